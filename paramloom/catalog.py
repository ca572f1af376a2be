"""Registered queries of the engine and their SQL.

Each runs one operator over the driver's tables. SQL is for DuckDB; results
of float arithmetic are rounded on both sides where the engines differ in the
last digit.
"""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paramloom.functions import signals
from paramloom.functions.canonical import address_column, canonical_column, epoch_seconds, type_name
from paramloom.operators import memo
from paramloom.plans import graph
from paramloom.sources.codecs import default_registry

FLAGSHIP = "q09_memo_sweep"
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parameters of each event, one row each: (event_id, key, type, text, num)."""
    events = _t(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))

    def one(key: str, kind: str, column: F.Column) -> F.Column:
        text = column.cast("string") if kind in ("str", "int") else F.lit(None).cast("string")
        num = F.lit(None).cast("double") if kind == "str" else column.cast("double")
        return F.struct(F.lit(key).alias("key"), F.lit(kind).alias("type"), text.alias("text"), num.alias("num"))

    parts = F.array(
        one("event_type", "str", F.col("event_type")), one("props.k", "int", F.col("k")), one("ts", "float", epoch_seconds("ts")),
        one("user_id", "int", F.col("user_id")), one("value", "float", F.col("value")),
    )
    return events.select("event_id", F.inline(parts))


_ENTRIES = """entries AS (
  SELECT event_id, 'event_type' AS key, 'str' AS type, event_type AS text, NULL::double AS num FROM events
  UNION ALL SELECT event_id, 'props.k', 'int', json_extract_string(props, '$.k'), json_extract_string(props, '$.k')::double FROM events
  UNION ALL SELECT event_id, 'ts', 'float', NULL, epoch(ts)::double FROM events
  UNION ALL SELECT event_id, 'user_id', 'int', user_id::varchar, user_id::double FROM events
  UNION ALL SELECT event_id, 'value', 'float', NULL, value FROM events)"""


@_query(f"WITH {_ENTRIES} SELECT * FROM entries")
def q01_env_flatten(spark, sf_dir):
    return _entries(spark, sf_dir)


_TYPED = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
}
_NAMES = "CASE any_value(typeof({c})) WHEN 'BIGINT' THEN 'int' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'float' WHEN 'VARCHAR' THEN 'str' WHEN 'BOOLEAN' THEN 'bool' ELSE 'datetime' END"


@_query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, {_NAMES.format(c=c)} AS type_name FROM {t}" for t, cs in _TYPED.items() for c in cs))
def q02_type_names(spark, sf_dir):
    rows = [(t, f.name, type_name(f.dataType)) for t in _TYPED for f in _t(spark, sf_dir, t).schema.fields]
    return spark.createDataFrame(rows, "table_name string, column_name string, type_name string")


@_query("SELECT event_id, epoch(ts)::double AS seconds FROM events")
def q03_epoch_cast(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", epoch_seconds("ts").alias("seconds"))


@_query(f"""WITH {_ENTRIES}, m AS (SELECT event_id, key, (event_id + length(key)) % 2 = 0 AS used, key <> 'props.k' AS visible FROM entries),
s(show_unused, show_invisible) AS (VALUES (false, false), (false, true), (true, false), (true, true))
SELECT show_unused, show_invisible, event_id, key FROM m, s WHERE (used OR show_unused) AND (visible OR show_invisible)""")
def q04_visible_used_filter(spark, sf_dir):
    marks = _entries(spark, sf_dir).select(
        "event_id", "key", ((F.col("event_id") + F.length("key")) % 2 == 0).alias("used"), (F.col("key") != "props.k").alias("visible")
    )
    settings = spark.createDataFrame([(a, b) for a in (False, True) for b in (False, True)], "show_unused boolean, show_invisible boolean")
    return memo.visible(marks, settings).select("show_unused", "show_invisible", "event_id", "key")


@_query(f"""WITH {_ENTRIES}, a(name, target) AS (VALUES ('r', 'props.k'), ('who', 'user_id'))
SELECT event_id, name AS key, text FROM entries JOIN a ON key = target""")
def q05_refer_resolve(spark, sf_dir):
    names = spark.createDataFrame([("r", "props.k"), ("who", "user_id")], "name string, target string")
    return memo.aliased(_entries(spark, sf_dir), names).select("event_id", "key", "text")


@_query("""SELECT o_orderkey, sha256('[{"key":"custkey","cls":"n","text":"' || o_custkey || '"},{"key":"orderkey","cls":"n","text":"' || o_orderkey
|| '"},{"key":"priority","cls":"s","text":"' || o_orderpriority || '"},{"key":"status","cls":"s","text":"' || o_orderstatus || '"}]') AS address FROM orders""")
def q06_content_address(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    keys = {"orderkey": "o_orderkey", "custkey": "o_custkey", "status": "o_orderstatus", "priority": "o_orderpriority"}
    return orders.select("o_orderkey", address_column(canonical_column(orders, keys)).alias("address"))


def _sweep_and_store(spark, sf_dir):
    """All events, and a store of the values that purchases had."""
    events = _t(spark, sf_dir, "events")
    store = events.filter("event_type = 'purchase'").select("value").distinct()
    return events.select("event_id", "value"), store


_STORE = "store AS (SELECT DISTINCT value FROM events WHERE event_type = 'purchase')"


@_query(f"WITH {_STORE} SELECT event_id, value FROM events WHERE value IN (SELECT value FROM store)")
def q07_memo_hits(spark, sf_dir):
    return memo.hits(*_sweep_and_store(spark, sf_dir), ["value"])


@_query(f"WITH {_STORE} SELECT event_id, value FROM events WHERE value NOT IN (SELECT value FROM store)")
def q08_memo_misses(spark, sf_dir):
    return memo.misses(*_sweep_and_store(spark, sf_dir), ["value"])


@_query(f"""WITH {_STORE} SELECT event_id, e.value, e.value * e.value AS result, CASE WHEN s.value IS NULL THEN 'computed' ELSE 'cache' END AS source
FROM events e LEFT JOIN store s ON e.value = s.value""")
def q09_memo_sweep(spark, sf_dir):
    sweep, known = _sweep_and_store(spark, sf_dir)
    store = known.withColumn("result", F.col("value") * F.col("value"))
    return memo.recall(sweep, store, ["value"], ["result"], {"result": F.col("value") * F.col("value")})


@_query("""SELECT user_id, event_type, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def q10_upsert_latest(spark, sf_dir):
    writes = _t(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return memo.latest(writes, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@_query("""SELECT user_id, event_id, epoch(ts)::double AS created_at, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::int AS run
FROM events WHERE event_type = 'purchase'""")
def q11_history_append(spark, sf_dir):
    stamped = _t(spark, sf_dir, "events").withColumn("created_at", F.when(F.col("event_type") == "purchase", F.col("ts")))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return stamped.filter(F.col("created_at").isNotNull()).select("user_id", "event_id", epoch_seconds("created_at").alias("created_at"), F.row_number().over(order).alias("run"))


def _uses(spark, sf_dir):
    return _t(spark, sf_dir, "events").select(
        F.col("event_type").alias("step"), F.concat(F.lit("value:float,k"), (F.col("user_id") % 5).cast("string"), F.lit(":int")).alias("fingerprint"), "ts", "event_id"
    )


_USES = "uses AS (SELECT event_type AS step, 'value:float,k' || (user_id % 5) || ':int' AS fingerprint, ts, event_id FROM events)"
_VERSIONS = """versions AS (SELECT step, fingerprint, (dense_rank() OVER (PARTITION BY step ORDER BY t, i) - 1)::int AS version FROM
(SELECT step, fingerprint, arg_min(ts, (ts, event_id)) AS t, arg_min(event_id, (ts, event_id)) AS i FROM uses GROUP BY ALL))"""


@_query(f"WITH {_USES}, {_VERSIONS} SELECT * FROM versions")
def q12_version_numbers(spark, sf_dir):
    return memo.version_numbers(_uses(spark, sf_dir), "step", "fingerprint", ["ts", "event_id"])


@_query(f"WITH {_USES}, {_VERSIONS} SELECT step, arg_max(version, (ts, event_id)) AS current_version FROM uses JOIN versions USING (step, fingerprint) GROUP BY step")
def q13_current_version(spark, sf_dir):
    uses = _uses(spark, sf_dir)
    versions = memo.version_numbers(uses, "step", "fingerprint", ["ts", "event_id"])
    return memo.current_version(uses.join(versions, ["step", "fingerprint"]), "step", "version", ["ts", "event_id"])


@_query("""SELECT c_custkey AS step, coalesce(max(o_orderkey) + 1, 0) AS next_version
FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey GROUP BY c_custkey""")
def q14_next_version(spark, sf_dir):
    steps = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("step"))
    versions = _t(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("step"), F.col("o_orderkey").alias("version"))
    return memo.next_version(steps, versions, "step", "version")


@_query("SELECT o_orderkey AS top_order, o_custkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey DESC LIMIT 1")
def q14b_top_version(spark, sf_dir):
    return _t(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").orderBy(F.desc("o_orderkey")).limit(1).select(F.col("o_orderkey").alias("top_order"), "o_custkey")


@_query("""SELECT c_name, o_orderkey, l_linenumber, l_quantity FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'MACHINERY' AND l_returnflag = 'R'""")
def q15_fk_navigation(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").filter("c_mktsegment = 'MACHINERY'")
    o, lines = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    joined = c.join(o, c.c_custkey == o.o_custkey).join(lines, o.o_orderkey == lines.l_orderkey)
    return joined.select("c_name", "o_orderkey", "l_linenumber", "l_quantity")


@_query("""SELECT DISTINCT p_name, s_name FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
WHERE p_type IN ('ECONOMY', 'PROMO') AND s_nationkey = 3""")
def q16_bridge_join_in(spark, sf_dir):
    p = _t(spark, sf_dir, "part").filter(F.col("p_type").isin("ECONOMY", "PROMO"))
    s = _t(spark, sf_dir, "supplier").filter("s_nationkey = 3")
    bridge = _t(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    return bridge.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).select("p_name", "s_name").distinct()


@_query("""SELECT r_name, n_name, c_name, o_orderkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
JOIN orders ON o_custkey = c_custkey WHERE r_regionkey = 1 AND o_orderpriority = '1-URGENT' AND c_acctbal > 5000""")
def q17_three_entity_join(spark, sf_dir):
    r, n = _t(spark, sf_dir, "region").filter("r_regionkey = 1"), _t(spark, sf_dir, "nation")
    c = _t(spark, sf_dir, "customer").filter("c_acctbal > 5000")
    o = _t(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    joined = r.join(n, r.r_regionkey == n.n_regionkey).join(c, c.c_nationkey == n.n_nationkey).join(o, o.o_custkey == c.c_custkey)
    return joined.select("r_name", "n_name", "c_name", "o_orderkey")


@_query("SELECT n_nationkey AS parent, (n_nationkey * 7 + 3) % 31 AS child FROM nation WHERE (n_nationkey * 7 + 3) % 31 NOT IN (SELECT n_nationkey FROM nation)")
def q18_missing_deps(spark, sf_dir):
    nodes = _t(spark, sf_dir, "nation")
    edges = nodes.select(F.col("n_nationkey").alias("parent"), F.expr("(n_nationkey * 7 + 3) % 31").alias("child"))
    return graph.missing_steps(edges, nodes, "child", "n_nationkey").select("parent", "child")


@_query("""WITH RECURSIVE e AS (SELECT n_nationkey AS parent, (n_nationkey * 3 + 1) % 25 AS child FROM nation),
w(node, pos, length, path) AS (SELECT parent, child, 1, parent || '>' || child FROM e
UNION ALL SELECT w.node, e.child, w.length + 1, w.path || '>' || e.child FROM w JOIN e ON w.pos = e.parent WHERE w.pos <> w.node AND w.length < 60)
SELECT node, length, path FROM w WHERE pos = node""")
def q19_cycles(spark, sf_dir):
    edges = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("parent"), F.expr("(n_nationkey * 3 + 1) % 25").alias("child"))
    return graph.cycles(spark, edges)


@_query("""WITH RECURSIVE e AS (SELECT (n_nationkey - 1) // 2 AS parent, n_nationkey AS child FROM nation WHERE n_nationkey > 0),
d(node, level) AS (SELECT 0::bigint, 0 UNION ALL SELECT e.child::bigint, d.level + 1 FROM d JOIN e ON d.node = e.parent)
SELECT node, min(level) AS level, greatest(2 - min(level), 0) AS remaining, greatest(2 - min(level), 0) > 0 AS forced FROM d GROUP BY node""")
def q20_force_depth(spark, sf_dir):
    edges = _t(spark, sf_dir, "nation").filter("n_nationkey > 0").select(F.expr("cast((n_nationkey - 1) div 2 as int)").alias("parent"), F.col("n_nationkey").alias("child"))
    return graph.forced(graph.levels(spark, edges, 0), 2)


@_query(f"""WITH {_ENTRIES}, a AS (SELECT DISTINCT key, type AS left_type FROM entries),
b(key, right_type) AS (VALUES ('event_type', 'str'), ('props.k', 'float'), ('ts', 'float'), ('apples', 'int'), ('value', 'float'))
SELECT key, left_type, right_type FROM a FULL JOIN b USING (key) WHERE left_type IS DISTINCT FROM right_type""")
def q21_schema_diff(spark, sf_dir):
    left = _entries(spark, sf_dir).select("key", "type").distinct()
    right = spark.createDataFrame([("event_type", "str"), ("props.k", "float"), ("ts", "float"), ("apples", "int"), ("value", "float")], "key string, type string")
    return memo.schema_diff(left, right)


@_query("""SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END::double, 2.0) AS o, 1::bigint AS a,
coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_size END::bigint, 3) AS apples FROM part""")
def q22_override_merge(spark, sf_dir):
    sweep = _t(spark, sf_dir, "part").select(
        "p_partkey", F.expr("if(p_partkey % 3 = 0, null, p_size)").alias("o"), F.expr("if(p_partkey % 2 = 0, p_size, null)").alias("apples")
    )
    return memo.overlay(sweep, {"o": 2.0, "a": 1, "apples": 3})


@_query(f"WITH {_ENTRIES} SELECT key, bool_or((event_id + length(key)) % 97 = 0 AND key <> 'ts') AS used FROM entries GROUP BY key")
def q23_usage_merge(spark, sf_dir):
    marks = _entries(spark, sf_dir).select("key", F.expr("(event_id + length(key)) % 97 = 0 and key <> 'ts'").alias("used"))
    return memo.merged_use(marks)


@_query("SELECT d.doc_id, coalesce(quality::bigint, n_chars) AS result, CASE WHEN quality IS NULL THEN 'file' ELSE 'sql' END AS kind FROM documents d LEFT JOIN labels l USING (doc_id)")
def q24_result_coalesce(spark, sf_dir):
    d, small = _t(spark, sf_dir, "documents").select("doc_id", "n_chars"), _t(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(small, "doc_id", "left").select(
        "doc_id", F.coalesce(F.col("quality").cast("bigint"), "n_chars").alias("result"), F.when(F.col("quality").isNull(), "file").otherwise("sql").alias("kind")
    )


@_query("SELECT i, 1.0::double + i * ((10.0::double - 1.0::double) / 10.0::double) AS x FROM range(11) t(i)")
def q25_linspace(spark, sf_dir):
    return signals.linspace(spark, 1.0, 10.0, 11)


@_query("SELECT i, 0.0::double + i * 0.25::double AS x FROM range(40) t(i)")
def q26_arange(spark, sf_dir):
    return signals.arange(spark, 0.0, 10.0, 0.25)


@_query(f"""SELECT user_id, len(es) AS n, round(list_reduce(list_prepend(0.0::double, es), lambda x, e:
x + 0.7 * (0.0 - x) * 0.01 + {0.3 * math.sqrt(0.01)!r} * e), 6) AS x FROM (SELECT user_id, list(value ORDER BY ts, event_id) AS es FROM events GROUP BY user_id)""")
def q27_recurrence(spark, sf_dir):
    ends = signals.last_of_relaxation(_t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 0.7, 0.0, 0.3, 0.01)
    return ends.select("user_id", "n", F.round("x", 6).alias("x"))


@_query("SELECT user_id, event_id, round(value / nullif(stddev_pop(value) OVER (PARTITION BY user_id), 0), 6) AS standardised FROM events")
def q28_standardise(spark, sf_dir):
    return signals.standardised(_t(spark, sf_dir, "events"), "user_id", "value").select("user_id", "event_id", F.round("standardised", 6).alias("standardised"))


_DF = 1.0 / (1024 * 0.01)


@_query(f"""WITH f AS (SELECT i, i * {_DF!r}::double AS f FROM range(513) t(i)), s AS (SELECT *, CASE WHEN f BETWEEN 1.0 AND 20.0 AND f > 0 THEN 1 / f ELSE 0 END AS s FROM f)
SELECT i, round(f, 6) AS f, round(sqrt(s / (2 * sum(s) OVER () * {_DF!r}::double)), 6) AS amplitude FROM s""")
def q29_band_mask_norm(spark, sf_dir):
    return signals.pink_weights(spark, 1024, 0.01, 1.0, 20.0).select("i", F.round("f", 6).alias("f"), F.round("amplitude", 6).alias("amplitude"))


@_query("""WITH x AS (SELECT vec_id, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) - 1 AS i, len(embedding) AS n FROM embeddings),
k AS (SELECT unnest(range(33))::int AS k)
SELECT vec_id, k, round(sqrt(power(sum(x * cos(-2 * pi() * ((k * i) % n) / n)), 2) + power(sum(x * sin(-2 * pi() * ((k * i) % n) / n)), 2)), 5) AS magnitude FROM x, k GROUP BY vec_id, k""")
def q30_dft_magnitude(spark, sf_dir):
    return signals.dft(_t(spark, sf_dir, "embeddings"), "vec_id", "embedding").select("vec_id", "k", F.round("magnitude", 5).alias("magnitude"))


@_query("""SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start FROM conversations""")
def q31_pulse_offsets(spark, sf_dir):
    turns = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("width"))
    return signals.offsets(turns, "conv_id", "turn", "width").select("conv_id", "turn", "start")


@_query("SELECT role, max(total)::bigint AS longest, count(*) AS n FROM (SELECT conv_id, role, sum(length(text)) AS total FROM conversations GROUP BY ALL) GROUP BY role")
def q32_pulse_total(spark, sf_dir):
    totals = _t(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.sum(F.length("text")).alias("total"))
    return totals.groupBy("role").agg(F.max("total").alias("longest"), F.count(F.lit(1)).alias("n"))


_ITEM = "p_type || CASE p_partkey % 5 WHEN 0 THEN '_X' WHEN 1 THEN '_Y' WHEN 2 THEN '_-X' WHEN 3 THEN '_-Y' ELSE '' END"


@_query(f"""WITH i AS (SELECT p_partkey, {_ITEM} AS item FROM part)
SELECT p_partkey, CASE WHEN contains(item, '_-X') THEN {math.pi!r} WHEN contains(item, '_-Y') THEN {-math.pi / 2!r} WHEN contains(item, '_X') THEN 0.0 WHEN contains(item, '_Y') THEN {math.pi / 2!r} ELSE 0.0 END::double AS phase,
replace(replace(replace(replace(item, '_-X', ''), '_-Y', ''), '_X', ''), '_Y', '') AS pulse FROM i""")
def q33_flag_parse(spark, sf_dir):
    items = _t(spark, sf_dir, "part").select("p_partkey", F.expr(_ITEM).alias("item"))
    phase, plain = signals.flag_phase("item")
    return items.select("p_partkey", phase.alias("phase"), plain.alias("pulse"))


@_query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events) WHERE i % 7 = 0")
def q34_stride_sample(spark, sf_dir):
    return signals.strided(_t(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value"), "user_id", ["ts", "event_id"], 7).drop("ts")


@_query("""SELECT vec_id, round(acos(embedding[3]::double / sqrt(embedding[1]::double ** 2 + embedding[2]::double ** 2 + embedding[3]::double ** 2)), 6) AS theta,
round(atan2(embedding[2]::double, embedding[1]::double), 6) AS phi FROM embeddings""")
def q35_angles(spark, sf_dir):
    x, y, z = (F.col("embedding")[i].cast("double") for i in range(3))
    theta, phi = signals.sphere_angles(x, y, z)
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.round(theta, 6).alias("theta"), F.round(phi, 6).alias("phi"))


@_query("""WITH p AS (SELECT user_id, event_id, ts, atan2(sin(value), cos(value)) AS phase FROM events),
d AS (SELECT *, phase - lag(phase) OVER w AS d FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
m AS (SELECT *, d + pi() - floor((d + pi()) / (2 * pi())) * 2 * pi() - pi() AS t FROM d),
c AS (SELECT *, CASE WHEN d IS NULL THEN 0 WHEN abs(d) < pi() THEN 0 WHEN t = -pi() AND d > 0 THEN pi() - d ELSE t - d END AS c FROM m)
SELECT user_id, event_id, round(phase + sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS unwrapped FROM c""")
def q36_unwrap(spark, sf_dir):
    phases = _t(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.atan2(F.sin("value"), F.cos("value")).alias("phase"))
    return signals.unwrapped(phases, "user_id", ["ts", "event_id"], "phase").select("user_id", "event_id", F.round("unwrapped", 6).alias("unwrapped"))


@_query("""SELECT event_id, round(exp(-(t * t) / 6400), 8) AS gauss, round(exp(-t / 30), 8) AS expo,
round(exp(-(t * t) / 6400) * exp(-t / 30) * (-2 * t / 6400 - 1.0 / 30), 8) + 0.0 AS slope FROM (SELECT event_id, value::double AS t FROM events)""")
def q37_decay(spark, sf_dir):
    t, a, b = F.col("value"), F.lit(80.0), F.lit(30.0)
    return _t(spark, sf_dir, "events").select(
        "event_id", F.round(signals.gaussian_decay(t, a), 8).alias("gauss"), F.round(signals.exponential_decay(t, b), 8).alias("expo"), (F.round(signals.decay_slope(t, a, b), 8) + F.lit(0.0)).alias("slope")
    )


@_query("""WITH RECURSIVE e AS (SELECT user_id, event_id, value / 200 AS w, value / 7 AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s(user_id, i, re, im, lost, path, mag) AS (
  SELECT user_id, 0::bigint, 0.0::double, 0.0::double, 0.0::double, 0.0::double, 0.0::double FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT user_id, i, CASE WHEN gone > len THEN 0 WHEN len = 0 THEN re ELSE re * (1 - gone / len) END, CASE WHEN gone > len THEN 0 WHEN len = 0 THEN im ELSE im * (1 - gone / len) END,
         lost + least(gone, len), len + lost, mag
  FROM (SELECT *, (len + lost - before) * exp(-(len + lost) * (len + lost)) * (exp(-(len + lost) / 0.5) / 0.5 - 2 * (len + lost) * (1 - exp(-(len + lost) / 0.5))) AS gone
        FROM (SELECT *, sqrt(re * re + im * im) AS len FROM (
          SELECT s.user_id, e.i, s.re + 0.02 * 2 * e.w * cos(e.a) AS re, s.im + 0.02 * 2 * e.w * sin(e.a) AS im, s.lost, sqrt(s.re * s.re + s.im * s.im) + s.lost AS before, 2 * e.w AS mag
          FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1))))
SELECT user_id, event_id, round(exp(-path * path), 6) + 0.0 AS purity, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im, round(mag, 6) + 0.0 AS magnitude,
       round(lost, 6) + 0.0 AS forgotten, round(path, 6) + 0.0 AS path FROM s JOIN e USING (user_id, i)""")
def q38_stateful_recurrence(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").selectExpr("user_id", "event_id", "ts", "value / 200 as w", "value / 7 as a")
    kept = signals.coherence(rows, "user_id", ["ts", "event_id"], "w", "a", 0.02, 1.0, 0.5)
    return kept.select("user_id", "event_id", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("purity", "re", "im", "magnitude", "forgotten", "path")])


#: Folders of local sessions that name none, by application: the setting can't be changed while one runs.
_own: dict[str, str] = {}


def _scratch(spark: SparkSession, name: str) -> str:
    """A folder in the cluster's shared one; a local session without it makes its own."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        place = _own[app] = _own.get(app) or tempfile.mkdtemp(prefix="paramloom-")
    return f"{place}/{name}-{uuid.uuid4().hex}"


@_query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def q39_typed_roundtrip(spark, sf_dir):
    registry, path = default_registry(), _scratch(spark, "roundtrip")
    writer, _ = registry.write(spark, _t(spark, sf_dir, "events"), path)
    return registry.read(spark, writer, path)


_UNIFORM = "(('0x' || substr(md5({}), 1, 13))::bigint / 4503599627370496.0::double)"


@_query(f"""SELECT i, round(sqrt(-2 * ln(1 - {_UNIFORM.format("'7:' || i || ':r'")})) * cos(2 * pi() * {_UNIFORM.format("'7:' || i || ':a'")}), 6) + 0.0 AS e FROM range(10000) t(i)""")
def q40_noise_generation(spark, sf_dir):
    return signals.gaussian(spark, 10_000, 7).select("i", (F.round("e", 6) + F.lit(0.0)).alias("e"))


@_query("SELECT event_id, value, value * value AS result FROM events")
def q41_opaque_step(spark, sf_dir):
    def square(batches):
        for pdf in batches:
            yield pdf.assign(result=pdf["value"] * pdf["value"])

    return _t(spark, sf_dir, "events").select("event_id", "value").mapInPandas(square, "event_id long, value double, result double")


@_query("SELECT user_id, event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM events")
def q42_lag_delta(spark, sf_dir):
    return signals.difference(_t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value").select("user_id", "event_id", "delta")


@_query("""SELECT user_id, (row_number() OVER w - 1)::int AS i, value AS x, value * value AS y, count(*) OVER (PARTITION BY user_id)::int AS n FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def q43_sweep_fold(spark, sf_dir):
    runs = _t(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("ord"), F.col("value").alias("xs"), (F.col("value") * F.col("value")).alias("ys"))
    folds = memo.folded(runs, "user_id", "ord", ["xs", "ys"])
    points = folds.select("user_id", "n", F.posexplode(F.arrays_zip("xs", "ys")).alias("i", "p"))
    return points.select("user_id", "i", F.col("p.xs").alias("x"), F.col("p.ys").alias("y"), "n")


_PULSES = """SELECT n_nationkey % 3 AS channel, n_nationkey * 1.5::double AS start, 1.0::double + n_regionkey AS width, 0.25::double AS t_ramp, 1.0::double AS amplitude, 0.5::double AS frequency, 0.0::double AS phase FROM nation"""


@_query(f"""WITH p AS ({_PULSES}), t AS (SELECT i, i * 0.1::double AS t FROM range(420) r(i)),
x AS (SELECT channel, i, t, t - start AS at, least(t - start, width - (t - start)) AS edge, amplitude, t_ramp, frequency, phase FROM p JOIN t ON t >= start AND t <= start + width)
SELECT channel, i, round(sum(CASE WHEN edge >= t_ramp THEN amplitude ELSE amplitude * 0.5 * (1 - cos(pi() * edge / t_ramp)) END * cos(2 * pi() * frequency * t + phase)), 6) + 0.0 AS signal FROM x GROUP BY channel, i""")
def q44_pulse_train(spark, sf_dir):
    pulses = _t(spark, sf_dir, "nation").selectExpr(
        "n_nationkey % 3 as channel", "n_nationkey * 1.5D as start", "1.0D + n_regionkey as width", "0.25D as t_ramp", "1.0D as amplitude", "0.5D as frequency", "0.0D as phase"
    )
    times = spark.range(420).select(F.col("id").alias("i"), F.expr("id * 0.1D").alias("t"))
    return signals.pulse_train(times, pulses, 4.0).select("channel", "i", (F.round("signal", 6) + F.lit(0.0)).alias("signal"))


@_query(f"""WITH s AS (SELECT event_type, count(*) AS runs, avg(value) AS mean, var_pop(value) AS var, min(value) AS low, max(value) AS high FROM events GROUP BY event_type)
SELECT event_type, runs, round(mean, 6) AS mean, round(var, 6) AS var, low, high FROM s""")
def q45_trace_statistics(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.var_pop("value"), 6).alias("var"), F.min("value").alias("low"), F.max("value").alias("high")
    )


@_query("""SELECT event_id, round(atan2(sin(value), cos(value)), 6) AS phase, CASE WHEN value < 20 THEN 'rise' WHEN value < 80 THEN 'hold' ELSE 'fall' END AS piece FROM events""")
def q46_phase_pieces(spark, sf_dir):
    piece = F.when(F.col("value") < 20, "rise").when(F.col("value") < 80, "hold").otherwise("fall")
    return _t(spark, sf_dir, "events").select("event_id", F.round(F.atan2(F.sin("value"), F.cos("value")), 6).alias("phase"), piece.alias("piece"))


@_query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def q47_single_row_audit(spark, sf_dir):
    return memo.one_per_key(_t(spark, sf_dir, "events"), ["user_id", "event_type"])


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def q48_orphan_results(spark, sf_dir):
    known = _t(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return _t(spark, sf_dir, "lineitem").join(known, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


@_query(f"""WITH k AS (SELECT s AS series_id, k, {_UNIFORM.format("'3:' || s || ':' || k")} AS u, k * {_DF!r}::double AS f FROM range(4) a(s), range(513) b(k)),
x AS (SELECT series_id, i, sum(cos(2 * pi() * ((k * i) % 1024) / 1024 + 2 * pi() * u) / sqrt(f)) AS x FROM k, range(1024) c(i) WHERE f BETWEEN 1.0 AND 20.0 AND k > 0 GROUP BY ALL)
SELECT series_id, i, round(x / stddev_pop(x) OVER (PARTITION BY series_id), 6) + 0.0 AS value FROM x""")
def q49_pink_noise(spark, sf_dir):
    traces = signals.pink_traces(spark, 4, 1024, 0.01, 1.0, 20.0, seed=3)
    return traces.select("series_id", "i", (F.round("value", 6) + F.lit(0.0)).alias("value"))


@_query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
s(user_id, i, x) AS (SELECT DISTINCT user_id, 0::bigint, 0.0::double FROM events
UNION ALL SELECT s.user_id, e.i, s.x + 0.7 * (0.0 - s.x) * 0.01 + {0.3 * math.sqrt(0.01)!r} * e.value FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
SELECT user_id, event_id, round(x, 6) + 0.0 AS x FROM s JOIN e USING (user_id, i)""")
def q50_relaxation_states(spark, sf_dir):
    rows = signals.states(_t(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", ["event_id"], "value", 0.7, 0.0, 0.3, 0.01)
    return rows.select("user_id", "event_id", (F.round("x", 6) + F.lit(0.0)).alias("x"))


@_query("SELECT event_id, value AS o, value * value AS result, 'cache' AS source FROM events")
def q51_study_sweep(spark, sf_dir):
    """A whole study: a sweep over events through the store, twice; the second run is all cache."""
    from paramloom.plans.study import Step, Study

    power = Step("power", expression={"result": F.col("o") * F.col("o")}, uses=["o"])
    study = Study(spark, _scratch(spark, "study"), steps=[power])
    sweep = _t(spark, sf_dir, "events").select("event_id", F.col("value").alias("o"))
    study.run_sweep("power", sweep)
    return study.run_sweep("power", sweep)


# the other catalogues register themselves here
from paramloom import catalog_runs, catalog_sets, catalog_store  # noqa: E402, F401
