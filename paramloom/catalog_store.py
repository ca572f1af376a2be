"""Registered queries of the result store and of joins over its tables.

The store is filled from ``events``: an event type is a step, the pair (k,
user_id) its input, value its result, purchases are history. The fifth
version of a step (number 4) is left unregistered, so that audits find it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paramloom.catalog import _query, _scratch, _t, _uses, _USES, _VERSIONS
from paramloom.functions.canonical import address_column, canonical_column
from paramloom.operators import memo
from paramloom.sources.store import Store

_filled: dict[tuple[str, str], str] = {}


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(versions, results) as the store takes them."""
    uses = _uses(spark, sf_dir)
    versions = memo.version_numbers(uses, "step", "fingerprint", ["ts", "event_id"])
    events = _t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), "user_id", "value")
    rows = uses.join(versions, ["step", "fingerprint"]).join(events, "event_id")
    form = canonical_column(rows, {"k": "k", "user_id": "user_id"})
    rows = rows.withColumn("environment", form).withColumn("env_key", address_column(F.col("environment"))).select(
        "step", "version", "environment", "env_key", F.to_json(F.struct(F.col("value").alias("result"))).alias("data"),
        F.when(F.col("step") == "purchase", F.col("ts")).alias("created_at"), F.col("event_id").alias("seq"),
    )
    listed = versions.filter("version < 4").select(
        F.col("step").alias("name"), "version", F.col("fingerprint").alias("changelog"), F.expr("str_to_map(fingerprint, ',', ':')").alias("env_schema"), F.expr("version = 3").alias("current")
    )
    return listed, rows


def _new_store(spark: SparkSession, sf_dir: str) -> Store:
    store = Store(spark, _scratch(spark, "store"))
    versions, rows = _inputs(spark, sf_dir)
    store.register_all(versions)
    store.save_rows(rows)
    return store


def _store(spark: SparkSession, sf_dir: str) -> Store:
    """Filled once per session and data; the queries below only read it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _filled:
        _filled[key] = _new_store(spark, sf_dir).root
    return Store(spark, _filled[key])


_RESULTS = f"""{_USES}, {_VERSIONS},
rows AS (SELECT u.step, version, sha256('[{{"key":"k","cls":"n","text":"' || json_extract_string(props, '$.k') || '"}},{{"key":"user_id","cls":"n","text":"' || user_id || '"}}]') AS env_key,
  value AS result, CASE WHEN u.step = 'purchase' THEN epoch(u.ts)::double END AS created_at, u.event_id AS seq
  FROM uses u JOIN versions USING (step, fingerprint) JOIN events e ON e.event_id = u.event_id),
counted AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY step, version, env_key, created_at ORDER BY seq DESC) = 1)"""


def _shown(results: DataFrame) -> DataFrame:
    return results.select("step", "version", "env_key", F.get_json_object("data", "$.result").cast("double").alias("result"), (F.unix_micros("created_at") / F.lit(1_000_000.0)).alias("created_at"))


@_query(f"WITH {_USES}, {_VERSIONS} SELECT step AS name, version AS current_version FROM versions WHERE step = 'purchase' AND version = 3")
def q52_step_scan(spark, sf_dir):
    """A step's row by name."""
    return _store(spark, sf_dir).table("step").filter(F.col("name") == "purchase").select("name", "current_version")


@_query(f"WITH {_USES}, {_VERSIONS} SELECT step AS name, version, 'k1,value' AS parameters FROM versions WHERE step IN ('click', 'view', 'error') AND fingerprint = 'value:float,k1:int' AND version < 4")
def q53_version_scan(spark, sf_dir):
    """Versions by name and by their parameters' types."""
    found = [_store(spark, sf_dir).version_like(name, {"value": "float", "k1": "int"}) for name in ("click", "view", "error")]
    all_ = found[0].unionByName(found[1]).unionByName(found[2])
    return all_.select("name", "version", F.concat_ws(",", F.array_sort(F.map_keys("env_schema"))).alias("parameters"))


@_query(f"WITH {_RESULTS} SELECT step, version, env_key, result, created_at FROM counted WHERE step = 'click' AND version = 1 AND created_at IS NULL")
def q54_result_scan(spark, sf_dir):
    """The results that count of one step and version, without history."""
    return _shown(_store(spark, sf_dir).results("click", 1))


@_query(f"WITH {_RESULTS} SELECT step, version, env_key, result, created_at FROM rows WHERE step = 'purchase' AND created_at IS NOT NULL")
def q55_history_scan(spark, sf_dir):
    """Every time-stamped result of a step."""
    return _shown(_store(spark, sf_dir).results("purchase", history=True))


@_query(f"WITH {_RESULTS} SELECT step, version, env_key, result, created_at FROM counted")
def q56_upserted_table(spark, sf_dir):
    """The table after all writes: of equal keys the last."""
    return _shown(_store(spark, sf_dir).table("result"))


@_query(f"WITH {_RESULTS} SELECT step, count(*) AS n FROM rows WHERE step <> 'view' GROUP BY step")
def q57_cleared_step(spark, sf_dir):
    """A step's results forgotten, the others left."""
    store = _new_store(spark, sf_dir)
    store.clear("view")
    return store.raw("result").groupBy("step").agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {_RESULTS} SELECT v.step AS name, v.version, count(c.env_key) AS results FROM versions v LEFT JOIN counted c ON c.step = v.step AND c.version = v.version WHERE v.version < 4 GROUP BY ALL")
def q58_catalogue(spark, sf_dir):
    """Steps to versions to results, by their keys."""
    return _store(spark, sf_dir).catalogue().groupBy("name", "version").agg(F.count("env_key").alias("results"))


@_query(f"WITH {_RESULTS} SELECT step AS name, version, count(*) AS results FROM counted WHERE version >= 4 GROUP BY ALL")
def q59_orphans(spark, sf_dir):
    """Results that refer to a version which isn't recorded."""
    return _store(spark, sf_dir).orphans().groupBy("name", "version").agg(F.count(F.lit(1)).alias("results"))


@_query(f"WITH {_USES}, {_VERSIONS} SELECT step AS name, version, fingerprint AS changelog FROM versions WHERE step = 'signup' AND version = 0")
def q60_first_match(spark, sf_dir):
    """F8: the first version that fits."""
    return _store(spark, sf_dir).table("step_version").filter("name = 'signup' and version = 0").limit(1).select("name", "version", "changelog")


_DEMO = {
    "journeys": ("id int, name string", [(1, "Safari Adventure"), (2, "Mountain Trek")]),
    "paths": ("id int, name string, journey_id int", [(1, "Forest", 1), (2, "Desert", 1), (3, "Snow", 2)]),
    "environments": ("id int, name string, value string", [(1, "Hot_Env", "50"), (2, "Cold_Env", "-10")]),
    "bridge": ("path_id int, env_id int", [(1, 1), (2, 1), (3, 2)]),
}


def _demo(spark: SparkSession) -> dict[str, DataFrame]:
    """Small tables from rows in memory, a many-to-many bridge among them."""
    return {name: spark.createDataFrame(rows, schema) for name, (schema, rows) in _DEMO.items()}


def _demo_sql() -> str:
    return ", ".join(f"{name}({', '.join(c.split()[0] for c in schema.split(','))}) AS (VALUES {', '.join(map(repr, rows))})" for name, (schema, rows) in _DEMO.items())


@_query(f"""WITH {_demo_sql()} SELECT p.name AS path, j.name AS journey FROM paths p JOIN bridge ON path_id = p.id JOIN environments e ON e.id = env_id JOIN journeys j ON j.id = journey_id
WHERE p.name IN ('Forest', 'Desert') AND e.name = 'Hot_Env'""")
def q61_bridge_demo(spark, sf_dir):
    """Over the bridge, with IN and a literal on the joined table, and back to the owner."""
    t = _demo(spark)
    hot = t["environments"].filter("name = 'Hot_Env'").select(F.col("id").alias("env_id"))
    chosen = t["paths"].filter(F.col("name").isin("Forest", "Desert"))
    found = chosen.join(t["bridge"], chosen.id == t["bridge"].path_id).join(hot, "env_id")
    owners = t["journeys"].select(F.col("id").alias("journey_id"), F.col("name").alias("journey"))
    return found.join(owners, "journey_id").select(F.col("name").alias("path"), "journey")


@_query(f"""WITH {_demo_sql()} SELECT p.name AS path, j.name AS journey, e.value FROM paths p JOIN bridge ON path_id = p.id JOIN environments e ON e.id = env_id JOIN journeys j ON j.id = journey_id
WHERE j.name = 'Safari Adventure' AND p.name IN ('Forest', 'Desert') AND e.name = 'Hot_Env' AND e.value = '50'""")
def q62_four_table_demo(spark, sf_dir):
    """Literals on three joined tables."""
    t = _demo(spark)
    hot = t["environments"].filter("name = 'Hot_Env' and value = '50'").select(F.col("id").alias("env_id"), "value")
    owners = t["journeys"].filter("name = 'Safari Adventure'").select(F.col("id").alias("journey_id"), F.col("name").alias("journey"))
    chosen = t["paths"].filter(F.col("name").isin("Forest", "Desert")).join(owners, "journey_id")
    return chosen.join(t["bridge"], chosen.id == t["bridge"].path_id).join(hot, "env_id").select(F.col("name").alias("path"), "journey", "value")


@_query("SELECT user_id, event_type AS batch_id, arg_max(value, (ts, event_id)) AS result FROM events GROUP BY ALL")
def q63_batch_fold(spark, sf_dir):
    """A3, T4: a parent's runs as one map by batch id; here unfolded again."""
    runs = _t(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("batch_id"), "ts", "event_id", "value")
    maps = memo.by_batch(runs, "user_id", "batch_id", ["ts", "event_id", "value"])
    return maps.select("user_id", F.explode("runs").alias("batch_id", "r")).select("user_id", "batch_id", F.col("r.value").alias("result"))


@_query("""SELECT user_id, count(*) AS runs, round((epoch(max(ts)) - epoch(min(ts))) / count(*), 6) AS seconds_a_run FROM events GROUP BY user_id""")
def q64_run_counts_and_times(spark, sf_dir):
    """How many runs, and the mean time of one."""
    seconds = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / F.lit(1e6)
    return _t(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), F.round(seconds / F.count(F.lit(1)), 6).alias("seconds_a_run"))


@_query("""SELECT p_partkey, string_split(p_type || '.' || p_size || '.' || p_brand, '.')[2] AS part, array_to_string(string_split(p_type || '.' || p_size || '.' || p_brand, '.'), '.') AS dotted,
p_size::varchar AS as_text, p_size::varchar::double AS as_number FROM part""")
def q65_dotted_names(spark, sf_dir):
    """Dotted names apart and together, numbers to text and back."""
    p = _t(spark, sf_dir, "part").withColumn("name", F.concat_ws(".", "p_type", F.col("p_size").cast("string"), "p_brand"))
    parts = F.split("name", r"\.")
    text = F.col("p_size").cast("string")
    return p.select("p_partkey", parts[1].alias("part"), F.concat_ws(".", parts).alias("dotted"), text.alias("as_text"), text.cast("double").alias("as_number"))


@_query("SELECT event_type, true AS later, count(*) AS n FROM events GROUP BY event_type")
def q66_stamped_now(spark, sf_dir):
    """Rows stamped with the time of the query, one time for all of them."""
    now = F.current_timestamp()
    return _t(spark, sf_dir, "events").withColumn("at", now).groupBy("event_type").agg((F.min("at") > F.max(F.col("ts").cast("timestamp"))).alias("later"), F.count(F.lit(1)).alias("n"))


@_query("""SELECT event_id, round(sqrt(abs(value)), 6) AS root, round(exp(-value / 50), 6) + 0.0 AS decay, round(value / 10 * cos(value), 6) + 0.0 AS re, round(value / 10 * sin(value), 6) + 0.0 AS im,
round(atan2(value / 10 * sin(value), value / 10 * cos(value)), 6) + 0.0 AS angle FROM events""")
def q67_complex_numbers(spark, sf_dir):
    """Roots, exponentials, and complex numbers as pairs: r exp(i phi), its real part and its angle."""
    r, phi = F.col("value") / 10, F.col("value")
    z = F.struct((r * F.cos(phi)).alias("re"), (r * F.sin(phi)).alias("im"))
    made = _t(spark, sf_dir, "events").withColumn("z", z)
    zero = F.lit(0.0)
    return made.select(
        "event_id", F.round(F.sqrt(F.abs("value")), 6).alias("root"), (F.round(F.exp(-F.col("value") / 50), 6) + zero).alias("decay"),
        (F.round("z.re", 6) + zero).alias("re"), (F.round("z.im", 6) + zero).alias("im"), (F.round(F.atan2("z.im", "z.re"), 6) + zero).alias("angle"),
    )
