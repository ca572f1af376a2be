"""Near-duplicate groups by bottom-k sketches of word shingles.

A document's set holds its distinct 5-word shingles (words as runs of other
than ASCII white space, A-Z lower-cased; the whole sequence if it is
shorter). Documents link at a Jaccard similarity of ``PERCENT`` / 100 or
more; a group is a connected component of links.

1. One hash function; each document retains the smallest of its hashes, as
   many as ``retained`` says: a bottom-k sketch whose k grows with the set.
   Documents with equal sets become one node.
2. Inverted lists of retained values: the smallest common values of a linked
   pair are retained by both, ``sure_common`` of them at least. A document
   with fewer values that others retain too has no partner.
3. Of the documents left, the same count over whole sets, and each indexes its
   rarest shingles: the prefix that any partner must meet, with positions, so
   that lists bound the overlap of a pair.
4. Each list links its members to its most central one (a star, not all
   pairs). Then the members outside a list's largest component meet those of
   other components that can still reach the threshold by size and position;
   lists are split by size, and a member meets only the sizes that its place
   in the list leaves possible.
5. Up to the smaller of two sketches' ends the union sketch of a pair is known
   whole. What it shares, and what lies beyond, bound the overlap; pairs that
   can still link are verified by exact Jaccard on the words of both texts.

No step loses a link: every bound is exact and every pair is verified on full
sets. ``loss`` above zero adds the estimate of the union sketch's smallest
``K`` values, which drops a pair at the threshold with at most that chance.

Scale. Shuffles carry hashes and ids. The texts of step 3 are picked by a
broadcast of their keys if these are at most scratch.SMALL, else by one
shuffle of the texts; those of candidates are shuffled for verification.
Lists are counted with map-side aggregation and stars are joins of stored
tables, which Spark splits where a list is long. A shingle in very many documents is the last to
be indexed, so it makes a list only for documents that have hardly any rarer
ones. Components run on distributed edges.

Edge cases. Null or empty text: empty set, own component, kept. A null doc_id
never names a component unless all of it are null. Repeated rows are members
like any other; of rows with the component's doc_id all are kept by the
contract, ``keep_one`` keeps exactly one. Empty tables give empty results.
"""

from __future__ import annotations

from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paramloom.llm.graph import components
from paramloom.llm.scratch import Scratch, bounded_batches, if_small, numbered_rows, text_or_empty, unboxed, without, worker_state

WIDTH = 5
PERCENT = 85
K = 16
#: A chance of losing a pair at the threshold, for those who want fewer verifications.
LOSS = 3e-7


def _tables():
    state = worker_state()
    if "shingles" not in state:
        rng = np.random.default_rng(20240229)
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        space = np.zeros(256, dtype=bool)
        space[[32, 9, 10, 11, 12, 13]] = True
        value = rng.integers(1, 2**63, 256, dtype=np.uint64)[lower]
        power = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, dtype=np.uint64))
        state["shingles"] = space, value, power, rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
    return state["shingles"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    space, value, power, factor = _tables()
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    blank = space[raw]
    at = np.flatnonzero(~blank)
    if not len(at):
        return np.zeros(0, dtype=np.int64)
    new = np.empty(len(at), dtype=bool)
    new[0] = True
    np.not_equal(np.diff(at), 1, out=new[1:])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(at))
    place = np.arange(len(at)) - np.repeat(starts, ends - starts)
    word = np.add.reduceat(value[raw[at]] * power[place & 4095] + (place >> 12).astype(np.uint64), starts)
    word = _mix(word + (ends - starts).astype(np.uint64) * factor[0])
    n = min(width, len(word))
    total = np.full(len(word) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        total = total + word[i : len(word) - n + 1 + i] * factor[i + 1]
    return np.unique(_mix(total).view(np.int64))


def shingle_set(text: str, width: int = WIDTH) -> set:
    """The shingles themselves."""
    words = text.encode("utf-8", "replace").lower().split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(width))))


def spare(n: int, percent: int) -> int:
    """How many of n shingles a partner may lack."""
    return (100 - percent) * n // 100


def retained(n: int, percent: int, k: int = K) -> int:
    """The size of the sketch of n shingles."""
    return min(n, k + spare(n, percent) + spare(n, percent) // 2)


def sure_common(n: int, percent: int, k: int = K) -> int:
    """How many retained values a document of n shingles has in common with those of any partner, at least.

    A common value of rank j among the common ones has at most rank
    j + spare(n) in a set, so both retain the first retained(n) - spare(n)
    of the smaller set; that grows with n, and n - spare(n) is the smallest
    partner.
    """
    m = n - spare(n, percent)
    return retained(m, percent, k) - spare(m, percent)


def _sketcher(k: int, percent: int):
    def sketch(batches):
        salt = _tables()[3]
        for batch in batches:
            n, least, d1, d2, low = [], [], [], [], []
            for value in batch.column("text"):
                hashes = shingle_hashes(value.as_py() or "")
                n.append(len(hashes))
                d1.append(int(_mix(hashes.view(np.uint64) ^ salt[10]).sum().astype(np.int64)))
                d2.append(int(_mix(hashes.view(np.uint64) ^ salt[11]).sum().astype(np.int64)))
                least.append(sure_common(len(hashes), percent, k))
                low.append(hashes[: retained(len(hashes), percent, k)])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row_id", "doc_id", "t1", "t2")), pa.array(n, pa.int64()), pa.array(least, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(low, pa.list_(pa.int64()))],
                names=["row_id", "doc_id", "t1", "t2", "n", "least", "d1", "d2", "sketch"],
            )

    return sketch


def _entries(batches):
    """(node, value) for each shingle of each text, in batches of bounded size."""
    for batch in batches:
        for node, value in zip(batch.column("node").to_pylist(), batch.column("text")):
            hashes = shingle_hashes(value.as_py() or "")
            for i in range(0, len(hashes), 100_000):
                part = hashes[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), node, dtype=np.int64)), pa.array(part)], names=["node", "value"])


def _verifier(percent: int):
    def verify(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("ta"), batch.column("tb")):
                p, q = shingle_set(x.as_py() or ""), shingle_set(y.as_py() or "")
                common = len(p & q)
                linked.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return verify


def least_shared(size: int, t: float, loss: float = LOSS) -> int:
    """The most values, one at least, of which a sketch of a pair at similarity t shares fewer with a chance of at most loss."""
    below, m = 0.0, 0
    while m < size and (below := below + comb(size, m) * t**m * (1 - t) ** (size - m)) <= loss:
        m += 1
    return max(1, m)


def _single_owners(entries: DataFrame) -> DataFrame:
    """How many of a node's values no other node has (node, singles)."""
    lists = entries.groupBy("value").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node"))
    return lists.filter("c = 1").groupBy("node").agg(F.count(F.lit(1)).alias("singles"))


def near_groups(spark: SparkSession, docs: DataFrame, percent: int = PERCENT, k: int = K, row_id: str | None = None, loss: float = 0.0) -> DataFrame:
    """row_id, doc_id, n_shingles, component_id, kept, first per row.

    first is true for exactly one row of each component, whatever its ids.
    row_id: a column that identifies the rows; without it they are numbered.
    """
    s = Scratch(spark, "near")
    bounded_batches(spark)
    text = text_or_empty()
    number = F.col(row_id) if row_id else F.monotonically_increasing_id()
    keyed = [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text")]
    rows = docs.select(number.alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), *keyed).mapInArrow(
        _sketcher(k, percent), "row_id long, doc_id long, t1 long, t2 long, n long, least long, d1 long, d2 long, sketch array<long>"
    )
    sketched = s.save(rows, "sketched")
    rows = s.save(sketched.select("row_id", "doc_id", "n", "d1", "d2"), "rows")
    most = rows.count()

    nodes = sketched.filter("n > 0").groupBy("n", "d1", "d2").agg(
        F.min(F.struct("row_id", "t1", "t2")).alias("m"), F.min("doc_id").alias("low")
    )
    nodes = s.save(nodes.select(F.col("m.row_id").alias("node"), "m.t1", "m.t2", "n", "d1", "d2", "low"), "nodes", most)

    # 2. sketches: who can have a partner at all
    sketches = sketched.select(F.col("row_id").alias("node"), "n", "least", "sketch").join(if_small(nodes.select("node")), "node", "left_semi")
    sketches = s.save(sketches, "sketches")
    s.drop("sketched")
    own = _single_owners(sketches.select("node", F.explode("sketch").alias("value")))
    maybe = sketches.join(own, "node", "left").filter("size(sketch) - coalesce(singles, 0) >= least").select("node", "n", "sketch")
    maybe = s.save(maybe, "maybe", most)
    s.drop("sketches")
    wanted = s.save(nodes.join(maybe.select("node"), "node", "left_semi").select("node", "t1", "t2", "n"), "wanted", most)
    texts = docs.select(*keyed).join(if_small(wanted), ["t1", "t2"]).groupBy("node", "n").agg(F.first("text").alias("text"))
    texts = s.save(texts, "texts")

    sure = f"ceil({percent} * n / 100.0)"

    # 3. whole sets of these: exact bound, then the prefix index of the rarest shingles
    entries = texts.select("node", "text").mapInArrow(_entries, "node long, value long")
    counts = entries.groupBy("value").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node"))
    counts = s.save(counts, "counts")
    singles = counts.filter("c = 1").groupBy("node").agg(F.count(F.lit(1)).alias("u"))
    left = texts.select("node", "n").join(singles, "node", "left").withColumn("u", F.coalesce("u", F.lit(0)))
    left = s.save(left.filter(f"u <= n - {sure}"), "left", most)
    again = texts.select("node", "text").join(left.select("node"), "node", "left_semi").mapInArrow(_entries, "node long, value long")
    shared = s.save(again.join(counts.filter("c > 1").select("value", "c"), "value"), "shared")
    order = Window.partitionBy("node").orderBy("c", "value")
    index = (
        shared.withColumn("r", F.row_number().over(order)).join(left, "node")
        .withColumn("pos", F.col("u") + F.col("r") - 1).filter(f"pos <= n - {sure}").select("value", "node", "n", "u", "pos")
    )
    index = s.save(index, "index")
    s.drop("shared", "counts")

    # 4. stars, then what stars leave open
    def reaches(x: str, y: str) -> str:
        need = f"ceil({percent} * ({x}n + {y}n) / {100.0 + percent})"
        return f"least({x}n - {x}pos, {y}n - {y}pos) >= {need} and 100 * least({x}n, {y}n) >= {percent} * greatest({x}n, {y}n)"

    centres = index.groupBy("value").agg(F.min(F.struct("u", "node", "n", "pos")).alias("m"))
    centres = s.save(centres.select("value", F.col("m.node").alias("c_node"), F.col("m.n").alias("c_n"), F.col("m.pos").alias("c_pos")), "centres")
    stars = index.join(centres, "value").filter(f"node <> c_node and {reaches('', 'c_')}")
    stars = stars.select(F.least("node", "c_node").alias("a"), F.greatest("node", "c_node").alias("b")).distinct()

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        pairs = s.save(pairs, f"{label}-pairs")
        for x in "ab":
            end = F.expr("if(size(sketch) < n, element_at(sketch, -1), 9223372036854775807L)")
            pairs = pairs.join(maybe.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"), end.alias(f"e{x}")), x)
        known = pairs.withColumn("e", F.least("ea", "eb")).withColumn("shared", F.expr("size(array_intersect(sa, sb))"))
        beyond = "least(na - size(filter(sa, v -> v <= e)), nb - size(filter(sb, v -> v <= e)))"
        pairs = known.filter(f"{100 + percent} * (shared + {beyond}) >= {percent} * (na + nb)")
        if loss:
            low = pairs.withColumn("low", F.expr(f"slice(sort_array(array_union(slice(sa, 1, {k}), slice(sb, 1, {k}))), 1, {k})"))
            least = ", ".join(str(least_shared(i, percent / 100, loss)) for i in range(1, k + 1))
            pairs = low.filter(f"size(array_intersect(array_intersect(low, sa), sb)) >= element_at(array({least}), size(low))")
        pairs = pairs.select("a", "b")
        pairs = s.save(pairs, f"{label}-likely")
        both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(
            texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b"
        )
        return s.save(both.select("a", "b", "ta", "tb").mapInArrow(_verifier(percent), "a long, b long, linked boolean"), f"{label}-verified")

    first = verified(stars, "star")
    links = first.filter("linked").select("a", "b")
    label = components(s, links, "star-cc")
    labelled = s.save(
        index.join(label, "node", "left").withColumn("component", F.coalesce("component", "node")), "labelled"
    )
    parts = labelled.groupBy("value", "component").agg(F.count(F.lit(1)).alias("c"))
    mixed = parts.groupBy("value").agg(F.count(F.lit(1)).alias("parts"), F.max_by("component", F.struct("c", "component")).alias("main"))
    mixed = s.save(mixed.filter("parts > 1").select("value", "main"), "mixed")
    width = log(100 / percent) / 8 if percent < 100 else 1.0

    def sized(n: str) -> str:
        return f"cast(floor(ln({n}) / {width!r}D) as int)"

    open_ = labelled.join(mixed, "value").withColumn("sized", F.expr(sized("n")))
    open_ = s.save(open_, "open")
    s.drop("labelled", "mixed")
    kept = ("node", "n", "pos", "component")
    least, most_ = f"({percent} * n + 99) div 100", f"(n - pos) * {100 + percent} div {percent} - n"  # the sizes that a partner may have
    odd = open_.filter(f"component <> main and {least} <= {most_}")
    x = odd.select("value", F.expr(f"explode(sequence({sized(least)}, {sized(most_)}))").alias("sized"), *[F.col(c).alias(f"x_{c}") for c in kept])
    y = open_.select("value", "sized", F.expr("component = main").alias("y_main"), *[F.col(c).alias(f"y_{c}") for c in kept])
    once = "x_component <> y_component and (y_main or x_node < y_node)"
    cross = x.join(y, ["value", "sized"]).filter(f"{once} and {reaches('x_', 'y_')}")
    cross = cross.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
    cross = cross.join(s.spark.read.schema("a long, b long").parquet(f"{s.root}/star-pairs"), ["a", "b"], "left_anti")
    second = verified(cross, "cross")
    more = second.filter("linked").select("a", "b")
    label = components(s, links.unionByName(more), "cc")
    s.drop("texts", "maybe", "wanted", "left", "index", "centres", "open", "star-pairs", "star-likely", "cross-pairs", "cross-likely")

    named = nodes.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = s.save(named.select("n", "d1", "d2", "component", "low"), "named", most)
    low = s.save(named.groupBy("component").agg(F.min("low").alias("component_id")), "low", most)
    members = rows.select("row_id", "doc_id", "n", "d1", "d2").join(named.select("n", "d1", "d2", "component"), ["n", "d1", "d2"], "left")
    members = s.save(members.join(low, "component", "left"), "members", most)
    s.drop("rows", "nodes", "named", "low")
    heads = members.filter("n > 0").groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")).alias("h")
    )
    heads = s.save(heads.select("component", F.col("h.row_id").alias("head")), "heads", most)
    return members.join(heads, "component", "left").select(
        "row_id",
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.expr("if(n = 0, doc_id, component_id)").alias("component_id"),
        F.expr("n = 0 or coalesce(doc_id = component_id, row_id = head)").alias("kept"),
        F.expr("n = 0 or row_id = head").alias("first"),
    )


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each group, with its columns."""
    scratch = Scratch(spark, "near-rows")
    rows = numbered_rows(scratch, docs)
    groups = near_groups(spark, rows.select("row_id", "doc.doc_id", "doc.text"), row_id="row_id")
    return unboxed(without(scratch, rows, groups.filter("not first")))


def op9_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", "n_shingles", "component_id", "kept")


ORACLE_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a)
SELECT doc_id, coalesce(n, 0)::bigint AS n_shingles, m AS component_id, doc_id = m AS kept
FROM (SELECT doc_id, min(reach) AS m FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""
