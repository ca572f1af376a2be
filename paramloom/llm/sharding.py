"""Shards as runs of a Hilbert curve through metadata.

Each document gets a cell in a grid of ``BITS`` bits per dimension: source and
language by the place of their value among all values, size and doc_id by
quantiles. Documents are sorted by the cell's index on the Hilbert curve
(then text checksum and doc_id, so equal texts lie together) and the order is
cut into runs of equal row counts: the law is ``rows``. A run covers a compact
region of the grid, so the minimum and maximum of each dimension prune files.

Scale. The order is one range-partitioned sort of small rows; a document's
place is its partition's offset plus its place there, so nothing is gathered
but a count per partition. Hot values do not matter: ties are ordered by
checksum and doc_id, over which range partitioning splits.

Edge cases. Null text: size 1, checksum 0. Null dimensions sort first and get
cell 0. Rows equal in every key are ordered arbitrarily among themselves.
Fewer rows than shards leave shards empty. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paramloom.llm.scratch import Scratch, boxed, text_or_empty

SHARDS = 16
BITS = 5


def hilbert_index(cells: list[np.ndarray], bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer cells below 2**bits, one array per dimension (after J. Skilling, 2004)."""
    x = [c.astype(np.int64).copy() for c in cells]
    n = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(n):
            high = (x[i] & level) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
        level >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        turn = np.where((x[n - 1] & level) != 0, turn ^ (level - 1), turn)
        level >>= 1
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | (((x[i] ^ turn) >> bit) & 1)
    return out


def _indexer(dims: tuple[str, ...], kept: tuple[str, ...]):
    def index(batches):
        for batch in batches:
            cells = [batch.column(d).to_numpy() for d in dims]
            columns = [batch.column(k) for k in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(hilbert_index(cells))], names=[*kept, "h"])

    return index


def numbered(scratch: Scratch, df: DataFrame, keys: list[str], label: str) -> tuple[DataFrame, int]:
    """df in the order of keys with its place (from 0), and the row count."""
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    stored = scratch.save(ordered.withColumn("_at", F.monotonically_increasing_id()), label)
    parts = stored.groupBy(F.shiftright("_at", 33).alias("part")).count().orderBy("part").collect()  # one row per partition
    total, offsets = 0, []
    for row in parts:
        offsets.append((row["part"], total))
        total += row["count"]
    table = scratch.spark.createDataFrame(offsets, "part long, offset long")
    place = stored.withColumn("part", F.shiftright("_at", 33)).join(F.broadcast(table), "part")
    return place.withColumn("place", F.col("offset") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("part", "offset", "_at"), total


def _place_of_values(scratch: Scratch, df: DataFrame, column: str) -> DataFrame:
    """(column, cell): the place of each value among the distinct ones, scaled to the grid."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    placed, total = numbered(scratch, values, [column], f"values-{column}")
    return scratch.save(placed.select(column, F.expr(f"cast(place * {1 << BITS} div {max(total, 1 << BITS)} as long)").alias(f"{column}_cell")), f"cells-{column}")


def hilbert_order(spark: SparkSession, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, size, text_crc32, h."""
    text = text_or_empty()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = scratch.save(rows, "rows")
    grid = 1 << BITS
    cuts = {}
    for column in ("size", "doc_id"):
        points = [i / grid for i in range(1, grid)]
        cuts[column] = sorted(set(rows.approxQuantile(column, points, 0.002)))  # at most 2**BITS - 1 numbers
    for column in ("source", "lang"):
        rows = rows.join(_place_of_values(scratch, rows, column), column, "left")

    def cell(column: str) -> F.Column:
        if not cuts[column]:
            return F.lit(0).cast("long")
        bounds = ", ".join(f"{x!r}D" for x in cuts[column])
        return F.coalesce(F.expr(f"cast(size(filter(array({bounds}), b -> b <= {column})) as long)"), F.lit(0).cast("long"))

    rows = rows.select(
        "doc_id", "size", "text_crc32",
        F.coalesce("source_cell", F.lit(0)).alias("c0"), F.coalesce("lang_cell", F.lit(0)).alias("c1"),
        cell("size").alias("c2"), cell("doc_id").alias("c3"),
    )
    return rows.mapInArrow(_indexer(("c0", "c1", "c2", "c3"), ("doc_id", "size", "text_crc32")), "doc_id long, size long, text_crc32 long, h long")


def shards(spark: SparkSession, docs: DataFrame, count: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert per document."""
    scratch = Scratch(spark, "shards")
    placed, total = numbered(scratch, hilbert_order(spark, docs, scratch), ["h", "text_crc32", "doc_id"], "ordered")
    shard = F.expr(f"cast(place * {count} div {max(total, 1)} as int)")
    return placed.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.expr(f"place - (cast(shard as bigint) * {total} + {count - 1}) div {count}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("h").alias("hilbert"),
    )


def write_shards(spark: SparkSession, docs: DataFrame, path: str, count: int = SHARDS) -> None:
    """The documents themselves, in folders _shard=0 ... of files sorted along the curve."""
    keys = shards(spark, docs, count).groupBy("doc_id", "text_crc32").agg(F.min(F.struct("shard", "slot")).alias("at"))
    rows = boxed(docs).select("doc", F.col("doc_id").cast("long").alias("id"), F.crc32(text_or_empty().cast("binary")).alias("crc"))
    placed = rows.join(keys, rows["id"].eqNullSafe(keys["doc_id"]) & (rows["crc"] == keys["text_crc32"])).select("doc.*", F.col("at.shard").alias("_shard"), F.col("at.slot").alias("_slot"))
    placed.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot").drop("_slot").write.partitionBy("_shard").parquet(path)


def op6_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
