"""Exact deduplication by deterministic block naming, on DataFrames only.

Each text is cut into blocks of ``block_bytes`` bytes. Sorting the distinct
blocks gives each an integer name; adjacent pairs of names are then named in
the same way, level by level, until a document has one name. Two texts have
the same (number of blocks, name) if and only if they are identical: a name
is given to a distinct value, never to a digest alone.

Scale. The text is shuffled once, after a map-side distinct, so copies of a
block cost one row per map task however many there are. A 64-bit fingerprint
stands for a block in joins only after the distinct blocks have been counted
per fingerprint; the blocks of a fingerprint that two blocks share are joined
by their content instead, so a collision costs time and never correctness.
All later shuffles carry integers.

Edge cases. Null text counts as empty; the empty text has one empty block.
A null doc_id loses against any other; of rows with the same doc_id and text
one stays. Empty tables give empty results. Columns other than doc_id and
text are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paramloom.llm.scratch import Scratch, named, numbered_rows, text_or_empty, unboxed, without

BLOCK_BYTES = 4096


def _fingerprint(block):
    return F.xxhash64(block)


def _blocks(rows: DataFrame, block_bytes: int, fingerprint) -> DataFrame:
    cut = rows.withColumn(
        "n_blocks", F.greatest(F.lit(1), F.ceil(F.octet_length("body") / block_bytes)).cast("int")
    ).withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    return cut.withColumn("block", F.expr(f"substring(body, pos * {block_bytes} + 1, {block_bytes})")).withColumn(
        "h", fingerprint(F.col("block"))
    )


def identities(
    spark: SparkSession, docs: DataFrame, block_bytes: int = BLOCK_BYTES, fingerprint=_fingerprint, row_id: str | None = None,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per input row: row_id, doc_id, n_blocks, name, text_sha256.

    Rows have the same (n_blocks, name) exactly if their texts are the same.
    row_id: a column that identifies the rows; without it they are numbered.
    """
    scratch = scratch or Scratch(spark, "exact")
    text = text_or_empty()
    rows = docs.select(
        (F.col(row_id) if row_id else F.monotonically_increasing_id()).alias("row_id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        text.cast("binary").alias("body"),
    )

    seen = _blocks(rows.select("body"), block_bytes, fingerprint).select("h", "block").distinct()
    names = named(scratch, seen.groupBy("h").agg(F.count(F.lit(1)).alias("variants")), "blocks")
    clashes = names.filter("variants > 1").select("h")

    cut = _blocks(rows.withColumn("sha", F.sha2("body", 256)), block_bytes, fingerprint)
    kept = ["row_id", "doc_id", "n_blocks", "pos", "h", F.expr("if(pos = 0, sha, null)").alias("sha")]
    if clashes.isEmpty():
        spelled = scratch.save(cut.select(*kept), "spelled")
        level = spelled.join(names.select("h", "name"), "h")
    else:  # a fingerprint of two blocks names nothing: these go by their content
        again = seen.join(clashes, "h", "left_semi").select("block")
        by_block = named(scratch, again, "clashing", "own_name")
        spelled = scratch.save(
            cut.join(by_block, "block", "left").select(*kept, "own_name"), "spelled"
        )
        level = spelled.join(names.select("h", "name"), "h").withColumn(
            "name", F.expr("if(own_name is null, 2 * name, 2 * own_name + 1)")
        )
    level = scratch.save(level.select("row_id", "n_blocks", "pos", "name"), "level0")

    longest, most = spelled.agg(F.max("n_blocks"), F.count_if(F.col("n_blocks") > 1)).first()
    longest = longest or 1
    done, width, step = [level.filter("n_blocks = 1")], 1, 0
    while width < longest:
        pairs = (
            level.filter(f"n_blocks > {width}")
            .groupBy("row_id", "n_blocks", F.expr("pos div 2").cast("int").alias("pos"))
            .agg(
                F.max(F.expr("if(pos % 2 = 0, name, null)")).alias("a"),
                F.coalesce(F.max(F.expr("if(pos % 2 = 1, name, null)")), F.lit(-1)).alias("b"),
            )
        )
        step += 1
        known = named(scratch, pairs.select("a", "b").distinct(), f"named{step}", most=most)
        level = scratch.save(
            pairs.join(known, ["a", "b"]).select("row_id", "n_blocks", "pos", "name"), f"level{step}", most
        )
        scratch.drop(f"named{step}")
        done.append(level.filter(f"n_blocks > {width} and n_blocks <= {2 * width}"))
        width *= 2
    final = done[0]
    for more in done[1:]:
        final = final.unionByName(more)
    heads = spelled.filter("pos = 0").select("row_id", "doc_id", F.col("sha").alias("text_sha256"))
    return heads.join(final.select("row_id", "n_blocks", "name"), "row_id")


def exact_groups(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, row_id.

    The row with the largest doc_id of each group of equal texts stays.
    """
    scratch, inner = Scratch(spark, "exact-ids"), Scratch(spark, "exact")
    ids = scratch.save(identities(spark, docs, scratch=inner, **options), "ids")
    inner.free()
    best = ids.groupBy("n_blocks", "name").agg(
        F.max(F.struct("doc_id", "row_id")).alias("best"), F.count(F.lit(1)).alias("group_size")
    )
    best = scratch.save(best, "best", ids.count())  # read back, the join deals both sides itself and can split a hot group
    return ids.join(best, ["n_blocks", "name"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("best.row_id")).alias("kept"),
        "text_sha256",
        "row_id",
    )


def op2_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_id")


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def drop_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns."""
    scratch = Scratch(spark, "exact-rows")
    rows = numbered_rows(scratch, docs)
    groups = exact_groups(spark, rows.select("row_id", "doc.doc_id", "doc.text"), row_id="row_id")
    return unboxed(without(scratch, rows, groups.filter("not kept")))
