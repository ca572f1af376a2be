"""Repeated passages by unit hashing.

A text's units are its lines, and within a line its sentences (up to a mark
``.!?`` before white space), each normalised: lower case, white space
collapsed. Digests of 128 bits are grouped over the corpus; of equal units
the one ranked first by (doc_id, start) stays. Neighbouring repeated units
form a run. ``remove_repeats`` removes every run; ``repeated_runs``, and the
query with its SQL, report those of ``MIN_WORDS`` words or more unless told
otherwise. Repeats inside a unit are not seen. Offsets are code points of the
original text.

Scale. One pass turns texts into units; shuffles carry digests and offsets,
never text. A unit that occurs everywhere is counted with a map-side minimum
and joined from stored tables, which Spark splits where a digest is hot. Runs
are formed per document.

Edge cases. Null or empty text has no units. Units without a word are skipped
and end no run. A null doc_id ranks before all others, and repeated rows are
told apart by position. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paramloom.llm.scratch import Scratch, bounded_batches, numbered_rows

MIN_WORDS = 30
_BREAK = re.compile(r"(?<=[.!?])[ \t\r\x0b\x0c]+|\n")


def units(text: str):
    """(start, end, words, digest) of each unit that has a word."""
    at = 0
    for start, end in [*(m.span() for m in _BREAK.finditer(text)), (len(text), len(text))]:
        words = text[at:start].lower().encode("utf-8", "replace").split()
        if words:
            yield at, start, len(words), hashlib.blake2b(b" ".join(words), digest_size=16).digest()
        at = end


def _cut(batches):
    names = ["row_id", "doc_id", "unit", "start", "end", "words", "g1", "g2"]
    for batch in batches:
        cols = {k: [] for k in names}
        for row, doc, value in zip(batch.column("row_id").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text")):
            for i, (start, end, words, digest) in enumerate(units(value.as_py() or "")):
                g1, g2 = struct.unpack("<qq", digest)
                for k, v in zip(names, (row, doc, i, start, end, words, g1, g2)):
                    cols[k].append(v)
        kinds = {"unit": pa.int32(), "start": pa.int32(), "end": pa.int32(), "words": pa.int32()}
        yield pa.RecordBatch.from_arrays([pa.array(cols[k], kinds.get(k, pa.int64())) for k in names], names=names)


def repeated_runs(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, row_id: str | None = None) -> DataFrame:
    """row_id, doc_id, start, end, n_words, first_doc_id, first_start per run to remove.

    first_*: where the run's first unit occurs first. row_id: a column that
    identifies the rows; without it they are numbered.
    """
    s = Scratch(spark, "lines")
    bounded_batches(spark)
    number = F.col(row_id) if row_id else F.monotonically_increasing_id()
    rows = docs.select(number.alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = s.save(rows.mapInArrow(_cut, "row_id long, doc_id long, unit int, start int, end int, words int, g1 long, g2 long"), "units")
    groups = cut.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc_id", "row_id", "start")).alias("f"))
    groups = groups.filter("c > 1").select(
        "g1", "g2", F.col("f.doc_id").alias("first_doc_id"), F.col("f.row_id").alias("first_row"), F.col("f.start").alias("first_start")
    )
    groups = s.save(groups, "groups")
    again = cut.join(groups, ["g1", "g2"]).filter("not (row_id = first_row and start = first_start)")
    again = s.save(again.drop("g1", "g2", "first_row"), "again")
    order = Window.partitionBy("row_id").orderBy("unit")
    islands = again.withColumn("island", F.col("unit") - F.row_number().over(order))
    found = islands.groupBy("row_id", "island").agg(
        F.min("doc_id").alias("doc_id"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.sum("words").alias("n_words"),
        F.min(F.struct("unit", "first_doc_id", "first_start")).alias("f"),
    )
    return found.filter(F.col("n_words") >= min_words).select(
        "row_id",
        "doc_id",
        F.col("start").cast("long").alias("start"),
        F.col("end").cast("long").alias("end"),
        "n_words",
        F.col("f.first_doc_id").alias("first_doc_id"),
        F.col("f.first_start").cast("long").alias("first_start"),
    )


def remove_repeats(spark: SparkSession, docs: DataFrame, min_words: int = 1) -> DataFrame:
    """docs with the runs cut out of text, and removed_spans: their original (start, end), null if there are none."""
    rows = numbered_rows(Scratch(spark, "line-rows"), docs)
    runs = repeated_runs(spark, rows.select("row_id", "doc.doc_id", "doc.text"), min_words, "row_id")
    runs = runs.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("removed"))
    joined = rows.join(runs, "row_id", "left")
    cut = F.expr(
        "if(removed is null, doc.text, concat(array_join(transform(removed, (r, i) -> substring(doc.text,"
        " cast(if(i = 0, 0, removed[greatest(i - 1, 0)].end) + 1 as int), cast(r.start - if(i = 0, 0, removed[greatest(i - 1, 0)].end) as int))), ''),"
        " substring(doc.text, cast(removed[size(removed) - 1].end + 1 as int))))"
    )
    kept = [cut.alias(c) if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns if c != "removed_spans"]
    return joined.select(*kept, F.col("removed").alias("removed_spans"))


def op10_unit_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_runs(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_id")


ORACLE_SQL = f"""
WITH l AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '\\n') AS l FROM documents),
li AS (SELECT doc_id, i AS line, l[i] AS t, (list_sum([length(x) + 1 for x in l[:i - 1]]))::bigint AS off
       FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM l)),
p AS (SELECT doc_id, line, coalesce(off, 0) AS off, regexp_extract_all(t, '(?s)(?:[^.!?]|[.!?]+[^.!? \\t\\r\\x0b\\x0c])*[.!?]*[ \\t\\r\\x0b\\x0c]*') AS parts FROM li),
pi AS (SELECT doc_id, line, i AS part, parts[i] AS raw, off + coalesce((list_sum([length(x) for x in parts[:i - 1]]))::bigint, 0) AS start
       FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM p)),
u AS MATERIALIZED (
  SELECT doc_id, start, start + length(raw) - CASE WHEN regexp_matches(raw, '[.!?][ \\t\\r\\x0b\\x0c]+$') THEN length(regexp_extract(raw, '[ \\t\\r\\x0b\\x0c]+$')) ELSE 0 END AS fin,
         array_to_string(regexp_extract_all(lower(raw), '[^ \\t\\r\\x0b\\x0c]+'), ' ') AS g, len(regexp_extract_all(raw, '[^ \\t\\r\\x0b\\x0c]+')) AS words,
         row_number() OVER (PARTITION BY doc_id ORDER BY line, part) AS unit
  FROM pi WHERE regexp_matches(raw, '[^ \\t\\r\\x0b\\x0c]')),
f AS (SELECT *, first_value(doc_id) OVER w AS fd, first_value(start) OVER w AS fs FROM u WINDOW w AS (PARTITION BY g ORDER BY doc_id, start)),
a AS (SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS island FROM f WHERE doc_id <> fd OR start <> fs)
SELECT doc_id, min(start)::bigint AS start, max(fin)::bigint AS "end", sum(words)::bigint AS n_words,
       arg_min(fd, unit) AS first_doc_id, arg_min(fs, unit)::bigint AS first_start
FROM a GROUP BY doc_id, island HAVING sum(words) >= {MIN_WORDS}
"""
