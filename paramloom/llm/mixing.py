"""Mixing sources to target weights by iterative proportional fitting, on DataFrames only.

Token counts are summed per cell (source, language, topic). The target share
of a source, language or topic is the one the caller gives; of those the
caller doesn't name it is the natural share to a power below one, so common
ones shrink and rare ones grow. All are made to sum to one. Raking scales
the cells' keeping probabilities to meet the source targets, then the
language targets, then the topic targets, ``ROUNDS`` times over; a
probability is at most one, so a cell never gives more than it has. A
document stays if a uniform number made from its doc_id and its text is below
its cell's probability: the expected tokens are ``BUDGET`` times all tokens, as far as
the cells reach.

The topic is the document's register unless the caller gives a column:
table (a pipe for every tenth word), short (under 60 words), long (2000 or
more), else prose. Tokens are words.

Scale. The texts are read once for the cells and once for the result; only
partial sums are shuffled. The cells are a table of their own and raking joins
it with its marginals, written after every step, so any number of sources
works and a source with a third of the rows is one cell per task. The result
joins documents to cells, broadcast only if Spark finds them small.

Edge cases. Null source, language or text are values like any other (null
text: no words). Null doc_id draws as the empty string; only rows with the
same doc_id and text share their draw. Cells without tokens keep probability one. Empty table: empty
result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paramloom.llm.scratch import Scratch

ROUNDS = 8
BUDGET = 0.5
POWERS = {"source": 0.7, "lang": 0.7, "topic": 0.9}
SEED = "mix-1"
#: Shares by value for some of source, lang and topic.
Targets = dict[str, dict[str, float]]


def _described(docs: DataFrame, topic: str | None = None) -> DataFrame:
    """doc (all columns of docs), doc_id and the cell columns _source, _lang, _topic and _tokens."""
    given = F.expr(topic).cast("string") if topic else F.lit(None).cast("string")
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", "text", "source", "lang", given.alias("_given"))
    t = "coalesce(cast(text as string), '')"
    words = rf"split(trim(BOTH ' \t\n\u000B\u000C\r' FROM {t}), '[\\x20\\x09-\\x0D]+')"
    df = docs.withColumn("_w", F.expr(f"size({words})")).withColumn(
        "_tokens", F.expr(rf"cast(if(_w = 1 and trim(BOTH ' \t\n\u000B\u000C\r' FROM {t}) = '', 0, _w) as bigint)")
    )
    register = f"case when 10 * regexp_count({t}, '[|]') > _tokens then 'table' when _tokens < 60 then 'short' when _tokens >= 2000 then 'long' else 'prose' end"
    return df.withColumns(
        {
            "_source": F.expr("coalesce(cast(source as string), '')"),
            "_lang": F.expr("coalesce(cast(lang as string), '')"),
            "_topic": F.expr("coalesce(_given, '')" if topic else register),
        }
    ).select("doc", "doc_id", "_source", "_lang", "_topic", "_tokens", F.expr(f"md5({t})").alias("_body"))


def fit(spark: SparkSession, scratch: Scratch, docs: DataFrame, topic: str | None = None, budget: float = BUDGET, rounds: int = ROUNDS, targets: Targets | None = None) -> DataFrame:
    """The cells with their probability p."""
    dims = ("source", "lang", "topic")
    cells = _described(docs, topic).groupBy(*[F.col(f"_{d}").alias(d) for d in dims]).agg(F.sum("_tokens").cast("double").alias("tokens"))
    cells = scratch.save(cells, "cells")
    most = cells.count()
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    goals = {}
    for d in dims:
        shares = cells.groupBy(d).agg(F.sum("tokens").alias("has")).withColumn("raw", F.expr(f"power(has / {total!r}D, {POWERS[d]}D)") if total else F.lit(0.0))
        if given := (targets or {}).get(d):
            wanted = F.create_map(*[F.lit(x) for value, share in given.items() for x in (value, float(share))])
            shares = shares.withColumn("raw", F.coalesce(F.try_element_at(wanted, F.col(d)), "raw"))
        shares = scratch.save(shares.select(d, "raw"), f"shares-{d}", most)
        norm = shares.agg(F.sum("raw")).first()[0] or 1.0
        goals[d] = scratch.save(shares.select(d, (F.col("raw") / F.lit(norm) * F.lit(budget * total)).alias("goal")), f"goals-{d}", most)
    now = cells.withColumn("p", F.lit(float(budget)))
    for d in dims:
        now = now.join(goals[d].withColumnRenamed("goal", f"goal_{d}"), d)
    now, columns = scratch.save(now, "start", most), now.columns
    last = "start"
    for i in range(rounds):
        for d in dims:
            have = now.groupBy(d).agg(F.sum(F.col("tokens") * F.col("p")).alias("have"))
            scaled = F.least(F.lit(1.0), F.col("p") * F.expr(f"if(have > 0, goal_{d} / have, 1D)"))
            label = f"round{i}-{d}"
            now = scratch.save(now.join(have, d).withColumn("p", scaled).select(*columns), label, most)
            scratch.drop(last)
            last = label
    return now.withColumn("p", F.when(F.col("tokens") > 0, F.round("p", 9)).otherwise(F.lit(1.0)))


_DRAW = f"cast(conv(substring(md5(concat('{SEED}:', coalesce(cast(doc_id as string), ''), ':', _body)), 1, 8), 16, 10) as double) / 4294967296D"


def _drawn(spark: SparkSession, docs: DataFrame, topic: str | None, budget: float, targets: Targets | None) -> DataFrame:
    scratch = Scratch(spark, "mixing")
    cells = scratch.save(fit(spark, scratch, docs, topic, budget, targets=targets).select(*[F.col(d).alias(f"_{d}") for d in ("source", "lang", "topic")], F.col("p").alias("_p")), "fitted")
    return _described(docs, topic).join(cells, ["_source", "_lang", "_topic"]).withColumn("_kept", F.expr(f"{_DRAW} < _p"))


def weigh(spark: SparkSession, docs: DataFrame, topic: str | None = None, budget: float = BUDGET, targets: Targets | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability, kept per document."""
    return _drawn(spark, docs, topic, budget, targets).select(
        F.col("doc_id"), F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"),
        F.col("_tokens").alias("n_tokens"), F.round("_p", 6).alias("probability"), F.col("_kept").alias("kept"),
    )


def sample(spark: SparkSession, docs: DataFrame, topic: str | None = None, budget: float = BUDGET, targets: Targets | None = None) -> DataFrame:
    """The documents that stay, with their columns."""
    return _drawn(spark, docs, topic, budget, targets).filter("_kept").select("doc.*")


def op5_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weigh(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))


def _oracle() -> str:
    steps, last = "", "p0"
    for i in range(ROUNDS):
        for d in POWERS:
            name = f"p_{i}_{d}"
            steps += (
                f", {name} AS MATERIALIZED (SELECT source, lang, topic, tokens, least(1.0, p * CASE WHEN have > 0 THEN goal / have ELSE 1 END) AS p FROM"
                f" (SELECT c.*, g.goal, sum(tokens * p) OVER (PARTITION BY {d}) AS have FROM {last} c JOIN goal_{d} g USING ({d})))"
            )
            last = name
    goals = ", ".join(
        f"raw_{d} AS (SELECT {d}, power(sum(tokens) / (SELECT sum(tokens) FROM cells), {x}::double) AS raw FROM cells GROUP BY {d}), "
        f"goal_{d} AS MATERIALIZED (SELECT {d}, raw / (SELECT sum(raw) FROM raw_{d}) * {BUDGET} * (SELECT sum(tokens) FROM cells) AS goal FROM raw_{d})"
        for d, x in POWERS.items()
    )
    return f"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
n AS (SELECT *, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))::bigint AS n_tokens FROM w),
d AS MATERIALIZED (SELECT doc_id, source, lang, n_tokens, md5(t) AS body, CASE WHEN 10 * len(regexp_extract_all(t, '[|]')) > n_tokens THEN 'table'
     WHEN n_tokens < 60 THEN 'short' WHEN n_tokens >= 2000 THEN 'long' ELSE 'prose' END AS topic FROM n),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::double AS tokens FROM d GROUP BY ALL),
{goals},
p0 AS (SELECT *, {BUDGET}::double AS p FROM cells){steps},
f AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN round(p, 9) ELSE 1.0 END AS p FROM {last})
SELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS probability,
       ('0x' || substr(md5(concat('{SEED}:', doc_id, ':', body)), 1, 8))::bigint / 4294967296.0::double < p AS kept
FROM d JOIN f USING (source, lang, topic)
"""


ORACLE_SQL = _oracle()
