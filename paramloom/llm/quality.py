"""Quality rules by weak supervision, on DataFrames only.

Each rule votes good (+1) or bad (-1) on a document or abstains (0).
Expectation-maximisation over the counts of vote patterns estimates, without
labels, how often each rule is right on good and on bad documents and how
common good documents are. Base failures are decided already and tell EM
nothing; of the others, a document stays if the posterior probability that
it is good reaches ``threshold``.

Scale. One pass over the texts computes the measures with array functions
(no shuffle of text or words); they are written once. The patterns number at
most 3**8 whatever the input, every pass of EM is one aggregation over them,
and only its single row of estimates comes to the driver.

Repeated windows are found by hash first: a text whose 5-word windows all
have different hashes repeats none. In any other text the windows that share
a hash are compared as words, so hashes decide nothing by themselves.

Edge cases. Null or empty text: no words, base failure, not kept. Empty
table: empty result. Ties of the posterior with the threshold are kept.
Other columns pass through ``filter_quality``; measures use names with the
prefix ``q_``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paramloom.llm.scratch import Scratch, boxed

ROUNDS = 12
THRESHOLD = 0.5
RULES: dict[str, tuple[str, str]] = {  # name: (bad if, good if)
    "symbols": ("n_symbols > 0.08 * word_chars", "n_symbols <= 0.02 * word_chars"),
    "symbol_words": ("n_symbol_runs > 0.2 * n_words", "n_symbol_runs <= 0.05 * n_words"),
    "dup_lines": ("n_dup_lines > 0.3 * n_lines", "n_dup_lines <= 0.1 * n_lines"),
    "repeats": ("n_repeat_words > 0.15 * n_words", "n_repeat_words <= 0.05 * n_words"),
    "length": ("n_words < 12", "n_words >= 40"),
    "word_length": ("word_chars < 2.2 * n_words or word_chars > 14 * n_words", "word_chars >= 3 * n_words and word_chars <= 9 * n_words"),
    "capitals": ("n_upper > 0.35 * word_chars", "n_upper <= 0.15 * word_chars"),
    "marks": ("n_marks > 0.5 * n_words", "n_marks <= 0.1 * n_words"),
}
_WS = r"[\\x20\\x09-\\x0D]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_symbol_runs")


def with_measures(docs: DataFrame, prefix: str = "q_") -> DataFrame:
    """docs with the measures of every whole text, each under the prefix."""
    names = [c for c in docs.columns]
    t = "_q_t"
    df = docs.select(*names, F.coalesce(F.col("text").cast("string"), F.lit("")).alias(t))
    df = df.select(
        *names,
        t,
        F.expr(rf"split(trim(BOTH ' \t\n\u000B\u000C\r' FROM {t}), '{_WS}+')").alias("_q_w"),
        F.expr(rf"filter(split({t}, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("_q_l"),
        F.expr(f"cast(regexp_count({t}, '[#*$%&|<>]') as bigint)").alias(f"{prefix}n_symbols"),
        F.expr(f"cast(regexp_count({t}, '[#*$%&|<>]+') as bigint)").alias(f"{prefix}n_symbol_runs"),
        F.expr(f"cast(regexp_count({t}, '[A-Z]') as bigint)").alias(f"{prefix}n_upper"),
        F.expr(f"cast(regexp_count({t}, '[!?]') as bigint)").alias(f"{prefix}n_marks"),
    )
    keep = [f"{prefix}n_symbols", f"{prefix}n_upper", f"{prefix}n_marks", f"{prefix}n_symbol_runs"]
    df = df.select(
        *names,
        *keep,
        "_q_w",
        F.expr("cast(if(size(_q_w) = 1 and _q_w[0] = '', 0, size(_q_w)) as bigint)").alias(f"{prefix}n_words"),
        F.expr("cast(length(array_join(_q_w, '')) as bigint)").alias(f"{prefix}word_chars"),
        F.expr("cast(size(_q_l) as bigint)").alias(f"{prefix}n_lines"),
        F.expr("cast(size(_q_l) - size(array_distinct(_q_l)) as bigint)").alias(f"{prefix}n_dup_lines"),
        F.expr("transform(_q_w, w -> xxhash64(w))").alias("_q_h"),
    )
    keep += [f"{prefix}{m}" for m in ("n_words", "word_chars", "n_lines", "n_dup_lines")]
    df = df.select(
        *names,
        *keep,
        "_q_w",
        F.expr(
            "if(size(_q_h) < 5, cast(array() as array<bigint>), transform(sequence(0, size(_q_h) - 5),"
            " i -> xxhash64(_q_h[i], _q_h[i + 1], _q_h[i + 2], _q_h[i + 3], _q_h[i + 4])))"
        ).alias("_q_g"),
    )
    df = df.select(
        *names,
        *keep,
        "_q_w",
        F.expr(
            "if(size(array_distinct(_q_g)) = size(_q_g), null,"
            " sort_array(transform(_q_g, (h, i) -> struct(h as h, i as i))))"
        ).alias("_q_s"),
    )
    df = df.select(
        *names,
        *keep,
        F.expr(
            "if(_q_s is null, null, sort_array(transform(filter(_q_s, (s, j) ->"
            " if(j > 0, _q_s[greatest(j - 1, 0)].h = s.h, false) or if(j < size(_q_s) - 1, _q_s[least(j + 1, size(_q_s) - 1)].h = s.h, false)),"
            " s -> struct(array_join(slice(_q_w, s.i + 1, 5), ' ') as g, s.i as i))))"
        ).alias("_q_c"),
    )
    df = df.select(
        *names,
        *keep,
        F.expr(
            "if(_q_c is null, null, sort_array(transform(filter(_q_c, (s, j) ->"
            " if(j > 0, _q_c[greatest(j - 1, 0)].g = s.g, false) or if(j < size(_q_c) - 1, _q_c[least(j + 1, size(_q_c) - 1)].g = s.g, false)),"
            " s -> s.i)))"
        ).alias("_q_p"),
    )
    covered = (
        "if(_q_p is null, 0L, cast(aggregate(transform(_q_p, (p, j) ->"
        " if(j < size(_q_p) - 1, least(5, _q_p[least(j + 1, size(_q_p) - 1)] - p), 5)), 0, (a, x) -> a + x) as bigint))"
    )
    df = df.select(*names, *keep, F.expr(covered).alias(f"{prefix}n_repeat_words"))
    return df.select(*names, *[F.col(f"{prefix}{m}") for m in MEASURES])


def base_failed(prefix: str = "") -> str:
    return f"({prefix}n_words < 10 or 100 * {prefix}n_repeat_words > 20 * {prefix}n_words)"


def _vote(rule: str, prefix: str) -> str:
    bad, good = RULES[rule]
    for m in MEASURES:
        bad, good = bad.replace(m, f"@{m}"), good.replace(m, f"@{m}")
    bad, good = bad.replace("@", prefix), good.replace("@", prefix)
    return f"cast(case when {bad} then -1 when {good} then 1 else 0 end as int)"


def _start() -> dict[str, float]:
    """Good documents rarely get a bad vote; a bad one gets it from about a third of the rules that vote."""
    return {"prior": 0.9} | {f"g_{r}": 0.998 for r in RULES} | {f"b_{r}": 0.3 for r in RULES}


def posterior(p: dict[str, float] | str) -> str:
    """SQL for the probability that a document with votes v_<rule> is good.

    p: numbers, or the alias of a row that has them as columns.
    """
    at = (lambda k: repr(float(p[k]))) if isinstance(p, dict) else (lambda k: f"{p}.{k}")
    good, bad = [f"cast({at('prior')} as double)"], [f"(1 - cast({at('prior')} as double))"]
    for r in RULES:
        g, b = f"cast({at(f'g_{r}')} as double)", f"cast({at(f'b_{r}')} as double)"
        good.append(f"case v_{r} when 1 then {g} when -1 then 1 - {g} else 1 end")
        bad.append(f"case v_{r} when 1 then 1 - {b} when -1 then {b} else 1 end")
    good_, bad_ = " * ".join(good), " * ".join(bad)
    return f"({good_}) / (({good_}) + ({bad_}))"


def _estimates() -> list[str]:
    """SQL of one M-step over patterns (n documents, posterior q), smoothed by the starting belief.

    The belief weighs as a two-hundredth of the documents, so it decides only
    what the votes leave open, at every size alike.
    """
    w = "(0.005 * sum(n))"
    s = _start()
    out = [f"(sum(n * q) + {s['prior']!r} * {w}) / (sum(n) + {w}) as prior"]
    for r in RULES:
        out.append(
            f"(sum(case when v_{r} = 1 then n * q else 0 end) + {s[f'g_{r}']!r} * {w})"
            f" / (sum(case when v_{r} <> 0 then n * q else 0 end) + {w}) as g_{r}"
        )
        out.append(
            f"(sum(case when v_{r} = -1 then n * (1 - q) else 0 end) + {s[f'b_{r}']!r} * {w})"
            f" / (sum(case when v_{r} <> 0 then n * (1 - q) else 0 end) + {w}) as b_{r}"
        )
    return out


def fit(scratch: Scratch, measured: DataFrame, prefix: str = "q_") -> dict[str, float]:
    """The estimates of EM after ROUNDS passes over the vote patterns of documents without base failure."""
    votes = measured.filter(f"not {base_failed(prefix)}").select(*[F.expr(_vote(r, prefix)).alias(f"v_{r}") for r in RULES])
    patterns = scratch.save(votes.groupBy(*votes.columns).agg(F.count(F.lit(1)).cast("double").alias("n")), "patterns")
    now = _start()
    if patterns.isEmpty():
        return now
    for _ in range(ROUNDS):
        row = patterns.withColumn("q", F.expr(posterior(now))).selectExpr(*_estimates()).first()
        now = {k: float(row[k]) for k in now}
    return now


def _judged(measured: DataFrame, estimates: dict[str, float], prefix: str) -> DataFrame:
    voted = measured.withColumns({f"v_{r}": F.expr(_vote(r, prefix)) for r in RULES})
    return voted.withColumn("q_posterior", F.expr(posterior(estimates))).withColumn(
        "q_base_failed", F.expr(base_failed(prefix))
    )


def judge(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the measures, base_failed, posterior and kept, one row per document."""
    scratch = Scratch(spark, "quality")
    measured = scratch.save(with_measures(docs.select("doc_id", "text")).drop("text"), "measures")
    judged = _judged(measured, fit(scratch, measured), "q_")
    return judged.select(
        "doc_id",
        *[F.col(f"q_{m}").alias(m) for m in MEASURES[:5]],
        F.col("q_base_failed").alias("base_failed"),
        F.expr(f"not q_base_failed and round(q_posterior, 9) >= {threshold}").alias("kept"),
        F.round("q_posterior", 6).alias("posterior"),
    )


def filter_quality(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that stay, with their columns. The measured table is written once and read twice."""
    scratch = Scratch(spark, "quality")
    measured = scratch.save(with_measures(boxed(docs).select("doc", "text")).drop("text"), "measured")
    judged = _judged(measured, fit(scratch, measured), "q_")
    return judged.filter(f"not q_base_failed and round(q_posterior, 9) >= {threshold}").select("doc.*")


def op8_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    ws = "[\\x20\\x09-\\x0D]"
    votes = ", ".join(f"{_vote(r, '')} AS v_{r}" for r in RULES)
    cols = ", ".join(f"v_{r}" for r in RULES)
    s = _start()
    rounds = f"e0 AS (SELECT {', '.join(f'{v!r}::double AS {k}' for k, v in s.items())})"
    for i in range(ROUNDS):
        rounds += (
            f", q{i} AS MATERIALIZED (SELECT p.*, {posterior(f'e{i}')} AS q FROM patterns p, e{i})"
            f", e{i + 1} AS MATERIALIZED (SELECT {', '.join(_estimates())} FROM q{i})"
        )
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
      list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM
      (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
m AS MATERIALIZED (SELECT w.doc_id, len(w)::bigint AS n_words, length(array_to_string(w, ''))::bigint AS word_chars,
      len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint AS n_symbols,
      (len(l) - len(list_distinct(l)))::bigint AS n_dup_lines, coalesce(rep.n, 0)::bigint AS n_repeat_words,
      len(l)::bigint AS n_lines, len(regexp_extract_all(t, '[A-Z]'))::bigint AS n_upper,
      len(regexp_extract_all(t, '[#*$%&|<>]+'))::bigint AS n_symbol_runs,
      len(regexp_extract_all(t, '[!?]'))::bigint AS n_marks FROM w LEFT JOIN rep USING (doc_id)),
v AS MATERIALIZED (SELECT *, {votes} FROM m),
patterns AS MATERIALIZED (SELECT {cols}, count(*)::double AS n FROM v WHERE NOT {base_failed()} GROUP BY ALL),
{rounds}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {base_failed()} AS base_failed,
       NOT {base_failed()} AND round({posterior(f'e{ROUNDS}')}, 9) >= {THRESHOLD} AS kept,
       round({posterior(f'e{ROUNDS}')}, 6) AS posterior
FROM v, e{ROUNDS}
"""


ORACLE_SQL = _oracle()
