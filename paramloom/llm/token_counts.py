"""Token counts through a digest cache.

The cache is a table (content, version, n_tokens): the SHA-256 of the text
and of the tokenizer's definition with its settings. Texts are joined to it;
only distinct texts that it lacks are encoded, and their counts appended.
Content is digested as it stands, since any change of a text may change its
tokens.

Scale. Digests are compared first: only texts that the cache lacks are
shuffled, once, after a map-side distinct, so a text with millions of copies
costs one row per map task and one encoding. Everything else carries digests.
The tokenizer's definition (a few MB, fixed) is broadcast, and the missing
digests if they are at most scratch.SMALL.

Edge cases. Null text counts as empty: 0 bytes, 0 tokens. Special strings in
a text count as the library counts them by default (one token). Repeated rows
and ids each get their row. Empty table: empty result. Other columns are not
read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paramloom.llm.pieces import encoder
from paramloom.llm.scratch import Scratch, bounded_batches, if_small, shared_dir, text_or_empty

LIMIT = 1024


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _counter(spec):
    def count(batches):
        enc = encoder(spec.value, "byte").encode
        for batch in batches:
            texts = batch.column("text")
            yield pa.RecordBatch.from_arrays(
                [batch.column("content"), pa.array([len(enc(t.as_py())) // 4 for t in texts], pa.int64())],
                names=["content", "n_tokens"],
            )

    return count


def count_tokens(
    spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, cache_path: str | None = None, limit: int = LIMIT
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per document.

    cache_path: a folder kept between calls; without it the cache lives as
    long as the session. One writer at a time.
    """
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        definition = f.read()
    version = hashlib.sha256(b"v1;no special tokens;" + definition.encode()).hexdigest()
    spec = spark.sparkContext.broadcast(definition)
    bounded_batches(spark)
    scratch = Scratch(spark, "token-counts")
    cache_path = cache_path or f"{scratch.root}/cache"
    text = text_or_empty()
    texts = docs.select(F.sha2(text, 256).alias("content"), text.alias("text"))

    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_path)
    exists = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    schema = "content string, version string, n_tokens long"
    if exists:
        stored = spark.read.schema(schema).parquet(cache_path).filter(F.col("version") == version).select("content")
        missing = scratch.save(texts.select("content").distinct().join(stored, "content", "left_anti"), "missing")
        texts = texts.join(if_small(missing), "content", "left_semi")
    counted = texts.distinct().mapInArrow(_counter(spec), "content string, n_tokens long")
    counted.withColumn("version", F.lit(version)).select("content", "version", "n_tokens").write.mode("append").parquet(cache_path)

    counts = (
        spark.read.schema(schema).parquet(cache_path).filter(F.col("version") == version)
        .groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    )
    counts = scratch.save(counts, "counts")  # read back, the join deals both sides itself and can split a hot text
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.sha2(text, 256).alias("content"),
    )
    return rows.join(counts, "content").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def cache_of(spark: SparkSession, corpus: str) -> str:
    """The folder of a corpus's counts in the cluster's shared folder, kept from run to run."""
    return f"{shared_dir(spark).rstrip('/')}/token-cache/{hashlib.sha256(corpus.encode()).hexdigest()[:16]}"


def op4_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first run over a corpus encodes its distinct texts, a later one those that came since."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(spark, docs, cache_path=cache_of(spark, sf_dir))
