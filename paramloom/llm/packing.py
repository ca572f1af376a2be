"""Packing token sequences into as few rows of ``capacity`` tokens as possible.

Method. The lengths of all pieces make a histogram (at most ``capacity``
classes, whatever the input). A configuration is a multiset of lengths that
fits one sequence; the configuration linear program asks for the fewest
configurations that cover the histogram. Multiplicative weights solve it:
each length has a price, a knapsack by dynamic programming finds the dearest
configuration, and the lengths it covers become cheaper. The fractional
solution is rounded down and the rest is packed by exact-complement best fit,
largest first, also on the histogram.

Scale. Tokenising is one pass; only (doc_id, piece, length, checksum) rows
are kept. The driver sees the histogram and returns runs: of the pieces of a
length, ranks a to b go to sequences c to d at one offset. Their number
depends on the capacity, never on the number of documents, and they are the
only broadcast besides the tokenizer. A piece's rank among those of its
length comes from counts per (length, salt), so no length, however common,
meets in one task.

Edge cases. Null text counts as empty and is its closing id alone. A document
longer than the capacity is cut into full pieces and a rest, none shorter are
cut. Repeated rows are packed each. Empty table: empty result. Other columns
are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paramloom.llm.pieces import encoder
from paramloom.llm.scratch import Scratch, bounded_batches

CAPACITY = 2048
ROUNDS = 120
STEP = 0.5
#: Pieces of one (length, salt) that one task ranks, about.
RANKED_TOGETHER = 50_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _cutter(spec, capacity: int, closing: bytes, with_ids: bool):
    def cut(batches):
        encode = encoder(spec.value, "word").encode
        for batch in batches:
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                raw = encode(text.as_py() or "") + closing
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    out["doc_id"].append(doc)
                    out["piece"].append(piece)
                    out["start"].append(at // 4)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
                    if with_ids:
                        out["ids"].append(np.frombuffer(part, "<u4").astype(np.int32))
            arrays = [
                pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()), pa.array(out["start"], pa.int64()),
                pa.array(out["length"], pa.int64()), pa.array(out["ids_crc32"], pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(out["ids"], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return cut


def pieces_of(
    spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, closing: int = 0, with_ids: bool = False
) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32, with_ids: ids."""
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    bounded_batches(spark)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return rows.mapInArrow(_cutter(spec, capacity, np.uint32(closing).tobytes(), with_ids), schema)


def _dearest(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> dict[int, int]:
    """The configuration of the highest total price: unbounded knapsack over the capacity."""
    best = np.zeros(capacity + 1)
    took = np.zeros(capacity + 1, dtype=np.int64)
    for c in range(int(lengths[0]), capacity + 1):
        n = np.searchsorted(lengths, c, "right")
        values = prices[:n] + best[c - lengths[:n]]
        k = int(values.argmax())
        if values[k] > best[c - 1]:
            best[c], took[c] = values[k], lengths[k]
        else:
            best[c], took[c] = best[c - 1], 0
    out: dict[int, int] = {}
    c = capacity
    while c > 0:
        if took[c]:
            out[int(took[c])] = out.get(int(took[c]), 0) + 1
            c -= int(took[c])
        else:
            c -= 1
    return out


def _best_fit(left: np.ndarray, first: int, capacity: int) -> dict[int, int]:
    """A configuration around one piece of length first: an exact complement of one or two pieces if there is one, else the longest that fits."""
    out, room = {first: 1}, capacity - first
    have = left.copy()
    have[first] -= 1
    while room > 0:
        if have[room] > 0:
            take = room
        else:
            there = np.flatnonzero(have[: room + 1] > 0)
            if not len(there):
                break
            other = room - there
            exact = there[(have[other] > 0) & ((other != there) | (have[there] > 1))]
            take = int(exact[-1]) if len(exact) else int(there[-1])
        out[take] = out.get(take, 0) + 1
        have[take] -= 1
        room -= take
    return out


def _solved(histogram: dict[int, int], capacity: int, rounds: int) -> list[tuple[dict[int, int], int]]:
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    chosen: list[tuple[dict[int, int], int]] = []

    def use(config: dict[int, int], times: int) -> None:
        chosen.append((config, times))
        for length, m in config.items():
            left[length] -= m * times

    if left[capacity]:
        use({capacity: 1}, int(left[capacity]))
    lengths = np.flatnonzero(left)
    if len(lengths) and rounds:
        need = left[lengths].astype(float)
        price = lengths / capacity  # total price of a full sequence: 1
        weight: dict[tuple, float] = {}
        for _ in range(rounds):
            config = _dearest(lengths, price, capacity)
            idx = np.searchsorted(lengths, list(config))
            m = np.array(list(config.values()), dtype=float)
            times = float((need[idx] / m).min())
            key = tuple(sorted(config.items()))
            weight[key] = weight.get(key, 0.0) + times
            price[idx] *= np.exp(-STEP * times * m / need[idx])
        covered = np.zeros(capacity + 1)
        for key, x in weight.items():
            for length, m in key:
                covered[length] += m * x
        over = max(1.0, float((covered[lengths] / need).max()))
        for key, x in sorted(weight.items(), key=lambda kv: (-kv[1], kv[0])):
            if sum(length * m for length, m in key) < capacity:
                continue  # of what rounding leaves, best fit wastes less
            times = min([int(x / over), *(int(left[length]) // m for length, m in key)])
            if times > 0:
                use(dict(key), times)
    for first in range(capacity, 0, -1):
        while left[first] > 0:
            config = _best_fit(left, first, capacity)
            use(config, max(1, min(int(left[length]) // m for length, m in config.items())))
    return chosen


def configurations(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """(configuration, times) whose pieces are exactly those of the histogram: the rounded program, or best fit alone where that takes fewer."""
    found = [_solved(histogram, capacity, r) for r in dict.fromkeys((rounds, 0))]
    return min(found, key=lambda chosen: sum(times for _, times in chosen))


def runs(chosen: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each (configuration, length): which ranks of that length it takes, and where they go."""
    at: dict[int, int] = {}
    rows, sequence = [], 0
    for config, times in chosen:
        offset = 0
        for length in sorted(config, reverse=True):
            m = config[length]
            rows.append((length, at.get(length, 0), m, sequence, offset))
            at[length] = at.get(length, 0) + m * times
            offset += m * length
        sequence += times
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return {k: table[:, i] for i, k in enumerate(("length", "first", "per", "sequence", "offset"))}


def _placer(table):
    def place(batches):
        t = table.value
        key = (t["length"] << 44) | t["first"]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in ("length", "rank"))
            i = np.searchsorted(key, (length << 44) | rank, "right") - 1
            inner = rank - t["first"][i]
            columns = [batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(t["sequence"][i] + inner // t["per"][i]), pa.array(t["offset"][i] + inner % t["per"][i] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return place


def pack(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece."""
    scratch = Scratch(spark, "packing")
    pieces = scratch.save(pieces_of(spark, docs, capacity, tokenizer), "pieces")
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    table = spark.sparkContext.broadcast(runs(configurations(histogram, capacity)))
    salts = max(1, -(-max(histogram.values(), default=0) // RANKED_TOGETHER))

    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    among = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("own", F.row_number().over(among) - 1).join(starts, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("own") + F.col("before"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank")).mapInArrow(
        _placer(table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def sequences(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """The packed rows themselves: sequence_id and its token ids."""
    scratch = Scratch(spark, "sequences")
    placed = scratch.save(pack(spark, docs, capacity, tokenizer), "placed")
    ids = pieces_of(spark, docs, capacity, tokenizer, with_ids=True)
    keys = ["doc_id", "piece", "ids_crc32", "length"]
    number = Window.partitionBy(*keys).orderBy(F.lit(0))  # equal pieces of repeated rows are interchangeable
    there = placed.withColumn("n", F.row_number().over(number))
    here = ids.withColumn("n", F.row_number().over(number)).select(*keys, "n", "ids")
    same = F.lit(True)
    for k in [*keys, "n"]:
        same = same & there[k].eqNullSafe(here[k])  # a null doc_id has pieces too
    both = there.join(here, same).select(there["sequence_id"], there["offset"], here["ids"])
    grouped = both.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return grouped.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))


def op7_configuration_lp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
