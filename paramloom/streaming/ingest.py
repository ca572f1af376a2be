"""Sweeps that arrive as a stream: each micro-batch is recalled or computed, then appended.

An addition to batch sweeps. The store makes it idempotent: a batch that is
replayed after a failure finds its results and appends none of them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from paramloom.plans.study import Options, Study


def ingest(study: Study, step: str, stream: DataFrame, out: str, checkpoint: str, base: dict | None = None, options: Options | None = None, available_now: bool = True) -> StreamingQuery:
    """Runs step over the rows of stream; out gets a folder per micro-batch, overwritten on replay."""

    def one(batch: DataFrame, number: int) -> None:
        study.run_sweep(step, batch, base, options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
