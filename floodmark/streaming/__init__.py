"""The same checks over a stream: each micro-batch is judged by the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def check_stream(stream: DataFrame, check: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Runs `check`, any of the operators, on each micro-batch and hands its rows to `sink` with the batch's number, by which a
    sink can drop what a restart delivers again."""

    def judge(batch: DataFrame, number: int) -> None:
        sink(check(batch), number)

    writer = stream.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_loads(stream: DataFrame, time: str, every: str, settle: str) -> DataFrame:
    """Rows loaded in each period, final once `settle` has passed: a period's count comes once and never changes."""
    from pyspark.sql import functions as F

    counts = stream.withWatermark(time, settle).groupBy(F.window(time, every)).agg(F.count(F.lit(1)).alias("loaded"))
    return counts.select(F.col("window.start").alias("slot"), "loaded")
