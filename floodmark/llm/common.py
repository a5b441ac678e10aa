"""What the operators of this subpackage share: tables, the shared folder, staged tables and ordered prefix sums."""

from __future__ import annotations

import ctypes
import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one that the session names for checkpoints, else one in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stages"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Of a row group of a table of wide rows.
GROUP_BYTES = 4 << 20
#: Paths of the staged tables of each `scratch` that is open.
_OPEN: list[list[str]] = []


def staged(df: DataFrame, name: str, files: int | None = None, lasting: bool = False, wide: bool = False) -> DataFrame:
    """df written to the shared folder and read again: later steps restart from files, not from lost executors. `files` bounds the
    number of files of a table that is known to be slim; a `wide` one is written in small row groups, as a task that writes or reads it
    holds a whole one. Within a `scratch` it goes at the end, unless it is `lasting`."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if _OPEN and not lasting:
        _OPEN[-1].append(path)
    writer = (df if files is None else df.coalesce(files)).write.option("compression", "zstd")
    (writer.option("parquet.block.size", str(GROUP_BYTES)) if wide else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables staged within it when it ends. What is lazy and leaves it must read lasting tables alone."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            drop_stage(spark, path)


@contextmanager
def shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """Within it Spark deletes an execution's shuffle files when it ends, not when the driver's garbage is collected; if a lost
    executor makes them needed again, their stages are run again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs within it passes so many rows at once to Python, and reads as many at once from files: for wide rows, which both
    sides hold a few batches of."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(key) for key in keys]
    for key in keys:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        for key, value in zip(keys, before):
            spark.conf.set(key, value)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives what is free back to the system before and after its task: Spark keeps workers, and allocators keep the most that
    any task of theirs once had."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        try:
            yield from run(batches)
        finally:
            released()

    return wrapped


def released() -> None:
    """Gives the free memory of this process back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Rows of a key column that may be broadcast: about 8 MB.
FEW_KEYS = 500_000


def among(rows: DataFrame, keys: DataFrame, on: str, most: int = FEW_KEYS) -> DataFrame:
    """The rows whose `on` is in keys, a table of that one column that is cheap to count. A few keys are broadcast, so that the rows
    stay where they are; more are joined as Catalyst sees fit."""
    few = keys.limit(most + 1).count() <= most
    return rows.join(F.broadcast(keys) if few else keys, on, "left_semi")


def free_name(df: DataFrame, name: str) -> str:
    """name, or with underscores added until df has no such column."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def drop_stage(spark: SparkSession, path: str) -> None:
    """Deletes a staged folder through Hadoop's file systems, wherever it lies."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def prefix_sums(df: DataFrame, order: list[str], value: str, out: str, part: str = "range_part", files: int | None = None) -> DataFrame:
    """Adds `out`, the sum of `value` over all rows before this one by `order`, and `part`, its range.

    Rows are dealt out by ranges of `order`, summed within each range, and only one total per range is gathered.
    `order` must be unique for a range never to grow with ties.
    """
    spark = df.sparkSession
    ranged = staged(df.repartitionByRange(n_partitions(spark), *order).withColumn(part, F.spark_partition_id()), "ranges", files)
    within = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(part).agg(F.sum(value).alias("_total"))
    before = totals.select(F.col(part).alias("_part"), F.coalesce(F.sum("_total").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return (
        ranged.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
        .join(F.broadcast(before), F.col(part) == F.col("_part"))  # one row for each range
        .withColumn(out, (F.col("_within") + F.col("_before")).cast("long"))
        .drop("_within", "_before", "_part")
    )


def parts_for(total: float, per_part: float) -> int:
    return max(1, math.ceil(total / per_part))
