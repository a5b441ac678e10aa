"""Shards by sampled splitters: size-weighted key samples give quantile boundaries, records are range-partitioned by them,
and ranges that turn out overfull are subdivided. DataFrame functions only.

The ranges are many more than the shards. Sizes are summed exactly within each range, and the ranges' totals place every
record on one line of bytes, which is cut into equal shards: sizes differ by no more than about one record. Equal texts
stand side by side on that line, yet a group of any size is spread over ranges by the second half of its keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floodmark.llm.common import n_partitions, staged
from floodmark.llm.ranges import hash_hex, range_index, sampled_splitters

RANGES_PER_SHARD = 32


def shard_records(df: DataFrame, size: str, near: list[str], n_shards: int = 24, law: str = "bytes") -> DataFrame:
    """df with shard (0 to n_shards - 1), slot (gapless from 0 in each shard) and law.

    `size` names the records' sizes; law "rows" counts each record as one instead. `near` names the columns whose equal
    values stand side by side. Null or negative sizes count as 0. Repeated rows are records of their own; an empty table
    gives no rows; columns of df that are called as those added are replaced.
    """
    if law not in ("bytes", "rows"):
        raise ValueError(f"no such law: {law}")
    own = [c for c in df.columns if c not in ("shard", "slot", "law")]
    weight = F.lit(1).cast("long") if law == "rows" else F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    rows = df.select(*own, weight.alias("_size"), F.monotonically_increasing_id().alias("_row"))
    rows = staged(rows.withColumn("_key", F.concat(hash_hex(*near), hash_hex("_row"))), "records")
    total = rows.agg(F.sum("_size")).first()[0] or 0
    ranges = max(n_shards * RANGES_PER_SHARD, n_partitions(df.sparkSession))
    cut = sampled_splitters(rows, "_key", "_size", ranges, total)
    rows = rows.withColumn("_range", range_index(F.col("_key"), cut))
    fair = max(1, total // ranges)
    sized = rows.groupBy("_range").agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_n"))
    # one row for each range at most, so it may be broadcast
    cuts = sized.select("_range", F.when((F.col("_bytes") > 2 * fair) & (F.col("_n") > 1), F.ceil(F.col("_bytes") / fair)).otherwise(1).alias("_cuts"))
    rows = rows.join(F.broadcast(cuts), "_range").withColumn("_cut", F.pmod(F.xxhash64(F.lit("cut"), "_key"), F.col("_cuts"))).drop("_cuts")
    parts = rows.groupBy("_range", "_cut").agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_n"))
    line = Window.orderBy("_range", "_cut").rowsBetween(Window.unboundedPreceding, -1)  # at most two for each range
    before = parts.select("_range", "_cut", F.coalesce(F.sum("_bytes").over(line), F.lit(0)).alias("_bytes"), F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_n"))
    inside = Window.partitionBy("_range", "_cut").orderBy("_key", "_row")
    placed = rows.withColumns({"_at": F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"), "_rank": F.row_number().over(inside) - 1})
    placed = placed.join(F.broadcast(before), ["_range", "_cut"])
    middle = F.col("_bytes") + F.col("_at") + F.col("_size") / 2
    shard = F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / F.lit(max(1, total))).cast("int")).cast("int")
    placed = staged(placed.select(*own, shard.alias("shard"), (F.col("_n") + F.col("_rank")).alias("_rank")), "placed")
    first = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))  # one row for each shard
    return placed.join(F.broadcast(first), "shard").select(*own, "shard", (F.col("_rank") - F.col("_first")).cast("long").alias("slot"), F.lit(law).alias("law"))


def write_shards(sharded: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """One folder for each shard, its records by slot; a large shard goes to several files, dealt out by slot."""
    dealt = sharded.repartition("shard", F.pmod("slot", F.lit(files_per_shard)))
    dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
