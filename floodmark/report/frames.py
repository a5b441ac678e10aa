"""The DataFrame side of the digest and the trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodmark.functions.keys import base_name


def group_text(groups: Column) -> Column:
    """A map as sorted k=v, a null value as nothing."""
    return F.array_join(F.array_sort(F.transform(F.map_keys(groups), lambda k: F.concat(k, F.lit("="), F.coalesce(groups[k], F.lit(""))))), ",")


def digest_history(results: DataFrame) -> DataFrame:
    """The latest NORMAL row of each dataset's check and group, its previous state, and since when it has failed without a break."""
    rows = results.where("execution_type = 'NORMAL'").withColumn("groups", group_text(F.col("group_values")))
    key = ["dataset", "check_id", "groups"]
    order = Window.partitionBy(*key).orderBy(F.desc("window_end"), F.desc("evaluated_at"), F.desc("run_id"))
    ranked = rows.withColumns({"_rank": F.row_number().over(order), "_sound": F.max(F.when(F.col("state") != "FAILED", F.col("evaluated_at"))).over(Window.partitionBy(*key))})
    failing = (F.col("state") == "FAILED") & (F.col("_sound").isNull() | (F.col("evaluated_at") > F.col("_sound")))
    agg = ranked.groupBy(*key).agg(F.max(F.when(F.col("_rank") == 1, F.struct("state", "evaluated_at", "run_id"))).alias("_now"), F.max(F.when(F.col("_rank") == 2, F.col("state"))).alias("previous_state"), F.min(F.when(failing, F.col("evaluated_at"))).alias("failed_since"))
    return agg.select(*key, "_now.state", "previous_state", "failed_since", F.col("_now.run_id").alias("run_id"))


def trace_layer(rows: DataFrame, match: list[tuple[Column, str]], record: Column, load: Column | None = None, file: str | None = None) -> DataFrame:
    """One row: how many rows of a layer hold a key, and the record time, load time and file of the latest version."""
    found = rows
    for column, value in match:
        found = found.where(column.cast("string") == F.lit(value))
    cells = found.select(record.alias("r"), (load if load is not None else F.lit(None).cast("timestamp")).alias("l"), (base_name(file) if file else F.lit(None).cast("string")).alias("f"))
    return cells.agg(F.count(F.lit(1)).alias("row_count"), F.max_by("r", "r").alias("record_ts"), F.max_by("l", "r").alias("load_ts"), F.max_by("f", "r").alias("file_name"))


def gone_groups(history: DataFrame, current: DataFrame) -> DataFrame:
    """Of a digest's history, the groups that failed when last seen and have no row in the current run (dataset, check_id, groups,
    state) although their check ran. A volume's groups are new each time."""
    ran = current.where("state <> 'DID_NOT_RUN'").select("dataset", "check_id").distinct()
    failed = history.where("state = 'FAILED' AND groups <> '' AND check_id <> 'T1_VOLUME'")
    return failed.join(ran, ["dataset", "check_id"], "left_semi").join(current.select("dataset", "check_id", "groups"), ["dataset", "check_id", "groups"], "left_anti")


def confirmed_causes(causes: DataFrame, results: DataFrame, ref: str, hop: str) -> DataFrame:
    """What causes are confirmed for a failing item at a hop, latest window first."""
    found = causes.where((F.col("failure_ref") == ref) & (F.col("hop") == hop) & (F.col("state") == "CONFIRMED")).select("evaluation_id", "run_id", "cause_code", "order_no", "evidence")
    return found.join(results.select("evaluation_id", "run_id", "window_end"), ["evaluation_id", "run_id"]).orderBy(F.desc("window_end"), "order_no")
