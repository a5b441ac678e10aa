"""Current state out of append-only rows: the four views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_run(runs: DataFrame) -> DataFrame:
    """One row for each run: its final one once there is one, else STARTED."""
    order = Window.partitionBy("run_id").orderBy(F.desc(F.col("status") != "STARTED"), F.desc("ended_at"))
    return runs.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def latest_result(results: DataFrame) -> DataFrame:
    """Every row (group) of the latest evaluation of each dataset's check: latest window, then evaluation, then run."""
    order = Window.partitionBy("dataset", "check_id").orderBy(F.desc("window_end"), F.desc("evaluated_at"), F.desc("run_id"))
    return results.withColumn("_rank", F.dense_rank().over(order)).where("_rank = 1").drop("_rank")


def open_keys(events: DataFrame) -> DataFrame:
    """Keys whose latest event flags them, and when this spell of being flagged began.

    Two grouped aggregates instead of windows: a key's events shrink to one row before any exchange but the first.
    """
    key = ["dataset", "check_id", "hop", "key_hash"]
    flagged = F.col("event").isin("FLAGGED", "STILL_FLAGGED")
    latest = F.max(F.struct("observed_at", "run_id", F.col("event").alias("latest_event"), "state_detail", "evaluation_id"))
    cleared = events.groupBy(*key).agg(latest.alias("_last"), F.max(F.when(F.col("event") == "CLEARED", F.col("observed_at"))).alias("_cleared"))
    still = cleared.where(F.col("_last.latest_event").isin("FLAGGED", "STILL_FLAGGED"))
    spell = events.where(flagged).join(still.select(*key, "_cleared"), key).where(F.col("_cleared").isNull() | (F.col("observed_at") > F.col("_cleared")))
    first = spell.groupBy(*key).agg(F.min("observed_at").alias("first_flagged_at"))
    return still.join(first, key, "left").select(*key, "_last.latest_event", "_last.state_detail", "first_flagged_at", F.col("_last.observed_at").alias("last_observed_at"), "_last.run_id", "_last.evaluation_id")


def file_status(files: DataFrame) -> DataFrame:
    """One row for each path: when it was first seen, and its latest size and times."""
    last = F.max(F.struct("observed_at", "run_id", "feed", "size_bytes", "modified_at"))
    found = files.groupBy("path").agg(F.min("first_seen_at").alias("first_seen_at"), last.alias("_last"))
    return found.select("path", "_last.feed", "first_seen_at", F.col("_last.size_bytes").alias("latest_size_bytes"), F.col("_last.modified_at").alias("latest_modified_at"), F.col("_last.observed_at").alias("last_observed_at"))


def window_history(results: DataFrame, runs: DataFrame) -> DataFrame:
    """dataset, previous_end, held_start, first_held_end, last_held_end and held_by of each dataset: where its next window starts,
    and what is held. An event is held by a check that didn't run for a PLATFORM or BUDGET reason, or by a run that didn't
    complete. Rule results, which have a severity, and other than NORMAL runs have no say."""
    blocked = (F.col("state") == "DID_NOT_RUN") & F.col("reason_category").isin("PLATFORM", "BUDGET")
    broken = F.coalesce(F.col("status"), F.lit("COMPLETED")) != "COMPLETED"
    kept = results.where("execution_type = 'NORMAL' AND severity IS NULL").join(latest_run(runs).select("run_id", "status"), "run_id", "left")
    why = F.when(blocked, F.col("reason_code")).when(broken, F.concat(F.lit("run_"), F.lower("status")))
    events = kept.groupBy("dataset", "event_id").agg(F.min("window_start").alias("a"), F.max("window_end").alias("b"), F.max(blocked | broken).alias("held"), F.collect_set(why).alias("why"))
    good = events.groupBy("dataset").agg(F.max(F.when(~F.col("held"), F.col("b"))).alias("previous_end"))
    held = events.where("held").join(good, "dataset").where(F.col("previous_end").isNull() | (F.col("b") > F.col("previous_end")))
    spans = held.groupBy("dataset").agg(F.min("a").alias("held_start"), F.min("b").alias("first_held_end"), F.max("b").alias("last_held_end"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("why")))).alias("held_by"))
    return good.join(spans, "dataset", "left")


def unexplained(results: DataFrame, causes: DataFrame, checks: list[str]) -> DataFrame:
    """The latest row of each evaluation of these checks that FAILED and has no cause rows."""
    order = Window.partitionBy("evaluation_id").orderBy(F.desc("evaluated_at"), F.desc("run_id"))
    latest = results.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return latest.where((F.col("state") == "FAILED") & F.col("check_id").isin(checks)).join(causes.select("evaluation_id"), "evaluation_id", "left_anti")
