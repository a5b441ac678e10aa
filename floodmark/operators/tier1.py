"""Checks on one table: its loads, their volume, its landed files, its keys and its schema.

Each is a plan from DataFrames to a few rows of population and violations; no check iterates over data in the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from floodmark.functions.keys import KeyPart, base_name, blank
from floodmark.functions.times import TimeColumn, as_utc, loaded_within, stamp, utc
from floodmark.operators.common import group_columns, judged, names, ones, with_first

LISTED = 100
HISTORY, LEAST_HISTORY = 14, 7


@dataclass(frozen=True)
class Period:
    """A cadence slot: its local time of day, its name, and where its period begins and ends."""

    label: str
    slot_time: str
    start: datetime
    end: datetime


def _spans(spans: Sequence[tuple[datetime, datetime]]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("n"), stamp(a).alias("a"), stamp(b).alias("b")) for k, (a, b) in enumerate(spans)])


def span_counts(rows: DataFrame, time: TimeColumn, spans: Sequence[tuple[datetime, datetime]], zone: str = "UTC") -> DataFrame:
    """n and rows for each span [a, b) that any row lies in; spans may overlap.

    Each row names its spans itself and only counts are exchanged: no join by range.
    """
    first, last = min(a for a, _ in spans), max(b for _, b in spans)
    hit = F.filter(_spans(spans), lambda s: (F.col("_t") >= s["a"]) & (F.col("_t") < s["b"]))
    found = rows.where(loaded_within(time, as_utc(first), as_utc(last), zone)).select(utc(time, zone).alias("_t")).select(F.explode(hit).alias("_s"))
    return found.groupBy(F.col("_s.n").alias("n")).agg(F.count(F.lit(1)).alias("row_count"))


def _all_spans(rows: DataFrame, columns: Sequence[Column]) -> DataFrame:
    return rows.sparkSession.range(1).select(F.inline(F.array(*columns)))


def slot_loads(rows: DataFrame, load_time: TimeColumn, slots: Sequence[datetime], sla: timedelta, zone: str = "UTC") -> DataFrame:
    """slot and loaded, the rows loaded in [slot, slot + sla), for each slot."""
    counts = span_counts(rows, load_time, [(s, s + sla) for s in slots], zone)
    every = _all_spans(rows, [F.struct(F.lit(k).alias("n"), stamp(s).alias("slot")) for k, s in enumerate(slots)])
    return every.join(counts, "n", "left").select("slot", F.coalesce("row_count", F.lit(0)).cast("long").alias("loaded"))


def due_loads(rows: DataFrame, load_time: TimeColumn, slots: Sequence[datetime], sla: timedelta, least_rows: int = 1, zone: str = "UTC") -> DataFrame:
    """One row: slots due, slots with fewer than least_rows rows, and those slots in order. A load at the deadline is late."""
    short = F.col("loaded") < least_rows
    return slot_loads(rows, load_time, slots, sla, zone).agg(F.count(F.lit(1)).alias("population"), ones(short).alias("violations"), F.sort_array(F.collect_list(F.when(short, F.col("slot")))).alias("short_slots"))


def volume_history(results: DataFrame, dataset: str, before: datetime, labels: Sequence[str]) -> DataFrame:
    """label and row_count of the last HISTORY loads of each label, out of a dataset's stored volume results: one for
    each load, the latest judgement of it, newest first by window end."""
    label, slot = F.col("group_values")["slot"], F.col("group_values")["slot_time"]
    kept = results.where((F.col("dataset") == dataset) & (F.col("check_id") == "T1_VOLUME") & (F.col("execution_type") == "NORMAL") & (F.col("population") > 0) & (F.col("state").isin("PASSED", "FAILED") | (F.col("reason_code") == "insufficient_history")) & (F.col("window_end") <= stamp(before)) & label.isin(list(labels)))
    loads = kept.groupBy(label.alias("label"), slot.alias("slot_time")).agg(F.max_by("population", "window_end").alias("row_count"), F.max("window_end").alias("window_end"))
    return last_loads(loads, "window_end")


def last_loads(loads: DataFrame, newest: str, limit: int = HISTORY) -> DataFrame:
    order = Window.partitionBy("label").orderBy(F.desc(newest))
    return loads.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= limit).select("label", "row_count")


def volume(rows: DataFrame, load_time: TimeColumn, periods: Sequence[Period], history: DataFrame, tolerance: float, least_history: int = LEAST_HISTORY, zone: str = "UTC") -> DataFrame:
    """For each period with rows: g_1 (label), g_2 (slot), row_count, loads, median_rows, low, high and outside (null with too
    short a history)."""
    counts = span_counts(rows, load_time, [(p.start, p.end) for p in periods], zone)
    every = _all_spans(rows, [F.struct(F.lit(k).alias("n"), F.lit(p.label).alias("label"), F.lit(p.slot_time).alias("slot_time")) for k, p in enumerate(periods)])
    stats = history.groupBy("label").agg(F.count(F.lit(1)).alias("loads"), F.median("row_count").alias("median_rows"))
    low, high = F.col("median_rows") * (1 - tolerance), F.col("median_rows") * (1 + tolerance)
    found = every.join(counts, "n").join(stats, "label", "left")
    loads = F.coalesce("loads", F.lit(0)).cast("long")
    return found.select(F.col("label").alias("g_1"), F.col("slot_time").alias("g_2"), "row_count", loads.alias("loads"), "median_rows", low.alias("low"), high.alias("high"), F.when(loads >= least_history, F.when(F.col("row_count").between(low, high), 0).otherwise(1)).alias("outside"))


def files_not_loaded(registry: DataFrame, raw: DataFrame, file_column: str, cutoff: datetime, limit: int = LISTED) -> DataFrame:
    """One row: files first seen before the cutoff, those without raw rows of their base name, and the first of those paths.
    registry has path and first_seen_at, a row for each sighting."""
    files = registry.groupBy("path").agg(F.min("first_seen_at").alias("first_seen_at")).where(F.col("first_seen_at") < stamp(cutoff))
    loaded = raw.groupBy(base_name(file_column).alias("_file")).agg(F.count(F.lit(1)).alias("raw_rows"))
    found = files.join(loaded, base_name("path") == F.col("_file"), "left").select("path", F.coalesce("raw_rows", F.lit(0)).alias("raw_rows"))
    lost = F.col("raw_rows") == 0
    return with_first(found, [F.count(F.lit(1)).alias("population"), ones(lost).alias("violations")], lost, F.col("path"), limit, "not_loaded")


def key_nulls(rows: DataFrame, load_time: TimeColumn, key: Sequence[str], start: datetime, end: datetime, groups: Sequence[str] = (), zone: str = "UTC") -> DataFrame:
    """Rows loaded in the window, and those with a blank key column as stored."""
    bad = blank(key[0])
    for column in key[1:]:
        bad = bad | blank(column)
    return judged(rows.where(loaded_within(load_time, start, end, zone)).select(*group_columns(groups), bad.alias("_bad")), groups, F.col("_bad"))


def key_counts(rows: DataFrame, key: Sequence[KeyPart], groups: Sequence[str], *more: Column) -> DataFrame:
    """One row for each key and group: the key parts k_1, ..., the groups and how many rows hold it."""
    keys = [p.value().alias(f"k_{k}") for k, p in enumerate(key, 1)]
    return rows.groupBy(*keys, *group_columns(groups)).agg(F.count(F.lit(1)).alias("rows"), *more)


def key_duplicates(rows: DataFrame, key: Sequence[KeyPart], groups: Sequence[str] = ()) -> DataFrame:
    """Distinct normalised keys of the whole table, and those on more than one row."""
    return judged(key_counts(rows, key, groups), groups, F.col("rows") > 1)


@dataclass(frozen=True)
class Drift:
    """A schema against the last one recorded."""

    columns: dict[str, str]
    digest: str
    changed: bool | None
    added: list[str]
    removed: list[str]
    retyped: list[str]

    @property
    def violations(self) -> int:
        """At least one where anything changed: the order of columns too."""
        return max(1, len(self.added) + len(self.removed) + len(self.retyped)) if self.changed else 0


def columns_of(schema: StructType) -> dict[str, str]:
    return {f.name.lower(): f.dataType.simpleString() for f in schema.fields}


def schema_digest(columns: dict[str, str]) -> str:
    return hashlib.sha256(",".join(f"{n}:{t}" for n, t in columns.items()).encode()).hexdigest()


def schema_drift(schema: StructType, recorded: dict[str, str] | None) -> Drift:
    """`changed` is None where nothing was recorded yet."""
    now = columns_of(schema)
    digest = schema_digest(now)
    if recorded is None:
        return Drift(now, digest, None, [], [], [])
    return Drift(now, digest, digest != schema_digest(recorded), sorted(set(now) - set(recorded)), sorted(set(recorded) - set(now)), sorted(n for n in set(now) & set(recorded) if now[n] != recorded[n]))


__all__ = ["Drift", "Period", "due_loads", "files_not_loaded", "key_counts", "key_duplicates", "key_nulls", "names", "schema_drift", "slot_loads", "span_counts", "volume", "volume_history"]
