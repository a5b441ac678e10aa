"""What checks read: a filtered table, or a relation derived from several."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floodmark.functions.times import TimeColumn, utc

UNMATCHED = "unmatched_sources"


@dataclass(frozen=True)
class Source:
    """A DataFrame under a name, with its filter."""

    name: str
    frame: DataFrame
    filter: str | None = None

    def rows(self) -> DataFrame:
        return self.frame.where(F.expr(self.filter)) if self.filter else self.frame


@dataclass(frozen=True)
class Lookup:
    """A join of a derived relation: `match` pairs qualified columns, (one already joined, one of the new source)."""

    source: Source
    match: list[tuple[str, str]]
    how: str = "left"


@dataclass(frozen=True)
class Derived:
    base: Source
    lookups: list[Lookup] = field(default_factory=list)
    where: str | None = None
    group_by: dict[str, str] = field(default_factory=dict)
    columns: dict[str, str] = field(default_factory=dict)
    record_time: TimeColumn | None = None
    load_time: TimeColumn | None = None
    default_zone: str = "UTC"


def table(spark: SparkSession, name: str, row_filter: str | None = None) -> DataFrame:
    rows = spark.table(name)
    return rows.where(F.expr(row_filter)) if row_filter else rows


def _of_base(time: TimeColumn | None, base: str, zone: str) -> Column:
    if time is None:
        return F.lit(None).cast("timestamp")
    local = F.try_to_timestamp(F.col(f"{base}.{time.column}").cast("string"), F.lit(time.format)) if time.format else F.expr(f"try_cast(`{base}`.`{time.column}` AS TIMESTAMP)")
    return F.to_utc_timestamp(local, time.zone(zone))


def derive(spec: Derived) -> DataFrame:
    """The group_by and columns outputs, record_ts and load_ts (the latest of the base's rows in the group, UTC) and the names
    of the joined sources that had no match somewhere in the group. A lookup that matches several rows multiplies them."""
    rows = spec.base.rows().alias(spec.base.name)
    for look in spec.lookups:
        on = [F.col(left) == F.col(right) for left, right in look.match]
        condition = on[0]
        for c in on[1:]:
            condition = condition & c
        rows = rows.join(look.source.rows().alias(look.source.name), condition, look.how)
    if spec.where:
        rows = rows.where(F.expr(spec.where))
    # one flag for each lookup instead of a list of all names for each row
    missing = [F.max(F.when(F.col(look.match[0][1]).isNull(), F.lit(look.source.name))).alias(f"_missing_{k}") for k, look in enumerate(spec.lookups)]
    grouped = rows.groupBy(*[F.expr(e).alias(n) for n, e in spec.group_by.items()]).agg(
        *[F.expr(e).alias(n) for n, e in spec.columns.items()],
        F.max(_of_base(spec.record_time, spec.base.name, spec.default_zone)).alias("record_ts"),
        F.max(_of_base(spec.load_time, spec.base.name, spec.default_zone)).alias("load_ts"),
        *missing,
    )
    names = F.array(*[F.col(f"_missing_{k}") for k in range(len(missing))]) if missing else F.array().cast("array<string>")
    return grouped.withColumn(UNMATCHED, F.array_sort(F.array_compact(names))).drop(*[f"_missing_{k}" for k in range(len(missing))])


__all__ = ["UNMATCHED", "Derived", "Lookup", "Source", "derive", "table", "utc"]
