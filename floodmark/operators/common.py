"""Groups of results, as every check has them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_columns(groups: Sequence[str]) -> list[Column]:
    """The group columns as g_1, g_2, ..., so that they may be key columns too."""
    return [F.col(g).cast("string").alias(f"g_{k}") for k, g in enumerate(groups, 1)]


def names(groups: Sequence[str]) -> list[str]:
    return [f"g_{k}" for k in range(1, len(groups) + 1)]


def ones(condition: Column) -> Column:
    """How many rows the condition holds for; 0 over rows that it never holds for, null over no rows."""
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def judged(rows: DataFrame, groups: Sequence[str], violation: Column, *more: Column) -> DataFrame:
    """population and violations for each group of rows that already have the g_ columns."""
    return rows.groupBy(*names(groups)).agg(F.count(F.lit(1)).alias("population"), ones(violation).alias("violations"), *more)


def with_first(rows: DataFrame, counts: Sequence[Column], condition: Column, value: Column, limit: int, out: str) -> DataFrame:
    """One row: the counts over rows, and in `out` the first `limit` values, in order, of rows that meet the condition.

    Every task keeps no more than `limit` values, so no task holds all of them.
    """
    one = rows.agg(*counts)
    first = rows.where(condition).select(value.alias("_v")).where(F.col("_v").isNotNull()).orderBy("_v").limit(limit)
    both = one.unionByName(first.agg(F.array_sort(F.collect_list("_v")).alias(out)), allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in one.columns], F.first(out, ignorenulls=True).alias(out))
