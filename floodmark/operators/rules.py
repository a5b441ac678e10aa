"""The seven rule templates, each a plan over a whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodmark.functions.keys import KeyPart
from floodmark.operators.common import group_columns, judged, names, ones
from floodmark.operators.tier1 import key_counts


def _holds(fragment: str) -> Column:
    """A condition that is null doesn't hold."""
    return F.coalesce(F.expr(fragment), F.lit(False))


def max_rows_per_key(rows: DataFrame, key: Sequence[KeyPart], most: int, groups: Sequence[str] = ()) -> DataFrame:
    return judged(key_counts(rows, key, groups), groups, F.col("rows") > most)


def max_open_rows_per_key(rows: DataFrame, key: Sequence[KeyPart], open_when: str, most: int, groups: Sequence[str] = ()) -> DataFrame:
    """All keys are judged, those without an open row too."""
    return judged(key_counts(rows, key, groups, ones(_holds(open_when)).alias("open_rows")), groups, F.col("open_rows") > most)


def column_order(rows: DataFrame, lower: str, upper: str, nulls_fail: bool = False, form: str | None = None, groups: Sequence[str] = ()) -> DataFrame:
    """Rows with both values, and those with upper < lower; with nulls_fail all rows, a null being a violation."""
    read = (lambda c: F.try_to_timestamp(F.col(c).cast("string"), F.lit(form))) if form else F.col
    pairs = rows.select(*group_columns(groups), read(lower).alias("_lower"), read(upper).alias("_upper"))
    missing = F.col("_lower").isNull() | F.col("_upper").isNull()
    if not nulls_fail:
        pairs = pairs.where(~missing)
    return judged(pairs, groups, missing | (F.col("_upper") < F.col("_lower")))


def superseded_still_open(rows: DataFrame, group_key: Sequence[str], order: str, open_when: str, groups: Sequence[str] = (), form: str | None = None) -> DataFrame:
    """Open rows, and those of which a row of the same group_key, open or not, has a later order value.

    The latest value of each group is a grouped maximum joined back to the open rows only, null keys included, so
    closed rows never leave their map tasks.
    """
    value = F.try_to_timestamp(F.col(order).cast("string"), F.lit(form)) if form else F.col(order)
    keys = [F.col(c).alias(f"_k{n}") for n, c in enumerate(group_key)]
    latest = rows.select(*keys, value.alias("_v")).groupBy(*[f"_k{n}" for n in range(len(group_key))]).agg(F.max("_v").alias("_latest"))
    still = rows.where(_holds(open_when)).select(*group_columns(groups), *[F.col(c).alias(f"_o{n}") for n, c in enumerate(group_key)], value.alias("_v"))
    on = [F.col(f"_o{n}").eqNullSafe(F.col(f"_k{n}")) for n in range(len(group_key))]
    return judged(still.join(latest, on, "left"), groups, F.col("_v") < F.col("_latest"))


def superseded_by_window(rows: DataFrame, group_key: Sequence[str], order: str, open_when: str, groups: Sequence[str] = ()) -> DataFrame:
    """The same by one window over all rows: better only where nearly all rows are open."""
    over = Window.partitionBy(*group_key)
    seen = rows.select("*", F.max(order).over(over).alias("_latest")).where(_holds(open_when))
    return judged(seen.select(*group_columns(groups), F.col(order).alias("_v"), "_latest"), groups, F.col("_v") < F.col("_latest"))


def child_within_parent(children: DataFrame, parents: DataFrame, join: Sequence[tuple[str, str]], child_start: Column, parent_start: Column, parent_end: Column, groups: Sequence[str] = ()) -> DataFrame:
    """Child rows with a parent, and those whose start no parent's [start, end] holds; a null end is open.

    Parents' intervals that meet are merged first, in order of their starts, so a key's list holds disjoint stretches only; a
    child meets them in one row, and a key with many children can be split by the join.
    """
    keys = [f"_p{n}" for n in range(len(join))]
    kids = children.select(*group_columns(groups), child_start.alias("_s"), *[F.col(c).alias(f"_c{n}") for n, (c, _) in enumerate(join)])
    spans = parents.select(parent_start.alias("_a"), parent_end.alias("_b"), *[F.col(p).alias(k) for k, (_, p) in zip(keys, join)])
    before = Window.partitionBy(*keys).orderBy("_a").rowsBetween(Window.unboundedPreceding, -1)
    holds = F.col("_a").isNotNull() & (F.col("_b").isNull() | (F.col("_b") >= F.col("_a")))
    apart = ~F.coalesce(F.max(holds & F.col("_b").isNull()).over(before), F.lit(False)) & ~F.coalesce(F.max(F.when(holds, F.col("_b"))).over(before) >= F.col("_a"), F.lit(False))
    numbered = spans.withColumns({"_holds": holds, "_new": (holds & apart).cast("int")})
    numbered = numbered.withColumn("_n", F.sum("_new").over(Window.partitionBy(*keys).orderBy("_a").rowsBetween(Window.unboundedPreceding, 0)))
    stretch = F.struct(F.min(F.when(F.col("_holds"), F.col("_a"))).alias("a"), F.when(F.max(F.col("_holds") & F.col("_b").isNull()), F.lit(None)).otherwise(F.max(F.when(F.col("_holds"), F.col("_b")))).alias("b"))
    merged = numbered.groupBy(*keys, "_n").agg(stretch.alias("_span")).groupBy(*keys).agg(F.collect_list("_span").alias("_spans"))
    held = F.exists("_spans", lambda s: F.coalesce((F.col("_s") >= s["a"]) & (s["b"].isNull() | (F.col("_s") <= s["b"])), F.lit(False)))
    met = kids.join(merged, [F.col(f"_c{n}") == F.col(k) for n, k in enumerate(keys)])
    return judged(met, groups, ~held)


def value_format(rows: DataFrame, column: str, pattern: str, groups: Sequence[str] = ()) -> DataFrame:
    """Values that aren't null, and those in which the pattern is nowhere found; as stored, not normalised."""
    found = rows.where(F.col(column).isNotNull()).select(*group_columns(groups), F.col(column).cast("string").alias("_v"))
    return judged(found, groups, ~F.col("_v").rlike(pattern))


def null_rate_max(rows: DataFrame, column: str, most: float, groups: Sequence[str] = ()) -> DataFrame:
    """Rows, nulls, and one violation where their rate is above `most`."""
    counted = rows.select(*group_columns(groups), F.col(column).isNull().alias("_null")).groupBy(*names(groups)).agg(F.count(F.lit(1)).alias("population"), ones(F.col("_null")).alias("nulls"))
    return counted.withColumn("violations", F.when(F.col("nulls") / F.col("population") > F.lit(float(most)), 1).otherwise(0).cast("long"))
