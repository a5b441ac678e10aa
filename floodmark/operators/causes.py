"""Evidence for causes: each a plan from the hop's or the registry's rows to facts about the failing items.

Failing keys come as a DataFrame of their hashes (at most a hundred for each evaluation), which joins decide on a side's size.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodmark.functions.keys import KeyPart, base_name, canonical, unusable
from floodmark.functions.times import stamp
from floodmark.operators.common import ones
from floodmark.operators.hops import Hop, with_hash
from floodmark.sources.relation import UNMATCHED

EXPLAINED = 100


def first_keys(rows: DataFrame, hashed=None, limit: int = EXPLAINED) -> DataFrame:
    """The first `limit` keys of an assessment's rows, by hash."""
    return with_hash(rows, hashed).select("key_hash", "k", "key_state", "up_record_ts", "up_load_ts", "dn_record_ts", "dn_load_ts").orderBy("key_hash", "k").limit(limit)


def failing_keys(assessed: DataFrame, hashed=None, limit: int = EXPLAINED) -> DataFrame:
    """MISSING and STALE keys by hash, the first `limit`; UNASSESSABLE ones are never explained."""
    return first_keys(assessed.where(F.col("key_state").isin("MISSING", "STALE")), hashed, limit)


def latest_load(rows: DataFrame, load: Column) -> DataFrame:
    return rows.agg(F.max(load).alias("max_load"))


def file_facts(hop: Hop, key: Sequence[KeyPart]) -> DataFrame:
    """f, first_load, up_rows, invalid_rows and rows_here of each upstream file; exclusions are left out of it."""
    bad = unusable(key[0])
    for part in key[1:]:
        bad = bad | unusable(part)
    up = hop.expected().groupBy(base_name(hop.up.file).alias("f")).agg(F.min(hop.up.loaded()).alias("first_load"), F.count(F.lit(1)).alias("up_rows"), ones(bad).alias("invalid_rows"))
    dn = hop.dn.rows.groupBy(base_name(hop.dn.file).alias("_f")).agg(F.count(F.lit(1)).alias("rows_here"))
    return up.join(dn, F.col("f") == F.col("_f"), "left").select("f", "first_load", "up_rows", "invalid_rows", F.coalesce("rows_here", F.lit(0)).cast("long").alias("rows_here"))


def skipped_files(facts: DataFrame) -> DataFrame:
    """f and later_files of each file without a row here that was loaded before a file with rows here.

    Files with rows are counted per load time, then per day; a day's times are ordered by themselves, and only the days, a row
    for each, in one task.
    """
    lost = facts.where("rows_here = 0 AND first_load IS NOT NULL").select("f", "first_load")
    counted = facts.where("first_load IS NOT NULL").groupBy("first_load").agg(ones(F.col("rows_here") > 0).alias("_here")).withColumn("_day", F.date_trunc("day", "first_load"))
    before = lambda over, column: F.coalesce(F.sum("_here").over(over.orderBy(F.desc(column)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = counted.groupBy("_day").agg(F.sum("_here").alias("_here"))
    days = days.select("_day", before(Window.partitionBy(), "_day").alias("_later_days"))
    after = counted.select("first_load", "_day", before(Window.partitionBy("_day"), "first_load").alias("_later")).join(days, "_day")
    return lost.join(after.select("first_load", (F.col("_later") + F.col("_later_days")).alias("later_files")), "first_load").where("later_files > 0").select("f", "later_files")


def key_mismatch(up_rows: DataFrame, up_key: Sequence[KeyPart], dn_rows: DataFrame, dn_key: Sequence[KeyPart], dropped: int, failing: DataFrame) -> DataFrame:
    """Of the failing keys (k), those that match a key here once the part number `dropped` is left out on both sides."""
    short = lambda parts: canonical([p for n, p in enumerate(parts) if n != dropped])
    asked = up_rows.select(canonical(list(up_key)).alias("k"), short(up_key).alias("_s")).join(failing.select("k").distinct(), "k", "left_semi").distinct()
    return asked.join(dn_rows.select(short(dn_key).alias("_s")).distinct(), "_s", "left_semi").select("k").distinct()


def unmatched_joins(derived: DataFrame, key: Column, failing: DataFrame) -> DataFrame:
    """k and the joined sources without a match, for failing keys of a derived upstream."""
    return derived.where(F.size(UNMATCHED) > 0).select(key.alias("k"), F.col(UNMATCHED).alias("unmatched")).join(failing.select("k").distinct(), "k", "left_semi")


def ties(hop: Hop, winner: Sequence[Column], failing: DataFrame) -> DataFrame:
    """k, tied, variants and winner_here of failing keys with several upstream rows at their latest record time: how many, with
    how many owned tuples, and whether the row that `winner` orders first is the one kept here. Keys are cut to the failing
    ones before any window."""
    asked = failing.select("k").distinct()
    names = [f"v{n}" for n in range(len(hop.up.values))]
    up = hop.expected().withColumns({"k": hop.up.key, "_r": hop.up.record} | {n: v.cast("string") for n, v in zip(names, hop.up.values)}).join(asked, "k", "left_semi")
    over = Window.partitionBy("k")
    top = up.withColumn("_top", F.max("_r").over(over)).where("_r = _top")
    ranked = top.withColumns({"_rank": F.row_number().over(over.orderBy(*winner)), "_tied": F.count(F.lit(1)).over(over)}).where("_tied > 1")
    one = F.concat_ws("|", *[F.coalesce(F.col(n), F.lit("<null>")) for n in names])
    dn = hop.dn.rows.select(hop.dn.key.alias("k"), hop.dn.record.alias("_r"), F.struct(*[v.cast("string").alias(n) for n, v in zip(names, hop.dn.values)]).alias("_v")).join(asked, "k", "left_semi")
    dn = dn.groupBy("k", "_r").agg(F.collect_set("_v").alias("_v")).groupBy("k").agg(F.max_by("_v", F.coalesce("_r", F.lit(0).cast("timestamp"))).alias("_kept"))
    first = F.max(F.when(F.col("_rank") == 1, F.struct(*names)))
    per_key = ranked.groupBy("k").agg(F.max("_tied").alias("tied"), F.countDistinct(one).alias("variants"), first.alias("_first"))
    return per_key.join(dn, "k", "left").select("k", "tied", "variants", F.coalesce(F.exists("_kept", lambda v: v.eqNullSafe(F.col("_first"))), F.lit(False)).cast("int").alias("winner_here"))


def older_written_later(assessed: DataFrame, granularity: str | None, zone: str) -> DataFrame:
    """STALE keys whose row here was loaded after the newer upstream version, at this layer's load granularity."""
    from floodmark.functions.times import truncated

    cut = (lambda c: truncated(F.col(c), granularity, zone)) if granularity else F.col
    return assessed.where((F.col("key_state") == "STALE") & (cut("dn_load_ts") > cut("up_load_ts"))).select("k")


def table_refs(rows: DataFrame, condition: str, ref: Column) -> DataFrame:
    """The distinct references (file base names or key hashes) among rows that meet the condition."""
    return rows.where(F.expr(condition)).select(ref.alias("ref")).distinct()


def rows_loaded(rows: DataFrame, load: Column, start: datetime, end: datetime) -> DataFrame:
    return rows.where((load >= stamp(start)) & (load < stamp(end))).agg(F.count(F.lit(1)).alias("loaded"))


def landed(registry: DataFrame, raw: DataFrame | None = None, file_column: str | None = None) -> DataFrame:
    """path, first_seen_at, sizes (distinct sizes it was seen with) and raw_rows of each landed file."""
    files = registry.groupBy("path").agg(F.min("first_seen_at").alias("first_seen_at"), F.countDistinct("size_bytes").alias("sizes"))
    if raw is None:
        return files.withColumn("raw_rows", F.lit(None).cast("long"))
    loaded = raw.groupBy(base_name(file_column).alias("_f")).agg(F.count(F.lit(1)).alias("_n"))
    return files.join(loaded, base_name("path") == F.col("_f"), "left").select("path", "first_seen_at", "sizes", F.coalesce("_n", F.lit(0)).cast("long").alias("raw_rows"))


def later_files(files: DataFrame, since: Sequence[datetime]) -> DataFrame:
    """since, later_files and loaded for each of a few times: files first seen then or later, and how many of them were loaded.
    A file names the times that it follows, so only counts are exchanged."""
    times = F.array(*[F.struct(F.lit(n).alias("n"), stamp(t).alias("since")) for n, t in enumerate(since)])
    named = files.select("raw_rows", F.explode(F.filter(times, lambda t: F.col("first_seen_at") >= t["since"])).alias("_t"))
    return named.groupBy(F.col("_t.n").alias("n"), F.col("_t.since").alias("since")).agg(F.count(F.lit(1)).alias("later_files"), F.coalesce(ones(F.col("raw_rows") > 0), F.lit(0)).cast("long").alias("loaded"))


def stalled(files: DataFrame, failing_path: str) -> DataFrame:
    """One row: other files first seen at or after the failing one, and how many of them were loaded."""
    at = files.where(F.col("path") == failing_path).select(F.col("first_seen_at").alias("_at"))
    later = files.where(F.col("path") != failing_path).join(F.broadcast(at), F.col("first_seen_at") >= F.col("_at"))  # one row
    return later.agg(F.count(F.lit(1)).alias("later_files"), F.coalesce(ones(F.col("raw_rows") > 0), F.lit(0)).cast("long").alias("loaded"))
