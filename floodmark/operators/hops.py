"""Checks between two layers: is every upstream key here, at its latest version, with the same values, file by file?

Latest versions come from grouped maxima of (record time, load time) structs: one partial aggregate and one exchange a
side, with no window over the whole table. On an ordinary run both sides are first cut, by a semi join, to the keys that
could be judged or counted: those with an upstream load since the window's first deadline or a load here in the window, and
the open ones. Owned values are only gathered for keys judged CURRENT, and keys are only hashed where an event or a failure
is kept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodmark.functions.keys import base_name
from floodmark.functions.times import stamp, within
from floodmark.operators.common import ones, with_first

BAD = ("MISSING", "STALE", "UNASSESSABLE")
#: No load is later.
NEVER = datetime(9000, 1, 1)


@dataclass(frozen=True)
class Side:
    """Rows of a layer after its filter, its canonical key and its UTC times. `values` are its owned columns in order; `bounds`
    is the condition that a load lies in a span, as a scan can use it."""

    rows: DataFrame
    key: Column
    record: Column
    load: Column | None = None
    file: Column | None = None
    values: tuple[Column, ...] = ()
    bounds: Callable[[datetime, datetime], Column] | None = field(default=None, compare=False)

    def loaded(self) -> Column:
        return self.load if self.load is not None else F.lit(None).cast("timestamp")

    def keys_loaded(self, start: datetime, end: datetime) -> DataFrame:
        """_c, the keys of rows loaded in [start, end), with repeats."""
        return self.rows.where(self.bounds(start, end) if self.bounds else within(self.loaded(), start, end)).select(self.key.alias("_c"))

    def cut(self, keys: DataFrame | None) -> DataFrame:
        """The rows whose key is among keys (_c), or all."""
        return self.rows if keys is None else self.rows.join(keys, self.key == F.col("_c"), "left_semi")


@dataclass(frozen=True)
class Hop:
    """`excluded` keeps upstream rows out where it holds; `open_keys` has key_hash and key_value of keys now flagged, which are
    judged again; `hashed` turns a key into that hash. A flagged key whose hash isn't that of its value any more, as after a
    change of the secret, counts as gone."""

    up: Side
    dn: Side
    start: datetime
    end: datetime
    sla: timedelta
    full_sweep: bool = False
    excluded: Column | None = None
    open_keys: DataFrame | None = None
    hashed: object = field(default=None, compare=False)

    @property
    def due(self) -> tuple[datetime, datetime]:
        return self.start - self.sla, self.end - self.sla

    def expected(self) -> DataFrame:
        return self.up.rows if self.excluded is None else self.up.rows.where(~F.coalesce(self.excluded, F.lit(False)))

    def flagged(self) -> DataFrame | None:
        """_open (the key), _hash and _same (the hash is still the key's) of the open keys."""
        if self.open_keys is None:
            return None
        found = self.open_keys.select(F.col("key_value").alias("_open"), F.col("key_hash").alias("_hash")).distinct()
        return found.withColumn("_same", self.hashed(F.col("_open")) == F.col("_hash") if self.hashed is not None else F.lit(True))

    def candidates(self) -> DataFrame | None:
        """_c, the only keys that an ordinary run can judge or count; nothing on a full sweep, where all can be."""
        if self.full_sweep:
            return None
        found = self.up.keys_loaded(self.due[0], NEVER).union(self.dn.keys_loaded(self.start, self.end))
        if self.open_keys is not None:
            found = found.union(self.open_keys.select("key_value"))
        return found.distinct()


def _sets(rows: DataFrame, side: Side) -> DataFrame:
    """k and the set of distinct owned tuples at the key's latest version, all versions being one if none has a time."""
    one = F.to_json(F.struct(*[v.cast("string").alias(f"c{n}") for n, v in enumerate(side.values, 1)]))
    versions = rows.select(side.key.alias("k"), side.record.alias("r"), one.alias("v")).groupBy("k", "r").agg(F.array_sort(F.collect_set("v")).alias("v"))
    return versions.groupBy("k").agg(F.max(F.struct("r", "v"))["v"].alias("values"))


def _upstream_keys(hop: Hop, keys: DataFrame | None) -> DataFrame:
    """k, up_record_ts, up_load_ts, _out (every row is excluded) and _any_load (over all rows) of each upstream key."""
    version = F.struct(hop.up.record.alias("r"), hop.up.loaded().alias("l"))
    out = F.coalesce(hop.excluded, F.lit(False)) if hop.excluded is not None else F.lit(False)
    latest = F.max(version) if hop.excluded is None else F.max(F.when(~out, version))
    up = hop.up.cut(keys).groupBy(hop.up.key.alias("k")).agg(latest.alias("_top"), F.max(hop.up.loaded()).alias("_any_load"))
    return up.select("k", F.col("_top.r").alias("up_record_ts"), F.col("_top.l").alias("up_load_ts"), F.col("_top").isNull().alias("_out"), "_any_load")


def assess(hop: Hop, others: bool = True) -> DataFrame:
    """k, key_hash, key_state, up_record_ts, up_load_ts, dn_record_ts, dn_load_ts, was_open and in_window of the keys judged and,
    with `others`, of those not judged: PENDING, EXCLUDED, and on a full sweep GONE (open keys that are no longer upstream).
    key_hash is that of open keys alone; `with_hash` adds the others'.

    A key is judged when its deadline falls in the window, when it was loaded here in the window after its deadline, or
    when it is open (then alone, in_window is false); on a full sweep, when its deadline has passed or it is open. A key whose
    latest version's deadline is still to come is PENDING; one whose every row is excluded is EXCLUDED if the latest load of
    all its rows is in the range judged.
    """
    first, last = (stamp(t) for t in hop.due)
    yes = lambda c: F.coalesce(c, F.lit(False))
    load = F.col("up_load_ts")
    passed, coming = yes(load < last) & ~F.col("_out"), yes(load >= last) & ~F.col("_out")
    excluded = F.col("_out") & yes(F.col("_any_load") < last)
    if not hop.full_sweep:
        excluded = excluded & yes(F.col("_any_load") >= first)
    cut, flagged = hop.candidates(), hop.flagged()
    keys = _upstream_keys(hop, cut)
    if flagged is None:
        keys = keys.withColumns({"was_open": F.lit(False), "key_hash": F.lit(None).cast("string")})
    else:
        known = flagged.where("_same").select("_open", "_hash")
        keys = keys.join(known, F.col("k") == F.col("_open"), "left").withColumns({"was_open": F.col("_open").isNotNull() & ~F.col("_out"), "key_hash": F.col("_hash")}).drop("_open", "_hash")
    # what can neither be judged nor counted goes before the join
    up = keys.where(passed | F.col("was_open") | ((coming | excluded) if others else F.lit(False)))
    dn = hop.dn.cut(cut).select(hop.dn.key.alias("d"), hop.dn.record.alias("r"), hop.dn.loaded().alias("l"))
    dn = dn.groupBy("d").agg(F.max("r").alias("dn_record_ts"), F.max("l").alias("dn_load_ts"), F.max(within(F.col("l"), hop.start, hop.end)).alias("_loaded"))
    due = passed if hop.full_sweep else passed & (yes(load >= first) | yes(F.col("_loaded")))
    state = F.when(F.col("d").isNull(), "MISSING").when(F.col("up_record_ts").isNull() | F.col("dn_record_ts").isNull(), "UNASSESSABLE").when(F.col("dn_record_ts") < F.col("up_record_ts"), "STALE").otherwise("CURRENT")
    named = F.when(due | F.col("was_open"), state)
    if others:
        named = named.when(coming, "PENDING").when(excluded, "EXCLUDED")
    cells = ["k", "key_hash", "key_state", "up_record_ts", "up_load_ts", "dn_record_ts", "dn_load_ts", "was_open", "in_window"]
    out = up.join(dn, F.col("k") == F.col("d"), "left").withColumns({"key_state": named, "in_window": due}).where("key_state IS NOT NULL").select(*cells)
    if others and hop.full_sweep and flagged is not None and hop.hashed is not None:
        here = keys.where(~F.col("_out")).select(F.col("k").alias("_open"))
        gone = flagged.where("_same").join(here, "_open", "left_anti").select("_hash").union(flagged.where("NOT _same").select("_hash")).distinct()
        out = out.unionByName(gone.select(F.col("_hash").alias("key_hash"), F.lit("GONE").alias("key_state"), F.lit(True).alias("was_open")), allowMissingColumns=True)
    return out


def with_hash(rows: DataFrame, hashed: Callable[[Column], Column] | None) -> DataFrame:
    """rows of `assess` with the key_hash of each. Only what is kept should get here: hashing is the one step outside the JVM."""
    return rows if hashed is None else rows.withColumn("key_hash", F.coalesce("key_hash", hashed(F.col("k"))))


def judge(hop: Hop) -> DataFrame:
    """The keys judged, alone."""
    return assess(hop, others=False)


def currency(assessed: DataFrame) -> DataFrame:
    """One row: population, violations, and how many keys are in each state."""
    state = F.col("key_state")
    each = [ones(state == s).alias(s.lower()) for s in (*BAD, "PENDING", "EXCLUDED")]
    return assessed.agg(ones(state.isin(*BAD, "CURRENT")).alias("population"), ones(state.isin(*BAD)).alias("violations"), *each)


def key_events(assessed: DataFrame, hashed: Callable[[Column], Column] | None = None) -> DataFrame:
    """FLAGGED, STILL_FLAGGED or CLEARED for the keys whose flag is set, kept or lifted."""
    state = F.col("key_state")
    event = F.when(state.isin("CURRENT", "GONE"), "CLEARED").when(F.col("was_open"), "STILL_FLAGGED").otherwise("FLAGGED")
    detail = F.when(state == "GONE", "no longer upstream").otherwise(state)
    kept = with_hash(assessed.where(~state.isin("PENDING", "EXCLUDED") & ((state != "CURRENT") | F.col("was_open"))), hashed)
    return kept.select("key_hash", F.col("k").alias("key_value"), event.alias("event"), detail.alias("state_detail"))


def mismatches(hop: Hop, assessed: DataFrame | None = None) -> DataFrame:
    """The keys judged CURRENT in the window with mismatch (0 or 1): whether both sides hold the same set of owned tuples at their
    latest version. Ties count once; null and empty differ. `assessed` saves judging again."""
    current = (judge(hop) if assessed is None else assessed).where("key_state = 'CURRENT' AND in_window")
    asked = current.select(F.col("k").alias("_c"))
    expected = hop.up.cut(asked) if hop.excluded is None else hop.up.cut(asked).where(~F.coalesce(hop.excluded, F.lit(False)))
    up = _sets(expected, hop.up).withColumnRenamed("values", "_up")
    dn = _sets(hop.dn.cut(asked), hop.dn).withColumnRenamed("values", "_dn")
    return current.join(up, "k").join(dn, "k").withColumn("mismatch", F.when(F.col("_up") == F.col("_dn"), 0).otherwise(1)).drop("_up", "_dn")


def agreement(hop: Hop, mismatched: DataFrame | None = None) -> DataFrame:
    return (mismatches(hop) if mismatched is None else mismatched).agg(F.count(F.lit(1)).alias("population"), F.sum("mismatch").cast("long").alias("violations"))


def file_counts(hop: Hop) -> DataFrame:
    """f, up_rows, excluded_rows, first_load and dn_rows of each upstream file. The first load counts excluded rows too; a null
    name is a file of its own that nothing here matches."""
    out = F.coalesce(hop.excluded, F.lit(False)) if hop.excluded is not None else F.lit(False)
    up = hop.up.rows.groupBy(base_name(hop.up.file).alias("f")).agg(ones(~out).alias("up_rows"), ones(out).alias("excluded_rows"), F.min(hop.up.loaded()).alias("first_load"))
    dn = hop.dn.rows.groupBy(base_name(hop.dn.file).alias("_f")).agg(F.count(F.lit(1)).alias("dn_rows"))
    return up.join(dn, F.col("f") == F.col("_f"), "left").withColumn("dn_rows", F.coalesce("dn_rows", F.lit(0)).cast("long")).drop("_f")


def completeness(hop: Hop, limit: int = 100) -> DataFrame:
    """One row: files due with expected rows, those with fewer rows here, the first of them by name, the rows excluded from the
    files due, and the files still pending."""
    first, last = (stamp(t) for t in hop.due)
    due = F.col("first_load") < last if hop.full_sweep else (F.col("first_load") >= first) & (F.col("first_load") < last)
    due = F.coalesce(due, F.lit(False))
    asked = due & (F.col("up_rows") > 0)
    short = asked & (F.col("dn_rows") < F.col("up_rows"))
    counts = [
        ones(asked).alias("population"),
        ones(short).alias("violations"),
        F.sum(F.when(due, F.col("excluded_rows"))).alias("excluded"),
        F.coalesce(ones(F.col("first_load") >= last), F.lit(0)).cast("long").alias("pending"),
    ]
    return with_first(file_counts(hop), counts, short, F.struct("f", "up_rows", "dn_rows"), limit, "short")
