"""The rules that queries over the large tables don't reach, on small frames."""

from __future__ import annotations

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from floodmark.functions.keys import KeyPart, canonical, keyed_hash
from floodmark.functions.times import TimeColumn, loaded_within, truncate, utc
from floodmark.operators import causes, hops, rules, tier1
from floodmark.operators.common import with_first
from floodmark.plans import schedule
from floodmark.plans.cadence import Cadence, previous_slot, slot_label, slots
from floodmark.plans.explain import Failure, Outcome, confirmed, explain, not_ready, ruled_out, settle
from floodmark.plans.identity import Event, History, evaluation_id, next_window, release, replay
from floodmark.plans.outcome import DID_NOT_RUN, FAILED, PASSED, counted, from_error, from_rows, run_check
from floodmark.config.patterns import FAILURES, failure_type

AT = datetime(2024, 3, 1, tzinfo=UTC)


def at(hours):
    return AT + timedelta(hours=hours)


def naive(hours):
    return at(hours).replace(tzinfo=None)


# -- times and cadences

def test_unparseable_times_are_null(spark):
    df = spark.createDataFrame([("03/09/2024 02:30",), ("soon",), (None,)], "t string")
    got = [r.u for r in df.select(utc(TimeColumn("t", "MM/dd/yyyy HH:mm", timezone="America/Chicago")).alias("u")).collect()]
    assert got == [datetime(2024, 3, 9, 8, 30), None, None]


def test_bounds_reach_the_scan(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    df = events.where(loaded_within(TimeColumn("ts"), at(0), at(1))).select("event_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan and "props" not in plan


def test_truncation_counts_in_the_own_zone():
    assert truncate(datetime(2024, 3, 10, 3, tzinfo=UTC), "day", "America/Chicago") == datetime(2024, 3, 9, 6, tzinfo=UTC)
    with pytest.raises(ValueError):
        truncate(AT, "week", "UTC")


def test_slots_over_a_clock_change():
    c = Cadence("times", "America/Chicago", ["00:30", "02:30"])
    got = slots(c, datetime(2024, 3, 10, tzinfo=UTC), datetime(2024, 3, 11, 12, tzinfo=UTC))
    assert got == [datetime(2024, 3, 10, 6, 30, tzinfo=UTC), datetime(2024, 3, 10, 8, 30, tzinfo=UTC), datetime(2024, 3, 11, 5, 30, tzinfo=UTC), datetime(2024, 3, 11, 7, 30, tzinfo=UTC)]
    assert slot_label(c, got[2]) == "00:30"


def test_monthly_and_weekday_slots():
    assert [s.day for s in slots(Cadence("monthly", days_of_month=[31]), datetime(2024, 1, 1), datetime(2024, 6, 1))] == [31, 31, 31]
    assert previous_slot(Cadence("monthly", days_of_month=[31]), datetime(2024, 3, 1)) == datetime(2024, 1, 31, tzinfo=UTC)
    assert len(slots(Cadence("interval", interval_minutes=720, calendar="WEEKDAYS"), datetime(2024, 3, 1), datetime(2024, 3, 5))) == 4
    assert slots(Cadence("times"), AT, AT) == []
    with pytest.raises(ValueError):
        slots(Cadence("times", calendar="BANK"), AT, at(24))


# -- keys

def test_keys_normalise_and_hash(spark):
    df = spark.createDataFrame([("007", "03/01/2024"), (None, "nonsense")], "a string, d string")
    k = canonical([KeyPart("a", strip_leading_zeros=True), KeyPart("d", parse_date="MM/dd/yyyy")])
    keys = [r.k for r in df.select(k.alias("k")).collect()]
    assert keys == ["7|2024-03-01", "<null>|<null>"]
    hashed = df.select(keyed_hash(b"s")(k).alias("h"))
    assert all(len(r.h) == 64 for r in hashed.collect()) and "'s'" not in hashed._jdf.queryExecution().toString()


# -- tier 1

def test_a_load_at_the_deadline_is_late(spark):
    rows = spark.createDataFrame([(naive(8),)], "t timestamp_ntz")
    r = tier1.due_loads(rows, TimeColumn("t"), [at(0)], timedelta(hours=8)).first()
    assert (r.population, r.violations, r.short_slots) == (1, 1, [naive(0)])
    assert tier1.due_loads(rows, TimeColumn("t"), [at(1)], timedelta(hours=8)).first().violations == 0


def test_slots_of_no_rows(spark):
    none = spark.createDataFrame([], "t timestamp_ntz")
    r = tier1.due_loads(none, TimeColumn("t"), [at(0), at(4)], timedelta(hours=8)).first()
    assert (r.population, r.violations) == (2, 2)


def test_group_columns_may_be_keys_and_null(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), (None, 2)], "k string, v int")
    got = {r.g_1: (r.population, r.violations) for r in tier1.key_duplicates(df, [KeyPart("k"), KeyPart("v")], ["k"]).collect()}
    assert got == {"a": (1, 1), None: (1, 0)}


def test_schema_drift(spark):
    schema = spark.createDataFrame([], "b int, A string").schema
    assert tier1.schema_drift(schema, None).changed is None
    assert tier1.schema_drift(schema, {"b": "int", "a": "string"}).violations == 0
    assert tier1.schema_drift(schema, {"a": "string", "b": "int"}).violations == 1  # another order
    d = tier1.schema_drift(schema, {"b": "bigint", "c": "int"})
    assert (d.added, d.removed, d.retyped) == (["a"], ["c"], ["b"])


def test_volume_needs_history(spark):
    rows = spark.createDataFrame([(naive(1),)] * 10, "t timestamp_ntz")
    p = [tier1.Period("00:00", "x", at(0), at(4))]
    short = spark.createDataFrame([("00:00", 10)] * 6, "label string, row_count long")
    assert tier1.volume(rows, TimeColumn("t"), p, short, 0.5).first().outside is None
    full = spark.createDataFrame([("00:00", 100)] * 7, "label string, row_count long")
    r = tier1.volume(rows, TimeColumn("t"), p, full, 0.5).first()
    assert (r.outside, r.low, r.high) == (1, 50.0, 150.0)


# -- rules

def test_superseded_counts_null_groups_and_closed_rows(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, False), (None, 1, True), (None, 3, True), ("b", None, True)], "g string, o int, open boolean")
    for f in (rules.superseded_still_open, rules.superseded_by_window):
        r = f(df, ["g"], "o", "open").first()
        assert (r.population, r.violations) == (4, 2), f.__name__


def test_child_within_parent_edges(spark):
    kids = spark.createDataFrame([("p", 5), ("p", 25), ("p", None), ("q", 1), (None, 1)], "k string, s int")
    parents = spark.createDataFrame([("p", 0, 10), ("p", 20, None), (None, 0, None)], "k string, a int, b int")
    r = rules.child_within_parent(kids, parents, [("k", "k")], F.col("s"), F.col("a"), F.col("b")).first()
    assert (r.population, r.violations) == (3, 1)  # the null start; q and null have no parent


def test_merged_parents_hold_what_each_held(spark):
    rng = random.Random(4)
    parents = [(rng.randrange(6), a, None if rng.random() < 0.05 else a + rng.randrange(-2, 6)) for a in (rng.randrange(60) for _ in range(60))] + [(0, None, 5), (0, None, None)]
    kids = [(rng.randrange(8), rng.choice([None, *range(-2, 70)])) for _ in range(500)]
    of = {k: [(a, b) for p, a, b in parents if p == k] for k in range(8)}
    met = [(k, s) for k, s in kids if of[k]]
    bad = [s for k, s in met if not any(s is not None and a is not None and a <= s and (b is None or s <= b) for a, b in of[k])]
    r = rules.child_within_parent(spark.createDataFrame(kids, "k int, s int"), spark.createDataFrame(parents, "k int, a int, b int"), [("k", "k")], F.col("s"), F.col("a"), F.col("b")).first()
    assert (r.population, r.violations) == (len(met), len(bad)) and 0 < len(bad) < len(met)


def test_null_rate_is_strict(spark):
    df = spark.createDataFrame([(None,), (1,)], "v int")
    assert rules.null_rate_max(df, "v", 0.5).first().violations == 0
    assert rules.null_rate_max(df, "v", 0.49).first().violations == 1


# -- hops

def hop(spark, up, dn, **more):
    cols = "k string, r timestamp_ntz, l timestamp_ntz, v string, f string"
    side = lambda rows: hops.Side(spark.createDataFrame(rows, cols), F.col("k"), utc(TimeColumn("r")), utc(TimeColumn("l")), F.col("f"), (F.col("v"),))
    return hops.Hop(side(up), side(dn), **{"start": at(0), "end": at(24), "sla": timedelta(hours=8)} | more)


def states(h):
    return {r.k: r.key_state for r in hops.assess(h).collect()}


def test_states(spark):
    row = lambda k, r=0, load=0, v="x": (k, None if r is None else naive(r), naive(load), v, "d/f1")
    up = [row("missing"), row("stale", 2), row("same", 2), row("unknown", None), row("late", 0, 17), row("old", 0, -9)]
    dn = [row("stale", 1), row("same", 2), row("unknown", 1)]
    assert states(hop(spark, up, dn)) == {"missing": "MISSING", "stale": "STALE", "same": "CURRENT", "unknown": "UNASSESSABLE", "late": "PENDING"}
    assert "old" in states(hop(spark, up, dn, full_sweep=True))


def test_latest_version_decides_the_load(spark):
    """The load time is that of the rows at the latest record time, not of any row."""
    up = [("k", naive(1), naive(20), "", "f"), ("k", naive(2), naive(0), "", "f")]
    assert states(hop(spark, up, [])) == {"k": "MISSING"}


def test_reloaded_keys_are_judged_again(spark):
    up = [("k", naive(-30), naive(-30), "", "f")]
    assert states(hop(spark, up, [])) == {}
    assert states(hop(spark, up, [("k", naive(-40), naive(1), "", "f")])) == {"k": "STALE"}


def test_exclusions_and_events(spark):
    up = [("a", naive(0), naive(0), "skip", "f"), ("b", naive(0), naive(0), None, "f"), ("c", naive(0), naive(0), "", "f")]
    flagged = spark.createDataFrame([("hc", "c"), ("hgone", "gone"), ("old", "b")], "key_hash string, key_value string")
    h = hop(spark, up, [("c", naive(0), naive(0), "", "f")], excluded=F.expr("v = 'skip'"), open_keys=flagged, hashed=lambda k: F.concat(F.lit("h"), k), full_sweep=True)
    assert {(r.k, r.key_state) for r in hops.assess(h).collect()} == {("a", "EXCLUDED"), ("b", "MISSING"), ("c", "CURRENT"), (None, "GONE")}
    got = {(r.key_hash, r.event, r.state_detail) for r in hops.key_events(hops.assess(h), h.hashed).collect()}
    # the hash "old" isn't that of its value any more, as after a change of the secret
    assert got == {("hb", "FLAGGED", "MISSING"), ("hc", "CLEARED", "CURRENT"), ("hgone", "CLEARED", "no longer upstream"), ("old", "CLEARED", "no longer upstream")}


def test_open_keys_are_judged_outside_the_window(spark):
    old = [("o", naive(-30), naive(-30), "x", "f"), ("p", naive(-30), naive(-30), "x", "f")]
    flagged = spark.createDataFrame([("ho", "o")], "key_hash string, key_value string")
    h = hop(spark, old, old, open_keys=flagged, hashed=lambda k: F.concat(F.lit("h"), k))
    r = hops.assess(h).collect()
    assert [(x.k, x.key_state, x.was_open, x.in_window, x.key_hash) for x in r] == [("o", "CURRENT", True, False, "ho")]
    assert hops.mismatches(h).count() == 0  # agreement is judged for the window's keys


def test_only_candidates_are_grouped_and_only_events_hashed(spark):
    """On an ordinary run both sides meet a semi join before they are grouped; no Python runs before the events."""
    row = [("k", naive(1), naive(1), "x", "f")]
    h = hop(spark, row, row, hashed=keyed_hash(b"s"))
    plan = hops.currency(hops.assess(h))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2 and "ArrowEvalPython" not in plan
    assert "LeftSemi" not in hops.assess(hop(spark, row, row, full_sweep=True))._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in hops.key_events(hops.assess(h), h.hashed)._jdf.queryExecution().optimizedPlan().toString()


def test_first_values_are_bounded(spark):
    rows = spark.range(1000).withColumn("bad", F.col("id") % 2 == 0)
    r = with_first(rows, [F.count(F.lit(1)).alias("n")], F.col("bad"), F.col("id"), 3, "first")
    assert tuple(r.first()) == (1000, [0, 2, 4]) and "TakeOrderedAndProject" in r._jdf.queryExecution().executedPlan().toString()
    assert tuple(with_first(rows.limit(0), [F.count(F.lit(1)).alias("n")], F.col("bad"), F.col("id"), 3, "first").first()) == (0, [])


def test_files_after_a_time(spark):
    files = spark.createDataFrame([("a", naive(0), 0), ("b", naive(1), 5), ("c", naive(50), 0)], "path string, first_seen_at timestamp, raw_rows long")
    got = {(r.n, r.later_files, r.loaded) for r in causes.later_files(files, [at(0), at(1), at(60)]).collect()}
    assert got == {(0, 3, 1), (1, 2, 1)}
    facts = spark.createDataFrame([("a", naive(0), 0), ("b", naive(1), 5), ("c", naive(50), 0), ("d", naive(50), 2), ("e", naive(75), 1), ("n", None, 0)], "f string, first_load timestamp, rows_here long")
    assert {(r.f, r.later_files) for r in causes.skipped_files(facts).collect()} == {("a", 3), ("c", 1)}


def test_agreement_is_set_equality(spark):
    tie = lambda k, *vs: [(k, naive(0), naive(0), v, "f") for v in vs]
    up = tie("a", "x", "y", "y") + tie("b", None) + tie("c", "x")
    dn = tie("a", "y", "x") + tie("b", "") + tie("c", "x", "z")
    assert {r.k: r.mismatch for r in hops.mismatches(hop(spark, up, dn)).collect()} == {"a": 0, "b": 1, "c": 1}


def test_files(spark):
    r = lambda f, load=0, v="": ("k", naive(0), naive(load), v, f)
    up = [r("x/a"), r("x/a"), r("x/b", v="skip"), r(None), r("x/c", 20), r("x/")]
    dn = [r("y/a"), r("z/")]
    got = hops.completeness(hop(spark, up, dn, excluded=F.expr("v = 'skip'"))).first()
    assert (got.population, got.violations, got.excluded, got.pending) == (3, 2, 1, 1)
    assert [s.f for s in got.short] == [None, "a"]


# -- windows, results and causes

def test_windows_hold_and_are_released():
    h = History(None, at(-40), at(-30), at(-10))
    assert release(h, "d", at(0), timedelta(hours=72)) == (at(-40), None)
    assert release(h, "d", at(60), timedelta(hours=72)) == (at(-10), Event("d", at(-40), at(-10)))
    assert release(History(at(-5)), "d", at(0), timedelta(hours=1)) == (at(-5), None)


def test_next_window_truncates_and_never_goes_back():
    e = next_window("d", at(1) + timedelta(seconds=30), None, timedelta(minutes=15), timedelta(hours=24), TimeColumn("t", granularity="hour"), "UTC")
    assert (e.start, e.end) == (at(-24), at(0))
    e = next_window("d", at(1), at(5), timedelta(), timedelta(hours=1), None, "UTC")
    assert e.start == e.end


def test_replay_fills_gaps():
    got = replay("d", at(0), at(10), [(at(2), at(4)), (at(2), at(5)), (at(7), at(8))], None, "UTC")
    assert [(e.start, e.end) for e in got] == [(at(0), at(2)), (at(2), at(5)), (at(5), at(7)), (at(7), at(8)), (at(8), at(10))]


def test_ids_are_stable():
    e = Event("d", at(0), at(1))
    assert e.event_id == Event("d", naive(0), naive(1)).event_id
    assert evaluation_id("e", "c", 1, "1", {"b": None, "a": "x"}) == evaluation_id("e", "c", 1, "1", {"a": "x", "b": ""})


def test_nothing_to_judge_never_passes(spark):
    assert counted(0, 0, "", "").state == DID_NOT_RUN and counted(None, None, "", "").reason == "empty_population"
    assert counted(3, 0, "", "").state == PASSED and counted(3, 1, "", "").state == FAILED
    assert from_rows([], ["g"], lambda r: ("", ""))[0].reason == "empty_population"


def test_errors_become_reasons(spark):
    def reason(f):
        return run_check(spark, f, 1)[0][0].reason

    assert reason(lambda: spark.table("nowhere").collect()) == "table_missing"
    assert reason(lambda: spark.range(1).select("nope").collect()) == "column_missing"
    assert reason(lambda: spark.sql("SELECT CAST('x' AS INT)").collect()) == "incompatible_type"
    assert reason(lambda: 1 / 0) == "query_failed"
    assert run_check(spark, list, 0)[0][0].reason == "budget_exceeded"
    assert run_check(spark, list, 1, scan_bytes=10**9, mb_per_minute=1)[0][0].reason == "budget_exceeded"
    assert "secret" not in (from_error(ValueError("secret")).detail or "")


def test_budget_interrupts(spark):
    import time

    results, _ = run_check(spark, lambda: time.sleep(5), 0.005)
    assert results[0].reason == "budget_exceeded"


def test_rules_are_due_once():
    assert schedule.rule_due("every_run", AT, AT, "06:00", "SUNDAY", "UTC")
    assert schedule.rule_due("daily", at(31), at(8), "06:00", "SUNDAY", "UTC")
    assert not schedule.rule_due("daily", at(29), at(8), "06:00", "SUNDAY", "UTC")
    assert schedule.due_since("weekly", datetime(2024, 3, 3, 5, tzinfo=UTC), "06:00", "SUNDAY", "UTC") == datetime(2024, 2, 25, 6, tzinfo=UTC)


def test_only_the_first_window_of_the_day_sweeps():
    sunday = datetime(2024, 3, 3, tzinfo=UTC)
    assert schedule.full_sweep(sunday - timedelta(hours=1), sunday + timedelta(hours=1), "SUNDAY", "UTC")
    assert not schedule.full_sweep(sunday + timedelta(hours=1), sunday + timedelta(hours=2), "SUNDAY", "UTC")


def test_causes_in_order():
    kind = FAILURES["load_wrote_nothing"]
    both = explain(kind, [Failure("s")], lambda c, f: confirmed())[0]
    assert (both.cause, both.level) == ("WRONG_PARTITION", "confirmed")
    none = explain(kind, [Failure("s")], lambda c, f: ruled_out())[0]
    assert (none.cause, none.level) == ("EMPTY_LOAD", "suspected")
    assert explain(kind, [Failure("s")], lambda c, f: not_ready(""))[0].level == "insufficient evidence"
    assert explain(kind, [Failure("s")], lambda c, f: 1 / 0)[0].outcomes[0][2] == Outcome("ERROR", {"error": "ZeroDivisionError"})
    assert settle([ruled_out(), not_ready("")]).state == "NOT_READY" and settle([not_ready(""), confirmed()]).state == "CONFIRMED"
    assert failure_type("T1_ON_TIME", "TABLE_MERGE") is None and failure_type("T1_KEY_NULLS", "FILE_CYCLIC") is None
