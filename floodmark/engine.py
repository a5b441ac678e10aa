"""A run: which checks, over which windows, their results, causes and key events into the store, and the digest."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime, timedelta
from functools import cached_property
from pathlib import Path
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from floodmark.config.loader import Config
from floodmark.config.models import PARAMS, PROBES, Dataset, Feed, Rule, ready
from floodmark.config.patterns import CHECKS, FAILURES, Cause, failure_type
from floodmark.functions.keys import base_name, canonical, keyed_hash
from floodmark.functions.times import as_utc, loaded_within, stamp, truncate, utc, within
from floodmark.operators import causes, hops, rules, tier1
from floodmark.plans import outcome as oc
from floodmark.plans import schedule
from floodmark.plans.cadence import previous_slot, slot_label, slots
from floodmark.plans.explain import Failure, Outcome, confirmed, explain, not_ready, ruled_out, settle
from floodmark.plans.identity import GAP, Event, History, evaluation_id, fixed, next_window, release, replay
from floodmark.plans.outcome import Result, counted, did_not_run, from_rows
from floodmark.sources import landing
from floodmark.sources.relation import UNMATCHED, Lookup, Source, derive
from floodmark.sources.relation import Derived as DerivedPlan
from floodmark.store import tables, views

VERSION = "1"
#: Days of results that are looked at first; a rule that hasn't run within them is due whatever its frequency.
RECENT_DAYS = 35
OUTCOME = ("state", "reason_category", "reason_code", "population", "violations", "observed", "expected", "severity", "detail")


@dataclass
class Job:
    dataset: Dataset
    feed: Feed | None
    check_id: str
    event: Event
    rule: Rule | None = None
    sweep: bool = False


@dataclass
class Engine:
    spark: SparkSession
    config: Config
    run_start: datetime
    execution: str = "NORMAL"
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    rows: list[dict] = field(default_factory=list)
    cause_rows: list[dict] = field(default_factory=list)
    short_slots: dict[str, tuple[str, ...]] = field(default_factory=dict)
    assessed: dict[tuple, DataFrame] = field(default_factory=dict)

    # -- names and relations

    @property
    def database(self) -> str:
        return self.config.defaults.dq_database

    @property
    def zone(self) -> str:
        return self.config.defaults.timezone

    @cached_property
    def secret(self) -> bytes | None:
        path = self.config.defaults.hmac_secret_file
        return Path(path).read_bytes().strip() if path else None

    def stored(self, table: str) -> DataFrame:
        return self.spark.table(f"{self.database}.{table}")

    def relation(self, name: str) -> DataFrame:
        """A dataset's rows after its filter, or its derived relation."""
        ds = self.config.datasets[name]
        if ds.derived is None:
            rows = self.spark.table(ds.table)
            return rows.where(F.expr(ds.feed_filter)) if ds.feed_filter else rows
        d = ds.derived
        source = lambda n: Source(n, self.relation(n))
        base = self.config.datasets[d.base]
        looks = [Lookup(source(j.dataset), [(f"{d.base}.{a}", f"{j.dataset}.{b}") for a, b in j.match.items()], j.type) for j in d.joins]
        time = lambda t: t.plan() if t else None
        return derive(DerivedPlan(source(d.base), looks, d.where, d.group_by, d.columns, time(base.record_time), time(base.load_time), self.zone))

    def time(self, column) -> Column | None:
        return utc(column.plan(), self.zone) if column else None

    def hop(self, ds: Dataset, up_name: str, event: Event, sweep: bool) -> hops.Hop:
        up, mapping = self.config.datasets[up_name], ds.key_map[up_name]
        sla = timedelta(hours=self.config.settings(ds.dataset)["sla_hours"])
        ups = tuple(F.col(u) for u in ds.owned_columns) if ds.owned_columns else ()
        dns = tuple(F.col(d) for d in ds.owned_columns.values())
        name = lambda x: F.col(x.file_name_column) if x.file_name_column else None
        bounds = lambda x: (lambda a, b: loaded_within(x.load_time.plan(), as_utc(a), as_utc(b), self.zone)) if x.load_time and x.derived is None else None
        hashed = keyed_hash(self.secret) if self.secret else None
        flagged = None
        if hashed is not None and self.execution == "NORMAL" and self.spark.catalog.tableExists(f"{self.database}.dq_key_event"):
            events = self.stored("dq_key_event").where((F.col("dataset") == ds.dataset) & (F.col("check_id") == "HOP_KEY_CURRENCY") & (F.col("hop") == f"{up_name}->{ds.dataset}"))
            values = events.where("key_value IS NOT NULL").groupBy("key_hash").agg(F.max("key_value").alias("key_value"))
            flagged = views.open_keys(events).select("key_hash").join(values, "key_hash")
        return hops.Hop(
            hops.Side(self.relation(up_name), canonical([up.part(mapping[c]) for c in ds.key]), self.time(up.record_time), self.time(up.load_time), name(up), ups, bounds(up)),
            hops.Side(self.relation(ds.dataset), canonical([ds.part(c) for c in ds.key]), self.time(ds.record_time), self.time(ds.load_time), name(ds), dns, bounds(ds)),
            event.start, event.end, sla, sweep, F.expr(ds.hop_exclusions[up_name]) if up_name in ds.hop_exclusions else None, flagged, hashed,
        )

    # -- checks

    def require(self, name: str, columns: Iterable[str | None] = ()) -> None:
        """Raises what a dataset lacks of what a check reads: the catalog's answer, its table, or configured columns."""
        ds = self.config.datasets[name]
        if ds.derived is not None:
            for source in ds.derived.sources:
                self.require(source)
            return
        try:
            there = {c.lower() for c in self.spark.table(ds.table).columns} if self.spark.catalog.tableExists(ds.table) else None
        except Exception as e:  # noqa: BLE001  whatever a catalog raises
            raise oc.Unmet("metastore_unavailable", oc.kind_of(e)) from None
        if there is None:
            raise oc.Unmet("table_missing", f"table {ds.table}")
        if lost := sorted({c for c in columns if c and c.lower() not in there}):
            raise oc.Unmet("column_missing", f"{ds.table} has no {', '.join(lost)}")

    def _reads(self, job: Job) -> list[str | None]:
        """The configured columns that a job reads of its own dataset."""
        ds = job.dataset
        record, load = (t.column if t else None for t in (ds.record_time, ds.load_time))
        if job.rule is not None:
            p, columns = job.rule.params, [*job.rule.group_by]
            columns += [p.get(c) for c in ("column", "lower", "upper", "order_column", "child_start")]
            columns += [*(p.get("group_key") or ()), *(p.get("join") or ())]
            return columns + (ds.key if job.rule.template in ("max_rows_per_key", "max_open_rows_per_key") else [])
        return {
            "T1_ON_TIME": [load],
            "T1_ZERO_ROWS": [load],
            "T1_VOLUME": [load],
            "T1_FILES_NOT_LOADED": [ds.file_name_column],
            "T1_KEY_NULLS": [load, *ds.key, *ds.group_by],
            "T1_KEY_DUPLICATES": [*ds.key, *ds.group_by],
            "HOP_KEY_CURRENCY": [record, load, *ds.key],
            "HOP_VALUE_AGREEMENT": [record, load, *ds.key, *ds.owned_columns.values()],
            "HOP_FILE_COMPLETENESS": [ds.file_name_column],
        }.get(job.check_id, [])

    def evaluate(self, job: Job) -> list[Result] | None:
        """The job's results; none where the check isn't for its dataset."""
        ds = job.dataset
        self.require(ds.dataset, self._reads(job))
        if job.rule is not None:
            return self._rule(job.rule, ds)
        needs = {"T1_ON_TIME", "T1_ZERO_ROWS", "T1_VOLUME", "T1_KEY_NULLS"}
        if job.check_id in needs and ds.load_time is None:
            raise oc.Unmet("invalid_config", "load_time isn't set")
        return getattr(self, "_" + job.check_id.lower())(job) or None

    def _slots_due(self, job: Job) -> list[datetime]:
        sla = timedelta(hours=self.config.settings(job.dataset.dataset)["sla_hours"])
        return slots(job.feed.cadence.plan(), job.event.start - sla, job.event.end - sla)

    def _loads(self, job: Job, least: int) -> list[Result]:
        due = self._slots_due(job)
        if not due:
            return [did_not_run("empty_population", "no slot is due in the window")]
        sla = timedelta(hours=self.config.settings(job.dataset.dataset)["sla_hours"])
        r = tier1.due_loads(self.relation(job.dataset.dataset), job.dataset.load_time.plan(), due, sla, least, self.zone).first()
        return [counted(r.population, r.violations, f"{r.population - r.violations} of {r.population} loads", f"at least {least} rows by each deadline", evidence=[as_utc(s) for s in r.short_slots])]

    def _t1_on_time(self, job: Job) -> list[Result]:
        return self._loads(job, 1)

    def _t1_zero_rows(self, job: Job) -> list[Result]:
        return self._loads(job, self.config.settings(job.dataset.dataset)["min_rows_per_load"])

    def _t1_volume(self, job: Job) -> list[Result]:
        plan, event, periods = job.feed.cadence.plan(), job.event, []
        upto = slots(plan, event.start, event.end + timedelta(microseconds=1))
        for end in (s for s in upto if as_utc(event.start) < s):
            if start := previous_slot(plan, end):
                periods.append(tier1.Period(slot_label(plan, start), start.isoformat(), start, end))
        if not periods:
            return [did_not_run("empty_population", "no period ends in the window")]
        settings = self.config.settings(job.dataset.dataset)
        history = tier1.volume_history(self.stored("dq_check_result"), job.dataset.dataset, event.start, [p.label for p in periods])
        found = tier1.volume(self.relation(job.dataset.dataset), job.dataset.load_time.plan(), periods, history, settings["volume_tolerance_pct"] / 100, zone=self.zone).collect()
        out = []
        for r in found:
            groups = {"slot": r.g_1, "slot_time": r.g_2}
            if r.outside is None:
                out.append(did_not_run("insufficient_history", f"{r.loads} earlier loads", groups, population=r.row_count, observed=f"{r.row_count} rows"))
            else:
                out.append(counted(r.row_count, r.outside, f"{r.row_count} rows", f"{r.low:g} to {r.high:g} rows", groups))
        return out

    def _t1_files_not_loaded(self, job: Job) -> list[Result]:
        ds = job.dataset
        if ds.layer != "RAW" or not ds.file_name_column:
            return []
        sla = timedelta(hours=self.config.settings(ds.dataset)["sla_hours"])
        seen = self.stored("dq_file").where(F.col("feed") == job.feed.feed)
        r = tier1.files_not_loaded(seen, self.relation(ds.dataset), ds.file_name_column, job.event.end - sla).first()
        return [counted(r.population, r.violations, f"{r.violations} files without rows", "every landed file has rows", evidence=list(r.not_loaded or []))]

    def _t1_schema_drift(self, job: Job) -> list[Result]:
        import json

        schema = self.spark.table(job.dataset.table).schema
        past = self.stored("dq_check_result").where((F.col("check_id") == "T1_SCHEMA_DRIFT") & (F.col("execution_type") == "NORMAL") & (F.get_json_object("observed", "$.table") == job.dataset.table)).orderBy(F.desc("evaluated_at")).limit(1).collect()
        known = json.loads(past[0].observed)["columns"] if past else None
        drift = tier1.schema_drift(schema, known)
        observed = json.dumps({"table": job.dataset.table, "digest": drift.digest, "columns": drift.columns})
        if drift.changed is None:
            return [did_not_run("insufficient_history", "the first schema recorded", observed=observed)]
        detail = json.dumps({"added": drift.added, "removed": drift.removed, "retyped": drift.retyped}) if drift.changed else None
        return [counted(len(drift.columns), drift.violations, observed, f"digest {tier1.schema_digest(known)}", detail=detail)]

    def _t1_key_nulls(self, job: Job) -> list[Result]:
        ds = job.dataset
        found = tier1.key_nulls(self.relation(ds.dataset), ds.load_time.plan(), ds.key, job.event.start, job.event.end, ds.group_by, self.zone).collect()
        return from_rows(found, ds.group_by, lambda r: (f"{r.violations} of {r.population} rows with a blank key", "none"))

    def _t1_key_duplicates(self, job: Job) -> list[Result]:
        ds = job.dataset
        if not ds.key_unique:
            return []
        found = tier1.key_duplicates(self.relation(ds.dataset), [ds.part(c) for c in ds.key], ds.group_by).collect()
        return from_rows(found, ds.group_by, lambda r: (f"{r.violations} of {r.population} keys on several rows", "none"))

    def _each_hop(self, job: Job, work) -> list[Result]:
        """One result for each upstream of the key map; what goes wrong with one stays with it."""
        ds, out = job.dataset, []
        for up_name in ds.key_map:
            groups = {"hop": f"{up_name}->{ds.dataset}"}
            up = self.config.datasets.get(up_name)
            if up is None or ds.record_time is None or up.record_time is None or up.load_time is None:
                out.append(did_not_run("invalid_config", "the hop lacks a record or load time", groups))
                continue
            try:
                mapped = ds.key_map[up_name]
                self.require(up_name, [up.record_time.column, up.load_time.column, *(mapped[c] for c in ds.key), *(ds.owned_columns if job.check_id == "HOP_VALUE_AGREEMENT" else ())])
                found = work(self.hop(ds, up_name, job.event, job.sweep), groups, up_name)
            except Exception as e:  # noqa: BLE001  a failing hop is a result
                found = replace(oc.from_error(e), groups=groups)
            out += [found] if found else []
        return out

    def judged(self, job: Job, up_name: str, hop: hops.Hop) -> DataFrame:
        """The hop's keys assessed over the job's window: once for currency, agreement, events and causes. Spark keeps the rows and
        rebuilds what a lost executor had of them."""
        name = (job.dataset.dataset, up_name, job.event, job.sweep)
        if name not in self.assessed:
            self.forget(job.dataset.dataset)
            self.assessed[name] = hops.assess(hop).persist(StorageLevel.MEMORY_AND_DISK)
        return self.assessed[name]

    def forget(self, but: str | None = None) -> None:
        """Lets go of what was assessed for other datasets."""
        for name in [n for n in self.assessed if n[0] != but]:
            self.assessed.pop(name).unpersist()

    def _hop_key_currency(self, job: Job) -> list[Result]:
        def work(hop: hops.Hop, groups: dict, up_name: str) -> Result:
            assessed = self.judged(job, up_name, hop)
            r = hops.currency(assessed).first()
            seen = f"{r.missing} missing, {r.stale} stale, {r.unassessable} unassessable of {r.population}; {r.excluded or 0} excluded, {r.pending or 0} pending" if r.population is not None else "none"
            why = None if self.secret or not r.violations else "no secret is set, so no key events are kept"
            return counted(r.population, r.violations, seen, "every upstream key at its latest version", groups, detail=why, evidence=(hop, assessed, up_name))

        return self._each_hop(job, work)

    def _hop_value_agreement(self, job: Job) -> list[Result]:
        if not job.dataset.owned_columns:
            return []

        def work(hop: hops.Hop, groups: dict, up_name: str) -> Result:
            off = hops.mismatches(hop, self.judged(job, up_name, hop)).persist(StorageLevel.MEMORY_AND_DISK)
            r = hops.agreement(hop, off).first()
            return counted(r.population, r.violations, f"{r.violations or 0} of {r.population} keys disagree", "the same owned values", groups, evidence=(hop, off, up_name))

        return self._each_hop(job, work)

    def _hop_file_completeness(self, job: Job) -> list[Result]:
        if not job.dataset.file_name_column:
            return []

        def work(hop: hops.Hop, groups: dict, up_name: str) -> Result | None:
            if hop.up.file is None:
                return None
            r = hops.completeness(hop).first()
            return counted(r.population, r.violations, f"{r.violations or 0} of {r.population} files short; {r.excluded or 0} rows excluded, {r.pending} files pending", "as many rows as upstream", groups, evidence=(hop, list(r.short or []), up_name))

        return self._each_hop(job, work)

    def _rule(self, rule: Rule, ds: Dataset) -> list[Result]:
        p, rows, groups = PARAMS[rule.template].model_validate(rule.params), self.relation(ds.dataset), rule.group_by
        key = [ds.part(c) for c in ds.key]
        match rule.template:
            case "max_rows_per_key":
                found = rules.max_rows_per_key(rows, key, p.max, groups)
            case "max_open_rows_per_key":
                found = rules.max_open_rows_per_key(rows, key, p.open_when, p.max, groups)
            case "column_order":
                found = rules.column_order(rows, p.lower, p.upper, p.nulls_fail, p.format, groups)
            case "superseded_still_open":
                found = rules.superseded_still_open(rows, p.group_key, p.order_column, p.open_when, groups, p.format)
            case "child_within_parent":
                read = (lambda c: F.try_to_timestamp(F.col(c).cast("string"), F.lit(p.format))) if p.format else F.col
                found = rules.child_within_parent(rows, self.relation(p.parent_dataset), list(p.join.items()), read(p.child_start), read(p.parent_start), read(p.parent_end), groups)
            case "value_format":
                found = rules.value_format(rows, p.column, p.pattern, groups)
            case _:
                found = rules.null_rate_max(rows, p.column, p.max_rate, groups)
        return from_rows(found.collect(), groups, lambda r: (f"{r.violations} of {r.population}", f"{rule.template} holds"))

    # -- planning

    def history(self, names: Iterable[str]) -> dict[str, History]:
        """Where each dataset's windows stand. Windows only move on, so the last weeks' rows tell all once a window of theirs is done;
        the whole store is only read for datasets without one."""
        found = {n: History() for n in names}
        recent = F.col("run_date") >= F.lit(self.run_start.date() - timedelta(days=RECENT_DAYS))
        at = lambda t: as_utc(t) if t else None
        for part in (recent, F.lit(True)):
            left = [n for n, h in found.items() if h.previous_end is None]
            rows = self.stored("dq_check_result").where(part & F.col("dataset").isin(left))
            for r in views.window_history(rows, self.stored("dq_run").where(part)).collect() if left else ():
                found[r.dataset] = History(at(r.previous_end), at(r.held_start), at(r.first_held_end), at(r.last_held_end), tuple(r.held_by or ()))
        return found

    def jobs(self, feeds: set[str] | None = None, changed: set[str] = frozenset()) -> tuple[list[Job], list[tuple[Dataset, Event]]]:
        """The jobs of a NORMAL run and the spans given up. Windows are fixed before anything is written; a schema is looked at
        once for each physical table. Feeds that are named run; else those with a slot due in their window or changed files."""
        chosen = {n: d for n, d in self.config.datasets.items() if d.derived is None and (feeds is None or (f := self.config.feed_of(n)) and f.feed in feeds)}
        out, gaps = self._planned(chosen)
        if feeds is None:
            due = changed | {j.feed.feed for j in out if j.feed and self._slots_due(j)}
            covered = {d.table for n, d in chosen.items() if self.config.feed_of(n)}
            fresh = {d.table for n, d in chosen.items() if (f := self.config.feed_of(n)) and f.feed in due}
            # a table-wide dataset goes with the feeds that write its table, or always if none does
            names = {n for n, d in chosen.items() if (f.feed in due if (f := self.config.feed_of(n)) else d.table in fresh or d.table not in covered)}
            out, gaps = [j for j in out if j.dataset.dataset in names], [g for g in gaps if g[0].dataset in names]
            chosen = {n: chosen[n] for n in names}
        tables_seen: set[str] = set()
        for j in [j for j in out if j.check_id == "T1_SCHEMA_DRIFT"]:
            if j.dataset.table in tables_seen:
                out.remove(j)
            tables_seen.add(j.dataset.table)
        return out + self._rules_due(chosen, out), gaps

    def _planned(self, chosen: dict[str, Dataset]) -> tuple[list[Job], list[tuple[Dataset, Event]]]:
        history, out, gaps = self.history(chosen), [], []
        for name, ds in chosen.items():
            feed, s = self.config.feed_of(name), self.config.settings(name)
            delay = timedelta(minutes=feed.check_delay_minutes if feed else 0)
            load = ds.load_time.plan() if ds.load_time else None
            settle, back = timedelta(minutes=s["settle_minutes"]), timedelta(hours=s["initial_lookback_hours"])
            end = next_window(name, self.run_start, None, settle, back, load, self.zone, delay).end
            start, gap = release(history[name], name, end, timedelta(hours=s["max_window_hours"]))
            if gap:
                gaps.append((ds, gap))
            event = next_window(name, self.run_start, start, settle, back, load, self.zone, delay)
            sweep = schedule.full_sweep(event.start, event.end, s["full_sweep_day"], self.zone)
            for check_id in CHECKS[feed.pattern if feed else "TABLE_WIDE"]:
                out.append(Job(ds, feed, check_id, event, sweep=sweep))
        return out, gaps

    def _rules_due(self, chosen: dict[str, Dataset], planned: list[Job]) -> list[Job]:
        d = self.config.defaults
        recent = F.col("run_date") >= F.lit(self.run_start.date() - timedelta(days=RECENT_DAYS))
        done = self.stored("dq_check_result").where(recent & F.expr("execution_type = 'NORMAL' AND severity IS NOT NULL AND coalesce(reason_category, '') NOT IN ('PLATFORM', 'BUDGET')"))
        last = {(r.dataset, r.check_id): as_utc(r.at) for r in done.groupBy("dataset", "check_id").agg(F.max("evaluated_at").alias("at")).collect()}
        events = {j.dataset.dataset: j.event for j in planned}
        out = []
        for rule in self.config.rules.values():
            ds = chosen.get(rule.dataset)
            if ds is None or rule.status == "retired":
                continue
            day = d.rule_weekly_day or self.config.settings(rule.dataset)["full_sweep_day"]
            if schedule.rule_due(rule.frequency, self.run_start, last.get((rule.dataset, rule.rule)), d.rule_run_at, day, self.zone):
                out.append(Job(ds, self.config.feed_of(rule.dataset), rule.rule, events[rule.dataset], rule))
        return out

    # -- writing

    def row(self, job: Job, r: Result, took: int) -> dict[str, Any]:
        version = self.config.version(job.dataset.dataset)
        return {
            "evaluation_id": evaluation_id(job.event.event_id, job.check_id, version, VERSION, r.groups), "run_id": self.run_id, "event_id": job.event.event_id, "window_start": job.event.start, "window_end": job.event.end, "execution_type": self.execution,
            "feed": job.feed.feed if job.feed else None, "dataset": job.dataset.dataset, "check_id": job.check_id, "expectation_version": version, "state": r.state, "reason_category": r.category, "reason_code": r.reason, "population": r.population, "violations": r.violations,
            "observed": r.observed, "expected": r.expected, "group_values": r.groups, "severity": job.rule.severity if job.rule else None, "evaluated_at": datetime.now(UTC), "duration_ms": took, "detail": r.detail, "run_date": self.run_start.date(),
        }

    def _run_row(self, status: str, expected: int, written: int = 0, to_explain: int = 0, explained: int = 0, ended: bool = False) -> None:
        tables.append_values(self.spark, self.database, "dq_run", [{"run_id": self.run_id, "started_at": self.run_start, "ended_at": datetime.now(UTC) if ended else None, "engine_version": VERSION, "status": status, "checks_expected": expected, "checks_written": written, "investigations_expected": to_explain, "investigations_done": explained, "execution_type": self.execution, "run_date": self.run_start.date()}])

    def land(self, feed: Feed) -> Result | int:
        """Registers a feed's new and changed files and says how many, or why it couldn't."""
        if feed.landing is None:
            return 0
        try:
            found = landing.listing(self.spark, feed.landing.roots, feed.landing.file_name_pattern)
        except landing.Unreadable as e:
            return did_not_run("landing_unreadable", str(e))
        except landing.Unavailable as e:
            return did_not_run("hdfs_unavailable", str(e))
        now = found.withColumns({"observed_at": stamp(self.run_start), "feed": F.lit(feed.feed), "run_id": F.lit(self.run_id), "run_date": F.lit(self.run_start.date())})
        fresh = tables.new_files(now, views.file_status(self.stored("dq_file").where(F.col("feed") == feed.feed))).persist()
        n = fresh.count()  # before its own table is appended to
        if n:
            tables.append(self.spark, self.database, "dq_file", fresh)
        fresh.unpersist()
        return n

    def run(self, feeds: set[str] | None = None, windows: tuple[datetime, datetime] | None = None) -> str:
        """The run's status. Checks go one after the other; a result is stored as soon as it is there."""
        if any(s != tables.OK for s in tables.status(self.spark, self.database).values()):
            raise RuntimeError("the store isn't installed")
        landed = {n: self.land(f) for n, f in self.config.feeds.items() if windows is None and (feeds is None or n in feeds)}
        problems = {n: x for n, x in landed.items() if isinstance(x, Result)}
        changed = {n for n, x in landed.items() if isinstance(x, int) and x}
        jobs, gaps = self.jobs(feeds, changed) if windows is None else (self._historical(feeds, *windows), [])
        self._run_row("STARTED", len(jobs))
        for ds, gap in gaps:
            job = Job(ds, self.config.feed_of(ds.dataset), GAP, gap)
            tables.append_values(self.spark, self.database, "dq_check_result", [self.row(job, did_not_run("window_gap", "held too long; never checked"), 0)])
        written = to_explain = explained = 0
        spent: dict[str, float] = {}
        for job in jobs:
            budget = self.config.settings(job.dataset.dataset)["compute_budget_minutes"]
            if self.config.defaults.compute_budget_scope == "dataset":
                budget -= spent.get(job.dataset.dataset, 0.0)
            problem = problems.get(job.feed.feed) if job.feed and job.check_id == "T1_FILES_NOT_LOADED" else None
            if problem is not None:
                results, took = [problem], 0
            else:
                results, took = self._timed(job, budget)
            spent[job.dataset.dataset] = spent.get(job.dataset.dataset, 0.0) + took / 60_000
            ok = self._store(job, results, took)
            written += ok
            failed = [r for r in results if r.state == oc.FAILED and r.evidence is not None and not job.rule]
            to_explain += len(failed)
            explained += sum(self.investigate(job, r) for r in failed)
            for r in results:
                if job.check_id == "HOP_VALUE_AGREEMENT" and isinstance(r.evidence, tuple):
                    r.evidence[1].unpersist()
        if self.execution == "NORMAL":
            self.retry()
        self.forget()
        status = "COMPLETED" if written == len(jobs) and explained == to_explain else "PARTIAL"
        self._run_row(status, len(jobs), written, to_explain, explained, ended=True)
        return status

    def _timed(self, job: Job, budget: float) -> tuple[list[Result], int]:
        size = None
        if self.config.defaults.scan_mb_per_minute and self.spark.catalog.tableExists(job.dataset.table):
            size = oc.estimated_bytes(self.relation(job.dataset.dataset))
        return oc.run_check(self.spark, lambda: self.evaluate(job), budget, size, self.config.defaults.scan_mb_per_minute)

    def _store(self, job: Job, results: list[Result], took: int) -> bool:
        rows = [self.row(job, r, took) for r in results]
        fresh = self._changed(rows)
        tables.append_values(self.spark, self.database, "dq_check_result", fresh)
        self.rows += rows
        if job.check_id in ("T1_ON_TIME", "T1_ZERO_ROWS"):
            self.short_slots |= {row["evaluation_id"]: tuple(s.isoformat() for s in r.evidence or ()) for row, r in zip(rows, results)}
        if job.check_id != "HOP_KEY_CURRENCY" or self.execution != "NORMAL" or self.secret is None:
            return True
        ok = True
        for row, r in zip(rows, results):
            if r.evidence is None:
                continue
            try:
                hop, assessed, up_name = r.evidence
                events = hops.key_events(assessed, hop.hashed).withColumns({"run_id": F.lit(self.run_id), "evaluation_id": F.lit(row["evaluation_id"]), "dataset": F.lit(job.dataset.dataset), "check_id": F.lit(job.check_id), "hop": F.lit(f"{up_name}->{job.dataset.dataset}"), "observed_at": stamp(self.run_start), "run_date": F.lit(self.run_start.date())})
                tables.append(self.spark, self.database, "dq_key_event", events)
            except Exception as e:  # noqa: BLE001  the result must say that its evidence is not there
                ok = False
                lost = did_not_run("evidence_incomplete", f"{type(e).__name__} {oc.condition_of(e)}".strip(), r.groups)
                tables.append_values(self.spark, self.database, "dq_check_result", [self.row(job, lost, 0)])
        return ok

    def _changed(self, rows: list[dict]) -> list[dict]:
        """On reruns, only rows whose outcome differs from the latest stored one of the same evaluation."""
        if self.execution == "NORMAL" or not rows:
            return rows
        order = Window.partitionBy("evaluation_id").orderBy(F.desc("evaluated_at"))
        past = self.stored("dq_check_result").where(F.col("evaluation_id").isin([r["evaluation_id"] for r in rows])).withColumn("_n", F.row_number().over(order)).where("_n = 1")
        known = {r.evaluation_id: tuple(r[c] for c in OUTCOME) for r in past.collect()}
        return [r for r in rows if known.get(r["evaluation_id"]) != tuple(r[c] for c in OUTCOME)]

    def _historical(self, feeds: set[str] | None, start: datetime, end: datetime) -> list[Job]:
        """RERUN: the window itself. REPLAY: the recorded windows of the span, and what they leave open. No files, rules, key
        events or schema checks, and no window moves."""
        out = []
        for name, ds in self.config.datasets.items():
            feed = self.config.feed_of(name)
            if ds.derived is not None or feeds is not None and (feed is None or feed.feed not in feeds):
                continue
            load = ds.load_time.plan() if ds.load_time else None
            if self.execution == "RERUN":
                events = [fixed(name, start, end, load, self.zone)]
            else:
                past = self.stored("dq_check_result").where((F.col("dataset") == name) & (F.col("check_id") != GAP) & F.expr("execution_type = 'NORMAL' AND severity IS NULL") & (F.col("window_start") >= stamp(start)) & (F.col("window_end") <= stamp(end)))
                recorded = [(as_utc(r.window_start), as_utc(r.window_end)) for r in past.select("window_start", "window_end").distinct().collect()]
                events = replay(name, start, end, recorded, load, self.zone)
            day = self.config.settings(name)["full_sweep_day"]
            for event in events:
                sweep = schedule.full_sweep(event.start, event.end, day, self.zone)
                out += [Job(ds, feed, c, event, sweep=sweep) for c in CHECKS[feed.pattern if feed else "TABLE_WIDE"] if c not in ("T1_SCHEMA_DRIFT", "T1_FILES_NOT_LOADED")]
        return out

    # -- causes

    def failures(self, job: Job, r: Result) -> list[Failure]:
        if job.check_id in ("T1_ON_TIME", "T1_ZERO_ROWS"):
            return [Failure(s.isoformat(), slot=s) for s in r.evidence[: causes.EXPLAINED]]
        if job.check_id == "T1_FILES_NOT_LOADED":
            return [Failure(p, path=p) for p in r.evidence]
        if job.check_id == "HOP_FILE_COMPLETENESS":
            return [Failure(s.f, file=s.f) for s in r.evidence[1]]
        hop, rows, _ = r.evidence
        if self.secret is None:
            return [Failure(None)]
        keys = causes.first_keys(rows.where("mismatch = 1"), hop.hashed) if job.check_id == "HOP_VALUE_AGREEMENT" else causes.failing_keys(rows, hop.hashed)
        return [Failure(k.key_hash, key=k) for k in keys.collect()]

    def investigate(self, job: Job, r: Result) -> bool:
        """Explains a failed result and stores what each cause's probe found; whether it got through."""
        kind = failure_type(job.check_id, job.feed.pattern if job.feed else "TABLE_WIDE")
        if kind is None:
            return True
        try:
            failures = self.failures(job, r)
            probe = Probe(self, job, r, failures)
            found = explain(kind, failures or [Failure(None)], (lambda c, f: not_ready("nothing to explain") if f.ref is None else probe(c, f)))
        except Exception:  # noqa: BLE001  tried again by a later run
            return False
        version = self.config.version(job.dataset.dataset)
        ident = evaluation_id(job.event.event_id, job.check_id, version, VERSION, r.groups)
        rows = [{"run_id": self.run_id, "evaluation_id": ident, "failure_ref": e.failure.ref, "hop": r.groups.get("hop"), "cause_check_id": code, "order_no": n, "state": o.state, "cause_code": code if o.state == "CONFIRMED" else None, "evidence": o.text(), "evaluated_at": datetime.now(UTC), "run_date": self.run_start.date()} for e in found for n, code, o in e.outcomes]
        tables.append_values(self.spark, self.database, "dq_cause_result", rows)
        self.cause_rows += [{"evaluation_id": ident, "ref": e.failure.ref, "cause": e.cause, "level": e.level} for e in found]
        return True

    def retries(self) -> DataFrame:
        """FAILED results of the last days that are still their evaluation's latest and have no cause rows."""
        since = self.run_start.date() - timedelta(days=self.config.defaults.investigation_retry_days)
        recent = self.stored("dq_check_result").where((F.col("run_date") >= F.lit(since)) & F.expr("execution_type = 'NORMAL' AND severity IS NULL"))
        explained = sorted({c for k in FAILURES.values() for c in k.checks})
        return views.unexplained(recent, self.stored("dq_cause_result"), explained)

    def retry(self) -> int:
        """Investigates what earlier runs couldn't: the check is evaluated over its own window again for the evidence."""
        done = 0
        for r in self.retries().where(F.col("run_id") != self.run_id).collect():
            ds = self.config.datasets.get(r.dataset)
            feed = ds and self.config.feed_of(r.dataset)
            if feed is None or failure_type(r.check_id, feed.pattern) is None:
                continue
            job = Job(ds, feed, r.check_id, Event(r.dataset, as_utc(r.window_start), as_utc(r.window_end)))
            try:
                again = next((x for x in self.evaluate(job) or () if x.state == oc.FAILED and x.groups == dict(r.group_values)), None)
            except Exception:  # noqa: BLE001  left for the next run
                continue
            done += again is not None and self.investigate(job, again)
        return done


class Probe:
    """What the evidence says of one cause and one failure. Each frame is collected once for an evaluation: it has a row for
    each failing item, or for each file of a feed."""

    def __init__(self, engine: Engine, job: Job, result: Result, failures: list[Failure]):
        self.e, self.job, self.result, self.failures, self.kept = engine, job, result, failures, {}
        keys = [f.key.k for f in failures if f.key is not None]
        self.failing = engine.spark.createDataFrame([(k,) for k in keys], "k string") if keys else None

    def once(self, name: str, make) -> Any:
        if name not in self.kept:
            self.kept[name] = make()
        return self.kept[name]

    def __call__(self, cause: Cause, failure: Failure) -> Outcome:
        if cause.probe == "builtin":
            return getattr(self, cause.code.lower())(failure)
        if cause.probe == "size_changed":
            return self.size_changed(failure)
        raw = self.job.feed.probes.get(cause.params) if self.job.feed else None
        sets = [PROBES[cause.probe].model_validate(p) for p in (raw if isinstance(raw, list) else [raw] if raw else [])]
        return settle([getattr(self, cause.probe)(p, failure) if ready(p) else not_ready("a parameter isn't set") for p in sets])

    # files

    def _raw(self) -> Dataset | None:
        return next((d for n in self.job.feed.datasets if (d := self.e.config.datasets[n]).layer == "RAW" and d.file_name_column), None)

    def _files(self) -> DataFrame:
        """The feed's landed files."""
        raw = self._raw()
        seen = self.e.stored("dq_file").where(F.col("feed") == self.job.feed.feed)
        return causes.landed(seen, self.e.relation(raw.dataset) if raw else None, raw.file_name_column if raw else None)

    def _span(self, slot: datetime) -> tuple[datetime, datetime]:
        return slot, slot + timedelta(hours=self.e.config.settings(self.job.dataset.dataset)["sla_hours"])

    def _landed(self) -> dict[str, Any]:
        """Those among them that fail or landed within a failing slot."""

        def make():
            asked = F.col("path").isin([f.path for f in self.failures if f.path])
            for f in self.failures:
                if f.slot is not None:
                    asked = asked | within(F.col("first_seen_at"), *self._span(f.slot))
            return {r.path: r for r in self._files().where(asked).collect()}

        return self.once("landed", make)

    def _later(self) -> dict[datetime, Any]:
        """Files since each failing item, itself included, by that time."""

        def make():
            since = sorted({t for f in self.failures if (t := self._since(f)) is not None})
            return {since[r.n]: r for r in causes.later_files(self._files(), since).collect()} if since else {}

        return self.once("later", make)

    def _since(self, failure: Failure) -> datetime | None:
        if failure.path in self._landed():
            return as_utc(self._landed()[failure.path].first_seen_at)
        return failure.slot and as_utc(failure.slot)

    def _paths(self, failure: Failure) -> list[str]:
        if failure.path:
            return [failure.path]
        if failure.slot is None:
            return []
        start, end = self._span(failure.slot)
        return [p for p, r in self._landed().items() if start <= as_utc(r.first_seen_at) < end]

    def file_exists(self, p, failure: Failure) -> Outcome:
        return confirmed(path=p.path) if landing.exists(self.e.spark, p.path) else ruled_out(path=p.path)

    def pipeline_stalled(self, failure: Failure) -> Outcome:
        if self._raw() is None:
            return not_ready("the feed has no raw dataset")
        since = self._since(failure)
        if since is None:
            return ruled_out(later_files=0)
        row, own = self._later().get(since), self._landed().get(failure.path)
        later = (row.later_files if row else 0) - (own is not None)
        loaded = (row.loaded if row else 0) - (own is not None and own.raw_rows > 0)
        return confirmed(later_files=later) if later and not loaded else ruled_out(later_files=later, loaded=loaded)

    def size_changed(self, failure: Failure) -> Outcome:
        if self._raw() is None:
            return not_ready("the feed has no raw dataset")
        sizes = max((self._landed()[p].sizes for p in self._paths(failure) if p in self._landed()), default=0)
        return confirmed(sizes=sizes) if sizes > 1 else ruled_out(sizes=sizes)

    def unreadable(self, failure: Failure) -> Outcome:
        if self.job.feed.landing is None or self._raw() is None:
            return not_ready("the feed has no landing or no raw dataset")
        for path in self._paths(failure):
            if not landing.exists(self.e.spark, path):
                return Outcome("ERROR", {"error": "the file is gone"})
            if not landing.readable(self.e.spark, path, self.job.feed.landing.file_format):
                return confirmed(format=self.job.feed.landing.file_format)
        return ruled_out()

    def log_contains(self, p, failure: Failure) -> Outcome:
        names = [x.rsplit("/", 1)[-1] for x in self._paths(failure)]
        hits = [f for n in names for f in landing.log_files_with(self.e.spark, p.path_glob, p.pattern, n)]
        return confirmed(logs=sorted(set(hits))) if hits else ruled_out()

    def file_value_compare(self, p, failure: Failure) -> Outcome:
        """The value in a file, read by its format, against the failing file's folder or slot, or against the window."""
        found = landing.value_in(self.e.spark, p.path, p.extract_regex)
        one = self.e.spark.range(1)
        parse = lambda v: one.select(F.try_to_timestamp(F.lit(v), F.lit(p.format)).alias("t")).first().t
        value = parse(found) if found else None
        if value is None:
            return not_ready("the file holds no such value")
        if p.compare_to == "window":
            at = one.select(F.to_utc_timestamp(F.lit(value), self.e.zone).alias("t")).first().t
            inside = as_utc(self.job.event.start) <= as_utc(at) < as_utc(self.job.event.end)
            return ruled_out(value=found) if inside else confirmed(value=found)
        zone = self.job.feed.cadence.timezone
        if failure.slot is not None:
            local = F.from_utc_timestamp(stamp(failure.slot), zone)
            parts = [one.select(F.try_to_timestamp(F.date_format(local, p.format), F.lit(p.format)).alias("t")).first().t]
        else:
            parts = [t for path in self._paths(failure) if (t := parse(path.rstrip("/").split("/")[-2].rpartition("=")[2]))]
        if not parts:
            return not_ready("the failing item has no partition of that format")
        off = any(value > t if p.confirm_when == "later" else value != t for t in parts)
        return confirmed(value=found) if off else ruled_out(value=found)

    # between layers

    @property
    def hop(self) -> hops.Hop:
        return self.result.evidence[0]

    @property
    def upstream(self) -> Dataset:
        return self.e.config.datasets[self.result.evidence[2]]

    def table_contains(self, p, failure: Failure) -> Outcome:
        up, ds = self.upstream, self.job.dataset
        rows = self.e.spark.table(p.table)
        if failure.key is not None:
            mapping = ds.key_map[up.dataset]
            ref = canonical([up.part(mapping[c]) for c in ds.key])
            wanted = failure.key.k
        else:
            if not up.file_name_column:
                return not_ready("the upstream has no file column")
            ref, wanted = base_name(up.file_name_column), failure.file
        hit = causes.table_refs(rows, p.condition, ref).where(F.col("ref") == wanted).limit(1).count()
        label = {"rule": p.id} if p.id else {}
        return confirmed(table=p.table, **label) if hit else ruled_out(table=p.table, **label)

    def _facts(self) -> dict[str, Any]:
        """What is known of the failing files, with the number of later files that have rows here."""

        def make():
            ds, up = self.job.dataset, self.upstream
            facts = causes.file_facts(self.hop, [up.part(ds.key_map[up.dataset][c]) for c in ds.key])
            asked = self.e.spark.createDataFrame([(f.file,) for f in self.failures], "f string")
            mine = facts.join(F.broadcast(asked.withColumnRenamed("f", "_f")), F.col("f").eqNullSafe(F.col("_f")), "left_semi")  # the failures explained
            skipped = causes.skipped_files(facts).join(F.broadcast(asked), "f", "left_semi")
            later = {r.f: r.later_files for r in skipped.collect()}
            return {r.f: (r, later.get(r.f, 0)) for r in mine.collect()}

        return self.once("facts", make)

    def _grain(self, t: datetime | None) -> datetime | None:
        load = self.job.dataset.load_time
        return None if t is None else truncate(t, load.granularity, load.timezone or self.e.zone)

    def not_run(self, failure: Failure) -> Outcome:
        ds = self.job.dataset
        if ds.load_time is None:
            return not_ready("load_time isn't set")
        row = failure.key or self._facts().get(failure.file, (None, 0))[0]
        at = self._grain(row and (row.up_load_ts if failure.key is not None else row.first_load))
        if at is None:
            return ruled_out(upstream_load=None)
        last = self.once("last", lambda: causes.latest_load(self.hop.dn.rows, self.hop.dn.load).first().max_load)
        return confirmed(upstream_load=at, latest_load=last) if last is None or as_utc(last) < at else ruled_out(upstream_load=at, latest_load=last)

    def file_skipped(self, failure: Failure) -> Outcome:
        row, later = self._facts().get(failure.file, (None, 0))
        if row is None or row.rows_here > 0 or row.first_load is None:
            return ruled_out(rows_here=row.rows_here if row else None)
        return confirmed(later_files=later) if later else ruled_out(later_files=0)

    def invalid_key(self, failure: Failure) -> Outcome:
        row, _ = self._facts().get(failure.file, (None, 0))
        n = row.invalid_rows if row else 0
        return confirmed(invalid_rows=n, rows=row.up_rows) if n else ruled_out(invalid_rows=0)

    def key_mismatch(self, failure: Failure) -> Outcome:
        ds, up = self.job.dataset, self.upstream
        tried = [c for c in ds.mismatch_probe_drop if len(ds.key) > 1]
        if not tried:
            return not_ready("no column can be dropped")
        if failure.key.key_state != "MISSING":
            return ruled_out(state=failure.key.key_state)
        mapping = ds.key_map[up.dataset]
        for column in tried:
            hits = self.once(f"without {column}", lambda column=column: {r.k for r in causes.key_mismatch(self.hop.expected(), [up.part(mapping[c]) for c in ds.key], self.hop.dn.rows, [ds.part(c) for c in ds.key], ds.key.index(column), self.failing).collect()})
            if failure.key.k in hits:
                return confirmed(without=column)
        return ruled_out(tried=tried)

    def join_unmatched(self, failure: Failure) -> Outcome:
        up = self.upstream
        if up.derived is None or not up.derived.joins:
            return not_ready("the upstream isn't derived with joins")
        if failure.key.key_state != "MISSING":
            return ruled_out(state=failure.key.key_state)
        found = self.once("unmatched", lambda: {r.k: list(r.unmatched) for r in causes.unmatched_joins(self.hop.up.rows, self.hop.up.key, self.failing).collect()})
        hit = found.get(failure.key.k)
        return confirmed(unmatched=hit) if hit else ruled_out(joins=[j.dataset for j in up.derived.joins])

    def tie_resolved_by_rule(self, failure: Failure) -> Outcome:
        rule = self.job.dataset.winner_rule
        if rule is None:
            return not_ready("no winner_rule is set")
        if failure.key.key_state != "CURRENT":
            return ruled_out(state=failure.key.key_state)
        row = self.once("ties", lambda: {r.k: r for r in causes.ties(self.hop, self._winner(rule), self.failing).collect()}).get(failure.key.k)
        if row is None:
            return ruled_out(tied=1)
        facts = {"tied": row.tied, "variants": row.variants, "winner_here": bool(row.winner_here)}
        return confirmed(**facts) if row.variants > 1 and row.winner_here else ruled_out(**facts)

    def _winner(self, rule) -> list[Column]:
        """The rule's order over upstream rows: times read as times, the upstream's own as configured."""
        up = self.upstream
        own = {t.column: t for t in (up.record_time, up.load_time) if t}
        out = []
        for term in rule.order_by:
            column, _, way = term.strip().partition(" ")
            c = F.try_to_timestamp(F.col(column).cast("string"), F.lit(rule.formats[column])) if column in rule.formats else self.e.time(own[column]) if column in own else F.col(column)
            out.append(F.desc_nulls_last(c) if way.strip().lower() == "desc" else F.asc_nulls_first(c))
        return out

    def older_version_written_later(self, failure: Failure) -> Outcome:
        k = failure.key
        if k.key_state != "STALE":
            return ruled_out(state=k.key_state)
        if self.job.dataset.load_time is None:
            return not_ready("load_time isn't set")
        here, there = self._grain(k.dn_load_ts), self._grain(k.up_load_ts)
        if here is None or there is None:
            return ruled_out(loaded_here=here, loaded_upstream=there)
        return confirmed(loaded_here=here, loaded_upstream=there) if here > there else ruled_out(loaded_here=here, loaded_upstream=there)

    def no_upstream_data(self, failure: Failure) -> Outcome:
        ds, ups = self.job.dataset, [self.e.config.datasets.get(u) for u in self.job.dataset.upstream]
        if not ups or any(u is None or u.load_time is None for u in ups):
            return not_ready("an upstream has no load_time, or there is none")
        start = previous_slot(self.job.feed.cadence.plan(), failure.slot)
        if start is None:
            return not_ready("no slot lies before this one")
        end = failure.slot + timedelta(hours=self.e.config.settings(ds.dataset)["sla_hours"])
        counts = {u.dataset: self.once(f"{u.dataset} {start}", lambda u=u: causes.rows_loaded(self.e.relation(u.dataset), self.e.time(u.load_time), start, end).first().loaded) for u in ups}
        return ruled_out(rows=counts) if any(counts.values()) else confirmed(rows=counts)


__all__ = ["UNMATCHED", "Engine", "Job", "Probe"]
