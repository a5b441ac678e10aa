"""Command line: validate, install, dry-run, run, trace, watchdog, retention.

Exit codes: 0 done (failing checks are results, not errors), 1 problems found, 2 a run that stayed partial, 3 not started.
"""

from __future__ import annotations

import argparse
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from floodmark.config.fragments import problems
from floodmark.config.loader import Config, load
from floodmark.engine import Engine
from floodmark.functions.times import as_utc
from floodmark.plans.outcome import FAILED
from floodmark.report import digest, trace, watchdog
from floodmark.report.frames import digest_history, gone_groups
from floodmark.store import tables


def session() -> SparkSession:
    return SparkSession.builder.appName("floodmark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="floodmark")
    p.add_argument("--conf", required=True)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("validate")
    install = sub.add_parser("install")
    install.add_argument("mode", choices=["print", "apply", "check"])
    sub.add_parser("dry-run")
    run = sub.add_parser("run")
    run.add_argument("--feed", action="append")
    run.add_argument("--execution", choices=["NORMAL", "RERUN", "REPLAY"], default="NORMAL")
    run.add_argument("--start", type=datetime.fromisoformat)
    run.add_argument("--end", type=datetime.fromisoformat)
    run.add_argument("--now", type=datetime.fromisoformat)
    t = sub.add_parser("trace")
    t.add_argument("dataset")
    t.add_argument("key", nargs="+")
    w = sub.add_parser("watchdog")
    w.add_argument("--now", type=datetime.fromisoformat)
    r = sub.add_parser("retention")
    r.add_argument("--apply", action="store_true")
    return p


SAMPLES = 5


def digests(engine: Engine) -> list[tuple[digest.Digest, str]]:
    """The run's digests and their texts, out of its own rows and the store's history. Key values are named only where a dataset's
    email_sample_keys allows it."""
    config, past = engine.config, []
    if engine.rows:
        history = digest_history(engine.stored("dq_check_result").where(F.col("dataset").isin(sorted({r["dataset"] for r in engine.rows}))))
        past = history.collect()
    known = {(r.dataset, r.check_id, r.groups): r for r in past}
    why: dict[str, list[str]] = {}
    for c in engine.cause_rows:
        line = f"{c['cause']} ({c['level']})"
        if line not in why.setdefault(c["evaluation_id"], []):
            why[c["evaluation_id"]].append(line)
    named: dict[str, list[str]] = {}
    sampled = [r["evaluation_id"] for r in engine.rows if r["check_id"] == "HOP_KEY_CURRENCY" and r["state"] == FAILED and config.settings(r["dataset"])["email_sample_keys"]]
    if sampled:
        ordered = Window.partitionBy("evaluation_id").orderBy("key_value")
        keys = engine.stored("dq_key_event").where((F.col("run_id") == engine.run_id) & F.col("evaluation_id").isin(sampled) & (F.col("event") != "CLEARED"))
        for r in keys.withColumn("_n", F.row_number().over(ordered)).where(F.col("_n") <= SAMPLES).collect():
            named.setdefault(r.evaluation_id, []).append(f"{r.key_value} {r.state_detail}")
    items = []
    for r in engine.rows:
        groups = ",".join(f"{k}={v or ''}" for k, v in sorted(r["group_values"].items()))
        h, rule = known.get((r["dataset"], r["check_id"], groups)), config.rules.get(r["check_id"])
        items.append(digest.Item(r["dataset"], r["check_id"], groups, r["state"], h and h.previous_state, h.failed_since if h and r["state"] == FAILED else None, r["observed"], r["expected"], r["reason_code"], r["population"], r["violations"], r["severity"], bool(rule and rule.status == "proposed"), tuple(why.get(r["evaluation_id"], ())), tuple(named.get(r["evaluation_id"], ())), engine.short_slots.get(r["evaluation_id"], ())))
    gone = []
    if items:
        current = engine.spark.createDataFrame([(i.dataset, i.check_id, i.groups, i.state) for i in items], "dataset string, check_id string, groups string, state string")
        gone = [digest.Item(r.dataset, r.check_id, r.groups, r.state) for r in gone_groups(history, current).collect()]
    return [(d, digest.text(d, config.defaults.environment, engine.run_id)) for d in digest.build(config, items, gone)]


def _run(spark: SparkSession, config: Config, args) -> int:
    if args.execution != "NORMAL" and not (args.start and args.end):
        print("a historical run needs --start and --end")
        return 3
    engine = Engine(spark, config, as_utc(args.now or datetime.now(UTC)), args.execution)
    windows = None if args.execution == "NORMAL" else (args.start, args.end)
    try:
        status = engine.run(set(args.feed) if args.feed else None, windows)
    except RuntimeError as e:
        print(e)
        return 3
    d = config.defaults
    for one, body in digests(engine) if windows is None else []:
        if digest.due(d.email.all_clear_digest, one, engine.run_start, d.rule_run_at, d.timezone):
            print(body)
            print(digest.send(d.email, d.recipients.get(one.owner, []), f"Data checks: {one.owner}", body))
    print(f"run {engine.run_id} {status}: {len(engine.rows)} results")
    return 0 if status == "COMPLETED" else 2


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    config = load(args.conf)
    for p in config.problems:
        print(p)
    if config.errors:
        return 3 if args.command == "run" else 1
    if args.command == "validate":
        return 0
    if args.command == "install" and args.mode == "print":
        print(";\n".join(tables.statements(config.defaults.dq_database)) + ";")
        return 0
    spark, db = session(), config.defaults.dq_database
    if args.command == "install":
        if args.mode == "apply":
            tables.install(spark, db)
        found = tables.status(spark, db)
        for t, s in found.items():
            print(f"{t} {s}")
        return 0 if set(found.values()) == {tables.OK} else 1
    if args.command == "dry-run":
        wrong = problems(spark, config)
        print("\n".join(wrong or ["every fragment resolves"]))
        return 1 if wrong else 0
    if args.command == "run":
        return _run(spark, config, args)
    if args.command == "trace":
        engine = Engine(spark, config, datetime.now(UTC))
        found = trace.follow(engine, args.dataset, args.key)
        for _, f in found:
            print(f"{f.dataset}: {f.rows} rows, record {f.record_ts}, load {f.load_ts}, file {f.file}")
        gap = trace.gap(found)
        print("gap: " + " ".join(gap or ["none"]))
        for line in trace.stored_causes(engine, args.key, gap[1], gap[0]) if gap and gap[1] == args.dataset else []:
            print(f"cause: {line}")
        return 0
    if args.command == "watchdog":
        wrong = watchdog.alerts(spark.table(f"{db}.dq_run"), args.now or datetime.now(UTC), config.defaults.watchdog_grace_minutes)
        print("\n".join(wrong or ["in order"]))
        return 1 if wrong else 0
    today = datetime.now(UTC).date()
    for t, months in config.defaults.retention_months.items():
        days = tables.expired(spark, db, t, today, months)
        print(f"{t}: {len(days)} partitions expired")
        if args.apply:
            tables.drop_partitions(spark, db, t, days, today, months)
    return 0


if __name__ == "__main__":
    sys.exit(main())
