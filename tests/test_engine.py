"""Configuration, store and whole runs over small tables."""

from __future__ import annotations

import textwrap
from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from floodmark.cli import digests, main
from floodmark.config.fragments import analyse, problems
from floodmark.config.loader import load
from floodmark.engine import Engine, Job
from floodmark.plans.identity import Event
from floodmark.plans.outcome import run_check
from floodmark.report import trace, watchdog
from floodmark.report.digest import Digest, Item, build, due, merged, send
from floodmark.sources import landing
from floodmark.store import tables, views
from floodmark.streaming import check_stream

NOW = datetime(2024, 3, 5, 12, 15, tzinfo=UTC)

DEFAULTS = """
    dq_database: dq
    environment: test
    timezone: UTC
    hmac_secret_file: {secret}
    retention_months: {{dq_run: 84, dq_check_result: 84, dq_cause_result: 84, dq_key_event: 84, dq_file: 13}}
    recipients: {{team: [team@example.com]}}
    sla_hours: 2
    min_rows_per_load: 1
    compute_budget_minutes: 5
"""
FEED = """
    feed: sales
    expectation_version: 1
    pattern: FILE_CYCLIC
    owner: team
    landing: {{roots: ["{root}"], file_format: text, file_name_pattern: "*.txt"}}
    cadence: {{kind: interval, interval_minutes: 240, timezone: UTC}}
    datasets: [raw, gold]
    probes:
      load_hold_marker: {{path: "{root}/hold"}}
"""
RAW = """
    dataset: raw
    table: lake.raw
    layer: RAW
    key: [id]
    key_normalise: {id: strip_leading_zeros}
    record_time: {column: rec}
    load_time: {column: loaded, granularity: minute}
    file_name_column: src
"""
GOLD = """
    dataset: gold
    table: lake.gold
    layer: GOLD
    upstream: [raw]
    key: [gid]
    key_unique: true
    record_time: {column: rec}
    load_time: {column: loaded, granularity: minute}
    key_map: {raw: {gid: id}}
    owned_columns: {v: gv}
"""
RULE = """
    rule: one_row
    template: max_rows_per_key
    dataset: gold
    owner: team
    status: approved
    severity: high
    frequency: every_run
"""


@pytest.fixture(scope="module")
def conf(tmp_path_factory):
    folder = tmp_path_factory.mktemp("conf")
    root = folder / "landing"
    root.mkdir()
    for name in ("a.txt", "b.txt", "_hidden.txt", "c.csv"):
        (root / name).write_text("x\n")
    (folder / "secret").write_bytes(b"s3cret")
    for sub, name, text in ((".", "defaults", DEFAULTS.format(secret=folder / "secret")), ("feeds", "sales", FEED.format(root=root)), ("datasets", "raw", RAW), ("datasets", "gold", GOLD), ("rules", "one_row", RULE)):
        (folder / sub).mkdir(exist_ok=True)
        (folder / sub / f"{name}.yaml").write_text(textwrap.dedent(text))
    return folder


@pytest.fixture(scope="module")
def lake(spark):
    t = lambda h: datetime(2024, 3, 5) + timedelta(hours=h)
    spark.sql("CREATE DATABASE IF NOT EXISTS lake")
    raw = [("01", t(0), t(0), "x", "s/a.txt"), ("02", t(1), t(4.5), "y", "s/a.txt"), ("03", t(1), t(8.5), "z", "s/a.txt")]
    gold = [("1", t(0), t(1), "x"), ("2", t(0), t(5), "y"), ("4", t(0), t(9), "w"), ("4", t(0), t(9), "w")]
    spark.createDataFrame(raw, "id string, rec timestamp_ntz, loaded timestamp_ntz, v string, src string").write.mode("overwrite").saveAsTable("lake.raw")
    spark.createDataFrame(gold, "gid string, rec timestamp_ntz, loaded timestamp_ntz, gv string").write.mode("overwrite").saveAsTable("lake.gold")
    spark.sql("DROP DATABASE IF EXISTS dq CASCADE")
    return spark


def test_a_whole_run(lake, conf):
    config = load(conf)
    assert not config.problems
    engine = Engine(lake, config, NOW)
    with pytest.raises(RuntimeError):
        engine.run()
    assert set(tables.status(lake, "dq").values()) == {tables.MISSING}
    tables.install(lake, "dq")
    tables.install(lake, "dq")
    assert set(tables.status(lake, "dq").values()) == {tables.OK}
    assert engine.run() == "COMPLETED"
    state = {(r["dataset"], r["check_id"]): (r["state"], r["violations"] if r["violations"] is not None else r["reason_code"]) for r in engine.rows}
    assert state["gold", "HOP_KEY_CURRENCY"] == ("FAILED", 2)  # 2 is stale, 3 is missing
    assert state["gold", "HOP_VALUE_AGREEMENT"] == ("PASSED", 0)
    assert state["gold", "T1_KEY_DUPLICATES"] == ("FAILED", 1)
    assert state["gold", "one_row"] == ("FAILED", 1)
    assert state["raw", "T1_KEY_NULLS"][0] == "PASSED"
    assert state["raw", "T1_SCHEMA_DRIFT"] == ("DID_NOT_RUN", "insufficient_history")
    assert state["raw", "T1_ON_TIME"][0] == "FAILED"
    events = lake.table("dq.dq_key_event").collect()
    assert {(e.key_value, e.event, e.state_detail) for e in events} == {("2", "FLAGGED", "STALE"), ("3", "FLAGGED", "MISSING")}
    assert views.open_keys(lake.table("dq.dq_key_event")).count() == 2
    assert {r.path.rsplit("/", 1)[1] for r in lake.table("dq.dq_file").collect()} == {"a.txt", "b.txt"}
    causes = lake.table("dq.dq_cause_result").collect()
    assert {c.cause_check_id for c in causes if c.hop} == {"NOT_RUN", "KEY_MISMATCH", "JOIN_UNMATCHED", "TIE_RESOLVED_BY_RULE", "OLDER_VERSION_WRITTEN_LATER", "FILTERED", "REJECTED"}
    assert "OLDER_VERSION_WRITTEN_LATER" in {c.cause_code for c in causes}
    body = "\n".join(b for _, b in digests(engine))
    assert "gold / HOP_KEY_CURRENCY [hop=raw->gold]" in body and "s3cret" not in body
    assert views.latest_run(lake.table("dq.dq_run")).first().status == "COMPLETED"
    # the next run starts where this one ended, and files that didn't change aren't registered again
    later = Engine(lake, config, NOW + timedelta(hours=1))
    assert later.jobs() == ([], []) and later.jobs(changed={"sales"})[0]  # no slot is due in that hour
    jobs, gaps = later.jobs({"sales"})
    assert not gaps and {j.event.start for j in jobs if j.dataset.dataset == "raw"} == {datetime(2024, 3, 5, 12, tzinfo=UTC)}
    assert later.run({"sales"}) == "COMPLETED" and lake.table("dq.dq_file").count() == 2
    kept = {(e.key_value, e.event) for e in lake.table("dq.dq_key_event").where(F.col("run_id") == later.run_id).collect()}
    assert kept == {("2", "STILL_FLAGGED"), ("3", "STILL_FLAGGED")}
    # a rerun of the first window says the same, so it stores nothing, and events stay as they are
    before = lake.table("dq.dq_check_result").count(), lake.table("dq.dq_key_event").count()
    again = Engine(lake, config, NOW + timedelta(hours=2), "RERUN")
    first = lake.table("dq.dq_check_result").where("dataset = 'gold' AND check_id = 'T1_KEY_NULLS'").orderBy("evaluated_at").first()
    again.run(None, (first.window_start.replace(tzinfo=UTC), first.window_end.replace(tzinfo=UTC)))
    assert lake.table("dq.dq_key_event").count() == before[1]
    rerun = lake.table("dq.dq_check_result").where("execution_type = 'RERUN' AND check_id = 'T1_KEY_DUPLICATES'")
    assert rerun.count() == 0
    assert later.retries().count() == 0
    for view, same in (("v_open_keys", views.open_keys(lake.table("dq.dq_key_event"))), ("v_file_status", views.file_status(lake.table("dq.dq_file"))), ("v_latest_run", views.latest_run(lake.table("dq.dq_run"))), ("v_latest_result", views.latest_result(lake.table("dq.dq_check_result")))):
        seen = lake.table(f"dq.{view}")
        assert sorted(seen.columns) == sorted(same.columns)
        key = [c for c in ("run_id", "key_hash", "path", "evaluation_id", "latest_event", "status", "first_flagged_at") if c in same.columns]
        assert sorted(map(tuple, seen.select(*key).collect()), key=str) == sorted(map(tuple, same.select(*key).collect()), key=str), view


def test_preconditions(lake, conf, monkeypatch):
    """A check whose table, column or catalog isn't there says so, before it reads anything."""
    config = load(conf)
    engine = Engine(lake, config, NOW)
    gold, feed = config.datasets["gold"], config.feed_of("gold")
    event = Event("gold", NOW - timedelta(hours=4), NOW)

    def reason(check, ds=gold):
        found, _ = run_check(lake, lambda: engine.evaluate(Job(ds, feed, check, event)), 5)
        return [(r.state, r.reason) for r in found]

    off = gold.model_copy(update={"key": ["nope"]})
    monkeypatch.setitem(config.datasets, "gold", off)
    assert reason("T1_KEY_DUPLICATES", off) == [("DID_NOT_RUN", "column_missing")]
    away = gold.model_copy(update={"table": "lake.nowhere"})
    monkeypatch.setitem(config.datasets, "gold", away)
    assert reason("T1_KEY_NULLS", away) == [("DID_NOT_RUN", "table_missing")]
    monkeypatch.setitem(config.datasets, "gold", gold)
    monkeypatch.setitem(config.datasets, "raw", config.datasets["raw"].model_copy(update={"key": ["id"], "record_time": config.datasets["raw"].record_time.model_copy(update={"column": "gone"})}))
    found, _ = run_check(lake, lambda: engine.evaluate(Job(gold, feed, "HOP_KEY_CURRENCY", event)), 5)
    assert [(r.reason, r.groups) for r in found] == [("column_missing", {"hop": "raw->gold"})]
    assert run_check(lake, lambda: engine.evaluate(Job(gold, feed, "HOP_FILE_COMPLETENESS", event)), 5)[0] == []

    def broken(*a, **k):
        raise ConnectionError("no metastore")

    monkeypatch.setattr(type(lake.catalog), "tableExists", broken)
    assert reason("T1_KEY_NULLS") == [("DID_NOT_RUN", "metastore_unavailable")]


def test_history_looks_back_as_far_as_it_must(lake, conf):
    tables.install(lake, "dq")
    engine = Engine(lake, load(conf), NOW + timedelta(days=200))
    before = lake.table("dq.dq_check_result").where("dataset = 'raw' AND execution_type = 'NORMAL' AND severity IS NULL").agg(F.max("window_end")).first()[0]
    assert before is None or engine.history(["raw"])["raw"].previous_end.replace(tzinfo=None) <= before


def test_trace_finds_the_gap(lake, conf):
    engine = Engine(lake, load(conf), NOW)
    assert trace.gap(trace.follow(engine, "gold", ["3"])) == ("raw", "gold", "MISSING")
    assert trace.gap(trace.follow(engine, "gold", ["2"])) == ("raw", "gold", "STALE")
    assert trace.gap(trace.follow(engine, "gold", ["1"])) is None


def test_command_line(lake, conf, capsys):
    assert main(["--conf", str(conf), "validate"]) == 0
    assert main(["--conf", str(conf), "dry-run"]) == 0
    assert main(["--conf", str(conf), "install", "check"]) == 0
    assert main(["--conf", str(conf), "trace", "gold", "3"]) == 0
    assert main(["--conf", str(conf), "trace", "gold", "2"]) == 0
    said = capsys.readouterr().out
    assert "cause: OLDER_VERSION_WRITTEN_LATER" in said
    assert "gap: raw gold MISSING" in said
    assert main(["--conf", str(conf), "retention"]) == 0


def test_problems_have_lines(conf, tmp_path):
    import shutil

    bad = tmp_path / "conf"
    shutil.copytree(conf, bad)
    (bad / "datasets/gold.yaml").write_text(textwrap.dedent(GOLD).replace("raw: {gid: id}", "raw: {gid: nope}") + "key_unique: false\nsurprise: 1\n")
    found = {p.where: p.line for p in load(bad).problems}
    assert found["surprise"] == 13 and found["key_unique"] == 12
    (bad / "datasets/gold.yaml").write_text(textwrap.dedent(GOLD).replace("raw: {gid: id}", "raw: {gid: nope}"))
    assert [(p.where, p.line) for p in load(bad).errors] == [("key_map.raw", 10)]
    (bad / "datasets/raw.yaml").write_text(textwrap.dedent(RAW) + "upstream: [gold]\n")
    assert sum(p.what == "leads back to itself" for p in load(bad).errors) == 2


def test_fragments_are_only_analysed(lake, conf):
    assert problems(lake, load(conf)) == []
    assert analyse(lake.table("lake.raw"), "nothing = 1").endswith("UNRESOLVED_COLUMN.WITH_SUGGESTION")
    assert analyse(lake.table("lake.raw"), "id = '1'") is None


def test_retention_keeps_what_it_must(lake):
    tables.install(lake, "dq")
    assert tables.months_before(date(2024, 3, 31), 1) == date(2024, 2, 29)
    old = date(2020, 1, 1)
    tables.append_values(lake, "dq", "dq_file", [{"path": "p", "run_date": old}])
    days = tables.expired(lake, "dq", "dq_file", date(2024, 3, 5), 13)
    assert days == [old]
    with pytest.raises(ValueError):
        tables.drop_partitions(lake, "dq", "dq_file", [date(2024, 3, 1)], date(2024, 3, 5), 13)
    tables.drop_partitions(lake, "dq", "dq_file", days, date(2024, 3, 5), 13)
    assert tables.expired(lake, "dq", "dq_file", date(2024, 3, 5), 13) == []
    with pytest.raises(ValueError):
        tables.append(lake, "dq", "dq_file", lake.range(1))


def test_landing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "X1.txt").write_text("<a/>\n")
    (tmp_path / "in" / "x2.txt").write_text("")
    assert [r.path.rsplit("/", 1)[1] for r in landing.listing(spark, [str(tmp_path)], "X*.txt").collect()] == ["X1.txt"]
    with pytest.raises(landing.Unreadable):
        landing.listing(spark, [str(tmp_path / "nowhere")])
    path = str(tmp_path / "in" / "X1.txt")
    assert landing.readable(spark, path, "xml") and not landing.readable(spark, str(tmp_path / "in" / "x2.txt"), "text") and not landing.readable(spark, path, "parquet")
    (tmp_path / "log").write_text("ERROR loading X1.txt\nok x2.txt\ncursor=20240301\n")
    assert len(landing.log_files_with(spark, str(tmp_path / "log"), "ERROR", "X1.txt")) == 1
    assert landing.log_files_with(spark, str(tmp_path / "log"), "ERROR", "x2.txt") == []
    assert landing.value_in(spark, str(tmp_path / "log"), r"cursor=(\d+)") == "20240301"


def _parts(folder):
    """A landing root with a file, a table in parts, one in folders by a value, one in a folder of its own, and what is not landed."""
    for name in ("orders.parquet", "_left.parquet", "words.parquet/part-0.parquet", "words.parquet/part-1", "words.parquet/_SUCCESS", "days.parquet/day=1/part-0.parquet", "days.parquet/day=2/part-0.parquet", "deep/items.parquet", "started.parquet/_SUCCESS", "notes.txt"):
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text("four")
    (folder / "empty.parquet").mkdir()
    return str(folder)


def test_tables_in_parts_are_listed_once(spark, tmp_path):
    """A table written as a folder of part files was once listed by its parts."""
    from floodmark.run_queries import QUERIES

    root = _parts(tmp_path / "x.parquet")
    names = ["days.parquet", "items.parquet", "orders.parquet", "words.parquet"]
    for at in (root, root + "/"):
        found = landing.listing(spark, [at], "*.parquet", tables=True)
        assert sorted((r.path.rsplit("/", 1)[1], r.size_bytes) for r in found.collect()) == list(zip(names, (8, 4, 4, 8), strict=True))
        assert found.columns == landing.listing(spark, [at]).columns and found.where("modified_at is null").isEmpty()
        assert sorted(r.file for r in QUERIES["landing_listing"](spark, at).collect()) == names
    assert landing.listing(spark, [root, root], "*.parquet", tables=True).agg({"size_bytes": "sum"}).first()[0] == 24
    assert [r.size_bytes for r in landing.listing(spark, [root + "/orders.parquet"], "*.parquet", tables=True).collect()] == [4]
    assert sorted(r.path.rsplit("/", 1)[1] for r in landing.listing(spark, [root], "*.parquet").collect()) == ["items.parquet", "orders.parquet"] + ["part-0.parquet"] * 3


def test_tables_in_parts_match_a_glob(spark, tmp_path):
    """A table written as a folder of part files was once not found by a glob, nor by its own name."""
    from floodmark.run_queries import QUERIES

    root = _parts(tmp_path / "x.parquet")
    (tmp_path / "x.parquet" / "begins.parquet" / "_temporary" / "0").mkdir(parents=True)
    (tmp_path / "x.parquet" / "begins.parquet" / "_temporary" / "0" / "part-0.parquet").write_text("four")
    for at in (root, root + "/"):
        assert sorted(tuple(r) for r in QUERIES["landing_paths"](spark, at).collect()) == [("*s.parquet", True, 3), ("nothing.parquet", False, 0), ("orders.parquet", True, 1)]
    assert [p.rsplit("/", 1)[1] for p in landing.matching(spark, f"{root}/*s.parquet", tables=True)] == ["days.parquet", "orders.parquet", "words.parquet"]
    assert [p.rsplit("/", 1)[1] for p in landing.matching(spark, f"{root}/*s.parquet")] == ["orders.parquet"]
    assert sorted(tuple(r) for r in QUERIES["landing_paths"](spark, root + "/words.parquet").collect()) == [("*s.parquet", False, 0), ("nothing.parquet", False, 0), ("orders.parquet", False, 0)]
    (tmp_path / "x.parquet" / "_by=1.parquet" / "_day=1").mkdir(parents=True)
    (tmp_path / "x.parquet" / "_by=1.parquet" / "_day=1" / "part-0").write_text("four")
    (tmp_path / "x.parquet" / "_by=1.parquet" / "_day=1" / "_a=1").write_text("four")
    assert len(landing.matching(spark, f"{root}/_by*", tables=True)) == 1


def test_watchdog(spark):
    cols = "run_id string, started_at timestamp, ended_at timestamp, status string, checks_expected int, checks_written int, investigations_expected int, investigations_done int, execution_type string, run_date date"
    row = lambda i, status, written=1, kind="NORMAL": (i, datetime(2024, 3, 5, 11, 5), None, status, 1, written, 0, 0, kind, date(2024, 3, 5))
    say = lambda rows: watchdog.alerts(spark.createDataFrame(rows, cols), datetime(2024, 3, 5, 12, 10, tzinfo=UTC), 30)
    assert len(say([])) == 1 and "no run" in say([row("r", "COMPLETED", kind="REPLAY")])[0]
    assert "not ended" in say([row("r", "STARTED")])[0] and say([row("r", "STARTED"), row("r", "COMPLETED", kind=None)]) == []
    assert "0 of 1 checks" in say([row("r", "PARTIAL", 0)])[0]


def test_digest_merges_and_sends_nothing_without_a_server(conf):
    config = load(conf)
    late, empty = Item("raw", "T1_ON_TIME", "", "FAILED", slots=("1", "2")), Item("raw", "T1_ZERO_ROWS", "", "FAILED", slots=("1",))
    assert merged([late, empty]) == [late] and merged([empty]) == [empty]
    out = build(config, [late, Item("gold", "c", "", "PASSED", "FAILED"), Item("gold", "r", "", "FAILED", proposed=True), Item("gold", "x", "", "DID_NOT_RUN", reason="insufficient_history")])
    assert len(out) == 1 and (len(out[0].failing), len(out[0].recovered), len(out[0].proposed), len(out[0].not_run)) == (1, 1, 1, 0)
    clear = Digest("team")
    assert due("every_run", clear, NOW, "06:00", "UTC") and not due("never", clear, NOW, "06:00", "UTC") and due("daily", clear, NOW, "12:00", "UTC")
    assert send(config.defaults.email, ["a@b.c"], "", "").startswith("not sent")


def test_streams_use_the_same_operators(spark, sf_dir, tmp_path):
    from floodmark.functions.keys import KeyPart
    from floodmark.operators.tier1 import key_duplicates

    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    source.write.parquet(str(tmp_path / "in"))
    seen = []
    q = check_stream(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")), lambda b: key_duplicates(b, [KeyPart("event_id")]), lambda rows, n: seen.extend((n, r.population) for r in rows.collect()), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sum(p for _, p in seen) == source.count()
