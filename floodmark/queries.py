"""Every operator as a query over the test tables, with the SQL that it must agree with."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floodmark.functions.keys import KeyPart, canonical, keyed_hash
from floodmark.functions.times import TimeColumn, loaded_within, truncated, utc, within
from floodmark.operators import causes, hops, rules, tier1
from floodmark.plans.cadence import Cadence, slots
from floodmark.report import frames
from floodmark.sources.relation import UNMATCHED, Derived, Lookup, Source, derive
from floodmark.store import views

START, END, SLA = datetime(2024, 1, 10), datetime(2024, 1, 12), timedelta(hours=8)
SLOTS = slots(Cadence(kind="interval", interval_minutes=240, timezone="UTC"), datetime(2024, 1, 9, 16), datetime(2024, 1, 11, 16))
TS = TimeColumn("ts")
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def clock(column: str) -> Column:
    return utc(TimeColumn(column))


# -- one table

@query("""SELECT l_returnflag AS g_1, count(*) AS population, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS violations
FROM (SELECT l_orderkey, l_linenumber, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1""")
def t1_key_duplicates(spark, sf_dir):
    return tier1.key_duplicates(read(spark, sf_dir, "lineitem"), [KeyPart("l_orderkey"), KeyPart("l_linenumber")], ["l_returnflag"])


@query("""SELECT CAST(user_id % 4 AS VARCHAR) AS g_1, count(*) AS population, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS violations
FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12' GROUP BY 1""")
def t1_key_nulls(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumns({"kind": F.nullif("event_type", F.lit("error")), "quarter": F.col("user_id") % 4})
    return tier1.key_nulls(rows, TS, ["user_id", "kind"], START, END, ["quarter"])


_LOADS = """WITH s AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-09 16:00:00', TIMESTAMP '2024-01-11 12:00:00', INTERVAL 4 HOUR)) AS slot),
l AS (SELECT slot, count(ts) AS loaded FROM s LEFT JOIN events ON ts >= slot AND ts < slot + INTERVAL 8 HOUR GROUP BY 1) """


@query(_LOADS + "SELECT strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, loaded FROM l")
def t1_slot_loads(spark, sf_dir):
    return tier1.slot_loads(read(spark, sf_dir, "events"), TS, SLOTS, SLA).select(text("slot").alias("slot"), "loaded")


def _due(spark, sf_dir, least):
    found = tier1.due_loads(read(spark, sf_dir, "events"), TS, SLOTS, SLA, least)
    return found.select("population", "violations", F.array_join(F.transform("short_slots", text), ",").alias("short_slots"))


_DUE = _LOADS + "SELECT count(*) AS population, CAST(sum(CASE WHEN loaded < {n} THEN 1 ELSE 0 END) AS BIGINT) AS violations, coalesce(string_agg(strftime(slot, '%Y-%m-%d %H:%M:%S'), ',' ORDER BY slot) FILTER (WHERE loaded < {n}), '') AS short_slots FROM l"


@query(_DUE.format(n=1))
def t1_on_time(spark, sf_dir):
    return _due(spark, sf_dir, 1)


@query(_DUE.format(n=110))
def t1_zero_rows(spark, sf_dir):
    return _due(spark, sf_dir, 110)


@query("""WITH c AS (SELECT time_bucket(INTERVAL 4 HOUR, ts) AS slot, count(*) AS n FROM events GROUP BY 1),
k AS (SELECT strftime(slot, '%H:%M') AS label, slot, n FROM c),
h AS (SELECT label, n FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY slot DESC) AS r FROM k WHERE slot < TIMESTAMP '2024-01-20') WHERE r <= 14),
s AS (SELECT label, count(*) AS loads, quantile_cont(n, 0.5) AS median_rows FROM h GROUP BY 1)
SELECT k.label AS g_1, strftime(slot, '%Y-%m-%d %H:%M:%S') AS g_2, n AS row_count, coalesce(loads, 0) AS loads, median_rows, median_rows * (1 - 0.25) AS low, median_rows * (1 + 0.25) AS high,
CAST(CASE WHEN coalesce(loads, 0) < 7 THEN NULL WHEN n BETWEEN median_rows * (1 - 0.25) AND median_rows * (1 + 0.25) THEN 0 ELSE 1 END AS INTEGER) AS outside
FROM k LEFT JOIN s USING (label) WHERE slot >= TIMESTAMP '2024-01-20' AND slot < TIMESTAMP '2024-01-22'""")
def t1_volume(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    every = slots(Cadence(kind="interval", interval_minutes=240, timezone="UTC"), datetime(2024, 1, 20), datetime(2024, 1, 22))
    periods = [tier1.Period(s.strftime("%H:%M"), s.strftime("%Y-%m-%d %H:%M:%S"), s, s + timedelta(hours=4)) for s in every]
    start = F.window(F.col("ts").cast("timestamp"), "4 hours")["start"]
    past = events.where(clock("ts") < F.lit("2024-01-20").cast("timestamp")).groupBy(start.alias("slot")).agg(F.count(F.lit(1)).alias("row_count")).withColumn("label", F.date_format("slot", "HH:mm"))
    return tier1.volume(events, TS, periods, tier1.last_loads(past, "slot"), 0.25)


@query("""SELECT sha256('o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_totalprice:double,o_orderdate:timestamp_ntz,o_orderpriority:string') AS digest, CAST(3 AS BIGINT) AS violations, 'o_orderpriority' AS added, 'o_gone' AS removed, 'o_custkey' AS retyped""")
def t1_schema_drift(spark, sf_dir):
    schema = read(spark, sf_dir, "orders").schema
    known = {n: t for n, t in tier1.columns_of(schema).items() if n != "o_orderpriority"}
    drift = tier1.schema_drift(schema, {**known, "o_custkey": "int", "o_gone": "string"})
    return spark.createDataFrame([(drift.digest, drift.violations, *(",".join(x) for x in (drift.added, drift.removed, drift.retyped)))], "digest string, violations long, added string, removed string, retyped string")


def _landed(orders: DataFrame) -> DataFrame:
    return orders.select("*", F.concat(F.lit("s3/"), "o_orderstatus", F.lit("/f_"), F.date_format("o_orderdate", "yyyyMM"), F.lit(".csv")).alias("path"))


_PATH = "'s3/' || o_orderstatus || '/f_' || strftime(o_orderdate, '%Y%m') || '.csv'"


@query(f"""WITH f AS (SELECT {_PATH} AS path, min(o_orderdate) AS seen FROM orders GROUP BY 1),
r AS (SELECT regexp_extract({_PATH}, '([^/]+)$', 1) AS f, count(*) AS n FROM orders WHERE o_totalprice > 480000 GROUP BY 1),
j AS (SELECT path, coalesce(n, 0) AS n FROM f LEFT JOIN r ON r.f = regexp_extract(path, '([^/]+)$', 1) WHERE seen < TIMESTAMP '1998-01-01')
SELECT count(*) AS population, CAST(sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) AS BIGINT) AS violations,
array_to_string(list_sort(coalesce(list(path) FILTER (WHERE n = 0), []))[1:100], ',') AS not_loaded FROM j""")
def t1_files_not_loaded(spark, sf_dir):
    orders = _landed(read(spark, sf_dir, "orders"))
    registry = orders.select("path", clock("o_orderdate").alias("first_seen_at"))
    found = tier1.files_not_loaded(registry, orders.where("o_totalprice > 480000"), "path", datetime(1998, 1, 1))
    return found.select("population", "violations", F.array_join("not_loaded", ",").alias("not_loaded"))


# -- rules

@query("""SELECT count(*) AS population, CAST(sum(CASE WHEN n > 7 THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)""")
def rule_max_rows_per_key(spark, sf_dir):
    return rules.max_rows_per_key(read(spark, sf_dir, "lineitem"), [KeyPart("l_orderkey")], 7)


@query("""SELECT count(*) AS population, CAST(sum(CASE WHEN n > 3 THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM (SELECT l_orderkey, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS n FROM lineitem GROUP BY 1)""")
def rule_max_open_rows_per_key(spark, sf_dir):
    return rules.max_open_rows_per_key(read(spark, sf_dir, "lineitem"), [KeyPart("l_orderkey")], "l_linestatus = 'O'", 3)


def _order_lines(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))


@query("""SELECT l_returnflag AS g_1, count(*) AS population, CAST(sum(CASE WHEN l_shipdate < o_orderdate THEN 1 ELSE 0 END) AS BIGINT) AS violations
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate IS NOT NULL AND o_orderdate IS NOT NULL GROUP BY 1""")
def rule_column_order(spark, sf_dir):
    return rules.column_order(_order_lines(spark, sf_dir), "o_orderdate", "l_shipdate", groups=["l_returnflag"])


@query("""SELECT count(*) AS population, CAST(sum(CASE WHEN e IS NULL OR e < ts THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM (SELECT ts, CASE WHEN event_type <> 'error' THEN ts END AS e FROM events)""")
def rule_column_order_nulls_fail(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("e", F.when(F.col("event_type") != "error", F.col("ts")))
    return rules.column_order(rows, "ts", "e", nulls_fail=True)


@query("""SELECT count(*) AS population, CAST(sum(CASE WHEN o_orderdate < m THEN 1 ELSE 0 END) AS BIGINT) AS violations
FROM (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE o_orderstatus = 'O'""")
def rule_superseded_still_open(spark, sf_dir):
    return rules.superseded_still_open(read(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderstatus = 'O'")


@query("""SELECT count(*) AS population, CAST(sum(CASE WHEN l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 90 DAY THEN 0 ELSE 1 END) AS BIGINT) AS violations
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def rule_child_within_parent(spark, sf_dir):
    return rules.child_within_parent(read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders"), [("l_orderkey", "o_orderkey")], F.col("l_shipdate"), F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS"))


@query("""SELECT p_type AS g_1, count(*) AS population, CAST(sum(CASE WHEN regexp_matches(p_brand, '^Brand#\\d{2}$') THEN 0 ELSE 1 END) AS BIGINT) AS violations FROM part WHERE p_brand IS NOT NULL GROUP BY 1""")
def rule_value_format(spark, sf_dir):
    return rules.value_format(read(spark, sf_dir, "part"), "p_brand", r"^Brand#\d{2}$", ["p_type"])


@query("""SELECT lang AS g_1, count(*) AS population, CAST(sum(CASE WHEN quality IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls,
CAST(CASE WHEN sum(CASE WHEN quality IS NULL THEN 1 ELSE 0 END) / count(*) > 0.6 THEN 1 ELSE 0 END AS BIGINT) AS violations FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def rule_null_rate_max(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return rules.null_rate_max(rows, "quality", 0.6, ["lang"])


# -- hops

HOP_START, HOP_END = datetime(1997, 1, 1), datetime(1997, 7, 1)


def _hop(spark, sf_dir, **more) -> hops.Hop:
    up, dn = _landed(read(spark, sf_dir, "orders")), read(spark, sf_dir, "lineitem")
    return hops.Hop(
        up=hops.Side(up, canonical([KeyPart("o_orderkey")]), clock("o_orderdate"), clock("o_orderdate"), F.col("path"), (F.col("o_totalprice").cast("decimal(18,2)"),), lambda a, b: loaded_within(TimeColumn("o_orderdate"), a, b)),
        dn=hops.Side(dn, canonical([KeyPart("l_orderkey")]), clock("l_shipdate"), clock("l_shipdate"), bounds=lambda a, b: loaded_within(TimeColumn("l_shipdate"), a, b)),
        **{"start": HOP_START, "end": HOP_END, "sla": SLA} | more,
    )


_STATES = """WITH u AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, max(o_orderdate) AS ur FROM orders {where} GROUP BY 1),
d AS (SELECT CAST(l_orderkey AS VARCHAR) AS k, max(l_shipdate) AS dr, max(CASE WHEN l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-07-01' THEN 1 ELSE 0 END) AS l FROM lineitem GROUP BY 1),
j AS (SELECT u.k, CASE WHEN d.k IS NULL THEN 'MISSING' WHEN dr < ur THEN 'STALE' ELSE 'CURRENT' END AS s, ur, dr FROM u LEFT JOIN d USING (k) WHERE {judged}) """
_SWEEP = "ur < TIMESTAMP '1997-06-30 16:00:00'"
_WINDOW = "(ur >= TIMESTAMP '1996-12-31 16:00:00' AND ur < TIMESTAMP '1997-06-30 16:00:00') OR (l = 1 AND ur < TIMESTAMP '1997-06-30 16:00:00')"
_SUMMARY = """SELECT count(*) AS population, CAST(sum(CASE WHEN s <> 'CURRENT' THEN 1 ELSE 0 END) AS BIGINT) AS violations, CAST(sum(CASE WHEN s = 'MISSING' THEN 1 ELSE 0 END) AS BIGINT) AS missing,
CAST(sum(CASE WHEN s = 'STALE' THEN 1 ELSE 0 END) AS BIGINT) AS stale, CAST(0 AS BIGINT) AS unassessable, (SELECT count(*) FROM u WHERE ur >= TIMESTAMP '1997-06-30 16:00:00') AS pending, CAST({excluded} AS BIGINT) AS excluded FROM j"""


@query(_STATES.format(where="", judged=_SWEEP) + _SUMMARY.format(excluded=0))
def hop_key_currency_sweep(spark, sf_dir):
    return hops.currency(hops.assess(_hop(spark, sf_dir, full_sweep=True)))


@query(_STATES.format(where="", judged=_WINDOW) + _SUMMARY.format(excluded=0))
def hop_key_currency(spark, sf_dir):
    return hops.currency(hops.assess(_hop(spark, sf_dir)))


@query(_STATES.format(where="WHERE o_orderpriority <> '5-LOW'", judged=_WINDOW) + _SUMMARY.format(excluded="(SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING min(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) = 1 AND max(o_orderdate) >= TIMESTAMP '1996-12-31 16:00:00' AND max(o_orderdate) < TIMESTAMP '1997-06-30 16:00:00'))"))
def hop_exclusions(spark, sf_dir):
    return hops.currency(hops.assess(_hop(spark, sf_dir, excluded=F.expr("o_orderpriority = '5-LOW'"))))


@query(_STATES.format(where="", judged=_WINDOW) + "SELECT k AS key_value, 'FLAGGED' AS event, s AS state_detail FROM j WHERE s <> 'CURRENT'")
def hop_key_events(spark, sf_dir):
    return hops.key_events(hops.assess(_hop(spark, sf_dir))).drop("key_hash")


@query(_STATES.format(where="", judged=f"({_WINDOW}) OR CAST(k AS BIGINT) % 97 = 0 AND CAST(k AS BIGINT) <= 1000") + """SELECT k AS key_value, CASE WHEN s = 'CURRENT' THEN 'CLEARED' WHEN CAST(k AS BIGINT) % 97 = 0 AND CAST(k AS BIGINT) <= 1000 THEN 'STILL_FLAGGED' ELSE 'FLAGGED' END AS event, s AS state_detail
FROM j WHERE s <> 'CURRENT' OR (CAST(k AS BIGINT) % 97 = 0 AND CAST(k AS BIGINT) <= 1000)""")
def hop_open_key_events(spark, sf_dir):
    flagged = spark.range(0, 1001, 97).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("key_hash"), F.col("id").cast("string").alias("key_value"))
    hop = _hop(spark, sf_dir, open_keys=flagged, hashed=lambda k: F.concat(F.lit("h"), k))
    return hops.key_events(hops.assess(hop), hop.hashed).drop("key_hash")


def _totals(spark, sf_dir) -> DataFrame:
    lines = Source("lines", read(spark, sf_dir, "lineitem"), "l_returnflag <> 'X'")
    return derive(Derived(lines, [], None, {"order_key": "lines.l_orderkey"}, {"total": "SUM(CAST(lines.l_extendedprice AS DECIMAL(18,2)))"}, TimeColumn("l_shipdate"), TimeColumn("l_shipdate")))


@query("""WITH t AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total, max(l_shipdate) AS ts FROM lineitem GROUP BY 1),
j AS (SELECT CAST(total AS DECIMAL(18,2)) = CAST(o_totalprice AS DECIMAL(18,2)) AS same FROM t JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= ts)
SELECT count(*) AS population, CAST(sum(CASE WHEN same THEN 0 ELSE 1 END) AS BIGINT) AS violations FROM j""")
def hop_value_agreement(spark, sf_dir):
    up = hops.Side(_totals(spark, sf_dir), canonical([KeyPart("order_key")]), F.col("record_ts"), F.col("load_ts"), values=(F.col("total").cast("decimal(18,2)"),))
    dn = hops.Side(read(spark, sf_dir, "orders"), canonical([KeyPart("o_orderkey")]), clock("o_orderdate"), clock("o_orderdate"), values=(F.col("o_totalprice").cast("decimal(18,2)"),))
    return hops.agreement(hops.Hop(up, dn, HOP_START, datetime(2030, 1, 1), SLA, full_sweep=True))


_FILES = f"""WITH u AS (SELECT regexp_extract({_PATH}, '([^/]+)$', 1) AS f, sum(CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE 1 END) AS ur, sum(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) AS x, min(o_orderdate) AS a FROM orders GROUP BY 1),
d AS (SELECT regexp_extract({_PATH}, '([^/]+)$', 1) AS f, count(*) AS dr FROM orders WHERE o_totalprice < 400000 GROUP BY 1),
j AS (SELECT u.f, ur, x, coalesce(dr, 0) AS dr FROM u LEFT JOIN d USING (f) WHERE a < TIMESTAMP '1997-06-30 16:00:00') """


def _files(spark, sf_dir, **more) -> hops.Hop:
    up = _landed(read(spark, sf_dir, "orders"))
    key = canonical([KeyPart("o_orderkey")])
    at = clock("o_orderdate")
    return hops.Hop(hops.Side(up, key, at, at, F.col("path")), hops.Side(up.where("o_totalprice < 400000"), key, at, at, F.col("path")), HOP_START, HOP_END, SLA, **more)


@query(_FILES + """SELECT CAST(sum(CASE WHEN ur > 0 THEN 1 ELSE 0 END) AS BIGINT) AS population, CAST(sum(CASE WHEN ur > 0 AND dr < ur THEN 1 ELSE 0 END) AS BIGINT) AS violations,
array_to_string(list_sort(coalesce(list(f || ':' || ur || ':' || dr) FILTER (WHERE ur > 0 AND dr < ur), []))[1:100], ',') AS short, CAST(sum(x) AS BIGINT) AS excluded, (SELECT count(*) FROM u WHERE a >= TIMESTAMP '1997-06-30 16:00:00') AS pending FROM j""")
def hop_file_completeness(spark, sf_dir):
    found = hops.completeness(_files(spark, sf_dir, full_sweep=True, excluded=F.expr("o_orderpriority = '5-LOW'")))
    listed = F.array_join(F.transform("short", lambda s: F.concat_ws(":", s["f"], s["up_rows"].cast("string"), s["dn_rows"].cast("string"))), ",")
    return found.withColumn("short", listed)


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS VARCHAR) AS total, count(DISTINCT c_mktsegment) AS segments, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS record_ts,
CASE WHEN count(*) FILTER (WHERE c_custkey IS NULL) > 0 THEN 'c' ELSE '' END || CASE WHEN count(*) FILTER (WHERE c_custkey IS NULL) > 0 AND count(*) FILTER (WHERE n_nationkey IS NULL) > 0 THEN ',' ELSE '' END || CASE WHEN count(*) FILTER (WHERE n_nationkey IS NULL) > 0 THEN 'n' ELSE '' END AS unmatched
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey WHERE o_orderstatus <> 'P' GROUP BY 1""")
def derived_relation(spark, sf_dir):
    spec = Derived(
        Source("o", read(spark, sf_dir, "orders")),
        [Lookup(Source("c", read(spark, sf_dir, "customer"), "c_acctbal > 0"), [("o.o_custkey", "c.c_custkey")]), Lookup(Source("n", read(spark, sf_dir, "nation"), "n_nationkey < 20"), [("c.c_nationkey", "n.n_nationkey")])],
        "o.o_orderstatus <> 'P'",
        {"month": "date_format(o.o_orderdate, 'yyyy-MM')"},
        {"orders": "COUNT(*)", "total": "CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS STRING)", "segments": "COUNT(DISTINCT c.c_mktsegment)"},
        TimeColumn("o_orderdate"),
        TimeColumn("o_orderdate"),
    )
    return derive(spec).select("month", "orders", "total", "segments", text("record_ts").alias("record_ts"), F.array_join(UNMATCHED, ",").alias("unmatched"))


@query("""SELECT strftime(o_orderdate, '%Y') AS year, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey AND c_mktsegment = 'BUILDING' GROUP BY 1""")
def derived_inner(spark, sf_dir):
    spec = Derived(Source("o", read(spark, sf_dir, "orders")), [Lookup(Source("c", read(spark, sf_dir, "customer"), "c_mktsegment = 'BUILDING'"), [("o.o_custkey", "c.c_custkey")], "inner")], None, {"year": "date_format(o.o_orderdate, 'yyyy')"}, {"orders": "COUNT(*)"})
    return derive(spec).select("year", "orders")


_SECRET = b"test secret"
_INNER, _OUTER = (bytes(b ^ pad for b in _SECRET.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))  # as HMAC pads its key


@query(f"""SELECT c_custkey, sha256(from_hex('{_OUTER}') || from_hex(sha256(from_hex('{_INNER}') || encode(CAST(c_custkey AS VARCHAR) || '|' || regexp_replace(c_name, '^0+', ''))))) AS key_hash FROM customer""")
def key_hash(spark, sf_dir):
    customer = read(spark, sf_dir, "customer")
    return customer.select("c_custkey", keyed_hash(_SECRET)(canonical([KeyPart("c_custkey"), KeyPart("c_name", strip_leading_zeros=True)])).alias("key_hash"))


@query("""SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) || '|' || coalesce(regexp_replace(nullif(o_orderstatus, 'P'), '^0+', ''), '<null>') || '|' || strftime(o_orderdate, '%Y-%m-%d') AS k FROM orders""")
def canonical_key(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").withColumns({"s": F.nullif("o_orderstatus", F.lit("P")), "d": F.date_format("o_orderdate", "MM/dd/yyyy")})
    return rows.select("o_orderkey", canonical([KeyPart("o_orderkey"), KeyPart("s", strip_leading_zeros=True), KeyPart("d", parse_date="MM/dd/yyyy")]).alias("k"))


# -- causes

@query("""SELECT strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') AS max_load FROM lineitem WHERE l_returnflag = 'R'""")
def cause_not_run(spark, sf_dir):
    return causes.latest_load(read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'"), clock("l_shipdate")).select(text("max_load").alias("max_load"))


_FACTS = f"""WITH u AS (SELECT regexp_extract({_PATH}, '([^/]+)$', 1) AS f, min(o_orderdate) AS a, count(*) AS up_rows, CAST(sum(CASE WHEN o_custkey % 50 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS invalid_rows FROM orders GROUP BY 1),
d AS (SELECT regexp_extract({_PATH}, '([^/]+)$', 1) AS f, count(*) AS n FROM orders WHERE month(o_orderdate) <> 3 GROUP BY 1), t AS (SELECT u.f, a, up_rows, invalid_rows, coalesce(n, 0) AS rows_here FROM u LEFT JOIN d USING (f)) """


def _facts(spark, sf_dir) -> DataFrame:
    up = _landed(read(spark, sf_dir, "orders")).withColumn("part", F.when(F.col("o_custkey") % 50 != 0, F.col("o_custkey")))
    key, at = canonical([KeyPart("o_orderkey")]), clock("o_orderdate")
    hop = hops.Hop(hops.Side(up, key, at, at, F.col("path")), hops.Side(up.where("month(o_orderdate) <> 3"), key, at, at, F.col("path")), HOP_START, HOP_END, SLA)
    return causes.file_facts(hop, [KeyPart("o_orderkey"), KeyPart("part")])


@query(_FACTS + "SELECT f, strftime(a, '%Y-%m-%d %H:%M:%S') AS first_load, up_rows, invalid_rows, rows_here FROM t")
def cause_invalid_key(spark, sf_dir):
    return _facts(spark, sf_dir).withColumn("first_load", text("first_load"))


@query(_FACTS + "SELECT t.f, count(*) AS later_files FROM t JOIN t AS l ON l.a > t.a AND l.rows_here > 0 WHERE t.rows_here = 0 GROUP BY 1")
def cause_file_skipped(spark, sf_dir):
    return causes.skipped_files(_facts(spark, sf_dir))


@query("""SELECT DISTINCT CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) AS k FROM lineitem l WHERE l_linenumber > 5 AND EXISTS (SELECT 1 FROM lineitem d WHERE d.l_linenumber <= 5 AND d.l_orderkey = l.l_orderkey)""")
def cause_key_mismatch(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    key = [KeyPart("l_orderkey"), KeyPart("l_linenumber")]
    failing = rows.where("l_linenumber > 5").select(canonical(key).alias("k"))
    return causes.key_mismatch(rows, key, rows.where("l_linenumber <= 5"), key, 1, failing)


@query("""SELECT CAST(o_custkey AS VARCHAR) AS k, 'c' AS unmatched FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey WHERE o_custkey % 3 = 0 GROUP BY 1 HAVING count(*) FILTER (WHERE c_custkey IS NULL) > 0""")
def cause_join_unmatched(spark, sf_dir):
    spec = Derived(Source("o", read(spark, sf_dir, "orders")), [Lookup(Source("c", read(spark, sf_dir, "customer"), "c_acctbal > 0"), [("o.o_custkey", "c.c_custkey")])], None, {"cust": "o.o_custkey"}, {"orders": "COUNT(*)"})
    failing = read(spark, sf_dir, "orders").where("o_custkey % 3 = 0").select(F.col("o_custkey").cast("string").alias("k"))
    return causes.unmatched_joins(derive(spec), canonical([KeyPart("cust")]), failing).select("k", F.array_join("unmatched", ",").alias("unmatched"))


@query("""WITH t AS (SELECT o_custkey AS k, o_orderkey, CAST(o_orderpriority AS VARCHAR) AS v, date_trunc('year', o_orderdate) AS r FROM orders WHERE o_custkey <= 300),
m AS (SELECT *, max(r) OVER (PARTITION BY k) AS top FROM t), x AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o_orderkey DESC) AS rn, count(*) OVER (PARTITION BY k) AS tied FROM m WHERE r = top),
d AS (SELECT o_custkey AS k, CAST(o_orderpriority AS VARCHAR) AS v FROM orders QUALIFY date_trunc('year', o_orderdate) = max(date_trunc('year', o_orderdate)) OVER (PARTITION BY o_custkey))
SELECT CAST(x.k AS VARCHAR) AS k, max(tied) AS tied, count(DISTINCT x.v) AS variants, CAST(max(CASE WHEN rn = 1 AND x.v = d.v THEN 1 ELSE 0 END) AS INTEGER) AS winner_here FROM x LEFT JOIN d ON d.k = x.k WHERE tied > 1 GROUP BY x.k""")
def cause_ties(spark, sf_dir):
    rows = read(spark, sf_dir, "orders")
    at = F.date_trunc("year", clock("o_orderdate"))
    side = hops.Side(rows, canonical([KeyPart("o_custkey")]), at, at, values=(F.col("o_orderpriority"),))
    failing = rows.where("o_custkey <= 300").select(F.col("o_custkey").cast("string").alias("k"))
    return causes.ties(hops.Hop(side, side, HOP_START, HOP_END, SLA), [F.desc("o_orderkey")], failing)


@query(_STATES.format(where="", judged=_SWEEP) + "SELECT k FROM j WHERE s = 'STALE' AND date_trunc('day', ur) > date_trunc('day', dr)")
def cause_older_written_later(spark, sf_dir):
    assessed = hops.judge(_hop(spark, sf_dir, full_sweep=True))
    swapped = assessed.withColumns({"dn_load_ts": F.col("up_load_ts"), "up_load_ts": F.col("dn_load_ts")})  # a stale row loaded after the newer one
    return causes.older_written_later(swapped, "day", "UTC")


@query("""SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS ref FROM lineitem WHERE (l_discount > 0.09)""")
def cause_table_contains(spark, sf_dir):
    return causes.table_refs(read(spark, sf_dir, "lineitem"), "l_discount > 0.09", canonical([KeyPart("l_orderkey")]))


@query(f"""SELECT path, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS first_seen_at, count(DISTINCT size) AS sizes, max(n) AS raw_rows FROM (SELECT {_PATH} AS path, o_orderdate, CAST(o_orderkey % 3 AS BIGINT) AS size FROM orders)
LEFT JOIN (SELECT regexp_extract({_PATH}, '([^/]+)$', 1) AS f, count(*) AS n FROM orders GROUP BY 1) ON f = regexp_extract(path, '([^/]+)$', 1) GROUP BY 1""")
def cause_size_changed(spark, sf_dir):
    orders = _landed(read(spark, sf_dir, "orders"))
    registry = orders.select("path", clock("o_orderdate").alias("first_seen_at"), (F.col("o_orderkey") % 3).alias("size_bytes"))
    return causes.landed(registry, orders, "path").withColumn("first_seen_at", text("first_seen_at"))


@query("""SELECT count(*) AS loaded FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'""")
def cause_no_upstream_data(spark, sf_dir):
    return causes.rows_loaded(read(spark, sf_dir, "events"), clock("ts"), START, END)


@query(f"""WITH f AS (SELECT {_PATH} AS path, min(o_orderdate) AS a FROM orders GROUP BY 1), p AS (SELECT min(path) AS path FROM f), x AS (SELECT a FROM f JOIN p USING (path))
SELECT count(*) AS later_files, count(*) AS loaded FROM f, x WHERE f.a >= x.a AND f.path <> (SELECT path FROM p)""")
def cause_pipeline_stalled(spark, sf_dir):
    orders = _landed(read(spark, sf_dir, "orders"))
    registry = orders.select("path", clock("o_orderdate").alias("first_seen_at"), F.lit(1).alias("size_bytes"))
    return causes.stalled(causes.landed(registry, orders, "path"), registry.agg(F.min("path")).first()[0])


# -- the store's views, over rows made of events

def _results(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events")
    state = F.expr("CASE event_type WHEN 'click' THEN 'PASSED' WHEN 'error' THEN 'DID_NOT_RUN' ELSE 'FAILED' END")
    return e.select(
        F.concat(F.lit("e"), (F.col("event_id") % 500).cast("string")).alias("event_id"), F.concat(F.lit("r"), (F.col("event_id") % 40).cast("string")).alias("run_id"),
        F.concat(F.lit("d"), (F.col("user_id") % 20).cast("string")).alias("dataset"), F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("check_id"),
        F.date_trunc("day", clock("ts")).alias("window_start"), (F.date_trunc("day", clock("ts")) + F.expr("INTERVAL 1 DAY")).alias("window_end"), clock("ts").alias("evaluated_at"),
        state.alias("state"), F.when(state == "DID_NOT_RUN", F.expr("CASE WHEN event_id % 2 = 0 THEN 'PLATFORM' ELSE 'CONFIGURATION' END")).alias("reason_category"), F.lit("why").alias("reason_code"),
        F.lit("NORMAL").alias("execution_type"), F.when(F.col("event_id") % 10 == 9, F.lit("high")).alias("severity"), F.create_map(F.lit("g"), (F.col("event_id") % 2).cast("string")).alias("group_values"),
    )


_R = """WITH r AS (SELECT 'e' || (event_id % 500) AS event_id, 'r' || (event_id % 40) AS run_id, 'd' || (user_id % 20) AS dataset, 'c' || (user_id % 3) AS check_id, date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, ts AS evaluated_at,
CASE event_type WHEN 'click' THEN 'PASSED' WHEN 'error' THEN 'DID_NOT_RUN' ELSE 'FAILED' END AS state, CASE WHEN event_id % 2 = 0 THEN 'PLATFORM' ELSE 'CONFIGURATION' END AS cat, CASE WHEN event_id % 10 = 9 THEN 'high' END AS severity, event_id % 2 AS g FROM events) """


@query(_R + """SELECT dataset, check_id, run_id, state, strftime(evaluated_at, '%Y-%m-%d %H:%M:%S') AS evaluated_at FROM (SELECT *, dense_rank() OVER (PARTITION BY dataset, check_id ORDER BY window_end DESC, evaluated_at DESC, run_id DESC) AS k FROM r) WHERE k = 1""")
def v_latest_result(spark, sf_dir):
    return views.latest_result(_results(spark, sf_dir)).select("dataset", "check_id", "run_id", "state", text("evaluated_at").alias("evaluated_at"))


def _runs(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.concat(F.lit("r"), (F.col("event_id") % 40).cast("string")).alias("run_id"), F.expr("CASE WHEN event_type = 'click' THEN 'STARTED' WHEN event_id % 40 < 4 THEN 'PARTIAL' ELSE 'COMPLETED' END").alias("status")).agg(F.max(clock("ts")).alias("ended_at"))


_RUNS = """u AS (SELECT 'r' || (event_id % 40) AS run_id, CASE WHEN event_type = 'click' THEN 'STARTED' WHEN event_id % 40 < 4 THEN 'PARTIAL' ELSE 'COMPLETED' END AS status, max(ts) AS ended_at FROM events GROUP BY 1, 2),
v AS (SELECT run_id, status, ended_at FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN status = 'STARTED' THEN 0 ELSE 1 END DESC, ended_at DESC) AS k FROM u) WHERE k = 1) """


@query("WITH " + _RUNS + "SELECT run_id, status, strftime(ended_at, '%Y-%m-%d %H:%M:%S') AS ended_at FROM v")
def v_latest_run(spark, sf_dir):
    return views.latest_run(_runs(spark, sf_dir)).withColumn("ended_at", text("ended_at"))


@query(_R + ", " + _RUNS + """, e AS (SELECT dataset, event_id, min(window_start) AS a, max(window_end) AS b, max(CASE WHEN (state = 'DID_NOT_RUN' AND cat = 'PLATFORM') OR coalesce(status, 'COMPLETED') <> 'COMPLETED' THEN 1 ELSE 0 END) AS held FROM r LEFT JOIN v USING (run_id) WHERE severity IS NULL GROUP BY 1, 2),
g AS (SELECT dataset, max(CASE WHEN held = 0 THEN b END) AS p FROM e GROUP BY 1)
SELECT g.dataset, strftime(p, '%Y-%m-%d %H:%M:%S') AS previous_end, strftime(min(a), '%Y-%m-%d %H:%M:%S') AS held_start, strftime(min(b), '%Y-%m-%d %H:%M:%S') AS first_held_end, strftime(max(b), '%Y-%m-%d %H:%M:%S') AS last_held_end
FROM g LEFT JOIN e ON e.dataset = g.dataset AND held = 1 AND (p IS NULL OR b > p) GROUP BY g.dataset, p""")
def window_history(spark, sf_dir):
    found = views.window_history(_results(spark, sf_dir), _runs(spark, sf_dir))
    return found.select("dataset", *[text(c).alias(c) for c in ("previous_end", "held_start", "first_held_end", "last_held_end")])


@query("""WITH e AS (SELECT 'h' || (user_id % 500) AS key_hash, event_type, CASE event_type WHEN 'click' THEN 'CLEARED' WHEN 'view' THEN 'FLAGGED' ELSE 'STILL_FLAGGED' END AS event, ts, event_id FROM events),
c AS (SELECT *, max(CASE WHEN event = 'CLEARED' THEN ts END) OVER (PARTITION BY key_hash) AS lc FROM e),
k AS (SELECT *, min(CASE WHEN event <> 'CLEARED' AND (lc IS NULL OR ts > lc) THEN ts END) OVER (PARTITION BY key_hash) AS ff, row_number() OVER (PARTITION BY key_hash ORDER BY ts DESC, event_id DESC) AS rn FROM c)
SELECT key_hash, event AS latest_event, strftime(ff, '%Y-%m-%d %H:%M:%S') AS first_flagged_at, strftime(ts, '%Y-%m-%d %H:%M:%S') AS last_observed_at FROM k WHERE rn = 1 AND event <> 'CLEARED'""")
def v_open_keys(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    rows = e.select(F.lit("d").alias("dataset"), F.lit("c").alias("check_id"), F.lit("a->b").alias("hop"), F.concat(F.lit("h"), (F.col("user_id") % 500).cast("string")).alias("key_hash"), F.expr("CASE event_type WHEN 'click' THEN 'CLEARED' WHEN 'view' THEN 'FLAGGED' ELSE 'STILL_FLAGGED' END").alias("event"), clock("ts").alias("observed_at"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("run_id"), F.lit("s").alias("state_detail"), F.lit("x").alias("evaluation_id"))
    return views.open_keys(rows).select("key_hash", "latest_event", text("first_flagged_at").alias("first_flagged_at"), text("last_observed_at").alias("last_observed_at"))


@query(f"""SELECT path, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS first_seen_at, arg_max(o_orderkey, o_orderkey) AS latest_size_bytes FROM (SELECT {_PATH} AS path, * FROM orders) GROUP BY 1""")
def v_file_status(spark, sf_dir):
    orders = _landed(read(spark, sf_dir, "orders"))
    rows = orders.select("path", F.lit("f").alias("feed"), clock("o_orderdate").alias("first_seen_at"), F.col("o_orderkey").alias("size_bytes"), clock("o_orderdate").alias("modified_at"), F.timestamp_seconds("o_orderkey").alias("observed_at"), F.lit("r").alias("run_id"))
    return views.file_status(rows).select("path", text("first_seen_at").alias("first_seen_at"), "latest_size_bytes")


@query(_R + """, k AS (SELECT *, 'g=' || g AS groups, row_number() OVER w AS rn, max(CASE WHEN state <> 'FAILED' THEN evaluated_at END) OVER (PARTITION BY dataset, check_id, g) AS sound FROM r WINDOW w AS (PARTITION BY dataset, check_id, g ORDER BY window_end DESC, evaluated_at DESC, run_id DESC))
SELECT dataset, check_id, groups, max(state) FILTER (WHERE rn = 1) AS state, max(state) FILTER (WHERE rn = 2) AS previous_state, strftime(min(evaluated_at) FILTER (WHERE state = 'FAILED' AND (sound IS NULL OR evaluated_at > sound)), '%Y-%m-%d %H:%M:%S') AS failed_since FROM k GROUP BY 1, 2, 3""")
def digest_history(spark, sf_dir):
    return frames.digest_history(_results(spark, sf_dir)).drop("run_id").withColumn("failed_since", text("failed_since"))


@query("""SELECT count(*) AS row_count, strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') AS record_ts, arg_max(l_returnflag, l_shipdate) AS file_name FROM lineitem WHERE l_orderkey = 7""")
def trace_layer(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("file", F.concat(F.lit("a/"), "l_returnflag"))
    return frames.trace_layer(rows, [(F.col("l_orderkey"), "7")], clock("l_shipdate"), clock("l_shipdate"), "file").select("row_count", text("record_ts").alias("record_ts"), "file_name")


@query("""SELECT event_id, strftime(((ts AT TIME ZONE 'America/Chicago') AT TIME ZONE 'UTC'), '%Y-%m-%d %H:%M:%S') AS utc FROM events""")
def utc_expr(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", text(utc(TimeColumn("ts", timezone="America/Chicago"))).alias("utc"))


@query("""SELECT event_id, strftime((date_trunc('day', (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago') AT TIME ZONE 'America/Chicago') AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS day FROM events""")
def granularity(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", text(truncated(clock("ts"), "day", "America/Chicago")).alias("day"))


@query("""SELECT strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-09 16:00:00', TIMESTAMP '2024-01-11 12:00:00', INTERVAL 4 HOUR)) AS slot)""")
def cadence_slots(spark, sf_dir):
    return spark.createDataFrame([(s.strftime("%Y-%m-%d %H:%M:%S"),) for s in SLOTS], "slot string")


@query("""SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'""")
def half_open_window(spark, sf_dir):
    return read(spark, sf_dir, "events").where(within(clock("ts"), START, END)).agg(F.count(F.lit(1)).alias("n"))
