"""The store's tables: their schemas, installing and checking them, appending and dropping old partitions."""

from __future__ import annotations

import re
from calendar import monthrange
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The columns of each table, after which run_date partitions it.
COLUMNS: dict[str, str] = {
    "dq_run": "run_id string, started_at timestamp, ended_at timestamp, engine_version string, config_commit string, status string, checks_expected int, checks_written int, investigations_expected int, investigations_done int, execution_type string",
    "dq_check_result": "evaluation_id string, run_id string, event_id string, window_start timestamp, window_end timestamp, execution_type string, feed string, dataset string, check_id string, expectation_version int, state string, reason_category string, reason_code string, population bigint, violations bigint, observed string, expected string, group_values map<string,string>, severity string, evaluated_at timestamp, duration_ms bigint, detail string",
    "dq_cause_result": "run_id string, evaluation_id string, failure_ref string, hop string, cause_check_id string, order_no int, state string, cause_code string, evidence string, evaluated_at timestamp",
    "dq_key_event": "run_id string, evaluation_id string, dataset string, check_id string, hop string, key_hash string, key_value string, event string, state_detail string, observed_at timestamp",
    "dq_file": "path string, feed string, first_seen_at timestamp, size_bytes bigint, modified_at timestamp, observed_at timestamp, run_id string",
}
TABLES = tuple(COLUMNS)
#: The views for SQL users, as in store.views: latest rows by maxima of structs, no window where an aggregate does.
VIEWS: dict[str, str] = {
    "v_latest_run": "SELECT r.* FROM (SELECT max_by(struct(*), struct(status <> 'STARTED', ended_at)) AS r FROM {db}.dq_run GROUP BY run_id)",
    "v_latest_result": "SELECT * EXCEPT (_rank) FROM (SELECT *, dense_rank() OVER (PARTITION BY dataset, check_id ORDER BY window_end DESC, evaluated_at DESC, run_id DESC) AS _rank FROM {db}.dq_check_result) WHERE _rank = 1",
    "v_open_keys": """
        WITH last AS (
          SELECT dataset, check_id, hop, key_hash, max(struct(observed_at, run_id, event, state_detail, evaluation_id)) AS e, max(CASE WHEN event = 'CLEARED' THEN observed_at END) AS cleared_at
          FROM {db}.dq_key_event GROUP BY dataset, check_id, hop, key_hash
        ), spell AS (
          SELECT v.dataset, v.check_id, v.hop, v.key_hash, min(v.observed_at) AS first_flagged_at
          FROM {db}.dq_key_event v JOIN last l ON v.dataset = l.dataset AND v.check_id = l.check_id AND v.hop = l.hop AND v.key_hash = l.key_hash
          WHERE v.event <> 'CLEARED' AND l.e.event <> 'CLEARED' AND (l.cleared_at IS NULL OR v.observed_at > l.cleared_at)
          GROUP BY v.dataset, v.check_id, v.hop, v.key_hash
        )
        SELECT l.dataset, l.check_id, l.hop, l.key_hash, l.e.event AS latest_event, l.e.state_detail, s.first_flagged_at, l.e.observed_at AS last_observed_at, l.e.run_id, l.e.evaluation_id
        FROM last l LEFT JOIN spell s ON s.dataset = l.dataset AND s.check_id = l.check_id AND s.hop = l.hop AND s.key_hash = l.key_hash
        WHERE l.e.event <> 'CLEARED'""",
    "v_file_status": """
        SELECT path, e.feed, first_seen_at, e.size_bytes AS latest_size_bytes, e.modified_at AS latest_modified_at, e.observed_at AS last_observed_at
        FROM (SELECT path, min(first_seen_at) AS first_seen_at, max(struct(observed_at, run_id, feed, size_bytes, modified_at)) AS e FROM {db}.dq_file GROUP BY path)""",
}
OK, MISSING, DIFFERS = "OK", "MISSING", "DIFFERS"
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def checked_name(name: str) -> str:
    if not _NAME.fullmatch(name):
        raise ValueError(f"{name!r} is no plain identifier")
    return name


def schema_of(spark: SparkSession, table: str) -> StructType:
    return StructType.fromDDL(f"{COLUMNS[table]}, run_date date")


def statements(database: str) -> list[str]:
    """What installs the store; running it again changes nothing."""
    database = checked_name(database)
    out = [f"CREATE DATABASE IF NOT EXISTS {database}"]
    out += [f"CREATE TABLE IF NOT EXISTS {database}.{t} ({c}, run_date date) USING orc PARTITIONED BY (run_date)" for t, c in COLUMNS.items()]
    return out + [f"CREATE VIEW IF NOT EXISTS {database}.{v} AS {q.format(db=database).strip()}" for v, q in VIEWS.items()]


def install(spark: SparkSession, database: str) -> None:
    for s in statements(database):
        spark.sql(s)


def status(spark: SparkSession, database: str) -> dict[str, str]:
    """OK, MISSING or DIFFERS of each table (its columns or partitioning) and view (its text, whatever its white space)."""
    out = {}
    for t in TABLES:
        full = f"{checked_name(database)}.{t}"
        if not spark.catalog.tableExists(full):
            out[t] = MISSING
            continue
        found = {f.name: f.dataType.simpleString() for f in spark.table(full).schema.fields}
        wanted = {f.name: f.dataType.simpleString() for f in schema_of(spark, t).fields}
        parts = [c.name for c in spark.catalog.listColumns(full) if c.isPartition]
        out[t] = OK if found == wanted and parts == ["run_date"] else DIFFERS
    for v, query in VIEWS.items():
        full = f"{checked_name(database)}.{v}"
        if not spark.catalog.tableExists(full):
            out[v] = MISSING
        elif all(out[t] == OK for t in TABLES):
            stored = next((r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {full}").collect() if r.col_name == "View Text"), "")
            out[v] = OK if " ".join(stored.split()) == " ".join(query.format(db=database).split()) else DIFFERS
        else:
            out[v] = DIFFERS
    return out


def append(spark: SparkSession, database: str, table: str, rows: DataFrame) -> None:
    """Rows with exactly the table's columns, in any order."""
    wanted = schema_of(spark, table).fieldNames()
    if sorted(rows.columns) != sorted(wanted):
        raise ValueError(f"{table} takes {sorted(wanted)}, not {sorted(rows.columns)}")
    rows.select(*wanted).write.mode("append").insertInto(f"{checked_name(database)}.{table}")


def append_values(spark: SparkSession, database: str, table: str, rows: list[dict]) -> None:
    """A few rows from the driver; columns that a row lacks are null."""
    if rows:
        schema = schema_of(spark, table)
        append(spark, database, table, spark.createDataFrame([tuple(r.get(c) for c in schema.fieldNames()) for r in rows], schema))


def new_files(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Of a landing listing (path, size_bytes, modified_at, observed_at and others), the paths that are new, or whose size or time
    changed since last seen; first_seen_at stays what it was. known is the file view."""
    seen = known.select("path", F.col("first_seen_at").alias("_first"), "latest_size_bytes", "latest_modified_at")
    found = listing.join(seen, "path", "left")
    new = F.col("_first").isNull() | ~F.col("size_bytes").eqNullSafe(F.col("latest_size_bytes")) | ~F.col("modified_at").eqNullSafe(F.col("latest_modified_at"))
    return found.where(new).withColumn("first_seen_at", F.coalesce("_first", "observed_at")).drop("_first", "latest_size_bytes", "latest_modified_at")


def months_before(day: date, months: int) -> date:
    """The same day so many months earlier, or the last day of a shorter month."""
    total = day.year * 12 + day.month - 1 - months
    year, month = divmod(total, 12)
    return date(year, month + 1, min(day.day, monthrange(year, month + 1)[1]))


def expired(spark: SparkSession, database: str, table: str, today: date, months: int) -> list[date]:
    """Partitions older than the retention, oldest first."""
    limit = months_before(today, months)
    days = [date.fromisoformat(r[0].partition("=")[2]) for r in spark.sql(f"SHOW PARTITIONS {checked_name(database)}.{checked_name(table)}").collect()]
    return sorted(d for d in days if d < limit)


def drop_partitions(spark: SparkSession, database: str, table: str, days: list[date], today: date, months: int) -> None:
    """Drops the days given; refuses if any is within the retention."""
    limit = months_before(today, months)
    if kept := [d for d in days if d >= limit]:
        raise ValueError(f"{kept[0]} is within the retention of {table}")
    for d in days:
        spark.sql(f"ALTER TABLE {checked_name(database)}.{checked_name(table)} DROP IF EXISTS PARTITION (run_date = DATE '{d.isoformat()}')")
