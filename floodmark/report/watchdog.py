"""Whether the hourly run came, ended, and did all it set out to do."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodmark.functions.times import as_utc, stamp
from floodmark.store.views import latest_run


def alerts(runs: DataFrame, now: datetime, grace_minutes: int) -> list[str]:
    """Only the partitions of the hour in question are read. Historical runs say nothing; a run without an execution type is a
    NORMAL one."""
    hour = (as_utc(now) - timedelta(minutes=grace_minutes)).replace(minute=0, second=0, microsecond=0)
    days = [hour.date(), (hour + timedelta(hours=1)).date()]
    rows = runs.where(F.col("run_date").isin(days) & (F.coalesce("execution_type", F.lit("NORMAL")) == "NORMAL") & (F.col("started_at") >= stamp(hour)) & (F.col("started_at") < stamp(hour + timedelta(hours=1))))
    found = latest_run(rows).collect()
    if not found:
        return [f"no run started in the hour from {hour:%Y-%m-%d %H:%M} UTC"]
    out = []
    for r in sorted(found, key=lambda r: r.started_at):
        if r.status == "STARTED":
            out.append(f"run {r.run_id} started and has not ended")
        elif r.status == "FAILED" or (r.checks_written or 0) < (r.checks_expected or 0):
            out.append(f"run {r.run_id} {r.status}: {r.checks_written or 0} of {r.checks_expected or 0} checks stored")
        elif (r.investigations_done or 0) < (r.investigations_expected or 0):
            out.append(f"run {r.run_id}: {r.investigations_done or 0} of {r.investigations_expected or 0} failures investigated")
    return out
