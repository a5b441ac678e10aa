"""SQL fragments of the configuration, analysed against the tables they are for; nothing is read or written."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodmark.config.loader import Config
from floodmark.config.models import PARAMS, PROBES
from floodmark.config.patterns import probe_keys
from floodmark.plans.outcome import condition_of


def fragments(config: Config) -> Iterator[tuple[str, str, str]]:
    """(where it stands, the table it is for, the fragment)."""
    table = lambda n: config.datasets[n].table if n in config.datasets else None
    for name, ds in config.datasets.items():
        if ds.feed_filter:
            yield f"dataset {name} feed_filter", ds.table, ds.feed_filter
        for up, fragment in ds.hop_exclusions.items():
            if table(up):
                yield f"dataset {name} hop_exclusions.{up}", table(up), fragment
    for name, rule in config.rules.items():
        open_when = getattr(PARAMS[rule.template].model_validate(rule.params), "open_when", None)
        if open_when and table(rule.dataset):
            yield f"rule {name} open_when", table(rule.dataset), open_when
    for name, feed in config.feeds.items():
        keys = probe_keys(feed.pattern)
        for key, raw in feed.probes.items():
            for params in raw if isinstance(raw, list) else [raw] if raw else []:
                p = PROBES[keys[key]].model_validate(params)
                if getattr(p, "condition", None) and p.table:
                    yield f"feed {name} probes.{key}", p.table, p.condition


def analyse(rows: DataFrame, fragment: str) -> str | None:
    """What is wrong with a condition on rows, else None: Catalyst resolves it, no job runs."""
    try:
        kept = rows.where(F.expr(fragment)).limit(0)
        kept.schema  # noqa: B018
    except Exception as e:  # noqa: BLE001
        return f"{type(e).__name__} {condition_of(e)}".strip()
    return None


def problems(spark: SparkSession, config: Config) -> list[str]:
    out = []
    for where, table, fragment in fragments(config):
        if not spark.catalog.tableExists(table):
            out.append(f"{where}: table {table} isn't there")
        elif what := analyse(spark.table(table), fragment):
            out.append(f"{where}: {what}")
    return out
