"""One key through its layers: where it is, at which version, and where it stops."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from floodmark.config.loader import Config
from floodmark.functions.keys import BETWEEN, KeyPart, hash_of
from floodmark.functions.times import as_utc
from floodmark.report.frames import confirmed_causes, trace_layer


@dataclass(frozen=True)
class Layer:
    dataset: str
    parts: list[KeyPart]
    upstreams: list[str]


@dataclass(frozen=True)
class Found:
    dataset: str
    rows: int
    record_ts: datetime | None
    load_ts: datetime | None
    file: str | None


def layers(config: Config, dataset: str) -> list[Layer]:
    """The datasets that a dataset's key maps lead to, sources first, each once, with the key's columns there."""
    out: dict[str, Layer] = {}

    def visit(name: str, columns: list[str]) -> None:
        ds = config.datasets[name]
        for up, mapping in ds.key_map.items():
            if up in config.datasets:
                visit(up, [mapping[c] for c in columns])
        out.setdefault(name, Layer(name, [ds.part(c) for c in columns], list(ds.key_map)))

    visit(dataset, list(config.datasets[dataset].key))
    return list(out.values())


def normalised(spark: SparkSession, parts: list[KeyPart], values: list[str]) -> list[str]:
    """Values as the key's parts write them; one that can't be parsed stays."""
    row = spark.createDataFrame([tuple(values)], ", ".join(f"`{p.column}` string" for p in parts)).select(*[p.value().cast("string").alias(f"v{n}") for n, p in enumerate(parts)]).first()
    return [v if row[n] is None else row[n] for n, v in enumerate(values)]


def follow(engine, dataset: str, values: list[str]) -> list[tuple[Layer, Found]]:
    """engine: floodmark.engine.Engine. One aggregate for each layer."""
    out, chain = [], layers(engine.config, dataset)
    wanted = normalised(engine.spark, chain[-1].parts, values)
    for layer in chain:
        ds = engine.config.datasets[layer.dataset]
        r = trace_layer(engine.relation(layer.dataset), [(p.value(), v) for p, v in zip(layer.parts, wanted)], engine.time(ds.record_time), engine.time(ds.load_time), ds.file_name_column).first()
        out.append((layer, Found(layer.dataset, r.row_count, r.record_ts and as_utc(r.record_ts), r.load_ts and as_utc(r.load_ts), r.file_name)))
    return out


def gap(found: list[tuple[Layer, Found]]) -> tuple[str, str, str] | None:
    """(upstream, dataset, MISSING or STALE) of the first hop, in the order of flow, that the key didn't make whole. Hops
    whose upstream lacks the key say nothing."""
    by = {f.dataset: f for _, f in found}
    for layer, here in found:
        for up in layer.upstreams:
            there = by.get(up)
            if there is None or not there.rows:
                continue
            if not here.rows:
                return up, layer.dataset, "MISSING"
            if here.record_ts and there.record_ts and here.record_ts < there.record_ts:
                return up, layer.dataset, "STALE"
    return None


def stored_causes(engine, values: list[str], dataset: str, upstream: str) -> list[str]:
    """What causes the store has confirmed for a key at a hop, latest first; without a secret there are none."""
    if engine.secret is None:
        return []
    ref = hash_of(engine.secret, BETWEEN.join(normalised(engine.spark, layers(engine.config, dataset)[-1].parts, values)))
    rows = confirmed_causes(engine.stored("dq_cause_result"), engine.stored("dq_check_result"), ref, f"{upstream}->{dataset}").collect()
    return [f"{r.cause_code} in the window to {r.window_end:%Y-%m-%d %H:%M} UTC: {r.evidence}" for r in rows]
