"""Which checks run for a pattern of arrival, and which causes explain their failures, in order."""

from __future__ import annotations

from dataclasses import dataclass

# Checks by pattern.
ARRIVAL = ["T1_ON_TIME", "T1_ZERO_ROWS", "T1_VOLUME"]
STORED = ["T1_SCHEMA_DRIFT", "T1_KEY_NULLS", "T1_KEY_DUPLICATES"]
HOPS = ["HOP_FILE_COMPLETENESS", "HOP_KEY_CURRENCY", "HOP_VALUE_AGREEMENT"]
CHECKS: dict[str, list[str]] = {
    "FILE_CYCLIC": [*ARRIVAL, "T1_FILES_NOT_LOADED", *STORED, *HOPS],
    "FILE_PERIODIC": [*ARRIVAL, "T1_FILES_NOT_LOADED", *STORED, *HOPS],
    "TABLE_MERGE": [*ARRIVAL, *STORED, *HOPS],
    "TABLE_WIDE": STORED,
}


@dataclass(frozen=True)
class Cause:
    """A cause code, the probe that looks for it, and the feed's probe key with its parameters."""

    code: str
    probe: str = "builtin"
    params: str | None = None


@dataclass(frozen=True)
class FailureType:
    checks: tuple[str, ...]
    order: tuple[Cause, ...]
    fallback: str


# Causes by failure type.
FAILURES: dict[str, FailureType] = {
    "file_not_loaded": FailureType(
        ("T1_FILES_NOT_LOADED", "T1_ON_TIME"),
        (Cause("RAW_LOAD_HELD", "file_exists", "load_hold_marker"), Cause("PIPELINE_STALLED"), Cause("SKIPPED_BEHIND_CURSOR", "file_value_compare", "partition_cursor"), Cause("INCOMPLETE_AT_LOAD", "size_changed"), Cause("UNREADABLE"), Cause("LOAD_ERROR", "log_contains", "load_log")),
        "PASSED_OVER",
    ),
    "rows_missing_between_layers": FailureType(
        ("HOP_FILE_COMPLETENESS",),
        (Cause("NOT_RUN"), Cause("FILE_SKIPPED"), Cause("INVALID_KEY"), Cause("FILTERED", "table_contains", "filter_rules"), Cause("REJECTED", "table_contains", "rejects")),
        "DROPPED",
    ),
    "key_missing_or_stale": FailureType(
        ("HOP_KEY_CURRENCY", "HOP_VALUE_AGREEMENT"),
        (Cause("NOT_RUN"), Cause("KEY_MISMATCH"), Cause("JOIN_UNMATCHED"), Cause("TIE_RESOLVED_BY_RULE"), Cause("OLDER_VERSION_WRITTEN_LATER"), Cause("FILTERED", "table_contains", "filter_rules"), Cause("REJECTED", "table_contains", "rejects")),
        "MERGE_NOT_APPLIED",
    ),
    "load_wrote_nothing": FailureType(("T1_ZERO_ROWS",), (Cause("WRONG_PARTITION", "file_value_compare", "partition_cursor"), Cause("NO_UPSTREAM_DATA")), "EMPTY_LOAD"),
}


def failure_type(check_id: str, pattern: str) -> FailureType | None:
    """Merge tables land no files, so theirs can be neither unloaded nor skipped; table-wide failures have no causes."""
    if pattern == "TABLE_WIDE":
        return None
    for name, kind in FAILURES.items():
        if check_id in kind.checks:
            if pattern == "TABLE_MERGE":
                if name == "file_not_loaded":
                    return None
                return FailureType(kind.checks, tuple(c for c in kind.order if c.code != "FILE_SKIPPED"), kind.fallback)
            return kind
    return None


def probe_keys(pattern: str) -> dict[str, str]:
    """Probe keys that a feed of this pattern may set, with their probe."""
    kinds = [failure_type(k.checks[0], pattern) for k in FAILURES.values()]
    return {c.params: c.probe for k in kinds if k for c in k.order if c.params}
