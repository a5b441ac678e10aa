"""Keys that compare alike in every layer, and their keyed hashes."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_PART, BETWEEN = "<null>", "|"


@dataclass(frozen=True)
class KeyPart:
    """A key column and how it is normalised: leading zeros stripped, or a date written in ISO form."""

    column: str
    strip_leading_zeros: bool = False
    parse_date: str | None = None

    def value(self) -> Column:
        """The normalised part, null if it can't be parsed."""
        raw = F.col(self.column)
        if self.parse_date:
            parsed = F.try_to_timestamp(raw.cast("string"), F.lit(self.parse_date))
            return F.date_format(parsed.cast("date"), "yyyy-MM-dd")
        if self.strip_leading_zeros:
            return F.regexp_replace(raw.cast("string"), "^0+", "")
        return raw


def canonical(parts: list[KeyPart]) -> Column:
    """One string for a key. Null parts are equal to each other. Parts aren't escaped, as in the layers' own keys."""
    return F.concat_ws(BETWEEN, *[F.coalesce(p.value().cast("string"), F.lit(NULL_PART)) for p in parts])


def blank(column: str | Column) -> Column:
    """Null, empty or white space, as stored."""
    c = F.col(column) if isinstance(column, str) else column
    return c.isNull() | (F.trim(c.cast("string")) == "")


def unusable(part: KeyPart) -> Column:
    """Blank, or without a normalised value."""
    return blank(part.column) | part.value().isNull()


def hash_of(secret: bytes, key: str) -> str:
    return hmac.new(secret, key.encode(), hashlib.sha256).hexdigest()


def keyed_hash(secret: bytes):
    """HMAC-SHA256 of a key string in hex. The secret stays in the function's closure, out of plans and SQL text."""

    @F.pandas_udf("string")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in batches:
            yield keys.map(lambda k: None if k is None else hash_of(secret, k))

    return hashed


def base_name(path: str | Column) -> Column:
    """What stands behind the last slash; empty if nothing does; null stays null."""
    return F.regexp_extract(F.col(path) if isinstance(path, str) else path, "([^/]+)$", 1)
