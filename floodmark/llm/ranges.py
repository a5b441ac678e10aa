"""Ranges of an ordered string key, from splitters drawn out of a size-weighted sample; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys drawn for each range: what the driver holds is about this times the number of ranges, whatever the data's size.
SAMPLE_PER_RANGE = 8


def ordered_hex(number: Column) -> Column:
    """A long as 16 hex digits whose order as text is that of the numbers; null comes first."""
    return F.coalesce(F.lpad(F.hex(number.cast("long").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))), 16, "0"), F.lit(""))


def hash_hex(*columns) -> Column:
    return F.lpad(F.hex(F.xxhash64(*columns)), 16, "0")


def sampled_splitters(df: DataFrame, key: str, size: str, ranges: int, total: int) -> list[str]:
    """At most ranges - 1 keys that cut df into ranges of about equal size.

    A row is drawn with a probability in proportion to its size, decided by a hash of its key; rows over a share of
    the total are always drawn and weigh what they are.
    """
    share = max(1.0, total / (ranges * SAMPLE_PER_RANGE))
    chance = (F.xxhash64(F.lit("draw"), key).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)) * share
    drawn = df.where(chance < F.col(size)).select(key, F.greatest(F.col(size).cast("double"), F.lit(share)).alias("w")).collect()
    drawn = sorted((r[0], r[1]) for r in drawn)
    whole, done, out = sum(w for _, w in drawn), 0.0, []
    for k, w in drawn:
        if done + w / 2 >= whole * (len(out) + 1) / ranges and (not out or k > out[-1]):
            out.append(k)
        done += w
    return out[: ranges - 1]


def range_index(key: Column, splitters: list[str]) -> Column:
    """The number of splitters that are at most key, looked up in two steps of about the root of their number."""
    if not splitters:
        return F.lit(0)
    step = math.isqrt(len(splitters)) + 1
    coarse = F.split(F.lit(",".join(splitters[step - 1 :: step])), ",") if len(splitters) >= step else F.array().cast("array<string>")
    fine = F.split(F.lit(",".join(splitters)), ",")
    block = F.size(F.filter(coarse, lambda s: s <= key)) * step
    return block + F.size(F.filter(F.slice(fine, block + 1, step), lambda s: s <= key))


