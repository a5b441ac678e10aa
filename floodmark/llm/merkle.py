"""Document fingerprints: a Merkle tree over sections, paragraphs and runs of words. DataFrame functions only.

Sections are parted by an empty line, paragraphs by a line end, leaves are runs of eight words with their white space (of
two in the first eight words of a section). Nothing of the text is left out. A leaf's SHA-256 is over its text, a node's
over those of its children in order, each kind with a letter of its own in front, so equal roots mean equal texts. Where
roots differ, differing branches lead to the edits.

As text: root ":" then for each section, parted by "/", its hash and its paragraphs, each ";", hash and leaves, each ",".
There a section or paragraph shows the first 16 hex digits of its hash, a leaf the first 8, a root all 64.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodmark.llm.common import n_partitions
from floodmark.llm.ranges import hash_hex, ordered_hex, range_index, sampled_splitters

EIGHT, TWO = (r"\s*+(?:\S++\s*+){1,%d}+|\s++" % n for n in (8, 2))
#: Ranges of doc_id: about so many bytes each, but a few for each shuffle partition and no more than so many; sorts within a range may spill.
BUCKET_BYTES, BUCKETS_A_PARTITION, MOST_BUCKETS = 64_000_000, 4, 1 << 16


def _over(kind: str, children: Column) -> Column:
    """A node's hash: over its kind and its children's hashes, which all have the same length."""
    return F.sha2(F.concat(F.lit(kind), F.array_join(children, "")), 256)


def _with_hash(kind: str, children: Column, text: Column) -> Column:
    """hash h of a node and its text form t, whose children are evaluated once."""
    return F.struct(_over(kind, children).alias("h"), text.alias("t"))


def _paragraph(line: Column, leading: Column) -> Column:
    """hash of the paragraph over the hashes of its leaves, and the text form of its leaves."""
    runs = F.regexp_extract_all(line, F.lit(EIGHT), F.lit(0))
    finer = F.concat(F.flatten(F.transform(F.slice(runs, 1, 1), lambda r: F.regexp_extract_all(r, F.lit(TWO), F.lit(0)))), F.slice(runs, 2, 1 << 30))
    hashes = F.transform(F.when(leading, finer).otherwise(runs), lambda r: F.sha2(F.concat(F.lit("w"), r), 256))
    return F.transform(F.array(hashes), lambda hs: _with_hash("p", hs, F.array_join(F.transform(hs, lambda h: F.concat(F.lit(","), F.substring(h, 1, 8))), "")))[0]


def _section(section: Column) -> Column:
    parts = F.transform(F.split(section, "\n", -1), lambda line, k: _paragraph(line, k == 0))
    return F.transform(F.array(parts), lambda ps: _with_hash("s", F.transform(ps, lambda p: p["h"]), F.array_join(F.transform(ps, lambda p: F.concat(F.lit(";"), F.substring(p["h"], 1, 16), p["t"])), "")))[0]


def fingerprint(text: Column) -> Column:
    """The tree of a text in text form; null counts as empty. Equal texts have equal fingerprints."""
    sections = F.transform(F.split(F.coalesce(text.cast("string"), F.lit("")), "\n\n", -1), _section)
    whole = F.transform(F.array(sections), lambda ss: _with_hash("d", F.transform(ss, lambda s: s["h"]), F.array_join(F.transform(ss, lambda s: F.concat(F.substring(s["h"], 1, 16), s["t"])), "/")))[0]
    return F.transform(F.array(whole), lambda w: F.concat(w["h"], F.lit(":"), w["t"]))[0]


def root(fp: Column) -> Column:
    return F.substring_index(fp, ":", 1)


def _leaves(fp: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(fp, F.lit(",([0-9a-f]{8})"), F.lit(1)))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots; else twice the common distinct leaves over all distinct leaves of both, below 1; null for a null."""
    both = F.size(_leaves(a)) + F.size(_leaves(b))
    common = 2.0 * F.size(F.array_intersect(_leaves(a), _leaves(b)))
    part = F.when(both > 0, common / both).otherwise(F.lit(0.0))
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(F.least(part, F.lit(1 - 2**-40)))


def edited_branches(a: Column, b: Column) -> Column:
    """Where two trees differ, from the root down: array of section and paragraph numbers from 0 at which either has another
    hash; none for equal roots. A paragraph that only one of them has differs."""

    def sections(fp):
        return F.split(F.substring_index(fp, ":", -1), "/", -1)

    def paragraphs(section):
        return F.slice(F.split(section, ";", -1), 2, 1 << 30)

    nothing = F.array().cast("array<struct<section:int,paragraph:int>>")

    def inside(x, y, k):
        zipped = F.arrays_zip(F.coalesce(paragraphs(x), F.array().cast("array<string>")).alias("x"), F.coalesce(paragraphs(y), F.array().cast("array<string>")).alias("y"))
        marked = F.transform(zipped, lambda p, j: F.struct(k.cast("int").alias("section"), j.cast("int").alias("paragraph"), (~p["x"].eqNullSafe(p["y"])).alias("differs")))
        return F.transform(F.filter(marked, lambda p: p["differs"]), lambda p: F.struct(p["section"].alias("section"), p["paragraph"].alias("paragraph")))

    pairs = F.arrays_zip(sections(a).alias("x"), sections(b).alias("y"))
    found = F.flatten(F.transform(pairs, lambda s, k: F.when(s["x"].eqNullSafe(s["y"]), nothing).otherwise(inside(s["x"], s["y"], k))))
    return F.when(root(a) == root(b), nothing).otherwise(found)


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with `out`, the fingerprint of each row's text. Other columns stay; one called `out` is replaced."""
    return docs.withColumn(out, fingerprint(F.col(text)))


def with_next(docs: DataFrame, carried: list[str], least_buckets: int | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs (doc_id, text) with next_<c> of each c in `carried`: its value in the next row by descending doc_id; after the last
    row comes the first. Null doc_ids come last; repeated doc_ids go by a hash of their text. A single row is its own next.

    Rows are dealt to ranges of doc_id of about equal bytes; each range also gets the first row of the one that follows, so
    the only exchange is the one by range.
    """
    rows = docs.withColumns({"_bytes": F.coalesce(F.octet_length("text"), F.lit(0)) + 64, "_key": F.concat(ordered_hex(F.col("doc_id")), F.lit("-"), hash_hex("text"))})
    slim = rows.select("_key", "_bytes")
    total = slim.agg(F.sum("_bytes")).first()[0] or 0
    if not total:
        return docs.withColumns({f"next_{c}": F.col(c) for c in carried})
    least = least_buckets or BUCKETS_A_PARTITION * n_partitions(docs.sparkSession)
    cut = sampled_splitters(slim, "_key", "_bytes", max(least, min(MOST_BUCKETS, -(-total // bucket_bytes))), total)
    rows = rows.withColumn("_range", range_index(F.col("_key"), cut))
    heads = {r[0]: r[1] for r in slim.groupBy(range_index(F.col("_key"), cut).alias("_range")).agg(F.max("_key")).collect()}  # a key for each range
    held = sorted(heads)
    above = {k: held[(at + 1) % len(held)] for at, k in enumerate(held)}
    goes_to = F.split(F.lit(",".join(str(above.get(k, 0)) for k in range(max(held) + 1))), ",")
    copies = rows.where(F.col("_key").isin(list(heads.values()))).withColumn("_range", F.element_at(goes_to, F.col("_range") + 1).cast("int"))
    all_rows = rows.withColumn("_copy", F.lit(0)).unionByName(copies.withColumn("_copy", F.lit(1)))
    order = Window.partitionBy("_range").orderBy("_copy", F.desc("_key"))
    led = all_rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried})
    return led.where("_copy = 0").drop("_bytes", "_key", "_range", "_copy")
