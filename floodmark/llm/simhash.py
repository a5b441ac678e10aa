"""SimHash near duplicates through an inverted index over byte positions.

Two 64-bit fingerprints that differ in at most 4 bits share at least 4 of their 8 positional bytes. Any 4 of 8 positions
hold one of the 20 position triples of `TRIPLES`, so a fingerprint is posted under its bytes at each triple and every
such pair meets in a list. There the shared positional bytes of a pair are tallied, pairs under the guaranteed minimum go,
and the rest are verified on all bits. A list gives a star for each of its connected groups, never its pairs; a
list longer than `LIST_ROWS` is split in blocks, of which each two meet in a task of their own.

`drop_near_duplicates` links what this index finds and the exact Jaccard similarity of the shingle sets confirms, then looks for
all other pairs of that similarity by a prefix filter over shingle hashes, each checked on all shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodmark.llm.common import among, batches_of, free_name, lean, n_partitions, scratch, shuffles_cleaned, staged

BITS, LIST_ROWS = 4, 2048
LEAST_SHARED = 8 - BITS
_HALVES = ((0, 1, 2), (3, 4, 5), (6, 7))


def _turan() -> list[tuple[int, int, int]]:
    """Triples of 8 positions of which any 4 positions contain one: Turan's construction on three parts in a circle."""
    part = {p: k for k, ps in enumerate(_HALVES) for p in ps}
    out = []
    for t in combinations(range(8), 3):
        per = [sum(part[p] == k for p in t) for k in range(3)]
        if max(per) == 3 or any(per[k] == 2 and per[(k + 1) % 3] == 1 for k in range(3)):
            out.append(t)
    return out


TRIPLES = _turan()


def word_hashes(ws: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `size` words joined by spaces, repeats included; of all words if they are fewer."""
    whole = b" ".join(ws)
    if len(ws) <= size:
        return np.array([xxhash.xxh64_intdigest(whole, 42)] if ws else [], dtype="<u8")
    lengths = np.fromiter(map(len, ws), dtype=np.int64, count=len(ws))
    stops = np.cumsum(lengths + 1) - 1
    starts = stops - lengths
    digest = xxhash.xxh64_intdigest
    return np.array([digest(whole[a:b], 42) for a, b in zip(starts[: len(ws) - size + 1].tolist(), stops[size - 1 :].tolist())], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are each 1 if set in over half the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def shingle_bits(text: str | None, size: int = 4) -> int:
    """The fingerprint of a text's shingles; no words give zero."""
    return majority(word_hashes(text.encode().lower().split() if text else [], size))


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th of any number of independent hashes made of one (a SplitMix64 step)."""
    with np.errstate(over="ignore"):
        x = hashes + np.uint64(0x9E3779B97F4A7C15) * np.uint64(k + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([shingle_bits(t, size) for t in b.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


class _Nodes:
    """Entries of postings: node, the bits that they are posted by and the bits that are verified, one row for each entry."""

    def __init__(self, node: np.ndarray, look: np.ndarray, wide: np.ndarray):
        self.node, self.look, self.wide = node, look, wide

    def __getitem__(self, at) -> "_Nodes":
        return _Nodes(self.node[at], self.look[at], self.wide[at])

    def __len__(self) -> int:
        return len(self.node)

    @staticmethod
    def join(a: "_Nodes", b: "_Nodes") -> "_Nodes":
        return _Nodes(np.concatenate([a.node, b.node]), np.concatenate([a.look, b.look]), np.concatenate([a.wide, b.wide]))

    def near(self, other: "_Nodes", bits: int, least_shared: int, table: bool = False) -> np.ndarray:
        """Whether pairs share enough positional bytes and then differ in few enough bits; with `table`, each against each."""
        pair = (lambda a, b: a[:, None] ^ b[None, :]) if table else np.bitwise_xor
        x = pair(self.look, other.look)
        shared = np.zeros(x.shape, dtype=np.uint8)
        for p in range(8):
            shared += (x & np.uint64(255 << 8 * p)) == 0
        keep = shared >= least_shared
        apart = np.zeros(x.shape, dtype=np.uint16)
        for k in range(self.wide.shape[1]):
            apart += np.bitwise_count(pair(self.wide[:, k], other.wide[:, k]))
        return keep & (apart <= bits)


def _stars(entries: _Nodes, sides: np.ndarray | None, bits: int, least_shared: int) -> list[tuple[np.ndarray, int]]:
    """(other members, smallest node) of each connected group of a list; with sides, only pairs across its two blocks count."""
    _, at, of = np.unique(entries.node, return_index=True, return_inverse=True)
    nodes = entries[at]
    out, todo = [], np.ones(len(nodes), dtype=bool)
    everyone = np.arange(len(nodes))
    if sides is None or sides.min() == sides.max():
        across = ((everyone, everyone),)
    else:
        left, right = np.unique(of[sides == sides.min()]), np.unique(of[sides == sides.max()])
        across = ((left, right), (right, left))
    while todo.any():
        first = int(todo.argmax())
        todo[first] = False
        group, front = [first], np.array([first])
        while len(front):
            reach = np.zeros(len(nodes), dtype=bool)
            for k in range(0, len(front), 256):
                some = front[k : k + 256]
                for mine, theirs in across:
                    src, dst = some if mine is everyone else some[np.isin(some, mine)], theirs[todo[theirs]]
                    if len(src) and len(dst):
                        reach[dst] |= nodes[src].near(nodes[dst], bits, least_shared, table=True).any(axis=0)
            front = np.flatnonzero(reach & todo)
            todo[front] = False
            group.extend(front.tolist())
        if len(group) > 1:
            members = nodes.node[np.array(group)]
            out.append((members[members != members.min()], members.min()))
    return out


def _lists(bits: int, least_shared: int, own: bool, wide: list[str]):
    """Links of each list of postings; rows come sorted by key, and only one list is held over batches."""

    def links(keys: np.ndarray, entries: _Nodes, sides: np.ndarray) -> pa.RecordBatch:
        hi, lo = [], []
        edges = np.flatnonzero(np.diff(keys)) + 1
        starts, sizes = np.concatenate([[0], edges]), np.diff(np.concatenate([[0], edges, [len(keys)]]))
        two = starts[(sizes == 2) & (sides[starts] == -1)]
        a, b = entries[two], entries[two + 1]
        pair = a.near(b, bits, least_shared) & (a.node != b.node)
        hi.append(np.maximum(a.node, b.node)[pair])
        lo.append(np.minimum(a.node, b.node)[pair])
        other = (sizes > 2) | ((sizes == 2) & (sides[starts] != -1))
        for s, n in zip(starts[other].tolist(), sizes[other].tolist()):
            for members, least in _stars(entries[s : s + n], None if sides[s] == -1 else sides[s : s + n], bits, least_shared):
                hi.append(members)
                lo.append(np.full(len(members), least))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(hi)), pa.array(np.concatenate(lo))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = lambda b, c: b.column(c).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
        keys = sides = entries = None
        for b in batches:
            look = longs(b, "look")
            more = _Nodes(look if own else longs(b, "node"), look.view(np.uint64), look.view(np.uint64)[:, None] if own else np.stack([longs(b, c).view(np.uint64) for c in wide], axis=1))
            if keys is None:
                keys, entries, sides = longs(b, "key"), more, longs(b, "side")
            else:
                keys, entries, sides = np.concatenate([keys, longs(b, "key")]), _Nodes.join(entries, more), np.concatenate([sides, longs(b, "side")])
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if whole:
                yield links(keys[:whole], entries[:whole], sides[:whole])
                keys, entries, sides = keys[whole:], entries[whole:], sides[whole:]
        if keys is not None and len(keys):
            yield links(keys, entries, sides)

    return run


def near_links(nodes: DataFrame, looks: list[str], wide: list[str] | None = None, bits: int = BITS, least_shared: int = LEAST_SHARED, list_rows: int = LIST_ROWS) -> DataFrame:
    """Links (a, b) with the connected components of the pairs of `nodes` that are at most `bits` bits apart.

    Each column of `looks` holds 64 bits whose positional bytes are indexed. Without `wide`, the one column of `looks` is the
    node itself, and its bits are those verified; else nodes have a column `node`, and the columns of `wide` are verified.
    """
    own = wide is None
    kept = [] if own else ["node", *wide]
    keys = []
    for r, look in enumerate(looks):
        byte = [F.shiftrightunsigned(look, 8 * p).bitwiseAND(F.lit(255)) for p in range(8)]
        keys += [F.struct((F.lit((r * len(TRIPLES) + k) << 24).cast("long") + byte[t[0]] * (1 << 16) + byte[t[1]] * (1 << 8) + byte[t[2]]).cast("long").alias("key"), F.col(look).alias("look")) for k, t in enumerate(TRIPLES)]
    postings = nodes.select(*kept, F.explode(F.array(*keys)).alias("_p")).select(F.col("_p.key").alias("key"), F.col("_p.look").alias("look"), *kept)
    n = n_partitions(nodes.sparkSession)
    long_lists = staged(postings.groupBy("key").count().where(F.col("count") > list_rows).select("key", F.ceil(F.col("count") / list_rows).cast("int").alias("blocks")), "long-lists")
    kernel, columns = _lists(bits, least_shared, own, wide or []), ["key", "look", "side", *kept]

    def linked(rows: DataFrame) -> DataFrame:
        return rows.select(*columns).repartition(n, "key").sortWithinPartitions("key").mapInArrow(kernel, "a long, b long")

    rest, out = postings.withColumn("side", F.lit(-1)), None
    if not long_lists.isEmpty():
        rest = rest.join(long_lists, "key", "left_anti")
        mine = F.pmod(F.xxhash64(F.lit("side"), "look" if own else "node"), F.col("blocks")).cast("int")
        split = postings.join(long_lists, "key").withColumn("side", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        out = linked(split.withColumn("key", F.xxhash64("key", F.least("side", "other"), F.greatest("side", "other"))))
    return (linked(rest) if out is None else linked(rest).unionByName(out)).distinct()


def components(links: DataFrame) -> DataFrame:
    """node and root (its component's smallest node) for each node of links (a, b), by alternating large and small stars."""
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == state:
            break
        state = now
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join has no aggregate below it and a hub with many links is split as any skewed key
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m")), "least")
        large = edges.join(least, "v").select("u", F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(least, "u")
        small = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = small.checkpoint()
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, size: int = 4, list_rows: int = LIST_ROWS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links, itself included) of each row of docs.

    Null, empty and blank texts have fingerprint zero and link with each other and with what is near zero. Rows without
    doc_id get their component's smallest doc_id, or null where it has none. Repeated rows are each kept; other columns are
    ignored; an empty table gives no rows.
    """
    fps = staged(fingerprints(docs, size), "fingerprints", lasting=True)
    with scratch(docs.sparkSession):
        reps = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
        roots = components(near_links(reps.select("fp"), ["fp"], list_rows=list_rows))
        placed = reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        placed = staged(placed, "placed")
        smallest = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
        named = staged(placed.join(smallest, "root").select("fp", "component_id"), "named", lasting=True)
    return fps.join(named, "fp")


SHORT_LIST, SAMPLED, SHARE, HOT_SHINGLES, MAP = 2, 10_000, 5, 400_000, 4
#: Texts or sets, and pairs of sets, that Python gets at once.
WIDE_ROWS, WIDE_PAIRS = 1000, 250


def shingle_sets(docs: DataFrame, size: int, kept: list[str]) -> DataFrame:
    """row, doc_id, node (a hash of the set) and, as named in `kept`, n, fp and shingles of each row of docs (row, doc_id, text):
    the distinct hashes of its runs of `size` words in order, 8 bytes each, and their fingerprint."""
    schema = ["row long", "doc_id long", "node long", *[{"n": "n int", "fp": "fp long", "shingles": "shingles binary"}[c] for c in kept]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(k, WIDE_ROWS) for k in range(0, whole.num_rows, WIDE_ROWS)):
                sets = [np.unique(word_hashes(t.as_py().encode().lower().split() if t.is_valid else [], size)) for t in b.column("text")]
                node = np.array([xxhash.xxh3_64_intdigest(s.tobytes(), 42) for s in sets], dtype=np.uint64).view(np.int64)
                more = {
                    "n": lambda: pa.array([len(s) for s in sets], pa.int32()),
                    "fp": lambda: pa.array(np.array([majority(s) for s in sets], dtype=np.uint64).view(np.int64)),
                    "shingles": lambda: pa.array([s.tobytes() for s in sets], pa.binary()),
                }
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(node), *[more[c]() for c in kept]], ["row", "doc_id", "node", *kept])

    return docs.select("row", F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), ", ".join(schema))


def _least_overlap(sizes, similarity: float):
    """The least number of common members with which two sets of so many members in all have that Jaccard similarity."""
    return np.ceil(sizes * (similarity / (1 + similarity)) - 1e-9).astype(np.int64)


def _hot(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles met often in a sample of sets, in order, and their places from rare to frequent. They only order the
    prefixes: any order gives the same pairs, this one gives short lists. The sample grows with the sets, one in SHARE where that is
    more than SAMPLED, so lists of what isn't hot stay as short on larger tables."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(b.column("shingles").to_pylist()), "<i8"))], ["h"])

    share = min(SHARE, max(1, sets.count() // SAMPLED))
    some = sets.where(F.pmod(F.xxhash64("node"), F.lit(share)) == 0).select("shingles").mapInArrow(lean(members), "h long")
    met = some.groupBy("h").count().where("count >= 4").orderBy(F.desc("count"), "h").limit(HOT_SHINGLES).select("h").toArrow()
    h = met.column("h").to_numpy()[::-1].astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], order + 1


def _postings(sets: DataFrame, similarity: float, hot) -> DataFrame:
    """key, node, n, at and the 64 * MAP bits of a parity map for each member of a prefix of each set.

    In one order of all shingles (hot ones last), sets of Jaccard similarity t and over share a member of their first
    n - ceil(t n) + 1. A shingle turns one bit of the map, so two maps differ in no more bits than their sets in members.
    """
    names = ["key", "node", "n", "at", *[f"m{k}" for k in range(MAP)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, places = hot.value
        for b in batches:
            out: list[list[np.ndarray]] = []
            for node, s in zip(b.column("node").to_pylist(), b.column("shingles").to_pylist()):
                h = np.frombuffer(s, "<u8")
                most = len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1 if len(h) else 0
                place = np.zeros(len(h), dtype=np.int64)
                if len(common):
                    near = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    place = np.where(common[near] == h, places[near], 0)
                first = h[np.argsort(place, kind="stable")[:most]]
                bits = np.packbits(np.bincount((mixed(h, 0) % np.uint64(64 * MAP)).astype(np.int64), minlength=64 * MAP) & 1, bitorder="little").view("<i8")
                full = lambda x: np.full(len(first), x, dtype=np.int64)
                out.append([first.view(np.int64), full(node), full(len(h)), np.arange(len(first)), *[full(x) for x in bits]])
                if len(out) >= 200:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names)

    return sets.select("node", "shingles").mapInArrow(lean(run), ", ".join(f"{c} long" for c in names))


class _Posted:
    """Postings as arrays: node, members of its set, place in its prefix, parity map, block of its list and component."""

    COLUMNS = ("key", "node", "n", "at", "side", "component")

    def __init__(self, b: pa.RecordBatch | None = None):
        if b is not None:
            longs = lambda c: b.column(c).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
            for c in self.COLUMNS:
                setattr(self, c, longs(c))
            self.map = np.stack([longs(f"m{k}").view(np.uint64) for k in range(MAP)], axis=1)

    def __getitem__(self, rows) -> "_Posted":
        out = _Posted()
        for c in (*self.COLUMNS, "map"):
            setattr(out, c, getattr(self, c)[rows])
        return out

    def __len__(self) -> int:
        return len(self.key)

    def joined(self, other: "_Posted") -> "_Posted":
        out = _Posted()
        for c in (*self.COLUMNS, "map"):
            setattr(out, c, np.concatenate([getattr(self, c), getattr(other, c)]))
        return out

    def may(self, other: "_Posted", similarity: float, table: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Whether pairs can be similar if this is their first common member, and how many bits their maps differ in."""
        of = (lambda x, y, f: f(x[:, None], y[None, :])) if table else (lambda x, y, f: f(x, y))
        sizes = of(self.n, other.n, np.add)
        least = _least_overlap(sizes, similarity)
        keep = (of(self.n - self.at, other.n - other.at, np.minimum) >= least) & of(self.node, other.node, np.not_equal)
        if self.component.any() or other.component.any():
            keep &= of(self.component, other.component, np.not_equal)
        apart = np.zeros(sizes.shape, dtype=np.int64)
        for k in range(MAP):
            apart += np.bitwise_count(of(self.map[:, k], other.map[:, k], np.bitwise_xor))
        return keep & (apart <= sizes - 2 * least), apart


def _star_pairs(x: _Posted, similarity: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each member of a list with the first that it may be similar to of a few hubs: never more pairs than members. Members come
    by node, so lists of the same group have the same hubs and their pairs coincide."""
    out, todo = [], np.arange(len(x))
    while len(todo) > 1:
        hub, todo = todo[:1], todo[1:]
        hit = x[hub].may(x[todo], similarity, table=True)[0][0]
        out.append((x.node[np.repeat(hub, hit.sum())], x.node[todo[hit]]))
        todo = todo[~hit]
    return out


def _cross_pairs(x: _Posted, similarity: float, closest: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a list that may be similar, across its two blocks if it has two; with `closest`, one for each two components."""
    low = np.flatnonzero(x.side == x.side.min())
    high = np.flatnonzero(x.side == x.side.max())
    inside = len(low) == len(x)
    out = []
    for k in range(0, len(low), 256):
        some = low[k : k + 256]
        keep, apart = x[some].may(x[high], similarity, table=True)
        i, j = np.nonzero(keep)
        a, b, far = some[i], high[j], apart[i, j]
        if inside:
            a, b, far = a[a < b], b[a < b], far[a < b]
        if closest and len(a):
            ends = np.sort(np.stack([x.component[a], x.component[b]], axis=1), axis=1)
            order = np.lexsort((far, ends[:, 1], ends[:, 0]))
            new = np.concatenate([[True], (np.diff(ends[order], axis=0) != 0).any(axis=1)])
            a, b = a[order[new]], b[order[new]]
        out.append((x.node[a], x.node[b]))
    return out


def _met(postings: DataFrame, similarity: float, how: str) -> DataFrame:
    """Pairs (a, b), a < b, that the lists of `postings` show: all, a star or the closest of each two components."""

    def pairs(x: _Posted) -> pa.RecordBatch:
        edges = np.flatnonzero(np.diff(x.key)) + 1
        starts, stops = np.concatenate([[0], edges]), np.concatenate([edges, [len(x)]])
        two = starts[stops - starts == 2] if how == "all" else starts[:0]
        two = two[x.side[two] == x.side[two + 1]]
        a, b = x[two], x[two + 1]
        hit = a.may(b, similarity)[0]
        out = [(a.node[hit], b.node[hit])]
        more = (stops - starts > 2) | (stops - starts == 2) & ~np.isin(starts, two)
        for s, e in zip(starts[more].tolist(), stops[more].tolist()):
            out += _star_pairs(x[s:e], similarity) if how == "star" else _cross_pairs(x[s:e], similarity, how == "closest")
        a, b = (np.concatenate([o[k] for o in out]) for k in range(2))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            held = _Posted(b) if held is None else held.joined(_Posted(b))
            whole = int(np.searchsorted(held.key, held.key[-1]))
            if whole:
                yield pairs(held[:whole])
                held = held[whole:]
        if held is not None and len(held):
            yield pairs(held)

    columns = [*_Posted.COLUMNS, *[f"m{k}" for k in range(MAP)]]
    dealt = postings.select(*columns).repartition(n_partitions(postings.sparkSession), "key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(lean(run), "a long, b long").distinct()


def _parities(shingles: np.ndarray) -> bytes:
    """A parity map of a set, of two to four bits for each member: each turns one bit, so two sets differ in no fewer members than
    their maps in bits."""
    bits = max(64, 1 << int(2 * len(shingles)).bit_length())
    return np.packbits(np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def _bits_apart(x: np.ndarray, y: np.ndarray) -> int:
    """The bits that two parity maps differ in; the larger one is folded to the smaller one's length, which keeps it a parity map."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _plausible(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose parity maps don't rule out that similarity: a map is about a thirtieth of its set."""

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("n"), pa.array([_parities(np.frombuffer(s.as_buffer(), "<u8")) for s in b.column("shingles")], pa.binary())], ["node", "n", "map"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64) + batch.column("m").to_numpy(zero_copy_only=False)
            apart = [_bits_apart(*(np.frombuffer(m.as_buffer(), "<u8") for m in two)) for two in zip(batch.column("x"), batch.column("y"))]
            keep = pa.array(np.array(apart, dtype=np.int64) <= sizes - 2 * _least_overlap(sizes, similarity))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    ends = staged(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "met")
    asked = staged(among(sets.select("node", "n", "shingles"), ends, "node").mapInArrow(lean(maps), "node long, n int, map binary"), "maps", wide=True)
    first = asked.select(F.col("node").alias("a"), "n", F.col("map").alias("x"))
    second = asked.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("map").alias("y"))
    return staged(pairs.join(first, "a").join(second, "b").mapInArrow(lean(run), "a long, b long"), "plausible")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b), a staged table, whose sets have at least that Jaccard similarity: those that their parity maps leave,
    from all their members."""
    if pairs.isEmpty():
        return pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(s.as_buffer(), "<u8") for s in (x, y))
                keep.append(len(np.intersect1d(x, y, assume_unique=True)) >= _least_overlap(np.int64(len(x) + len(y)), similarity))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    with batches_of(sets.sparkSession, WIDE_PAIRS):
        pairs = _plausible(pairs, sets, similarity)
        if pairs.isEmpty():
            return pairs
        ends = staged(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "asked")
        asked = among(sets.select("node", "shingles"), ends, "node")
        # a pair crosses the network with one of its sets; the other comes once for each node
        both = pairs.join(asked.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(asked.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        return staged(both.mapInArrow(lean(run), "a long, b long"), "similar")


def fingerprint_links(sets: DataFrame, similarity: float, list_rows: int = LIST_ROWS) -> DataFrame:
    """Links (a, b) of sets (node, n, fp, shingles) that the index over byte positions of their fingerprints finds and that have at
    least that Jaccard similarity. Sets of one fingerprint go to the smallest of them."""
    fps = staged(sets.select("node", "fp"), "fingerprints")
    reps = staged(fps.groupBy("fp").agg(F.min("node").alias("rep")), "distinct-fingerprints")
    found = near_links(reps.select("fp"), ["fp"], list_rows=list_rows)
    ends = found.join(reps.select(F.col("fp").alias("a"), F.col("rep").alias("x")), "a").join(reps.select(F.col("fp").alias("b"), F.col("rep").alias("y")), "b")
    pairs = ends.select("x", "y").unionByName(fps.join(reps, "fp").where("node <> rep").select(F.col("rep").alias("x"), F.col("node").alias("y")))
    return _similar(staged(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "candidates"), sets, similarity)


def similar_links(sets: DataFrame, similarity: float, list_rows: int = LIST_ROWS, short_list: int = SHORT_LIST, links: DataFrame | None = None) -> DataFrame:
    """Links (a, b) of sets (node, n, shingles; nodes once each), each of at least that Jaccard similarity, with the connected
    components of all such pairs. `links` are such links as are known.

    Lists of up to `short_list` give all their pairs that are still apart. A longer one gives stars, then the closest of each two
    components still apart, then all pairs still apart, so a large group's pairs aren't listed; blocks of `list_rows` are tasks of
    their own. Members met by no other set in a prefix are dropped first.
    """
    spark = sets.sparkSession
    with batches_of(spark, WIDE_ROWS):
        postings = _postings(sets, similarity, spark.sparkContext.broadcast(_hot(sets)))
        lists = postings.groupBy("key").count().where("count > 1")
        lists = staged(lists.select("key", (F.col("count") > short_list).alias("long"), F.ceil(F.col("count") / list_rows).cast("int").alias("blocks")), "lists")
        shared = staged(postings.join(lists, "key"), "shared-postings")

    long = shared.where("long").withColumn("side", F.pmod(F.xxhash64(F.lit("side"), "node"), F.col("blocks")).cast("int"))
    roots = None if links is None or links.isEmpty() else staged(components(links), "components")

    def placed(rows: DataFrame) -> DataFrame:
        if roots is None:
            return rows.withColumn("component", F.col("node"))
        return rows.join(roots, "node", "left").withColumn("component", F.coalesce("root", "node"))

    stars = _met(placed(long.withColumn("key", F.xxhash64("key", "side"))), similarity, "star")
    short = _met(placed(shared.where("not long").withColumn("side", F.lit(-1))), similarity, "all")
    steps = [short.unionByName(stars).distinct()]
    if not lists.where("long").isEmpty():
        pairs = long.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("key", F.xxhash64("key", F.least("side", "other"), F.greatest("side", "other")))
        steps += ["closest", "all"]
    for step in steps:
        more = _similar(staged(_met(placed(pairs), similarity, step) if isinstance(step, str) else step, "candidates"), sets, similarity)
        if links is None:
            links = more
        elif not more.isEmpty():
            links = links.unionByName(more)
        else:
            continue
        if step is not steps[-1]:
            roots = staged(components(links), "components")
    return links


def drop_near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8, list_rows: int = LIST_ROWS, copy: bool = True) -> DataFrame:
    """docs (doc_id, text and others) with one row, that of least doc_id, for each group of near duplicates.

    Rows link if the sets of their shingles of `size` words have at least that Jaccard similarity, and groups are the
    components of all such links: no pair is missed and none below links. Candidates meet in the index over their fingerprints, then
    by a prefix filter, and are verified on all their shingles. Null, empty and blank texts are one group; null doc_ids come first; repeated rows
    are near duplicates. Rows are numbered once, in a copy of docs; copy=False saves it where docs is a table as it is read, which
    comes in the same order each time.
    """
    row = free_name(docs, "_row")
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    rows = staged(rows, "rows", lasting=True) if copy else rows
    named = rows.select(F.col(row).alias("row"), "doc_id", "text")
    with scratch(docs.sparkSession), shuffles_cleaned(docs.sparkSession):
        with batches_of(docs.sparkSession, WIDE_ROWS):
            nodes = shingle_sets(named, size, []).groupBy("node").agg(F.min(F.struct("doc_id", "row")).alias("least"))
            nodes = staged(nodes, "nodes")
            first = among(named, nodes.select(F.col("least.row").alias("row")), "row")
            sets = staged(shingle_sets(first, size, ["n", "fp", "shingles"]).select("node", "n", "fp", "shingles"), "shingle-sets", wide=True)
        roots = components(similar_links(sets, similarity, list_rows, links=fingerprint_links(sets, similarity, list_rows)))
        grouped = nodes.select("node", "least").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("least"))
        kept = staged(grouped.select(F.col("least.row").alias(row)), "kept", lasting=True)
    return among(rows, kept, row).select(*docs.columns)
