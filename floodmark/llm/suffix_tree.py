"""LM scoring with a probabilistic suffix tree over words, grown level by level over blocks of documents.

Tokens are words and an end token for each text. The tree's states are contexts of any length, which may reach back to the
start of the text. The root gives P(w) = (c(w) + 1) / (N + V + 1), unknown words being one symbol. A state s mixes its own
counts with its parent's distribution (the state without its first word), P_s(w) = (c_s(w) + u_s P_parent(w)) / (n_s + u_s),
n_s being the training tokens after it and u_s the distinct words among them. It is kept when those tokens, each predicted
from the others, are likelier under it than under its parent by `least_gain` nats in all. What the parent adds to words met
twice or more is left out of that sum, so it is a lower bound, and it adds up over any split of the words:
    sum over c >= 2 of c log((c - 1) / ((n + u - 1) P_parent))  +  (words with c = 1) log((u - 1) / (n + u - 2)).
A state is tested if its parent is kept (all words are, at depth one) and the context without its last word was tested too,
which tells n_s beforehand: only states with n_s >= 2 are. A token is scored by the longest kept state before it.

Only packed arrays travel:
  - each block asks the words' partitions once for the counts and numbers of its distinct words;
  - at each level it sends (state, word, training count) of its positions that are still in the tree, to the state's
    partition, which tells it the sums over all blocks and which states are kept.
A state with more than a sixteenth of a partition's tokens is split by the following word; there can be no more than 16 a
partition, and their few sums, not their words, are added up over partitions and broadcast. Levels go on until no state
is kept. Nothing else of the tree or the vocabulary passes the driver but N and V.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floodmark.llm.common import drop_stage, fresh_path, n_partitions, parts_for, shuffles_cleaned
from floodmark.llm.tokens import groups, strings

#: Bytes of text in a block, and tokens whose states go to one partition: what bounds a task's arrays.
BLOCK_BYTES, PART_TOKENS = 4_000_000, 3_000_000
#: A state is hot from this share of a partition's tokens.
HOT_SHARE = 1 / 16
#: Levels up to this one are worked out again from the block's words; at deeper ones the positions left, a fraction, are kept.
REPLAYED = 2
#: The counts of words that make up at least this share of all tokens are known everywhere; there can't be more than one over it.
FREQUENT = 2.0**-18
END, START = 1, 2
BLOCKS = "block long, doc_ids array<long>, lengths binary, train binary, words binary, stream binary, counts binary"
BASE = "block long, doc_ids array<long>, lengths binary, train binary, words binary, stream binary"
DOCS = "block long, doc_ids array<long>, lengths binary, train binary, root binary"
SCORES = "doc_id long, learnt boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
SENT = "part int, block long, data binary"
TOLD = "block long, part int, data binary, n_tokens long, n_words long"
ANSWERED = "block long, part int, data binary, kept long, state long, n long, u long, twice long, once long, a double"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob, bytes of equal weight side by side."""
    out = []
    for a in arrays:
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()
        out.append(len(a).to_bytes(8, "little") + a.dtype.str.encode().ljust(4) + planes)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(data):
        n, kind = int.from_bytes(data[at : at + 8], "little"), np.dtype(data[at + 8 : at + 12].decode().strip())
        at += 12
        planes = np.frombuffer(data, dtype=np.uint8, count=n * kind.itemsize, offset=at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(-1))
        at += n * kind.itemsize
    return out


def tokens(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lowered."""
    return text.encode().lower().split() if text else []


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by blocks of about BLOCK_BYTES; a longer text is a block of its own."""
    made = 0
    for batch in batches:
        for at, n in groups(batch.column("text"), BLOCK_BYTES):
            b = batch.slice(at, n)
            words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(b.column("text"), "")))
            runs, flat = pc.list_value_length(words).to_numpy(zero_copy_only=False), words.flatten()
            some = pc.greater(pc.binary_length(flat), 0)
            lengths = np.bincount(np.repeat(np.arange(n), runs)[some.to_numpy(zero_copy_only=False)], minlength=n) + 1
            flat = flat.filter(some).dictionary_encode()
            ends = np.zeros(int(lengths.sum()), dtype=bool)
            ends[np.cumsum(lengths) - 1] = True
            stream = np.zeros(len(ends), dtype=np.int64)
            stream[~ends] = flat.indices.to_numpy(zero_copy_only=False) + 1
            hashes = np.array([END, *map(_word_hash, strings(flat.dictionary))], dtype=np.uint64)
            del words, flat, some
            order = np.argsort(-np.bincount(stream, minlength=len(hashes)), kind="stable")
            rank = np.empty(len(hashes), dtype="<u4")
            rank[order] = np.arange(len(hashes))
            train = b.column("learn").to_numpy(zero_copy_only=False).astype(np.uint8)
            counts = np.bincount(stream[np.repeat(train.astype(bool), lengths)], minlength=len(hashes))
            row = (TaskContext.get().partitionId() << 32) + made, b.column("doc_id").to_pylist(), pack(lengths.astype("<u4")), pack(train), pack(hashes[order]), pack(rank[stream]), pack(counts[order].astype("<u4"))
            yield _rows([row], BLOCKS)
            made += 1


def _word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word, 7)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each key; they come sorted by it."""
    now, held = None, []
    for b in batches:
        for r in b.to_pylist():
            if r[key] != now and held:
                yield now, held
                held = []
            now = r[key]
            held.append(r)
    if held:
        yield now, held


def _ask(n: int):
    """Round 1, from a block: its distinct words' hashes and training counts, to the words' partitions."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                (hashes,), (counts,) = unpack(r["words"]), unpack(r["counts"])
                part = (hashes % np.uint64(n)).astype(np.int64)
                order = np.lexsort((hashes, part))
                stops = np.searchsorted(part[order], np.arange(n + 1))
                yield _rows([(p, r["block"], pack(hashes[o], counts[o])) for p in range(n) if len(o := order[stops[p] : stops[p + 1]])], "part int, block long, data binary")

    return run


def _answer(n: int):
    """Round 1, at a partition: the words' counts over all blocks and their numbers, back to each block, and the partition's tokens,
    words and, as they may be frequent, the words met most. A partition numbers its words by their frequency, n apart."""

    def run(batches):
        for part, rows in _grouped(batches, "part"):
            asked = [unpack(r["data"]) for r in rows]
            words, where = np.unique(np.concatenate([h for h, _ in asked]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([c for _, c in asked]).astype(float), len(words)).astype(np.int64)
            number = np.empty(len(words), dtype=np.int64)
            number[np.argsort(-counts, kind="stable")] = np.arange(len(words)) * n + part
            stops = np.cumsum([0] + [len(h) for h, _ in asked])
            for k, r in enumerate(rows):
                mine = where[stops[k] : stops[k + 1]]
                yield _rows([(r["block"], part, pack(counts[mine].astype("<u8"), number[mine]), None, None)], TOLD)
            yield _rows([(None, part, pack(*_above(number, counts, FREQUENT * int(counts.sum()))), int(counts.sum()), int((counts > 0).sum()))], TOLD)

    return run


def _above(numbers: np.ndarray, counts: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Words that have at least that count, and their counts."""
    some = (counts > 0) & (counts >= least)
    return numbers[some], counts[some]


def _frequent(answers: DataFrame, n_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent words' numbers in order, at most 1 / FREQUENT of them, and their counts. A partition knows its own tokens alone,
    so it has offered a little more than its frequent words; what it offers is cut to them before it leaves the executors."""

    def cut(batches):
        for b in batches:
            yield _rows([(pack(*_above(*unpack(d), FREQUENT * n_tokens)),) for d in b.column("data").to_pylist()], "data binary")

    parts = [unpack(r.data) for r in answers.where("block is null").select("data").mapInArrow(cut, "data binary").collect()]
    numbers, counts = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, dtype=np.int64) for k in range(2))
    order = np.argsort(numbers)
    return numbers[order], counts[order]


def _among(numbers: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which of the words are frequent, and where they stand there."""
    if not len(frequent[0]):
        return np.zeros(len(numbers), dtype=bool), np.zeros(len(numbers), dtype=np.int64)
    place = np.minimum(np.searchsorted(frequent[0], numbers), len(frequent[0]) - 1)
    return frequent[0][place] == numbers, place


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, in their order, and each key's number among them."""
    order = np.argsort(keys)
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.diff(keys[order]) != 0
    number = np.empty(len(order), dtype=np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return order[new], number


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * _MIX
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _kept(a, twice, once, n, u, least_gain: float) -> np.ndarray:
    """The divergence test, from a state's sums: a over words met twice or more of c log((c - 1) / P_parent), those words'
    tokens, the words met once, all tokens and all words."""
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = a - twice * np.log(np.maximum(n + u - 1, 1)) + np.where(once > 0, once * np.log((u - 1) / (n + u - 2)), 0.0)
    return (n > 1) & (gain >= least_gain)


class _Growing:
    """A block's positions in the tree at one level: `at` (in order), the word there, the farthest word of the context, the state,
    what the state's parent says of the word, and each state's hash and training tokens.

    The farthest word one level down is that of the position before, which is there too or the position is not.
    """

    def __init__(self, row: dict, totals: tuple[int, int], parts: int, frequent: tuple[np.ndarray, np.ndarray]):
        self.block, self.parts, self.totals, self.frequent = row["block"], parts, totals, frequent
        self.hot_from = max(2.0, HOT_SHARE * totals[0] / parts)
        if row.get("carry") is not None:
            level, lengths, self.train, self.code, self.wide, self.at, self.word, self.far, self.state, self.up, self.hash, self.n, gain = unpack(row["carry"])
            self.level, self.gain = int(level[0]), gain.copy()
            self._places(lengths)
            return
        (lengths,), (self.train,), (stream,), (self.counts, self.code) = (unpack(row[c]) for c in ("lengths", "train", "stream", "words"))
        self._places(lengths)
        self.wide = np.append(_mixed(self.code.astype(np.uint64) + np.uint64(START + 1)), np.uint64(START))
        self.doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        self.level, self.gain = 0, np.zeros(len(lengths))
        self.at = np.arange(len(stream), dtype=np.int32)
        self.word = stream.astype(np.int32)
        self.up = (self.counts[stream] + 1) / (totals[0] + totals[1] + 1)
        self.root, self.known = (np.add.reduceat(x, self.start) for x in (np.log10(self.up), (self.counts[stream] > 0).astype(np.int64)))
        self.hash, self.state = np.zeros(1, dtype=np.uint64), np.zeros(len(stream), dtype=np.int32)
        far = np.roll(self.word, 1)
        far[self.start] = len(self.code)
        met = np.append(self.counts, self.counts[stream[-1]])[far]  # a start for each end
        self._grow(far, met, met >= 2)

    def _places(self, lengths: np.ndarray) -> None:
        self.lengths, self.doc = lengths, None
        self.start = np.cumsum(lengths.astype(np.int64)) - lengths

    def _docs(self) -> np.ndarray:
        return np.searchsorted(self.start, self.at, side="right") - 1 if self.doc is None else self.doc[self.at]

    def _grow(self, far: np.ndarray, met: np.ndarray, can: np.ndarray) -> None:
        """One level down, for the positions that can: their farthest words, and how often their longer contexts were met."""
        self.level += 1
        self.at, self.word, self.up, self.far, met, above = self.at[can], self.word[can], self.up[can], far[can], met[can], self.state[can]
        pairs = above * np.int64(len(self.wide)) + self.far
        if self.level == 1:
            used = np.bincount(pairs, minlength=len(self.wide)) > 0
            first = np.empty(len(used), dtype=np.int64)
            first[pairs] = np.arange(len(pairs))
            first, state = first[used], (np.cumsum(used) - 1)[pairs]
        else:
            first, state = _distinct(pairs)
        self.hash = _mixed(self.hash[above[first]] + self.wide[self.far[first]] * _MIX + np.uint64(self.level))
        self.n, self.state = met[first].astype(np.int64), state.astype(np.int32)

    def carry(self) -> bytes:
        words, word = np.unique(self.word, return_inverse=True)
        wide, far = np.unique(self.far, return_inverse=True)
        return pack(np.array([self.level], dtype=np.int64), self.lengths, self.train, self.code[words], self.wide[wide], self.at, word.astype("<i4"), far.astype("<i4"), self.state, self.up, self.hash, self.n, self.gain)

    def _runs(self) -> None:
        """Entries (state, word) by partition, hot ones last, in the order of states and words; a hot state has a run in each
        partition that its words go to."""
        part = (_mixed(self.hash) % np.uint64(self.parts)).astype(np.int64)
        hot = self.n >= self.hot_from
        run, of, mine, some = np.arange(len(self.hash)), self.state.astype(np.int64), part, np.flatnonzero(hot[self.state])
        if len(some):
            to = (_mixed(self.hash[self.state[some]] ^ self.code[self.word[some]].astype(np.uint64)) % np.uint64(self.parts)).astype(np.int64)
            both, where = np.unique(self.state[some] * np.int64(self.parts) + to, return_inverse=True)
            of[some] = len(run) + where
            run, mine = np.concatenate([run, both // self.parts]), np.concatenate([mine, both % self.parts])
        used = np.bincount(of, minlength=len(run)) > 0
        order = np.lexsort((self.hash[run], hot[run], mine))
        order = order[used[order]]
        rank = np.empty(len(run), dtype=np.int64)
        rank[order] = np.arange(len(order))
        self.run_state, self.run_part, self.run_hot = run[order], mine[order], hot[run[order]]
        key = (rank[of] << 32) + self.word
        self.first, self.entry = _distinct(key)
        self.entry_run = key[self.first] >> 32

    def messages(self) -> Iterator[tuple]:
        """What each partition gets: its runs, words and training counts, and what its entries' parents say: at the first level by
        rare words' counts, at the second by the parents' counts and sums too, then as it is."""
        self._runs()
        words, runs = self.word[self.first], self.run_state
        counts = np.bincount(self.entry, self.train.astype(bool)[self._docs()], len(self.first)).astype("<u4")
        sizes = np.bincount(self.entry_run, minlength=len(runs)).astype("<u4")
        stops = np.searchsorted(self.run_part, np.arange(self.parts + 1))
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        for p in range(self.parts):
            a, b = stops[p], stops[p + 1]
            if a == b:
                continue
            i, j = ends[a], ends[b]
            code, given = self.code[words[i:j]], []
            if self.level <= 2:
                given = [self.counts[words[i:j]][~_among(code, self.frequent)[0]]]
            if self.level == 2:
                given += [self.parent_count[self.first[i:j]].astype("<u4"), self.parent_n[runs[a:b]].astype("<u8"), self.parent_u[runs[a:b]].astype("<u8")]
            if self.level > 2:
                given = [self.up[self.first[i:j]]]
            yield p, self.block, pack(self.hash[runs[a:b]], sizes[a:b], self.run_hot[a:b].astype(np.uint8), code, counts[i:j], *given)

    def learn(self, answers: list[dict], hot: tuple[np.ndarray, ...]) -> None:
        """Takes the partitions' sums, scores with the states that are kept and goes one level down."""
        self._runs()
        got = [unpack(a["data"]) for a in sorted(answers, key=lambda a: a["part"])]
        kept = np.concatenate([g[0] for g in got]).astype(bool) if got else np.zeros(0, dtype=bool)
        n, u = np.zeros(len(kept)), np.zeros(len(kept))
        c = np.concatenate([g[3] for g in got]).astype(np.int64) if got else np.zeros(0, dtype=np.int64)
        n[kept], u[kept] = (np.concatenate([g[k] for g in got]) if got else np.zeros(0) for k in (1, 2))
        some = np.flatnonzero(self.run_hot)
        if len(some):
            states, hot_kept, hot_n, hot_u = hot
            place = np.searchsorted(states, self.hash[self.run_state[some]])
            kept[some], n[some], u[some] = hot_kept[place], hot_n[place], hot_u[place]
        stays = kept[self.entry_run]
        run, up = self.entry_run[stays], self.up[self.first[stays]]
        value = self.up[self.first]
        value[stays] = (c[stays] + u[run] * up) / (n[run] + u[run])
        on = stays[self.entry]
        now, doc, entry = value[self.entry[on]], self._docs()[on], self.entry[on]
        self.gain += np.bincount(doc, np.log10(now / self.up[on]), len(self.gain))
        stand = self.at[on]
        before = np.searchsorted(self.at, stand - 1)
        there = (self.at[before] == stand - 1) & (stand - self.start[doc] >= self.level)
        met = np.where(there, c[self.entry[before]], 0)
        far, can = self.far[before], met >= 2
        above = self.state[on]
        self.at, self.word, self.up, self.state = stand, self.word[on], now, above
        sums = [x[can] for x in (c[entry], n[self.entry_run[entry]], u[self.entry_run[entry]])] if self.level == 1 else []
        self._grow(far, met, can)
        if self.level == 2:
            self.parent_count, first = sums[0], np.empty(len(self.hash), dtype=np.int64)
            first[self.state] = np.arange(len(self.state))
            self.parent_n, self.parent_u = sums[1][first], sums[2][first]


def _numbered(batches):
    """Blocks with the training counts and numbers of their words, as the words' partitions told them, in place of hashes."""
    for b in batches:
        for r in b.to_pylist():
            (hashes,), told = unpack(r["words"]), sorted(r["told"], key=lambda a: a["part"])
            order = np.lexsort((hashes, hashes % np.uint64(told[0]["parts"])))
            got = [unpack(a["data"]) for a in told]
            both = np.empty((2, len(hashes)), dtype=np.int64)
            for k in range(2):
                both[k, order] = np.concatenate([g[k] for g in got]).astype(np.int64)
            yield _rows([(r["block"], r["doc_ids"], r["lengths"], r["train"], pack(*both), r["stream"])], BASE)


def _left(totals: tuple[int, int], parts: int, frequent, hots):
    """From a block: its positions left at the next level, and the gains so far."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                yield _rows([(r["block"], _learnt(r, totals, parts, frequent, hots).carry())], "block long, carry binary")

    return run


def _roots(totals: tuple[int, int], frequent):
    """From a block: what the root says of its documents."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                g = _Growing(r, totals, 1, frequent.value)
                yield _rows([(r["block"], r["doc_ids"], r["lengths"], r["train"], pack(g.root, g.known))], DOCS)

    return run


def _learnt(row: dict, totals: tuple[int, int], parts: int, frequent, hots) -> _Growing:
    """A block's positions after all the answers that it has."""
    g = _Growing(row, totals, parts, frequent.value)
    answers = row["answers"] or [] if "answers" in row else []
    for level in range(g.level, max((a["level"] for a in answers), default=0) + 1):
        g.learn([a for a in answers if a["level"] == level], hots[level].value)
    return g


def _send(totals: tuple[int, int], parts: int, frequent, hots):
    """From a block: its messages for the next level."""

    def sent(r: dict) -> Iterator[pa.RecordBatch]:
        g = _learnt(r, totals, parts, frequent, hots)
        for row in g.messages() if len(g.at) else ():
            yield _rows([row], SENT)

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                yield from sent(r)  # nothing of a block is held over the next

    return run


def _count(totals: tuple[int, int], frequent, level: int, least_gain: float):
    """At a partition: adds its blocks' entries up, tests its states, and tells each block the sums of its own entries."""

    def counted(part: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        got = [unpack(r.pop("data")) for r in rows]
        runs = [len(g[0]) for g in got]
        state, of_run = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
        of = np.repeat(of_run.astype(np.int64), np.concatenate([g[1] for g in got]).astype(np.int64))
        hot = np.zeros(len(state), dtype=bool)
        hot[of_run] = np.concatenate([g[2] for g in got]).astype(bool)
        code = np.concatenate([g[3] for g in got])
        first, entry = _distinct(of * (int(code.max()) + 1) + code)
        c = np.bincount(entry, np.concatenate([g[4] for g in got]), len(first))
        given = np.concatenate([g[5] for g in got])
        if level <= 2:
            known, place = _among(code, frequent.value)
            counts = np.empty(len(code), dtype=np.int64)
            counts[~known], counts[known] = given, frequent.value[1][place[known]]
            up = (counts[first] + 1) / (totals[0] + totals[1] + 1)
            del counts, known, place
        else:
            up = given[first]
        if level == 2:
            c1, n1, u1 = (np.concatenate([g[k] for g in got]).astype(float) for k in (6, 7, 8))
            run = np.repeat(np.arange(len(of_run), dtype=np.int32), np.concatenate([g[1] for g in got]).astype(np.int64))[first]
            up = (c1[first] + u1[run] * up) / (n1[run] + u1[run])
            del c1, n1, u1, run
        sizes = [len(g[3]) for g in got]
        del got, given, code
        owner, m = of[first], len(state)
        n, u, once = np.bincount(owner, c, m), np.bincount(owner, c > 0, m), np.bincount(owner, c == 1, m)
        more = c >= 2
        twice = np.bincount(owner[more], c[more], m)
        a = np.bincount(owner[more], c[more] * np.log((c[more] - 1) / up[more]), m)
        kept = _kept(a, twice, once, n, u, least_gain) & ~hot
        yield _rows([(None, part, None, int(kept.sum()), int(s), int(n[k]), int(u[k]), int(twice[k]), int(once[k]), float(a[k])) for k, s in zip(np.flatnonzero(hot).tolist(), state[hot].view(np.int64).tolist())] + [(None, part, None, int(kept.sum()), *[None] * 6)], ANSWERED)
        for r, i, x, j, y in zip(rows, np.cumsum(runs), runs, np.cumsum(sizes), sizes):
            mine = of_run[i - x : i]
            on = kept[mine]
            yield _rows([(r["block"], part, pack(on.astype(np.uint8), n[mine[on]], u[mine[on]], c[entry[j - y : j]].astype("<u8")), *[None] * 7)], ANSWERED)

    def run(batches):
        for part, rows in _grouped(batches, "part"):
            yield from counted(part, rows)

    return run


def _scores(totals: tuple[int, int], parts: int, frequent, hots):
    """From a block's documents and positions: the scores, after the last level."""

    def scored(r: dict) -> pa.RecordBatch:
        (root, known), (train,), (lengths,) = (unpack(r[c]) for c in ("root", "train", "lengths"))
        gain = _learnt({k: v for k, v in r.items() if k in ("block", "carry", "answers")}, totals, parts, frequent, hots).gain
        m = len(lengths)
        cells = [pa.array(r["doc_ids"], pa.int64()), pa.array(train == 1), pa.array(lengths.astype(np.int64)), pa.array(known), pa.array(np.full(m, totals[0], dtype=np.int64)), pa.array(root), pa.array(root + gain)]
        return pa.RecordBatch.from_arrays(cells, [c.split()[0] for c in SCORES.split(", ")])

    def run(batches):
        for b in batches:
            yield from map(scored, b.to_pylist())

    return run


def _hot_states(answers: DataFrame, least_gain: float) -> tuple[np.ndarray, ...]:
    """Hash, verdict, tokens and words of the hot states in order: at most 1 / HOT_SHARE a partition."""
    sums = answers.where("state is not null").groupBy("state").agg(*[F.sum(c).alias(c) for c in ("n", "u", "twice", "once", "a")]).collect()
    state = np.array([r.state for r in sums], dtype=np.int64).view(np.uint64)
    n, u, twice, once, a = (np.array([r[c] for r in sums], dtype=float) for c in ("n", "u", "twice", "once", "a"))
    order = np.argsort(state)
    return state[order], _kept(a, twice, once, n, u, least_gain)[order], n[order], u[order]


class _Held:
    """Tables that later levels read, written to the shared folder: what they came from can go, and nothing is lost with an executor."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.tables = spark, {}, {}

    def bucketed(self, name: str, df: DataFrame, buckets: int) -> DataFrame:
        """Written in buckets of `block`, so that joins with it leave it where it is."""
        path, table = fresh_path(self.spark, name), f"floodmark_{uuid.uuid4().hex}"
        self.paths[name], self.tables[name] = path, table
        df.repartition(buckets, "block").write.bucketBy(buckets, "block").option("path", path).option("compression", "uncompressed").saveAsTable(table)
        return self.spark.table(table)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = self.paths[name] = fresh_path(self.spark, name)
        df.write.option("compression", "uncompressed").parquet(path)  # packed arrays are compressed by themselves
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
            if name in self.paths:
                drop_stage(self.spark, self.paths.pop(name))


def score_documents(docs: DataFrame, learn: Column, least_gain: float = 4.0, part_tokens: int = PART_TOKENS) -> DataFrame:
    """doc_id, learnt, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of each row of docs
    (doc_id, text). Rows for which `learn` holds are counted; a null condition doesn't hold.

    Null and empty texts are the end token alone. Repeated rows and rows without doc_id are each counted and scored; other
    columns are ignored; an empty table gives no rows. With nothing to learn from, scores are those of the root. The work is
    done when this returns; what it returns is read from the shared folder.
    """
    with shuffles_cleaned(docs.sparkSession):
        return _scored(docs, learn, least_gain, part_tokens)


def _scored(docs: DataFrame, learn: Column, least_gain: float, part_tokens: int) -> DataFrame:
    spark = docs.sparkSession
    n, held = n_partitions(spark), _Held(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(learn, F.lit(False)).alias("learn"))
    blocks = held.write("blocks", rows.mapInArrow(_blocks, BLOCKS))
    asked = blocks.select("block", "words", "counts").mapInArrow(_ask(n), SENT)
    answers = held.write("word-answers", asked.repartition(n, "part").sortWithinPartitions("part", "block").mapInArrow(_answer(n), TOLD))
    sums = answers.agg(F.sum("n_tokens"), F.sum("n_words")).first()
    totals = sums[0] or 0, sums[1] or 0
    frequent = spark.sparkContext.broadcast(_frequent(answers, totals[0]))  # at most 1 / FREQUENT words
    told = answers.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("part", "data", F.lit(n).alias("parts"))).alias("told"))
    base = held.bucketed("base", blocks.drop("counts").join(told, "block").mapInArrow(_numbered, BASE), n)
    held.drop("blocks", "word-answers")

    parts = parts_for(totals[0], part_tokens)
    about = held.write("documents", base.mapInArrow(_roots(totals, frequent), DOCS))
    level, hots, source, known = 1, {}, base.drop("doc_ids"), None
    while True:
        if level > REPLAYED:
            source = held.write(f"level-{level}", source.mapInArrow(_left(totals, parts, frequent, hots), "block long, carry binary"))
            held.drop("base", *[f"{what}-{k}" for k in range(1, level) for what in ("answers", "level")])
        dealt = source.mapInArrow(_send(totals, parts, frequent, hots), SENT).repartition(max(n, parts), "part").sortWithinPartitions("part", "block")
        answers = held.write(f"answers-{level}", dealt.mapInArrow(_count(totals, frequent, level, least_gain), ANSWERED)).withColumn("level", F.lit(level))
        hot = _hot_states(answers, least_gain)
        hots = {**hots, level: spark.sparkContext.broadcast(hot)}
        found = answers.where("state is null").agg(F.sum("kept")).first()[0] or 0
        known = answers if known is None or level > REPLAYED else known.unionByName(answers)
        listed = known.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("level", "part", "data")).alias("answers"))
        source = (source if level > REPLAYED else base.drop("doc_ids")).join(listed, "block", "left")
        level += 1
        if level > REPLAYED and not found and not hot[1].any():
            break
    left = source.select("block", "carry", "answers") if level > REPLAYED + 1 else source.mapInArrow(_left(totals, parts, frequent, hots), "block long, carry binary").withColumn("answers", F.lit(None).cast("array<struct<level:int,part:int,data:binary>>"))
    scores = held.write("scores", about.join(left, "block").mapInArrow(_scores(totals, parts, frequent, hots), SCORES))
    held.drop("base", "documents", *[f"{what}-{k}" for k in range(1, level) for what in ("answers", "level")])
    return scores


__all__ = ["pack", "score_documents", "tokens", "unpack"]
