"""Quality classifier: a factorisation machine over hashed words, word shapes, structure statistics and the text's length.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)), the second part being all
pairwise interactions in time linear in the features. It is fitted on a sample of labelled rows, of at most `train_rows`
(a bound on the driver's memory), and scores every text whole. Neither labels nor lang, source or doc_id are features.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words and shapes share 2**BUCKET_BITS - STAT_SLOTS buckets; statistics have slots of their own at the end.
BUCKET_BITS, STAT_BINS, CACHE_WORDS = 16, 16, 200_000
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SYMBOLS = bytes(c for c in range(33, 127) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
_LETTERS, _NUMBERS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")
N_STATS = 14
STAT_SLOTS = N_STATS * STAT_BINS
BUCKETS = (1 << BUCKET_BITS) - STAT_SLOTS


class _Hashes(dict):
    """Word to its bucket and its shape's."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        case = "A" if word.isupper() else "Aa" if word[:1].isupper() else "a"
        shape = _NUMBERS.sub("0", _LETTERS.sub(case, word))
        both = zlib.crc32(word.lower().encode()) % BUCKETS, zlib.crc32(b"\x00" + shape.encode()) % BUCKETS
        self[word] = both
        return both


_HASHES = _Hashes()


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    """N_STATS numbers from 0 to 1."""
    data = text.encode()
    size, n = max(1, len(data)), max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    share = lambda drop: 1 - len(data.translate(None, drop)) / size
    log = lambda x, top: min(1.0, math.log1p(x) / top)
    top = max(counts.values(), default=0)
    return [
        log(len(text), 12), log(len(words), 10), log(len(lines), 7), min(1.0, size / n / 20),
        share(_UPPER), share(_DIGITS), min(1.0, 2 * share(_SYMBOLS)), share(b"!?"), share(b"|<>{}[]#$%&*=~^_\\"),
        len(counts) / n if words else 0.0, top / n,
        len(set(lines)) / len(lines) if lines else 0.0,
        sum(len(x) < 20 for x in lines) / len(lines) if lines else 0.0,
        sum(c for w, c in counts.items() if not any(map(str.isalnum, w))) / n,
    ]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: words and shapes each of unit length, one slot for the bin of each statistic."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    both = np.array([_HASHES[w] for w in counts], dtype=np.int64).reshape(-1, 2)
    n = np.log1p(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)))
    out_i, out_x = [], []
    for k in range(2):
        bins, where = np.unique(both[:, k], return_inverse=True)
        x = np.bincount(where, weights=n, minlength=len(bins)) if len(bins) else np.empty(0)
        out_i.append(bins)
        out_x.append(x / max(1e-9, math.sqrt(float((x * x).sum()))))
    stats = statistics(text, words, counts)
    out_i.append(BUCKETS + np.arange(N_STATS) * STAT_BINS + np.minimum(STAT_BINS - 1, (np.array(stats) * STAT_BINS).astype(np.int64)))
    out_x.append(np.full(N_STATS, 1 / math.sqrt(N_STATS)))
    return np.concatenate(out_i), np.concatenate(out_x)


class Machine:
    """Weights of a fitted factorisation machine, one row for each bucket and slot."""

    def __init__(self, bias: float, linear: np.ndarray, factors: np.ndarray):
        self.bias, self.linear, self.factors = bias, linear, factors

    def score(self, i: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[i] * x[:, None]
        z = self.bias + float(self.linear[i] @ x) + 0.5 * float((v.sum(axis=0) ** 2 - (v * v).sum(axis=0)).sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, factors: int = 8, epochs: int = 12, rate: float = 0.1, decay: float = 2e-4, least_rows: int = 3, seed: int = 7) -> Machine:
    """Adagrad on the logistic loss, both labels weighing the same. A bucket met in fewer than `least_rows` rows keeps weight zero. With no rows, or labels of
    one kind, the score is the labels' smoothed share everywhere."""
    share = (float(labels.sum()) + 1) / (len(labels) + 2)
    size = 1 << BUCKET_BITS
    linear, v = np.zeros(size), np.zeros((size, factors))
    weight = np.where(labels == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    bias = math.log(share / (1 - share))
    if not len(labels) or labels.min() == labels.max():
        return Machine(bias, linear.astype(np.float32), v.astype(np.float32))
    rng = np.random.default_rng(seed)
    seen = np.bincount(np.concatenate([i for i, _ in rows]), minlength=size)
    rows = [(i[seen[i] >= least_rows], x[seen[i] >= least_rows]) for i, x in rows]
    used = seen >= least_rows
    v[used] = rng.normal(0, 0.05, (int(used.sum()), factors))
    sum_w, sum_v, sum_b = np.full(size, 1e-6), np.full((size, factors), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            some = order[at : at + 64]
            i = np.concatenate([rows[r][0] for r in some])
            x = np.concatenate([rows[r][1] for r in some])
            d = np.repeat(np.arange(len(some)), [len(rows[r][0]) for r in some])
            vx = v[i] * x[:, None]
            sums = np.zeros((len(some), factors))
            np.add.at(sums, d, vx)
            z = bias + np.bincount(d, linear[i] * x, len(some)) + 0.5 * ((sums**2).sum(axis=1) - np.bincount(d, (vx * vx).sum(axis=1), len(some)))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some]) * weight[some] / len(some)
            keys, where = np.unique(i, return_inverse=True)
            gw = np.bincount(where, g[d] * x, len(keys)) + decay * linear[keys] / len(some)
            gv = np.zeros((len(keys), factors))
            np.add.at(gv, where, (g[d] * x)[:, None] * (sums[d] - vx))
            gv += decay * v[keys]
            sum_w[keys] += gw**2
            sum_v[keys] += gv**2
            sum_b += g.sum() ** 2
            linear[keys] -= rate * gw / np.sqrt(sum_w[keys])
            v[keys] -= rate * 0.3 * gv / np.sqrt(sum_v[keys])
            bias -= rate * g.sum() / math.sqrt(sum_b)
    return Machine(bias, linear.astype(np.float32), v.astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = 6000, learnable=None) -> Machine:
    """Fits on labels (doc_id, quality) of docs (doc_id, text) for which `learnable`, a condition on doc_id, holds.

    At most `train_rows` labelled rows, those of least hash of doc_id and label, are used; null ids or labels never are.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("doc_id is not null and quality is not null")
    if learnable is not None:
        known = known.where(learnable)
    some = known.orderBy(F.xxhash64("doc_id", "quality"), "doc_id", "quality").limit(train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array([i.astype("<i4").tobytes() for i, _ in found], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in found], pa.binary())], ["doc_id", "quality", "i", "x"])

    joined = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(some), "doc_id")  # at most train_rows rows
    got = joined.select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, i binary, x binary").collect()
    got.sort(key=lambda r: (r.doc_id, r.quality, bytes(r.i)))
    rows = [(np.frombuffer(r.i, dtype="<i4").astype(np.int64), np.frombuffer(r.x, dtype="<f4").astype(np.float64)) for r in got]
    return fit(rows, np.array([r.quality for r in got], dtype=float))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """docs with `score`, the probability of label 1. Null and empty texts are scored by their statistics alone; every other
    column, clashing names but `score` included, is kept as it is, and so are repeated rows."""
    sent = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.linear, machine.factors))  # 2**BUCKET_BITS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine(*sent.value)
        for b in batches:
            scores = [m.score(*features(t)) for t in b.column("text").to_pylist()]
            yield b.append_column("score", pa.array(scores, pa.float64()))

    kept = docs.drop("score").withColumn("text", F.col("text").cast("string"))
    return kept.mapInArrow(run, kept.select("*", F.lit(0.0).cast("double").alias("score")).schema)
