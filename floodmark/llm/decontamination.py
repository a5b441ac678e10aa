"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

Documents stream through the automaton word by word; at each word it knows the longest run of words, ending there, that
some item also has. A run of `window` words is over the length limit; an item shorter than that is over the coverage limit
when a document holds all of it. Words of either kind are hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodmark.llm.common import parts_for, staged

#: Bytes of item texts that one automaton takes; more items are scanned in further blocks.
BLOCK_BYTES = 2_000_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SCANNED = "row long, doc_id long, n_words long, spans array<struct<start:long,stop:long>>, items array<string>"


def words(text: str | None) -> list[bytes]:
    """Runs of digits, letters and anything outside ASCII, with A-Z lowered; null has none."""
    return text.encode().translate(_LOWER).split() if text else []


class SuffixAutomaton:
    """States of all runs of words of the items; `window` is the length limit."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.ids.setdefault(w, len(self.ids)) for w in ws]) for name, ws in items if ws]
        for _, ws in coded:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        self.window_items: dict[int, set[str]] = {}
        short: dict[int, list[tuple[int, str]]] = {}
        for name, ws in coded:
            state = 0
            for k, w in enumerate(ws, 1):
                state = self.next[state][w]
                if k >= window:
                    while self.length[self.link[state]] >= window:
                        state = self.link[state]
                    self.window_items.setdefault(state, set()).add(name)
            if len(ws) < window:
                short.setdefault(state, []).append((len(ws), name))
        # for each state: the one that holds its last `window` words, and the short items that it ends with
        self.top = [0] * len(self.link)
        self.short: list[list[tuple[int, str]]] = [[]] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[s]
            self.top[s] = self.top[up] if self.length[up] >= window else s
            self.short[s] = short.get(s, []) + self.short[up]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.length) - 1

    def _split(self, at: int, w: int, to: int) -> int:
        """The part of state `to` that is one word longer than `at`, as a state of its own."""
        twin = self._state(self.length[at] + 1, self.link[to], dict(self.next[to]))
        self.link[to] = twin
        while at >= 0 and self.next[at].get(w) == to:
            self.next[at][w] = twin
            at = self.link[at]
        return twin

    def _extend(self, last: int, w: int) -> int:
        known = self.next[last].get(w)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, w, known)
        new, at = self._state(self.length[last] + 1, 0, {}), last
        while at >= 0 and w not in self.next[at]:
            self.next[at][w] = new
            at = self.link[at]
        if at >= 0:
            to = self.next[at][w]
            self.link[new] = to if self.length[to] == self.length[at] + 1 else self._split(at, w, to)
        return new

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint spans of hit words in order, and the items that they come from."""
        following, link, length, top, short, window = self.next, self.link, self.length, self.top, self.short, self.window
        get, spans, found, state, run = self.ids.get, [], set(), 0, 0
        for i, w in enumerate(map(get, ws), 1):
            if w is None:
                state = run = 0
                continue
            to = following[state].get(w)
            if to is None:
                while state and w not in following[state]:
                    state = link[state]
                run = length[state]
                to = following[state].get(w)
                if to is None:
                    run = 0
                    continue
            state, run = to, run + 1
            reach = 0
            if run >= window:
                reach = run
                found |= self.window_items[top[state]]
            for n, name in short[state]:
                if n <= run:
                    found.add(name)
                    reach = max(reach, n)
            if reach:
                start = i - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i))
        return spans, found


_BUILT: dict[tuple[str, int], SuffixAutomaton] = {}


def _scanner(items, key: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (key, window) not in _BUILT:
            _BUILT.clear()
            _BUILT[key, window] = SuffixAutomaton([(name, words(text)) for name, text in items.value], window)
        automaton = _BUILT[key, window]
        kinds = (pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.list_(pa.string()))
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for text in b.column("text").to_pylist():
                ws = words(text)
                spans, found = automaton.scan(ws)
                for cells, x in zip(out, (len(ws), [{"start": s, "stop": e} for s, e in spans], sorted(found))):
                    cells.append(x)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), *[pa.array(x, t) for x, t in zip(out, kinds)]], ["row", "doc_id", "n_words", "spans", "items"])

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans = [[{"start": s, "stop": e} for s, e in merged([(x["start"], x["stop"]) for x in row])] for row in b.column("spans").to_pylist()]
        yield b.set_column(3, "spans", pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))))


def scan_documents(docs: DataFrame, benchmark: DataFrame, window: int = 8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """row, doc_id, n_words, spans of hit words and the items found, for each row of docs (row, doc_id, text).

    benchmark has item_id and text. Its texts are broadcast in blocks of at most about `block_bytes`; each block's automaton
    sees every document, and the blocks' spans are joined for each row. Null texts have no words and no spans; items
    without words are never found; repeated items or item ids count once for each id.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    blocks = parts_for(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0, block_bytes)
    if blocks > 1:
        items = staged(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "items")
        docs = staged(docs, "scanned")
    out = None
    for k in range(blocks):
        rows = sorted((r.item_id, r.text) for r in (items if blocks == 1 else items.where(F.col("block") == k)).select("item_id", "text").toLocalIterator())
        sent = docs.sparkSession.sparkContext.broadcast(rows)
        found = docs.select("row", F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scanner(sent, f"{sent._jbroadcast.id()}", window), SCANNED)
        out = found if out is None else out.unionByName(found)
    if blocks > 1:
        out = out.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).mapInArrow(_merge, SCANNED)
    return out


def remove_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of the spans (start, stop) and what stands between the words of a span."""
    if not text or not spans:
        return text
    places = [m.span() for m in _WORD.finditer(text.translate({c: c + 32 for c in range(65, 91)}))]
    out, at = [], 0
    for s, e in spans:
        out.append(text[at : places[s][0]])
        at = places[e - 1][1]
    out.append(text[at:])
    return "".join(out)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 8, most_coverage: float = 0.8) -> DataFrame:
    """docs (doc_id, text, n_chars and others) with hit spans cut out of the texts; n_chars follows.

    A document of whose words more than `most_coverage` are hit goes. Untouched texts, null and empty ones too, stay as they
    are. Rows are told apart by place, so repeated doc_ids are each treated on their own text.
    """
    rows = staged(docs.withColumn("_row", F.monotonically_increasing_id()), "decontaminated")
    found = scan_documents(rows.select(F.col("_row").alias("row"), "doc_id", "text"), benchmark, window).where(F.size("spans") > 0)
    hits = staged(found.select(F.col("row").alias("_row"), F.col("n_words").alias("_words"), F.col("spans").alias("_spans")), "hits")  # read twice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = [remove_spans(t, [(x["start"], x["stop"]) for x in s or []]) for t, s in zip(b.column("text").to_pylist(), b.column("_spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(cut, pa.string())], ["_row", "_cut"])

    touched = rows.select("_row", "text").join(hits, "_row")
    covered = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    gone = hits.where(covered > most_coverage * F.col("_words")).select("_row")
    cut = touched.mapInArrow(run, "_row long, _cut string")
    out = rows.join(gone, "_row", "left_anti").join(cut.withColumn("_touched", F.lit(True)), "_row", "left")
    changed = {"text": F.when(F.col("_touched"), F.col("_cut")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_touched"), F.length("_cut").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumns(changed).select(*docs.columns)
