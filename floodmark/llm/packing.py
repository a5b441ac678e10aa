"""Best-fit packing of token pieces into sequences under several capacities.

A document longer than a sequence is cut into pieces of the full length, the first of which takes what is left over; others
stay whole. A sequence has three residual capacities: tokens, documents and attention cost (the sum of squared piece
lengths). Pieces go, longest first, to the open sequence that fits under every constraint and scores best: the least
weighted norm of what would be left ("norm"), or the least weighted dot product of demand and residual ("dot").

Pieces are dealt to shards of about `shard_tokens` by a hash, each shard is packed by itself, and the pieces of sequences
that stayed under `keep_fill` are dealt to fewer shards and packed once more.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodmark.llm.common import parts_for, staged
from floodmark.llm.tokens import encoder, groups

PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long, ids binary"
PLACED = "doc_id long, row long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, filled long"


def piece_lengths(n: int, most: int) -> list[int]:
    first = (n - 1) % most + 1
    return [first] + [most] * ((n - first) // most)


def cut_pieces(docs: DataFrame, tokenizer: str, most: int = 2048, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Pieces of docs (row, doc_id, text) with the crc32 of their ids, and the ids themselves if asked for."""

    def run(batches):
        enc, end = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for b in (b.slice(*some) for b in batches for some in groups(b.column("text"))):
            out = []
            for row, doc_id, data in zip(b.column("row").to_pylist(), b.column("doc_id").to_pylist(), enc.encode_all(b.column("text"))):
                data, at = data + end, 0
                for k, n in enumerate(piece_lengths(len(data) // 4, most)):
                    ids = data[4 * at : 4 * (at + n)]
                    out.append((doc_id, row, k, at, n, zlib.crc32(ids), ids if with_ids else None))
                    at += n
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["doc_id", "row", "piece", "start", "length", "ids_crc32", "ids"])

    return docs.select("row", F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def vector_best_fit(lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float] = (1.0, 0.02, 0.1), rule: str = "norm") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, filled tokens of its bin) of each piece. Raises if one piece exceeds a capacity by itself.

    Ties go to the sequence opened first; equal lengths keep their order.
    """
    caps = np.array(capacity, dtype=float)
    w = np.array(weights, dtype=float)[:, None]
    n = len(lengths)
    where, offset = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    left = np.empty((3, 16))
    names = np.empty(16, dtype=np.int64)
    filled: list[int] = []
    opened = 0
    order = np.argsort(-lengths, kind="stable")
    least = int(lengths.min()) if n else 0
    for i in order.tolist():
        size = int(lengths[i])
        need = np.array([size, 1.0, float(size) * size])
        if (need > caps).any():
            raise ValueError(f"a piece of {size} tokens exceeds the capacity {capacity}")
        at = -1
        if opened:
            now = left[:, :opened]
            fits = np.flatnonzero((now >= need[:, None]).all(axis=0))
            if len(fits):
                room = now[:, fits]
                if rule == "norm":
                    score = (w * ((room - need[:, None]) / caps[:, None]) ** 2).sum(axis=0)
                else:
                    score = (w * (need / caps)[:, None] * (room / caps[:, None])).sum(axis=0)
                at = int(fits[int(score.argmin())])
        if at < 0:
            if opened == left.shape[1]:
                left = np.concatenate([left, np.empty_like(left)], axis=1)
                names = np.concatenate([names, np.empty_like(names)])
            at, opened = opened, opened + 1
            left[:, at] = caps
            names[at] = len(filled)
            filled.append(0)
        b = int(names[at])
        where[i], offset[i] = b, filled[b]
        filled[b] += size
        left[:, at] -= need
        if left[0, at] < least or left[1, at] < 1:  # nothing goes in any more; the last open one takes its place
            opened -= 1
            left[:, at], names[at] = left[:, opened], names[opened]
    return where, offset, np.array(filled, dtype=np.int64)[where] if n else where


def pack_shards(pieces: DataFrame, total: int, shard_tokens: int, capacity: tuple[int, int, int], rule: str, first_id: int) -> DataFrame:
    shards = parts_for(total, shard_tokens)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "piece"], kind="stable")
        bins, offsets, filled = vector_best_fit(pdf["length"].to_numpy(), capacity, rule=rule)
        pdf["sequence_id"] = first_id + (pdf["shard"].to_numpy() << 32) + bins
        return pdf.assign(offset=offsets, filled=filled).drop(columns="shard")

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(run, PLACED)


def pack_documents(docs: DataFrame, tokenizer: str, most: int = 2048, max_docs: int | None = None, max_cost: int | None = None, rule: str = "norm", shard_tokens: int = 2_000_000, keep_fill: float = 0.98, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Pieces of docs (doc_id, text) with sequence_id and offset; every row of docs is a document of its own.

    Null and empty texts are one piece, the end id. max_docs and max_cost default to what never binds. Repeated rows and
    rows without doc_id are each kept; other columns are ignored; an empty table gives no rows. With ids, each piece also
    has its ids as little-endian unsigned 32-bit integers.
    """
    capacity = (most, max_docs or most, max_cost or most * most)
    pieces = staged(cut_pieces(docs.withColumn("row", F.monotonically_increasing_id()), tokenizer, most, end_id, with_ids), "pieces")
    slim = pieces.drop("ids")
    total = slim.agg(F.sum("length")).first()[0] or 0
    once = staged(pack_shards(slim, total, shard_tokens, capacity, rule, 0), "packed")
    full = F.col("filled") >= int(keep_fill * most)
    rest = once.where(~full).agg(F.sum("length")).first()[0] or 0
    out = once.where(full)
    if rest:
        out = out.unionByName(pack_shards(once.where(~full).drop("sequence_id", "offset", "filled"), rest, shard_tokens, capacity, rule, 1 << 62))
    out = out.drop("filled")
    if with_ids:
        out = out.join(pieces.select("row", "piece", "ids"), ["row", "piece"])
    return out.drop("row")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (array<long>) and doc_starts (array<long>) of each packed sequence; needs the pieces' ids."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("offset")
        ids = np.frombuffer(b"".join(pdf["ids"]), dtype="<u4").astype(np.int64)
        return pd.DataFrame({"sequence_id": [pdf["sequence_id"].iloc[0]], "ids": [ids], "doc_starts": [pdf["offset"].to_numpy()]})

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInPandas(run, "sequence_id long, ids array<long>, doc_starts array<long>")


__all__ = ["cut_pieces", "pack_documents", "piece_lengths", "sequences", "vector_best_fit"]
