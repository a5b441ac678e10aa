"""Content-addressed store of token ids.

Rolling hashes cut each document's ids into chunks, so that an edit changes the chunks around it alone. A chunk's name is
the BLAKE2 digest of its ids; each distinct chunk is stored once. A recipe lists the chunks of a document, a Merkle
manifest covers the recipes in their order.

Files under `path`:
  objects/   kind 'c': name, n, ids (unsigned little-endian, `width` bytes an id)
             kind 'r': doc_id, n, names (array) and root (digest of the names) of one document
  recipes/   doc_id, uid, start, n, names, root, range_part: ascending doc_id, null first, `start` gapless from 0
  manifest/  range_part, n_docs, n_tokens, root: one Merkle root for each range of recipes
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodmark.llm.common import n_partitions, prefix_sums
from floodmark.llm.tokens import encoder, groups

OBJECTS = "name binary, kind string, n long, width int, ids binary, doc_id long, names array<binary>, root binary"
WINDOW_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
SPREAD = np.uint64(0xD6E8FEB86659FD93)
#: A chunk ends where this many top bits of the rolling hash are zero: 2**9 ids on average.
CUT_BITS, LEAST, MOST = 9, 64, 4096
#: Recipes are a small part of the store, and go to as many times fewer files than its chunks.
SLIM = 8


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks. The polynomial hash of the last 16 ids decides, so equal runs are cut alike wherever they stand."""
    n = len(ids)
    h = (ids.astype(np.uint64) + np.uint64(1)) * SPREAD
    h ^= h >> np.uint64(29)
    base = WINDOW_BASE
    with np.errstate(over="ignore"):
        for width in (1, 2, 4, 8):
            if n > width:
                step = h.copy()
                step[width:] += h[:-width] * base
                h = step
            base = base * base
    marks = np.flatnonzero((h >> np.uint64(64 - CUT_BITS)) == 0) + 1
    out, last = [], 0
    for at in [*marks.tolist(), n]:
        while at - last > MOST:
            last += MOST
            out.append(last)
        if at - last >= LEAST or (at == n and at > last):
            last = at
            out.append(at)
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root over digests in order; an odd one at the end goes up as it is, none give the digest of nothing."""
    level = leaves or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\x01" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _objects(path: str, end_id: int):
    def run(batches):
        enc, seen, row = encoder(path), set(), 0
        end, at = np.array([end_id], dtype="<u4").tobytes(), TaskContext.get().partitionId()
        kinds = {f.name: f.type for f in SCHEMA}
        for batch in (b.slice(*some) for b in batches for some in groups(b.column("text"))):
            out = {k: [] for k in kinds}

            def put(out=out, **cells):
                for k, v in out.items():
                    v.append(cells.get(k))

            for doc_id, data in zip(batch.column("doc_id").to_pylist(), enc.encode_all(batch.column("text"))):
                data += end
                ids, last, names = np.frombuffer(data, dtype="<u4"), 0, []
                for stop in cuts(ids):
                    name = digest(data[4 * last : 4 * stop])
                    names.append(name)
                    if name not in seen:
                        seen.add(name)
                        piece = ids[last:stop]
                        width = 2 if int(piece.max()) < 1 << 16 else 4
                        put(name=name, kind="c", n=stop - last, width=width, ids=piece.astype(f"<u{width}").tobytes())
                    last = stop
                put(name=b"r" + digest(f"{at}:{row}".encode()), kind="r", n=len(ids), doc_id=doc_id, names=names, root=merkle(names))
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(out[k], kinds[k]) for k in kinds], list(kinds))

    return run


SCHEMA = pa.schema([("name", pa.binary()), ("kind", pa.string()), ("n", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("doc_id", pa.int64()), ("names", pa.list_(pa.binary())), ("root", pa.binary())])


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Writes docs (doc_id, text) as a store.

    Null and empty texts are documents of the end id alone; rows with the same doc_id, or none, are each kept; other
    columns are ignored; an empty table makes an empty store. Each chunk crosses the network at most once for each task that
    met it, whatever number of documents share it.
    """
    spark = docs.sparkSession
    objects = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_objects(tokenizer, end_id), OBJECTS)
    once = objects.repartition(n_partitions(spark), "name").groupBy("name").agg(*[F.first(c).alias(c) for c in ("kind", "n", "width", "ids", "doc_id", "names", "root")])
    once.write.option("compression", "zstd").parquet(f"{path}/objects")
    recipes = spark.read.parquet(f"{path}/objects").where("kind = 'r'").select("doc_id", F.hex("name").alias("uid"), "n", "names", "root")
    few = max(1, n_partitions(spark) // SLIM)
    recipes = prefix_sums(recipes, ["doc_id", "uid"], "n", "start", files=few)
    recipes.coalesce(few).sortWithinPartitions("range_part", "doc_id", "uid").write.option("compression", "zstd").parquet(f"{path}/recipes")
    ranges(spark.read.parquet(f"{path}/recipes")).coalesce(few).write.parquet(f"{path}/manifest")


def ranges(recipes: DataFrame) -> DataFrame:
    """One Merkle root over the roots of each range's documents in order."""

    def run(batches):
        # a range's rows come sorted; only 16 bytes a document are held
        part, roots, tokens = None, [], 0
        done = []
        for b in batches:
            for p, n, r in zip(b.column("range_part").to_pylist(), b.column("n").to_pylist(), b.column("root").to_pylist()):
                if p != part and roots:
                    done.append((part, len(roots), tokens, merkle(roots)))
                    roots, tokens = [], 0
                part, tokens = p, tokens + n
                roots.append(r)
        if roots:
            done.append((part, len(roots), tokens, merkle(roots)))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["range_part", "n_docs", "n_tokens", "root"])

    slim = recipes.select("range_part", "doc_id", "uid", "n", "root").repartition("range_part").sortWithinPartitions("range_part", "doc_id", "uid")
    return slim.mapInArrow(run, "range_part int, n_docs long, n_tokens long, root binary")


def check_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The ranges whose recipes no longer give the manifest's root: no rows for a sound store."""
    kept = spark.read.parquet(f"{path}/manifest").select("range_part", F.col("root").alias("kept_root"))
    found = ranges(spark.read.parquet(f"{path}/recipes"))
    return found.join(kept, "range_part", "full").where(~F.col("root").eqNullSafe(F.col("kept_root")))


def _wide(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, dtype=f"<u{width}").astype("<u4").tobytes()


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """name, n and crc32 of each stored chunk, after its ids gave its name again."""

    def run(batches):
        for b in batches:
            names, crcs, sizes = b.column("name").to_pylist(), [], []
            for name, width, ids in zip(names, b.column("width").to_pylist(), b.column("ids").to_pylist()):
                data = _wide(ids, width)
                if digest(data) != name:
                    raise ValueError(f"chunk {name.hex()} of the token store doesn't hold its own ids")
                crcs.append(zlib.crc32(data))
                sizes.append(len(data) // 4)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], ["name", "chunk_n", "crc"])

    return spark.read.parquet(f"{path}/objects").where("kind = 'c'").select("name", "width", "ids").mapInArrow(run, "name binary, chunk_n long, crc long")


_ZEROS = bytes(1 << 16)


@lru_cache(maxsize=8192)
def _zeros_crc(size: int, start: int = 0) -> int:
    return _over_zeros(start, size)


def _over_zeros(crc: int, size: int) -> int:
    """The checksum `crc` carried on over `size` zero bytes."""
    view = memoryview(_ZEROS)
    while size > len(_ZEROS):
        crc, size = zlib.crc32(_ZEROS, crc), size - len(_ZEROS)
    return zlib.crc32(view[:size], crc)


def join_crc(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of concatenated pieces from each one's (bytes, CRC-32).

    A checksum carried on over a piece is an affine function of where it started, so it differs from the piece's own as it would
    over as many zeros.
    """
    out = 0
    for size, crc in parts:
        out = _over_zeros(out, size) ^ _zeros_crc(size) ^ crc
    return out


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and the root of each document as the files have it.

    Chunks are read and verified where they lie; only their names, lengths and checksums are joined with the recipes, and a
    document's checksum is put together from those of its chunks in order.
    """
    recipes = spark.read.parquet(f"{path}/recipes")

    def run(batches):
        for b in batches:
            cols = {k: b.column(k).to_pylist() for k in ("doc_id", "start", "n", "root", "parts")}
            crcs = []
            for n, root, parts in zip(cols["n"], cols["root"], cols["parts"]):
                parts = sorted(parts, key=lambda p: p["pos"])
                if sum(p["chunk_n"] or 0 for p in parts) != n or merkle([p["name"] for p in parts]) != root:
                    raise ValueError("a recipe of the token store doesn't match its chunks")
                crcs.append(join_crc([(4 * p["chunk_n"], p["crc"]) for p in parts]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n"), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    refs = recipes.select("uid", F.posexplode("names").alias("pos", "name")).join(read_chunks(spark, path), "name", "left")
    parts = refs.groupBy("uid").agg(F.collect_list(F.struct("pos", "name", "chunk_n", "crc")).alias("parts"))
    return recipes.select("uid", "doc_id", "start", "n", "root").join(parts, "uid").select("doc_id", "start", "n", "root", "parts").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ids (array<int>) of every document, rebuilt from its chunks."""
    chunks = spark.read.parquet(f"{path}/objects").where("kind = 'c'").select("name", "width", "ids")
    recipes = spark.read.parquet(f"{path}/recipes")
    refs = recipes.select("uid", F.posexplode("names").alias("pos", "name")).join(chunks, "name")

    def run(batches):
        for b in batches:
            ids = [np.frombuffer(b"".join(_wide(p["ids"], p["width"]) for p in sorted(parts, key=lambda p: p["pos"])), dtype="<u4").astype(np.int64).tolist() for parts in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "start", "ids"])

    parts = refs.groupBy("uid").agg(F.collect_list(F.struct("pos", "width", "ids")).alias("parts"))
    return recipes.select("uid", "doc_id", "start").join(parts, "uid").select("doc_id", "start", "parts").mapInArrow(run, "doc_id long, start long, ids array<long>")
