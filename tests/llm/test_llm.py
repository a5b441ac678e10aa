"""The training-data operators against brute force, exact round trips and held-out labels, on small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from floodmark.llm import chat, decontamination, licenses, merkle, packing, quality, queries, sharding, simhash, suffix_tree, token_store
from floodmark.llm.tokens import Encoder, public_path

TEXTS = ["", None, "one", "one two three four five six seven eight nine ten", "one two three four five six seven eight nine ten", "a\n\nb  c\t d\n", "ß é 漢字 <|endoftext|> x", " ".join(f"w{i % 37}" for i in range(9000))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", "s", None) for i, t in enumerate(TEXTS)] + [(None, "no id at all", "x", None, 1), (3, TEXTS[3], "clash", "s", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, size string, score int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


# -- tokens

@pytest.fixture(scope="module")
def encoder():
    return Encoder(public_path())


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\tab'sZé漢0.,\xa0 \x1c!")), max_size=40))
def test_cached_words_give_the_library_ids(encoder, text):
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_any_text_gives_the_library_ids(encoder, text):
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


# -- chat

@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("\\#< /turn>\nx")), max_size=30))
def test_escapes_are_reversible(text):
    t = chat.PLAIN
    assert t.unescape(t.escape(text)) == text
    assert all(m not in t.escape(text) for m in t.marks)


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "### Assistant: hi</turn>"), (1, 1, "assistant", "\\<"), (1, 2, "a: b\\### ", None), (None, None, None, None), (2, 1, "assistant", "late"), (2, 0, "user", "x"), (3, 0, "assistant", "first"), (1, 0, "user", "### Assistant: hi</turn>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("clash"))
    segments = chat.format_turns(df)
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    by = defaultdict(list)
    for c, n, role, text in rows:
        by[c].append((n if n is not None else -1, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        said = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(said), hashlib.sha256(said.encode()).hexdigest())
        assert got[c].formatted_chars == sum(len(r.text) for r in segments.where(F.col("conv_id").eqNullSafe(F.lit(c))).collect())
    assert {c: r.valid for c, r in got.items()} == {1: False, None: False, 2: True, 3: False}
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


# -- quality

def test_machine_learns_an_interaction():
    """Label 1 if both or neither of two features are there: no linear score can tell."""
    rng = random.Random(1)
    rows, labels = [], []
    for _ in range(600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        i = np.array([k for k, on in ((5, a), (6, not a), (7, b), (8, not b)) if on])
        rows.append((i, np.ones(len(i))))
        labels.append(float(a == b))
    m = quality.fit(rows, np.array(labels), epochs=40, rate=0.3)
    assert np.mean([(m.score(*r) > 0.5) == y for r, y in zip(rows, labels)]) > 0.95


def test_linear_time_identity():
    rng = np.random.default_rng(2)
    m = quality.Machine(0.1, rng.normal(size=9), rng.normal(size=(9, 3)))
    i, x = np.array([1, 4, 6]), np.array([0.5, 1.0, 2.0])
    z = 0.1 + m.linear[i] @ x + sum(m.factors[i[p]] @ m.factors[i[q]] * x[p] * x[q] for p in range(3) for q in range(p))
    assert math.isclose(m.score(i, x), 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    scored = queries.op2_quality(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    r = scored.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("right"), F.count("*").alias("n")).first()
    assert r.n > 50 and r.right > 0.93
    assert scored.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_quality_edges(docs, empty, spark):
    labels = spark.createDataFrame([(3, 1, 0), (None, 0, 0), (0, None, 0)], "doc_id long, quality int, toxic int")
    m = quality.train(docs, labels)
    out = quality.score(docs, m)
    assert out.count() == docs.count() and out.columns == ["doc_id", "text", "row", "size", "score"]
    assert quality.score(empty, quality.train(empty, labels.limit(0))).count() == 0


# -- packing

def test_pieces_and_sequences(docs, empty, encoder):
    packed = packing.pack_documents(docs, public_path(), most=256, shard_tokens=2000)
    rows = packed.collect()
    wanted = sorted(np.frombuffer(encoder.encode(t) + b"\0\0\0\0", "<u4").tobytes() for t in [*TEXTS, "no id at all", TEXTS[3]])
    parts, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length and (r.piece == 0 or r.length == 256)
        parts[r.doc_id].append((r.start, bytes(r.ids)))
        seqs[r.sequence_id].append((r.offset, r.length))
    whole = [b"".join(x for _, x in sorted(p)) for k, p in parts.items() if k != 3]
    assert sorted([*whole, *[x for _, x in parts[3]]]) == wanted
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 256
    assert packing.sequences(packed).where(F.size("ids") > 256).count() == 0
    assert packing.pack_documents(empty, public_path()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60), st.integers(1, 6), st.sampled_from(["norm", "dot"]))
def test_every_capacity_holds(lengths, most_docs, rule):
    lengths = np.array(lengths, dtype=np.int64)
    bins, offsets, filled = packing.vector_best_fit(lengths, (64, most_docs, 3000 if rule == "dot" else 4096), rule=rule) if not len(lengths) or rule == "norm" or lengths.max() <= 54 else (None, None, None)
    if bins is None:
        return
    for b in set(bins.tolist()):
        mine = lengths[bins == b]
        assert mine.sum() <= 64 and len(mine) <= most_docs and (mine**2).sum() <= 4096 and mine.sum() == filled[bins == b][0]
        assert sorted(offsets[bins == b].tolist())[0] == 0


def test_packing_is_near_the_bound():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 1500, 3000)
    bins, _, _ = packing.vector_best_fit(lengths, (2048, 2048, 2048**2))
    assert bins.max() + 1 <= 1.01 * -(-lengths.sum() // 2048)
    with pytest.raises(ValueError):
        packing.vector_best_fit(np.array([3000]), (2048, 9, 2048**2))


# -- decontamination

def brute_hits(ws, items, window):
    hit, found = set(), set()
    for name, item in items:
        n = min(window, len(item))
        wins = {tuple(item[k : k + n]) for k in range(len(item) - n + 1)} if item else set()
        for k in range(len(ws) - n + 1 if n else 0):
            if tuple(ws[k : k + n]) in wins:
                hit |= set(range(k, k + n))
                found.add(name)
    return hit, found


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.lists(st.lists(st.sampled_from("abc"), max_size=14), max_size=5), st.integers(2, 5))
def test_automaton_finds_what_brute_force_finds(ws, items, window):
    ws = [w.encode() for w in ws]
    items = [(str(k), [w.encode() for w in x]) for k, x in enumerate(items)]
    spans, found = decontamination.SuffixAutomaton(items, window).scan(ws)
    hit, names = brute_hits(ws, items, window)
    assert {i for s, e in spans for i in range(s, e)} == hit and found == names
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_decontamination_edges(spark, docs, empty):
    bench = spark.createDataFrame([(1, "two three four five six seven eight nine"), (2, "ONE"), (3, None), (4, ""), (5, "?!"), (2, "one")], "item_id long, text string")
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    one = {r.row: r for r in decontamination.scan_documents(rows, bench).collect()}
    many = {r.row: r for r in decontamination.scan_documents(rows, bench, block_bytes=10).collect()}
    assert {k: (v.n_words, v.spans, v["items"]) for k, v in one.items()} == {k: (v.n_words, v.spans, v["items"]) for k, v in many.items()}
    assert sorted(len(r["items"]) for r in one.values() if r.doc_id == 3) == [2, 2]
    clean = decontamination.decontaminate(docs, bench)
    kept = {r.doc_id: r.text for r in clean.collect()}
    assert 2 not in kept and 3 not in kept and kept[5] == TEXTS[5] and kept[1] is None and clean.columns == docs.columns
    assert decontamination.remove_spans("Say: one, TWO three four!", [(1, 3)]) == "Say:  four!" or decontamination.remove_spans("Say: one, TWO three four!", [(1, 3)]) == "Say:  three four!"
    assert decontamination.decontaminate(empty, bench).count() == 0
    assert decontamination.decontaminate(docs, bench.limit(0)).count() == docs.count()


# -- near duplicates

def brute_components(fps):
    parent = {i: i for i, _ in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(fps):
        for j, b in fps[:n]:
            if (a ^ b).bit_count() <= 4:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in fps}


def test_triples_cover():
    from itertools import combinations

    assert all(any(set(t) <= set(q) for t in simhash.TRIPLES) for q in combinations(range(8), 4)) and len(simhash.TRIPLES) == 20


@pytest.mark.parametrize("list_rows", [2048, 8])
def test_links_are_those_of_brute_force(spark, list_rows):
    """Chains and dense families of fingerprints, with lists short and split."""
    rng = random.Random(4)
    fps = []
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(25):
            fps.append(x)
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
    fps = list(dict.fromkeys(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), ["fp"], list_rows=list_rows)
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    mine, theirs = defaultdict(set), defaultdict(set)
    for k, root in brute_components(list(enumerate(fps))).items():
        theirs[root].add(k)
        mine[roots.get(signed[k], signed[k])].add(k)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_fingerprints_bit_by_bit():
    text = "The QUICK brown\tfox\njumps over\x0bthe lazy dog\xa0again"
    ws = text.lower().replace("\t", " ").replace("\n", " ").replace("\x0b", " ").split(" ")
    hs = [xxhash.xxh64_intdigest(" ".join(ws[k : k + 4]).encode(), 42) for k in range(len(ws) - 3)]
    assert simhash.shingle_bits(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert simhash.shingle_bits(None) == simhash.shingle_bits(" \n") == 0
    assert simhash.shingle_bits("a b") == xxhash.xxh64_intdigest(b"a b", 42)


def test_near_duplicates_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op5_simhash_dedup(spark, sf).collect()}
    fps = [(r.doc_id, simhash.shingle_bits(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {i: f"{x:016x}" for i, x in fps} == {i: r.fingerprint for i, r in got.items()}
    assert brute_components(fps) == {i: r.component_id for i, r in got.items()}


def test_one_of_each_group_stays(spark, docs, empty):
    rng = random.Random(5)
    base = [f"word{rng.randrange(3000)}" for _ in range(400)]
    near = [*base[:200], "changed", *base[201:]]
    rows = [(10, " ".join(base)), (11, " ".join(near)), (12, " ".join(base)), (13, " ".join(f"other{k}" for k in range(100))), (14, None), (15, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(df).collect()) == [10, 13, 14]
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 4").count() == 0
    assert simhash.drop_near_duplicates(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


# -- shards

@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_shards_are_even_and_whole(spark, law):
    rows = [(k, "same" if k % 3 == 0 else f"text {k}", 10 + k % 7) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size long").withColumn("shard", F.lit("clash"))
    out = sharding.shard_records(df, "size", ["text"], 24, law).collect()
    assert sorted(r.doc_id for r in out) == list(range(3000))
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    sizes = [sum(r["size"] if law == "bytes" else 1 for r in x) for x in by.values()]
    assert len(by) == 24 and max(sizes) - min(sizes) <= (2 * 16 if law == "bytes" else 1)


def test_shard_edges(spark, empty):
    assert sharding.shard_records(empty.select("doc_id", F.lit(1).alias("size")), "size", ["doc_id"]).count() == 0
    odd = spark.createDataFrame([(None, None), (None, None), (1, -5)], "doc_id long, size long")
    assert sorted(r.slot for r in sharding.shard_records(odd, "size", ["doc_id"], 1).collect()) == [0, 1, 2]
    plan = sharding.shard_records(odd, "size", ["doc_id"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- language model

def brute_scores(rows):
    """The tree by dictionaries of whole contexts of any length. rows: (text, learnt)."""
    toks = [([w.decode() for w in suffix_tree.tokens(t)] + ["</s>"], l) for t, l in rows]
    c = Counter(w for t, l in toks if l for w in t)
    n, v = sum(c.values()), len(c)
    longest = max(len(t) for t, _ in toks)
    seen = defaultdict(Counter)
    by_length = defaultdict(set)
    for t, l in toks:
        padded = ["<s>", *t]
        for i in range(len(t)):
            for k in range(1, min(longest, i + 1) + 1):
                context = tuple(padded[i + 1 - k : i + 1])
                by_length[k].add(context)
                if l:
                    seen[context][t[i]] += 1
    kept = set()

    def p(context, w):
        if not context:
            return (c[w] + 1) / (n + v + 1)
        up = p(context[1:], w)
        if context not in kept:
            return up
        cs = seen[context]
        return (cs[w] + len(cs) * up) / (sum(cs.values()) + len(cs))

    tested, k = {s for s in by_length[1] if sum(seen[s].values()) >= 2}, 1
    while tested:
        found = set()
        for s in tested:
            cs = seen[s]
            m, u, once = sum(cs.values()), len(cs), sum(x == 1 for x in cs.values())
            gain = sum(x * math.log((x - 1) / p(s[1:], w) / (m + u - 1)) for w, x in cs.items() if x > 1)
            if once:
                gain += once * math.log((u - 1) / (m + u - 2))
            if gain >= 4.0:
                found.add(s)
        kept |= found
        tested = {s for s in by_length[k + 1] if s[1:] in found and s[:-1] in tested and seen[s[:-1]][s[-1]] >= 2}
        k += 1
    out = []
    for t, _ in toks:
        padded, score = ["<s>", *t], 0.0
        for i, w in enumerate(t):
            k = 0
            while tuple(padded[i - k : i + 1]) in kept and k <= i:
                k += 1
            score += math.log10(p(tuple(padded[i + 1 - k : i + 1]), w))
        out.append((len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), score))
    return out, kept


@pytest.mark.parametrize("part_tokens", [10**6, 300])
def test_suffix_tree_scores_are_those_of_brute_force(spark, part_tokens):
    """With 300 tokens a partition, states are hot from 19 tokens on, and the tree grows to contexts of several words."""
    rng = random.Random(6)
    passage = [f"p{k}" for k in range(8)]
    rows = []
    for k in range(160):
        ws = [f"w{int(rng.paretovariate(1)) % 50}" for _ in range(30)]
        tail = passage + ["x", f"y{k % 2}", "x", "x", f"z{k % 2}"]
        rows.append((k, " ".join(ws[:10] + tail[k % 5 :] + ws[10:]), k % 4 != 0))
    rows += [(None, None, True), (200, "", False), (201, "never seen before", False), (0, rows[0][1], True), (202, "long " + "w1 w2 w3 " * 4000, False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, l boolean").withColumn("score", F.lit("clash"))
    got = sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in suffix_tree.score_documents(df, F.col("l"), part_tokens=part_tokens).collect())
    rows = [(t, l) for _, t, l in rows]
    want, kept = brute_scores([*rows[:-1], ("long " + "w1 w2 w3 " * 20, False)])
    assert max(map(len, kept)) >= 3
    want, got = sorted(want[:-1]), got[:-1]
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:3] == w[:3] and abs(g[3] - w[3]) < 1e-9 and abs(g[4] - w[4]) < 1e-9


def test_suffix_tree_edges(spark, docs, empty):
    assert suffix_tree.score_documents(empty, F.lit(True)).count() == 0
    alone = suffix_tree.score_documents(docs, F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.base_score == r.score for r in alone)
    assert len(suffix_tree.score_documents(docs, F.lit(True)).collect()) == len(alone) == docs.count()


# -- Merkle fingerprints

def test_fingerprints_and_edits(spark):
    a = "Title here\nfirst line of text\n\nsecond section\n" + "word " * 60
    texts = [a, a, a.replace("second", "other"), a + " ", "", None, "x\n\n\ny", "x\n\ny\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    fps = [r.f for r in df.select(merkle.fingerprint(F.col("text")).alias("f"), "doc_id").orderBy("doc_id").collect()]
    assert fps[0] == fps[1] and fps[4] == fps[5] and len(set(fps)) == 6
    pair = spark.createDataFrame([(fps[0], fps[1]), (fps[0], fps[2]), (fps[0], fps[4])], "a string, b string")
    got = [(r.n, [tuple(x) for x in r.e]) for r in pair.select(merkle.likeness(F.col("a"), F.col("b")).alias("n"), merkle.edited_branches(F.col("a"), F.col("b")).alias("e")).collect()]
    assert got[0] == (1.0, []) and 0.5 < got[1][0] < 1 and got[1][1] == [(1, 0)] and got[2][0] == 0


def brute_tree(text):
    """The tree by hashlib, from the rules."""
    sha = lambda kind, x: hashlib.sha256((kind + x).encode()).hexdigest()
    runs = lambda n, x: re.findall(r"\s*+(?:\S++\s*+){1,%d}+|\s++" % n, x, re.ASCII)
    shown, sections = [], []
    for section in (text or "").split("\n\n"):
        paragraphs, form = [], ""
        for k, line in enumerate(section.split("\n")):
            found = runs(8, line)
            leaves = [sha("w", x) for x in ([*runs(2, found[0]), *found[1:]] if found and k == 0 else found)]
            paragraphs.append(sha("p", "".join(leaves)))
            form += ";" + paragraphs[-1][:16] + "".join("," + x[:8] for x in leaves)
        sections.append(sha("s", "".join(paragraphs)))
        shown.append(sections[-1][:16] + form)
    return sha("d", "".join(sections)) + ":" + "/".join(shown)


def test_trees_are_those_of_hashlib(spark):
    rng = random.Random(12)
    texts = TEXTS + ["\n", "\n\n", "\n\n\n", " \n a"] + ["".join(rng.choice(["\n", "\n\n", " ", "  ", "\t", "word", "é", "x.", "the "]) for _ in range(rng.randrange(60))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", merkle.fingerprint(F.col("t")).alias("f"))
    for r in df.collect():
        assert r.f == brute_tree(texts[r.i])


def test_next_document(spark, empty):
    rows = [(5, "e"), (3, "c"), (9, "z"), (None, "n"), (3, "c2")]
    out = merkle.with_next(spark.createDataFrame(rows, "doc_id long, text string"), ["text"])
    got = {r.text: r.next_text for r in out.collect()}
    assert got["z"] == "e" and got["n"] == "z" and {got["c"], got["c2"]} & {"n"} and len(got) == 5 and got["e"] in ("c", "c2")
    one = merkle.with_next(spark.createDataFrame([(1, "a")], "doc_id long, text string"), ["text"]).first()
    assert one.next_text == "a"
    assert merkle.with_next(empty.select("doc_id", "text"), ["text"]).count() == 0


def test_edited_texts(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in queries.op8_merkle_fingerprint(spark, sf).collect()}
    assert len(got) == len(docs)
    for k, (i, t) in enumerate(docs):
        n = len(t)
        edited = t[: n - n // 2] + docs[(k + 1) % len(docs)][1][: n // 2]
        assert got[i].n_chars == n and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].near_edited >= 0.3 or n < 60


# -- licences

def test_licences(spark, docs, empty):
    c = licenses.fit(["the quick brown fox jumps over the dog", "we released a new record in the spring"])
    said = [(t, f) for f, ts in licenses.TEMPLATES.items() for t in ts]
    hits = sum([x[1] for x in c.paragraphs(f"Some words.\n{t}\nMore words.")] == [f] for t, f in said)
    assert hits >= 0.95 * len(said)
    assert not any(list(c.paragraphs(t)) for t in licenses.ASIDES)
    long = " ".join(f"word{k}" for k in range(150)) + " Released under the MIT License. " + " ".join(f"word{k}" for k in range(150))
    assert [x[1] for x in c.paragraphs(long)] == ["mit"]
    two = "Released under the MIT License. Licensed under the Apache License, Version 2.0."
    assert [x[1] for x in c.paragraphs(two)] == ["apache-2.0", "mit"]
    assert [x[1] for x in c.paragraphs(f"Some more words first, then this. {two} And then some others, none of which says anything of note.")] == ["apache-2.0", "mit"]


#: Wordings that no template has.
HELD_OUT = {
    "This module is made available under the Apache License, Version 2.0, a copy of which comes with it.": "apache-2.0",
    "Copyright the authors; use is subject to the MIT License.": "mit",
    "The sources are covered by the BSD 3-Clause License.": "bsd",
    "You may copy it under the GNU General Public License, version 3.": "gpl",
    "It is provided under the GNU Lesser General Public License, version 2.1.": "lgpl",
    "The server is offered under the GNU Affero General Public License, version 3.": "agpl",
    "The files here fall under the Mozilla Public License, version 2.0.": "mpl",
    "All plug-ins come under the Eclipse Public License 2.0.": "epl",
    "Headers are covered by the Boost Software License, Version 1.0.": "boost",
    "The text is shared under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
    "Images may be used under the Creative Commons Attribution-NonCommercial 4.0 International License.": "cc-by-nc",
    "Our drawings are in the public domain under CC0 1.0 Universal.": "public-domain",
}
STRANGERS = ["The Apache web server was installed on the new machine in the office.", "She studied at MIT and then moved to the general staff.", "The public domain of the web is large.", "Version 2.0 of the software will be released in May.", "A license to fish is needed at the lake.", "Common creative work with attribution of ideas.", "The terms of the contract were distributed to the members."]


def test_licences_in_other_words():
    c = licenses.fit(["the quick brown fox jumps over the dog", "we released a new record in the spring"])
    got = {t: [x[1] for x in c.paragraphs(t)] for t in HELD_OUT}
    assert not any(f for t, f in got.items() if set(f) - {HELD_OUT[t]})
    assert sum(f == [HELD_OUT[t]] for t, f in got.items()) >= 0.75 * len(HELD_OUT)
    assert not any(list(c.paragraphs(t)) for t in STRANGERS)


def test_scan_is_what_the_classifier_says(spark, docs, empty):
    c = licenses.train(docs)
    rows = [(1, "Licensed under the MIT License.\n\nwords\nSPDX-License-Identifier: MPL-2.0"), (1, "Licensed under the MIT License."), (None, "Licensed under CC BY 4.0."), (3, None), (4, ""), (5, "words " * 50_000 + "Released under the ISC License. " + "words " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("licences", F.lit("clash"))
    got = sorted(((r.doc_id, r.n_paragraphs, [tuple(x) for x in r.licences]) for r in licenses.scan(df, c).collect()), key=str)
    assert got == sorted(((i, (t or "").count("\n") + 1, list(c.paragraphs(t))) for i, t in rows), key=str)
    assert [x[1] for r in got if r[0] == 5 for x in r[2]] == ["isc"] and [x[:2] for r in got if r[0] == 1 and r[1] > 1 for x in r[2]] == [(0, "mit"), (3, "mpl")]
    assert licenses.scan(docs, c).where(F.size("licences") > 0).count() == 0
    assert licenses.scan(empty, licenses.train(empty)).count() == 0


# -- token store

@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=50), max_size=6))
def test_checksums_combine(parts):
    assert token_store.join_crc([(len(p), zlib.crc32(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def test_cuts_follow_content():
    rng = np.random.default_rng(7)
    ids = rng.integers(0, 50000, 20000).astype(np.uint32)
    moved = np.concatenate([ids[:37], ids])
    chunks = lambda x: {x[a:b].tobytes() for a, b in zip([0, *token_store.cuts(x)], token_store.cuts(x))}
    assert len(chunks(ids) & chunks(moved)) > 0.8 * len(chunks(ids))
    assert token_store.cuts(ids)[-1] == len(ids) and max(np.diff([0, *token_store.cuts(ids)])) <= token_store.MOST


def test_store_round_trip(spark, docs, empty, encoder, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_store(docs, path, public_path())
    texts = [("no id at all", None), *[(t, i) for i, t in sorted([*enumerate(TEXTS), (3, TEXTS[3])], key=lambda x: x[0])]]
    at = 0
    digests = sorted(token_store.read_digests(spark, path).collect(), key=lambda r: r.start)
    back = sorted(token_store.read_documents(spark, path).collect(), key=lambda r: r.start)
    for (text, i), r, b in zip(texts, digests, back, strict=True):
        ids = np.frombuffer(encoder.encode(text) + b"\0\0\0\0", "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes())) and b.ids == ids.tolist()
        at += len(ids)
    names = [r.name for r in spark.read.parquet(f"{path}/objects").where("kind = 'c'").collect()]
    assert len(names) == len(set(names)) and token_store.check_manifest(spark, path).count() == 0
    token_store.write_store(empty, str(tmp_path / "none"), public_path())
    assert token_store.read_digests(spark, str(tmp_path / "none")).count() == 0


def test_damage_is_found(spark, docs, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_store(docs, path, public_path())
    objects = spark.read.parquet(f"{path}/objects").withColumn("ids", F.when(F.col("kind") == "c", F.unhex(F.regexp_replace(F.hex("ids"), "^..", "FF"))))
    objects.write.parquet(str(tmp_path / "bad" / "objects"))
    spark.read.parquet(f"{path}/recipes").write.parquet(str(tmp_path / "bad" / "recipes"))
    with pytest.raises(Exception, match="doesn't hold its own ids"):
        token_store.read_digests(spark, str(tmp_path / "bad")).collect()


# -- the pipeline

def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns
        kept = spark.createDataFrame(kept.collect(), docs.schema)
    texts = {r.doc_id: r.text for r in kept.collect()}
    items = [(str(r.item_id), decontamination.words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(brute_hits(decontamination.words(t), items, 8)[1] for t in texts.values())
    sets = {}
    for i, t in texts.items():
        ws = t.lower().split()
        sets[i] = {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))}
    ids = sorted(sets)
    assert not any(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for n, a in enumerate(ids) for b in ids[:n])
    out = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(ids)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


# -- near duplicates by exact similarity

def brute_groups(texts, similarity=0.8):
    """Components of all pairs of texts whose sets of five-word shingles have that Jaccard similarity."""
    sets = []
    for t in texts:
        ws = t.lower().split()
        sets.append({tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))})
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(texts))]


def kept_ids(spark, texts, **more):
    rows = [(k, t) for k, t in enumerate(texts)]
    return sorted(r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **more).collect())


def test_appended_truncated_and_edited_copies_meet(spark):
    """Copies down to a similarity of 0.8, of which byte positions of fingerprints lost some."""
    rng = random.Random(8)
    texts = []
    for k, n in enumerate([20, 60, 60, 150, 150, 400] * 8):
        ws = [f"t{k}w{rng.randrange(4000)}" for _ in range(n)]
        cut = int(n * rng.uniform(0.1, 0.19))
        at = rng.randrange(n - cut)
        texts += [" ".join(ws), " ".join([*ws, *[f"new{k}x{i}" for i in range(cut)]]), " ".join(ws[:-cut]), " ".join([*ws[:at], *[f"e{k}x{i}" for i in range(cut // 2)], *ws[at + cut // 2 :]])]
    want = brute_groups(texts)
    assert len(set(want)) < 80
    assert kept_ids(spark, texts) == sorted(set(want))


def test_long_lists_link_the_same_groups(spark):
    """Large groups of near copies and a line that many texts hold, with lists taken as long and split in blocks."""
    rng = random.Random(9)
    line = "a line that very many of these texts hold word for word"
    texts = []
    for k in range(4):
        ws = [f"g{k}w{rng.randrange(900)}" for _ in range(70)]
        for _ in range(25):
            texts.append(" ".join([line, *ws]))
            for _ in range(1):
                ws[rng.randrange(70)] = f"x{rng.randrange(10**6)}"
    texts += [" ".join([line, *[f"s{k}w{i}" for i in range(rng.randint(3, 12))]]) for k in range(60)]
    want = brute_groups(texts)
    rows = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "row long, doc_id long, text string")
    sets = simhash.shingle_sets(rows, 5, ["n", "shingles"]).dropDuplicates(["node"]).cache()
    ids = {r.node: r.doc_id for r in sets.collect()}
    roots = {ids[r.node]: ids[r.root] for r in simhash.components(simhash.similar_links(sets, 0.8, list_rows=16, short_list=3)).collect()}
    got = [roots.get(k, k) for k in range(len(texts))]
    assert len(set(got)) < len(texts) - 60
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_a_repeated_line_is_one(spark):
    """A copy with lines repeated has nearly the same set of shingles; repeats once outweighed the rest."""
    texts = []
    for k, (n, times) in enumerate([(200, 5), (200, 20), (1000, 50)]):
        ws = [f"r{k}w{i}" for i in range(n)]
        texts += [" ".join(ws), " ".join(ws + ws[-10:] * times)]
    assert kept_ids(spark, texts) == [0, 2, 4]


def test_nothing_below_the_limit_goes(spark):
    """Pairs of similarity 0.65 to 0.79 all stay, beside one of 0.8 that goes."""
    texts = []
    for k, more in enumerate([*range(54, 26, -2), 25]):  # 104 words are 100 shingles, each word more one more
        ws = [f"b{k}w{i}" for i in range(104)]
        texts += [" ".join(ws), " ".join([*ws, *[f"c{k}w{i}" for i in range(more)]])]
    assert kept_ids(spark, texts) == list(range(len(texts) - 1))


def test_the_byte_index_comes_first(spark, monkeypatch):
    """Near duplicates go through the index over fingerprints; what it finds is confirmed by all shingles, the rest follows."""
    base = [f"s{k}" for k in range(600)]
    texts = [" ".join(base), " ".join([*base, "more"]), " ".join(f"o{k}" for k in range(50))]
    found = []
    real = simhash.near_links
    monkeypatch.setattr(simhash, "near_links", lambda *a, **k: found.append(real(*a, **k)) or found[-1])
    assert kept_ids(spark, texts) == [0, 2]
    assert len(found) == 1
    rows = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "row long, doc_id long, text string")
    sets = simhash.shingle_sets(rows, 5, ["n", "fp", "shingles"]).cache()
    ids = {r.node: r.doc_id for r in sets.collect()}
    assert [{ids[r.a], ids[r.b]} for r in simhash.fingerprint_links(sets, 0.8).collect()] == [{0, 1}]
    # no set of another similarity is confirmed, whatever its fingerprint
    alike = sets.withColumn("fp", F.lit(7).cast("long"))
    assert [{ids[r.a], ids[r.b]} for r in simhash.fingerprint_links(alike, 0.8).collect()] in ([{0, 1}], [])


def test_a_shared_passage_ships_no_sets(spark, monkeypatch):
    """Long texts with a passage in common are told apart by small maps; their sets once crossed the network for each such pair."""
    rng = random.Random(12)
    texts = [" ".join([*[f"p{k % 4}x{i}" for i in range(120)], *[f"d{k}w{rng.randrange(10**6)}" for _ in range(1100)]]) for k in range(12)]
    asked = []
    real = simhash.staged

    def counted(df, name, *a, **k):
        out = real(df, name, *a, **k)
        if name == "asked":
            asked.append(out.count())
        return out

    monkeypatch.setattr(simhash, "staged", counted)
    assert kept_ids(spark, texts) == list(range(12))
    assert sum(asked) == 0


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 700), st.integers(0, 700), st.integers(0, 2**32))
def test_parity_maps_lose_no_pair(common, left, right, seed):
    rng = np.random.default_rng(seed)
    h = np.unique(rng.integers(0, 2**63, common + left + right, dtype=np.uint64))
    x, y = h[: len(h) - right], np.concatenate([h[:common], h[len(h) - right :]])
    apart = simhash._bits_apart(*(np.frombuffer(simhash._parities(s), "<u8") for s in (x, y)))
    assert apart <= len(np.setxor1d(x, y))
    if common < 0.3 * (len(h)) and len(h) > 100:
        assert apart > len(x) + len(y) - 2 * simhash._least_overlap(np.int64(len(x) + len(y)), 0.8)


def test_texts_come_in_small_batches(spark):
    """A worker holds the sets of a few texts at a time."""
    rows = spark.range(3500).coalesce(1).selectExpr("id as row", "id as doc_id", "concat('a b c d e f ', id) as text")
    sizes = []

    def count(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with simhash.batches_of(spark, simhash.WIDE_ROWS):
        sizes = [r.n for r in simhash.shingle_sets(rows, 5, ["shingles"]).mapInArrow(count, "n long").collect()]
    assert sum(sizes) == 3500 and max(sizes) <= simhash.WIDE_ROWS
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_workers_give_memory_back():
    """What a worker held in an earlier task once stayed with it through all later ones."""
    from pathlib import Path

    from floodmark.llm import common

    def held():
        return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024

    blocks = [np.ones(60_000, np.uint8) for _ in range(4000)]
    last = [bytes(1000) for _ in range(1000)]
    del blocks
    before = held()
    assert list(common.lean(iter)([1, 2])) == [1, 2] and last
    assert held() < before - 100


def test_wide_rows_are_read_and_written_in_small_pieces(spark):
    """A task holds one row group, and the JVM one batch, of the shingle sets; both once were whole files or 4096 rows."""
    import pyarrow.parquet as pq

    from floodmark.llm import common

    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    with simhash.batches_of(spark, simhash.WIDE_ROWS):
        assert int(spark.conf.get(key)) <= simhash.WIDE_ROWS
    assert spark.conf.get(key) == before
    rows = spark.range(0, 3000, 1, 1).selectExpr("id", *[f"randstr(4000, {k}) as s{k}" for k in range(2)])
    files = [pq.ParquetFile(f.removeprefix("file:")) for f in common.staged(rows, "wide", wide=True).inputFiles()]
    sizes = [f.metadata.row_group(k).total_byte_size for f in files for k in range(f.metadata.num_row_groups)]
    assert len(sizes) > 2 and max(sizes) <= 2 * common.GROUP_BYTES
