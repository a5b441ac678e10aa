"""The queries over whole tables that `__spark_entry__` registers, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodmark.llm import chat, decontamination, licenses, merkle, packing, quality, sharding, simhash, suffix_tree, token_store
from floodmark.llm.common import fresh_path, table
from floodmark.llm.tokens import public_path


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.read_back(chat.format_turns(turns))


def held_out(modulus: int, remainder: int, doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus)) == remainder


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = quality.train(docs, table(spark, sf_dir, "labels"), learnable=~held_out(5, 0))
    scored = quality.score(docs, machine)
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), public_path(), most=2048, with_ids=False).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    found = decontamination.scan_documents(docs, table(spark, sf_dir, "benchmark"), window=8)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    n_items = F.size("items").cast("long")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_items >= 2).alias("contaminated"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), size=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("text_hash"))
    placed = sharding.shard_records(docs, "size", ["text_hash"], n_shards=24, law="bytes")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_suffix_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = suffix_tree.score_documents(table(spark, sf_dir, "documents"), ~held_out(7, 2))
    return scored.select("doc_id", F.coalesce(held_out(7, 2), F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = merkle.with_next(merkle.fingerprints(docs), ["text", "fingerprint"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = docs.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    edited = merkle.fingerprints(edited, "edited", "edited_fingerprint")
    return edited.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", merkle.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), merkle.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scan(docs, licenses.train(docs))
    families = F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["family"])))
    places = F.array_join(F.transform("licences", lambda x: F.concat(x["paragraph"].cast("string"), F.lit(":"), x["family"])), ",")
    return found.select("doc_id", "n_paragraphs", F.size("licences").cast("long").alias("n_licences"), F.array_join(families, ",").alias("families"), places.alias("places"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), path, public_path())
    return token_store.read_digests(spark, path)


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_quality": op2_quality,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_decontamination": op4_decontamination,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_sharding": op6_sharding,
    "op7_suffix_tree_score": op7_suffix_tree_score,
    "op8_merkle_fingerprint": op8_merkle_fingerprint,
    "op9_license_scan": op9_license_scan,
    "op10_token_store": op10_token_store,
}
OP1_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(text) + (length(text) - length(replace(text, '\', ''))) + (length(text) - length(replace(text, '### ', ''))) // 4
             + (length(text) - length(replace(text, '</turn>', ''))) // 7
             + CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 ELSE 15 END + 8 AS formatted FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(formatted) AS BIGINT) AS formatted_chars, true AS valid
FROM e GROUP BY conv_id
"""

OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(ws), 8) AS n, array_to_string(ws[k:k + least(len(ws), 8) - 1], ' ') AS win
      FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 0) + 2)) AS k FROM i WHERE len(ws) > 0)),
d AS (SELECT doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') AS win
      FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM w, (SELECT DISTINCT n FROM g) WHERE len(ws) >= n)),
m AS (SELECT d.doc_id, d.n, d.k, g.item_id FROM d JOIN g ON d.n = g.n AND d.win = g.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM m GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op1_chat_format": OP1_SQL,
    "op4_decontamination": OP4_SQL,
}
