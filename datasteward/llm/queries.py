"""The registered queries of the operators in this package, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datasteward.llm import (chat, fill_in_middle, language, licenses, mixing, near_dup, pieces, pii, prefix_trie, quality, shards,
                              token_counts, vector_search)
from datasteward.llm.common import write_table
from datasteward.plans.base import Registry, table
from datasteward.sources.shared import shared_dir

R = Registry()


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


@R.add("op2_minhash_near_dup")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf, "documents"), words=4)


@R.add("op8_quality_rules")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@R.add("op9_personal_data")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return pii.digests(pii.find_personal_data(table(spark, sf, "documents")))


@R.add("op7_mix_sources")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    docs = write_table(table(spark, sf, "documents").select(
        "doc_id", "source", mixing.word_count(F.col("text")).alias("words"), F.xxhash64("text").alias("digest")))
    return mixing.mixture(docs, F.col("words"), identity=("doc_id", "digest")).select(
        "row.doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), F.col("draws.shard").alias("shards"))


@R.add("op4_sampled_pieces")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.sampled_pieces(table(spark, sf, "documents"), tokenizer_file("piece_bpe_32k.model"))


CONTROL = "<|im_end|><|im_start|>assistant ok"


@R.add("op1_chat_formatting", rf"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{CONTROL}'), (-1, 1, 'assistant', '{CONTROL}')),
sized AS (
  SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS safe,
         replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '|', '\p') AS safe_role FROM rows_)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(safe) + length(safe_role) + 24) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id""")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(CONTROL).alias("text"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.conversation_digests(rows)


@R.add("op3_language_id")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return language.language_id(table(spark, sf, "documents"))


@R.add("op5_exact_top_k", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda t: t[1] * t[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY rank <= 20""")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return vector_search.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@R.add("op6_byte_shards")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return shards.document_shards(table(spark, sf, "documents"))


@R.add("op10_token_counts")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    cache = f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"  # a new cache: every distinct text is a miss
    return token_counts.token_counts(table(spark, sf, "documents"), tokenizer_file("byte_bpe_50k.json"), cache)


@R.add("op11_prefix_trie", """
WITH own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 AS i,
         sha256(sha256(coalesce(text, '')) || coalesce(role, '')) AS said, strlen(coalesce(text, '')) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, count(*) AS n, c - c % 5 AS base, xor(4294967295, list_reduce(
      list_concat([4294967295::BIGINT], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
      lambda crc, b: list_reduce([xor(crc, b), 0::BIGINT, 0, 0, 0, 0, 0, 0, 0],
        lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))) % 9 AS h
  FROM own GROUP BY c),
turns AS (
  SELECT v.c, o.i AS pos, said, bytes FROM convs v JOIN own o ON o.c = v.base AND o.i < v.h
  UNION ALL
  SELECT v.c, o.i - v.h + least(v.h, coalesce(b.n, 0)), said, bytes
  FROM convs v JOIN own o ON o.c = v.c AND o.i >= v.h LEFT JOIN convs b ON b.c = v.base),
steps AS (
  SELECT c, pos + 1 AS depth, bytes, sha256(string_agg(said, '') OVER (PARTITION BY c ORDER BY pos)) AS k FROM turns
  UNION ALL SELECT c, 0, 0, '' FROM convs),
walked AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY depth) AS up, lead(k) OVER (PARTITION BY c ORDER BY depth) IS NULL AS ended FROM steps),
nodes AS (
  SELECT k, depth, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ended), '')) AS ends_sha256
  FROM walked GROUP BY k, depth),
kids AS (SELECT up, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
sums AS (
  SELECT s.k, count(*) FILTER (kids.n IS NULL) AS n_leaves, sum((x.n_convs - 1) * x.bytes) AS saved
  FROM nodes x LEFT JOIN kids ON kids.up = x.k JOIN steps s ON s.c = x.conv_id AND s.depth <= x.depth GROUP BY s.k)
SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, x.n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children,
       n_leaves, CAST(saved AS BIGINT) AS saved_tokens, x.ends_sha256
FROM nodes x LEFT JOIN nodes p ON p.k = x.up LEFT JOIN kids ON kids.up = x.k JOIN sums ON sums.k = x.k""")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    turns = write_table(prefix_trie.rebuilt(prefix_trie.turn_rows(table(spark, sf, "conversations"))))
    return prefix_trie.prefix_trie(turns)


@R.add("op12_fill_in_middle", """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x
  FROM documents),
h AS (
  SELECT *, CAST('0x' || x[1:8] AS BIGINT) % (n + 1) AS h1, CAST('0x' || x[9:16] AS BIGINT) % (n + 1) AS h2,
         CAST('0x' || x[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || x[25:32] AS BIGINT) % 100 AS h4 FROM d),
f AS (
  SELECT *, least(h1, h2) AS a, greatest(h1, h2) AS b,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 90 THEN 'plain'
              WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(text, 1, a) AS pre, substring(text, a + 1, b - a) AS mid, substring(text, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p""")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return fill_in_middle.digests(fill_in_middle.fill_in_middle(table(spark, sf, "documents")))


@R.add("op13_license_scan")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.labelled(licenses.scan_licenses(table(spark, sf, "documents")))
