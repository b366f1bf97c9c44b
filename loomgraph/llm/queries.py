"""The queries of this subpackage and, where SQL can express one, its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import chat, langid, licences, linecrf, packing, repeats, sharding, simhash, suffixes, urls
from loomgraph.llm.common import table


def third(id_col: str = "doc_id"):
    """crc32 of the identifier as text, modulo 3."""
    return F.crc32(F.col(id_col).cast("string")) % 3


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat.turns_as_calls(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    linked = chat.link(calls, results, {chat.REPLY: chat.REPLY_SCHEMA})
    return linked.select("conv_id", "turn", "call_id", "level", "result_turn", "valid", F.array_join("errors", "; ").alias("errors"), F.sha2(F.col("json").cast("binary"), 256).alias("json_sha256"))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.find(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_items") >= suffixes.LEAST_ITEMS).alias("contaminated"),
    )


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return sharding.shuffle(table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_line_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    field = linecrf.learn(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return linecrf.judge(docs, field).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages", "page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    net = langid.learn(docs, third() != 1)
    out = langid.classify(docs.select("doc_id", "text"), net)
    return out.select("doc_id", F.coalesce(third() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tool_calls": op1_tool_calls,
    "op2_licences": op2_licences,
    "op3_decontamination": op3_decontamination,
    "op4_repeats": op4_repeats,
    "op5_packing": op5_packing,
    "op6_sharding": op6_sharding,
    "op7_simhash": op7_simhash,
    "op8_line_field": op8_line_field,
    "op9_urls": op9_urls,
    "op10_language_id": op10_language_id,
}

_OP1_SQL = r"""
WITH RECURSIVE users AS (
  SELECT conv_id, turn, coalesce(text, '') AS t, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r]+'), lambda x: x <> '')) AS w
  FROM conversations WHERE role = 'user'),
chain AS (
  SELECT conv_id, turn, 0 AS level FROM users u WHERE NOT EXISTS (SELECT 1 FROM users p WHERE p.conv_id = u.conv_id AND p.turn = u.turn - 2)
  UNION ALL
  SELECT u.conv_id, u.turn, level + 1 FROM chain JOIN users u ON u.conv_id = chain.conv_id AND u.turn = chain.turn + 2),
answers AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant')
SELECT u.conv_id, u.turn, 'call-' || u.conv_id || '-' || u.turn AS call_id, CAST(level AS INTEGER) AS level, a.turn AS result_turn, w >= 3 AND t <> '' AS valid,
       concat_ws('; ', CASE WHEN t = '' THEN '$.prompt: too short' END, CASE WHEN w < 3 THEN '$.words: too small' END) AS errors,
       sha256('{"arguments":{"prompt":' || to_json(t) || ',"words":' || w || '},"id":"call-' || u.conv_id || '-' || u.turn || '","name":"reply","result":' || coalesce(CAST(to_json(a.text) AS VARCHAR), 'null') || '}') AS json_sha256
FROM users u JOIN chain c ON c.conv_id = u.conv_id AND c.turn = u.turn LEFT JOIN answers a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
"""

_OP3_SQL = r"""
WITH folded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
probes AS (
  SELECT DISTINCT item_id, least(8, len(w)) AS k, array_to_string(w[i:i + 7], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT k FROM probes),
grams AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM folded, lengths WHERE len(w) >= k)),
hits AS (SELECT doc_id, i, grams.k AS k, item_id FROM grams JOIN probes ON grams.k = probes.k AND grams.g = probes.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT folded.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM folded LEFT JOIN words ON folded.doc_id = words.doc_id LEFT JOIN found ON folded.doc_id = found.doc_id
"""

_OP4_SQL = r"""
WITH split AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS row_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (SELECT row_id, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT row_id, w, unnest(range(1, len(w) - 33)) AS i FROM split WHERE len(w) >= 35)),
often AS (SELECT g FROM runs GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT row_id, unnest(range(i, i + 35)) AS p FROM runs WHERE g IN (SELECT g FROM often)),
places AS (SELECT row_id, list(p) AS ps FROM gone GROUP BY row_id),
left_over AS (
  SELECT split.row_id, string_agg(w[p], ' ' ORDER BY p) AS kept
  FROM (SELECT row_id, w, unnest(range(1, len(w) + 1)) AS p FROM split) split
  WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.row_id = split.row_id AND gone.p = split.p) GROUP BY split.row_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM split LEFT JOIN places ON split.row_id = places.row_id LEFT JOIN left_over ON split.row_id = left_over.row_id
"""

ORACLES: dict[str, str] = {
    "op1_tool_calls": _OP1_SQL,
    "op2_licences": licences.scan_sql(),
    "op3_decontamination": _OP3_SQL,
    "op4_repeats": _OP4_SQL,
}
