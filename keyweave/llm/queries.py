"""The queries of this subpackage, each with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontamination, exact_dedup, jaccard, quality, sentencepiece_codec, sharding, suffix_dedup, token_counts, token_files
from .common import shared_folder, table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


#: Both texts of conversation -1.
CONTROLS = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROLS).alias("text"))
    talks = chat_format.conversations(rows.unionByName(extra))
    return chat_format.digests(chat_format.read_back(chat_format.format_chats(talks)))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_digests(table(spark, sf_dir, "documents"), PIECES)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.kept_bytes(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents"), 24, shared_folder(spark, "op6") + "/map")
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.digests(decontamination.find(docs, table(spark, sf_dir, "benchmark")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), PIECES, limit=4096)


def op9_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_classes(table(spark, sf_dir, "documents"), width=3, percent=90)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "op10")
    return token_files.sequences_of(spark, table(spark, sf_dir, "documents"), WORDS, f"{folder}/sequences", f"{folder}/manifest", end_id=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_format, op2_sentencepiece, op3_exact_dedup, op4_suffix_dedup, op5_quality, op6_sharding, op7_decontamination, op8_token_counts, op9_shingle_join, op10_token_files)}


_ESCAPES = [("\\", "\\s"), *((control, "\\" + code) for control, code in zip(chat_format.Template().controls, chat_format.CODES, strict=False))]


def _escaped(text: str) -> str:
    for control, code in _ESCAPES:
        text = f"replace({text}, '{control}', '{code}')"
    return text


_TURNS = f"(SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{CONTROLS}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROLS}')"
_OPENING = "CASE role WHEN 'system' THEN 7 WHEN 'user' THEN 6 WHEN 'assistant' THEN 7 ELSE 17 + length(role) END"
_MOVES = "prev || '>' || role IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user')"

#: Word shingles of op9 and their sets, as SQL.
_SHINGLES = """
words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words)"""

SQL = {
    "op1_chat_format": f"""
WITH RECURSIVE t AS (SELECT *, coalesce(lag(role) OVER w, '') AS prev, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM {_TURNS} WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
m AS (SELECT *, CASE WHEN {_MOVES} THEN NULL ELSE k END AS wrong FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
  sum({_OPENING} + length({_escaped("text")}) + 6)::BIGINT AS formatted_chars,
  min(wrong) IS NULL AND max(CASE WHEN k = n - 1 THEN role END) IN ('user', 'assistant') AS valid, min(wrong)::INT AS wrong_turn
FROM m GROUP BY conv_id""",
    "op3_exact_dedup": """
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t)::BIGINT AS group_size, doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d""",
    "op7_decontamination": """
WITH lowered AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
words AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
windows AS (SELECT id AS item_id, len(w[i : i + least(10, len(w)) - 1]) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM words WHERE kind = 1 AND len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (SELECT id AS doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS g FROM (SELECT id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, sizes WHERE kind = 0 AND len(w) >= size)),
hits AS (SELECT doc_id, size, i, item_id FROM grams JOIN windows USING (size, g)),
covered AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, size, i FROM hits)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*)::BIGINT AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT id AS doc_id, len(w)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM words LEFT JOIN covered ON covered.doc_id = id LEFT JOIN named ON named.doc_id = id WHERE kind = 0""",
    "op9_shingle_join": f"""
WITH RECURSIVE {_SHINGLES},
nodes AS (SELECT min(doc_id) AS node, list_sort(s) AS s, len(s) AS n FROM sets GROUP BY list_sort(s), len(s)),
items AS (SELECT node, n, unnest(s) AS g FROM nodes WHERE n > 0),
links AS (SELECT a.node AS x, b.node AS y FROM items a JOIN items b ON a.g = b.g AND a.node <> b.node AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT node AS x, node AS y FROM nodes UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
roots AS (SELECT x AS node, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, CASE WHEN len(sets.s) = 0 THEN doc_id ELSE component_id END AS component_id FROM sets JOIN nodes ON nodes.s = list_sort(sets.s) JOIN roots USING (node)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
