"""The registered queries of this subpackage: operators applied to their whole tables."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe import bpe_digest
from .chat_formatting import chat_formatting
from .html_extraction import html_extraction
from .jaccard_join import jaccard_join
from .media import media_digest
from .packing import pack
from .quality_classifier import quality_classifier
from .quality_rules import quality_rules
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup



def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file on the driver, which alone reads it; $QUILLON_TOKENIZERS names another folder."""
    folder = os.environ.get("QUILLON_TOKENIZERS")
    return f"{folder}/{name}" if folder else public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents")).drop("kept_text")


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents")).drop("row_id")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_formatting(_table(spark, sf_dir, "conversations"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction(_table(spark, sf_dir, "pages"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents")).drop("kept_bytes")


QUERIES = {
    f.__name__: f
    for f in (op1_quality_classifier, op2_substring_dedup, op3_bpe_round_trip, op4_quality_rules, op5_media_columns, op6_packing, op7_jaccard_join, op8_chat_formatting, op9_html_extraction, op10_suffix_dedup)
}
#: Only these two can be said in SQL whole; the others' models, formats and digests cannot.
ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": r"""
WITH split AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
word AS (SELECT doc_id, r, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS p FROM split),
starts AS (SELECT r, words, unnest(range(1, len(words) - 33)) AS p FROM split WHERE len(words) >= 35),
grams AS (SELECT r, p, array_to_string(words[p:p + 34], ' ') AS g FROM starts),
again AS (SELECT g FROM grams GROUP BY g HAVING count(*) > 1),
hits AS (SELECT r, p FROM grams WHERE g IN (SELECT g FROM again)),
marked AS (SELECT word.*, max(hits.p) OVER (PARTITION BY word.r ORDER BY word.p) AS last FROM word LEFT JOIN hits ON word.r = hits.r AND word.p = hits.p),
kept AS (SELECT r, count(*) AS n, string_agg(w, ' ' ORDER BY p) AS t FROM marked WHERE last IS NULL OR p > last + 34 GROUP BY r)
SELECT split.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM split LEFT JOIN kept ON split.r = kept.r
""",
    "op7_jaccard_join": r"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
shingle AS (
  SELECT doc_id, array_to_string(words[p:p + 3], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 2)) AS p FROM split WHERE len(words) >= 4) AS x
  UNION SELECT doc_id, array_to_string(words, ' ') AS g FROM split WHERE len(words) BETWEEN 1 AND 3
),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingle AS a JOIN shingle AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT x, y FROM pair JOIN size AS s ON s.doc_id = x JOIN size AS t ON t.doc_id = y WHERE 100 * c >= 85 * (s.n + t.n - c)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, edge.y FROM reach JOIN edge ON reach.other = edge.x),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT least.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM least LEFT JOIN size ON size.doc_id = least.doc_id
""",
}
