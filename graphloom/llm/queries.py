"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.bpe import bpe_round_trip
from graphloom.llm.main_text import with_main_text
from graphloom.llm.mixing import mixed
from graphloom.llm.near_dup import near_duplicates
from graphloom.llm.oracles import OP5_SQL, OP7_SQL
from graphloom.llm.quality_model import scored
from graphloom.llm.quality_rules import with_quality
from graphloom.llm.token_counts import token_counts
from graphloom.llm.token_files import read_token_files, write_token_files
from graphloom.llm.topk import top_k
from graphloom.llm.warc import read_archives, write_archives


#: sha1() is hexadecimal here; its 160 bits are read five at a time for base 32.
OP6_SQL = """
WITH payloads AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), largest AS (SELECT hex, max(page_id) AS top FROM payloads GROUP BY hex),
digits AS (
  SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((('0x' || substr(hex, 1 + 10 * CAST(k // 8 AS INTEGER), 10))::UBIGINT >> (35 - 5 * (k % 8))) & 31 AS INTEGER), 1), '' ORDER BY k) AS b32
  FROM largest, range(32) AS t(k) GROUP BY hex
)
SELECT p.page_id, p.payload_bytes, d.b32 AS payload_digest,
  CASE WHEN p.page_id IS NULL OR p.page_id = l.top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id IS NULL OR p.page_id = l.top THEN NULL ELSE l.top END AS refers_to
FROM payloads p JOIN largest l USING (hex) JOIN digits d USING (hex)
"""


OP10_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.v AS asked, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, asked ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def definition(name: str) -> str:
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of being junk, and whether it is kept."""
    return scored(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc.doc_id", "junk", "kept")


def bpe_digests(documents: DataFrame) -> DataFrame:
    made = bpe_round_trip(documents, definition("word_bpe_49k.json"))
    return made.select("doc_id", (F.length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents, encoded and decoded: sizes and digests."""
    return bpe_digests(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of 150 % of all words takes of each document, sources weighed 3, 1, 2 in turn."""
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "mix_at")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, size and checksum in token files, read back from them."""
    files = write_token_files(table(spark, sf_dir, "documents"), definition("byte_bpe_50k.json"), end_id=2)
    return read_token_files(files).select("doc_id", "start", (F.length("token_ids") / 4).cast("long").alias("n_tokens"), F.crc32("token_ids").alias("ids_crc32"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document, and the verdict of its histograms' divergence from its language."""
    return with_quality(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to archives and read back."""
    return read_archives(write_archives(table(spark, sf_dir, "pages"))).drop("url")


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size, and its component of documents linked at a similarity of 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, counted between the end ids of flat files; the end id is the first that the vocabulary leaves free."""
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = file.read()
    return token_counts(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, end_id=50256).select("doc_id", "n_tokens")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return with_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector with all others."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_model": op1_quality_model,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_mix_sources": op3_mix_sources,
    "op4_token_files": op4_token_files,
    "op5_quality_rules": op5_quality_rules,
    "op6_warc_zstd": op6_warc_zstd,
    "op7_near_dup": op7_near_dup,
    "op8_token_counts": op8_token_counts,
    "op9_main_text": op9_main_text,
    "op10_top_k": op10_top_k,
}
ORACLES: dict[str, str] = {
    "op5_quality_rules": OP5_SQL,
    "op6_warc_zstd": OP6_SQL,
    "op7_near_dup": OP7_SQL,
    "op10_top_k": OP10_SQL,
}
