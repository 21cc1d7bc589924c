"""The stages of the corpus pipeline: each takes documents and returns those that go on, with the columns of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import WORD, materialised, nested
from graphloom.llm.mixing import mixed
from graphloom.llm.near_dup import near_duplicates
from graphloom.llm.quality_model import scored
from graphloom.llm.quality_rules import with_quality
from graphloom.llm.queries import bpe_digests


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier, trained on this input, rejects."""
    return scored(docs).filter("kept").select("doc.*")


def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules, with references from this input, reject."""
    return with_quality(docs).filter("kept").select("doc.*")


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the least doc_id, once if it is repeated.

    Documents without a doc_id are in no group, and stay. Rows that share a doc_id with other texts are judged apart.
    """
    gone = near_duplicates(docs, label="pipeline-near", hashes=True).filter(~F.col("kept")).select("doc_id", "text_hash").distinct()
    rows = docs.select(nested(docs), F.col("doc_id"), F.xxhash64(F.col("text").cast("binary")).alias("text_hash"))
    left = rows.join(materialised(gone, "pipeline-gone"), ["doc_id", "text_hash"], "left_anti")
    return left.dropDuplicates(["doc_id", "text_hash"]).select("doc.*")


def weighted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The servings of the mix, one row for each: a document that is taken twice is there twice, one that isn't taken is not there.

    A serving that the budget cuts short is its text up to the end of the last word taken, and has its own n_chars.
    """
    rows = materialised(docs.select(nested(docs), "doc_id", "source", "text", F.monotonically_increasing_id().alias("row")), "pipeline-rows")
    takes = mixed(rows, row="row").filter("taken > 0").select("row", "taken", "size")
    served = rows.select("doc", "row").join(takes, "row").withColumn("at", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)))
    words = F.col("taken") - F.col("at") * F.col("size")
    whole = words >= F.col("size")
    spaces = "[\\x20\\x09-\\x0D]+"
    cut = F.when(whole, F.col("doc.text")).otherwise(_first_words(F.col("doc.text"), words, spaces))
    served = served.select("doc", whole.alias("whole"), cut.alias("cut"))
    new = {"text": F.col("cut"), "n_chars": F.when(F.col("whole"), F.col("doc.n_chars")).otherwise(F.length("cut").cast("long"))} if "n_chars" in docs.columns else {"text": F.col("cut")}
    return served.select(*(new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))


def _first_words(text: Column, n: Column, spaces: str) -> Column:
    """The text up to the end of its n-th word, white space and line feeds as they are."""
    gaps = F.regexp_extract_all(text, F.lit(f"({spaces})"), F.lit(1))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    leads = text.rlike(f"^{spaces}").cast("int")
    length = F.aggregate(F.slice(words, F.lit(1), n.cast("int")), F.lit(0), lambda s, w: s + F.length(w)) + F.aggregate(F.slice(gaps, F.lit(1), n.cast("int") - 1 + leads), F.lit(0), lambda s, w: s + F.length(w))
    return F.substring(text, F.lit(1), length)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Size and digests of each serving's ids and decoded text."""
    return bpe_digests(docs)
