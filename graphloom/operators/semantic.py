"""Semantic edges: what words describe a node, its vectors, hyperplane signatures, and the pairs that are worth scoring."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import expanded_tokens
from graphloom.operators.vector import indexed, normalised

#: Neighbours and words of a node, entries of its lists, signature bits, bands of them, candidates of a node.
MOST_NEIGHBOURS, MOST_TOKENS, MOST_ENTRIES = 64, 512, 16
BITS, BANDS = 64, 16
MOST_CANDIDATES = 200
#: Nodes of a range of a bucket, about.
MOST_RANGE = 4096
TEXTS, LISTS = ("signature", "return_type", "docstring"), ("param_names", "param_types", "decorators")


def neighbours(nodes: DataFrame, calls: DataFrame, outbound: bool = True) -> DataFrame:
    """id, names: the first 64 names, sorted, of what a node calls or is called by. A hub's names are cut to its first before they are collected."""
    own, other = ("source_id", "target_id") if outbound else ("target_id", "source_id")
    near = calls.select(F.col(own).alias("own"), F.col(other).alias("id")).distinct().join(nodes.select("id", "name"), "id").groupBy("own", "name").agg(F.count("*").alias("n"))
    first = near.withColumn("k", F.row_number().over(Window.partitionBy("own").orderBy("name"))).filter(F.col("k") <= MOST_NEIGHBOURS)
    return first.groupBy(F.col("own").alias("id")).agg(F.array_sort(F.collect_list("name")).alias("names"))


def node_tokens(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """id, tokens: words of name, qualified name, path, signature, return type, docstring, parameters, decorators, body (bt), callees and callers, 512 at most.

    nodes has these as columns: texts, and arrays for parameters and decorators. The ceiling is the operator's own.
    """
    t = lambda c: F.coalesce(expanded_tokens(c), F.array().cast("array<string>"))
    out, into = (neighbours(nodes, calls, way).withColumnRenamed("names", name) for way, name in ((True, "_out"), (False, "_in")))
    many = lambda c: F.flatten(F.transform(F.coalesce(c, F.array().cast("array<string>")), t))
    parts = [t(F.col(c)) for c in ("name", "qualified_name", "file_path", *TEXTS)] + [many(F.col(c)) for c in LISTS] + [t(F.col("bt")), many(F.col("_out")), many(F.col("_in"))]
    return nodes.join(out, "id", "left").join(into, "id", "left").select("id", F.slice(F.concat(*parts), 1, MOST_TOKENS).alias("tokens"))


def entry_vectors(entries: DataFrame, dim: int = 768) -> DataFrame:
    """id, vector: the unit sum of the index vectors of a node's entries (id, entry); an entry that is there twice counts twice."""
    return indexed(entries, "id", "entry", dim).select("id", normalised(F.col("vector")).alias("vector"))


def text_vectors(texts: DataFrame, tokens: str, dim: int = 768) -> DataFrame:
    """What entry_vectors gives of each id's distinct tokens, of texts (id, tokens) with an array of tokens each.

    Tokens are made distinct within the row, so they needn't be shuffled. Only those of ids with several rows are, if there are
    any; where these have most rows, all are, which is less than to shuffle texts to tell them apart.
    """
    each = lambda df: df.select("id", F.explode(F.array_distinct(tokens)).alias("entry"))
    counts = texts.groupBy("id").agg(F.count("*").alias("n"))
    n, many = counts.agg(F.sum("n"), F.sum(F.when(F.col("n") > 1, F.col("n")))).first()
    if not many:
        return entry_vectors(each(texts), dim)
    if 2 * many > n:
        return entry_vectors(each(texts).distinct(), dim)
    several = counts.filter("n > 1").select(F.col("id").alias("_id"))
    same = F.col("id").eqNullSafe(F.col("_id"))
    return entry_vectors(each(texts), dim).join(several, same, "left_anti").unionByName(entry_vectors(each(texts.join(several, same, "left_semi")).distinct(), dim))


def api_vectors(nodes: DataFrame, calls: DataFrame, dim: int = 768) -> DataFrame:
    return entry_vectors(neighbours(nodes, calls).select("id", F.explode("names").alias("entry")), dim)


def type_vectors(nodes: DataFrame, dim: int = 768) -> DataFrame:
    kinds = F.concat(F.array_compact(F.array("return_type")), F.slice(F.coalesce("param_types", F.array().cast("array<string>")), 1, MOST_ENTRIES))
    return entry_vectors(nodes.select("id", F.explode(kinds).alias("entry")), dim)


def decorator_vectors(nodes: DataFrame, dim: int = 768) -> DataFrame:
    return entry_vectors(nodes.select("id", F.explode(F.slice(F.coalesce("decorators", F.array().cast("array<string>")), 1, MOST_ENTRIES)).alias("entry")), dim)


def signature(vector: Column, dim: int, seed: int = 7) -> Column:
    """64 bits, as an array of 0 and 1: on which side of each of 64 random hyperplanes a vector is."""
    import numpy as np

    planes = np.random.default_rng(seed).normal(size=(BITS, dim))
    table = F.array(*(F.array(*map(F.lit, map(float, p))) for p in planes))
    side = lambda p: F.aggregate(F.zip_with(vector, p, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x) > 0
    return F.transform(table, lambda p: side(p).cast("int"))


def candidates(vectors: DataFrame, dim: int, id_column: str = "id", vector: str = "vector") -> DataFrame:
    """a, b (a < b): pairs that agree in one of 16 bands of 4 bits, at most 200 for each node over all bands.

    For each band the members of a bucket stand in the order of their signature, read from that band on; each meets the
    next ones. So those that agree most meet in buckets of any size, rows stay in proportion to nodes, and no bucket is left
    out. Buckets of many are cut by the bits that come next, a number that grows with the logarithm of the nodes.
    """
    width = BITS // BANDS
    signed = vectors.select(F.col(id_column).alias("id"), F.array_join(signature(F.col(vector), dim), "").alias("bits"))
    more = max(0, math.ceil(math.log2(max(1, vectors.count()) / (MOST_RANGE << width))))
    turned = F.concat(F.substring(F.col("bits"), F.col("band") * width + 1, F.lit(BITS)), F.substring(F.col("bits"), F.lit(1), F.col("band") * width))
    keyed = signed.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))).withColumn("turned", turned)
    ranged = keyed.select("id", "turned", F.concat_ws(":", F.col("band").cast("string"), F.substring("turned", 1, width + more)).alias("key"))
    order = Window.partitionBy("key").orderBy("turned", "id")
    next_ = F.collect_list("id").over(order.rowsBetween(1, MOST_CANDIDATES // BANDS + 1))
    ways = ranged.withColumn("near", next_).select("id", F.explode("near").alias("other"))
    return ways.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).filter("a <> b").distinct()


# Indexes that are kept between runs
def refreshed(index: DataFrame, current: DataFrame, encode) -> tuple[DataFrame, dict[str, int]]:
    """The index (qualified_name, content_hash, vector, and others) of what is there now, and how many vectors were reused, made and pruned.

    A vector whose content is unchanged is reused, under any name; only the others go to encode(rows), which adds vector.
    """
    known = index.groupBy("content_hash").agg(F.first("vector").alias("vector"))
    joined = current.join(known, "content_hash", "left")
    reused, fresh = joined.filter("vector is not null"), joined.filter("vector is null").drop("vector")
    made = encode(fresh)
    counts = {"reused": reused.count(), "made": fresh.count(), "pruned": index.join(current, "qualified_name", "left_anti").count()}
    return reused.unionByName(made.select(*reused.columns)), counts


def record_vectors(records: DataFrame, index: DataFrame, encode) -> DataFrame:
    """id, content_hash, vector of records (id, content): one vector for each content, kept from the index (content_hash, vector) where it is there."""
    hashed = records.select("id", "content", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))
    contents = hashed.groupBy("content_hash").agg(F.first("content").alias("content")).join(index, "content_hash", "left")
    made = encode(contents.filter("vector is null").select("content_hash", "content")).select("content_hash", "vector")
    every = contents.filter("vector is not null").select("content_hash", "vector").unionByName(made)
    return hashed.select("id", "content_hash").join(every, "content_hash")
