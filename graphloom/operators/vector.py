"""Vectors of code and text: cosine, exact top-k, corpus weights, random indexing, combined similarity, diffusion, projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-10


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(x: Column, y: Column) -> Column:
    """0 where a length is too small to divide by."""
    d = norm(x) * norm(y)
    return F.when(d < TINY, F.lit(0.0)).otherwise(dot(x, y) / d)


def normalised(x: Column) -> Column:
    """The length is bound once, not computed for each element."""
    return F.transform(F.array(norm(x)), lambda n: F.transform(x, lambda v: F.when(n < TINY, F.lit(0.0)).otherwise(v.cast("double") / n)))[0]


def blended(x: Column, y: Column, share: float = 0.7) -> Column:
    return F.zip_with(x, y, lambda a, b: a * share + b * (1 - share))


def summed(rows: DataFrame, key: str, vector: str, weight: Column | None = None) -> DataFrame:
    """key, vector: element by element, by places, so a key's rows may be any share of all."""
    w = F.lit(1.0) if weight is None else weight
    places = rows.select(key, w.alias("_w"), F.posexplode(vector).alias("_at", "_v")).groupBy(key, "_at").agg(F.sum(F.col("_v") * F.col("_w")).alias("_v"))
    return places.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda x: x["_v"]).alias(vector))


class VectorError(ValueError):
    pass


@dataclass(frozen=True)
class Answer:
    """state is available, no backend, no index or model mismatch; rows is None unless it is available; n is the vectors searched."""

    state: str
    rows: DataFrame | None = None
    n: int = 0


def nearest(vectors: DataFrame, query: list[float], k: int = 10, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, score of the k vectors with the greatest inner product with a query of unit length; the smaller id wins ties.

    The query is a literal of the plan; Spark keeps k rows for each partition, and no sort of all is made.
    """
    length = sum(x * x for x in query) ** 0.5
    if abs(length - 1) > 1e-3:
        raise VectorError(f"the query's length is {length:.4f}, not 1")
    wrong = vectors.filter(F.size(vector) != len(query)).limit(1).count()
    if wrong:
        raise VectorError(f"vectors of another dimension than the query's {len(query)}")
    return vectors.select(F.col(id_column), dot(F.col(vector), F.array(*map(F.lit, map(float, query)))).alias("score")).orderBy(F.desc("score"), id_column).limit(k)


def ask(index: DataFrame | None, meta: dict | None, query: list[float] | None, model: str, k: int = 10) -> Answer:
    if query is None:
        return Answer("no backend")
    if index is None or meta is None:
        return Answer("no index")
    if meta.get("model") != model or meta.get("dim") != len(query):
        return Answer("model mismatch")
    return Answer("available", nearest(index, query, k, "qualified_name"), index.count())


def keyword_scores(keywords: DataFrame, vectors: DataFrame, id_column: str = "id") -> DataFrame:
    """id, score: the least cosine over a handful of keywords (vector), each a literal of the plan."""
    rows = keywords.limit(33).collect()
    if len(rows) > 32:
        raise VectorError("at most 32 keywords")
    scores = [cosine(F.col("vector"), F.array(*map(F.lit, map(float, r["vector"])))) for r in rows]
    return vectors.select(id_column, (F.least(*scores) if len(scores) > 1 else scores[0]).alias("score"))


# Corpus
def idf(tokens: DataFrame, n: int) -> DataFrame:
    """token, df, idf = ln(N / df) of tokens (doc, token); a token that no document has weighs 0."""
    return tokens.distinct().groupBy("token").agg(F.count("*").alias("df")).withColumn("idf", F.ln(F.lit(float(max(n, 1))) / F.col("df")))


def idf_of(texts: DataFrame, tokens: str, n: int) -> DataFrame:
    """What idf gives, of texts with an array of tokens each: tokens are made distinct within the row, so only counts are shuffled."""
    each = texts.select(F.explode(F.array_distinct(tokens)).alias("token"))
    return each.groupBy("token").agg(F.count("*").alias("df")).withColumn("idf", F.ln(F.lit(float(max(n, 1))) / F.col("df")))


def tfidf(tokens: DataFrame, n: int) -> DataFrame:
    """doc, token, weight over the true vocabulary."""
    tf = tokens.groupBy("doc", "token").agg(F.count("*").alias("tf"))
    return tf.join(idf(tokens, n), "token").select("doc", "token", (F.col("tf") * F.col("idf")).alias("weight"))


def index_vector(token: Column, dim: int = 768, entries: int = 8) -> Column:
    """A token's sparse random vector: so many places with +1 or -1, from its hashes."""
    h = lambda k: F.xxhash64(token, F.lit(k))
    at, sign = [F.pmod(h(k), F.lit(dim)) for k in range(entries)], [F.pmod(h(k + 1000), F.lit(2)) * 2 - 1 for k in range(entries)]
    value = lambda i: sum((F.when(a == i, s).otherwise(0) for a, s in zip(at, sign, strict=True)), F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: value(i).cast("double"))


def indexed(rows: DataFrame, key: str, token: str, dim: int = 768, entries: int = 8) -> DataFrame:
    """key, vector: the sum of the index_vector of each of a key's tokens, from the places that a token has and not from all of dim.

    Only sums by place are shuffled, added up before that, so a key's rows may be any share of all.
    """
    h = lambda k: F.xxhash64(F.col(token), F.lit(k))
    # Twice the place, and 1 for +1: one int for each entry, in the plan's generated code.
    codes = rows.select(key, F.explode(F.array(*((F.pmod(h(k), F.lit(dim)) * 2 + h(k + 1000).bitwiseAND(1)).cast("int") for k in range(entries)))).alias("_c"))
    sums = codes.groupBy(key, F.shiftright("_c", 1).alias("_at")).agg(F.sum(F.col("_c").bitwiseAND(1) * 2 - 1).cast("double").alias("_v"))
    p = F.col("_p")
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    filled = F.flatten(F.transform(p, lambda x, i: F.concat(zeros(x["_at"] - F.coalesce(F.get(p, i - 1)["_at"], F.lit(-1)) - 1), F.array(x["_v"]))))
    return sums.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", "_v"))).alias("_p")).select(key, F.concat(filled, zeros(dim - 1 - F.element_at(p, -1)["_at"])).alias("vector"))


def co_occurrence(tokens: DataFrame, window: int = 5) -> DataFrame:
    """token, near, weight of tokens (doc, at, token): 1 / distance within the window, summed. Each row meets at most 2 window others, by place."""
    shifted = tokens.select("doc", F.col("at").alias("place"), F.col("token").alias("near"))
    ways = tokens.withColumn("step", F.explode(F.array(*(F.lit(k) for k in range(-window, window + 1) if k)))).withColumn("place", F.col("at") + F.col("step"))
    return ways.join(shifted, ["doc", "place"]).groupBy("token", "near").agg(F.sum(1.0 / F.abs("step")).alias("weight"))


def co_occurrence_of(texts: DataFrame, tokens: str, window: int = 5) -> DataFrame:
    """What co_occurrence gives, of texts with an array of tokens each: pairs are made within a row, so tokens needn't be joined.

    Each pair is counted once, under its lesser token first, and turned around after the sums.
    """
    t = F.col("_t")

    def ahead(k: int) -> Column:
        left = F.greatest(F.size(t) - k, F.lit(0))
        return F.zip_with(F.slice(t, F.lit(1), left), F.slice(t, F.lit(k + 1), left), lambda x, y: F.struct(F.least(x, y).alias("x"), F.greatest(x, y).alias("y"), F.lit(1.0 / k).alias("w")))

    sums = texts.select(F.col(tokens).alias("_t")).select(F.inline(F.concat(*(ahead(k) for k in range(1, window + 1))))).groupBy("x", "y").agg(F.sum("w").alias("w"))
    ways = F.when(F.col("x") == F.col("y"), F.array(F.struct(F.col("x").alias("token"), F.col("y").alias("near"), (2 * F.col("w")).alias("weight")))).otherwise(F.array(F.struct(F.col("x").alias("token"), F.col("y").alias("near"), F.col("w").alias("weight")), F.struct(F.col("y").alias("token"), F.col("x").alias("near"), F.col("w").alias("weight"))))
    return sums.select(F.inline(ways))


# Combined similarity
#: Weights of the signals.
WEIGHTS = {"tfidf": 0.20, "ri": 0.25, "minhash": 0.10, "api": 0.15, "type": 0.10, "decorator": 0.05, "profile": 0.10}


def proximity(a: Column, b: Column) -> Column:
    """1 + 0.10 shared directories / greater depth of two paths."""
    x, y = F.filter(F.split(F.regexp_replace(a, "[^/]*$", ""), "/"), lambda s: s != ""), F.filter(F.split(F.regexp_replace(b, "[^/]*$", ""), "/"), lambda s: s != "")
    deep = F.greatest(F.size(x), F.size(y))
    shared = F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), F.struct(F.lit(True).alias("go"), F.lit(0).alias("n")), lambda s, v: F.struct((s["go"] & v).alias("go"), (s["n"] + (s["go"] & v).cast("int")).alias("n")))["n"]
    return F.when(deep == 0, F.lit(1.0)).otherwise(1 + 0.10 * shared / deep)


def combined(signals: dict[str, Column], near: Column, jaccard: Column) -> Column:
    """The weighted signals times proximity, in [0, 1]; 0 for near-duplicates, before anything else is looked at."""
    total = F.lit(0.0)
    for name, value in signals.items():
        total = total + F.coalesce(value, F.lit(0.0)) * WEIGHTS[name]
    return F.when(jaccard >= 0.95, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total * near)))


def budgeted(scored: DataFrame, least: float = 0.75, most: int = 10) -> DataFrame:
    """a, b, score of pairs of least score or more, admitted in (score, a, b) order while neither end has most edges.

    A pair is settled when it is among the first most of both ends that are still open: so each round admits what a sequential
    pass would admit at both ends, and drops what a full end can no longer take, until nothing is left.
    """
    from graphloom.storage import written

    left = written(scored.filter(F.col("score") >= least).select("a", "b", "score"), "budget")
    done: DataFrame | None = None
    while not left.isEmpty():  # each round settles the best pair that is left, at least
        ends = left.select(F.col("a").alias("n"), "a", "b", "score").union(left.select("b", "a", "b", "score"))
        if done is not None:
            used = done.select(F.col("a").alias("n")).union(done.select("b")).groupBy("n").agg(F.count("*").alias("used"))
            ends = ends.join(used, "n", "left")
        else:
            ends = ends.withColumn("used", F.lit(0))
        order = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("score"), "a", "b"))
        open_ = F.lit(most) - F.coalesce("used", F.lit(0))
        sides = ends.withColumn("k", order).withColumn("room", open_).groupBy("a", "b", "score").agg(F.min(F.col("room") > 0).alias("may"), F.min(F.col("k") <= F.col("room")).alias("sure"))
        sides = written(sides, "budget-sides")
        new = sides.filter("may and sure").select("a", "b", "score")
        done = written(new if done is None else done.union(new), "budget-done")
        left = written(sides.filter("may and not sure").select("a", "b", "score"), "budget-left")
    return done if done is not None else left


def diffused(vectors: DataFrame, edges: DataFrame, alpha: float = 0.3) -> DataFrame:
    """id, vector: (1 - alpha) of a node's own and alpha of its neighbours' mean, renormalised."""
    both = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("other")).union(edges.select("target_id", "source_id")).distinct()
    near = both.join(vectors.select(F.col("id").alias("other"), F.col("vector")), "other")
    means = summed(near.select("id", "vector"), "id", "vector").join(near.groupBy("id").agg(F.count("*").alias("n")), "id").select("id", F.transform("vector", lambda v: v / F.col("n")).alias("mean"))
    j = vectors.join(means, "id", "left")
    return j.select("id", F.when(F.col("mean").isNull(), F.col("vector")).otherwise(normalised(F.zip_with("vector", "mean", lambda a, b: a * (1 - alpha) + b * alpha))).alias("vector"))


def projected(vectors: DataFrame, axes: int = 3, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and so many principal coordinates; each axis's sign makes its greatest loading positive."""
    import numpy as np
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.select(id_column, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("v"))
    model = PCA(k=axes, inputCol="v", outputCol="p").fit(v)
    loadings = model.pc.toArray()
    signs = [float(np.sign(loadings[np.abs(loadings[:, k]).argmax(), k]) or 1.0) for k in range(axes)]
    p = model.transform(v).select(id_column, vector_to_array("p").alias("p"))
    return p.select(id_column, *((F.get("p", F.lit(k)) * signs[k]).alias(f"axis{k}") for k in range(axes)))


def ast_profile(csv: Column, maxima: list[float]) -> Column:
    """A comma-separated profile of counts, each divided by its maximum and cut off at 1."""
    parts = F.split(csv, ",")
    return F.array(*(F.least(F.lit(1.0), F.coalesce(F.get(parts, F.lit(k)).try_cast("double"), F.lit(0.0)) / m) for k, m in enumerate(maxima)))
