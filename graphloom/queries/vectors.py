"""Vectors of the embeddings table, and corpus weights of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import semantic as sem
from graphloom.operators import vector as v
from graphloom.queries.similarity import TOKENS, _documents


def _embeddings(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _topk(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    query = e.filter("vec_id = 7").first()["embedding"]
    return v.nearest(e, query, 10).select("vec_id", F.round("score", 5).alias("score"))


def _cosine_neighbours(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select((F.col("vec_id") - 1).alias("a"), F.col("embedding").alias("y"))
    return a.join(b, "a").select("a", F.round(v.cosine(F.col("x"), F.col("y")), 5).alias("cosine"))


def _tokens(spark, sf_dir):
    return _documents(spark, sf_dir).select(F.col("id").alias("doc"), F.explode("tokens").alias("token"))


def _idf(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    return v.idf_of(_documents(spark, sf_dir), "tokens", n).select("token", "df", F.round("idf", 6).alias("idf")).filter("df > 20")


def _tfidf(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    return v.tfidf(_tokens(spark, sf_dir), n).groupBy("doc").agg(F.round(F.sum("weight"), 4).alias("weight"))


def _co(spark, sf_dir):
    return v.co_occurrence_of(_documents(spark, sf_dir), "tokens", 2).filter("weight > 20").select("token", "near", F.round("weight", 4).alias("weight"))


def _label_means(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    sums = v.summed(e.select("label", F.col("embedding")), "label", "embedding")
    return sums.select("label", F.round(v.norm(F.col("embedding")), 3).alias("length"))


def _blended(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    near = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    pair = e.join(near, "vec_id").select("vec_id", v.blended(F.transform("embedding", lambda x: x.cast("double")), v.normalised(F.col("next"))).alias("b"))
    return pair.select("vec_id", F.round(v.norm(F.col("b")), 5).alias("length"), F.round(F.get("b", F.lit(3)), 5).alias("fourth"))


def _keywords(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    return v.keyword_scores(e.filter("vec_id IN (3, 5, 11)").select(F.col("embedding").alias("vector")), e.select("vec_id", F.col("embedding").alias("vector")), "vec_id").select("vec_id", F.round("score", 5).alias("score"))


def _diffused(spark, sf_dir):
    e = _embeddings(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    edges = e.select(F.col("id").alias("source_id"), (F.col("id") + 1).alias("target_id")).filter("source_id % 3 = 0")
    return v.diffused(e, edges).select("id", F.round(F.get("vector", F.lit(0)), 5).alias("first"), F.round(v.norm(F.col("vector")), 5).alias("length"))


def _proximity(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    a = F.concat_ws("/", "p_brand", "p_type", F.lit("x.py"))
    b = F.concat_ws("/", "p_brand", F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("other"), F.when(F.col("p_size") % 3 == 0, F.lit("deep")), F.lit("y.py"))
    return p.select("p_partkey", F.round(v.proximity(a, b), 6).alias("near"))


def _profile(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    csv = F.concat_ws(",", F.col("p_size").cast("string"), (F.col("p_partkey") % 30).cast("string"), F.lit("bad"))
    return p.select("p_partkey", v.ast_profile(csv, [25.0, 20.0, 10.0, 5.0]).alias("x")).select("p_partkey", *(F.round(F.get("x", F.lit(k)), 6).alias(f"x{k}") for k in range(4)))


def _combined(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    share = lambda k: F.col("p_size") % k / (k - 1)
    signals = {"tfidf": share(7), "ri": share(5), "minhash": share(3), "api": F.when(F.col("p_size") % 2 == 0, 0.5), "profile": F.lit(1.0)}
    return p.select("p_partkey", F.round(v.combined(signals, F.lit(1.1), share(11)), 6).alias("score"))


def _encoded(rows):
    """A stand-in for an encoder: what a content's hash begins with."""
    return rows.withColumn("vector", F.array(F.conv(F.substring("content_hash", 1, 6), 16, 10).cast("double")))


def _record_vectors(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("content"))
    kept = d.filter("id % 2 = 0").select(F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"), F.array(F.lit(-1.0)).alias("vector")).distinct()
    return sem.record_vectors(d, kept, _encoded).select("id", F.get("vector", F.lit(0)).alias("first"))


def _refreshed(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.format_string("d%d", "doc_id").alias("qualified_name"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("content_hash"), "doc_id")
    index = d.filter("doc_id % 3 = 0").select("qualified_name", "content_hash", F.array(F.lit(-1.0)).alias("vector"))
    rows, counts = sem.refreshed(index, d.filter("doc_id % 5 > 0").drop("doc_id"), _encoded)
    return rows.agg(F.count("*").alias("rows"), F.count(F.when(F.get("vector", F.lit(0)) < 0, 1)).alias("kept")).select("rows", "kept", *(F.lit(n).cast("long").alias(k) for k, n in counts.items()))


def _mean_documents(spark, sf_dir):
    """Unit vectors of documents from their distinct words, by the words' index vectors: their length."""
    return sem.text_vectors(_documents(spark, sf_dir), "tokens", 16).select("id", F.round(v.norm(F.col("vector")), 4).alias("length")).filter("length > 0")


QUERIES = {
    "vs_blended": _blended, "vs_keywords": _keywords, "vs_diffused": _diffused, "vs_proximity": _proximity, "vs_profile": _profile, "vs_combined": _combined,
    "vs_record_vectors": _record_vectors, "vs_refreshed": _refreshed, "vs_entry_vectors": _mean_documents,
    "vs_topk": _topk, "vs_cosine": _cosine_neighbours, "vs_idf": _idf, "vs_tfidf": _tfidf, "vs_cooccurrence": _co, "vs_label_sums": _label_means}
_T = f"t AS (SELECT doc_id AS doc, unnest({TOKENS}) AS token FROM documents), n AS (SELECT count(*) AS n FROM documents), i AS (SELECT token, count(DISTINCT doc) AS df FROM t GROUP BY token)"
_cos = "list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {0}))"
_hash = "sha256(coalesce(text, ''))"
ORACLES = {
    "vs_blended": "WITH p AS (SELECT a.vec_id, list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda x: x[1] * 0.7::DOUBLE + x[2] / sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) * 0.3::DOUBLE) AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(sqrt(list_inner_product(b, b)), 5) AS length, round(b[4], 5) AS fourth FROM p",
    "vs_keywords": f"SELECT vec_id, round(least({_cos.format(3)}, {_cos.format(5)}, {_cos.format(11)}), 5) AS score FROM embeddings e",
    "vs_diffused": "WITH n AS (SELECT a.vec_id AS id, a.embedding::DOUBLE[] AS v, b.embedding::DOUBLE[] AS m FROM embeddings a LEFT JOIN embeddings b ON a.vec_id % 3 = 0 AND b.vec_id = a.vec_id + 1 OR a.vec_id % 3 = 1 AND b.vec_id = a.vec_id - 1), w AS (SELECT id, CASE WHEN m IS NULL THEN v ELSE list_transform(list_zip(v, m), lambda x: x[1] * 0.7::DOUBLE + x[2] * 0.3::DOUBLE) END AS x, m IS NULL AS own FROM n) SELECT id, round(CASE WHEN own THEN x[1] ELSE x[1] / sqrt(list_inner_product(x, x)) END, 5) AS first, round(CASE WHEN own THEN sqrt(list_inner_product(x, x)) ELSE 1.0::DOUBLE END, 5) AS length FROM w",
    "vs_proximity": "SELECT p_partkey, round(1 + 0.1::DOUBLE * CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END / CASE WHEN p_size % 3 = 0 THEN 3 ELSE 2 END, 6) AS near FROM part",
    "vs_profile": "SELECT p_partkey, round(least(1.0::DOUBLE, p_size / 25.0::DOUBLE), 6) AS x0, round(least(1.0::DOUBLE, p_partkey % 30 / 20.0::DOUBLE), 6) AS x1, 0.0::DOUBLE AS x2, 0.0::DOUBLE AS x3 FROM part",
    "vs_combined": "SELECT p_partkey, CASE WHEN p_size % 11 / 10.0::DOUBLE >= 0.95 THEN 0.0::DOUBLE ELSE round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.1::DOUBLE * (0.2::DOUBLE * (p_size % 7) / 6 + 0.25::DOUBLE * (p_size % 5) / 4 + 0.1::DOUBLE * (p_size % 3) / 2 + CASE WHEN p_size % 2 = 0 THEN 0.075::DOUBLE ELSE 0 END + 0.1::DOUBLE))), 6) END AS score FROM part",
    "vs_record_vectors": f"WITH h AS (SELECT doc_id AS id, {_hash} AS h FROM documents) SELECT id, CASE WHEN h IN (SELECT h FROM h WHERE id % 2 = 0) THEN -1.0::DOUBLE ELSE ('0x' || substr(h, 1, 6))::BIGINT::DOUBLE END AS first FROM h",
    "vs_refreshed": f"WITH h AS (SELECT doc_id AS id, {_hash} AS h FROM documents), k AS (SELECT id, h IN (SELECT h FROM h WHERE id % 3 = 0) AS known FROM h WHERE id % 5 > 0) SELECT count(*) AS rows, count(*) FILTER (known) AS kept, count(*) FILTER (known) AS reused, count(*) FILTER (NOT known) AS made, (SELECT count(*) FROM h WHERE id % 3 = 0 AND id % 5 = 0) AS pruned FROM k",
    
    "vs_topk": "SELECT e.vec_id, round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id LIMIT 10",
    "vs_cosine": "SELECT a.vec_id AS a, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "vs_idf": f"WITH {_T} SELECT token, df, round(ln(n::DOUBLE / df), 6) AS idf FROM i, n WHERE df > 20",
    "vs_tfidf": f"WITH {_T} SELECT doc, round(sum(ln(n::DOUBLE / df)), 4) AS weight FROM t JOIN i USING (token), n GROUP BY doc",
    "vs_cooccurrence": f"WITH d AS (SELECT doc_id AS doc, {TOKENS} AS w FROM documents), t AS (SELECT doc, unnest(w) AS token, generate_subscripts(w, 1) AS at FROM d) SELECT a.token, b.token AS near, round(sum(1.0 / abs(a.at - b.at))::DOUBLE, 4) AS weight FROM t a JOIN t b ON a.doc = b.doc AND abs(a.at - b.at) BETWEEN 1 AND 2 GROUP BY 1, 2 HAVING sum(1.0 / abs(a.at - b.at)) > 20",
    "vs_label_sums": "WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS k FROM embeddings), s AS (SELECT label, k, sum(v) AS v FROM x GROUP BY 1, 2) SELECT label, round(sqrt(sum(v * v)), 3) AS length FROM s GROUP BY 1",
}
