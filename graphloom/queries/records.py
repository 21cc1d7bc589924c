"""Conversations as records, and events as spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import records as r
from graphloom.operators.search import coverage_in, coverage_of
from graphloom.sources.artifact import coverage_replaced
from graphloom.sources.delta import changed_files
from graphloom.streaming.feed import not_stored, p99, parsed, spans


def _records(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("text is not null and role is not null")
    null = F.lit(None).cast("string")
    return r.built(c.select(F.lit("message").alias("kind"), F.col("role").alias("author"), (F.col("conv_id") * 1000 + F.col("turn") + 1).cast("long").alias("timestamp_ms"), F.col("text").alias("content"), null.alias("anchor"), F.concat(F.lit("c:"), F.col("conv_id").cast("string"), F.lit("@"), F.col("turn").cast("string")).alias("origin"), F.col("conv_id").cast("string").alias("thread"), null.alias("parent")))


def _query(spark, sf_dir):
    return r.query(_records(spark, sf_dir), r.RecordQuery(author="user", since=5000, until=40000, anchored=False)).select("id", "timestamp_ms")


def _union(spark, sf_dir):
    x = _records(spark, sf_dir).distinct()
    return r.appended(x.filter("timestamp_ms % 3 < 2"), x.filter("timestamp_ms % 3 > 0")).groupBy("author").agg(F.count("*").alias("n"))


def _thread(spark, sf_dir):
    return r.thread(_records(spark, sf_dir), "12").select("timestamp_ms", "author", "content")


def _p99(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return p99(e.filter("value is not null").select("event_type", "value"), ["event_type"], "value")


def _delta(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("rel_path"), F.sha2("text", 256).alias("sha256"))
    new = d.filter("rel_path % 7 <> 0").withColumn("sha256", F.when(F.col("rel_path") % 5 == 0, F.lit("x")).otherwise(F.col("sha256")))
    return changed_files(d.filter("rel_path % 11 <> 0"), new)


IMAGE = "'record/1' || chr(10) || 'kind:7:message' || chr(10) || 'author:' || strlen(role) || ':' || role || chr(10) || 'timestamp_ms:' || strlen((conv_id * 1000 + turn + 1)::VARCHAR) || ':' || (conv_id * 1000 + turn + 1) || chr(10) || 'content:' || strlen(text) || ':' || text || chr(10) || 'anchor:-:' || chr(10) || 'origin:' || strlen('c:' || conv_id || '@' || turn) || ':c:' || conv_id || '@' || turn || chr(10) || 'thread:' || strlen(conv_id::VARCHAR) || ':' || conv_id || chr(10) || 'parent:-:' || chr(10)"
def _missing(spark, sf_dir):
    x = _records(spark, sf_dir).distinct()
    return r.missing(x.filter("timestamp_ms % 3 < 2"), x).select("id", "timestamp_ms")


def _memory(spark, sf_dir):
    return r.query(_records(spark, sf_dir), r.RecordQuery(kind="message", text="the ")).select("id", "author")


def _orphans(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 > 0, F.concat(F.lit("s"), (F.col("c_custkey") * 2).cast("string"))).alias("anchor"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("qualified_name"))
    return r.orphans(c, part)


def _decisions(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null")
    made = r.from_decisions(d.select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("project"), F.col("text").alias("content"), (F.col("doc_id") + 1).cast("long").alias("updated_ms")))
    return r.verified(made).select("kind", "author", "timestamp_ms", "origin", F.length("content").cast("long").alias("n"))


def _not_stored(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    origin = F.concat(F.lit("c:"), F.col("conv_id").cast("string"), F.lit("@"), F.col("turn").cast("string")).alias("origin")
    return not_stored(c.select(origin), _records(spark, sf_dir).filter("timestamp_ms % 3 < 2"))


def _parsed(spark, sf_dir):
    """Every conversation turn as a line: some have no author, some a kind that isn't known, some are no JSON."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("text is not null")
    at = F.col("conv_id") * 1000 + F.col("turn") + 1
    sound = F.to_json(F.struct(F.when(at % 5 > 0, "user").alias("author"), F.when(at % 7 == 0, "gossip").otherwise("message").alias("kind"), at.cast("long").alias("timestamp_ms"), F.col("text").alias("content")))
    lines = c.select(F.when(at % 11 == 0, F.concat(F.lit("no json "), at.cast("string"))).otherwise(sound).alias("value"), F.lit("log").alias("path"))
    return parsed(lines).groupBy(F.coalesce("reason", F.lit("sound")).alias("reason")).agg(F.count("*").alias("n"))


def _coverage(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = part.select(F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string")).alias("rel_path"), F.col("p_partkey").alias("run"))
    paths = part.filter("p_size % 2 = 0").select(F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string")).alias("path"))
    return coverage_replaced(rows, rows.filter("p_brand = 'Brand#11'").withColumn("run", F.lit(-1).cast("long")), paths, "Brand#11")


def _coverage_of(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = part.select(F.concat("p_brand", F.lit("/"), "p_name", F.when(F.col("p_size") % 2 == 0, "/").otherwise("")).alias("rel_path")).union(part.select("p_brand"))
    return coverage_of(rows.distinct(), "Brand#11/small ring/x.py")


def _coverage_in(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return coverage_in(part.select("p_partkey", F.concat("p_brand", F.lit("/"), "p_name").alias("rel_path")), "Brand#1/")


def _spans(spark, sf_dir):
    """Every event as a span of a service, with a path from its route or its URL, or none."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    of, key = lambda *x: F.create_map(*(F.lit(y) if isinstance(y, str) else y for y in x)), F.col("event_id")
    attributes = F.when(key % 3 == 0, of("http.route", F.concat(F.lit("/"), "event_type"), "http.method", "GET")).when(key % 3 == 1, of("url.full", F.concat(F.lit("https://h/"), "event_type", F.lit("?q=1")))).otherwise(of("other", "x"))
    raw = e.select(of("service.name", F.col("event_type")).alias("resource"), attributes.alias("attributes"), key.cast("string").alias("start"), F.when(key % 4 == 0, "x").otherwise((key * 2 - 50).cast("string")).alias("end"), F.lit("server").alias("kind"))
    return spans(raw).groupBy("service", "method", "path").agg(F.count("*").alias("n"), F.sum("duration_ns").alias("ns"))


QUERIES = {
    "rm_missing": _missing, "rm_text": _memory, "rm_orphans": _orphans, "rm_decisions": _decisions, "st_not_stored": _not_stored, "st_parsed": _parsed,
    "st_coverage": _coverage, "ad_coverage_of": _coverage_of, "ad_coverage_in": _coverage_in, "st_spans": _spans,
    "rm_digest": lambda spark, sf_dir: r.digest(_records(spark, sf_dir)), "rm_query": _query, "rm_union": _union, "rm_thread": _thread, "st_p99": _p99, "st_delta": _delta}
_sound = "FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL"
_ms = "(conv_id * 1000 + turn + 1)"
ORACLES = {
    "rm_missing": f"SELECT DISTINCT sha256({IMAGE}) AS id, {_ms}::BIGINT AS timestamp_ms {_sound} AND {_ms} % 3 = 2",
    "rm_text": f"SELECT sha256({IMAGE}) AS id, role AS author {_sound} AND contains(text, 'the ')",
    "rm_orphans": "SELECT c_custkey AS id, 's' || (c_custkey * 2) AS anchor FROM customer WHERE c_custkey % 4 > 0 AND NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = c_custkey * 2)",
    "rm_decisions": "SELECT 'decision' AS kind, 'p' || doc_id AS author, doc_id + 1 AS timestamp_ms, 'adr:p' || doc_id AS origin, length(text) AS n FROM documents WHERE text IS NOT NULL",
    "st_not_stored": f"SELECT DISTINCT 'c:' || conv_id || '@' || turn AS origin FROM conversations EXCEPT SELECT 'c:' || conv_id || '@' || turn {_sound} AND {_ms} % 3 < 2",
    "st_parsed": f"SELECT CASE WHEN {_ms} % 11 = 0 THEN 'not a JSON object' WHEN {_ms} % 7 = 0 THEN 'unknown kind' WHEN {_ms} % 5 = 0 THEN 'no author' ELSE 'sound' END AS reason, count(*) AS n FROM conversations WHERE text IS NOT NULL GROUP BY 1",
    "st_coverage": "SELECT p_brand || '/' || p_partkey AS rel_path, CASE WHEN p_brand = 'Brand#11' THEN -1 ELSE p_partkey END::BIGINT AS run FROM part WHERE p_size % 2 = 0",
    "ad_coverage_of": "SELECT * FROM (SELECT DISTINCT p_brand || '/' || p_name || CASE WHEN p_size % 2 = 0 THEN '/' ELSE '' END AS rel_path FROM part UNION SELECT p_brand FROM part) WHERE rel_path IN ('Brand#11', 'Brand#11/small ring', 'Brand#11/small ring/')",
    "ad_coverage_in": "SELECT p_partkey, p_brand || '/' || p_name AS rel_path FROM part WHERE p_brand = 'Brand#1'",
    "st_spans": "SELECT event_type AS service, CASE WHEN event_id % 3 = 0 THEN 'GET' END AS method, CASE WHEN event_id % 3 < 2 THEN '/' || event_type END AS path, count(*) AS n, sum(CASE WHEN event_id % 4 > 0 AND event_id * 2 - 50 > event_id THEN event_id - 50 ELSE 0 END)::BIGINT AS ns FROM events GROUP BY ALL",
    
    "rm_digest": f"WITH i AS (SELECT sha256({IMAGE}) AS id FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL), g AS (SELECT substr(id, 1, 3) AS g, count(*) AS n, sha256(string_agg(id, '' ORDER BY id)) AS d FROM i GROUP BY 1) SELECT sum(n)::BIGINT AS records, sha256(string_agg(d, '' ORDER BY g)) AS digest FROM g",
    "rm_query": f"SELECT sha256({IMAGE}) AS id, (conv_id * 1000 + turn + 1)::BIGINT AS timestamp_ms FROM conversations WHERE role = 'user' AND text IS NOT NULL AND conv_id * 1000 + turn + 1 BETWEEN 5000 AND 40000",
    "rm_union": "SELECT role AS author, count(*) AS n FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL) GROUP BY 1",
    "rm_thread": "SELECT (conv_id * 1000 + turn + 1)::BIGINT AS timestamp_ms, role AS author, text AS content FROM conversations WHERE conv_id = 12 AND text IS NOT NULL AND role IS NOT NULL",
    "st_p99": "SELECT event_type, list_sort(list(value))[least(floor(count(*) * 0.99)::BIGINT, count(*) - 1) + 1] AS p99 FROM events WHERE value IS NOT NULL GROUP BY 1",
    "st_delta": "SELECT doc_id::VARCHAR AS rel_path, CASE WHEN doc_id % 11 = 0 THEN 'added' WHEN doc_id % 7 = 0 THEN 'removed' ELSE 'changed' END AS change FROM documents WHERE (doc_id % 11 = 0 AND doc_id % 7 <> 0) OR (doc_id % 11 <> 0 AND doc_id % 7 = 0) OR (doc_id % 11 <> 0 AND doc_id % 7 <> 0 AND doc_id % 5 = 0)",
}
