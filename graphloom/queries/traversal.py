"""Traversal queries over the star-schema graph, and over calls made of parts that share an order."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import traverse as t
from graphloom.operators.architecture import connected
from graphloom.operators.search import edges_with_url
from graphloom.plans.model import GraphView, star_view
from graphloom.queries.search import EDGES, NODES


def _bfs(spark, sf_dir):
    return t.bfs(star_view(spark, sf_dir), [21, 31], (), "in", 2)[0].select("id", "hop")


def _bfs_single(spark, sf_dir):
    return t.bfs(star_view(spark, sf_dir), [13], (), "out", 4)[0].select("id", "hop")


def _impact(spark, sf_dir):
    found, edges, _ = t.bfs(star_view(spark, sf_dir), [1], (), "in", 3)
    return t.impact(found, edges)


def _dependents(spark, sf_dir):
    g = star_view(spark, sf_dir)
    return t.dependents(g, spark.createDataFrame([("ASIA/INDIA",), ("ASIA",)], "file_path string"))


def _status(spark, sf_dir):
    return t.status(star_view(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


def _ways(spark, sf_dir, target, **props):
    """Suppliers that call one another: a graph whose cycles and chains are known."""
    s, key = spark.read.parquet(f"{sf_dir}/supplier.parquet"), F.col("s_suppkey").cast("long")
    nodes = s.select(key.alias("id"), F.lit("p").alias("project"), F.lit("Function").alias("label"), F.col("s_name").alias("name"), F.col("s_name").alias("qualified_name"), F.lit("a.py").alias("file_path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.to_json(F.struct((F.col("s_nationkey") % 4).alias("loop_depth"))).alias("props"))
    edges = s.select(key.alias("id"), F.lit("p").alias("project"), key.alias("source_id"), target(key).alias("target_id"), F.lit("CALLS").alias("type"), F.concat(F.lit('{"url_path": "/'), "s_nationkey", F.lit('/x"}')).alias("props"))
    return GraphView(nodes, edges)


def _cycles(spark, sf_dir):
    return t.cycles(_ways(spark, sf_dir, lambda k: k * 5 % 13 + 1))


def _loop_depths(spark, sf_dir):
    g = _ways(spark, sf_dir, lambda k: F.floor(k / 2))
    return t.loop_depths(g).select("id", F.col("transitive_loop_depth").cast("long").alias("depth"), "recursive")


def _urls(spark, sf_dir):
    return edges_with_url(_ways(spark, sf_dir, lambda k: k + 1), "/1").select("source_id", "target_id")


def _connected(spark, sf_dir):
    line = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return connected(line.select(F.col("s_suppkey").cast("long").alias("a"), (F.col("s_suppkey") + F.when(F.col("s_suppkey") % 7 == 0, 1).otherwise(7)).cast("long").alias("b")))


QUERIES = {
    "gr_cycles": _cycles, "gr_loop_depths": _loop_depths, "gr_connected": _connected, "sr_edges_url": _urls,
    "gr_bfs": _bfs_single, "gr_bfs_multi": _bfs, "gr_impact": _impact, "gr_dependents": _dependents, "gr_status": _status}
ORACLES = {
    "gr_cycles": "WITH RECURSIVE e AS (SELECT s_suppkey::BIGINT AS s, s_suppkey::BIGINT * 5 % 13 + 1 AS t FROM supplier), w(s, t) AS (FROM e UNION SELECT w.s, e.t FROM w JOIN e ON e.s = w.t) SELECT a.s AS id, least(a.s, min(b.t)) AS component FROM w a JOIN w b ON b.s = a.s AND EXISTS (SELECT 1 FROM w c WHERE c.s = b.t AND c.t = a.s) WHERE a.s = a.t GROUP BY a.s",
    "gr_loop_depths": "WITH RECURSIVE o AS (SELECT s_suppkey::BIGINT AS id, s_nationkey % 4 AS own FROM supplier), w(id, here, d) AS (SELECT id, id, own FROM o UNION ALL SELECT w.id, w.here // 2, d + own FROM w JOIN o ON o.id = w.here // 2 WHERE w.here > 0) SELECT id, max(d)::BIGINT AS depth, id = 0 AS recursive FROM w GROUP BY id",
    "gr_connected": "WITH RECURSIVE e AS (SELECT s_suppkey::BIGINT AS a, (s_suppkey + CASE WHEN s_suppkey % 7 = 0 THEN 1 ELSE 7 END)::BIGINT AS b FROM supplier), f AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), w(a, b) AS (FROM f UNION SELECT w.a, f.b FROM w JOIN f ON f.a = w.b) SELECT a AS id, min(b) AS root FROM w GROUP BY a",
    "sr_edges_url": "SELECT s_suppkey::BIGINT AS source_id, s_suppkey::BIGINT + 1 AS target_id FROM supplier WHERE contains('/' || s_nationkey || '/x', '/1')",
    
    "gr_bfs": f"WITH RECURSIVE w(id, hop) AS (SELECT 13::BIGINT, 0 UNION SELECT e.t, hop + 1 FROM w JOIN {EDGES} e ON e.s = w.id WHERE hop < 4) SELECT id, min(hop)::INTEGER AS hop FROM w WHERE id <> 13 GROUP BY id",
    "gr_bfs_multi": f"WITH RECURSIVE w(id, hop) AS (SELECT unnest([21, 31])::BIGINT, 0 UNION SELECT e.s, hop + 1 FROM w JOIN {EDGES} e ON e.t = w.id WHERE hop < 2) SELECT id, min(hop)::INTEGER AS hop FROM w WHERE id NOT IN (21, 31) GROUP BY id",
    "gr_impact": f"WITH RECURSIVE w(id, hop) AS (SELECT 1::BIGINT, 0 UNION SELECT e.s, hop + 1 FROM w JOIN {EDGES} e ON e.t = w.id WHERE hop < 3), m AS (SELECT id, min(hop) AS hop FROM w WHERE id <> 1 GROUP BY id) SELECT count(*) FILTER (hop = 1) AS critical, count(*) FILTER (hop = 2) AS high, count(*) FILTER (hop = 3) AS medium, count(*) FILTER (hop > 3) AS low, count(*) AS total, false AS has_cross_service FROM m",
    "gr_dependents": f"WITH n AS (SELECT * FROM {NODES}) SELECT DISTINCT a.path AS file_path FROM {EDGES} e JOIN n a ON a.id = e.s JOIN n b ON b.id = e.t WHERE b.path IN ('ASIA/INDIA', 'ASIA') AND a.path NOT IN ('ASIA/INDIA', 'ASIA')",
    "gr_status": f"SELECT 'structural' AS status, count(*) AS n FROM {NODES}",
}
