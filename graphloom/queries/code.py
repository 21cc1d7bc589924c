"""Queries over parts seen as code: calls, flags, routes and tests, so that statuses, layers and degrees have something to tell apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import architecture as a
from graphloom.operators import facts, resolve, semantic
from graphloom.operators import search as s
from graphloom.operators import traverse as t
from graphloom.plans.model import GraphView, code_view, deduplicated_edges
from graphloom.sources import artifact, delta

NODES = """(SELECT p_partkey AS id, CASE WHEN p_size = 1 THEN 'Route' WHEN p_size % 2 = 0 THEN 'Function' ELSE 'Method' END AS label, CASE WHEN p_size % 11 = 0 THEN 'test_' ELSE 'f' END || p_partkey AS name,
 'shop.src.' || replace(p_brand, '#', '') || '.' || CASE WHEN p_size % 11 = 0 THEN 'test_' ELSE 'f' END || p_partkey AS qn, replace(p_brand, '#', '') AS package, CASE WHEN p_size % 13 = 0 THEN 'tests/' ELSE 'src/' END || replace(p_brand, '#', '') || '.py' AS path,
 p_partkey % 1000 + 1 AS start_line, p_partkey % 1000 + 1 + p_size AS end_line, p_size % 11 = 0 OR p_size % 13 = 0 AS in_test, p_size % 7 = 0 AS starts, p_size % 3 = 0 AS exported FROM part)"""
EDGES = """(SELECT DISTINCT a.l_partkey AS s, b.l_partkey AS t, 'CALLS' AS type FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
 UNION ALL SELECT DISTINCT a.l_partkey, b.l_partkey, 'USAGE' FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 2)"""
CTE = f"n AS MATERIALIZED (SELECT * FROM {NODES}), e AS MATERIALIZED (SELECT * FROM {EDGES})"
PACKAGES = "k AS (SELECT a.package AS f, b.package AS g, count(*) AS c FROM e JOIN n a ON a.id = s JOIN n b ON b.id = t WHERE type = 'CALLS' AND a.package <> b.package GROUP BY 1, 2), p AS (SELECT package, count(*) AS node_count, coalesce((SELECT sum(c) FROM k WHERE g = package), 0)::BIGINT AS fan_in, coalesce((SELECT sum(c) FROM k WHERE f = package), 0)::BIGINT AS fan_out FROM n GROUP BY package)"


def _view(use):
    return lambda spark, sf_dir: use(code_view(spark, sf_dir))


def _changes(g):
    hunks = g.nodes.sparkSession.createDataFrame([("src/Brand11.py", 10, 30), ("src/Brand32.py", 500, 500)], "path string, start int, end int")
    return t.detect_changes(g, hunks, 2).select("id", "name", "hop", "risk")


def _named(found, column):
    return found.select("id", F.array_join(column, ",").alias(column))


def _facts(g):
    """Each node refers to, throws and writes the part of its own brand with the next key, by name."""
    module = F.regexp_replace("qualified_name", "\\.[^.]*$", "")
    return g.nodes.select(F.col("id").alias("source_id"), module.alias("module"), F.concat(F.lit("f"), (F.col("id") + 25).cast("string")).alias("name"), F.array().cast("array<string>").alias("imports"), (F.col("start_line") % 2 == 0).alias("is_write"), (F.col("end_line") % 2 == 0).alias("precise"))


def _none(g):
    return g.nodes.sparkSession.createDataFrame([], "module string, alias string, target string")


def _tally(g):
    return g.nodes.groupBy(F.col("label").alias("kind")).agg(F.count("*").alias("n")).union(g.edges.groupBy("type").agg(F.count("*")))


def _patched(g):
    """One file's functions get other ids, and keep their names; edges from other files follow them."""
    paths = g.nodes.sparkSession.createDataFrame([("src/Brand11.py",)], "file_path string")
    new = g.nodes.filter("file_path = 'src/Brand11.py'").withColumn("id", -F.col("id") - 1)
    return delta.patched(g, new, g.edges.limit(0), paths).edges.select("source_id", "target_id", "type")


def _dumped(g):
    """Fresh ids in the order of names, seen through the edges: how far apart the ends' places are."""
    d = artifact.dumped(g)
    return d.edges.select("source_id", "target_id", "type")


QUERIES = {
    "ar_code_packages": _view(a.packages),
    "ar_code_layers": _view(a.layers),
    "ar_code_boundaries": _view(a.boundaries),
    "ar_entry_points": _view(a.entry_points),
    "ar_routes": _view(a.routes),
    "gr_code_status": _view(t.status),
    "gr_trace": _view(lambda g: t.trace_path(g, "f77", "both", 2)),
    "gr_detect_changes": _view(_changes),
    "gr_call_depth": _view(lambda g: t.call_depth(g).select("id", F.col("depth").cast("long").alias("depth"))),
    "rj_tests": _view(lambda g: resolve.test_edges(g.edges, g.nodes)),
    "rj_usages": _view(lambda g: facts.usages(_facts(g), g.nodes, _none(g))),
    "rj_accesses": _view(lambda g: facts.accesses(_facts(g), g.nodes, _none(g))),
    "sr_min_degree": _view(lambda g: s.matching(g, s.Search(min_degree=60, exclude_labels=("Route",))).select("id", F.col("in_degree").cast("long").alias("in_degree"), F.col("out_degree").cast("long").alias("out_degree"))),
    "sr_max_degree": _view(lambda g: s.matching(g, s.Search(max_degree=40, exclude_entry_points=True)).select("id", "name")),
    "sr_callers": _view(lambda g: _named(s.callers_and_callees(g), "callers")),
    "sr_callees": _view(lambda g: _named(s.callers_and_callees(g), "callees")),
    "sr_overlapping": _view(lambda g: s.overlapping(g, "src/Brand11.py", 100, 300).select("id")),
    "sr_edges_by": _view(lambda g: s.edges_by(g, source=77, kind="USAGE").select("source_id", "target_id")),
    "sr_call_pairs": _view(lambda g: s.call_pairs(g, 500)[0]),
    "sr_by_degree": _view(lambda g: s.search(g, s.Search(sort_by="degree", limit=20))[0].select("id", "name")),
    "sr_connected": _view(lambda g: _named(s.matching(g, s.Search(include_connected=True, label="Function")), "connected")),
    "sr_call_names": _view(lambda g: _named(semantic.neighbours(g.nodes, g.edges.filter("type = 'CALLS'")), "names")),
    "ad_without": _view(lambda g: _tally(delta.without(g, label="Route"))),
    "ad_merged": _view(lambda g: artifact.merged(g, GraphView(g.nodes.filter("id % 3 = 0").withColumn("name", F.lit("new")), g.edges.limit(0))).nodes.select("id", "name")),
    "ad_edges": _view(lambda g: deduplicated_edges(g.edges.union(g.edges).union(g.edges.withColumn("type", F.lit("CALLS")))).select("source_id", "target_id", "type")),
    "st_patched": _view(_patched),
    "st_carried": _view(lambda g: artifact.carried(g.nodes.withColumn("project", F.when(F.col("id") % 2 == 0, "even").otherwise("odd")), g.nodes.withColumn("project", F.lit("even")).withColumn("name", F.lit("new")), "even").select("id", "project", "name")),
    "sk_dumped": _view(_dumped),
    "gr_node_degree": _view(lambda g: s.node_degree(g, 77)),
}
ORACLES = {
    "ar_code_packages": f"WITH {CTE}, {PACKAGES} SELECT * FROM p",
    "ar_code_layers": f"WITH {CTE}, {PACKAGES}, r AS (SELECT DISTINCT package FROM n WHERE label = 'Route'), b AS (SELECT DISTINCT package FROM n WHERE starts AND NOT in_test) SELECT package, CASE WHEN package IN (FROM r) THEN 'api' WHEN package IN (FROM b) THEN 'entry' WHEN fan_in > fan_out AND fan_in > 0 THEN 'core' WHEN fan_out > 0 THEN 'internal' ELSE 'leaf' END AS layer, CASE WHEN package IN (FROM r) THEN 'has routes' WHEN package IN (FROM b) THEN 'has entry points' ELSE 'fan-in ' || fan_in || ', fan-out ' || fan_out END AS reason FROM p",
    "ar_code_boundaries": f"WITH {CTE}, {PACKAGES} SELECT f AS from_package, g AS to_package, c AS n FROM k",
    "ar_entry_points": f"WITH {CTE} SELECT name, qn AS qualified_name, path AS file_path FROM n WHERE starts AND NOT in_test",
    "ar_routes": f"WITH {CTE} SELECT 'GET' AS method, '/' || package || '/' || id AS path, qn AS handler FROM n WHERE label = 'Route'",
    "gr_code_status": f"WITH {CTE}, u AS (SELECT t AS id, count(*) FILTER (type = 'CALLS') AS calls, count(*) AS uses FROM e GROUP BY t) SELECT id, CASE WHEN label = 'Route' THEN 'structural' WHEN in_test THEN 'test' WHEN starts THEN 'entry' WHEN exported THEN 'exported' WHEN coalesce(uses, 0) = 0 THEN 'dead' WHEN calls = 1 THEN 'single' ELSE 'normal' END AS status FROM n LEFT JOIN u USING (id)",
    "gr_trace": f"WITH RECURSIVE {CTE}, w(d, id, hop) AS (SELECT d, n.id, 0 FROM n, (VALUES ('out'), ('in')) x(d) WHERE name = 'f77' UNION SELECT d, CASE d WHEN 'out' THEN t ELSE s END, hop + 1 FROM w JOIN e ON type = 'CALLS' AND w.id = CASE d WHEN 'out' THEN s ELSE t END WHERE hop < 2) SELECT d AS direction, w.id, name, min(hop)::INTEGER AS hop FROM w JOIN n ON n.id = w.id GROUP BY d, w.id, name HAVING min(hop) > 0",
    "gr_detect_changes": f"WITH RECURSIVE {CTE}, w(id, hop) AS (SELECT id, 0 FROM n WHERE path = 'src/Brand11.py' AND start_line <= 30 AND end_line >= 10 OR path = 'src/Brand32.py' AND start_line <= 500 AND end_line >= 500 UNION SELECT s, hop + 1 FROM w JOIN e ON type = 'CALLS' AND t = w.id WHERE hop < 2) SELECT w.id, name, min(hop)::INTEGER AS hop, CASE min(hop) WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' END AS risk FROM w JOIN n ON n.id = w.id GROUP BY w.id, name HAVING min(hop) > 0",
    "gr_call_depth": f"WITH RECURSIVE {CTE}, w(id, hop) AS (SELECT id, 0 FROM n WHERE label = 'Route' UNION SELECT t, hop + 1 FROM w JOIN e ON s = w.id WHERE hop < 12) SELECT n.id, coalesce(min(hop), 0) AS depth FROM n LEFT JOIN w ON w.id = n.id GROUP BY n.id",
    "rj_tests": f"WITH {CTE} SELECT DISTINCT s AS source_id, t AS target_id FROM e JOIN n a ON a.id = s JOIN n b ON b.id = t WHERE type = 'CALLS' AND a.in_test AND starts_with(a.name, 'test_') AND NOT b.in_test",
    "rj_usages": f"WITH {CTE} SELECT a.id AS source_id, b.id AS target_id, CASE WHEN a.end_line % 2 = 0 THEN 'CALL_REFERENCE' ELSE 'USAGE' END AS type, b.name AS callee FROM n a JOIN n b ON b.id = a.id + 25 AND starts_with(b.name, 'f') AND b.label <> 'Route'",
    "rj_accesses": f"WITH {CTE} SELECT a.id AS source_id, b.id AS target_id, CASE WHEN a.start_line % 2 = 0 THEN 'WRITES' ELSE 'READS' END AS type FROM n a JOIN n b ON b.id = a.id + 25 AND starts_with(b.name, 'f') AND b.label <> 'Route'",
    "sr_min_degree": f"WITH {CTE}, g AS (SELECT n.id, label, (SELECT count(*) FROM e WHERE t = n.id) AS in_degree, (SELECT count(*) FROM e WHERE s = n.id) AS out_degree FROM n) SELECT id, in_degree, out_degree FROM g WHERE label <> 'Route' AND in_degree + out_degree >= 60",
    "sr_max_degree": f"WITH {CTE} SELECT id, name FROM n WHERE NOT starts AND (SELECT count(*) FROM e WHERE t = n.id) + (SELECT count(*) FROM e WHERE s = n.id) <= 40",
    "sr_callers": f"WITH {CTE}, r AS (SELECT t AS id, name, row_number() OVER (PARTITION BY t ORDER BY name, n.id) AS k FROM e JOIN n ON n.id = s WHERE type = 'CALLS') SELECT n.id, coalesce((SELECT string_agg(r.name, ',' ORDER BY r.name) FROM r WHERE r.id = n.id AND k <= 10), '') AS callers FROM n",
    "sr_callees": f"WITH {CTE}, r AS (SELECT s AS id, name, row_number() OVER (PARTITION BY s ORDER BY name, n.id) AS k FROM e JOIN n ON n.id = t WHERE type = 'CALLS') SELECT n.id, coalesce((SELECT string_agg(r.name, ',' ORDER BY r.name) FROM r WHERE r.id = n.id AND k <= 10), '') AS callees FROM n",
    "sr_overlapping": f"WITH {CTE} SELECT id FROM n WHERE path = 'src/Brand11.py' AND start_line <= 300 AND end_line >= 100",
    "sr_edges_by": f"WITH {CTE} SELECT s AS source_id, t AS target_id FROM e WHERE s = 77 AND type = 'USAGE'",
    "sr_call_pairs": f"WITH {CTE} SELECT s AS source_id, t AS target_id FROM e JOIN n a ON a.id = s JOIN n b ON b.id = t WHERE type = 'CALLS' AND a.label <> 'Route' AND b.label <> 'Route' ORDER BY s, t LIMIT 500",
    "sr_by_degree": f"WITH {CTE} SELECT n.id, name FROM n ORDER BY (SELECT count(*) FROM e WHERE t = n.id) + (SELECT count(*) FROM e WHERE s = n.id) DESC, n.id LIMIT 20",
    "sr_connected": f"WITH {CTE}, r AS (SELECT t AS id, name, row_number() OVER (PARTITION BY t ORDER BY name, n.id) AS k FROM e JOIN n ON n.id = s WHERE type = 'CALLS' UNION ALL SELECT s, name, row_number() OVER (PARTITION BY s ORDER BY name, n.id) FROM e JOIN n ON n.id = t WHERE type = 'CALLS'), u AS (SELECT DISTINCT id, name FROM r WHERE k <= 10) SELECT n.id, coalesce((SELECT string_agg(u.name, ',' ORDER BY u.name) FROM u WHERE u.id = n.id), '') AS connected FROM n WHERE label = 'Function'",
    "sr_call_names": f"WITH {CTE}, r AS (SELECT s AS id, name, row_number() OVER (PARTITION BY s ORDER BY name) AS k FROM (SELECT DISTINCT s, name FROM e JOIN n ON n.id = t WHERE type = 'CALLS')) SELECT id, string_agg(name, ',' ORDER BY name) AS names FROM r WHERE k <= 64 GROUP BY id",
    "ad_without": f"WITH {CTE} SELECT label AS kind, count(*) AS n FROM n WHERE label <> 'Route' GROUP BY 1 UNION ALL SELECT type, count(*) FROM e JOIN n a ON a.id = s JOIN n b ON b.id = t WHERE a.label <> 'Route' AND b.label <> 'Route' GROUP BY 1",
    "ad_merged": f"WITH {CTE} SELECT id, CASE WHEN id % 3 = 0 THEN 'new' ELSE name END AS name FROM n",
    "ad_edges": f"WITH {CTE} SELECT s AS source_id, t AS target_id, type FROM e UNION SELECT s, t, 'CALLS' FROM e",
    "st_patched": f"WITH {CTE}, g AS (SELECT id FROM n WHERE path = 'src/Brand11.py') SELECT s AS source_id, CASE WHEN t IN (FROM g) THEN -t - 1 ELSE t END AS target_id, type FROM e WHERE s NOT IN (FROM g)",
    "st_carried": f"WITH {CTE} SELECT id, 'odd' AS project, name FROM n WHERE id % 2 = 1 UNION ALL SELECT id, 'even', 'new' FROM n",
    "sk_dumped": f"WITH {CTE}, p AS (SELECT id, row_number() OVER (ORDER BY qn, id) AS k FROM n) SELECT a.k AS source_id, b.k AS target_id, type FROM e JOIN p a ON a.id = s JOIN p b ON b.id = t",
    "gr_node_degree": f"WITH {CTE} SELECT count(*) FILTER (t = 77) AS in_degree, count(*) FILTER (s = 77) AS out_degree FROM e WHERE type = 'CALLS'",
}
