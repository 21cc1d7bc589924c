"""Search queries over the star-schema graph and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import search as s
from graphloom.operators.architecture import languages
from graphloom.plans.model import GraphView, star_view

NODES = """(SELECT r_regionkey::BIGINT * 10 + 1 AS id, 'Region' AS label, r_name AS name, 'tpch.' || r_name AS qn, r_name AS path FROM region
 UNION ALL SELECT n_nationkey::BIGINT * 10 + 2, 'Nation', n_name, 'tpch.' || r_name || '.' || n_name, r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT c_custkey * 10 + 3, 'Customer', c_name, 'tpch.' || r_name || '.' || n_name || '.' || c_name, r_name || '/' || n_name || '/customer' FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT s_suppkey * 10 + 4, 'Supplier', s_name, 'tpch.' || r_name || '.' || n_name || '.' || s_name, r_name || '/' || n_name || '/supplier' FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT p_partkey * 10 + 5, 'Part', p_name, 'tpch.parts.' || p_brand || '.' || p_partkey, 'parts/' || p_brand || '/part' FROM part
 UNION ALL SELECT o_orderkey * 10 + 6, 'Order', 'Order#' || o_orderkey, 'tpch.orders.' || o_orderpriority || '.' || o_orderkey, 'orders/' || o_orderpriority FROM orders)"""
EDGES = """(SELECT n_nationkey::BIGINT * 10 + 2 AS s, n_regionkey::BIGINT * 10 + 1 AS t, 'IN_REGION' AS type FROM nation
 UNION ALL SELECT c_custkey * 10 + 3, c_nationkey::BIGINT * 10 + 2, 'IN_NATION' FROM customer
 UNION ALL SELECT s_suppkey * 10 + 4, s_nationkey::BIGINT * 10 + 2, 'IN_NATION' FROM supplier
 UNION ALL SELECT o_custkey * 10 + 3, o_orderkey * 10 + 6, 'PLACED' FROM orders
 UNION ALL SELECT DISTINCT l_orderkey * 10 + 6, l_partkey * 10 + 5, 'HAS_PART' FROM lineitem
 UNION ALL SELECT DISTINCT l_suppkey * 10 + 4, l_partkey * 10 + 5, 'SUPPLIES' FROM lineitem)"""


def _view(use):
    return lambda spark, sf_dir: use(star_view(spark, sf_dir))


def _bm25(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return s.bm25(d, "doc_id", F.col("text"), ["the", "nation", "idiot"]).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def _search_code(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), "text")
    return s.search_code(d, "Licensed under").select("path", "line")


def _snippet(spark, sf_dir):
    """The second to fourth line of a document, as a node's own lines."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), "text", "doc_id")
    nodes = d.select(F.col("doc_id").alias("id"), F.col("path").alias("qualified_name"), F.col("path").alias("file_path"), F.lit(2).alias("start_line"), F.lit(4).alias("end_line"))
    return s.snippet(GraphView(nodes, nodes), d.select("path", "text"), "7")


def _languages(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    ends = F.element_at(F.array(*map(F.lit, (".py", ".go", ".rs", ".unknown"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return languages(GraphView(p.select(F.lit("File").alias("label"), F.concat("p_name", ends).alias("file_path")), p))


QUERIES = {
    "sr_snippet": _snippet,
    "ar_languages": _languages,
    "sr_label": _view(lambda g: s.nodes_by(g, label="Supplier").select("id", "name")),
    "sr_suffix": _view(lambda g: s.with_suffix(g, "ASIA").select("id", "qualified_name")),
    "sr_regex": _view(lambda g: s.matching(g, s.Search(name_pattern="customer.*77$", label="Customer")).select("id", "name")),
    "sr_glob": _view(lambda g: s.matching(g, s.Search(file_pattern="ASIA/**", label="Supplier")).select("id", "file_path")),
    "sr_page": _view(lambda g: s.search(g, s.Search(label="Part", sort_by="name", limit=7, offset=11))[0].select("id", "name")),
    "sr_relationship": _view(lambda g: s.matching(g, s.Search(relationship="IN_REGION", direction="inbound")).select("id", "name")),
    "sr_degree": _view(lambda g: s.degrees(g).filter("in_degree + out_degree > 0").select("id", F.col("in_degree").cast("long").alias("in_degree"), F.col("out_degree").cast("long").alias("out_degree"))),
    "sr_degree_type": _view(lambda g: s.degrees(g, ("PLACED",)).filter("out_degree > 10").select("id", F.col("out_degree").cast("long").alias("out_degree"))),
    "sr_files": _view(lambda g: s.files(g)),
    "sr_counts": _view(lambda g: s.counts(g)),
    "sr_counts_scope": _view(lambda g: s.counts(g, directory="ASIA/")),
    "sr_ids": _view(lambda g: s.ids_of(g, g.nodes.sparkSession.createDataFrame([("tpch.ASIA",), ("tpch.none",)], "qualified_name string"))),
    "sr_bm25": _bm25,
    "sr_search_code": _search_code,
    "gr_schema": _view(lambda g: s.schema_patterns(g)),
    "gr_schema_keys": _view(lambda g: s.property_keys(g)),
}
DEGREES = f"SELECT n.id, count(*) FILTER (e.t = n.id)::BIGINT AS in_degree, count(*) FILTER (e.s = n.id)::BIGINT AS out_degree FROM {NODES} n JOIN (SELECT s, t, s AS k FROM {EDGES} UNION ALL SELECT s, t, t FROM {EDGES}) e ON e.k = n.id GROUP BY n.id"
ORACLES = {
    "sr_snippet": "SELECT '7' AS qualified_name, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS source FROM documents WHERE doc_id = 7",
    "ar_languages": "SELECT CASE p_partkey % 4 WHEN 0 THEN 'Python' WHEN 1 THEN 'Go' ELSE 'Rust' END AS language, count(*) AS files FROM part WHERE p_partkey % 4 < 3 GROUP BY 1",
    "sr_label": "SELECT s_suppkey * 10 + 4 AS id, s_name AS name FROM supplier",
    "sr_suffix": f"SELECT id, qn AS qualified_name FROM {NODES} WHERE qn = 'ASIA' OR ends_with(qn, '.ASIA')",
    "sr_regex": f"SELECT id, name FROM {NODES} WHERE label = 'Customer' AND regexp_matches(name, '(?i)customer.*77$')",
    "sr_glob": f"SELECT id, path AS file_path FROM {NODES} WHERE label = 'Supplier' AND path LIKE 'ASIA%'",
    "sr_page": f"SELECT id, name FROM {NODES} WHERE label = 'Part' ORDER BY name, id LIMIT 7 OFFSET 11",
    "sr_relationship": "SELECT r_regionkey::BIGINT * 10 + 1 AS id, r_name AS name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)",
    "sr_degree": DEGREES,
    "sr_degree_type": "SELECT o_custkey * 10 + 3 AS id, count(*) AS out_degree FROM orders GROUP BY 1 HAVING count(*) > 10",
    "sr_files": f"SELECT DISTINCT path AS file_path FROM {NODES}",
    "sr_counts": f"SELECT 'node' AS kind, label AS name, count(*) AS n FROM {NODES} GROUP BY 2 UNION ALL SELECT 'edge', type, count(*) FROM {EDGES} GROUP BY 2",
    "sr_counts_scope": f"WITH n AS (SELECT * FROM {NODES} WHERE path = 'ASIA' OR starts_with(path, 'ASIA/')) SELECT 'node' AS kind, label AS name, count(*) AS n FROM n GROUP BY 2 UNION ALL SELECT 'edge', type, count(*) FROM {EDGES} WHERE s IN (SELECT id FROM n) GROUP BY 2",
    "sr_ids": "SELECT 'tpch.none' AS qualified_name, 0::BIGINT AS id UNION ALL SELECT 'tpch.' || r_name, r_regionkey::BIGINT * 10 + 1 FROM region WHERE r_name = 'ASIA'",
    "sr_bm25": """WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
 f AS (SELECT doc_id, len(w) AS l, t, len(list_filter(w, lambda x: x = t)) AS tf FROM w, (VALUES ('the'), ('nation'), ('idiot')) q(t)),
 d AS (SELECT t, count(*) FILTER (tf > 0) AS df, count(*) AS n, avg(l) AS mean FROM f GROUP BY t)
 SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 6) AS score FROM f JOIN d USING (t) GROUP BY doc_id HAVING sum(tf) > 0""",
    "sr_search_code": "SELECT doc_id::VARCHAR AS path, i::INTEGER AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE contains(x, 'Licensed under')",
    "gr_schema": f"SELECT a.label AS source_label, type, b.label AS target_label, count(*) AS n FROM {EDGES} e JOIN {NODES} a ON a.id = e.s JOIN {NODES} b ON b.id = e.t GROUP BY ALL",
    "gr_schema_keys": "SELECT 'Customer' AS label, k AS key, count(*) AS n FROM customer, (VALUES ('acctbal'), ('mktsegment')) t(k) GROUP BY k UNION ALL SELECT 'Supplier', 'acctbal', count(*) FROM supplier UNION ALL SELECT 'Part', k, count(*) FROM part, (VALUES ('type'), ('size'), ('retailprice')) t(k) GROUP BY k UNION ALL SELECT 'Order', k, count(*) FROM orders, (VALUES ('status'), ('totalprice')) t(k) GROUP BY k",
}
