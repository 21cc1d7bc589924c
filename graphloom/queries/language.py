"""Queries in the query language over the star-schema graph."""

from __future__ import annotations

from graphloom.plans.compiler import cypher
from graphloom.plans.model import star_view

#: name: (query, SQL)
PAIRS: dict[str, tuple[str, str]] = {
    "cy_flagship": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.status = 'F' RETURN c.name AS name, count(o) AS n ORDER BY n DESC, name LIMIT 10",
        "SELECT c_name AS name, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY c_custkey, c_name ORDER BY n DESC, name LIMIT 10",
    ),
    "cy_filter_count": (
        "MATCH (c:Customer) WHERE c.acctbal > 1000 AND c.mktsegment IN ['BUILDING', 'MACHINERY'] RETURN c.mktsegment AS segment, count(*) AS n",
        "SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE c_acctbal > 1000 AND c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1",
    ),
    "cy_order_skip_limit": (
        "MATCH (o:Order) RETURN o.name AS name, o.totalprice AS price ORDER BY price DESC, name SKIP 5 LIMIT 20",
        "SELECT 'Order#' || o_orderkey AS name, o_totalprice AS price FROM orders ORDER BY price DESC, name LIMIT 20 OFFSET 5",
    ),
    "cy_distinct": ("MATCH (o:Order) RETURN DISTINCT o.status AS status", "SELECT DISTINCT o_orderstatus AS status FROM orders"),
    "cy_label_alternation": (
        "MATCH (n:Region|Nation) RETURN n.label AS label, n.qualified_name AS qn",
        "SELECT 'Region' AS label, 'tpch.' || r_name AS qn FROM region UNION ALL SELECT 'Nation', 'tpch.' || r_name || '.' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "cy_inline_props": ("MATCH (p:Part {size: '10'}) RETURN count(*) AS n", "SELECT count(*) AS n FROM part WHERE p_size = 10"),
    "cy_direction_any": (
        "MATCH (n:Nation)-[r:IN_REGION|IN_NATION]-(m) RETURN n.name AS name, type(r) AS kind, count(m) AS n",
        "SELECT n_name AS name, 'IN_REGION' AS kind, count(*) AS n FROM nation GROUP BY 1 UNION ALL SELECT n_name, 'IN_NATION', count(*) FROM nation JOIN (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) ON k = n_nationkey GROUP BY 1",
    ),
    "cy_chain": (
        "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order) RETURN r.name AS region, count(o) AS orders",
        "SELECT r_name AS region, count(*) AS orders FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    ),
    "cy_varlen_1_3": (
        "MATCH (o:Order {status: 'P'})<-[:PLACED]-(c:Customer)-[:IN_NATION|IN_REGION*1..3]->(x) RETURN x.label AS label, x.name AS name, count(*) AS n",
        "SELECT 'Nation' AS label, n_name AS name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'P' GROUP BY 2 UNION ALL SELECT 'Region', r_name, count(*) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'P' GROUP BY 2",
    ),
    "cy_multi_match": (
        "MATCH (s:Supplier)-[:IN_NATION]->(n:Nation) MATCH (c:Customer)-[:IN_NATION]->(n) WHERE s.acctbal > 9000 AND c.acctbal > 9000 RETURN n.name AS nation, count(*) AS pairs",
        "SELECT n_name AS nation, count(*) AS pairs FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN customer ON c_nationkey = n_nationkey WHERE s_acctbal > 9000 AND c_acctbal > 9000 GROUP BY 1",
    ),
    "cy_optional": (
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.status = 'P' RETURN c.name AS name, count(o) AS n",
        "SELECT c_name AS name, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey, 1",
    ),
    "cy_optional_is_null": (
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order {status: 'P'}) WITH c, o WHERE o IS NULL RETURN c.name AS name",
        "SELECT c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    ),
    "cy_exists": (
        "MATCH (c:Customer) WHERE EXISTS { (c)-[:PLACED]->(:Order {status: 'P'}) } AND c.acctbal < 0 RETURN c.name AS name",
        "SELECT c_name AS name FROM customer WHERE c_acctbal < 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    ),
    "cy_not_exists": (
        "MATCH (c:Customer) WHERE NOT EXISTS { (c)-[:PLACED]->(:Order {status: 'P'}) } RETURN c.name AS name",
        "SELECT c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    ),
    "cy_exists_or": (
        "MATCH (c:Customer) WHERE EXISTS { (c)-[:PLACED]->(:Order {status: 'P'}) } XOR c.acctbal > 5000 RETURN count(*) AS n",
        "SELECT count(*) AS n FROM customer WHERE (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')) <> (c_acctbal > 5000)",
    ),
    "cy_boolean": (
        "MATCH (p:Part) WHERE (p.size < 5 OR p.size >= 48) AND NOT p.type CONTAINS 'ECON' AND p.name STARTS WITH 'small' RETURN count(*) AS n",
        "SELECT count(*) AS n FROM part WHERE (p_size < 5 OR p_size >= 48) AND NOT contains(p_type, 'ECON') AND starts_with(p_name, 'small')",
    ),
    "cy_regex": (
        "MATCH (p:Part) WHERE p.type =~ '(ECON|SM).*' AND p.name =~ '.*ring.*' RETURN p.type AS type, count(*) AS n",
        "SELECT p_type AS type, count(*) AS n FROM part WHERE regexp_full_match(p_type, '(ECON|SM).*') AND regexp_full_match(p_name, '.*ring.*') GROUP BY 1",
    ),
    "cy_with_having": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS n, sum(o.totalprice) AS total WHERE n > 15 RETURN c.name AS name, n, total",
        "SELECT c_name AS name, count(*) AS n, sum(o_totalprice) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING count(*) > 15",
    ),
    "cy_union": (
        "MATCH (c:Customer)-[:IN_NATION]->(n) RETURN n.name AS name UNION MATCH (s:Supplier)-[:IN_NATION]->(n) RETURN n.name AS name",
        "SELECT n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    ),
    "cy_union_all": (
        "MATCH (n:Nation) RETURN n.name AS name UNION ALL MATCH (r:Region) RETURN r.name AS name",
        "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region",
    ),
    "cy_unwind": (
        "UNWIND ['BUILDING', 'AUTOMOBILE'] AS seg MATCH (c:Customer) WHERE c.mktsegment = seg RETURN seg, count(c) AS n",
        "SELECT c_mktsegment AS seg, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE') GROUP BY 1",
    ),
    "cy_case": (
        "MATCH (o:Order) RETURN CASE WHEN o.totalprice > 200000 THEN 'large' WHEN o.totalprice > 100000 THEN 'middle' ELSE 'small' END AS size, count(*) AS n",
        "SELECT CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS size, count(*) AS n FROM orders GROUP BY 1",
    ),
    "cy_functions": (
        "MATCH (n:Nation) RETURN id(n) AS id, toLower(n.name) AS low, toUpper(n.name) AS up, substring(n.name, 1, 3) AS sub, left(n.name, 2) AS l, right(n.name, 2) AS r, reverse(n.name) AS rev, size(n.name) AS len, replace(n.name, 'A', 'x') AS rep, toInteger('12') AS i, toFloat('1.5') AS f, coalesce(n.status, 'none') AS c, trim('  a ') AS t, toString(n.id) AS s, toBoolean('true') AS b",
        "SELECT n_nationkey::BIGINT * 10 + 2 AS id, lower(n_name) AS low, upper(n_name) AS up, substr(n_name, 2, 3) AS sub, left(n_name, 2) AS l, right(n_name, 2) AS r, reverse(n_name) AS rev, length(n_name)::INTEGER AS len, replace(n_name, 'A', 'x') AS rep, 12::BIGINT AS i, 1.5::DOUBLE AS f, 'none' AS c, 'a' AS t, (n_nationkey * 10 + 2)::VARCHAR AS s, true AS b FROM nation",
    ),
    "cy_aggs": (
        "MATCH (s:Supplier)-[:IN_NATION]->(n:Nation) RETURN n.name AS nation, count(DISTINCT s.name) AS names, min(s.acctbal) AS low, max(s.acctbal) AS high, avg(s.acctbal) AS mean, collect(s.id) AS ids",
        "SELECT n_name AS nation, count(DISTINCT s_name) AS names, min(s_acctbal) AS low, max(s_acctbal) AS high, avg(s_acctbal) AS mean, list_sort(list(s_suppkey * 10 + 4)) AS ids FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1",
    ),
    "cy_label_test": (
        "MATCH (n) WHERE n:Region OR n:Nation RETURN labels(n) AS labels, n.name AS name",
        "SELECT ['Region'] AS labels, r_name AS name FROM region UNION ALL SELECT ['Nation'], n_name FROM nation",
    ),
    "cy_keys": (
        "MATCH (p:Part) RETURN keys(p) AS keys, count(*) AS n",
        "SELECT ['end_line', 'file_path', 'id', 'label', 'name', 'project', 'qualified_name', 'retailprice', 'size', 'start_line', 'type'] AS keys, count(*) AS n FROM part",
    ),
    "cy_properties": (
        "MATCH (s:Supplier) RETURN s.name AS name, properties(s) CONTAINS 'acctbal' AS has, size(properties(s)) > 12 AS long",
        "SELECT s_name AS name, true AS has, true AS long FROM supplier",
    ),
    "cy_limit_zero": ("MATCH (n:Nation) RETURN n.name AS name LIMIT 0", "SELECT n_name AS name FROM nation LIMIT 0"),
}


def _query(text: str):
    return lambda spark, sf_dir: cypher(star_view(spark, sf_dir), text, max_rows=None)


QUERIES = {name: _query(text) for name, (text, _) in PAIRS.items()}
ORACLES = {name: sql for name, (_, sql) in PAIRS.items()}
