"""Resolution joins over parts, orders and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions.text import confidence_band, url_path
from graphloom.operators import resolve as r


def _coupling(spark, sf_dir):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_shipdate")
    brand = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    commits = line.join(brand, "l_partkey").select(F.col("l_orderkey").alias("commit"), F.unix_timestamp("l_shipdate").alias("ts"), F.col("p_brand").alias("file"))
    commits = commits.groupBy("commit", "file").agg(F.max("ts").alias("ts"))
    out = r.change_coupling(commits, 3, 0.15)
    return out.select("file_a", "file_b", "co_changes", F.round("coupling_score", 6).alias("coupling_score"), "last_co_change")


def _symbols(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat_ws(".", F.lit("lib"), F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""), F.concat(F.lit("f"), (F.col("p_partkey") % 97).cast("string"))).alias("qualified_name")).distinct()


def _calls(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    module = F.concat(F.lit("lib.Brand"), (F.col("o_custkey") % 30).cast("string"))
    return o.select(F.col("o_orderkey").alias("call_id"), module.alias("module"), F.concat(F.lit("f"), (F.col("o_orderkey") % 120).cast("string")).alias("callee"), F.array().cast("array<string>").alias("imports"))


def _resolve(spark, sf_dir):
    imports = spark.createDataFrame([("none", "x", "y")], "module string, alias string, target string")
    # Equal calls of a module resolve alike: each is resolved once.
    calls = _calls(spark, sf_dir).select("call_id", F.struct("module", "callee", "imports").alias("call"))
    found = r.resolve(calls.select(F.col("call").alias("call_id"), "call.*").distinct(), _symbols(spark, sf_dir), imports)
    return calls.join(found.withColumnRenamed("call_id", "call"), "call").select("call_id", "qualified_name", "strategy", "confidence", "band")


def _division(spark, sf_dir):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    have = line.select(F.col("l_suppkey").alias("class"), F.concat("l_returnflag", "l_linestatus", (F.col("l_linenumber")).cast("string")).alias("method"))
    need = spark.createDataFrame([("all7", f"{a}{n}") for a in ("AF", "NO", "RF") for n in range(1, 8)] + [("some", "AF1"), ("some", "NO2")], "interface string, method string")
    return r.implicit_implements(have, need)


def _routes(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    calls = p.select(F.col("page_id").alias("call_id"), F.lit("get").alias("method"), url_path(F.regexp_replace("url", "#.*$", "")).alias("path"))
    routes = spark.createDataFrame([("en", "GET", "/en/{id}"), ("any", "GET", "/{lang}/{id}"), ("post", "POST", "/en/{id}")], "route string, method string, path string")
    return r.route_matches(calls, routes)


def _test_files(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    base = p.select(F.concat_ws("/", F.lit("src"), F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit(".py"))).alias("path"))
    tests = p.select(F.concat(F.lit("src/tests/test_m"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"))
    return r.test_files(base.union(tests))


def _band(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(confidence_band(F.col("l_discount") * 10).alias("band")).agg(F.count("*").alias("n"))


QUERIES = {"rj_coupling": _coupling, "rj_resolve": _resolve, "rj_division": _division, "rj_route_match": _routes, "rj_test_files": _test_files, "rj_band": _band}
ORACLES = {
    "rj_coupling": """WITH f AS (SELECT l_orderkey AS c, p_brand AS f, max(epoch(l_shipdate))::BIGINT AS ts FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
 t AS (SELECT f, count(*) AS total FROM f GROUP BY f),
 p AS (SELECT a.f AS file_a, b.f AS file_b, count(*) AS co_changes, max(a.ts) AS last_co_change FROM f a JOIN f b ON a.c = b.c AND a.f < b.f GROUP BY 1, 2 HAVING count(*) >= 3)
 SELECT file_a, file_b, co_changes, round(co_changes / least(x.total, y.total), 6) AS coupling_score, last_co_change FROM p JOIN t x ON x.f = file_a JOIN t y ON y.f = file_b WHERE co_changes / least(x.total, y.total) >= 0.15""",
    "rj_resolve": """WITH s AS (SELECT q, string_split(q, '.')[3] AS simple, count(*) OVER (PARTITION BY string_split(q, '.')[3]) AS n FROM (SELECT DISTINCT 'lib.' || regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') || '.f' || (p_partkey % 97) AS q FROM part)),
 c AS (SELECT o_orderkey AS call_id, 'lib.Brand' || (o_custkey % 30) AS module, 'f' || (o_orderkey % 120) AS callee FROM orders),
 d AS (SELECT DISTINCT module, callee FROM c),
 m AS (SELECT module, callee, q, n, q = module || '.' || callee AS own, len(list_filter(range(1, 1 + least(len(q), len(module))), lambda k: q[1:k] = module[1:k])) AS near FROM d JOIN s ON simple = callee WHERE n <= 256),
 r AS (SELECT *, row_number() OVER (PARTITION BY module, callee ORDER BY own DESC, near DESC, q) AS k FROM m),
 x AS (SELECT module, callee, q AS qualified_name, CASE WHEN own THEN 'same_module' WHEN n = 1 THEN 'unique_name' ELSE 'suffix_match' END AS strategy, CASE WHEN own THEN 0.9::DOUBLE WHEN n = 1 THEN 0.75::DOUBLE ELSE 0.55::DOUBLE * least(1.0::DOUBLE, 3.0::DOUBLE / n) END AS confidence FROM r WHERE k = 1)
 SELECT call_id, qualified_name, strategy, confidence, CASE WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.45 THEN 'medium' WHEN confidence >= 0.25 THEN 'speculative' ELSE '' END AS band FROM c JOIN x USING (module, callee)""",
    "rj_division": """WITH h AS (SELECT DISTINCT l_suppkey AS class, l_returnflag || l_linestatus || l_linenumber AS m FROM lineitem),
 n AS (SELECT 'all7' AS interface, a || k AS m FROM (VALUES ('AF'), ('NO'), ('RF')) t(a), range(1, 8) r(k) UNION ALL VALUES ('some', 'AF1'), ('some', 'NO2'))
 SELECT class, interface FROM (SELECT DISTINCT class FROM h) c CROSS JOIN (SELECT DISTINCT interface FROM n) i WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.interface = i.interface AND NOT EXISTS (SELECT 1 FROM h WHERE h.class = c.class AND h.m = n.m))""",
    "rj_route_match": """WITH c AS (SELECT page_id, regexp_extract(regexp_replace(url, '#.*$', ''), '^[^/]*//[^/]*(/[^?]*)', 1) AS p FROM pages)
 SELECT page_id AS call_id, 'en' AS route, 'template' AS kind FROM c WHERE regexp_full_match(p, '/en/[^/]+') UNION ALL SELECT page_id, 'any', 'template' FROM c WHERE regexp_full_match(p, '/[^/]+/[^/]+')""",
    "rj_test_files": "SELECT 'src/tests/test_m' || p_partkey || '.py' AS test, 'src/m' || p_partkey || '.py' AS tested FROM part",
    "rj_band": "SELECT CASE WHEN l_discount * 10 >= 0.7 THEN 'high' WHEN l_discount * 10 >= 0.45 THEN 'medium' WHEN l_discount * 10 >= 0.25 THEN 'speculative' ELSE '' END AS band, count(*) AS n FROM lineitem GROUP BY 1",
}
