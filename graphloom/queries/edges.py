"""Edges made from facts: definitions, imports, exceptions, inheritance, configuration, routes, topics, workspaces, anchors."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions.text import url_path
from graphloom.operators import facts, resolve

c, lit = F.col, F.lit


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _over(table, use):
    return lambda spark, sf_dir: use(_read(spark, sf_dir, table))


def _text(x):
    return x.cast("string")


def _brand():
    return F.regexp_replace("p_brand", "#", "")


# Names are unique: every fourth part is an error.
def _name(key):
    return F.concat(F.when(key % 4 == 0, "LateError").otherwise("odd"), _text(key))


def _things(part):
    return part.select(c("p_partkey").alias("id"), F.concat_ws(".", lit("lib"), _brand(), _name(c("p_partkey"))).alias("qualified_name"), F.when(c("p_partkey") % 4 == 0, "Class").otherwise("Function").alias("label"))


def _no_imports(df):
    return df.sparkSession.createDataFrame([], "module string, alias string, target string")


def _fact(part, *more):
    return part.select(c("p_partkey").alias("source_id"), F.concat_ws(".", lit("lib"), _brand()).alias("module"), F.array().cast("array<string>").alias("imports"), *more)


def _throws(part):
    return facts.throws(_fact(part, _name(c("p_partkey") + 1).alias("name")), _things(part), _no_imports(part))


def _depends(part):
    signature = F.concat(lit("(a = Depends("), _name(c("p_partkey") + 1), lit("), b: int, c = Depends("), _name(c("p_partkey") + 2), lit("))"))
    return facts.depends(_fact(part, signature.alias("signature")), _things(part), _no_imports(part))


def _defined(part):
    """A file for each brand, a class for every fifth part, and methods of the class before them."""
    path = F.concat(lit("src/"), _brand(), lit(".py"))
    own = c("p_partkey") - c("p_partkey") % 5
    files = part.select((-1 - F.regexp_extract("p_brand", "[0-9]+", 0).cast("long")).alias("id"), lit("shop").alias("project"), lit("File").alias("label"), path.alias("file_path"), path.alias("qualified_name"), lit(None).cast("string").alias("parent_class")).distinct()
    inside = part.select(c("p_partkey").alias("id"), lit("shop").alias("project"), F.when(c("p_partkey") == own, "Class").otherwise("Method").alias("label"), path.alias("file_path"), F.concat(lit("shop.c"), _text(c("p_partkey"))).alias("qualified_name"), F.when(c("p_partkey") != own, F.concat(lit("shop.c"), _text(own))).alias("parent_class"))
    return files.union(inside)


def _imports(part):
    path = F.concat(lit("src/"), _brand(), lit(".py"))
    named = part.select(lit("shop").alias("project"), path.alias("file_path"), F.concat(lit("shop.c"), _text(c("p_partkey") + 1)).alias("target"), F.when(c("p_size") % 3 > 0, F.concat(lit("n"), _text(c("p_size") % 3))).alias("local_name"))
    return facts.import_edges(named.union(named), _defined(part))


def _inherits(part):
    nodes = part.select(c("p_partkey").alias("id"), F.concat(lit("c"), _text(c("p_partkey"))).alias("name"), F.when(c("p_partkey") % 3 == 0, "Interface").when(c("p_partkey") % 3 == 1, "Class").otherwise("Function").alias("label"))
    return resolve.inheritance(part.select(c("p_partkey").alias("source_id"), F.concat(lit("c"), _text(c("p_partkey") * 7 + 1)).alias("base")), nodes)


def _overrides(line):
    methods = line.select(c("l_suppkey").alias("class"), F.concat("l_returnflag", "l_linestatus", _text(c("l_linenumber")), _text(c("l_quantity").cast("int"))).alias("method"))
    return resolve.overrides(methods.distinct(), line.select(c("l_suppkey").alias("class"), (c("l_suppkey") + 1).alias("parent")).distinct())


CALLEES = [("requests.get", "HTTP_CALLS"), ("bus.kafka.send", "ASYNC_CALLS"), ("UserStub.Get", "GRPC_CALLS"), ("apollo.query", "GRAPHQL_CALLS"), ("client.trpc.user", "TRPC_CALLS"), ("os.getenv", "CONFIG_READS"), ("plain.call", "CALLS")]


def _service(part):
    callee = F.element_at(F.array(*(lit(x) for x, _ in CALLEES)), (c("p_size") % len(CALLEES) + 1).cast("int"))
    return part.select("p_partkey", callee.alias("callee")).select("p_partkey", resolve.service_of_call(c("callee")).alias("kind"))


LANGUAGES, STRATEGIES = ("Perl", "TypeScript", "Go"), ("same_module", "import_map", "import_map_suffix", "suffix_match", "unique_name")


def _weak(part):
    pick = lambda xs, at: F.element_at(F.array(*map(lit, xs)), (at % len(xs) + 1).cast("int"))
    rows = part.select("p_partkey", pick(LANGUAGES, c("p_partkey")).alias("language"), pick(STRATEGIES, c("p_size")).alias("strategy"), (F.length("p_name") % 2 == 0).alias("is_method"))
    return resolve.without_weak(rows)


def _config_links(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    keys = part.select(F.concat(lit("cfg."), c("p_type")).alias("key")).union(part.select(F.regexp_replace("p_name", " ", "-"))).distinct()
    symbols = part.select(F.concat_ws("_", "p_name", "p_type").alias("name")).union(part.select("p_name")).distinct()
    return resolve.config_links(keys, symbols)


def _dependencies(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    named = part.select(F.element_at(F.split("p_name", " "), 1).alias("name")).distinct()
    modules = part.select(F.regexp_replace("p_name", " ", ".").alias("module")).union(part.select(F.concat(lit("x/"), F.regexp_replace("p_name", " ", "/")))).distinct()
    return resolve.dependency_links(named, modules)


def _file_references(part):
    path = F.concat(lit("src/"), _brand(), lit("/f"), _text(c("p_partkey")), lit(".py"))
    base = F.concat(lit("f"), _text(c("p_partkey")), lit(".py"))
    return resolve.file_references(part.select(F.when(c("p_partkey") % 2 == 0, path).otherwise(base).alias("text")), part.select(path.alias("path")))


def _route_nodes(pages):
    handlers = pages.select(F.when(c("page_id") % 3 == 0, "get").when(c("page_id") % 3 == 1, "post").alias("method"), F.regexp_replace(url_path(F.regexp_replace("url", "#.*$", "")), "[0-9]+", "<id>").alias("path"))
    return resolve.route_nodes(handlers)


def _data_flows(spark, sf_dir):
    calls = _read(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("caller"), c("l_suppkey").alias("route"))
    handles = _read(spark, sf_dir, "supplier").select(c("s_suppkey").alias("route"), c("s_nationkey").alias("handler"))
    direct = _read(spark, sf_dir, "orders").select(c("o_orderkey").alias("caller"), (c("o_orderkey") % 25).cast("int").alias("handler"))
    return resolve.data_flows(calls, handles, direct)


def _topics(spark, sf_dir):
    emits = _read(spark, sf_dir, "supplier").select((-1 - c("s_suppkey")).alias("node"), c("s_nationkey").alias("project"), c("s_suppkey").alias("key"))
    listens = _read(spark, sf_dir, "customer").select(c("c_custkey").alias("node"), c("c_nationkey").alias("project"), c("c_custkey").alias("key"))
    return resolve.topic_matches(emits, listens)


def _member_calls(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    line = _read(spark, sf_dir, "lineitem").join(part.select(c("p_partkey").alias("l_partkey"), _brand().alias("brand")), "l_partkey")
    file, name = F.concat(lit("o"), _text(c("l_orderkey"))), lambda key: F.concat(lit("f"), _text(key % 2))
    calls = line.select((c("l_orderkey") * 10 + c("l_linenumber")).alias("call_id"), file.alias("file"), name(c("l_partkey")).alias("name")).distinct()
    specifiers = line.select(file.alias("file"), F.concat(lit("./"), c("brand"), lit("/m"), _text(c("l_partkey")), lit(".py")).alias("text"))
    symbols = part.select(_brand().alias("member"), F.concat(lit("lib/"), _brand(), lit("/m"), _text(c("p_partkey")), lit(".py")).alias("path"), name(c("p_partkey")).alias("name"), c("p_partkey").alias("id"))
    return resolve.member_calls(calls, specifiers, symbols)


def _tags(part):
    decorated = part.select(c("p_partkey").alias("id"), F.concat_ws(".", lit("app.get"), F.regexp_replace("p_name", " ", "_"), "p_type", F.concat(lit("only"), _text(c("p_partkey")))).alias("decorator"))
    return resolve.decorator_tags(decorated).select("id", F.array_join("tags", ",").alias("tags"))


def _anchors(spark, sf_dir):
    symbols = _read(spark, sf_dir, "part").select(F.concat(lit("s"), _text(c("p_partkey") - F.when(c("p_partkey") % 10 == 9, 1).otherwise(0))).alias("qualified_name"), F.concat(lit("h"), _text(c("p_partkey"))).alias("hash"))
    key, kind = c("o_orderkey"), c("o_orderkey") % 5
    records = _read(spark, sf_dir, "orders").select(key.alias("id"), F.when(kind > 0, F.concat(lit("s"), _text(key))).alias("anchor"), F.when(kind == 1, F.concat(lit("h"), _text(key))).when(kind == 2, "edited").when(kind == 3, F.concat(lit("h"), _text(key % 100))).alias("hash"))
    return resolve.anchors(records, symbols)


def _decorator_routes(pages):
    path = F.regexp_replace(url_path(F.regexp_replace("url", "#.*$", "")), "[0-9]+", "{id}")
    call = F.when(c("page_id") % 3 == 0, F.concat(lit('@app.get("'), path, lit('")'))).when(c("page_id") % 3 == 1, F.concat(lit("@router.route('"), path, lit("', methods=['PUT'])"))).otherwise("@cached(60)")
    decorated = pages.select(F.concat(lit("h"), _text(c("page_id"))).alias("handler"), F.when(c("page_id") % 2 == 0, "a").otherwise("b").alias("module"), call.alias("decorator"))
    return facts.decorator_routes(decorated, pages.sparkSession.createDataFrame([("a", "/api/")], "module string, prefix string"))


def _validated(spark, sf_dir):
    spans = _read(spark, sf_dir, "events").select(F.concat(lit("/"), c("event_type"), lit("/{id}")).alias("path"), c("user_id").cast("long").alias("duration_ns"))
    calls = _read(spark, sf_dir, "pages").select(c("page_id").alias("source_id"), (c("page_id") + 1).alias("target_id"), F.when(c("page_id") % 2 == 0, "/click/:id").when(c("page_id") % 3 == 0, "/view/<id>").otherwise("/none").alias("url_path"))
    return facts.validated_calls(calls, spans).fillna(-1, ["p99_ns"])


def _imported(spark, sf_dir):
    """Calls by an imported alias (import_map), and below an imported package (import_map_suffix)."""
    part = _read(spark, sf_dir, "part")
    symbols = part.select(F.concat_ws(".", lit("lib"), _brand(), F.concat(lit("m"), _text(c("p_partkey") % 7)), F.concat(lit("f"), _text(c("p_partkey")))).alias("qualified_name"))
    callee = F.concat(lit("b."), F.when(c("p_partkey") % 2 == 0, F.concat(lit("m"), _text(c("p_partkey") % 7), lit("."))).otherwise(""), lit("f"), _text(c("p_partkey")))
    calls = part.select(c("p_partkey").alias("call_id"), _brand().alias("module"), callee.alias("callee"), F.array().cast("array<string>").alias("imports"))
    imports = part.select(_brand().alias("module"), lit("b").alias("alias"), F.concat(lit("lib."), _brand()).alias("target")).distinct()
    return resolve.resolve(calls, symbols, imports)


QUERIES = {
    "rj_throws": _over("part", _throws),
    "rj_depends": _over("part", _depends),
    "rj_defines": _over("part", lambda d: facts.defines(_defined(d))),
    "rj_imports": _over("part", _imports),
    "rj_inherits": _over("part", _inherits),
    "rj_overrides": _over("lineitem", _overrides),
    "rj_service": _over("part", _service),
    "rj_weak": _over("part", _weak),
    "rj_import_map": _imported,
    "rj_config_links": _config_links,
    "rj_dependencies": _dependencies,
    "rj_file_references": _over("part", _file_references),
    "rj_route_nodes": _over("pages", _route_nodes),
    "rj_data_flows": _data_flows,
    "rj_topics": _topics,
    "rj_member_calls": _member_calls,
    "rj_decorator_tags": _over("part", _tags),
    "rj_anchors": _anchors,
    "rj_decorator_routes": _over("pages", _decorator_routes),
    "rj_validated": _validated,
}
_thing = "CASE WHEN b.p_partkey % 4 = 0 THEN '{0}' ELSE '{1}' END"
_brand_sql = "replace(p_brand, '#', '')"
_kinds = " ".join(f"WHEN {k} THEN '{kind}'" for k, (_, kind) in enumerate(CALLEES))
_page_path = "regexp_replace(regexp_extract(regexp_replace(url, '#.*$', ''), '^[^/]*//[^/]*(/[^?]*)', 1), '[0-9]+', '{}', 'g')"
_config = "trim(regexp_replace(lower(regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', '_', 'g')), '[_ ]+', '_', 'g'), '_')"
_pick = lambda xs, at: f"([{', '.join(repr(x) for x in xs)}])[{at} % {len(xs)} + 1]"
ORACLES = {
    "rj_throws": f"SELECT a.p_partkey AS source_id, b.p_partkey AS target_id, {_thing.format('RAISES', 'THROWS')} AS type FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1",
    "rj_depends": "SELECT a.p_partkey AS source_id, b.p_partkey AS target_id, 'CALLS' AS type FROM part a JOIN part b ON b.p_partkey - a.p_partkey IN (1, 2)",
    "rj_defines": "SELECT -1 - regexp_extract(p_brand, '[0-9]+')::BIGINT AS source_id, p_partkey AS target_id, 'DEFINES' AS type FROM part UNION ALL SELECT a.p_partkey, b.p_partkey, 'DEFINES_METHOD' FROM part a JOIN part b ON a.p_partkey = b.p_partkey - b.p_partkey % 5 AND b.p_partkey % 5 > 0",
    "rj_imports": "SELECT DISTINCT -1 - regexp_extract(a.p_brand, '[0-9]+')::BIGINT AS source_id, b.p_partkey AS target_id, 'IMPORTS' AS type, CASE WHEN a.p_size % 3 > 0 THEN 'n' || (a.p_size % 3) ELSE '' END AS local_name FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1",
    "rj_inherits": "SELECT a.p_partkey AS source_id, b.p_partkey AS target_id, CASE WHEN b.p_partkey % 3 = 0 THEN 'IMPLEMENTS' ELSE 'INHERITS' END AS type FROM part a JOIN part b ON b.p_partkey = a.p_partkey * 7 + 1 AND b.p_partkey % 3 < 2",
    "rj_overrides": "WITH m AS (SELECT DISTINCT l_suppkey AS class, l_returnflag || l_linestatus || l_linenumber || l_quantity::INTEGER AS method FROM lineitem) SELECT a.class, b.class AS parent, method FROM m a JOIN m b USING (method) WHERE b.class = a.class + 1",
    "rj_service": f"SELECT p_partkey, CASE p_size % {len(CALLEES)} {_kinds} END AS kind FROM part",
    "rj_weak": f"SELECT * FROM (SELECT p_partkey, {_pick(LANGUAGES, 'p_partkey')} AS language, {_pick(STRATEGIES, 'p_size')} AS strategy, length(p_name) % 2 = 0 AS is_method FROM part) WHERE CASE language WHEN 'Perl' THEN strategy IN ('same_module', 'import_map', 'import_map_suffix') WHEN 'TypeScript' THEN NOT is_method OR strategy NOT IN ('suffix_match', 'unique_name') ELSE true END",
    "rj_import_map": f"SELECT p_partkey AS call_id, 'lib.' || {_brand_sql} || '.m' || (p_partkey % 7) || '.f' || p_partkey AS qualified_name, CASE WHEN p_partkey % 2 = 0 THEN 'import_map' ELSE 'import_map_suffix' END AS strategy, CASE WHEN p_partkey % 2 = 0 THEN 0.95::DOUBLE ELSE 0.85::DOUBLE END AS confidence, 'high' AS band FROM part",
    "rj_config_links": f"WITH k AS (SELECT key, {_config.format('key')} AS n FROM (SELECT 'cfg.' || p_type AS key FROM part UNION SELECT replace(p_name, ' ', '-') FROM part)), s AS (SELECT name, {_config.format('name')} AS n FROM (SELECT p_name || '_' || p_type AS name FROM part UNION SELECT p_name FROM part)) SELECT key, name, CASE WHEN k.n = s.n THEN 0.85::DOUBLE ELSE 0.75::DOUBLE END AS confidence FROM k JOIN s ON contains('_' || s.n || '_', '_' || k.n || '_') AND contains(k.n, '_')",
    "rj_dependencies": "WITH d AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS name FROM part), m AS (SELECT replace(p_name, ' ', '.') AS module FROM part UNION SELECT 'x/' || replace(p_name, ' ', '/') FROM part) SELECT name, module, CASE WHEN name = module OR regexp_split_to_array(module, '[./]')[1] = name THEN 0.95::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM d JOIN m ON name = module OR list_contains(regexp_split_to_array(module, '[./]'), name)",
    "rj_file_references": f"SELECT CASE WHEN p_partkey % 2 = 0 THEN path ELSE base END AS text, path, CASE WHEN p_partkey % 2 = 0 THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM (SELECT p_partkey, 'src/' || {_brand_sql} || '/f' || p_partkey || '.py' AS path, 'f' || p_partkey || '.py' AS base FROM part)",
    "rj_route_nodes": f"SELECT DISTINCT '__route__' || m || '__' || p AS qualified_name, m AS method, p AS path FROM (SELECT CASE page_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'ANY' END AS m, {_page_path} AS p FROM pages)",
    "rj_data_flows": "SELECT DISTINCT l_orderkey AS caller, s_nationkey AS handler FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 25 = s_nationkey)",
    "rj_topics": "WITH p AS (SELECT -1 - s_suppkey AS source, c_custkey AS target, s_suppkey AS key FROM supplier JOIN customer ON c_custkey = s_suppkey AND c_nationkey <> s_nationkey) SELECT * FROM p UNION ALL SELECT target, source, key FROM p",
    "rj_member_calls": f"WITH l AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS k, l_partkey AS p, {_brand_sql} AS brand FROM lineitem JOIN part ON p_partkey = l_partkey), h AS (SELECT a.o * 10 + a.k AS call_id, b.brand AS member, b.p AS target FROM l a JOIN l b ON a.o = b.o AND a.p % 2 = b.p % 2) SELECT call_id, min(member) AS member, min(target) AS target FROM h GROUP BY call_id HAVING count(DISTINCT member) = 1 AND count(DISTINCT target) = 1",
    "rj_decorator_tags": f"WITH w AS (SELECT DISTINCT p_partkey AS id, unnest(string_split_regex(lower(p_name || ' ' || p_type), '[./_\\- (),:]+')) AS w FROM part), x AS (SELECT * FROM w WHERE length(w) > 1 AND w NOT IN {resolve.STOP_WORDS} AND w IN (SELECT w FROM w GROUP BY w HAVING count(*) > 1)) SELECT id, string_agg(w, ',' ORDER BY w) AS tags FROM x GROUP BY id",
    "rj_anchors": "WITH s AS (SELECT 's' || (p_partkey - CASE WHEN p_partkey % 10 = 9 THEN 1 ELSE 0 END) AS q, 'h' || p_partkey AS hash FROM part), r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 > 0 THEN 's' || o_orderkey END AS anchor, CASE o_orderkey % 5 WHEN 1 THEN 'h' || o_orderkey WHEN 2 THEN 'edited' WHEN 3 THEN 'h' || (o_orderkey % 100) END AS hash FROM orders), n AS (SELECT q, count(*) AS n, min(hash) AS now FROM s GROUP BY q), m AS (SELECT hash AS was, min(q) AS to_ FROM s GROUP BY hash), j AS (SELECT id, to_, CASE WHEN anchor IS NULL THEN 'unknown' WHEN n > 1 THEN 'ambiguous' WHEN n IS NULL THEN 'orphaned' WHEN hash IS NULL OR hash = now THEN 'resolved' ELSE 'resolved_edited' END AS state FROM r LEFT JOIN n ON q = anchor LEFT JOIN m ON was = hash) SELECT id, state, CASE WHEN state = 'orphaned' THEN to_ END AS moved_to FROM j",
    "rj_decorator_routes": f"SELECT 'h' || page_id AS handler, CASE page_id % 3 WHEN 0 THEN 'GET' ELSE 'PUT' END AS method, CASE WHEN page_id % 2 = 0 THEN '/api' ELSE '' END || {_page_path} AS path FROM pages WHERE page_id % 3 < 2",
    "rj_validated": "WITH e AS (SELECT event_type AS t, count(*) AS seen, list_sort(list(user_id))[least(floor(count(*) * 0.99)::BIGINT, count(*) - 1) + 1]::BIGINT AS p99 FROM events GROUP BY 1), c AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'click' WHEN page_id % 3 = 0 THEN 'view' END AS t FROM pages) SELECT page_id AS source_id, page_id + 1 AS target_id, CASE c.t WHEN 'click' THEN '/click/:id' WHEN 'view' THEN '/view/<id>' ELSE '/none' END AS url_path, coalesce(seen, 0) AS seen, coalesce(p99, -1) AS p99_ns FROM c LEFT JOIN e ON e.t = c.t",
}
