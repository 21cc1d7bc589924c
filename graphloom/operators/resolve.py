"""Resolution joins: how call sites, routes, configuration and files become edges.

Candidates of all strategies are found by equi-joins, tagged with a priority, and the best one of each call site is taken
by one aggregate; nothing is looked up row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import canonical_route, config_key, confidence_band, identifier_tokens
from graphloom.operators.search import is_test_name, is_test_path
from graphloom.plans.model import property_of

#: Confidence by strategy.
CONFIDENCE = {"import_map": 0.95, "same_module": 0.90, "import_map_suffix": 0.85, "qualified_suffix": 0.90, "unique_name": 0.75, "suffix_match": 0.55}
MOST_CANDIDATES = 256
#: Words of decorators that say nothing.
STOP_WORDS = ("and", "app", "class", "for", "from", "function", "get", "if", "method", "new", "not", "or", "param", "private", "public", "return", "router", "set", "the", "type", "value", "with")


def penalty(n: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(3.0) / n)


def reachable(module: Column, imports: Column) -> Column:
    """An imported module contains the candidate's module, or is contained in it; a file without imports reaches everything."""
    return (F.coalesce(F.size(imports), F.lit(0)) <= 0) | F.exists(F.coalesce(imports, F.array().cast("array<string>")), lambda m: module.contains(m) | m.contains(module))


def prefix_length(a: Column, b: Column) -> Column:
    """Characters that two names share from their start."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(a), F.length(b)))), F.lit(0), lambda n, k: F.when((n == k - 1) & (F.substring(a, k, F.lit(1)) == F.substring(b, k, F.lit(1))) & (F.length(a) > 0) & (F.length(b) > 0), k).otherwise(n))


def resolve(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """call_id, qualified_name, strategy, confidence, band for each call that resolves.

    calls: call_id, module, callee, imports (modules of the file). symbols: qualified_name. imports: module, alias, target.
    The chain is: imported name, name below an import, same module, unique qualified suffix, unique name, best suffix; names
    with more than 256 candidates stay unresolved.
    """
    sym = symbols.select("qualified_name", F.element_at(F.split("qualified_name", "\\."), -1).alias("simple"), F.regexp_replace("qualified_name", "\\.[^.]*$", "").alias("home"))
    c = calls.select("call_id", "module", F.regexp_replace("callee", "::", ".").alias("callee"), "imports").withColumn("simple", F.element_at(F.split("callee", "\\."), -1)).withColumn("head", F.element_at(F.split("callee", "\\."), 1))
    out = lambda df, strategy, confidence, rank: df.select("call_id", "qualified_name", F.lit(strategy).alias("strategy"), confidence.alias("confidence"), F.lit(rank).alias("rank"))
    im = c.join(imports, (c["module"] == imports["module"]) & (c["head"] == imports["alias"])).select(c["call_id"], c["callee"], c["head"], "target")
    tail = F.substring(F.col("callee"), F.length("head") + 1, F.lit(2**31 - 1))
    direct = im.withColumn("wanted", F.concat("target", tail)).join(sym.select("qualified_name"), F.col("wanted") == F.col("qualified_name"))
    below = im.withColumn("simple", F.element_at(F.split("callee", "\\."), -1)).join(sym, "simple").filter(F.col("qualified_name").startswith(F.concat("target", F.lit("."))))
    below = below.groupBy("call_id").agg(F.min("qualified_name").alias("qualified_name"))
    same = c.withColumn("wanted", F.concat_ws(".", "module", "callee")).join(sym.select("qualified_name"), F.col("wanted") == F.col("qualified_name"))
    # Names with too many candidates are dropped before the join, so that none of its keys is hot.
    few = sym.groupBy("simple").agg(F.count("*").alias("n")).filter(F.col("n") <= MOST_CANDIDATES)
    named = c.join(few, "simple").join(sym, "simple").withColumn("near", reachable(F.col("home"), F.col("imports")))
    # A qualified name tells candidates apart; a single candidate needs none.
    dotted = named.filter((F.col("n") > 1) & F.col("callee").contains(".") & ((F.col("qualified_name") == F.col("callee")) | F.col("qualified_name").endswith(F.concat(F.lit("."), F.col("callee"))))).groupBy("call_id").agg(F.count("*").alias("k"), F.min("qualified_name").alias("qualified_name")).filter("k = 1")
    unique = named.filter("n = 1")
    half = F.when(F.col("near"), 1.0).otherwise(0.5)
    score = F.when(is_test_path(F.regexp_replace("home", "\\.", "/")), 0).otherwise(1000) + prefix_length(F.col("qualified_name"), F.col("module"))
    any_near = F.max("near").over(Window.partitionBy("call_id"))
    best = named.filter("n > 1").withColumn("any_near", any_near).filter("near or not any_near").withColumn("score", score)
    best = best.groupBy("call_id").agg(F.min_by(F.struct("qualified_name", "n", "any_near"), F.struct(-F.col("score"), F.col("qualified_name"))).alias("b")).select("call_id", "b.*")
    lit = {k: F.lit(v) for k, v in CONFIDENCE.items()}
    parts = [out(direct, "import_map", lit["import_map"], 1), out(below, "import_map_suffix", lit["import_map_suffix"], 2), out(same, "same_module", lit["same_module"], 3), out(dotted, "qualified_suffix", lit["qualified_suffix"], 4), out(unique, "unique_name", lit["unique_name"] * half, 5), out(best, "suffix_match", lit["suffix_match"] * penalty(F.col("n")) * F.when(F.col("any_near"), 1.0).otherwise(0.5), 6)]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    first = every.groupBy("call_id").agg(F.min_by(F.struct("qualified_name", "strategy", "confidence"), F.struct("rank", "qualified_name")).alias("r")).select("call_id", "r.*")
    return first.withColumn("band", confidence_band(F.col("confidence")))


def without_weak(resolved: DataFrame) -> DataFrame:
    """Drops weak strategies where a language's calls don't bear them: language, is_method, strategy."""
    perl = (F.col("language") == "Perl") & ~F.col("strategy").isin("same_module", "import_map", "import_map_suffix")
    script = F.col("language").isin("TypeScript", "JavaScript") & F.col("is_method") & F.col("strategy").isin("suffix_match", "unique_name", "field_type_hint", "fuzzy")
    return resolved.filter(~(perl | script))


#: What a callee's name says about the kind of call.
SERVICE_PATTERNS = [("HTTP_CALLS", r"(?i)(^|\.)(requests|axios|httpx|fetch|http\.client|resttemplate|webclient)(\.|$)"), ("ASYNC_CALLS", r"(?i)(^|\.)(kafka|sqs|sns|pubsub|rabbit|amqp|celery|publish|send_task|enqueue)(\.|$)"), ("GRPC_CALLS", r"(?i)(grpc|Stub\.)"), ("GRAPHQL_CALLS", r"(?i)(gql|graphql|apollo)"), ("TRPC_CALLS", r"(?i)\btrpc\b"), ("CONFIG_READS", r"(?i)(getenv|environ|viper|configparser|process\.env)")]


def service_of_call(callee: Column) -> Column:
    out = F.lit("CALLS")
    for kind, pattern in reversed(SERVICE_PATTERNS):
        out = F.when(callee.rlike(pattern), kind).otherwise(out)
    return out


def inheritance(bases: DataFrame, nodes: DataFrame) -> DataFrame:
    """source_id, target_id, type: IMPLEMENTS where the base (source_id, base) is an interface, INHERITS else."""
    n = nodes.filter(F.col("label").isin("Class", "Interface", "Type", "Enum")).select(F.col("id").alias("target_id"), F.col("name").alias("base"), "label")
    return bases.join(n, "base").select("source_id", "target_id", F.when(F.col("label") == "Interface", "IMPLEMENTS").otherwise("INHERITS").alias("type"))


def implicit_implements(methods: DataFrame, interfaces: DataFrame) -> DataFrame:
    """class, interface of all classes that have every method of an interface: methods (class, method), interfaces (interface, method).

    Relational division by counting: matches are grouped, no set is collected.
    """
    need = interfaces.distinct()
    size = need.groupBy("interface").agg(F.count("*").alias("n"))
    have = methods.distinct().join(need, "method").groupBy("class", "interface").agg(F.count("*").alias("k"))
    return have.join(size, "interface").filter("k = n").select("class", "interface")


def overrides(methods: DataFrame, parents: DataFrame) -> DataFrame:
    """class, parent, method: methods of the same name in a class and its parent (class, parent)."""
    return parents.join(methods, "class").join(methods.select(F.col("class").alias("parent"), "method"), ["parent", "method"]).select("class", "parent", "method").distinct()


def test_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """source_id, target_id of calls from a test, by path or flag and by name, to what is no test."""
    flagged = F.coalesce(property_of(F.col("props"), nodes.schema["props"].dataType, "is_test").cast("string"), F.lit("false")) == "true" if "props" in nodes.columns else F.lit(False)
    n = nodes.select("id", "name", (flagged | is_test_path(F.col("file_path"))).alias("in_test"))
    calls = edges.filter("type = 'CALLS'").select("source_id", "target_id")
    j = calls.join(n.select(F.col("id").alias("source_id"), F.col("name").alias("s"), F.col("in_test").alias("st")), "source_id").join(n.select(F.col("id").alias("target_id"), F.col("in_test").alias("tt")), "target_id")
    return j.filter(F.col("st") & ~F.col("tt") & is_test_name(F.col("s"))).select("source_id", "target_id").distinct()


def test_files(paths: DataFrame) -> DataFrame:
    """test, tested: paths (path) joined by naming convention, in any directory's own place."""
    base = F.element_at(F.split("path", "/"), -1)
    folder = F.regexp_replace(F.regexp_replace("path", "[^/]*$", ""), "(^|/)(tests?|__tests__|spec)/", "$1")
    stripped = F.regexp_replace(F.regexp_replace(base, r"^test_|(_test|\.test|\.spec|_spec)(?=\.[^.]+$)", ""), r"(Tests?|Spec)(?=\.[^.]+$)", "")
    p = paths.select("path", base.alias("base"), folder.alias("folder"), stripped.alias("stripped"), is_test_path(F.col("path")).alias("t"))
    return p.filter("t").select(F.col("path").alias("test"), F.col("stripped").alias("base"), "folder").join(p.filter(~F.col("t")).select(F.col("path").alias("tested"), "base", "folder"), ["base", "folder"]).select("test", "tested")


def trackable(path: Column) -> Column:
    """Neither in a directory that is never source, nor a lock file, nor of a kind that nobody edits."""
    return ~path.rlike(r"^(\.git|node_modules|vendor|__pycache__|\.cache)/|(^|/)(package-lock\.json|pnpm-lock\.yaml)$|\.(lock|sum|min\.js|min\.css|map|wasm|png|jpg|gif|ico|svg)$")


def change_coupling(commits: DataFrame, least: int = 3, least_score: float = 0.3, most_files: int = 20) -> DataFrame:
    """file_a, file_b, co_changes, coupling_score, last_co_change of commits (commit, ts, file).

    Commits of more than most_files files are left out before files are paired, so pairs are bounded by rows times that number.
    """
    rows = commits.select("commit", "ts", "file").distinct()
    small = rows.groupBy("commit").agg(F.count("*").alias("n")).filter(F.col("n").between(2, most_files)).select("commit")
    kept = rows.join(small, "commit", "left_semi")
    totals = rows.join(rows.groupBy("commit").agg(F.count("*").alias("n")).filter(F.col("n") <= most_files), "commit", "left_semi").groupBy("file").agg(F.count("*").alias("total"))
    a, b = kept.select("commit", "ts", F.col("file").alias("file_a")), kept.select("commit", F.col("file").alias("file_b"))
    pairs = a.join(b, "commit").filter("file_a < file_b").groupBy("file_a", "file_b").agg(F.count("*").alias("co_changes"), F.max("ts").alias("last_co_change")).filter(F.col("co_changes") >= least)
    scored = pairs.join(totals.select(F.col("file").alias("file_a"), F.col("total").alias("ta")), "file_a").join(totals.select(F.col("file").alias("file_b"), F.col("total").alias("tb")), "file_b")
    score = F.col("co_changes") / F.least("ta", "tb")
    return scored.select("file_a", "file_b", "co_changes", score.alias("coupling_score"), "last_co_change").filter(F.col("coupling_score") >= least_score)


def config_links(keys: DataFrame, symbols: DataFrame) -> DataFrame:
    """key, name, confidence: configuration keys of two words or more that are a symbol's name (0.85) or part of it (0.75).

    Part of is found by shared runs of words: each name is cut into its runs of as many words as a key has, so it is an equi-join.
    """
    k = keys.select("key", config_key(F.col("key")).alias("n")).withColumn("w", F.size(F.split("n", "_"))).filter("w > 1")
    s = symbols.select("name", config_key(F.col("name")).alias("n"))
    words = F.split("n", "_")
    runs = s.select("name", F.col("n").alias("whole"), F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(i, F.size(words)), lambda j: F.array_join(F.slice(words, i, j - i + 1), "_"))))).alias("n")).distinct()
    return k.join(runs, "n").groupBy("key", "name").agg(F.max(F.when(F.col("n") == F.col("whole"), 0.85).otherwise(0.75)).alias("confidence"))


def dependency_links(dependencies: DataFrame, imports: DataFrame) -> DataFrame:
    """name, module, confidence: a dependency that is the imported name (0.95), or a part of its path (0.80)."""
    parts = imports.select("module", F.explode(F.array_union(F.array("module"), F.split("module", "[./]"))).alias("name"))
    return dependencies.join(parts, "name").groupBy("name", "module").agg(F.max(F.when((F.col("name") == F.col("module")) | (F.element_at(F.split("module", "[./]"), 1) == F.col("name")), 0.95).otherwise(0.80)).alias("confidence"))


def file_references(references: DataFrame, paths: DataFrame) -> DataFrame:
    """text, path, confidence: a text that is a file's whole path (0.90) or its name (0.70)."""
    full = references.join(paths, F.col("text") == F.col("path")).select("text", "path", F.lit(0.90).alias("confidence"))
    name = references.join(paths.withColumn("base", F.element_at(F.split("path", "/"), -1)), F.col("text") == F.col("base")).filter("text <> path").select("text", "path", F.lit(0.70).alias("confidence"))
    return full.union(name)


# Routes
def route_nodes(handlers: DataFrame) -> DataFrame:
    """qualified_name, method, path: one node for each method and canonical path of handlers (method, path)."""
    m, p = F.upper(F.coalesce("method", F.lit("ANY"))), canonical_route(F.col("path"))
    return handlers.select(F.concat(F.lit("__route__"), m, F.lit("__"), p).alias("qualified_name"), m.alias("method"), p.alias("path")).distinct()


def route_matches(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """call_id, route, kind of calls (call_id, method, path) and routes (route, method, path): exact canonical paths first, then templates of as many segments.

    A {} takes one segment that isn't empty. Templates meet calls by method, number of segments and first fixed segment, which bounds the pairs.
    """
    c = calls.select("call_id", F.upper("method").alias("method"), canonical_route(F.col("path")).alias("p"))
    r = routes.select("route", F.upper("method").alias("method"), canonical_route(F.col("path")).alias("p"))
    exact = c.join(r, ["method", "p"]).select("call_id", "route", F.lit("exact").alias("kind"))
    seg = lambda df: df.withColumn("s", F.split("p", "/")).withColumn("k", F.size("s"))
    rest = seg(c.join(exact, "call_id", "left_anti"))
    places = F.transform(F.col("s"), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    fixed = F.filter(places, lambda x: ~x["x"].contains("{}") & (x["x"] != ""))
    t = seg(r).filter(F.col("p").contains("{}")).withColumn("anchor", F.get(fixed, F.lit(0)))
    ways = rest.withColumn("anchor", F.explode(F.filter(places, lambda x: x["x"] != "")))
    fits = lambda a, b: F.forall(F.zip_with(a, b, lambda x, y: F.when(y == "{}", x != "").otherwise(x == y)), lambda x: x)
    anchored = ways.join(t.select("route", "method", F.col("s").alias("rs"), "k", "anchor").filter("anchor is not null"), ["method", "k", "anchor"]).filter(fits(F.col("s"), F.col("rs")))
    loose = rest.join(t.filter("anchor is null").select("route", "method", F.col("s").alias("rs"), "k"), ["method", "k"]).filter(fits(F.col("s"), F.col("rs")))
    template = anchored.select("call_id", "route").union(loose.select("call_id", "route")).distinct().withColumn("kind", F.lit("template"))
    return exact.union(template)


def topic_matches(emits: DataFrame, listens: DataFrame) -> DataFrame:
    """source, target, key between projects that emit (node, project, key) and listen on one key, both ways round."""
    a, b = emits.select(F.col("node").alias("source"), F.col("project").alias("p1"), "key"), listens.select(F.col("node").alias("target"), F.col("project").alias("p2"), "key")
    pairs = a.join(b, "key").filter("p1 <> p2").select("source", "target", "key").distinct()
    return pairs.union(pairs.select("target", "source", "key"))


def data_flows(calls: DataFrame, handles: DataFrame, direct: DataFrame) -> DataFrame:
    """caller, handler through a route (caller, route; handler, route), unless they call one another directly."""
    return calls.join(handles, "route").select("caller", "handler").distinct().join(direct, ["caller", "handler"], "left_anti")


def member_calls(calls: DataFrame, specifiers: DataFrame, symbols: DataFrame) -> DataFrame:
    """call_id, member, target of calls between the members of a workspace.

    calls: call_id, file, name. specifiers: file, text, what the file names and doesn't have itself. symbols: member, path, name, id. A
    specifier must be the end of the target's path at a segment, and the name must be one function of that member; two members that answer make none.
    """
    ends = symbols.withColumn("segments", F.split("path", "/")).withColumn("end", F.explode(F.transform(F.sequence(F.lit(1), F.size("segments")), lambda k: F.array_join(F.slice("segments", k, F.size("segments")), "/"))))
    clean = specifiers.withColumn("end", F.regexp_replace("text", r"^(\.{0,2}/)+", ""))
    hits = calls.join(clean.select("file", "end"), "file").join(ends.select("member", "name", F.col("id").alias("target"), "end"), ["end", "name"]).select("call_id", "member", "target").distinct()
    one = hits.groupBy("call_id", "member").agg(F.count("*").alias("n"), F.min("target").alias("target"))
    return one.groupBy("call_id").agg(F.count("*").alias("members"), F.max("n").alias("n"), F.min("member").alias("member"), F.min("target").alias("target")).filter("members = 1 and n = 1").select("call_id", "member", "target")


def decorator_tags(decorated: DataFrame) -> DataFrame:
    """id, tags: words of decorators (id, decorator) that two nodes or more have, sorted."""
    words = decorated.select("id", F.explode(identifier_tokens(F.col("decorator"))).alias("w")).filter((F.length("w") >= 2) & ~F.col("w").isin(*STOP_WORDS)).distinct()
    common = words.groupBy("w").agg(F.count("*").alias("n")).filter("n > 1").select("w")
    return words.join(common, "w", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("w")).alias("tags"))


def anchors(records: DataFrame, symbols: DataFrame) -> DataFrame:
    """id, state, moved_to of records (id, anchor, hash): resolved, resolved_edited, ambiguous, orphaned, or unknown without an anchor. symbols: qualified_name, hash.

    Equal content elsewhere is evidence of a move, and changes no state.
    """
    at = symbols.groupBy("qualified_name").agg(F.count("*").alias("n"), F.min("hash").alias("now"))
    elsewhere = symbols.groupBy(F.col("hash").alias("was")).agg(F.min("qualified_name").alias("moved_to"))
    j = records.join(at, F.col("anchor") == F.col("qualified_name"), "left").join(elsewhere, F.col("hash") == F.col("was"), "left")
    state = F.when(F.col("anchor").isNull(), "unknown").when(F.col("n") > 1, "ambiguous").when(F.col("n").isNull(), "orphaned").when(F.col("hash").isNull() | (F.col("hash") == F.col("now")), "resolved").otherwise("resolved_edited")
    return j.select("id", state.alias("state"), F.when(state == "orphaned", F.col("moved_to")).alias("moved_to"))
