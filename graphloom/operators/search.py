"""Lookups and structural, full-text and source search over a graph."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.patterns import matches_glob, regex_hints
from graphloom.functions.text import camel_split
from graphloom.plans.model import GraphView
from graphloom.storage import written


class AmbiguousError(LookupError):
    """Two or more nodes answer to an address that one should."""


# Scans and lookups
def nodes_by(graph: GraphView, project: str | None = None, **fields) -> DataFrame:
    """Nodes whose fields equal the values given (label, id, name, qualified_name, file_path)."""
    df = graph.scoped(project).nodes
    for name, value in fields.items():
        df = df.filter(F.col(name) == value)
    return df


def one_node(graph: GraphView, project: str | None = None, **fields):
    """The one node at an address, or None; AmbiguousError if there are more."""
    found = nodes_by(graph, project, **fields).orderBy("id").limit(2).collect()
    if len(found) > 1:
        raise AmbiguousError(f"more than one node has {fields}")
    return found[0] if found else None


def ids_of(graph: GraphView, names: DataFrame) -> DataFrame:
    """names (qualified_name) with id, 0 where no node has the name."""
    return names.join(graph.nodes.select("qualified_name", "id"), "qualified_name", "left").withColumn("id", F.coalesce("id", F.lit(0)))


def with_suffix(graph: GraphView, suffix: str) -> DataFrame:
    """Nodes whose qualified name is the suffix, or ends with it at a dot."""
    return graph.nodes.filter((F.col("qualified_name") == suffix) | F.col("qualified_name").endswith(f".{suffix}"))


def overlapping(graph: GraphView, path: str, low: int, high: int) -> DataFrame:
    return graph.nodes.filter((F.col("file_path") == path) & (F.col("start_line") <= high) & (F.col("end_line") >= low) & ~F.col("label").isin("Module", "Package"))


def edges_by(graph: GraphView, source: int | None = None, target: int | None = None, kind: str | None = None) -> DataFrame:
    df = graph.edges
    for name, value in (("source_id", source), ("target_id", target), ("type", kind)):
        df = df if value is None else df.filter(F.col(name) == value)
    return df


def edges_with_url(graph: GraphView, keyword: str) -> DataFrame:
    return graph.edges.filter(graph.edge_property("url_path").contains(keyword))


def files(graph: GraphView, project: str | None = None) -> DataFrame:
    return graph.scoped(project).nodes.select("file_path").filter("file_path is not null and file_path <> ''").distinct()


def in_directory(path: Column, directory: str | None) -> Column:
    """A path in a directory, or the directory itself; a slash at its end doesn't matter."""
    d = (directory or "").rstrip("/")
    return F.lit(True) if not d else (path == d) | path.startswith(f"{d}/")


def counts(graph: GraphView, project: str | None = None, directory: str | None = None) -> DataFrame:
    """kind ("node" or "edge"), name (label or type), n; an edge counts where its source is."""
    g = graph.scoped(project)
    nodes = g.nodes.filter(in_directory(F.col("file_path"), directory))
    edges = g.edges if not directory else g.edges.join(nodes.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return nodes.groupBy(F.lit("node").alias("kind"), F.col("label").alias("name")).agg(F.count("*").alias("n")).union(edges.groupBy(F.lit("edge").alias("kind"), F.col("type").alias("name")).agg(F.count("*").alias("n")))


def call_pairs(graph: GraphView, limit: int) -> tuple[DataFrame, bool]:
    """CALLS between functions and methods, at most limit of them by id, and whether there are more."""
    code = graph.nodes.filter(F.col("label").isin("Function", "Method")).select("id")
    calls = graph.edges.filter(F.col("type") == "CALLS").select("source_id", "target_id").distinct()
    pairs = calls.join(code.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(code.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return pairs.orderBy("source_id", "target_id").limit(limit), pairs.limit(limit + 1).count() > limit


# Degrees
def degrees(graph: GraphView, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """id, in_degree, out_degree of every node; kinds None counts all edges."""
    edges = graph.edges if kinds is None else graph.edges.filter(F.col("type").isin(*kinds))
    ends = edges.select(F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select(F.col("target_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    sums = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return graph.nodes.select("id").join(sums, "id", "left").select("id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def node_degree(graph: GraphView, node: int) -> DataFrame:
    """One row: in_degree and out_degree of a node over CALLS alone."""
    calls = graph.edges.filter((F.col("type") == "CALLS") & ((F.col("source_id") == node) | (F.col("target_id") == node)))
    return calls.agg(F.count(F.when(F.col("target_id") == node, 1)).alias("in_degree"), F.count(F.when(F.col("source_id") == node, 1)).alias("out_degree"))


def callers_and_callees(graph: GraphView, limit: int = 10) -> DataFrame:
    """id, callers, callees: names over the three kinds of call, at most limit each, by name."""
    calls = graph.edges.filter(F.col("type").isin("CALLS", "HTTP_CALLS", "ASYNC_CALLS"))
    names = graph.nodes.select("id", "name")
    sides = []
    for own, other, column in (("target_id", "source_id", "callers"), ("source_id", "target_id", "callees")):
        near = calls.select(F.col(own).alias("own"), F.col(other).alias("id")).distinct().join(names, "id")
        first = near.withColumn("k", F.row_number().over(Window.partitionBy("own").orderBy("name", "id"))).filter(F.col("k") <= limit)
        sides.append(first.groupBy(F.col("own").alias("id")).agg(F.array_sort(F.collect_list("name")).alias(column)))
    empty = F.array().cast("array<string>")
    return graph.nodes.select("id").join(sides[0], "id", "left").join(sides[1], "id", "left").select("id", F.coalesce("callers", empty).alias("callers"), F.coalesce("callees", empty).alias("callees"))


# Structural search
#: Kinds of edges that a search's degree counts.
DEGREE_KINDS = ("CALLS", "INHERITS", "IMPLEMENTS", "USAGE")


@dataclass(frozen=True)
class Search:
    """What to look for; empty texts and -1 are no filter."""

    project: str | None = None
    label: str = ""
    name_pattern: str = ""
    qn_pattern: str = ""
    file_pattern: str = ""
    case_sensitive: bool = False
    relationship: str = ""
    direction: str = "any"
    min_degree: int = -1
    max_degree: int = -1
    exclude_labels: tuple[str, ...] = ()
    exclude_entry_points: bool = False
    include_connected: bool = False
    sort_by: str = "relevance"
    limit: int = 10
    offset: int = 0


def _like_regex(column: Column, pattern: str, case_sensitive: bool) -> Column:
    cond = column.rlike(pattern if case_sensitive else f"(?i){pattern}")
    for hint in regex_hints(pattern):
        cond = (column.contains(hint) if case_sensitive else F.lower(column).contains(hint.lower())) & cond
    return cond


def matching(graph: GraphView, s: Search) -> DataFrame:
    """All nodes that a search finds, with in_degree and out_degree."""
    g = graph.scoped(s.project)
    df = g.nodes
    if s.label:
        df = df.filter(F.col("label") == s.label)
    if s.exclude_labels:
        df = df.filter(~F.col("label").isin(*s.exclude_labels))
    if s.name_pattern:
        df = df.filter(_like_regex(F.col("name"), s.name_pattern, s.case_sensitive))
    if s.qn_pattern:
        df = df.filter(_like_regex(F.col("qualified_name"), s.qn_pattern, s.case_sensitive))
    if s.file_pattern:
        df = df.filter(matches_glob(F.col("file_path"), s.file_pattern))
    if s.exclude_entry_points:
        df = df.filter(F.coalesce(g.node_property("is_entry_point").cast("string"), F.lit("false")) != "true")
    if s.relationship:
        e = g.edges.filter(F.col("type") == s.relationship)
        ends = {"outbound": [e.select(F.col("source_id").alias("id"))], "inbound": [e.select(F.col("target_id").alias("id"))]}
        sides = ends.get(s.direction, ends["outbound"] + ends["inbound"])
        df = df.join(sides[0] if len(sides) == 1 else sides[0].union(sides[1]), "id", "left_semi")
    df = df.join(degrees(g, DEGREE_KINDS), "id")
    total = F.col("in_degree") + F.col("out_degree")
    if s.min_degree >= 0:
        df = df.filter(total >= s.min_degree)
    if s.max_degree >= 0:
        df = df.filter(total <= s.max_degree)
    if s.include_connected:
        near = callers_and_callees(g)
        df = df.join(near.select("id", F.array_sort(F.array_union("callers", "callees")).alias("connected")), "id")
    return df


def search(graph: GraphView, s: Search) -> tuple[DataFrame, int]:
    """One page of a search, and the number of all rows, counted before paging. Relevance puts functions first, then classes, then by degree."""
    df = matching(graph, s)
    rank = F.when(F.col("label").isin("Function", "Method"), 0).when(F.col("label").isin("Class", "Interface", "Type", "Enum", "Route"), 1).otherwise(2)
    degree = (F.col("in_degree") + F.col("out_degree")).desc()
    keys = {"name": [F.col("name")], "degree": [degree]}.get(s.sort_by, [rank, degree, F.col("name")])
    return df.orderBy(*keys, "id").offset(s.offset).limit(s.limit), df.count()


# Full text
K1, B = 1.2, 0.75


def bm25(documents: DataFrame, id_column: str, text: Column, query: list[str]) -> DataFrame:
    """id, score of the rows that have a term of the query: Okapi BM25 with natural logarithms over lower-cased words of letters and digits.

    Only the query's terms are counted; the corpus gives its number of rows and words. Everything but one row of totals stays distributed.
    """
    terms = sorted({t.lower() for t in query})
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    base = documents.select(F.col(id_column).alias("id"), words.alias("w")).select("id", F.size("w").alias("len"), *((F.size("w") - F.size(F.array_remove("w", t))).alias(f"tf{k}") for k, t in enumerate(terms)))
    base = written(base, "bm25")  # a few numbers a row, in place of a second pass over the texts
    stats = base.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *(F.count(F.when(F.col(f"tf{k}") > 0, 1)).alias(f"df{k}") for k in range(len(terms))))
    joined = base.join(F.broadcast(stats))
    score = F.lit(0.0)
    for k in range(len(terms)):
        tf, df = F.col(f"tf{k}"), F.col(f"df{k}")
        idf = F.ln(F.lit(1.0) + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    hit = F.lit(False)
    for k in range(len(terms)):
        hit = hit | (F.col(f"tf{k}") > 0)
    return joined.filter(hit).select("id", score.alias("score"))


def search_text(graph: GraphView, query: list[str], limit: int = 10) -> DataFrame:
    """id, name, score: BM25 over name, its parts, qualified name, label and path; functions gain 10, test paths lose 5."""
    text = F.concat_ws(" ", "name", camel_split(F.col("name")), "qualified_name", "label", "file_path")
    found = bm25(graph.nodes, "id", text, query).join(graph.nodes.select("id", "name", "label", "file_path"), "id")
    boost = F.when(F.col("label").isin("Function", "Method"), 10.0).otherwise(0.0) - F.when(is_test_path(F.col("file_path")), 5.0).otherwise(0.0)
    return found.select("id", "name", (F.col("score") + boost).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


#: Ends of test files' names, parts of them, and directories of tests.
TEST_ENDS = ["_test.go", "_test.py", "_test.rs", "_test.cpp", "_test.lua", "Test.java", "Test.kt", "Test.cs", "Test.php", "Spec.scala", "_spec.rb"]
TEST_PARTS = [".test.ts", ".spec.ts", ".test.js", ".spec.js", ".test.tsx", ".spec.tsx"]
TEST_FOLDERS = ["__tests__", "tests", "test", "spec"]
_test_path = "|".join([r"(^|/)test_[^/]*$", *(f"{re.escape(x)}$" for x in TEST_ENDS), *map(re.escape, TEST_PARTS), "__tests__/", *(f"(^|/){x}/" for x in TEST_FOLDERS)])


def is_test_path(path: Column) -> Column:
    return F.coalesce(path, F.lit("")).rlike(_test_path)


def is_test_name(name: Column) -> Column:
    """Names of test functions in any language: Test, Benchmark, Example before a capital or alone, test_ or testX, and the hooks of test runners."""
    return F.coalesce(name, F.lit("")).rlike("^(Test|Benchmark|Example)($|[A-Z])|^test_|^test[A-Z]|^(test|it|describe|beforeAll|afterAll|beforeEach|afterEach|@testset|@test)$")


def search_code(sources: DataFrame, pattern: str) -> DataFrame:
    """path, line, text of every line of sources (path, text) that a regular expression matches."""
    hits = sources.filter(F.col("text").rlike(f"(?m){pattern}"))
    lines = hits.select("path", F.posexplode(F.split("text", "\n")).alias("k", "text"))
    return lines.filter(F.col("text").rlike(pattern)).select("path", (F.col("k") + 1).alias("line"), "text")


def snippet(graph: GraphView, sources: DataFrame, qualified_name: str) -> DataFrame:
    """qualified_name, source: the node's own lines of its file."""
    node = nodes_by(graph, qualified_name=qualified_name).select("qualified_name", "file_path", "start_line", "end_line")
    lines = F.slice(F.split("text", "\n"), F.col("start_line"), F.greatest(F.lit(0), F.col("end_line") - F.col("start_line") + 1))
    return node.join(sources, F.col("file_path") == F.col("path")).select("qualified_name", F.array_join(lines, "\n").alias("source"))


# Schema
def schema_counts(graph: GraphView) -> DataFrame:
    """The cheap variant: labels and types with counts, without reading properties."""
    return counts(graph)


def schema_patterns(graph: GraphView) -> DataFrame:
    """source_label, type, target_label, n."""
    labels = graph.nodes.select("id", "label")
    e = graph.edges.select("source_id", "target_id", "type")
    e = e.join(labels.select(F.col("id").alias("source_id"), F.col("label").alias("source_label")), "source_id").join(labels.select(F.col("id").alias("target_id"), F.col("label").alias("target_label")), "target_id")
    return e.groupBy("source_label", "type", "target_label").agg(F.count("*").alias("n"))


def property_keys(graph: GraphView) -> DataFrame:
    """label, key, n: how many nodes of a label have a property."""
    from pyspark.sql import types as T

    kind = graph.nodes.schema["props"].dataType
    if isinstance(kind, T.StructType):
        keys = F.array_compact(F.array(*(F.when(F.col("props")[f].isNotNull(), F.lit(f)) for f in kind.names)))
    else:
        keys = F.map_keys("props") if isinstance(kind, T.MapType) else F.json_object_keys("props")
    return graph.nodes.select("label", F.explode(keys).alias("key")).groupBy("label", "key").agg(F.count("*").alias("n"))


# Coverage
def coverage_of(coverage: DataFrame, path: str) -> DataFrame:
    """Coverage rows of a path itself and of the directories above it."""
    p = F.lit(path)
    return coverage.filter((F.col("rel_path") == p) | p.startswith(F.concat(F.rtrim(F.col("rel_path"), F.lit("/")), F.lit("/"))))


def coverage_in(coverage: DataFrame, scope: str) -> DataFrame:
    return coverage.filter(in_directory(F.col("rel_path"), scope))


