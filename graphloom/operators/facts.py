"""Edges from facts about sources: definitions, imports, references, exceptions, accesses, dependencies, decorator routes, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import canonical_route, qualified_name
from graphloom.operators.resolve import resolve

#: Labels whose nodes other facts may be resolved to.
REGISTRABLE = ("Function", "Method", "Class", "Struct", "Interface", "Enum", "Type", "Trait", "Variable", "Field")
CALLABLE = ("Function", "Method")


def file_name(project: Column, path: Column) -> Column:
    """The qualified name of a file's own node."""
    return qualified_name(project, path, F.lit("__file__"))


def defines(nodes: DataFrame) -> DataFrame:
    """source_id, target_id, type: DEFINES from each file to what it defines, DEFINES_METHOD from each class (parent_class, a qualified name) to its methods."""
    files = nodes.filter("label = 'File'").select(F.col("id").alias("source_id"), "project", "file_path")
    inside = nodes.filter(F.col("label").isin(*REGISTRABLE)).select(F.col("id").alias("target_id"), "project", "file_path", "label", "parent_class")
    own = files.join(inside, ["project", "file_path"]).select("source_id", "target_id", F.lit("DEFINES").alias("type"))
    classes = nodes.select(F.col("id").alias("source_id"), "project", F.col("qualified_name").alias("parent_class"))
    methods = inside.filter("label = 'Method'").join(classes, ["project", "parent_class"]).select("source_id", "target_id", F.lit("DEFINES_METHOD").alias("type"))
    return own.union(methods)


def import_edges(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """source_id, target_id, type, local_name: IMPORTS from a file (project, file_path) to the node of a qualified name (target), once for each name that it gets there."""
    files = nodes.filter("label = 'File'").select(F.col("id").alias("source_id"), "project", "file_path")
    targets = nodes.select(F.col("id").alias("target_id"), F.col("qualified_name").alias("target"))
    found = imports.join(files, ["project", "file_path"]).join(targets, "target").filter("source_id <> target_id")
    return found.select("source_id", "target_id", F.lit("IMPORTS").alias("type"), F.coalesce("local_name", F.lit("")).alias("local_name")).distinct()


def _resolved(facts: DataFrame, nodes: DataFrame, imports: DataFrame) -> DataFrame:
    """facts (source_id, module, name, imports, and others) with target_id and target_label; equal names of a module are resolved once; a node's references to itself are dropped."""
    call = F.struct("module", F.col("name").alias("callee"), "imports")
    keyed = facts.withColumn("call", call)
    found = resolve(keyed.select(F.col("call").alias("call_id"), "call.*").distinct(), nodes.filter(F.col("label").isin(*REGISTRABLE)).select("qualified_name"), imports)
    targets = nodes.select(F.col("id").alias("target_id"), "qualified_name", F.col("label").alias("target_label"))
    return keyed.join(found.select(F.col("call_id").alias("call"), "qualified_name"), "call").join(targets, "qualified_name").filter("source_id <> target_id")


def usages(references: DataFrame, nodes: DataFrame, imports: DataFrame) -> DataFrame:
    """source_id, target_id, type, callee of references (source_id, module, name, imports, precise): CALL_REFERENCE where a precise one names something callable, USAGE else."""
    kind = F.when(F.col("precise") & F.col("target_label").isin(*CALLABLE), "CALL_REFERENCE").otherwise("USAGE")
    return _resolved(references, nodes, imports).select("source_id", "target_id", kind.alias("type"), F.col("name").alias("callee")).distinct()


def throws(facts: DataFrame, nodes: DataFrame, imports: DataFrame) -> DataFrame:
    """source_id, target_id, type of exceptions thrown (source_id, module, name, imports): RAISES for errors and panics by name, THROWS for the others, as they count as checked."""
    kind = F.when(F.col("name").rlike("[Ee]rror|[Pp]anic"), "RAISES").otherwise("THROWS")
    return _resolved(facts, nodes, imports).select("source_id", "target_id", kind.alias("type")).distinct()


def accesses(facts: DataFrame, nodes: DataFrame, imports: DataFrame) -> DataFrame:
    """source_id, target_id, type of variables read and written (source_id, module, name, imports, is_write)."""
    return _resolved(facts, nodes, imports).select("source_id", "target_id", F.when(F.col("is_write"), "WRITES").otherwise("READS").alias("type")).distinct()


def depends(signatures: DataFrame, nodes: DataFrame, imports: DataFrame) -> DataFrame:
    """source_id, target_id, type: CALLS from a function to each function that its signature (source_id, module, signature, imports) names in Depends(...)."""
    names = signatures.select("source_id", "module", "imports", F.explode(F.regexp_extract_all("signature", F.lit(r"Depends\(([A-Za-z_][A-Za-z0-9_.]*)"), F.lit(1))).alias("name"))
    return _resolved(names, nodes, imports).select("source_id", "target_id", F.lit("CALLS").alias("type")).distinct()


def decorator_routes(decorated: DataFrame, prefixes: DataFrame) -> DataFrame:
    """handler, method, path of decorators (handler, module, decorator) such as @app.get("/x") and @router.route("/x", methods=["POST"]).

    prefixes (module, prefix) are where a module's router is mounted; routes of a module without one stay as they are.
    """
    verb = F.lower(F.regexp_extract("decorator", r"\.(get|post|put|delete|patch|head|options|route|websocket)\s*\(", 1))
    listed = F.upper(F.regexp_extract("decorator", r"methods\s*=\s*[\[(]\s*[\"'](\w+)", 1))
    found = decorated.select("handler", "module", verb.alias("verb"), listed.alias("listed"), F.regexp_extract("decorator", r"\(\s*[\"']([^\"']*)[\"']", 1).alias("path")).filter("verb <> '' and path like '/%'")
    method = F.when(F.col("verb") != "route", F.upper("verb")).when(F.col("listed") != "", F.col("listed")).otherwise("GET")
    whole = F.concat(F.rtrim(F.coalesce("prefix", F.lit("")), F.lit("/")), F.col("path"))
    return found.join(prefixes, "module", "left").select("handler", method.alias("method"), canonical_route(whole).alias("path")).distinct()


def validated_calls(edges: DataFrame, spans: DataFrame) -> DataFrame:
    """source_id, target_id, url_path, seen, p99_ns of HTTP_CALLS (source_id, target_id, url_path): how many spans (path, duration_ns) have their canonical path."""
    from graphloom.streaming.feed import p99

    seen = spans.select(canonical_route(F.col("path")).alias("route"), "duration_ns")
    sums = seen.groupBy("route").agg(F.count("*").alias("seen")).join(p99(seen, ["route"], "duration_ns"), "route")
    e = edges.select("source_id", "target_id", "url_path", canonical_route(F.col("url_path")).alias("route"))
    return e.join(sums, "route", "left").select("source_id", "target_id", "url_path", F.coalesce("seen", F.lit(0)).cast("long").alias("seen"), F.col("p99").alias("p99_ns"))
