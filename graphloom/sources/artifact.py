"""What leaves and enters a store: graphs with fresh ids, projects replaced whole, checked exports, compact text, project rows, git's own state."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.search import in_directory
from graphloom.plans.model import GraphView, upserted_nodes
from graphloom.storage import written


class BadArtifact(ValueError):
    pass


def dumped(graph: GraphView) -> GraphView:
    """graph with ids from 1 on in the order of project and qualified name, and edges that follow; edges without both ends are dropped.

    Ranges are numbered by place; one count for each range reaches the driver.
    """
    spark = graph.nodes.sparkSession
    ordered = graph.nodes.repartitionByRange("project", "qualified_name", "id").sortWithinPartitions("project", "qualified_name", "id")
    placed = written(ordered.withColumn("_at", F.monotonically_increasing_id()), "dump")
    part, before, total = F.shiftright("_at", 33), [], 0
    for row in sorted(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect(), key=lambda r: r["part"]):
        before.append((row["part"], total))
        total += row["n"]
    starts = spark.createDataFrame(before, "part long, start long")
    numbered = placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("new", F.col("start") + F.col("_at") - F.shiftleft("part", 33) + 1)
    ids = written(numbered.select("id", "new"), "dump-ids")
    nodes = numbered.select(*(F.col("new").alias(c) if c == "id" else F.col(c) for c in graph.nodes.columns))
    ends = graph.edges.join(ids.select(F.col("id").alias("source_id"), F.col("new").alias("_s")), "source_id").join(ids.select(F.col("id").alias("target_id"), F.col("new").alias("_t")), "target_id")
    edges = ends.select(*({"source_id": F.col("_s").alias(c), "target_id": F.col("_t").alias(c)}.get(c, F.col(c)) for c in graph.edges.columns))
    return GraphView(nodes, edges)


def flushed(store: GraphView, project: str, graph: GraphView) -> GraphView:
    """store with all of a project replaced by graph."""
    other = F.col("project") != project
    return GraphView(store.nodes.filter(other).unionByName(graph.nodes), store.edges.filter(other).unionByName(graph.edges))


def merged(store: GraphView, graph: GraphView) -> GraphView:
    """store with graph's nodes put in place of those of the same name, and nothing deleted."""
    nodes = store.nodes.withColumn("_new", F.lit(0)).unionByName(graph.nodes.withColumn("_new", F.lit(1)))
    return GraphView(upserted_nodes(nodes, "_new").drop("_new"), store.edges.unionByName(graph.edges))


def carried(old: DataFrame, new: DataFrame, project: str) -> DataFrame:
    """The rows of a new generation: those of other projects as they were, and those that the project has now."""
    return old.filter(F.col("project") != project).unionByName(new.filter(F.col("project") == project))


def coverage_replaced(old: DataFrame, new: DataFrame, paths: DataFrame, scope: str | None = None) -> DataFrame:
    """Coverage rows (rel_path, ...) with those of scope replaced by new, and those of files that are gone (not in paths) pruned."""
    kept = old.filter(~in_directory(F.col("rel_path"), scope)) if scope else old.join(new.select("rel_path").distinct(), "rel_path", "left_anti")
    return kept.unionByName(new).join(paths.select(F.col("path").alias("rel_path")).distinct(), "rel_path", "left_semi")


def checksum(df: DataFrame) -> tuple[int, str]:
    """Rows, and a sum of row hashes that no order changes."""
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(F.to_json(F.struct("*"))).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string")).first()
    return n, total


def exported(graph: GraphView, folder: str) -> dict:
    """Writes nodes and edges as compressed Parquet with a manifest of rows and sums; returns the manifest."""
    spark, manifest = graph.nodes.sparkSession, {}
    for name, df in (("nodes", graph.nodes), ("edges", graph.edges)):
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        manifest[name] = checksum(spark.read.parquet(f"{folder}/{name}"))
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{folder}/manifest")
    return manifest


def imported(spark: SparkSession, folder: str) -> GraphView:
    """The graph of an export; BadArtifact if rows or sums aren't those of its manifest."""
    manifest = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
    parts = {name: spark.read.parquet(f"{folder}/{name}") for name in ("nodes", "edges")}
    for name, df in parts.items():
        if list(checksum(df)) != list(manifest[name]):
            raise BadArtifact(f"{name} of {folder} are not what was exported")
    return GraphView(parts["nodes"], parts["edges"])


def cell(value) -> str:
    """A value as compact text: quoted if it is empty, has outer white space, a comma, quote or line break, or reads as another kind of value."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if not isinstance(value, str):
        return str(value)
    literal = re.fullmatch(r"true|false|null|-?\d+(\.\d+)?([eE][+-]?\d+)?", value)
    return json.dumps(value, ensure_ascii=False) if not value or value != value.strip() or re.search(r'[,"\n\r]', value) or literal else value


def compact(key: str, df: DataFrame) -> str:
    """A small answer as text: a line with its size and columns, and a line for each row."""
    rows = [", ".join(map(cell, r)) for r in df.toLocalIterator()]
    return "\n".join([f"{key}: {len(rows)}  (cols: {' '.join(df.columns)})", *(f"  {r}" for r in rows)])


def columns_and_rows(df: DataFrame) -> str:
    """A small answer as JSON: {"columns": [...], "rows": [[...], ...]}."""
    return json.dumps({"columns": df.columns, "rows": [list(r) for r in df.toLocalIterator()]}, default=str, ensure_ascii=False)


# Projects
def project_put(projects: DataFrame, name: str, root: str, indexed_at: str) -> DataFrame:
    """projects (name, root_path, indexed_at) with one put in, in place of the one of that name."""
    row = projects.sparkSession.createDataFrame([(name, root, indexed_at)], "name string, root_path string, indexed_at string")
    return projects.filter(F.col("name") != name).unionByName(row)


def project_gone(projects: DataFrame, graph: GraphView, name: str) -> tuple[DataFrame, GraphView]:
    """projects and graph without a project and all that is in it."""
    other = F.col("project") != name
    return projects.filter(F.col("name") != name), GraphView(graph.nodes.filter(other), graph.edges.filter(other))


def git_context(root: str) -> dict[str, str]:
    """branch (empty if detached) and head of a work tree that the driver can read; empty where there is none."""
    folder = os.path.join(root, ".git")
    try:
        with open(os.path.join(folder, "HEAD"), encoding="utf-8") as file:
            head = file.read().strip()
    except OSError:
        return {"branch": "", "head": ""}
    if not head.startswith("ref: "):
        return {"branch": "", "head": head}
    ref, found = head[5:], ""
    try:
        with open(os.path.join(folder, ref), encoding="utf-8") as file:
            found = file.read().strip()
    except OSError:
        try:
            with open(os.path.join(folder, "packed-refs"), encoding="utf-8") as file:
                found = next((line.split()[0] for line in file if line.rstrip().endswith(f" {ref}")), "")
        except OSError:
            pass
    return {"branch": ref.removeprefix("refs/heads/"), "head": found}
