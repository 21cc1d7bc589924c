"""Versioned tables: whole snapshots under numbered folders, and a pointer that a rename puts in place; incremental changes between manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.model import GraphView


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Published versions: those whose marker is there."""
    fs, path = _fs(spark, folder)
    if not fs.exists(path(folder)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path(folder))]
    return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".done"))


def published(df: DataFrame, folder: str) -> int:
    """Writes df as the next version and returns its number. A version exists from the moment its marker is renamed into place; two writers can't publish one number."""
    data = f"{folder}/data-{uuid.uuid4().hex}"
    df.write.parquet(data)
    return _pointed(df.sparkSession, folder, [data])


def _pointed(spark: SparkSession, folder: str, data: list[str]) -> int:
    fs, path = _fs(spark, folder)
    number = (versions(spark, folder) or [0])[-1] + 1
    draft = path(f"{folder}/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray("\n".join(data).encode()))
    out.close()
    if not fs.rename(draft, path(f"{folder}/v{number}.done")):
        raise RuntimeError(f"version {number} of {folder} was published by another writer")
    return number


def appended_version(df: DataFrame, folder: str, part: str) -> int:
    """The next version: all of the last one, and df, which alone is written, under the name of its part. A part that the last version has already is not added again; returns its number."""
    spark = df.sparkSession
    known = versions(spark, folder)
    parts = [r[0] for r in spark.read.text(f"{folder}/v{known[-1]}.done").collect()] if known else []
    data = f"{folder}/{part}"
    if data in parts:
        return known[-1]
    df.write.mode("overwrite").parquet(data)  # what a run that failed has left
    return _pointed(spark, folder, [*parts, data])


def read_version(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame | None:
    """A version, the latest by default; None if there is none."""
    known = versions(spark, folder)
    if not known or number is not None and number not in known:
        return None
    return spark.read.parquet(*(r[0] for r in spark.read.text(f"{folder}/v{number or known[-1]}.done").collect()))


def generation(spark: SparkSession, folder: str) -> str:
    """Changes when a new version is published: a cursor that carries another is out of date."""
    return f"g{(versions(spark, folder) or [0])[-1]}"


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """rel_path, change (added, removed, changed) between manifests (rel_path, sha256)."""
    j = old.select("rel_path", F.col("sha256").alias("was")).join(new.select("rel_path", F.col("sha256").alias("now")), "rel_path", "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return j.select("rel_path", change.alias("change")).filter("change is not null")


def route(changes: int, files: int, schema_changed: bool = False) -> str:
    """What an index run does: noop without changes, full when the schema or most files changed, else an incremental repair."""
    return "full" if schema_changed or files and changes * 2 > files else "noop" if not changes else "incremental"


def patched(graph: GraphView, nodes: DataFrame, edges: DataFrame, paths: DataFrame, recomputed: tuple[str, ...] = ("SIMILAR_TO", "SEMANTICALLY_RELATED", "FILE_CHANGES_WITH")) -> GraphView:
    """graph with the nodes of paths (file_path) replaced by nodes, and their edges by edges.

    Edges from other files into a replaced node are linked again by its qualified name; types that are recomputed anyway are dropped.
    """
    gone = graph.nodes.join(paths, "file_path", "left_semi").select("id", "qualified_name")
    kept = graph.nodes.join(gone.select("id"), "id", "left_anti")
    e = graph.edges.filter(~F.col("type").isin(*recomputed)).join(gone.select(F.col("id").alias("source_id")), "source_id", "left_anti")
    stay = e.join(gone.select(F.col("id").alias("target_id")), "target_id", "left_anti")
    linked = e.join(gone.select(F.col("id").alias("target_id"), "qualified_name"), "target_id").drop("target_id").join(nodes.select("qualified_name", F.col("id").alias("target_id")), "qualified_name").select(*graph.edges.columns)
    return GraphView(kept.unionByName(nodes), stay.select(*graph.edges.columns).unionByName(linked).unionByName(edges.select(*graph.edges.columns)))


def without(graph: GraphView, project: str | None = None, file_path: str | None = None, label: str | None = None) -> GraphView:
    """graph without the nodes that meet every condition given, and without their edges."""
    cond = F.lit(True)
    for name, value in (("project", project), ("file_path", file_path), ("label", label)):
        cond = cond if value is None else cond & F.col(name).eqNullSafe(value)
    gone = graph.nodes.filter(cond).select("id")
    edges = graph.edges.join(gone.select(F.col("id").alias("source_id")), "source_id", "left_anti").join(gone.select(F.col("id").alias("target_id")), "target_id", "left_anti")
    return GraphView(graph.nodes.filter(~cond), edges.select(*graph.edges.columns))


def bound(registry: DataFrame, slug: str, root: str, role: str | None = None) -> DataFrame:
    """registry (slug, root_path, role) with a member bound: the same again changes nothing; another root under the slug, or another slug for the root, is refused."""
    clash = registry.filter((F.col("slug") == slug) & (F.col("root_path") != root) | (F.col("slug") != slug) & (F.col("root_path") == root)).first()
    if clash:
        raise ValueError(f"{clash['slug']} is bound to {clash['root_path']}")
    new = registry.sparkSession.createDataFrame([(slug, root, role)], "slug string, root_path string, role string")
    return registry.filter(F.col("slug") != slug).unionByName(new)
