"""Bounded traversal: breadth-first search, impact, dependents, depths and cycles.

A search keeps one table of visited nodes and a frontier; each hop is two joins. Both are written to shared storage at each
hop, so plans don't grow with the depth.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.search import callers_and_callees, degrees, is_test_path, overlapping  # noqa: F401
from graphloom.plans.model import GraphView
from graphloom.storage import written

CROSS_SERVICE = ("HTTP_CALLS", "ASYNC_CALLS")


def steps(graph: GraphView, kinds: tuple[str, ...] = (), direction: str = "out") -> DataFrame:
    """here, there for each way along an edge."""
    e = graph.edges.filter(F.col("type").isin(*kinds)) if kinds else graph.edges
    out = e.select(F.col("source_id").alias("here"), F.col("target_id").alias("there"))
    back = e.select(F.col("target_id").alias("here"), F.col("source_id").alias("there"))
    return out if direction == "out" else back if direction == "in" else out.union(back)


def reach(graph: GraphView, seeds: DataFrame, kinds: tuple[str, ...] = (), direction: str = "out", max_depth: int | None = 5) -> DataFrame:
    """id, hop of every node within max_depth hops of a seed (id), or any number of hops, with its least hop; seeds are left out.

    The ways are written once, in the order of the side that is joined at each hop; the edges are not derived again.
    """
    ways = written(steps(graph, kinds, direction).distinct(), "reach-ways")
    seen = written(seeds.select("id").distinct().withColumn("hop", F.lit(0)), "reach")
    front = seen
    for hop in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        near = front.select(F.col("id").alias("here")).join(ways, "here").select(F.col("there").alias("id")).distinct()
        front = written(near.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop)), "reach-front")
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen.filter("hop > 0")


def bfs(graph: GraphView, seeds: list[int], kinds: tuple[str, ...] = (), direction: str = "out", max_depth: int = 5, max_results: int = 0) -> tuple[DataFrame, DataFrame, bool]:
    """Visited nodes (id, hop) in order of hop and id, every edge among them and the seeds, and whether max_results cut them short."""
    start = graph.nodes.sparkSession.createDataFrame([(s,) for s in seeds], "id long")
    found = written(reach(graph, start, kinds, direction, max_depth), "bfs")
    truncated = False
    if max_results:
        truncated = found.limit(max_results + 1).count() > max_results
        found = found.orderBy("hop", "id").limit(max_results)
    inside = found.select("id").union(start)
    edges = graph.edges.filter(F.col("type").isin(*kinds)) if kinds else graph.edges
    edges = edges.join(inside.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(inside.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return found, edges, truncated


def trace_path(graph: GraphView, name: str, direction: str = "both", depth: int = 3) -> DataFrame:
    """direction, id, name, hop along CALLS from the nodes of a name; depth is 1 to 5. Each direction is a search of its own."""
    if not 1 <= depth <= 5:
        raise ValueError("depth is 1 to 5")
    seeds = graph.nodes.filter(F.col("name") == name).select("id")
    if seeds.isEmpty():
        raise LookupError(f"no node is called {name}")
    parts = [reach(graph, seeds, ("CALLS",), d, depth).withColumn("direction", F.lit(d)) for d in (("out", "in") if direction == "both" else (direction,))]
    found = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    return found.join(graph.nodes.select("id", "name"), "id").select("direction", "id", "name", "hop")


def least_hops(hops: DataFrame) -> DataFrame:
    return hops.groupBy("id").agg(F.min("hop").alias("hop"))


def risk_of(hop: Column) -> Column:
    return F.when(hop == 1, "CRITICAL").when(hop == 2, "HIGH").when(hop == 3, "MEDIUM").otherwise("LOW")


def impact(hops: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: how many nodes of each risk, all, and whether an edge crosses services."""
    sums = least_hops(hops).select(risk_of(F.col("hop")).alias("r")).agg(*(F.count(F.when(F.col("r") == r.upper(), 1)).alias(r) for r in ("critical", "high", "medium", "low")), F.count("*").alias("total"))
    cross = edges.agg(F.coalesce(F.max(F.col("type").isin(*CROSS_SERVICE)), F.lit(False)).alias("has_cross_service"))
    return sums.join(F.broadcast(cross))


def changed_symbols(graph: GraphView, hunks: DataFrame) -> DataFrame:
    """id of the nodes that a hunk (path, start, end) overlaps; modules and packages are left out."""
    n = graph.nodes.filter(~F.col("label").isin("Module", "Package", "File", "Folder", "Project"))
    return n.join(hunks, (F.col("file_path") == F.col("path")) & (F.col("start_line") <= F.col("end")) & (F.col("end_line") >= F.col("start")), "left_semi").select("id")


def detect_changes(graph: GraphView, hunks: DataFrame, depth: int = 4) -> DataFrame:
    """id, name, hop, risk of all that calls, directly or not, what the hunks change."""
    found = reach(graph, changed_symbols(graph, hunks), ("CALLS", *CROSS_SERVICE), "in", depth)
    return found.join(graph.nodes.select("id", "name"), "id").select("id", "name", "hop", risk_of(F.col("hop")).alias("risk"))


def dependents(graph: GraphView, paths: DataFrame) -> DataFrame:
    """file_path of every file, other than paths (file_path) themselves, that owns an edge into one of them."""
    n = graph.nodes.select("id", "file_path")
    into = n.join(paths, "file_path", "left_semi").select(F.col("id").alias("target_id"))
    sources = graph.edges.join(into, "target_id", "left_semi").select(F.col("source_id").alias("id")).distinct()
    return n.join(sources, "id", "left_semi").select("file_path").filter("file_path is not null and file_path <> ''").distinct().join(paths, "file_path", "left_anti")


def call_depth(graph: GraphView, max_depth: int | None = None) -> DataFrame:
    """id, depth below routes, files, modules and packages, or below nodes that nothing calls if there is none of these; 0 out of reach."""
    seeds = graph.nodes.filter(F.col("label").isin("Route", "File", "Module", "Package")).select("id")
    if seeds.isEmpty():
        seeds = degrees(graph, ("CALLS",)).filter("in_degree = 0").select("id")
    found = reach(graph, seeds, (), "out", max_depth)
    return graph.nodes.select("id").join(found, "id", "left").select("id", F.coalesce("hop", F.lit(0)).alias("depth"))


def status(graph: GraphView) -> DataFrame:
    """id, status of each node, the first that applies: structural, test, entry, exported, dead, single, normal."""
    e = graph.edges.filter(F.col("type").isin("CALLS", "USAGE", "CALL_REFERENCE", "HTTP_CALLS", "ASYNC_CALLS"))
    into = e.groupBy(F.col("target_id").alias("id")).agg(F.count(F.when(F.col("type") == "CALLS", 1)).alias("calls"), F.count("*").alias("uses"))
    flag = lambda p: F.coalesce(graph.node_property(p).cast("string"), F.lit("false")) == "true"
    n = graph.nodes.select("id", "label", "file_path", flag("is_test").alias("test"), (flag("is_entry_point") | (F.coalesce(graph.node_property("route_path").cast("string"), F.lit("")) != "")).alias("entry"), flag("is_exported").alias("exported")).join(into, "id", "left")
    calls, uses = F.coalesce("calls", F.lit(0)), F.coalesce("uses", F.lit(0))
    named = F.when(~F.col("label").isin("Function", "Method"), "structural").when(F.col("test") | is_test_path(F.col("file_path")), "test").when(F.col("entry"), "entry").when(F.col("exported"), "exported").when(uses == 0, "dead").when(calls == 1, "single").otherwise("normal")
    return n.select("id", named.alias("status"))


def cycles(graph: GraphView, kinds: tuple[str, ...] = ("CALLS",)) -> DataFrame:
    """id, component of the nodes on cycles of more than one node, or with an edge to themselves; component is the least id.

    Nodes without a way in or out are trimmed until none is left. Then, round by round, each node takes the greatest id that
    reaches it; a node of that id's own colour that reaches it back, inside the colour, is in its component.
    """
    e = written(steps(graph, kinds).distinct(), "cycle-edges")
    loops = e.filter("here = there").select(F.col("here").alias("id"), F.col("here").alias("component"))
    e = e.filter("here <> there")
    parts: list[DataFrame] = []
    while True:
        while True:  # trim
            kept = written(e.join(e.select(F.col("here").alias("there")).distinct(), "there", "left_semi").join(e.select(F.col("there").alias("here")).distinct(), "here", "left_semi"), "cycle-trim")
            before, after = e.count(), kept.count()
            e = kept
            if after == before or not after:
                break
        if e.isEmpty():
            break
        colour = written(e.select(F.col("here").alias("id")).distinct().withColumn("colour", F.col("id")), "cycle-colour")
        while True:
            best = e.join(colour.withColumnRenamed("id", "here"), "here").groupBy(F.col("there").alias("id")).agg(F.max("colour").alias("new"))
            moved = written(colour.join(best, "id", "left").select("id", F.greatest("colour", F.coalesce("new", "colour")).alias("colour"), (F.coalesce("new", "colour") > F.col("colour")).alias("moved")), "cycle-colour")
            colour = moved.select("id", "colour")
            if moved.filter("moved").isEmpty():
                break
        same = e.join(colour.select(F.col("id").alias("here"), F.col("colour").alias("c1")), "here").join(colour.select(F.col("id").alias("there"), F.col("colour").alias("c2")), "there").filter("c1 = c2").select("here", "there", F.col("c1").alias("colour"))
        same = written(same, "cycle-same")
        back = written(colour.filter("id = colour"), "cycle-roots")
        front = back
        while not front.isEmpty():
            near = same.join(front.withColumnRenamed("id", "there"), ["there", "colour"]).select(F.col("here").alias("id"), "colour").distinct()
            front = written(near.join(back, ["id", "colour"], "left_anti"), "cycle-front")
            back = written(back.union(front), "cycle-back")
        parts.append(back)
        gone = back.select("id")
        e = written(e.join(gone.withColumnRenamed("id", "here"), "here", "left_anti").join(gone.withColumnRenamed("id", "there"), "there", "left_anti"), "cycle-rest")
    found = loops
    for p in parts:
        low = p.groupBy("colour").agg(F.min("id").alias("component"), F.count("*").alias("n")).filter("n > 1")
        found = found.union(p.join(low, "colour").select("id", "component"))
    return found.groupBy("id").agg(F.min("component").alias("component"))


def loop_depths(graph: GraphView) -> DataFrame:
    """id, transitive_loop_depth, recursive of functions and methods: own loop depth plus the greatest of what they call.

    Calls inside a cycle add nothing and mark both ends as recursive; the other calls have no cycles, so a longest path is
    found by as many rounds as the longest chain of calls.
    """
    own = graph.nodes.filter(F.col("label").isin("Function", "Method")).select("id", F.coalesce(graph.node_property("loop_depth").cast("string").try_cast("int"), F.lit(0)).alias("own"))
    rings = written(cycles(graph), "loops-rings")
    e = steps(graph, ("CALLS",)).distinct()
    e = e.join(rings.select(F.col("id").alias("here"), F.col("component").alias("c1")), "here", "left").join(rings.select(F.col("id").alias("there"), F.col("component").alias("c2")), "there", "left")
    e = written(e.filter(~F.coalesce(F.col("c1") == F.col("c2"), F.lit(False)) & (F.col("here") != F.col("there"))).select("here", "there"), "loops-edges")
    depth = written(own.withColumn("total", F.col("own")), "loops-depth")
    while True:
        below = e.join(depth.select(F.col("id").alias("there"), "total"), "there").groupBy(F.col("here").alias("id")).agg(F.max("total").alias("below"))
        new = written(depth.join(below, "id", "left").select("id", "own", (F.col("own") + F.coalesce("below", F.lit(0))).alias("total"), F.col("total").alias("was")), "loops-depth")
        depth = new.select("id", "own", "total")
        if new.filter("total <> was").isEmpty():
            break
    return depth.join(rings.select("id", F.lit(True).alias("ring")), "id", "left").select("id", F.col("total").alias("transitive_loop_depth"), F.coalesce("ring", F.lit(False)).alias("recursive"))
