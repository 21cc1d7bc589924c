"""Roll-ups of a graph by package, file, service, layer and community."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import package_of
from graphloom.operators.search import degrees, in_directory, is_test_path
from graphloom.plans.model import GraphView
from graphloom.sources.languages import language_of
from graphloom.storage import written

ASPECTS = ("languages", "packages", "entry_points", "routes", "hotspots", "boundaries", "services", "layers", "clusters", "file_tree")
SERVICE_KINDS = ("HTTP_CALLS", "ASYNC_CALLS", "GRPC_CALLS", "GRAPHQL_CALLS", "TRPC_CALLS", "CROSS_HTTP_CALLS", "CROSS_ASYNC_CALLS", "CROSS_CHANNEL", "CROSS_GRPC_CALLS", "CROSS_GRAPHQL_CALLS", "CROSS_TRPC_CALLS")


def in_scope(graph: GraphView, directory: str | None) -> GraphView:
    if not directory:
        return graph
    nodes = graph.nodes.filter(in_directory(F.col("file_path"), directory))
    ids = nodes.select("id")
    edges = graph.edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return GraphView(nodes, edges)


def _packaged(graph: GraphView) -> DataFrame:
    return graph.nodes.select("id", package_of(F.col("qualified_name")).alias("package"), "label", "file_path")


def languages(graph: GraphView) -> DataFrame:
    return graph.nodes.filter("label = 'File'").select(language_of(F.col("file_path")).alias("language")).filter("language <> ''").groupBy("language").agg(F.count("*").alias("files"))


def _between_packages(graph: GraphView, kinds: tuple[str, ...] | None = ("CALLS",)) -> DataFrame:
    """from_package, to_package, type, n. Edges are counted by source package and target node before the second join, so what it moves is no longer one row an edge."""
    p = _packaged(graph).select("id", "package")
    e = graph.edges if kinds is None else graph.edges.filter(F.col("type").isin(*kinds))
    e = e.select("source_id", "target_id", "type").join(p.select(F.col("id").alias("source_id"), F.col("package").alias("from_package")), "source_id")
    e = e.groupBy("from_package", "target_id", "type").agg(F.count("*").alias("n")).join(p.select(F.col("id").alias("target_id"), F.col("package").alias("to_package")), "target_id")
    return e.groupBy("from_package", "to_package", "type").agg(F.sum("n").alias("n"))


def packages(graph: GraphView) -> DataFrame:
    """package, node_count, fan_in, fan_out: calls that cross the package's border."""
    pairs = _between_packages(graph).filter("from_package <> to_package")
    out = pairs.groupBy(F.col("from_package").alias("package")).agg(F.sum("n").alias("fan_out"))
    into = pairs.groupBy(F.col("to_package").alias("package")).agg(F.sum("n").alias("fan_in"))
    nodes = _packaged(graph).filter("package <> ''").groupBy("package").agg(F.count("*").alias("node_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return nodes.join(into, "package", "left").join(out, "package", "left").select("package", "node_count", zero("fan_in"), zero("fan_out"))


def _flag(graph: GraphView, name: str) -> Column:
    return F.coalesce(graph.node_property(name).cast("string"), F.lit("false")) == "true"


def entry_points(graph: GraphView) -> DataFrame:
    return graph.nodes.filter(_flag(graph, "is_entry_point") & ~_flag(graph, "is_test") & ~is_test_path(F.col("file_path"))).select("name", "qualified_name", "file_path")


def routes(graph: GraphView) -> DataFrame:
    p = lambda name: F.coalesce(graph.node_property(name).cast("string"), F.lit(""))
    return graph.nodes.filter("label = 'Route'").select(p("method").alias("method"), p("path").alias("path"), p("handler").alias("handler"))


def hotspots(graph: GraphView, limit: int = 10, kinds: tuple[str, ...] = ("CALLS",)) -> DataFrame:
    """name, qualified_name, fan_in of the nodes with most edges into them, tests left out."""
    into = graph.edges.filter(F.col("type").isin(*kinds)).groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("fan_in"))
    named = graph.nodes.filter(~is_test_path(F.col("file_path")) & ~_flag(graph, "is_test")).select("id", "name", "qualified_name")
    return into.join(named, "id").orderBy(F.desc("fan_in"), "qualified_name").limit(limit).select("name", "qualified_name", "fan_in")


def boundaries(graph: GraphView, kinds: tuple[str, ...] = ("CALLS",)) -> DataFrame:
    return _between_packages(graph, kinds).filter("from_package <> to_package and from_package <> '' and to_package <> ''").groupBy("from_package", "to_package").agg(F.sum("n").alias("n"))


def services(graph: GraphView) -> DataFrame:
    return _between_packages(graph, SERVICE_KINDS)


def layers(graph: GraphView) -> DataFrame:
    """package, layer, reason: api where routes are, entry where programs start, core where more calls come in than go out and some do, else internal or leaf."""
    routed = graph.nodes.filter("label = 'Route'").select(F.coalesce(graph.node_property("handler").cast("string"), F.lit("")).alias("handler"))
    own = package_of(F.col("qualified_name"))
    handlers = routed.join(graph.nodes.select("qualified_name"), F.col("handler") == F.col("qualified_name")).select(own.alias("package"))
    with_routes = handlers.union(graph.nodes.filter("label = 'Route'").select(own.alias("package"))).distinct().withColumn("routed", F.lit(True))
    starts = entry_points(graph).select(own.alias("package")).distinct().withColumn("starts", F.lit(True))
    p = packages(graph).join(with_routes, "package", "left").join(starts, "package", "left")
    layer = F.when(F.col("routed"), "api").when(F.col("starts"), "entry").when((F.col("fan_in") > F.col("fan_out")) & (F.col("fan_in") > 0), "core").when(F.col("fan_out") > 0, "internal").otherwise("leaf")
    reason = F.when(F.col("routed"), "has routes").when(F.col("starts"), "has entry points").otherwise(F.concat(F.lit("fan-in "), F.col("fan_in").cast("string"), F.lit(", fan-out "), F.col("fan_out").cast("string")))
    return p.select("package", layer.alias("layer"), reason.alias("reason"))


def file_tree(graph: GraphView) -> DataFrame:
    """path, type (dir or file), children: how many a directory has of its own."""
    paths = graph.nodes.select(F.col("file_path").alias("path")).filter("path is not null and path <> ''").distinct()
    parts = F.split("path", "/")
    chains = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("path"), F.array_join(F.slice(parts, 1, k - 1), "/").alias("parent"), (k == F.size(parts)).alias("leaf")))).alias("x")).select("x.*")
    each = chains.groupBy("path", "parent").agg(F.min("leaf").alias("leaf"))
    below = each.groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("children"))
    return each.join(below, "path", "left").select("path", F.when(F.col("leaf"), "file").otherwise("dir").alias("type"), F.coalesce("children", F.lit(0)).alias("children"))


def architecture_docs(graph: GraphView) -> DataFrame:
    return graph.nodes.select("file_path").distinct().filter(F.lower("file_path").rlike(r"(^|/)(architecture|design|adr)[^/]*\.(md|rst|txt|adoc)$|(^|/)adrs?/[^/]+\.md$|(^|/)docs?/architecture/"))


# Communities
def communities(graph: GraphView, resolution: float = 1.0, kinds: tuple[str, ...] = ("CALLS",), rounds: int = 20, levels: int = 8) -> DataFrame:
    """id, community: modularity moves and aggregation in the manner of Leiden; every community is connected inside.

    Moves are distributed: in a round each node weighs the communities around it, and a half of the nodes, by a hash that
    changes with the round, goes to the best one if that gains. Communities that moves have left in pieces are split into
    their connected parts before they become the nodes of the next level. A community's name is its least node id.
    """
    both = graph.edges.filter(F.col("type").isin(*kinds) & (F.col("source_id") != F.col("target_id"))).select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).groupBy("a", "b").agg(F.count("*").cast("double").alias("w"))
    links = written(both.union(both.select("b", "a", "w")), "leiden-links")
    total = links.agg(F.sum("w").alias("m")).first()["m"]
    part = graph.nodes.select("id", F.col("id").alias("community"))
    if not total:
        return part
    part = written(part, "leiden-part")
    level = links
    for _ in range(levels):
        where = written(level.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")).withColumn("c", F.col("id")), "leiden-where")
        moved_any = False
        for turn in range(rounds):
            mass = where.groupBy("c").agg(F.sum("k").alias("mass"))
            near = level.filter("a <> b").join(where.select(F.col("id").alias("b"), "c"), "b").groupBy(F.col("a").alias("id"), "c").agg(F.sum("w").alias("into"))
            options = near.join(mass, "c").join(where.select("id", "k", F.col("c").alias("own")), "id")
            gain = F.col("into") - resolution * F.col("k") * (F.col("mass") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / total
            best = options.groupBy("id").agg(F.max_by("c", F.struct(gain.alias("g"), (-F.col("c")).alias("t"))).alias("best"), F.max(gain).alias("g"), F.max(F.when(F.col("c") == F.col("own"), gain)).alias("stay"))
            alone = -resolution * F.col("k") * (F.col("mass") - F.col("k")) / total
            new = where.join(best, "id", "left").join(mass, "c")
            go = (F.col("best") != F.col("c")) & (F.col("g") > F.coalesce("stay", alone) + 1e-12) & (F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0)
            new = written(new.select("id", "k", F.when(go, F.col("best")).otherwise(F.col("c")).alias("c"), F.coalesce(go, F.lit(False)).alias("moved")), "leiden-where")
            n = new.filter("moved").count()
            where = new.select("id", "k", "c")
            moved_any = moved_any or n > 0
            if n == 0 and turn % 2:
                break
        if not moved_any:
            break
        # Refinement: connected parts of each community.
        inner = level.filter("a <> b").join(where.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(where.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b").filter("ca = cb").select("a", "b")
        roots = connected(inner)
        where = written(where.select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("c")), "leiden-refined")
        before = part.select("community").distinct().count()
        part = written(part.join(where.select(F.col("id").alias("community"), "c"), "community", "left").select("id", F.coalesce("c", "community").alias("community")), "leiden-part")
        level = written(level.join(where.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(where.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")), "leiden-level")
        if part.select("community").distinct().count() == before:
            break
    low = part.groupBy("community").agg(F.min("id").alias("low"))
    return part.join(low, "community").select("id", F.col("low").alias("community"))


def connected(links: DataFrame) -> DataFrame:
    """id, root: connected parts of links (a, b), named by their least id."""
    both = written(links.union(links.select("b", "a")).distinct(), "connected-links")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("root"))
    labels = written(labels, "connected")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        lower = written(labels.join(near, "id").select("id", F.least("root", "near").alias("root"), F.col("root").alias("was")), "connected-lower")
        jump = lower.select(F.col("id").alias("root"), F.col("root").alias("ahead"))
        labels = written(lower.join(jump, "root").select("id", F.col("ahead").alias("root"), (F.col("ahead") != F.col("was")).alias("moved")), "connected")
        if labels.filter("moved").isEmpty():
            return labels.select("id", "root")
        labels = labels.select("id", "root")


def clusters(graph: GraphView, found: DataFrame | None = None, top: int = 5) -> DataFrame:
    """community, label, members, cohesion, top_nodes, packages, edge_types of communities of two or more."""
    found = communities(graph) if found is None else found
    n = graph.nodes.select("id", "name", package_of(F.col("qualified_name")).alias("package")).join(found, "id").join(degrees(graph), "id").withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    ranked = n.withColumn("k", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "name", "id")))
    sums = ranked.groupBy("community").agg(F.count("*").alias("members"), F.array_sort(F.collect_set(F.when(F.col("package") != "", F.col("package")))).alias("packages"), F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= top, F.struct("k", "name")))), lambda x: x["name"]).alias("top_nodes")).filter("members > 1")
    e = graph.edges.join(found.select(F.col("id").alias("source_id"), F.col("community").alias("c1")), "source_id").join(found.select(F.col("id").alias("target_id"), F.col("community").alias("c2")), "target_id")
    ends = e.select(F.col("c1").alias("community"), "type", (F.col("c1") == F.col("c2")).alias("inside")).union(e.filter("c1 <> c2").select("c2", "type", F.lit(False)))
    held = ends.groupBy("community").agg((F.count(F.when(F.col("inside"), 1)) / F.count("*")).alias("cohesion"), F.array_sort(F.collect_set("type")).alias("edge_types"))
    return sums.join(held, "community", "left").select("community", F.element_at("top_nodes", 1).alias("label"), "members", F.coalesce("cohesion", F.lit(0.0)).alias("cohesion"), "top_nodes", "packages", "edge_types")


def architecture(graph: GraphView, aspects: tuple[str, ...] = ("overview",), directory: str | None = None) -> dict[str, DataFrame]:
    """Only the aspects asked for; overview is all but the file tree."""
    g, make = in_scope(graph, directory), {"languages": languages, "packages": packages, "entry_points": entry_points, "routes": routes, "hotspots": hotspots, "boundaries": boundaries, "services": services, "layers": layers, "clusters": clusters, "file_tree": file_tree}
    wanted = [a for a in ASPECTS if a in aspects or "all" in aspects or "overview" in aspects and a != "file_tree"]
    unknown = set(aspects) - {*ASPECTS, "overview", "all"}
    if unknown:
        raise ValueError(f"unknown aspects: {sorted(unknown)}")
    return {a: make[a](g) for a in wanted}


# Decision documents
#: The canonical headings of a decision document.
SECTIONS = ("PURPOSE", "STACK", "ARCHITECTURE", "PATTERNS", "TRADEOFFS", "PHILOSOPHY")
MOST_BYTES = 8000


def adr_sections(text: str) -> dict[str, str]:
    """Text below each canonical heading; other headings stay inside the section they are in."""
    found: dict[str, list[str]] = {}
    current = None
    for line in text.split("\n"):
        head = line.lstrip("#").strip().upper()
        if line.startswith("## ") and head in SECTIONS:
            current = found.setdefault(head, [])
        elif current is not None:
            current.append(line)
    return {k: "\n".join(v).strip() for k, v in found.items()}


def adr_text(sections: dict[str, str]) -> str:
    unknown = set(sections) - set(SECTIONS)
    if unknown:
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    text = "\n\n".join(f"## {s}\n{sections[s]}" for s in SECTIONS if s in sections)
    if len(text.encode()) > MOST_BYTES:
        raise ValueError(f"a decision document has {MOST_BYTES} bytes at most")
    return text


def adr_updated(text: str, changes: dict[str, str]) -> str:
    return adr_text(adr_sections(text) | changes)


