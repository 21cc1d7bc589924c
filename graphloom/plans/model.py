"""Graphs as two DataFrames, and a graph view over a star schema."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_FIELDS = ["id", "project", "label", "name", "qualified_name", "file_path", "start_line", "end_line"]
EDGE_FIELDS = ["id", "project", "source_id", "target_id", "type"]
NODE_SCHEMA = "id long, project string, label string, name string, qualified_name string, file_path string, start_line int, end_line int, props string"
EDGE_SCHEMA = "id long, project string, source_id long, target_id long, type string, props string"


def property_of(props: Column, kind: T.DataType, name: str) -> Column:
    """A property from a JSON text, a map or a struct; null where it is absent."""
    if isinstance(kind, T.StructType):
        return props[name] if name in kind.names else F.lit(None).cast("string")
    if isinstance(kind, T.MapType):
        return F.try_element_at(props, F.lit(name))
    return F.get_json_object(props, f"$.{name}")


@dataclass(frozen=True)
class GraphView:
    """nodes and edges with the fields above and props, which may be JSON text, a map or a struct of native types.

    shadows holds further graphs by name, such as "missed" for what an index run couldn't cover.
    """

    nodes: DataFrame
    edges: DataFrame
    shadows: dict[str, GraphView] = field(default_factory=dict)

    def scoped(self, project: str | None) -> GraphView:
        return self if project is None else GraphView(self.nodes.filter(F.col("project") == project), self.edges.filter(F.col("project") == project), self.shadows)

    def node_property(self, name: str) -> Column:
        return property_of(F.col("props"), self.nodes.schema["props"].dataType, name)

    def edge_property(self, name: str) -> Column:
        return property_of(F.col("props"), self.edges.schema["props"].dataType, name)

    @classmethod
    def of(cls, spark: SparkSession, nodes: list[tuple], edges: list[tuple]) -> GraphView:
        """From literal rows; trailing fields may be left out."""
        defaults = (None, "p", None, None, None, None, None, None, "{}")
        full = [tuple(x if x is not None else d for x, d in zip((*n, *[None] * (9 - len(n))), defaults, strict=True)) for n in nodes]
        return cls(spark.createDataFrame(full, NODE_SCHEMA), spark.createDataFrame([(*e, *("{}",) * (6 - len(e))) for e in edges], EDGE_SCHEMA))


def upserted_nodes(nodes: DataFrame, order: str) -> DataFrame:
    """One row for each (project, qualified_name): the one with the greatest value of order."""
    columns = [c for c in nodes.columns if c not in ("project", "qualified_name")]
    latest = nodes.groupBy("project", "qualified_name").agg(F.max_by(F.struct(*columns), F.struct(order, "id")).alias("_row"))
    return latest.select(*(F.col(c) if c in ("project", "qualified_name") else F.col(f"_row.{c}").alias(c) for c in nodes.columns))


def deduplicated_edges(edges: DataFrame, order: str = "id") -> DataFrame:
    """One edge for each (source, target, type), the properties of the latest; IMPORTS edges differ by local_name as well."""
    local = F.when(F.col("type") == "IMPORTS", F.coalesce(property_of(F.col("props"), edges.schema["props"].dataType, "local_name"), F.lit(""))).otherwise(F.lit(""))
    keys = ["source_id", "target_id", "type"]
    rest = [c for c in edges.columns if c not in keys]
    latest = edges.groupBy(*keys, local.alias("_local")).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
    return latest.select(*(F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in edges.columns))


#: Last digit of a node id, by label of the star-schema view.
TAGS = {"Region": 1, "Nation": 2, "Customer": 3, "Supplier": 4, "Part": 5, "Order": 6}
PROPS = "acctbal double, mktsegment string, type string, size int, retailprice double, status string, totalprice double"


def star_view(spark: SparkSession, sf_dir: str) -> GraphView:
    """Regions, nations, customers, suppliers, parts and orders as nodes; who is where, ordered what and supplies what as edges.

    Labels and types are literals of each branch, so a filter on them leaves only the tables that it needs.
    """
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    region, nation = t("region"), t("nation")
    places = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 rows of 5
    kinds = [x.split() for x in PROPS.split(", ")]

    def node(df: DataFrame, label: str, key: str, name: Column, qn: Column, path: Column, **props: str) -> DataFrame:
        bag = F.struct(*((F.col(props[k]).cast(v) if k in props else F.lit(None).cast(v)).alias(k) for k, v in kinds))
        return df.select((F.col(key).cast("long") * 10 + TAGS[label]).alias("id"), F.lit("tpch").alias("project"), F.lit(label).alias("label"), name.alias("name"), qn.alias("qualified_name"), path.alias("file_path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), bag.alias("props"))

    c, dot = F.col, lambda *x: F.concat_ws(".", F.lit("tpch"), *x)
    located = lambda df, key: df.join(F.broadcast(places), c(key) == c("n_nationkey"))
    nodes = [
        node(region, "Region", "r_regionkey", c("r_name"), dot(c("r_name")), c("r_name")),
        node(places, "Nation", "n_nationkey", c("n_name"), dot(c("r_name"), c("n_name")), F.concat_ws("/", "r_name", "n_name")),
        node(located(t("customer"), "c_nationkey"), "Customer", "c_custkey", c("c_name"), dot(c("r_name"), c("n_name"), c("c_name")), F.concat_ws("/", "r_name", "n_name", F.lit("customer")), acctbal="c_acctbal", mktsegment="c_mktsegment"),
        node(located(t("supplier"), "s_nationkey"), "Supplier", "s_suppkey", c("s_name"), dot(c("r_name"), c("n_name"), c("s_name")), F.concat_ws("/", "r_name", "n_name", F.lit("supplier")), acctbal="s_acctbal"),
        node(t("part"), "Part", "p_partkey", c("p_name"), dot(F.lit("parts"), c("p_brand"), c("p_partkey").cast("string")), F.concat_ws("/", F.lit("parts"), "p_brand", F.lit("part")), type="p_type", size="p_size", retailprice="p_retailprice"),
        node(t("orders"), "Order", "o_orderkey", F.concat(F.lit("Order#"), c("o_orderkey").cast("string")), dot(F.lit("orders"), c("o_orderpriority"), c("o_orderkey").cast("string")), F.concat_ws("/", F.lit("orders"), "o_orderpriority"), status="o_orderstatus", totalprice="o_totalprice"),
    ]

    def edge(df: DataFrame, kind: str, source: tuple[str, str], target: tuple[str, str], distinct: bool = False) -> DataFrame:
        ids = [(c(col).cast("long") * 10 + TAGS[label]).alias(name) for (label, col), name in ((source, "source_id"), (target, "target_id"))]
        pairs = df.select(*ids).distinct() if distinct else df.select(*ids)
        return pairs.select(F.xxhash64("source_id", "target_id", F.lit(kind)).alias("id"), F.lit("tpch").alias("project"), "source_id", "target_id", F.lit(kind).alias("type"), F.lit("{}").alias("props"))

    line = t("lineitem")
    edges = [
        edge(nation, "IN_REGION", ("Nation", "n_nationkey"), ("Region", "n_regionkey")),
        edge(t("customer"), "IN_NATION", ("Customer", "c_custkey"), ("Nation", "c_nationkey")),
        edge(t("supplier"), "IN_NATION", ("Supplier", "s_suppkey"), ("Nation", "s_nationkey")),
        edge(t("orders"), "PLACED", ("Customer", "o_custkey"), ("Order", "o_orderkey")),
        edge(line, "HAS_PART", ("Order", "l_orderkey"), ("Part", "l_partkey"), True),
        edge(line, "SUPPLIES", ("Supplier", "l_suppkey"), ("Part", "l_partkey"), True),
    ]
    union = lambda parts: parts[0] if len(parts) == 1 else union(parts[:-1]).unionByName(parts[-1])
    return GraphView(union(nodes), union(edges))


CODE_PROPS = ["is_test", "is_entry_point", "is_exported", "method", "path", "handler"]


def code_view(spark: SparkSession, sf_dir: str) -> GraphView:
    """Parts as functions, methods and routes of packages by brand, with flags by size; parts of one order that follow one another call, those two places apart use one another."""
    part, line = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "lineitem"))
    c, size, brand = F.col, F.col("p_size"), F.regexp_replace("p_brand", "#", "")
    label = F.when(size == 1, "Route").when(size % 2 == 0, "Function").otherwise("Method")
    name = F.concat(F.when(size % 11 == 0, "test_").otherwise("f"), c("p_partkey").cast("string"))
    qn, start = F.concat_ws(".", F.lit("shop.src"), brand, name), (c("p_partkey") % 1000 + 1).cast("int")
    route = lambda x: F.when(size == 1, x)
    bag = F.struct((size % 11 == 0).alias("is_test"), (size % 7 == 0).alias("is_entry_point"), (size % 3 == 0).alias("is_exported"), route(F.lit("GET")).alias("method"), route(F.concat_ws("/", F.lit(""), brand, c("p_partkey").cast("string"))).alias("path"), route(qn).alias("handler"))
    nodes = part.select(c("p_partkey").alias("id"), F.lit("shop").alias("project"), label.alias("label"), name.alias("name"), qn.alias("qualified_name"), F.concat(F.when(size % 13 == 0, "tests/").otherwise("src/"), brand, F.lit(".py")).alias("file_path"), start.alias("start_line"), (start + size).cast("int").alias("end_line"), bag.alias("props"))

    def following(step: int, kind: str) -> DataFrame:
        a = line.select("l_orderkey", (c("l_linenumber") + step).alias("l_linenumber"), c("l_partkey").alias("source_id"))
        pairs = a.join(line.select("l_orderkey", "l_linenumber", c("l_partkey").alias("target_id")), ["l_orderkey", "l_linenumber"]).select("source_id", "target_id").distinct()
        return pairs.select(F.xxhash64("source_id", "target_id", F.lit(kind)).alias("id"), F.lit("shop").alias("project"), "source_id", "target_id", F.lit(kind).alias("type"), F.lit("{}").alias("props"))

    return GraphView(nodes, following(1, "CALLS").unionByName(following(2, "USAGE")))
