"""Connected components of a link table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialised


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """node, root for each end of links (a, b); root is the smallest node that can be reached.

    Each round takes the least label among a node and its neighbours, then the label of that label, until none changes:
    rounds grow with the logarithm of the longest path. Each round is written to shared storage; a hub's rows are
    spread by the adaptive skew join, since the other side has one row for each node.
    """
    both = materialised(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), f"{label}-links")
    labels = materialised(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), f"{label}-start")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = materialised(labels.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("was")), f"{label}-lower")
        ahead = lower.select(F.col("node").alias("root"), F.col("root").alias("ahead"))
        jumped = materialised(lower.join(ahead, "root").select("node", F.col("ahead").alias("root"), (F.col("ahead") != F.col("was")).alias("moved")), f"{label}-jumped")
        labels = jumped.select("node", "root")
        if jumped.filter("moved").isEmpty():
            return labels
