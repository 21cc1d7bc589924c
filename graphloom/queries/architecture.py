"""Roll-up queries over the star-schema graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import architecture as a
from graphloom.plans.model import star_view
from graphloom.queries.search import EDGES, NODES

KINDS = ("IN_REGION", "IN_NATION", "PLACED", "SUPPLIES", "HAS_PART")
PKG = "CASE WHEN len(string_split({0}, '.')) >= 4 THEN string_split({0}, '.')[3] WHEN len(string_split({0}, '.')) >= 2 THEN string_split({0}, '.')[2] ELSE '' END"


def _view(use):
    return lambda spark, sf_dir: use(star_view(spark, sf_dir))


QUERIES = {
    "ar_packages": _view(lambda g: a.packages(g)),
    "ar_hotspots": _view(lambda g: a.hotspots(g, 10, KINDS)),
    "ar_boundaries": _view(lambda g: a.boundaries(g, KINDS)),
    "ar_file_tree": _view(lambda g: a.file_tree(g)),
    "ar_layers": _view(lambda g: a.layers(g)),
    "ar_qn_package": _view(lambda g: g.nodes.groupBy(a.package_of(F.col("qualified_name")).alias("package")).agg(F.count("*").alias("n"))),
}
ORACLES = {
    "ar_packages": f"SELECT {PKG.format('qn')} AS package, count(*) AS node_count, 0::BIGINT AS fan_in, 0::BIGINT AS fan_out FROM {NODES} GROUP BY 1 HAVING package <> ''",
    "ar_hotspots": f"SELECT name, qn AS qualified_name, count(*) AS fan_in FROM {EDGES} e JOIN {NODES} n ON n.id = e.t GROUP BY n.id, name, qn ORDER BY fan_in DESC, qualified_name LIMIT 10",
    "ar_boundaries": f"SELECT {PKG.format('a.qn')} AS from_package, {PKG.format('b.qn')} AS to_package, count(*) AS n FROM {EDGES} e JOIN {NODES} a ON a.id = e.s JOIN {NODES} b ON b.id = e.t GROUP BY 1, 2 HAVING from_package <> to_package",
    "ar_file_tree": f"WITH p AS (SELECT DISTINCT path, string_split(path, '/') AS x FROM {NODES}), c AS (SELECT array_to_string(x[1:k], '/') AS path, array_to_string(x[1:k-1], '/') AS parent, k = len(x) AS leaf FROM p, range(1, 9) r(k) WHERE k <= len(x)), e AS (SELECT path, parent, bool_and(leaf) AS leaf FROM c GROUP BY ALL) SELECT e.path, CASE WHEN e.leaf THEN 'file' ELSE 'dir' END AS type, (SELECT count(*) FROM e f WHERE f.parent = e.path) AS children FROM e",
    "ar_layers": f"SELECT DISTINCT {PKG.format('qn')} AS package, 'leaf' AS layer, 'fan-in 0, fan-out 0' AS reason FROM {NODES}",
    "ar_qn_package": f"SELECT {PKG.format('qn')} AS package, count(*) AS n FROM {NODES} GROUP BY 1",
}
