import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import architecture as a
from graphloom.operators import search as s
from graphloom.operators import traverse as t
from graphloom.plans.model import GraphView, deduplicated_edges


@pytest.fixture(scope="module")
def f1(spark):
    return GraphView.of(spark, [(1, "p", "Function", "SubmitOrder", "p.main.SubmitOrder", "main.go", 1, 5), (2, "p", "Function", "ProcessOrder", "p.service.ProcessOrder", "service.go", 1, 9), (3, "p", "Class", "OrderService", "p.service.OrderService", "service.go", 10, 20)], [(1, "p", 1, 2, "CALLS")])


def test_search(f1):
    total = lambda **k: s.search(f1, s.Search(**k))[1]
    assert (total(label="Function"), total(label=""), total(name_pattern=".*Submit.*"), total(file_pattern="service*"), total(name_pattern="submitorder"), total(name_pattern="submitorder", case_sensitive=True)) == (2, 3, 1, 2, 1, 0)
    page, n = s.search(f1, s.Search(limit=1, offset=100))
    assert page.count() == 0 and n == 3
    assert {r.name for r in s.matching(f1, s.Search(min_degree=1)).collect()} == {"SubmitOrder", "ProcessOrder"}
    assert {r.name for r in s.matching(f1, s.Search(max_degree=0)).collect()} == {"OrderService"}
    assert {r.name: r.connected for r in s.matching(f1, s.Search(include_connected=True)).collect()}["SubmitOrder"] == ["ProcessOrder"]
    assert [r.id for r in s.overlapping(f1, "service.go", 8, 12).collect()] == [2, 3]
    assert s.one_node(f1, name="SubmitOrder").id == 1 and s.one_node(f1, name="none") is None
    with pytest.raises(s.AmbiguousError):
        s.one_node(f1, file_path="service.go")
    assert s.call_pairs(f1, 1)[1] is False and s.search_text(f1, ["submit"]).first().name == "SubmitOrder"


def test_degrees(spark):
    g = GraphView.of(spark, [(k, "p", "Function", x, x) for k, x in ((1, "A"), (2, "B"), (3, "C"))], [(1, "p", 1, 2, "CALLS"), (2, "p", 1, 3, "CALLS"), (3, "p", 2, 3, "CALLS"), (4, "p", 1, 3, "USAGE")])
    d = lambda *k: {r.id: (r.in_degree, r.out_degree) for r in s.degrees(g, *k).collect()}
    assert d() == {1: (0, 3), 2: (1, 1), 3: (3, 0)} and d(("CALLS",)) == {1: (0, 2), 2: (1, 1), 3: (2, 0)}
    edges = spark.createDataFrame([(1, "p", 1, 2, "CALLS", "{}"), (2, "p", 1, 2, "CALLS", '{"x": 1}'), (3, "p", 1, 2, "IMPORTS", '{"local_name": "a"}'), (4, "p", 1, 2, "IMPORTS", '{"local_name": "b"}')], "id long, project string, source_id long, target_id long, type string, props string")
    assert sorted(r.id for r in deduplicated_edges(edges).collect()) == [2, 3, 4]


def test_bfs_against_plain_python(spark):
    rnd = random.Random(4)
    edges = sorted({(rnd.randrange(30), rnd.randrange(30)) for _ in range(60)})
    g = GraphView.of(spark, [(k, "p", "Function", str(k), str(k)) for k in range(30)], [(k, "p", x, y, "CALLS") for k, (x, y) in enumerate(edges)])
    for direction in ("out", "in", "any"):
        hops, front = {0: 0, 5: 0}, {0, 5}
        for hop in range(1, 4):
            near = {y for x, y in edges if x in front} if direction != "in" else set()
            near |= {x for x, y in edges if y in front} if direction != "out" else set()
            front = near - hops.keys()
            hops |= dict.fromkeys(front, hop)
        found, inside, cut = t.bfs(g, [0, 5], ("CALLS",), direction, 3)
        assert {r.id: r.hop for r in found.collect()} == {k: h for k, h in hops.items() if h} and not cut
        assert inside.count() == sum(x in hops and y in hops for x, y in edges)


def test_star_and_ceiling(spark):
    g = GraphView.of(spark, [(k, "p", "Function", str(k), str(k)) for k in range(1201)], [(k, "p", k, 0, "CALLS") for k in range(1, 1201)])
    found, edges, cut = t.bfs(g, [0], ("CALLS",), "in", 1)
    assert (found.count(), edges.count(), cut) == (1200, 1200, False)
    found, _, cut = t.bfs(g, [0], ("CALLS",), "in", 1, 20)
    assert found.count() == 20 and cut


def test_impact_and_changes(spark):
    g = GraphView.of(spark, [(k, "p", "Function", x, x, f"{x}.py", 1, 9) for k, x in enumerate("ABCD")], [(1, "p", 0, 1, "CALLS"), (2, "p", 1, 2, "HTTP_CALLS"), (3, "p", 2, 3, "CALLS")])
    hunks = spark.createDataFrame([("D.py", 9, 12)], 'path string, start int, end int')
    assert {r["name"]: r.risk for r in t.detect_changes(g, hunks).collect()} == {"C": "CRITICAL", "B": "HIGH", "A": "MEDIUM"}
    found, edges, _ = t.bfs(g, [3], (), "in", 5)
    assert tuple(t.impact(found, edges).first()) == (1, 1, 1, 0, 3, True)
    with pytest.raises(LookupError):
        t.trace_path(g, "none")


def test_cycles_and_loop_depths(spark):
    nodes = [(k, "p", "Function", str(k), str(k), None, None, None, '{"loop_depth": %d}' % (k % 3)) for k in range(9)]
    g = GraphView.of(spark, nodes, [(k, "p", x, y, "CALLS") for k, (x, y) in enumerate([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 4), (7, 7), (6, 1)])])
    assert {r.id: r.component for r in t.cycles(g).collect()} == {0: 0, 1: 0, 2: 0, 4: 4, 5: 4, 7: 7}
    got = {r.id: (r.transitive_loop_depth, r.recursive) for r in t.loop_depths(g).collect()}
    assert got[3] == (0 + 1, False) and got[2] == (3, True) and got[7] == (1, True) and got[8] == (2, False)


def test_status(spark):
    nodes = [(1, "p", "Function", "dead", "1"), (2, "p", "Function", "one", "2"), (3, "p", "Function", "t", "3", "tests/test_x.py"), (4, "p", "Function", "e", "4", None, None, None, '{"is_entry_point": true}'), (5, "p", "Function", "x", "5", None, None, None, '{"is_exported": true}'), (6, "p", "File", "f", "6")]
    g = GraphView.of(spark, nodes, [(1, "p", 4, 2, "CALLS")])
    assert {r.id: r.status for r in t.status(g).collect()} == {1: "dead", 2: "single", 3: "test", 4: "entry", 5: "exported", 6: "structural"}


def cliques(n, size):
    edges = [(c * size + x, c * size + y) for c in range(n) for x in range(size) for y in range(x)]
    return edges + [(c * size, (c + 1) * size) for c in range(n - 1)]


def test_communities_are_connected(spark):
    for edges, most in ((cliques(2, 10), 2), (cliques(4, 8), 5), ([(0, 1), (1, 2), (2, 0), (3, 4)], 2), ([(k, k + 1) for k in range(29)], 12)):
        n = 1 + max(max(e) for e in edges)
        g = GraphView.of(spark, [(k, "p", "Function", str(k), f"p.m.f{k}") for k in range(n)], [(k, "p", x, y, "CALLS") for k, (x, y) in enumerate(edges)])
        part = {r.id: r.community for r in a.communities(g).collect()}
        assert len(part) == n and len(set(part.values())) <= most
        for c in set(part.values()):
            inside = {k for k, v in part.items() if v == c}
            seen, todo = set(), [c]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += [z for e in edges for z in e if x in e and z in inside]
            assert seen == inside
    rows = a.clusters(g, a.communities(g)).collect()
    assert all(r.members >= 2 and 0 <= r.cohesion <= 1 for r in rows)


def test_architecture_fixture(spark):
    files = [("main.go", "Go"), ("handler.go", "Go"), ("service.go", "Go"), ("x.py", "Python"), ("y.js", "JavaScript")]
    nodes = [(k, "p", "File", f, f"p.{f}", f) for k, (f, _) in enumerate(files)]
    fn = lambda k, n, qn, path, props="{}": (k, "p", "Function", n, qn, path, 1, 2, props)
    nodes += [fn(10, "main", "p.cmd.server.main", "main.go", '{"is_entry_point": true}'), fn(11, "Handle", "p.internal.handler.Handle", "handler.go", '{"is_entry_point": true}'), fn(12, "Process", "p.internal.service.Process", "service.go"), fn(13, "TestX", "p.internal.service.TestX", "service_test.go", '{"is_entry_point": true, "is_test": true}'), (14, "p", "Route", "POST /api/orders", "p.internal.handler.route", "handler.go", 1, 1, '{"method": "POST", "path": "/api/orders", "handler": "p.internal.handler.Handle"}')]
    g = GraphView.of(spark, nodes, [(1, "p", 10, 11, "CALLS"), (2, "p", 11, 12, "CALLS"), (3, "p", 13, 12, "CALLS")])
    got = a.architecture(g, ("languages", "entry_points", "routes", "boundaries", "layers", "hotspots"))
    assert set(got) == {"languages", "entry_points", "routes", "boundaries", "layers", "hotspots"}
    assert {tuple(r) for r in got["languages"].collect()} == {("Go", 3), ("Python", 1), ("JavaScript", 1)}
    assert got["entry_points"].count() == 2 and tuple(got["routes"].first())[:2] == ("POST", "/api/orders")
    assert {tuple(r) for r in got["boundaries"].collect()} == {("server", "handler", 1), ("handler", "service", 1)}
    assert {r.package: r.layer for r in got["layers"].collect()}["handler"] == "api"
    assert got["hotspots"].first().name == "Process" and got["hotspots"].first().fan_in == 2
    assert a.architecture(GraphView(g.nodes.limit(0), g.edges.limit(0)), ("packages",))["packages"].count() == 0


def test_decision_documents():
    text = "intro\n## PURPOSE\nx\n## Other\ny\n## STACK\nz"
    assert a.adr_sections(text) == {"PURPOSE": "x\n## Other\ny", "STACK": "z"}
    assert a.adr_sections(a.adr_updated(text, {"STACK": "q"}))["STACK"] == "q"
    with pytest.raises(ValueError):
        a.adr_text({"PURPOSE": "x" * 9000})
