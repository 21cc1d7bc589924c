import pytest

from graphloom.functions.patterns import glob_to_like, regex_hints
from graphloom.plans.compiler import as_strings, cypher
from graphloom.plans.model import GraphView
from graphloom.plans.syntax import CypherError, UnsupportedCypher, lexed, parsed


@pytest.fixture(scope="module")
def graph(spark):
    nodes = [(k, "p", "Function", n, f"p.m.{n}", "m.py", k, k + 1, props) for k, n, props in [(1, "caller", '{"is_test": true, "alloc_in_loop": 2}'), (2, "leaf", '{"doc": ""}'), (3, "orphan", None), (4, "other", None)]]
    nodes.append((9, "q", "Class", "hello", "q.hello"))
    missed = GraphView.of(spark, [(1, "p", "File", "lost.py", "p.lost")], [(1, "p", 1, 1, "X")])
    g = GraphView.of(spark, nodes, [(1, "p", 1, 2, "CALLS"), (2, "p", 2, 4, "CALLS"), (3, "p", 1, 2, "USAGE")])
    return GraphView(g.nodes, g.edges, {"missed": missed})


def rows(graph, text, **k):
    return sorted(tuple(r) for r in cypher(graph, text, **k).collect())


def test_limits(graph):
    q = "MATCH (f:Function) RETURN f.name AS n"
    assert [len(rows(graph, q + x)) for x in ("", " LIMIT 2", " LIMIT 0")] == [4, 2, 0]
    assert rows(graph, "MATCH (f:Function) WITH f LIMIT 0 RETURN f.name AS n") == []
    assert len(rows(graph, q, max_rows=3)) == 3


def test_dead_code(graph):
    want = [("caller",), ("orphan",)]
    assert rows(graph, "MATCH (f:Function) OPTIONAL MATCH (c)-[:CALLS]->(f) WITH f, c WHERE c IS NULL RETURN f.name AS n") == want
    assert rows(graph, "MATCH (f:Function) WHERE NOT EXISTS { (f)<-[:CALLS]-() } RETURN f.name AS n") == want
    assert "LeftAnti" in cypher(graph, "MATCH (f:Function) OPTIONAL MATCH (c)-[:CALLS]->(f) WITH f, c WHERE c IS NULL RETURN f.name AS n")._jdf.queryExecution().optimizedPlan().toString()


def test_typing_traps(graph):
    one = lambda w: rows(graph, f"MATCH (f:Function) WHERE {w} RETURN f.name AS n")
    assert one("f.is_test = true") == [("caller",)] and one("f.is_test = 1") == []
    assert one("f.alloc_in_loop = 2") == [("caller",)] and one("f.alloc_in_loop = true") == []
    assert len(one("coalesce(f.doc, 'x') = 'x'")) == 4


def test_shared_variables_join(graph):
    assert rows(graph, "MATCH (a)-[:CALLS]->(b) MATCH (b)-[:CALLS]->(c) RETURN a.name AS a, c.name AS c") == [("caller", "other")]
    assert rows(graph, "MATCH (a)-[:CALLS]->(b)-[:CALLS]->(c) RETURN a.name AS a, c.name AS c") == [("caller", "other")]
    with pytest.raises(CypherError):
        from graphloom.plans.compiler import Compiler

        Compiler(graph, most_product=5).query(parsed("MATCH (a), (b) RETURN count(*) AS n"))


def test_paths_clamp_with_a_warning(graph):
    with pytest.warns(UserWarning):
        got = rows(graph, "MATCH (a {name: 'caller'})-[:CALLS*]->(b) RETURN b.name AS n")
    assert got == [("leaf",), ("other",)]
    assert rows(graph, "MATCH (a {name: 'caller'})-[:CALLS*0..1]->(b) RETURN b.name AS n") == [("caller",), ("leaf",)]


def test_projects_and_shadows(graph):
    assert rows(graph, "MATCH (n) RETURN n.name AS n", project="q") == [("hello",)]
    assert rows(graph, "MATCH (n) RETURN n.name AS n", shadow="missed") == [("lost.py",)]
    with pytest.raises(CypherError):
        cypher(graph, "MATCH (n) RETURN n.name AS n", shadow="other")


def test_refusals(graph):
    for text in ("CREATE (n)", "MATCH (n) DELETE n", "MATCH (n) SET n.x = 1 RETURN n", "CALL db.labels()", "MATCH (n) WHERE n.x = $p RETURN n", "MATCH (n) RETURN [x IN [1] | x]", "MATCH (n) RETURN {a: 1} AS m", "MATCH (n) RETURN abs(n.x) AS x", "ATTACH 'x'"):
        with pytest.raises(UnsupportedCypher):
            cypher(graph, text)
    for text in ("", "MATCH (n", "MATCH (n) RETURN n.x UNION SELECT 1", "RETURN 'a", "MATCH (n) RETURN n.a ORDER BY " + ", ".join(["n.a"] * 9), "MATCH (n) RETURN m.x", "MATCH (n) RETURN n.a LIMIT -1"):
        with pytest.raises(CypherError):
            cypher(graph, text)
    assert rows(graph, "MATCH (n) WHERE n.name = \"x' OR 1=1 --\" RETURN n.name AS n") == []


def test_strings_and_whole_nodes(graph):
    got = as_strings(cypher(graph, "MATCH (f:Function {name: 'leaf'}) RETURN f, f.none AS x, labels(f) AS l, keys(f) AS k")).first()
    assert '"name":"leaf"' in got.f and got.x == "" and got.l == '["Function"]' and "doc" in got.k


def test_lexer_and_patterns():
    assert [t.value for t in lexed("MATCH (n:`a b`)-[*1..3]->() // x")][:6] == ["MATCH", "(", "n", ":", "a b", ")"]
    assert [glob_to_like(x) for x in ("**/*.py", "**/dir/**", "src/**", "file?.txt")] == ["%%.py", "%dir%", "src%", "file_.txt"]
    assert [regex_hints(x) for x in (".*Order.*Handler.*", ".*ab.*", "a|b", "abcd?e", "x{2}yzw")] == [["Order", "Handler"], [], [], ["abc"], ["yzw"]]
