from pyspark.sql import functions as F

from graphloom.operators import facts, semantic
from graphloom.plans.model import GraphView
from graphloom.sources import artifact
from graphloom.sources.python_facts import python_facts

NODES = [
    (1, "p", "File", "a.py", "p.a.__file__", "a.py", None), (2, "p", "File", "b.py", "p.b.__file__", "b.py", None),
    (3, "p", "Function", "run", "p.a.run", "a.py", None), (4, "p", "Class", "Box", "p.b.Box", "b.py", None),
    (5, "p", "Method", "open", "p.b.Box.open", "b.py", "p.b.Box"), (6, "p", "Class", "LateError", "p.b.LateError", "b.py", None), (7, "p", "Class", "Stop", "p.b.Stop", "b.py", None),
    (8, "p", "Variable", "limit", "p.a.limit", "a.py", None), (9, "p", "Function", "user", "p.b.user", "b.py", None),
]


def test_edges_from_facts(spark):
    nodes = spark.createDataFrame(NODES, "id long, project string, label string, name string, qualified_name string, file_path string, parent_class string")
    imports = spark.createDataFrame([("p.a", "Box", "p.b.Box")], "module string, alias string, target string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(facts.defines(nodes)) == [(1, 3, "DEFINES"), (1, 8, "DEFINES"), (2, 4, "DEFINES"), (2, 5, "DEFINES"), (2, 6, "DEFINES"), (2, 7, "DEFINES"), (2, 9, "DEFINES"), (4, 5, "DEFINES_METHOD")]
    named = spark.createDataFrame([("p", "a.py", "p.b.Box", "Box"), ("p", "a.py", "p.b.Box", "B"), ("p", "a.py", "p.b.Box", "B"), ("p", "a.py", "p.none", "n")], "project string, file_path string, target string, local_name string")
    assert rows(facts.import_edges(named, nodes)) == [(1, 4, "IMPORTS", "B"), (1, 4, "IMPORTS", "Box")]
    at = lambda xs, extra="": spark.createDataFrame([(3, "p.a", x[0], [], *x[1:]) for x in xs], "source_id long, module string, name string, imports array<string>" + extra)
    assert rows(facts.usages(at([("Box", True), ("open", True), ("run", False), ("nothing", False)], ", precise boolean"), nodes, imports)) == [(3, 4, "USAGE", "Box"), (3, 5, "CALL_REFERENCE", "open")]
    assert rows(facts.throws(at([("LateError",), ("Stop",)]), nodes, imports)) == [(3, 6, "RAISES"), (3, 7, "THROWS")]
    assert rows(facts.accesses(at([("limit", True), ("limit", False), ("limit", False)], ", is_write boolean"), nodes, imports)) == [(3, 8, "READS"), (3, 8, "WRITES")]
    signed = spark.createDataFrame([(3, "p.a", "(u=Depends(user), v=Depends(nobody))", [])], "source_id long, module string, signature string, imports array<string>")
    assert rows(facts.depends(signed, nodes, imports)) == [(3, 9, "CALLS")]
    deco = spark.createDataFrame([("h", "m", '@router.get("/x/{id}")'), ("g", "n", "@app.route('/y', methods=['POST'])"), ("k", "n", "@cache(60)")], "handler string, module string, decorator string")
    assert rows(facts.decorator_routes(deco, spark.createDataFrame([("m", "/api/")], "module string, prefix string"))) == [("g", "POST", "/y"), ("h", "GET", "/api/x/{}")]
    spans = spark.createDataFrame([("/u/{id}", k) for k in range(10, 110, 10)], "path string, duration_ns long")
    calls = spark.createDataFrame([(1, 2, "/u/:id"), (1, 3, "/none")], "source_id long, target_id long, url_path string")
    assert rows(facts.validated_calls(calls, spans)) == [(1, 2, "/u/:id", 10, 100), (1, 3, "/none", 0, None)]


def test_python_sources(spark):
    text = "import os.path as op\nfrom .b import Box as B\nLIMIT: int = 3\nclass C(B):\n    @cached\n    def go(self, x):\n        if x: raise LateError('x')\n        return run(LIMIT, os.getenv('HOME'))\n"
    df = spark.createDataFrame([("a.py", text), ("bad.py", "def ("), ("none.py", None), ("x.txt", "def f(): pass")], "path string, text string")
    found = {(r.path, r.kind, r.owner, r.name, r.label, r.parent, r.line) for r in python_facts(df).collect() if r.kind not in ("read", "write")}
    assert {("a.py", "import", "", "os.path", "", "", 1), ("a.py", "import", "", ".b.Box", "", "", 2), ("a.py", "definition", "", "C", "Class", "", 4), ("a.py", "base", "", "B", "", "C", 4), ("a.py", "definition", "C", "go", "Method", "C", 6), ("a.py", "throw", "C.go", "LateError", "", "", 7), ("a.py", "call", "C.go", "run", "", "", 8), ("a.py", "reference", "C.go", "LIMIT", "", "", 8), ("a.py", "env", "C.go", "HOME", "", "", 8), ("a.py", "typed", "", "LIMIT", "", "", 3), ("bad.py", "unparsed", "", "", "", "", 1)} <= found
    assert {p for p, *_ in found} == {"a.py", "bad.py"}


def test_semantic_candidates(spark):
    rows = [(k, "get_user" if k % 2 else "openBox", f"p.m.f{k}", "m.py", None, "User" if k % 2 else "Box", None, None, ["int"] if k % 2 else ["str", "str"], ["cached"], None) for k in range(300)]
    nodes = spark.createDataFrame(rows, "id long, name string, qualified_name string, file_path string, signature string, return_type string, docstring string, param_names array<string>, param_types array<string>, decorators array<string>, bt string")
    calls = spark.createDataFrame([(0, 1), (0, 3), (2, 1)], "source_id long, target_id long")
    tokens = {r.id: r.tokens for r in semantic.node_tokens(nodes, calls).collect()}
    assert tokens[0].count("user") == 1 and tokens[1].count("box") == 1 and {"open", "box", "p", "m", "f0", "py", "str", "string", "cached"} <= set(tokens[0])
    vectors = semantic.type_vectors(nodes, 32)
    assert vectors.count() == 300 and semantic.api_vectors(nodes, calls, 32).count() == 2 and semantic.decorator_vectors(nodes, 32).select("vector").distinct().count() == 1
    pairs = semantic.candidates(vectors, 32).collect()
    met = {}
    for p in pairs:
        assert p.a < p.b
        for x in p:
            met.setdefault(x, set()).update(p)
    # Two groups of equal vectors, larger than any ceiling: everybody meets others, and nearly all of them are of the own group.
    assert len(met) == 300 and sum((p.a - p.b) % 2 == 0 for p in pairs) > 0.9 * len(pairs) and max(map(len, met.values())) <= 2 * semantic.MOST_CANDIDATES


def test_kept_vectors(spark):
    index = spark.createDataFrame([("a", "h1", [1.0]), ("gone", "h9", [9.0])], "qualified_name string, content_hash string, vector array<double>")
    current = spark.createDataFrame([("a", "h1"), ("moved", "h9"), ("new", "h2")], "qualified_name string, content_hash string")
    out, counts = semantic.refreshed(index, current, lambda df: df.withColumn("vector", F.array(F.lit(0.5))))
    assert {(r.qualified_name, r.vector[0]) for r in out.collect()} == {("a", 1.0), ("moved", 9.0), ("new", 0.5)} and counts == {"reused": 2, "made": 1, "pruned": 1}
    records = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id int, content string")
    kept = spark.createDataFrame([], "content_hash string, vector array<double>")
    assert semantic.record_vectors(records, kept, lambda df: df.withColumn("vector", F.array(F.length("content").cast("double")))).count() == 3


def test_artifacts(spark, tmp_path):
    g = GraphView.of(spark, [(9, "p", "Function", "b", "p.b"), (4, "p", "Function", "a", "p.a"), (7, "q", "Function", "c", "q.c")], [(1, "p", 9, 4, "CALLS"), (2, "p", 9, 99, "CALLS"), (3, "q", 7, 7, "CALLS")])
    d = artifact.dumped(g)
    assert sorted((r.id, r.qualified_name) for r in d.nodes.collect()) == [(1, "p.a"), (2, "p.b"), (3, "q.c")]
    assert sorted((r.source_id, r.target_id) for r in d.edges.collect()) == [(2, 1), (3, 3)]
    new = GraphView.of(spark, [(1, "p", "Class", "a", "p.a")], [])
    assert sorted(r.qualified_name for r in artifact.flushed(g, "p", new).nodes.collect()) == ["p.a", "q.c"]
    assert sorted((r.qualified_name, r.label) for r in artifact.merged(g, new).nodes.collect()) == [("p.a", "Class"), ("p.b", "Function"), ("q.c", "Function")]
    folder = f"file://{tmp_path}/x"
    artifact.exported(g, folder)
    assert artifact.imported(spark, folder).nodes.count() == 3
    g.edges.limit(1).write.mode("overwrite").parquet(f"{folder}/edges")
    try:
        artifact.imported(spark, folder)
        raise AssertionError("a damaged export was read")
    except artifact.BadArtifact:
        pass
    small = spark.createDataFrame([("a, b", 1, True), ("1", None, None), ("", 2, False)], "x string, n int, ok boolean")
    assert artifact.compact("rows", small) == 'rows: 3  (cols: x n ok)\n  "a, b", 1, true\n  "1", , \n  "", 2, false'
    assert artifact.columns_and_rows(small.limit(1)) == '{"columns": ["x", "n", "ok"], "rows": [["a, b", 1, true]]}'
    projects = artifact.project_put(artifact.project_put(spark.createDataFrame([], "name string, root_path string, indexed_at string"), "p", "/p", "t"), "p", "/p2", "u")
    assert [tuple(r) for r in projects.collect()] == [("p", "/p2", "u")]
    left, rest = artifact.project_gone(projects, g, "p")
    assert left.count() == 0 and rest.nodes.count() == 1
    old = spark.createDataFrame([("a.py", "old"), ("gone.py", "old"), ("d/x.py", "old")], "rel_path string, kind string")
    cover = artifact.coverage_replaced(old, spark.createDataFrame([("a.py", "new")], "rel_path string, kind string"), spark.createDataFrame([("a.py",), ("d/x.py",)], "path string"))
    assert sorted(map(tuple, cover.collect())) == [("a.py", "new"), ("d/x.py", "old")]
    assert artifact.carried(g.nodes, new.nodes, "p").count() == 2
    (tmp_path / ".git/refs/heads").mkdir(parents=True)
    (tmp_path / ".git/HEAD").write_text("ref: refs/heads/main\n")
    (tmp_path / ".git/refs/heads/main").write_text("abc\n")
    assert artifact.git_context(str(tmp_path)) == {"branch": "main", "head": "abc"} and artifact.git_context("/nowhere") == {"branch": "", "head": ""}


def test_equal_lines_and_appended_batches(spark, tmp_path):
    from graphloom.sources import delta
    from graphloom.streaming import feed

    inbox, store = tmp_path / "in", f"file://{tmp_path}/store"
    inbox.mkdir()
    line = '{"author": "a", "timestamp_ms": 5, "content": "twice"}\n'
    for k in range(3):
        (inbox / f"{k}.jsonl").write_text(line * (k + 1) + "bad\n")
        feed.watch(spark, f"file://{inbox}", store, f"file://{tmp_path}/ck").awaitTermination()
    rows = delta.read_version(spark, f"{store}/records")
    assert rows.count() == 6 and rows.select("id").distinct().count() == 6 and delta.read_version(spark, f"{store}/records", 1).count() == 1
    assert delta.read_version(spark, f"{store}/dead_letters").count() == 3
    # A batch that is run again adds nothing.
    n = delta.versions(spark, f"{store}/records")[-1]
    assert delta.appended_version(rows.limit(1), f"{store}/records", "batch-2") == n and delta.read_version(spark, f"{store}/records").count() == 6


def test_p99_of_split_groups(spark):
    import random

    from graphloom.streaming.feed import p99

    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "a", "a", None, "b"]), rnd.random()) for _ in range(3000)] + [("one", 4.0)]
    got = {r.k: r.p99 for r in p99(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    for k in {k for k, _ in rows}:
        own = sorted(v for g, v in rows if g == k)
        assert got[k] == own[min(int(len(own) * 0.99), len(own) - 1)]
