"""Registered queries read whole tables."""

import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

from graphloom.operators import vector as v
from graphloom.plans import compiler
from graphloom.plans.model import star_view
from graphloom.queries import all_queries


def test_co_occurrence_reads_every_document(spark, tmp_path):
    texts = [" ".join(f"w{(k * j) % 7}" for j in range(1, 60)) for k in range(1, 120)] + ["", "one", "x x x", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for words in (re.findall("[a-z0-9]+", (x or "").lower()) for x in texts):
        for i, a in enumerate(words):
            for j in range(max(0, i - 2), min(len(words), i + 3)):
                if j != i:
                    want[a, words[j]] += 1 / abs(i - j)
    got = {(r.token, r.near): r.weight for r in all_queries()[0]["vs_cooccurrence"](spark, str(tmp_path)).collect()}
    assert got == {k: round(w, 4) for k, w in want.items() if w > 20}


def test_co_occurrence_in_rows_as_by_place(spark):
    rows = [(1, "a b a a c".split()), (2, ["b"]), (3, []), (4, "c b a".split())]
    places = spark.createDataFrame([(d, k, w) for d, ws in rows for k, w in enumerate(ws)], "doc int, at int, token string")
    found = [{(r.token, r.near): round(r.weight, 6) for r in df.collect()} for df in (v.co_occurrence(places, 3), v.co_occurrence_of(spark.createDataFrame(rows, "doc int, tokens array<string>"), "tokens", 3))]
    assert found[0] == found[1]


def test_language_queries_have_no_ceiling(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(compiler, "MOST_ROWS", 5)
    customers = spark.read.parquet(f"{folder}/customer.parquet").count()
    assert all_queries()[0]["cy_optional"](spark, folder).count() == customers > 5
    text = "MATCH (c:Customer) RETURN c.name AS name"
    graph = star_view(spark, folder)
    assert compiler.cypher(graph, text).count() == 5
    found = [compiler.answered(graph, text, n) for n in (0, customers - 1, customers)]
    assert [(df.count(), cut) for df, cut in found] == [(5, True), (customers - 1, True), (customers, False)]


def test_registry_needs_no_session():
    code = "from graphloom.queries import all_queries; q, sql = all_queries(); assert q and set(sql) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, check=True)


def test_entry_vectors_have_length_one(spark):
    folder = "/root/testdata/sf0.001"
    assert {r.length for r in all_queries()[0]["vs_entry_vectors"](spark, folder).collect()} == {1.0}
