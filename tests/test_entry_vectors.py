"""Index vectors of entries and of texts against sums of whole vectors, and what their plans shuffle."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.operators import semantic
from graphloom.operators import vector as v
from graphloom.queries import all_queries

TEXTS = [
    (1, "a b b c"), (1, "b c d"), (1, None),  # an id with several rows: b and c count once
    (2, "a"), (3, ""), (4, None), (5, " ".join(f"w{k}" for k in range(400))), (6, "The the THE, a-a"),
    (None, "x y"), (None, "y z"), (7, "x y"),
]


def brute(spark, entries, dim):
    """id: unit sum of whole index vectors, for a Counter of entries each."""
    tokens = sorted({t for c in entries.values() for t in c} | {""})
    known = {r.t: r.v for r in spark.createDataFrame([(t,) for t in tokens], "t string").select("t", v.index_vector(F.col("t"), dim).alias("v")).collect()}
    found = {}
    for i, c in entries.items():
        total = [sum(n * known[t][k] for t, n in c.items()) for k in range(dim)]
        length = math.sqrt(sum(x * x for x in total))
        found[i] = [x / length if length else 0.0 for x in total]
    return found


@pytest.mark.parametrize("dim", [1, 16, 300])
def test_entries_count_as_often_as_they_are_there(spark, dim):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "b"), (3, ""), (None, "a"), *((4, f"e{k % 90}") for k in range(300))]
    want = defaultdict(Counter)
    for i, e in rows:
        want[i][e] += 1
    got = [tuple(r) for r in semantic.entry_vectors(spark.createDataFrame(rows, "id long, entry string"), dim).collect()]
    assert dict(got) == brute(spark, want, dim) and len(got) == len(want)


@pytest.mark.parametrize("rows", [TEXTS, TEXTS[:4], TEXTS[3:9], []], ids=["some repeat", "most repeat", "none repeat", "no rows"])
def test_distinct_tokens_of_an_id(spark, rows):
    want = defaultdict(set)
    for i, text in rows:
        for word in re.findall("[a-z0-9]+", (text or "").lower()):
            want[i].add(word)
    texts = spark.createDataFrame([(i, None if t is None else re.findall("[a-z0-9]+", t.lower())) for i, t in rows], "id long, tokens array<string>")
    got = [tuple(r) for r in semantic.text_vectors(texts, "tokens", 24).collect()]
    assert dict(got) == brute(spark, {i: Counter(words) for i, words in want.items()}, 24) and len(got) == len(want)


def test_query_over_repeated_and_empty_rows(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in all_queries()[0]["vs_entry_vectors"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([(i, 1.0) for i in (1, 2, 5, 6, None, 7)], key=str)


def test_words_are_not_shuffled(spark):
    """Ids and places alone: a row for each word, or for each word and place, grows far beyond the texts."""
    plan = all_queries()[0]["vs_entry_vectors"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert keys and not [k for k in keys if re.search("token|entry|_v", k)]
    assert "sequence(" not in plan and "posexplode" not in plan
