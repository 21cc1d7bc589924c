import random

import numpy as np

from graphloom.llm.quality_model import BUCKETS, estimated, scored
from graphloom.llm.quality_rules import COMMON


def test_em_finds_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.2
    right = np.array([0.95, 0.9, 0.85, 0.7, 0.6])
    cast = np.where(rng.random((20_000, 5)) < right, truth[:, None], ~truth[:, None]) + 1
    cast[rng.random((20_000, 5)) < 0.3] = 0
    patterns, where, counts = np.unique(cast, axis=0, return_inverse=True, return_counts=True)
    guess = estimated(patterns, counts.astype(float))[where.ravel()] > 0.5
    assert (guess == truth).mean() > 0.93


def prose(rnd, n):
    return " ".join(rnd.choice(COMMON["en"]) if rnd.random() < 0.4 else "".join(rnd.choice("aeioutnrs") for _ in range(6)) for _ in range(n)) + "."


def test_held_out_documents(spark):
    rnd = random.Random(3)

    def corpus(n):
        rows = []
        for k in range(n):
            text, junk = prose(rnd, rnd.randrange(30, 200)), rnd.random() < 0.2
            if junk:
                text = rnd.choice([lambda: " ".join(w + "$$$" for w in text.split()), lambda: " ".join(w.upper() + "!!" for w in text.split()), lambda: " | ".join(text.split())])()
            rows.append((k, text, junk))
        return rows

    rows = corpus(300) + [(900, None, True), (901, " \n", True), (902, "Short one.", False), (902, "Short one.", False)]
    df = spark.createDataFrame([(d, t, "x") for d, t, _ in rows], "doc_id long, text string, quality string")
    got = {r.doc.doc_id: r.kept for r in scored(df).collect()}
    assert np.mean([got[d] != junk for d, _, junk in rows]) > 0.97 and not got[900] and not got[901] and got[902]
    assert scored(df.limit(0)).count() == 0
    # Columns that bear the names of the results, and a text of a million words.
    wide = spark.createDataFrame([(1, prose(rnd, 100) + " more" * 1_000_000, 7, True, "d"), (2, prose(rnd, 100), 8, None, "e")], "doc_id long, text string, junk int, kept boolean, doc string")
    weights = np.zeros(BUCKETS + 1)
    assert sorted((r.doc.doc_id, r.doc.junk, r.doc.doc, r.kept, r.junk) for r in scored(wide, weights=weights).collect()) == [(1, 7, "d", True, 0.5), (2, 8, "e", True, 0.5)]


def test_agreement_with_labels(spark):
    """On the labelled documents, whose labels the model never sees: nearly all of quality 0 are rejected, all of quality 1 are kept."""
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r.doc_id: r.kept for r in scored(spark.read.parquet(f"{folder}/documents.parquet"), keep=["doc_id"]).select("doc.doc_id", "kept").collect()}
    by = [[kept[d] for d, q in labels.items() if q == x] for x in (0, 1)]
    assert 1 - np.mean(by[0]) > 0.93 and np.mean(by[1]) > 0.99
