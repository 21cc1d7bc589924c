import random
import re

import numpy as np

from graphloom.llm import near_dup
from graphloom.llm.near_dup import estimate, near_duplicates, registers, shingles


def brute(rows, percent=85):
    def of(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [of(t) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    low = {}
    for x, (doc, _) in zip(label, rows):
        low[x] = min(low.get(x, doc), doc)
    return {doc: (len(s), low[x], doc == low[x]) for (doc, _), s, x in zip(rows, sets, label)}


def corpus(seed=5):
    rnd, rows = random.Random(seed), []
    vocab = [f"w{k}" for k in range(300)]

    def edited(words, n):
        words = list(words)
        for _ in range(n):
            words[rnd.randrange(len(words))] = rnd.choice(vocab)
        return words

    for _ in range(12):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([3, 8, 60, 150]))]
        for _ in range(rnd.choice([1, 2, 30])):
            rows.append(" ".join(edited(base, rnd.choice([0, 1, 2, 4, 8]))))
    rows += ["", None, " \n", "One", "one", "ONE two", "a b c", "A b C"]
    rnd.shuffle(rows)
    return list(enumerate(rows))


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "LOOSE_BLOCK", 300)
    monkeypatch.setattr(near_dup, "PROBE_BLOCK", 700)
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, component_id int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert got == brute(rows)


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(4, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e F")], "doc_id long, text string")
    got = sorted(map(tuple, near_duplicates(df).collect()), key=str)
    assert got == sorted([(4, 2, 2, False), (4, 2, 2, False), (None, 2, None, True), (2, 2, 2, True)], key=str)
    assert near_duplicates(df.limit(0)).count() == 0


def test_estimates_are_close():
    rnd = np.random.default_rng(1)
    values = np.unique(rnd.integers(0, 1 << 63, 3000, dtype=np.uint64))
    for share in (0.5, 0.85, 0.95):
        a, b = values[: int(len(values) * (1 + share) / 2)], values[int(len(values) * (1 - share) / 2) :]
        equal = (registers(a) == registers(b)).mean()
        assert abs(estimate(equal, len(a), np.array(len(b))) - share) < 0.15


def test_short_texts():
    assert len(shingles(b"")) == 0 and len(shingles(b"a b")) == 1
    assert shingles(b"A b c d e")[0] == shingles(b"a B c d e")[0]
