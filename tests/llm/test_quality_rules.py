import math
import random
import re

from graphloom.llm.quality_rules import COMMON, counted, js_distance, references, with_quality


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside), n < 10 or 100 * len(inside) > 20 * n


def test_base_counts_by_brute_force(spark):
    rnd = random.Random(2)
    texts = [None, "", " \n\n \x0b", "é\xa0x # |", "a b c d e a b c d e", "x " * 40, "one\none\n one\n\none"]
    texts += [" ".join(rnd.choice("abcd") for _ in range(rnd.randrange(60))) for _ in range(60)]
    texts += ["\n".join(rnd.choice(["aa bb", "cc", "", " "]) for _ in range(9)) for _ in range(20)]
    df = spark.createDataFrame([(k, t, "en", 3) for k, t in enumerate(texts)], "doc_id long, text string, lang string, n_words int")
    for r in with_quality(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc.doc_id]), texts[r.doc.doc_id]
        assert not (r.base_failed and r.kept)


def prose(rnd, n, lang="en"):
    return " ".join(rnd.choice(COMMON[lang]) if rnd.random() < 0.4 else "".join(rnd.choice("aeioutnrs") for _ in range(6)) for _ in range(n))


def test_divergent_documents_are_rejected(spark):
    rnd = random.Random(7)
    good = [(k, prose(rnd, rnd.randrange(30, 400)), "en") for k in range(60)]
    bad = [(100, " ".join(f"{w}$$$" for w in prose(rnd, 200).split()), "en"), (101, prose(rnd, 200).upper(), "en"), (102, " ".join("qzx%d" % k for k in range(200)), "en")]
    other = [(200, "1 2 3 4 5 6 7 8 9 10 11 12", None), (201, prose(rnd, 9), "en"), (202, prose(rnd, 50), "xx")]
    df = spark.createDataFrame(good + bad + other, "doc_id long, text string, lang string")
    kept = {r.doc.doc_id for r in with_quality(df).filter("kept").collect()}
    assert {d for d, *_ in good} <= kept and not kept & {100, 101, 102, 201} and {200, 202} <= kept
    assert with_quality(df.limit(0)).count() == 0 and references(counted(df.limit(0))) == {}


def test_distance(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(js_distance([F.lit(0.5), F.lit(0.5)], [0.5, 0.5]).alias("same"), js_distance([F.lit(1.0), F.lit(0.0)], [0.25, 0.75]).alias("far")).first()
    want = math.sqrt((math.log2(1 / 0.625) + 0.25 * math.log2(0.25 / 0.625) + 0.75 * math.log2(2)) / 2)
    assert row.same == 0 and abs(row.far - want) < 1e-12


def test_verdicts_by_brute_force(spark):
    """kept, recomputed in Python from histograms, exact medians and Jensen-Shannon distances, over columns that bear working names; one text is long."""
    import statistics
    import unicodedata

    from graphloom.llm import quality_rules as q

    rnd = random.Random(5)
    rows = [(k, prose(rnd, rnd.randrange(5, 300), lang), lang) for k, lang in enumerate(["en", "de", "fr", "es"] * 15)]
    rows += [(100 + k, " ".join(w + rnd.choice(["", "$", "9", "X", "\u00bf"]) for w in prose(rnd, 150).split()), rnd.choice(["en", "fr", None, "xx"])) for k in range(30)]
    rows += [(200, "word %s " * 20_000 % tuple(range(20_000)), "en"), (201, None, "en"), (202, prose(rnd, 100), None), (202, prose(rnd, 100), None)]
    df = spark.createDataFrame([(d, t, g, True, 1, 2.0, "w") for d, t, g in rows], "doc_id long, text string, lang string, kept boolean, of int, js_class double, words string")

    def shares(t, g):
        n = [0] * 6
        for c in t:
            kind = unicodedata.category(c)
            n[0 if kind == "Lu" else 1 if kind[0] == "L" else 2 if kind[0] == "N" else 3 if c in " \t\n\x0b\x0c\r" else 4 if c in q.SYMBOLS else 5] += 1
        words = t.split()
        common = [words.count(w) for w in q.COMMON.get(g, [])]
        return [x / len(t) for x in n] if len(t) >= q.LEAST_CHARS_CLASS else None, [x / len(words) for x in [*common, len(words) - sum(common)]] if common and len(words) >= q.LEAST_WORDS_COMMON else None

    def distance(p, r):
        part = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x > 0)
        return math.sqrt(max(0, (part(p, r) + part(r, p)) / 2))

    medians = {}
    for kind in (0, 1):
        for g in ("en", "de", "fr", "es", ""):
            of = [s for d, t, h in rows if t and len(t.split()) >= 10 and (h if h in q.COMMON else "") == g and (s := shares(t, h)[kind])]
            if of:
                middle = [max(statistics.median(round(x[k], q.DECIMALS) for x in of), q.FLOOR) for k in range(len(of[0]))]
                medians[kind, g] = [m / sum(middle) for m in middle]
    want = {}
    for d, t, g in rows:
        far = [distance(s, medians[k, g if g in q.COMMON else ""]) if (s := shares(t or "", g)[k]) else 0.0 for k in (0, 1)]
        want.setdefault(d, []).append((not base(t)[-1] and far[0] <= q.MOST_CLASS and far[1] <= q.MOST_COMMON, min(abs(far[0] - q.MOST_CLASS), abs(far[1] - q.MOST_COMMON))))
    got = {}
    for r in with_quality(df).collect():
        assert r.doc["kept"] is True and r.doc["of"] == 1
        got.setdefault(r.doc.doc_id, []).append(r.kept)
    assert all(sorted(got[d]) == sorted(k for k, _ in w) for d, w in want.items() if min(m for _, m in w) > 1e-3)
    assert {k for w in want.values() for k, _ in w} == {True, False}
