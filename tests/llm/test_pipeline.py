import hashlib
import random
from array import array

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm.mixing import mixed
from tests.llm.test_near_dup import brute
from tests.llm.test_quality_model import prose

REAL = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def corpus():
    rnd, rows = random.Random(11), []
    for k in range(150):
        text = prose(rnd, rnd.randrange(40, 200))
        rows.append((k, text, "en", f"s{k % 5}", len(text)))
        if k % 10 == 0:
            rows.append((1000 + k, text + " indeed", "en", "s0", len(text) + 7))
    rows += [(2000 + k, " ".join(w + "$$$" for w in prose(rnd, 100).split()), "en", "s1", 1) for k in range(25)]
    rows += [(3000, None, "en", "s1", 0), (3001, "", None, None, 0), (5, rows[5][1], "en", rows[5][3], rows[5][4]), (None, prose(rnd, 60), None, None, 9)]
    return rows


def test_every_stage_by_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    columns, found = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "").cache()
        found.append(docs.collect())
        assert docs.columns == columns or stage is corpus_pipeline.STAGES[-1][1], name
    ids = [[r.doc_id for r in f] for f in found]
    clean = {r[0] for r in rows if r[0] is not None and (r[0] < 2000)}
    assert len(clean - set(ids[0])) <= 2 and not {3000, 3001} & set(ids[0]) and len([i for i in ids[0] if i and 2000 <= i < 3000]) <= 1
    assert len(clean & set(ids[0]) - set(ids[1])) <= 2
    texts = sorted({(r.doc_id, r.text) for r in found[1] if r.doc_id is not None})
    want = brute([((d, t), t) for d, t in texts])
    assert sorted((r.doc_id, r.text) for r in found[2] if r.doc_id is not None) == sorted(d for d, (_, low, _) in want.items() if d[0] == low[0])
    assert (None in ids[1]) == (None in ids[2])
    size = lambda f: sum(len(r.text.split()) for r in f)
    by = {s: size([r for r in found[2] if r.source == s]) for s in {r.source for r in found[2]}}
    assert abs(size(found[3]) - 1.5 * size(found[2])) <= len(by)
    assert all(size([r for r in found[3] if r.source == s]) <= 2 * by[s] + 1 for s in by)
    encodings = sorted((str(r.doc_id), hashlib.sha256(array("I", REAL.encode(r.text, add_special_tokens=False).ids).tobytes()).hexdigest()) for r in found[3])
    assert sorted((str(r.doc_id), r.ids_sha256) for r in found[4]) == encodings


def test_run_on_files(spark, tmp_path):
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 100
    empty = tmp_path / "empty"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{empty}/documents.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_clashing_columns_and_shared_ids(spark):
    """Columns that bear the names of working columns pass through every stage; rows that share doc_id, source and size are served by what each was taken."""
    rows = [r for r in corpus()[:90]] + [(7000, "alpha beta gamma delta\n  epsilon", "en", "z", 30), (7000, "one two\tthree four\nfive", "en", "z", 22)]
    names = ["_kept", "_junk", "_same", "_size", "_at", "_taken", "kept", "junk", "row", "doc", "text_hash", "taken", "at", "size", "words", "of", "cut", "whole"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names)
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], schema).cache()
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == columns, name
        got = out.collect()
        assert got and all(tuple(r)[5:] == tuple(range(len(names))) for r in got), name
        if name == "source mix":
            taken = {}
            for r in mixed(docs).collect():
                taken[r.source] = taken.get(r.source, 0) + r.taken
            served = {}
            for r in got:
                served[r.source] = served.get(r.source, 0) + len((r.text or "").split())
                assert any(x[0] == r.doc_id and (x[1] or "").startswith(r.text) for x in rows)
                assert r.n_chars == len(r.text) or (r.text, r.n_chars) in {(x[1], x[4]) for x in rows}
            assert served == {s: t for s, t in taken.items() if t}
