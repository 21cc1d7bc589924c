import io
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm.library_tokens import WordwiseTokenizer
from graphloom.llm.token_counts import token_counts
from graphloom.llm.token_files import BadTokenFile, block, blocks, packed, read_token_files, unpacked, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
REAL, OWN = Tokenizer.from_file(PATH), WordwiseTokenizer(open(PATH).read())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="ab. \n\t'sé1 <|", max_size=40) | st.text(max_size=30), max_size=5))
def test_wordwise_equals_whole_texts(texts):
    texts = [*texts, None, "<|endoftext|> x", "a\n \nb", " a  b ", "it's 12\n\nYes we'll \x1c go"]
    got = [np.frombuffer(x, "<u4").tolist() for x in OWN.encode(texts)]
    assert got == [REAL.encode(t, add_special_tokens=False).ids if t else [] for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.sampled_from([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24])))
def test_code_round_trip(values):
    values = np.array(values, np.uint32)
    assert unpacked(*packed(values), len(values)).tolist() == values.tolist()


def test_blocks_and_damage():
    data = block([3, None], [2, 1], np.array([7, 70000, 2], np.uint32)) + block([9], [0], np.empty(0, np.uint32))
    got = [(d, n.tolist(), v.tolist()) for d, n, v in blocks(io.BytesIO(data))]
    assert got == [([3, None], [2, 1], [7, 70000, 2]), ([9], [0], [])]
    for bad in (data[:-2], b"x" + data, data[:60] + b"\xff" + data[61:]):
        with pytest.raises(BadTokenFile):
            list(blocks(io.BytesIO(bad)))


ROWS = [(7, "The cat sat."), (2, None), (5, "<|endoftext|>"), (5, "<|endoftext|>"), (None, "word " * 30_000), (1, "")]


def test_files_in_order(spark):
    df = spark.createDataFrame([(d, t, 1) for d, t in ROWS], "doc_id long, text string, start int").repartition(3)
    got = sorted(read_token_files(write_token_files(df, open(PATH).read(), 2)).collect(), key=lambda r: r.start)
    want, at = [], 0
    for d, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = (REAL.encode(t, add_special_tokens=False).ids if t else []) + [2]
        want.append((d, at, ids))
        at += len(ids)
    assert [(r.doc_id, r.start, np.frombuffer(r.token_ids, "<u4").tolist()) for r in got] == want
    assert read_token_files(write_token_files(df.limit(0), open(PATH).read(), 2)).count() == 0


def test_counts_across_blocks(spark):
    import tiktoken

    ranks = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    import base64

    real = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})
    rnd = random.Random(1)
    rows = ROWS + [(100 + k, " ".join(rnd.choice(["the", "cat", "é", ""]) for _ in range(rnd.randrange(30)))) for k in range(50)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_tokens int").repartition(3)
    want = sorted((str(d), len(real.encode_ordinary(t or ""))) for d, t in rows)
    for size in (5, 64, 0):
        assert sorted((str(r.doc_id), r.n_tokens) for r in token_counts(df, ranks, public_tokenizers.PATTERN, 50256, size).collect()) == want
    assert token_counts(df.limit(0), ranks, public_tokenizers.PATTERN, 50256).count() == 0
