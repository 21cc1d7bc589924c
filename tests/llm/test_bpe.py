import hashlib
from array import array

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm.bpe import PrefixBpe, bpe_round_trip

PATH = public_tokenizers.path("word_bpe_49k.json")
REAL = Tokenizer.from_file(PATH)
OWN = PrefixBpe(open(PATH).read())


def same(text):
    want = REAL.encode(text, add_special_tokens=False).ids
    assert OWN.encode(text) == want
    assert OWN.packed(text)[1].decode() == REAL.decode(want, skip_special_tokens=False)


def test_hand_picked():
    for text in ["", " ", "Hello, World! it's we'll", "x" * 300, "a\x1cb \x1d", "ΑΣ ΟΔΟΣ İstanbul", "é <|endoftext|>x<|startoftext|>", " a b\x85c", "日本語 🙂🙂 ½ ² 12345", "</w> the</w>", "don't 'S 'RE", "ﬁ Å̊", "\0 a\0b"]:
        same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="theonring'<|>s .,\n", max_size=60))
def test_wordlike_text(text):
    same(text)


def test_operator_with_nulls_and_extra_columns(spark):
    rows = [(1, "The cat.", "x"), (2, None, "y"), (2, None, "y"), (None, "", None), (5, "word " * 50_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    out = sorted(bpe_round_trip(df, open(PATH).read()).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [len(r.token_ids) // 4 for r in out] == [0, 3, 0, 0, 50_000]
    assert array("I", out[1].token_ids).tolist() == REAL.encode("The cat.", add_special_tokens=False).ids
    assert bpe_round_trip(df.limit(0), open(PATH).read()).count() == 0
