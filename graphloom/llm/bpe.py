"""BPE encoding by dynamic programming over prefixes, and decoding.

A sequence of tokens is what the merge procedure makes of a word if and only if each token, and each pair of neighbours,
is what the procedure makes of its own characters. So every prefix of a word has one last token: among the vocabulary
tokens that end there (matches of an automaton with suffix links), the one that is compatible with the last token of the
prefix before it. Following the last tokens back from the end of the word gives the ids; no merge is ever replayed on a text.
"""

from __future__ import annotations

import json
import unicodedata
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Remembered, arrow_rows, uncollected

#: Stands for the end of a word inside token strings.
END = "\0"
#: Bytes of a worker's memory of words, which ends with its task, and entries of its memory of pairs of tokens; full, they are emptied.
CACHE_BYTES, PAIRS = 96 << 20, 300_000

#: Unicode's white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Signs that end a word and are a piece of their own after letters, under any pattern of letters, numbers and others.
STOPS = (",", ".", ";", ":", "!", "?")
#: str.split() takes these for white space; the tokenizer doesn't.
SEPARATORS = "\x1c\x1d\x1e\x1f"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable Latin-1, else the next one from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


#: Characters that the regex module's newer tables call letters or numbers, and the tokenizer's don't.
NEWER = [(0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F)]
_newer = dict.fromkeys((c for a, b in NEWER for c in range(a, b + 1)), "\xa1")


def stand_ins(text: str) -> str:
    """The text with a sign in place of each newer letter, for the splitting pattern."""
    return text if text.isascii() else text.translate(_newer)


class PrefixBpe:
    """Encoder and decoder for a byte-level BPE with an end-of-word mark, from its tokenizer file (JSON).

    Handles normalisation to NFC, white space and lower case, a splitting pattern, and special tokens, as that file asks.
    """

    def __init__(self, definition: str):
        import ahocorasick
        import regex

        spec = json.loads(definition)
        model, self.suffix = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        self.names: dict[int, str] = {i: t for t, i in model["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {self._inner(t): i for t, i in model["vocab"].items()}
        self.strings = {i: t for t, i in self.tokens.items()}
        self.rank = {tuple(map(self._inner, pair if isinstance(pair, list) else pair.split(" "))): n for n, pair in enumerate(model["merges"])}
        self.letters = dict(enumerate(byte_alphabet()))
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern.replace(r"\s", WHITE))
        self.around = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.automaton = ahocorasick.Automaton()
        for text, token in self.tokens.items():
            self.automaton.add_word(text, (token, len(text)))
        self.automaton.make_automaton()
        self._pairs: dict[int, bool] = {}
        self._alone: dict[int, bool] = {}
        self._chunks: Remembered = Remembered(CACHE_BYTES)

    def _inner(self, token: str) -> str:
        return token[: -len(self.suffix)] + END if self.suffix and token.endswith(self.suffix) else token

    @staticmethod
    def _symbols(text: str) -> list[str]:
        out = list(text)
        if out[-1:] == [END]:
            out[-2:] = [out[-2] + END]
        return out

    def merged(self, symbols: list[str]) -> list[str]:
        """The merge procedure itself: the leftmost pair of least rank first. Only for the strings of one or two tokens."""
        symbols = list(symbols)
        while True:
            best = min(((self.rank[p], k) for k, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in self.rank), default=None)
            if best is None:
                return symbols
            k = best[1]
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]

    def stands(self, token: int) -> bool:
        """Whether the token's own characters encode to it."""
        known = self._alone.get(token)
        if known is None:
            known = self._alone[token] = self.merged(self._symbols(self.strings[token])) == [self.strings[token]]
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether the characters of the two tokens encode to just these two."""
        known = self._pairs.get(left << 32 | right)
        if known is None:
            a, b = self.strings[left], self.strings[right]
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            known = self._pairs[left << 32 | right] = self.merged(self._symbols(a) + self._symbols(b)) == [a, b]
        return known

    def word(self, piece: str) -> list[int]:
        """Ids of one piece of text, in which no pattern boundary falls."""
        text = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)
        if self.suffix:
            text += END
        whole = self.tokens.get(text)
        if whole is not None and self.stands(whole):
            return [whole]
        size, pairs, alone = len(text), self._pairs, self._alone
        last, length = [-1] * (size + 1), [0] * (size + 1)
        for end, (token, n) in self.automaton.iter(text):
            at = end + 1
            if last[at] >= 0:
                continue
            if n == at:
                if not (alone[token] if token in alone else self.stands(token)):
                    continue
            else:
                before = last[at - n]
                if before < 0:
                    continue
                fits = pairs.get(before << 32 | token)
                if not (self.compatible(before, token) if fits is None else fits):
                    continue
            last[at], length[at] = token, n
        ids, at = [], size
        while at:
            ids.append(last[at])
            at -= length[at]
        ids.reverse()
        return ids

    def _plain(self, text: str) -> list[int]:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = "".join(c.lower() for c in text) if "\u03a3" in text else text.lower()  # the tokenizer lowers a capital sigma alike everywhere
        if text.isalpha():
            return self.word(text)
        if text[-1:] in STOPS and text[:-1].isalpha():
            return self.word(text[:-1]) + self.word(text[-1])
        ids: list[int] = []
        for piece in self.pieces.finditer(stand_ins(text)):
            ids += self.word(text[piece.start() : piece.end()])
        return ids

    def chunk(self, text: str) -> tuple[bytes, bytes, int]:
        """Packed ids, decoded UTF-8 and number of tokens of a text without white space inside words; cached."""
        known = self._chunks.get(text)
        if known is None:
            ids: list[int] = []
            if any(x in text for x in self.special):
                for part in self.around.split(text):
                    ids += [self.special[part]] if part in self.special else self._plain(part)
            else:
                ids = self._plain(text)
            known = array("I", ids).tobytes(), self.decode(ids).encode(), len(ids)
            self._chunks.keep(text, known, len(known[0]) + len(known[1]))
        return known

    def forget(self) -> None:
        self._chunks.forget()

    def packed(self, text: str | None) -> tuple[bytes, bytes]:
        """Ids as little-endian unsigned 32-bit integers, and their decoded text in UTF-8. Null is an empty text.

        White space separates pieces, is never part of one, and neither composition nor special tokens reach across it:
        so the words between can be encoded, and remembered, one by one.
        """
        if not text:
            return b"", b""
        words = text.split(" ") if any(c in text for c in SEPARATORS) else text.split()
        done = [x for x in map(self._chunks.get, words)]
        if None in done:
            done = [self.chunk(w) if x is None else x for w, x in zip(words, done, strict=True)]
        return b"".join([x[0] for x in done]), b" ".join([x[1] for x in done if x[2]])

    def encode(self, text: str | None) -> list[int]:
        return array("I", self.packed(text)[0]).tolist()

    def decode(self, ids) -> str:
        """The tokens' strings, one space between; special tokens are kept. The tokenizer file names no decoder, so byte letters and word ends stay as they are."""
        return " ".join([self.names[i] for i in ids])


_made: dict[int, tuple[str, PrefixBpe]] = {}


def coder(definition: str) -> PrefixBpe:
    """This worker process's coder, with the words it knows already."""
    key = hash(definition)
    if key not in _made or _made[key][0] != definition:
        _made.clear()
        _made[key] = definition, PrefixBpe(definition)
    return _made[key][1]


def forget() -> None:
    for _, bpe in _made.values():
        bpe.forget()


def bpe_round_trip(df: DataFrame, definition: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row's text encoded and decoded again: id, token_ids (binary, little-endian unsigned 32-bit), decoded (text).

    definition is the content of a tokenizer file, of bounded size; each worker gets it by broadcast. Null and empty texts
    give no tokens; repeated rows give repeated rows; an empty table gives an empty one; other columns are not read. A text may
    be of any length, and so may a word: it takes memory in proportion to its length, and is not remembered.
    """
    sent = df.sparkSession.sparkContext.broadcast(definition)
    kind = df.schema[id_column].dataType.simpleString()

    def make(columns: dict[str, pa.Array]):
        bpe = coder(sent.value)
        with uncollected():
            done = [bpe.packed(t) for t in columns["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([columns["id"], pa.array([d[0] for d in done], pa.binary()), pa.array([d[1].decode() for d in done], pa.string())], names=[id_column, "token_ids", "decoded"])

    return arrow_rows(df, [F.col(id_column).alias("id"), F.col(text_column).alias("text")], make, f"`{id_column}` {kind}, token_ids binary, decoded string", after=forget)
