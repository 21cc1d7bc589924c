"""Whole texts through a public tokenizer library, with words that a worker has met before taken from memory."""

from __future__ import annotations

import gc
import os
import re
from array import array

import numpy as np

from graphloom.llm.common import ENTRY_BYTES, LONGEST_KEPT

#: Bytes of a worker's memory of words, at most about: when the younger half is full, it becomes the older one, and what was not used since is gone.
CACHE_BYTES = 256 << 20
#: New words that go to the library as one text.
TOGETHER = 20_000
#: Letters (of the scripts about whose classes all Unicode tables agree), then signs, then the same after a line feed. An apostrophe may begin a piece with letters, so it isn't among the signs.
_LETTERS, _SIGNS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+", r"[!-&(-/:-@\[-`{-~]+"
_built = re.compile(rf"({_LETTERS})({_SIGNS})?(?:\n({_LETTERS})({_SIGNS})?)?")


class WordwiseTokenizer:
    """A byte-level BPE of the tokenizers library: encode(texts) gives what the library gives for each whole text.

    Its pattern starts a piece at a single space between two characters that aren't white space, and no other piece of such
    words has a space. So the new words of a batch go to the library as one text, and each token that begins with a space
    begins the next word. Letters, signs and a line feed are pieces of their own, so words that consist of these are put
    together from parts, of which there are fewer. Texts with other arrangements of spaces, or a special token, go to the
    library whole.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        space = self.library.id_to_token(self.library.encode(" ", add_special_tokens=False).ids[0])
        names = self.library.get_vocab()
        self.begins = np.zeros(max(names.values()) + 1, bool)
        self.begins[[i for t, i in names.items() if t.startswith(space)]] = True
        #: Ids of words after a space, in two generations; False for what can't be taken apart.
        self.spaced: dict[str, bytes | bool] = {}
        self.older: dict[str, bytes | bool] = {}
        #: Ids of letters after a line feed, and of signs after letters.
        self.bare: dict[str, bytes] = {}
        self.signs: dict[str | None, bytes] = {None: b""}
        self.feed = self._whole(["\n"])[0]
        self.held = 0

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _sound(self, word: str) -> bool:
        """Whether no white space is at the word's ends, and no special token in it."""
        return word.isalpha() or bool(word) and not word[0].isspace() and not word[-1].isspace() and not any(s in word for s in self.special)

    def _after_spaces(self, words: list[str]) -> list[bytes]:
        """The ids of sound words, each after a space."""
        found: list[bytes] = []
        for at in range(0, len(words), TOGETHER):
            part = words[at : at + TOGETHER]
            ids = np.array(self.library.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) == len(part):
                data, cuts = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
                found += [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            else:
                found += self._whole([" " + w for w in part])
        return found

    def _learn(self, words: set[str]) -> None:
        """Brings words into the younger generation, from the older one or from the library."""
        older, table, bare, signs = self.older, self.spaced, self.bare, self.signs
        back = {w: older[w] for w in words if w in older} if older else {}
        table.update(back)
        need, plans, odd = {}, [], []
        for w in words.difference(back):
            if w.isalpha():
                need[w] = None
            elif (m := _built.fullmatch(w)) and not any(x in w for x in self.special):
                plans.append((w, m.groups()))
            elif self._sound(w):
                need[w] = None
            else:
                odd.append(w)
        for _, (stem, *_) in plans:
            if stem not in table:
                if stem in older:
                    table[stem] = older[stem]
                else:
                    need[stem] = None
        made = list(need)
        table.update(zip(made, self._after_spaces(made), strict=True))
        for known, new in ((bare, {x[2] for _, x in plans if x[2]}.difference(bare)), (signs, {y for _, x in plans for y in (x[1], x[3])}.difference(signs))):
            new = list(new)
            known.update(zip(new, self._whole(new), strict=True))
            self.held += ENTRY_BYTES * len(new)
        for w, (stem, after, second, last) in plans:
            table[w] = table[stem] + signs[after] + self.feed + bare[second] + signs[last] if second else table[stem] + signs[after]
        table.update(dict.fromkeys(odd, False))
        self.held += (ENTRY_BYTES + 60) * len(words)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers; null is an empty text."""
        # No cycles are made here; the collector would only walk through the many words, again and again.
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encoded(texts)
        finally:
            if collecting:
                gc.enable()

    def _encoded(self, texts: list[str | None]) -> list[bytes]:
        if self.held > CACHE_BYTES // 2:
            self.older, self.spaced, self.held = self.spaced, {}, 0
            self.bare, self.signs = {}, {None: b""}
        heads, tails, found = [], [], set()
        for t in texts:
            head, space, tail = t.partition(" ") if t else ("", "", "")
            words = tail.split(" ") if space else []
            heads.append(head)
            tails.append(words)
            found.update(words)
        new = found.difference(self.spaced)
        self._learn(new)
        whole = [k for k, h in enumerate(heads) if h and not self._sound(h)]
        first = self._whole(heads)
        known, out = self.spaced.__getitem__, []
        for k, (t, words) in enumerate(zip(texts, tails, strict=True)):
            try:
                out.append(first[k] + b"".join(map(known, words)))
            except TypeError:  # a word that can't be taken apart
                whole.append(k)
                out.append(b"")
            if not heads[k] and words:
                whole.append(k)
        for k in set(whole):
            out[k] = self._whole([texts[k]])[0]
        for w in [w for w in new if len(w) > LONGEST_KEPT]:
            del self.spaced[w]
        return out


_made: dict[int, tuple[str, WordwiseTokenizer]] = {}


def tokenizer(definition: str) -> WordwiseTokenizer:
    """This worker process's tokenizer."""
    key = hash(definition)
    if key not in _made or _made[key][0] != definition:
        _made.clear()
        _made[key] = definition, WordwiseTokenizer(definition)
    return _made[key][1]
