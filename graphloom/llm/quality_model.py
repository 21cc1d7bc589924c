"""A quality classifier without labels: heuristic labellers, their accuracies by expectation-maximisation, and a hashed linear scorer.

Each labeller votes junk, fine, or not at all, on one trait of a text. Votes overlap and conflict. Expectation-maximisation
over the counts of all vote patterns estimates how often each labeller gives each vote to junk and to fine texts, and from
these the probability that a pattern's texts are junk. With these soft labels a linear scorer is trained on hashed
features of a bounded sample of rows; it judges every row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import Remembered, materialised, nested, tuned

#: Common short words of four languages, and signs that prose seldom has.
STOP_WORDS = frozenset("the of and to in is that it on for with as by from this are was be at or an der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es de la le et les en un une du que qui dans pour est sur au par el y a los se del las por con una no".split())
SYMBOLS = b"#*$%&|<>{}[]\\^~=_@"
UPPER = bytes(range(65, 91))
#: Buckets of the hashed features, and rows of the training sample, at most about.
BUCKETS, SAMPLE_ROWS = 1 << 14, 6000
#: Rows whose probability of being junk is higher are rejected.
MOST_JUNK = 0.5
#: Bytes of a worker's memory of words' buckets, which ends with its task.
CACHE_BYTES = 48 << 20
#: Words of a window in which distinct words are counted.
WINDOW = 200


def diversity(words: list[str]) -> float:
    """The mean share of distinct words over consecutive windows of a text of at least one word.

    Windows are of one size, so the share doesn't fall with the length of the text; the last one ends with the text, and so may overlap the one before.
    """
    n = len(words)
    if n <= WINDOW:
        return len(set(words)) / n
    starts = [*range(0, n - WINDOW, WINDOW), n - WINDOW]
    return sum(len(set(words[k : k + WINDOW])) for k in starts) / (WINDOW * len(starts))


def traits(text: str) -> dict[str, float]:
    """What the labellers look at. text has at least one word."""
    raw, words = text.encode(), text.split()
    n, lines = max(1, len(words)), [x for x in text.split("\n") if x.strip()]
    letters = max(1, sum(map(len, words)))
    return {
        "words": n,
        "symbols": (len(raw) - len(raw.translate(None, SYMBOLS))) / letters,
        "upper": (len(raw) - len(raw.translate(None, UPPER))) / letters,
        "stops": sum(map(STOP_WORDS.__contains__, words)) / n,
        "length": letters / n,
        "shouts": raw.count(b"!") / n,
        "marks": sum(1 for w in words if len(w) == 1 and not w.isalnum()) / n,
        "packed": len(zlib.compress(raw, 1)) / len(raw) if len(raw) >= 400 else 0.5,
        "lines": 1 - len(set(lines)) / max(1, len(lines)),
        "kinds": diversity(words),
    }


def _vote(value: float, junk_above: float | None = None, fine_below: float | None = None, junk_below: float | None = None, fine_above: float | None = None) -> int:
    if (junk_above is not None and value > junk_above) or (junk_below is not None and value < junk_below):
        return 2
    return 1 if (fine_below is not None and value < fine_below) or (fine_above is not None and value > fine_above) else 0


def votes(t: dict[str, float]) -> tuple[int, ...]:
    """One vote from each labeller: 0 none, 1 fine, 2 junk."""
    long = t["words"] >= 20
    return (
        _vote(t["symbols"], junk_above=0.06, fine_below=0.01),
        _vote(t["upper"], junk_above=0.4, fine_below=0.12),
        _vote(t["stops"], junk_below=0.04, fine_above=0.12) if long else 0,
        _vote(t["shouts"], junk_above=0.2, fine_below=0.05),
        _vote(t["marks"], junk_above=0.15, fine_below=0.03),
        _vote(t["length"], junk_above=14, fine_below=9),
        _vote(t["packed"], junk_below=0.15, fine_above=0.3) if long else 0,
        _vote(t["lines"], junk_above=0.4, fine_below=0.1),
        _vote(t["kinds"], junk_below=0.25, fine_above=0.45) if long else 0,
    )


LABELLERS = 9


def estimated(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """The probability of junk for each vote pattern (rows of 0, 1, 2), by expectation-maximisation over all counts.

    It starts from the number of junk votes, since traits of junk are rare one by one and few texts have many. A labeller's share of each vote among junk and among fine texts is
    smoothed by one half; a labeller counts as better than chance, so a class can't change its meaning. No vote tells nothing.
    """
    junk = 1 / (1 + np.exp(2.0 - 3.0 * (patterns == 2).sum(axis=1)))
    for _ in range(rounds):
        log = np.log(np.clip(np.array([(counts * (1 - junk)).sum(), (counts * junk).sum()]) + 0.5, 1e-9, None))
        totals = np.tile(log - np.logaddexp(*log), (len(patterns), 1))
        for k in range(patterns.shape[1]):
            share = np.array([[(counts * w * (patterns[:, k] == v)).sum() + 0.5 for v in (1, 2)] for w in (1 - junk, junk)])
            share /= share.sum(axis=1, keepdims=True)
            if share[1, 1] < share[0, 1]:  # worse than chance: its votes say nothing
                share[:] = share.mean(axis=0)
            known = np.log(np.column_stack([np.ones(2), share]))  # no vote, as on short texts, is no evidence
            totals += known[:, patterns[:, k]].T
        new = np.exp(totals[:, 1] - np.logaddexp(totals[:, 0], totals[:, 1]))
        if np.abs(new - junk).max() < 1e-9:
            break
        junk = new
    return junk


_features = Remembered(CACHE_BYTES)


def _shape(word: str) -> str:
    """Characters by class, runs as one: Aa. for "Word.", a$ for "word$$$"."""
    out = []
    for c in word:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if out[-1:] != [kind]:
            out.append(kind)
    return "".join(out)


def hashed(text: str, t: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text's features: shares of word shapes and word ends, and each trait's grade."""
    words = text.split()
    found = list(map(_features.get, words))
    if None in found:
        for k, f in enumerate(found):
            if f is None:
                w = words[k]
                found[k] = f = zlib.crc32(b"s" + _shape(w).encode()) % BUCKETS, zlib.crc32(b"e" + w[-2:].lower().encode()) % BUCKETS
                _features.keep(w, f, 100)
    at, n = np.unique(np.array(found, np.int64), return_counts=True)
    grades = [zlib.crc32(f"{k}{int(np.floor(12 * np.sqrt(min(v, 4.0))))}".encode()) % BUCKETS for k, v in t.items() if k not in ("words", "length")]
    return np.concatenate([at, grades]), np.concatenate([n / len(words), np.full(len(grades), 0.25)])


def fitted(rows: list[tuple[np.ndarray, np.ndarray]], junk: np.ndarray, rounds: int = 300, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights, and the bias last, of a logistic scorer for soft labels, by full-batch gradient steps with momentum of both orders."""
    size = np.array([len(r[0]) for r in rows])
    row = np.repeat(np.arange(len(rows)), size)
    at, value = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
    w, m, v = (np.zeros(BUCKETS + 1) for _ in range(3))
    for step in range(1, rounds + 1):
        z = np.bincount(row, value * w[at], len(rows)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - junk) / len(rows)
        g = np.bincount(at, value * error[row], BUCKETS + 1) + decay * w / len(rows)
        g[-1] = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) / np.sqrt(step)
    return w


def _texts(column: pa.Array) -> list[str | None]:
    return [t if t and t.split() else None for t in column.to_pylist()]


def trained(documents: DataFrame, text: str = "text") -> np.ndarray:
    """The scorer's weights for a corpus. Vote patterns are counted over all rows; their number is bounded by the labellers'.

    The training sample is the rows whose hash falls below SAMPLE_ROWS over the number of rows.
    """
    spark = tuned(documents.sparkSession)
    rows = documents.select(F.xxhash64(text).alias("h"), F.col(text).alias("text"))

    def voted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["".join(map(str, votes(traits(t)))) if t else None for t in texts], pa.string())], names=["h", "votes"])

    cast = materialised(rows.mapInArrow(voted, "h long, votes string"), "model-votes").filter("votes is not null")
    counted = sorted((r["votes"], r["n"]) for r in cast.groupBy("votes").agg(F.count("*").alias("n")).collect())
    if not counted:
        return np.zeros(BUCKETS + 1)
    patterns = np.array([list(map(int, p)) for p, _ in counted])
    junk = estimated(patterns, np.array([n for _, n in counted], float))
    label = dict(zip((p for p, _ in counted), junk.tolist(), strict=True))
    total = sum(n for _, n in counted)
    below = F.pmod("h", F.lit(1 << 30)) < int(min(1.0, SAMPLE_ROWS / total) * (1 << 30))

    def featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forget()
            out = [(h, "".join(map(str, votes(t))), *hashed(x, t)) for h, x in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True) if x for t in [traits(x)]]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2].astype("<u2").tobytes() for o in out], pa.binary()), pa.array([o[3].astype("<f4").tobytes() for o in out], pa.binary())], names=["h", "votes", "at", "value"])

    # Copies share a hash: each text is sampled once.
    sample = rows.filter(below).mapInArrow(featured, "h long, votes string, at binary, value binary").dropDuplicates(["h"]).collect()
    sample.sort(key=lambda r: r["h"])
    if not sample:
        return np.zeros(BUCKETS + 1)
    return fitted([(np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["value"], "<f4").astype(float)) for r in sample], np.array([label[r["votes"]] for r in sample]))


def forget() -> None:
    _features.forget()


def scored(documents: DataFrame, text: str = "text", weights: np.ndarray | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """doc (a struct of the row's own columns, whatever their names, or of those to keep), junk (the scorer's probability) and kept, for each row.

    Texts without a word, and null ones, have no probability, and are rejected. Repeated rows get equal scores. A text of
    any length is judged as a whole, and an empty table gives an empty one. The scorer is trained on the same rows unless
    weights are given.
    """
    spark = tuned(documents.sparkSession)
    sent = spark.sparkContext.broadcast(trained(documents, text) if weights is None else weights)
    held = list(keep or documents.columns)
    place = held.index(text) if text in held else None
    rows = documents.select(nested(documents, held), *([F.col(text).alias("text")] if place is None else []))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        try:
            for batch in batches:
                junk = []
                for t in _texts(batch.column(1) if place is None else batch.column(0).field(place)):
                    if t is None:
                        junk.append(None)
                        continue
                    at, value = hashed(t, traits(t))
                    junk.append(float(1 / (1 + np.exp(-np.clip(value @ w[at] + w[-1], -30, 30)))))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(junk, pa.float64()), pa.array([j is not None and j <= MOST_JUNK for j in junk], pa.bool_())], names=["doc", "junk", "kept"])
        finally:
            forget()

    return rows.mapInArrow(run, T.StructType([rows.schema["doc"], T.StructField("junk", T.DoubleType()), T.StructField("kept", T.BooleanType())]))
