"""Near-duplicate documents by HyperMinHash sketches, banding, and exact confirmation.

A document's set is its distinct 5-word shingles. For each register the least value of a hash over the set is kept, as its
count of leading zeros and the mantissa bits after the first one: 16 bits in place of 64. Bands of registers find
candidates, the share of equal registers, corrected for chance collisions, estimates their similarity, and whoever passes
is compared on the full sets.

Links need not be listed pair by pair. Documents with equal sets form one class. In a bucket every class is compared with
the bucket's first class (a star). Who was linked is contracted to a component; only classes outside the component of
their bucket's first class are then compared with the rest of the bucket, in blocks of bounded size, inside tasks.
A hot bucket of true copies costs one comparison for each member; no pairs are emitted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Remembered, arrow_rows, materialised, partitions_for, tuned
from graphloom.llm.components import components

SHINGLE = 5
#: 30 bands of 5 registers miss a pair at similarity 0.85 once in 40 million times.
BANDS, ROWS = 30, 5
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Standard deviations below the threshold at which an estimate still leads to a comparison of full sets.
MARGIN = 6.0
#: Shingles of one block of a bucket's outsiders, and of the members that they are compared with.
LOOSE_BLOCK, PROBE_BLOCK = 100_000, 400_000
#: Bytes of a worker's memory of word hashes, which ends with its task.
CACHE_BYTES = 32 << 20

_rng = np.random.default_rng(20240607)
_MUL = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_words = Remembered(CACHE_BYTES)


def forget() -> None:
    _words.forget()


def _word_hashes(words: list[bytes]) -> np.ndarray:
    found = list(map(_words.get, words))
    if None in found:
        for k, h in enumerate(found):
            if h is None:
                found[k] = h = int.from_bytes(hashlib.blake2b(words[k], digest_size=8).digest(), "little")
                _words.keep(words[k], h)
    return np.array(found, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's 5-word shingles: A-Z lower-cased, words split at ASCII white space.

    A text of fewer words is one shingle; a text without words, or null, has none.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = _word_hashes(words)
    n = min(SHINGLE, len(words))
    out = np.full(len(words) - n + 1, np.uint64(n))
    for k in range(n):
        out = out * _STEP + h[k : len(words) - n + 1 + k]
    return np.unique(_mixed(out))


def registers(values: np.ndarray) -> np.ndarray:
    """The HyperMinHash sketch of a set: uint16 for each register, leading zeros above mantissa bits."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max)
    for at in range(0, len(values), 2048):
        part = values[at : at + 2048, None] * _MUL
        part += _ADD
        np.minimum(least, part.min(axis=0), out=least)
    zeros = np.minimum(64 - np.frexp(least.astype(np.float64))[1], 63).clip(0).astype(np.uint64)
    mantissa = (least << zeros << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return (zeros << np.uint64(MANTISSA) | mantissa).astype(np.uint16)


def estimate(equal: np.ndarray, n: int, m: np.ndarray) -> np.ndarray:
    """Similarity of sets of n and m members of whose registers the share `equal` agrees.

    Different least values collide in a register with a chance of about 0.7213 nm/(n+m)^2 in 2^MANTISSA: the mean width of
    a cell, against the densities of the two least values.
    """
    chance = 0.7213 * n * m / (n + m) ** 2 / (1 << MANTISSA)
    return (equal - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    j = percent / 100
    return j - MARGIN * (j * (1 - j) / REGISTERS) ** 0.5


def _sketches(columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    ids, sizes, prints, regs, bands = [], [], [], [], []
    tag = np.arange(BANDS, dtype=np.uint64) * _STEP
    for doc, text in zip(columns["doc_id"].to_pylist(), columns["text"].to_pylist(), strict=True):
        values = shingles(text)
        ids.append(doc)
        sizes.append(len(values))
        if len(values) and doc is not None:
            r = registers(values)
            keys = tag
            for k in range(ROWS):
                keys = _mixed(keys * _STEP + r[k::ROWS].astype(np.uint64) + np.uint64(1))
            prints.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
            regs.append(r.tobytes())
            bands.append(keys.view(np.int64))
        else:
            prints.append(None)
            regs.append(None)
            bands.append(None)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), columns["text_hash"], pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(regs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "n", "fp", "regs", "bands"])


def _overlap(values: np.ndarray, other: np.ndarray) -> int:
    if len(other) > len(values):
        values, other = other, values
    at = np.searchsorted(values, other)
    at[at == len(values)] = 0
    return int((values[at] == other).sum())


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 |a & b| >= percent |a | b|."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = _overlap(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def near_duplicates(documents: DataFrame, percent: int = 85, label: str = "near", hashes: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach), kept (doc_id = component_id) for each row; with hashes, also text_hash, xxhash64 of the text.

    Null and empty texts have no shingles and link with nothing. Rows with a null doc_id link with nothing, have a null
    component and are kept. Repeated rows have equal sets, so they share a component. Other columns are not read.
    """
    spark = tuned(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    sketched = materialised(arrow_rows(docs, [F.col("doc_id"), F.col("text"), F.xxhash64("text").alias("text_hash")], _sketches, "doc_id long, text_hash long, n long, fp binary, regs binary, bands array<long>", after=forget), f"{label}-sketch")
    classes = materialised(sketched.filter("fp is not null").groupBy("fp").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.count("*").alias("copies"), F.first(F.struct("n", "regs", "bands")).alias("of")).select("fp", F.col("least.doc_id").alias("low"), F.col("least.text_hash").alias("text_hash"), "copies", "of.*"), f"{label}-classes")

    def rows() -> DataFrame:
        return classes.select("fp", "low", "text_hash", "n", F.explode("bands").alias("key"))

    buckets = materialised(rows().groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("low", "fp")).alias("first")).filter("c > 1").select("key", "c", F.col("first.fp").alias("first")), f"{label}-buckets")
    members = materialised(rows().join(buckets, "key"), f"{label}-members")
    # Texts of all classes that share a bucket with another. Rows with one doc_id may differ in text.
    wanted = members.select("fp", F.col("low").alias("doc_id"), "text_hash").distinct()
    texts = docs.withColumn("text_hash", F.xxhash64("text")).join(wanted, ["doc_id", "text_hash"]).select("fp", "text")
    texts = materialised(classes.select("fp", "n", "regs").join(texts, "fp").dropDuplicates(["fp"]), f"{label}-texts")

    stars = materialised(members.filter("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b")).distinct(), f"{label}-stars")
    sides = [texts.select(F.col("fp").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "regs"))) for x in "ab"]
    likely = materialised(stars.join(sides[0], "a").join(sides[1], "b").filter(_passes(percent)).select("a", "b"), f"{label}-likely")
    checked = likely.join(texts.select(F.col("fp").alias("a"), F.col("text").alias("text_a")), "a")
    checked = materialised(checked, f"{label}-left").join(texts.select(F.col("fp").alias("b"), F.col("text").alias("text_b")), "b")
    links = materialised(arrow_rows(checked, [F.col(c) for c in ("a", "b", "text_a", "text_b")], lambda c: _confirmed(c, percent), "a binary, b binary", after=forget), f"{label}-links")
    joined = components(links, f"{label}-first")

    # Buckets of three or more in which some class is outside the first one's component.
    known = members.filter("c > 2").join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", "n", "first", F.coalesce("root", "fp").alias("own"))
    known = materialised(known, f"{label}-known")
    lead = known.filter("fp = first").select("key", F.col("own").alias("lead"))
    known = materialised(known.join(lead, "key").select("key", "fp", "n", "own", (F.col("own") != F.col("lead")).alias("loose")), f"{label}-sides")
    blocks = known.groupBy("key").agg(F.sum(F.when(F.col("loose"), F.col("n")).otherwise(0)).alias("loose_n"), F.sum("n").alias("all_n")).filter("loose_n > 0")
    blocks = materialised(blocks.select("key", F.ceil(F.col("loose_n") / LOOSE_BLOCK).cast("int").alias("nb"), F.ceil(F.col("all_n") / PROBE_BLOCK).cast("int").alias("np")), f"{label}-blocks")
    open_ = known.join(blocks, "key")
    j, p = F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int"), F.pmod(F.xxhash64("fp", F.lit(1)), F.col("np")).cast("int")
    dealt = open_.select("key", "fp", "own", F.col("loose"), F.explode(F.when(F.col("loose"), F.concat(
        F.transform(F.sequence(F.lit(0), F.col("np") - 1), lambda x: F.struct(j.alias("j"), x.alias("p"), F.lit(True).alias("anchor"))),
        F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda x: F.struct(x.alias("j"), p.alias("p"), F.lit(False).alias("anchor"))),
    )).otherwise(F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda x: F.struct(x.alias("j"), p.alias("p"), F.lit(False).alias("anchor"))))).alias("at")).select("key", "fp", "own", "at.*")
    full = materialised(dealt, f"{label}-dealt").join(texts.select("fp", "regs", "text"), "fp").withColumn("group", F.struct("key", "j", "p"))
    full = full.repartition(partitions_for(full), "key", "j", "p").sortWithinPartitions("key", "j", "p", F.desc("anchor"))
    more = materialised(full.select("key", "j", "p", "anchor", "fp", "own", "regs", "text").mapInArrow(lambda batches: _blocks(batches, percent), "a binary, b binary"), f"{label}-more")
    again = components(more, f"{label}-second")

    # The component of each class, as its least doc_id.
    roots = joined.select(F.col("node").alias("fp"), F.col("root").alias("own")).join(again.select(F.col("node").alias("own"), F.col("root").alias("top")), "own", "left").select("fp", F.coalesce("top", "own").alias("top"))
    roots = materialised(roots.union(again.join(joined, "node", "left_anti").select(F.col("node").alias("fp"), F.col("root").alias("top"))), f"{label}-roots")
    placed = materialised(classes.select("fp", "low", "copies").join(roots, "fp", "left"), f"{label}-placed")
    lowest = placed.filter("top is not null").groupBy("top").agg(F.min("low").alias("component"))
    group = materialised(placed.filter("top is not null or copies > 1").join(materialised(lowest, f"{label}-lowest"), "top", "left").select("fp", F.coalesce("component", "low").alias("component")), f"{label}-groups")
    out = sketched.select("doc_id", "text_hash", "n", "fp").join(group, "fp", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), *["text_hash"] * hashes)


def _passes(percent: int):
    """Sizes that allow the similarity, and an estimate that doesn't rule it out, over n_a, n_b, regs_a, regs_b.

    Registers are compared two bytes at a time, inside the JVM.
    """
    equal = F.aggregate(F.sequence(F.lit(0), F.lit(REGISTERS - 1)), F.lit(0), lambda s, k: s + (F.substring(F.col("regs_a"), 2 * k + 1, F.lit(2)) == F.substring(F.col("regs_b"), 2 * k + 1, F.lit(2))).cast("int"))
    chance = F.lit(0.7213 / (1 << MANTISSA)) * F.col("n_a") * F.col("n_b") / F.pow(F.col("n_a") + F.col("n_b"), F.lit(2))
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return sizes & ((equal / F.lit(float(REGISTERS)) - chance) / (1 - chance) >= least_estimate(percent))


def _confirmed(columns: dict[str, pa.Array], percent: int) -> Iterator[pa.RecordBatch]:
    found = []
    for a, b, x, y in zip(*(columns[c].to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
        if linked(shingles(x), shingles(y), percent):
            found.append((a, b))
    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary())], names=["a", "b"])


def _blocks(batches, percent: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows of many groups; each group's anchors come first and are compared with all of its rows."""
    group, anchors, merged = None, [], {}

    def top(x: bytes) -> bytes:
        while merged.get(x, x) != x:
            merged[x] = merged.get(merged[x], merged[x])
            x = merged[x]
        return x

    floor = least_estimate(percent)
    for batch in batches:
        links = []
        for key, j, p, anchor, fp, own, regs, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (key, j, p) != group:
                group, anchors, merged = (key, j, p), [], {}
                stacked = None
            r = np.frombuffer(regs, np.uint16)
            if anchor:
                anchors.append((own, r, shingles(text)))
                stacked = None
                continue
            if not anchors:
                continue
            if stacked is None:
                stacked, sizes = np.stack([a[1] for a in anchors]), np.array([len(a[2]) for a in anchors])
            values = None
            equal = stacked == r
            share = equal.mean(axis=1)
            for k in np.flatnonzero(share >= floor):
                mine, theirs = top(own), top(anchors[k][0])
                if mine == theirs:
                    continue
                if values is None:
                    values = shingles(text)
                if estimate(share[k], len(values), sizes[k]) >= floor and linked(anchors[k][2], values, percent):
                    merged[max(mine, theirs)] = min(mine, theirs)
                    links.append((own, anchors[k][0]))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.binary()), pa.array([x[1] for x in links], pa.binary())], names=["a", "b"])
