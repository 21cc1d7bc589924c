"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue that serves its documents in a shuffled order, and once more from the start. Serving a document
ends at its virtual finish time: the source's words up to and including it, divided by the source's weight. The mix is the
order of virtual finish times over all sources, truncated at the total budget: this cut alone decides what is taken. A queue
that has served all its documents twice ends, and those left share the rest by weight.

At the cut each queue has one document half served. Those are served in packets with finish times of their own, single
words near the cut, so that a long document doesn't push its source off its target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialised, n_words, running_total

#: Times that a document may be taken.
REPEATS = 2
#: Words of a source before and after its share by weight that are served one by one: the cut falls within a few words of there.
NEAR = 16


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float) -> DataFrame:
    """source, source_size, before (words of the sources ahead of it in code point order), weight, target, due, for each source of (source, size).

    Sources by code point, null last, take the weights in turn. Targets add up to share times all sizes; none exceeds
    REPEATS times its source, and what that cuts off goes to the others by weight, until no target is above. due is the
    share by weight alone, at the level that the others reach; null if no source is left to reach one.
    """
    sums = materialised(sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1)), "mix-sources")
    order = [F.col("source").isNull(), F.col("source")]
    ranked = running_total(running_total(sums, order, "one", "rank", "mix-rank"), order, "source_size", "before", "mix-before")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * REPEATS
    ranked = materialised(ranked.select("source", "source_size", "before", weight.cast("double").alias("weight"), cap.cast("double").alias("cap")), "mix-weighted")
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first()["t"]
    # Sources whose caps are below the level's share stay at them; the level rises for the others, as long as any joins them.
    budget, level, capped = min(share, REPEATS) * total, -1.0, -1
    while True:
        full = F.col("cap") <= level * F.col("weight")
        x = ranked.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("kept"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"), F.count(F.when(full, 1)).alias("n")).first()
        if x["n"] == capped or not x["open"]:
            break
        capped, level = x["n"], (budget - x["kept"]) / x["open"]
    target = F.when(full, F.col("cap")).otherwise(level * F.col("weight")) if x["open"] else F.col("cap")
    due = level * F.col("weight") if x["open"] else F.lit(None).cast("double")
    return materialised(ranked.select("source", "source_size", "before", "weight", target.alias("target"), due.alias("due")), "mix-targets")


def mixed(documents: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, seed: int = 17, row: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies, mix_at for each document; with row, that column of unique longs too.

    taken counts the words that the mix takes, repeats included; copies is in how many servings, the last perhaps in part;
    mix_at is the mix position of its first word (null if none is taken). The shuffle is a hash of id and text, so reruns
    agree; equal rows are served one after the other. Null texts have size 0, and are never taken; a null source is a source
    of its own; a text may be of any length; an empty table gives an empty mix; other columns are not read.
    """
    own = F.monotonically_increasing_id() if row is None else F.col(row)
    sizes = documents.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", F.col("text").cast("binary")).alias("shuffled"), own.alias("row"))
    sizes = materialised(sizes, "mix-sizes")
    targets = source_targets(sizes, weights, share)
    order: list[Column] = [F.col("source").isNull(), F.col("source"), F.col("shuffled"), F.col("doc_id"), F.col("row")]
    queued = running_total(sizes, order, "size", "ahead", "mix-queued")
    queued = queued.join(spread(targets), [F.col("source").eqNullSafe(F.col("t_source")), part_of(F.col("shuffled")) == F.col("part")], "left").drop("t_source", "part")
    queued = materialised(queued.withColumn("ahead", F.col("ahead") - F.col("before")).drop("before"), "mix-documents")
    serving = queued.filter("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))))
    serving = serving.select("row", "epoch", "shuffled", "doc_id", "size", "weight", (F.col("epoch") * F.col("source_size") + F.col("ahead")).alias("begin"), "due")
    # The places where packets begin: the document's start, and each word near its source's share.
    low = F.greatest(F.lit(1).cast("long"), F.floor(F.col("due") - F.col("begin")).cast("long") - NEAR)
    high = F.least(F.col("size") - 1, F.ceil(F.col("due") - F.col("begin")).cast("long") + NEAR)
    zero = F.array(F.lit(0).cast("long"))
    starts = F.when(F.coalesce(low <= high, F.lit(False)), F.concat(zero, F.sequence(low, high))).otherwise(zero)
    serving = serving.withColumn("starts", starts).select("*", F.posexplode("starts").alias("k", "start"))
    words = F.coalesce(F.get("starts", F.col("k") + 1), F.col("size")) - F.col("start")
    # Half a word off, so that the cut rounds a source's share to the nearest word, not down.
    finish = (F.col("begin") + F.col("start") + words - F.lit(0.5)) / F.col("weight")
    serving = serving.select("row", "epoch", "start", "shuffled", "doc_id", finish.alias("finish"), words.alias("words"))
    line = running_total(serving, [F.col("finish"), F.col("shuffled"), F.col("doc_id"), F.col("row"), F.col("epoch"), F.col("start")], "words", "at", "mix-line")
    budget = round(targets.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("b")).first()["b"])
    taken = line.filter(F.col("at") < budget).withColumn("words", F.least(F.col("words"), F.lit(budget) - F.col("at")))
    taken = taken.groupBy("row").agg(F.sum("words").alias("words"), F.count(F.when(F.col("start") == 0, 1)).alias("n"), F.min("at").alias("mix_at"))
    out = queued.join(taken, "row", "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"), F.coalesce("n", F.lit(0)).cast("int").alias("copies"), "mix_at", *([F.col("row").alias(row)] if row else []))


#: Parts into which each source's documents fall for the lookup of its target, however many it has.
PARTS = 64


def part_of(shuffled: Column) -> Column:
    return F.pmod(shuffled, F.lit(PARTS)).cast("int")


def spread(targets: DataFrame) -> DataFrame:
    return targets.select(F.col("source").alias("t_source"), "source_size", "before", "weight", "target", "due", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
