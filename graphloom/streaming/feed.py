"""Ingest of append-only JSON lines, in batches or as a stream, with a dead-letter table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import redactions, scrubbed
from graphloom.operators.records import FIELDS, FIRST_MS, KINDS, LAST_MS, record_id
from graphloom.sources.delta import appended_version, read_version
from graphloom.storage import written

LINE = "v int, kind string, author string, timestamp_ms long, content string, anchor string, thread string, parent string, _bad string"


def parsed(lines: DataFrame) -> DataFrame:
    """lines (value, path) with the record's fields, reason (null for sound lines) and redactions; content is scrubbed before it gets an id.

    A line's origin is its file, its own hash, and how many equal lines the file has before it: so a line that is read again
    makes the same record, and equal lines of one file are records of their own. lines holds whole files. Equal lines are
    counted before they are dealt, so a line that a file repeats without end is no hot key.
    """
    lines = lines.groupBy("path", "value").agg(F.count("*").alias("times")).select("path", "value", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("turn"))
    x = F.from_json("value", LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.select("value", "path", "turn", x.alias("x")).select("value", "path", "turn", "x.*").withColumn("kind", F.coalesce("kind", F.lit("message")))
    reason = (
        F.when(F.col("_bad").isNotNull(), "not a JSON object").when(F.coalesce("v", F.lit(1)) != 1, "unknown version").when(~F.col("kind").isin(*KINDS), "unknown kind")
        .when(F.coalesce(F.trim("author"), F.lit("")) == "", "no author").when(F.col("content").isNull(), "no content").when(~F.coalesce(F.col("timestamp_ms").between(FIRST_MS, LAST_MS), F.lit(False)), "no time of its own")
    )
    rows = rows.withColumn("reason", reason).withColumn("redactions", F.coalesce(redactions(F.col("content")), F.lit(0))).withColumn("content", scrubbed(F.col("content")))
    return rows.withColumn("origin", F.concat(F.lit("wd1:"), "path", F.lit("@"), F.substring(F.sha2("value", 256), 1, 16), F.when(F.col("turn") > 1, F.concat(F.lit("#"), F.col("turn").cast("string"))).otherwise("")))


def records_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sound lines as records, each once, and the others as dead letters (path, value, reason)."""
    good = rows.filter("reason is null").select(record_id().alias("id"), *FIELDS).dropDuplicates(["id"])
    return good, rows.filter("reason is not null").select("path", "value", "reason")


def ingest_batch(lines: DataFrame, store: DataFrame, atomic: bool = True) -> tuple[DataFrame, dict[str, int]]:
    """The store with a batch added, and its statistics. An atomic batch with a bad line adds nothing."""
    rows = parsed(lines)
    good, bad = records_of(rows)
    stats = rows.agg(F.count("*").alias("items"), F.count("reason").alias("bad"), F.coalesce(F.sum("redactions"), F.lit(0)).alias("redactions")).first().asDict()
    if atomic and stats["bad"]:
        first = bad.first()
        raise ValueError(f"{first['path']}: {first['reason']}; nothing was added")
    fresh = good.join(store.select("id"), "id", "left_anti")
    stats["built"] = good.count()
    stats["absorbed"] = stats["built"] - fresh.count()
    return store.select("id", *FIELDS).unionByName(fresh), stats


def watch(spark: SparkSession, folder: str, store: str, checkpoint: str, available_now: bool = True):
    """A stream over a folder of JSON lines into a versioned store of records and of dead letters below it.

    Spark's checkpoint is the cursor: a file counts once it ends in whole lines, as writers move files in when they are done.
    Each micro-batch writes its own rows alone, and is published as one version, a list of folders: so a reader sees all of it or
    nothing, a batch costs what it holds, and one that is run again adds nothing new.
    """

    def one(batch: DataFrame, number: int) -> None:
        good, bad = records_of(parsed(batch))
        for rows, name in ((good, "records"), (bad, "dead_letters")):
            old = read_version(spark, f"{store}/{name}") if name == "records" else None
            if old is not None:  # of what is there already only ids are read
                rows = rows.join(old.select("id"), "id", "left_anti")
            appended_version(rows.withColumn("batch", F.lit(number)), f"{store}/{name}", f"batch-{number}")

    lines = spark.readStream.format("text").option("recursiveFileLookup", "true").load(folder).select("value", F.col("_metadata.file_path").alias("path")).filter(F.trim("value") != "")
    writer = lines.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()


def not_stored(feed: DataFrame, store: DataFrame) -> DataFrame:
    """Origins that a feed yields and the store lacks; counts are never compared."""
    return feed.select("origin").distinct().join(store.select("origin").filter("origin is not null").distinct(), "origin", "left_anti")


def poll_seconds(files: int) -> int:
    """5 seconds, and one more for every 500 files, up to 60."""
    return min(60, 5 + files // 500)


# Traces
def spans(raw: DataFrame) -> DataFrame:
    """service, method, path, duration_ns, kind of spans (resource and attributes as maps of texts; start, end as decimal texts)."""
    from graphloom.functions.text import url_path

    a = lambda *names: F.coalesce(*(F.try_element_at("attributes", F.lit(n)) for n in names))
    start, end = F.col("start").try_cast("bigint"), F.col("end").try_cast("bigint")
    path = F.coalesce(a("http.route", "url.path", "http.target"), url_path(a("http.url", "url.full")))
    return raw.select(F.coalesce(F.try_element_at("resource", F.lit("service.name")), F.lit("")).alias("service"), a("http.method", "http.request.method").alias("method"), path.alias("path"), duration(start, end).alias("duration_ns"), "kind")


def duration(start: Column, end: Column) -> Column:
    """end - start where end is later, else 0."""
    return F.when(end > start, end - start).otherwise(F.lit(0)).cast("long")


def p99(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, p99: the value at place floor(0.99 n), from 0, of each group in order.

    Distinct values are counted, and dealt by ranges of key and value, so a group of any size is many tasks'; each range's
    totals, one row for a key, say how many values come before it.
    """
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranged = written(counts.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()), "p99")
    sums = ranged.groupBy("_part", *keys).agg(F.sum("_n").alias("_sum"))
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("_part").alias("_p"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_before"), F.sum("_sum").over(Window.partitionBy(*keys)).alias("_total"))
    within = F.sum("_n").over(Window.partitionBy("_part", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    same = [F.col("_part") == F.col("_p"), *(F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys))]
    ranked = ranged.withColumn("_within", within).join(starts, same)
    at = F.least(F.floor(F.col("_total") * F.lit(0.99)).cast("long"), F.col("_total") - 1)
    return ranked.filter(F.col("_within") + F.col("_before") > at).groupBy(*keys).agg(F.min(value).alias("p99"))
