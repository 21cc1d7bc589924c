"""Append-only records: identities from content, unions that commute, queries and threads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "kind string, author string, timestamp_ms long, content string, anchor string, origin string, thread string, parent string"
FIELDS = [x.split()[0] for x in SCHEMA.split(", ")]
KINDS = ("decision", "verdict", "summary", "signal", "message")
#: Milliseconds of the years 1970 to 9999.
FIRST_MS, LAST_MS = 1, 253402300799999


class RecordError(ValueError):
    pass


def record_id() -> Column:
    """SHA-256 over a tagged image of every field: its name, its length in bytes or -, and its text. No two records share an image."""
    parts = [F.concat(F.lit(f"{f}:"), F.coalesce(F.length(F.col(f).cast("string").cast("binary")).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit("\n")) for f in FIELDS]
    return F.sha2(F.concat(F.lit("record/1\n"), *parts), 256)


def built(rows: DataFrame) -> DataFrame:
    """rows (the fields) with id; refuses unknown kinds, times out of range and records without author or content."""
    bad = rows.filter(~F.col("kind").isin(*KINDS) | F.col("kind").isNull() | ~F.coalesce(F.col("timestamp_ms").between(FIRST_MS, LAST_MS), F.lit(False)) | F.coalesce(F.col("author"), F.lit("")).eqNullSafe("") | F.col("content").isNull())
    if not bad.isEmpty():
        raise RecordError(f"not a record: {bad.first().asDict()}")
    return rows.select(record_id().alias("id"), *FIELDS)


def appended(store: DataFrame, new: DataFrame) -> DataFrame:
    """The union of two sets of records: idempotent and commutative. An id with other fields is refused, and the store stays as it is."""
    every = store.select("id", *FIELDS).union(new.select("id", *FIELDS)).distinct()
    clash = every.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    if not clash.isEmpty():
        raise RecordError(f"records with id {clash.first()['id']} differ")
    return every


def verified(store: DataFrame) -> DataFrame:
    """The store, after every id has been recomputed."""
    wrong = store.filter(F.col("id") != record_id())
    if not wrong.isEmpty():
        raise RecordError(f"record {wrong.first()['id']} isn't what its id says")
    return store


@dataclass(frozen=True)
class RecordQuery:
    kind: str | None = None
    author: str | None = None
    anchor: str | None = None
    anchor_prefix: str | None = None
    anchored: bool | None = None
    origin: str | None = None
    thread: str | None = None
    parent: str | None = None
    since: int | None = None
    until: int | None = None
    text: str | None = None


def query(store: DataFrame | None, q: RecordQuery) -> DataFrame:
    """Records that meet every condition, in order of id. A store that isn't there, and a query that nothing can meet, are errors, not empty answers."""
    if store is None:
        raise RecordError("there is no record store")
    if q.anchored is False and (q.anchor or q.anchor_prefix) or q.anchor and q.anchor_prefix and not q.anchor.startswith(q.anchor_prefix) or q.since is not None and q.until is not None and q.since > q.until:
        raise RecordError("the query contradicts itself")
    df = store
    for name in ("kind", "author", "anchor", "origin", "thread", "parent"):
        if (value := getattr(q, name)) is not None:
            df = df.filter(F.col(name) == value)
    if q.anchor_prefix:
        df = df.filter(F.col("anchor").startswith(q.anchor_prefix))
    if q.anchored is not None:
        df = df.filter(F.col("anchor").isNotNull() if q.anchored else F.col("anchor").isNull())
    if q.since is not None:
        df = df.filter(F.col("timestamp_ms") >= q.since)
    if q.until is not None:
        df = df.filter(F.col("timestamp_ms") <= q.until)
    if q.text:
        df = df.filter(F.col("content").contains(q.text))
    return df.orderBy("id")


def digest(store: DataFrame) -> DataFrame:
    """One row: records, digest. Ids are hashed in groups by their first three digits, in order, then the groups' digests: no task has all ids."""
    groups = store.select("id").groupBy(F.substring("id", 1, 3).alias("g")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("id")), ""), 256).alias("d"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "d"))), lambda x: x["d"]), ""), 256).alias("digest"))


def missing(here: DataFrame, there: DataFrame) -> DataFrame:
    """Records of there that here lacks."""
    return there.join(here.select("id"), "id", "left_anti")


def exchanged(a: DataFrame, b: DataFrame) -> DataFrame:
    return appended(a, b)


def thread(store: DataFrame, name: str) -> DataFrame:
    return store.filter(F.col("thread") == name).orderBy("timestamp_ms", "id")


def orphans(store: DataFrame, symbols: DataFrame) -> DataFrame:
    """id, anchor of records whose anchor no symbol (qualified_name) has, as of now."""
    return store.filter("anchor is not null").join(symbols.select(F.col("qualified_name").alias("anchor")).distinct(), "anchor", "left_anti").select("id", "anchor")


def from_decisions(documents: DataFrame) -> DataFrame:
    """Decision documents (project, content, updated_ms) as records of kind decision."""
    return built(documents.select(F.lit("decision").alias("kind"), F.col("project").alias("author"), F.col("updated_ms").alias("timestamp_ms"), "content", F.lit(None).cast("string").alias("anchor"), F.concat(F.lit("adr:"), "project").alias("origin"), F.lit(None).cast("string").alias("thread"), F.lit(None).cast("string").alias("parent")))
