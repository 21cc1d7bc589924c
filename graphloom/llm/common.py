"""What the operators of this subpackage share: shared storage, word rules, running totals, salted lookups."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The word rule of every contract, in Python and in Java syntax.
WORD = "[^\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

#: Rows and bytes that one Arrow batch to a Python worker holds at most; long texts make rows of many kB.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


#: Longer words are never remembered by a worker, and an entry of its tables takes so many bytes besides its text.
LONGEST_KEPT, ENTRY_BYTES = 64, 200


class Remembered(dict):
    """What a worker process remembers by word, up to a budget of bytes.

    Full, it is emptied; words of over LONGEST_KEPT characters don't get in. So its size has a bound, and results never depend on it.
    Whoever fills it empties it when a task ends, so that nothing is left in a worker that Spark uses again.
    """

    def __init__(self, budget: int):
        super().__init__()
        self.budget = self.room = budget

    def keep(self, word, value, size: int = 0) -> None:
        if len(word) > LONGEST_KEPT:
            return
        self.room -= ENTRY_BYTES + 2 * len(word) + size
        if self.room < 0:
            self.forget()
            self.room -= ENTRY_BYTES + 2 * len(word) + size
        self[word] = value

    def forget(self) -> None:
        self.clear()
        self.room = self.budget


@contextmanager
def uncollected() -> Iterator[None]:
    """No garbage collection inside: for code that makes no cycles but keeps many small objects, which the collector would walk through again and again."""
    collecting = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if collecting:
            gc.enable()


def tuned(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches of the session's Python operators."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent, as in tests on one machine, a temporary folder stands in.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/graphloom-{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, label: str) -> DataFrame:
    """The rows of df, written once as Parquet in the shared folder: lineage ends there, and column pruning still works."""
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def arrow_rows(df: DataFrame, columns: Sequence[Column], make: Callable[[dict[str, pa.Array]], Iterator[pa.RecordBatch]], schema: str, after: Callable[[], None] | None = None) -> DataFrame:
    """df's columns, batch by batch, through make(), which yields record batches of the schema; after() is called in the worker when a task ends."""
    tuned(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                if batch.num_rows:
                    yield from make(dict(zip(batch.schema.names, batch.columns, strict=True)))
        finally:
            if after:
                after()

    return df.select(*columns).mapInArrow(run, schema)


def nested(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """A row's columns as one struct, doc, beside which working columns of any name can't clash with them."""
    return F.struct(*(F.col(f"`{c}`") for c in columns or df.columns)).alias("doc")


def n_words(text: Column) -> Column:
    """Words of a text; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def partitions_for(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def running_total(df: DataFrame, keys: Sequence[Column], value: str, out: str, label: str) -> DataFrame:
    """Adds `out`, the sum of `value` over all rows before this one in the global order of keys.

    Rows are dealt by range and written once, so that a rerun of a task can't change the order. Each partition then adds
    up its own rows in turn, and starts from the total of the partitions before it: one number for each partition reaches the driver.
    The keys must be a total order but for rows that are equal in every column.
    """
    spark = tuned(df.sparkSession)
    ordered = df.repartitionByRange(partitions_for(df), *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            own = batch.column(value).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.cumsum(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums - own + total, pa.int64())], names=[*batch.schema.names, out])
            total += int(sums[-1]) if len(sums) else 0

    counted = materialised(ordered.mapInArrow(run, T.StructType([*ordered.schema.fields, T.StructField(out, T.LongType())])), label)
    before, total = [], 0
    for row in sorted(counted.groupBy("_part").agg(F.max(F.col(out) + F.coalesce(value, F.lit(0))).alias("total")).collect(), key=lambda r: r["_part"]):
        before.append((row["_part"], total))
        total += row["total"]
    starts = spark.createDataFrame(before, "_part int, _before long")
    return counted.join(F.broadcast(starts), "_part").withColumn(out, F.col(out) + F.col("_before")).drop("_part", "_before")


#: Into so many parts a lookup by a possibly hot key is dealt.
SALTS = 32


def salted_lookup(left: DataFrame, right: DataFrame, key: str, salt: Column, how: str = "left") -> DataFrame:
    """left joined with right, which has one row for each value of key.

    The rows of one key in left may be any share of all rows: they go to SALTS tasks, and right's row is repeated for each.
    """
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(spread, [key, "_salt"], how).drop("_salt")
