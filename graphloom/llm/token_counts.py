"""Token counts from flat token files without an index: a scan for the ids that end documents.

Files are nothing but 16-bit ids, each document's followed by the end id. They are scanned in blocks: each block's ends are
found at once, a prefix scan over the blocks gives the number of documents before a block and where the last one ended,
and so the document that a block's first end closes is stitched to its part in the blocks before.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_rows, materialised, partitions_for, shared_folder, tuned
from graphloom.llm.files import read_range, write_whole

#: Ids of one block of a scan.
BLOCK_IDS = 1 << 20
_made: dict[int, object] = {}


def _encoding(ranks: bytes, pattern: str):
    import base64

    import tiktoken

    key = hash((ranks, pattern))
    if key not in _made:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _made.clear()
        _made[key] = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _made[key]


def write_flat(documents: DataFrame, ranks: bytes, pattern: str, end_id: int, label: str = "flat") -> tuple[DataFrame, DataFrame]:
    """Writes the ids of every row's text as flat files, one for each input partition, without a shuffle.

    Returns the files (file, path, ids) and which row is which document of a file (file, ordinal, doc_id). No text can
    contain the end id, which must not be in ranks. A null text is an empty document.
    """
    spark = tuned(documents.sparkSession)
    sent, folder = spark.sparkContext.broadcast((ranks, pattern)), shared_folder(spark, f"{label}-files")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, context, docs, total = _encoding(*sent.value), TaskContext.get(), [], [0]
        number, end = context.partitionId(), np.array([end_id], "<u2").tobytes()

        def made() -> Iterator[bytes]:
            for batch in batches:
                # A copy: a slice would keep its whole batch, texts included, in memory.
                docs.append(pa.array(batch.column(0).to_pylist(), pa.int64()))
                for text in batch.column(1).to_pylist():
                    ids = np.array(encoding.encode_ordinary(text), "<u2").tobytes() + end if text else end
                    total[0] += len(ids) // 2
                    yield ids

        path = f"{folder}/part-{number:06d}.bin"
        write_whole(path, context.taskAttemptId(), made())
        at = 0
        for column in docs:
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(column), pa.int32()), pa.array([path] * len(column)), pa.array(range(at, at + len(column)), pa.int64()), column, pa.array([total[0]] * len(column), pa.int64())], names=["file", "path", "ordinal", "doc_id", "ids"])
            at += len(column)

    rows = materialised(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(write, "file int, path string, ordinal long, doc_id long, ids long"), f"{label}-rows")
    return rows.filter("ordinal = 0").select("file", "path", "ids"), rows.select("file", "ordinal", "doc_id")


def scan_flat(files: DataFrame, end_id: int, block_ids: int = 0) -> DataFrame:
    """file, ordinal, start, n_tokens (the end id not counted) for each document of flat files (file, path, ids).

    Ids after the last end id of a file are no document.
    """
    size = block_ids or BLOCK_IDS
    blocks = files.filter("ids > 0").select("file", "path", "ids", F.explode(F.sequence(F.lit(0), F.floor((F.col("ids") - 1) / size))).alias("block"))
    blocks = blocks.select("file", "path", "block", (F.col("block") * size).alias("at"), F.least(F.lit(size), F.col("ids") - F.col("block") * size).alias("n"))
    blocks = blocks.repartition(max(4 * partitions_for(files), 16), "file", "block")

    def ends(path: str, at: int, n: int) -> np.ndarray:
        ids = np.frombuffer(read_range(path, 2 * at, 2 * n), "<u2")
        if len(ids) != n:
            raise ValueError(f"{path} ends before id {at + n}")
        return at + np.flatnonzero(ids == end_id)

    def counted(columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
        found = [ends(*x) for x in zip(*(columns[c].to_pylist() for c in ("path", "at", "n")), strict=True)]
        yield pa.RecordBatch.from_arrays([*(columns[c] for c in ("file", "path", "block", "at", "n")), pa.array([len(f) for f in found], pa.int64()), pa.array([int(f[-1]) if len(f) else None for f in found], pa.int64())], names=["file", "path", "block", "at", "n", "docs", "last"])

    schema = "file int, path string, block long, at long, n long, docs long, last long"
    counts = materialised(arrow_rows(blocks, [F.col(c) for c in ("file", "path", "block", "at", "n")], counted, schema), "flat-counts")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = counts.select("*", F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("ahead"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("previous")).filter("docs > 0")

    def documents(columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
        for file, path, first, n, ahead, previous in zip(*(columns[c].to_pylist() for c in ("file", "path", "at", "n", "ahead", "previous")), strict=True):
            e = ends(path, first, n)
            starts = np.concatenate([[previous + 1], e[:-1] + 1])
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(e), pa.int32()), pa.array(ahead + np.arange(len(e)), pa.int64()), pa.array(starts, pa.int64()), pa.array(e - starts, pa.int64())], names=["file", "ordinal", "start", "n_tokens"])

    return arrow_rows(stitched, [F.col(c) for c in ("file", "path", "at", "n", "ahead", "previous")], documents, "file int, ordinal long, start long, n_tokens long")


def token_counts(documents: DataFrame, ranks: bytes, pattern: str, end_id: int, block_ids: int = 0) -> DataFrame:
    """doc_id, file, start, n_tokens for each row of documents, counted in flat files of its tokens.

    Null and empty texts have no tokens; rows that repeat a doc_id, or have none, are counted one by one; a text may be of any
    length; an empty table gives an empty one; other columns are not read. Both sides of the last join grow with the
    documents, so they are merged in order of file and place, never broadcast.
    """
    files, rows = write_flat(documents, ranks, pattern, end_id)
    return rows.hint("merge").join(scan_flat(files, end_id, block_ids), ["file", "ordinal"], "left").select("doc_id", "file", "start", "n_tokens")
