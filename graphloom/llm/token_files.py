"""Token files: frequency-ranked ids in a byte-aligned variable-length code, control bytes apart from data bytes.

A file is a sequence of blocks. A block ranks its own ids by frequency, so the 256 most frequent take one byte each, and
holds: a header, the ids in rank order, its documents' ids and lengths, control bytes with the lengths of four codes each
(two bits a code: 1 to 4 bytes), and the data bytes. All numbers are little-endian. Decoding looks control bytes up in a
table and gathers data bytes for the whole block at once.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_rows, materialised, partitions_for, shared_folder, tuned
from graphloom.llm.files import at, write_whole
from graphloom.llm.library_tokens import tokenizer

MAGIC = b"GLVB"
#: magic, documents, ids, distinct ids, control bytes, data bytes, CRC-32 of what follows.
HEADER = struct.Struct("<4sIQIQQI")
#: A block is closed when it has so many ids; a longer document is a block of its own.
BLOCK_IDS = 1 << 22

#: Lengths of the four codes of each control byte.
_LENGTHS = 1 + (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8)


class BadTokenFile(ValueError):
    pass


def packed(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = values.astype("<u4")
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]].tobytes()


def unpacked(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    if len(size) != n or int(size.sum()) != len(data):
        raise BadTokenFile("control bytes don't fit the data")
    start = np.cumsum(size) - size
    held = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = held[start].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        out[more] |= held[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def block(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    top = int(ids.max()) if len(ids) else 0
    if top < 1 << 22:  # a vocabulary's ids: counted by place
        counts = np.bincount(ids)
        distinct, place = np.flatnonzero(counts).astype(np.uint32), ids
        counts = counts[distinct]
    else:
        distinct, place, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.lexsort((distinct, -counts))
    rank = np.empty(top + 1 if place is ids else len(order), np.uint32)
    rank[distinct[order] if place is ids else order] = np.arange(len(order), dtype=np.uint32)
    control, data = packed(rank[place] if len(ids) else np.empty(0, np.uint32))
    body = b"".join([distinct[order].astype("<u4").tobytes(), np.array([d is not None for d in doc_ids], np.uint8).tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array(lengths, "<u8").tobytes(), control, data])
    return HEADER.pack(MAGIC, len(doc_ids), len(ids), len(distinct), len(control), len(data), zlib.crc32(body)) + body


def blocks(file) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """doc_ids, lengths and ids of each block of an open file."""
    while head := file.read(HEADER.size):
        if len(head) < HEADER.size:
            raise BadTokenFile("a header is cut short")
        magic, docs, n, ranked, controls, datas, crc = HEADER.unpack(head)
        if magic != MAGIC:
            raise BadTokenFile("not a token file")
        body = file.read(4 * ranked + 17 * docs + controls + datas)
        if len(body) != 4 * ranked + 17 * docs + controls + datas or zlib.crc32(body) != crc:
            raise BadTokenFile("a block is cut short or damaged")
        cuts = np.cumsum([0, 4 * ranked, docs, 8 * docs, 8 * docs, controls, datas])
        table, has, doc_ids, lengths, control, data = (body[a:b] for a, b in zip(cuts, cuts[1:], strict=False))
        ids = np.frombuffer(table, "<u4")[unpacked(control, data, n)] if n else np.empty(0, np.uint32)
        yield [d if h else None for d, h in zip(np.frombuffer(doc_ids, "<i8").tolist(), has, strict=True)], np.frombuffer(lengths, "<u8").astype(np.int64), ids


def write_token_files(documents: DataFrame, definition: str, end_id: int, label: str = "tokens") -> DataFrame:
    """Encodes every row's text with the tokenizers library, ends it with end_id, and writes ids in ascending doc_id order.

    Returns file, path, documents, ids for each file; files follow one another in doc_id order. A null doc_id comes first; rows
    that share a doc_id are in the order of their text's hash. A null text has the end id alone.
    """
    spark = tuned(documents.sparkSession)
    sent, folder = spark.sparkContext.broadcast(definition), shared_folder(spark, f"{label}-files")
    keys = [F.col("doc_id"), F.xxhash64("text")]
    ordered = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(partitions_for(documents), *keys).sortWithinPartitions(*keys)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, totals, end = tokenizer(sent.value), [0, 0], np.array([end_id], "<u4").tobytes()

        def made() -> Iterator[bytes]:
            held: list[tuple[int | None, bytes]] = []
            size = 0
            for batch in batches:
                for doc, ids in zip(batch.column(0).to_pylist(), library.encode(batch.column(1).to_pylist()), strict=True):
                    held.append((doc, ids + end))
                    size += len(ids) // 4 + 1
                    if size >= BLOCK_IDS:
                        yield flushed(held)
                        held, size = [], 0
            if held:
                yield flushed(held)

        def flushed(held) -> bytes:
            ids = np.frombuffer(b"".join(x[1] for x in held), "<u4")
            totals[0] += len(held)
            totals[1] += len(ids)
            return block([x[0] for x in held], [len(x[1]) // 4 for x in held], ids)

        context = TaskContext.get()
        path = f"{folder}/part-{context.partitionId():06d}.glvb"
        write_whole(path, context.taskAttemptId(), made())
        yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()], pa.int32()), pa.array([path]), pa.array([totals[0]], pa.int64()), pa.array([totals[1]], pa.int64())], names=["file", "path", "documents", "ids"])

    return materialised(ordered.mapInArrow(write, "file int, path string, documents long, ids long"), f"{label}-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), token_ids (binary, little-endian unsigned 32-bit) for each document of the files."""
    spark = manifest.sparkSession
    # One row for each file: offsets are added up on the driver.
    files, start = [], 0
    for f in sorted(manifest.collect(), key=lambda r: r["file"]):
        files.append((f["path"], start, f["documents"], f["ids"]))
        start += f["ids"]
    spread = spark.createDataFrame(files, "path string, start long, documents long, ids long").repartition(max(partitions_for(manifest), 16), "path")

    def make(columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
        for path, start, documents, ids in zip(*(columns[c].to_pylist() for c in ("path", "start", "documents", "ids")), strict=True):
            system, inner = at(path)
            seen = [0, 0]
            with system.open_input_stream(inner, compression=None) as file:
                for doc_ids, lengths, values in blocks(file):
                    ends = np.cumsum(lengths)
                    if (int(ends[-1]) if len(ends) else 0) != len(values):
                        raise BadTokenFile(f"{path}: lengths don't add up")
                    for k in range(0, len(doc_ids), 256):
                        pieces = [values[e - n : e].astype("<u4").tobytes() for e, n in zip(ends[k : k + 256], lengths[k : k + 256], strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(doc_ids[k : k + 256], pa.int64()), pa.array(start + seen[1] + ends[k : k + 256] - lengths[k : k + 256], pa.int64()), pa.array(pieces, pa.binary())], names=["doc_id", "start", "token_ids"])
                    seen[0] += len(doc_ids)
                    seen[1] += len(values)
            if seen != [documents, ids]:
                raise BadTokenFile(f"{path} has {seen} documents and ids, not {[documents, ids]}")

    return arrow_rows(spread, [F.col(c) for c in ("path", "start", "documents", "ids")], make, "doc_id long, start long, token_ids binary")
