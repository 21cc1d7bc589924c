"""Zstandard-compressed WARC archives: a writer that records equal payloads once, and a reader that trusts nothing.

An archive starts with a skippable frame that holds its dictionary; each record is one frame of its own, compressed with
that dictionary, so that a reader can stop at, or start from, any record.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_rows, materialised, partitions_for, salted_lookup, shared_folder, tuned
from graphloom.llm.files import at, write_whole

#: Fixed values of the formats.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
VERSION, REVISIT = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Records at the head of an archive from which its dictionary is trained, and the dictionary's bytes.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 200, 1 << 20, 16 << 10
LEVEL = 3


class BadArchive(ValueError):
    """What is wrong, and where."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, size: int, sha1: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record: an HTTP response with its payload, or a revisit that has the headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{sha1}"), ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if revisit:
        head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head.append(("Content-Length", str(len(block))))
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def archive(records: Iterable[bytes]) -> Iterator[bytes]:
    """The archive's bytes, piece by piece. Only the records that train the dictionary are held."""
    records, sample, size = iter(records), [], 0
    for r in records:
        sample.append(r)
        size += len(r)
        if len(sample) >= SAMPLE_RECORDS or size >= SAMPLE_BYTES:
            break
    try:
        dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, sample, level=LEVEL, k=256, d=8).as_bytes()
    except zstandard.ZstdError:  # too few or too short to train from: their bytes, as they are, serve as one
        dictionary = b"".join(sample)[:DICTIONARY_BYTES] or VERSION
    yield struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True, write_checksum=True)
    for r in sample:
        yield pack.compress(r)
    for r in records:
        yield pack.compress(r)


def frame_end(data, start: int) -> int:
    """Where the frame that begins at start ends, from its block headers; -1 if data ends before."""
    if len(data) < start + 6:
        return -1
    if struct.unpack_from("<I", data, start)[0] != FRAME:
        raise BadArchive(f"no frame begins at byte {start}")
    flags = data[start + 4]
    single = flags >> 5 & 1
    k = start + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        if len(data) < k + 3:
            return -1
        head = data[k] | data[k + 1] << 8 | data[k + 2] << 16
        k += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            k += 4 * (flags >> 2 & 1)
            return k if len(data) >= k else -1


def frames(file, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an open archive, decompressed; the dictionary is loaded from the leading skippable frame."""
    head = file.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != SKIPPABLE:
        raise BadArchive("the archive doesn't start with a dictionary frame")
    size = struct.unpack("<I", head[4:])[0]
    dictionary = file.read(size)
    if len(dictionary) < size:
        raise BadArchive("the dictionary is cut short")
    if dictionary[:4] == struct.pack("<I", FRAME):  # the dictionary itself may be compressed
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    data, start = b"", 0
    while True:
        end = frame_end(data, start) if len(data) > start else -1
        if end < 0:
            more = file.read(max(chunk, len(data) - start))
            if not more:
                if len(data) > start:
                    raise BadArchive("the last record is cut short")
                return
            data, start = data[start:] + more, 0
            continue
        try:
            yield unpack.decompress(data[start:end])
        except zstandard.ZstdError as e:
            raise BadArchive(f"a frame can't be decoded: {e}") from None
        start = end


def parsed(raw: bytes) -> dict:
    """A record's fields, after its version, header lines, lengths and digests have been found right."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != VERSION:
        raise BadArchive("a record has no WARC header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or not name.strip() or name.lower() in fields:
            raise BadArchive(f"bad header line: {line!r}")
        fields[name.lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "content-length", "warc-payload-digest", "warc-block-digest"} - fields.keys()
    if missing or not fields["content-length"].isdigit():
        raise BadArchive(f"missing or bad header fields: {sorted(missing) or 'content-length'}")
    size = int(fields["content-length"])
    block, end = rest[:size], rest[size:]
    if len(block) < size or end != b"\r\n\r\n":
        raise BadArchive("the block's length isn't Content-Length")
    if fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise BadArchive("the block's digest doesn't hold")
    http, gap, payload = block.partition(b"\r\n\r\n")
    length = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), -1)
    kind, sha1 = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if not gap or kind not in ("response", "revisit") or length < 0:
        raise BadArchive("no response, and no revisit of one")
    if kind == "response" and (len(payload) != length or digest(payload) != sha1):
        raise BadArchive("the payload's length or digest doesn't hold")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise BadArchive("a revisit has a payload, or refers to nothing")
    number = lambda x: int(y) if (y := x.removeprefix("<urn:page:").removesuffix(">")) else None
    return {"page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": length, "payload_digest": sha1, "record_type": kind, "refers_to": number(fields["warc-refers-to"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None}


def write_archives(pages: DataFrame, least_bytes: int = 0, label: str = "warc") -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) to shared archives, one for each input partition; returns their paths, records and bytes.

    Of rows with equal payloads of least_bytes or more, the one with the largest page_id is a response, and the others
    are revisits that refer to it; rows that repeat that page_id are responses as well, as is every row without a page_id.
    A null html is an empty payload. A payload's rows may be any share of all rows: only ids and digests are shuffled to
    find the largest id, and these are salted.
    """
    spark = tuned(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary")).alias("payload"))
    keyed = materialised(rows.select("page_id", F.sha1("payload").alias("sha1"), F.length("payload").alias("size")).filter(F.col("page_id").isNotNull() & (F.col("size") >= least_bytes)), f"{label}-digests")
    first = materialised(keyed.groupBy("sha1").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).filter("n > 1").select("sha1", "top"), f"{label}-repeated")
    again = salted_lookup(keyed.select("page_id", "sha1"), first, "sha1", F.col("page_id"), "inner").filter("page_id <> top").select("page_id", F.col("sha1").alias("same"), "top").distinct()
    again = materialised(again, f"{label}-revisits")
    # By page_id and digest: a page_id may be repeated with another payload.
    full = rows.withColumn("sha1", F.sha1("payload")).join(again.withColumnRenamed("same", "sha1"), ["page_id", "sha1"], "left")
    folder = shared_folder(spark, f"{label}-archives")
    sent = ("page_id", "url", "payload", "top")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [0]

        def records():
            for batch in batches:
                for page, url, payload, top in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    made[0] += 1
                    yield record(page, url, payload, len(payload), digest(payload), top, top is not None)

        context, stream = TaskContext.get(), records()
        head = next(stream, None)
        if head is None:
            return
        path = f"{folder}/part-{context.partitionId():06d}.warc.zst"

        def chained():
            yield head
            yield from stream

        size = write_whole(path, context.taskAttemptId(), archive(chained()))
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([made[0]], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

    return materialised(full.select(*sent).mapInArrow(write, "path string, records long, bytes long"), f"{label}-manifest")


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of archives (path, records), one archive to a task; raises BadArchive for anything that isn't as it should be.

    payloads adds each response's bytes as payload.
    """
    names = [c.split(" ")[0] for c in READ.split(", ")] + ["payload"] * payloads
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: len(names)]

    def make(columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
        for path, expected in zip(columns["path"].to_pylist(), columns["records"].to_pylist(), strict=True):
            system, inner = at(path)
            found, held, seen = [], 0, 0
            with system.open_input_stream(inner, compression=None) as file:
                for raw in frames(file):
                    x = parsed(raw)
                    found.append(x)
                    held, seen = held + (len(raw) if payloads else 200), seen + 1
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], t) for n, t in zip(names, types, strict=True)], names=names)
                        found, held = [], 0
            if seen != expected:
                raise BadArchive(f"{path} has {seen} records, not {expected}")
            yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], t) for n, t in zip(names, types, strict=True)], names=names)

    spread = archives.repartition(max(partitions_for(archives), 16), "path")
    return arrow_rows(spread, [F.col("path"), F.col("records")], make, READ + ", payload binary" * payloads)
