import base64
import hashlib
import io

import pytest

from graphloom.llm import warc
from graphloom.llm.warc import BadArchive, archive, frames, parsed, read_archives, record, write_archives


def test_round_trip(spark):
    texts = ["<p>é</p>", "<p>é</p>", "", None, "x" * 200_000, "<p>b</p>"] + [f"<html><body><p>page {k}</p></body></html>" for k in range(40)]
    rows = [(k, f"http://a/{k}", t, "z") for k, t in enumerate(texts)] + [(45, "http://a/45", texts[45], "z"), (None, None, "<p>b</p>", "z"), (70, "x\r\ny", "<p>b</p>", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string").repartition(3)
    got = read_archives(write_archives(df), payloads=True).collect()
    assert len(got) == len(rows)
    best = {}
    for p, _, t, _ in rows:
        if p is not None:
            best[t or ""] = max(best.get(t or "", -1), p)
    want = sorted((str(p), len((t or "").encode()), base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode(), "response" if p in (best[t or ""], None) else "revisit", None if p in (best[t or ""], None) else best[t or ""]) for p, _, t, _ in rows)
    key = lambda x: tuple(map(str, x))
    assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert {r.page_id: r.payload.decode() for r in got if r.payload is not None}[5 if best["<p>b</p>"] == 5 else 70] == "<p>b</p>"
    assert read_archives(write_archives(df.limit(0))).count() == 0


def test_small_payloads_are_no_revisits(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = {r.page_id: r.refers_to for r in read_archives(write_archives(df, least_bytes=3)).collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}


def made(n=3):
    raw = [record(k, "http://x", b"body %d" % k * 50, 6 * 50, warc.digest(b"body %d" % k * 50), None, False) for k in range(n)]
    return raw, b"".join(archive(iter(raw)))


def test_frames_across_chunks_and_damage():
    raw, data = made(400)
    assert list(frames(io.BytesIO(data), chunk=7)) == raw
    with pytest.raises(BadArchive):
        list(frames(io.BytesIO(data[:-3])))
    with pytest.raises(BadArchive):
        list(frames(io.BytesIO(data[20:])))
    broken = bytearray(data)
    broken[-30] ^= 255
    with pytest.raises(BadArchive):
        [parsed(x) for x in frames(io.BytesIO(bytes(broken)))]


def test_validation():
    good = made()[0][0]
    assert parsed(good)["page_id"] == 0
    for bad in (good.replace(b"WARC/1.1", b"WARC/9.9"), good[:-1], good.replace(b"body 0", b"body 1", 1), good.replace(b"Content-Length: 300", b"Content-Length: 299"), good.replace(b"WARC-Type: response", b"WARC-Type response")):
        with pytest.raises(BadArchive):
            parsed(bad)
