import base64
import gzip
import hashlib
import json
import os

import pytest

from quern.llm import warc


def parsed(raw):
    """Records of one archive as (headers, block), by their lengths alone."""
    out, at = [], 0
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at)
        lines = raw[at:stop].decode().split("\r\n")
        assert lines[0] in ("WARC/1.0", "WARC/1.1")
        head = [tuple(x.split(": ", 1)) for x in lines[1:]]
        size = int(dict(head)["Content-Length"])
        block = raw[stop + 4 : stop + 4 + size]
        assert raw[stop + 4 + size : stop + 8 + size] == b"\r\n\r\n"
        out.append((head, block))
        at = stop + 8 + size
    return out


def archives(folder):
    for name in sorted(os.listdir(folder)):
        if name.startswith("part-"):
            raw = open(f"{folder}/{name}", "rb").read()
            yield parsed(gzip.decompress(raw) if name.endswith(".gz") else raw)


def sha(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def brute(rows):
    out = []
    for page_id, html in rows:
        same = [p for p, h in rows if (h or "") == (html or "")]
        payload = (html or "").encode()
        first = page_id == min(same)
        out.append((page_id, len(payload), sha(payload), "response" if first else "revisit", None if first else min(same)))
    return sorted(out)


TRICKY = "x\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n\nWARC/1."
ROWS = [
    (1, "http://a.org/x?q#f", "<p>é</p>"), (2, "http://b.org", None), (3, None, ""), (4, "no scheme", TRICKY), (5, "http://c.org/a b\r\nX: 1", "<p>é</p>"), (6, "http://d.org/", "\r\n\r\n" + "y" * 300_000),
    (7, "http://e.org/", "<p>é</p>"), (8, "http://f.org/", "\nWARC/1."), (9, "http://g.org/", TRICKY), (10, "http://h.org/", "end\r\n\r"),
]


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_written_and_read_back(spark, tmp_path, compression):
    frame = spark.createDataFrame([(*r, "kept") for r in ROWS], "page_id long, url string, html string, type string").repartition(2)
    warc.write(frame, str(tmp_path / "w"), compression=compression)
    records = [r for a in archives(tmp_path / "w") for r in a]
    assert len(records) == 3 * len(ROWS) and len({dict(h)["WARC-Record-ID"] for h, _ in records}) == len(records)
    found = {r.record_id: r for r in warc.read(spark, str(tmp_path / "w")).collect()}
    for head, block in records:
        r = found[dict(head)["WARC-Record-ID"]]
        assert bytes(r.block) == block and [(x.name, x.value) for x in r.headers] == [(n, v.strip()) for n, v in head] and r.type == dict(head)["WARC-Type"]
    got = warc.captures(warc.read(spark, str(tmp_path / "w"))).collect()
    assert len(got) == len(ROWS)
    by_key = {json.loads(bytes(c.metadata[0].block))["page_id"]: c for c in got}
    for page_id, url, html in ROWS:
        c = by_key[page_id]
        assert json.loads(bytes(c.metadata[0].block)) == {"page_id": page_id, "url": url, "type": "kept"} and len(c.requests) == 1
        if c.type == "response":
            assert bytes(c.payload) == (html or "").encode() and c.payload_digest == sha((html or "").encode()) == c.digest.removeprefix("sha1:")
        else:
            assert by_key[min(p for p, _, h in ROWS if (h or "") == (html or ""))].capture == c.refers_to and len(c.payload) == 0


def test_small_splits(spark, tmp_path):
    """Archives cut into many pieces: boundaries inside records, and inside lines that look like a record's start."""
    spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1).createOrReplaceTempView("_pages")
    warc.write(spark.table("_pages"), str(tmp_path / "w"), compression="none")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (37, 500, 9_001):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size if size > 100 else 1_000 + size)
            want = {dict(h)["WARC-Record-ID"]: b for a in archives(tmp_path / "w") for h, b in a}
            assert {r.record_id: bytes(r.block) for r in warc.read(spark, str(tmp_path / "w")).collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_other_archives(spark, tmp_path):
    """Record-wise compression, version 1.0, lower-case names, links in both directions, loose and malformed records, bytes that are no UTF-8."""
    def record(kind, own, block, **more):
        head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in {"warc-type": kind, "WARC-Record-ID": own, **more}.items())
        return f"WARC/1.0\r\n{head}content-length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n\xff\xfe\r\n\r\nz"
    made = [
        record("warcinfo", "<i>", b"software: x\r\n"), record("request", "<q>", b"GET /\r\n\r\n"), record("response", "<r>", body, WARC_Concurrent_To="<q>"), record("metadata", "<m>", b"a: 1", WARC_Concurrent_To="<r>"),
        record("metadata", "<m2>", b"", WARC_Concurrent_To="<r>"), record("request", "<q2>", b"GET /lost", WARC_Concurrent_To="<gone>"), record("resource", "<s>", b"raw\x00bytes"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in made))
    (tmp_path / "b.warc").write_bytes(b"WARC/1.0\r\nno length here")
    (tmp_path / "c.warc").write_bytes(b"")
    found = {r.record_id: r for r in warc.read(spark, str(tmp_path)).collect()}
    assert set(found) == {"<i>", "<q>", "<r>", "<m>", "<m2>", "<q2>", "<s>", ""} and bytes(found["<r>"].payload) == b"\xff\xfe\r\n\r\nz" and bytes(found["<s>"].payload) == b"raw\x00bytes"
    assert found[""].type is None and found[""].block.endswith(b"no length here")
    got = {c.capture: c for c in warc.captures(warc.read(spark, str(tmp_path))).collect()}
    assert set(got) == {"<r>", "<gone>", "<s>"} and {x.record_id for x in got["<r>"].metadata} == {"<m>", "<m2>"} and [x.record_id for x in got["<r>"].requests] == ["<q>"]
    assert got["<gone>"].type is None and got["<gone>"].requests[0].record_id == "<q2>" and got["<s>"].requests == []


def test_repeated_rows_null_keys_and_empty_tables(spark, tmp_path):
    rows = [(None, "http://a.org", "same"), (None, "http://a.org", "same"), (4, "u", "same"), (4, "u", "same")]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), str(tmp_path / "w"))
    got = warc.captures(warc.read(spark, str(tmp_path / "w"))).collect()
    assert len(got) == 4 and sorted(c.type for c in got) == ["response", "revisit", "revisit", "revisit"]
    first = next(c for c in got if c.type == "response")
    assert json.loads(bytes(first.metadata[0].block))["page_id"] == 4 and {c.refers_to for c in got if c.type == "revisit"} == {first.capture}
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "e"))
    assert warc.captures(warc.read(spark, str(tmp_path / "e"))).count() == 0


def test_query(spark, sf_dir):
    pages = [(p.page_id, p.html) for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert sorted(map(tuple, warc.op11_warc(spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())) == brute(pages)
