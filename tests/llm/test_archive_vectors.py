import gzip
import hashlib
import io
import math
import struct
import warnings
import zipfile

import numpy as np
import pytest

from marlstone.llm import archive, innerproduct


def pages(spark):
    long, other = "<p>" + "x" * 200, "<b>" + "ä" * 90
    rows = [(5, "http://a/", long), (2, "http://b/", long), (9, None, long), (1, "u", "short"), (3, "u", "short"), (4, "u", None), (6, "u\r\nInjected: 1", other), (7, "u", other), (7, "u", other), (None, "u", long)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(2), rows


def test_round_trip_through_archives(spark):
    df, rows = pages(spark)
    archives = archive.write_archives(df, limit=300)
    got = archive.read_archives(archives, payloads=True).collect()
    assert len(got) == len(rows)
    first = {}
    for p, _, h in rows:
        data = (h or "").encode()
        if len(data) >= 100 and p is not None:
            first[data] = min(p, first.get(data, p))
    want = sorted((str(p), len(d := (h or "").encode()), hashlib.sha256(d).hexdigest(), first[d] if p is not None and d in first and first[d] != p else None) for p, _, h in rows)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.refers_to) for r in got) == [tuple(w) for w in want]
    assert all((r.record_type == "revisit") == (r.refers_to is not None) == (r.payload is None) for r in got)
    assert archive.read_archives(archive.write_archives(df.limit(0))).count() == 0


def test_zip64_directory_and_missing_index():
    w = archive.Writer()
    w.add(1, "http://a/", b"hello", hashlib.sha256(b"hello").hexdigest(), 5, None)
    w.add(2, "http://b/", b"", hashlib.sha256(b"hello").hexdigest(), 5, 1)
    plain = w.close()
    cut = plain.rindex(b"PK\x05\x06")
    count, size, start = struct.unpack_from("<HII", plain, cut + 10)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, size, start)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, cut, 1)
    short = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 7) + b"comment"
    big = plain[:cut] + end64 + locator + short
    reads = []
    fetch = lambda data: lambda at, n: (reads.append(n), data[at : at + n])[1]
    for data in (plain, big):
        found = list(archive.records(fetch(data), len(data)))
        assert [r["headers"]["warc-type"] for r in found] == ["response", "revisit"] and found[0]["payload"] == b"hello"
    bare = io.BytesIO()
    with zipfile.ZipFile(bare, "w") as z, zipfile.ZipFile(io.BytesIO(plain)) as old, z.open(archive.DATA, "w", force_zip64=True) as f:
        f.write(old.read(archive.DATA))
    data = bare.getvalue()
    assert len(list(archive.records(fetch(data), len(data)))) == 2


def test_files_are_range_read(spark, tmp_path):
    w = archive.Writer()
    w.add(1, "http://a/", b"hello", hashlib.sha256(b"hello").hexdigest(), 5, None)
    (tmp_path / "a.zip").write_bytes(w.close())
    got = archive.read_archive_files(spark.createDataFrame([(str(tmp_path / "a.zip"),)], "path string"), payloads=True).collect()
    assert [(r.page_id, bytes(r.payload)) for r in got] == [(1, b"hello")]


def brute(rows, scale, k):
    ok = {i: np.floor(np.array(v, dtype=float) * scale) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in ok:
        if q % 20 == 0:
            best = sorted((-int(ok[q] @ ok[c]), c) for c in ok if c != q)[:k]
            out |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(best)}
    return out


def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(innerproduct, "QUERY_BLOCK", 7)
    monkeypatch.setattr(innerproduct, "SEEDS", 40)
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.normal(size=16) * (1 + k % 3)]) for k in range(400)]
    rows += [(500 + k, rows[3][1]) for k in range(60)]  # ties
    rows += [(1000, None), (1020, []), (1040, [float("nan")] * 16), (1060, [None] * 16), (1080, [float("inf")] + [0.0] * 15), (1100, [0.0] * 16)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, v string").repartition(5)
    got = innerproduct.top_k(df, lambda c: c % 20 == 0, 20, scale=64.0).collect()
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == brute(as_float, 64.0, 20)


def test_topk_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 1.0]), (2, [1.0])], "vec_id long, embedding array<double>")
    got = innerproduct.top_k(df, lambda c: c % 20 == 0, 20).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, 1, 2.0), (2, 2, 1.0)]
    assert innerproduct.top_k(df.limit(0), lambda c: c % 20 == 0).count() == 0


def packed(*members):
    """A ZIP file of (name, content, method)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z, warnings.catch_warnings():
        warnings.simplefilter("ignore")  # repeated names
        for name, content, method in members:
            z.writestr(zipfile.ZipInfo(name), content, method)
    return out.getvalue()


def record(n, payload=b"text"):
    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n" % (n, len(block)) + block + b"\r\n\r\n"


def read(content):
    view = memoryview(content)
    return [int(r["headers"]["warc-record-id"][10:-1]) for r in archive.records(lambda at, n: view[at : at + n], len(view))]


def test_members_and_indexes_of_all_kinds():
    stored, deflated = zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED
    one, two = gzip.compress(record(1)), gzip.compress(record(2, b"x" * 100_000))
    line = lambda offset, length, name="data.warc.gz": f'com,a)/ 2024 {{"filename": "{name}", "offset": "{offset}", "length": {length}}}\n'.encode()
    index = b" CDX N b a m\n!meta {bad\n" + line(0, len(one)) + line(len(one), len(two)) + line(0, len(one)) + b"no entry\n" + line(0, 5, "gone.warc.gz")
    assert read(packed(("archive/data.warc.gz", one + two, stored), ("indexes/index.cdx.gz", gzip.compress(index), stored))) == [1, 2]
    assert read(packed(("archive/data.warc.gz", one + two, stored), ("indexes/index.cdxj", index, deflated))) == [1, 2]
    assert read(packed(("archive/data.warc.gz", one + two, deflated), ("indexes/index.cdxj", index, stored))) == [1, 2]  # walked: it has no ranges
    assert read(packed(("archive/plain.warc", record(3) + record(4, b"y" * 70_000) + record(5), stored))) == [3, 4, 5]
    assert read(packed(("archive/plain.warc", record(3) + record(4), deflated), ("archive/", b"", stored))) == [3, 4]
    assert read(packed(("archive/whole.warc.gz", gzip.compress(record(6) + record(7)), stored))) == [6, 7]
    assert sorted(read(packed(("archive/data.warc.gz", gzip.compress(record(8)), stored), ("archive/data.warc.gz", one, stored), ("indexes/i.cdxj", line(0, len(one)), stored)))) == [1, 8]
    assert read(packed(("archive/empty.warc.gz", b"", stored), ("other/x", b"y", stored))) == [] and read(packed()) == []


def test_corrupt_archives(spark):
    good = packed(("archive/a.warc", record(1) + record(2), zipfile.ZIP_STORED))
    cut = packed(("archive/a.warc", record(1) + record(2)[:-30], zipfile.ZIP_STORED))
    rows = [("good", good), ("none", None), ("empty", b""), ("noise", b"x" * 500), ("cut", cut), ("end", good[:-5])]
    table = spark.createDataFrame(rows, "path string, content binary")
    got = sorted((r["path"], r["record_type"], r["page_id"] or 0) for r in archive.read_archives(table, tolerant=True).collect())
    assert got == [("cut", "corrupt", 0), ("cut", "response", 1), ("end", "corrupt", 0), ("good", "response", 1), ("good", "response", 2), ("noise", "corrupt", 0)]
    with pytest.raises(Exception, match="no end of central directory"):
        archive.read_archives(table.where("path = 'noise'")).collect()
    assert archive.read_archives(table.where("path IN ('none', 'empty')")).count() == 0
