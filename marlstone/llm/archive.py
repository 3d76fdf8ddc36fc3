"""WARC records in ZIP-packaged archives: a writer, and a reader that range-reads records without extraction.

An archive holds one stored member ``archive/data.warc.gz`` (a gzip member for each record) and one stored
``indexes/index.cdxj`` (offset and length of each record). The reader needs only ``fetch(offset, length)``:
it reads the end of the file, the central directory (with ZIP64 where sizes call for it), the index, and then
each record's own range. Members without an index are walked record by record.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

#: Bytes of records in an archive, after which the next one begins; records from this payload size on are deduplicated.
ARCHIVE_BYTES, LEAST_REVISIT = 4 << 20, 100
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"

Fetch = Callable[[int, int], bytes]


class Member(NamedTuple):
    name: str
    method: int
    header: int
    size: int


def directory(fetch: Fetch, total: int) -> list[Member]:
    """Members of a ZIP file from its end records and central directory."""
    tail_at = max(0, total - 65_557)
    tail = bytes(fetch(tail_at, total - tail_at))
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (len(tail) < at + 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] > len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    count, size, start = struct.unpack_from("<HII", tail, at + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (size, start):
        locator = bytes(fetch(tail_at + at - 20, 20)) if tail_at + at >= 20 else b""
        if locator[:4] == b"PK\x06\x07":
            end = bytes(fetch(struct.unpack_from("<Q", locator, 8)[0], 56))
            if end[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            count, size, start = struct.unpack_from("<QQQ", end, 32)
    listing, found, p = bytes(fetch(start, size)), [], 0
    for _ in range(count):
        if listing[p : p + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory")
        flags, method = struct.unpack_from("<HH", listing, p + 8)
        packed, plain, n, m, k = struct.unpack_from("<IIHHH", listing, p + 20)
        header = struct.unpack_from("<I", listing, p + 42)[0]
        name = listing[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        extra, q = listing[p + 46 + n : p + 46 + n + m], 0
        while q + 4 <= len(extra):
            kind, length = struct.unpack_from("<HH", extra, q)
            if kind == 1:  # ZIP64: only what does not fit, in this order
                field = q + 4
                if plain == 0xFFFFFFFF:
                    plain, field = struct.unpack_from("<Q", extra, field)[0], field + 8
                if packed == 0xFFFFFFFF:
                    packed, field = struct.unpack_from("<Q", extra, field)[0], field + 8
                if header == 0xFFFFFFFF:
                    header = struct.unpack_from("<Q", extra, field)[0]
            q += 4 + length
        found.append(Member(name, method, header, packed))
        p += 46 + n + m + k
    return found


def data_start(fetch: Fetch, member: Member) -> int:
    """Where a member's bytes begin; its local header has lengths of its own."""
    if member.method not in (0, 8):
        raise ValueError(f"{member.name} is neither stored nor deflated")
    local = bytes(fetch(member.header, 30))
    if local[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header for {member.name}")
    return member.header + 30 + sum(struct.unpack_from("<HH", local, 26))


def _headers(text: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = text.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def parse_record(data: bytes) -> dict:
    """A WARC record: its headers, its HTTP headers and its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, headers = _headers(head)
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"headers": headers, "http": _headers(http)[1], "payload": payload}


def _bytes(fetch: Fetch, member: Member) -> Iterator[bytes]:
    """A member's content in pieces; deflated ones are inflated on the way."""
    start, at = data_start(fetch, member), 0
    inflate = zlib.decompressobj(-15) if member.method == 8 else None
    while at < member.size:
        part = bytes(fetch(start + at, min(65_536, member.size - at)))
        if not part:
            raise ValueError(f"{member.name} is cut off")
        at += len(part)
        yield inflate.decompress(part) if inflate else part


def _inflated(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """What gzip members one after the other hold; anything else as it is."""
    part = next((p for p in pieces if p), b"")
    if part[:2] != b"\x1f\x8b":
        yield part
        yield from pieces
        return
    inflate = zlib.decompressobj(31)
    while part:
        yield inflate.decompress(part)
        part = inflate.unused_data if inflate.eof else b""
        if inflate.eof and part:
            inflate = zlib.decompressobj(31)
        if not part:
            part = next((p for p in pieces if p), b"")
            if part and inflate.eof:
                inflate = zlib.decompressobj(31)
    if not inflate.eof:
        raise ValueError("a gzip member is cut off")


def _walked(pieces: Iterator[bytes]) -> Iterator[dict]:
    """Records one after the other; one at a time is held."""
    held = bytearray()
    while True:
        while held[:2] == b"\r\n":
            del held[:2]
        while (cut := held.find(b"\r\n\r\n")) < 0:
            part = next(pieces, None)
            if part is None:
                if held.strip():
                    raise ValueError("a record is cut off")
                return
            held += part
            while held[:2] == b"\r\n":
                del held[:2]
        end = cut + 4 + int(_headers(bytes(held[:cut]))[1].get("content-length", "0"))
        while len(held) < end:
            part = next(pieces, None)
            if part is None:
                raise ValueError("a record is cut off")
            held += part
        yield parse_record(bytes(held[:end]))
        del held[:end]


def _entry(line: str) -> tuple[str, int, int] | None:
    """File, offset and length of an index line; None for headers and anything else that isn't an entry."""
    try:
        entry = json.loads(line[line.index("{") :])
        return entry["filename"], int(entry["offset"]), int(entry["length"])
    except (ValueError, KeyError, TypeError):
        return None


def records(fetch: Fetch, total: int) -> Iterator[dict]:
    """All records of an archive.

    A stored member below archive/ that an index below indexes/ (plain or gzip) names is read by it, each record by
    a range of its own and once. Every other member there is walked: stored or deflated, of gzip members or plain.
    Of members of one name an index means the last; the others are walked. Index lines that are no entries, and
    those of files that aren't there, are passed over.
    """
    listed = directory(fetch, total)
    data = [m for m in listed if m.name.startswith("archive/") and not m.name.endswith("/")]
    named, starts, seen = {m.name: m for m in data}, {}, set()
    for index in (m for m in listed if m.name.startswith("indexes/") and not m.name.endswith("/")):
        for line in b"".join(_inflated(_bytes(fetch, index))).decode("utf-8", "replace").splitlines():
            entry = _entry(line)
            member = named.get("archive/" + entry[0]) if entry else None
            if member is None or member.method != 0 or (member.header, entry[1]) in seen:
                continue
            seen.add((member.header, entry[1]))
            if member.header not in starts:
                starts[member.header] = data_start(fetch, member)
            found = bytes(fetch(starts[member.header] + entry[1], entry[2]))
            yield parse_record(zlib.decompress(found, 31) if found[:2] == b"\x1f\x8b" else found)
    for member in data:
        if member.header not in starts:
            yield from _walked(_inflated(_bytes(fetch, member)))


class Writer:
    """Builds archives of bounded size."""

    def __init__(self, limit: int = ARCHIVE_BYTES):
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.data, self.index = io.BytesIO(), []

    def add(self, page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> None:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
        block = http if refers_to is not None else http + payload
        head = [f"WARC/1.1\r\nWARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
        if refers_to is not None:
            head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()
        self.index.append(f'page {len(self.index)} {{"filename": "data.warc.gz", "offset": {self.data.tell()}, "length": {len(packed)}}}')
        self.data.write(packed)

    @property
    def full(self) -> bool:
        return self.data.tell() >= self.limit

    def close(self) -> bytes | None:
        """The archive so far, or nothing."""
        if not self.index:
            return None
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            z.writestr(DATA, self.data.getbuffer())
            z.writestr(INDEX, "\n".join(self.index) + "\n")
        self._clear()
        return out.getvalue()


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives (a row of ``content`` each) with a record for each row of ``pages``.

    Null payloads are empty. Of rows with equal payloads of LEAST_REVISIT bytes or more, those of the smallest id
    are responses and the others revisit it; rows without an id are responses. Further columns are not read.
    """
    html = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), html.alias("payload"))
    digest = F.sha2(F.col("payload").cast("binary"), 256)
    large = rows.where((F.octet_length("payload") >= LEAST_REVISIT) & F.col("page_id").isNotNull()).select("page_id", digest.alias("digest"))
    groups = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").drop("last")
    revisits = large.distinct().join(groups, "digest").where("page_id > refers_to").select(F.col("page_id").alias("again_id"), F.col("digest").alias("again"), "refers_to")
    # narrow rows are joined on the digest, which a third of all pages may share; the payloads only on the even page_id
    ready = rows.withColumn("digest", digest).join(revisits, (F.col("page_id") == F.col("again_id")) & (F.col("digest") == F.col("again")), "left").select("page_id", "url", "payload", "digest", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(limit)
        done = lambda content: pa.RecordBatch.from_arrays([pa.array([hashlib.md5(content).hexdigest()]), pa.array([content], pa.binary())], names=["path", "content"])
        for b in batches:
            for page, url, payload, digest, refers in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("payload").cast(pa.binary()), b.column("digest").to_pylist(), b.column("refers_to").to_pylist(), strict=True):
                data = payload.as_py()
                writer.add(page, url, data, digest, len(data), refers)
                if writer.full:
                    yield done(writer.close())
        if content := writer.close():
            yield done(content)

    return ready.mapInArrow(write, "path string, content binary")


_RECORD = "path string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def _rows(path: str, fetch: Fetch, total: int, payloads: bool) -> Iterator[dict]:
    number = lambda x: int(x[10:-1]) if x and x[10:-1].lstrip("-").isdigit() else None
    for r in records(fetch, total):
        h, payload = r["headers"], r["payload"]
        response = h.get("warc-type") == "response"
        yield {
            "path": path, "page_id": number(h.get("warc-record-id")), "url": h.get("warc-target-uri") or None, "record_type": h.get("warc-type"), "refers_to": number(h.get("warc-refers-to")),
            "payload_bytes": len(payload) if response else int(r["http"].get("content-length", 0)),
            "payload_digest": hashlib.sha256(payload).hexdigest() if response else h.get("warc-payload-digest", "").removeprefix("sha256:"),
        } | ({"payload": payload if response else None} if payloads else {})


#: What reading an archive that isn't one, or is cut off, may raise.
BROKEN = (ValueError, KeyError, IndexError, struct.error, zlib.error, UnicodeDecodeError)


def read_archives(archives: DataFrame, payloads: bool = False, tolerant: bool = False) -> DataFrame:
    """Records of archives given as ``path`` and ``content`` (written here, or of Spark's binaryFile source).

    Null and empty contents have no records. A corrupt archive raises; if ``tolerant``, it gives the records before
    the fault and a row of its path whose record_type is corrupt. Repeated archives give their records again; an
    empty table none; further columns are not read. An archive's records are held by one task.
    """
    schema = _RECORD + (", payload binary" if payloads else "")
    kind = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in schema.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                view = memoryview(content.as_buffer()) if content.is_valid else memoryview(b"")
                found = []
                try:
                    for r in _rows(path, lambda at, n, v=view: v[at : at + n], len(view), payloads) if len(view) else ():
                        found.append(r)
                except BROKEN:
                    if not tolerant:
                        raise
                    found.append({"path": path, "record_type": "corrupt"})
                yield pa.RecordBatch.from_pylist(found, schema=kind)

    return archives.select("path", "content").mapInArrow(read, schema)


def read_archive_files(paths: DataFrame, payloads: bool = False) -> DataFrame:
    """Records of archive files that every executor can open by ``path`` (a mounted store); only ranges are read, so size is no limit. A corrupt file raises."""
    schema = _RECORD + (", payload binary" if payloads else "")
    kind = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in schema.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                with open(path, "rb") as f:
                    total = f.seek(0, 2)
                    held: list[dict] = []
                    for r in _rows(path, lambda at, n: (f.seek(at), f.read(n))[1], total, payloads):
                        held.append(r)
                        if len(held) == 256:
                            yield pa.RecordBatch.from_pylist(held, schema=kind)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=kind)

    return paths.select("path").mapInArrow(read, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = Scratch(spark, "archives").cut(write_archives(table(spark, sf_dir, "pages")))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f
"""
