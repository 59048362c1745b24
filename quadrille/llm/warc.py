"""Web archives in ZIP packages: WARC records written, and range-read back without extraction.

Each task writes ZIP files of bounded size into the shared folder: a stored member ``archive/data.warc.gz`` of
records that are compressed one by one, and a stored member ``indexes/index.cdxj`` with offset and length of
each. The reader takes a package by ranges only: the end of the file, the ZIP64 end record where there is one,
the central directory, a member's local header, the index, then the records. Packages are listed in a
checkpointed manifest, so what a lost task left behind is never read.

Records whose payloads are equal and at least ``least`` bytes long: the smallest page_id's is a response, the
others are revisits of it without a payload; smaller ones are all responses.

Defined results: a null html is an empty payload; rows that repeat a page_id are records of their own, all
responses if it is the smallest; a null page_id is never the smallest where another is, and reads back as null;
a null url is empty, line ends in one are percent-encoded; an empty table writes no package and reads back as
no row; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.tables import checkpointed, shared_path
from quadrille.llm.words import slices

#: Bytes of payload after which a package is closed, and bytes that one range read spans at most.
PACKAGE_BYTES, RANGE_BYTES = 32 << 20, 4 << 20
#: Distinct repeated payloads up to which they are broadcast.
BROADCAST_REPEATED = 50_000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
RESULT = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit tells the payload's digest and length but has no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    name = "" if page_id is None else page_id
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 2020-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def packed(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def package(records: list[tuple[bytes, dict]]) -> bytes:
    """A ZIP file with the compressed records and their index as stored members."""
    out, at, index = io.BytesIO(), 0, []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open(DATA, "w", force_zip64=True) as f:
            for data, said in records:
                f.write(data)
                index.append(json.dumps(said | {"offset": at, "length": len(data)}))
                at += len(data)
        z.writestr(INDEX, "\n".join(index))
    return out.getvalue()


# --- reading by ranges -------------------------------------------------------------------------------------


def directory(read, size: int) -> dict[str, tuple[int, int, int, int]]:
    """Members of a ZIP file by name: (offset of local header, compressed size, size, method). ``read(at, n)`` gives a range."""
    tail_at = max(0, size - 65_577)  # end record, the longest comment, and the ZIP64 locator before them
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    # an end record's comment reaches to the end of the file; the same bytes within a comment don't fit
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack("<H", tail[end + 20 : end + 22])[0] != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    locator = tail[end - 20 : end] if end >= 20 else b""
    if locator[:4] == b"PK\x06\x07" and (count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF):
        (where,) = struct.unpack("<Q", locator[8:16])
        record64 = read(where, 56)
        if record64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory where its locator points")
        count, length, start = struct.unpack("<QQQ", record64[32:56])
    raw, out, at = read(start, length), {}, 0
    for _ in range(count):
        if raw[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, = struct.unpack("<H", raw[at + 10 : at + 12])
        small, large, n, extra, note = struct.unpack("<IIHHH", raw[at + 20 : at + 34])
        (offset,) = struct.unpack("<I", raw[at + 42 : at + 46])
        name = raw[at + 46 : at + 46 + n].decode()
        more, at = raw[at + 46 + n : at + 46 + n + extra], at + 46 + n + extra + note
        while len(more) >= 4:
            tag, size_ = struct.unpack("<HH", more[:4])
            if tag == 1:  # ZIP64: only the fields that overflow, in this order
                body = more[4 : 4 + size_]
                for which in ("large", "small", "offset"):
                    if {"large": large, "small": small, "offset": offset}[which] == 0xFFFFFFFF:
                        (value,), body = struct.unpack("<Q", body[:8]), body[8:]
                        large, small, offset = (value if which == "large" else large), (value if which == "small" else small), (value if which == "offset" else offset)
            more = more[4 + size_ :]
        out[name] = (offset, small, large, method)
    return out


def stored_member(read, entry: tuple[int, int, int, int]) -> tuple[int, int]:
    """Where a stored member's bytes lie in the file: (offset, length)."""
    offset, small, _, method = entry
    if method != 0:
        raise ValueError("the member is compressed; it cannot be read by ranges")
    head = read(offset, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no local header where the directory points")
    name, extra = struct.unpack("<HH", head[26:30])
    return offset + 30 + name + extra, small


def parse(data: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of one WARC record."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = fields["WARC-Record-ID"][len("<urn:page:") : -1]
    kind = fields["WARC-Type"]
    if kind == "response":
        size, said, refers = len(payload), digest(payload), None
    else:
        told = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:] if ": " in line)
        size, said, refers = int(told["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["WARC-Refers-To"][len("<urn:page:") : -1])
    return {"page_id": int(page) if page else None, "payload_bytes": size, "payload_digest": said, "record_type": kind, "refers_to": refers}


def records_of(read, size: int) -> Iterator[dict]:
    """All records of a package, by its index; neighbouring records share a range read."""
    members = directory(read, size)
    index_at, index_size = stored_member(read, members[INDEX])
    data_at, _ = stored_member(read, members[DATA])
    wanted = [json.loads(line) for line in read(index_at, index_size).decode().split("\n") if line]
    k = 0
    while k < len(wanted):
        start, stop, last = wanted[k]["offset"], wanted[k]["offset"] + wanted[k]["length"], k + 1
        while last < len(wanted) and wanted[last]["offset"] == stop and stop + wanted[last]["length"] - start <= RANGE_BYTES:
            stop += wanted[last]["length"]
            last += 1
        block = read(data_at + start, stop - start)
        for w in wanted[k:last]:
            at = w["offset"] - start
            yield parse(zlib.decompress(block[at : at + w["length"]], 31))
        k = last


# --- Spark -------------------------------------------------------------------------------------------------


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, record_type, refers_to of every page."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", html.cast("binary").alias("payload"), F.sha1(html.cast("binary")).alias("key"))
    repeated = rows.where(F.octet_length("payload") >= least).groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first")
    repeated = checkpointed(repeated)
    few = repeated.limit(BROADCAST_REPEATED + 1).count() <= BROADCAST_REPEATED
    both = rows.join(F.broadcast(repeated) if few else repeated, "key", "left")
    again = F.col("first").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("first"), F.lit(False))
    return both.select("page_id", "url", "payload", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def write_packages(records: DataFrame, folder: str) -> DataFrame:
    """Write ``records`` (as of ``with_revisits``) as packages below ``folder``; their manifest (path, size, records)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        held, size = [], 0

        def close() -> pa.RecordBatch:
            name, data = f"{uuid.uuid4().hex}.wacz", package(held)
            with fs.open_output_stream(f"{root}/{name}") as f:
                f.write(data)
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "size": len(data), "records": len(held)}])

        for batch in batches:
            for part in slices(batch, "payload"):
                for page_id, url, payload, kind, refers_to in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    held.append((packed(record(page_id, url, payload, kind, refers_to)), {"page": page_id, "type": kind}))
                    size += len(payload)
                    if size >= PACKAGE_BYTES:
                        yield close()
                        held, size = [], 0
        if held:
            yield close()

    return checkpointed(records.mapInArrow(write, "path string, size bigint, records bigint"))


def read_packages(manifest: DataFrame) -> DataFrame:
    """One row per record of the packages in ``manifest``."""

    def read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RESULT.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist(), strict=True):
                fs, where = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(where) as f:
                    rows = []
                    for r in records_of(lambda at, n, f=f: f.read_at(n, at), size):
                        rows.append(r)
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], k) for n, k in zip(names, kinds, strict=True)], names)
                            rows = []
                    yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    # the checkpointed manifest keeps the partitions that wrote the packages, so reading is as parallel
    return manifest.mapInArrow(read_all, RESULT)


def op8_zip_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_packages(write_packages(with_revisits(pages), shared_path(spark, "warc")))


def _base32_sql(hex_: str) -> str:
    out = []
    for g in range(8):  # five hex digits are four base32 digits
        v = f"('0x' || substr({hex_}, {1 + 5 * g}, 5))::BIGINT"
        out += [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (({v} >> {s}) & 31)::INTEGER, 1)" for s in (15, 10, 5, 0)]
    return " || ".join(out)


OP8_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT page_id, strlen(p.html)::BIGINT AS payload_bytes, {_base32_sql('h')} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN m USING (html)
"""
