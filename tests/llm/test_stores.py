"""Nearest neighbours and web archives."""

import base64
import hashlib
import io
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import ann, warc
from quadrille.llm.tables import shared_path


def exact(rows, top):
    """Brute force over distinct ids: query_id -> [(vec_id, score)]."""
    x = {i: np.array(v, float) for i, v in rows}
    out = {}
    for q in x:
        if q % 20 == 0:
            s = sorted(((float(x[q] @ x[i]), i) for i in x if i != q), key=lambda t: (-round(t[0], 12), t[1]))
            out[q] = [(i, s_) for s_, i in s[:top]]
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def vectors(n, seed, clusters=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16))
    if clusters:
        x = 4 * rng.normal(size=(clusters, 16))[rng.integers(0, clusters, n)] + x
    return np.round(x, 2).astype(np.float32)


def test_all_buckets_are_exact(spark):
    x = vectors(300, 1)
    x[100:180] = x[100]  # ties
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(1000, None, 0), (1020, [0.0] * 16, 0), (1040, [float("nan")] * 16, 0), (1060, [1.0, 2.0], 0), (1080, [float("inf")] + [1.0] * 15, 0), (1100, [None] + [1.0] * 15, 0), (None, x[0].tolist(), 0), (40, x[40].tolist(), 0), (1120, [], 0)]
    got = ann.nearest(table(spark, rows + odd).withColumn("score", F.lit("clash")), F.col("vec_id") % 20 == 0, success=1.0)
    mine = {}
    for r in got.orderBy("query_id", "rank").collect():
        mine.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(mine[r.query_id])
    want = exact([(i, v) for i, v, _ in rows], 20)
    assert mine.keys() == want.keys()
    for q in want:
        assert [i for i, _ in mine[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in mine[q]], [s for _, s in want[q]], rtol=0, atol=1e-9)


def test_few_vectors_and_none(spark):
    some = table(spark, [(20, [1.0, 0.0], 0), (21, [0.5, 0.5], 0), (22, [-1.0, 0.0], 0)])
    assert [(r["rank"], r.vec_id, r.score) for r in ann.nearest(some, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [(1, 21, 0.5), (2, 22, -1.0)]
    assert ann.nearest(some.limit(0), F.lit(True)).isEmpty()
    assert ann.nearest(table(spark, [(20, [1.0], 0)]), F.lit(True)).isEmpty()


def recall(spark, x, least=20):
    """Recall of each query against brute force, by the operator's own parameters."""
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = {}
    for r in ann.nearest(table(spark, rows), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = exact([(i, v) for i, v, _ in rows], 20)
    assert all(len(v) == least for v in got.values()) and got.keys() == want.keys()
    return {q: len(got[q] & {i for i, _ in want[q]}) / least for q in want}


@pytest.mark.parametrize(("n", "clusters"), [(4000, 0), (4000, 40), (600, 0)])
def test_recall(spark, n, clusters, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 512)
    monkeypatch.setattr(ann, "STEP", 100)
    found = recall(spark, vectors(n, 2, clusters))
    assert sum(found.values()) / len(found) >= 0.9


def test_recall_of_copies_and_of_isolated_vectors(spark):
    """Four of five rows lie in tight groups of copies, the others anywhere: both kinds are found."""
    rng = np.random.default_rng(4)
    n = 4000
    alone = np.arange(n) % 100 < 20
    x = rng.normal(size=(n, 16))
    x[~alone] = rng.normal(size=(n // 32, 16))[rng.integers(0, n // 32, (~alone).sum())] + 0.01 * rng.normal(size=((~alone).sum(), 16))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    found = recall(spark, x)
    for kind in (True, False):
        some = [v for q, v in found.items() if alone[q] == kind]
        assert len(some) > 30 and sum(some) / len(some) >= 0.9


def test_repeated_ids_do_not_crowd_out_others(spark):
    """Thirty rows of one id count once, wherever they lie."""
    x = vectors(60, 9)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(7, (50 * x[20] + 0.01 * k).tolist(), 0) for k in range(30)] + [(8, (60 * x[20]).tolist(), 0)] * 30
    got = [(r.vec_id, r["rank"]) for r in ann.nearest(table(spark, rows), F.col("vec_id") == 20).orderBy("rank").collect()]
    assert [k for _, k in got] == list(range(1, 21)) and {i for i, _ in got[:2]} == {7, 8} and len({i for i, _ in got}) == 20


# --- archives --------------------------------------------------------------------------------------------------


def told(pages, least=0):
    first, out = {}, []
    for i, _, html in pages:
        data = (html or "").encode()
        if i is not None:
            first[data] = min(first.get(data, i), i)
    for i, _, html in pages:
        data = (html or "").encode()
        again = len(data) >= least and data in first and first[data] != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[data] if again else None))
    return sorted(out, key=str)


PAGES = [(5, "http://a/", "<p>é</p>"), (3, "http://b/", "<p>é</p>"), (9, None, "<p>é</p>"), (1, "http://c/\r\nX: y", ""), (2, "u", None), (4, "u", "WARC/1.1\r\n\r\n" * 50), (6, "u", "x" * 300_000), (3, "http://b/", "<p>é</p>"), (None, "n", "alone"), (None, "n", "<p>é</p>")]


@pytest.mark.parametrize("least", [0, 5])
def test_archive_round_trip(spark, least, monkeypatch):
    monkeypatch.setattr(warc, "PACKAGE_BYTES", 1000)
    monkeypatch.setattr(warc, "RANGE_BYTES", 200)
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("payload", F.lit("clash"))
    got = warc.read_packages(warc.write_packages(warc.with_revisits(pages, least), shared_path(spark, "warc")))
    assert sorted(map(tuple, got.collect()), key=str) == told(PAGES, least)


def test_archive_of_nothing(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.read_packages(warc.write_packages(warc.with_revisits(pages), shared_path(spark, "warc"))).isEmpty()


def as_zip64(data: bytes) -> bytes:
    """The same package as if counts, sizes and offsets had overflown, by the format's rules."""
    end = data.rfind(b"PK\x05\x06")
    count, size, start = struct.unpack("<HII", data[end + 10 : end + 20])
    directory, at, out = data[start : start + size], 0, b""
    for _ in range(count):
        small, large, n, extra, note = struct.unpack("<IIHHH", directory[at + 20 : at + 34])
        (offset,) = struct.unpack("<I", directory[at + 42 : at + 46])
        field = struct.pack("<HHQQQ", 1, 24, large, small, offset)
        other = struct.pack("<HHI", 0x9999, 4, 7)
        full = b"\xff" * 4
        out += directory[at : at + 20] + full + full + struct.pack("<HHH", n, len(field) + len(other), 0) + directory[at + 34 : at + 42] + full + directory[at + 46 : at + 46 + n] + other + field
        at += 46 + n + extra + note
    where = start + len(out)
    record = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, len(out), start)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, where, 1)
    return data[:start] + out + record + locator + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 9) + b"a comment"


def test_end_records_in_comments():
    """Comments that hold the mark of an end record, and the longest comment behind a ZIP64 locator."""
    data = warc.package([(warc.packed(warc.record(i, "u", b"text", "response", None)), {"page": i}) for i in range(3)])
    ends = data.rfind(b"PK\x05\x06")
    for comment in (b"see PK\x05\x06 and more bytes than an end record has", b"PK\x05\x06", b"x" * 65_535):
        plain = data[: ends + 20] + struct.pack("<H", len(comment)) + comment
        large = as_zip64(data)
        large = large[: large.rfind(b"PK\x05\x06") + 20] + struct.pack("<H", len(comment)) + comment
        for d in (plain, large):
            assert [r["page_id"] for r in warc.records_of(lambda at, n, d=d: d[at : at + n], len(d))] == [0, 1, 2]


def test_zip64_and_damage():
    made = [(warc.packed(warc.record(i, "u", f"text {i}".encode(), "response", None)), {"page": i}) for i in range(5)]
    data = warc.package(made)
    assert zipfile.ZipFile(io.BytesIO(data)).testzip() is None
    for d in (data, as_zip64(data)):
        reads = []

        def read(at, n, d=d, reads=reads):
            reads.append((at, n))
            return d[at : at + n]

        assert [r["page_id"] for r in warc.records_of(read, len(d))] == list(range(5))
    with pytest.raises(ValueError):
        warc.directory(lambda at, n: b"\0" * n, 100)
    squeezed = io.BytesIO()
    with zipfile.ZipFile(squeezed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc.INDEX, "x" * 100)
        z.writestr(warc.DATA, "x" * 100)
    raw = squeezed.getvalue()
    with pytest.raises(ValueError):
        list(warc.records_of(lambda at, n: raw[at : at + n], len(raw)))
