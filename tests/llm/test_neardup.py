import random
import re

import pytest
from pyspark.sql import functions as F

from quadrille.llm import neardup as N
from quadrille.llm.components import components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def cases():
    base = words(200, 1)
    rows = [(10, " ".join(base)), (11, " ".join(base).upper()), (12, "\t".join(base) + "\n")]
    for k in range(40):  # a chain of edits: neighbours are alike, ends are not
        base = [*base]
        base[(7 * k) % 200] = f"new{k}"
        rows.append((20 + k, " ".join(base)))
    rows += [(100, None), (101, ""), (102, "  \n"), (103, "one"), (104, "One"), (105, "one two"), (106, "two one"), (107, "a b c"), (108, "a b c")]
    rows += [(200, " ".join(words(30000, 3))), (201, " ".join(words(30000, 3)[:-400]))]
    return rows + [(300 + k, " ".join(words(80, 50 + k))) for k in range(20)]


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_against_all_pairs(spark, width, percent, monkeypatch):
    monkeypatch.setattr(N, "CELL", 8)  # the chain becomes a family of many parts
    rows = cases()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(frame(spark, rows), width, percent).collect()}
    assert got == brute(rows, width, percent)


def dense(n, seed, first=1000):
    """Copies of one text with a few changes each, some of them far from the rest but near to one another."""
    r, base = random.Random(seed), words(300, seed)
    rows = []
    for k in range(n):
        w = [*base]
        for at in r.sample(range(300), r.randrange(1, 12)):
            w[at] = f"x{k}_{at}"
        rows.append((first + k, " ".join(w)))
    far = [*base]
    for at in range(0, 300, 25):
        far[at] = f"far{at}"
    for k in range(6):
        w = [*far]
        w[5 + k] = f"y{k}"
        rows.append((first + 500 + k, " ".join(w)))
    return rows


@pytest.mark.parametrize("cell", [4, 16, 1024])
def test_dense_groups_against_all_pairs(spark, cell, monkeypatch):
    monkeypatch.setattr(N, "CELL", cell)
    rows = dense(60, 11) + dense(25, 12, 2000) + [(1, " ".join(words(300, 11))), (2, "alone among many")]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(frame(spark, rows), 3, 85).collect()}
    assert got == brute(rows, 3, 85)


def test_templates_form_no_families(spark):
    """Texts that share half of their words in one block meet in buckets, but no link passes, so nothing is confirmed in cells."""
    template = words(120, 5)
    rows = [(k, " ".join(template + words(120, 100 + k))) for k in range(150)]
    docs = frame(spark, rows)
    links = []
    keep = N.candidate_links
    try:
        N.candidate_links = lambda *a: links.append(keep(*a)) or links[-1]
        got = {r.doc_id: r.component_id for r in N.near_duplicates(docs, 3, 85).collect()}
    finally:
        N.candidate_links = keep
    assert got == {k: k for k, _ in rows}
    assert links[0].count() <= 5


def test_dealt_cells(spark, monkeypatch):
    """What is already one component meets the rest, never itself: cells grow with its size, not the square."""
    monkeypatch.setattr(N, "CELL", 8)
    members = spark.range(1000).select(F.lit(1).alias("f"), "id", (F.col("id") < 3).alias("rest"), F.lit(1).alias("weight"))
    rows = N.dealt(members, "f").collect()
    assert len(rows) < 1000 + 3 * 130
    cells = {}
    for r in rows:
        cells.setdefault((r.i, r.j), set()).add(r.id)
    for a in range(3):
        for b in range(1000):
            assert a == b or any(a in c and b in c for c in cells.values())


def test_query_on_a_fixture(spark, sf, tmp_path):
    rows = cases()[:30]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.op9_bbit_minhash(spark, str(tmp_path)).collect()}
    assert got == brute(rows, 3, 85)


def test_edges(spark):
    empty = N.near_duplicates(frame(spark, []))
    assert empty.columns == ["doc_id", "n_shingles", "component_id", "kept"] and empty.isEmpty()
    odd = frame(spark, [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]).withColumn("keys", F.lit(1)).withColumn("packed", F.lit("x"))
    got = sorted(map(tuple, N.near_duplicates(odd).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True)], key=str)


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (20, 3)] + [(k + 1, k) for k in range(100, 160)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert {n: got[n] for n in (1, 2, 3, 20, 9, 8, 7)} == {1: 1, 2: 1, 3: 1, 20: 1, 9: 7, 8: 7, 7: 7}
    assert {got[k] for k in range(100, 161)} == {100} and 5 not in got
    assert components(spark.createDataFrame([], "a bigint, b bigint")).isEmpty()


def test_native_lanes_equal_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**64, (40, N.SIGNED * N.BITS // 64), dtype=np.uint64)
    x[20:, ::2] = x[:20, ::2]
    rows = [(a.view(np.int64).tolist(), b.view(np.int64).tolist()) for a, b in zip(x[:20], x[20:])]
    got = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>").select(N.similar_lanes(F.col("a"), F.col("b")).alias("n")).collect()
    assert [r.n for r in got] == np.diag(N.equal_lanes(x[:20], x[20:])).tolist()
    assert (N.estimate(np.array([N.least_lanes(85) - 1, N.least_lanes(85)])) >= N._margin(0.85)).tolist() == [False, True]


def test_estimate_is_unbiased():
    import numpy as np

    rng = np.random.default_rng(0)
    for true in (0.0, 0.5, 0.9):
        got = []
        for _ in range(30):
            both = rng.integers(1, 2**63, int(400 * true), dtype=np.uint64)
            rest = (400 - len(both)) // 2
            sets = [np.unique(np.concatenate([both, rng.integers(1, 2**63, rest, dtype=np.uint64)])) for _ in "ab"]
            h, cut = np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
            _, packed = N.signatures(h, cut)
            got.append(N.estimate(N.equal_lanes(packed[:1], packed[1:]))[0, 0])
        assert abs(np.mean(got) - true) < 0.03
