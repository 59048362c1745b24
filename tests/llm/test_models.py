"""Quality, toxicity and URL classifiers: held-out accuracy and defined results at the edges."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quadrille.llm import quality, toxicity, urls
from quadrille.session import read_table

SF = "/root/testdata/sf0.1"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def held_out(spark, scored, column):
    rows = scored.where("held_out").join(read_table(spark, SF, "labels"), "doc_id").collect()
    return [(r.score, r.predicted, r[column]) for r in rows]


def auc(rows):
    pos, neg = sorted(s for s, _, y in rows if y == 1), sorted(s for s, _, y in rows if y == 0)
    from bisect import bisect_left

    return sum(bisect_left(neg, p) for p in pos) / (len(pos) * len(neg))


def test_quality_held_out(spark):
    scored = quality.op3_factorisation_machine(spark, SF)
    rows = held_out(spark, scored, "quality")
    assert auc(rows) > 0.98
    assert sum(p == y for _, p, y in rows) / len(rows) > 0.95
    good = [p for _, p, y in rows if y == 1]
    assert sum(good) / len(good) > 0.97
    assert scored.count() == read_table(spark, SF, "documents").count()


def test_toxicity_held_out(spark):
    scored = toxicity.op7_text_cnn(spark, SF)
    rows = held_out(spark, scored, "toxic")
    assert auc(rows) > 0.93
    assert sum(p == y for _, p, y in rows) / len(rows) > 0.96
    clean = [p for _, p, y in rows if y == 0]
    assert sum(clean) / len(clean) < 0.02


def odd_documents(spark):
    data = [(1, None, "en", "s", None), (2, "", None, None, -5), (3, "\x00\n\t ", "xx", "s", 1), (4, "word " * 100_000, "en", "s", 500_000), (5, "é😀 ß", "de", "s", 4), (5, "é😀 ß", "de", "s", 4), (None, "no id", "en", "s", 5)]
    return spark.createDataFrame(data, DOCS).withColumn("score", F.lit("clash")).withColumn("label", F.lit("clash"))


@pytest.fixture(scope="module")
def labels(spark):
    r = random.Random(1)
    data = [(10 + k, " ".join(r.choice(["fine", "prose", "goes", "on"]) for _ in range(60)) if k % 2 else "JUNK!! $$$ " * 20) for k in range(120)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in data], DOCS)
    said = spark.createDataFrame([(i, k % 2, 1 - k % 2) for k, (i, _) in enumerate(data)] + [(10, 1, 0), (11, 1, 0), (None, 1, 1), (99999, 1, 1), (12, None, None), (13, 7, 7)], "doc_id bigint, quality int, toxic int")
    return docs, said


@pytest.mark.parametrize("which", ["quality", "toxicity"])
def test_edges(spark, labels, which):
    docs, said = labels
    score = {"quality": quality.score_quality, "toxicity": toxicity.score_toxicity}[which]
    every = odd_documents(spark).select(docs.columns).unionByName(docs)
    rows = score(every, said).collect()
    assert len(rows) == every.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    five = [r.score for r in rows if r.doc_id == 5]
    assert len(five) == 2 and five[0] == five[1]
    assert score(odd_documents(spark), said).count() == 7
    assert score(every.limit(0), said).isEmpty()
    untaught = score(every, said.limit(0)).select("score").distinct().collect()
    assert [r.score for r in untaught] == [0.5 if which == "quality" else 0.0]


def test_scores_do_not_see_names(spark, labels):
    docs, said = labels
    one = quality.score_quality(docs, said).collect()
    model = {r.doc_id: r.score for r in one}
    other = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("zz"))
    assert {r.doc_id: r.score for r in quality.score_quality(other, said).collect()} == model


def test_quality_keeps_columns(spark, labels):
    docs, said = labels
    out = quality.score_quality(docs.withColumn("extra", F.lit(1)), said, keep_columns=True)
    assert out.columns == [*docs.columns, "extra", "held_out", "score", "predicted"]


def test_factorisation_identity():
    import numpy as np

    rng = np.random.default_rng(0)
    m = quality.Machine(np.zeros((len(quality.STATISTICS), quality.BINS - 1)))
    m.w[:] = rng.normal(size=m.w.shape)
    m.v[:] = rng.normal(size=m.v.shape)
    row, slot, value = np.repeat([0, 1], 5), rng.choice(quality.SLOTS, 10, replace=False), rng.normal(size=10)
    got, _ = m.sums(row, slot, value, 2)
    for r in (0, 1):
        s, x = slot[row == r], value[row == r]
        pairs = sum(float(m.v[s[i]] @ m.v[s[j]]) * x[i] * x[j] for i in range(5) for j in range(i))
        assert abs(got[r] - (m.w[s] @ x + pairs)) < 1e-3


ODD = [None, "", "  \n\t", "One one TWO two-two #tag 1.5 | |\nnext LINE!!\n", "é É ß 😀 x", "a " * 50 + "b", "no_white", "A|B|C ||| $$$ end$", "x\n\n\ny z.", "tab\tand\x0bfeed 12 34 AB"]


def plain_features(text, n_chars):
    """What the docstring promises, one text at a time: {word: times} and the structure statistics."""
    import math

    raw = (text or "").encode()
    tokens = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    low = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in tokens]
    times = {w: low.count(w) for w in low}
    size, n, lines = max(len(raw), 1), max(len(tokens), 1), raw.count(b"\n") + 1
    count = lambda chars: sum(raw.count(c.encode()) for c in chars)
    symbols = "#$%&*+=<>@^_`~|\\{}[]!"
    stats = [
        math.log(size), math.log1p(len(tokens)), sum(map(len, tokens)) / n, count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / size, count("0123456789") / size,
        count(symbols) / size, count(".,;:?'\"()-") / size, count("|") / n, count(" \t\n\x0b\x0c\r") / size, len(times) / n, max(times.values(), default=0) / n,
        sum(a == b for a, b in zip(low, low[1:])) / n, len(tokens) / lines, math.log(lines), sum(chr(w[-1]) in symbols for w in tokens) / n,
        math.log1p(max(n_chars, 0)) if n_chars is not None else math.nan,
    ]
    return times, stats


def test_quality_features_against_plain_python():
    import numpy as np
    import pyarrow as pa

    from quadrille.llm.words import WHITE, Words

    chars = [5, None, -3, 0, 7, 100, 8, 9, 10, 11]
    batch = pa.RecordBatch.from_arrays([pa.array(ODD, pa.string()), pa.array(chars, pa.int64())], ["text", "n_chars"])
    row, slot, value, stats = quality.describe(batch)
    slot_of = lambda w: int(Words(pa.array([w.decode()]), ~WHITE).hashes[0] >> np.uint64(64 - quality.WORD_BITS))
    for r, (text, n) in enumerate(zip(ODD, chars)):
        times, want = plain_features(text, n)
        got = dict(zip(slot[row == r].tolist(), value[row == r].tolist()))
        assert got == pytest.approx({slot_of(w): np.log1p(t) / len(times) ** 0.5 for w, t in times.items()})
        assert stats[r] == pytest.approx(want, nan_ok=True)
    edges = np.sort(np.random.default_rng(3).normal(size=(stats.shape[1], quality.BINS - 1)), axis=1)
    slots = quality.bin_slots(stats, edges)
    for r in range(len(ODD)):
        for j in range(stats.shape[1]):
            nth = quality.BINS if np.isnan(stats[r, j]) else sum(e <= stats[r, j] for e in edges[j])
            assert slots[r, j] == (1 << quality.WORD_BITS) + j * (quality.BINS + 1) + nth


def test_convolution_against_plain_loops():
    import math

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    t = toxicity
    size = t.SIDES * t.DIM
    net = t.Network([rng.normal(size=(1 << t.TABLE_BITS, t.DIM)).astype(np.float32) for _ in range(t.SIDES)], rng.normal(size=(size, sum(t.WIDTHS) * t.FILTERS)).astype(np.float32), rng.normal(size=len(t.WIDTHS) * t.FILTERS).astype(np.float32), rng.normal(size=len(t.WIDTHS) * t.FILTERS).astype(np.float32), np.float32(0.3))
    got = net.score(pa.array(ODD, pa.string()))
    for text, score in zip(ODD, got.tolist()):
        tokens = re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", (text or "").lower())
        vectors = []
        for w in tokens:
            slots, _ = t.tokens(pa.array([w]))
            assert slots[2][0] == t.tokens(pa.array([w.encode()[: t.PREFIX].decode(errors="ignore")]))[0][2][0] or not w.isascii()
            vectors.append([float(x) for side, s in zip(net.tables, slots) for x in side[s[0]]])
        pooled, column = [], 0
        for k, width in enumerate(t.WIDTHS):
            for f in range(t.FILTERS):
                best = 0.0
                for at in range(len(vectors) - width + 1):
                    z = float(net.biases[k * t.FILTERS + f])
                    for o in range(width):
                        z += sum(x * float(net.filters[d, (column + o) * t.FILTERS + f]) for d, x in enumerate(vectors[at + o]))
                    best = max(best, z)
                pooled.append(best)
            column += width
        z = sum(p * float(o) for p, o in zip(pooled, net.out)) + 0.3
        assert score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)


def test_thresholds_from_all_calibrating_labels(spark):
    """Each language's best F1 over all its calibrating rows, at their own proportions; held out and fitted rows have no say."""
    import zlib

    r = random.Random(8)
    part = lambda i: zlib.crc32(str(i).encode()) % 5
    rows = [(i, "aa" if i % 3 else ("bb" if i % 2 else None), r.betavariate(2, 3), int(r.random() < 0.2)) for i in range(3000)]
    rows = [(i, lang, min(0.999, s + 0.4 * y if lang == "aa" else s), y) for i, lang, s, y in rows]
    rare = [(9000 + k, "cc", 0.5, 1) for k in range(40)]
    scored = spark.createDataFrame(rows + rare, "doc_id bigint, lang string, score double, y int")
    said = scored.select("doc_id", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == toxicity.CALIBRATES, F.col("y")).otherwise(1 - F.col("y")).alias("toxic"))
    own, every = toxicity.calibrate(scored, said)

    def f1(some, t):
        hit = sum(y for _, _, s, y in some if s >= t)
        return 2 * hit / (sum(s >= t for _, _, s, _ in some) + sum(y for *_, y in some))

    used = [x for x in rows + rare if part(x[0]) == toxicity.CALIBRATES]
    bins = [k / toxicity.BINS for k in range(toxicity.BINS)]
    got = {x.lang: x.threshold for x in own.collect()}
    assert got.keys() == {"aa", "bb"}
    for some, t in [([x for x in used if x[1] == g], t) for g, t in got.items()] + [(used, every)]:
        assert f1(some, t) == pytest.approx(max(f1(some, b) for b in bins))


# --- URLs ------------------------------------------------------------------------------------------------------


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fits = [r for r, _ in urls.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/en/x", "https://a.example.net/EN/x", "https://a.example.net/en", "https://example.net/en/", "https://badexample.net/en/a", "ftp://example.com/de/x?y=/", "https://x.example.com/fr/", "https://a.org/fr/1", "https://a.org/fr", "https://org/fr/", "https://net", "https://a.net?x=/", "https://a.net/#f", "https://ÄB.org/fr/ü", "a://b://c/d", "https://a.net:80/x", "https://poker-casino.com/win", "https://city-library.org/about", "https://a.b/x\ny?z", "https://" + "a" * 100_000 + ".com/"]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(None, "https://a.net/", ""), (0, None, None)], "page_id bigint, url string, html string").withColumn("host", F.lit("clash"))
    rows = urls.judge_urls(pages).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        if r.page_id is None:
            continue
        host, path = plain(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule_of(host, path))
        want = dict(urls.RULES).get(r.rule) or ("block" if r.score >= 0.5 else "allow")
        assert r.verdict == want
    verdict = {r.page_id: r.verdict for r in rows}
    assert verdict[URLS.index("https://poker-casino.com/win")] == "block" and verdict[URLS.index("https://city-library.org/about")] == "allow"
    assert urls.judge_urls(pages.limit(0)).isEmpty()
    with pytest.raises(ValueError):
        urls.fit([("http://a/", 0)] * (urls.MAX_LABELLED + 1))


def test_url_model_holds_out():
    rows = urls.labelled_urls()
    train = [r for k, r in enumerate(rows) if k % 5]
    test = [r for k, r in enumerate(rows) if k % 5 == 0]
    w, b = urls.fit(train)
    import numpy as np
    import pyarrow as pa

    parts = [urls.split_python(u) for u, _ in test]
    row, slot, value = urls.ngram_features(pa.array([h for h, _ in parts]), pa.array([p for _, p in parts]))
    z = np.bincount(row, w[slot] * value, len(test)) + b
    assert np.mean((z >= 0) == np.array([y == 1 for _, y in test])) > 0.9
