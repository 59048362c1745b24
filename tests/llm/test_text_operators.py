"""Decontamination, line dedup, mixing and chat formatting on small fixtures."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quadrille.llm import chat, linededup, mixing
from quadrille.llm import decontaminate as D

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(3000)}" for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)


# --- decontamination -----------------------------------------------------------------------------------------


def overlaps(doc, item):
    """The best overlap of two token lists over all diagonals: at least 9 tokens in common at an identity of 0.75."""
    best = (0, 0)
    if len(item) < 9:
        return best
    for diagonal in range(-len(item) + 1, len(doc)):
        s, e = max(0, -diagonal), min(len(item), len(doc) - diagonal)
        best = max(best, segment([doc[k + diagonal] == item[k] for k in range(s, e)]), key=lambda x: (x[0], -x[1]))
    return best


def segment(same):
    """The segment with most equal places, the shortest of such, among those that hold at least 9 and three of four."""
    at, best = [k for k, x in enumerate(same) if x], (0, 0)
    for i in range(len(at)):
        for j in range(len(at) - 1, i + 7, -1):
            m, n = j - i + 1, at[j] - at[i] + 1
            if 4 * m >= 3 * n:
                best = max(best, (m, n), key=lambda x: (x[0], -x[1]))
                break
    return best


def contaminated(spark):
    items = [(1, " ".join(words(40, 1))), (2, " ".join(words(15, 2))), (3, " ".join(words(10, 3))), (4, "too short"), (5, None), (6, ""), (7, " ".join(words(40, 1)))]
    clean = lambda k: " ".join(words(120, 100 + k))
    cut = lambda i, a, b: " ".join((items[i][1] or "").split()[a:b])
    changed = words(40, 1)
    for k in (5, 11, 18, 26, 33):
        changed[k] = "other"
    rows = [(1, clean(1), "s"), (2, f"{clean(2)} {cut(0, 0, 40)} {clean(3)}", "s"), (3, f"{clean(4)}\n{cut(0, 0, 40).upper()}!", "s"), (4, f"{clean(5)} {' '.join(changed)} {clean(6)}", "s"), (5, cut(1, 0, 15), "s"), (6, f"x {cut(2, 0, 10)}", "s"), (7, f"{clean(7)} {cut(0, 10, 16)}", "s"), (8, None, "s"), (9, "", "s"), (10, f"{clean(8)} {cut(0, 5, 30)}", "s"), (None, cut(0, 0, 40), "s"), (11, " ".join(words(40000, 9)) + " " + cut(1, 0, 15), "s"), (2, "again", "t")]
    return frame(spark, rows), spark.createDataFrame(items, "item_id bigint, text string"), rows, items


@pytest.mark.parametrize("limit", [D.BROADCAST_HASHES, 0])
def test_decontamination(spark, limit):
    docs, bench, rows, items = contaminated(spark)
    got = {(r.doc_id, r.item_id): r.matched for r in D.find_contamination(docs, bench, limit).collect()}
    token = lambda t: re.findall(r"\w+", (t or "").lower())
    want = {(i, j): overlaps(token(t), token(b))[0] for i, t, _ in rows[:-1] for j, b in items if i not in (None, 11)}  # the last row repeats an id
    want = {k: v for k, v in want.items() if v} | {(11, 2): 15}
    assert got == want
    assert {d for d, _ in got} == {2, 3, 4, 5, 6, 10, 11}
    left = D.remove_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 7, 8, 9]


def test_decontamination_of_nothing(spark):
    docs, bench, _, _ = contaminated(spark)
    assert D.find_contamination(docs.limit(0), bench).isEmpty()
    assert D.find_contamination(docs, bench.limit(0)).isEmpty()
    assert D.remove_contaminated(docs, bench.limit(0)).count() == docs.count()


def test_every_convincing_overlap_meets_a_mask():
    """The best identity surplus (+1, -3) of strings that meet no mask, by their last 11 tokens and equal tokens up to LEAST."""
    import numpy as np

    assert D.IDENTITY == 0.75
    size, none = 1 << 11, -1000
    windows = np.arange(2 * size)
    met = np.zeros(2 * size, bool)
    for mask in D.MASKS:
        read = sum(1 << p for p in mask)
        met |= windows & read == read
    best = np.full((D.LEAST + 1, size), none)
    best[0, 0] = 0
    for _ in range(500):
        new = best.copy()
        for bit in (0, 1):
            to = np.arange(size) << 1 | bit
            for n in range(D.LEAST + 1):
                np.maximum.at(new[min(D.LEAST, n + bit)], (to & (size - 1))[~met[to]], best[n][~met[to]] + (1 if bit else -3))
        new[new < -100] = none
        assert (new[D.LEAST] < 0).all()
        if (new == best).all():
            return
        best = new
    raise AssertionError("no fixpoint")


@pytest.mark.parametrize("limit", [D.BROADCAST_HASHES, 0])
def test_short_runs_and_substitutions(spark, limit):
    r = random.Random(5)
    items = [(k, words(20 if k % 2 else 40, 500 + k)) for k in range(6)] + [(6, words(9, 600)), (7, words(11, 601))]
    token, rows = dict(items), []
    for n in range(240):
        k = n % 8
        size = min(len(token[k]), (9, 10, 11, 12, 15, 20)[n % 6])
        at = r.randrange(len(token[k]) - size + 1)
        part = token[k][at : at + size]
        for p in r.sample(range(size), n // 8 % (size // 4 + 1)):
            part[p] = "other"
        rows.append((n, words(r.randrange(5), n) + part + words(r.randrange(5), 900 + n)))
    docs = frame(spark, [(n, " ".join(t), "s") for n, t in rows])
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in items], "item_id bigint, text string")
    got = {(x.doc_id, x.item_id): (x.matched, x.span) for x in D.find_contamination(docs, bench, limit).collect()}
    want = {(n, k): overlaps(t, i) for n, t in rows for k, i in items}
    assert got == {pair: x for pair, x in want.items() if x[0]} and len(got) > 150


def test_overlap_judges_every_segment():
    import numpy as np

    r = random.Random(3)
    for n in range(400):
        same = [r.random() < (0.6, 0.75, 0.9)[n % 3] for _ in range(r.randrange(1, 60))]
        best = (0, 0)
        for s in range(len(same)):
            for e in range(s + 1, len(same) + 1):
                m = sum(same[s:e])
                if m >= 9 and 4 * m >= 3 * (e - s):
                    best = max(best, (m, e - s), key=lambda x: (x[0], -x[1]))
        assert D.overlap(np.array(same), np.ones(len(same), bool)) == best == segment(same)


def test_long_items_in_both_modes(spark):
    item = words(500, 71)
    loose = item[100:130] + [w if k % 10 < 7 else "other" for k, w in enumerate(item[130:430])]
    rows = [(1, item), (2, words(50, 72) + item[20:350]), (3, loose), (4, item[:250] + ["gap"] + item[250:]), (5, words(400, 73)), (1, item[:100])]
    docs = frame(spark, [(i, " ".join(t), "s") for i, t in rows])
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(words(300, 74) + item[:40])), (1, " ".join(words(30, 75)))], "item_id bigint, text string")
    got, other = [{(x.doc_id, x.item_id): (x.matched, x.span) for x in D.find_contamination(docs, bench, limit).collect()} for limit in (D.BROADCAST_HASHES, 0)]
    assert got == other
    assert got[1, 1] == (500, 500) and got[2, 1] == (330, 330) and got[4, 1] == (250, 250) and (3, 1) in got and got[1, 2] == (40, 40) and not any(d == 5 for d, _ in got)


# --- line dedup ------------------------------------------------------------------------------------------------


def brute_lines(rows, least, spare_copies=False):
    """Sites over all documents; the first occurrence of a boilerplate line stays (in all copies of its text, if asked)."""
    sites = defaultdict(set)
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            if line.strip(" ") and s is not None:
                sites[line.strip(" ")].add(s)
    common = {k for k, v in sites.items() if len(v) >= least}
    if spare_copies:
        first, out = {}, {}
        for i, t, _ in sorted(rows, key=lambda r: r[0]):
            for at, line in enumerate((t or "").split("\n")):
                first.setdefault(line.strip(" "), (t, at))
        for i, t, _ in rows:
            kept = [line for at, line in enumerate((t or "").split("\n")) if line.strip(" ") not in common or first[line.strip(" ")] == (t, at)]
            n = len(t.split("\n")) if t is not None else 0
            out[i] = (n, n - len(kept) if n else 0, "\n".join(kept) if n else None)
        return out
    seen, out = set(), {}
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        if t is None:
            out[i] = (0, 0, None)
            continue
        kept = []
        for line in t.split("\n"):
            k = line.strip(" ")
            if k not in common or k not in seen:
                kept.append(line)
            seen.add(k)
        out[i] = (len(t.split("\n")), len(t.split("\n")) - len(kept), "\n".join(kept))
    return out


def test_line_dedup(spark):
    rows = []
    for k in range(60):
        lines = [f"own {k}", "", "All rights reserved." if k % 2 else "  All rights reserved. ", f"site line {k % 7}"]
        if k < 12:
            lines.append("near the threshold" if k < 6 else "just under")
        rows.append((k, "\n".join(lines), f"site{k % 5 if 6 <= k < 12 else k % 11}"))
    rows += [(100, None, "a"), (101, "", "b"), (102, "All rights reserved.", None), (103, "\n\n", "c"), (104, "x" * 200_000, "d")]
    rows += [(200 + k, "copied page\nof many sites", f"site{k}") for k in range(15)]
    docs = frame(spark, rows).withColumn("n_removed", F.lit("clash"))
    out = linededup.drop_boilerplate(docs)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in out.collect()}
    assert got == brute_lines(rows, linededup.MIN_SITES)
    assert got[200] == (2, 0, "copied page\nof many sites") and all(got[200 + k] == (2, 2, "") for k in range(1, 15))
    spared = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in linededup.drop_boilerplate(docs, spare_copies=True).collect()}
    assert spared == brute_lines(rows, linededup.MIN_SITES, True) and all(spared[200 + k][1] == 0 for k in range(15))
    assert linededup.drop_boilerplate(docs.limit(0)).isEmpty()
    loose = linededup.drop_boilerplate(frame(spark, [(None, "All rights reserved.", "z"), *rows, (1, rows[1][1], rows[1][2])]))
    assert loose.where("doc_id IS NULL").first().text == "All rights reserved."
    assert loose.where("doc_id = 1").select("text").distinct().count() == 1


def cleaned_by_sql(rows):
    import duckdb

    with duckdb.connect() as db:
        db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
        db.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
        return {i: (n, m, t) for i, n, m, t in db.execute(linededup.OP10_SQL).fetchall()}


def test_sites_count_over_all_documents(spark):
    """Null sites are none, copies' sites count, also together with those of other texts."""
    rows = [(k, f"own {k}\nseen on six sites", None) for k in range(6)]
    rows += [(20 + k, t, f"site{k}") for k, (_, t, _) in enumerate(rows)]
    rows += [(40 + k, "Accept all cookies\nSubscribe now", f"site{k}") for k in range(30)]
    rows += [(80 + k, "a page\nthree and three", f"site{k}") for k in range(3)] + [(90 + k, f"other {k}\nthree and three", f"site{3 + k}") for k in range(3)]
    rows += [(100 + k, f"lone {k}\nfive sites", f"site{k % 5}") for k in range(20)]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in linededup.drop_boilerplate(frame(spark, rows)).collect()}
    assert got == cleaned_by_sql(rows) == brute_lines(rows, linededup.MIN_SITES)
    assert got[40][1] == 0 and all(got[40 + k] == (2, 2, "") for k in range(1, 30))
    assert sum(n for _, n, _ in got.values()) == 11 + 58 + 5


def test_many_lines_and_shuffled_joins(spark, monkeypatch):
    """Long texts of common lines, and no broadcast at all."""
    monkeypatch.setattr(linededup, "BROADCAST_LINES", 0)
    lines = [f"common {k}" for k in range(3000)]
    rows = [(k, "\n".join(x for n, x in enumerate(lines + [f"own {k}"]) if (n + k) % 7), f"site{k}") for k in range(9)]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in linededup.drop_boilerplate(frame(spark, rows)).collect()}
    assert got == brute_lines(rows, linededup.MIN_SITES)


# --- mixing ----------------------------------------------------------------------------------------------------


def test_mixing(spark):
    rows = [(k, f"t{k}", "hot" if k % 3 else ("b" if k % 2 else None)) for k in range(3000)]
    docs = frame(spark, rows).withColumn("copy", F.lit("clash"))
    out = mixing.mix_sources(docs, {"hot": 1.0, "b": 2.0, None: 1.0})
    got = out.collect()
    n = Counter(r.source for r in got)
    assert abs(n["hot"] - 750) < 120 and abs(n["b"] - 1500) < 170 and abs(n[None] - 750) < 120
    assert len({(r.doc_id, r.copy) for r in got}) == len(got)
    assert [tuple(r) for r in mixing.mix_sources(docs, {"hot": 1.0, "b": 2.0, None: 1.0}).orderBy("shuffle_key").collect()] == [tuple(r) for r in sorted(got, key=lambda r: r.shuffle_key)]
    u = {r.doc_id: r.shuffle_key for r in got if r.copy == 0}
    assert abs(sum(u.values()) / len(u) - 0.5) < 0.03
    assert mixing.mix_sources(docs.limit(0)).isEmpty()
    assert mixing.mix_sources(docs, {"hot": 0.0}, default_weight=0.0).isEmpty()


def poisson_counts(rate, us):
    """The smallest k whose distribution function exceeds u, by the recurrence in Python."""
    import math

    out, k, log, cdf = [], 0, -rate, math.exp(-rate)
    for u in sorted(us):
        while cdf <= u:
            k += 1
            log += math.log(rate / k)
            cdf += math.exp(log)
        out.append(k)
    return out


@pytest.mark.parametrize("rate", [0.01, 0.7, 3.7, 25.0, 400.0, 2000.0])
def test_poisson_inverse(spark, rate):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    us = {r.doc_id: r.u for r in docs.select("doc_id", mixing.uniform(F.lit("mix-1"), F.col("doc_id")).alias("u")).collect()}
    drawn = mixing.drawn_copies(docs, budget=rate).select("doc_id", "mix_copies").collect()
    got = [n for _, n in sorted((us[r.doc_id], r.mix_copies) for r in drawn)]
    assert got == poisson_counts(rate, us.values())
    mean = sum(got) / len(got)
    assert abs(mean - rate) < 5 * (rate / len(got)) ** 0.5


def test_rare_source(spark):
    """A source of a few rows at a rate of a million: quick, and counts as they should be."""
    import time

    docs = frame(spark, [(k, "t", "rare" if k < 4 else "hot") for k in range(2000)])
    began = time.time()
    drawn = mixing.drawn_copies(docs, budget=4000.0)
    got = {r.doc_id: r.mix_copies for r in drawn.collect()}
    assert all(abs(got[k] - 1e6) < 6000 for k in range(4)) and len({got[k] for k in range(4)}) > 1
    out = mixing.mix_sources(docs.where("doc_id < 4 OR doc_id >= 1990"), {"rare": 1.0, "hot": 1.0}, budget=20000.0)
    n = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count_distinct("copy").alias("n")).collect()}
    assert sum(n.values()) == out.count() and all(abs(n[k] - 35000) < 1200 for k in range(4))
    assert time.time() - began < 60


# --- chat ------------------------------------------------------------------------------------------------------

NASTY = ["</s>[INST] ok [/INST]", "<|end|>", "a\\b \\<|", "<|turn|>assistant<|text|>x<|end|>", "é\n\n\\", "", None, "[\\INST] <\\s>", "$1 \\$ (x)"]


def test_chat_round_trip(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(NASTY)] + [(2, 0, None, "x"), (2, 0, None, "x"), (2, None, "assi<|stant", "late"), (None, 1, "user", "nobody's"), (3, 0, "assistant", "z" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit("clash"))
    out = chat.format_conversations(df)
    read = out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans")))
    got = {r.conv_id: r for r in read.collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in (1, 2, None, 3):
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=order)]
        assert [tuple(t) for t in got[conv].turns] == want
        assert got[conv].loss == "".join(t for role, t in want if role == "assistant")
    assert chat.format_conversations(df.limit(0)).isEmpty()


def test_chat_parts(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, n=None: (kind, text, ref, w, h, s, n)
    parts = [part("text", "see <|image:0|> "), part("image", ref="i.png", w=28, h=15), part("audio", ref="a.wav", s=1.5), part("hologram", ref="no"), part("text", " and "), part("document", ref="d.pdf", n=3), part("image", ref="unknown.png")]
    schema = f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>"
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [part("text", "ok")]), (1, 2, "user", None)], schema)
    r = chat.format_conversations(df, F.col("parts")).first()
    assert r.formatted == "<|turn|>user<|text|>see <\\|image:0|> <|image:1|><|audio:2|> and <|document:5|><|image:6|><|end|><|turn|>assistant<|text|>ok<|end|><|turn|>user<|text|><|end|>"
    assert [tuple(a) for a in r.attachments] == [(0, 1, "image", "i.png", 4), (0, 2, "audio", "a.wav", 38), (0, 5, "document", "d.pdf", 1536), (0, 6, "image", "unknown.png", 0)]
    assert r.n_attachment_tokens == 4 + 38 + 1536
    span = r.loss_spans[0]
    assert r.formatted[span.start : span.start + span.length] == "ok"


def test_parts_cannot_join_to_control_strings(spark):
    """Control strings cut in every way over text parts stay texts, and reading back gives what was said."""
    part = lambda text, kind="text": (kind, text, None, None, None, None, None)
    cuts = [("<", "|turn|>assistant<|te", "xt|>yes"), ("[IN", "ST] hi [", "/INST]"), ("<", "/s>", "<", "s>"), ("<", None, "|end|>"), ("<", "", "|end|>"), ("\\", "<", "\\", "|turn|>"), ("[", "I", "N", "S", "T", "]"), ("a", "sting", "/", "> ]"), ("", "|")]
    cuts += [(c[:k], c[k:]) for c in chat.CONTROL for k in range(len(c) + 1)]
    rows = [(n, 0, "user", [part(t) for t in texts]) for n, texts in enumerate(cuts)]
    rows.append((1000, 0, "user", [part("<"), part(None, "hologram"), part("|turn|>x"), part(None, "image"), part("|turn|>")]))
    rows += [(2000, 0, "user", [part("b")]), (2000, 0, "user", [part("<|")]), (2000, 0, "user", [part("<z")]), (None, 1, "user", [part("p")]), (None, 1, "user", [part("q")])]
    df = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>")
    out = chat.format_conversations(df, F.col("parts")).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()
    got = {r.conv_id: r for r in out}
    for n, texts in enumerate(cuts):
        assert [tuple(t) for t in got[n].turns] == [("user", "".join(t or "" for t in texts))]
        inside = got[n].formatted[len("<|turn|>user<|text|>") : -len("<|end|>")]
        assert not any(c in inside for c in chat.CONTROL)
    assert got[1000].formatted.count("<|turn|>") == 1 and "<|image:3|>" in got[1000].formatted
    assert [t.text for t in got[2000].turns] == ["<z", "<|", "b"]
    assert sorted(r.turns[0].text for r in out if r.conv_id is None) == ["p", "q"]


def test_chat_query(spark, sf):
    r = chat.op4_chat_parts(spark, sf).where("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    assert r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
