"""URL filters: explicit host and path rules, else logistic regression on hashed character n-grams.

The model is fitted in numpy on the driver from a small labelled URL table (a parameter, bounded by
``MAX_LABELLED`` rows); its weights, 2**BITS numbers, go to the tasks. Rules are a short list, so they become
one expression.

Defined results: a null url, or one without ``://``, has empty host and path, no rule, and the verdict of the
method on empty strings; repeated rows are judged alike; rules of equal length cannot fit one url unless they
are equal; an empty table gives an empty result; columns named like ours are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.words import FOLD, buffers, windows

BITS = 14
WIDTHS = (3, 4, 5)
MAX_LABELLED = 10_000

#: Labelled URLs: 1 is to be blocked.
BLOCKED_WORDS = ["casino", "poker", "betting", "jackpot", "slots", "adult", "xxx", "porn", "sex-cam", "escort", "pills", "viagra", "cheap-meds", "warez", "crack-keygen", "torrent-free", "win-prize", "free-money", "payday-loan", "hot-dates", "ad-server", "click-tracker", "sports-bets"]
GOOD_WORDS = ["library", "weather", "university", "museum", "garden", "science", "history", "recipes", "travel", "health", "football", "council", "journal", "school", "theatre", "hospital", "archive", "railway", "climate", "music", "kitchen", "letters", "atlas"]
PATHS = ["", "/", "/en/12", "/de/845.html", "/fr/news/2031", "/es/7?page=2&ref=x", "/about#top", "/en/5512?utm_source=feed"]
HOSTS = ["{w}.com", "www.{w}.org", "{w}-online.net", "blog.{w}.example.org", "m.{w}.example.com"]


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table: every word in hosts and, with a plain host, in a path."""
    rows = []
    for words, label in ((BLOCKED_WORDS, 1), (GOOD_WORDS, 0)):
        for i, w in enumerate(words):
            rows += [("https://" + h.format(w=w) + PATHS[(i + j) % len(PATHS)], label) for j, h in enumerate(HOSTS)]
            rows += [(f"http://site{i}.example.net/{w}/{i}.html", label), (f"https://www.place{i}.com/en/{w}-{i}", label)]
    rows += [(f"http://{GOOD_WORDS[i % 23][:4]}{GOOD_WORDS[(3 * i + 1) % 23][:3]}.example.{t}/{l}/{37 * i}{e}", 0) for i in range(40) for t in ("com", "net", "org") for l, e in (("en", ""), ("de", "/"), ("fr", ".html"))]
    return rows


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a URL; both empty without ``://``."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substr(url, F.instr(url, "://") + F.lit(3))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(F.lit("")), F.when(has, path).otherwise(F.lit(""))


#: (rule, verdict): host and path prefix.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, prefix = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + prefix))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def ngram_features(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value) of hashed n-grams of bytes of ``^host$`` and ``^path$``, each part in its own slots; a row's values have norm about 1."""
    rows, slots = [], []
    for part, column in enumerate((hosts, paths)):
        raw, offsets = buffers(pc.binary_join_element_wise(pa.scalar("^", pa.large_string()), pc.fill_null(column.cast(pa.large_string()), ""), pa.scalar("$", pa.large_string()), pa.scalar("", pa.large_string())))
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        codes = FOLD[raw].astype(np.uint64) + np.uint64(1 + 1000 * part)
        for width in WIDTHS:
            h = windows(codes, width)
            same = row[: len(h)] == row[width - 1 :][: len(h)]
            rows.append(row[: len(h)][same])
            slots.append((h[same] >> np.uint64(64 - BITS)).astype(np.int64))
    row, slot = np.concatenate(rows), np.concatenate(slots)
    n = np.bincount(row, minlength=len(hosts))
    return row, slot, 1 / np.sqrt(n[row])


def split_python(url: str | None) -> tuple[str, str]:
    """``split_url`` of one labelled row, on the driver."""
    import re

    if not url or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.partition("://")[2], re.S).groups()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def fit(labelled: list[tuple[str, int]], epochs: int = 300, rate: float = 0.5, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic regression, by AdaGrad over the whole small table."""
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"the labelled table has {len(labelled)} rows; {MAX_LABELLED} at most")
    w, b = np.zeros(1 << BITS), 0.0
    if not labelled:
        return w, b
    parts = [split_python(u) for u, _ in labelled]
    row, slot, value = ngram_features(pa.array([h for h, _ in parts]), pa.array([p for _, p in parts]))
    y = np.array([label for _, label in labelled], float)
    weight = np.where(y == 1, len(y) / max(1, 2 * y.sum()), len(y) / max(1, 2 * (1 - y).sum())) / len(y)
    g2, gb2 = np.full(len(w), 1e-8), 1e-8
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-(np.bincount(row, w[slot] * value, len(y)) + b)))
        d = (p - y) * weight
        g = np.bincount(slot, d[row] * value, len(w)) + l2 * w
        g2 += g * g
        w -= rate * g / np.sqrt(g2)
        gb2 += d.sum() ** 2
        b -= rate * d.sum() / np.sqrt(gb2)
    return w, b


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, labelled: list[tuple[str, int]] | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of ``pages``."""
    w, b = fit(labelled_urls() if labelled is None else labelled)
    model = pages.sparkSession.sparkContext.broadcast((w, b))
    host, path = split_url(F.col("url"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for batch in batches:
            row, slot, value = ngram_features(batch.column("host"), batch.column("path"))
            z = np.bincount(row, weights[slot] * value, batch.num_rows) + bias
            yield batch.append_column("score", pa.array(1 / (1 + np.exp(-z))))

    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    types = dict(pages.dtypes)
    scored = parts.mapInArrow(score, f"page_id {types['page_id']}, host string, path string, score double")
    ruled = scored.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    verdict = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    for rule, said in rules:
        verdict = F.when(F.col("rule") == rule, F.lit(said)).otherwise(verdict)
    return ruled.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
