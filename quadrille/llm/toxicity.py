"""Toxicity: a convolutional text classifier in numpy.

A word is three hashed embeddings side by side: two of the whole word (two tables, so that a chance collision in
one is not enough) and one of its beginning, which inflected forms share. Filters of several widths slide over the words of the whole text, each keeps its largest response, and a
logistic layer reads those. It is fitted on the driver on at most 2 x PER_CLASS labelled texts; the embeddings
start from smoothed log odds of the words in that sample and are trained on, as are filters and output layer.
Scoring is one pass over whole texts. Labels whose crc32 remainder is CALIBRATES never reach the fit: all of them, at
their true proportions, set the thresholds by language (``threshold``, ``flagged``), from counts of their scores in
BINS intervals; the score itself never sees the language.

Defined results: null, empty or wordless texts pool to zero and get the score of the bias; without labels of
both classes every score is 0; a language, or null, with fewer than LEAST_LABELS calibrating rows of a class has the
threshold over all, and that is 0.5 without such rows of both classes; repeated rows are scored alike; an empty table
gives an empty result; columns named like ours are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.labelled import label_table, labelled_sample, remainder
from quadrille.llm.tables import checkpointed
from quadrille.llm.words import ALNUM, Words, slices

TABLE_BITS, DIM, WIDTHS, FILTERS = 16, 4, (1, 2, 3), 8
#: Bytes of a word's beginning.
PREFIX, SIDES = 6, 3
#: Bound of the sample that the model is fitted on: rows of each class.
PER_CLASS = 2000
#: Remainder of the rows that calibrate (0 is held out, the others are fitted on), score intervals, rows of a class that a language needs.
CALIBRATES, BINS, LEAST_LABELS = 1, 4096, 10
BROADCAST_LANGUAGES = 10_000
#: Rows of a sampled class in which a word must stand for its log odds to count.
LEAST_ROWS, SHRINK = 4, 4.0


def tokens(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """A slot in each table for every lower-cased word, and n + 1 bounds of the rows."""
    w = Words(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")), ALNUM, prefix=PREFIX)
    mask = np.uint64((1 << TABLE_BITS) - 1)
    return [(x & mask).astype(np.int32) for x in (w.hashes, w.hashes >> np.uint64(32), w.prefixes)], w.first


class Network:
    """Arrays: embedding tables, filter weights (SIDES x DIM, offsets x FILTERS), filter biases, output layer."""

    def __init__(self, tables, filters, biases, out, out_bias):
        self.tables, self.filters, self.biases, self.out, self.out_bias = tables, filters, biases, out, out_bias

    def arrays(self):
        return self.tables, self.filters, self.biases, self.out, self.out_bias

    def pooled(self, slots: list[np.ndarray], bounds: np.ndarray, where: bool = False):
        """(rows, filters) of largest responses, at least 0; with ``where``, also the windows that gave them and the word vectors."""
        n, row = len(bounds) - 1, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        words = np.concatenate([t[x] for t, x in zip(self.tables, slots, strict=True)], axis=1)
        every = words @ self.filters
        out, places, at = np.zeros((n, len(WIDTHS) * FILTERS), np.float32), [], 0
        for k, width in enumerate(WIDTHS):
            m = max(0, len(words) - width + 1)
            z = np.zeros((m, FILTERS), np.float32) + self.biases[k * FILTERS : (k + 1) * FILTERS]
            for o in range(width):
                z += every[o : o + m, (at + o) * FILTERS : (at + o + 1) * FILTERS]
            at += width
            own = np.flatnonzero(row[:m] == row[width - 1 :][:m])
            best = np.full((n, FILTERS), -1, np.int64)
            if len(own):
                z, rows = z[own], row[own]
                head = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
                top = np.maximum.reduceat(z, head, axis=0)
                out[rows[head], k * FILTERS : (k + 1) * FILTERS] = top
                if where:
                    tail = np.append(head[1:], len(rows))
                    for r, s, e in zip(rows[head].tolist(), head.tolist(), tail.tolist(), strict=True):
                        best[r] = own[s + z[s:e].argmax(0)]
            places.append(best)
        return (np.maximum(out, 0), places, words) if where else np.maximum(out, 0)

    def score(self, column: pa.Array) -> np.ndarray:
        z = self.pooled(*tokens(column)) @ self.out + self.out_bias
        return 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))


def _log_odds(slots: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    n = [np.zeros(1 << TABLE_BITS), np.zeros(1 << TABLE_BITS)]
    for s, label in zip(slots, y, strict=True):
        n[int(label)][np.unique(s)] += 1
    odds = np.log((n[1] + 1) / (y.sum() + 2)) - np.log((n[0] + 1) / (len(y) - y.sum() + 2))
    rows = n[0] + n[1]
    return np.where(rows >= LEAST_ROWS, np.clip(odds, -3, 3) * rows / (rows + SHRINK), 0)


def fit(texts: list[tuple[np.ndarray, ...]], y: np.ndarray, priors: dict[int, int], epochs: int = 6, size: int = 64, rate: float = 0.01) -> Network:
    """Minibatch Adam on the dense layers and AdaGrad on the embedding rows in use."""
    rng = np.random.default_rng(7)
    tables = []
    for side in range(SIDES):
        t = rng.normal(0, 0.01, (1 << TABLE_BITS, DIM)).astype(np.float32)
        used = np.zeros(1 << TABLE_BITS, bool)
        for x in texts:
            used[x[side]] = True
        t[~used] = 0
        t[:, 0] = 0.5 * _log_odds([x[side] for x in texts], y)
        tables.append(t)
    k = len(WIDTHS) * FILTERS
    filters = rng.normal(0, 0.2, (SIDES * DIM, sum(WIDTHS) * FILTERS)).astype(np.float32)
    filters[::DIM] = np.abs(filters[::DIM]) + 0.2
    net = Network(tables, filters, np.full(k, -0.5, np.float32), np.full(k, 0.1, np.float32), np.float32(-1))
    weight = np.where(y == 1, priors[1] / y.sum(), priors[0] / (1 - y).sum())
    # between the labelled proportions and even classes
    weight = np.sqrt(weight * np.where(y == 1, 1 / y.sum(), 1 / (1 - y).sum()))
    weight *= len(y) / weight.sum()
    dense = [net.filters, net.biases, net.out]
    state, seen, t, ob = [(np.zeros_like(p), np.zeros_like(p)) for p in dense], [np.full((1 << TABLE_BITS, 1), 1e-6, np.float32) for _ in tables], 0, [0.0, 0.0]
    for _ in range(epochs):
        for at in range(0, len(y), size):
            if at == 0:
                order = rng.permutation(len(y))
            some = order[at : at + size]
            slots = [np.concatenate([texts[i][side] for i in some]) for side in range(SIDES)]
            bounds = np.concatenate([[0], np.cumsum([len(texts[i][0]) for i in some])])
            pool, places, words = net.pooled(slots, bounds, True)
            p = 1 / (1 + np.exp(-np.clip(pool @ net.out + net.out_bias, -30, 30)))
            d = ((p - y[some]) * weight[some] / len(some)).astype(np.float32)
            d_pool = d[:, None] * net.out[None, :] * (pool > 0)
            g_filters, g_biases, col = np.zeros_like(net.filters), d_pool.sum(0), 0
            touched, grads = [], []
            for w, (width, best) in enumerate(zip(WIDTHS, places, strict=True)):
                part = d_pool[:, w * FILTERS : (w + 1) * FILTERS]
                r, f = np.nonzero((part != 0) & (best >= 0))
                g = part[r, f][:, None]
                for o in range(width):
                    c = (col + o) * FILTERS + f
                    np.add.at(g_filters.T, c, g * words[best[r, f] + o])
                    touched.append(best[r, f] + o)
                    grads.append(g * net.filters.T[c])
                col += width
            place, g_words = np.concatenate(touched), np.concatenate(grads)
            t += 1
            for q, g, (m, v) in zip(dense, (g_filters + 1e-4 * net.filters, g_biases, pool.T @ d + 1e-4 * net.out), state, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            ob = [0.9 * ob[0] + 0.1 * d.sum(), 0.999 * ob[1] + 0.001 * d.sum() ** 2]
            net.out_bias -= rate * (ob[0] / (1 - 0.9**t)) / (np.sqrt(ob[1] / (1 - 0.999**t)) + 1e-8)
            for side, (table, g2, slot) in enumerate(zip(net.tables, seen, slots, strict=True)):
                cut = slice(side * DIM, (side + 1) * DIM)
                rows, inverse = np.unique(slot[place], return_inverse=True)
                g = np.zeros((len(rows), DIM), np.float32)
                np.add.at(g, inverse, g_words[:, cut])
                g2[rows] += (g * g).mean(1, keepdims=True)
                table[rows] -= 0.02 * g / np.sqrt(g2[rows])
    return net


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Network | None:
    """The network, from rows whose crc32 mod 5 is neither 0 nor CALIBRATES."""
    sample, priors = labelled_sample(docs.select("doc_id", "text"), labels, "toxic", ~remainder(5).isin(0, CALIBRATES), per_class)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                slots, bounds = tokens(part.column("text"))
                cut = pa.array(bounds, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("label"), *(pa.ListArray.from_arrays(cut, pa.array(x)) for x in slots)], ["label", "a", "b", "c"])

    pdf = sample.select("label", "text").mapInArrow(features, "label int, a array<int>, b array<int>, c array<int>").toArrow().to_pandas()  # 2 x per_class rows at most
    y = pdf.label.to_numpy(float)
    if not 0 < y.sum() < len(y):
        return None
    return fit(list(zip(pdf.a, pdf.b, pdf.c, strict=True)), y, priors)


def best_thresholds(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, threshold, clean, toxic): the lower end of the interval from which flagging has the best F1, of (by, bin, label, n); the higher of equals."""
    n = counts.groupBy(*by, "bin").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("hit"), F.sum("n").alias("all"))
    above = Window.partitionBy(*by).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)  # BINS rows at most
    whole = Window.partitionBy(*by)
    f1 = 2 * F.sum("hit").over(above) / (F.sum("all").over(above) + F.sum("hit").over(whole))
    rows = n.select(*by, "bin", "hit", "all", f1.alias("f1"))
    found = rows.groupBy(*by).agg(F.max_by("bin", F.struct("f1", "bin")).alias("bin"), F.sum(F.col("all") - F.col("hit")).alias("clean"), F.sum("hit").alias("toxic"))
    return found.select(*by, (F.col("bin") / BINS).alias("threshold"), "clean", "toxic")


def calibrate(scored: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """(lang, threshold) of languages with labels enough, and the threshold over all, from the calibrating rows of ``scored`` (doc_id, lang, score)."""
    told = label_table(labels, "toxic", remainder(5) == CALIBRATES)
    counts = checkpointed(scored.join(told, "doc_id").groupBy("lang", F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).alias("bin"), "label").agg(F.count(F.lit(1)).alias("n")))
    every = best_thresholds(counts.withColumn("one", F.lit(1)), ["one"]).where("clean > 0 AND toxic > 0").first()
    own = best_thresholds(counts.where("lang IS NOT NULL"), ["lang"]).where((F.col("clean") >= LEAST_LABELS) & (F.col("toxic") >= LEAST_LABELS))
    return own.select("lang", "threshold"), every.threshold if every else 0.5


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted, threshold, flagged for every document."""
    net = train(docs, labels, per_class)
    model = docs.sparkSession.sparkContext.broadcast(None if net is None else net.arrays())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None if model.value is None else Network(*model.value)
        for batch in batches:
            for part in slices(batch, max_bytes=1 << 20):
                got = np.zeros(part.num_rows) if own is None else own.score(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), part.column("lang"), pa.array(got)], ["doc_id", "held_out", "lang", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    scored = checkpointed(docs.select("doc_id", (remainder(5) == 0).alias("held_out"), "lang", "text").mapInArrow(score, f"doc_id {kind}, held_out boolean, lang string, score double"))
    own, every = calibrate(scored, labels)
    own = checkpointed(own)
    few = own.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES
    threshold = F.coalesce("threshold", F.lit(every))
    told = scored.join(F.broadcast(own) if few else own, "lang", "left").select("doc_id", "held_out", "score", threshold.alias("threshold"))
    return told.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).cast("int").alias("flagged"))


def op7_text_cnn(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
