"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Features of a text are its distinct hashed words, and the bins of structure statistics (symbols, capitals,
digits, repetition, line shapes, length as told by ``n_chars``). The machine adds a bias, linear weights and
low-rank pairwise interactions, computed in linear time by 1/2 sum_f ((sum v x)^2 - sum v^2 x^2). It is fitted
in numpy on the driver on at most 2 x PER_CLASS labelled rows; scoring is one pass over whole texts.

Defined results: null and empty texts have only their statistics and get a score like others; a null n_chars
has a bin of its own; without labels of both classes every score is 0.5 (predicted 1: nothing is rejected);
repeated rows are scored alike; an empty table gives an empty result; columns named like ours are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from quadrille.llm.labelled import labelled_sample, remainder
from quadrille.llm.words import WHITE, Words, slices

WORD_BITS, BINS, RANK = 16, 10, 8
#: Bound of the sample that the model is fitted on: rows of each class.
PER_CLASS = 3000
STATISTICS = ["bytes_log", "words_log", "word_bytes", "upper", "digit", "symbol", "punctuation", "pipe", "white", "distinct", "top_word", "adjacent", "line_words", "lines_log", "symbol_end", "n_chars_log"]
SLOTS = (1 << WORD_BITS) + len(STATISTICS) * (BINS + 1)

_UPPER, _DIGIT, _SYMBOL, _POINT = (np.isin(np.arange(256), [ord(c) for c in s]) for s in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#$%&*+=<>@^_`~|\\{}[]!", ".,;:?'\"()-"))


def _per_row(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(float)


def describe(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, word slot, value) of distinct words, and the (rows, statistics) table."""
    w = Words(batch.column("text"), ~WHITE)
    n, raw, cut = batch.num_rows, w.raw, w.offsets
    row, slot = w.row, (w.hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    key, times = np.unique((row << WORD_BITS) | slot, return_counts=True)
    word_row, word_slot = key >> WORD_BITS, key & ((1 << WORD_BITS) - 1)
    kinds = np.bincount(word_row, minlength=n)
    value = np.log1p(times) / np.sqrt(np.maximum(kinds, 1))[word_row]
    size, words = np.maximum(np.diff(cut), 1).astype(float), np.diff(w.first).astype(float)
    some = np.maximum(words, 1)
    lines = _per_row(raw == 10, cut) + 1
    top = np.zeros(n)
    np.maximum.at(top, word_row, times)
    again = (w.hashes[1:] == w.hashes[:-1]) & (row[1:] == row[:-1]) if len(row) else np.zeros(0, bool)
    told = batch.column("n_chars").cast(pa.float64()).to_numpy(zero_copy_only=False)
    stats = np.column_stack(
        [
            np.log(size), np.log1p(words), np.diff(np.concatenate([[0], np.cumsum(w.end - w.start)])[w.first]) / some,
            _per_row(_UPPER[raw], cut) / size, _per_row(_DIGIT[raw], cut) / size, _per_row(_SYMBOL[raw], cut) / size,
            _per_row(_POINT[raw], cut) / size, _per_row(raw == 124, cut) / some, _per_row(WHITE[raw], cut) / size,
            kinds / some, top / some, np.bincount(row[1:][again], minlength=n) / some, words / lines, np.log(lines),
            _per_row(_SYMBOL[raw[w.end - 1]], w.first) / some, np.log1p(np.maximum(told, 0)),
        ]
    )
    return word_row, word_slot, value, stats


def bin_slots(stats: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The slot of each statistic's bin; NaN has the last."""
    out = np.empty(stats.shape, np.int64)
    for j in range(stats.shape[1]):
        bins = np.searchsorted(edges[j], stats[:, j], side="right")
        out[:, j] = (1 << WORD_BITS) + j * (BINS + 1) + np.where(np.isnan(stats[:, j]), BINS, bins)
    return out


def joined(word_row, word_slot, value, stat_slots):
    """Words and statistics as one (row, slot, value) list ordered by row."""
    n, k = stat_slots.shape
    row = np.concatenate([word_row, np.repeat(np.arange(n), k)])
    order = np.argsort(row, kind="stable")
    return row[order], np.concatenate([word_slot, stat_slots.reshape(-1)])[order], np.concatenate([value, np.full(n * k, 1 / np.sqrt(k))])[order]


class Machine:
    """Bias, linear weights and factors; ``raw`` is linear in the number of features."""

    def __init__(self, edges: np.ndarray, seed: int = 3):
        self.edges, self.b = edges, 0.0
        self.w = np.zeros(SLOTS, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (SLOTS, RANK)).astype(np.float32)

    @classmethod
    def of(cls, edges, b, w, v):
        m = cls.__new__(cls)
        m.edges, m.b, m.w, m.v = edges, b, w, v
        return m

    def arrays(self):
        return self.edges, self.b, self.w, self.v

    def sums(self, row, slot, value, n):
        starts = np.searchsorted(row, np.arange(n))  # every row has its statistics
        x = value.astype(np.float32)[:, None] * self.v[slot]
        total = np.add.reduceat(x, starts, axis=0)
        return self.b + np.bincount(row, self.w[slot] * value, n) + 0.5 * (total**2 - np.add.reduceat(x * x, starts, axis=0)).sum(1), total

    def score(self, batch: pa.RecordBatch) -> np.ndarray:
        r, s, v, stats = describe(batch)
        z, _ = self.sums(*joined(r, s, v, bin_slots(stats, self.edges)), batch.num_rows)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list, priors: dict[int, int], epochs: int = 12, size: int = 128, rate: float = 0.02, l2: float = 2e-4) -> Machine | None:
    """``rows``: (label, word slots, values, statistics); class weights restore the labelled proportions."""
    y = np.array([r.label for r in rows], float)
    if not 0 < y.sum() < len(y):
        return None
    stats = np.array([r.stats for r in rows], float)
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = np.array([np.quantile(c[~np.isnan(c)], quantiles) if (~np.isnan(c)).any() else np.zeros(BINS - 1) for c in stats.T])
    bins = bin_slots(stats, edges)
    weight = np.where(y == 1, priors[1] / y.sum(), priors[0] / (1 - y).sum())
    weight *= len(y) / weight.sum()
    m, rng = Machine(edges), np.random.default_rng(1)
    params = [m.w, m.v]
    first, second, b1, b2, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0.0, 0.0, 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), size):
            some = order[at : at + size]
            counts = [len(rows[i].slots) for i in some]
            row, slot, value = joined(np.repeat(np.arange(len(some)), counts), np.concatenate([np.asarray(rows[i].slots, np.int64) for i in some]), np.concatenate([np.asarray(rows[i].vals, float) for i in some]), bins[some])
            z, total = m.sums(row, slot, value, len(some))
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) * weight[some] / len(some)
            dv = d[row][:, None] * (value[:, None] * total[row] - (value**2)[:, None] * m.v[slot])
            used, place = np.unique(slot, return_inverse=True)
            grads = [np.bincount(place, d[row] * value, len(used)) + l2 * m.w[used], np.column_stack([np.bincount(place, dv[:, f], len(used)) for f in range(RANK)]) + l2 * m.v[used]]
            t += 1
            for p, g, a, c in zip(params, grads, first, second, strict=True):  # Adam over the slots in use
                a[used] = 0.9 * a[used] + 0.1 * g
                c[used] = 0.999 * c[used] + 0.001 * g * g
                p[used] -= rate * (a[used] / (1 - 0.9**t)) / (np.sqrt(c[used] / (1 - 0.999**t)) + 1e-8)
            b1, b2 = 0.9 * b1 + 0.1 * d.sum(), 0.999 * b2 + 0.001 * d.sum() ** 2
            m.b -= rate * (b1 / (1 - 0.9**t)) / (np.sqrt(b2 / (1 - 0.999**t)) + 1e-8)
    return m


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Machine | None:
    sample, priors = labelled_sample(docs.select("doc_id", "text", "n_chars"), labels, "quality", remainder(3) != 1, per_class)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                r, s, v, stats = describe(part)
                cut = pa.array(np.searchsorted(r, np.arange(part.num_rows + 1)), pa.int32())
                flat = pa.array(np.arange(part.num_rows + 1) * stats.shape[1], pa.int32())
                columns = [part.column("label"), pa.ListArray.from_arrays(cut, pa.array(s, pa.int32())), pa.ListArray.from_arrays(cut, pa.array(v)), pa.ListArray.from_arrays(flat, pa.array(stats.reshape(-1)))]
                yield pa.RecordBatch.from_arrays(columns, ["label", "slots", "vals", "stats"])

    rows = sample.select("doc_id", "label", "text", "n_chars").mapInArrow(features, "label int, slots array<int>, vals array<double>, stats array<double>")
    pdf = rows.toArrow().to_pandas()  # 2 x per_class rows at most
    return fit(list(pdf.itertuples(index=False)), priors)


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, keep_columns: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; with ``keep_columns``, ``docs`` with the last three."""
    fitted = train(docs, labels, per_class)
    model = docs.sparkSession.sparkContext.broadcast(None if fitted is None else fitted.arrays())
    docs = docs.drop("held_out", "score", "predicted") if keep_columns else docs.select("doc_id", "text", "n_chars")
    names = docs.columns if keep_columns else ["doc_id"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = None if model.value is None else Machine.of(*model.value)
        for batch in batches:
            for part in slices(batch):
                got = np.full(part.num_rows, 0.5) if m is None else m.score(part)
                yield part.select([*names, "held_out"]).append_column("score", pa.array(got))

    held = docs.withColumn("held_out", remainder(3) == 1)
    schema = StructType([*(docs.schema[c] for c in names), StructField("held_out", BooleanType()), StructField("score", DoubleType())])
    return held.mapInArrow(score, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_factorisation_machine(spark, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
