"""Benchmark decontamination by spaced-seed hashing.

Fixed masks over at most 12 tokens each ignore some positions, so a window with substitutions still agrees under
a mask whose positions it left alone. The masks lose nothing: every segment with at least LEAST tokens in common
at an identity of IDENTITY meets one of them, wherever its substitutions stand (a test goes through all strings of
equal and unequal tokens with an automaton). Hashes of benchmark windows under each mask are joined with those of the
training texts; each hit gives a diagonal between a text and an item, and the whole overlap along it is verified:
some segment must hold at least LEAST tokens in common at an identity of IDENTITY. ``matched`` and ``span`` are
those of the segment with the most tokens in common, the shortest of such.

Up to BROADCAST_HASHES window hashes the benchmark's sorted hash table is broadcast and the join happens in the
scan of the texts; beyond that, texts only meet a bitmap of the benchmark's hashes (sized by their number, 32 MB at
most), Spark joins the hits with the benchmark by hash, its side salted, and each distinct diagonal then meets the
item's and the text's tokens. Both ways give the same rows.

Defined results: tokens are runs of letters and digits, lower-cased; items with fewer than LEAST tokens, null or
empty ones match nothing; null, empty or short texts are
clean; repeated rows of one doc_id give one row per item with the best overlap; rows with a null doc_id are
never reported; repeated items are items of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.tables import FILTER_BITS, bucket_of, checkpointed, in_filter, slot_filter, without
from quadrille.llm.words import ALNUM, Words, mix, slices, windows

#: Positions that each mask reads of a window.
MASKS = [(0, 1, 2, 4, 5), (0, 1, 6, 8, 9), (0, 1, 3, 6, 7), (0, 1, 3, 10, 11)]
LEAST, IDENTITY = 9, 0.75
BROADCAST_HASHES = 2_000_000
SALTS = 16
#: A bitmap in the shuffle has at least 16 bits a hash, up to 2**28 in all; a byte table at least 16 slots, up to 2**25.
BITS_PER_HASH, MOST_BITS, LEAST_SLOTS, MOST_SLOTS = 16, 28, 22, 25

PAIR = "doc_id bigint, t bigint, item_id bigint, matched bigint, span bigint"


def tokens(column: pa.Array) -> Words:
    return Words(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")), ALNUM)


def seeds(hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(span, hash of the window at each position) under each mask."""
    for k, places in enumerate(MASKS):
        span = places[-1] + 1
        yield span, mix(windows(hashes, span, places) + np.uint64(k))


def overlap(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(equal tokens, length) of the convincing segment with most equal tokens, the shortest of such, of two token
    runs laid side by side; (0, 0) if none is convincing."""
    at = np.flatnonzero(a == b)
    if len(at) < LEAST:
        return 0, 0
    nth = np.arange(len(at))
    before, after = nth - IDENTITY * at, nth + 1 - IDENTITY * (at + 1)
    ahead = np.maximum.accumulate(after[::-1])  # from the end, so it rises
    last = len(at) - 1 - np.searchsorted(ahead, before)  # the last equal token that a segment from each can end with
    matched, span = last - nth + 1, at[last] - at + 1
    k = np.lexsort((span, -matched))[0]
    return (int(matched[k]), int(span[k])) if matched[k] >= LEAST else (0, 0)


def convincing(matched: int, span: int) -> bool:
    return matched >= LEAST and matched >= IDENTITY * span


class Index:
    """The benchmark's window hashes in order, with item and position of each, and all items' tokens."""

    def __init__(self, hashes, items, places, ids, words, first):
        self.hashes, self.items, self.places, self.ids, self.words, self.first = hashes, items, places, ids, words, first

    def search(self, hashes: np.ndarray, near: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, tokens in common, span) of the convincing overlaps of one text; ``near``: where windows may hit."""
        seen: set[tuple[int, int]] = set()
        found: dict[int, tuple[int, int]] = {}
        for _, h in seeds(hashes):
            at = np.flatnonzero(near[: len(h)])
            left, right = (np.searchsorted(self.hashes, h[at], side) for side in ("left", "right"))
            times = right - left
            k = np.repeat(left, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            seen.update(zip(self.items[k].tolist(), (np.repeat(at, times) - self.places[k]).tolist(), strict=True))
        for item, diagonal in seen:
            words = self.words[self.first[item] : self.first[item + 1]]
            s, e = max(0, -diagonal), min(len(words), len(hashes) - diagonal)
            got = overlap(hashes[s + diagonal : e + diagonal], words[s:e])
            if convincing(*got):
                found[item] = max(got, found.get(item, (0, 0)), key=lambda x: (x[0], -x[1]))
        return [(int(self.ids[i]), m, n) for i, (m, n) in found.items()]


def bench_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, tokens) of the items that can match."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = tokens(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("item_id"), pa.ListArray.from_arrays(pa.array(w.first, pa.int32()), pa.array(w.hashes.view(np.int64)))], ["item_id", "words"])

    rows = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    return rows.mapInArrow(take, "item_id bigint, words array<bigint>").where(F.size("words") >= LEAST)


def _bench_seeds(ids: np.ndarray, lists: list[np.ndarray]):
    """Parallel arrays (hash, item index, place) over all items."""
    hashes, items, places = [], [], []
    for i, words in enumerate(lists):
        for _, h in seeds(words):
            hashes.append(h)
            items.append(np.full(len(h), i))
            places.append(np.arange(len(h)))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(items), np.concatenate(places)


def find_contamination(docs: DataFrame, benchmark: DataFrame, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """(doc_id, item_id, matched, span): every document and item with a convincing overlap, the best of them."""
    pairs = contaminated_texts(docs, benchmark, broadcast_hashes)
    return pairs.groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", (-F.col("span")).alias("less"))).alias("best")).select("doc_id", "item_id", F.col("best.matched").alias("matched"), (-F.col("best.less")).alias("span"))


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """(doc_id, t, item_id, matched, span): every text, told by its id and its hash ``t``, and item with a convincing overlap."""
    items = bench_items(benchmark)
    size = items.agg(F.sum(F.size("words"))).first()[0] or 0
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    return _by_broadcast(texts, items) if size * len(MASKS) <= broadcast_hashes else _by_shuffle(texts, items, _bits(size * len(MASKS), FILTER_BITS, MOST_BITS))


def _bits(hashes: int, least: int, most: int) -> int:
    """log2 of the slots of a filter of so many hashes."""
    return min(most, max(least, (BITS_PER_HASH * hashes - 1).bit_length()))


def _by_broadcast(texts: DataFrame, items: DataFrame) -> DataFrame:
    rows = items.toArrow()  # at most broadcast_hashes / masks tokens
    ids = rows.column("item_id").to_numpy()
    lists = [np.asarray(x, np.int64).view(np.uint64) for x in rows.column("words").to_pylist()]
    hashes, owner, places = _bench_seeds(ids, lists)
    order = np.argsort(hashes, kind="stable")
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    words = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
    shared = texts.sparkSession.sparkContext.broadcast((hashes[order], owner[order], places[order], ids, words, first))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*shared.value)
        # one byte per slot of the hashes' upper bits, to pass over most windows at little cost
        bits = _bits(len(index.hashes), LEAST_SLOTS, MOST_SLOTS)
        slots, drop = np.zeros(1 << bits, bool), np.uint64(64 - bits)
        slots[(index.hashes >> drop).astype(np.int64)] = True
        for batch in batches:
            for part in slices(batch):
                w = tokens(part.column("text"))
                row, near = w.row, np.zeros(len(w.hashes), bool)
                for span, h in seeds(w.hashes):
                    near[: len(h)] |= slots[(h >> drop).astype(np.int64)] & (row[: len(h)] == row[span - 1 :][: len(h)])
                out = []
                ids_, t = part.column("doc_id"), part.column("t")
                for r in np.unique(row[near]).tolist():
                    out += [(ids_[r].as_py(), t[r].as_py(), *x) for x in index.search(w.hashes[w.first[r] : w.first[r + 1]], near[w.first[r] : w.first[r + 1]])]
                columns = zip(*out, strict=True) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["doc_id", "t", "item_id", "matched", "span"])

    return texts.mapInArrow(search, PAIR)


def _by_shuffle(texts: DataFrame, items: DataFrame, filter_bits: int) -> DataFrame:
    items = items.withColumn("k", F.xxhash64("words"))

    def bench(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, words, k in zip(*[batch.column(c).to_pylist() for c in ("item_id", "words", "k")], strict=True):
                hashes, _, places = _bench_seeds(np.array([i]), [np.asarray(words, np.int64).view(np.uint64)])
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.full(len(hashes), i)), pa.array(np.full(len(hashes), k)), pa.array(places)], ["h", "item_id", "k", "q"])

    seeded = items.mapInArrow(bench, "h bigint, item_id bigint, k bigint, q bigint")
    slot = F.shiftrightunsigned("h", 64 - filter_bits)
    bits = texts.sparkSession.sparkContext.broadcast(slot_filter(seeded.select(slot.alias("slot")), filter_bits))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w, ids_, t = tokens(part.column("text")), part.column("doc_id").to_numpy(), part.column("t").to_numpy()
                row = w.row
                for span, h in seeds(w.hashes):
                    at = np.flatnonzero(in_filter(bits.value, h >> np.uint64(64 - filter_bits)) & (row[: len(h)] == row[span - 1 :][: len(h)]))
                    yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(ids_[row[at]]), pa.array(t[row[at]]), pa.array(at - w.first[row[at]])], ["h", "doc_id", "t", "p"])

    found = texts.mapInArrow(hits, "h bigint, doc_id bigint, t bigint, p bigint").withColumn("salt", bucket_of(F.struct("doc_id", "t"), 1, SALTS))
    salted = seeded.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    met = checkpointed(found.join(salted, ["h", "salt"]).select("doc_id", "t", "item_id", "k", (F.col("p") - F.col("q")).alias("diagonal")).distinct())
    # each text once, ahead of its diagonals; a task holds the tokens of one text at a time
    pairs = met.join(items.dropDuplicates(["item_id", "k"]), ["item_id", "k"]).select("doc_id", "t", "item_id", "diagonal", "words", F.lit(None).cast("string").alias("text"))
    whole = texts.join(met.select("doc_id", "t").distinct(), ["doc_id", "t"], "left_semi").select("doc_id", "t", F.lit(None).cast("bigint").alias("item_id"), F.lit(None).cast("bigint").alias("diagonal"), F.lit(None).cast("array<bigint>").alias("words"), "text")
    together = whole.unionAll(pairs).repartition("doc_id", "t").sortWithinPartitions("doc_id", "t", F.col("item_id").asc_nulls_first())

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours = np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "t", "item_id", "diagonal", "words")]
            for r, (d, t, i, diagonal, words) in enumerate(zip(*columns, strict=True)):
                if i is None:
                    ours = tokens(batch.column("text").slice(r, 1)).hashes
                    continue
                theirs = np.asarray(words, np.int64).view(np.uint64)
                s, e = max(0, -diagonal), min(len(theirs), len(ours) - diagonal)
                got = overlap(ours[s + diagonal : e + diagonal], theirs[s:e])
                if convincing(*got):
                    out.append((d, t, i, *got))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["doc_id", "t", "item_id", "matched", "span"])

    return together.mapInArrow(verify, PAIR)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text shares a convincing overlap with any item."""
    hit = contaminated_texts(docs, benchmark).select(F.col("doc_id").alias("hit_id"), F.col("t").alias("hit_text"))
    keyed = docs.withColumns({"hit_id": F.col("doc_id").cast("bigint"), "hit_text": F.xxhash64("text")})
    return without(keyed, hit, ["hit_id", "hit_text"]).select(*docs.columns)


def op1_spaced_seeds(spark, sf_dir: str) -> DataFrame:
    return find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
