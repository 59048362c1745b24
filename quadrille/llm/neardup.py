"""Near duplicates by b-bit MinHash: connected components of documents whose shingle sets are similar enough.

1. A task turns each text into its set of distinct word shingles, LANES minima of it, BANDS band keys over
   ROWS full minima each, and a signature of the BITS low bits of SIGNED minima, packed into longs.
2. Texts with equal sets become one class, so copies cost nothing further.
3. Classes that share a band key are candidates, and only those. Each meets its bucket's smallest class (the pivot)
   once, by native bit counts of the signatures: the estimate is corrected for chance collisions of the low bits, and
   a pair within MARGIN standard errors of the threshold passes. What does not pass meets the rest of its bucket in
   cells of bounded size; a cell gives back links that span what passes among its members, not all pairs.
4. Families are components of the links that passed, so texts that merely share a template or a quote form none.
   A family of up to PLAIN parts is confirmed on full sets in cells of two parts. In a larger one the links
   themselves are confirmed first; then only members outside the family's largest component meet the others, in
   cells. So a group of many copies costs in proportion to its size, and no pair that could join two components is
   left out.
5. Components over the confirmed links; each document gets the smallest doc_id of its component.

A pair at a threshold of 0.85 shares no band with probability (1 - 0.85**7)**40 = 2e-7 (0.8: 8e-5).

Defined results: words are as ``is_word`` says after A-Z are lowered; a text with fewer words than a shingle
is one shingle, its whole sequence; null, empty or wordless texts have no shingles and are linked with nothing;
rows that repeat a doc_id give one row (largest set size, smallest component); a null doc_id is kept, in no
component (null); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.components import components
from quadrille.llm.runs import runs
from quadrille.llm.tables import checkpointed, id_slots, in_filter, slot_filter
from quadrille.llm.words import WHITE, Words, mix, powers, slices, windows

BITS, BANDS, ROWS, SIGNED = 4, 40, 7, 128
LANES = BANDS * ROWS
MARGIN = 5.0
#: Members and shingles that a part of a bucket or family has, about; two parts meet in a cell.
CELL, CELL_SHINGLES = 1024, 1 << 20
#: Parts of a family up to which all of them meet.
PLAIN = 8
#: Pairs for each member of a cell up to which they are confirmed one by one, and not by a matrix product.
SINGLY = 8

_rng = np.random.Generator(np.random.PCG64(9))
_A = _rng.integers(1, 2**64, LANES, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**64, LANES, dtype=np.uint64)
_C = _rng.integers(0, 2**64, BANDS, dtype=np.uint64)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(column: pa.Array, width: int, is_word: np.ndarray = ~WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted, one row after the other, and n + 1 bounds."""
    w = Words(column, is_word)
    count = np.diff(w.first)
    row = w.row
    h = windows(w.hashes, width)
    whole = row[: len(h)] == row[width - 1 :][: len(h)]
    h, owner = h[whole], row[: len(whole)][whole]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        one = mix(np.array([np.sum(w.hashes[w.first[r] : w.first[r + 1]] * powers(_STEP, count[r])) for r in short], np.uint64) + count[short].astype(np.uint64))
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        owner, h = owner[order], np.concatenate([h, one])[order]
    bounds = np.searchsorted(owner, np.arange(len(count) + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def _lists(values: np.ndarray) -> pa.Array:
    """Rows of a 2-d array of 64-bit numbers as lists."""
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(values.reshape(-1).view(np.int64)))


def signatures(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (n, BANDS) and packed low bits (n, SIGNED * BITS / 64) of sets, none of them empty."""
    n = len(bounds) - 1
    minima = np.empty((LANES, n), np.uint64)
    for lane in range(LANES):
        minima[lane] = np.minimum.reduceat(h * _A[lane] + _B[lane], bounds[:-1])
    keys = np.empty((n, BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(n, _C[band])
        for lane in range(band * ROWS, (band + 1) * ROWS):
            key = mix(key + minima[lane]) * _STEP
        keys[:, band] = key
    per = 64 // BITS
    low = mix(minima[:SIGNED]) & np.uint64((1 << BITS) - 1)
    packed = np.zeros((n, SIGNED // per), np.uint64)
    for lane in range(SIGNED):
        packed[:, lane // per] |= low[lane] << np.uint64(BITS * (lane % per))
    return keys, packed


_ONES = sum(1 << (BITS * i) for i in range(64 // BITS))


def equal_lanes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lanes in which packed signatures agree, for all pairs: bit counts of the folded exclusive or."""
    lanes = np.zeros((len(a), len(b)), np.int32)
    for k in range(a.shape[1]):
        d = a[:, k][:, None] ^ b[:, k][None, :]
        for i in (1, 2):  # BITS neighbours into one
            d |= d >> np.uint64(i)
        lanes += 64 // BITS - np.bitwise_count(d & np.uint64(_ONES)).astype(np.int32)
    return lanes


def estimate(lanes: np.ndarray) -> np.ndarray:
    """Similarity by equal lanes, corrected for the chance 2**-BITS that different minima share their low bits."""
    chance = 2.0**-BITS
    return (lanes / SIGNED - chance) / (1 - chance)


def _margin(threshold: float) -> float:
    """Estimate below which a pair cannot reach the threshold, but for MARGIN standard errors."""
    chance = 2.0**-BITS
    p = threshold + (1 - threshold) * chance
    return threshold - MARGIN * sqrt(p * (1 - p) / SIGNED) / (1 - chance)


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of incidence matrices over blocks of shingles."""
    flat = np.concatenate(sets)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    many = times > 1
    place = np.cumsum(many) - 1
    use = many[column]
    owner, column = owner[use], place[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = 2048
    for low in range(0, int(many.sum()), width):
        a, b = np.searchsorted(column, [low, low + width])
        x = np.zeros((len(sets), width), np.float32)
        x[owner[a:b], column[a:b] - low] = 1
        out += x @ x.T
    return out.astype(np.int64)


def similar_lanes(a: Column, b: Column) -> Column:
    """Lanes in which two packed signatures agree, as ``equal_lanes`` counts them."""

    def lanes(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        for i in (1, 2):
            d = d.bitwiseOR(F.shiftrightunsigned(d, i))
        return F.lit(64 // BITS) - F.bit_count(d.bitwiseAND(F.lit(_ONES)))

    return F.aggregate(F.zip_with(a, b, lanes), F.lit(0), lambda s, x: s + x)


def least_lanes(percent: int) -> int:
    """The fewest equal lanes of a pair that passes."""
    return int(np.flatnonzero(estimate(np.arange(SIGNED + 1)) >= _margin(percent / 100))[0])


def spanning(ids: np.ndarray, group: np.ndarray, pairs, good) -> tuple[np.ndarray, np.ndarray]:
    """Links (a > b) that span what the good ones of ``pairs`` (two arrays of places, in order of choice) join beyond the groups."""
    first: dict[int, int] = {}
    root = [first.setdefault(g, k) for k, g in enumerate(group.tolist())]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    a, b = [], []
    for i, j in zip(pairs[0][good].tolist(), pairs[1][good].tolist(), strict=True):
        x, y = find(i), find(j)
        if x != y:
            root[max(x, y)] = min(x, y)
            a.append(i)
            b.append(j)
    x, y = ids[np.array(a, np.int64)], ids[np.array(b, np.int64)]
    return np.maximum(x, y), np.minimum(x, y)


def passing(packed: np.ndarray, group: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places (x < y) in different groups whose signatures pass, the most similar first."""
    least, found = least_lanes(percent), []
    for at in range(0, len(packed), 128):
        lanes = equal_lanes(packed[at : at + 128], packed)
        x, y = np.nonzero(lanes >= least)
        keep = (x + at < y) & (group[x + at] != group[y])
        found.append((x[keep] + at, y[keep], lanes[x[keep], y[keep]]))
    x, y, lanes = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(-lanes, kind="stable")
    return x[order], y[order]


def links_of(ids: np.ndarray, group: np.ndarray, packed: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Confirmed links (a > b) that span the components which the groups of one cell form among themselves."""
    x, y = passing(packed, group, percent)
    n = np.array([len(s) for s in sets])
    near = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
    x, y = x[near], y[near]
    if len(x) > SINGLY * len(ids):
        some, back = np.unique(np.concatenate([x, y]), return_inverse=True)
        both = common([sets[i] for i in some])[back[: len(x)], back[len(x) :]]
    else:
        both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(x.tolist(), y.tolist(), strict=True)], np.int64)
    return spanning(ids, group, (x, y), 100 * both >= percent * (n[x] + n[y] - both))


def full_sets(docs: DataFrame, ids: DataFrame, width: int, is_word: np.ndarray) -> DataFrame:
    """(id, shingles) of the documents in ``ids`` (column id), taken again from the texts."""
    bits = docs.sparkSession.sparkContext.broadcast(slot_filter(ids.select(id_slots(F.col("id")).alias("slot"))))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_filter(bits.value, batch.column("slot").to_numpy())))
            for part in slices(batch):
                h, bounds = shingle_sets(part.column("text"), width, is_word)
                values = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), values], ["id", "shingles"])

    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("id"), "text", id_slots(F.col("doc_id").cast("bigint")).alias("slot"))
    return texts.mapInArrow(sets, "id bigint, shingles array<bigint>")


def dealt(members: DataFrame, by: str) -> DataFrame:
    """``members`` (by, id, rest, weight, …) in cells (by, i, j): what is ``rest`` meets all of its group, the others meet the rest only."""
    parts = lambda some: F.greatest(F.ceil(F.count_if(some) / CELL), F.ceil(F.sum(F.when(some, F.col("weight")).otherwise(0)) / CELL_SHINGLES)).cast("int")
    sizes = members.groupBy(by).agg(parts(F.col("rest")).alias("parts"), parts(~F.col("rest")).alias("others")).where("parts > 0")
    h = F.xxhash64("id")
    own = F.when(F.col("rest"), F.pmod(h, F.col("parts"))).otherwise(F.col("parts") + F.pmod(h, F.greatest("others", F.lit(1)))).cast("int")
    last = F.when(F.col("rest"), F.col("parts") + F.col("others")).otherwise(F.col("parts")) - 1
    met = members.join(sizes, by).withColumn("own", own).withColumn("x", F.explode(F.sequence(F.lit(0), last)))
    return met.withColumns({"i": F.least("own", "x"), "j": F.greatest("own", "x")}).drop("own", "x", "parts", "others", "rest", "weight")


def _cells(rows: DataFrame, by: str, percent: int) -> DataFrame:
    """Links of every cell of ``dealt`` rows; confirmed if they hold ``shingles``."""
    exact = "shingles" in rows.columns

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in runs(batches, [by, "i", "j"]):
            if cell.num_rows < 2:
                continue
            ids, group = cell.column("id").to_numpy(), cell.column("group").to_numpy()
            packed = cell.column("packed").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
            if exact:
                shingles = cell.column("shingles").combine_chunks()
                flat, cut = shingles.flatten().to_numpy().view(np.uint64), shingles.offsets.to_numpy()
                cut = cut - cut[0]
                a, b = links_of(ids, group, packed, [flat[s:e] for s, e in zip(cut[:-1], cut[1:], strict=True)], percent)
            else:
                pairs = passing(packed, group, percent)
                a, b = spanning(ids, group, pairs, slice(None))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return rows.repartition(by, "i", "j").sortWithinPartitions(by, "i", "j").mapInArrow(meet, "a bigint, b bigint")


def candidate_links(classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between classes (id, keys, packed) of one bucket whose signatures pass; they span all such pairs."""
    banded = classes.select("id", F.explode("keys").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1")
    placed = checkpointed(banded.join(buckets, "key"))
    signed = classes.select("id", "packed")
    met = placed.where("id != pivot").select("id", "pivot").distinct().join(signed, "id").join(signed.toDF("pivot", "pivot_packed"), "pivot")
    met = checkpointed(met.select("id", "pivot", (similar_lanes(F.col("packed"), F.col("pivot_packed")) >= least_lanes(percent)).alias("passes")))
    # buckets of three or more with a class that did not pass its pivot
    failed = met.where("NOT passes").select("id", "pivot")
    open_keys = checkpointed(placed.where("size > 2").join(failed, ["id", "pivot"]).select("key").distinct())
    open_rows = placed.where("size > 2 AND id != pivot").join(open_keys, "key", "left_semi").join(failed.withColumn("failed", F.lit(True)), ["id", "pivot"], "left")
    open_rows = checkpointed(open_rows.select("key", "id", "pivot", F.coalesce("failed", F.lit(False)).alias("rest")))
    pivots = open_rows.select("key", F.col("pivot").alias("id"), "pivot", F.lit(False).alias("rest")).distinct()
    members = open_rows.unionByName(pivots).join(signed, "id").select("key", "id", "rest", F.lit(1).alias("weight"), F.when(F.col("rest"), F.col("id")).otherwise(F.col("pivot")).alias("group"), "packed")
    return met.where("passes").select(F.col("id").alias("a"), F.col("pivot").alias("b")).unionAll(_cells(dealt(members, "key"), "key", percent)).distinct()


def confirmed_links(docs: DataFrame, classes: DataFrame, links: DataFrame, width: int, percent: int, is_word: np.ndarray) -> DataFrame:
    """(a, b): confirmed links that span the near duplicates among the families which candidate ``links`` form."""
    families = components(links).select(F.col("node").alias("id"), F.col("component").alias("family"))
    members = checkpointed(families.join(classes.select("id", "n", "packed"), "id"))
    sets = full_sets(docs, members.select("id"), width, is_word)
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"))
    large = checkpointed(sizes.where((F.col("size") > PLAIN * CELL) | (F.col("weight") > PLAIN * CELL_SHINGLES)).select("family"))
    whole = members.join(large, "family", "left_anti").withColumns({"rest": F.lit(True), "group": F.col("id")})
    if large.isEmpty():
        sure, every = None, whole
    else:
        sets = checkpointed(sets)
        inside = members.join(large, "family", "left_semi")
        own = sets.join(inside.select("id"), "id", "left_semi")
        pairs = links.join(inside.select(F.col("id").alias("a")), "a", "left_semi").join(own.toDF("a", "of_a"), "a").join(own.toDF("b", "of_b"), "b")
        both = F.size(F.array_intersect("of_a", "of_b"))
        sure = checkpointed(pairs.where(100 * both >= percent * (F.size("of_a") + F.size("of_b") - both)).select("a", "b"))
        parts = components(sure).select(F.col("node").alias("id"), "component")
        grouped = checkpointed(inside.join(parts, "id", "left").withColumn("group", F.coalesce("component", "id")).drop("component"))
        most = grouped.groupBy("family", "group").agg(F.count(F.lit(1)).alias("size")).groupBy("family").agg(F.max_by("group", F.struct("size", "group")).alias("most"))
        every = whole.unionByName(grouped.join(most, "family").withColumn("rest", F.col("group") != F.col("most")).drop("most"))
    rows = dealt(every.withColumnRenamed("n", "weight"), "family").join(sets, "id").select("family", "i", "j", "id", "group", "packed", "shingles")
    found = _cells(rows, "family", percent)
    return found if sure is None else found.unionAll(sure)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, is_word: np.ndarray = ~WHITE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h, bounds = shingle_sets(part.column("text"), width, is_word)
                n = np.diff(bounds)
                keys, packed = np.zeros((len(n), BANDS), np.uint64), np.zeros((len(n), SIGNED * BITS // 64), np.uint64)
                d1, d2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                some = np.flatnonzero(n)
                if len(some):
                    starts = np.append(bounds[:-1][some], bounds[-1])
                    keys[some], packed[some] = signatures(h, starts)
                    d1[some] = np.add.reduceat(mix(h), starts[:-1])
                    d2[some] = np.add.reduceat(mix(h ^ _C[0]), starts[:-1])
                columns = [part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), _lists(keys), _lists(packed)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "d1", "d2", "keys", "packed"])

    signed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(sign, "doc_id bigint, n bigint, d1 bigint, d2 bigint, keys array<bigint>, packed array<bigint>")
    signed = checkpointed(signed)
    usable = signed.where("n > 0 AND doc_id IS NOT NULL")
    merged = usable.groupBy("d1", "d2").agg(F.min_by(F.struct("doc_id", "n", "keys", "packed"), "doc_id").alias("c"))
    classes = checkpointed(merged.select("d1", "d2", F.col("c.doc_id").alias("id"), "c.n", "c.keys", "c.packed"))
    links = checkpointed(candidate_links(classes, percent))
    comps = components(confirmed_links(docs, classes, links, width, percent, is_word))
    # every document by its class
    named = classes.select("d1", "d2", "id").join(comps.select(F.col("node").alias("id"), "component"), "id", "left").select("d1", "d2", F.coalesce("component", "id").alias("component"))
    by_set = signed.join(named, ["d1", "d2"], "left")
    own = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    one = by_set.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("n").alias("n_shingles"), F.min(own).alias("component_id"))
    out = one.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    nameless = signed.where("doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionAll(nameless)


def op9_bbit_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=85)
