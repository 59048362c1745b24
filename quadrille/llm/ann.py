"""Approximate nearest neighbours by multiprobe p-stable hashing, largest inner product.

Vectors are put on the unit sphere so that inner products keep their order (scaled by the largest norm, with
one more component that fills up to length one; a query gets a zero there). Each of TABLES tables hashes them by
K Gaussian projections cut into intervals of WIDTH. A neighbour at similarity rho to a query lies around rho
times the query's projection, so each perturbed bucket has an estimated success probability; a query visits
buckets in that order until they hold SUCCESS of the probability in each table. It does so twice: first as if its
neighbours were at similarity FIRST, in few buckets; then at the similarity of the TOP-th vector found, which its true
neighbours have at least, in those buckets that it hasn't seen. So each query pays by its own surroundings: one among
close copies stops early, one without near neighbours goes on. The candidates of all tables merge, and the exact inner
products of the original vectors, in double precision, rank them.

Buckets that share their first two intervals form a cell. Queries and members of a cell meet in blocks of
bounded size (BLOCK members, taken STEP at a time, and QUERY_BLOCK queries), and a block gives back each query's
best TOP among its probed buckets; so no list of candidate pairs is ever shuffled, and a bucket of any size is
searched whole.

Defined results: rows whose vector is null, zero, holds null or non-finite components or has another length
than most take no part; null ids neither; repeated rows count once; of several vectors of one id the nearest
counts; a query with fewer than TOP candidates in its buckets visits all buckets; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.runs import runs
from quadrille.llm.tables import bucket_of, checkpointed

TOP, TABLES, K, WIDTH, BINS = 20, 2, 5, 2.0, 6
#: Estimated success probability of the buckets that a query visits in one table, similarity of the first visit, and the mark of a visit to all buckets.
SUCCESS, FIRST, EVERY = 0.75, 0.95, -1.0
BLOCK, STEP, QUERY_BLOCK = 65_536, 4096, 1024
COARSE, FINE = BINS * BINS, BINS ** (K - 2)

HIT = "query_id bigint, vec_id bigint, score double"


def matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


class Hasher:
    """The projections and offsets of every table, for vectors of ``dim`` components plus one."""

    def __init__(self, dim: int, longest: float, success: float = SUCCESS):
        rng = np.random.default_rng(11)
        self.a = rng.normal(size=(TABLES, dim + 1, K))
        self.b = rng.uniform(0, WIDTH, (TABLES, K))
        self.longest, self.success = longest, success

    @classmethod
    def of(cls, a, b, longest, success):
        h = cls.__new__(cls)
        h.a, h.b, h.longest, h.success = a, b, longest, success
        return h

    def arrays(self):
        return self.a, self.b, self.longest, self.success

    def on_sphere(self, x: np.ndarray, query: bool) -> np.ndarray:
        if query:
            return np.column_stack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))])
        x = x / self.longest
        return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))])

    def bins(self, x: np.ndarray, table: int) -> np.ndarray:
        """(rows, K) intervals 0 to BINS - 1; the outer ones are open."""
        return np.clip(np.floor((self.on_sphere(x, False) @ self.a[table] + self.b[table]) / WIDTH).astype(np.int64) + BINS // 2, 0, BINS - 1)

    def probes(self, x: np.ndarray, table: int, rho: np.ndarray) -> np.ndarray:
        """(queries, COARSE, FINE): whether a query visits the bucket, for neighbours at its similarity ``rho``."""
        from math import erf

        rho, every = np.clip(rho, 0, 0.995), rho == EVERY
        at = rho[:, None] * (self.on_sphere(x, True) @ self.a[table])
        edges = (np.arange(1, BINS) - BINS // 2)[None, None, :] * WIDTH - self.b[table][None, :, None]
        z = (edges - at[:, :, None]) / np.sqrt(2 * (1 - rho**2))[:, None, None]
        below = 0.5 * (1 + np.vectorize(erf)(z))
        p = np.diff(np.concatenate([np.zeros((*below.shape[:2], 1)), below, np.ones((*below.shape[:2], 1))], axis=2), axis=2)
        joint = p[:, 0]
        for k in range(1, K):
            joint = (joint[:, :, None] * p[:, k][:, None, :]).reshape(len(x), -1)
        order = np.argsort(-joint, axis=1)
        gained = np.cumsum(np.take_along_axis(joint, order, 1), axis=1)
        visit = np.zeros(joint.shape, bool)
        np.put_along_axis(visit, order, np.concatenate([np.zeros((len(x), 1)), gained[:, :-1]], 1) < self.success, 1)
        return (visit | every[:, None]).reshape(len(x), COARSE, FINE)

    def new_probes(self, x: np.ndarray, table: int, rhos: np.ndarray) -> np.ndarray:
        """The buckets of the last of several visits (columns of ``rhos``) that none before it saw."""
        visit = self.probes(x, table, rhos[:, -1])
        for k in range(rhos.shape[1] - 1):
            visit &= ~self.probes(x, table, rhos[:, k])
        return visit


def codes(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell and place in it of each row's bucket."""
    code = np.ravel_multi_index(bins.T, (BINS,) * K)
    return code // FINE, code % FINE


def best(q_ids, queries, ids, vectors, allowed: np.ndarray, top: int):
    """(query_id, vec_id, score) of each query's best ``top`` ids among its allowed vectors; ties to the smaller id."""
    s = queries @ vectors.T
    s[~allowed | (q_ids[:, None] == ids[None, :])] = -np.inf
    order = np.argsort(ids, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], np.diff(ids[order]) != 0]))
    by_id = s if len(heads) == len(ids) else np.maximum.reduceat(s[:, order], heads, axis=1)
    if by_id.shape[1] > top:
        least = np.partition(by_id, by_id.shape[1] - top, axis=1)[:, by_id.shape[1] - top]
    else:
        least = np.full(len(s), -np.inf)
    # the product's rounding may depend on places; what could be among the best is computed again, alike everywhere
    slack = 1e-9 * np.maximum(1.0, np.abs(np.where(np.isfinite(least), least, 0.0)))
    x, y = np.nonzero((s >= (least - slack)[:, None]) & np.isfinite(s))
    return merged([(q_ids[x], ids[y], np.einsum("ij,ij->i", queries[x], vectors[y]))], top)


def merged(parts: list[tuple], top: int):
    """The best ``top`` ids of each query over several lists of (query_id, vec_id, score)."""
    q, ids, score = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((-score, ids, q))
    q, ids, score = q[order], ids[order], score[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
    q, ids, score = q[new], ids[new], score[new]
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    own = np.arange(len(q)) - np.searchsorted(q, q) < top
    return q[own], ids[own], score[own]


def usable_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, v): distinct rows that can take part, v as doubles."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(F.coalesce(v, F.array().cast("array<double>")), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    some = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & fine).select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).where(F.exists("v", lambda x: x != 0))
    return some


def place(vectors: DataFrame, hasher: Hasher) -> DataFrame:
    """(id, v, cell, place): every vector in its bucket of each table."""
    shared = vectors.sparkSession.sparkContext.broadcast(hasher.arrays())

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher.of(*shared.value)
        for batch in batches:
            x = matrix(batch.column("v"))
            for t in range(TABLES):
                cell, at = codes(h.bins(x, t))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cell + t * COARSE), pa.array(at)], ["id", "v", "cell", "place"])

    return checkpointed(vectors.mapInArrow(members, "id bigint, v array<double>, cell bigint, place bigint"))


def search(placed: DataFrame, queries: DataFrame, hasher: Hasher, top: int) -> DataFrame:
    """Each query's best ``top`` in every block that the last of its visits (``rhos``) reaches."""
    shared = placed.sparkSession.sparkContext.broadcast(hasher.arrays())

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher.of(*shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                x, rhos = matrix(batch.column("v")), matrix(batch.column("rhos"))
                for t in range(TABLES):
                    visit = h.new_probes(x, t, rhos)
                    q, cell = np.nonzero(visit.any(2))
                    bits = np.packbits(visit[q, cell], axis=1)
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(q)), batch.column("v").take(pa.array(q)), pa.array(cell + t * COARSE), pa.array([b.tobytes() for b in bits], pa.binary())], ["id", "v", "cell", "bits"])

    asked = checkpointed(queries.select("vec_id", "v", "rhos").mapInArrow(visits, "id bigint, v array<double>, cell bigint, bits binary"))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("mb")).join(asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("qb")), "cell")
    sizes = F.broadcast(sizes)  # TABLES x COARSE rows at most
    null = F.lit(None)
    left = placed.join(sizes, "cell").select("cell", bucket_of(F.col("id"), 1, 1 << 30).alias("h"), "mb", "qb", "id", "v", "place", null.cast("binary").alias("bits"))
    left = left.withColumn("m", F.pmod("h", "mb")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)))
    right = asked.join(sizes, "cell").select("cell", bucket_of(F.col("id"), 2, 1 << 30).alias("h"), "mb", "qb", "id", "v", null.cast("bigint").alias("place"), "bits")
    right = right.withColumn("q", F.pmod("h", "qb")).withColumn("m", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)))
    both = left.drop("h", "mb", "qb").unionByName(right.drop("h", "mb", "qb"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, ["cell", "m", "q"]):
            place = block.column("place").to_numpy()
            is_query = np.isnan(place.astype(float))
            if not is_query.any() or is_query.all():
                continue
            x, ids = matrix(block.column("v").combine_chunks()), block.column("id").to_numpy()
            bits = np.array([np.frombuffer(b, np.uint8) for b in block.column("bits").filter(pa.array(is_query)).to_pylist()])
            visit = np.unpackbits(bits, axis=1)[:, :FINE].astype(bool)
            q_ids, q, rows = ids[is_query], x[is_query], np.flatnonzero(~is_query)
            got = []
            for at in range(0, len(rows), STEP):
                some = rows[at : at + STEP]
                got.append(best(q_ids, q, ids[some], x[some], visit[:, place[some].astype(np.int64)], top))
                if len(got) == 8:
                    got = [merged(got, top)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in merged(got, top)], ["query_id", "vec_id", "score"])

    return both.repartition("cell", "m", "q").sortWithinPartitions("cell", "m", "q").mapInArrow(meet, HIT)


def ranked(hits: DataFrame, top: int) -> DataFrame:
    one = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return one.withColumn("rank", place).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, is_query, top: int = TOP, success: float = SUCCESS) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of every row for which ``is_query`` holds; all are searched if ``success`` is 1."""
    usable = usable_vectors(rows)
    kinds = usable.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if kinds is None:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    vectors = usable.where(F.size("v") == kinds.dim)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    longest = vectors.agg(F.max(norm)).first()[0]
    hasher = Hasher(kinds.dim, longest, success)
    placed = place(vectors, hasher)
    n = F.coalesce("n", F.lit(0))

    def visit(asked: DataFrame, found: DataFrame | None = None) -> DataFrame:
        """``found`` and what the last of the visits of ``asked`` brings."""
        hits = search(placed, asked, hasher, top)
        return checkpointed(ranked(hits if found is None else hits.unionByName(found.select("query_id", "vec_id", "score")), top))

    def so_far(asked: DataFrame, found: DataFrame) -> DataFrame:
        told = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s"))
        return asked.join(told, "vec_id", "left")

    def again(asked: DataFrame, rho) -> DataFrame:
        return checkpointed(asked.select("vec_id", "v", F.concat("rhos", F.array(rho)).alias("rhos")))

    asked = checkpointed(vectors.where(is_query).withColumn("rhos", F.array(F.lit(FIRST if success < 1 else EVERY))))
    found = visit(asked)
    if success < 1:
        asked = again(so_far(asked, found), F.when(n >= top, F.col("s") / norm / longest).otherwise(0.0))
        found = visit(asked, found)
        # the few queries, if any, that still have fewer than top visit what is left
        rest = again(so_far(asked, found).where(n < top), F.lit(EVERY))
        if not rest.isEmpty():
            found = visit(rest, found)
    return found


def op5_multiprobe_lsh(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
