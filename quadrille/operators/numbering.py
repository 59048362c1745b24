"""Consecutive numbers in a global order, without one global sort or window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.session import ensure_checkpoint_dir


def numbered(rows: DataFrame, by: list[str], after: int = 0, name: str = "seq") -> DataFrame:
    """``rows`` with ``name``: after + 1, after + 2, ... in order of ``by``, without gaps; rows equal in ``by`` must be equal in all that matters.

    Rows are sorted in ranges; a row's number is its place plus the counts of the ranges before. The sorted rows are
    checkpointed, so counts and places come from the same ranges whatever is computed again or planned anew.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    places = {"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumns(places).checkpoint()
    counts = {r["_range"]: r["n"] for r in ordered.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per range
    before, total = {}, after
    for k in sorted(counts):
        before[k], total = total, total + counts[k]
    base = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("_range")) if before else F.lit(after)
    return ordered.withColumn(name, (base + F.col("_place") + 1).cast("bigint")).drop("_range", "_place")
