"""Bounded samples of labelled documents for fitting, the same at every size of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(of: int) -> Column:
    """crc32 of doc_id as text, modulo ``of``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % of


def label_table(labels: DataFrame, column: str, usable: Column) -> DataFrame:
    """(doc_id, label) of usable rows; a document whose labels disagree evenly is left out."""
    said = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & usable)
    mean = said.groupBy("doc_id").agg(F.avg(F.col(column).cast("double")).alias("mean"))
    return mean.where("mean != 0.5").select("doc_id", (F.col("mean") > 0.5).cast("int").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, usable: Column, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """Documents with ``label``: of each class the ``per_class`` ids of smallest hash; and the labelled rows of each class.

    The ids are at most 2 x per_class, so they are broadcast.
    """
    table = label_table(labels, column, usable)
    counts = {r.label: r.n for r in table.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    picks = None
    for label in (0, 1):
        some = table.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picks = some if picks is None else picks.unionAll(some)
    # a pick whose text is missing is lost to the fit only
    return docs.join(F.broadcast(picks), "doc_id"), counts
