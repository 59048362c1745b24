"""The corpus pipeline: documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all but
the last return the columns of ``docs``. The last returns each kept document as often as the mix asks for, in
the mix's order, with ``copy`` and ``shuffle_key``.

Defined results: documents with null or empty texts are scored, never matched, linked or changed; rows that share
a doc_id are documents of their own wherever their texts differ, and one where they don't; rows with a null doc_id
pass all stages but are not linked, cleaned or matched; an empty table gives an empty result; further columns go
through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.decontaminate import remove_contaminated
from quadrille.llm.linededup import drop_boilerplate
from quadrille.llm.mixing import mix_sources
from quadrille.llm.neardup import near_duplicates
from quadrille.llm.quality import score_quality
from quadrille.llm.tables import checkpointed, read_table, shared_path, without


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine accepts."""
    scored = score_quality(docs, read_table(spark, sf_dir, "labels"), keep_columns=True)
    return scored.where("predicted = 1").select(*docs.columns)


def line_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without cross-site boilerplate lines; ``n_chars`` follows the text. Whole copies of the text that has a line first keep it: the next stage leaves one of them."""
    cleaned = drop_boilerplate(docs, spare_copies=True)
    n = F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", n).select(*docs.columns)


def near_dup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    named = docs.where("doc_id IS NOT NULL")
    repeated = checkpointed(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    keyed = docs.withColumn("near_key", F.col("doc_id").cast("bigint"))
    if not repeated.isEmpty():
        # each different text of an id gets a key of its own: the id for the smallest text, numbers over 2**62 for the others
        several, row = named.join(repeated, "doc_id", "left_semi"), F.struct(*docs.columns)
        texts = several.groupBy("doc_id", F.xxhash64("text").alias("near_text")).agg(F.min_by(row, F.to_json(row)).alias("near_row"))
        first = several.groupBy("doc_id").agg(F.xxhash64(F.min("text")).alias("near_first"))
        other = F.xxhash64("doc_id", "near_text").bitwiseAND(F.lit(2**62 - 1)).bitwiseOR(F.lit(2**62))
        key = F.when(F.col("near_text") == F.col("near_first"), F.col("doc_id").cast("bigint")).otherwise(other)
        apart = texts.join(first, "doc_id").select("near_row.*", key.alias("near_key"))
        keyed = checkpointed(keyed.join(repeated, "doc_id", "left_anti").select(*keyed.columns).unionByName(apart))
    found = near_duplicates(keyed.select(F.col("near_key").alias("doc_id"), "text"), width=5, percent=80)
    return without(keyed, found.where("NOT kept").select(F.col("doc_id").alias("near_key")), ["near_key"]).select(*docs.columns)


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: equal weights of all sources, as many rows in all as documents, by expectation."""
    return mix_sources(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: A trained classifier and verified similarities are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = shared_path(spark, f"stage{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
