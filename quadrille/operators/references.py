"""References to documents: bare ids, stamped IRIs (``@id``) and minted ones, resolved over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions import bodies as B
from quadrille.functions import terms as T
from quadrille.operators.quads import quads_of


def stamped(docs: DataFrame) -> DataFrame:
    """(id, iri): documents (id, body) with their stamped IRI, null without one."""
    return docs.select("id", B.text(B.fields("body"), "@id").alias("iri"))


def resolve_ids(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """(ref, id, known) of references (ref): a known id, the id of a stamped IRI (the smallest of several), of a minted IRI, else the reference itself; blank ones have none."""
    all_ids = stamped(docs)
    ids = all_ids.select(F.col("id").alias("ref"), F.col("id").alias("own")).distinct()
    by_iri = all_ids.where("iri IS NOT NULL").groupBy(F.col("iri").alias("ref")).agg(F.min("id").alias("by_iri"))
    minted = ids.select(F.concat(F.lit(T.INSTANCE), "ref").alias("ref"), F.col("own").alias("minted"))
    rows = refs.select("ref").distinct().join(ids, "ref", "left").join(by_iri, "ref", "left").join(minted, "ref", "left")
    found = F.coalesce("own", "by_iri", "minted")
    return rows.select("ref", F.when(F.trim("ref") != "", F.coalesce(found, F.col("ref"))).alias("id"), found.isNotNull().alias("known"))


def resolve_refs(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """(ref, iri) of references (ref): absolute IRIs as they are, known ids by their stamped IRI or a minted one, others null."""
    rows = refs.select("ref").distinct().join(stamped(docs).withColumnRenamed("id", "ref").withColumn("known", F.lit(True)), "ref", "left")
    own = F.when(F.contains("iri", F.lit(":")), F.col("iri")).when(F.col("known"), F.concat(F.lit(T.INSTANCE), "ref"))
    return rows.select("ref", F.when(F.trim("ref") == "", F.lit(None)).when(F.contains("ref", F.lit(":")), F.col("ref")).otherwise(own).alias("iri"))


def edges(links: DataFrame, docs: DataFrame, g: str) -> tuple[DataFrame, DataFrame]:
    """Links (rid, source, predicate, target) as quads of ``g``, and (rid, reachable): whether both ends resolve to safe IRIs, so that reachability sees the link."""
    ends = resolve_refs(links.select(F.col("source").alias("ref")).unionAll(links.select(F.col("target").alias("ref"))).where("ref IS NOT NULL"), docs)
    rows = links.join(ends.toDF("source", "s"), "source", "left").join(ends.toDF("target", "o"), "target", "left")
    rows = rows.withColumn("p", F.when(F.contains("predicate", F.lit(":")), F.col("predicate")).otherwise(F.concat(F.lit(T.BOARD), "predicate")))
    good = F.lit(True)
    for c in "spo":
        good = good & F.coalesce(F.col(c).rlike(T.SAFE_IRI) & F.contains(c, F.lit(":")), F.lit(False))
    rows = rows.withColumn("reachable", good)
    return quads_of(rows.where("reachable"), F.col("s"), F.col("p"), F.col("o"), g).distinct(), rows.select("rid", "reachable")


def board_links(docs: DataFrame, g: str, fields: dict[str, str]) -> DataFrame:
    """Quads of ``g`` for the links that bodies (id, body) hold under the keys of ``fields`` (key: predicate), as far as they resolve."""
    rows = None
    for key, predicate in fields.items():
        one = docs.select(F.col("id").alias("rid"), F.col("id").alias("source"), F.lit(predicate).alias("predicate"), B.text(B.fields("body"), key).alias("target")).where("target IS NOT NULL")
        rows = one if rows is None else rows.unionAll(one)
    return edges(rows, docs, g)[0]
