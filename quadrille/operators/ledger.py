"""Sealing, ledger and proofs: append-only logs whose rows are hashed, signed and chained.

A seal is set-based: candidates are validated, stamped, hashed and appended together; what a gate refuses comes
back as rows and is not written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions.digests import hmac_sha256, sha256
from quadrille.operators.numbering import numbered
from quadrille.session import bounded


def hashed(bodies: DataFrame, key: bytes) -> DataFrame:
    """``bodies`` (… body) with ``body_sha256`` and ``sig``, the HMAC of the body."""
    return bodies.withColumn("body_sha256", sha256(F.col("body"))).withColumn("sig", hmac_sha256(F.col("body"), key))


def chained(rows: DataFrame, partition: Column | str) -> DataFrame:
    """Rows with ``prev_seq``: the seq before theirs in the same chain.

    A chain is told by ``partition``; one chain over a whole store would be one task.
    """
    return rows.withColumn("prev_seq", F.lag("seq").over(Window.partitionBy(partition).orderBy("seq")))


def append(new: DataFrame, ledger: DataFrame, key: bytes) -> DataFrame:
    """Ledger rows of ``new`` (instance_id, body, ts): numbered on from the ledger, in order of ts, id and body hash, without gaps."""
    top = ledger.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("m")).first().m
    rows = hashed(new.select("instance_id", "body", "ts"), key).drop("body")
    rows = numbered(rows, ["ts", "instance_id", "body_sha256"], top)
    previous = ledger.groupBy("instance_id").agg(F.max("seq").alias("old"))
    own = F.lag("seq").over(Window.partitionBy("instance_id").orderBy("seq"))
    rows = rows.withColumn("own", own).join(previous, "instance_id", "left")
    return rows.select("seq", "instance_id", "body_sha256", "sig", F.coalesce("own", "old").alias("prev_seq"), "ts")


def latest(rows: DataFrame, by: str, order: str = "seq") -> DataFrame:
    """The last row of each key; combined before the shuffle."""
    others = [c for c in rows.columns if c != by]
    return rows.groupBy(by).agg(F.max_by(F.struct(*others), order).alias("_")).select(by, "_.*")


def verify(instances: DataFrame, ledger: DataFrame, proofs: DataFrame, key: bytes) -> DataFrame:
    """(id, verified): the body's hash and signature equal the last ledger row's, its byte proof agrees, and its prev_seq is the row before."""
    now = hashed(instances.select("id", "body"), key)
    last = ledger.groupBy("instance_id").agg(F.max_by(F.struct("body_sha256", "sig", "prev_seq"), "seq").alias("l"), F.max("seq").alias("seq"))
    before = ledger.join(last.select("instance_id", F.col("seq").alias("last_seq")), "instance_id").where("seq < last_seq").groupBy("instance_id").agg(F.max("seq").alias("real_prev"))
    proof = proofs.where("method = 'sha256'").groupBy(F.col("about").alias("instance_id")).agg(F.max_by("digest", "id").alias("digest"))
    rows = now.withColumnRenamed("id", "instance_id").join(last, "instance_id", "left").join(before, "instance_id", "left").join(proof, "instance_id", "left")
    good = (F.col("l.body_sha256") == F.col("body_sha256")) & (F.col("l.sig") == F.col("sig")) & (F.col("digest") == F.col("body_sha256")) & F.col("l.prev_seq").eqNullSafe(F.col("real_prev"))
    return rows.select(F.col("instance_id").alias("id"), F.coalesce(good, F.lit(False)).alias("verified"))


def broken_links(ledger: DataFrame, partition: str = "instance_id") -> DataFrame:
    """Ledger rows whose ``prev_seq`` is not the row before theirs, over whole chains."""
    real = F.lag("seq").over(Window.partitionBy(partition).orderBy("seq"))
    return ledger.withColumn("real_prev", real).where(~F.col("prev_seq").eqNullSafe(F.col("real_prev")))


def latest_proof(proofs: DataFrame) -> DataFrame:
    """(about, digest, n_proofs): the newest proof of each subject, and how many it has."""
    return proofs.groupBy("about").agg(F.max_by("digest", "id").alias("digest"), F.count(F.lit(1)).alias("n_proofs"))


def provenance(ledger: DataFrame, proofs: DataFrame) -> DataFrame:
    """(id, seqs, n_rows, n_proofs, digest): an instance's ledger rows in order, with its proofs."""
    rows = ledger.groupBy(F.col("instance_id").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("seq")), lambda x: x.cast("string")), ",").alias("seqs"), F.count(F.lit(1)).alias("n_rows"))
    return rows.join(latest_proof(proofs).withColumnRenamed("about", "id"), "id", "left").select("id", "seqs", "n_rows", F.coalesce("n_proofs", F.lit(0)).alias("n_proofs"), "digest")


def stamped(candidates: DataFrame, shapes: DataFrame, epoch: int, participant: str, project: str) -> DataFrame:
    """Candidates (id, type, …) with the server's stamps; ``conforms_to`` is null where no shape targets the type."""
    by_type = shapes.groupBy(F.col("target").alias("type")).agg(F.min("shape").alias("conforms_to"))
    return candidates.join(bounded(by_type), "type", "left").withColumn("produced_by", F.lit(project)).withColumn("created_by", F.lit(participant)).withColumn("sealed_at_epoch", F.lit(epoch).cast("bigint"))


def gate(candidates: DataFrame, report: DataFrame, admitted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused): a candidate is refused if its type is not admitted or the report has a Violation on it; ``refused`` is (id, reason)."""
    bad_type = candidates.join(admitted.where("admitted").select("type"), "type", "left_anti").select("id", F.concat(F.lit("type not admitted: "), F.coalesce("type", F.lit("none"))).alias("reason"))
    bad_shape = report.where("severity = 'Violation'").groupBy(F.col("focus").alias("id")).agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws(" ", "path", "component"))), "; ").alias("reason")).join(candidates.select("id"), "id", "left_semi")
    refused = bad_type.unionByName(bad_shape).groupBy("id").agg(F.min("reason").alias("reason"))
    return candidates.join(refused, "id", "left_anti"), refused
