"""The seal: documents are judged, stamped, hashed, signed and appended together; what is refused comes back as rows.

Nothing is written here: ``Sealed`` holds the rows that each append-only log gains. A batch is judged as a whole, by
plans over all its candidates: identity, stamps, admitted types, the shapes of the surface, proof obligations.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions import bodies as B
from quadrille.functions import terms as T
from quadrille.operators import governance as G
from quadrille.operators import ledger as L
from quadrille.operators import quads as Q
from quadrille.operators import shapes as S
from quadrille.operators.documents import Refused
from quadrille.session import bounded, ensure_checkpoint_dir
from quadrille.streaming import outbox

PARTICIPANT = T.CORE + "participant"
#: Proof numbers between two ledger numbers: the proof of the bytes, of obligations, and other evidence.
PROOFS = 1000


@dataclass
class Who:
    """Who seals, under which project and epoch, and what evidence of the connection is kept: a fingerprint of claims (never the token) and the acting grant."""

    project: str
    participant: str | None
    key: bytes
    epoch: int = 0
    residue: str | None = None
    grant_ref: str | None = None

    @property
    def kernel(self) -> str:
        return f"urn:x:{self.project}/kernel/ck"

    @property
    def iri(self) -> str:
        return T.PARTICIPANT + re.sub("[^a-z0-9-]+", "-", (self.participant or "").strip().lower())

    def check(self) -> None:
        if not (self.participant or "").strip():
            raise Refused("unattributed write: no identity on this call")
        if self.residue is not None and not re.fullmatch("[0-9a-f]{64}", self.residue):
            raise Refused("the evidence of a connection is a fingerprint of 64 hex digits, never the token")
        if self.grant_ref is not None and not re.match(T.SAFE_IRI, self.grant_ref):
            raise Refused("the acting grant is an IRI")


@dataclass
class Surface:
    """What judges: the composed shapes graph, entailed, with its constraints compiled once."""

    quads: DataFrame
    rules: DataFrame
    types: DataFrame | None = None  # (s, c): classes of nodes outside the batch

    @classmethod
    def of(cls, quads: DataFrame, types: DataFrame | None = None) -> Surface:
        return cls(quads, S.constraints_of(quads).checkpoint(), types)


@dataclass
class Sealed:
    """Rows that the logs gain, (rid, id, reason) of what is refused, and (id, path, component, message) of warnings."""

    instances: DataFrame
    ledger: DataFrame
    proofs: DataFrame
    quads: DataFrame
    events: DataFrame
    refused: DataFrame
    warnings: DataFrame


def stamp(candidates: DataFrame, surface: Surface, who: Who) -> DataFrame:
    """(rid, id, type, body, reason): bodies without claimed stamps and with the server's; a reason where a row cannot be a document at all."""
    fields = B.fields("body")
    nth = F.row_number().over(Window.partitionBy("id").orderBy("rid"))
    rows = candidates.select("rid", "id", fields.alias("f"), nth.alias("nth")).withColumn("type", B.text(F.col("f"), "type"))
    shape = surface.quads.where(F.col("p") == T.SHACL + "targetClass").groupBy(F.col("o").alias("type")).agg(F.min("s").alias("shape"))
    rows = rows.join(bounded(shape), "type", "left")
    stamps = dict(zip(T.STAMPS, (F.lit(who.kernel), F.lit(who.iri), F.lit(who.epoch), F.col("shape")), strict=True)) | {PARTICIPANT: F.lit(who.iri)}
    body = B.canonical(B.overlaid(B.without(F.col("f"), *T.STAMPS, "participant"), B.of_pairs(stamps)))
    reason = F.when(F.col("id").isNull(), "id required").when(F.col("f").isNull(), "the body is no object").when(F.col("nth") > 1, "changed twice in one batch")
    return rows.select("rid", "id", "type", body.alias("body"), reason.alias("reason"))


def judged(rows: DataFrame, surface: Surface, who: Who) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(quads of the candidates, the report on them, (id, reason) of types that are not admitted)."""
    g = f"urn:x:{who.project}/instances"
    declared = S.property_shapes(surface.quads).where("datatype IS NOT NULL").groupBy("path").agg(F.min("datatype").alias("datatype"))
    quads = Q.body_to_quads(rows.select("id", "body"), g, declared).checkpoint()
    above = surface.quads.where(F.col("p") == T.SUBCLASS).select(F.col("s").alias("c"), F.col("o").alias("d"))
    own = S.types_of(quads)
    types = own.unionByName(own.join(bounded(above), "c").select("s", F.col("d").alias("c"))).distinct()
    every = types if surface.types is None else types.unionByName(surface.types).distinct()
    report = S.check(surface.rules, S.targets(surface.quads, quads, types), S.values(quads), every).checkpoint()
    known = S.admitted(rows.select("type").distinct(), surface.quads)
    foreign = rows.join(bounded(known.where("admitted").select("type")), "type", "left_anti")
    return quads, report, foreign.select("id", F.concat(F.lit("type not admitted: "), F.coalesce("type", F.lit("none"))).alias("reason"))


def violations(report: DataFrame) -> DataFrame:
    """(id, reason): all violations of a candidate, in order."""
    line = F.concat_ws(" ", "path", "component")
    return report.where("severity = 'Violation'").groupBy(F.col("focus").alias("id")).agg(F.array_join(F.sort_array(F.collect_set(line)), "; ").alias("reason"))


def seal(candidates: DataFrame, ledger: DataFrame, surface: Surface, who: Who, now: Column, obligations: DataFrame | None = None, evidence: dict[str, DataFrame] | None = None) -> Sealed:
    """Seal candidates (rid, id, body: JSON text). ``obligations`` (target_type, obligation, check_name, active) use ``evidence`` as of ``governance.failures``."""
    who.check()
    ensure_checkpoint_dir(candidates.sparkSession)
    stamped = stamp(candidates, surface, who).checkpoint()
    rows = stamped.where("reason IS NULL").drop("reason")
    quads, report, foreign = judged(rows, surface, who)
    refused = foreign.unionByName(violations(report).join(rows.select("id"), "id", "left_semi"))
    due = None
    if obligations is not None:
        failed = G.failures(rows, report, evidence or {})
        due = G.due(rows, obligations)
        first = G.first_failure(rows, obligations, failed)
        refused = refused.unionByName(first.select("id", F.concat(F.lit("proof obligation "), "refused_by").alias("reason")))
    refused = refused.groupBy("id").agg(F.min("reason").alias("reason")).checkpoint()
    good = rows.join(refused, "id", "left_anti").withColumn("ts", now).checkpoint()
    entries = L.append(good.select(F.col("id").alias("instance_id"), "body", "ts"), ledger, who.key).checkpoint()
    base = entries.select((F.col("seq") * PROOFS).alias("id"), F.col("instance_id").alias("about"), F.lit("sha256").alias("method"), F.col("body_sha256").alias("digest"))
    proofs = [base]
    if due is not None:
        nth = F.row_number().over(Window.partitionBy("about").orderBy("obligation"))
        held = base.join(due.select(F.col("id").alias("about"), "obligation").distinct(), "about")
        proofs.append(held.withColumn("id", F.col("id") + nth).select("id", "about", F.concat(F.lit("obligation:"), "obligation").alias("method"), "digest"))
    if who.residue is not None:
        proofs.append(base.select((F.col("id") + PROOFS - 2).alias("id"), "about", F.lit("token-residue").alias("method"), F.lit(who.residue).alias("digest")))
    if who.grant_ref is not None:
        proofs.append(base.select((F.col("id") + PROOFS - 1).alias("id"), "about", F.lit("grant-ref:" + who.grant_ref).alias("method"), "digest"))
    told = entries.join(good.withColumnRenamed("id", "instance_id").drop("ts"), "instance_id").withColumn("created_by", F.lit(who.iri))
    out_of = stamped.where("reason IS NOT NULL").select("rid", "id", "reason").unionByName(rows.join(refused, "id").select("rid", "id", "reason"))
    warnings = report.where("severity != 'Violation'").select(F.col("focus").alias("id"), "path", "component", "message").join(good.select("id"), "id", "left_semi")
    return Sealed(good.select("id", "type", "body", "ts"), entries, Q.union(*proofs).checkpoint(), quads.join(good.select(F.col("id").alias("s")), "s", "left_semi").select(*Q.COLUMNS), outbox.events(told, who.project), out_of, warnings)


def append_to(folder: str, sealed: Sealed) -> None:
    """Append a batch to the Parquet logs below ``folder``: instances last, as what they hold refers to the others."""
    for name in ("ledger", "proofs", "quads", "events", "instances"):
        getattr(sealed, name).write.mode("append").parquet(f"{folder.rstrip('/')}/{name}")
