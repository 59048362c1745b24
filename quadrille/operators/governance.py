"""Governed change: proposals, votes, epochs, plans, state machines and obligations, over whole tables of them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions import bodies as B
from quadrille.functions import terms as T
from quadrille.operators.documents import Refused
from quadrille.operators.quads import SCHEMA
from quadrille.session import bounded

FLOOR = "floor"
# The operations that a proposal can name, and the checks that an obligation can.
OPERATIONS = ["add_class", "add_property", "set_transition_map", "add_affordance", "add_proof_obligation"]
CHECKS = ["digest-match", "adopts-resolves", "structural-pin", "no-warnings"]


def quorum(votes: DataFrame, proposals: DataFrame) -> DataFrame:
    """(proposal, approvers, applied) of pending proposals (proposal, requires_quorum): distinct named approvers count, rejections don't."""
    said = votes.where("value = 'approve' AND created_by IS NOT NULL AND created_by != 'anonymous'")
    n = said.groupBy("proposal").agg(F.count_distinct("created_by").alias("approvers"))
    both = proposals.join(n, "proposal", "left").withColumn("approvers", F.coalesce("approvers", F.lit(0)))
    return both.select("proposal", "approvers", (F.col("approvers") >= F.col("requires_quorum")).alias("applied"))


def epochs(changes: DataFrame) -> DataFrame:
    """(kernel, epoch): applied changes (kernel, seq) counted; a kernel starts at 0."""
    return changes.groupBy("kernel").agg(F.count(F.lit(1)).alias("epoch"))


def resolve_plans(plans: DataFrame, asked: DataFrame) -> DataFrame:
    """The plan of each asked (kernel, verb): the kernel's own before the floor's, then the newest epoch. Only the newest plan of an owner and verb meets what is asked for, by two equi-joins."""
    others = [c for c in plans.columns if c not in ("kernel", "verb")]
    newest = plans.groupBy(F.col("kernel").alias("owner"), "verb").agg(F.max_by(F.struct(*others), "epoch").alias("plan"))
    own = asked.join(newest.withColumnRenamed("owner", "kernel"), ["kernel", "verb"]).withColumn("owner", F.col("kernel"))
    rest = asked.join(own.select("kernel", "verb"), ["kernel", "verb"], "left_anti")
    floor = rest.join(newest.where(F.col("owner") == FLOOR), "verb")
    columns = [*asked.columns, "owner", "plan.*"]
    return own.select(*columns).unionByName(floor.select(*columns))


def transitions(log: DataFrame, allowed: DataFrame) -> DataFrame:
    """Steps (type, from_state, to_state, …) with ``legal`` and ``source``.

    A type with pairs of its own (``allowed``: type, from_state, to_state) never falls back on the pairs of the
    null type; an absent state counts as ``planned``.
    """
    log = log.withColumn("from_state", F.coalesce("from_state", F.lit("planned")))
    own = allowed.where("type IS NOT NULL")
    has = own.select("type").distinct().withColumn("has", F.lit(True))
    pairs = own.select("type", "from_state", "to_state").distinct().withColumn("own", F.lit(True))
    common = allowed.where("type IS NULL").select("from_state", "to_state").distinct().withColumn("common", F.lit(True))
    rows = log.join(bounded(has), "type", "left").join(bounded(pairs), ["type", "from_state", "to_state"], "left").join(bounded(common), ["from_state", "to_state"], "left")
    no = F.lit(False)
    legal = F.when(F.coalesce("has", no), F.coalesce("own", no)).otherwise(F.coalesce("common", no))
    return rows.withColumn("legal", legal).withColumn("source", F.when(F.coalesce("has", no), "sealed").otherwise("fallback")).drop("has", "own", "common")


def steps(events: DataFrame, by: str, state: str, *order: str) -> DataFrame:
    """Successive states of each subject as (from_state, to_state) rows; the first comes from null."""
    return events.withColumn("from_state", F.lag(state).over(Window.partitionBy(by).orderBy(*order))).withColumnRenamed(state, "to_state")


def bind(template: str, params: dict[str, str], declared: list[str]) -> str:
    """A governed expression with its ``:name`` parameters as quoted literals; undeclared names and unsafe values are refused."""
    for name, value in params.items():
        if name not in declared:
            raise Refused(f"undeclared parameter {name!r}")
        if not re.fullmatch(T.PARAMETER_PATTERN, value):
            raise Refused(f"parameter {name!r} has a value that is not allowed")
    missing = [n for n in declared if n not in params]
    if missing:
        raise Refused(f"missing parameters {missing}")
    return re.sub(r":([a-z_]+)\b", lambda m: "'" + params[m[1]] + "'" if m[1] in params else m[0], template)


def operation_quads(spark, op: str, detail: dict, g: str) -> DataFrame:
    """The quads that an accepted operation adds to a kernel's graph."""
    if op not in OPERATIONS:
        raise Refused(f"unknown operation {op!r}")
    iri = lambda x: x if isinstance(x, str) and re.match(T.IRI_PATTERN, x) else (_ for _ in ()).throw(Refused(f"{x!r} is no IRI"))
    rows: list[tuple] = []

    def add(s: str, p: str, o: str, kind: int = T.IRI, dt: str | None = None) -> None:
        rows.append((g, s, p, str(o), T.IRI, kind, dt, None, False))

    def declare(shape: str, prop: dict) -> None:
        path = iri(prop["path"])
        node = f"{shape}/{re.sub('.*[/#]', '', path)}"
        add(shape, T.SHACL + "property", node)
        add(node, T.SHACL + "path", path)
        if prop.get("datatype"):
            add(node, T.SHACL + "datatype", iri(prop["datatype"]))
        for name in ("minCount", "maxCount"):
            if prop.get(name) is not None:
                add(node, T.SHACL + name, int(prop[name]), T.LITERAL, T.XSD + "integer")

    if op in ("add_class", "add_property"):
        target = iri(detail["class"])
        shape = target + "Shape"
        if op == "add_class":
            add(target, T.RDF_TYPE, T.OWL + "Class")
        add(shape, T.RDF_TYPE, T.SHACL + "NodeShape")
        add(shape, T.SHACL + "targetClass", target)
        for prop in detail.get("properties", [] if op == "add_class" else [detail]):
            declare(shape, prop)
        if detail.get("closed"):
            add(shape, T.SHACL + "closed", "true", T.LITERAL, T.XSD + "boolean")
            for path in detail.get("ignoredProperties", [T.RDF_TYPE, *T.STAMPS, T.CORE + "participant", T.BOARD + "created_at"]):
                add(shape, T.SHACL + "ignoredProperties", iri(path))
    elif op == "set_transition_map":
        for state, following in detail["map"].items():
            for to in following:
                add(iri(detail["class"]), "urn:x:p/allows", f"{state}>{to}", T.LITERAL)
    elif op == "add_affordance":
        add(g + "/" + detail["verb"], "urn:x:p/answers", detail["query"], T.LITERAL)
    else:
        if detail["check"] not in CHECKS:
            raise Refused(f"unknown check {detail['check']!r}")
        add(g + "/" + detail["obligation"], "urn:x:p/checks", detail["check"], T.LITERAL)
    return spark.createDataFrame(rows, SCHEMA)


def obligation(spark, detail: dict) -> DataFrame:
    """The row of a proof obligation (target_type, obligation, check_name, active) that an accepted operation sets; an inactive one needs its name only."""
    active = str(detail.get("active", "true")).lower() != "false"
    if active and detail.get("check") not in CHECKS:
        raise Refused(f"unknown check {detail.get('check')!r}")
    if active and not re.match(T.IRI_PATTERN, str(detail.get("targetType"))):
        raise Refused("an obligation is on a type, by its IRI")
    return spark.createDataFrame([(detail.get("targetType"), detail["obligation"], detail.get("check"), active)], "target_type string, obligation string, check_name string, active boolean")


def transition_rows(spark, detail: dict) -> DataFrame:
    """The steps (type, from_state, to_state) of an accepted transition map."""
    rows = [(detail["class"], state, to) for state, following in detail["map"].items() for to in following]
    if any(not re.match(T.STATE_NAME, x) for _, *pair in rows for x in pair):
        raise Refused("states are plain names")
    return spark.createDataFrame(rows, "type string, from_state string, to_state string")


def fenced(quads: DataFrame) -> DataFrame:
    """(p): predicates of a staged graph that are not of the vocabularies a shape graph may use."""
    allowed = F.lit(False)
    for ns in (T.RDF_TYPE.rpartition("#")[0] + "#", T.RDFS, T.OWL, T.SHACL, "urn:x:p/allows"):
        allowed = allowed | F.startswith("p", F.lit(ns))
    return quads.where(~allowed).select("p").distinct()


# --- obligations: candidates (id, type, …) that an active check refuses -------------------------------------


def unmatched_digests(claims: DataFrame, sealed: DataFrame) -> DataFrame:
    """Claims (id, digest, epoch) without an epoch row that holds both; a null epoch asks for the digest only."""
    with_epoch = claims.where("epoch IS NOT NULL").join(sealed, ["digest", "epoch"], "left_anti")
    without = claims.where("epoch IS NULL").join(sealed.select("digest").distinct(), "digest", "left_anti")
    return with_epoch.select("id", "digest", "epoch").unionByName(without.select("id", "digest", "epoch"))


def unresolved_adoptions(claims: DataFrame, quads: DataFrame) -> DataFrame:
    """Claims (id, adopts) whose graph has no asserted quad."""
    return claims.join(quads.where("NOT inferred").select(F.col("g").alias("adopts")).distinct(), "adopts", "left_anti")


def drifted(pins: DataFrame, digests: DataFrame) -> DataFrame:
    """Pins (g, digest) with the digest now and whether they differ; a graph that is gone has drifted."""
    return pins.join(digests.withColumnRenamed("digest", "digest_now"), "g", "left").withColumn("drifted", ~F.col("digest").eqNullSafe(F.col("digest_now")))


def warned(report: DataFrame) -> DataFrame:
    """(id, warnings) of candidates that the gate let pass with warnings."""
    return report.where("severity = 'Warning'").groupBy(F.col("focus").alias("id")).agg(F.count(F.lit(1)).alias("warnings"))


def due(candidates: DataFrame, obligations: DataFrame) -> DataFrame:
    """Candidates (id, type, …) with each active obligation (obligation, check_name) on their exact type."""
    active = obligations.where("active").select(F.col("target_type").alias("type"), "obligation", "check_name")
    return candidates.join(bounded(active), "type")


def failures(candidates: DataFrame, report: DataFrame, evidence: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What each check refuses of candidates (id, body). ``evidence``: ``epochs`` (digest, epoch) that are sealed, ``quads`` of the store, ``pins`` and ``digests`` (g, digest); a check without its evidence refuses what it would look up."""
    spark = candidates.sparkSession
    none = lambda schema: spark.createDataFrame([], schema)
    fields = B.fields("body")
    cited = candidates.select("id", B.text(fields, T.CORE + "surfaceDigest").alias("digest"), B.text(fields, T.CORE + "epoch").try_cast("bigint").alias("epoch")).where("digest IS NOT NULL")
    adopts = candidates.select("id", B.text(fields, T.CORE + "adopts").alias("adopts")).where("adopts IS NOT NULL")
    state = drifted(evidence.get("pins", none("g string, digest string")), evidence.get("digests", none("g string, digest string")))
    return {
        "digest-match": unmatched_digests(cited, evidence.get("epochs", none("digest string, epoch bigint")).select("digest", F.col("epoch").cast("bigint").alias("epoch")).distinct()),
        "adopts-resolves": unresolved_adoptions(adopts, evidence.get("quads", none("g string, inferred boolean"))),
        "structural-pin": adopts.join(state.where("drifted").select(F.col("g").alias("adopts")), "adopts", "left_semi"),
        "no-warnings": warned(report),
    }


def first_failure(candidates: DataFrame, obligations: DataFrame, failed: dict[str, DataFrame]) -> DataFrame:
    """(id, refused_by): the first active obligation, by name, whose exact type a candidate has and whose check it fails."""
    rows = None
    for name, some in failed.items():
        one = some.select("id", F.lit(name).alias("check_name")).distinct()
        rows = one if rows is None else rows.unionByName(one)
    return due(candidates, obligations).join(rows, ["id", "check_name"], "left_semi").groupBy("id").agg(F.min("obligation").alias("refused_by"))
