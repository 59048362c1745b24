"""Bringing a store up: empty logs, law and kernels from Turtle, modules, the routing registry, small settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import terms as T
from quadrille.operators import entail as E
from quadrille.operators import governance as G
from quadrille.operators import pattern as P
from quadrille.operators import quads as Q
from quadrille.operators.documents import Refused

#: The logs of a store and their columns.
LOGS = {
    "instances": "id string, type string, body string, ts timestamp",
    "ledger": "seq bigint, instance_id string, body_sha256 string, sig string, prev_seq bigint, ts timestamp",
    "proofs": "id bigint, about string, method string, digest string",
    "events": "ledger_seq bigint, subject string, payload binary, headers map<string,string>",
    "quads": Q.SCHEMA,
    "pins": "g string, digest string, structural string",
    "obligations": "target_type string, obligation string, check_name string, active boolean",
}
# When a surface is built anew, and how far it is entailed.
TRIGGERS, PROFILES = ["batch", "on_seal", "governance-manual"], ["rdfs", "owl-rl"]
REGISTRY = ["kernel", "verb", "affordance", "in_topic", "out_topic", "in_shape", "plane", "epoch", "delegate"]


def empty_store(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in LOGS.items()}


def boot(law: DataFrame) -> DataFrame:
    """The law, entailed; a graph without any shape is refused, as every gate would be vacuous."""
    if law.where((F.col("p") == T.RDF_TYPE) & (F.col("o") == T.SHACL + "NodeShape")).isEmpty():
        raise Refused("the law holds no shapes")
    return E.entail(law)


def surface(quads: DataFrame, name: str, law: str, kernel: str | None = None, modules: list[str] | None = None, excluded: str | None = None) -> DataFrame:
    """The surface that judges: the law's graph, the kernel's and the adopted modules' under one name, entailed. An adopted module without quads is refused, but for the one that a supersession removes."""
    wanted = [m for m in modules or [] if m != excluded]
    there = {r.g for r in quads.where(F.col("g").isin(wanted)).select("g").distinct().collect()} if wanted else set()
    if missing := sorted(set(wanted) - there):
        raise Refused(f"adopted modules are absent or empty: {missing}")
    return E.entail(Q.compose(quads.where("NOT inferred"), name, law, *([kernel] if kernel else []), *wanted))


def first_pins(pins: DataFrame, quads: DataFrame) -> DataFrame:
    """Pins (g, digest, structural) of graphs that have none yet; later states never replace them."""
    new = quads.join(pins.select("g"), "g", "left_anti")
    return Q.copy_digest(new).join(Q.structural_digest(new).withColumnRenamed("digest", "structural"), "g", "left").select("g", "digest", "structural")


def staged(quads: DataFrame, core: str = T.CORE) -> DataFrame:
    """(reason, term): why a staged graph may not be applied: predicates beyond the shapes' vocabularies, and terms declared in the core namespace."""
    foreign = G.fenced(quads).select(F.lit("predicate").alias("reason"), F.col("p").alias("term"))
    kinds = [T.RDFS + "Class", *(T.OWL + k for k in ("Class", "ObjectProperty", "DatatypeProperty"))]
    minted = quads.where((F.col("p") == T.RDF_TYPE) & F.col("o").isin(kinds) & F.startswith("s", F.lit(core))).select(F.lit("core term").alias("reason"), F.col("s").alias("term"))
    return foreign.unionByName(minted).distinct()


def adopt(quads: DataFrame, new: DataFrame, g: str) -> DataFrame:
    """``quads`` with a staged graph under ``g``, if nothing speaks against it."""
    if faults := staged(new).limit(20).collect():
        raise Refused("; ".join(f"{r.reason} {r.term}" for r in faults))
    return quads.unionByName(new.withColumn("g", F.lit(g))).distinct()


def registry(quads: DataFrame) -> DataFrame:
    """(``REGISTRY``): routes of the affordances among quads, by their topics; what a topic doesn't tell is no route, and of several for a verb the newest epoch counts."""
    c = T.CORE
    rows = P.match(quads, [("?affordance", T.RDF_TYPE, c + "Affordance"), ("?affordance", c + "inTopic", "?in_topic")], same_graph=True)
    for name, prop in (("out_topic", "outTopic"), ("in_shape", "inShape"), ("plane", "plane"), ("epoch", "epoch"), ("delegate", "delegate")):
        rows = P.optional(rows, P.one(quads, ("?affordance", c + prop, "?" + name), same_graph=True))
    topic = r"^input\.kernel\.([^.]+)\.action\.(.+)$"
    bare = lambda name: F.nullif(T.without_datatype(F.col(name)), F.lit(""))
    rows = rows.where(F.col("in_topic").rlike(topic)).select(
        F.regexp_extract("in_topic", topic, 1).alias("kernel"), F.regexp_extract("in_topic", topic, 2).alias("verb"), "affordance", "in_topic", "out_topic", "in_shape",
        F.coalesce(bare("plane"), F.lit("instance")).alias("plane"), F.coalesce(bare("epoch").try_cast("int"), F.lit(1)).alias("epoch"), F.coalesce(bare("delegate").try_cast("boolean"), F.lit(False)).alias("delegate"),
    )
    rest = REGISTRY[2:]
    return rows.groupBy("kernel", "verb").agg(F.max_by(F.struct(*rest), F.struct("epoch", "affordance")).alias("_")).select("kernel", "verb", "_.*")


def policy(trigger: str | None, profile: str | None) -> dict[str, str]:
    """Settings of when and how far a surface is built."""
    if trigger not in TRIGGERS or profile not in PROFILES:
        raise Refused(f"trigger is one of {TRIGGERS}, profile one of {PROFILES}")
    return {"materialize_trigger": trigger, "materialize_profile": profile}


def legacy_verb(verb: str, payload: dict) -> str:
    """The older name that answers a canonical verb, by what the payload holds."""
    if verb == "instance.create":
        return "kernel.create" if "name" in payload and "task" not in payload else "task.create"
    older = {"instance.update": "task.update", "instance.snapshot": "snapshot.board", "instance.query": "instances.list"}
    return older.get(verb) or next((old for old, new in T.CANONICAL_VERBS.items() if new == verb and verb in ("instance.link", "instance.provenance")), verb)


def form(shapes: DataFrame) -> DataFrame:
    """(shape, group, place, path): the declared properties of each shape by ``sh:group`` and ``sh:order``; those without come last, under no group."""
    sh = lambda name, out: shapes.where(F.col("p") == T.SHACL + name).groupBy("g", F.col("s").alias("node")).agg(F.min("o").alias(out))
    props = shapes.where(F.col("p") == T.SHACL + "property").select("g", F.col("s").alias("shape"), F.col("o").alias("node"))
    rows = props.join(sh("path", "path"), ["g", "node"]).join(sh("group", "group"), ["g", "node"], "left").join(sh("order", "order"), ["g", "node"], "left")
    order = F.struct(F.col("group").isNull(), F.col("group"), F.coalesce(F.col("order").try_cast("double"), F.lit(float("inf"))).alias("o"), F.col("path"))
    sorted_rows = rows.groupBy("shape").agg(F.sort_array(F.collect_list(F.struct(order.alias("k"), "group", "path"))).alias("all"))
    return sorted_rows.select("shape", F.posexplode("all").alias("place", "x")).select("shape", "x.group", "place", "x.path")
