"""Derived values: contributions of a formula over a scope, kept with an epoch and a watermark.

A pointer (plan, concept, epoch, watermark, valid_until, built_at) tells where a value was built; it is fresh
while epoch and watermark are the current ones and its validity has not passed. Pointers are appended, the last
one of a (plan, concept) counts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import bodies as B
from quadrille.operators.documents import Refused
from quadrille.session import ensure_checkpoint_dir

NUMBER = "decimal(38,18)"
POINTER = "plan string, concept string, graph_iri string, epoch bigint, watermark bigint, valid_until timestamp, built_at timestamp"
JOB = "plan string, concept string, scope string, formula string, epoch bigint, enqueued_at timestamp"
#: How long a built value may be read.
VALID = "INTERVAL '1 hour'"
# What a formula is made of, besides numbers, quoted keys and operators.
FORMULA_WORDS = ["n", "v", "abs", "least", "greatest", "coalesce", "round", "case", "when", "then", "else", "end", "and", "or", "not", "is", "null"]


def contributions(scope: DataFrame, concept: Column, formula: Column | str) -> DataFrame:
    """(concept, id, contrib): one row per document of the scope whose formula has a value."""
    value = F.expr(formula) if isinstance(formula, str) else formula
    return scope.select(concept.alias("concept"), "id", value.cast(NUMBER).alias("contrib")).where("contrib IS NOT NULL")


def derived_sum(contribs: DataFrame) -> DataFrame:
    return contribs.groupBy("concept").agg(F.sum("contrib").alias("value"), F.count(F.lit(1)).alias("scored"))


def dispersion(contribs: DataFrame) -> DataFrame:
    """Net and volume: what adds up, and what was moved."""
    return contribs.groupBy("concept").agg(F.sum("contrib").alias("net"), F.sum(F.abs("contrib")).alias("volume"))


def watermark(ledger: DataFrame, scope: DataFrame) -> DataFrame:
    """(concept, watermark): the last ledger seq in each scope (concept, instance_id), 0 without any."""
    last = ledger.groupBy("instance_id").agg(F.max("seq").alias("seq"))
    return scope.join(last, "instance_id", "left").groupBy("concept").agg(F.coalesce(F.max("seq"), F.lit(0)).cast("bigint").alias("watermark"))


def current(pointers: DataFrame) -> DataFrame:
    """The last pointer of each plan and concept."""
    others = [c for c in pointers.columns if c not in ("plan", "concept")]
    return pointers.groupBy("plan", "concept").agg(F.max_by(F.struct(*others), "built_at").alias("_")).select("plan", "concept", "_.*")


def fresh(pointers: DataFrame, marks: DataFrame, epoch: int, now: Column) -> DataFrame:
    """(plan, concept, fresh) against current watermarks (concept, watermark)."""
    now_marks = marks.select("concept", F.col("watermark").alias("now_mark"))
    good = (F.col("epoch") == epoch) & (F.col("watermark") == F.col("now_mark")) & (F.col("valid_until").isNull() | (now <= F.col("valid_until")))
    return current(pointers).join(now_marks, "concept", "left").select("plan", "concept", F.coalesce(good, F.lit(False)).alias("fresh"))


def unreferenced(graphs: DataFrame, pointers: DataFrame) -> DataFrame:
    """Built graphs (graph_iri) that no current pointer names."""
    return graphs.join(current(pointers).select("graph_iri"), "graph_iri", "left_anti")


def materialise(spark, contribs: DataFrame, path: str) -> DataFrame:
    """Write contributions under a new versioned path (a pointer is appended only after) and read them back."""
    contribs.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def decayed_score(signals: DataFrame, at: Column, rate: float, tau: float, implicit: float) -> DataFrame:
    """(concept, score): sum of weights that fall by ``exp(-rate * days)``; an implicit signal weighs by its dwell time."""
    days = (F.unix_timestamp(at) - F.unix_timestamp("ts")) / 86400.0
    weight = F.coalesce(F.col("weight"), F.lit(implicit) * (1 - F.exp(-F.col("dwell") / tau)))
    return signals.groupBy("concept").agg(F.sum(F.round(weight * F.exp(-rate * days), 9).cast("decimal(38,9)")).alias("score"))


def formula(text: str) -> Column:
    """A formula as a column over ``n`` (fields as numbers) and ``v`` (fields as texts); words that are not on the list are refused."""
    bare = re.sub(r"'[^'\\]*'", " ", text)
    words = re.findall(r"[A-Za-z_]\w*", bare)
    if not text.strip() or re.search(r"[^\w\s.+*/%()\[\],<>=!-]", bare) or any(w.lower() not in FORMULA_WORDS for w in words):
        raise Refused(f"the formula {text!r} uses more than fields, numbers and {FORMULA_WORDS}")
    return F.expr(text).cast(NUMBER)


def in_scope(docs: DataFrame, scope: dict) -> DataFrame:
    """Documents (id, type, body) of the scope's type that are about its concept, with ``n`` and ``v``."""
    f = B.fields("body")
    fields = docs.where(F.col("type") == scope["type"]).where(B.text(f, scope["about_prop"]) == scope["about"])
    v = F.transform_values(f, lambda k, x: F.try_variant_get(x, "$", "string"))
    return fields.select("id", v.alias("v"), F.transform_values(v, lambda k, x: x.try_cast(NUMBER)).alias("n"))


def derive(docs: DataFrame, ledger: DataFrame, plan: str, scope: dict, text: str, epoch: int, pointers: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(value, scored, net volume, watermark, rebuilt) of a concept, and the pointers with the one it was read by.

    A pointer of the same epoch and watermark that is still valid is read; else the contributions are built under a
    path of their own (plan, concept, epoch, watermark), and a pointer is appended after.
    """
    spark, concept = docs.sparkSession, scope["about"]
    now = F.current_timestamp() if now is None else now
    rows = in_scope(docs, scope)
    mark = watermark(ledger, rows.select(F.lit(concept).alias("concept"), F.col("id").alias("instance_id"))).first()
    mark = mark.watermark if mark else 0
    mine = current(pointers.where((F.col("plan") == plan) & (F.col("concept") == concept)))
    good = mine.where((F.col("epoch") == epoch) & (F.col("watermark") == mark) & (F.col("valid_until").isNull() | (now <= F.col("valid_until")))).select("graph_iri").first()
    if good is None:
        safe = lambda x: re.sub("[^A-Za-z0-9]+", "-", str(x))
        name = f"{safe(plan)}/{safe(concept)}-{hash_name(concept + text)}/{epoch}/{mark}"
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/derived/{name}"
        contributions(rows, F.lit(concept), formula(text)).write.mode("overwrite").parquet(path)
        new = spark.range(1).select(F.lit(plan).alias("plan"), F.lit(concept).alias("concept"), F.lit(path).alias("graph_iri"), F.lit(epoch).cast("bigint").alias("epoch"), F.lit(mark).cast("bigint").alias("watermark"), (now + F.expr(VALID)).alias("valid_until"), now.alias("built_at"))
        pointers = pointers.unionByName(new.checkpoint())
    built = spark.read.parquet(good.graph_iri if good else path)
    answer = built.agg(F.coalesce(F.sum("contrib"), F.lit(0).cast(NUMBER)).alias("value"), F.count(F.lit(1)).alias("scored"), F.coalesce(F.sum(F.abs("contrib")), F.lit(0).cast(NUMBER)).alias("volume"))
    return answer.select("value", "scored", "volume", F.lit(mark).cast("bigint").alias("watermark"), F.lit(good is None).alias("rebuilt")), pointers


def hash_name(text: str) -> str:
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()[:16]


def waiting(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """The compute queue: of jobs (``JOB``) the last of each (plan, concept), without those drained since (plan, concept, drained_at), oldest first."""
    others = [c for c in jobs.columns if c not in ("plan", "concept")]
    last = jobs.groupBy("plan", "concept").agg(F.max_by(F.struct(*others), "enqueued_at").alias("_")).select("plan", "concept", "_.*")
    drained = done.groupBy("plan", "concept").agg(F.max("drained_at").alias("drained_at"))
    return last.join(drained, ["plan", "concept"], "left").where("drained_at IS NULL OR drained_at < enqueued_at").drop("drained_at").orderBy("enqueued_at", "plan", "concept")


def drain_once(jobs: DataFrame, done: DataFrame, docs: DataFrame, ledger: DataFrame, pointers: DataFrame, now: Column | None = None) -> tuple[int, DataFrame, DataFrame]:
    """Build the oldest waiting job at the current watermark: (jobs drained: 0 or 1, done, pointers)."""
    import json

    job = waiting(jobs, done).first()
    if job is None:
        return 0, done, pointers
    _, pointers = derive(docs, ledger, job.plan, json.loads(job.scope), job.formula, job.epoch, pointers, now)
    row = docs.sparkSession.createDataFrame([(job.plan, job.concept, job.enqueued_at)], "plan string, concept string, drained_at timestamp")
    return 1, done.unionByName(row), pointers
