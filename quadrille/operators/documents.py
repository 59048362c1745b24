"""Typed document reads: filter DSL, lists, search, boards and allocation.

Documents are rows with ``id``, ``type``, ``ts`` and their fields, either as columns (declared) or in ``body``
as JSON text (unshaped).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions import bodies as B
from quadrille.functions import terms as T

OPERATORS = ["eq", "neq", "lt", "lte", "gt", "gte", "contains"]
MAX_LIMIT, MAX_MATCHES = 1000, 100
NUMBER = "decimal(38,18)"


class Refused(ValueError):
    """A request that the rules refuse."""


def predicate(value: Column, op: str, literal: str) -> Column:
    """One filter over a field. Missing fields never pass, not even ``neq``; ordering compares numbers only, and texts that are none never pass; ``contains`` takes % and _ as wildcards."""
    if op not in OPERATORS:
        raise Refused(f"unknown operator {op!r}")
    text = value.cast("string")
    if op == "eq":
        return value == literal
    if op == "neq":
        return value != literal
    if op == "contains":
        return text.like(f"%{literal}%")
    try:
        number = Decimal(literal)
    except ArithmeticError:
        return F.lit(False)
    own = F.when(text.rlike(T.NUMBER_PATTERN) | text.rlike(r"^-?[0-9.]+[eE][+-]?[0-9]+$"), value.try_cast(NUMBER))
    other = F.lit(number).cast(NUMBER)
    return {"lt": own < other, "lte": own <= other, "gt": own > other, "gte": own >= other}[op]


def resolve(docs: DataFrame, key: str, declared: dict[str, str] | None) -> Column:
    """The column of a filter key. Declared types take declared local names or full property names only; others look into ``body`` for the exact key, or one that ends in it after a slash or a hash; a key that no document has is refused, never silently empty."""
    if declared is not None:
        if key in declared:
            return F.col(declared[key])
        if key in declared.values():
            return F.col(key)
        raise Refused(f"key {key!r} is not declared")
    if "body" not in docs.columns:
        raise Refused(f"key {key!r} cannot be resolved")
    fields = F.from_json("body", "map<string,string>")
    here = F.map_filter(fields, lambda k, v: (k == key) | k.endswith("/" + key) | k.endswith("#" + key))
    if docs.where(F.size(here) > 0).isEmpty() and not docs.isEmpty():
        raise Refused(f"no document has a key {key!r}")
    return F.coalesce(F.try_element_at(fields, F.lit(key)), F.try_element_at(F.map_values(here), F.lit(1)))


def query(docs: DataFrame, filters: list[tuple[str, str, str]], declared: dict[str, str] | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Documents that pass all (key, operator, value), ordered by id, one page of them."""
    out = docs
    for key, op, literal in filters:
        out = out.where(predicate(resolve(docs, key, declared), op, literal))
    return out.orderBy("id").offset(max(0, offset)).limit(max(1, min(limit, MAX_LIMIT)))


def of_type(docs: DataFrame, type_: str) -> DataFrame:
    """Documents whose type is ``type_`` or ends in it."""
    return docs.where((F.col("type") == type_) | F.endswith("type", F.lit(type_)))


def get(docs: DataFrame, id_: str) -> DataFrame:
    return docs.where(F.col("id") == id_)


def last(docs: DataFrame, n: int = 10) -> DataFrame:
    """The newest ``n``; ties to the smaller id."""
    return docs.orderBy(F.desc("ts"), "id").limit(n)


def match_labels(labels: DataFrame, term: str, limit: int = 10, rank_first: bool = False) -> DataFrame:
    """(id, label, rank) of labels that contain ``term`` in any case: 1 equal, 2 at the start, 3 inside.

    The governed order takes the first ``limit`` by label and then ranks them; ``rank_first`` ranks all.
    """
    n = max(1, min(limit, MAX_MATCHES))
    low, t = F.lower("label"), term.lower()
    hit = labels.where(F.contains(low, F.lit(t))).withColumn("rank", F.when(low == t, 1).when(F.startswith(low, F.lit(t)), 2).otherwise(3))
    order = ["rank", "label", "id"]
    return hit.orderBy(*order).limit(n) if rank_first else hit.orderBy("label", "id").limit(n).orderBy(*order)


def project_labels(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(id, label): the first of several body fields that has a value."""
    fields = F.from_json("body", "map<string,string>")
    return docs.select("id", F.coalesce(*[F.nullif(F.try_element_at(fields, F.lit(k)), F.lit("")) for k in keys]).alias("label")).where("label IS NOT NULL")


def sort_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks with their place on the board of their kernel: highest priority, then queue number, then id."""
    w = Window.partitionBy("kernel").orderBy(F.desc("priority"), "queue_seq", "task_id")
    return tasks.withColumn("place", F.row_number().over(w))


def allocate(tasks: DataFrame, new: DataFrame) -> DataFrame:
    """Queue numbers for new tasks (kernel, task_id): on from the largest of their kernel, in order of id."""
    top = tasks.groupBy("kernel").agg(F.max("queue_seq").alias("top"))
    nth = F.row_number().over(Window.partitionBy("kernel").orderBy("task_id"))
    return new.withColumn("nth", nth).join(top, "kernel", "left").select("kernel", "task_id", (F.coalesce("top", F.lit(0)) + F.col("nth")).cast("bigint").alias("queue_seq"))


def next_ids(ids: DataFrame, prefix: str, width: int = 4) -> DataFrame:
    """(next_id): the prefix and one more than the largest number among the digits of ids."""
    digits = F.regexp_replace("id", "[^0-9]", "").try_cast("bigint")
    return ids.agg((F.coalesce(F.max(digits), F.lit(0)) + 1).alias("n")).select(F.concat(F.lit(prefix), F.lpad(F.col("n").cast("string"), width, "0")).alias("next_id"))


def patch(docs: DataFrame, patches: DataFrame) -> DataFrame:
    """``docs`` (id, body) with the fields of ``patches`` (id, patch: a JSON object) laid over their bodies, types kept; a patch that is no object changes nothing."""
    both = docs.join(patches.select("id", B.fields("patch").alias("patch_fields")), "id", "left")
    merged = B.overlaid(B.fields("body"), F.coalesce("patch_fields", B.none()))
    return both.select("id", F.coalesce(B.canonical(merged), F.col("body")).alias("body"))


def without_empty(fields: Column) -> Column:
    """A map without its null and empty values."""
    return F.map_filter(fields, lambda k, v: v.isNotNull() & (v != ""))
