"""Governed reads: patterns that are registered as data, with parameters that pass a gate, and derived values likewise.

A read is a JSON object: ``where`` (triples; ``?x`` is a variable, ``$x$`` a parameter), ``optional`` and ``minus``
(lists of triples each), ``any`` (alternatives), ``filters`` ([left, operator, right]; a right side is a variable, a
number, a text or a list), ``select``, ``by`` and ``count`` (variables), ``minus_of`` ({name: [a, b]}: a - b), ``same_graph``.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import terms as T
from quadrille.operators import pattern as P
from quadrille.operators.documents import Refused

PARTS = {"where", "optional", "minus", "any", "filters", "select", "by", "count", "minus_of", "same_graph"}
OPERATORS = ["=", "!=", "<", "<=", ">", ">=", "in", "starts", "contains"]
PLAN = "kernel string, verb string, epoch bigint, kind string, statement string, params array<string>"


def check(spec: dict) -> None:
    """Refuses a read that is not of this form."""
    if not spec.get("where") and not spec.get("any") or set(spec) - PARTS:
        raise Refused(f"a read has where or any, and else only {sorted(PARTS)}")
    triples = [t for k in ("where",) for t in spec.get(k, [])] + [t for k in ("optional", "minus", "any") for part in spec.get(k, []) for t in part]
    if any(not isinstance(t, list) or len(t) != 3 or not all(isinstance(x, str) for x in t) for t in triples):
        raise Refused("a pattern is a list of three texts")
    if any(len(f) != 3 or f[1] not in OPERATORS for f in spec.get("filters", [])):
        raise Refused(f"a filter is [left, operator, right], with one of {OPERATORS}")


def bind(spec: dict, declared: list[str], given: dict[str, str]) -> dict:
    """The read with its parameters in place: all declared ones and no others, of safe characters only."""
    if extra := sorted(set(given) - set(declared)):
        raise Refused(f"undeclared parameters {extra}")
    for name in declared:
        if given.get(name) is None:
            raise Refused(f"missing parameter {name!r}")
        if not re.fullmatch(T.PARAMETER_PATTERN, str(given[name])):
            raise Refused(f"parameter {name!r} has a value that is not allowed")

    def put(x):
        if isinstance(x, list):
            return [put(y) for y in x]
        if isinstance(x, dict):
            return {k: put(v) for k, v in x.items()}
        if isinstance(x, str):
            for name in declared:
                x = x.replace(f"${name}$", str(given[name]))
        return x

    return put(spec)


def _filter(left: str, op: str, right) -> Column:
    a = F.col(left.removeprefix("?"))
    if op == "in":
        return a.isin(list(right))
    if isinstance(right, str) and right.startswith("?"):
        b: Column = F.col(right[1:])
    elif isinstance(right, (int, float)):
        a, b = T.without_datatype(a).try_cast("double"), F.lit(float(right))
    else:
        b = F.lit(right)
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "starts": F.startswith(a, b), "contains": F.contains(F.lower(a), F.lower(b))}[op]


def read(quads: DataFrame, spec: dict) -> DataFrame:
    """The answer of a bound read over quads, as a plan."""
    check(spec)
    same = bool(spec.get("same_graph"))
    group = lambda triples: P.match(quads, [tuple(t) for t in triples], same)
    rows = group(spec["where"]) if spec.get("where") else None
    if spec.get("any"):
        either = P.alternatives(*[group(part) for part in spec["any"]])
        rows = either if rows is None else P.join(rows, either)
    for part in spec.get("optional", []):
        rows = P.optional(rows, group(part))
    for part in spec.get("minus", []):
        rows = P.minus(rows, group(part))
    for left, op, right in spec.get("filters", []):
        rows = rows.where(_filter(left, op, right))
    for name, (a, b) in spec.get("minus_of", {}).items():
        number = lambda v: T.without_datatype(F.col(v.removeprefix("?"))).try_cast("decimal(38,0)")
        rows = rows.withColumn(name, (number(a) - number(b)).cast("bigint"))
    by = [v.removeprefix("?") for v in spec.get("by", [])]
    if spec.get("count"):
        return rows.groupBy(*by).agg(F.count_distinct(*[v.removeprefix("?") for v in spec["count"]]).alias("n"))
    return rows.select(*[v.removeprefix("?") for v in spec["select"]]).distinct() if spec.get("select") else rows


def registered(spark, kernel: str, epoch: int, detail: dict) -> DataFrame:
    """The plan row (``PLAN``) that an accepted affordance adds: ``query`` is a read, or ``formula`` and ``scope`` a derived value."""
    verb = detail.get("verb")
    if not isinstance(verb, str) or not re.match(T.VERB_NAME, verb):
        raise Refused(f"no safe verb: {verb!r}")
    if detail.get("formula"):
        scope = detail.get("scope") or {}
        if not scope.get("type") or not scope.get("about_prop"):
            raise Refused("a derived value needs a scope with type and about_prop")
        return spark.createDataFrame([(kernel, verb, epoch, "derived", json.dumps({"formula": detail["formula"], "scope": scope}, sort_keys=True), ["concept"])], PLAN)
    params = detail.get("params", [])
    if not isinstance(params, list) or not all(isinstance(p, str) and re.match(T.VERB_NAME, p) for p in params):
        raise Refused("parameters are a list of safe names")
    spec = detail.get("query")
    spec = json.loads(spec) if isinstance(spec, str) else spec
    if not isinstance(spec, dict):
        raise Refused("a query is a read as a JSON object")
    check(spec)
    return spark.createDataFrame([(kernel, verb, epoch, "query", json.dumps(spec, sort_keys=True), params)], PLAN)


#: The published reads of the wave vocabulary, as data: who is blocked, what is stale, how much is repair.
W, C, A = T.WAVE, T.CORE, T.RDF_TYPE
VOCABULARY = {
    "blocked": {"where": [["?i", W + "filedBy", "?c"], ["?i", W + "blockedOn", "?t"], ["?i", W + "forPass", "?p"]], "select": ["?c", "?t", "?p"]},
    "stale_tickets": {"where": [["?t", A, W + "Ticket"], ["?t", W + "openedAtPass", "?opened"], ["?t", W + "ticketState", "?s"]], "filters": [["?s", "!=", "closed"]], "select": ["?t", "?opened"]},
    "bound_elsewhere": {"where": [["?c", W + "statement", "?st"], ["?st", W + "bindsRoot", "?bound"], ["?st", W + "forPass", "?p"], ["?p", A, W + "Pass"], ["?p", C + "surfaceDigest", "?surface"]], "filters": [["?bound", "!=", "?surface"]], "select": ["?c", "?bound", "?surface"]},
    "capacity": {"where": [["?i", A, W + "Index"], ["?i", W + "capacity", "?cap"]], "by": ["?cap"], "count": ["?i"]},
    "correction_rate": {"where": [["?r", A, W + "Ruling"], ["?r", W + "refutedAtPass", "?x"]], "count": ["?r"]},
    "unconfirmed": {"where": [["?t", A, W + "Ticket"], ["?t", W + "ticketState", "delivered"]], "minus": [[["?cf", W + "confirmsTicket", "?t"]]], "select": ["?t"]},
    "stale_overwrite": {"where": [["?op", W + "opKind", "supersede"], ["?op", W + "supersedes", "?old"], ["?st", W + "bindsRoot", "?old"]], "select": ["?old"]},
    "operations_of_pass": {"where": [["?o", A, W + "Operation"], ["?o", W + "opKind", "?k"], ["?o", W + "opAtPass", "$pass$"]], "by": ["?k"], "count": ["?o"]},
    "declared_defects": {"where": [["?d", A, W + "Defect"], ["?d", W + "defectState", "declared"]], "select": ["?d"]},
    "belief_age": {"where": [["?d", W + "discoveredAtPass", "?f"], ["?d", W + "resolvedAtPass", "?r"]], "minus_of": {"passes": ["?r", "?f"]}, "select": ["?d", "passes"]},
    "without_evidence": {"where": [["?o", A, W + "Operation"]], "minus": [[["?o", W + "opEvidence", "?e"]]], "select": ["?o"]},
    "own_corrections": {"where": [["?o", W + "opKind", "?k"], ["?o", C + "createdBy", "?d"]], "filters": [["?k", "in", ["withdraw", "correct", "refute"]]], "count": ["?o"]},
}
