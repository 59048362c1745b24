"""Graph patterns as joins: variables are names with ``?``, everything else is a constant.

A basic pattern is a chain of equi-joins on shared variables; optional parts are left joins, alternatives a
union, exclusions anti-joins, filters plain predicates. With ``same_graph`` all parts must hold in one graph,
which is then the column ``g``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Triple = tuple[str, str, str]


def one(quads: DataFrame, triple: Triple, same_graph: bool = False, distinct: bool = True) -> DataFrame:
    """The bindings of one triple pattern; without ``distinct``, a triple of several graphs may bind more than once."""
    keep, rows = {}, quads
    for column, term in zip("spo", triple, strict=True):
        if not term.startswith("?"):
            rows = rows.where(F.col(column) == term)
        elif term[1:] in keep:
            rows = rows.where(F.col(column) == F.col(keep[term[1:]]))
        else:
            keep[term[1:]] = column
    out = [F.col(c).alias(v) for v, c in keep.items()]
    found = rows.select(*([F.col("g")] if same_graph else []), *(out or [F.lit(1).alias("_")]))
    return found.distinct() if distinct else found


def join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all shared variables; patterns that share none are refused, as their product is no join."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError(f"patterns share no variable: {left.columns} and {right.columns}")
    return left.join(right, shared, how)


def match(quads: DataFrame, triples: list[Triple], same_graph: bool = False) -> DataFrame:
    return reduce(join, [one(quads, t, same_graph, distinct=False) for t in triples]).distinct()


def optional(bindings: DataFrame, more: DataFrame) -> DataFrame:
    return join(bindings, more, "left")


def alternatives(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).distinct()


def minus(bindings: DataFrame, excluded: DataFrame) -> DataFrame:
    return join(bindings, excluded, "left_anti")


def ask(bindings: DataFrame) -> DataFrame:
    """One row: whether there is any binding."""
    return bindings.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))
