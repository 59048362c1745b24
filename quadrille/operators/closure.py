"""Transitive closure by a semi-naive frontier: each round joins only what the last one found.

Rounds are checkpointed in the shared folder, so lineage stays short and a lost executor costs a read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.session import ensure_checkpoint_dir


@dataclass
class Reached:
    """Pairs found, the depth of the last round that found any, and whether ``max_depth`` cut the search."""

    pairs: DataFrame
    depth: int
    truncated: bool


def closure(edges: DataFrame, starts: DataFrame | None = None, max_depth: int | None = 64, keys: tuple[str, ...] = ()) -> Reached:
    """All (src, dst, depth) with a path of one or more of ``edges`` (src, dst), from ``starts`` (src) or everywhere.

    ``keys`` are columns that stay equal along a path, such as the graph. A start is among its own ends only if
    it lies on a cycle. Without ``max_depth`` rounds go on until one finds nothing.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    keys = list(keys)
    edges = edges.select(*keys, "src", "dst").distinct().checkpoint()
    first = edges if starts is None else edges.join(starts.select("src").distinct(), "src", "left_semi")
    frontier = first.select(*keys, "src", "dst", F.lit(1).alias("depth"))
    found, depth = frontier.checkpoint(), 1
    frontier = found
    if frontier.isEmpty():
        return Reached(found, 0, False)
    step = edges.select(*keys, F.col("src").alias("dst"), F.col("dst").alias("next"))
    while True:
        ahead = frontier.join(step, [*keys, "dst"]).select(*keys, "src", F.col("next").alias("dst")).distinct()
        fresh = ahead.join(found.select(*keys, "src", "dst"), [*keys, "src", "dst"], "left_anti").withColumn("depth", F.lit(depth + 1)).checkpoint()
        if fresh.isEmpty():
            return Reached(found, depth, False)
        if max_depth is not None and depth >= max_depth:
            return Reached(found, depth, True)
        found, frontier, depth = found.unionByName(fresh), fresh, depth + 1


def reach(quads: DataFrame, start: str, via: str, max_depth: int = 64, declared: list[str] | None = None) -> Reached:
    """What ``start`` reaches over one predicate, within each graph; the predicate must be declared, if a list is given."""
    if declared is not None and via not in declared:
        raise ValueError(f"predicate {via!r} is not declared")
    edges = quads.where((F.col("p") == via) & (F.col("o_kind") != 3)).select("g", F.col("s").alias("src"), F.col("o").alias("dst"))
    starts = quads.sparkSession.createDataFrame([(start,)], "src string")
    return closure(edges, starts, max_depth, ("g",))
