"""Documents' JSON bodies as maps of variants: fields keep their types, texts come out with sorted keys.

A body that is no JSON object has no fields (null).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = "map<string,variant>"


def fields(body: Column | str) -> Column:
    return F.from_json(body, FIELDS)


def none() -> Column:
    return F.from_json(F.lit("{}"), FIELDS)


def overlaid(lower: Column, upper: Column) -> Column:
    """The fields of ``lower`` under those of ``upper``, which win."""
    return F.map_concat(F.map_filter(lower, lambda k, v: ~F.map_contains_key(upper, k)), upper)


def without(some: Column, *keys: str) -> Column:
    return F.map_filter(some, lambda k, v: ~k.isin(*keys))


def canonical(some: Column) -> Column:
    """The fields as JSON text with sorted keys and no white space."""
    order = F.array_sort(F.map_entries(some), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    return F.to_json(F.map_from_entries(order))


def text(some: Column, key: str | Column) -> Column:
    """A field as text; null if it is missing."""
    return F.try_variant_get(F.try_element_at(some, F.lit(key) if isinstance(key, str) else key), "$", "string")


def of(**columns: Column) -> Column:
    """Fields of columns; nulls are left out."""
    return of_pairs(columns)


def of_pairs(columns: dict[str, Column]) -> Column:
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), c.cast("variant").alias("value")) for k, c in columns.items()])
    return F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull()))


def from_entries(entries: Column) -> Column:
    """Fields of an array of (key, value); of several with one key the last."""
    later = lambda x, i: F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda y: y["key"] == x["key"])
    return F.map_from_entries(F.filter(entries, lambda x, i: ~later(x, i)))
