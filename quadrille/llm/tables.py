"""Tables, shared folder and bounded filters for the operators of this subpackage."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.session import ensure_checkpoint_dir, read_table

__all__ = ["read_table", "checkpointed", "shared_path", "without", "id_slots", "slot_filter", "in_filter", "bucket_of"]


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Lineage cut in the shared folder, so that a lost executor costs a read and not a recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Keys up to which an anti-join broadcasts them (some 8 MB), so that the rows themselves are not shuffled.
BROADCAST_KEYS = 250_000


def without(rows: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` whose key is not among ``keys``; rows with a null in the key stay."""
    keys = checkpointed(keys.select(*by).distinct())
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(keys) if few else keys, by, "left_anti")


FILTER_BITS = 24


def id_slots(key: Column) -> Column:
    """The slot of a key in a filter of 2**FILTER_BITS bits."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - FILTER_BITS)


def slot_filter(slots: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of the column ``slot`` with 2**bits bits (2 MB by default) whatever the number of rows, so it may be broadcast.

    It only spares work: whoever uses it joins the exact keys afterwards.
    """
    parts = (
        slots.groupBy(F.bitmap_bucket_number(F.col("slot") + 1).alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("bits"))
        .collect()
    )
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in parts:
        at = (row.part - 1) * 4096
        part = np.frombuffer(bytes(row.bits), np.uint8)[: len(out) - at] if at < len(out) else np.zeros(0, np.uint8)
        out[at : at + len(part)] |= part
    return out


def in_filter(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    slots = slots.astype(np.int64)
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def bucket_of(key: Column, seed: int, of: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(of)).cast("int")
