"""Joins of huge tables with lookup tables, safe against hot keys and grown lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.workdir import written

BROADCAST_BYTES = 64 * 1024 * 1024
# A key is hot when it has more than one in HOT_SHARE of all rows: there are fewer than that many.
HOT_SHARE = 1000


def hot_hashes(uses: DataFrame, keys: Sequence[str], count: str = "uses") -> list[int]:
    """Hashes of the hot keys of a table that holds each key once with its number of uses."""
    total = uses.agg(F.sum(count)).first()[0] or 0
    hashes = uses.where(F.col(count) * HOT_SHARE > total).select(F.xxhash64(*keys).alias("h"))
    return [row.h for row in hashes.collect()]


def salted_lookup(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], hot: Sequence[int],
                  spread_by: Sequence[str], salts: int = 64) -> DataFrame:
    """Left join on (left, right) key pairs with hot keys spread over ``salts`` keys on both sides.

    The right side holds each key once. Rows of a hot key scatter by a hash of ``spread_by``, and
    the one right row of that key is repeated per salt; all other keys join as they are.
    """
    left_hash, right_hash = F.xxhash64(*[a for a, _ in keys]), F.xxhash64(*[b for _, b in keys])
    spread = F.pmod(F.xxhash64(*spread_by), F.lit(salts))
    # NULL keys match nothing, so they may lie anywhere; there may be very many of them.
    unmatched = F.lit(False)
    for a, _ in keys:
        unmatched = unmatched | F.col(a).isNull()
    salted_left = left.withColumn("_salt", F.when(unmatched | left_hash.isin(list(hot)), spread).otherwise(F.lit(0)).cast("int"))
    copies = F.when(right_hash.isin(list(hot)), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    names = {b: f"_key_{b}" for _, b in keys}
    salted_right = right.withColumn("_right_salt", F.explode(copies)).withColumnsRenamed(names)
    match = F.col("_salt") == F.col("_right_salt")
    for a, b in keys:
        match = match & (F.col(a) == F.col(names[b]))
    return salted_left.join(salted_right, match, "left").drop("_salt", "_right_salt", *names.values())


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], spread_by: Sequence[str],
           name: str = "lookup") -> DataFrame:
    """Left join that adds the right side's columns.

    The right side, with each key once, is written down and measured: up to ``BROADCAST_BYTES`` it is
    broadcast and the left side is not moved at all; beyond that both sides are shuffled with
    hot keys salted.
    """
    stored = written(right, name)
    size = stored.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        added = [c for c in right.columns if c not in keys]
        return left.join(F.broadcast(stored), list(keys), "left").select(*left.columns, *added)
    uses = written(left.groupBy(*keys).agg(F.count(F.lit(1)).alias("uses")), f"{name}-uses")
    return salted_lookup(left, stored, [(k, k) for k in keys], hot_hashes(uses, keys), spread_by)
