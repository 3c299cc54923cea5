"""Joins in which one key may hold a large part of the rows of one side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key that one task may take.
HEAVY = 50_000


def heavy_keys(rows: DataFrame, keys: Sequence[str], most: int = HEAVY, count: int | None = None) -> DataFrame | None:
    """Keys with over ``most`` rows, and into how many parts they are dealt: at most rows / ``most`` of them, so they may be broadcast.

    None if ``count``, the number of all rows, says that there can be none."""
    if count is not None and count <= most:
        return None
    return rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*keys, F.ceil(F.col("_n") / most).cast("int").alias("_parts"))


def join_skewed(many: DataFrame, one: DataFrame, keys: Sequence[str], by: str, heavy: DataFrame | None) -> DataFrame:
    """``many`` with the row of ``one`` of the same keys (null-free).  Rows of heavy keys are dealt by a hash of column ``by``, and their row of ``one`` is copied to each part."""
    if heavy is None:
        return many.join(one, list(keys))
    few = F.broadcast(heavy)
    left = many.join(few, list(keys), "left").withColumn("_salt", F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    right = one.join(few, list(keys), "left").withColumn("_salt", copies).drop("_parts")
    return left.join(right, [*keys, "_salt"]).drop("_salt")
