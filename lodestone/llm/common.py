"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import materialize, release, remove, scratch

__all__ = ["ascii_lower", "broadcast_if_small", "materialize", "release", "remove", "scratch", "table", "text_slices", "unit_interval"]

SLICE_BYTES = 4 << 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; all-ASCII strings take the byte-wise path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Hint a broadcast only after counting ``df``: above ``max_rows`` the join is left to the optimizer."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def text_slices(batch: pa.RecordBatch, column: int | str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of about ``most`` bytes of text, a row at least: what a task makes of texts is bounded by a part.

    After each part the worker gives back what Arrow's pool has free."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
    for start, end in pairwise([0, *cuts.tolist(), len(sizes)]):
        if end > start:
            yield batch.slice(start, end - start)
            pa.default_memory_pool().release_unused()


def unit_interval(key: Column, salt: str = "") -> Column:
    """A number in (0, 1) that depends on ``key`` only: 52 bits of its MD5, centred in their cell."""
    digest = F.md5(F.concat(F.lit(salt), F.coalesce(key.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
