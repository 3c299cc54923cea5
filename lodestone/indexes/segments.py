"""Indexes as segments: folders that are written once, listed when complete, and merged now and then.

An update never rewrites what is there.  It writes a segment with the new rows and the ids that they replace; a row counts
unless a later segment replaces its id.  A segment's number is claimed by creating a file, which only one writer can, and the
segment is read from the moment it is listed as done, so readers see whole segments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import claim, names_in, remove

BUCKETS = 64


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class Segments:
    """What all indexes share: numbering, listing, ids that later segments replace, and merging."""

    #: Table -> DDL of its columns; each is partitioned by segment, and by the columns of ``partitions``.
    tables: dict[str, str] = {}
    partitions: dict[str, Sequence[str]] = {}

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def live(self) -> list[int]:
        return sorted(int(n) for n in names_in(self.spark, f"{self.root}/_done"))

    def _new(self) -> int:
        n = max([0, *(int(x) for x in names_in(self.spark, f"{self.root}/_claimed"))]) + 1
        while not claim(self.spark, f"{self.root}/_claimed/{n}"):
            n += 1
        return n

    def _put(self, segment: int, table: str, rows: DataFrame) -> None:
        """Write rows of a table; integers and sorted strings are delta-coded by Parquet's second writer."""
        writer = rows.write.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false").option("compression", "zstd")
        by = [c for c in self.partitions.get(table, ()) if c in rows.columns]
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.root}/{table}/segment={segment}")

    def table(self, name: str, segments: Sequence[int] | None = None) -> DataFrame:
        """Rows of a table in the segments that are done; filters on segment and partition columns prune folders."""
        live = self.live() if segments is None else list(segments)
        whole = ", ".join([self.tables[name], *(f"{c} int" for c in self.partitions.get(name, ())), "segment int"])
        paths = [f"{self.root}/{name}/segment={n}" for n in live]
        if not paths:
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).option("basePath", f"{self.root}/{name}").parquet(*paths)

    def without_replaced(self, rows: DataFrame, key: str = "id") -> DataFrame:
        """``rows`` (with segment) less those whose id a later segment replaces.  One segment replaces nothing."""
        live = self.live()
        if len(live) <= 1:
            return rows
        gone = self.table("replaced", live[1:]).groupBy(F.col("id").alias("_gone")).agg(F.max("segment").alias("_by"))
        kept = rows.join(gone, F.col(key) == F.col("_gone"), "left").where("_by is null or _by <= segment")
        return kept.drop("_gone", "_by")

    def _done(self, segment: int) -> None:
        claim(self.spark, f"{self.root}/_done/{segment}")

    def _drop(self, segments: Sequence[int]) -> None:
        """Take segments off the list, then delete their files."""
        for n in segments:
            remove(self.spark, f"{self.root}/_done/{n}")
        for n in segments:
            for name in (*self.tables, "replaced"):
                remove(self.spark, f"{self.root}/{name}/segment={n}")


Segments.tables = {"replaced": "id string"}
