"""A trigram index of names.

A posting is (trigram, number of the name's trigrams, ids).  How many trigrams a name shares with what is asked is the number
of its postings among those read, and its own number of trigrams is in them, so the similarity, shared over all, is known
without the name.  A name of n trigrams can reach the threshold t against one of m only if t * m <= n <= m / t, which skips
row groups, and only if it shares t * (m + n) / (1 + t) of them; ids below that are dropped in the count, and no name is fetched.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import names, scoring
from lodestone.indexes.segments import Segments, bucket_of

NAMES_A_BLOCK = 16_384


class NameIndex(Segments):
    tables = {"postings": "tri string, size int, block int, ids array<string>", "replaced": "id string"}
    partitions = {"postings": ("bucket",)}

    def write(self, rows: DataFrame, column: str = "name", replaces: DataFrame | None = None) -> int:
        segment = self._new()
        blocks = max(1, math.ceil(rows.count() / NAMES_A_BLOCK))
        own = rows.select("id", scoring.trigrams(names.normalize_name(F.col(column))).alias("tris"))
        each = own.select("id", F.size("tris").alias("size"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.explode("tris").alias("tri"))
        each = each.withColumn("bucket", bucket_of(F.col("tri"))).repartition("bucket", "block")
        lists = each.groupBy("bucket", "block", "tri", "size").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        self._put(segment, "postings", lists.sortWithinPartitions("bucket", "tri", "size", "block"))
        ids = rows.select("id")
        if self.live():
            gone = ids if replaces is None else ids.unionByName(replaces.select(F.col(replaces.columns[0]).alias("id")))
            self._put(segment, "replaced", gone.distinct())
        else:
            self._put(segment, "replaced", ids.limit(0))
        self._done(segment)
        return segment

    def similar(self, wanted: Sequence[str], least: float) -> DataFrame:
        """(token, id, similarity) of all names at or above ``least``; ``wanted`` are a question's words."""
        assert 0 < least <= 1
        rows = self.spark.createDataFrame([(w,) for w in dict.fromkeys(wanted)], "token string")
        # a question's own words, so their trigrams are few: they become the constants that prune folders
        asked = [(r.token, r.tris) for r in rows.select("token", scoring.trigrams(names.normalize_name(F.col("token"))).alias("tris")).collect()]
        pairs = [(token, t, len(tris)) for token, tris in asked for t in tris]
        if not pairs:
            return self.spark.createDataFrame([], "token string, id string, similarity double")
        tris = sorted({t for _, t, _ in pairs})
        low, high = (f(bound) for f, bound in ((min, [math.ceil(least * m - 1e-9) for _, _, m in pairs]), (max, [math.floor(m / least + 1e-9) for _, _, m in pairs])))
        found = self.table("postings").where(F.col("bucket").isin(*[bucket_of(F.lit(t)) for t in tris]) & F.col("tri").isin(tris) & F.col("size").between(low, high))
        table = F.broadcast(self.spark.createDataFrame(pairs, "token string, tri string, m int"))
        met = found.join(table, "tri").where((F.col("size") >= least * F.col("m") - 1e-9) & (F.col("size") <= F.col("m") / least + 1e-9))
        each = self.without_replaced(met.select("token", "m", "size", "segment", F.explode("ids").alias("id")))
        shared = each.groupBy("token", "m", "size", "id").agg(F.count("*").alias("n"))
        near = F.col("n") / (F.col("m") + F.col("size") - F.col("n"))
        return shared.withColumn("similarity", near).where(F.col("similarity") >= least).select("token", "id", "similarity")

    def merge(self) -> None:
        live = self.live()
        if len(live) <= 1:
            return
        segment = self._new()
        each = self.without_replaced(self.table("postings", live).select("bucket", "tri", "size", "segment", F.explode("ids").alias("id")))
        blocks = max(1, math.ceil(each.select("id").distinct().count() / NAMES_A_BLOCK))
        each = each.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).repartition("bucket", "block")
        lists = each.groupBy("bucket", "block", "tri", "size").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        self._put(segment, "postings", lists.sortWithinPartitions("bucket", "tri", "size", "block"))
        self._put(segment, "replaced", each.select("id").limit(0))
        self._done(segment)
        self._drop(live)
