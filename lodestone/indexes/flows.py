"""Stored call flows, kept up to date with their graph.

``walks`` holds what each entry point reaches, in folders by a hash of the node reached: it is the index from a node to the
flows through it.  After a change of edges only the entry points whose walk met the source of a changed edge, and new entry
points, are walked again; other walks are taken over.  Flows, their labels and their ranking are made from the walks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.indexes.segments import Segments, bucket_of
from lodestone.operators import graph as O
from lodestone.session import materialize

DEPTH = 10


class FlowIndex(Segments):
    tables = {
        "walks": "seed string, node string, depth int",
        "starts": "id string, out_degree long, in_degree long",
        "flows": "seed string, label string, depth int, n_steps int, steps array<struct<depth:int,name:string,node:string>>",
    }
    partitions = {"walks": ("bucket",)}

    def _put_all(self, walks: DataFrame, starts: DataFrame, entities: DataFrame) -> None:
        """The new state as a segment; the one before goes once this is listed."""
        old, segment = self.live(), self._new()
        self._put(segment, "walks", walks.withColumn("bucket", bucket_of(F.col("node"))).repartition("bucket").sortWithinPartitions("bucket", "node"))
        self._put(segment, "starts", starts.select("id", "out_degree", "in_degree"))
        self._put(segment, "flows", O.flows_of(self.table("walks", [segment]).drop("bucket", "segment"), starts, entities))
        self._done(segment)
        self._drop(old)

    def build(self, entities: DataFrame, edges: DataFrame) -> None:
        starts = materialize(O.entry_points(entities, edges))
        self._put_all(O.reach(O.call_steps(edges), starts.select(F.col("id").alias("seed")), DEPTH), starts, entities)

    def refresh(self, entities: DataFrame, edges: DataFrame, changed: DataFrame) -> int:
        """Bring the flows up to ``edges``; ``changed``: the sources of calls that were added or removed.  How many entry points were walked again."""
        starts = materialize(O.entry_points(entities, edges))
        walks = self.table("walks").drop("bucket", "segment")
        # a node of the last depth is never left, so its calls do not matter
        met = walks.where(F.col("depth") < DEPTH).join(changed.select(F.col(changed.columns[0]).alias("node")).distinct(), "node", "left_semi").select("seed").distinct()
        kept = walks.select("seed").distinct().join(met, "seed", "left_anti").join(starts.select(F.col("id").alias("seed")), "seed", "left_semi")
        kept = materialize(kept)
        again = materialize(starts.select(F.col("id").alias("seed")).join(kept, "seed", "left_anti"))
        fresh = O.reach(O.call_steps(edges), again, DEPTH)
        self._put_all(walks.join(kept, "seed", "left_semi").unionByName(fresh), starts, entities)
        return again.count()

    def flows(self, through: str | None = None) -> DataFrame:
        """All flows, or those through a node, which its own folder names."""
        found = self.table("flows").drop("segment")
        if through is None:
            return found
        seeds = self.table("walks").where((F.col("bucket") == bucket_of(F.lit(through))) & (F.col("node") == through)).select("seed")
        return found.join(seeds, "seed", "left_semi")
