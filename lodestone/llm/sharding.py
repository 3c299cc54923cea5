"""Sharding by Karmarkar-Karp differencing.

Documents with equal texts form one indivisible group.  The groups are dealt to blocks of a few thousand; each block
starts from one partial partition for each group (all bytes in one part, the others empty) and repeatedly combines the
two partial partitions of largest spread, the parts of one in descending and of the other in ascending order, until one
is left.  Groups too heavy for a block are placed before the others, and the blocks level out the load that they make:
it takes part in the differencing as one more partial partition.  A few blocks are kept free of it and combined with the
sum of all others at the end.  No task holds more than a block of groups, and the rows of a group that makes up a third
of the input are never brought together: only their sum is.

Slots number the rows of a shard without gaps: rows are dealt to buckets by a hash of doc_id, counted by shard and
bucket, and numbered within a bucket after the counts of the buckets before it.

Defined cases: null texts are one group, of size 1 each; an empty table gives no rows; rows may repeat a doc_id
(their slots follow size and checksum).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, table

SHARDS = 8
BLOCK = 4096
MOST_FREE = 256
HEAVY = 1 / 64
_PLACED = "gkey binary, block long, bytes long, part int"
ROWS_A_BUCKET = 20_000


def differencing(parts: Iterable[Iterable[int]]) -> tuple[list[list[int]], list[int]]:
    """Combine partial partitions of k parts each; for each of them where its parts go, and the sums of the final parts."""
    sums = [list(map(int, x)) for x in parts]
    if not sums:
        return [], []
    n, k = len(sums), len(sums[0])
    heap = [(min(x) - max(x), i) for i, x in enumerate(sums)]
    heapq.heapify(heap)
    joined: list[tuple[int, list[int], int, list[int]]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x, y = sums[a], sums[b]
        high = sorted(range(k), key=x.__getitem__, reverse=True)
        low = sorted(range(k), key=y.__getitem__)
        both = [x[i] + y[j] for i, j in zip(high, low, strict=True)]
        joined.append((a, high, b, low))
        heapq.heappush(heap, (min(both) - max(both), len(sums)))
        sums.append(both)
    goes: list[list[int]] = [[]] * len(sums)
    goes[-1] = list(range(k))
    for at in range(len(joined) - 1, -1, -1):
        a, high, b, low = joined[at]
        to = goes[n + at]
        for child, order in ((a, high), (b, low)):
            place = [0] * k
            for position, part in enumerate(order):
                place[part] = to[position]
            goes[child] = place
    return goes[:n], sums[-1]


def _deal(shards: int):
    """One block: its groups, and in each row the load that they have to level out (empty: none)."""

    def run(groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values(["bytes", "gkey"], ascending=[False, True], kind="stable")
        load = groups["load"].iloc[0]
        parts = [[b] + [0] * (shards - 1) for b in groups["bytes"]]
        fixed = load is not None and len(load) > 0
        goes, _ = differencing([*parts, list(load)] if fixed else parts)
        place = [0] * shards
        for part, to in enumerate(goes[-1] if fixed else range(shards)):
            place[to] = part  # the load's parts are shards, so what lands on them takes their names
        return pd.DataFrame({"gkey": groups["gkey"], "block": groups["block"], "bytes": groups["bytes"], "part": np.array([place[g[0]] for g in goes[: len(parts)]], dtype="int32")})

    return run


def _loads(parts: DataFrame, shards: int) -> list[int]:
    """Bytes of each shard: one row of ``shards`` numbers."""
    cells = [F.coalesce(F.sum(F.when(F.col("part") == s, F.col("bytes"))), F.lit(0)).cast("long") for s in range(shards)]
    return list(parts.agg(*cells).first())


def place_groups(groups: DataFrame, shards: int = SHARDS, block_size: int = BLOCK) -> DataFrame:
    """(gkey, bytes), written -> (gkey, bytes, part): the shard of each group.

    Groups above HEAVY of a block's mean bytes would unbalance any block, so they are placed first, by the same steps.
    All blocks but a few then start from an equal share of that load, whose parts are named shards, and level it out.
    The few free blocks are combined with the sum of all that at the end, which takes up the remainders.
    """
    count, total = groups.agg(F.count("*"), F.sum("bytes")).first()
    blocks = max(1, math.ceil(count / block_size))
    free = min(MOST_FREE, blocks // 4)
    keyed = groups.withColumn("block", F.pmod(F.xxhash64("gkey"), F.lit(blocks)).cast("long"))
    if blocks == 1:
        one = keyed.withColumn("load", F.array().cast("array<long>")).groupBy("block")
        return materialize(one.applyInPandas(_deal(shards), _PLACED).select("gkey", "bytes", "part"))
    limit = max(1, int(total / blocks * max(HEAVY, 4 / block_size)))  # so at most a quarter of the groups is above it
    heavy = place_groups(materialize(groups.where(F.col("bytes") > limit)), shards, block_size) if groups.where(F.col("bytes") > limit).limit(1).count() else None
    load = _loads(heavy, shards) if heavy is not None else [0] * shards
    share = F.array(*[F.lit(x // (blocks - free)).cast("long") for x in load])
    light = keyed.where(F.col("bytes") <= limit).withColumn("load", F.when(F.col("block") >= free, share).otherwise(F.array().cast("array<long>")))
    parts = materialize(light.groupBy("block").applyInPandas(_deal(shards), _PLACED))
    if free:
        named = _loads(parts.where(F.col("block") >= free), shards)
        cells = [F.coalesce(F.sum(F.when(F.col("part") == s, F.col("bytes"))), F.lit(0)).cast("long") for s in range(shards)]
        sums = parts.where(F.col("block") < free).groupBy("block").agg(F.array(*cells).alias("sums")).orderBy("block").collect()  # MOST_FREE rows at most
        goes, _ = differencing([[a + b for a, b in zip(named, load, strict=True)], *(r.sums for r in sums)])
        back = [goes[0].index(to) for to in range(shards)]
        rename = {r.block: [back[to] for to in g] for r, g in zip(sums, goes[1:], strict=True)}
        if rename:
            names = parts.sparkSession.createDataFrame(sorted(rename.items()), "b long, names array<int>")
            parts = parts.join(F.broadcast(names), F.col("block") == F.col("b"), "left").withColumn("part", F.coalesce(F.get("names", F.col("part")), "part"))
    parts = parts.select("gkey", "bytes", "part")
    return parts if heavy is None else parts.unionByName(heavy)


def shard_rows(rows: DataFrame, shards: int = SHARDS, block_size: int = BLOCK) -> DataFrame:
    """Rows with gkey and size -> the same rows plus shard: groups by gkey stay whole, bytes are even."""
    groups = materialize(rows.groupBy("gkey").agg(F.sum("size").alias("bytes")))
    placed = place_groups(groups, shards, block_size).select("gkey", F.col("part").alias("shard"))
    return rows.join(placed, "gkey")


def number_rows(rows: DataFrame, total: int, shard: str = "shard", key: str = "doc_id") -> DataFrame:
    """Add slot: 0, 1, ... within each shard, in order of hash bucket, key, and size and checksum where there are such columns."""
    buckets = max(16, math.ceil(total / ROWS_A_BUCKET))
    dealt = materialize(rows.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets))))
    counts = dealt.groupBy(shard, "_bucket").count()
    before = F.sum("count").over(Window.partitionBy(shard).orderBy("_bucket")) - F.col("count")
    offsets = broadcast_if_small(counts.select(F.col(shard).alias("_s"), F.col("_bucket").alias("_b"), before.alias("_before")))
    ties = [c for c in ("size", "text_crc32") if c in rows.columns]
    within = F.row_number().over(Window.partitionBy(shard, "_bucket").orderBy(key, *ties)) - 1
    numbered = dealt.withColumn("_within", within).join(offsets, (F.col(shard) == F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    return numbered.withColumn("slot", (F.col("_before") + F.col("_within")).cast("long")).drop("_bucket", "_s", "_b", "_before", "_within")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of ``docs``; the law is ``bytes``."""
    text = F.col("text")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(bytearray())).alias("gkey"),
    )
    rows = materialize(rows)
    placed = shard_rows(rows, shards).drop("gkey")
    return number_rows(placed, rows.count()).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
