"""Approximate nearest neighbours by multiprobe p-stable hashing.

Nearness is the inner product.  Vectors are divided by the largest norm and given one more component that makes them unit
vectors, queries are scaled to unit length and given a zero: the order by inner product is then the order by Euclidean
distance, for which a hash ``floor((a . x + b) / w)`` with normal ``a`` is p-stable.  A table joins HASHES of them to a
cell; a query visits its own cell and then cells that differ by one or two steps in some hashes, in the order of the sums of
squared distances to the boundaries crossed (the estimated order of success).  The candidates of all TABLES tables are
merged and ranked by the exact inner product of the original vectors, in double precision.

Only rows and queries that meet in a cell are multiplied.  Equal vectors are one *node*, with its k + 1 least ids, so a vector
that a third of the rows repeat costs as much as any other.  Every node goes to one group of cells in each table, every query
to the groups that hold cells it visits; a task joins one group by cell.  A cell of more than BLOCK nodes is a crowded one:
its nodes are dealt to groups of their own, BLOCK in each, which all its visitors visit.  So no cell is capped, and a task
holds about BLOCK nodes.

A query's k-th best score among a bounded sample of the nodes (SAMPLE) is a lower bound of its k-th best in the table; what
scores less is not sent on.  How many cells a query visits is set before, on the same sample (PROBE_QUERIES of it as queries):
the least number that finds RECALL of the sample's nearest rows, at the depth that corresponds to k in the whole table.  A
query left with fewer than k hits is compared with every row, in blocks (the exact way for the rest).

Defined cases: rows whose id or vector is null, whose vector is zero or holds null or non-finite components take no part;
vectors are compared with those of their own length; a candidate with the query's own id is left out; with fewer than k
candidates, all are returned; rows that repeat an id and a vector count once; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, table

TABLES, HASHES, WIDTH, SEED = 4, 6, 1.25, 42
BLOCK = 4096
SAMPLE, PROBE_QUERIES, RECALL = 4096, 128, 0.95
MOST_PROBES = 4096
MERGE_FAN = 16
_HITS = "node long, less array<double>, ids array<long>"


@cache
def _steps() -> np.ndarray:
    """The MOST_PROBES ways to step over up to two boundaries a hash that are least far on average."""
    every = np.array(list(product((-2, -1, 0, 1, 2), repeat=HASHES)), dtype=np.int64)
    far = np.array([0.0, 1 / 3, 7 / 3])[np.abs(every)].sum(axis=1)  # the mean square of a uniform distance to each boundary
    return every[np.argsort(far, kind="stable")[:MOST_PROBES]]


class Hashes:
    """The hash functions for vectors of ``size`` components, and the cells that queries visit."""

    def __init__(self, size: int) -> None:
        rng = np.random.default_rng([SEED, size])
        self.size = size
        self.normals = rng.normal(size=(TABLES, size + 1, HASHES))
        self.offsets = rng.uniform(0, WIDTH, (TABLES, HASHES))
        self.mix = np.array([1009**i for i in range(HASHES)], dtype=np.int64)

    def _key(self, table_: int, cell: np.ndarray) -> np.ndarray:
        """A cell's number among those of all tables and sizes; a clash would only add candidates."""
        x = (cell * TABLES + table_).astype(np.uint64) + np.uint64(self.size * 0x9E3779B97F4A7C15 % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return (x ^ (x >> np.uint64(31))).view(np.int64)

    def cells(self, vectors: np.ndarray, largest: float) -> np.ndarray:
        """(row, table) -> cell."""
        scaled = vectors / largest
        unit = np.c_[scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1)))]
        places = [np.floor((unit @ n + o) / WIDTH).astype(np.int64) @ self.mix for n, o in zip(self.normals, self.offsets, strict=True)]
        return np.stack([self._key(t, p) for t, p in enumerate(places)], axis=1)

    def probes(self, queries: np.ndarray, count: int) -> np.ndarray:
        """(query, table, nth) -> cell to visit, best first."""
        unit, steps = np.c_[queries / np.linalg.norm(queries, axis=1, keepdims=True), np.zeros(len(queries))], _steps()
        out = np.empty((len(queries), TABLES, count), dtype=np.int64)
        for t in range(TABLES):
            place = (unit @ self.normals[t] + self.offsets[t]) / WIDTH
            home = np.floor(place)
            below = place - home
            cost = np.zeros((len(queries), len(steps)))
            for step, distance in ((-1, below), (-2, below + 1), (1, 1 - below), (2, 2 - below)):
                cost += distance**2 @ (steps == step).T
            order = np.argsort(cost, axis=1, kind="stable")[:, :count]
            out[:, t] = self._key(t, (home.astype(np.int64) @ self.mix)[:, None] + (steps @ self.mix)[order])
        return out


def met(hashes: Hashes, vectors: np.ndarray, queries: np.ndarray, largest: float, count: int) -> np.ndarray:
    """Which rows each query meets in the cells it visits, in any table: for calibration and tests on bounded data."""
    cells, probes = hashes.cells(vectors, largest), hashes.probes(queries, count)
    out = np.zeros((len(queries), len(vectors)), dtype=bool)
    for t in range(TABLES):
        for q in range(len(queries)):
            out[q] |= np.isin(cells[:, t], probes[q, t])
    return out


def probes_needed(sample: np.ndarray, largest: float, total: int, k: int, recall: float = RECALL) -> int:
    """Cells to visit in each table so that a share of ``recall`` of the sample's nearest rows is found."""
    if len(sample) <= k + 1:
        return MOST_PROBES
    queries = sample[:PROBE_QUERIES]
    depth = max(1, round(k * len(sample) / max(total, 1)))
    exact = queries @ sample.T
    exact[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    nearest_ = np.argpartition(-exact, depth - 1, axis=1)[:, :depth]
    hashes = Hashes(sample.shape[1])
    cells, probes = hashes.cells(sample, largest), hashes.probes(queries, MOST_PROBES)
    needed = np.full(nearest_.shape, MOST_PROBES, dtype=np.int64)  # visits until each of the nearest is met in some table
    for q, near in enumerate(nearest_):
        for t in range(TABLES):
            hit = probes[q, t][None, :] == cells[near, t][:, None]
            needed[q] = np.minimum(needed[q], np.where(hit.any(axis=1), hit.argmax(axis=1) + 1, MOST_PROBES))
    return int(np.quantile(needed, recall, method="higher"))


def _stack(column: pa.ChunkedArray | pa.Array, size: int = -1) -> np.ndarray:
    """Vectors of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), size if size >= 0 else len(flat) // max(1, len(column)))


def _by_size(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.asarray(batch.column("size"))
    for size in np.unique(sizes):
        yield batch.filter(pa.array(sizes == size))


def _lists(values: np.ndarray) -> pa.Array:
    """A matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def _place(largest: float, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_size(batch):
                cells = Hashes(int(part.column("size")[0].as_py())).cells(_stack(part.column("v")), largest)
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(cells), _lists((cells.view(np.uint64) % np.uint64(groups)).astype(np.int64))], [*part.schema.names, "cells", "groups"])

    return run


def _ask(sample, count: int, k: int, groups: int):
    """Queries -> the groups they visit, each with the cells visited in it, and the score that a hit needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, owners = sample.value
        for batch in batches:
            for same in _by_size(batch):
                size = int(same.column("size")[0].as_py())
                for at in range(0, len(same), 256):
                    part = same.slice(at, 256)
                    queries, nodes = _stack(part.column("v")), np.asarray(part.column("node"))
                    bound = np.full(len(queries), -np.inf)
                    if size == known.shape[1] and len(known) > k:
                        scores = np.where(nodes[:, None] == owners[None, :], -np.inf, queries @ known.T)
                        best = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
                        bound = np.where(np.isfinite(best), best - 1e-9 * np.abs(best) - 1e-12, -np.inf)
                    probes = Hashes(size).probes(queries, count).reshape(len(queries), -1)
                    group = (probes.view(np.uint64) % np.uint64(groups)).astype(np.int64)
                    order = np.argsort(group, axis=1, kind="stable")
                    probes, group = np.take_along_axis(probes, order, 1), np.take_along_axis(group, order, 1)
                    first = np.c_[np.ones(len(queries), dtype=bool), group[:, 1:] != group[:, :-1]]
                    of, _ = np.nonzero(first)
                    cells = pa.ListArray.from_arrays(pa.array(np.r_[np.flatnonzero(first), first.size].astype(np.int32)), pa.array(probes.ravel()))
                    columns = [part.column("node").take(pa.array(of)), part.column("v").take(pa.array(of)), pa.array(bound[of]), pa.array(group[first]), cells]
                    yield pa.RecordBatch.from_arrays(columns, ["node", "v", "bound", "group", "visits"])

    return run


def _best(k: int, query: np.ndarray, score: np.ndarray, ids: pa.ListArray) -> pa.Table:
    """Hits (query, score, ids of the row) -> for each query its k + 1 best (negative score, id), ties to the smaller id."""
    sizes = np.diff(ids.offsets.to_numpy())
    row, flat = np.repeat(np.arange(len(query)), sizes), ids.flatten().to_numpy()
    query, score = query[row], score[row]
    order = np.lexsort((flat, -score, query))
    query, score, flat = query[order], score[order], flat[order]
    new = np.r_[True, (query[1:] != query[:-1]) | (flat[1:] != flat[:-1]) | (score[1:] != score[:-1])] if len(query) else np.zeros(0, dtype=bool)
    query, score, flat = query[new], score[new], flat[new]
    starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, dtype=np.int64)
    nth = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
    query, score, flat = (x[nth <= k] for x in (query, score, flat))
    starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, dtype=np.int64)
    offsets = pa.array(np.r_[starts, len(query)].astype(np.int32))
    columns = [pa.array(query[starts]), pa.ListArray.from_arrays(offsets, pa.array(-score)), pa.ListArray.from_arrays(offsets, pa.array(flat))]
    return pa.Table.from_arrays(columns, ["node", "less", "ids"])


def _exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return (queries * vectors).sum(axis=1)


def _join_cells(k: int):
    """One group of cells: the queries that visit a cell against the rows in it, and nothing else."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        none = np.empty(0, dtype=np.int64)
        if not len(rows) or not len(asked):
            return _best(k, none, none.astype(np.float64), pa.array([], pa.list_(pa.int64())))
        rows, asked = rows.combine_chunks(), asked.combine_chunks()
        cell = np.asarray(rows.column("cell"))
        order = np.argsort(cell, kind="stable")
        names, start = np.unique(cell[order], return_index=True)
        until = np.r_[start[1:], len(order)]
        visits = asked.column("visits").combine_chunks()
        who, what = np.repeat(np.arange(len(asked)), np.diff(visits.offsets.to_numpy())), visits.flatten().to_numpy()
        at = np.minimum(np.searchsorted(names, what), len(names) - 1)
        there = names[at] == what
        who, at = who[there], at[there]
        by_cell = np.argsort(at, kind="stable")
        who, at = who[by_cell], at[by_cell]
        edges = np.r_[np.searchsorted(at, np.arange(len(names))), len(at)]
        sizes_of_rows, sizes_of_queries = np.diff(rows.column("v").combine_chunks().offsets.to_numpy()), np.diff(asked.column("v").combine_chunks().offsets.to_numpy())
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for size in np.unique(sizes_of_rows):
            mine, theirs = np.flatnonzero(sizes_of_rows == size), np.flatnonzero(sizes_of_queries == size)
            vectors, queries = _stack(rows.column("v").take(pa.array(mine)), int(size)), _stack(asked.column("v").take(pa.array(theirs)), int(size))
            row_at, query_at = np.full(len(rows), -1), np.full(len(asked), -1)
            row_at[mine], query_at[theirs] = np.arange(len(mine)), np.arange(len(theirs))
            bound = np.asarray(asked.column("bound"))[theirs]
            for c in np.flatnonzero(edges[1:] > edges[:-1]):
                r, q = row_at[order[start[c] : until[c]]], query_at[who[edges[c] : edges[c + 1]]]
                r, q = r[r >= 0], q[q >= 0]
                for a in range(0, len(q), BLOCK):  # a bounded product at a time
                    b = q[a : a + BLOCK]
                    x, y = np.nonzero(queries[b] @ vectors[r].T >= bound[b][:, None])
                    if len(x):
                        found.append((theirs[b[x]], mine[r[y]], _exact(queries[b[x]], vectors[r[y]])))
        query, row = (np.concatenate([f[i] for f in found]) if found else none for i in range(2))
        score = np.concatenate([f[2] for f in found]) if found else none.astype(np.float64)
        return _best(k, np.asarray(asked.column("node"))[query], score, rows.column("ids").take(pa.array(row)).combine_chunks())

    return run


def _all_pairs(k: int):
    """One block of rows and one of queries, of one size: all products."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        none = np.empty(0, dtype=np.int64)
        if not len(rows) or not len(asked):
            return _best(k, none, none.astype(np.float64), pa.array([], pa.list_(pa.int64())))
        vectors, queries = _stack(rows.column("v")), _stack(asked.column("v"))
        found = []
        for a in range(0, len(queries), 256):
            scores = queries[a : a + 256] @ vectors.T
            if scores.shape[1] > k + 1:
                least = -np.partition(-scores, k, axis=1)[:, k]
                x, y = np.nonzero(scores >= (least - 1e-9 * np.abs(least) - 1e-12)[:, None])
            else:
                x, y = np.nonzero(np.ones_like(scores, dtype=bool))
            found.append((x + a, y, _exact(queries[x + a], vectors[y])))
        query, row, score = (np.concatenate([f[i] for f in found]) for i in range(3))
        return _best(k, np.asarray(asked.column("node"))[query], score, rows.column("ids").take(pa.array(row)).combine_chunks())

    return run


def _merged(hits: DataFrame, k: int) -> DataFrame:
    """(node, less, ids) -> (node, hits): the k + 1 best of each query."""
    hits = hits.select("node", F.arrays_zip("less", F.col("ids").alias("id")).alias("hits"), F.xxhash64("less", "ids").alias("_part"))
    best = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))), 1, k + 1).alias("hits")
    return hits.groupBy("node", F.pmod("_part", F.lit(MERGE_FAN)).alias("_part")).agg(best).groupBy("node").agg(best)


def _usable(vectors: Column) -> Column:
    """Not null, not zero, and only finite components."""
    fine = F.forall(vectors, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.isNotNull() & fine & F.exists(vectors, lambda x: x != 0)


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def _found_in_cells(nodes: DataFrame, asking: DataFrame, total: int, main: int, largest: float, k: int, recall: float) -> DataFrame:
    """(node, less, ids) from every group of cells."""
    spark = nodes.sparkSession
    share = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, SAMPLE / total))
    taken = nodes.where((F.col("size") == main) & share).select("node", "v").limit(2 * SAMPLE).collect()  # bounded
    known = np.array([r.v for r in taken], dtype=np.float64).reshape(len(taken), main)
    sample = spark.sparkContext.broadcast((known, np.array([r.node for r in taken], dtype=np.int64)))
    count = probes_needed(known, largest, total, k, recall)
    groups = max(1, math.ceil(total * TABLES / BLOCK))
    schema = "node long, v array<double>, ids array<long>, size int, cells array<long>, groups array<long>"
    placed = materialize(nodes.mapInArrow(_place(largest, groups), schema))
    at = placed.select("node", "v", "ids", F.explode(F.arrays_zip(F.col("cells").alias("cell"), F.col("groups").alias("group"))).alias("c"))
    rows = at.select("node", "v", "ids", "c.cell", "c.group")
    visits = asking.mapInArrow(_ask(sample, count, k, groups), "node long, v array<double>, bound double, group long, visits array<long>")
    crowded = rows.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    crowded = materialize(crowded.select(F.col("cell").alias("_cell"), F.ceil(F.col("n") / BLOCK).cast("int").alias("_parts")))
    if crowded.limit(1).count():
        crowded = broadcast_if_small(crowded)
        visits = materialize(visits)
        rows = rows.join(crowded, F.col("cell") == F.col("_cell"), "left")
        salt = F.coalesce(F.pmod(F.xxhash64("node", F.lit(2)), F.col("_parts")).cast("int"), F.lit(-1))
        rows = rows.select("node", "v", "ids", "cell", F.coalesce("_cell", "group").alias("group"), salt.alias("salt"))
        also = visits.select("node", "v", "bound", F.explode("visits").alias("visit")).join(crowded, F.col("visit") == F.col("_cell"))
        also = also.select("node", "v", "bound", F.col("visit").alias("group"), F.array("visit").alias("visits"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("salt"))
        visits = visits.withColumn("salt", F.lit(-1)).unionByName(also)
    else:
        rows, visits = rows.withColumn("salt", F.lit(-1)), visits.withColumn("salt", F.lit(-1))
    return rows.groupBy("group", "salt").cogroup(visits.groupBy("group", "salt")).applyInArrow(_join_cells(k), _HITS)


def _found_in_blocks(nodes: DataFrame, short: DataFrame, k: int) -> DataFrame:
    """(node, less, ids) of the few queries in ``short``, each against every row of its size."""
    blocks = nodes.groupBy("size").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    blocks = broadcast_if_small(materialize(blocks.withColumnRenamed("size", "_size")))
    rows = nodes.join(blocks, F.col("size") == F.col("_size")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    asked = nodes.join(short, "node", "left_semi").join(blocks, F.col("size") == F.col("_size"))
    asked = asked.select(F.col("node").alias("node"), F.col("v").alias("v"), F.col("size").alias("size"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("block"))
    rows = rows.select("node", "v", "ids", "size", "block")
    return rows.groupBy("size", "block").cogroup(asked.groupBy("size", "block")).applyInArrow(_all_pairs(k), _HITS)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``is_query`` picks, the k nearest found among the other rows."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    rows = rows.where(_usable(F.col("v")) & F.col("id").isNotNull()).select("*", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), F.col("v")).alias("h2"))
    rows = materialize(rows.groupBy("id", "h1", "h2").agg(F.max("asked").alias("asked"), F.first("v").alias("v")))
    nth = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))
    nodes = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("h1", "h2").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids"))
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("node"), "v", "ids", F.size("v").alias("size"), "h1", "h2"))
    sizes = nodes.groupBy("size").agg(F.count("*").alias("n"), F.max(_norm(F.col("v"))).alias("norm"))
    main = sizes.orderBy(F.desc("n"), "size").first()
    if main is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    largest = sizes.agg(F.max("norm")).first()[0]
    asked = materialize(rows.where("asked").select(F.col("id").alias("query_id"), "h1", "h2").join(nodes.select("h1", "h2", "node"), ["h1", "h2"]).select("query_id", "node"))
    nodes = nodes.select("node", "v", "ids", "size")
    asking = nodes.join(asked.select("node").distinct(), "node", "left_semi")
    hits = materialize(_merged(_found_in_cells(nodes, asking, main["n"], main["size"], largest, k, recall), k))
    others = F.filter(F.col("hits"), lambda h: h["id"] != F.col("query_id"))
    answers = asked.join(hits, "node", "left").select("query_id", "node", F.slice(others, 1, k).alias("hits"))
    few = F.coalesce(F.size("hits"), F.lit(0)) < k
    short = materialize(answers.where(few).select("node").distinct())
    if short.limit(1).count():
        rest = asked.join(_merged(_found_in_blocks(nodes, short, k), k), "node").select("query_id", "node", F.slice(others, 1, k).alias("hits"))
        answers = answers.join(short, "node", "left_anti").unionByName(rest)
    # an id that repeats with several vectors asks once for each; only the k best of its answers leave a task
    found = answers.select("query_id", F.explode("hits").alias("hit")).select("query_id", "hit.less", "hit.id").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("less", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), (-F.col("less")).alias("score"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
