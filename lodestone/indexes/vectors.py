"""A stored index of vectors: cells around centres that are fitted on a bounded sample, as a partition column.

Every vector lies in the folder of the centre whose direction is nearest to its own.  A cell knows its width, the largest
angle between its centre and a member, so no member can be nearer to a query than the query's angle to the centre less that
width.  A search opens the cells whose centres are nearest to the query and ranks their rows by exact cosine; cells that
cannot hold anything above the threshold are never opened.  If it finds fewer rows than were asked for, it opens all cells
that could hold one, so short answers are exact.  With ``exact`` it goes on until no unopened cell can hold a better row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import scoring
from lodestone.indexes.segments import Segments

#: Rows that the centres are fitted on, at most, and centres, at most.
SAMPLE = 16_384
MOST_CELLS = 1024
RECALL = 0.95


def unit(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(size > 0, size, 1)


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Directions of ``cells`` centres: k-means by cosine; a centre without members takes the worst placed row."""
    rows, rng = unit(np.asarray(sample, dtype=np.float64)), np.random.default_rng(seed)
    centres = rows[np.sort(rng.choice(len(rows), min(cells, len(rows)), replace=False))]
    for _ in range(rounds):
        near = rows @ centres.T
        home = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, rows)
        empty = np.flatnonzero(np.bincount(home, minlength=len(centres)) == 0)
        if len(empty):
            sums[empty] = rows[np.argsort(near.max(axis=1))[: len(empty)]]
        centres = unit(sums)
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray, k: int = 20, recall: float = RECALL) -> int:
    """How many of the nearest cells hold, on average, that share of the k nearest rows of rows of the sample."""
    rows = unit(np.asarray(sample, dtype=np.float64))
    asked = rows[:: max(1, len(rows) // 200)]
    home = (rows @ centres.T).argmax(axis=1)
    near = asked @ rows.T
    top = np.argsort(-near, axis=1)[:, 1 : k + 1]
    rank = np.empty((len(asked), len(centres)), dtype=np.int64)
    np.put_along_axis(rank, np.argsort(-(asked @ centres.T), axis=1), np.arange(len(centres))[None, :], axis=1)
    needed = np.sort(np.take_along_axis(rank, home[top], axis=1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]) + 1 if len(needed) else len(centres)


def _place(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1) if len(batch) else np.empty((0, centres.shape[1]))
            near = unit(flat) @ centres.T
            cell = near.argmax(axis=1) if len(batch) else np.empty(0, dtype=np.int64)
            angle = np.arccos(np.clip(near.max(axis=1), -1, 1)) if len(batch) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors, pa.array(angle), pa.array(cell, pa.int32())], ["id", "embedding", "angle", "cell"])

    return run


class VectorIndex(Segments):
    tables = {"vectors": "id string, embedding array<float>, angle double", "cells": "cell int, n long, width double", "replaced": "id string"}
    partitions = {"vectors": ("cell",)}

    def __init__(self, spark: SparkSession, root: str) -> None:
        super().__init__(spark, root)
        self._fit: tuple[np.ndarray, int] | None = None

    def fit(self, rows: DataFrame, cells: int | None = None) -> None:
        """Centres from a sample of at most SAMPLE rows of the commonest length, and how many cells a search opens; they stay as they are for all later segments."""
        usable = _usable(rows)
        sizes = usable.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
        usable, n = (usable.where(F.size("embedding") == sizes["size"]), sizes["count"]) if sizes else (usable, 0)
        part = usable if n <= SAMPLE else usable.orderBy(F.xxhash64("id")).limit(SAMPLE)
        sample = np.array([r.embedding for r in part.select("embedding").collect()], dtype=np.float64)
        count = cells or max(1, min(MOST_CELLS, int(math.sqrt(n))))
        centres = fit_centres(sample, count) if len(sample) else np.zeros((0, 0))
        # a cell of the sample holds fewer rows than one of the whole, so the same share of the nearest is looked for among fewer
        probes = probes_for(sample, centres, max(1, min(20, len(sample) - 1))) if len(sample) > 1 else 1
        table = self.spark.createDataFrame([(i, [float(x) for x in c], probes) for i, c in enumerate(centres)], "cell int, centre array<double>, probes int")
        table.coalesce(1).write.parquet(f"{self.root}/centres")
        self._fit = None

    def centres(self) -> tuple[np.ndarray, int]:
        """The centres, MOST_CELLS rows at most, and the number of cells to open."""
        if self._fit is None:
            rows = sorted(self.spark.read.schema("cell int, centre array<double>, probes int").parquet(f"{self.root}/centres").collect())
            self._fit = np.array([r.centre for r in rows], dtype=np.float64), rows[0].probes if rows else 0
        return self._fit

    def write(self, rows: DataFrame, replaces: DataFrame | None = None) -> int:
        """Index id and embedding of ``rows``; vectors that are null, zero or of another length are left out, as nothing is similar to them."""
        centres, _ = self.centres()
        segment = self._new()
        own = _usable(rows).where(F.size("embedding") == centres.shape[1]).select("id", F.col("embedding").cast("array<float>").alias("embedding"))
        placed = own.mapInArrow(_place(centres), "id string, embedding array<float>, angle double, cell int")
        files = max(1, math.ceil(rows.count() / 200_000))  # of each cell; a crowded cell is in several
        self._put(segment, "vectors", placed.repartition(F.col("cell"), F.pmod(F.xxhash64("id"), F.lit(files))))
        cells = self.table("vectors", [segment]).groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("width"))
        self._put(segment, "cells", cells.coalesce(1))
        ids = rows.select("id")
        if self.live():
            gone = ids if replaces is None else ids.unionByName(replaces.select(F.col(replaces.columns[0]).alias("id")))
            self._put(segment, "replaced", gone.distinct())
        else:
            self._put(segment, "replaced", ids.limit(0))
        self._done(segment)
        return segment

    def _cells(self, vector: Sequence[float]) -> list[tuple[float, float, int, int]]:
        """(similarity of the centre, bound on that of a member, cell, rows) of cells with members, nearest first."""
        centres, _ = self.centres()
        sums = self.table("cells").groupBy("cell").agg(F.sum("n").alias("n"), F.max("width").alias("width")).collect()  # MOST_CELLS rows at most
        if not sums:
            return []
        near = centres @ unit(np.asarray([vector], dtype=np.float64))[0]
        out = []
        for r in sums:
            angle = math.acos(max(-1.0, min(1.0, near[r.cell])))
            out.append((float(near[r.cell]), math.cos(max(0.0, angle - r.width)) + 1e-6, r.cell, r.n))
        return sorted(out, key=lambda x: (-x[0], x[2]))

    def _scored(self, cells: Sequence[int], vector: Sequence[float], least: float, among: DataFrame | None) -> DataFrame:
        rows = self.without_replaced(self.table("vectors").where(F.col("cell").isin(*cells)) if cells else self.table("vectors").where("false"))
        if among is not None:
            rows = rows.join(among.select("id"), "id", "left_semi")
        return rows.select("id", scoring.cosine(F.col("embedding"), scoring.vector_literal(vector)).alias("score")).where(F.col("score") >= least)

    def search(self, vector: Sequence[float], limit: int, least: float = 0.4, probes: int | None = None, exact: bool = False, among: DataFrame | None = None) -> DataFrame:
        """(id, score): the best ``limit`` rows at or above ``least``, best first, ties by id; ``among``: ids that may be found."""
        able = [c for c in self._cells(vector) if c[1] >= least]
        first = able[: probes or self.centres()[1]]
        if len(first) < len(able):
            top = self._scored([c[2] for c in first], vector, least, among).orderBy(F.desc("score"), "id").limit(limit).agg(F.count("*").alias("n"), F.min("score").alias("last")).first()
            if top.n < limit:
                first = able  # too few: whatever can hold one more
            elif exact:
                first += [c for c in able[len(first) :] if c[1] >= top.last]
        self.opened = sum(c[3] for c in first)
        return self._scored([c[2] for c in first], vector, least, among).orderBy(F.desc("score"), "id").limit(limit)


def _usable(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)) & F.exists("embedding", lambda x: x != 0))
