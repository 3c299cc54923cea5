"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import neighbours


def brute(ids, vectors, k):
    out = {}
    for q, i in enumerate(ids):
        if i % 20 == 0:
            score = (vectors * vectors[q]).sum(axis=1)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(score[j])) for j in order]
    return out


@pytest.mark.parametrize("scale", [False, True])
def test_recall_and_scores(spark, monkeypatch, scale):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    if scale:
        frame = frame.withColumn("embedding", F.transform("embedding", lambda x: x * (F.col("vec_id") % 7 + 1)))
        monkeypatch.setattr(neighbours, "BLOCK", 300)
    rows = frame.orderBy("vec_id").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    want = brute(ids, vectors, 20)
    got = {}
    for r in neighbours.nearest(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert got.keys() == want.keys()
    exact = {i: dict(zip(ids.tolist(), (vectors * vectors[at]).sum(axis=1).tolist())) for at, i in enumerate(ids) if i % 20 == 0}
    for q, hits in got.items():
        assert all(abs(s - exact[q][v]) < 1e-12 for v, s in hits)
        assert hits == sorted(hits, key=lambda x: (-x[1], x[0]))
    recall = np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9, recall


def test_unusable_vectors_ties_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 0.0]), (7, [None, 1.0]), (8, [1.0]), (20, [0.5, 0.5]), (40, None), (None, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit(1)).withColumn("asked", F.lit(1))
    out = neighbours.nearest(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in out] == [(0, 1), (0, 2), (0, 20), (20, 0), (20, 1), (20, 2)]
    assert neighbours.nearest(frame.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_every_query_gets_all_it_can(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(2000, 16))
    vectors[7] *= 1000  # puts all others at one pole of the sphere
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(7, vectors[7].tolist())] * 30  # repeats of a row take no places
    for kept, k in ((rows, 20), (rows[:15], 20), (rows[:3], 20)):
        frame = spark.createDataFrame(kept, "vec_id long, embedding array<double>")
        ids = len({i for i, _ in kept})
        out = {r.query_id: r.n for r in neighbours.nearest(frame, F.col("vec_id") % 2 == 0, k).groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).collect()}
        assert out == {i: min(k, ids - 1) for i in range(0, ids, 2)}


def test_lengths_are_apart_and_repeated_ids_count_once(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4 if i % 3 else 6).tolist()) for i in range(60)] + [(0, [1.0] * 6), (0, [1.0] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = neighbours.nearest(frame, F.col("vec_id") % 20 == 0, 5).collect()
    by_length = {n: [(i, np.array(v)) for i, v in rows if len(v) == n] for n in (4, 6)}
    for q in (0, 20, 40):
        own = [(i, v) for i, v in rows if i == q]
        want = sorted({(-float((np.array(x) * v).sum()), i) for _, x in own for i, v in by_length[len(x)] if i != q})[:5]
        got = sorted([(-r.score, r.vec_id) for r in out if r.query_id == q])
        assert [i for _, i in got] == [i for _, i in want] and np.allclose([s for s, _ in got], [s for s, _ in want])


def test_a_vector_of_a_third_of_the_rows_and_a_crowded_cell(spark, monkeypatch):
    rng = np.random.default_rng(6)
    near = rng.normal(size=16) + 1e-3 * rng.normal(size=(400, 16))  # one cell
    vectors = [*rng.normal(size=(400, 16)), *near, *[np.ones(16)] * 400]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    got = {}
    for r in neighbours.nearest(frame, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(np.arange(1200), np.array(vectors), 20)
    assert all(len(got[q]) == 20 for q in want)
    assert np.mean([len(got[q] & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    assert all(got[q] == {i for i, _ in want[q]} for q in range(800, 1200, 20))


def share_met(vectors, k=20):
    """Recall, and the share of rows that the queries meet."""
    vectors = np.asarray(vectors, dtype=np.float64)
    largest = np.linalg.norm(vectors, axis=1).max()
    rng = np.random.default_rng(0)
    sample = vectors[np.sort(rng.choice(len(vectors), min(len(vectors), neighbours.SAMPLE), replace=False))]
    count = neighbours.probes_needed(sample, largest, len(vectors), k)
    queries = np.arange(0, len(vectors), max(20, len(vectors) // 100))
    seen = neighbours.met(neighbours.Hashes(vectors.shape[1]), vectors, vectors[queries], largest, count)
    scores = vectors[queries] @ vectors.T
    scores[np.arange(len(queries)), queries] = -np.inf
    top = np.argsort(-scores, axis=1)[:, :k]
    return np.take_along_axis(seen, top, axis=1).mean(), seen.mean()


def test_share_of_rows_met(spark):
    """The index meets few rows where there is structure, and on nearly orthogonal vectors more, but not all."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(60, 64))
    clustered = [c / np.linalg.norm(c) + 0.04 * rng.normal(size=64) for c in centres for _ in range(100)]
    recall, share = share_met(clustered)
    assert recall >= 0.9 and share <= 0.15, (recall, share)
    found = {}
    for sf in ("sf0.01", "sf0.1"):
        rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("embedding").collect()
        found[sf] = recall, share = share_met([r.embedding for r in rows])
        assert recall >= 0.9 and share <= 0.9, found
    print(found)
