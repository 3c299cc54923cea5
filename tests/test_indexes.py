"""Stored indexes against scans of the same rows."""

import glob
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.functions import scoring, text
from lodestone.indexes.names import NameIndex
from lodestone.indexes.texts import TextIndex
from lodestone.indexes.vectors import VectorIndex
from lodestone.plans import search as S

WORDS = "store stores stored index indexing query queries the of token cache caches caching box boxes class parse parsed graph node edge".split()
QUERIES = ["store", "store query", '"store index"', "store or graph", "cache -node", '"parse graph" or "token cache"', "-store", "-store -node", "the", "", "absent", "store stores", '"store query" -"node edge"', "boxes class"]


def texts(n, seed=0):
    rng = random.Random(seed)
    return [(f"f{i}", " ".join(rng.choices(WORDS, k=rng.choice([0, 1, 3, 8, 40])))) for i in range(n)] + [("null", None)]


def found(df):
    return [(r.id, round(r.score, 6)) for r in df.collect()]


def scan(rows, query, limit, frequency=False):
    return found(S.text_top(rows, query, limit, frequency=frequency))


def test_text_index_equals_the_scan(spark, tmp_path):
    rows = spark.createDataFrame(texts(400), "id string, claim string")
    index = TextIndex(spark, f"{tmp_path}/i")
    index.write(rows)
    for query in QUERIES:
        for frequency in (False, True):
            assert found(index.search(query, 30, frequency)) == scan(rows, query, 30, frequency), query
    some = rows.where("id < 'f2'")
    assert found(index.search("store query", 30, among=some)) == scan(some, "store query", 30)
    n = {r.stem: r.n for r in index.frequencies(["stores", "graph", "absent"]).collect()}
    assert n == {s: rows.where(F.array_contains(text.lexemes(F.col("claim")), s)).count() for s in ("store", "graph")}


def test_text_index_takes_updates_and_merges(spark, tmp_path, monkeypatch):
    import lodestone.indexes.texts as module

    monkeypatch.setattr(module, "TEXTS_A_BLOCK", 37)
    first, changed = texts(300), [(f"f{i}", "graph store " * (i % 4)) for i in range(0, 300, 7)] + [("new", "store graph store")]
    index = TextIndex(spark, f"{tmp_path}/i")
    index.write(spark.createDataFrame(first, "id string, claim string"))
    index.write(spark.createDataFrame(changed, "id string, claim string"), replaces=spark.createDataFrame([("f1",), ("f2",)], "id string"))
    index.write(spark.createDataFrame([("f7", "token")], "id string, claim string"))
    now = {k: v for k, v in {**dict(first), **dict(changed), "f7": "token"}.items() if k not in ("f1", "f2")}
    rows = spark.createDataFrame(sorted(now.items()), "id string, claim string")
    for _ in range(2):
        for query in QUERIES[:8]:
            assert found(index.search(query, 40)) == scan(rows, query, 40), query
        index.merge()
    assert index.live() == [4] and index.frequencies(["token"]).first().n == rows.where(F.array_contains(text.lexemes(F.col("claim")), "token")).count()
    empty = TextIndex(spark, f"{tmp_path}/e")
    assert found(empty.search("store", 5)) == []
    empty.write(rows.where("false"))
    assert found(empty.search("store", 5)) == [] and found(empty.search("-store", 5)) == []


def test_a_search_opens_the_folders_of_its_own_words_and_no_text(spark, tmp_path, monkeypatch):
    import lodestone.indexes.texts as module

    monkeypatch.setattr(module, "TEXTS_A_BLOCK", 50)
    index = TextIndex(spark, f"{tmp_path}/i")
    index.write(spark.createDataFrame(texts(500), "id string, claim string"))
    plan = index.search("store query", 5)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) == 1 and "PartitionFilters: [bucket" in scans[0] and "In(stem, [query,store])" in scans[0].replace("StringIn", "In") and "claim" not in plan
    hot = index.table("postings").where("stem = 'store'")
    assert hot.count() > 5 and hot.agg(F.max(F.size("ids"))).first()[0] < 100  # a common word's list is in blocks
    files = glob.glob(f"{tmp_path}/i/postings/segment=1/bucket=*/*.parquet")
    encodings = {e for f in files for g in [pq.ParquetFile(f).metadata.row_group(0)] for c in range(g.num_columns) for e in g.column(c).encodings if g.column(c).path_in_schema.startswith(("ids", "places"))}
    assert {"DELTA_BYTE_ARRAY", "DELTA_BINARY_PACKED"} <= encodings


def test_claims_of_segments_are_exclusive(spark, tmp_path):
    from lodestone.session import claim, names_in

    assert claim(spark, f"{tmp_path}/c/1") and not claim(spark, f"{tmp_path}/c/1") and claim(spark, f"{tmp_path}/c/2")
    assert sorted(n for n in names_in(spark, f"{tmp_path}/c")) == ["1", "2"] and names_in(spark, f"{tmp_path}/none") == []
    a, b = TextIndex(spark, f"{tmp_path}/i"), TextIndex(spark, f"{tmp_path}/i")
    assert {a._new(), b._new(), a._new()} == {1, 2, 3}
    a.write(spark.createDataFrame([("x", "store")], "id string, claim string"))
    assert a.live() == [4]  # numbers that were claimed and never finished are no segments


@pytest.mark.parametrize("least", [0.3, 0.4, 0.95])
def test_name_index_equals_the_scan(spark, tmp_path, least):
    rng = random.Random(1)
    rows = [(f"e{i}", "r" + str(i % 3), rng.choice(["handle", "Store", "parse", "new"]) + rng.choice(["User", "_order", "-Item", " cart", ""]) + str(rng.randrange(60))) for i in range(800)] + [("x", "r0", ""), ("y", "r0", "é"), ("z", "r1", "handleUser7" * 40)]
    entities = spark.createDataFrame(rows, "id string, repo_id string, name string")
    index = NameIndex(spark, f"{tmp_path}/n")
    index.write(entities.where("id < 'e5'"))
    index.write(entities.where("id >= 'e5' or id = 'e11'"))
    wanted = ["handleUser7", "store_item4", "STORE ORDER 11", "a", "zzzzzz", "handleUser7"]
    own = entities.select("id", scoring.trigrams(F.translate("name", "ABCDEFGHIJKLMNOPQRSTUVWXYZ_- ", "abcdefghijklmnopqrstuvwxyz")).alias("b"))
    asked = spark.createDataFrame([(w,) for w in dict.fromkeys(wanted)], "token string").withColumn("a", scoring.trigrams(F.translate("token", "ABCDEFGHIJKLMNOPQRSTUVWXYZ_- ", "abcdefghijklmnopqrstuvwxyz")))
    want = {(r.token, r.id, round(r.s, 9)) for r in own.crossJoin(F.broadcast(asked)).withColumn("s", scoring.trigram_similarity(F.col("a"), F.col("b"))).where(F.col("s") >= least).collect()}
    for _ in range(2):
        assert {(r.token, r.id, round(r.similarity, 9)) for r in index.similar(wanted, least).collect()} == want
        index.merge()
    assert want and len({i for _, i, _ in want}) / len(rows) < {0.3: 0.9, 0.4: 0.6, 0.95: 0.02}[least]  # the share of names that a search fetches
    plan = index.similar(wanted[:1], least)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "GreaterThanOrEqual(" in plan and "name" not in plan.split("ReadSchema")[1]
    via = S.fuzzy_names(entities, wanted, least, 3, index)
    assert sorted(map(tuple, via.collect())) == sorted(map(tuple, S.fuzzy_names(entities, wanted, least, 3).collect()))


def share_and_recall(spark, index, rows, vectors, queries, k=20):
    shares, hits = [], []
    for q in queries:
        got = index.search(vectors[q].tolist(), k, -1.0).collect()
        near = vectors @ vectors[q] / np.linalg.norm(vectors, axis=1) / np.linalg.norm(vectors[q])
        best = {f"v{i}" for i in sorted(range(len(near)), key=lambda i: (-round(near[i], 9), f"v{i}"))[:k]}
        hits.append(len(best & {r.id for r in got}) / k)
        shares.append(index.opened / len(vectors))
    return float(np.mean(shares)), float(np.mean(hits))


def test_vector_index_reads_few_rows_of_clustered_vectors(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 32))
    vectors = np.array([c + 0.3 * rng.normal(size=32) for c in centres for _ in range(80)])
    rows = spark.createDataFrame([(f"v{i}", v.tolist()) for i, v in enumerate(vectors)], "id string, embedding array<double>")
    odd = spark.createDataFrame([("n", None), ("z", [0.0] * 32), ("e", []), ("nan", [float("nan")] * 32), ("short", [1.0])], "id string, embedding array<double>")
    index = VectorIndex(spark, f"{tmp_path}/v")
    index.fit(rows.unionByName(odd))
    index.write(rows.unionByName(odd))
    share, recall = share_and_recall(spark, index, rows, vectors, range(0, 3200, 400))
    assert recall >= 0.9 and share <= 0.35, (share, recall)
    q = vectors[5].tolist()
    exact = found(S.vector_top(rows, q, 25, 0.2))
    assert found(index.search(q, 25, 0.2, exact=True)) == exact
    # short answers are exact: fewer than asked for are above the threshold
    assert found(index.search(q, 500, 0.6, probes=1)) == found(S.vector_top(rows, q, 500, 0.6))
    assert index.opened < 3200
    plan = index.search(q, 5, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    # an update replaces rows, whatever cell they were in
    moved = spark.createDataFrame([("v5", (-vectors[5]).tolist()), ("w", vectors[5].tolist())], "id string, embedding array<double>")
    index.write(moved)
    assert index.search(q, 1, 0.4).first().id == "w"
    assert found(index.search(q, 25, 0.2, exact=True)) == found(S.vector_top(rows.where("id <> 'v5'").unionByName(moved), q, 25, 0.2))


def test_vector_index_on_the_test_vectors(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"), "embedding", "vec_id").orderBy("vec_id")
    vectors = np.array([r.embedding for r in table.collect()], dtype=np.float64)
    index = VectorIndex(spark, f"{tmp_path}/v")
    index.fit(table)
    index.write(table)
    share, recall = share_and_recall(spark, index, table, vectors, range(0, len(vectors), len(vectors) // 8))
    assert recall >= 0.9 and share < 1, (share, recall)
