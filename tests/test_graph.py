"""Traversals of many seeds, flows that are kept up to date, names in texts, and limits of the engine's questions."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.indexes.flows import FlowIndex
from lodestone.operators import graph as O
from lodestone.operators import relational as R
from lodestone.operators import skew
from lodestone.plans.api import KnowledgeEngine


def walk(steps, seed, hops, cap=None):
    """Breadth first; with a cap, the first of each level by name."""
    seen, level = {seed: 0}, [seed]
    for depth in range(1, hops + 1):
        level = sorted({b for a in level for b in steps.get(a, ()) if b not in seen})[:cap]
        seen |= dict.fromkeys(level, depth)
    return seen


@pytest.mark.parametrize(("n_seeds", "cap"), [(3, None), (150, None), (150, 4)])
def test_many_seeds_share_a_frontier(spark, n_seeds, cap):
    rng = random.Random(n_seeds)
    edges = [(f"n{rng.randrange(200)}", f"n{rng.randrange(200)}") for _ in range(350)] + [("hub", f"n{i}") for i in range(60)]
    steps = {}
    for a, b in edges:
        steps.setdefault(a, set()).add(b)
    seeds = ["hub", "nowhere"] + [f"n{i}" for i in range(n_seeds - 2)]
    frame = spark.createDataFrame(edges + edges[:9], "src string, dst string")
    got = O.reach(frame, spark.createDataFrame([(s,) for s in seeds + seeds[:2]], "seed string"), 4, cap)
    assert {(r.seed, r.node, r.depth) for r in got.collect()} == {(s, n, d) for s in seeds for n, d in walk(steps, s, 4, cap).items()}
    assert got.count() == got.distinct().count()


def test_a_level_joins_the_steps_once_whatever_the_number_of_seeds(spark, monkeypatch):
    plans = []
    written = O.materialize

    def watch(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df)

    monkeypatch.setattr(O, "materialize", watch)
    frame = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(100)], "src string, dst string")
    for n in (3, 90):
        plans.clear()
        assert O.reach(frame, spark.createDataFrame([(f"n{i}",) for i in range(n)], "seed string"), 3).count() == 4 * n
        levels = plans[2:]  # after the seeds' numbers and the steps
        assert len(levels) == 3 and all(p.count("src#") and p.count("FileScan") - p.count("bits") <= 1 for p in levels)
        assert all(sum("dst" in line for line in p.splitlines() if "FileScan" in line) == 1 for p in levels)


def test_capped_traversals_do_not_spread_a_hub(spark, monkeypatch):
    """Each of many seeds has a hub two steps away: they meet its first nodes, not all; seeds with enough nodes go no further."""
    sizes = []
    written = O.materialize

    def watch(df):
        out = written(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(O, "materialize", watch)
    monkeypatch.setattr(O, "_unpacked", lambda rows, unpacked=O._unpacked: watch(unpacked(rows)))
    pairs = [(f"s{i:03}", f"m{i % 3}") for i in range(200)] + [(f"m{i}", "hub") for i in range(3)] + [("hub", f"x{i:04}") for i in range(2000)]
    pairs += [("full", f"m{i}") for i in range(3)] + [("full", f"y{i}") for i in range(9)]
    edges = spark.createDataFrame(pairs + pairs[::7], "from_entity_id string, to_entity_id string")
    steps = {}
    for a, b in pairs:
        steps.setdefault(a, set()).add(b)
        steps.setdefault(b, set()).add(a)
    seeds = ["full", "nowhere", "hub"] + [f"s{i:03}" for i in range(200)]
    got = O.traverse(edges, spark.createDataFrame([(s,) for s in seeds], "seed string"), 3, 5)
    want = {(s, n, d) for s in seeds for n, d in sorted(walk(steps, s, 3).items(), key=lambda x: (x[1], x[0]))[:5]}
    assert sorted((r.seed, r.node, r.depth) for r in got.collect()) == sorted(want)
    sizes.remove(max(sizes))  # the steps
    assert max(sizes) <= 203 * 5


ENTITIES = [(f"f{i}", "r", f"name{i}", f"pkg::name{i}") for i in range(60)]


def calls(pairs, spark):
    return spark.createDataFrame([(a, b, "calls") for a, b in pairs], "from_entity_id string, to_entity_id string, kind string")


def rows_of(flows):
    return sorted((r.seed, r.label, r.depth, r.n_steps) for r in flows.collect())


def test_refreshed_flows_are_those_of_the_whole_graph(spark, tmp_path):
    rng = random.Random(6)
    entities = spark.createDataFrame(ENTITIES, "id string, repo_id string, name string, qualified_name string")
    old = {(f"f{a}", f"f{b}") for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(90)) if a != b}
    gone, new = set(sorted(old)[::9]), {("f1", "f50"), ("f1", "f51"), ("f30", "f2"), ("f59", "f3"), ("f59", "f4")}
    index = FlowIndex(spark, f"{tmp_path}/f")
    index.build(entities, calls(old, spark))
    assert rows_of(index.flows()) == rows_of(O.flows(entities, calls(old, spark)))
    now = (old - gone) | new
    changed = spark.createDataFrame(sorted({(a,) for a, _ in gone | (new - old)}), "src string")
    walked = index.refresh(entities, calls(now, spark), changed)
    assert rows_of(index.flows()) == rows_of(O.flows(entities, calls(now, spark)))
    assert index.live() == [2]
    # nothing changed: nothing is walked again; a change that no flow meets: the same
    starts = O.entry_points(entities, calls(now, spark)).count()
    assert 0 < walked <= starts and index.refresh(entities, calls(now, spark), changed.limit(0)) == 0
    through = {r.seed for r in index.flows("f2").collect()}
    assert through == {r.seed for r in index.flows().where(F.exists("steps", lambda s: s["node"] == "f2")).collect()} != set()
    plan = index.flows("f2")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(node,f2)" in plan and "PartitionFilters: [isnotnull(bucket" in plan


def test_no_calls_no_flows(spark, tmp_path):
    entities = spark.createDataFrame(ENTITIES, "id string, repo_id string, name string, qualified_name string")
    index = FlowIndex(spark, f"{tmp_path}/f")
    index.build(entities, entities.select(F.col("id").alias("from_entity_id"), F.col("id").alias("to_entity_id"), F.lit("owns").alias("kind")))
    assert index.flows().count() == 0


def test_names_meet_texts_on_their_rarest_run(spark, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY", 20)
    names = ["the", "theatre", "a", "ab", "", "Élan", "the the", "zz%_", "needle42", None]
    texts = ["the theatre of the absurd", "THE", "", None, "élan vital", "a", "zz%_ zz", "hay needle42 hay"] + [f"the row {i}" for i in range(200)]
    e = spark.createDataFrame([(f"e{i}", n) for i, n in enumerate(names)], "id string, name string")
    t = spark.createDataFrame([(f"t{i}", x) for i, x in enumerate(texts)] + [("t1", "THE")], "text_id string, text string")
    want = {(f"t{i}", f"e{k}") for i, x in enumerate(texts) for k, n in enumerate(names) if x and n and n.lower() in x.lower()}
    got = R.mentions_of_names(t, e)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert R.mentions_of_names(t.limit(0), e).count() == R.mentions_of_names(t, e.limit(0)).count() == 0


def test_equal_texts_and_names_that_no_text_can_hold_cost_nothing(spark, monkeypatch):
    sizes = []
    written = R.materialize

    def watch(df):
        out = written(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(R, "materialize", watch)
    e = spark.createDataFrame([("e", "Supplier7")] + [(f"e{i}", f"Supplier{i}") for i in range(1000, 2000)], "id string, name string")
    t = spark.createDataFrame([(f"t{i}", f"about supplier{i % 5 + 5}") for i in range(3000)], "text_id string, text string")
    got = R.mentions_of_names(t, e)
    assert {tuple(r) for r in got.collect()} == {(f"t{i}", "e") for i in range(2, 3000, 5)} and got.count() == 600
    assert max(sizes) < 1500  # runs of names; not texts, nor their runs


def test_too_many_files_are_an_error(spark):
    known = KnowledgeEngine({})
    for paths in ([], [f"{i}.go" for i in range(21)]):
        with pytest.raises(ValueError, match="files"):
            known.task_context("r", paths)




def test_backfill_goes_on_while_a_round_makes_something(spark):
    from lodestone.plans.extraction import backfill

    entities = [("m", "r", "p::A.B.C.run"), ("n", "r", "p::A.B.stop"), ("k", "r", "p::K"), ("s", "r", "p::K.go"), ("x", "q", "p::K.go")]
    e = spark.createDataFrame(entities, "id string, repo_id string, qualified_name string")
    edges = spark.createDataFrame([("none", "none")], "from_entity_id string, to_entity_id string")
    refs = [("r", "p::K", "p::A.B"), ("r", "src::p::K", "p::A"), ("r", "p::K", "p::A::B.C"), ("r", "p::K", "p::K"), ("r", "p::K", "gone"), ("q", "p::K.go", "p::K")]
    made, found = backfill(e, edges, spark.createDataFrame([(*r, "calls", "weak") for r in refs], "repo_id string, from_name string, to_name string, kind string, strength string"))
    assert {(r.id, r.kind, r["name"], r["round"]) for r in made.collect()} == {
        ("own:r:p::A.B.C", "type", "C", 1), ("own:r:p::A.B", "type", "B", 1), ("own:q:p::K", "type", "K", 1), ("own:r:p::A", "type", "A", 2)}
    assert {(r.from_entity_id, r.to_entity_id, r.kind, r["round"]) for r in found.collect()} == {
        ("k", "s", "owns", 1), ("own:r:p::A.B.C", "m", "owns", 2), ("own:r:p::A.B", "n", "owns", 2), ("own:r:p::A.B", "own:r:p::A.B.C", "owns", 2), ("own:q:p::K", "x", "owns", 2), ("own:r:p::A", "own:r:p::A.B", "owns", 3),
        ("k", "own:r:p::A.B", "calls", 2), ("k", "own:r:p::A", "calls", 3), ("k", "own:r:p::A.B.C", "calls", 2), ("x", "own:q:p::K", "calls", 2)}
    nothing, no_edges = backfill(e.limit(0), edges, spark.createDataFrame([], "repo_id string, from_name string, to_name string, kind string, strength string"))
    assert nothing.count() == no_edges.count() == 0
