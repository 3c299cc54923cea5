"""Communities by joins against a plain sequential version, and clusters as they are stored."""

import random

from pyspark.sql import functions as F

from lodestone.operators import communities as C
from lodestone.operators import graph as O
from lodestone.sources.graph import TestGraph


def sequential(pairs: list[tuple[str, str, float]], max_passes: int = 10, min_gain: float = 1e-6) -> dict[str, str]:
    """Communities of one graph, named by their least node.  Nodes move in order of name; ties go to the least community."""
    nodes = sorted({n for a, b, _ in pairs for n in (a, b)})
    member = {n: n for n in nodes}
    near: dict[str, dict[str, float]] = {n: {} for n in nodes}
    for a, b, w in pairs:
        near[a][b] = near[a].get(b, 0.0) + w
        if a != b:
            near[b][a] = near[b].get(a, 0.0) + w
    m2 = sum(w for x in near.values() for w in x.values()) + sum(x.get(n, 0.0) for n, x in near.items())
    for _ in range(max_passes):
        degree = {n: sum(x.values()) + x.get(n, 0.0) for n, x in near.items()}  # a loop counts twice
        home, total = {n: n for n in near}, dict(degree)
        moved_any, gained = False, True
        while gained:
            gained = False
            for n in sorted(near):
                total[home[n]] -= degree[n]
                to: dict[str, float] = {home[n]: 0.0}
                for other, w in near[n].items():
                    if other != n:
                        to[home[other]] = to.get(home[other], 0.0) + w
                gain = {c: 2 * w / m2 - 2 * degree[n] * total[c] / m2**2 for c, w in to.items()}
                best = min(gain, key=lambda c: (-round(gain[c], 12), c))
                if gain[best] - gain[home[n]] > min_gain:
                    home[n], gained, moved_any = best, True, True
                total[home[n]] += degree[n]
        if not moved_any:
            break
        least: dict[str, str] = {}
        for n in sorted(near):
            least.setdefault(home[n], n)
        member = {n: least[home[c]] for n, c in member.items()}
        merged: dict[str, dict[str, float]] = {c: {} for c in least.values()}
        for a, x in near.items():
            for b, w in x.items():
                if a <= b:
                    ca, cb = sorted((least[home[a]], least[home[b]]))
                    merged[ca][cb] = merged[ca].get(cb, 0.0) + w
                    if ca != cb:
                        merged[cb][ca] = merged[ca][cb]
        near = merged
    names_: dict[str, str] = {}
    for n in nodes:
        names_.setdefault(member[n], n)
    return {n: names_[c] for n, c in member.items()}


def planted(rng, groups, size, inner, outer):
    """Nodes in groups with many edges within and few between them."""
    nodes = [(g, f"g{g}n{i:02d}") for g in range(groups) for i in range(size)]
    return {(a, b): 1.0 for i, (g, a) in enumerate(nodes) for h, b in nodes[i + 1 :] if rng.random() < (inner if g == h else outer)}


def ring(cliques, size):
    out = {}
    for c in range(cliques):
        out |= {(f"c{c:02d}.{i}", f"c{c:02d}.{j}"): 2.0 for i in range(size) for j in range(i)}
        out[tuple(sorted((f"c{c:02d}.0", f"c{(c + 1) % cliques:02d}.1")))] = 1.0
    return out


def quality(pairs, member):
    m2 = 2 * sum(pairs.values())
    inside, total = {}, {}
    for (a, b), w in pairs.items():
        total[member[a]] = total.get(member[a], 0) + w
        total[member[b]] = total.get(member[b], 0) + w
        if member[a] == member[b]:
            inside[member[a]] = inside.get(member[a], 0) + 2 * w
    return sum(inside.get(c, 0) / m2 - (t / m2) ** 2 for c, t in total.items())


def test_modularity_is_within_two_percent_of_the_sequential_version(spark):
    edges = TestGraph(spark, "/root/testdata/sf0.001").relationships.where("repo_id = 'r1'")
    stored = {(r.a, r.b): r.weight for r in O.weighted(edges).collect()}
    graphs = {"planted": planted(random.Random(4), 6, 20, 0.35, 0.02), "ring": ring(12, 5), "stored": stored}
    rows = [(name, a, b, w) for name, pairs in graphs.items() for (a, b), w in pairs.items()]
    found = C.communities(spark.createDataFrame(rows, "repo_id string, a string, b string, weight double")).collect()
    for name, pairs in graphs.items():
        member = {r.node: r.community for r in found if r.repo_id == name}
        assert member.keys() == {n for p in pairs for n in p}
        assert all(member[c] == c and c == min(n for n, x in member.items() if x == c) for c in set(member.values()))
        plain = sequential([(a, b, w) for (a, b), w in pairs.items()])
        assert quality(pairs, member) >= 0.98 * quality(pairs, plain), name


def test_a_hub_with_a_third_of_the_edges_is_dealt_out(spark):
    rng = random.Random(5)
    pairs = planted(rng, 4, 15, 0.4, 0.01)
    pairs |= {tuple(sorted(("hub", n))): 0.5 for n in sorted({n for p in pairs for n in p})}
    frame = spark.createDataFrame([("r", a, b, w) for (a, b), w in pairs.items()], "repo_id string, a string, b string, weight double")
    plain = {(r.node, r.community) for r in C.communities(frame, 2, 2).collect()}
    assert {(r.node, r.community) for r in C.communities(frame, 2, 2, heavy=10).collect()} == plain
    heavy = C.heavy_keys(frame.withColumn("node", F.lit("x")), ["repo_id"], 10)
    assert heavy.first()["_parts"] == -(-len(pairs) // 10) and C.heavy_keys(frame, ["repo_id"], 10, 9) is None


def test_no_pairs_and_loops(spark):
    schema = "repo_id string, a string, b string, weight double"
    assert C.communities(spark.createDataFrame([], schema), 2, 2).count() == 0
    got = C.communities(spark.createDataFrame([("r", "a", "a", 1.0), ("r", "a", "b", 1.0), ("s", "z", "z", 2.0)], schema), 2, 2)
    assert {tuple(r) for r in got.collect()} <= {("r", "a", "a"), ("r", "b", "a"), ("r", "b", "b"), ("s", "z", "z")}


def test_clusters_of_one_label_are_one_and_path_less_modules_are_left_out(spark):
    names = {"a": "parseUser", "b": "parse_user", "c": "User-parse"}
    entities, edges = [], []
    for g in range(2):  # two triangles with the same words, not connected
        for k, name in names.items():
            entities.append((f"{k}{g}", "r", "function", name, "x.go"))
        edges += [("r", f"a{g}", f"b{g}", "calls"), ("r", f"b{g}", f"c{g}", "calls"), ("r", f"c{g}", f"a{g}", "calls")]
    entities += [("dep", "r", "module", "dep", None), ("old", "r", "cluster", "old", None), ("two", "r", "type", "two", "y.go")]
    edges += [("r", "a0", "dep", "imports"), ("r", "a1", "dep", "imports"), ("r", "a0", "old", "calls"), ("r", "two", "two", "calls")]
    e = spark.createDataFrame(entities, "id string, repo_id string, kind string, name string, path string")
    r = spark.createDataFrame(edges, "repo_id string, from_entity_id string, to_entity_id string, kind string")
    clusters, links = C.clusters(e, r)
    (one,) = clusters.collect()
    assert (one["name"], one.members, one.capabilities, one.cohesion) == ("parse-user", 6, ["parse"], 1.0)
    assert one.summary == "Cluster related to parse, user (cohesion=1.00)" and one.qualified_name == "cluster::parse-user"
    assert sorted(x.from_entity_id for x in links.collect()) == ["a0", "a1", "b0", "b1", "c0", "c1"]
    none, no_links = C.clusters(e.limit(0), r.limit(0))
    assert none.count() == no_links.count() == 0
