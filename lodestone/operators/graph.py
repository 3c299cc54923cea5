"""Graph operators: traversals, paths, flows, weights, communities."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import names, scoring
from lodestone.operators.relational import edges_between
from lodestone.session import materialize

MAX_HOPS = 5


def all_edges(relationships: DataFrame, cross_repo: DataFrame | None = None) -> DataFrame:
    """Edges within repositories, with those between repositories if given, under one schema."""
    if cross_repo is None:
        return relationships
    other = cross_repo.withColumnRenamed("from_repo_id", "repo_id").drop("to_repo_id")
    return relationships.unionByName(other)


def filter_edges(edges: DataFrame, kinds: Sequence[str] = (), min_confidence: float = 0.0) -> DataFrame:
    edges = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    return edges.where(F.col("confidence") >= min_confidence) if min_confidence > 0 else edges


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst) of each edge in either direction, parallel edges included: whoever joins them drops repeats afterwards."""
    there = edges.select(F.col("from_entity_id").alias("src"), F.col("to_entity_id").alias("dst"))
    return there.unionByName(there.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


#: Seeds whose marks share a row.
BITS = 62


def reach(steps: DataFrame, seeds: DataFrame, hops: int, cap: int | None = None, enough: int | None = None) -> DataFrame:
    """(seed, node, depth): nodes within ``hops`` steps of each seed, with the least depth.

    One frontier serves all seeds: a row holds a node and, as bits, up to BITS of the seeds that have just come to it.  A level
    joins the frontier with the steps once, whatever the number of seeds, or-s the bits by node and takes off those seen before.
    Steps are written once, the frontier after each level; an empty one ends the walk.  With ``cap``, a level keeps the first
    ``cap`` nodes of a seed by id: if it has more, what lies beyond is not among the nearest ``cap`` at any depth.  With
    ``enough``, too, a seed that has so many nodes goes no further.
    """
    if cap is not None:
        return _reach_capped(steps, seeds, hops, cap, enough)
    own = seeds.select("seed").distinct()
    nth = F.row_number().over(Window.orderBy("seed")) - 1  # over a query's own seeds
    numbered = materialize(own.select("seed", F.floor(nth / BITS).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (nth % BITS).cast("int")).alias("bits")))
    frontier = numbered.groupBy(F.col("seed").alias("node"), "word").agg(F.bit_or("bits").alias("bits"))
    levels = [frontier.withColumn("depth", F.lit(0))]
    steps = materialize(steps.select("src", "dst").distinct()) if hops > 1 else steps
    for depth in range(1, hops + 1):
        ahead = frontier.join(steps, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node"), "word").agg(F.bit_or("bits").alias("bits"))
        seen = functools.reduce(DataFrame.unionByName, [x.drop("depth") for x in levels]).groupBy("node", "word").agg(F.bit_or("bits").alias("_seen"))
        fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_seen", F.lit(0).cast("long"))))
        frontier = ahead.join(seen, ["node", "word"], "left").select("node", "word", fresh.alias("bits")).where("bits <> 0")
        frontier = materialize(frontier)
        if frontier.isEmpty():
            break
        levels.append(frontier.withColumn("depth", F.lit(depth)))
    return _unpacked(functools.reduce(DataFrame.unionByName, levels)).join(F.broadcast(numbered), ["word", "bits"]).select("seed", "node", "depth")


def _reach_capped(steps: DataFrame, seeds: DataFrame, hops: int, cap: int, enough: int | None) -> DataFrame:
    """reach() where a level keeps ``cap`` nodes a seed, so that a row is a seed and a node.

    The first ``cap`` new nodes by id of a seed are among the first ``cap`` + s of each node they are reached from, s being the
    nodes that the seed has seen: of a node with more neighbours than that, the others are never looked at.
    """
    frontier = materialize(seeds.select("seed").distinct().select("seed", F.col("seed").alias("node")))
    levels = [frontier.withColumn("depth", F.lit(0))]
    steps = materialize(steps.select("src", "dst")) if hops > 1 else steps.select("src", "dst")
    for depth in range(1, hops + 1):
        seen = functools.reduce(DataFrame.unionByName, levels).select("seed", "node")
        if enough is not None and depth > 1:
            frontier = frontier.join(seen.groupBy("seed").agg(F.count("*").alias("_n")).where(F.col("_n") < enough), "seed", "left_semi")
        most = 1 + cap * (depth - 1)
        most = cap + (most if enough is None else max(1, min(most, enough - 1)))
        near = steps.join(frontier.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
        near = _nearest(near, "src", "dst", most)
        ahead = _nearest(frontier.join(near, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")), "seed", "node", most)
        fresh = ahead.join(seen, ["seed", "node"], "left_anti")
        frontier = materialize(_nearest(fresh, "seed", "node", cap))
        if frontier.isEmpty():
            break
        levels.append(frontier.withColumn("depth", F.lit(depth)))
    return functools.reduce(DataFrame.unionByName, levels)


def _nearest(rows: DataFrame, of: str, node: str, most: int) -> DataFrame:
    """The first ``most`` different nodes of each, repeats dropped.  The rank counts repeats once, so tasks cut their own rows before the shuffle."""
    rank = F.dense_rank().over(Window.partitionBy(of).orderBy(node))
    return rows.withColumn("_n", rank).where(F.col("_n") <= most).select(of, node).distinct()


def _unpacked(rows: DataFrame) -> DataFrame:
    """A row for each bit."""
    ones = F.filter(F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.col("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i))), lambda b: b != 0)
    return rows.withColumn("bits", F.explode(ones))


def traverse(edges: DataFrame, seeds: DataFrame, hops: int = 3, cap: int | None = 200) -> DataFrame:
    """reach() in both directions, nearest first, at most ``cap`` nodes a seed (ties by id; the seed is never cut)."""
    found = reach(both_ways(edges), seeds, min(hops, MAX_HOPS), cap=cap, enough=cap)
    if cap is None:
        return found
    rank = F.row_number().over(Window.partitionBy("seed").orderBy("depth", "node"))
    return found.withColumn("_n", rank).where(F.col("_n") <= cap).drop("_n")


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges_between(edges, nodes.select("node").distinct())


def strongest_neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node, strength): one hop either way, with the strongest edge to each neighbour."""
    both = edges.select(F.col("from_entity_id").alias("seed"), F.col("to_entity_id").alias("node"), "strength").unionByName(
        edges.select(F.col("to_entity_id").alias("seed"), F.col("from_entity_id").alias("node"), "strength")
    )
    rank = scoring.by_value(F.col("strength"), {"strong": 3.0, "moderate": 2.0, "weak": 1.0}, 0.0)
    own = both.join(seeds.select("seed").distinct(), "seed", "left_semi").where("seed <> node")
    return own.groupBy("seed", "node").agg(F.max_by("strength", rank).alias("strength"))


def paths(edges: DataFrame, seed: str, hops: int) -> DataFrame:
    """(node, depth, path): one shortest path to each node more than one step away, over an undirected graph.

    Among parents at the depth before, the least path wins, so the answer does not depend on row order.
    """
    steps = both_ways(edges)
    level = edges.sparkSession.range(1).select(F.lit(seed).alias("node"), F.array(F.lit(seed)).alias("path"))
    seen = level.select("node")
    found: DataFrame | None = None
    for depth in range(1, hops + 1):
        ahead = level.join(steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        level = materialize(ahead.join(seen, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")))
        seen = seen.unionByName(level.select("node"))
        if depth > 1:
            own = level.select("node", F.lit(depth).alias("depth"), "path")
            found = own if found is None else found.unionByName(own)
    return found if found is not None else level.select("node", F.lit(0).alias("depth"), "path").limit(0)


def degrees(edges: DataFrame, kind: str = "calls") -> DataFrame:
    calls = edges.where(F.col("kind") == kind)
    out = calls.groupBy(F.col("from_entity_id").alias("id")).agg(F.count("*").alias("out_degree"))
    into = calls.groupBy(F.col("to_entity_id").alias("id")).agg(F.count("*").alias("in_degree"))
    return out.join(into, "id", "left").fillna(0, ["in_degree"])


def entry_points(entities: DataFrame, edges: DataFrame, min_out: int = 2, max_in: int = 2, limit: int = 400) -> DataFrame:
    found = degrees(edges).where((F.col("out_degree") >= min_out) & (F.col("in_degree") <= max_in))
    joined = found.join(entities.select("id", "repo_id", "name", "qualified_name"), "id")
    return joined.orderBy((F.col("out_degree") - F.col("in_degree")).desc(), "id").limit(limit)


def call_steps(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("kind") == "calls").select(F.col("from_entity_id").alias("src"), F.col("to_entity_id").alias("dst")).distinct()


def flows_of(walks: DataFrame, starts: DataFrame, entities: DataFrame, shown: int = 8, limit: int = 200) -> DataFrame:
    """Flows from what each entry point reaches: steps by depth, name and id; a label of the first names; one flow a label."""
    named = walks.join(entities.select(F.col("id").alias("node"), "name"), "node")
    steps = named.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("depth", "name", "node"))).alias("steps"))  # a flow's own nodes
    texts = F.transform(F.slice("steps", 1, shown), lambda s: s["name"])
    label = F.concat(F.array_join(texts, " → "), F.when(F.size("steps") > shown, " → …").otherwise(""))
    built = steps.select("seed", label.alias("label"), F.array_max(F.transform("steps", lambda s: s["depth"])).alias("depth"), F.size("steps").alias("n_steps"), "steps").where("depth >= 2")
    place = F.col("out_degree") - F.col("in_degree")
    ranked = built.join(starts.select(F.col("id").alias("seed"), place.alias("place")), "seed")
    first = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("place"), "seed"))
    return ranked.withColumn("_n", first).where("_n = 1").orderBy(F.desc("place"), "seed").limit(limit).drop("_n", "place")


def flows(entities: DataFrame, edges: DataFrame, depth: int = 10, shown: int = 8, limit: int = 200, entries: DataFrame | None = None) -> DataFrame:
    """Call flows from each entry point."""
    starts = materialize(entries if entries is not None else entry_points(entities, edges))
    return flows_of(reach(call_steps(edges), starts.select(F.col("id").alias("seed")), depth), starts, entities, shown, limit)


def weighted(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(a, b, weight), a < b: the weights of the kinds that count, added up over parallel edges; no loops."""
    w = scoring.by_value(F.col("kind"), scoring.GRAPH_WEIGHT, 0.0)
    pairs = edges.select(F.least("from_entity_id", "to_entity_id").alias("a"), F.greatest("from_entity_id", "to_entity_id").alias("b"), w.alias("w")).where("a <> b and w > 0")
    if nodes is not None:
        own = nodes.select(F.col("id").alias("_id"))
        pairs = pairs.join(own, F.col("a") == F.col("_id"), "left_semi").join(own, F.col("b") == F.col("_id"), "left_semi")
    return pairs.groupBy("a", "b").agg(F.sum("w").alias("weight"))


def modularity(pairs: DataFrame, communities: DataFrame) -> DataFrame:
    """One row: the modularity over all pairs (q), and over adjacent pairs only (q_adjacent).  ``communities``: node, community."""
    both = pairs.select("a", "b", "weight").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    k = both.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("k"))
    total = both.agg(F.sum("weight").alias("m2"))
    ends = k.join(communities, "node")
    x, y = ends.select(F.col("node").alias("a"), F.col("k").alias("ka"), F.col("community").alias("ca")), ends.select(F.col("node").alias("b"), F.col("k").alias("kb"), F.col("community").alias("cb"))
    inner = both.join(x, "a").join(y, "b").where("ca = cb").crossJoin(F.broadcast(total))  # total is one row
    adjacent = inner.agg(F.coalesce(F.sum((F.col("weight") - F.col("ka") * F.col("kb") / F.col("m2")) / F.col("m2")), F.lit(0.0)).alias("q_adjacent"))
    per = ends.groupBy("community").agg(F.sum("k").alias("tot")).join(inner.groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("inside")), "community", "left")
    q = per.crossJoin(F.broadcast(total)).agg(F.coalesce(F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("m2") - F.pow(F.col("tot") / F.col("m2"), 2)), F.lit(0.0)).alias("q"))
    return q.crossJoin(F.broadcast(adjacent))


def label_propagation(pairs: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, community), a cheaper way than ``communities``: each node takes its neighbours' heaviest label, ties the least."""
    both = materialize(pairs.select("a", "b", "weight").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")))
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy("a", "community").agg(F.sum("weight").alias("w"))
        best = heard.groupBy("a").agg(F.min(F.struct((-F.col("w")).alias("w"), "community")).alias("x"))
        labels = materialize(best.select(F.col("a").alias("node"), F.col("x.community").alias("community")))
    return labels


def cohesion(pairs: DataFrame, communities: DataFrame) -> DataFrame:
    """(community, members, cohesion): distinct inner pairs over all possible ones."""
    sizes = communities.groupBy("community").agg(F.count("*").alias("members"))
    x, y = communities.select(F.col("node").alias("a"), F.col("community").alias("ca")), communities.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    inner = pairs.join(x, "a").join(y, "b").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("inside"))
    possible = F.col("members") * (F.col("members") - 1) / 2
    return sizes.join(inner, "community", "left").select("community", "members", F.when(possible > 0, F.coalesce("inside", F.lit(0)) / possible).otherwise(0.0).alias("cohesion"))


#: Words that do not label a community.
NOISE = (
    "handler", "store", "manager", "service", "new", "get", "set", "run", "create", "update", "delete", "list", "find", "init", "config", "helper", "utils", "error", "response", "request", "base", "default",
)


def top_words(communities: DataFrame, entities: DataFrame, words: int = 3, noise: Sequence[str] = NOISE) -> DataFrame:
    """(community, words): the most frequent words of its members' names, ties in order of the alphabet; no row if there are none."""
    named = communities.join(entities.select(F.col("id").alias("node"), "name"), "node")
    each = named.select("community", F.explode(names.name_tokens(F.col("name"))).alias("word"))
    n = each.where(~F.col("word").isin(*noise) & (F.length("word") > 1)).groupBy("community", "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "word"))
    top = n.withColumn("_n", rank).where(F.col("_n") <= words)
    return top.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "word"))), lambda x: x["word"]).alias("words"))


def labels_of(communities: DataFrame, entities: DataFrame, words: int = 3, noise: Sequence[str] = NOISE) -> DataFrame:
    """(community, label): the most frequent words of its members' names, ``misc`` if there are none."""
    found = top_words(communities, entities, words, noise).select("community", F.array_join("words", "-").alias("label"))
    return communities.select("community").distinct().join(found, "community", "left").select("community", F.coalesce("label", F.lit("misc")).alias("label"))


def repo_graph(entities: DataFrame, relationships: DataFrame, cross_repo: DataFrame, repo_ids: Sequence[str], entity_kinds: Sequence[str] = (), edge_kinds: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges to draw: both ends present, only connected nodes; links between the chosen repositories once each."""
    own = entities.where(F.col("repo_id").isin(*repo_ids))
    own = own.where(F.col("kind").isin(*entity_kinds)) if entity_kinds else own
    links = cross_repo.where(F.col("from_repo_id").isin(*repo_ids) & F.col("to_repo_id").isin(*repo_ids))
    edges = all_edges(relationships.where(F.col("repo_id").isin(*repo_ids)), links)
    edges = edges_between(filter_edges(edges, edge_kinds), own.select("id")).dropDuplicates(["id"])
    used = edges.select(F.explode(F.array("from_entity_id", "to_entity_id")).alias("id")).distinct()
    return own.join(used, "id", "left_semi"), edges
