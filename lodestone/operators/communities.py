"""Communities of graphs by parallel moves: joins and aggregates only, over all repositories at once.

A level is a number of rounds.  In a round every node hears the communities of its neighbours, adds up the weight of its
edges to each, and takes the one with the largest gain in modularity, ties to the least name.  Nodes that all moved at once
would swap places for ever, so a round lets half of them move, by a digit of a hash of the node; two rounds make up both
halves, and a single node joins another single one only if that has the lesser name.  When two such rounds move nothing, the
communities become the nodes of the next level, until a level moves nothing.  At the end the nodes of the graph itself move once
more, from the communities found, which repairs what moves at the same time have spoilt.

Edges carry what they need of their source, so a node's options meet by (node, community) and then as one row a task: a hub
with a third of all edges is never in one task.  Joins on a heavy end or community deal its rows out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import scoring
from lodestone.operators.graph import NOISE, cohesion, top_words
from lodestone.operators.skew import HEAVY, heavy_keys, join_skewed
from lodestone.session import materialize

ROUNDS, LEVELS, MIN_GAIN = 6, 4, 1e-6


def _half(node: str, pair: int) -> Column:
    """0 or 1: which of a pair's two rounds lets the node move."""
    return F.conv(F.substring(F.md5(node), 1 + pair % 32, 1), 16, 10).cast("int") % 2


def communities(pairs: DataFrame, rounds: int = ROUNDS, levels: int = LEVELS, heavy: int = HEAVY) -> DataFrame:
    """(repo_id, a, b, weight), each pair once -> (repo_id, node, community), a community named by its least node.

    Defined cases: loops count twice in a node's weight; nodes without edges have no row; no pairs, no rows."""
    there = pairs.where("a <> b").select("repo_id", F.col("a").alias("src"), F.col("b").alias("dst"), F.col("weight").alias("w"))
    edges = there.unionByName(there.select("repo_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    loops = pairs.where("a = b").groupBy("repo_id", F.col("a").alias("node")).agg(F.sum("weight").alias("loop"))
    member: DataFrame | None = None
    most, first = 0, None
    for _ in range(levels):
        edges, nodes, crowded, size = _level(edges, loops, heavy)
        first = first or (edges, nodes, crowded, size)
        found, moved = _moves(edges, nodes, crowded, rounds, heavy, size)
        if member is None:
            member = found.select("repo_id", "node", "community")
        elif moved:
            step = found.select("repo_id", F.col("node").alias("community"), F.col("community").alias("_next"))
            member = join_skewed(member, step, ["repo_id", "community"], "node", heavy_keys(member, ["repo_id", "community"], heavy, most)).select("repo_id", "node", F.col("_next").alias("community"))
        else:
            break
        member = materialize(member)
        most = most or size
        if not moved:
            break
        edges, loops = _contracted(edges, nodes, found, crowded, heavy)
    assert member is not None and first is not None
    edges, nodes, crowded, size = first
    start = nodes.drop("loop").join(member, ["repo_id", "node"])
    member = _moves(edges, start, crowded, rounds, heavy, size)[0].select("repo_id", "node", "community")
    names = member.groupBy("repo_id", "community").agg(F.min("node").alias("least"))
    return join_skewed(member, names, ["repo_id", "community"], "node", heavy_keys(member, ["repo_id", "community"], heavy, most)).select("repo_id", "node", F.col("least").alias("community"))


def _level(edges: DataFrame, loops: DataFrame, heavy: int) -> tuple[DataFrame, DataFrame, DataFrame | None, int]:
    """Written edges with the weight k of their source and m2 of the graph; nodes with k, m2 and loop; the nodes with many edges; how many nodes there are."""
    edges = materialize(edges)
    ends = edges.groupBy("repo_id", F.col("src").alias("node")).agg(F.sum("w").alias("k"))
    nodes = ends.join(loops, ["repo_id", "node"], "full_outer").select("repo_id", "node", (F.coalesce("k", F.lit(0.0)) + 2 * F.coalesce("loop", F.lit(0.0))).alias("k"), F.coalesce("loop", F.lit(0.0)).alias("loop"))
    nodes = materialize(nodes)
    size = nodes.count()
    whole = nodes.groupBy("repo_id").agg(F.sum("k").alias("m2"))
    nodes = materialize(join_skewed(nodes, whole, ["repo_id"], "node", heavy_keys(nodes, ["repo_id"], heavy, size)))
    crowded = heavy_keys(edges.select("repo_id", F.col("dst").alias("node")), ["repo_id", "node"], heavy, edges.count())
    crowded = crowded if crowded is None else materialize(crowded)
    own = nodes.select("repo_id", F.col("node").alias("src"), "k", "m2")
    edges = join_skewed(edges, own, ["repo_id", "src"], "dst", _as(crowded, "src"))
    return materialize(edges), nodes, crowded, size


def _as(crowded: DataFrame | None, end: str) -> DataFrame | None:
    return crowded if crowded is None else crowded.withColumnRenamed("node", end)


def _moves(edges: DataFrame, nodes: DataFrame, crowded: DataFrame | None, rounds: int, heavy: int, size: int) -> tuple[DataFrame, bool]:
    """(repo_id, node, community, k, m2) after the rounds, and whether any node moved."""
    state = nodes.select("repo_id", "node", (F.col("community") if "community" in nodes.columns else F.col("node")).alias("community"), "k", "m2")
    any_moved, still = False, 0
    for r in range(rounds):
        totals = state.groupBy("repo_id", "community").agg(F.sum("k").alias("tot"), F.count("*").alias("n"))
        placed = join_skewed(state, totals, ["repo_id", "community"], "node", heavy_keys(state, ["repo_id", "community"], heavy, size))
        near = placed.select("repo_id", F.col("node").alias("dst"), "community", "tot", "n")
        heard = join_skewed(edges, near, ["repo_id", "dst"], "src", _as(crowded, "dst"))
        heard = heard.select("repo_id", F.col("src").alias("node"), "k", "m2", "community", "tot", "n", "w", F.lit(0).alias("own"))
        options = heard.unionByName(placed.select("repo_id", "node", "k", "m2", "community", "tot", "n", F.lit(0.0).alias("w"), F.lit(1).alias("own")))
        options = options.groupBy("repo_id", "node", "k", "m2", "community").agg(F.sum("w").alias("w"), F.max("tot").alias("tot"), F.max("n").alias("n"), F.max("own").alias("own"))
        others = F.col("tot") - F.when(F.col("own") == 1, F.col("k")).otherwise(0.0)
        gain = F.round(2 * F.col("w") / F.col("m2") - 2 * F.col("k") * others / (F.col("m2") * F.col("m2")), 12)
        options = options.withColumn("gain", gain)
        best = options.groupBy("repo_id", "node", "k", "m2").agg(
            F.min(F.struct((-F.col("gain")).alias("loss"), "community", "n")).alias("best"), F.max(F.when(F.col("own") == 1, F.struct("community", "gain", "n"))).alias("mine")
        )
        goes = (-F.col("best.loss") - F.col("mine.gain") > MIN_GAIN) & (_half("node", r // 2) == r % 2)
        goes = goes & ~((F.col("best.n") == 1) & (F.col("mine.n") == 1) & (F.col("best.community") > F.col("mine.community")))
        state = materialize(best.select("repo_id", "node", F.when(goes, F.col("best.community")).otherwise(F.col("mine.community")).alias("community"), "k", "m2", goes.alias("moved")))
        moved = state.where("moved").limit(1).count() > 0
        any_moved, still = any_moved or moved, 0 if moved else still + 1
        state = state.drop("moved")
        if still >= 2 and r % 2 == 1:  # both halves of a pair of rounds stayed
            break
    return state, any_moved


def _contracted(edges: DataFrame, nodes: DataFrame, found: DataFrame, crowded: DataFrame | None, heavy: int) -> tuple[DataFrame, DataFrame]:
    """Edges between communities, and the weight within them."""
    named = found.select("repo_id", F.col("node").alias("src"), F.col("community").alias("a"))
    both = join_skewed(edges.select("repo_id", "src", "dst", "w"), named, ["repo_id", "src"], "dst", _as(crowded, "src"))
    named = named.select("repo_id", F.col("src").alias("dst"), F.col("a").alias("b"))
    both = join_skewed(both, named, ["repo_id", "dst"], "src", _as(crowded, "dst"))
    sums = materialize(both.groupBy("repo_id", "a", "b").agg(F.sum("w").alias("w")))
    old = nodes.where("loop > 0").select("repo_id", "node", "loop").join(found.select("repo_id", "node", "community"), ["repo_id", "node"])
    inner = sums.where("a = b").select("repo_id", F.col("a").alias("node"), (F.col("w") / 2).alias("loop"))
    inner = inner.unionByName(old.select("repo_id", F.col("community").alias("node"), "loop")).groupBy("repo_id", "node").agg(F.sum("loop").alias("loop"))
    return sums.where("a <> b").select("repo_id", F.col("a").alias("src"), F.col("b").alias("dst"), "w"), materialize(inner)


def cluster_pairs(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, a, b, weight) of the edges that count between entities of a repository: no clusters, and no modules without a path."""
    own = entities.where((F.col("kind") != "cluster") & ~((F.col("kind") == "module") & F.col("path").isNull())).select(F.col("id").alias("_id"), F.col("repo_id").alias("_repo"))
    w = scoring.by_value(F.col("kind"), scoring.GRAPH_WEIGHT, 0.0)
    pairs = edges.select("repo_id", F.least("from_entity_id", "to_entity_id").alias("a"), F.greatest("from_entity_id", "to_entity_id").alias("b"), w.alias("w")).where("a <> b and w > 0")
    for end in ("a", "b"):
        pairs = pairs.join(own, (F.col(end) == F.col("_id")) & (F.col("repo_id") == F.col("_repo")), "left_semi")
    return pairs.groupBy("repo_id", "a", "b").agg(F.sum("w").alias("weight"))


def clusters(entities: DataFrame, edges: DataFrame, least: int = 3, noise: Sequence[str] = NOISE) -> tuple[DataFrame, DataFrame]:
    """Cluster entities and their member_of edges, as they are stored.

    Clusters have repo_id, kind, name, qualified_name, summary, capabilities, members and cohesion.  Communities of one repository
    with the same label are one cluster, whose summary is that of the largest of them (ties to the least node).
    Edges have repo_id, from_entity_id, qualified_name of the cluster, kind, strength and confidence.
    """
    pairs = materialize(cluster_pairs(entities, edges))
    found = materialize(communities(pairs))
    keyed = found.select("repo_id", "node", F.concat_ws("\n", "repo_id", "community").alias("community"))
    sized = cohesion(pairs.select("a", "b", "weight"), keyed).where(F.col("members") >= least)
    words = F.coalesce("words", F.array().cast("array<string>"))
    named = sized.join(top_words(keyed, entities, 3, noise), "community", "left").withColumn("words", words)
    none = F.size("words") == 0
    text = F.when(none, F.lit("Miscellaneous cluster")).otherwise(F.concat(F.lit("Cluster related to "), F.array_join("words", ", ")))
    named = named.select(
        F.substring_index("community", "\n", 1).alias("repo_id"), "community", F.when(none, F.lit("misc")).otherwise(F.array_join("words", "-")).alias("name"), "members", "cohesion",
        F.concat(text, F.when(F.col("cohesion") > 0, F.format_string(" (cohesion=%.2f)", "cohesion")).otherwise("")).alias("summary"), F.array(F.when(none, F.lit("other")).otherwise(F.get("words", F.lit(0)))).alias("capabilities"),
    )
    named = materialize(named)
    largest = F.min(F.struct((-F.col("members")).alias("m"), "community", "summary", "cohesion")).alias("x")
    out = named.groupBy("repo_id", "name").agg(F.sum("members").alias("members"), largest, F.first("capabilities").alias("capabilities"))
    out = out.select("repo_id", F.lit("cluster").alias("kind"), "name", F.concat(F.lit("cluster::"), "name").alias("qualified_name"), "x.summary", "capabilities", "members", "x.cohesion")
    links = join_skewed(keyed.select("node", "community"), named.select("community", "repo_id", "name"), ["community"], "node", heavy_keys(keyed, ["community"]))
    links = links.select("repo_id", F.col("node").alias("from_entity_id"), F.concat(F.lit("cluster::"), "name").alias("qualified_name"), F.lit("member_of").alias("kind"), F.lit("strong").alias("strength"), F.lit(0.9).alias("confidence"))
    return out, links
