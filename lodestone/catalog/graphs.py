"""Traversals, flows, weights and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.catalog.base import query
from lodestone.functions import scoring
from lodestone.indexes.flows import FlowIndex
from lodestone.operators import communities as C
from lodestone.operators import graph as O
from lodestone.session import materialize, scratch
from lodestone.sources.graph import TestGraph as G

U = "u AS (SELECT from_entity_id AS a, to_entity_id AS b FROM relationships UNION SELECT to_entity_id, from_entity_id FROM relationships)"


def seeds(g: G, *ids: str) -> DataFrame:
    return g.spark.createDataFrame([(i,) for i in ids], "seed string")


@query("gr1_traverse", f"WITH RECURSIVE {U}, w AS (SELECT 'n3' AS node, 0 AS depth UNION SELECT u.b, w.depth + 1 FROM w JOIN u ON u.a = w.node WHERE w.depth < 3), m AS (SELECT node, min(depth) AS depth FROM w GROUP BY node) SELECT node, depth FROM m ORDER BY depth, node LIMIT 200")
def _(g: G) -> DataFrame:
    return O.traverse(g.relationships, seeds(g, "n3")).select("node", "depth")


@query("gr1_induced_edges", f"WITH RECURSIVE {U}, w AS (SELECT 'n3' AS node, 0 AS depth UNION SELECT u.b, w.depth + 1 FROM w JOIN u ON u.a = w.node WHERE w.depth < 2), m AS (SELECT node, min(depth) AS depth FROM w GROUP BY node), c AS (SELECT node FROM m ORDER BY depth, node LIMIT 200) SELECT id, kind FROM relationships WHERE from_entity_id IN (SELECT node FROM c) AND to_entity_id IN (SELECT node FROM c)")
def _(g: G) -> DataFrame:
    return O.subgraph(g.relationships, O.traverse(g.relationships, seeds(g, "n3"), 2)).select("id", "kind")


@query("gr1_cross_repo_kinds", "WITH RECURSIVE e AS (SELECT from_entity_id, to_entity_id FROM relationships WHERE kind IN ('owns', 'depends_on') AND confidence >= 0.7 UNION ALL SELECT from_entity_id, to_entity_id FROM cross_repo_relationships WHERE kind IN ('owns', 'depends_on') AND confidence >= 0.7), u AS (SELECT from_entity_id AS a, to_entity_id AS b FROM e UNION SELECT to_entity_id, from_entity_id FROM e), w AS (SELECT 'p8' AS node, 0 AS depth UNION SELECT u.b, w.depth + 1 FROM w JOIN u ON u.a = w.node WHERE w.depth < 4) SELECT node, min(depth) AS depth FROM w GROUP BY node")
def _(g: G) -> DataFrame:
    edges = O.filter_edges(O.all_edges(g.relationships, g.cross_repo_relationships), ["owns", "depends_on"], 0.7)
    return O.traverse(edges, seeds(g, "p8"), 4, None).select("node", "depth")


@query("gr2_many_seeds", f"WITH {U}, s AS (SELECT 'n1' AS seed UNION ALL SELECT 'n2' UNION ALL SELECT 's3'), h AS (SELECT seed, seed AS node, 0 AS d FROM s UNION ALL SELECT seed, u.b, 1 FROM s JOIN u ON u.a = seed UNION ALL SELECT s.seed, y.b, 2 FROM s JOIN u x ON x.a = s.seed JOIN u y ON y.a = x.b), m AS (SELECT seed, node, min(d) AS depth FROM h GROUP BY seed, node) SELECT seed, node, depth FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, node) AS k FROM m) WHERE k <= 50")
def _(g: G) -> DataFrame:
    return O.traverse(g.relationships, seeds(g, "n1", "n2", "s3"), 2, 50).select("seed", "node", "depth")


@query("gr2_all_services", f"WITH {U}, s AS (SELECT id AS seed FROM entities WHERE kind = 'service'), h AS (SELECT seed, seed AS node, 0 AS d FROM s UNION ALL SELECT seed, u.b, 1 FROM s JOIN u ON u.a = seed UNION ALL SELECT s.seed, y.b, 2 FROM s JOIN u x ON x.a = s.seed JOIN u y ON y.a = x.b), m AS (SELECT seed, node, min(d) AS depth FROM h GROUP BY seed, node) SELECT seed, node, depth FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, node) AS k FROM m) WHERE k <= 50")
def _(g: G) -> DataFrame:
    """What triplet search does with its seeds, for all services at once."""
    services = g.entities.where("kind = 'service'").select(F.col("id").alias("seed"))
    return O.traverse(g.relationships, services, 2, 50).select("seed", "node", "depth")


@query("gr3_strongest_neighbours", "WITH b AS (SELECT from_entity_id AS seed, to_entity_id AS node, strength FROM relationships UNION ALL SELECT to_entity_id, from_entity_id, strength FROM relationships) SELECT node, CASE max(CASE strength WHEN 'strong' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END) WHEN 3 THEN 'strong' WHEN 2 THEN 'moderate' ELSE 'weak' END AS strength FROM b WHERE seed = 'p7' AND node <> seed GROUP BY node")
def _(g: G) -> DataFrame:
    return O.strongest_neighbours(g.relationships, seeds(g, "p7")).select("node", "strength")


CALLS = "c AS (SELECT DISTINCT from_entity_id AS a, to_entity_id AS b FROM relationships WHERE kind = 'calls')"
ENTRY = """o AS (SELECT from_entity_id AS id, count(*) AS od FROM relationships WHERE kind = 'calls' GROUP BY 1), i AS (SELECT to_entity_id AS id, count(*) AS ind FROM relationships WHERE kind = 'calls' GROUP BY 1),
    ep AS (SELECT o.id, od, coalesce(ind, 0) AS ind FROM o LEFT JOIN i ON o.id = i.id JOIN entities e ON e.id = o.id WHERE od >= 2 AND coalesce(ind, 0) <= 2 ORDER BY od - coalesce(ind, 0) DESC, o.id LIMIT 400)"""


@query("gr5_entry_points", f"WITH {ENTRY} SELECT id, od AS out_degree, ind AS in_degree FROM ep")
def _(g: G) -> DataFrame:
    return O.entry_points(g.entities, g.relationships).select("id", "out_degree", "in_degree")


@query("agg10_degrees", "WITH o AS (SELECT from_entity_id AS id, count(*) AS od FROM relationships WHERE kind = 'calls' GROUP BY 1), i AS (SELECT to_entity_id AS id, count(*) AS ind FROM relationships WHERE kind = 'calls' GROUP BY 1) SELECT o.id, od AS out_degree, coalesce(ind, 0) AS in_degree FROM o LEFT JOIN i ON o.id = i.id")
def _(g: G) -> DataFrame:
    return O.degrees(g.relationships)


@query("gr4_call_flow", f"WITH RECURSIVE {CALLS}, w AS (SELECT 'c7' AS node, 0 AS depth UNION SELECT c.b, w.depth + 1 FROM w JOIN c ON c.a = w.node WHERE w.depth < 10) SELECT node, min(depth) AS depth FROM w GROUP BY node")
def _(g: G) -> DataFrame:
    calls = g.relationships.where("kind = 'calls'").select(F.col("from_entity_id").alias("src"), F.col("to_entity_id").alias("dst")).distinct()
    return O.reach(calls, seeds(g, "c7"), 10).select("node", "depth")


FLOWS = f"""
    WITH RECURSIVE {CALLS}, {ENTRY}, w AS (SELECT id AS seed, id AS node, 0 AS depth FROM ep UNION SELECT w.seed, c.b, w.depth + 1 FROM w JOIN c ON c.a = w.node WHERE w.depth < 10),
    m AS (SELECT seed, node, min(depth) AS depth FROM w GROUP BY seed, node), n AS (SELECT seed, node, depth, e.name, row_number() OVER (PARTITION BY seed ORDER BY depth, name, node) AS k FROM m JOIN entities e ON e.id = node),
    l AS (SELECT seed, string_agg(CASE WHEN k <= 8 THEN name END, ' → ' ORDER BY k) || CASE WHEN count(*) > 8 THEN ' → …' ELSE '' END AS label, max(depth) AS depth, count(*) AS n_steps FROM n GROUP BY seed),
    r AS (SELECT l.*, od - ind AS place, row_number() OVER (PARTITION BY label ORDER BY od - ind DESC, seed) AS k FROM l JOIN ep ON ep.id = l.seed WHERE l.depth >= 2)
    SELECT seed, label, depth, n_steps FROM r WHERE k = 1 ORDER BY place DESC, seed LIMIT 200"""


def flows_of(g: G) -> FlowIndex:
    """The stored flows of the graph."""

    def make() -> FlowIndex:
        index = FlowIndex(g.spark, scratch(g.spark, "flows"))
        index.build(g.entities, g.relationships)
        return index

    return g.once("flows", make)


@query("gr6_flows", FLOWS)
def _(g: G) -> DataFrame:
    return flows_of(g).flows().select("seed", "label", "depth", "n_steps")


@query("gr6_flows_refreshed", FLOWS)
def _(g: G) -> DataFrame:
    """Flows of the graph without its weak edges, then brought up to the whole graph."""
    index = FlowIndex(g.spark, scratch(g.spark, "flows"))
    index.build(g.entities, g.relationships.where("strength <> 'weak'"))
    index.refresh(g.entities, g.relationships, g.relationships.where("strength = 'weak' and kind = 'calls'").select("from_entity_id"))
    return index.flows().select("seed", "label", "depth", "n_steps")


@query("flt7_flows_through", FLOWS.replace("SELECT seed, label, depth, n_steps FROM r WHERE k = 1", "SELECT seed, label FROM (SELECT * FROM r WHERE k = 1").replace("LIMIT 200", "LIMIT 200) WHERE seed IN (SELECT seed FROM m WHERE node = 's3')"))
def _(g: G) -> DataFrame:
    return flows_of(g).flows("s3").select("seed", "label")


PAIRS = "p AS (SELECT least(from_entity_id, to_entity_id) AS a, greatest(from_entity_id, to_entity_id) AS b, sum(CASE kind WHEN 'calls' THEN 3.0 WHEN 'depends_on' THEN 2.0 WHEN 'owns' THEN 1.5 ELSE 0 END)::DOUBLE AS weight FROM relationships WHERE from_entity_id <> to_entity_id GROUP BY 1, 2)"


@query("gr7_weighted", f"WITH {PAIRS} SELECT a, b, weight FROM p")
def _(g: G) -> DataFrame:
    return O.weighted(g.relationships)


def community_sql(rounds: int = C.ROUNDS, levels: int = C.LEVELS) -> str:
    """The rounds of ``operators.communities``, one after the other, from ``g0`` (repo_id, a, b, weight) to ``found`` (repo_id, node, community); rounds that move nothing change nothing."""
    out = ["e0 AS MATERIALIZED (SELECT repo_id, a AS src, b AS dst, weight AS w FROM g0 UNION ALL SELECT repo_id, b, a, weight FROM g0)", "l0 AS (SELECT NULL::VARCHAR AS repo_id, NULL::VARCHAR AS node, 0.0::DOUBLE AS loop WHERE false)"]
    member = None

    def moves(v: str, edges: str) -> None:
        """From the communities of s{v}_0 to those of s{v}_{rounds}."""
        for r in range(rounds):
            half = f"({'' if r % 2 else 'NOT '}substr(md5(node), {1 + r // 2 % 32}, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f'))"
            out.append(f"p{v}_{r} AS MATERIALIZED (SELECT *, sum(k) OVER w AS tot, count(*) OVER w AS n FROM s{v}_{r} WINDOW w AS (PARTITION BY repo_id, community))")
            out.append(f"""o{v}_{r} AS MATERIALIZED (SELECT repo_id, node, k, m2, community, n, own, round(2 * w / m2 - 2 * k * (tot - CASE WHEN own = 1 THEN k ELSE 0 END) / (m2 * m2), 12) AS gain FROM
                (SELECT repo_id, node, any_value(k) AS k, any_value(m2) AS m2, community, sum(w) AS w, max(tot) AS tot, max(n) AS n, max(own) AS own FROM
                 (SELECT e.repo_id, e.src AS node, x.k, x.m2, y.community, y.tot, y.n, e.w, 0 AS own FROM {edges} e JOIN p{v}_{r} x ON x.repo_id = e.repo_id AND x.node = e.src JOIN p{v}_{r} y ON y.repo_id = e.repo_id AND y.node = e.dst
                  UNION ALL SELECT repo_id, node, k, m2, community, tot, n, 0, 1 FROM p{v}_{r}) GROUP BY repo_id, node, community))""")
            out.append(f"""s{v}_{r + 1} AS MATERIALIZED (SELECT repo_id, node, CASE WHEN best.gain - mine.gain > {C.MIN_GAIN} AND {half} AND NOT (best.n = 1 AND mine.n = 1 AND best.community > mine.community) THEN best.community ELSE mine.community END AS community, k, m2 FROM
                (SELECT repo_id, node, any_value(k) AS k, any_value(m2) AS m2, arg_min({{'gain': gain, 'community': community, 'n': n}}, {{'loss': -gain, 'community': community}}) AS best,
                 any_value({{'gain': gain, 'community': community, 'n': n}}) FILTER (own = 1) AS mine FROM o{v}_{r} GROUP BY repo_id, node))""")

    for v in range(levels):
        out.append(f"""n{v} AS MATERIALIZED (SELECT repo_id, node, k, loop, sum(k) OVER (PARTITION BY repo_id) AS m2 FROM (SELECT repo_id, node, sum(w) + 2 * sum(loop) AS k, sum(loop) AS loop
            FROM (SELECT repo_id, src AS node, w, 0.0::DOUBLE AS loop FROM e{v} UNION ALL SELECT repo_id, node, 0, loop FROM l{v}) GROUP BY repo_id, node))""")
        out.append(f"s{v}_0 AS MATERIALIZED (SELECT repo_id, node, node AS community, k, m2 FROM n{v})")
        moves(str(v), f"e{v}")
        out.append(f"m{v} AS MATERIALIZED (SELECT repo_id, node, community FROM s{v}_{rounds})" if member is None else f"m{v} AS MATERIALIZED (SELECT m.repo_id, m.node, s.community FROM {member} m JOIN s{v}_{rounds} s ON s.repo_id = m.repo_id AND s.node = m.community)")
        member = f"m{v}"
        out.append(f"c{v} AS MATERIALIZED (SELECT e.repo_id, x.community AS a, y.community AS b, sum(w) AS w FROM e{v} e JOIN s{v}_{rounds} x ON x.repo_id = e.repo_id AND x.node = e.src JOIN s{v}_{rounds} y ON y.repo_id = e.repo_id AND y.node = e.dst GROUP BY ALL)")
        out.append(f"e{v + 1} AS MATERIALIZED (SELECT repo_id, a AS src, b AS dst, w FROM c{v} WHERE a <> b)")
        out.append(f"l{v + 1} AS MATERIALIZED (SELECT repo_id, node, sum(loop) AS loop FROM (SELECT repo_id, a AS node, w / 2 AS loop FROM c{v} WHERE a = b UNION ALL SELECT n.repo_id, s.community, loop FROM n{v} n JOIN s{v}_{rounds} s ON s.repo_id = n.repo_id AND s.node = n.node WHERE loop > 0) GROUP BY repo_id, node)")
    out.append(f"sx_0 AS MATERIALIZED (SELECT n.repo_id, n.node, m.community, k, m2 FROM n0 n JOIN {member} m ON m.repo_id = n.repo_id AND m.node = n.node)")
    moves("x", "e0")
    out.append(f"found AS MATERIALIZED (SELECT repo_id, node, min(node) OVER (PARTITION BY repo_id, community) AS community FROM sx_{rounds})")
    return ",\n".join(out)


WEIGHT = "CASE kind WHEN 'calls' THEN 3.0::DOUBLE WHEN 'implements' THEN 2.5::DOUBLE WHEN 'depends_on' THEN 2.0::DOUBLE WHEN 'owns' THEN 1.5::DOUBLE WHEN 'imports' THEN 1.0::DOUBLE ELSE 0 END"
WHOLE = f"g0 AS MATERIALIZED (SELECT repo_id, least(from_entity_id, to_entity_id) AS a, greatest(from_entity_id, to_entity_id) AS b, sum({WEIGHT}) AS weight FROM relationships WHERE from_entity_id <> to_entity_id GROUP BY ALL HAVING sum({WEIGHT}) > 0)"
#: Without modules that have no path.
CLUSTERED = WHOLE.replace("WHERE from_entity_id <> to_entity_id", "WHERE from_entity_id <> to_entity_id AND from_entity_id IN (SELECT id FROM own) AND to_entity_id IN (SELECT id FROM own)").replace("g0 AS", "own AS (SELECT id FROM entities WHERE kind <> 'cluster' AND NOT (kind = 'module' AND path IS NULL)), g0 AS", 1)


@query("gr8_louvain", f"WITH {WHOLE}, {community_sql()} SELECT repo_id, node, community FROM found")
def _(g: G) -> DataFrame:
    ends = [f("from_entity_id", "to_entity_id") for f in (F.least, F.greatest)]
    pairs = g.relationships.select("repo_id", ends[0].alias("a"), ends[1].alias("b"), scoring.by_value(F.col("kind"), scoring.GRAPH_WEIGHT, 0.0).alias("weight"))
    return C.communities(pairs.where("a <> b and weight > 0").groupBy("repo_id", "a", "b").agg(F.sum("weight").alias("weight")))


@query("gr9_modularity", f"""
    WITH {PAIRS}, d AS (SELECT a, b, weight FROM p UNION ALL SELECT b, a, weight FROM p), m AS (SELECT sum(weight) AS m2 FROM d), k AS (SELECT a AS node, substr(a, 1, 1) AS c, sum(weight) AS k FROM d GROUP BY a),
    i AS (SELECT x.c, d.weight, x.k AS ka, y.k AS kb FROM d JOIN k x ON d.a = x.node JOIN k y ON d.b = y.node WHERE x.c = y.c), t AS (SELECT c, sum(k) AS tot FROM k GROUP BY c), n AS (SELECT c, sum(weight) AS inside FROM i GROUP BY c)
    SELECT round((SELECT sum(coalesce(inside, 0) / m2 - (tot / m2) ** 2) FROM t LEFT JOIN n ON t.c = n.c, m), 9) AS q, round((SELECT coalesce(sum((weight - ka * kb / m2) / m2), 0) FROM i, m), 9) AS q_adjacent""")
def _(g: G) -> DataFrame:
    pairs = O.weighted(g.relationships)
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("community", F.substring("node", 1, 1))
    return O.modularity(pairs, nodes).select(F.round("q", 9).alias("q"), F.round("q_adjacent", 9).alias("q_adjacent"))


@query("agg17_cohesion", f"WITH {PAIRS}, k AS (SELECT id AS node, qualified_name[1:5] AS c FROM entities), s AS (SELECT c, count(*) AS n FROM k GROUP BY c), i AS (SELECT x.c, count(*) AS e FROM p JOIN k x ON p.a = x.node JOIN k y ON p.b = y.node WHERE x.c = y.c GROUP BY x.c) SELECT s.c AS community, n AS members, round(CASE WHEN n > 1 THEN coalesce(e, 0) / (n * (n - 1) / 2) ELSE 0 END, 9) AS cohesion FROM s LEFT JOIN i ON s.c = i.c")
def _(g: G) -> DataFrame:
    nodes = g.entities.select(F.col("id").alias("node"), F.substring("qualified_name", 1, 5).alias("community"))
    return O.cohesion(O.weighted(g.relationships), nodes).select("community", "members", F.round("cohesion", 9).alias("cohesion"))


@query("agg16_labels", r"""
    WITH w AS (SELECT kind AS community, unnest(list_filter(string_split_regex(lower(regexp_replace(name, '([a-z])([A-Z])', '\1 \2', 'g')), '[ _\-.:/]+'), lambda x: x <> '')) AS word FROM entities WHERE kind IN ('type', 'service')),
    n AS (SELECT community, word, count(*) AS n FROM w WHERE length(word) > 1 AND word NOT IN ('handler', 'store', 'manager', 'service', 'new', 'get', 'set', 'run', 'create', 'update', 'delete', 'list', 'find', 'init', 'config', 'helper', 'utils', 'error', 'response', 'request', 'base', 'default') GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, word) AS k FROM n)
    SELECT community, string_agg(word, '-' ORDER BY k) AS label FROM r WHERE k <= 3 GROUP BY community""")
def _(g: G) -> DataFrame:
    nodes = g.entities.where("kind in ('type', 'service')").select(F.col("id").alias("node"), F.col("kind").alias("community"))
    return O.labels_of(nodes, g.entities)


@query("gr11_paths", """
    WITH RECURSIVE e AS (SELECT from_entity_id, to_entity_id FROM relationships WHERE kind = 'depends_on'), u AS (SELECT from_entity_id AS a, to_entity_id AS b FROM e UNION SELECT to_entity_id, from_entity_id FROM e),
    w AS (SELECT 'p40' AS node, ['p40'] AS path UNION ALL SELECT u.b, list_append(w.path, u.b) FROM w JOIN u ON u.a = w.node WHERE len(w.path) <= 3 AND NOT list_contains(w.path, u.b)),
    m AS (SELECT node, min((len(path), path)) AS x FROM w GROUP BY node)
    SELECT node, CAST(x[1] - 1 AS INT) AS depth, array_to_string(x[2], '>') AS path FROM m WHERE x[1] > 2""")
def _(g: G) -> DataFrame:
    return O.paths(g.relationships.where("kind = 'depends_on'"), "p40", 3).select("node", "depth", F.array_join("path", ">").alias("path"))


@query("gr12_repo_graph", "SELECT id, kind FROM relationships WHERE repo_id = 'r1' AND kind IN ('owns', 'depends_on') AND from_entity_id IN (SELECT id FROM entities WHERE repo_id = 'r1') AND to_entity_id IN (SELECT id FROM entities WHERE repo_id = 'r1')")
def _(g: G) -> DataFrame:
    return O.repo_graph(g.entities, g.relationships, g.cross_repo_relationships, ["r1"], (), ["owns", "depends_on"])[1].select("id", "kind")


@query("gr14_multi_repo_graph", "WITH x AS (SELECT id, from_entity_id, to_entity_id FROM relationships WHERE repo_id IN ('r1', 'r2') AND kind = 'owns' UNION SELECT id, from_entity_id, to_entity_id FROM cross_repo_relationships WHERE from_repo_id IN ('r1', 'r2') AND to_repo_id IN ('r1', 'r2') AND kind = 'owns') SELECT id FROM entities WHERE repo_id IN ('r1', 'r2') AND (id IN (SELECT from_entity_id FROM x) OR id IN (SELECT to_entity_id FROM x))")
def _(g: G) -> DataFrame:
    return O.repo_graph(g.entities, g.relationships, g.cross_repo_relationships, ["r1", "r2"], (), ["owns"])[0].select("id")


@query("gr18_affected_repos", "SELECT DISTINCT r.name FROM cross_repo_relationships c JOIN repos r ON c.to_repo_id = r.id WHERE c.from_repo_id = 'r1'")
def _(g: G) -> DataFrame:
    out = g.cross_repo_relationships.where("from_repo_id = 'r1'").select(F.col("to_repo_id").alias("id")).distinct()
    return g.repos.join(out, "id", "left_semi").select("name").distinct()


NOISE = ", ".join(f"'{w}'" for w in O.NOISE)
CLUSTERS = rf"""WITH {CLUSTERED}, {community_sql()},
    z AS (SELECT repo_id, community, count(*) AS members FROM found GROUP BY ALL HAVING count(*) >= 3),
    i AS (SELECT x.repo_id, x.community, count(*) AS inside FROM g0 p JOIN found x ON p.repo_id = x.repo_id AND p.a = x.node JOIN found y ON p.repo_id = y.repo_id AND p.b = y.node WHERE x.community = y.community GROUP BY ALL),
    t AS (SELECT f.repo_id, f.community, unnest(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\1 \2', 'g'), '(.)([A-Z][a-z])', '\1 \2', 'g')), '[ _\-.:/]+'), lambda x: length(x) > 1 AND x NOT IN ({NOISE}))) AS word FROM found f JOIN entities e ON e.id = f.node),
    q AS (SELECT *, row_number() OVER (PARTITION BY repo_id, community ORDER BY n DESC, word) AS k FROM (SELECT repo_id, community, word, count(*) AS n FROM t GROUP BY ALL)),
    b AS (SELECT repo_id, community, list(word ORDER BY k) AS words FROM q WHERE k <= 3 GROUP BY ALL),
    named AS (SELECT z.repo_id, z.community, members, coalesce(inside, 0) / (members * (members - 1) / 2) AS cohesion, coalesce(array_to_string(words, '-'), 'misc') AS name, coalesce('Cluster related to ' || array_to_string(words, ', '), 'Miscellaneous cluster') AS said, coalesce(words[1], 'other') AS domain
        FROM z LEFT JOIN i USING (repo_id, community) LEFT JOIN b USING (repo_id, community))"""


@query("gr10_clusters", f"""{CLUSTERS} SELECT repo_id, name, 'cluster::' || name AS qualified_name, sum(members)::BIGINT AS members, any_value(domain) AS domain,
    arg_min(said || CASE WHEN cohesion > 0 THEN printf(' (cohesion=%.2f)', cohesion) ELSE '' END, {{'m': -members, 'c': community}}) AS summary FROM named GROUP BY repo_id, name""")
def _(g: G) -> DataFrame:
    return C.clusters(g.entities, g.relationships)[0].select("repo_id", "name", "qualified_name", "members", F.get("capabilities", F.lit(0)).alias("domain"), "summary")


@query("gr10_member_of", f"{CLUSTERS} SELECT f.repo_id, f.node AS from_entity_id, 'cluster::' || name AS qualified_name, 'member_of' AS kind, 0.9::DOUBLE AS confidence FROM found f JOIN named n ON n.repo_id = f.repo_id AND n.community = f.community")
def _(g: G) -> DataFrame:
    return C.clusters(g.entities, g.relationships)[1].drop("strength")


def within(hops: int) -> str:
    """Nodes within so many steps of s3."""
    return f"{U}, h0 AS (SELECT 's3' AS node), " + ", ".join(f"h{i} AS (SELECT node FROM h{i - 1} UNION SELECT u.b FROM u JOIN h{i - 1} ON u.a = h{i - 1}.node)" for i in range(1, hops + 1))


@query("gr13_entity_graph", " UNION ALL ".join(f"SELECT * FROM (WITH {within(d)} SELECT DISTINCT {d} AS hops, id, kind FROM relationships WHERE from_entity_id IN (SELECT node FROM h{d}) AND to_entity_id IN (SELECT node FROM h{d}))" for d in (1, 2, 3)))
def _(g: G) -> DataFrame:
    """The graphs of one, two and three steps around an entity."""
    found = materialize(O.traverse(g.relationships, seeds(g, "s3"), 3, None))
    parts = [O.subgraph(g.relationships, found.where(F.col("depth") <= d)).select(F.lit(d).alias("hops"), "id", "kind") for d in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("set3_recursive_paths", "WITH RECURSIVE w AS (SELECT to_entity_id AS node, 1 AS depth FROM relationships WHERE from_entity_id = 'p40' AND kind = 'depends_on' UNION ALL SELECT r.to_entity_id, w.depth + 1 FROM w JOIN relationships r ON r.from_entity_id = w.node AND r.kind = 'depends_on' WHERE w.depth < 10) SELECT node, min(depth) AS depth FROM w GROUP BY node")
def _(g: G) -> DataFrame:
    steps = g.relationships.where("kind = 'depends_on'").select(F.col("from_entity_id").alias("src"), F.col("to_entity_id").alias("dst"))
    return O.reach(steps, seeds(g, "p40"), 10).where("depth > 0").select("node", "depth")
