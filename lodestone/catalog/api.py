"""The engine's questions."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.catalog.base import query
from lodestone.catalog.graphs import FLOWS, flows_of
from lodestone.catalog.relational import CAT, DIM
from lodestone.catalog.search import LEAST, SHOWN, TRIPLETS, hybrid_sql, indexes, with_vectors
from lodestone.plans.api import KnowledgeEngine
from lodestone.sources.graph import TestGraph as G

NAMES = ("repos", "entities", "relationships", "cross_repo_relationships", "decisions", "decision_entities", "feedback", "jobs", "runs")


def engine(g: G) -> KnowledgeEngine:
    return KnowledgeEngine({**{n: g.table(n) for n in NAMES}, "facts": with_vectors(g)}, embed=lambda _: g.query_vector, indexes=indexes(g))


@query("q01_search_facts", hybrid_sql(f"SELECT {SHOWN} FROM best", limit=20))
def _(g: G) -> DataFrame:
    return engine(g).search("que la", least=LEAST).withColumn("score", F.round("score", 6))


@query("q01_search_graph", TRIPLETS)
def _(g: G) -> DataFrame:
    return engine(g).search("que la", mode="graph").select("id", F.round("score", 6).alias("score"))


@query("q02_list_repos", "SELECT id, name FROM repos")
def _(g: G) -> DataFrame:
    return engine(g).list_repos().select("id", "name")


@query("q03_conventions", f"SELECT id, category FROM facts WHERE superseded_by IS NULL AND category IN ('convention', 'pattern') AND confidence <> 'low' AND repo_id = 'r1' ORDER BY {DIM}, id LIMIT 50")
def _(g: G) -> DataFrame:
    return engine(g).conventions("r1").select("id", "category")


FIRST_FACTS = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY {DIM}, {CAT}, id) AS k FROM facts WHERE superseded_by IS NULL) WHERE k <= 50"
BOTH_ENDS = "SELECT from_entity_id AS entity_id, to_entity_id AS other_id, id, kind, confidence, 'outgoing' AS direction FROM relationships UNION ALL SELECT to_entity_id, from_entity_id, id, kind, confidence, 'incoming' FROM relationships WHERE from_entity_id <> to_entity_id"


@query("q04_module_context", f"SELECT id, claim FROM ({FIRST_FACTS}) WHERE entity_id = 'p7'")
def _(g: G) -> DataFrame:
    return engine(g).module_context("p7")["facts"].select("id", "claim")


@query("q04_deep_context", f"""
    WITH w AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY id) AS k FROM ({BOTH_ENDS}) WHERE entity_id = 'p7') WHERE k <= 50)
    SELECT w.id, direction, w.kind, w.confidence, e.name AS other_name, e.kind AS other_kind, e.path AS other_path, r.name AS other_repo FROM w LEFT JOIN entities e ON e.id = other_id LEFT JOIN repos r ON r.id = e.repo_id""")
def _(g: G) -> DataFrame:
    return engine(g).module_context("p7", deep=True)["relationships"].select("id", "direction", "kind", "confidence", "other_name", "other_kind", "other_path", "other_repo")


@query("q05_service_contract", "SELECT e.name AS from_name, r.kind FROM (SELECT * FROM relationships WHERE to_entity_id = 'p7' ORDER BY id LIMIT 50) r JOIN entities e ON r.from_entity_id = e.id")
def _(g: G) -> DataFrame:
    return engine(g).service_contract("p7")[0].select(F.col("other_name").alias("from_name"), "kind")


@query("q05_invariants", f"SELECT id, category, claim FROM ({FIRST_FACTS}) WHERE entity_id = 'p6' AND category IN ('behavior', 'constraint', 'contract')")
def _(g: G) -> DataFrame:
    return engine(g).service_contract("p6")[1].select("id", "category", "claim")


#: Weak calls stand for tests: both directions of p7 have some.
E06 = """WITH e AS (SELECT id, from_entity_id, to_entity_id, CASE WHEN kind = 'calls' AND strength = 'weak' THEN 'tested_by' ELSE kind END AS kind FROM (SELECT id, from_entity_id, to_entity_id, kind, strength FROM relationships UNION ALL SELECT id, from_entity_id, to_entity_id, kind, strength FROM cross_repo_relationships)),
    k AS (SELECT * FROM e WHERE kind IN ('depends_on', 'tested_by')), u AS (SELECT from_entity_id AS a, to_entity_id AS b FROM k UNION SELECT to_entity_id, from_entity_id FROM k),
    one AS (SELECT b AS node FROM u WHERE a = 'p7'), two AS (SELECT DISTINCT u.b AS node FROM one JOIN u ON u.a = one.node),
    n AS (SELECT node, min(d) AS d FROM (SELECT 'p7' AS node, 0 AS d UNION ALL SELECT node, 1 FROM one UNION ALL SELECT node, 2 FROM two) GROUP BY node ORDER BY d, node LIMIT 50)"""


def impact_of_p7(g: G) -> tuple[DataFrame, DataFrame, DataFrame]:
    tested = F.when((F.col("kind") == "calls") & (F.col("strength") == "weak"), "tested_by").otherwise(F.col("kind"))
    known = engine(g)
    known.tables |= {n: g.table(n).withColumn("kind", tested) for n in ("relationships", "cross_repo_relationships")}
    return known.impact("p7", 2, ["depends_on", "tested_by"])


@query("q06_impact_direct", f"""{E06} SELECT id, CASE WHEN from_entity_id <> 'p7' THEN 'depended_by' WHEN kind = 'tested_by' THEN 'tested_by' ELSE 'depends_on' END AS direction
    FROM k WHERE (from_entity_id = 'p7' OR to_entity_id = 'p7') AND from_entity_id IN (SELECT node FROM n) AND to_entity_id IN (SELECT node FROM n)""")
def _(g: G) -> DataFrame:
    return impact_of_p7(g)[0].select("id", "direction")


@query("q06_impact_paths", f"""{E06}, i AS (SELECT from_entity_id AS a, to_entity_id AS b FROM k WHERE from_entity_id IN (SELECT node FROM n) AND to_entity_id IN (SELECT node FROM n)), v AS (SELECT a, b FROM i UNION SELECT b, a FROM i)
    SELECT y.b AS node, 2 AS depth, min('p7>' || x.b || '>' || y.b) AS path FROM v x JOIN v y ON y.a = x.b WHERE x.a = 'p7' AND x.b <> 'p7' AND y.b <> 'p7' AND y.b NOT IN (SELECT b FROM v WHERE a = 'p7') GROUP BY y.b""")
def _(g: G) -> DataFrame:
    return impact_of_p7(g)[1].select("node", "depth", F.array_join("path", ">").alias("path"))


@query("q06_impact_repos", f"{E06} SELECT id, name FROM repos WHERE id IN (SELECT repo_id FROM entities WHERE id IN (SELECT node FROM n)) AND id <> (SELECT repo_id FROM entities WHERE id = 'p7')")
def _(g: G) -> DataFrame:
    return impact_of_p7(g)[2]


@query("q07_decisions", "SELECT d.id FROM decisions d JOIN decision_entities l ON d.id = l.decision_id WHERE l.entity_id = 'p9' ORDER BY d.created_at DESC, d.id LIMIT 50")
def _(g: G) -> DataFrame:
    return engine(g).decisions_of("p9").select("id")


#: Files by their whole path, by the end of it, an entity by its qualified name, and nothing.
FILES = ("internal/svc/nation_11.go", "svc/nation_16.go", "geo::NATION_6", "small.go", "none.go")
TASK = f"""
    WITH a AS (SELECT unnest({list(FILES)!r}) AS asked),
    rel AS (SELECT id, from_entity_id, to_entity_id, CASE WHEN kind = 'calls' AND strength = 'weak' THEN 'imports' ELSE kind END AS kind, confidence FROM relationships),
    met AS (SELECT * FROM (SELECT asked, CASE WHEN path = asked THEN 0 WHEN qualified_name = asked THEN 1 WHEN path LIKE '%/' || asked THEN 2 END AS way, e.* FROM entities e, a WHERE repo_id = 'r1') WHERE way IS NOT NULL),
    prime AS (SELECT asked, id AS entity_id FROM met QUALIFY row_number() OVER (PARTITION BY asked ORDER BY way, start_line NULLS LAST, qualified_name, id) = 1),
    inside AS (SELECT * FROM met WHERE way <> 1 QUALIFY way = min(way) OVER (PARTITION BY asked)),
    ends AS (SELECT from_entity_id AS entity_id, to_entity_id AS other_id, id, kind, 'outgoing' AS direction FROM rel UNION ALL SELECT to_entity_id, from_entity_id, id, kind, 'incoming' FROM rel WHERE from_entity_id <> to_entity_id),
    edge AS (SELECT x.* FROM ends x WHERE entity_id IN (SELECT id FROM inside) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY id) <= 50),
    seen AS (SELECT i.asked, x.*, o.name AS other_name, o.qualified_name AS other_qualified, o.path AS other_path FROM edge x JOIN inside i ON i.id = x.entity_id LEFT JOIN entities o ON o.id = x.other_id),
    rel_files AS (SELECT asked, other_path, arg_min(CASE direction WHEN 'incoming' THEN 'depended on by ' ELSE 'depends on ' END || other_name, {{'id': id, 'd': direction}}) AS reason FROM seen s
        WHERE NOT (kind = 'imports' AND direction = 'outgoing') AND other_path IS NOT NULL AND other_path <> asked AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.asked = s.asked AND i.id = s.other_id) GROUP BY asked, other_path),
    ff AS (SELECT p.asked, f.* FROM prime p JOIN ({FIRST_FACTS}) f ON f.entity_id = p.entity_id)
    SELECT 'modules' AS section, a.asked AS asked, coalesce(entity_id, '-') AS item FROM a LEFT JOIN prime p ON p.asked = a.asked
    UNION ALL SELECT 'entities', asked, id FROM inside UNION ALL SELECT DISTINCT 'imports', asked, other_qualified FROM seen WHERE kind = 'imports' AND direction = 'outgoing' AND other_qualified IS NOT NULL
    UNION ALL SELECT 'related', asked, other_path || ': ' || reason FROM rel_files UNION ALL SELECT 'facts', asked, id FROM ff UNION ALL SELECT 'invariants', asked, id FROM ff WHERE category IN ('behavior', 'constraint', 'contract')
    UNION ALL SELECT 'dependents', asked, x.id FROM prime p JOIN (SELECT * FROM rel QUALIFY row_number() OVER (PARTITION BY to_entity_id ORDER BY id) <= 50) x ON x.to_entity_id = p.entity_id
    UNION ALL SELECT 'relationships', asked, x.id || ' ' || direction FROM prime p JOIN (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY id) <= 50) x ON x.entity_id = p.entity_id
    UNION ALL SELECT 'decisions', asked, x.decision_id FROM prime p JOIN (SELECT l.entity_id, l.decision_id FROM decision_entities l JOIN decisions d ON d.id = l.decision_id QUALIFY row_number() OVER (PARTITION BY l.entity_id ORDER BY created_at DESC, l.decision_id) <= 50) x ON x.entity_id = p.entity_id
    UNION ALL SELECT 'conventions', NULL, id FROM (SELECT id FROM facts WHERE superseded_by IS NULL AND category IN ('convention', 'pattern') AND confidence <> 'low' AND repo_id = 'r1' ORDER BY {DIM}, id LIMIT 20)
    UNION ALL SELECT 'staleness', NULL, 'commit_drift ' || (SELECT count(*) FROM jobs WHERE repo_id = 'r1' AND status IN ('pending', 'failed'))"""


@query("q08_task_context", TASK)
def _(g: G) -> DataFrame:
    """All parts of a task's context, as (section, asked, item)."""
    known = engine(g)
    known.tables["relationships"] = g.relationships.withColumn("kind", F.when((F.col("kind") == "calls") & (F.col("strength") == "weak"), "imports").otherwise(F.col("kind")))
    heads = g.repos.select(F.col("id").alias("repo_id"), F.lit("newer").alias("head_sha"))
    found = known.task_context("r1", FILES, deep=True, heads=heads, now=F.lit("2024-01-31 00:00:00").cast("timestamp"))
    item = {
        "modules": F.coalesce("entity_id", F.lit("-")), "imports": F.col("import"), "related": F.concat("other_path", F.lit(": "), "reason"), "decisions": F.col("decision_id"),
        "relationships": F.concat("id", F.lit(" "), "direction"), "staleness": F.concat("reasons", F.lit(" "), F.col("backlog").cast("string")),
    }
    parts = [df.select(F.lit(name).alias("section"), (F.col("asked") if "asked" in df.columns else F.lit(None).cast("string")).alias("asked"), item.get(name, F.col("id") if "id" in df.columns else None).alias("item")) for name, df in found.items()]
    return functools.reduce(DataFrame.unionByName, parts)


@query("q09_execution_flows", FLOWS.replace("SELECT seed, label, depth, n_steps FROM r WHERE k = 1 ORDER BY place DESC, seed LIMIT 200", "SELECT seed, label, depth FROM (SELECT * FROM r WHERE k = 1 ORDER BY place DESC, seed LIMIT 200) ORDER BY depth DESC, seed LIMIT 20"))
def _(g: G) -> DataFrame:
    return KnowledgeEngine({}, flows=flows_of(g)).execution_flows().select("seed", "label", "depth")


@query("q12_search_entities", "SELECT id FROM entities WHERE kind = 'service' AND (contains(lower(name), 'supplier1') OR contains(lower(qualified_name), 'supplier1')) ORDER BY qualified_name, id LIMIT 20")
def _(g: G) -> DataFrame:
    return engine(g).search_entities("supplier1", kind="service").select("id")


@query("join14_resolve", "SELECT id FROM entities WHERE repo_id = (SELECT repo_id FROM entities WHERE id = 's3') AND path LIKE '%/' || (SELECT list_last(string_split(path, '/')) FROM entities WHERE id = 's3') ORDER BY start_line NULLS LAST, qualified_name, id LIMIT 1")
def _(g: G) -> DataFrame:
    row = g.entities.where("id = 's3'").select("repo_id", F.element_at(F.split("path", "/"), -1).alias("f")).first()
    return engine(g).resolve(row.repo_id, row.f).select("id")


@query("q16_repo_details", """
    SELECT r.id, r.name, (SELECT count(*) FROM entities WHERE repo_id = r.id) AS entities, (SELECT count(*) FROM facts WHERE repo_id = r.id AND superseded_by IS NULL) AS facts,
           (SELECT count(*) FROM relationships WHERE repo_id = r.id) AS relationships, (SELECT count(*) FROM decisions WHERE repo_id = r.id) AS decisions,
           (SELECT quality_overall FROM runs WHERE repo_id = r.id ORDER BY created_at DESC, id DESC LIMIT 1) AS quality_overall FROM repos r""")
def _(g: G) -> DataFrame:
    return engine(g).repo_details()


@query("q17_entity_edges", "SELECT r.id, a.name AS from_name, b.name AS to_name FROM relationships r JOIN entities a ON r.from_entity_id = a.id JOIN entities b ON r.to_entity_id = b.id WHERE r.from_entity_id = 's3' OR r.to_entity_id = 's3'")
def _(g: G) -> DataFrame:
    return engine(g).entity_edges("s3").select("id", "from_name", "to_name")


CUT = """CASE WHEN strlen({0}) > 120 THEN left({0}, list_max(list_filter(range(0, 118), lambda k: strlen(left({0}, k)) <= 117))) || '...' ELSE {0} END"""
#: Each repository has an entity of its own, with capabilities, an architecture, and the conventions and risks of its facts; modules without a path have versions.
REPO_ENTITIES = """e AS (SELECT id, repo_id, kind, name, qualified_name, path, summary FROM entities UNION ALL SELECT 'R' || id, id, 'concept', name, name, NULL, 'All of ' || name FROM repos),
    fs AS (SELECT id, CASE WHEN category IN ('convention', 'risk') THEN 'R' || repo_id ELSE entity_id END AS entity_id, repo_id, CASE WHEN category = 'convention' AND confidence = 'high' THEN '[' || dimension || '] ' || claim ELSE claim END AS claim, dimension, category FROM facts WHERE superseded_by IS NULL
           UNION ALL SELECT 'A' || id, 'R' || id, id, 'Architecture: layers of ' || name, 'how', 'pattern' FROM repos
           UNION ALL SELECT 'V' || id, id, repo_id, 'Required at version 1.' || substr(id, 2), 'what', 'constraint' FROM entities WHERE kind = 'module' AND path IS NULL)"""


def described(g: G) -> KnowledgeEngine:
    known = engine(g)
    own = g.repos.select(F.concat(F.lit("R"), "id").alias("id"), F.col("id").alias("repo_id"), F.lit("concept").alias("kind"), "name", F.col("name").alias("qualified_name"), F.concat(F.lit("All of "), "name").alias("summary"), F.array(F.lit("trade"), F.concat(F.lit("for "), "name")).alias("capabilities"))
    e = g.entities.unionByName(own, allowMissingColumns=True)
    f = g.facts.withColumn("entity_id", F.when(F.col("category").isin("convention", "risk"), F.concat(F.lit("R"), "repo_id")).otherwise(F.col("entity_id")))
    f = f.withColumn("claim", F.when((F.col("category") == "convention") & (F.col("confidence") == "high"), F.concat(F.lit("["), "dimension", F.lit("] "), "claim")).otherwise(F.col("claim")))
    row = lambda df, i, e, repo, claim, dimension, category: df.select(i.alias("id"), e.alias("entity_id"), repo.alias("repo_id"), claim.alias("claim"), F.lit(dimension).alias("dimension"), F.lit(category).alias("category"))
    key = F.concat(F.lit("R"), "id")
    f = f.unionByName(row(g.repos, F.concat(F.lit("A"), "id"), key, F.col("id"), F.concat(F.lit("Architecture: layers of "), "name"), "how", "pattern"), allowMissingColumns=True)
    outer = g.entities.where("kind = 'module' and path is null")
    f = f.unionByName(row(outer, F.concat(F.lit("V"), "id"), F.col("id"), F.col("repo_id"), F.concat(F.lit("Required at version 1."), F.substring("id", 2, 9)), "what", "constraint"), allowMissingColumns=True)
    known.tables |= {"entities": e, "facts": f, "decisions": g.decisions.withColumn("rationale", F.concat(F.lit("as of "), F.col("nth").cast("string")))}
    return known


RICH = """rf AS (SELECT entity_id AS id, count(*) AS n FROM fs GROUP BY entity_id), rr AS (SELECT id, count(*) AS n FROM (SELECT from_entity_id AS id FROM relationships UNION ALL SELECT to_entity_id FROM relationships WHERE from_entity_id <> to_entity_id) GROUP BY id),
    core AS (SELECT e.*, row_number() OVER (ORDER BY coalesce(rf.n, 0) + coalesce(rr.n, 0) DESC, e.id) AS place FROM e LEFT JOIN rf ON rf.id = e.id LEFT JOIN rr ON rr.id = e.id WHERE repo_id = 'r1' AND NOT (kind = 'module' AND path IS NULL) {other})"""


@query("q18_overview", f"""
    WITH {REPO_ENTITIES}, {RICH.format(other="AND e.id <> 'Rr1'")},
    own AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {DIM}, id) AS place FROM fs WHERE entity_id = 'Rr1'),
    l AS (SELECT 'summary' AS section, 1 AS place, summary AS line FROM e WHERE id = 'Rr1'
          UNION ALL SELECT 'capabilities', k, '- ' || CASE k WHEN 1 THEN 'trade' ELSE 'for ' || name END FROM repos, range(1, 3) AS t(k) WHERE id = 'r1'
          UNION ALL SELECT 'architecture', 1, substr(claim, 15) FROM own WHERE category = 'pattern' AND claim LIKE 'Architecture: %'
          UNION ALL SELECT 'components', place, '| ' || qualified_name || ' | ' || kind || ' | ' || replace({CUT.format("coalesce(summary, '')")}, '|', '\\|') || ' |' FROM core WHERE place <= 15
          UNION ALL SELECT 'conventions', place, CASE WHEN regexp_matches(claim, '^\\[[^\\]]+\\] ') THEN '### ' || regexp_extract(claim, '^\\[([^\\]]+)\\] ', 1) || ': ' || substr(claim, strpos(claim, '] ') + 2) ELSE '- ' || claim END FROM own WHERE category = 'convention'
          UNION ALL SELECT 'dependencies', row_number() OVER (ORDER BY name, id), '- **' || name || '**: 1.' || substr(id, 2) FROM e WHERE repo_id = 'r1' AND kind = 'module' AND path IS NULL
          UNION ALL SELECT 'decisions', k, '- **' || summary || '**: as of ' || nth FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, id) AS k FROM decisions WHERE repo_id = 'r1' AND still_valid) WHERE k <= 10
          UNION ALL SELECT 'risks', place, '- ' || claim FROM own WHERE category = 'risk')
    SELECT section, place, line FROM l""")
def _(g: G) -> DataFrame:
    return described(g).overview("r1")


@query("q11_repo_overview", """SELECT name, '' AS overview, last_indexed_at, (SELECT count(*) FROM entities WHERE repo_id = 'r1') AS entities, (SELECT count(*) FROM facts WHERE repo_id = 'r1') AS facts,
    (SELECT count(*) FROM relationships WHERE repo_id = 'r1') AS relationships, (SELECT count(*) FROM decisions WHERE repo_id = 'r1') AS decisions FROM repos WHERE id = 'r1'""")
def _(g: G) -> DataFrame:
    return engine(g).repo_overview("r1")


@query("ph4_synthesis_input", f"""
    WITH {REPO_ENTITIES}, {RICH.format(other="")},
    ff AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY {DIM}, {CAT}, id) AS k FROM fs),
    t AS (SELECT entity_id, string_agg('- [' || dimension || '/' || category || '] ' || claim || chr(10), '' ORDER BY k) AS lines FROM ff WHERE k <= 5 GROUP BY entity_id)
    SELECT place, qualified_name, kind, '## ' || qualified_name || ' (' || kind || ')' || chr(10) || 'Summary: ' || coalesce(summary, '') || chr(10) || CASE WHEN core.id = 'Rr1' THEN 'Capabilities: trade, for ' || name || chr(10) ELSE '' END || coalesce(lines, '') AS section
    FROM core LEFT JOIN t ON t.entity_id = core.id WHERE place <= 60""")
def _(g: G) -> DataFrame:
    return described(g).synthesis_input("r1")


@query("ph5_summary_input", f"""
    WITH {REPO_ENTITIES}, {RICH.format(other="")},
    how AS (SELECT claim, row_number() OVER (ORDER BY place, {DIM}, {CAT}, fs.id) AS k FROM fs JOIN core ON core.id = fs.entity_id WHERE place <= 60 AND (category = 'pattern' OR dimension = 'how'))
    SELECT 'entities' AS part, place, '- ' || qualified_name || ' (' || kind || '): ' || coalesce(summary, '') AS line FROM core WHERE place <= 60
    UNION ALL SELECT 'facts', k, '- ' || claim FROM how WHERE k <= 40
    UNION ALL SELECT 'decisions', k, '- ' || summary || ': as of ' || nth FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, id) AS k FROM decisions WHERE repo_id = 'r1') WHERE k <= 10""")
def _(g: G) -> DataFrame:
    return described(g).summary_input("r1")


@query("q20_health", "SELECT 'repos' AS what, count(*) AS n FROM repos UNION ALL SELECT 'entities', count(*) FROM entities UNION ALL SELECT 'facts', count(*) FROM facts UNION ALL SELECT 'relationships', count(*) FROM relationships UNION ALL SELECT 'decisions', count(*) FROM decisions")
def _(g: G) -> DataFrame:
    return engine(g).health()


@query("q24_cross_repo_links", "SELECT id FROM cross_repo_relationships WHERE from_repo_id = 'r2' OR to_repo_id = 'r2'")
def _(g: G) -> DataFrame:
    return engine(g).cross_repo_links("r2").select("id")


@query("q27_chat_history", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role IN ('user', 'assistant')) WHERE k <= 3")
def _(g: G) -> DataFrame:
    return engine(g).chat_history(g.conversations, 3).select("conv_id", "turn")
