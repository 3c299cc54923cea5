"""Scans, filters, joins, aggregations, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.catalog.base import query
from lodestone.functions import names, scoring
from lodestone.operators import relational as R
from lodestone.schemas import ordinal
from lodestone.sources.graph import TestGraph as G

FACT = ["id", "entity_id", "repo_id", "dimension", "category", "confidence"]
ENT = ["id", "repo_id", "kind", "name", "qualified_name", "path"]
DIM = "CASE dimension WHEN 'what' THEN 1 WHEN 'how' THEN 2 WHEN 'why' THEN 3 ELSE 4 END"
CAT = "CASE category WHEN 'behavior' THEN 1 WHEN 'constraint' THEN 2 WHEN 'pattern' THEN 3 WHEN 'convention' THEN 4 WHEN 'debt' THEN 5 ELSE 6 END"


@query("src1_scan", "SELECT id, repo_id, kind, name, qualified_name, path FROM entities")
def _(g: G) -> DataFrame:
    return g.entities.select(*ENT)


@query("flt1_lookup", "SELECT id, repo_id, kind, name FROM entities WHERE name = 'Supplier7' AND kind = 'service'")
def _(g: G) -> DataFrame:
    return R.lookup(g.entities, name="Supplier7", kind="service").select("id", "repo_id", "kind", "name")


@query("flt2_by_ids", "SELECT id, kind, name FROM entities WHERE id IN (SELECT DISTINCT entity_id FROM facts)")
def _(g: G) -> DataFrame:
    return R.by_ids(g.entities, g.facts.select("entity_id")).select("id", "kind", "name")


@query("flt3_path_suffix", "SELECT id, path FROM entities WHERE path LIKE '%/nation\\_3.go' ESCAPE '\\'")
def _(g: G) -> DataFrame:
    return R.path_suffix(g.entities, "nation_3.go").select("id", "path")


@query("flt4_search_names", "SELECT id, qualified_name, (SELECT count(*) FROM entities WHERE contains(lower(name), 'widget') OR contains(lower(qualified_name), 'widget')) AS total FROM entities WHERE contains(lower(name), 'widget') OR contains(lower(qualified_name), 'widget') ORDER BY qualified_name, id LIMIT 20 OFFSET 10")
def _(g: G) -> DataFrame:
    found = R.search_names(g.entities, "Widget").select("id", "qualified_name")
    total = found.agg(F.count("*").alias("total"))
    return R.page(found, ["qualified_name", "id"], 20, 10).crossJoin(F.broadcast(total))


@query("flt5_facts_of_categories", f"SELECT id, dimension, category FROM facts WHERE superseded_by IS NULL AND category IN ('behavior', 'pattern') AND confidence <> 'low' ORDER BY {DIM}, id LIMIT 50")
def _(g: G) -> DataFrame:
    return R.facts_of_categories(g.facts, ["behavior", "pattern"], 50).select("id", "dimension", "category")


@query("flt6_without_vectors", "SELECT id FROM facts WHERE id NOT IN (SELECT id FROM fact_vectors WHERE embedding IS NOT NULL)")
def _(g: G) -> DataFrame:
    return R.without_vectors(g.facts, g.fact_vectors).select("id")


@query("flt8_ordered_list", "SELECT path, start_line, id, row_number() OVER (PARTITION BY path ORDER BY start_line NULLS LAST, qualified_name, id) AS place FROM entities WHERE path IS NOT NULL")
def _(g: G) -> DataFrame:
    order = Window.partitionBy("path").orderBy(F.col("start_line").asc_nulls_last(), "qualified_name", "id")
    return g.entities.where("path is not null").select("path", "start_line", "id", F.row_number().over(order).alias("place"))


@query("flt9_touching", "SELECT id, kind, strength FROM relationships WHERE from_entity_id = 'p7' OR to_entity_id = 'p7'")
def _(g: G) -> DataFrame:
    return R.touching(g.relationships, "p7").select("id", "kind", "strength")


@query("flt10_feedback_list", "SELECT id, fact_id, status FROM feedback WHERE status = 'pending'")
def _(g: G) -> DataFrame:
    return R.feedback_list(g.feedback, status="pending").select("id", "fact_id", "status")


@query("flt16_kind_filter", "SELECT id, kind FROM relationships WHERE kind IN ('calls', 'owns')")
def _(g: G) -> DataFrame:
    return g.relationships.where(F.array_contains(F.split(F.lit("calls,owns"), ","), F.col("kind"))).select("id", "kind")


@query("flt18_repo_scope", "SELECT id FROM repos WHERE id IN ('r1', 'r3') OR name = 'asia'")
def _(g: G) -> DataFrame:
    return g.repos.where(F.col("id").isin("r1", "r3")).unionByName(R.lookup(g.repos, name="asia")).select("id").distinct()


@query("join1_decisions_of", "SELECT d.id, d.summary, d.still_valid FROM decisions d JOIN decision_entities l ON d.id = l.decision_id WHERE l.entity_id = 'p7' ORDER BY d.created_at DESC, d.id LIMIT 50")
def _(g: G) -> DataFrame:
    return R.decisions_of(g.decisions, g.decision_entities, "p7", 50).select("id", "summary", "still_valid")


@query("join2_orphans", "SELECT id, kind FROM entities e WHERE path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM facts f WHERE f.entity_id = e.id AND f.superseded_by IS NULL)")
def _(g: G) -> DataFrame:
    return R.orphans(g.entities, g.facts).select("id", "kind")


@query("join3_isolated", "SELECT id, kind FROM entities WHERE id NOT IN (SELECT from_entity_id FROM relationships WHERE strength = 'weak' UNION SELECT to_entity_id FROM relationships WHERE strength = 'weak')")
def _(g: G) -> DataFrame:
    return R.entities_without_edges(g.entities, R.lookup(g.relationships, strength="weak")).select("id", "kind")


@query("join4_with_edges", "SELECT repo_id, count(*) AS n FROM entities WHERE id IN (SELECT from_entity_id FROM relationships UNION SELECT to_entity_id FROM relationships) GROUP BY repo_id")
def _(g: G) -> DataFrame:
    return R.counts(R.entities_with_edges(g.entities, g.relationships), "repo_id")


@query("join5_with_facts", "SELECT repo_id, count(*) AS n FROM entities WHERE id IN (SELECT entity_id FROM facts WHERE superseded_by IS NULL) GROUP BY repo_id")
def _(g: G) -> DataFrame:
    return R.counts(R.entities_with_facts(g.entities, g.facts), "repo_id")


@query("join6_recent_runs", "SELECT r.id, p.name, r.quality_overall FROM runs r JOIN repos p ON r.repo_id = p.id ORDER BY r.created_at DESC, r.id LIMIT 50")
def _(g: G) -> DataFrame:
    p = g.repos.select(F.col("id").alias("repo_id"), "name")
    return g.runs.orderBy(F.desc("created_at"), "id").limit(50).join(p, "repo_id").select("id", "name", "quality_overall")


@query("join7_edges_between", "SELECT id, kind FROM relationships WHERE from_entity_id IN (SELECT entity_id FROM facts) AND to_entity_id IN (SELECT entity_id FROM facts)")
def _(g: G) -> DataFrame:
    return R.edges_between(g.relationships, g.facts.select("entity_id")).select("id", "kind")


@query("join9_hydrate", "SELECT f.id, e.name AS entity_name, e.kind AS entity_kind, r.name AS repo_name FROM facts f JOIN entities e ON f.entity_id = e.id LEFT JOIN repos r ON f.repo_id = r.id")
def _(g: G) -> DataFrame:
    return R.hydrate(g.facts, g.entities, g.repos).select("id", "entity_name", "entity_kind", "repo_name")


ABOUT = "lower(d.summary || ' about ' || CASE d.nth % 4 WHEN 0 THEN 'nation_' || CAST(d.nth % 25 AS STRING) || ' plan' WHEN 1 THEN 'Supplier' || CAST(d.nth % 97 AS STRING) WHEN 2 THEN 'handleBUILDING' || CAST(d.nth % 211 AS STRING) ELSE '' END)"


@query("join10_mentions", f"SELECT d.id AS text_id, e.id AS entity_id FROM decisions d, entities e WHERE contains({ABOUT}, lower(e.name))")
def _(g: G) -> DataFrame:
    number = lambda n: (F.col("nth") % n).cast("string")
    about = F.when(F.col("nth") % 4 == 0, F.concat(F.lit("nation_"), number(25), F.lit(" plan"))).when(F.col("nth") % 4 == 1, F.concat(F.lit("Supplier"), number(97))).when(F.col("nth") % 4 == 2, F.concat(F.lit("handleBUILDING"), number(211))).otherwise("")
    texts = g.decisions.select(F.col("id").alias("text_id"), F.concat("summary", F.lit(" about "), about).alias("text"))
    return R.mentions_of_names(texts, g.entities)


@query("join11_match_repos", """
    WITH deps AS (SELECT DISTINCT 'github.com/org/' || lower(r_name) || suffix AS dependency FROM region, (VALUES ('', 1), ('-core', 2)) AS s(suffix, n)),
    d AS (SELECT dependency, split_part(dependency, '/', 3) AS dn FROM deps),
    m AS (SELECT dependency, r.id AS repo_id, row_number() OVER (PARTITION BY dependency ORDER BY CASE WHEN dn = lower(r.name) THEN 0 ELSE 1 END, length(r.name) DESC, r.id) AS k
          FROM d JOIN repos r ON dn = lower(r.name) OR contains(dn, lower(r.name)) OR (length(dn) >= 3 AND contains(lower(r.name), dn)))
    SELECT dependency, repo_id FROM m WHERE k = 1""")
def _(g: G) -> DataFrame:
    base = g.region.select(F.concat(F.lit("github.com/org/"), F.lower("r_name")).alias("x"))
    deps = base.select(F.explode(F.array("x", F.concat("x", F.lit("-core")))).alias("dependency")).distinct()
    return R.match_repos(deps, g.repos)


@query("join12_resolve_names", """
    WITH refs AS (SELECT DISTINCT q AS ref, caller FROM (
        SELECT CASE WHEN p_partkey % 3 = 0 THEN qualified_name WHEN p_partkey % 3 = 1 THEN name ELSE name || 'X' END AS q, CASE WHEN p_partkey % 2 = 0 THEN 'parts::x' ELSE 'other::y' END AS caller
        FROM part JOIN entities ON entities.id = 'p' || CAST(p_partkey AS STRING))),
    own AS (SELECT id, qualified_name, split_part(qualified_name, '::', 1) AS pkg, list_last(string_split(list_last(string_split(qualified_name, '::')), '.')) AS short FROM entities),
    uniq AS (SELECT short, min(id) AS id FROM own GROUP BY short HAVING count(*) = 1),
    f AS (SELECT ref, caller, o.id, 0 AS stage FROM refs JOIN own o ON o.qualified_name = ref
          UNION ALL SELECT ref, caller, o.id, 3 FROM refs JOIN own o ON o.short = ref AND o.pkg = split_part(caller, '::', 1)
          UNION ALL SELECT ref, caller, u.id, 5 FROM refs JOIN uniq u ON u.short = list_last(string_split(list_last(string_split(ref, '::')), '.')))
    SELECT ref, caller, arg_min(id, (stage, id)) AS entity_id, min(stage) AS stage FROM f GROUP BY ref, caller""")
def _(g: G) -> DataFrame:
    rows = g.part.join(g.entities, F.concat(F.lit("p"), F.col("p_partkey").cast("string")) == F.col("id"))
    k = F.col("p_partkey")
    ref = F.when(k % 3 == 0, F.col("qualified_name")).when(k % 3 == 1, F.col("name")).otherwise(F.concat("name", F.lit("X")))
    return R.resolve_names(rows.select(ref.alias("ref"), F.when(k % 2 == 0, "parts::x").otherwise("other::y").alias("caller")), g.entities)


@query("join15_duplicate_names", """
    WITH b AS (SELECT id || 'x' AS other_id, repo_id, kind, upper(replace(name, '_', '-')) AS name, qualified_name FROM entities)
    SELECT a.id, other_id FROM entities a JOIN b ON a.repo_id = b.repo_id AND a.kind = b.kind
      AND translate(a.name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ_- ', 'abcdefghijklmnopqrstuvwxyz') = translate(b.name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ_- ', 'abcdefghijklmnopqrstuvwxyz')
      AND regexp_replace(a.qualified_name, '\\.[^.]*$', '') = regexp_replace(b.qualified_name, '\\.[^.]*$', '') AND contains(a.qualified_name, '.') AND contains(b.qualified_name, '.')""")
def _(g: G) -> DataFrame:
    own = g.entities.where("contains(qualified_name, '.')")
    other = own.select(F.concat("id", F.lit("x")).alias("id"), "repo_id", "kind", F.upper(F.replace("name", F.lit("_"), F.lit("-"))).alias("name"), "qualified_name")
    return R.duplicate_names(own, other).select("id", "other_id")


@query("join17_stale_paths", "SELECT DISTINCT path FROM entities WHERE path IS NOT NULL AND path NOT IN (SELECT 'internal/svc/' || lower(n_name) || '.go' FROM nation)")
def _(g: G) -> DataFrame:
    now = g.nation.select(F.concat(F.lit("internal/svc/"), F.lower("n_name"), F.lit(".go")).alias("path"))
    return g.entities.where("path is not null").select("path").distinct().join(now, "path", "left_anti")


@query("agg1_entities_by_kind", "SELECT repo_id, kind, count(*) AS n FROM entities GROUP BY repo_id, kind")
def _(g: G) -> DataFrame:
    return R.counts(g.entities, "repo_id", "kind")


@query("agg2_active_facts", "SELECT repo_id, dimension, count(*) AS n FROM facts WHERE superseded_by IS NULL GROUP BY repo_id, dimension")
def _(g: G) -> DataFrame:
    return R.counts(R.active_facts(g.facts), "repo_id", "dimension")


@query("agg3_jobs_by_status", "SELECT phase, status, count(*) AS n FROM jobs GROUP BY phase, status")
def _(g: G) -> DataFrame:
    return R.counts(g.jobs, "phase", "status")


@query("agg4_pending_feedback", "SELECT fact_id, count(*) AS n FROM feedback WHERE status = 'pending' GROUP BY fact_id")
def _(g: G) -> DataFrame:
    return R.counts(R.lookup(g.feedback, status="pending"), "fact_id")


@query("agg5_count_distinct", "SELECT repo_id, count(DISTINCT entity_id) AS n FROM facts WHERE superseded_by IS NULL GROUP BY repo_id")
def _(g: G) -> DataFrame:
    return R.active_facts(g.facts).groupBy("repo_id").agg(F.countDistinct("entity_id").alias("n"))


@query("agg6_conditional_count", "SELECT phase, count(*) FILTER (WHERE status = 'completed') AS ok, count(*) FILTER (WHERE status IN ('completed', 'failed')) AS done FROM jobs GROUP BY phase")
def _(g: G) -> DataFrame:
    return g.jobs.groupBy("phase").agg(F.count_if(F.col("status") == "completed").alias("ok"), F.count_if(F.col("status").isin("completed", "failed")).alias("done"))


@query("agg8_counts", "SELECT 'repos' AS what, count(*) AS n FROM repos UNION ALL SELECT 'entities', count(*) FROM entities UNION ALL SELECT 'facts', count(*) FROM facts UNION ALL SELECT 'relationships', count(*) FROM relationships UNION ALL SELECT 'decisions', count(*) FROM decisions")
def _(g: G) -> DataFrame:
    return R.count_all(repos=g.repos, entities=g.entities, facts=g.facts, relationships=g.relationships, decisions=g.decisions)


@query("agg9_per_repo", "SELECT repo_id, count(*) AS n FROM decisions GROUP BY repo_id")
def _(g: G) -> DataFrame:
    return R.counts(g.decisions, "repo_id")


@query("agg13_quality", """
    WITH e AS (SELECT repo_id, count(*) AS total, count(*) FILTER (WHERE kind = 'module' AND path IS NULL) AS excluded FROM entities GROUP BY repo_id),
    f AS (SELECT repo_id, count(*) AS facts, count(DISTINCT dimension) AS dims FROM facts WHERE superseded_by IS NULL GROUP BY repo_id),
    wf AS (SELECT repo_id, count(*) AS with_facts FROM entities WHERE id IN (SELECT entity_id FROM facts WHERE superseded_by IS NULL) GROUP BY repo_id),
    wr AS (SELECT repo_id, count(*) AS with_rels FROM entities WHERE id IN (SELECT from_entity_id FROM relationships UNION SELECT to_entity_id FROM relationships) GROUP BY repo_id),
    j AS (SELECT repo_id, count(*) FILTER (WHERE status = 'completed') AS ok, count(*) AS jobs FROM jobs GROUP BY repo_id),
    a AS (SELECT e.repo_id, greatest(0, total - excluded)::DOUBLE AS nd, coalesce(facts, 0) AS facts, coalesce(dims, 0) AS dims, coalesce(with_facts, 0) AS wf, coalesce(with_rels, 0) AS wr, coalesce(ok, 0) AS ok, coalesce(jobs, 0) AS jobs
          FROM e LEFT JOIN f USING (repo_id) LEFT JOIN wf USING (repo_id) LEFT JOIN wr USING (repo_id) LEFT JOIN j USING (repo_id)),
    b AS (SELECT repo_id, CASE WHEN nd > 0 THEN least(1, wf / nd) * 100 ELSE 0 END AS entity_cov, CASE WHEN nd = 0 THEN 0 WHEN facts / nd < 1.5 THEN facts / nd / 1.5 * 100 WHEN facts / nd > 8 THEN greatest(50, 100 - (facts / nd - 8) * 6.25) ELSE 100 END AS fact_density,
          CASE WHEN nd > 0 THEN least(1, wr / nd) * 100 ELSE 0 END AS rel_connect, dims / 4 * 100 AS dim_coverage, CASE WHEN jobs > 0 THEN ok / jobs * 100 ELSE 100 END AS parse_rate FROM a)
    SELECT repo_id, round(entity_cov, 6) AS entity_cov, round(fact_density, 6) AS fact_density, round(rel_connect, 6) AS rel_connect, round(dim_coverage, 6) AS dim_coverage, round(parse_rate, 6) AS parse_rate,
           round(greatest(0, least(100, entity_cov * 0.3 + fact_density * 0.2 + rel_connect * 0.2 + dim_coverage * 0.15 + parse_rate * 0.15)), 6) AS overall FROM b""")
def _(g: G) -> DataFrame:
    found = R.quality(g.entities, g.facts, g.relationships, g.jobs)
    return found.select("repo_id", *[F.round(c, 6).alias(c) for c in found.columns if c != "repo_id"])


@query("agg15_richness", """
    WITH f AS (SELECT entity_id AS id, count(*) AS n FROM facts WHERE superseded_by IS NULL GROUP BY entity_id),
    r AS (SELECT id, count(*) AS n FROM (SELECT from_entity_id AS id FROM relationships UNION ALL SELECT to_entity_id FROM relationships WHERE from_entity_id <> to_entity_id) GROUP BY id)
    SELECT e.id, coalesce(f.n, 0) + coalesce(r.n, 0) AS richness FROM entities e LEFT JOIN f ON e.id = f.id LEFT JOIN r ON e.id = r.id ORDER BY richness DESC, e.id LIMIT 60""")
def _(g: G) -> DataFrame:
    return R.richness(g.entities, g.facts, g.relationships).orderBy(F.desc("richness"), "id").limit(60).select("id", "richness")


@query("agg18_backlog", "SELECT repo_id, count(*) FILTER (WHERE status IN ('pending', 'failed')) AS backlog FROM jobs GROUP BY repo_id")
def _(g: G) -> DataFrame:
    return g.jobs.groupBy("repo_id").agg(F.count_if(F.col("status").isin("pending", "failed")).alias("backlog"))


@query("agg19_orphans_by_file", "SELECT path, count(*) AS n, min(id) AS first_id FROM entities e WHERE path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM facts f WHERE f.entity_id = e.id AND f.superseded_by IS NULL) GROUP BY path")
def _(g: G) -> DataFrame:
    return R.orphans(g.entities, g.facts).groupBy("path").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("agg20_histogram", "SELECT phase, " + ", ".join(f"count(*) FILTER (WHERE tokens_used <= {b}) AS le_{b}" for b in (5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000)) + ", CAST(sum(tokens_used) AS BIGINT) AS sum, count(tokens_used) AS count FROM jobs GROUP BY phase")
def _(g: G) -> DataFrame:
    return R.histogram(g.jobs, "tokens_used", (5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000), "phase")


@query("agg21_distinct_paths", "SELECT DISTINCT path FROM entities WHERE path IS NOT NULL")
def _(g: G) -> DataFrame:
    return g.entities.where("path is not null").select("path").distinct()


@query("top1_order_limit", "SELECT id, duration_ms FROM runs ORDER BY duration_ms DESC, id LIMIT 40")
def _(g: G) -> DataFrame:
    return g.runs.orderBy(F.desc("duration_ms"), "id").limit(40).select("id", "duration_ms")


@query("top3_facts_of_entities", f"SELECT id, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY {DIM}, {CAT}, id) AS k FROM facts WHERE superseded_by IS NULL) WHERE k <= 3")
def _(g: G) -> DataFrame:
    return R.facts_of_entities(g.facts, 3).select("id", "entity_id")


@query("top4_diversify", "WITH s AS (SELECT id, repo_id, duration_ms AS score, row_number() OVER (PARTITION BY repo_id ORDER BY duration_ms DESC, id) AS k FROM runs) SELECT id, repo_id, score FROM s ORDER BY CASE WHEN k > 13 THEN 1 ELSE 0 END, score DESC, id LIMIT 40")
def _(g: G) -> DataFrame:
    return R.diversify(g.runs.select("id", "repo_id", F.col("duration_ms").alias("score")), 40)


@query("top5_latest", "SELECT repo_id, created_at, id, quality_overall FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, id DESC) AS k FROM runs) WHERE k = 1")
def _(g: G) -> DataFrame:
    return R.latest(g.runs.select("repo_id", "created_at", "id", "quality_overall"), "repo_id", "created_at")


@query("top6_trend", "SELECT id, repo_id, quality_overall - lag(quality_overall) OVER (PARTITION BY repo_id ORDER BY created_at, id) AS change FROM runs")
def _(g: G) -> DataFrame:
    return R.trend(g.runs).select("id", "repo_id", "change")


@query("top7_end_lines", "SELECT id, lead(start_line) OVER (PARTITION BY repo_id, path ORDER BY start_line, id) - 1 AS end_line FROM entities WHERE path IS NOT NULL AND start_line IS NOT NULL")
def _(g: G) -> DataFrame:
    return R.end_lines(g.entities.where("path is not null and start_line is not null")).select("id", "end_line")


@query("top8_first_per_path", "SELECT path, id FROM (SELECT path, id, row_number() OVER (PARTITION BY path ORDER BY start_line NULLS LAST, qualified_name, id) AS k FROM entities WHERE path IS NOT NULL) WHERE k = 1")
def _(g: G) -> DataFrame:
    return R.distinct_first(g.entities.where("path is not null"), F.col("path"), [F.col("start_line").asc_nulls_last(), "qualified_name", "id"]).select("path", "id")


@query("top9_ordered_dedup", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY dimension || ':' || lower(trim(claim)) ORDER BY id) AS k FROM facts WHERE category = 'convention') WHERE k = 1")
def _(g: G) -> DataFrame:
    key = F.concat("dimension", F.lit(":"), F.lower(F.trim("claim")))
    return R.distinct_first(g.facts.where("category = 'convention'"), key, ["id"]).select("id")


@query("set1_union_edges", "SELECT id, repo_id, kind FROM relationships UNION ALL SELECT id, from_repo_id, kind FROM cross_repo_relationships")
def _(g: G) -> DataFrame:
    from lodestone.operators.graph import all_edges

    return all_edges(g.relationships, g.cross_repo_relationships).select("id", "repo_id", "kind")


@query("set4_membership", "SELECT id FROM facts WHERE id IN (SELECT fact_id FROM feedback) AND id NOT IN (SELECT fact_id FROM feedback WHERE status = 'pending')")
def _(g: G) -> DataFrame:
    seen = g.facts.join(g.feedback.select(F.col("fact_id").alias("id")), "id", "left_semi")
    return seen.join(g.feedback.where("status = 'pending'").select(F.col("fact_id").alias("id")), "id", "left_anti").select("id")


@query("set5_ordered_union", "SELECT id, kind || '|' || repo_id AS tags FROM entities")
def _(g: G) -> DataFrame:
    tags = F.array_distinct(F.concat(F.array("kind", "repo_id"), F.array("kind")))
    return g.entities.select("id", F.array_join(tags, "|").alias("tags"))


@query("str_names", r"""
    SELECT id, translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ_- ', 'abcdefghijklmnopqrstuvwxyz') AS norm, split_part(qualified_name, '::', 1) AS package,
           CASE WHEN contains(qualified_name, '.') THEN regexp_replace(qualified_name, '\.[^.]*$', '') ELSE split_part(qualified_name, '::', 1) END AS owner,
           list_last(string_split(list_last(string_split(qualified_name, '::')), '.')) AS short,
           CASE WHEN path IS NULL THEN NULL ELSE replace(regexp_replace(regexp_extract(path, '^(.*)/[^/]*$', 1), '^(src|internal|pkg)/', ''), '/', '.') END AS module FROM entities""")
def _(g: G) -> DataFrame:
    q = F.col("qualified_name")
    return g.entities.select(
        "id", names.normalize_name(F.col("name")).alias("norm"), names.package_of(q).alias("package"), names.owner_of(q).alias("owner"),
        names.short_name(q).alias("short"), names.module_name(F.col("path")).alias("module"),
    )


@query("str9_urls", r"SELECT page_id, list_last(regexp_split_to_array(regexp_replace(regexp_replace(url, '/+$', ''), '\.git$', ''), '[/:]')) AS repo FROM pages")
def _(g: G) -> DataFrame:
    return g.pages.select("page_id", names.repo_name_of_url(F.col("url")).alias("repo"))


@query("str10_tokens", r"SELECT id, array_to_string(list_filter(string_split_regex(lower(regexp_replace(name, '([a-z])([A-Z])', '\1 \2', 'g')), '[ _\-.:/]+'), lambda x: x <> ''), ' ') AS words FROM entities WHERE kind IN ('type', 'service')")
def _(g: G) -> DataFrame:
    return g.entities.where("kind in ('type', 'service')").select("id", F.array_join(names.name_tokens(F.col("name")), " ").alias("words"))


@query("str11_truncate", "SELECT id, CASE WHEN strlen(claim) > 120 THEN left(claim, list_max(list_filter(range(0, 118), lambda k: strlen(left(claim, k)) <= 117))) || '...' ELSE claim END AS shown, replace(substr(claim, 1, 40), '|', '\\|') AS cell FROM facts")
def _(g: G) -> DataFrame:
    return g.facts.select("id", names.truncate(F.col("claim"), 120).alias("shown"), names.escape_pipes(F.substring("claim", 1, 40)).alias("cell"))


@query("str14_relation_confidence", "SELECT id, greatest(0.0, least(1.0, confidence + CASE strength WHEN 'strong' THEN 0.05 WHEN 'weak' THEN -0.05 ELSE 0.0 END))::DOUBLE AS c FROM relationships")
def _(g: G) -> DataFrame:
    return g.relationships.select("id", scoring.relation_confidence(F.col("confidence").cast("double"), F.col("strength")).alias("c"))


@query("ma6_budgets", "SELECT doc_id, greatest(512, 32000 - 4096 - CAST(floor(n_chars / 4) AS BIGINT)) * 4 AS prompt, least(4096 + 300 * (doc_id % 40), 12800)::BIGINT AS output FROM documents")
def _(g: G) -> DataFrame:
    return g.documents.select(
        "doc_id", scoring.prompt_budget(F.lit(32000), F.lit(4096), F.col("n_chars")).alias("prompt"), scoring.output_budget(F.col("doc_id") % 40, F.lit(32000)).alias("output")
    )


@query("ma7_job_cost", "SELECT id, tokens_used / 1e6::DOUBLE * 3 + tokens_used / 2e6::DOUBLE * 15 AS cost FROM jobs")
def _(g: G) -> DataFrame:
    return g.jobs.select("id", (F.col("tokens_used") / 1e6 * 3 + F.col("tokens_used") / 2e6 * 15).alias("cost"))


@query("js2_sanitize", "SELECT event_id, CASE WHEN lower(trim(event_type)) IN ('view') THEN 'what' ELSE 'what' END AS dimension, event_type NOT IN ('what', 'how', 'why', 'when') AS fell_back FROM events")
def _(g: G) -> DataFrame:
    from lodestone.schemas import DOMAINS, in_domain

    return g.events.select("event_id", in_domain("dimension", F.col("event_type"), "what").alias("dimension"), (~F.col("event_type").isin(*DOMAINS["dimension"])).alias("fell_back"))


@query("js3_payload", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def _(g: G) -> DataFrame:
    return g.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("dt1_dates", "SELECT o_orderkey, o_orderdate AS at FROM orders")
def _(g: G) -> DataFrame:
    return g.orders.select("o_orderkey", names.parse_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("at"))


@query("hs1_sha256", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def _(g: G) -> DataFrame:
    return g.documents.select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("dt_ordinals", f"SELECT id, {DIM} AS dimension_order, {CAT} AS category_order FROM facts")
def _(g: G) -> DataFrame:
    return g.facts.select("id", ordinal("dimension", F.col("dimension")).cast("int").alias("dimension_order"), ordinal("category", F.col("category")).cast("int").alias("category_order"))


@query("sr23_staleness", """
    SELECT id AS repo_id, never OR old OR drift AS stale, CASE WHEN never THEN 'never_indexed' ELSE concat_ws(',', CASE WHEN old THEN 'index_age' END, CASE WHEN drift THEN 'commit_drift' END) END AS reasons
    FROM (SELECT id, last_indexed_at IS NULL AS never, coalesce(last_indexed_at < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY, false) AS old,
                 coalesce(last_commit_sha IS NOT NULL AND id IN ('r1', 'r2'), false) AS drift FROM repos)""")
def _(g: G) -> DataFrame:
    head = F.when(F.col("id").isin("r1", "r2"), "newer").otherwise(F.col("last_commit_sha"))
    heads = g.repos.select(F.col("id").alias("repo_id"), head.alias("head_sha"))
    return R.staleness(g.repos, heads, F.lit("2024-01-31 00:00:00").cast("timestamp"))
