"""Writes, files, manifests and extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.catalog.base import query
from lodestone.operators import store as ST
from lodestone.plans import extraction as X
from lodestone.sources import files as FS
from lodestone.sources.graph import TestGraph as G

CONF = "CASE strength WHEN 'strong' THEN 0.9 WHEN 'moderate' THEN 0.75 ELSE 0.55 END"


@query("dml2_upsert_entities", """
    SELECT e.repo_id, e.qualified_name, e.kind, CASE WHEN e.kind = 'service' AND e.id LIKE 's1%' THEN coalesce('new ' || e.id, e.summary) ELSE e.summary END AS summary FROM entities e
    UNION ALL SELECT repo_id, qualified_name || 'New', 'concept', 'fresh' FROM entities WHERE kind = 'module'""")
def _(g: G) -> DataFrame:
    old = g.entities.select("repo_id", "qualified_name", "kind", "summary")
    changed = g.entities.where("kind = 'service' and id like 's1%'").select("repo_id", "qualified_name", F.lit("endpoint").alias("kind"), F.concat(F.lit("new "), "id").alias("summary"))
    fresh = g.entities.where("kind = 'module'").select("repo_id", F.concat("qualified_name", F.lit("New")).alias("qualified_name"), F.lit("concept").alias("kind"), F.lit("fresh").alias("summary"))
    return ST.upsert_entities(old, changed.unionByName(fresh))


@query("dml3_upsert_relationships", "SELECT repo_id, from_entity_id, to_entity_id, kind, CASE WHEN kind = 'owns' THEN 'weak' ELSE strength END AS strength, greatest(confidence, CASE WHEN kind = 'owns' THEN 0.8 ELSE 0 END)::DOUBLE AS confidence FROM relationships")
def _(g: G) -> DataFrame:
    old = g.relationships.select("repo_id", "from_entity_id", "to_entity_id", "kind", "strength", F.col("confidence").cast("double").alias("confidence"))
    new = old.where("kind = 'owns'").withColumn("strength", F.lit("weak")).withColumn("confidence", F.lit(0.8))
    return ST.upsert_relationships(old, new)


@query("dml6_insert_absent", "SELECT repo_id, phase, target FROM (SELECT DISTINCT repo_id, phase, target FROM jobs) UNION SELECT repo_id, 'phase2', path FROM entities WHERE path IS NOT NULL")
def _(g: G) -> DataFrame:
    old = g.jobs.select("repo_id", "phase", "target").distinct()
    new = g.entities.where("path is not null").select("repo_id", F.lit("phase2").alias("phase"), F.col("path").alias("target"))
    return ST.insert_absent(old, new, ["repo_id", "phase", "target"])


@query("dml7_update_by_key", "SELECT f.id, CASE WHEN b.fact_id IS NOT NULL THEN 'low' ELSE confidence END AS confidence FROM facts f LEFT JOIN (SELECT DISTINCT fact_id FROM feedback WHERE status = 'pending') b ON f.id = b.fact_id")
def _(g: G) -> DataFrame:
    delta = g.feedback.where("status = 'pending'").select(F.col("fact_id").alias("id"), F.lit("low").alias("confidence")).distinct()
    return ST.update_by_key(g.facts.select("id", "confidence"), delta)


@query("dml8_delete_cascade", "SELECT 'entities' AS what, count(*) AS n FROM entities WHERE kind <> 'service' UNION ALL SELECT 'facts', count(*) FROM facts UNION ALL SELECT 'relationships', count(*) FROM relationships WHERE from_entity_id NOT LIKE 's%' AND to_entity_id NOT LIKE 's%'")
def _(g: G) -> DataFrame:
    from lodestone.operators.relational import count_all

    left = ST.delete_entities({"entities": g.entities, "facts": g.facts, "relationships": g.relationships}, g.entities.where("kind = 'service'").select("id"))
    return count_all(**left)


@query("dml9_delete_repo", "SELECT 'repos' AS what, count(*) AS n FROM repos WHERE id <> 'r1' UNION ALL SELECT 'facts', count(*) FROM facts WHERE repo_id <> 'r1' UNION ALL SELECT 'cross', count(*) FROM cross_repo_relationships WHERE from_repo_id <> 'r1' AND to_repo_id <> 'r1'")
def _(g: G) -> DataFrame:
    from lodestone.operators.relational import count_all

    return count_all(**ST.delete_repo({"repos": g.repos, "facts": g.facts, "cross": g.cross_repo_relationships}, "r1"))


@query("dml11_claim_jobs", "SELECT id, CASE WHEN status = 'pending' AND row_number() OVER (PARTITION BY repo_id, phase, status = 'pending' ORDER BY created_at, id) <= 5 THEN 'in_progress' ELSE status END AS status FROM jobs")
def _(g: G) -> DataFrame:
    return ST.claim_jobs(g.jobs, 5).select("id", "status")


@query("dml12_finish_and_reset", "SELECT id, CASE WHEN status = 'in_progress' AND id % 3 = 0 THEN 'pending' WHEN status = 'in_progress' THEN 'completed' WHEN status = 'failed' THEN 'pending' ELSE status END AS status FROM jobs")
def _(g: G) -> DataFrame:
    done = g.jobs.where("status = 'in_progress'").select("id", F.when(F.col("id") % 3 == 0, "broken").alias("error_message"))
    return ST.reset_failed(ST.finish_jobs(g.jobs, done)).select("id", "status")


@query("dml13_feedback", """
    WITH j AS (SELECT repo_id, target, min(status) AS status FROM jobs WHERE phase = 'phase2' GROUP BY repo_id, target),
    r AS (SELECT DISTINCT repo_id, ref AS target FROM facts WHERE id IN (SELECT fact_id FROM feedback WHERE status = 'pending'))
    SELECT coalesce(j.repo_id, r.repo_id) AS repo_id, 'phase2' AS phase, coalesce(j.target, r.target) AS target, CASE WHEN r.target IS NOT NULL AND coalesce(j.status, '') <> 'in_progress' THEN 'pending' ELSE j.status END AS status
    FROM j FULL JOIN r ON j.repo_id = r.repo_id AND j.target = r.target""")
def _(g: G) -> DataFrame:
    facts = g.facts.select("id", "repo_id", "confidence", F.array("ref", F.concat(F.lit(" "), "ref")).alias("refs"))
    jobs = g.jobs.where("phase = 'phase2'").groupBy("repo_id", "phase", "target").agg(F.min("status").alias("status"))
    return ST.submit_feedback(facts, jobs, g.feedback.where("status = 'pending'"))[1]


@query("dml14_newest_of_each", "SELECT id, repo_id FROM (SELECT id, repo_id, row_number() OVER (PARTITION BY repo_id, duration_ms % 50 ORDER BY created_at DESC, id) AS k FROM runs) WHERE k = 1")
def _(g: G) -> DataFrame:
    rows = g.runs.select("id", "repo_id", (F.col("duration_ms") % 50).alias("part"), F.col("created_at").alias("updated_at"))
    return ST.newest_of_each(rows, ["repo_id", "part"]).select("id", "repo_id")


@query("dml15_backfill_confidence", f"SELECT id, {CONF}::DOUBLE AS confidence FROM relationships")
def _(g: G) -> DataFrame:
    return ST.backfill_confidence(g.relationships.withColumn("confidence", F.lit(0.0))).select("id", "confidence")


@query("s9_queue_changed", "SELECT coalesce(source, '') AS target, CASE WHEN count(*) % 2 = 0 THEN 'completed' ELSE 'pending' END AS status FROM documents GROUP BY source")
def _(g: G) -> DataFrame:
    now = g.documents.groupBy(F.coalesce("source", F.lit("")).alias("target")).agg(F.count("*").alias("n")).withColumn("repo_id", F.lit("r0")).withColumn("content_hash", F.sha2(F.col("n").cast("string"), 256))
    before = now.select("repo_id", "target", F.when(F.col("n") % 2 == 0, F.col("content_hash")).otherwise("old").alias("content_hash"), F.lit("completed").alias("status"))
    return ST.queue_changed(before, now).select("target", "status")


FIELDS_OF_ENTITIES = " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("id", "kind", "name", "path", "qualified_name", "repo_id", "start_line", "summary"))


@query("dml17_fingerprint", f"""WITH h AS (SELECT sha256({FIELDS_OF_ENTITIES}) AS h FROM entities)
    SELECT sha256(count(*)::VARCHAR || ':' || (sum(('0x' || substr(h, 1, 15))::HUGEINT) % {ST.PRIMES[0]})::HUGEINT::VARCHAR || ':' || (sum(('0x' || substr(h, 16, 15))::HUGEINT) % {ST.PRIMES[1]})::HUGEINT::VARCHAR) AS etag FROM h""")
def _(g: G) -> DataFrame:
    return ST.fingerprint(g.entities)


@query("flt11_exclude", "SELECT DISTINCT path FROM entities WHERE path IS NOT NULL AND path NOT LIKE 'pkg/parts/%' AND NOT regexp_matches(path, '(^|/)svc_1[^/]*\\.go(/|$)')")
def _(g: G) -> DataFrame:
    return FS.exclude(g.entities.where("path is not null").select("path").distinct(), ["pkg/parts"], ["svc_1*.go", "# comment", ""])


#: folder, what it makes of its files; base name, class, language, test by name, manifest, class comes after the test rule.
FOLDERS = (("internal/svc", "plain"), ("Vendor/x", "vendored"), ("dist", "vendored"), ("docs/guide", "plain"), ("Tests/unit", "test"), ("specs", "test"), ("src/pkg", "plain"), ("plugins/a", "vendored"))
BASES = (
    ("main.go", "source", "go", False, False, True), ("go.mod", "build", None, False, True, False), ("yarn.lock", "ignored", None, False, True, False), ("a.pb.go", "generated", None, False, False, False),
    ("b_pb2.py", "generated", None, False, False, False), ("x_gen.go", "generated", None, False, False, False), ("tsconfig.json", "config", None, False, False, False), ("conf.YAML", "config", "yaml", False, False, False),
    ("setup.cfg", "config", "ini", False, False, False), ("Cargo.toml", "build", None, False, True, False), ("app.toml", "config", "toml", False, False, False), ("README.md", "doc", "markdown", False, False, False),
    ("test_a.py", "test", "python", True, False, True), ("a_test.go", "test", "go", True, False, True), ("b.spec.ts", "test", "typescript", True, False, True), ("c.test.js", "test", "javascript", True, False, True),
    ("data.json", "data", None, False, False, True), ("d.csv", "data", None, False, False, True), ("logo.PNG", "ignored", None, False, False, False), ("script.zsh", "source", "shell", False, False, True),
    ("infra.tf", "source", "terraform", False, False, True), ("noext", "ignored", None, False, False, True), ("Dockerfile", "config", None, False, True, False), ("weird.xyz", "ignored", None, False, False, True),
    ("build.gradle.kts", "ignored", None, False, True, True), ("App.CSPROJ", "ignored", None, False, True, True), ("composer.json", "data", None, False, True, True), ("v.kt", "source", "kotlin", False, False, True),
    ("package.json", "build", None, False, True, False), ("next.config.mjs", "config", None, False, False, False), ("vite.config.ts", "config", None, False, False, False),
    ("t.tmpl", "source", "gotemplate", False, False, True), ("api.generated.ts", "generated", None, False, False, False),
)


def _sql(rows: tuple) -> str:
    cell = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, (bool, int)) else f"'{x}'"
    return ", ".join(f"({i}, {', '.join(map(cell, r))})" for i, r in enumerate(rows))


#: The parts as files: a folder and a base name by key, the part's size as size; with what is known of them.
FILES = f"""
    d AS (SELECT * FROM (VALUES {_sql(FOLDERS)}) AS t(k, dir, makes)),
    b AS (SELECT * FROM (VALUES {_sql(BASES)}) AS t(k, base, class, lang, by_name, manifest, late)),
    files AS (SELECT dir || '/' || base AS path, p_size AS size, by_name OR makes = 'test' AS test, manifest,
                     CASE WHEN makes = 'vendored' THEN 'vendored' WHEN makes = 'test' AND late THEN 'test' ELSE class END AS class, CASE WHEN makes <> 'vendored' THEN lang END AS language
              FROM part JOIN d ON d.k = p_partkey % {len(FOLDERS)} JOIN b ON b.k = CAST(floor(p_partkey / {len(FOLDERS)}) AS BIGINT) % {len(BASES)})"""


def _files(g: G) -> DataFrame:
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    folder = pick([d for d, _ in FOLDERS], F.col("p_partkey") % len(FOLDERS))
    base = pick([b[0] for b in BASES], F.floor(F.col("p_partkey") / len(FOLDERS)) % len(BASES))
    return g.part.select(F.concat(folder, F.lit("/"), base).alias("path"), F.col("p_size").alias("size"))


@query("flt12_classify", f"WITH {FILES} SELECT DISTINCT path, class, language FROM files")
def _(g: G) -> DataFrame:
    return X.inventory(_files(g).select("path").distinct()).select("path", "class", "language")


@query("agg11_manifest", f"WITH {FILES} SELECT class, language, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY ALL")
def _(g: G) -> DataFrame:
    return X.inventory_stats(X.inventory(_files(g)))


@query("agg14_cost", f"WITH {FILES} SELECT count(*) AS files, CAST(sum(floor(size / 4) + 1500) AS BIGINT) AS tokens FROM files WHERE class IN ('source', 'config', 'doc', 'build')")
def _(g: G) -> DataFrame:
    return X.cost_estimate(X.inventory(_files(g)))


@query("gr15_repair_owners", r"""
    WITH m AS (SELECT *, regexp_replace(qualified_name, '\.[^.]*$', '') AS owner FROM entities WHERE contains(qualified_name, '.')),
    o AS (SELECT DISTINCT repo_id, owner FROM m WHERE owner LIKE 'parts::Brand1%'), e AS (SELECT * FROM relationships WHERE kind = 'depends_on')
    SELECT o.repo_id || ':' || o.owner AS from_entity_id, m.id AS to_entity_id, 'owns' AS kind FROM m JOIN o ON m.repo_id = o.repo_id AND m.owner = o.owner
    WHERE m.id NOT IN (SELECT from_entity_id FROM e) AND m.id NOT IN (SELECT to_entity_id FROM e)""")
def _(g: G) -> DataFrame:
    owner = F.regexp_replace("qualified_name", r"\.[^.]*$", "")
    owners = g.entities.where("contains(qualified_name, '.')").select("repo_id", owner.alias("qualified_name")).where("qualified_name like 'parts::Brand1%'").distinct()
    owners = owners.withColumn("id", F.concat("repo_id", F.lit(":"), "qualified_name")).withColumn("kind", F.lit("module"))
    return X.repair_owners(g.entities.unionByName(owners, allowMissingColumns=True), g.relationships.where("kind = 'depends_on'"))


#: Functions of types within types that are not stored, and references to what exists, to what is made in the first and second round, and to nothing.
NESTED = "CASE WHEN kind = 'function' THEN regexp_replace(qualified_name, '\\.handle', '.Inner' || CAST(start_line % 7 AS STRING) || '.handle') ELSE qualified_name END"
REFERRED = "CASE start_line % 5 WHEN 0 THEN 'geo::NATION_1' WHEN 1 THEN 'mkt::MACHINERY.Inner' || CAST(start_line % 7 AS STRING) WHEN 2 THEN 'mkt::MACHINERY' WHEN 3 THEN 'mkt::BUILDING::Inner' || CAST(start_line % 7 AS STRING) ELSE 'nothing::there' END"


@query("gr17_backfill", rf"""
    WITH k AS (SELECT id, repo_id, {NESTED} AS qualified_name FROM entities),
    alone AS (SELECT * FROM k WHERE id NOT IN (SELECT from_entity_id FROM relationships WHERE kind = 'depends_on') AND id NOT IN (SELECT to_entity_id FROM relationships WHERE kind = 'depends_on')),
    w AS (SELECT id, repo_id, qualified_name, regexp_replace(qualified_name, '\.[^.]*$', '') AS owner FROM alone WHERE contains(qualified_name, '.')
          UNION SELECT 'own:' || repo_id || ':' || owner, repo_id, owner, regexp_replace(owner, '\.[^.]*$', '') FROM w WHERE contains(qualified_name, '.') AND NOT EXISTS (SELECT 1 FROM k WHERE k.repo_id = w.repo_id AND k.qualified_name = w.owner)),
    names AS (SELECT id, repo_id, qualified_name FROM k UNION SELECT id, repo_id, qualified_name FROM w),
    r AS (SELECT repo_id, qualified_name AS from_name, replace({REFERRED}, 'BUILDING::', 'BUILDING.') AS to_name FROM entities WHERE kind = 'service')
    SELECT n.id AS from_entity_id, w.id AS to_entity_id, 'owns' AS kind FROM w JOIN names n ON n.repo_id = w.repo_id AND n.qualified_name = w.owner WHERE contains(w.qualified_name, '.')
    UNION SELECT a.id, b.id, 'calls' FROM r JOIN names a ON a.repo_id = r.repo_id AND a.qualified_name = from_name JOIN names b ON b.repo_id = r.repo_id AND b.qualified_name = to_name WHERE a.id <> b.id""")
def _(g: G) -> DataFrame:
    entities = g.entities.withColumn("qualified_name", F.expr(NESTED))
    references = g.entities.where("kind = 'service'").select("repo_id", F.col("qualified_name").alias("from_name"), F.expr(REFERRED).alias("to_name"), F.lit("calls").alias("kind"), F.lit("moderate").alias("strength"))
    return X.backfill(entities, g.relationships.where("kind = 'depends_on'"), references)[1].select("from_entity_id", "to_entity_id", "kind")


#: Entities and raw calls of every kind, for callers in the package mkt: the entity that a call names, and how surely.
CALLED = (("x1", "Store", "mkt::Store"), ("x2", "Create", "mkt::Store.Create"), ("x3", "Store", "geo::Store"), ("x4", "Save", "geo::Store.Save"), ("x5", "helper", "mkt::helper"), ("x6", "Dup", "geo::Dup"), ("x7", "Dup", "svc::Dup"), ("x8", "Only", "svc::Only"), ("x9", "Near", "mkt::a.Near"), ("y1", "Near", "alt::Near"))
CALLS = (("geo::Store.Save", "x4", "strong"), ("Store.Create", "x2", "strong"), ("Store.Save", "x4", "moderate"), ("helper", "x5", "strong"), ("Only", "x8", "moderate"), ("Near", "x9", "moderate"), ("Dup", "x6", "weak"), ("nothing", None, None))


@query("gr16_call_edges", f"""
    WITH c AS (SELECT * FROM (VALUES {_sql(CALLS)}) AS t(k, raw, to_entity_id, strength))
    SELECT 'c' || CAST(c_custkey AS STRING) AS from_entity_id, to_entity_id, 'calls' AS kind, strength FROM customer JOIN c ON c.k = c_custkey % {len(CALLS)} WHERE to_entity_id IS NOT NULL""")
def _(g: G) -> DataFrame:
    more = g.spark.createDataFrame(list(CALLED), "id string, name string, qualified_name string")
    entities = g.entities.select("id", "name", "qualified_name").unionByName(more)
    raw = F.element_at(F.array(*[F.lit(c[0]) for c in CALLS]), (F.substring("id", 2, 20).cast("long") % len(CALLS) + 1).cast("int"))
    calls = g.entities.where("kind = 'function'").select(F.col("qualified_name").alias("caller"), raw.alias("callee"))
    return X.call_edges(calls, entities).select("from_entity_id", "to_entity_id", "kind", "strength")


@query("js3_extraction", "SELECT 'a::x' || CAST(event_id AS STRING) AS qualified_name, CASE WHEN event_id % 2 = 0 THEN 'function' ELSE 'concept' END AS kind, CAST(event_id % 2 AS INT) AS fallbacks FROM events")
def _(g: G) -> DataFrame:
    kind = F.when(F.col("event_id") % 2 == 0, "Function").otherwise("widget")
    response = F.to_json(F.struct(F.array(F.struct(kind.alias("kind"), F.lit("x").alias("name"), F.concat(F.lit("lib/a/x"), F.col("event_id").cast("string")).alias("qualified_name"))).alias("entities")))
    rows = X.parse_payload(g.events.select(F.lit("f.go").alias("path"), response.alias("response")))
    return X.payload_entities(rows).select("qualified_name", "kind", "fallbacks")


@query("ph3_batches", "SELECT id, CAST(floor((row_number() OVER (PARTITION BY repo_id ORDER BY id) - 1) / 10) AS BIGINT) AS batch FROM decisions")
def _(g: G) -> DataFrame:
    return X.batches_of(g.decisions, "repo_id", "id").select("id", "batch")


TITLES = ("Add things", "chore: x", "CI fix", "docs", "Bump y", "Update dependencies now", "dependabot z", "A docs change", "style fix", "cicada")


@query("flt14_worthwhile", """
    SELECT doc_id FROM documents WHERE length(coalesce(text, '')) >= 50 AND (length(coalesce(text, '')) >= 150 OR doc_id % 3 = 0) AND doc_id % 10 IN (0, 7, 8)""")
def _(g: G) -> DataFrame:
    title = F.element_at(F.array(*map(F.lit, TITLES)), (F.col("doc_id") % len(TITLES) + 1).cast("int"))
    comments = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("seen"))).otherwise(F.array().cast("array<string>"))
    prs = g.documents.select("doc_id", title.alias("title"), F.col("text").alias("body"), comments.alias("review_comments"), F.array().cast("array<string>").alias("linked_issues"))
    return FS.worthwhile_pull_requests(prs).select("doc_id")


@query("streaming_window_counts", "SELECT date_trunc('hour', created_at) AS hour, status, count(*) AS n FROM jobs GROUP BY 1, 2")
def _(g: G) -> DataFrame:
    from lodestone.streaming.changes import counts_by_window

    return counts_by_window(g.jobs).select(F.col("window.start").alias("hour"), "status", "n")


@query("flt13_predicates", f"WITH {FILES} SELECT DISTINCT path, test, manifest FROM files")
def _(g: G) -> DataFrame:
    paths = _files(g).select("path").distinct()
    return paths.select("path", FS.is_test(F.col("path")).alias("test"), FS.is_manifest(F.col("path")).alias("manifest"))


@query("flt15_referenced_methods", "SELECT id FROM entities WHERE kind = 'function' AND (id IN (SELECT from_entity_id FROM relationships) OR id IN (SELECT to_entity_id FROM relationships) OR id IN (SELECT entity_id FROM facts))")
def _(g: G) -> DataFrame:
    from lodestone.operators.relational import endpoints

    used = endpoints(g.relationships).unionByName(g.facts.select(F.col("entity_id").alias("id"))).distinct()
    return g.entities.where("kind = 'function'").join(used, "id", "left_semi").select("id")


@query("agg12_stack", f"""
    WITH {FILES}, n AS (SELECT *, list_last(string_split(path, '/')) AS base FROM files),
    s AS (SELECT 'language' AS what, language AS name FROM n WHERE language IS NOT NULL
          UNION ALL SELECT 'build tool', CASE base WHEN 'go.mod' THEN 'go modules' WHEN 'Cargo.toml' THEN 'cargo' ELSE 'npm' END FROM n WHERE class = 'build'
          UNION ALL SELECT 'framework', CASE base WHEN 'next.config.mjs' THEN 'Next.js' WHEN 'vite.config.ts' THEN 'Vite' ELSE 'Docker' END FROM n WHERE class = 'config' AND base IN ('next.config.mjs', 'vite.config.ts', 'Dockerfile')
          UNION ALL SELECT 'framework', unnest(CASE size % 3 WHEN 0 THEN ['React', 'Next.js'] WHEN 1 THEN ['Vue'] ELSE ['Express'] END) FROM n WHERE class = 'build' AND base = 'package.json')
    SELECT what, name, count(*) AS files FROM s GROUP BY ALL""")
def _(g: G) -> DataFrame:
    bodies = F.array(*map(F.lit, ('{"dependencies": {"react": "1", "next": "2"}}', '{"devDependencies": {"vue": "3"}}', '{"dependencies": {"express": "4", "nextra": "1"}}')))
    content = F.when(F.endswith(F.col("path"), F.lit("package.json")), F.element_at(bodies, (F.col("size") % 3 + 1).cast("int")))
    return X.stack(X.inventory(_files(g)).withColumn("content", content))


@query("join16_import_edges", """
    WITH f AS (SELECT path, id FROM (SELECT path, id, row_number() OVER (PARTITION BY path ORDER BY start_line NULLS LAST, qualified_name, id) AS k FROM entities WHERE path IS NOT NULL) WHERE k = 1),
    m AS (SELECT name, min(id) AS id FROM entities WHERE kind = 'module' GROUP BY name)
    SELECT DISTINCT f.id AS from_entity_id, m.id AS to_entity_id, 'imports' AS kind FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN f ON f.path = 'internal/svc/' || lower(n_name) || '.go' JOIN m ON m.name = n_name WHERE f.id <> m.id""")
def _(g: G) -> DataFrame:
    at = g.supplier.join(g.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    imports = at.select(F.concat(F.lit("internal/svc/"), F.lower("n_name"), F.lit(".go")).alias("path"), F.concat(F.lit("h.example/geo/"), "n_name").alias("import"))
    return X.import_edges(imports, g.entities)


def _manifest(g: G, base: str, line: str, head: str = "", tail: str = "", joiner: str = "\n") -> DataFrame:
    """One manifest a brand, a line a part: the parts' keys and sizes as names and versions."""
    text = F.format_string(line, F.col("p_partkey"), F.col("p_size"))
    lines = F.array_sort(F.collect_list(text))
    body = F.concat(F.lit(head), F.array_join(lines, joiner), F.lit(tail))
    made = g.part.groupBy("p_brand").agg(body.alias("content"))
    return made.select(F.concat("p_brand", F.lit("/" + base)).alias("path"), F.col("content").cast("binary").alias("content"))


MANIFEST = "SELECT p_brand || '/{0}' AS path, {1} || CAST(p_partkey AS STRING) AS name, {2} || CAST(p_size AS STRING) AS version, {3} AS dev FROM part"


def _register(name: str, reader: str, base: str, prefix: str, before: str, dev: str, **text: str) -> None:
    @query(name, MANIFEST.format(base, f"'{prefix}'", f"'{before}'", dev))
    def _(g: G) -> DataFrame:
        from lodestone.sources import manifests

        return getattr(manifests, reader)(_manifest(g, base, **text)).select("path", "name", "version", "dev")


_register("d1_go_mod", "go_mod", "go.mod", "h.example/p", "v", "false", line="\th.example/p%d v%d", head="module m\n\nrequire (\n", tail="\n)\n")
_register("d2_package_json", "package_json", "package.json", "p", "^", "true", line='"p%d": "^%d"', head='{"devDependencies": {', tail="}}", joiner=",")
_register("d3_requirements", "requirements_txt", "requirements.txt", "p", "", "false", line="p%d==%d", head="# pinned\n")
_register("d5_cargo", "toml", "Cargo.toml", "p", "", "false", line='p%d = "%d"', head="[dependencies]\n")
_register("d6_gemfile", "gemfile", "Gemfile", "p", "", "false", line="gem 'p%d', '%d'")
_register("d7_pom", "pom_xml", "pom.xml", "g:p", "", "true", line="<dependency><groupId>g</groupId><artifactId>p%d</artifactId><version>%d</version><scope>test</scope></dependency>")
_register("d8_gradle", "build_gradle", "build.gradle", "g:p", "", "false", line="  implementation 'g:p%d:%d'")
_register("d9_composer", "composer_json", "composer.json", "a/p", "", "false", line='"a/p%d": "%d"', head='{"require": {"php": "8", ', tail="}}", joiner=",")
_register("d10_pubspec", "pubspec_yaml", "pubspec.yaml", "p", "^", "false", line="  p%d: ^%d", head="name: x\ndependencies:\n", tail="\n")
_register("d11_mix", "mix_exs", "mix.exs", "p", "~> ", "false", line='{:p%d, "~> %d"}', joiner=", ")
_register("d13_csproj", "csproj", "App.csproj", "P", "", "false", line='<PackageReference Include="P%d" Version="%d" />')
