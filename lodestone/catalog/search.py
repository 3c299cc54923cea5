"""Vector, text and name search, fusion, hybrid and triplet search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.catalog.base import query
from lodestone.catalog.relational import CAT, DIM
from lodestone.functions import scoring
from lodestone.functions.text import STOP_WORDS
from lodestone.indexes.names import NameIndex
from lodestone.indexes.texts import TextIndex
from lodestone.indexes.vectors import VectorIndex
from lodestone.operators import relational as R
from lodestone.plans import search as S
from lodestone.session import materialize, scratch
from lodestone.sources.graph import TestGraph as G

COS = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"
LEAST = 0.1


def with_vectors(g: G) -> DataFrame:
    return g.facts.join(g.fact_vectors, "id", "left")


def texts_of(g: G) -> TextIndex:
    """The stored index of active facts' claims."""

    def make() -> TextIndex:
        index = TextIndex(g.spark, scratch(g.spark, "texts"))
        index.write(R.active_facts(g.facts).select("id", "claim"))
        return index

    return g.once("texts", make)


def names_of(g: G) -> NameIndex:
    def make() -> NameIndex:
        index = NameIndex(g.spark, scratch(g.spark, "names"))
        index.write(g.entities.select("id", "name"))
        return index

    return g.once("names", make)


def vectors_of(g: G) -> VectorIndex:
    def make() -> VectorIndex:
        index, rows = VectorIndex(g.spark, scratch(g.spark, "vectors")), R.active_facts(with_vectors(g)).select("id", "embedding")
        index.fit(rows)
        index.write(rows)
        return index

    return g.once("vectors", make)


def indexes(g: G) -> S.Indexes:
    """Texts and names by their indexes; vectors by the exact scan, so that results are those of the definition."""
    return S.Indexes(texts_of(g), names_of(g))


def search_graph(g: G) -> dict[str, DataFrame]:
    return {"facts": with_vectors(g), "entities": g.entities, "relationships": g.relationships, "repos": g.repos, "feedback": g.feedback}


@query("ma1_cosine", f"SELECT vec_id, round({COS}, 6) AS cosine FROM embeddings")
def _(g: G) -> DataFrame:
    return g.embeddings.select("vec_id", F.round(scoring.cosine(F.col("embedding"), scoring.vector_literal(g.query_vector)), 6).alias("cosine"))


VECTORS = f"v AS (SELECT f.id, {COS} AS s FROM facts f JOIN fact_vectors x ON f.id = x.id WHERE superseded_by IS NULL)"


@query("sr1_vector_top", f"WITH {VECTORS} SELECT id, round(s, 6) AS score FROM v WHERE s >= {LEAST} ORDER BY s DESC, id LIMIT 60")
def _(g: G) -> DataFrame:
    found = S.vector_top(R.active_facts(with_vectors(g)).select("id", "embedding"), g.query_vector, 60, LEAST)
    return found.select("id", F.round("score", 6).alias("score"))


@query("sr1_vector_index", f"WITH {VECTORS} SELECT id, round(s, 6) AS score FROM v WHERE s >= {LEAST} ORDER BY s DESC, id LIMIT 60")
def _(g: G) -> DataFrame:
    """The stored cells, opened until none can hold a better row."""
    return vectors_of(g).search(g.query_vector, 60, LEAST, exact=True).select("id", F.round("score", 6).alias("score"))


@query("sr1_vector_default", f"WITH v AS (SELECT f.id, {COS} AS s FROM facts f JOIN fact_vectors x ON f.id = x.id) SELECT id, round(s, 6) AS score FROM v WHERE s >= 0.4 ORDER BY s DESC, id LIMIT 60")
def _(g: G) -> DataFrame:
    found = S.vector_top(with_vectors(g).select("id", "embedding"), g.query_vector, 60)
    return found.select("id", F.round("score", 6).alias("score"))


@query("sr2_vector_per_entity", f"""
    WITH v AS (SELECT f.id, f.entity_id, {COS} AS s FROM facts f JOIN fact_vectors x ON f.id = x.id WHERE superseded_by IS NULL)
    SELECT id, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY s DESC, id) AS k FROM v) WHERE k <= 2""")
def _(g: G) -> DataFrame:
    near = R.active_facts(with_vectors(g)).withColumn("s", scoring.cosine(F.col("embedding"), scoring.vector_literal(g.query_vector))).where("s is not null")
    return R.first_n(near, ["entity_id"], [F.desc("s"), "id"], 2).select("id", "entity_id")


@query("agg7_max_similarity", f"SELECT entity_id, round(max({COS}), 6) AS similarity FROM facts f JOIN fact_vectors x ON f.id = x.id WHERE superseded_by IS NULL GROUP BY entity_id")
def _(g: G) -> DataFrame:
    return S.entity_similarity(with_vectors(g), g.query_vector).select("entity_id", F.round("similarity", 6).alias("similarity"))


TOKENS = r"list_filter(string_split_regex(lower(claim), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


STOP = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))
#: Cover density of 'que la': each pair of neighbouring hits of different words is a shortest stretch.
COVER = f"""
    lx AS (SELECT id, list_filter({TOKENS}, lambda x: x NOT IN ({STOP})) AS w FROM facts WHERE superseded_by IS NULL {{scope}}),
    hit AS (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM lx WHERE list_contains(w, 'que') AND list_contains(w, 'la')),
    gap AS (SELECT id, word, pos, lag(pos) OVER o AS before, lag(word) OVER o AS other FROM hit WHERE word IN ('que', 'la') WINDOW o AS (PARTITION BY id ORDER BY pos)),
    cov AS (SELECT id, sum(CASE WHEN other <> word THEN 2 / (pos - before + 1)::DOUBLE ELSE 0 END) AS s FROM gap GROUP BY id)"""


@query("sr6_text_match", f"WITH {COVER.replace('{scope}', '')} SELECT id, round(s, 6) AS score FROM cov")
def _(g: G) -> DataFrame:
    return texts_of(g).search("que la", None).select("id", F.round("score", 6).alias("score"))


@query("sr6_text_scan", f"WITH {COVER.replace('{scope}', '')} SELECT id, round(s, 6) AS score FROM cov ORDER BY round(s, 9) DESC, id LIMIT 60")
def _(g: G) -> DataFrame:
    return S.text_top(R.active_facts(g.facts).select("id", "claim"), "que la", 60).select("id", F.round("score", 6).alias("score"))


FREQUENCY = f"""
    WITH t AS (SELECT id, {TOKENS} AS w FROM facts WHERE superseded_by IS NULL),
    r AS (SELECT id, (1 - 1 / (1 + len(list_filter(w, lambda x: x = 'que')))::DOUBLE + 1 - 1 / (1 + len(list_filter(w, lambda x: x = 'la')))::DOUBLE) / 2 AS s FROM t WHERE list_contains(w, 'que') AND list_contains(w, 'la'))
    SELECT id, round(s, 6) AS score FROM r ORDER BY round(s, 9) DESC, id LIMIT 60"""


@query("sr7_text_frequency", FREQUENCY)
def _(g: G) -> DataFrame:
    return texts_of(g).search("que la", 60, frequency=True).select("id", F.round("score", 6).alias("score"))


@query("sr8_index_updates", FREQUENCY)
def _(g: G) -> DataFrame:
    """Every text is indexed twice: an earlier wording, then the real one, which replaces it; then the segments are merged."""
    index, rows = TextIndex(g.spark, scratch(g.spark, "texts")), R.active_facts(g.facts).select("id", "claim")
    index.write(g.facts.select("id", F.concat(F.lit("que la "), "claim").alias("claim")))
    index.write(rows, replaces=g.facts.select("id"))
    index.merge()
    return index.search("que la", 60, frequency=True).select("id", F.round("score", 6).alias("score"))


@query("sr8_frequencies", f"""
    WITH t AS (SELECT DISTINCT id, unnest({TOKENS}) AS w FROM facts WHERE superseded_by IS NULL) SELECT w AS stem, count(*) AS n FROM t WHERE w IN ('que', 'la', 'und') GROUP BY w""")
def _(g: G) -> DataFrame:
    return texts_of(g).frequencies(["que", "la", "und"])


@query("sr8_stored_lexemes", FREQUENCY)
def _(g: G) -> DataFrame:
    stored = materialize(S.index_texts(R.active_facts(g.facts).select("id", "claim")).drop("claim"))
    return S.text_top(stored, "que la", 60, frequency=True).select("id", F.round("score", 6).alias("score"))


def with_summaries(g: G) -> DataFrame:
    """Services with the vector of their number as the vector of their summary."""
    vectors = g.embeddings.select(F.concat(F.lit("s"), F.col("vec_id").cast("string")).alias("id"), F.col("embedding").alias("summary_embedding"))
    return g.entities.join(vectors, "id", "left")


@query("sr4_summary_search", f"SELECT e.id, round({COS}, 6) AS score FROM entities e JOIN embeddings ON e.id = 's' || CAST(vec_id AS STRING) WHERE repo_id IN ('r0', 'r1', 'r2', 'r3') AND {COS} >= -0.05 ORDER BY {COS} DESC, e.id LIMIT 20")
def _(g: G) -> DataFrame:
    return S.summary_top(with_summaries(g), g.query_vector, 20, ("r0", "r1", "r2", "r3"), -0.05).select("id", F.round("score", 6).alias("score"))


TRI = "list_distinct(list_transform(range(1, length(n) + 2), lambda i: substr('  ' || n || ' ', i, 3)))"


@query("sr9_fuzzy", f"""
    WITH e AS (SELECT id, repo_id, translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ_- ', 'abcdefghijklmnopqrstuvwxyz') AS n FROM entities),
    q AS (SELECT {TRI} AS t FROM (SELECT 'supplier1' AS n)),
    s AS (SELECT id, repo_id, len(list_intersect({TRI}, t))::DOUBLE / len(list_distinct(list_concat({TRI}, t))) AS sim FROM e, q)
    SELECT id, round(sim, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY sim DESC, id) AS k FROM s WHERE sim >= 0.3) WHERE k <= 10""")
def _(g: G) -> DataFrame:
    return S.fuzzy_names(g.entities, ["Supplier_1"], 0.3, 10, names_of(g)).select("id", F.round("similarity", 6).alias("similarity"))


FUSED = f"""{VECTORS},
    vl AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS r FROM (SELECT * FROM v WHERE s >= {LEAST} ORDER BY s DESC, id LIMIT 60)),
    tw AS (SELECT id, {TOKENS} AS w FROM facts WHERE superseded_by IS NULL),
    ts AS (SELECT id, (2 - 1 / (1 + len(list_filter(w, lambda x: x = 'que')))::DOUBLE - 1 / (1 + len(list_filter(w, lambda x: x = 'la')))::DOUBLE) / 2 AS s FROM tw WHERE list_contains(w, 'que') AND list_contains(w, 'la')),
    tl AS (SELECT id, row_number() OVER (ORDER BY round(s, 9) DESC, id) AS r FROM (SELECT * FROM ts ORDER BY round(s, 9) DESC, id LIMIT 60)),
    fused AS (SELECT coalesce(vl.id, tl.id) AS id, coalesce(1 / (60 + vl.r)::DOUBLE, 0) + coalesce(1 / (60 + tl.r)::DOUBLE, 0) AS score,
              CASE WHEN vl.id IS NOT NULL AND tl.id IS NOT NULL THEN 'hybrid' WHEN vl.id IS NOT NULL THEN 'vector' ELSE 'fts' END AS source FROM vl FULL JOIN tl ON vl.id = tl.id)"""


def _fused(g: G) -> DataFrame:
    facts = R.active_facts(with_vectors(g))
    return S.fuse(S.vector_top(facts.select("id", "embedding"), g.query_vector, 60, LEAST), texts_of(g).search("que la", 60, frequency=True)).drop("rv", "rt")


@query("sr12_rrf", f"WITH {FUSED} SELECT id, round(score, 9) AS score, source FROM fused")
def _(g: G) -> DataFrame:
    return _fused(g).select("id", F.round("score", 9).alias("score"), "source")


QUESTION = "Which documents say Licensed, or have a password_or a handleBUILDING1?"


@query("sr17_multipliers", f"""
    WITH {FUSED} SELECT f.id, round(fused.score * CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.85 ELSE 0.7 END * CASE WHEN e.kind IN ('function', 'type', 'endpoint', 'config') THEN 1.15 ELSE 0.85 END
        * CASE category WHEN 'constraint' THEN 0.95 WHEN 'risk' THEN 0.8 WHEN 'debt' THEN 0.7 ELSE 1.0 END * CASE WHEN f.repo_id IN ('r1', 'r2') THEN 1.3 ELSE 0.6 END, 9) AS score,
        least(0.05 * (contains(lower(claim), 'documents')::INT + contains(lower(claim), 'licensed')::INT + contains(lower(claim), 'password_or')::INT + contains(lower(claim), 'handlebuilding1')::INT), 0.1) AS bonus
    FROM fused JOIN facts f ON fused.id = f.id JOIN entities e ON f.entity_id = e.id""")
def _(g: G) -> DataFrame:
    rows = R.hydrate(_fused(g).join(g.facts, "id"), g.entities, g.repos)
    score = F.col("score") * scoring.by_value(F.col("confidence"), scoring.CONFIDENCE_FACTOR) * scoring.by_value(F.col("entity_kind"), scoring.KIND_FACTOR) * scoring.by_value(F.col("category"), scoring.CATEGORY_FACTOR)
    return rows.select("id", F.round(score * S.affinity(F.col("repo_id"), ("r1", "r2")), 9).alias("score"), S.claim_bonus(F.col("claim"), QUESTION).alias("bonus"))


@query("sr11_mentions", f"""
    WITH e AS (SELECT id, repo_id, translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ_- ', 'abcdefghijklmnopqrstuvwxyz') AS n FROM entities),
    q AS (SELECT n, {TRI} AS t FROM (VALUES ('supplier12'), ('handlemachinery7')) AS x(n)),
    s AS (SELECT q.n AS token, id, repo_id, len(list_intersect(u, t))::DOUBLE / len(list_distinct(list_concat(u, t))) AS sim FROM (SELECT *, {TRI} AS u FROM e) AS e, q),
    k AS (SELECT *, row_number() OVER (PARTITION BY token, repo_id ORDER BY sim DESC, id) AS k FROM s WHERE sim >= 0.4)
    SELECT id AS entity_id, round(max(sim), 6) AS similarity FROM k WHERE k <= 5 GROUP BY id""")
def _(g: G) -> DataFrame:
    return S.mentioned(g.entities, "What does Supplier12 call, and who owns handleMACHINERY7?", index=names_of(g)).withColumn("similarity", F.round("similarity", 6))


def hybrid_sql(tail: str, repo_ids: tuple[str, ...] = (), limit: int = 40, token: str | None = None) -> str:
    """Hybrid search for 'que la' over the graph tables; ``tail`` selects from ``best``.  ``token``: an identifier that the question names."""
    scope = f"AND repo_id IN ({', '.join(repr(r) for r in repo_ids)})" if repo_ids else ""
    affinity = f"CASE WHEN f.repo_id IN ({', '.join(repr(r) for r in repo_ids)}) THEN 1.3::DOUBLE ELSE 0.6::DOUBLE END" if repo_ids else "1.0::DOUBLE"
    said = "SELECT NULL::VARCHAR AS entity_id, NULL::DOUBLE AS similarity WHERE false"
    if token:
        said = f"""SELECT id AS entity_id, max(sim) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY sim DESC, id) AS k FROM
            (SELECT id, repo_id, len(list_intersect(own, asked))::DOUBLE / len(list_distinct(list_concat(own, asked))) AS sim FROM
             (SELECT id, repo_id, {TRI} AS own FROM (SELECT id, repo_id, translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ_- ', 'abcdefghijklmnopqrstuvwxyz') AS n FROM entities)), (SELECT {TRI} AS asked FROM (SELECT '{token.lower()}' AS n)))
            WHERE sim >= 0.4) WHERE k <= 5 GROUP BY id"""
    bonus = f"CASE WHEN contains(lower(f.claim), '{token.lower()}') THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END" if token else "0.0::DOUBLE"
    return f"""
    WITH v AS (SELECT f.id, f.repo_id, f.entity_id, {COS} AS s FROM facts f JOIN fact_vectors x ON f.id = x.id WHERE superseded_by IS NULL),
    vl AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS r FROM (SELECT id, s FROM v WHERE s >= {LEAST} {scope} ORDER BY s DESC, id LIMIT 60)),
    {COVER.replace('{scope}', scope)},
    tl AS (SELECT id, row_number() OVER (ORDER BY round(s, 9) DESC, id) AS r FROM (SELECT id, s FROM cov ORDER BY round(s, 9) DESC, id LIMIT 60)),
    fused AS (SELECT coalesce(vl.id, tl.id) AS id, coalesce(1 / (60 + vl.r)::DOUBLE, 0) + coalesce(1 / (60 + tl.r)::DOUBLE, 0) AS score, vl.r AS rv, tl.r AS rt,
              CASE WHEN vl.id IS NOT NULL AND tl.id IS NOT NULL THEN 'hybrid' WHEN vl.id IS NOT NULL THEN 'vector' ELSE 'fts' END AS source FROM vl FULL JOIN tl ON vl.id = tl.id),
    said AS ({said}),
    seeds AS (SELECT f.id, f.entity_id, u.score * (1 + 0.5::DOUBLE * coalesce(m.similarity, 0)) AS score, source, rv, rt, m.similarity AS mention FROM fused u JOIN facts f ON f.id = u.id LEFT JOIN said m ON m.entity_id = f.entity_id),
    top AS (SELECT max(score) AS top FROM seeds),
    wide AS (SELECT entity_id FROM (SELECT entity_id, count(*) AS n, max(score) AS best FROM seeds GROUP BY entity_id), top WHERE n >= 2 OR best >= 0.9::DOUBLE * top UNION SELECT entity_id FROM said),
    ex AS (SELECT id, s, row_number() OVER (PARTITION BY entity_id ORDER BY s DESC, id) AS k FROM v WHERE entity_id IN (SELECT entity_id FROM wide) AND id NOT IN (SELECT id FROM seeds)),
    expanded AS (SELECT id, top * s * 0.85::DOUBLE AS score FROM ex, top WHERE k <= 10),
    near AS (SELECT seed, node, max(CASE strength WHEN 'strong' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END) AS st FROM (SELECT from_entity_id AS seed, to_entity_id AS node, strength FROM relationships
             UNION ALL SELECT to_entity_id, from_entity_id, strength FROM relationships) WHERE seed IN (SELECT entity_id FROM wide) AND seed <> node GROUP BY seed, node),
    around AS (SELECT node AS entity_id, max(CASE st WHEN 3 THEN 0.35::DOUBLE WHEN 2 THEN 0.25::DOUBLE ELSE 0.15::DOUBLE END) AS factor FROM near WHERE node NOT IN (SELECT entity_id FROM wide) GROUP BY node),
    bs AS (SELECT id, entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY {DIM}, {CAT}, id) AS k FROM facts WHERE superseded_by IS NULL AND id NOT IN (SELECT id FROM seeds) AND id NOT IN (SELECT id FROM expanded)),
    every AS (SELECT id, score, source, rv, rt, mention FROM seeds UNION ALL SELECT id, score, 'expansion', NULL, NULL, NULL FROM expanded
              UNION ALL SELECT bs.id, top * factor, 'relationship', NULL, NULL, NULL FROM bs JOIN around USING (entity_id), top WHERE k <= 3),
    scored AS (SELECT f.id, f.entity_id, e.name AS entity_name, e.kind AS entity_kind, e.qualified_name, e.path, e.summary, f.repo_id, f.claim, f.dimension, f.category, f.confidence, x.source, x.score AS base, rv, rt, mention,
               CASE f.confidence WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.85::DOUBLE ELSE 0.7::DOUBLE END AS f_confidence,
               CASE WHEN e.kind IN ('function', 'type', 'endpoint', 'config') THEN 1.15::DOUBLE WHEN e.kind IN ('module', 'service', 'concept') THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END AS f_kind,
               CASE f.category WHEN 'constraint' THEN 0.95::DOUBLE WHEN 'risk' THEN 0.8::DOUBLE WHEN 'debt' THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS f_category, {affinity} AS f_repo, {bonus} AS f_words
               FROM every x JOIN facts f ON f.id = x.id LEFT JOIN entities e ON e.id = f.entity_id),
    best AS (SELECT scored.*, base * f_confidence * f_kind * f_category * f_repo + f_words AS score, r.name AS repo_name, EXISTS (SELECT 1 FROM feedback b WHERE b.fact_id = scored.id AND b.status = 'pending') AS flagged
             FROM scored LEFT JOIN repos r ON r.id = scored.repo_id ORDER BY score DESC, scored.id LIMIT {limit})
    {tail}"""


SHOWN = "id, entity_id, entity_name, entity_kind, repo_id, repo_name, dimension, category, confidence, round(score, 6) AS score, source, flagged"


@query("sr19_hybrid_search", hybrid_sql(f"SELECT {SHOWN} FROM best", token="Supplier12"))
def _(g: G) -> DataFrame:
    question = "que la Supplier12"
    found = S.hybrid_search(search_graph(g), question, [S.SubQuery("que la", g.query_vector)], least=LEAST, indexes=indexes(g))
    return found.withColumn("score", F.round("score", 6))


TRIPLETS = f"""
    WITH n AS (SELECT entity_id, max({COS}) AS s FROM facts f JOIN fact_vectors x ON f.id = x.id WHERE superseded_by IS NULL GROUP BY entity_id),
    seeds AS (SELECT entity_id AS seed FROM n ORDER BY s DESC, entity_id LIMIT 15),
    u AS (SELECT from_entity_id AS a, to_entity_id AS b FROM relationships UNION SELECT to_entity_id, from_entity_id FROM relationships),
    h AS (SELECT seed, seed AS node, 0 AS d FROM seeds UNION ALL SELECT seed, u.b, 1 FROM seeds JOIN u ON u.a = seed
          UNION ALL SELECT s.seed, u2.b, 2 FROM seeds s JOIN u u1 ON u1.a = s.seed JOIN u u2 ON u2.a = u1.b),
    m AS (SELECT seed, node, min(d) AS d FROM h GROUP BY seed, node),
    c AS (SELECT DISTINCT node FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY d, node) AS k FROM m) WHERE k <= 50)
    SELECT r.id, round(0.4 * coalesce(a.s, 0) + 0.2 * (coalesce(a.s, 0) + coalesce(b.s, 0)) / 2 * CASE strength WHEN 'strong' THEN 1.0 WHEN 'moderate' THEN 0.7 ELSE 0.4 END + 0.4 * coalesce(b.s, 0), 6) AS score
    FROM relationships r LEFT JOIN n a ON r.from_entity_id = a.entity_id LEFT JOIN n b ON r.to_entity_id = b.entity_id
    WHERE r.from_entity_id IN (SELECT node FROM c) AND r.to_entity_id IN (SELECT node FROM c) ORDER BY 2 DESC, r.id LIMIT 20"""


@query("sr20_triplet_search", TRIPLETS)
def _(g: G) -> DataFrame:
    return S.triplet_search(search_graph(g), g.query_vector).select("id", F.round("score", 6).alias("score"))


@query("sr5_summary_fallback", f"""
    WITH n AS (SELECT entity_id, max({COS}) AS s FROM facts f JOIN fact_vectors x ON f.id = x.id WHERE superseded_by IS NULL GROUP BY entity_id),
    m AS (SELECT 's' || CAST(vec_id AS STRING) AS id, {COS} * 0.8 AS s FROM embeddings)
    SELECT e.id, round(coalesce(n.s, m.s, 0), 6) AS similarity FROM entities e LEFT JOIN n ON e.id = n.entity_id LEFT JOIN m ON e.id = m.id""")
def _(g: G) -> DataFrame:
    near = S.or_by_summary(S.entity_similarity(with_vectors(g), g.query_vector), S.summary_similarity(with_summaries(g), g.query_vector))
    return g.entities.join(near.withColumnRenamed("entity_id", "id"), "id", "left").select("id", F.round(F.coalesce("similarity", F.lit(0.0)), 6).alias("similarity"))


@query("sr18_pending_flags", hybrid_sql("SELECT id, flagged FROM best"))
def _(g: G) -> DataFrame:
    return S.hybrid_search(search_graph(g), "que la", [S.SubQuery("que la", g.query_vector)], least=LEAST, indexes=indexes(g)).select("id", "flagged")


FACTORS = ("f_confidence", "f_kind", "f_category", "f_repo", "f_words")


@query("sr21_explain", hybrid_sql(f"SELECT {SHOWN}, round(base, 6) AS base, rv, rt, round(mention, 6) AS mention, {', '.join(FACTORS)} FROM best", ("r1", "r2"), token="Supplier12"))
def _(g: G) -> DataFrame:
    found = S.hybrid_search(search_graph(g), "que la Supplier12", [S.SubQuery("que la", g.query_vector)], ["r1", "r2"], least=LEAST, explain=True, indexes=indexes(g))
    return found.withColumns({c: F.round(c, 6) for c in ("score", "base", "mention")})


TRACE = """SELECT id, source || ' ' || entity_name || printf(': %.4f', base) || coalesce(' vector #' || rv, '') || coalesce(' text #' || rt, '') || coalesce(printf(' named x%.2f', 1 + 0.5::DOUBLE * mention), '')
    || CASE WHEN f_confidence <> 1 THEN printf(' confidence x%.2f', f_confidence) ELSE '' END || CASE WHEN f_kind <> 1 THEN printf(' kind x%.2f', f_kind) ELSE '' END
    || CASE WHEN f_category <> 1 THEN printf(' category x%.2f', f_category) ELSE '' END || CASE WHEN f_repo <> 1 THEN printf(' repo x%.2f', f_repo) ELSE '' END
    || CASE WHEN f_words > 0 THEN printf(' words +%.2f', f_words) ELSE '' END || printf(' = %.4f', score) AS trace FROM best"""


@query("sr21_trace", hybrid_sql(TRACE, ("r1", "r2"), token="Supplier12"))
def _(g: G) -> DataFrame:
    return S.trace_text(S.hybrid_search(search_graph(g), "que la Supplier12", [S.SubQuery("que la", g.query_vector)], ["r1", "r2"], least=LEAST, explain=True, indexes=indexes(g)))


SECTION = """'### ' || place || '. ' || qualified_name || ' (' || entity_kind || ')' || chr(10) || 'Repository: ' || repo_name || chr(10) || CASE WHEN coalesce(path, '') <> '' THEN 'File: ' || path || chr(10) ELSE '' END
    || CASE WHEN coalesce(claim, '') <> '' THEN 'Claim: ' || claim || chr(10) ELSE '' END || 'Marks: ' || dimension || ', ' || category || ', ' || confidence || chr(10) || CASE WHEN coalesce(summary, '') <> '' THEN 'Summary: ' || summary || chr(10) ELSE '' END"""


@query("sr22_context", hybrid_sql(f"SELECT '## Knowledge found' || chr(10) || chr(10) || string_agg({SECTION}, chr(10) ORDER BY place) || chr(10) || '## Question' || chr(10) || 'que la' AS context FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place FROM best)", limit=10))
def _(g: G) -> DataFrame:
    found = S.hybrid_search(search_graph(g), "que la", [S.SubQuery("que la", g.query_vector)], limit=10, least=LEAST, indexes=indexes(g))
    return S.context_text(found, g.facts, g.entities, "que la")
