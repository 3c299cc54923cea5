"""Hybrid search over facts and triplet search over the graph, each as one lazy plan.

The question's parts that are not data (sub-queries, their vectors, identifiers named in it) are made on the driver and
enter as literals; everything that grows with the store stays in DataFrames.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import names, scoring, text
from lodestone.indexes.names import NameIndex
from lodestone.indexes.texts import TextIndex
from lodestone.indexes.vectors import VectorIndex
from lodestone.operators import graph as graph_ops
from lodestone.operators import relational as R
from lodestone.session import materialize

FAN_OUT = 60


@dataclass(frozen=True)
class Indexes:
    """Stored indexes that a search may use in place of scans: of active facts' claims and vectors, and of entities' names."""

    texts: TextIndex | None = None
    names: NameIndex | None = None
    vectors: VectorIndex | None = None


@dataclass(frozen=True)
class SubQuery:
    """One query that the question was split into, with its vector."""

    words: str
    vector: Sequence[float]


def vector_top(rows: DataFrame, vector: Sequence[float], limit: int, least: float = 0.4, column: str = "embedding") -> DataFrame:
    """Rows with their exact cosine similarity to ``vector``, best first; a top-k that each task cuts to ``limit`` rows."""
    scored = rows.withColumn("score", scoring.cosine(F.col(column), scoring.vector_literal(vector)))
    return scored.where(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(limit)


def summary_top(entities: DataFrame, vector: Sequence[float], limit: int, repo_ids: Sequence[str] = (), least: float = 0.4) -> DataFrame:
    """Entities by the similarity of their summaries (summary_embedding), best first."""
    scoped = entities.where(F.col("repo_id").isin(*repo_ids)) if repo_ids else entities
    return vector_top(scoped.where("summary_embedding is not null"), vector, limit, least, "summary_embedding")


def summary_similarity(entities: DataFrame, vector: Sequence[float]) -> DataFrame:
    """(entity_id, similarity) of all entities with a summary vector."""
    near = scoring.cosine(F.col("summary_embedding"), scoring.vector_literal(vector))
    return entities.select(F.col("id").alias("entity_id"), near.alias("similarity")).where("similarity is not null")


def index_texts(rows: DataFrame, column: str = "claim") -> DataFrame:
    """``rows`` with their lexemes, to be stored with them: text_top() then reads these instead of the texts."""
    return rows.withColumn("lexemes", text.lexemes(F.col(column)))


def text_top(rows: DataFrame, words: str, limit: int, column: str = "claim", frequency: bool = False) -> DataFrame:
    """Rows whose text matches the query, by cover density (or term frequency), to nine digits, so that ties are ties."""
    stored = "lexemes" in rows.columns
    lex = F.col("lexemes") if stored else text.lexemes(F.col(column))
    found = (rows if stored else rows.where(text.may_match(F.col(column), words))).withColumn("_lex", lex).where(text.matches(F.col("_lex"), words))
    rank = (text.rank_frequency if frequency else text.rank_cover)(F.col("_lex"), words)
    return found.withColumn("score", F.round(rank, 9)).drop("_lex").orderBy(F.desc("score"), "id").limit(limit)


def fuzzy_names(entities: DataFrame, wanted: Sequence[str], least: float, limit: int, index: NameIndex | None = None) -> DataFrame:
    """(token, id, similarity): the ``limit`` most similar names of each token and repository.

    With an index, only what is similar is looked up.  Without, names that share a trigram with a token meet it on trigrams;
    the tokens are literals.
    """
    if index is not None:
        near = entities.select("id", "repo_id").join(index.similar(wanted, least), "id")
        return R.first_n(near, ["token", "repo_id"], [F.desc("similarity"), "id"], limit).select("token", "id", "repo_id", "similarity")
    spark = entities.sparkSession
    rows = spark.createDataFrame([(w,) for w in wanted], "token string").withColumn("tri", scoring.trigrams(names.normalize_name(F.col("token"))))
    asked = F.broadcast(rows.select("token", "tri", F.explode("tri").alias("t")))  # a question's own tokens
    own = entities.select("id", "repo_id", scoring.trigrams(names.normalize_name(F.col("name"))).alias("own"))
    met = own.withColumn("t", F.explode("own")).join(asked, "t").dropDuplicates(["token", "id"])
    near = met.withColumn("similarity", scoring.trigram_similarity(F.col("own"), F.col("tri"))).where(F.col("similarity") >= least)
    return R.first_n(near, ["token", "repo_id"], [F.desc("similarity"), "id"], limit).select("token", "id", "repo_id", "similarity")


def mentioned(entities: DataFrame, question: str, least: float = 0.4, limit: int = 5, index: NameIndex | None = None) -> DataFrame:
    """(entity_id, similarity) of entities whose names the question's identifiers come near."""
    found = fuzzy_names(entities, list(dict.fromkeys(text.candidate_tokens(question))), least, limit, index)
    return found.groupBy(F.col("id").alias("entity_id")).agg(F.max("similarity").alias("similarity"))


def fuse(vectors: DataFrame, texts: DataFrame, k: int = scoring.RRF_K, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (id, score): id, score, source (vector, fts or hybrid) and both ranks."""
    rank = lambda df: df.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("r"))  # noqa: E731  at most FAN_OUT rows
    v, t = rank(vectors).withColumnRenamed("r", "rv"), rank(texts).withColumnRenamed("r", "rt")
    both = v.join(t, "id", "full_outer")
    part = lambda c, w: F.coalesce(scoring.rrf(F.col(c), w, k), F.lit(0.0))
    source = F.when(F.col("rv").isNotNull() & F.col("rt").isNotNull(), "hybrid").when(F.col("rv").isNotNull(), "vector").otherwise("fts")
    return both.select("id", (part("rv", weights[0]) + part("rt", weights[1])).alias("score"), source.alias("source"), "rv", "rt")


def affinity(repo_id: Column, repo_ids: Sequence[str]) -> Column:
    """Facts of the repositories asked for count more than others; without any, all the same."""
    return F.when(repo_id.isin(*repo_ids), 1.3).otherwise(0.6) if repo_ids else F.lit(1.0)


def claim_bonus(claim: Column, question: str) -> Column:
    """0.05 for each of the question's candidate words that the claim holds, 0.1 at most."""
    words = [w.lower() for w in text.candidate_tokens(question)]
    if not words:
        return F.lit(0.0)
    return F.least(0.05 * F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(claim), w))), F.lit(0.1))


def hybrid_search(
    graph: dict[str, DataFrame], question: str, queries: Sequence[SubQuery], repo_ids: Sequence[str] = (), limit: int = 40, least: float = 0.4, explain: bool = False, indexes: Indexes | None = None
) -> DataFrame:
    """Facts for a question: two ranked lists a sub-query, fused; boosted by mentions; expanded to whole entities and their
    neighbours; weighted by confidence, kind, category, repository and words; capped, flagged and diversified.

    ``graph`` has facts (with embedding), entities, relationships, repos and feedback.
    """
    by = indexes or Indexes()
    facts = R.active_facts(graph["facts"]).withColumn("f_words", claim_bonus(F.col("claim"), question))
    scoped = facts.where(F.col("repo_id").isin(*repo_ids)) if repo_ids else facts
    entities = graph["entities"]
    lists: DataFrame | None = None
    for nth, q in enumerate(queries):
        among = scoped.select("id") if repo_ids else None
        near = by.vectors.search(q.vector, FAN_OUT, least, among=among) if by.vectors else vector_top(scoped.select("id", "embedding"), q.vector, FAN_OUT, least)
        said = by.texts.search(q.words, FAN_OUT, among=among) if by.texts else text_top(scoped.select("id", "claim", *([] if "lexemes" not in scoped.columns else ["lexemes"])), q.words, FAN_OUT)
        one = fuse(near, said).withColumn("nth", F.lit(nth))
        lists = one if lists is None else lists.unionByName(one)
    assert lists is not None
    # a fact that several sub-queries find keeps the first one's score
    seeds = lists.groupBy("id").agg(F.min(F.struct("nth", "score", "source", "rv", "rt")).alias("x")).select("id", "x.score", "x.source", "x.rv", "x.rt")
    light = facts.select("id", "entity_id", "repo_id", "dimension", "category", "confidence", "f_words")
    said = materialize(mentioned(entities, question, index=by.names))
    seeds = seeds.join(light, "id").join(said, "entity_id", "left")
    seeds = materialize(seeds.withColumn("score", F.col("score") * (1 + 0.5 * F.coalesce("similarity", F.lit(0.0)))).withColumnRenamed("similarity", "mention"))
    top = seeds.agg(F.max("score").alias("top"))
    per = seeds.groupBy("entity_id").agg(F.count("*").alias("n"), F.max("score").alias("best")).crossJoin(F.broadcast(top))
    widened = per.where((F.col("n") >= 2) | (F.col("best") >= 0.9 * F.col("top"))).select("entity_id").unionByName(said.select("entity_id")).distinct()
    widened = materialize(widened)
    near = scoring.cosine(F.col("embedding"), scoring.vector_literal(queries[0].vector))
    more = facts.join(widened, "entity_id", "left_semi").join(seeds.select("id"), "id", "left_anti").withColumn("sim", near).where("sim is not null")
    more = R.first_n(more, ["entity_id"], [F.desc("sim"), "id"], 10).crossJoin(F.broadcast(top))
    expanded = more.select("entity_id", "id", (F.col("top") * F.col("sim") * 0.85).alias("score"), F.lit("expansion").alias("source"), "repo_id", "dimension", "category", "confidence", "f_words")
    around = graph_ops.strongest_neighbours(graph["relationships"], widened.select(F.col("entity_id").alias("seed")))
    factor = F.max(scoring.by_value(F.col("strength"), scoring.NEIGHBOUR_FACTOR, 0.15)).alias("factor")
    around = around.groupBy(F.col("node").alias("entity_id")).agg(factor).join(widened, "entity_id", "left_anti")
    seen = seeds.select("id").unionByName(expanded.select("id"))
    beside = R.facts_of_entities(facts.join(seen, "id", "left_anti"), 3).join(around, "entity_id").crossJoin(F.broadcast(top))
    beside = beside.select("entity_id", "id", (F.col("top") * F.col("factor")).alias("score"), F.lit("relationship").alias("source"), "repo_id", "dimension", "category", "confidence", "f_words")
    all_rows = seeds.unionByName(expanded, allowMissingColumns=True).unionByName(beside, allowMissingColumns=True)
    kinds = entities.select(F.col("id").alias("entity_id"), F.col("name").alias("entity_name"), F.col("kind").alias("entity_kind"))
    rows = all_rows.join(kinds, "entity_id", "left").withColumn("base", F.col("score"))
    rows = (
        rows.withColumn("f_confidence", scoring.by_value(F.col("confidence"), scoring.CONFIDENCE_FACTOR))
        .withColumn("f_kind", scoring.by_value(F.col("entity_kind"), scoring.KIND_FACTOR))
        .withColumn("f_category", scoring.by_value(F.col("category"), scoring.CATEGORY_FACTOR))
        .withColumn("f_repo", affinity(F.col("repo_id"), repo_ids))
        .withColumn("score", F.col("base") * F.col("f_confidence") * F.col("f_kind") * F.col("f_category") * F.col("f_repo") + F.col("f_words"))
    )
    best = rows.orderBy(F.desc("score"), "id").limit(limit)
    pending = graph["feedback"].where("status = 'pending'").groupBy(F.col("fact_id").alias("id")).agg(F.count("*").alias("pending"))
    flagged = best.join(pending, "id", "left").withColumn("flagged", F.coalesce("pending", F.lit(0)) > 0)
    named = flagged.join(graph["repos"].select(F.col("id").alias("repo_id"), F.col("name").alias("repo_name")), "repo_id", "left")
    shown = ["id", "entity_id", "entity_name", "entity_kind", "repo_id", "repo_name", "dimension", "category", "confidence", "score", "source", "flagged"]
    return R.diversify(named.select(*shown, *(["base", "rv", "rt", "mention", "f_confidence", "f_kind", "f_category", "f_repo", "f_words"] if explain else [])), limit)


def entity_similarity(facts: DataFrame, vector: Sequence[float]) -> DataFrame:
    """(entity_id, similarity): the nearest active fact of each entity."""
    near = scoring.cosine(F.col("embedding"), scoring.vector_literal(vector))
    return R.active_facts(facts).groupBy("entity_id").agg(F.max(near).alias("similarity")).where("similarity is not null")


def or_by_summary(near: DataFrame, summaries: DataFrame) -> DataFrame:
    """Entities without a near fact count by their summary, a little less."""
    s = summaries.select("entity_id", (F.col("similarity") * 0.8).alias("_s"))
    return near.join(s, "entity_id", "full_outer").select("entity_id", F.coalesce("similarity", "_s").alias("similarity"))


def triplet_search(
    graph: dict[str, DataFrame], vector: Sequence[float], repo_ids: Sequence[str] = (), seeds: int = 15, hops: int = 2, cap: int = 50, limit: int = 20, summaries: DataFrame | None = None
) -> DataFrame:
    """Edges around the entities nearest to the query, scored by both ends and the edge between them."""
    near = materialize(entity_similarity(graph["facts"], vector))
    if summaries is not None:
        near = or_by_summary(near, summaries)
    first = near.orderBy(F.desc("similarity"), "entity_id").limit(seeds).select(F.col("entity_id").alias("seed"))
    around = materialize(graph_ops.traverse(graph["relationships"], first, hops, cap))
    edges = graph_ops.subgraph(graph["relationships"], around)
    s, t = near.select(F.col("entity_id").alias("from_entity_id"), F.col("similarity").alias("ss")), near.select(F.col("entity_id").alias("to_entity_id"), F.col("similarity").alias("ts"))
    joined = edges.join(s, "from_entity_id", "left").join(t, "to_entity_id", "left").fillna(0.0, ["ss", "ts"])
    rel = (F.col("ss") + F.col("ts")) / 2 * scoring.by_value(F.col("strength"), scoring.STRENGTH_FACTOR, 0.5)
    factor = affinity(F.col("repo_id"), repo_ids)
    scored = joined.withColumn("score", (0.4 * F.col("ss") + 0.2 * rel + 0.4 * F.col("ts")) * factor)
    return scored.select("id", "from_entity_id", "to_entity_id", "kind", "strength", "score").orderBy(F.desc("score"), "id").limit(limit)


def trace_text(explained: DataFrame) -> DataFrame:
    """(id, trace): how each result of hybrid_search(explain=True) came by its score; factors of 1 are left out."""
    times = lambda name, c: F.when(F.col(c) != 1, F.format_string(f" {name} x%.2f", c))
    parts = [
        F.format_string("%s %s: %.4f", "source", "entity_name", "base"),
        F.when(F.col("rv").isNotNull(), F.format_string(" vector #%d", "rv")),
        F.when(F.col("rt").isNotNull(), F.format_string(" text #%d", "rt")),
        F.when(F.col("mention").isNotNull(), F.format_string(" named x%.2f", 1 + 0.5 * F.col("mention"))),
        *[times(n, c) for n, c in (("confidence", "f_confidence"), ("kind", "f_kind"), ("category", "f_category"), ("repo", "f_repo"))],
        F.when(F.col("f_words") > 0, F.format_string(" words +%.2f", "f_words")),
        F.format_string(" = %.4f", "score"),
    ]
    return explained.select("id", F.concat(*[F.coalesce(p, F.lit("")) for p in parts]).alias("trace"))


def context_sections(results: DataFrame, facts: DataFrame, entities: DataFrame) -> DataFrame:
    """(place, section): a markdown section for each result, best first: the claim with its entity, repository, file and marks."""
    e = entities.select(F.col("id").alias("entity_id"), "qualified_name", "path", "summary")
    rows = results.join(facts.select("id", "claim"), "id").join(e, "entity_id", "left")
    line = lambda name, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{name}: "), F.col(c), F.lit("\n")))
    place = F.row_number().over(Window.orderBy(F.desc("score"), "id"))  # a result's own rows, as many as its limit
    head = F.format_string("### %d. %s (%s)\n", F.col("place"), F.coalesce("qualified_name", "entity_name"), F.col("entity_kind"))
    marks = F.format_string("Marks: %s, %s, %s\n", F.col("dimension"), F.col("category"), F.col("confidence"))
    parts = [head, line("Repository", "repo_name"), line("File", "path"), line("Claim", "claim"), marks, line("Summary", "summary")]
    return rows.withColumn("place", place).select("place", F.concat(*[F.coalesce(p, F.lit("")) for p in parts]).alias("section"))


def context_text(results: DataFrame, facts: DataFrame, entities: DataFrame, question: str) -> DataFrame:
    """One row: the sections and the question, as an answer is written from them."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "section")))
    text_ = F.array_join(F.transform(ordered, lambda x: x["section"]), "\n")
    return context_sections(results, facts, entities).agg(F.concat(F.lit("## Knowledge found\n\n"), text_, F.lit(f"\n## Question\n{question}")).alias("context"))


def query_frame(spark: SparkSession, queries: Sequence[SubQuery]) -> DataFrame:
    return spark.createDataFrame([(i, q.words) for i, q in enumerate(queries)], "nth int, words string")
