"""The engine's questions: one method each, DataFrames out."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import names
from lodestone.indexes.flows import FlowIndex
from lodestone.operators import graph as O
from lodestone.operators import relational as R
from lodestone.plans import search as S
from lodestone.schemas import ordinal
from lodestone.session import materialize


#: Files that one question may name.
MOST_FILES = 20
#: How claims on a repository's architecture and on a dependency's version begin.
ARCHITECTURE, VERSION = "Architecture: ", "Required at version "


def clamp(n: int | None, default: int, most: int) -> int:
    return default if not n or n <= 0 else min(n, most)


@dataclass
class KnowledgeEngine:
    """``tables``: repos, entities, facts, relationships, cross_repo_relationships, decisions, decision_entities, feedback, jobs, runs."""

    tables: dict[str, DataFrame]
    embed: Callable[[str], Sequence[float]] | None = None
    decompose: Callable[[str], list[str]] | None = None
    indexes: S.Indexes | None = None
    flows: FlowIndex | None = None

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    def search(self, question: str, repo_ids: Sequence[str] = (), mode: str = "facts", limit: int | None = None, least: float = 0.4) -> DataFrame:
        assert self.embed is not None, "search needs an embedder"
        n = clamp(limit, 20, 50)
        if mode == "graph":
            return S.triplet_search(self.tables, self.embed(question), repo_ids, limit=n)
        parts = (self.decompose(question) if self.decompose else [])[:4] or [question]
        return S.hybrid_search(self.tables, question, [S.SubQuery(p, self.embed(p)) for p in parts], repo_ids, n, least, indexes=self.indexes)

    def list_repos(self) -> DataFrame:
        return self.repos.orderBy("name", "id")

    def repo_details(self) -> DataFrame:
        """Every repository with its counts and its latest quality; one pass a table, not one query a repository."""
        per = lambda df, what: df.groupBy(F.col("repo_id").alias("id")).agg(F.count("*").alias(what))
        last = R.latest(self.runs.select("repo_id", "created_at", "id", "quality_overall"), "repo_id", "created_at").select(F.col("repo_id").alias("id"), "quality_overall")
        out = self.repos.select("id", "name").join(per(self.entities, "entities"), "id", "left").join(per(R.active_facts(self.facts), "facts"), "id", "left")
        return out.join(per(self.relationships, "relationships"), "id", "left").join(per(self.decisions, "decisions"), "id", "left").fillna(0).join(last, "id", "left")

    def conventions(self, repo_id: str | None = None, limit: int | None = None) -> DataFrame:
        n = clamp(limit, 50, 200)
        found = R.facts_of_categories(self.facts, ["convention", "pattern"], n if repo_id else 2 * n, repo_id)
        if repo_id:
            return found
        key = F.concat("dimension", F.lit(":"), F.lower(F.trim("claim")))
        return R.distinct_first(found, key, ["id"]).orderBy(ordinal("dimension", F.col("dimension")), "id").limit(n)

    def resolve(self, repo_id: str, text: str) -> DataFrame:
        """The entity that a path, a qualified name or the end of a path names; the first way that finds one."""
        own = self.entities.where(F.col("repo_id") == repo_id)
        way = F.when(F.col("path") == text, 0).when(F.col("qualified_name") == text, 1).when(F.col("path").endswith("/" + text), 2)
        return own.withColumn("_way", way).where("_way is not null").orderBy("_way", F.col("start_line").asc_nulls_last(), "qualified_name", "id").limit(1).drop("_way")

    def module_context(self, entity_id: str, deep: bool = False, limit: int | None = None) -> dict[str, DataFrame]:
        """Facts of the entity, and if deep its edges with what is at the other end."""
        one = self.entities.where(F.col("id") == entity_id).select(F.col("id").alias("entity_id"))
        n = clamp(limit, 50, 200)
        out = {"facts": R.facts_of_entities(self.facts.join(one, "entity_id", "left_semi"), n)}
        return out | ({"relationships": self.edges_of(one, n)} if deep else {})

    def edges_of(self, ids: DataFrame, n: int) -> DataFrame:
        """The first ``n`` edges by id of each of the entities in the one column of ``ids``: direction, kind, confidence, and name, kind, path and repository of the other end."""
        own = ids.select(F.col(ids.columns[0]).alias("entity_id")).distinct()
        ends = [("from_entity_id", "to_entity_id", "outgoing"), ("to_entity_id", "from_entity_id", "incoming")]
        each = [self.relationships.select(F.col(a).alias("entity_id"), F.col(b).alias("other_id"), "id", "kind", "confidence", F.lit(d).alias("direction")) for a, b, d in ends]
        both = each[0].unionByName(each[1].where("entity_id <> other_id")).join(own, "entity_id", "left_semi")  # a loop is outgoing
        return self._other_end(R.first_n(both, ["entity_id"], ["id"], n))

    def _other_end(self, rows: DataFrame) -> DataFrame:
        e = self.entities.select(F.col("id").alias("other_id"), F.col("name").alias("other_name"), F.col("qualified_name").alias("other_qualified"), F.col("kind").alias("other_kind"), F.col("path").alias("other_path"), F.col("repo_id").alias("_repo"))
        return rows.join(e, "other_id", "left").join(self.repos.select(F.col("id").alias("_repo"), F.col("name").alias("other_repo")), "_repo", "left").drop("_repo")

    def service_contract(self, entity_id: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Who depends on the entity, and its invariants: facts on behaviour, constraints and contracts."""
        one, n = self.entities.where(F.col("id") == entity_id).select(F.col("id").alias("entity_id")), clamp(limit, 50, 200)
        return self._dependents(one, n), self._invariants(R.facts_of_entities(self.facts.join(one, "entity_id", "left_semi"), n))

    def _dependents(self, ids: DataFrame, n: int) -> DataFrame:
        into = self.relationships.select(F.col("to_entity_id").alias("entity_id"), F.col("from_entity_id").alias("other_id"), "id", "kind", "confidence")
        return self._other_end(R.first_n(into.join(ids, "entity_id", "left_semi"), ["entity_id"], ["id"], n))

    @staticmethod
    def _invariants(facts: DataFrame) -> DataFrame:
        return facts.where(F.col("category").isin("behavior", "constraint", "contract"))

    def impact(self, entity_id: str, hops: int | None = None, kinds: Sequence[str] = (), min_confidence: float = 0.0, limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Direct impacts with their direction, shortest paths to the rest, and the other repositories touched; among the nearest 50 entities, 200 at most."""
        edges = O.filter_edges(O.all_edges(self.relationships, self.cross_repo_relationships), kinds, min_confidence)
        seed = edges.sparkSession.createDataFrame([(entity_id,)], "seed string")
        edges = materialize(edges)
        reached = materialize(O.traverse(edges, seed, clamp(hops, 2, 5), clamp(limit, 50, 200)))
        inner = materialize(O.subgraph(edges, reached))
        direction = F.when(F.col("from_entity_id") != entity_id, "depended_by").when(F.col("kind") == "tested_by", "tested_by").otherwise("depends_on")
        direct = R.touching(inner, entity_id).withColumn("direction", direction)
        named = self.entities.select(F.col("id").alias("node"), "repo_id")
        own = named.where(F.col("node") == entity_id).select(F.col("repo_id").alias("_own"))
        repos = reached.join(named, "node").crossJoin(F.broadcast(own)).where("repo_id <> _own").select(F.col("repo_id").alias("id")).distinct()
        return direct, O.paths(inner, entity_id, clamp(hops, 2, 5)), self.repos.join(repos, "id", "left_semi").select("id", "name")

    def decisions_of(self, entity_id: str, limit: int = 50) -> DataFrame:
        return R.decisions_of(self.decisions, self.decision_entities, entity_id, limit)

    def task_context(self, repo_id: str, paths: Sequence[str], deep: bool = False, limit: int | None = None, heads: DataFrame | None = None, now: Column | None = None) -> dict[str, DataFrame]:
        """What is known of up to MOST_FILES files, all of them in one plan a part.

        modules: each path's own entity, null if nothing is found; entities, imports and related: of the path's file; facts,
        relationships (if deep), dependents, invariants and decisions: of the own entity; conventions and staleness: of the repository.
        """
        wanted = list(dict.fromkeys(paths))
        if not wanted or len(wanted) > MOST_FILES:
            raise ValueError(f"one to {MOST_FILES} files, not {len(wanted)}")
        n = clamp(limit, 50, 200)
        spark = self.entities.sparkSession
        asked = F.broadcast(spark.createDataFrame([(p,) for p in wanted], "asked string"))
        own = self.entities.where(F.col("repo_id") == repo_id)
        way = F.when(F.col("path") == F.col("asked"), 0).when(F.col("qualified_name") == F.col("asked"), 1).when(F.col("path").endswith(F.concat(F.lit("/"), "asked")), 2)
        met = own.join(asked, way.isNotNull()).withColumn("way", way)  # MOST_FILES paths against each row, as the scan goes by
        met = materialize(met.select("asked", "way", "id", "name", "kind", "qualified_name", "path", "start_line"))
        order = ["way", F.col("start_line").asc_nulls_last(), "qualified_name", "id"]
        first = R.first_n(met, ["asked"], order, 1)
        here = met.where("way <> 1")  # the file's entities: of the very path, or else of paths that end in it
        best = here.groupBy("asked").agg(F.min("way").alias("way"))
        inside = materialize(here.join(best, ["asked", "way"]).select("asked", "id", "name", "kind", "qualified_name", "path"))
        primary = materialize(first.select("asked", F.col("id").alias("entity_id")))
        edges = self.edges_of(inside.select("id"), 50).join(inside.select("asked", F.col("id").alias("entity_id")), "entity_id")
        outside = edges.join(inside.select("asked", F.col("id").alias("other_id")), ["asked", "other_id"], "left_anti")
        imports = edges.where("kind = 'imports' and direction = 'outgoing'").select("asked", F.col("other_qualified").alias("import")).where("import is not null").distinct()
        why = F.concat(F.when(F.col("direction") == "incoming", "depended on by ").otherwise("depends on "), F.col("other_name"))
        related = outside.where("not (kind = 'imports' and direction = 'outgoing') and other_path is not null and other_path <> asked")
        related = related.groupBy("asked", "other_path").agg(F.min(F.struct("id", "direction", why.alias("reason"))).alias("x")).select("asked", "other_path", "x.reason")
        ids = primary.select("entity_id").distinct()
        of = lambda df: primary.join(df, "entity_id")
        facts = materialize(R.facts_of_entities(self.facts.join(ids, "entity_id", "left_semi"), n).select("id", "entity_id", "claim", "dimension", "category", "confidence"))
        decided = self.decision_entities.join(ids, "entity_id", "left_semi").join(self.decisions.withColumnRenamed("id", "decision_id"), "decision_id")
        out = {
            "modules": spark.createDataFrame([(p,) for p in wanted], "asked string").join(primary, "asked", "left"),
            "entities": inside, "imports": imports, "related": related, "facts": of(facts), "invariants": of(self._invariants(facts)), "dependents": of(self._dependents(ids, n)),
            "decisions": of(R.first_n(decided, ["entity_id"], [F.desc("created_at"), "decision_id"], n)),
            "conventions": R.facts_of_categories(self.facts, ["convention", "pattern"], min(n, 20), repo_id),
            "staleness": self.repo_staleness(repo_id, heads, now),
        }
        return out | ({"relationships": of(self.edges_of(ids, n))} if deep else {})

    def repo_staleness(self, repo_id: str, heads: DataFrame | None = None, now: Column | None = None) -> DataFrame:
        """Staleness of a repository, with the number of jobs that are pending or failed."""
        one = self.repos.where(F.col("id") == repo_id)
        heads = heads if heads is not None else one.select(F.col("id").alias("repo_id"), F.lit(None).cast("string").alias("head_sha"))
        open_ = self.jobs.where((F.col("repo_id") == repo_id) & F.col("status").isin("pending", "failed")).agg(F.count("*").alias("backlog"))
        return R.staleness(one, heads, F.current_timestamp() if now is None else now).crossJoin(F.broadcast(open_))

    def repo_overview(self, repo_id: str) -> DataFrame:
        """One row: name, stored text, counts and when the repository was indexed."""
        count = lambda df, what: df.where(F.col("repo_id") == repo_id).agg(F.count("*").alias(what))
        text = F.col("overview") if "overview" in self.repos.columns else F.lit(None).cast("string")
        out = self.repos.where(F.col("id") == repo_id).select("name", F.coalesce(text, F.lit("")).alias("overview"), "last_indexed_at")
        for what in ("entities", "facts", "relationships", "decisions"):
            out = out.crossJoin(F.broadcast(count(self.tables[what], what)))  # one row
        return out

    def execution_flows(self, through: str | None = None, limit: int | None = None) -> DataFrame:
        """Stored flows, if the engine has them, else flows made now; all or those through an entity."""
        if self.flows is not None:
            found = self.flows.flows(through)
        else:
            found = O.flows(self.entities, self.relationships)
            found = found.where(F.exists("steps", lambda s: s["node"] == through)) if through else found
        return found.orderBy(F.desc("depth"), "seed").limit(clamp(limit, 20, 50))

    def functional_clusters(self, repo_id: str, limit: int | None = None, shown: int = 200) -> DataFrame:
        """Label, description, member count and members (at most ``shown``) of a repository's stored clusters."""
        own = self.entities.where((F.col("repo_id") == repo_id) & (F.col("kind") == "cluster")).orderBy("qualified_name", "id").limit(clamp(limit, 50, 200))
        links = self.relationships.where("kind = 'member_of'").select(F.col("to_entity_id").alias("id"), F.col("from_entity_id").alias("member"))
        members = R.first_n(links.join(own.select("id"), "id", "left_semi"), ["id"], ["member"], shown)
        named = members.join(self.entities.select(F.col("id").alias("member"), "qualified_name", "kind", "path"), "member")
        listed = named.groupBy("id").agg(F.count("*").alias("n_members"), F.array_sort(F.collect_list(F.struct("qualified_name", "kind", "path"))).alias("members"))
        return own.select("id", F.col("name").alias("label"), F.col("summary").alias("description")).join(listed, "id", "left").fillna(0, ["n_members"])

    def search_entities(self, query: str, kind: str | None = None, repo_id: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
        return R.page(R.search_names(self.entities, query, kind, repo_id), ["qualified_name", "id"], clamp(limit, 20, 100), offset)

    def entity_edges(self, entity_id: str) -> DataFrame:
        """Edges of an entity with the names at both ends."""
        a = self.entities.select(F.col("id").alias("from_entity_id"), F.col("name").alias("from_name"))
        b = self.entities.select(F.col("id").alias("to_entity_id"), F.col("name").alias("to_name"))
        return R.touching(self.relationships, entity_id).join(a, "from_entity_id").join(b, "to_entity_id")

    def overview(self, repo_id: str, top: int = 15) -> DataFrame:
        """(section, place, line): a repository described by what is stored of it, as markdown lines.

        The repository's own entity (whose qualified name is the repository's) gives summary, capabilities, architecture,
        conventions and risks; the others give the richest components, dependencies with their versions, and decisions.
        """
        repo = self.repos.where(F.col("id") == repo_id).select(F.col("name").alias("_repo"))
        all_ = self.entities.where(F.col("repo_id") == repo_id)
        itself = materialize(all_.join(F.broadcast(repo), F.col("qualified_name") == F.col("_repo")).orderBy("id").limit(1))
        facts = R.active_facts(self.facts).where(F.col("repo_id") == repo_id)
        own = materialize(facts.join(itself.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select("id", "claim", "dimension", "category"))
        external = (F.col("kind") == "module") & F.col("path").isNull()
        core = all_.where(~external).join(itself.select("id"), "id", "left_anti")
        rich = R.richness(core, facts, self.relationships).orderBy(F.desc("richness"), "id").limit(top)
        cells = F.concat(F.lit("| "), "qualified_name", F.lit(" | "), "kind", F.lit(" | "), names.escape_pipes(names.truncate(F.coalesce("summary", F.lit("")), 120)), F.lit(" |"))
        order = [ordinal("dimension", F.col("dimension")), "id"]
        tagged = F.regexp_extract("claim", r"^(?s)\[(.+?)\] (.*)$", 1)
        convention = F.when(tagged != "", F.concat(F.lit("### "), tagged, F.lit(": "), F.regexp_extract("claim", r"^(?s)\[(.+?)\] (.*)$", 2))).otherwise(F.concat(F.lit("- "), "claim"))
        outer = all_.where(external)
        versions = facts.join(outer.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").where(F.col("claim").startswith(VERSION))
        versions = versions.groupBy(F.col("entity_id").alias("id")).agg(F.min(F.struct("id", "claim")).alias("x")).select("id", F.substr("x.claim", F.lit(len(VERSION) + 1)).alias("version"))
        said = self.decisions.where((F.col("repo_id") == repo_id) & F.col("still_valid")).orderBy(F.desc("created_at"), "id").limit(10)
        why = F.col("rationale") if "rationale" in self.decisions.columns else F.lit("")
        parts = [
            ("summary", itself.where("summary is not null"), ["id"], F.col("summary")),
            ("capabilities", itself.select(F.posexplode("capabilities").alias("id", "c")) if "capabilities" in itself.columns else None, ["id"], F.concat(F.lit("- "), "c")),
            ("architecture", own.where((F.col("category") == "pattern") & F.col("claim").startswith(ARCHITECTURE)).orderBy(*order).limit(1), ["id"], F.substr("claim", F.lit(len(ARCHITECTURE) + 1))),
            ("components", rich, [F.desc("richness"), "id"], cells),
            ("conventions", own.where("category = 'convention'"), order, convention),
            ("dependencies", outer.join(versions, "id", "left"), ["name", "id"], F.concat(F.lit("- **"), "name", F.lit("**"), F.coalesce(F.concat(F.lit(": "), "version"), F.lit("")))),
            ("decisions", said, [F.desc("created_at"), "id"], F.concat(F.lit("- **"), "summary", F.lit("**: "), F.coalesce(why, F.lit("")))),
            ("risks", own.where("category = 'risk'"), order, F.concat(F.lit("- "), "claim")),
        ]
        out = [df.select(F.lit(name).alias("section"), F.row_number().over(_window(by)).alias("place"), line.alias("line")) for name, df, by, line in parts if df is not None]
        return functools.reduce(DataFrame.unionByName, out)

    def core_entities(self, repo_id: str, most: int = 60) -> DataFrame:
        """The richest entities of a repository that are not external modules, with their place."""
        own = self.entities.where((F.col("repo_id") == repo_id) & ~((F.col("kind") == "module") & F.col("path").isNull()))
        rich = R.richness(own, self.facts, self.relationships).orderBy(F.desc("richness"), "id").limit(most)
        return rich.withColumn("place", F.row_number().over(_window([F.desc("richness"), "id"])))

    def synthesis_input(self, repo_id: str, most: int = 60, facts: int = 5) -> DataFrame:
        """(place, qualified_name, kind, section): what a synthesis of a repository is written from: its richest entities, each with its first facts."""
        core = materialize(self.core_entities(repo_id, most))
        own = R.facts_of_entities(self.facts.join(core.select(F.col("id").alias("entity_id")), "entity_id", "left_semi"), facts)
        nth = F.struct(ordinal("dimension", F.col("dimension")).alias("d"), ordinal("category", F.col("category")).alias("c"), "id", F.format_string("- [%s/%s] %s\n", "dimension", "category", "claim").alias("line"))
        lines = own.groupBy(F.col("entity_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(nth)), lambda x: x["line"]), "").alias("lines"))
        can = F.array_join(F.slice("capabilities", 1, 5), ", ") if "capabilities" in core.columns else F.lit("")
        able = F.when(can != "", F.concat(F.lit("Capabilities: "), can, F.lit("\n"))).otherwise("")
        text = F.concat(F.format_string("## %s (%s)\nSummary: %s\n", F.col("qualified_name"), F.col("kind"), F.coalesce("summary", F.lit(""))), able, F.coalesce("lines", F.lit("")))
        return core.join(lines, "id", "left").select("place", "qualified_name", "kind", text.alias("section"))

    def summary_input(self, repo_id: str, most: int = 60, facts: int = 40, decisions: int = 10) -> DataFrame:
        """(part, place, line): what a summary of a repository is written from: entities, facts on patterns and on how things work, decisions."""
        core = materialize(self.core_entities(repo_id, most))
        how = R.active_facts(self.facts).join(core.select(F.col("id").alias("entity_id"), F.col("place").alias("_at")), "entity_id").where("category = 'pattern' or dimension = 'how'")
        order = ["_at", ordinal("dimension", F.col("dimension")), ordinal("category", F.col("category")), "id"]
        how = how.orderBy(*order).limit(facts)
        said = self.decisions.where(F.col("repo_id") == repo_id).orderBy(F.desc("created_at"), "id").limit(decisions)
        why = F.col("rationale") if "rationale" in self.decisions.columns else F.lit("")
        parts = [
            core.select(F.lit("entities").alias("part"), "place", F.format_string("- %s (%s): %s", F.col("qualified_name"), F.col("kind"), F.coalesce("summary", F.lit(""))).alias("line")),
            how.select(F.lit("facts").alias("part"), F.row_number().over(_window(order)).alias("place"), F.concat(F.lit("- "), "claim").alias("line")),
            said.select(F.lit("decisions").alias("part"), F.row_number().over(_window([F.desc("created_at"), "id"])).alias("place"), F.format_string("- %s: %s", F.col("summary"), F.coalesce(why, F.lit(""))).alias("line")),
        ]
        return functools.reduce(DataFrame.unionByName, parts)

    def health(self) -> DataFrame:
        return R.count_all(repos=self.repos, entities=self.entities, facts=self.facts, relationships=self.relationships, decisions=self.decisions)

    def cross_repo_links(self, repo_id: str | None = None) -> DataFrame:
        links = self.cross_repo_relationships
        return links.where((F.col("from_repo_id") == repo_id) | (F.col("to_repo_id") == repo_id)) if repo_id else links

    def chat_history(self, messages: DataFrame, n: int = 10) -> DataFrame:
        """The last ``n`` user and assistant turns of each conversation."""
        return R.first_n(messages.where(F.col("role").isin("user", "assistant")), ["conv_id"], [F.desc("turn")], n)


def _window(order: Sequence[Column | str]):
    from pyspark.sql import Window

    return Window.orderBy(*order)  # over at most a section's own rows
