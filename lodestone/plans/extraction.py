"""From model output to graph rows: repair, parse, sanitise, name, and queue what is left to do."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import names, scoring
from lodestone.operators import relational as R
from lodestone.session import materialize
from lodestone.schemas import DOMAINS, in_domain
from lodestone.sources.files import analyzable, classify, language

PAYLOAD = """file_summary string, entities array<struct<kind:string,name:string,qualified_name:string,summary:string,capabilities:array<string>,assumptions:array<string>>>,
facts array<struct<entity_name:string,claim:string,dimension:string,category:string,confidence:string>>,
relationships array<struct<from:string,to:string,kind:string,description:string,strength:string>>"""


def clean_json(text: str | None) -> str:
    """The JSON in a model's answer: without fences and prose around it, trailing commas, comments, and cut-off ends closed."""
    raw = text or ""
    if m := re.search(r"```(?:json)?\s*\n?(.*?)(?:```|\Z)", raw, re.S):
        raw = m[1]
    at = min((i for i in (raw.find("{"), raw.find("[")) if i >= 0), default=-1)
    if at < 0:
        return ""
    raw = raw[at:]
    try:
        return json.dumps(json.JSONDecoder().raw_decode(raw)[0], ensure_ascii=False)
    except ValueError:
        pass
    out, closers, in_string, escaped = [], [], False, False
    for i, c in enumerate(raw):
        if in_string:
            in_string, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
            out.append({"\n": "\\n", "\t": "\\t", "\r": "\\r"}.get(c, c))
            continue
        if c == '"':
            in_string = True
        elif c in "{[":
            closers.append("}" if c == "{" else "]")
        elif c in "}]":
            if not closers:
                break
            while out and (out[-1].isspace() or out[-1] == ","):
                out.pop()
            closers.pop()
        elif c == "/" and raw[i : i + 2] == "//":
            break
        out.append(c)
        if not closers and c in "}]":
            break
    tail = "".join(out).rstrip() if not in_string else "".join(out)
    tail = tail + '"' if in_string else re.sub(r"[,:]\s*$", lambda m: ": null" if ":" in m[0] else "", tail)
    fixed = tail + "".join(reversed(closers))
    fixed = re.sub(r'([{,]\s*)([A-Za-z_]\w*)\s*:', r'\1"\2":', fixed) if '"' not in fixed[:3] and re.match(r"\{\s*[A-Za-z_]", fixed) else fixed
    try:
        json.loads(fixed)
    except ValueError:
        return ""
    return fixed


def repaired(rows: DataFrame, column: str = "response") -> DataFrame:
    """``rows`` with the column's JSON repaired where Spark cannot read it; the rest never leaves the JVM."""
    fine = rows.where(F.try_parse_json(F.col(column)).isNotNull())
    bad = rows.where(F.try_parse_json(F.col(column)).isNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{column: batch[column].map(clean_json)})

    return fine.unionByName(bad.mapInPandas(run, rows.schema))


def run_extractor(files: DataFrame, extract: Callable[[str, str], str], attempts: int = 3) -> DataFrame:
    """(path, content) -> path, response and error: the injected model call on each file, retried before it is given up."""

    def one(path: str, content: object) -> tuple[str | None, str | None]:
        text, error = bytes(content).decode("utf-8", "replace") if not isinstance(content, str) else content, None
        for _ in range(attempts):
            try:
                return extract(path, text), None
            except Exception as e:  # noqa: BLE001  whatever a service raises; it becomes the job's error
                error = str(e)
        return None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [one(p, c) for p, c in zip(batch["path"], batch["content"], strict=True)]
            yield pd.DataFrame({"path": batch["path"], "response": [f[0] for f in found], "error": [f[1] for f in found]})

    return files.select("path", "content").mapInPandas(run, "path string, response string, error string")


def parse_payload(rows: DataFrame, column: str = "response") -> DataFrame:
    return rows.withColumn("payload", F.from_json(F.col(column), PAYLOAD))


def payload_entities(rows: DataFrame) -> DataFrame:
    e = rows.select("path", F.explode("payload.entities").alias("e")).select("path", "e.*")
    kind = in_domain("entity_kind", F.col("kind"), "concept")
    return e.select("path", kind.alias("kind"), "name", names.normalize_qualified(F.coalesce("qualified_name", "name")).alias("qualified_name"), "summary", "capabilities", "assumptions", (~_known("entity_kind", "kind")).cast("int").alias("fallbacks"))


def payload_facts(rows: DataFrame) -> DataFrame:
    f = rows.select("path", F.explode("payload.facts").alias("f")).select("path", "f.*").where("claim is not null")
    made = {"dimension": "what", "category": "behavior", "confidence": "medium"}
    return f.select("path", "entity_name", "claim", *[in_domain(d, F.col(d), v).alias(d) for d, v in made.items()], sum((~_known(d, d)).cast("int") for d in made).alias("fallbacks"))


def payload_relationships(rows: DataFrame) -> DataFrame:
    r = rows.select("path", F.explode("payload.relationships").alias("r")).select("path", "r.*")
    q = names.normalize_qualified
    return r.select("path", q(F.col("from")).alias("from_name"), q(F.col("to")).alias("to_name"), in_domain("relationship_kind", F.col("kind"), "depends_on").alias("kind"), "description", in_domain("strength", F.col("strength"), "moderate").alias("strength"), ((~_known("relationship_kind", "kind")).cast("int") + (~_known("strength", "strength")).cast("int")).alias("fallbacks"))


def _known(domain: str, column: str) -> Column:
    return F.coalesce(F.lower(F.trim(F.col(column))).isin(*DOMAINS[domain]), F.lit(False))


def rename_consistently(rows: DataFrame, columns: list[str], renames: DataFrame) -> DataFrame:
    """Names in the columns through ``renames`` (path, old, new), else in their normal form."""
    for c in columns:
        r = renames.select("path", F.col("old").alias(c), F.col("new").alias("_new"))
        rows = rows.join(r, ["path", c], "left").withColumn(c, F.coalesce("_new", names.normalize_qualified(F.col(c)))).drop("_new")
    return rows


def inventory(files: DataFrame) -> DataFrame:
    """(path, size, ...) with class and language."""
    return files.withColumn("class", classify(F.col("path"))).withColumn("language", language(F.col("path")))


def inventory_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("class", "language").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


#: What build files, configurations and packages say about a repository.
BUILD_TOOLS = {"go.mod": "go modules", "package.json": "npm", "cargo.toml": "cargo", "pyproject.toml": "pip", "requirements.txt": "pip", "makefile": "make", "pom.xml": "maven", "build.gradle": "gradle"}
FRAMEWORK_CONFIGS = (("^next\\.config", "Next.js"), ("^vite\\.config", "Vite"), ("^(dockerfile|docker-compose\\.ya?ml)$", "Docker"))
FRAMEWORK_PACKAGES = {"react": "React", "express": "Express", "next": "Next.js", "vue": "Vue", "fastify": "Fastify"}


def stack(files: DataFrame) -> DataFrame:
    """Files with class, language and (of packages) content -> (what, name, files): languages, build tools and frameworks."""
    base, content = F.lower(F.element_at(F.split("path", "/"), -1)), F.coalesce(F.col("content").cast("string"), F.lit(""))
    tool = F.when(F.col("class") == "build", F.element_at(F.create_map(*[F.lit(x) for pair in BUILD_TOOLS.items() for x in pair]), base))
    by_config = [F.when((F.col("class") == "config") & base.rlike(pattern), F.lit(name)) for pattern, name in FRAMEWORK_CONFIGS]
    package = (F.col("class") == "build") & (base == "package.json")
    by_package = [F.when(package & F.contains(content, F.lit(f'"{key}"')), F.lit(name)) for key, name in FRAMEWORK_PACKAGES.items()]
    said = lambda what, name: F.struct(F.lit(what).alias("what"), name.alias("name"))
    rows = F.array(said("language", F.col("language")), said("build tool", tool), *(said("framework", c) for c in [*by_config, *by_package]))
    each = files.select(F.explode(F.array_distinct(rows)).alias("s")).where("s.name is not null")
    return each.groupBy("s.what", "s.name").agg(F.count("*").alias("files"))


def cost_estimate(files: DataFrame) -> DataFrame:
    """Tokens of an extraction over the files that are analysed."""
    tokens = F.floor(F.col("size") / 4) + 500 + 1000
    return analyzable(files).agg(F.count("*").alias("files"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"))


def resolve_edges(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """(from_name, to_name, kind, strength) -> edges between entities; unresolved ends and loops are left out."""
    refs = relationships.select(F.explode(F.array("from_name", "to_name")).alias("ref"), F.col("from_name").alias("caller"))
    found = R.resolve_names(refs, entities).select("ref", "caller", "entity_id")
    a = found.select(F.col("ref").alias("from_name"), F.col("caller").alias("_c"), F.col("entity_id").alias("from_entity_id")).where("from_name = _c").drop("_c")
    b = found.select(F.col("ref").alias("to_name"), F.col("caller").alias("from_name"), F.col("entity_id").alias("to_entity_id"))
    edges = relationships.join(a, "from_name").join(b, ["from_name", "to_name"]).where("from_entity_id <> to_entity_id")
    return edges.withColumn("confidence", scoring.strength_to_confidence(F.col("strength")))


def call_edges(calls: DataFrame, entities: DataFrame) -> DataFrame:
    """(caller, callee): qualified callers and raw call expressions -> calls edges; how a name was found decides the strength."""
    raw = calls.select("caller", F.col("callee").alias("raw"), F.when(F.contains("caller", F.lit("::")), F.substring_index("caller", "::", 1)).otherwise("").alias("pkg"))
    found = raw.join(R.resolve_calls(raw, entities), ["raw", "pkg"])
    own = entities.select(F.col("qualified_name").alias("caller"), F.col("id").alias("from_entity_id"))
    edges = found.join(own, "caller").where("from_entity_id <> entity_id").withColumn("strength", scoring.confidence_to_strength(F.col("certainty")))
    return edges.select("from_entity_id", F.col("entity_id").alias("to_entity_id"), F.lit("calls").alias("kind"), "strength", F.lit(0.95).alias("confidence")).distinct()


def import_edges(imports: DataFrame, entities: DataFrame) -> DataFrame:
    """(path, import) -> imports edges from a file's first entity to the module that the import names."""
    first = R.distinct_first(entities.where("path is not null"), F.col("path"), [F.col("start_line").asc_nulls_last(), "qualified_name", "id"]).select("path", F.col("id").alias("from_entity_id"))
    last = imports.withColumn("module", F.element_at(F.split("import", "/"), -1))
    modules = entities.where("kind = 'module'").groupBy(F.col("name").alias("module")).agg(F.min("id").alias("to_entity_id"))
    return last.join(first, "path").join(modules, "module").where("from_entity_id <> to_entity_id").select("from_entity_id", "to_entity_id", F.lit("imports").alias("kind")).distinct()


def repair_owners(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """owns edges from its owner to each method that has no edge."""
    alone = R.entities_without_edges(entities, edges).where(F.contains("qualified_name", F.lit(".")))
    owners = entities.select(F.col("id").alias("from_entity_id"), F.col("qualified_name").alias("owner"), "repo_id")
    return alone.withColumn("owner", names.owner_of(F.col("qualified_name"))).join(owners, ["repo_id", "owner"]).select("from_entity_id", F.col("id").alias("to_entity_id"), F.lit("owns").alias("kind"))


def backfill(entities: DataFrame, edges: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is missing after an extraction, in rounds until a round makes nothing: (entities, edges), each with its round.

    Methods without an edge get an owns edge from their owner; an owner that is not stored is made, and may lack an owner itself.
    ``references`` (repo_id, from_name, to_name, kind, strength) become edges as soon as both ends are known, by their names or
    another spelling of them.  Rounds are semi-naive: what waits is joined with the names of the last round only, and what is new
    with all names.  A round's work is in proportion to what it makes and to what still waits.
    """
    known = materialize(entities.select("repo_id", "qualified_name", "id").dropDuplicates(["repo_id", "qualified_name"]))
    fresh = known
    alone = R.entities_without_edges(entities, edges).where(F.contains("qualified_name", F.lit(".")))
    starting = materialize(alone.select("repo_id", "id", F.col("qualified_name").alias("name"), names.owner_of(F.col("qualified_name")).alias("owner")))
    waiting = starting.limit(0)
    none = F.lit(None).cast("string")
    open_ = materialize(references.select("repo_id", "from_name", "to_name", "kind", "strength", none.alias("from_id"), none.alias("to_id")).distinct())
    made: list[DataFrame] = []
    found: list[DataFrame] = []
    nth = 0
    while True:
        nth += 1
        by_owner = lambda df: df.select("repo_id", F.col("qualified_name").alias("owner"), F.col("id").alias("owner_id"))
        met = materialize(starting.join(by_owner(known), ["repo_id", "owner"]).unionByName(waiting.join(by_owner(fresh), ["repo_id", "owner"])))
        found.append(met.select("repo_id", F.col("owner_id").alias("from_entity_id"), F.col("id").alias("to_entity_id"), F.lit("owns").alias("kind"), F.lit("strong").alias("strength"), F.lit(nth).alias("round")))
        still = starting.unionByName(waiting).join(met.select("id"), "id", "left_anti")
        for end in ("from", "to"):
            open_ = _with_end(open_, fresh, end)
        open_ = materialize(open_)
        done = open_.where("from_id is not null and to_id is not null")
        found.append(done.where("from_id <> to_id").select("repo_id", F.col("from_id").alias("from_entity_id"), F.col("to_id").alias("to_entity_id"), "kind", "strength", F.lit(nth).alias("round")))
        open_ = open_.where("from_id is null or to_id is null")
        id_ = F.concat_ws(":", F.lit("own"), "repo_id", "owner")
        created = still.select("repo_id", "owner").distinct().join(by_owner(known), ["repo_id", "owner"], "left_anti").select("repo_id", F.col("owner").alias("qualified_name"), id_.alias("id"))
        created = materialize(created)
        waiting = materialize(still)
        if created.isEmpty():
            break
        made.append(created.withColumn("round", F.lit(nth)))
        known, fresh = materialize(known.unionByName(created)), created
        starting = created.where(F.contains("qualified_name", F.lit("."))).select("repo_id", "id", F.col("qualified_name").alias("name"), names.owner_of(F.col("qualified_name")).alias("owner"))
    everything = functools.reduce(DataFrame.unionByName, made) if made else known.limit(0).withColumn("round", F.lit(0))
    kind = F.when(F.contains("qualified_name", F.lit("::")), "type").otherwise("module")
    new = everything.select("id", "repo_id", kind.alias("kind"), names.short_name(F.col("qualified_name")).alias("name"), "qualified_name", "round")
    return new, functools.reduce(DataFrame.unionByName, found).dropDuplicates(["repo_id", "from_entity_id", "to_entity_id", "kind"])


def _with_end(open_: DataFrame, fresh: DataFrame, end: str) -> DataFrame:
    """References with the id of an end that is still unknown, if the new names have it; its own spelling comes before others."""
    lacking = open_.where(F.col(f"{end}_id").isNull()).select("repo_id", f"{end}_name").distinct()
    spelt = lacking.select("repo_id", f"{end}_name", F.posexplode(F.concat(F.array(f"{end}_name"), names.name_alternatives(F.col(f"{end}_name")))).alias("n", "qualified_name"))
    best = spelt.join(fresh, ["repo_id", "qualified_name"]).groupBy("repo_id", f"{end}_name").agg(F.min(F.struct("n", "id")).alias("x")).select("repo_id", f"{end}_name", F.col("x.id").alias("_id"))
    return open_.join(best, ["repo_id", f"{end}_name"], "left").withColumn(f"{end}_id", F.coalesce(f"{end}_id", "_id")).drop("_id").select(*open_.columns)


def batches_of(rows: DataFrame, by: str, order: str, size: int = 10) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("batch", F.floor((n - 1) / size))
