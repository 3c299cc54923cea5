"""Writes: upserts, deletes and state changes as new versions of tables.

Parquet tables are not changed in place.  An operator makes the next version of a table from the current one and a delta;
``Store`` writes a version to a folder of its own and then moves the pointer to it, so readers see one version or the other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import scoring
from lodestone.schemas import KEYS, PROVENANCE, TABLES


def merge(old: DataFrame, new: DataFrame, keys: Sequence[str], rules: dict[str, str], order: Sequence[str] = ()) -> DataFrame:
    """Upsert: rows of ``new`` replace those of ``old`` with the same keys, column by column.

    Rules: ``new`` takes the new value, ``old`` keeps the old, ``fill`` takes the new unless null, ``greatest`` the larger.
    Keys that ``new`` repeats are merged to their last row by ``order`` first.
    """
    if order:
        new = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))).where("_n = 1").drop("_n")
    o, n = old.select(F.struct(*old.columns).alias("o"), *keys), new.select(F.struct(*old.columns).alias("n"), *keys)
    both = o.join(n, list(keys), "full_outer")
    pick = {
        "new": lambda c: F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")),
        "old": lambda c: F.when(F.col("o").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")),
        "fill": lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")),
        "greatest": lambda c: F.greatest(F.col(f"n.{c}"), F.col(f"o.{c}")),
    }
    return both.select(*[F.col(c) if c in keys else pick[rules.get(c, "old")](c).alias(c) for c in old.columns])


#: How each table's columns merge; what is not named keeps the old value.
ENTITY_RULES = {"summary": "fill", "signature": "fill", "typeref": "fill", "start_line": "fill", "end_line": "fill", "capabilities": "new", "assumptions": "new", "name_normalized": "new", "updated_at": "new"}
RELATIONSHIP_RULES = {"strength": "new", "provenance": "new", "confidence": "greatest", "description": "fill"}
FLOW_RULES = {"label": "new", "step_entity_ids": "new", "step_names": "new", "depth": "new", "updated_at": "new"}


def upsert_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    return merge(old, new, KEYS["entities"], ENTITY_RULES)


def upsert_relationships(old: DataFrame, new: DataFrame) -> DataFrame:
    return merge(old, new, KEYS["relationships"], RELATIONSHIP_RULES)


def upsert_cross_repo(old: DataFrame, new: DataFrame) -> DataFrame:
    return merge(old, new.where("from_repo_id <> to_repo_id"), KEYS["cross_repo_relationships"], RELATIONSHIP_RULES)


def upsert_flows(old: DataFrame, new: DataFrame) -> DataFrame:
    return merge(old, new, KEYS["execution_flows"], FLOW_RULES)


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


def update_by_key(base: DataFrame, delta: DataFrame, key: str = "id") -> DataFrame:
    """Non-null columns of ``delta`` over those of ``base``, for the keys that ``delta`` has."""
    own = [c for c in delta.columns if c != key]
    d = delta.select(key, *[F.col(c).alias(f"_new_{c}") for c in own])
    return base.join(d, key, "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in own else F.col(c) for c in base.columns])


def delete_entities(tables: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """``tables`` without the entities in the one column of ``doomed``, and without the facts, edges and links on them."""
    ids = doomed.select(F.col(doomed.columns[0]).alias("_doomed")).distinct()
    hits = {"entities": ("id",), "facts": ("entity_id",), "relationships": ("from_entity_id", "to_entity_id"), "cross_repo_relationships": ("from_entity_id", "to_entity_id"), "decision_entities": ("entity_id",), "execution_flows": ("entry_entity_id",)}
    out = dict(tables)
    for name, columns in hits.items():
        for column in columns if name in out else ():
            out[name] = out[name].join(ids, F.col(column) == F.col("_doomed"), "left_anti")
    return out


def delete_repo(tables: dict[str, DataFrame], repo_id: str) -> dict[str, DataFrame]:
    out = {}
    for name, df in tables.items():
        columns = [c for c in ("repo_id", "from_repo_id", "to_repo_id") if c in df.columns] if name != "repos" else ["id"]
        keep = F.lit(True)
        for c in columns:
            keep = keep & (F.col(c) != repo_id)
        out[name] = df.where(keep)
    return out


def claim_jobs(jobs: DataFrame, n: int) -> DataFrame:
    """Jobs with the ``n`` oldest pending ones of each repository and phase in progress."""
    rank = F.row_number().over(Window.partitionBy("repo_id", "phase", (F.col("status") == "pending")).orderBy("created_at", "id"))
    claimed = (F.col("status") == "pending") & (rank <= n)
    return jobs.withColumn("_c", claimed).withColumn("status", F.when(F.col("_c"), "in_progress").otherwise(F.col("status"))).drop("_c")


def finish_jobs(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """``done``: id and error_message (null if completed)."""
    d = done.select("id", F.lit(True).alias("_done"), F.col("error_message").alias("_error"))
    state = F.when(F.col("_done") & F.col("_error").isNull(), "completed").when(F.col("_done"), "failed").otherwise(F.col("status"))
    return jobs.join(d, "id", "left").withColumn("status", state).drop("_done", "_error")


def reset_failed(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("status", F.when(F.col("status") == "failed", "pending").otherwise(F.col("status")))


def queue_changed(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, target, content_hash, status): files that are new or whose content changed are pending, others as they were."""
    f = files.select("repo_id", "target", F.col("content_hash").alias("_h"))
    both = jobs.select("repo_id", "target", "content_hash", "status").join(f, ["repo_id", "target"], "full_outer")
    changed = F.col("_h").isNotNull() & ~F.col("_h").eqNullSafe(F.col("content_hash"))
    return both.select("repo_id", "target", F.coalesce("_h", "content_hash").alias("content_hash"), F.when(changed, "pending").otherwise(F.col("status")).alias("status"))


def submit_feedback(facts: DataFrame, jobs: DataFrame, reported: DataFrame, phase: str = "phase2") -> tuple[DataFrame, DataFrame]:
    """Facts with the reported ones at low confidence, and jobs with what they were taken from queued again.

    ``facts`` has ``refs`` (array of strings); a job in progress is left alone.
    """
    ids = reported.select(F.col("fact_id").alias("id")).distinct()
    hit = facts.join(ids, "id", "left_semi")
    refs = hit.select("repo_id", F.explode(F.transform("refs", lambda x: F.trim(x))).alias("target")).where("target <> ''").distinct().withColumn("_again", F.lit(True))
    low = facts.join(ids.withColumn("_low", F.lit(True)), "id", "left").withColumn("confidence", F.when(F.col("_low"), "low").otherwise(F.col("confidence"))).drop("_low")
    mine = jobs.where(F.col("phase") == phase)
    both = mine.join(refs, ["repo_id", "target"], "full_outer")
    state = F.when(F.col("_again") & ~F.coalesce(F.col("status") == "in_progress", F.lit(False)), "pending").otherwise(F.col("status"))
    queued = both.select("repo_id", F.lit(phase).alias("phase"), "target", state.alias("status"))
    return low, queued.unionByName(jobs.where(F.col("phase") != phase).select("repo_id", "phase", "target", "status"))


def newest_of_each(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("updated_at"), "id"))
    return df.withColumn("_n", rank).where("_n = 1").drop("_n")


def backfill_confidence(edges: DataFrame, cross_repo: bool = False) -> DataFrame:
    known = F.when(F.col("confidence") > 0, F.col("confidence"))
    return edges.withColumn("confidence", F.coalesce(known, scoring.strength_to_confidence(F.col("strength"), cross_repo)))


#: Primes below 2**60: what the two folds of row hashes are taken modulo.
PRIMES = ((1 << 60) - 93, (1 << 60) - 107)


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: a hash that equal tables share, whatever the order of their rows.

    A row's hash is that of its columns by name, each as its byte count, a colon and its text, or ``-`` for null.  Two parts of 60
    bits of it are added up over all rows, modulo two primes, and counted: a fold that tasks do in part, without order or arrays.
    """
    field = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    row = F.sha2(F.concat(*[field(F.col(c).cast("string")) for c in sorted(df.columns)]), 256)
    part = lambda n: F.conv(F.substring("h", 1 + 15 * n, 15), 16, 10).cast("decimal(38,0)")
    sums = df.select(row.alias("h")).agg(F.count("*").alias("n"), *[F.coalesce(F.sum(part(i)), F.lit(0)).cast("decimal(38,0)").alias(f"s{i}") for i in range(2)])
    folds = [(F.col(f"s{i}") % F.lit(p).cast("decimal(38,0)")).cast("decimal(38,0)").cast("string") for i, p in enumerate(PRIMES)]
    return sums.select(F.sha2(F.concat_ws(":", F.col("n").cast("string"), *folds), 256).alias("etag"))


def etag_matches(header: str | None, etag: str) -> bool:
    """Whether an If-None-Match header (a list, weak tags, or ``*``) names ``etag``."""
    tags = [t.strip().removeprefix("W/").strip('"') for t in (header or "").split(",")]
    return "*" in tags or etag in tags


def check_keys(name: str, df: DataFrame) -> DataFrame:
    """Keys that a table repeats: no row if its unique key holds."""
    return df.groupBy(*KEYS[name]).count().where("count > 1")


class Store:
    """Versions of the graph's tables under one root; a table's pointer is a one-row table that names its current version."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _pointer(self, name: str) -> int | None:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema("version long").json(f"{self.root}/{name}/_pointer").agg(F.max("version")).first()[0]
        except AnalysisException:  # no such folder yet
            return None

    def exists(self, name: str) -> bool:
        return self._pointer(name) is not None

    def read(self, name: str) -> DataFrame:
        version = self._pointer(name)
        if version is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}/v{version}")

    def write(self, name: str, df: DataFrame) -> None:
        version = (self._pointer(name) or 0) + 1
        shaped = df.select(*[F.col(f.split(" ", 1)[0]).cast(f.split(" ", 1)[1]) for f in _fields(TABLES[name])])
        shaped.write.mode("errorifexists").parquet(f"{self.root}/{name}/v{version}")
        self.spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").json(f"{self.root}/{name}/_pointer")

    def append(self, name: str, df: DataFrame) -> None:
        self.write(name, self.read(name).unionByName(df))

    def reset(self) -> None:
        for name in TABLES:
            self.write(name, self.spark.createDataFrame([], TABLES[name]))


def _fields(ddl: str) -> list[str]:
    """Top-level fields of a DDL string."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            out.append(ddl[at:i].strip())
            at = i + 1
    return [*out, ddl[at:].strip()]


def encode_provenance(column: Column) -> Column:
    return F.to_json(column)


def decode_provenance(column: Column) -> Column:
    return F.from_json(column, PROVENANCE)
