"""Graph tables: reading a stored graph, and the mapping of the star-schema test tables onto one.

The mapping is SQL that Spark and other engines read alike; ``{name}`` stands for a table.  It is the single definition
of the test graph, so an oracle can be stated over the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

from lodestone.schemas import TABLES
from lodestone.session import materialize

T = TypeVar("T")
BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

MAPPING = {
    "repos": """
        SELECT 'r' || CAST(r_regionkey AS STRING) AS id, lower(r_name) AS name, 'https://example.org/org/' || lower(r_name) || '.git' AS remote_url,
               '/repos/' || lower(r_name) AS local_path, CASE WHEN r_regionkey = 4 THEN NULL ELSE 'sha' || CAST(r_regionkey AS STRING) END AS last_commit_sha,
               CASE WHEN r_regionkey = 4 THEN NULL WHEN r_regionkey % 2 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' ELSE TIMESTAMP '2024-01-28 00:00:00' END AS last_indexed_at
        FROM {region}""",
    "places": "SELECT n_nationkey, n_name, 'r' || CAST(n_regionkey AS STRING) AS repo_id FROM {nation}",
    "entities": """
        SELECT 'n' || CAST(n_nationkey AS STRING) AS id, repo_id, 'module' AS kind, n_name AS name, 'geo::' || n_name AS qualified_name,
               CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE 'src/geo/' || lower(n_name) || '/mod.go' END AS path, CAST(NULL AS STRING) AS summary, CAST(NULL AS INT) AS start_line
        FROM {places}
        UNION ALL
        SELECT 's' || CAST(s_suppkey AS STRING), repo_id, 'service', 'Supplier' || CAST(s_suppkey AS STRING), 'svc::' || n_name || '.Supplier' || CAST(s_suppkey AS STRING),
               'internal/svc/' || lower(n_name) || '.go', CASE WHEN s_acctbal > 5000 THEN 'Supplies parts from ' || n_name END, CAST(s_suppkey % 90 AS INT)
        FROM {supplier} JOIN {places} ON s_nationkey = n_nationkey
        UNION ALL
        SELECT 'p' || CAST(p_partkey AS STRING), 'r' || CAST(p_partkey % 5 AS STRING), 'type', replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS STRING),
               'parts::' || replace(p_brand, '#', '') || '.' || replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS STRING), 'pkg/parts/' || lower(p_type) || '.go', p_type || ' ' || p_name, CAST(p_partkey % 300 AS INT)
        FROM {part}
        UNION ALL
        SELECT 'c' || CAST(c_custkey AS STRING), repo_id, 'function', 'handle' || c_mktsegment || CAST(c_custkey AS STRING), 'mkt::' || c_mktsegment || '.handle' || CAST(c_custkey AS STRING),
               'internal/' || lower(c_mktsegment) || '/svc_' || CAST(c_nationkey AS STRING) || '.go', CASE WHEN c_acctbal > 0 THEN c_name END, CAST(c_custkey % 500 AS INT)
        FROM {customer} JOIN {places} ON c_nationkey = n_nationkey""",
    "edges": """
        SELECT from_entity_id, to_entity_id, kind, strength, CASE strength WHEN 'strong' THEN 0.9 WHEN 'moderate' THEN 0.75 ELSE 0.55 END AS confidence
        FROM (SELECT 'n' || CAST(s_nationkey AS STRING) AS from_entity_id, 's' || CAST(s_suppkey AS STRING) AS to_entity_id, 'owns' AS kind, 'strong' AS strength FROM {supplier}
              UNION ALL SELECT 'n' || CAST(c_nationkey AS STRING), 'c' || CAST(c_custkey AS STRING), 'owns', 'moderate' FROM {customer}
              UNION ALL SELECT 'p' || CAST(p_partkey AS STRING), 'p' || CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS STRING), 'depends_on', CASE WHEN p_size > 30 THEN 'strong' ELSE 'weak' END FROM {part} WHERE p_partkey > 0
              UNION ALL SELECT 'c' || CAST(o_custkey AS STRING), 'p' || CAST(l_partkey AS STRING), 'calls', CASE WHEN sum(l_quantity) >= 40 THEN 'strong' WHEN sum(l_quantity) >= 20 THEN 'moderate' ELSE 'weak' END
                        FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_custkey, l_partkey
              UNION ALL SELECT 'p' || CAST(l_partkey AS STRING), 's' || CAST(l_suppkey AS STRING), 'calls', CASE WHEN sum(l_quantity) >= 40 THEN 'strong' WHEN sum(l_quantity) >= 20 THEN 'moderate' ELSE 'weak' END
                        FROM {lineitem} GROUP BY l_partkey, l_suppkey) AS e""",
    "placed_edges": """
        SELECT e.kind || ':' || e.from_entity_id || '>' || e.to_entity_id AS id, a.repo_id AS from_repo_id, b.repo_id AS to_repo_id, e.from_entity_id, e.to_entity_id, e.kind, e.strength, e.confidence
        FROM {edges} AS e JOIN {entities} AS a ON e.from_entity_id = a.id JOIN {entities} AS b ON e.to_entity_id = b.id""",
    "relationships": "SELECT id, from_repo_id AS repo_id, from_entity_id, to_entity_id, kind, strength, confidence FROM {placed_edges} WHERE from_repo_id = to_repo_id",
    "cross_repo_relationships": "SELECT id, from_repo_id, to_repo_id, from_entity_id, to_entity_id, kind, strength, confidence FROM {placed_edges} WHERE from_repo_id <> to_repo_id",
    "facts": """
        SELECT 'f' || CAST(doc_id AS STRING) AS id, 'p' || CAST(doc_id % 200 AS STRING) AS entity_id, 'r' || CAST(doc_id % 5 AS STRING) AS repo_id, text AS claim,
               CASE doc_id % 4 WHEN 0 THEN 'what' WHEN 1 THEN 'how' WHEN 2 THEN 'why' ELSE 'when' END AS dimension,
               CASE doc_id % 6 WHEN 0 THEN 'behavior' WHEN 1 THEN 'constraint' WHEN 2 THEN 'pattern' WHEN 3 THEN 'convention' WHEN 4 THEN 'debt' ELSE 'risk' END AS category,
               CASE WHEN n_chars > 2000 THEN 'high' WHEN n_chars > 800 THEN 'medium' ELSE 'low' END AS confidence,
               CASE WHEN doc_id % 17 = 0 THEN 'f' || CAST(doc_id + 1 AS STRING) END AS superseded_by, source || '/' || lang || '.md' AS ref
        FROM {documents}""",
    "fact_vectors": "SELECT 'f' || CAST(vec_id AS STRING) AS id, embedding FROM {embeddings}",
    "feedback": """
        SELECT 'b' || CAST(doc_id AS STRING) AS id, 'f' || CAST(doc_id AS STRING) AS fact_id, 'r' || CAST(doc_id % 5 AS STRING) AS repo_id,
               CASE WHEN quality = 0 THEN 'pending' ELSE 'resolved' END AS status, doc_id AS nth FROM {labels}""",
    "jobs": """
        SELECT event_id AS id, 'r' || CAST(user_id % 5 AS STRING) AS repo_id, CASE event_type WHEN 'view' THEN 'phase1' WHEN 'click' THEN 'phase2' WHEN 'purchase' THEN 'phase4' WHEN 'signup' THEN 'phase5' ELSE 'gitlog' END AS phase,
               'file' || CAST(user_id AS STRING) || '.go' AS target, CASE WHEN event_id % 10 < 6 THEN 'completed' WHEN event_id % 10 < 8 THEN 'pending' WHEN event_id % 10 = 8 THEN 'failed' ELSE 'in_progress' END AS status,
               CAST(floor(value * 100) AS BIGINT) AS tokens_used, ts AS created_at FROM {events}""",
    "runs": """
        SELECT o_orderkey AS id, 'r' || CAST(o_custkey % 5 AS STRING) AS repo_id, CAST(floor(o_totalprice) AS BIGINT) % 101 AS quality_overall, CAST(floor(o_totalprice) AS BIGINT) AS duration_ms, o_orderdate AS created_at FROM {orders}""",
    "decisions": """
        SELECT 'd' || CAST(o_orderkey AS STRING) AS id, 'r' || CAST(o_custkey % 5 AS STRING) AS repo_id, o_orderpriority AS summary, o_orderstatus <> 'F' AS still_valid, o_orderdate AS created_at, o_orderkey AS nth FROM {orders}""",
    "decision_entities": "SELECT DISTINCT 'd' || CAST(l_orderkey AS STRING) AS decision_id, 'p' || CAST(l_partkey AS STRING) AS entity_id FROM {lineitem}",
}


def _named(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def as_ctes(*names: str) -> str:
    """``WITH`` clause that defines the named graph tables over the base tables."""
    order: list[str] = []

    def visit(name: str) -> None:
        for below in _named(MAPPING[name]):
            if below in MAPPING:
                visit(below)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({re.sub(r'[{}]', '', MAPPING[n])})" for n in order)


#: Tables of the test graph that are joins and aggregates of the test tables: they are written once, as a store would hold them.
STORED = ("entities", "relationships", "cross_repo_relationships")
#: What has been written for an application and a folder of test tables.
_kept: dict[tuple[str, str, str], object] = {}


class TestGraph:
    """The graph tables over one folder of test tables, as DataFrames: ``graph.facts`` and so on."""

    __test__ = False

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in BASE_TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                sql = MAPPING[name]
                build = lambda: self.spark.sql(sql, **{n: self.table(n) for n in _named(sql)})
                self._made[name] = self.once(name, lambda: materialize(build())) if name in STORED else build()
        return self._made[name]

    def once(self, what: str, make: Callable[[], T]) -> T:
        """What ``make`` writes, made once for an application and folder."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, what)
        if key not in _kept:
            _kept[key] = make()
        return _kept[key]  # type: ignore[return-value]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in (*BASE_TABLES, *MAPPING):
            raise AttributeError(name)
        return self.table(name)

    @cached_property
    def query_vector(self) -> list[float]:
        """The vector of vec_id 0: one row, by its key."""
        row = self.table("embeddings").where("vec_id = 0").select("embedding").first()
        return [float(x) for x in row.embedding]


def read_graph(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All stored tables under ``root``, each with its fixed schema (nothing is inferred)."""
    return {name: spark.read.schema(ddl).parquet(f"{root}/{name}") for name, ddl in TABLES.items()}
