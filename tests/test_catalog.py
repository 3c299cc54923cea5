"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from lodestone import catalog
from lodestone.sources.graph import BASE_TABLES

SF = "/root/testdata/sf0.001"
CHECKED = ("flt4_search_names", "join10_mentions", "sr6_text_match", "sr19_hybrid_search", "gr2_all_services", "q08_task_context", "q18_overview", "join2_orphans", "join4_with_edges", "join11_match_repos", "agg13_quality", "top4_diversify", "gr3_strongest_neighbours", "gr7_weighted", "sr1_vector_top", "sr9_fuzzy", "dml2_upsert_entities", "dml11_claim_jobs", "dml13_feedback", "js3_extraction", "q16_repo_details")


def cell(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return None
    if hasattr(x, "isoformat"):
        return pd.Timestamp(x).isoformat()
    if isinstance(x, float) or type(x).__name__.startswith("float"):
        return f"{float(x):.9g}"
    return str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted([tuple(cell(x) for x in r) for r in frame.itertuples(index=False, name=None)], key=str)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_its_sql(spark, name):
    db = duckdb.connect()
    db.sql("SET TimeZone='UTC'")
    for t in BASE_TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), db.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_and_names(spark):
    import __spark_entry__

    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
    assert catalog.QUERIES.keys() <= __spark_entry__.queries().keys()
    assert __spark_entry__.entry(spark).count() > 0
