"""Registration of queries over the test graph and of the SQL that states the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.sources.graph import MAPPING, TestGraph, as_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[TestGraph], DataFrame]], Callable[[TestGraph], DataFrame]]:
    """Register a function of the graph under ``name``; ``sql`` may name graph tables and starts after their WITH clause."""

    def register(build: Callable[[TestGraph], DataFrame]) -> Callable[[TestGraph], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: build(TestGraph(spark, sf_dir))
        if sql is not None:
            used = [t for t in MAPPING if re.search(rf"\b{t}\b", sql)]
            own = sql.strip()
            if own.startswith("WITH "):
                own = own[5:].removeprefix("RECURSIVE ")
                ORACLES[name] = f"{as_ctes(*used)},\n{own}" if used else sql
            else:
                ORACLES[name] = f"{as_ctes(*used)}\n{own}" if used else sql
        return build

    return register
