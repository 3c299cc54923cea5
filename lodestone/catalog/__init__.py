"""One query for each operator, by operator ID."""

from lodestone.catalog import api, graphs, ingest, relational, search  # noqa: F401
from lodestone.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
