"""All queries of the core, and their SQL."""

from quire.catalog import chunks, labels, records, sample, structure  # noqa: F401
from quire.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
