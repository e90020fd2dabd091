"""All queries of the catalogue, and their SQL."""

from . import check_queries, detector_queries, store_queries, tenant_queries  # noqa: F401  (they add to the catalogue)
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
