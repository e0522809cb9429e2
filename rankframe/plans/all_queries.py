"""All registered queries and their SQL."""

from rankframe.plans import io_queries, run_queries  # noqa: F401  (they register theirs)
from rankframe.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
