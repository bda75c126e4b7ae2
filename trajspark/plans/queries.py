"""All queries on the driver's tables, with the SQL of those that SQL can express."""

from trajspark.plans import epoch_queries, join_queries, source_queries, stream_queries, track_queries  # noqa: F401
from trajspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
