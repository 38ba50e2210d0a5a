"""The queries that show the operators on the driver's tables, and their SQL for a second engine."""

from . import build_queries, evaluation_queries, heldout_queries, metric_queries, model_queries, report_queries, score_queries, split_queries, stat_queries, vector_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
