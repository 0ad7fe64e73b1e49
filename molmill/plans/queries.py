"""All queries of the package's own operators."""

from . import q_filters, q_graphs, q_jobs, q_sampling, q_scores, q_space, q_stats, q_text  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
