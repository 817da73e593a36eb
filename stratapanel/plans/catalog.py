"""All registered panel queries and the SQL that each must equal."""

from stratapanel.plans import log_queries, loss_queries, model_queries, panel_queries, scaling_queries, score_queries, source_queries  # noqa: F401
from stratapanel.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
