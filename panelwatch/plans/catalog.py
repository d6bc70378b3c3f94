"""Collects the queries of all families."""

from panelwatch.plans import oracle_base, q_classify, q_forecast, q_gold, q_inference, q_long, q_panel, q_text  # noqa: F401
from panelwatch.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
