"""All registered queries: importing the plan modules fills the registry."""

from turnloom.plans import join_plans, judge_plans, metric_plans, report_plans, stream_plans, text_plans, udf_plans  # noqa: F401
from turnloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
