"""The registered queries: each an operator run over the derived tables, with its oracle."""

from vulnspark.plans.queries.registry import ORACLES, QUERIES
from vulnspark.plans.queries import context, evidence, feeds, inventory, lifecycle, matching, reporting, views  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
