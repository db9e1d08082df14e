"""All registered queries."""

from leadlake.plans import cleaning, evaluation, ingesting, modelling, monitoring, ranking  # noqa: F401
from leadlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
