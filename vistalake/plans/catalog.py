"""All registered queries of the engine proper."""

from vistalake.plans import coherence, evidence, files, hypervectors, intake, live, matching, pixels, programs, rules, signals, spatial, steps, trees  # noqa: F401
from vistalake.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
