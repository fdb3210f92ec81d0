"""All queries of the audit library and their SQL."""

from attestry.plans import data, estimates, experiments, provenance, resampling, surveys
from attestry.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "data", "estimates", "experiments", "provenance", "resampling", "surveys"]
