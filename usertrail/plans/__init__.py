"""Plans: the pipeline orchestration and the query surface."""

from usertrail.plans.pipeline import Analysis, Options, analyze

__all__ = ["Analysis", "Options", "analyze"]
