"""usertrail -- user-by-user event-log analytics on Spark DataFrames."""

from usertrail.plans.pipeline import Analysis, Options, analyze
from usertrail.sources.reader import ReadError, read_events

__all__ = ["Analysis", "Options", "ReadError", "analyze", "read_events"]
__version__ = "0.1.0"
