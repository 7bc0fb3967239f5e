"""Sources (S1-S8) and sinks."""

from usertrail.sources.json_array import read_json_array
from usertrail.sources.reader import ReadError, read_events, read_parts
from usertrail.sources.sinks import export_users, write_profiles

__all__ = ["ReadError", "export_users", "read_events", "read_json_array", "read_parts",
           "write_profiles"]
