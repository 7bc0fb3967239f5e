"""Structured Streaming operators."""

from usertrail.streaming.live import (
    live_totals,
    read_event_stream,
    run_available_now,
    stream_profiles,
    stream_sessions,
    stream_user_counts,
)
from usertrail.streaming.stateful import (
    column_sessions,
    gap_sessions,
    rocksdb_state,
    stream_column_runs,
    stream_gap_sessions,
)
from usertrail.streaming.store import ChangeLog, ProfileStore

__all__ = ["ChangeLog", "ProfileStore", "column_sessions", "gap_sessions", "live_totals", "read_event_stream", "rocksdb_state",
           "run_available_now", "stream_column_runs", "stream_gap_sessions", "stream_profiles", "stream_sessions", "stream_user_counts"]
