"""Sinks: all-user profile export (S9) and scoped user export.

Writes are distributed (one file per partition); nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def _flat_profile(profiles: DataFrame) -> DataFrame:
    return profiles.select("user_id", "events", "sessions", "first_seen", "last_seen",
                           "family_counts", "attrs")


def write_profiles(profiles: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """One record per user (``json`` lines or ``parquet``)."""
    out = _flat_profile(profiles)
    writer = out.write.mode(mode)
    if fmt == "json":
        writer.json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported profile format {fmt!r}")


def export_users(selected: DataFrame, session_events: DataFrame, path: str,
                 mode: str = "overwrite") -> None:
    """Write the chosen users' profiles and their (long-form) session events.

    ``selected`` is the already filtered profile table (see ``queries.export_subset``);
    events are restricted with a semi join, not an id list on the driver.
    """
    _flat_profile(selected).write.mode(mode).json(f"{path}/profiles")
    ev = session_events.join(selected.select("user_id"), "user_id", "left_semi")
    ev.write.mode(mode).json(f"{path}/events")

