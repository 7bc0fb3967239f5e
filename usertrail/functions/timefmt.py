"""Timestamp parsing, ordering keys and display formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from usertrail.constants import HHMM_FORMAT, MINUTE_FORMAT, TS_FORMAT

# Sort key used for rows whose timestamp is null: they order first (nulls-first
# semantics) and never take part in gap arithmetic.
NULL_TS_KEY = -(2**62)

# A string must at least start like an ISO date before we let Spark's lenient
# cast loose on it (a bare "2024" would otherwise become 2024-01-01).
_ISO_GUARD = r"^\s*\d{4}-\d{2}-\d{2}"


def parse_string_ts(c: Column) -> Column:
    """Lenient ISO-8601 parse; anything unparseable becomes null."""
    trimmed = F.trim(c)
    return F.when(trimmed.rlike(_ISO_GUARD), trimmed.try_cast("timestamp"))


def ts_key(ts: Column) -> Column:
    """Microseconds since the epoch; null timestamps map to ``NULL_TS_KEY``."""
    return F.coalesce(F.unix_micros(ts), F.lit(NULL_TS_KEY))


def _local(ts: Column, tz: str | None) -> Column:
    return F.from_utc_timestamp(ts, tz) if tz else ts


def fmt_ts(ts: Column, tz: str | None = None) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` in the display zone; null -> ''."""
    return F.coalesce(F.date_format(_local(ts, tz), TS_FORMAT), F.lit(""))


def fmt_hhmm(ts: Column, tz: str | None = None) -> Column:
    return F.coalesce(F.date_format(_local(ts, tz), HHMM_FORMAT), F.lit(""))


def fmt_minute(ts: Column, tz: str | None = None) -> Column:
    return F.coalesce(F.date_format(_local(ts, tz), MINUTE_FORMAT), F.lit(""))


def local_date(ts: Column, tz: str | None = None) -> Column:
    return F.to_date(_local(ts, tz))
