"""Column-expression helpers (all built-in Spark functions, codegen friendly)."""

from usertrail.functions.text import first_token, last_token, named
from usertrail.functions.timefmt import (
    NULL_TS_KEY,
    fmt_hhmm,
    fmt_minute,
    fmt_ts,
    parse_string_ts,
    ts_key,
)

__all__ = [
    "NULL_TS_KEY", "first_token", "fmt_hhmm", "fmt_minute", "fmt_ts", "last_token",
    "named", "parse_string_ts", "ts_key",
]
