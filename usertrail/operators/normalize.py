"""Normalisation (N1-N7): canonical names, types, ordering key, redaction.

Output columns: ``user_id`` (string), ``ts`` (TIMESTAMP, UTC), ``event_name``,
optional ``session_id``, ``ts_key`` (long, nulls first), ``ord`` (tie-break),
followed by the extras.  No global sort: per-user order lives in the window
specs downstream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usertrail.constants import EPOCH_MILLIS_ABOVE, REDACTED
from usertrail.functions.timefmt import parse_string_ts, ts_key
from usertrail.operators.resolve import ResolvedSchema, SchemaError

CANONICAL = ("user_id", "ts", "event_name", "session_id")
#: Names of columns that the library adds to events, timelines and profiles.
RESERVED = frozenset(CANONICAL) | {
    "ts_key", "ord", "bucket", "pos", "session_no", "is_start", "prev_name", "prev_ts_key", "prev_start_key",
    "run_no", "family", "props", "attrs"}
_OWN = "extra__"


def extra_column(name: str) -> str:
    """The column that holds the input's extra ``name``: its own name, unless the
    library uses that one itself; names with a leading underscore are the library's."""
    return _OWN + name if name.lower() in RESERVED or name.startswith(("_", _OWN)) else name


def _rename(df: DataFrame, schema: ResolvedSchema) -> DataFrame:
    roles = {schema.user_id: "user_id", schema.timestamp: "ts", schema.event_name: "event_name"}
    if schema.session_id:
        roles[schema.session_id] = "session_id"
    return df.select(*[F.col(f"`{c}`").alias(roles.get(c) or extra_column(c)) for c in df.columns])


def parse_timestamp(df: DataFrame, col: str = "ts") -> DataFrame:
    """Bring any supported time type to TIMESTAMP."""
    dtype = df.schema[col].dataType
    c = F.col(col)
    if isinstance(dtype, T.TimestampType):
        return df
    if isinstance(dtype, (T.TimestampNTZType, T.DateType)):
        return df.withColumn(col, c.cast("timestamp"))
    if isinstance(dtype, T.StringType):
        return df.withColumn(col, parse_string_ts(c))
    if isinstance(dtype, T.NumericType):
        # One scalar probe decides seconds vs milliseconds for the whole column.
        max_val = df.agg(F.max(c.cast("double")).alias("m")).first()["m"]
        millis = max_val is not None and max_val > EPOCH_MILLIS_ABOVE
        if isinstance(dtype, T.IntegralType):
            out = F.timestamp_millis(c.cast("long")) if millis else F.timestamp_seconds(c.cast("long"))
        else:  # float epoch (accepted here, crashes later in the original)
            out = F.timestamp_micros((c.cast("double") * (1000.0 if millis else 1_000_000.0)).cast("long"))
        return df.withColumn(col, out)
    raise SchemaError(f"Unsupported timestamp column type: {dtype.simpleString()}")


def default_order(extras: Sequence[str], dtypes: dict | None = None) -> Column:
    """D3: deterministic tie-break when no order column is given."""
    if not extras:
        return F.xxhash64(F.lit(0))
    dtypes = dtypes or {}

    def hashable(c: str) -> Column:
        # maps cannot be hashed directly: hash their JSON text instead
        col = F.col(f"`{extra_column(c)}`")
        return F.to_json(col) if isinstance(dtypes.get(extra_column(c)), T.MapType) else col

    return F.xxhash64(*[hashable(c) for c in extras])


def hmac_pads(key: bytes) -> tuple[bytes, bytes]:
    """The inner and outer block of HMAC-SHA256 (RFC 2104) for a key."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def keyed_digest(c: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a text column, in hex; null for null."""
    inner, outer = map(F.lit, map(bytearray, hmac_pads(key)))
    text = c.cast("string").cast("binary")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, text), 256))), 256)


def _redact_roles(out: DataFrame, schema: ResolvedSchema, redact: Sequence[str], key: bytes | str | None) -> DataFrame:
    """N7 for role columns.  Event names become one constant, as extras do.  A user or
    session id becomes a digest under the caller's key instead, which keeps whose rows are whose
    and can't be undone by hashing all ids without the key; a redacted time would leave
    nothing to analyse."""
    ids = [c for c in (schema.user_id, schema.session_id) if c and c in redact]
    if ids and not key:
        raise SchemaError(f"redacting the id column(s) {ids} needs Options(redact_key=...), a secret of yours")
    secret = key.encode() if isinstance(key, str) else key

    def digest(c: str) -> Column:
        return F.concat(F.lit("redacted-"), F.substring(keyed_digest(F.col(c), secret), 1, 32))

    if schema.timestamp in redact:
        raise SchemaError(f"the time column {schema.timestamp!r} cannot be redacted: every result is about time")
    if schema.event_name in redact:
        out = out.withColumn("event_name", F.when(F.col("event_name").isNotNull(), F.lit(REDACTED)))
    if schema.user_id in redact:
        out = out.withColumn("user_id", digest("user_id"))
    if schema.session_id and schema.session_id in redact:
        out = out.withColumn("session_id", digest("session_id"))
    return out


def normalize(df: DataFrame, schema: ResolvedSchema, *, order_by: Sequence[str] | str | None = None,
              redact: Sequence[str] = (), redact_key: bytes | str | None = None) -> DataFrame:
    """N1-N5 + N7. ``order_by`` names the caller's tie-break column(s)."""
    out = _rename(df, schema)
    out = out.withColumn("user_id", F.col("user_id").cast("string"))
    if not isinstance(out.schema["event_name"].dataType, T.StringType):
        out = out.withColumn("event_name", F.col("event_name").cast("string"))
    out = parse_timestamp(out, "ts")

    extras = list(schema.extras)
    # Whole-column redaction, before classification; unknown names ignored.
    red = {extra_column(c): F.lit(REDACTED) for c in redact if c in extras}
    if red:
        out = out.withColumns(red)
    out = _redact_roles(out, schema, redact, redact_key)

    if isinstance(order_by, str):
        order_by = [order_by]
    if order_by:
        order_by = [extra_column(c) if c in extras else c for c in order_by]
        missing = [c for c in order_by if c not in out.columns]
        if missing:
            raise SchemaError(f"order column(s) {missing} not found")
        ord_col = F.struct(*[F.col(f"`{c}`") for c in order_by]) if len(order_by) > 1 \
            else F.col(f"`{order_by[0]}`")
    else:
        dtypes = {f.name: f.dataType for f in out.schema.fields}
        ord_col = F.struct(F.col("event_name"), default_order(extras, dtypes))

    head = ["user_id", "ts", "event_name"] + (["session_id"] if schema.session_id else [])
    return out.select(
        *[F.col(c) for c in head],
        ts_key(F.col("ts")).alias("ts_key"),
        ord_col.alias("ord"),
        *[F.col(f"`{extra_column(c)}`") for c in extras],
    )
