"""Event-name tokenisation (F1): split on separators, lower-case, drop empties.

``first_token`` / ``last_token`` use ``regexp_extract`` (code-generated)
rather than ``filter(split(...))``, whose lambda would drop the projection
out of whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from usertrail.constants import TOKEN_SEPARATORS as _SEP


def last_token(name: Column) -> Column:
    tok = F.regexp_extract(F.lower(name), f"([^{_SEP}]+)[{_SEP}]*$", 1)
    return F.when(tok != F.lit(""), tok)


def first_token(name: Column) -> Column:
    tok = F.regexp_extract(F.lower(name), f"^[{_SEP}]*([^{_SEP}]+)", 1)
    return F.when(tok != F.lit(""), tok)


def named(name: Column) -> Column:
    """An event name for output: rows without a name are listed as ``None``."""
    return F.coalesce(name, F.lit("None"))
