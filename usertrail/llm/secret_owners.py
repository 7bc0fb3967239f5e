"""Secrets, judged by who else has them.

A scan finds candidate spans in every text: the base patterns (an assignment to a
telling name, an access key id, a long hex run) and, beyond them, any long token of
high entropy.  Candidate values are hashed and aggregated over the corpus by
distinct owners and, where the table names them, distinct repositories.  A value that
more than ``max_owners`` owners or ``max_repositories`` repositories have is a copied
example; without a repository column owners alone decide, so copies of a text by one
owner stay that owner's.  A value that stays with its owners and does not look like a
placeholder is taken for a live credential.  Base spans are always reported,
with that verdict; a high-entropy token is added only if it is live.

Defined cases: a null text is empty; a missing owner or repository counts as one
unnamed owner or repository; equal rows are reported row by row.  Values are
compared by a keyed 128-bit hash and never leave the scan in the clear.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usertrail.llm.common import bounded_batches, column, landed, slices, text_of, texts

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                     re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a run is taken whole, so shorter runs can't hide a longer one
_LONG = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_PLACEHOLDER = re.compile(r"example|sample|dummy|changeme|placeholder|your|test|xxxx|1234567|abcdef", re.IGNORECASE)
ASSIGN_VALUE, ACCESS_LENGTH = 6, 20
KINDS = ("assign", "access", "hex", "entropy")


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * log2(c / n) for c in Counter(value).values()) if n else 0.0


def looks_live(value: str, least_bits: float = 3.0) -> bool:
    """Of high entropy, with letters and digits, and without a placeholder's words."""
    return (entropy(value) >= least_bits and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
            and not _PLACEHOLDER.search(value))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's number, end, value) of the base patterns, in order."""
    found = [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found)


def long_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Long tokens of high entropy that no base span touches."""
    out = []
    for m in _LONG.finditer(text):
        if any(c.isdigit() for c in m[0]) and looks_live(m[0]) and not any(
                s < m.end() and m.start() < e for s, _, e, _ in base):
            out.append((m.start(), 3, m.end(), m[0]))
    return out


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[s[1]]}:{s[0]}:{s[2]}" for s in sorted(spans))


_FOUND = ("row long, {}, n_assign long, n_access long, n_hex long, base_sha256 string, "
          "found array<struct<start:long,kind:int,end:long,value:string,live:boolean>>")


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", repository: str | None = None,
         owner: str = "source", salt: bytes = b"usertrail") -> DataFrame:
    """Candidates of each document, with its repository and owner, written once."""
    named = F.lit(None) if repository is None else F.col(repository)
    rows = bounded_batches(docs).select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), named.cast("string").alias("repository"),
        F.col(owner).cast("string").alias("owner"), text_of(text).alias("text"))
    fixed = f"key {docs.schema[key].dataType.simpleString()}, repository string, owner string"
    item = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.string()),
                      ("live", pa.bool_())])

    def hashed(value: str) -> str:
        return hashlib.blake2b(value.encode(), digest_size=16, key=salt).hexdigest()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, shas, found = ([], [], []), [], []
            for t in texts(batch):
                base = base_spans(t)
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in base))
                shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
                found.append([{"start": s, "kind": k, "end": e, "value": hashed(v), "live": looks_live(v)}
                              for s, k, e, v in base + long_spans(t, base)])
            yield pa.RecordBatch.from_arrays(
                [column(batch, "row"), column(batch, "key"), column(batch, "repository"), column(batch, "owner"),
                 *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(found, pa.list_(item))],
                ["row", "key", "repository", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "found"])

    return landed(rows.mapInArrow(find, _FOUND.format(fixed)), "secrets")


def ownership(scanned: DataFrame) -> DataFrame:
    """value -> distinct repositories and owners; each step pre-aggregates before it shuffles."""
    seen = scanned.select(F.explode("found.value").alias("value"), F.coalesce("owner", F.lit("")).alias("owner"),
                          F.coalesce("repository", F.lit("")).alias("repository")).distinct()
    by_owner = seen.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("n"))
    repositories = seen.select("value", "repository").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("n_repositories"))
    return by_owner.groupBy("value").agg(F.count(F.lit(1)).alias("n_owners")).join(repositories, "value")


def judge(scanned: DataFrame, max_owners: int = 2, max_repositories: int = 20) -> DataFrame:
    """A row per document: base counts and digest, all spans, and how many are live or copied."""
    spans = scanned.where(F.size("found") > 0).select("row", F.explode("found").alias("f")).select("row", "f.*")
    judged = spans.join(ownership(scanned), "value").withColumn(
        "copied", (F.col("n_owners") > max_owners) | (F.col("n_repositories") > max_repositories))
    judged = judged.withColumn("live", F.col("live") & ~F.col("copied")).where((F.col("kind") < 3) | F.col("live"))
    per_row = judged.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"),
        F.sum((F.col("kind") == 3).cast("long")).alias("n_added"),
        F.sum(F.col("live").cast("long")).alias("n_live"), F.sum(F.col("copied").cast("long")).alias("n_copied"))
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(
        ":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"),
        s["end"].cast("string"))), ",")
    per_row = per_row.withColumn("spans", text)
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_added", "n_live", "n_copied")]
    return scanned.join(per_row, "row", "left").select(
        "key", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"), *zero)
