"""Near-duplicate classes by BagMinHash over five-word shingles.

A document is the multiset of its shingles.  ``signatures`` draws, per shingle,
Poisson processes over the dyadic pieces (0, 1], (1, 2], (2, 4], ... of its count;
each point carries an arrival time and a signature component, and every component
keeps its earliest point (Ertl, 2018).  A piece that the count covers in part is
descended: a point's bits halve the piece until its part lies within or beyond
the count, so points beyond fall away.  A process ends as soon as it is later than
every component's earliest point.  Two documents agree in a component with
probability equal to their weighted Jaccard similarity, without bias.

Signatures are cut into bands.  A bucket is led by its member with most neighbours
over all bands (the original, in a group of copies), and every text is tried with the
best of its leaders: one pair a member joins such a group to one class.  Members of
one bucket that are of different classes still are tried with each other, unless
their own shingles, which no other candidate has, and what each has in common with
the leader both were tried with bound their similarity below the threshold.  Every pair is verified on the exact shingle counts; nothing emits all
pairs of a group.  With 32 bands of five, a pair at the
threshold of 0.8 meets in some band with probability 1 - 3e-6.

Defined cases: equal texts are always one class, also without words (a null text
is empty); a text of one to four words is one shingle; repeated rows share a
class; a class is named by its least document id, null if none of them has one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usertrail.llm.common import (
    WordHashes, bounded_batches, column, give_back, landed, mix64, narrowed, partitions, shingle_hashes, slices, text_of, texts, word_bytes,
)

BANDS, ROWS = 32, 5
SIZE = BANDS * ROWS
MEMBERS_A_TASK = 250
POINTS = 1 << 13
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


# ------------------------------------------------------------------ signatures

def shingle_counts(text: str, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes and how often each occurs."""
    return np.unique(shingle_hashes(hashes(word_bytes(text.encode()))), return_counts=True)


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _within(bits: np.ndarray, low: np.ndarray, high: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Descend the dyadic piece (low, high] by bits: whether the point lies within the weight."""
    low, high, kept = low.copy(), high.copy(), np.zeros(len(bits), bool)
    open_ = np.arange(len(bits))
    level = 0
    while len(open_):
        done = high[open_] <= weight[open_]
        kept[open_[done]] = True
        open_ = open_[~done & (low[open_] < weight[open_])]
        middle = (low[open_] + high[open_]) // 2
        right = (bits[open_] >> np.uint64(level)) & np.uint64(1) == 1
        low[open_] = np.where(right, middle, low[open_])
        high[open_] = np.where(right, high[open_], middle)
        level += 1
    return kept


def signatures(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n_docs: int, size: int = SIZE) -> np.ndarray:
    """n_docs x size arrival times (infinite for a document without shingles)."""
    pieces = [(doc, shingle, count, np.zeros(len(doc), np.int64), np.ones(len(doc), np.int64))]
    low = 1
    while True:
        more = count > low
        if not more.any():
            break
        pieces.append((doc[more], mix64(shingle[more] + np.uint64(low * int(_GOLDEN) % 2**64)), count[more],
                       np.full(more.sum(), low, np.int64), np.full(more.sum(), 2 * low, np.int64)))
        low *= 2
    doc, seed, count, low, high = (np.concatenate(x) for x in zip(*pieces))
    best = np.full(n_docs * size, np.inf)
    by_doc, latest = best.reshape(n_docs, size), np.full(n_docs, np.inf)
    time, step = np.zeros(len(doc)), 0
    while len(doc):
        # several points of each process at once where few processes are left; points later than needed change nothing
        steps = np.arange(step + 1, step + 1 + max(1, min(POINTS // len(doc), size)), dtype=np.uint64)[:, None]
        step += len(steps)
        r = mix64(seed + steps * _GOLDEN)
        times = np.log(_unit(r))
        times /= low - high
        times[0] += time
        times = np.cumsum(times, axis=0)
        s = mix64(r ^ np.uint64(0xA0761D6478BD642F))
        at = ((s >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).view(np.int64) + doc * size
        partial = np.flatnonzero(high > count)
        if len(partial):
            ends = [np.broadcast_to(x[partial], (len(steps), len(partial))).ravel() for x in (low, high, count)]
            within = _within(mix64(s[:, partial] + _GOLDEN).ravel(), *ends)
            kept = np.ones(at.shape, bool)
            kept[:, partial] = within.reshape(len(steps), -1)
            np.minimum.at(best, at[kept], times[kept])
        else:
            np.minimum.at(best, at.ravel(), times.ravel())
        time = times[-1]
        here = np.zeros(n_docs, bool)
        here[doc] = True
        latest[here] = by_doc[here].max(axis=1)
        live = np.flatnonzero(time < latest[doc])
        doc, seed, count, low, high, time = (x[live] for x in (doc, seed, count, low, high, time))
    return by_doc


def band_keys(times: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key a band."""
    bits = mix64(times.view(np.uint64)).reshape(len(times), bands, -1)
    out = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64)), bits.shape[:2]).copy()
    for k in range(bits.shape[2]):
        out = mix64(out ^ bits[:, :, k]) + _GOLDEN
    return out.view(np.int64)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """The size of two sorted multisets' intersection."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    return int(np.minimum(a[1][i], b[1][j]).sum())


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted multisets."""
    both = overlap(a, b)
    return both / max(int(a[1].sum() + b[1].sum()) - both, 1)


# ------------------------------------------------------------------ texts and buckets

def _text_key(name: str = "text"):
    return F.unhex(F.md5(text_of(name).cast("binary")))


def sketch(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's text key and band keys, written once; copies within a batch are sketched once."""
    rows = bounded_batches(docs).select(F.col(key).alias("key"), text_of(text).alias("text"))
    key_type = docs.schema[key].dataType.simpleString()

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, max_bytes=2 << 20):
            keys, bands, seen, counts, of = [], [None] * batch.num_rows, set(), [], []
            for i, t in enumerate(texts(batch)):
                k = hashlib.md5(t.encode()).digest()
                keys.append(k)
                if k not in seen:
                    seen.add(k)
                    got = shingle_counts(t, hashes)
                    if len(got[0]):
                        of.append(i)
                        counts.append(got)
            if of:
                sizes = [len(c[0]) for c in counts]
                times = signatures(np.repeat(np.arange(len(of)), sizes), np.concatenate([c[0] for c in counts]),
                                   np.concatenate([c[1] for c in counts]), len(of))
                for i, b in zip(of, band_keys(times)):
                    bands[i] = b
            yield pa.RecordBatch.from_arrays(
                [column(batch, "key"), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["key", "t", "bands"])
        give_back()

    return landed(rows.mapInArrow(draw, f"key {key_type}, t binary, bands array<long>"), "bag-sketch")


def distinct_texts(sketched: DataFrame) -> DataFrame:
    """A node per distinct text: node, t, first (the least id) and bands."""
    return landed(sketched.groupBy("t").agg(F.min("key").alias("first"), F.first("bands", ignorenulls=True).alias("bands"))
                  .withColumn("node", F.monotonically_increasing_id()), "bag-nodes")


def _roles(pairs: DataFrame) -> DataFrame:
    """(node, lead, salt, member): each lead's members spread over as many salts as they need."""
    pairs = pairs.select("lead", "node")
    sizes = pairs.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_A_TASK).cast("int").alias("salts"))
    members = pairs.join(sizes, "lead").select(
        "node", "lead", F.expr("cast(pmod(xxhash64(node), salts) as int)").alias("salt"), F.lit(1).alias("member"))
    leads = sizes.select(F.col("lead").alias("node"), "lead", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
                         F.lit(0).alias("member"))
    return members.unionByName(leads)


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: float, *, text: str = "text") -> DataFrame:
    """The pairs (lead, node) with the size of their intersection, ``both``, and whether
    their exact similarity reaches the threshold, ``link``.

    A bitmap leaves out texts that are in no pair; the others come together by key,
    copies combined before the shuffle; what then moves are their shingle counts.  A
    lead's rows stream through one task a salt, the lead first.
    """
    pairs = landed(pairs.select("lead", "node"), "bag-pairs")
    roles = _roles(pairs).join(nodes.select("node", "t"), "node")
    roles = landed(roles.groupBy("t").agg(F.collect_set(F.struct("node", "lead", "salt", "member")).alias("roles")), "bag-roles")
    all_texts = docs.select(_text_key(text).alias("t"), text_of(text).alias("text"))
    once = narrowed(all_texts, F.xxhash64("t"), roles, F.xxhash64("t")).groupBy("t").agg(F.first("text").alias("text"))
    rows = once.join(roles, "t")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, max_bytes=1 << 20):
            out = []
            for t, roles_ in zip(texts(batch), column(batch, "roles").to_pylist()):
                h, n = shingle_counts(t, hashes)
                raw = h.astype("<u8").tobytes() + n.astype("<u4").tobytes()
                out += [(r["lead"], r["salt"], r["member"], r["node"], raw) for r in roles_]
            for lo in range(0, len(out), 500):
                cols = list(zip(*out[lo:lo + 500]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))],
                    ["lead", "salt", "member", "node", "counts"])

    def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        n = len(raw) // 12
        return np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<u4", n, 8 * n).astype(np.int64)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (None, None)
        for batch in slices(batches, "counts", 4 << 20):
            out = []
            for lead, member, node, raw in zip(*(column(batch, c).to_pylist() for c in ("lead", "member", "node", "counts"))):
                if member == 0:
                    held = (lead, unpack(raw))
                elif held[0] == lead:
                    other = unpack(raw)
                    both = overlap(held[1], other)
                    either = int(held[1][1].sum() + other[1].sum()) - both
                    out.append((lead, node, both, both >= threshold * max(either, 1)))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.bool_())],
                                             ["lead", "node", "both", "link"])

    packed = rows.select("text", "roles").mapInArrow(pack, "lead long, salt int, member int, node long, counts binary")
    return (packed.repartition(partitions(docs.sparkSession), "lead", "salt").sortWithinPartitions("lead", "salt", "member")
            .mapInArrow(compare, "lead long, node long, both long, link boolean"))


def _own_shares(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """node, total and own: its shingles, and those of them that no other wanted text has.

    What only one text has no pair can share, so two texts are at most as similar as
    the rest of theirs allows.
    """
    wanted = landed(wanted.join(nodes.select("node", "t"), "node"), "bag-wanted")
    all_texts = docs.select(_text_key(text).alias("t"), text_of(text).alias("text"))
    once = narrowed(all_texts, F.xxhash64("t"), wanted, F.xxhash64("t")).groupBy("t").agg(F.first("text").alias("text"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, max_bytes=1 << 20):
            found = [shingle_counts(t, hashes) for t in texts(batch)]
            ids = np.asarray(column(batch, "node"))
            sizes = [len(h) + 1 for h, _ in found]
            # besides its shingles, one row that no other text has: it brings the total of texts without own shingles
            marks = mix64(ids.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, sizes)),
                 pa.array(np.concatenate([x for (h, _), m in zip(found, marks) for x in (h, [m])]).astype(np.uint64).view(np.int64)),
                 pa.array(np.concatenate([x for _, n in found for x in (n, [0])]).astype(np.int64)),
                 pa.array(np.repeat([int(n.sum()) for _, n in found], sizes).astype(np.int64))], ["node", "h", "n", "total"])

    rows = once.join(wanted, "t").select("node", "text").mapInArrow(spread, "node long, h long, n long, total long")
    alone = rows.groupBy("h").agg(F.min("node").alias("node"), F.max("node").alias("other"), F.sum("n").alias("n"),
                                  F.max("total").alias("total")).where("node = other")
    return alone.groupBy("node").agg(F.sum("n").alias("own"), F.max("total").alias("total"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node but the roots: large-star and small-star rounds (Kiveris et al., 2014)."""
    def oriented(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    edges, mark = landed(oriented(links.toDF("a", "b")), "bag-edges"), None
    while True:
        seen = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.expr("cast(xxhash64(a, b) as decimal(38, 0))"))).first())
        if seen == mark or seen[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = oriented(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        edges = landed(oriented(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            small.select("a", F.col("m").alias("b")))), "bag-edges")


def _most() -> Column:
    """The largest intersection that texts x and y can have.

    Own shingles are in no other text.  Where both were tried with the same hub, the
    intersection lies within the hub as far as both meet it, and outside as far as
    both have shingles there that are not their own.
    """
    def least(of) -> Column:
        return F.least(of("x"), of("y"))

    free = least(lambda t: F.col(f"{t}.total") - F.col(f"{t}.own"))
    by_hub = least(lambda t: F.col(f"{t}.both")) + least(lambda t: F.col(f"{t}.total") - F.col(f"{t}.both") - F.col(f"{t}.own"))
    # a hub's own shingles lie within itself
    outside = F.when(F.col("x.hub") == F.col("y.hub"), F.when(
        (F.col("x.node") != F.col("x.hub")) & (F.col("y.node") != F.col("y.hub")), by_hub))
    return F.least(free, F.coalesce(outside, free))


def classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(documents, nodes): key, t and node of each document; t, node, first and root of each distinct text."""
    sketched = sketch(docs, key=key, text=text)
    nodes = distinct_texts(sketched)
    rows = nodes.select("node", F.explode("bands").alias("band"))
    buckets = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = landed(rows.join(buckets, "band"), "bag-buckets")
    # the original of many copies is in the largest buckets: who has most neighbours leads
    weight = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    members = shared.select("band", "node").join(weight, "node").select("band", F.struct("weight", (-F.col("node")).alias("col2")).alias("m"))
    leads = members.groupBy("band").agg(F.max("m").alias("lead"))
    tried = members.join(leads, "band").groupBy("m").agg(F.max("lead").alias("lead")).where("m <> lead")
    tried = landed(tried.select((-F.col("lead.col2")).alias("lead"), (-F.col("m.col2")).alias("node")), "bag-tried")
    tried = landed(verified(tried, nodes, docs, threshold, text=text), "bag-tried")
    links = tried.where("link").select("lead", "node")
    roots = components(links)

    # what the leaders left apart: pairs of one bucket from different classes
    rest = shared.select("band", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = rest.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band")
    rest = landed(rest.join(split, "band"), "bag-rest")
    wanted = rest.select("node").distinct().join(tried.select("node", F.col("lead").alias("hub"), "both"), "node", "left")
    wanted = landed(wanted.withColumn("hub", F.coalesce("hub", "node")), "bag-wanted")
    everyone = wanted.select("node").unionByName(wanted.select(F.col("hub").alias("node"))).distinct()
    sizes = wanted.join(_own_shares(everyone, nodes, docs, text), "node")
    sizes = sizes.where((F.col("total") - F.col("own")) >= threshold * F.col("total")).select(
        "node", "hub", "total", "own", F.coalesce("both", "total").alias("both"))
    rest = landed(rest.join(sizes, "node").join(nodes.select("node", "bands"), "node"), "bag-rest")
    x, y = rest.alias("x"), rest.alias("y")
    shares = F.array_intersect("x.bands", "y.bands")
    across = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.node") < F.col("y.node")) & (
        F.col("x.root") != F.col("y.root")) & (_most() >= threshold * (F.col("x.total") + F.col("y.total") - _most())) & (
        F.size(shares) >= 2) & (F.array_min(shares) == F.col("x.band"))).select(
        F.col("x.node").alias("lead"), F.col("y.node").alias("node"))
    both_ways = tried.select("lead", "node").unionByName(tried.select(F.col("node").alias("lead"), F.col("lead").alias("node")))
    across = landed(across.join(both_ways, ["lead", "node"], "left_anti"), "bag-across")
    if not across.isEmpty():
        found = landed(verified(across, nodes, docs, threshold, text=text).where("link").select("lead", "node"), "bag-links")
        if not found.isEmpty():
            roots = components(links.unionByName(found))
    named = nodes.select("t", "node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return sketched.select("key", "t"), named


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """A row per document: key, class_id (the least id of its class) and whether its text has the class's name."""
    members, named = classes(docs, key=key, text=text, threshold=threshold)
    names = named.groupBy("root").agg(F.min("first").alias("class_id"))
    by_text = named.join(names, "root").select("t", "class_id")
    return members.join(by_text, "t").select("key", "class_id")


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """One document of each class, all columns: of the class's texts the one with the least id (ids before nulls)."""
    _, named = classes(docs, key=key, text=text, threshold=threshold)
    rank = F.struct(F.col("first").isNull(), F.col("first"), F.col("node"))
    kept = named.groupBy("root").agg(F.min(rank).alias("kept")).select(F.col("kept.node").alias("node")).join(
        named.select("node", "t"), "node").select("t")
    cols = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in cols])
    once = docs.select(_text_key(text).alias("t"), F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.xxhash64(
        *[F.col(f"`{c}`") for c in cols]).alias("h")).alias("rank"), row.alias("doc")).groupBy("t").agg(
        F.min_by("doc", "rank").alias("doc"))
    return once.join(kept, "t").select("doc.*")
