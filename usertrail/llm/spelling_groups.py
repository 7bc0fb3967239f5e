"""Spelling variants by blocked Gram matrices of letter counts.

A word is counted in every text; task totals are merged by Spark.  Its letters are
counted in 32 places (a to z, and six for all others by code point), and in six
groups of letters, whose counts name its block.  One inserted or deleted letter
changes one group's count by one, one replaced letter moves one between two groups
(or stays in its own), so the only blocks that can hold a word's near words are its
own and the adjacent ones: 22 rows a word (half of the directions suffice, since
the neighbour comes from the other side).  In a block NumPy multiplies the letter counts of its words
with those of its visitors; |x|^2 + |y|^2 - 2xy is the squared distance, at most
two for near words.  Pairs at most two apart are verified letter by letter.

A block of many words is dealt out over parts of about ``part_words`` of its own words,
each of which meets all visitors; so a task holds one part and streams visitors.

Each word's form is its near word of the largest count where that is at least
``lead`` times its own; roots follow forms by doubling.  As every step multiplies
the count by ``lead``, the number of rounds follows from the largest count.

Defined cases: a null or empty text has no words; a null key counts as an empty
one; rows with repeated keys are texts like others; ties in count go to the smaller
word by code points; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usertrail.llm.common import ascii_lower, bounded_batches, column, give_back, landed, partitions, slices, text_of, texts

RUN = "[A-Za-zÀ-ÿ]"
PLACES, GROUPS = 32, 6
_COMMON_FIRST = "etaoinshrdlcumwfgypbvkjxqz"
_PLACE = np.asarray([c - 97 if 97 <= c < 123 else 26 + c % (PLACES - 26) for c in range(256)])
_GROUP = np.asarray([_COMMON_FIRST.index(chr(c)) % GROUPS if 97 <= c < 123 else c % GROUPS for c in range(256)])
#: Where a word visits, as changes of its group counts: half of the moves between groups, and one letter more.
_VISITS = [*([int(k == i) - int(k == j) for k in range(GROUPS)] for i in range(GROUPS) for j in range(i)),
           *([int(k == i) for k in range(GROUPS)] for i in range(GROUPS))]


def _seed(key: str | None, found: Counter, one_in: int) -> Iterator[tuple[str, int]]:
    """The words of one text and their counts, some runs with a letter deleted as their checksum says."""
    start = zlib.crc32(f"{'' if key is None else key}:".encode())
    for run, n in found.items():
        h = zlib.crc32(run.encode(), start)
        if h % one_in == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        yield run, n


def count_words(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_length: int = 6,
                min_count: int = 5, typo_one_in: int | None = 199, most: int = 200_000) -> DataFrame:
    """word and n, over all texts.  With ``typo_one_in`` some runs lose a letter first (planted variants)."""
    rows = bounded_batches(docs).select(F.col(key).cast("string").alias("key"), text_of(text).alias("text"))
    find = re.compile(f"{RUN}{{{max(min_length, 1)},}}").findall  # a deletion only shortens, so shorter runs give no word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                              ["word", "n"])

        for batch in slices(batches):
            for k, t in zip(column(batch, "key").to_pylist(), texts(batch)):
                found = Counter(find(ascii_lower(t)))
                for word, n in _seed(k, found, typo_one_in) if typo_one_in else found.items():
                    if len(word) >= min_length:
                        total[word] += n
            if len(total) > most:
                yield out()
                total.clear()
        if total:
            yield out()
        give_back()

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(
        F.col("n") >= min_count)


def _letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, one row a word."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def _counted(letters: np.ndarray, of: np.ndarray, width: int) -> np.ndarray:
    rows = np.repeat(np.arange(len(letters)) * width, letters.shape[1])
    return np.bincount(rows + of[letters].ravel(), minlength=len(letters) * width).reshape(len(letters), width)


def placed(words: DataFrame, part_words: int = 4096) -> DataFrame:
    """Rows (block, part, visits, word, n): every word at home, and wherever a near word may be at home."""
    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = column(batch, "word").to_pylist()
            counts = np.asarray([np.bincount(_GROUP[np.frombuffer(w.encode("latin-1"), np.uint8)], minlength=GROUPS)
                                 for w in found], np.int64).reshape(-1, GROUPS)
            for visits, change in enumerate([[0] * GROUPS, *_VISITS]):
                moved = counts + np.asarray(change)
                there = np.flatnonzero((moved >= 0).all(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r.tobytes() for r in moved[there].astype("<u4")], pa.binary()),
                     pa.array(np.full(len(there), visits > 0)), column(batch, "word").take(there),
                     column(batch, "n").take(there)], ["block", "visits", "word", "n"])

    rows = words.mapInArrow(homes, "block binary, visits boolean, word string, n long")
    parts = rows.where("not visits").groupBy("block").agg(F.ceil(F.count(F.lit(1)) / part_words).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    # inner: nobody visits a block where no word is at home
    rows = rows.join(parts, "block").withColumn("own", F.when(~F.col("visits"), own).otherwise(F.lit(-1)))
    spread = rows.withColumn("part", F.explode(F.sequence(F.greatest("own", F.lit(0)), F.col("parts") - 1)))
    return spread.select("block", "part", (F.col("part") != F.col("own")).alias("visits"), "word", "n")


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of letters are one edit apart; ``y`` is as long as ``x`` or one letter shorter."""
    if x.shape[1] == y.shape[1]:
        return (x != y).sum(axis=1) == 1
    before = np.logical_and.accumulate(x[:, :-1] == y, axis=1).sum(axis=1)
    behind = np.logical_and.accumulate((x[:, 1:] == y)[:, ::-1], axis=1).sum(axis=1)
    return before + behind >= y.shape[1]


class _Part:
    """The words at home in one part of a block, which visitors are held against."""

    def __init__(self, words: list[str], counts: list[int]):
        self.words, self.counts = words, np.asarray(counts)
        self.letters = _letters(words)
        self.places = self._places(self.letters)
        self.norms = (self.places ** 2).sum(axis=1)

    @staticmethod
    def _places(letters: np.ndarray) -> np.ndarray:
        # products are exact: below 2**24 in float32 up to 1000 letters, else in float64
        return _counted(letters, _PLACE, PLACES).astype(np.float32 if letters.shape[1] < 1000 else np.float64)

    def meet(self, words: list[str], counts: np.ndarray, own: int | None = None,
             cells: int = 4 << 20) -> Iterator[pa.RecordBatch]:
        """Near pairs with visitors of one length; ``own`` says that they are the home words from there on."""
        letters = _letters(words)
        places = self._places(letters)
        norms = (places ** 2).sum(axis=1)
        step = max(cells // max(len(self.words), 1), 1)
        for lo in range(0, len(words), step):
            gram = places[lo:lo + step] @ self.places.T
            far = norms[lo:lo + step, None] + self.norms[None] - 2 * gram
            at_y, at_x = np.nonzero(far <= 2)
            at_y += lo
            if own is not None:
                at_y, at_x = (a[at_x > at_y + own] for a in (at_y, at_x))
            per = max(cells // max(letters.shape[1], 1), 1)
            for k in range(0, len(at_x), per):
                i, j = at_x[k:k + per], at_y[k:k + per]
                good = _near(self.letters[i], letters[j])
                i, j = i[good], j[good]
                if len(i):
                    a, b = pa.array(self.words).take(pa.array(i)), pa.array(words).take(pa.array(j))
                    n_a, n_b = pa.array(self.counts[i]), pa.array(counts[j])
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(p) for p in ([a, b], [n_a, n_b], [b, a], [n_b, n_a])],
                                                     ["word", "n", "near", "near_n"])


def near_pairs(words: DataFrame, part_words: int = 4096) -> DataFrame:
    """Both directions (word, n, near, near_n) of all pairs of words one edit apart."""
    order = ["block", "part", "visits"]
    rows = placed(words, part_words).repartition(partitions(words.sparkSession), "block", "part").sortWithinPartitions(*order, "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, home, part = None, ([], []), None

        def settled() -> Iterator[pa.RecordBatch]:
            """The home words are known: they meet each other."""
            nonlocal part
            if part is None and home[0]:
                part = _Part(*home)
                yield from part.meet(part.words, part.counts, own=0)

        for batch in batches:
            if not batch.num_rows:
                continue
            where = list(zip(column(batch, "block").to_pylist(), column(batch, "part").to_pylist(),
                             column(batch, "visits").to_pylist()))
            words, counts = column(batch, "word").to_pylist(), column(batch, "n").to_pylist()
            edges = [0, *(k for k in range(1, len(where)) if where[k] != where[k - 1]), len(where)]
            for lo, hi in zip(edges, edges[1:]):
                block, number, visits = where[lo]
                if at != (block, number):
                    yield from settled()
                    at, home, part = (block, number), ([], []), None
                if not visits:
                    home[0].extend(words[lo:hi])
                    home[1].extend(counts[lo:hi])
                elif home[0]:
                    yield from settled()
                    for length in sorted({len(w) for w in words[lo:hi]}):
                        some = [k for k in range(lo, hi) if len(words[k]) == length]
                        yield from part.meet([words[k] for k in some], np.asarray([counts[k] for k in some]))
        yield from settled()
        give_back()

    return rows.mapInArrow(run, "word string, n long, near string, near_n long")


def groups(words: DataFrame, *, lead: int = 5, part_words: int = 4096) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of ``words`` (word, n)."""
    best = near_pairs(words, part_words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("top"))
    leads = -F.col("top.n") >= lead * F.col("n")
    found = landed(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(leads, F.col("top.word")).alias("form"), F.when(leads, -F.col("top.n")).alias("form_n")), "forms")
    largest = found.agg(F.max("form_n")).first()[0]
    steps = found.where("form is not null").select("word", F.col("form").alias("root"))
    if largest is not None:
        # a chain of k forms multiplies the count by lead ** k; each round doubles the steps taken
        longest = max(int(math.log(largest, lead)) + 1, 1)
        for _ in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
            on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
            steps = landed(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return found.join(steps, "word", "left").select("word", "n", "n_near", "form", "form_n",
                                                    F.coalesce("root", "word").alias("root"))
