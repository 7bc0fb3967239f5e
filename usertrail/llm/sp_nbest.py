"""SentencePiece encoding and decoding with N-best segmentations.

The pieces and scores of a SentencePiece model file span a lattice over a text;
a segmentation's score is the sum of its pieces' scores.  A forward Viterbi pass
gives every position its best score from the beginning.  These scores are an exact
heuristic for an A* search from the end: it pops segmentations in order of score
and expands nothing that is not on one of the N best.

No piece joins text over a word's end (checked when the model is loaded), so the
lattice of a text is a chain of the lattices of its words.  Words are segmented
once and remembered; the N best of a text come from the N - 1 words whose second
segmentation loses least, as every other word is on its best one in all of them.

Text is prepared as the model says for its identity normaliser: a blank in front,
blanks as U+2581.  A character that is no piece becomes its UTF-8 byte pieces, at
a score below every piece's.  For a model trained with merges the scores are merge
ranks, so the best path is not the merge result, but it decodes to the same text.

The second to n-th segmentation differ from the best in a few words only, so a row
holds them as replacements of stretches of the best ids; ``expanded`` spells them out.

Defined cases: a null or empty text has no pieces, one empty segmentation and
decodes to an empty text; ties go to the longer last piece, and between words to
the earlier one; a text holding U+2581 decodes with a blank there (``round_trip``
is false).
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usertrail.llm.common import bounded_batches, column, slices, text_of, texts

BLANK = "▁"
NORMAL, BYTE = 1, 6  # piece types of the model file


_BASE = np.uint64(0x9E3779B97F4A7C15)
_PACK = {n: struct.Struct(f"<{n}I").pack for n in range(1, 33)}


class Lattice:
    """Segmentations by one model file."""

    def __init__(self, path: str, most: int = 400_000):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models with an identity normaliser that keeps blanks")
        self.lead = BLANK if model.normalizer_spec.add_dummy_prefix else ""
        self.pieces: dict[str, tuple[int, float] | None] = {}  # None: only the beginning of pieces
        self.byte_ids, self.raw = [0] * 256, []
        normal = [(p.piece, i, p.score) for i, p in enumerate(model.pieces) if p.type == NORMAL]
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
            self.raw.append(bytes([int(p.piece[3:5], 16)]) if p.type == BYTE
                            else p.piece.replace(BLANK, " ").encode() if p.type == NORMAL else b"")
        for piece, i, score in normal:
            for k in range(1, len(piece)):
                self.pieces.setdefault(piece[:k], None)
            self.pieces[piece] = (i, score)
        self.unknown = min((s for _, _, s in normal), default=0.0) - 10.0
        chained = not any(re.search(f"[^{BLANK}]{BLANK}|\n.|.\n", p, re.DOTALL) for p, _, _ in normal)
        # marks part from the letter before them too, except from those that some piece joins to a mark
        joined = "".join(sorted({m[1] for p, _, _ in normal for m in re.finditer(r"([^\W\d_])[.,;:!?]", p)}))
        letter = r"(?<=[^\W\d_])" + (f"(?<![{re.escape(joined)}])" if joined else "")
        no_letter = r"(?:(?<![^\W\d_])" + (f"|(?<=[{re.escape(joined)}])" if joined else "") + ")"
        inner = f"(?:[^{BLANK}\n.,;:!?]+|{no_letter}[.,;:!?])"
        self.cut = re.compile(f"{letter}[.,;:!?]{inner}*|{BLANK}+{inner}*|\n|{inner}+" if chained else r".+", re.DOTALL)
        # the pieces' beginnings by length, for many words at once: sorted hashes, piece ids (-1: none) and scores
        self.by_length = []
        for size in range(1, max(map(len, self.pieces), default=0) + 1):
            begin = [(p, got) for p, got in self.pieces.items() if len(p) == size]
            codes = np.frombuffer("".join(p for p, _ in begin).encode("utf-32-le"), "<u4").reshape(-1, size)
            hashes = np.zeros(len(begin), np.uint64)
            for k in range(size):
                hashes = hashes * _BASE + codes[:, k]
            order = np.argsort(hashes)
            if len(np.unique(hashes)) < len(hashes):
                raise ValueError("two beginnings of pieces share a hash")
            self.by_length.append((hashes[order], np.asarray([got[0] if got else -1 for _, got in begin], np.int32)[order],
                                   np.asarray([got[1] if got else 0.0 for _, got in begin])[order]))
        # the words learned lately, and those before them; of the latter, used ones come over
        self.most, self.known, self.before, self.known_best = most, {}, {}, {}

    # -------------------------------------------------------------- one word

    def arcs(self, word: str, start: int) -> Iterator[tuple[int, tuple[int, ...], float]]:
        """(end, ids, score) of the pieces that start there; byte pieces where the character is none."""
        get, single = self.pieces.get, False
        for end in range(start + 1, len(word) + 1):
            sub = word[start:end]
            got = get(sub, 0)
            if got == 0:
                break
            if got is not None:
                single |= end == start + 1
                yield end, (got[0],), got[1]
        if not single:
            yield start + 1, tuple(self.byte_ids[b] for b in word[start].encode()), self.unknown

    def viterbi(self, word: str) -> tuple[list[float], list, list[float]]:
        """Forward scores, the arc that ends the best path, and the best score by another arc, at each position."""
        n, get, unknown = len(word), self.pieces.get, self.unknown
        low = float("-inf")
        best, back, second = [low] * (n + 1), [None] * (n + 1), [low] * (n + 1)
        best[0] = 0.0
        for start in range(n):
            here = best[start]
            for end in range(start + 1, n + 1):
                got = get(word[start:end], 0)
                if got:
                    score = here + got[1]
                    if score > best[end]:
                        second[end] = best[end]
                        best[end] = score
                        back[end] = (start, got[0])
                    elif score > second[end]:
                        second[end] = score
                elif got == 0:
                    break
            if not get(word[start]):
                end, score = start + 1, here + unknown
                if score > best[end]:
                    second[end], best[end], back[end] = best[end], score, (start, -1)
                elif score > second[end]:
                    second[end] = score
        return best, back, second

    def learn(self, word: str) -> tuple[bytes, float, float]:
        """The word's best ids (packed), their score, and what its second segmentation loses."""
        if (got := self.before.get(word)) is not None:
            self.known[word] = got
            return got
        best, back, second = self.viterbi(word)
        ids, at, loss = [], len(word), float("inf")
        while at:
            loss = min(loss, best[at] - second[at])
            start, piece = back[at]
            if piece < 0:
                ids += [self.byte_ids[b] for b in reversed(word[start].encode())]
            else:
                ids.append(piece)
            at = start
        ids.reverse()
        got = self.known[word] = (pack(*ids) if (pack := _PACK.get(len(ids))) else np.asarray(ids, "<u4").tobytes(),
                                  best[-1], loss)
        return got

    def _learn_equal(self, words: list[str]) -> None:
        """``learn`` for words of one length together: the same pass over starts and ends, a column a word."""
        n, rows = len(words[0]), np.arange(len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(-1, n).astype(np.uint64)
        best, second = (np.full((n + 1, len(words)), -np.inf) for _ in range(2))
        back, piece = (np.zeros((n + 1, len(words)), np.int32) for _ in range(2))
        best[0] = 0.0

        def arc(at: np.ndarray, start: int, end: int, score: np.ndarray, ids: np.ndarray) -> None:
            now = best[end, at]
            better = score > now
            second[end, at] = np.where(better, now, np.maximum(second[end, at], score))
            won = at[better]
            best[end, won], back[end, won], piece[end, won] = score[better], start, ids[better]

        for start in range(n):
            at, hashes, single = rows, np.zeros(len(words), np.uint64), np.zeros(len(words), bool)
            for size, (known, ids, scores) in enumerate(self.by_length[:n - start], 1):
                hashes = hashes * _BASE + codes[at, start + size - 1]
                k = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                begins = known[k] == hashes
                at, hashes, k = at[begins], hashes[begins], k[begins]
                if not len(at):
                    break
                whole = ids[k] >= 0
                if size == 1:
                    single[at[whole]] = True
                arc(at[whole], start, start + size, best[start, at[whole]] + scores[k[whole]], ids[k[whole]])
            odd = rows[~single]
            if len(odd):
                arc(odd, start, start + 1, best[start, odd] + self.unknown, np.full(len(odd), -1, np.int32))
        at, loss, steps, path = np.full(len(words), n), np.full(len(words), np.inf), np.zeros(len(words), np.int64), []
        spelled = np.zeros(len(words), bool)
        while (at > 0).any():
            on = at > 0
            loss[on] = np.minimum(loss[on], best[at[on], rows[on]] - second[at[on], rows[on]])
            here = piece[at, rows]
            spelled |= on & (here < 0)
            path.append(here)
            steps += on
            at = np.where(on, back[at, rows], 0)
        ids = np.asarray(path[::-1], "<i4").T  # each word's pieces stand at the end of its row
        for i, (w, k, score, lost, odd) in enumerate(zip(words, steps.tolist(), best[n].tolist(), loss.tolist(), spelled.tolist())):
            if odd:
                self.learn(w)
            else:
                # rows are cut where the word's path ends: what is over stands in front
                self.known[w] = (ids[i, len(path) - k:].tobytes(), score, lost)

    def learn_all(self, words: set[str]) -> None:
        """Make words known: those of before come over, the others are learned by length."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            if (got := self.before.get(w)) is not None:
                self.known[w] = got
            else:
                by_length.setdefault(len(w), []).append(w)
        for size, group in by_length.items():
            if len(group) < 24 or size > 64:
                for w in group:
                    self.learn(w)
            else:
                self._learn_equal(group)

    def n_best(self, word: str, n: int) -> list[tuple[float, bytes]]:
        """(loss, packed ids) of the word's n best segmentations, by A* from its end."""
        if (found := self.known_best.get((word, n))) is not None:
            return found
        best, _, _ = self.viterbi(word)
        ending: list[list] = [[] for _ in range(len(word) + 1)]
        for start in range(len(word)):
            for end, ids, score in self.arcs(word, start):
                ending[end].append((start, ids, score))
        out, serial = [], 0
        # (loss so far, position, order, ids behind it as a linked list, score behind it): of equal losses the
        # one nearest to the beginning goes on, so that ties do not widen the search
        queue = [(0.0, len(word), 0, None, 0.0)]
        while queue and len(out) < n:
            loss, at, _, behind, score = heapq.heappop(queue)
            if at == 0:
                ids = []
                while behind is not None:
                    ids += behind[0]
                    behind = behind[1]
                out.append((loss, np.asarray(ids, "<u4").tobytes()))
                continue
            for start, ids, s in ending[at]:
                serial += 1
                heapq.heappush(queue, (best[-1] - (best[start] + s + score), start, serial, (ids, behind), s + score))
        # the best one stays the Viterbi path, also in a tie
        first = (self.known.get(word) or self.learn(word))[0]
        out = [(0.0, first)] + [o for o in out if o[1] != first]
        self.known_best[word, n] = out[:n]
        return out[:n]

    # -------------------------------------------------------------- texts

    def encode(self, text: str, n: int = 1) -> tuple[float, list[tuple[float, bytes]]]:
        """The best score, and (loss, packed ids) of the n best segmentations."""
        return self.encode_all([text], n)[0][:2]

    def encode_all(self, batch: list[str], n: int = 1) -> list[tuple[float, list[tuple[float, bytes]], list]]:
        """``encode`` of several texts, whose new words are learned together; and of each segmentation but the
        best its replacements: (from which of the best ids on, how many of them, packed ids)."""
        found = [self.cut.findall(self.lead + t.replace(" ", BLANK)) if t else [] for t in batch]
        known = self.known
        self.learn_all({w for f in found for w in f if w not in known})
        out = [self._n_best_of(f, n) for f in found]
        if len(known) > self.most:
            self.known, self.before = {}, known
        if len(self.known_best) > self.most // 10:
            self.known_best.clear()
        return out

    def _n_best_of(self, found: list[str], n: int) -> tuple[float, list[tuple[float, bytes]], list]:
        """The text's score, n best and their replacements, from those of its words."""
        got = list(map(self.known.__getitem__, found))
        ids = list(map(itemgetter(0), got))
        score = sum(map(itemgetter(1), got))
        losses = list(map(itemgetter(2), got))
        open_ = sorted(k for k in heapq.nsmallest(n - 1, range(len(losses)), key=losses.__getitem__) if losses[k] < float("inf"))
        paths: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        lists = [self.n_best(found[k], n) for k in open_]
        for options in lists:
            paths = heapq.nsmallest(n, ((a + b[0], (*c, j)) for a, c in paths for j, b in enumerate(options)))
        out, edits, places, at, start = [], [], [], 0, 0
        for k in open_:  # where the word's ids begin, and how many they are
            at += sum(map(len, ids[start:k])) // 4
            places.append((at, len(ids[k]) // 4))
            start = k
        for loss, chosen in paths:
            for k, options, j in zip(open_, lists, chosen):
                ids[k] = options[j][1]
            out.append((loss, b"".join(ids)))
            edits.append([(*place, options[j][1]) for place, options, j in zip(places, lists, chosen) if j])
        return float(score), out, edits[1:]

    def decode(self, packed: bytes) -> str:
        raw = b"".join(map(self.raw.__getitem__, np.frombuffer(packed, "<u4").tolist()))
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.lead and text[:1] == " " else text


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    """One a Python worker, so that later tasks find the words known."""
    return Lattice(path)


SCHEMA = "ids array<int>, n_pieces long, score double, losses array<double>, ids_crc32 array<long>, round_trip boolean"


def _lists(sizes: Iterable[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), values)


def _packed(found: list[bytes]) -> pa.Array:
    """Packed ids as lists of integers."""
    return _lists((len(p) // 4 for p in found), pa.array(np.frombuffer(b"".join(found), "<i4")))


def encode(docs: DataFrame, model: str, *, key: str = "doc_id", text: str = "text", n_best: int = 4,
           alternatives: bool = True) -> DataFrame:
    """A row per document: the best ids, their number and score; the n best's losses and crc32s (of ids as
    little-endian 32-bit integers), best first; whether the best decodes to the text; and the ``alternatives``,
    the second to n-th segmentation: each replaces the ``over`` ids from number ``at`` (from 0) of the best
    by ``ids``, once or more."""
    if n_best < 1:
        raise ValueError("n_best must be at least 1")
    rows = bounded_batches(docs).select(F.col(key).alias("key"), text_of(text).alias("text"))
    names = ["key", "ids", "n_pieces", "score", "losses", "ids_crc32", "round_trip", *["alternatives"] * alternatives]

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lattice(model)
        for batch in slices(batches):
            best, others, sizes, scores, losses, crcs, same = [], [], [], [], [], [], []
            whole = texts(batch)
            for t, (score, found, edits) in zip(whole, of.encode_all(whole, n_best)):
                best.append(found[0][1])
                others.append(edits)
                sizes.append(len(found[0][1]) // 4)
                scores.append(score)
                losses.append([x for x, _ in found])
                crcs.append([zlib.crc32(p) for _, p in found])
                same.append(of.decode(found[0][1]) == t)
            cols = [column(batch, "key"), _packed(best), pa.array(sizes, pa.int64()), pa.array(scores),
                    pa.array(losses, pa.list_(pa.float64())), pa.array(crcs, pa.list_(pa.int64())), pa.array(same)]
            if alternatives:
                paths = [path for o in others for path in o]
                edits = [edit for path in paths for edit in path]
                each = pa.StructArray.from_arrays(
                    [pa.array([e[0] for e in edits], pa.int32()), pa.array([e[1] for e in edits], pa.int32()),
                     _packed([e[2] for e in edits])], ["at", "over", "ids"])
                cols.append(_lists(map(len, others), _lists(map(len, paths), each)))
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = SCHEMA + ", alternatives array<array<struct<at: int, over: int, ids: array<int>>>>" * alternatives
    return rows.mapInArrow(segment, f"key {docs.schema[key].dataType.simpleString()}, {schema}")


def expanded(ids: str | Column = "ids", alternatives: str | Column = "alternatives") -> Column:
    """The ids of the second to n-th segmentation, an array each."""
    ids, alternatives = (F.col(c) if isinstance(c, str) else c for c in (ids, alternatives))

    def upto(done: Column, end: Column) -> Column:
        return F.concat(done["out"], F.slice(ids, done["upto"] + 1, end - done["upto"]))

    def spell(path: Column) -> Column:
        none = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("upto"))
        return F.aggregate(path, none, lambda done, e: F.struct(
            F.concat(upto(done, e["at"]), e["ids"]).alias("out"), (e["at"] + e["over"]).alias("upto")),
            lambda done: upto(done, F.size(ids)))

    return F.transform(alternatives, spell)


def decode(encoded: DataFrame, model: str, *, key: str = "key", ids: str = "ids") -> DataFrame:
    """key and text; null ids decode to an empty text."""
    rows = bounded_batches(encoded).select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lattice(model)
        for batch in batches:
            out = [of.decode(np.asarray(i or [], "<u4").tobytes()) for i in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "key"), pa.array(out, pa.string())], ["key", "text"])

    return rows.mapInArrow(spell, f"key {encoded.schema[key].dataType.simpleString()}, text string")
