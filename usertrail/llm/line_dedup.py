"""Line deduplication within one word of edit, by a deletion-neighbourhood join.

Lines are trimmed and lower-cased; their words are what stands between blanks.  A
line goes if an earlier line (by document id, then line number) that stays has the
same words, or if both have at least ``fuzzy_words`` words and differ by one inserted,
deleted or replaced word.  So what goes is within the bound of a line that is still
there, and of a chain of lines each one word from the last every other one stays.
Empty lines always stay, and so do lines of fewer than ``min_words`` words where more
than 1 is asked.

Everything is DataFrame expressions; no step pairs up the lines of a group.

1. Each line's 128-bit key, word count and half-line keys are written once.
2. Lines within one word of each other share their first h or their last h words
   for every h up to half the shorter one.  Lines that share no such key with a
   different line have no neighbour, and emit nothing (an exact filter).
3. The others emit themselves and every variant with one word deleted, hashed by
   position-salted word hashes, so that a line of n words costs n log n.  (Should
   two variants of one length share a 64-bit hash without sharing their words, a
   line of theirs may stay; none goes wrongly, see step 5.)
4. Equal variants meet by aggregation.  Lines that had their word deleted in the same
   place are all neighbours; a line that equals a variant as it stands is a neighbour
   of all that made it.  So the earliest of a group answers for it.
5. Rounds decide: a line with a neighbour that stays goes, once their distance is
   verified on the words, by common beginning and end; one without an earlier open
   neighbour stays; others wait.  The earliest open line is always decided; with lines
   in no special order, the rounds grow as the logarithm of their number.

Before a large side is shuffled to meet a small one, a bitmap of fixed size over the
small side's keys narrows it (``common.narrowed``); the join that follows decides.
So the words of step 3 come from a second scan without a shuffle of the texts, and
only texts that lose a line travel, once.

Defined cases: a null text stays null and has no line; null ids come after all
others, then texts order by hash; of repeated rows one keeps its lines.  A text
whose lines all go is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usertrail.llm.common import _marked, landed, narrowed

#: What tells a row from others: its id as text, whether it has none, and its text's hash.
ROW = ["kid", "no_id", "th"]


def plain(line: Column) -> Column:
    return F.lower(F.trim(line))


def words_of(line: Column) -> Column:
    return F.split(plain(line), " ", -1)


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _half_keys(line: Column, n: Column) -> Column:
    """Keys of the first and last h words, h the largest of 4, 8, 16, ... up to n / 2, and for n - 1 words as well."""
    def h(count: Column) -> Column:
        return F.when(count < 8, 4).otherwise(F.pow(F.lit(2), F.floor(F.log2(count.cast("double"))) - 1)).cast("int")

    def keys(size: Column) -> Column:
        first, last = (F.call_function("substring_index", line, F.lit(" "), k) for k in (size, -size))
        return F.array(F.xxhash64(F.lit("first"), size, first), F.xxhash64(F.lit("last"), size, last))

    return F.when(h(n) == h(n - 1), keys(h(n))).otherwise(F.concat(keys(h(n)), keys(h(n - 1))))


def _scan(values: Column) -> Column:
    """Running exclusive-ors of an array of longs, by doubling steps."""
    n, zero = F.size(values), F.lit(0).cast("long")
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(2)).cast("double"))).cast("int"))
    return F.aggregate(steps, values, lambda a, k: F.slice(F.zip_with(
        a, F.concat(F.array_repeat(zero, F.pow(F.lit(2), k).cast("int")), a),
        lambda x, y: F.coalesce(x, zero).bitwiseXOR(y)), F.lit(1), n))


def _variants(words: Column) -> Column:
    """Structs (s, n, slot): the line as it stands (slot 0), and with word 1, 2, ... deleted.

    A sequence's hash is the exclusive-or of its words' hashes, each salted with its
    place.  Behind a deleted word all places move by one: the hash takes each word's
    ``here`` before the gap and its ``back`` behind it.  Variants meet only with
    equal hash, length and, but for a line as it stands, slot; that the words agree
    is verified later.
    """
    zero = F.lit(0).cast("long")
    here = F.transform(words, lambda w, i: F.xxhash64(F.lit(17), w, i))
    back = F.transform(words, lambda w, i: F.xxhash64(F.lit(17), w, i - 1))

    def each(s: Column) -> Column:
        """``change``: running difference between the words' places here and back."""
        all_back = F.aggregate(s["back"], zero, lambda a, b: a.bitwiseXOR(b))
        return _let(all_back, lambda all_: F.transform(
            F.concat(F.array(F.lit(None).cast("long")), s["back"]), lambda b, i: F.struct(
                F.when(i == 0, F.element_at(s["change"], -1)).otherwise(
                    F.coalesce(F.get(s["change"], i - 2), zero).bitwiseXOR(b)).bitwiseXOR(all_).alias("s"),
                (F.size(s["back"]) - (i > 0).cast("int")).alias("n"), i.alias("slot"))))

    scanned = _let(back, lambda b: F.struct(b.alias("back"), _scan(F.zip_with(here, b, lambda x, y: x.bitwiseXOR(y))).alias("change")))
    return _let(scanned, each)


def within_one(a: Column, b: Column) -> Column:
    """Whether two arrays of words are at most one insertion, deletion or replacement apart."""
    def common(x: Column, y: Column) -> Column:
        differ = F.array_position(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), True)
        return F.when(differ > 0, differ - 1).otherwise(F.least(F.size(x), F.size(y)).cast("long"))

    longest = F.greatest(F.size(a), F.size(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (
        common(a, b) + common(F.reverse(a), F.reverse(b)) >= longest - 1)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("kid"), F.col(key).isNull().alias("no_id"),
                       F.xxhash64(text).alias("th"), F.col(key).alias("id"), F.col(text).cast("string").alias("text"))


def _lines(rows: DataFrame) -> DataFrame:
    return rows.select(*ROW, "id", F.posexplode(F.split("text", "\n", -1)).alias("line", "raw"))


def _line_keys(docs: DataFrame, key: str, text: str, min_words: int, fuzzy_words: int) -> DataFrame:
    """A narrow row per line of at least ``min_words`` words, written once."""
    found = _lines(_rows(docs, key, text)).select(*ROW, "id", "line", F.xxhash64("raw").alias("rh"), plain(F.col("raw")).alias("p"))
    blanks = F.octet_length("p") - F.octet_length(F.replace(F.col("p"), F.lit(" "), F.lit("")))
    found = found.withColumn("n", blanks + 1).where((F.col("n") >= min_words) & (F.col("p") != ""))
    return landed(found.select(
        *ROW, "id", "line", "rh", F.xxhash64("p").alias("h1"), F.xxhash64(F.lit(5), "p").alias("h2"),
        F.when(F.col("n") >= fuzzy_words, _half_keys(F.col("p"), F.col("n"))).alias("halves")), "line-keys")


def _neighbours(docs: DataFrame, keys: DataFrame, distinct: DataFrame, key: str, text: str) -> DataFrame:
    """(h1, h2) of the distinct lines that have an earlier line within one word."""
    halves = distinct.where("halves is not null").select("h1", "h2", F.explode("halves").alias("half"))
    shared = landed(halves.groupBy("half").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi")
                    .select("half"), "line-halves")
    near = narrowed(halves, F.col("half"), shared, F.col("half")).join(shared, "half").select("h1", "h2").distinct()
    near = landed(near, "line-near")
    near = narrowed(distinct.select("h1", "h2", "first"), F.col("h1"), near, F.col("h1")).join(near, ["h1", "h2"])
    # numbers in the order of the lines' first places, which stand for these from here on
    near = landed(near.orderBy("first").withColumn("node", F.monotonically_increasing_id()), "line-near")

    # the words of these lines, from their first places
    places = near.select("node", "first", *[F.col(f"first.{c}").alias(c) for c in (*ROW, "line", "rh")])
    scanned = _lines(_rows(docs, key, text)).drop("id").withColumn("rh", F.xxhash64("raw"))
    hits = narrowed(scanned, F.col("rh"), places, F.col("rh")).drop("rh")
    words = landed(hits.join(places, [*ROW, "line"]).select("node", words_of(F.col("raw")).alias("w"))
                   .dropDuplicates(["node"]), "line-words")

    variant = ["s", "n"]
    variants = landed(words.select("node", F.inline(_variants(F.col("w")))), "line-variants")
    met = landed(variants.groupBy(*variant).agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
                 .select(*variant), "line-met")
    met = narrowed(variants, F.col("s"), met, F.col("s")).join(met, variant)
    edited = _decided(met, words).join(near, "node").select("first")
    # from the line's first place to its key
    edited = edited.select(*[F.col(f"first.{c}").alias(c) for c in (*ROW, "line", "rh")])
    return narrowed(keys.select(*ROW, "line", "rh", "h1", "h2"), F.col("rh"), edited, F.col("rh")).join(
        edited, [*ROW, "line", "rh"]).select("h1", "h2").distinct()


def _decided(met: DataFrame, words: DataFrame) -> DataFrame:
    """The nodes of the lines that go for an earlier neighbour that stays.

    ``met``: node, and the variants (s, n, slot) that a line shares with others; nodes in the order of the lines.
    """
    variant = ["s", "n"]
    met, out = landed(met.withColumn("stays", F.lit(False)), "line-open"), met.select("node").where("false")
    staying, waiting = (F.min(F.when(F.col("stays") == s, F.col("node"))).alias(name)
                        for s, name in ((True, "staying"), (False, "waiting")))
    while not met.where("not stays").isEmpty():
        cut, whole = met.where("slot > 0"), met.where("slot = 0")
        groups = ((cut, cut, [*variant, "slot"]), (cut, whole, variant), (whole, cut, variant))
        pairs = None
        for lines, others, same in groups:
            found = lines.where("not stays").select("node", *same).join(
                others.groupBy(*same).agg(staying, waiting), same, "left").select("node", "staying", "waiting")
            pairs = found if pairs is None else pairs.unionByName(found)
        pairs = landed(pairs.groupBy("node", "staying").agg(F.min("waiting").alias("waiting")), "line-pairs")
        near = (pairs.where("staying < node").select("node", "staying")
                .join(words.select(F.col("node").alias("staying"), F.col("w").alias("staying_w")), "staying")
                .join(words, "node"))
        gone = near.where(within_one(F.col("w"), F.col("staying_w"))).select("node", F.lit(True).alias("goes")).distinct()
        judged = landed(pairs.groupBy("node").agg(F.min("waiting").alias("waiting")).join(gone, "node", "left").select(
            "node", F.coalesce("goes", F.lit(False)).alias("goes"),
            F.coalesce(F.col("waiting") >= F.col("node"), F.lit(True)).alias("free")).where("goes or free"), "line-round")
        out = out.unionByName(judged.where("goes").select("node"))
        met = landed(met.join(judged, "node", "left").where(~F.coalesce("goes", F.lit(False))).withColumn(
            "stays", F.col("stays") | F.coalesce("free", F.lit(False))).drop("goes", "free"), "line-open")
    return out


def dropped_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_words: int = 1,
                  fuzzy_words: int = 8) -> DataFrame:
    """(kid, no_id, th, drop): the sorted numbers (from 0) of each text's lines that go."""
    if fuzzy_words < 8:
        raise ValueError("lines under 8 words have no half of 4 words to be found by")
    keys = _line_keys(docs, key, text, min_words, fuzzy_words)
    first = F.struct("no_id", "id", "th", "line", "kid", "rh")
    distinct = landed(keys.groupBy("h1", "h2").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("copies"),
                                                   F.first("halves").alias("halves")), "line-first")
    edited = _neighbours(docs, keys, distinct, key, text).withColumn("edited", F.lit(True))
    judged = distinct.where("copies > 1").select("h1", "h2", "first").join(edited, ["h1", "h2"], "full")
    judged = landed(judged.select("h1", "h2", "first", F.coalesce("edited", F.lit(False)).alias("edited")), "line-judged")
    lines = keys.select(*ROW, "line", "h1", "h2")
    gone = narrowed(lines, F.col("h1"), judged, F.col("h1")).join(judged, ["h1", "h2"])
    own = F.struct(*ROW, "line") == F.struct(*[F.col(f"first.{c}") for c in (*ROW, "line")])
    return gone.where(F.col("edited") | ~own).groupBy(*ROW).agg(F.sort_array(F.collect_set("line")).alias("drop"))


def dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_words: int = 1, fuzzy_words: int = 8) -> DataFrame:
    """All columns of ``docs`` in a struct ``doc``, with the new text, n_lines and n_dropped beside it."""
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("kid"), F.col(key).isNull().alias("no_id"),
                       F.xxhash64(text).alias("th"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    body = F.col("doc").getField(text).cast("string")
    none = F.array().cast("array<int>")
    drops = dropped_lines(docs, key=key, text=text, min_words=min_words, fuzzy_words=fuzzy_words)
    repeated = rows.select(*ROW).groupBy(*ROW).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    drops = landed(drops.join(repeated, ROW, "full").select(
        *ROW, F.coalesce("drop", none).alias("drop"), F.coalesce("rows", F.lit(1)).alias("rows")), "line-drops")

    marked = _marked(rows, F.xxhash64(*ROW), drops, F.xxhash64(*ROW), 1 << 16)
    still = marked.where("not _maybe").select("doc", none.alias("drop"))
    met = marked.where("_maybe").drop("_maybe").join(drops.hint("shuffle_hash"), ROW, "left")
    # a repeated row's lines are all later than those of the first such row
    copy = F.when(F.col("rows") > 1, F.row_number().over(Window.partitionBy(*ROW).orderBy(F.lit(1)))).otherwise(1)
    lines = F.split(body, "\n", -1)
    long_ones = F.filter(F.transform(lines, lambda x, i: F.when((F.size(words_of(x)) >= min_words) & (plain(x) != ""), i)), F.isnotnull)
    met = met.withColumn("copy", copy).select(
        "doc", F.when(F.col("copy") > 1, long_ones).otherwise(F.coalesce("drop", none)).alias("drop"))
    out = still.unionByName(met).select("doc", "drop", lines.alias("lines"))
    # stretches between the lines that go, so that a long text costs its length
    ends = F.concat("drop", F.array(F.size("lines")))
    kept = F.flatten(F.transform(F.arrays_zip(F.concat(F.array(F.lit(-1)), "drop").alias("a"), ends.alias("b")),
                                 lambda s: F.slice(F.col("lines"), s["a"] + 2, s["b"] - s["a"] - 1)))
    return out.select("doc", F.when(F.size("drop") > 0, F.array_join(kept, "\n")).otherwise(body).alias("text"),
                      F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"), F.size("drop").alias("n_dropped"))
