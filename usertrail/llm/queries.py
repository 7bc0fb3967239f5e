"""Registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usertrail.llm import (bag_minhash, ecoc_langid, line_dedup, phrase_index, quality_qda, secret_owners, sp_nbest, span_hash,
                           spelling_groups, surrogates, token_align, token_store, toxicity_nnpu)
from usertrail.llm.common import landed, scratch, table


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, path = table(spark, sf_dir, "documents"), scratch(spark, "tokens")
    found = token_store.write_store(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    n_buckets = token_store.build_index(found, path)
    places = token_store.lookup(found.select("key", "copy"), path, n_buckets)
    back = token_store.read_payloads(places, path, ids=False)
    return back.join(F.broadcast(token_store.shard_starts(found)), F.col("shard") == F.col("in_shard")).select(
        F.col("key").alias("doc_id"), (F.col("shard_start") + F.col("offset")).alias("start"),
        "n_tokens", "ids_crc32")


def op2_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = quality_qda.featurise(table(spark, sf_dir, "documents"))
    fold = ecoc_langid.fold
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    scored = quality_qda.score(features, quality_qda.learn(features, labels))
    return scored.select(F.col("key").alias("doc_id"), (fold("key", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_line_dedup(spark: SparkSession, sf_dir: str, min_words: int = 1) -> DataFrame:
    found = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=min_words)
    return found.select("doc.doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"),
                        F.col("n_dropped").cast("long").alias("n_dropped"),
                        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op3_line_dedup_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The former name of what ``op3_line_dedup`` does: every exact repeat of a line that is not empty goes."""
    return op3_line_dedup(spark, sf_dir, min_words=1)


def op4_sp_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = sp_nbest.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumnRenamed("key", "doc_id")


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = surrogates.replace_all(docs, b"usertrail registered query")

    def count(kind: str) -> Column:
        return F.size(F.filter("kinds", lambda k: k == F.lit(kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc.doc_id", "text", *map(count, surrogates.KINDS))


def op6_span_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_hash.fingerprints(table(spark, sf_dir, "documents"))


def op7_ecoc_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = ecoc_langid.fold("doc_id", 4) == 2
    model = ecoc_langid.train(docs.where(~held_out))
    found = ecoc_langid.predict(docs.select("doc_id", "text", held_out.alias("held_out")).select(
        "doc_id", "held_out", "text"), model)
    return found.select("doc.doc_id", "doc.held_out", F.col("lang_id.lang").alias("lang_pred"),
                        F.col("lang_id.score").alias("score"), F.col("lang_id.ambiguous").alias("ambiguous"))


def op8_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = phrase_index.build_index(table(spark, sf_dir, "documents"))
    return phrase_index.digest(phrase_index.find(index, table(spark, sf_dir, "benchmark")))


def op9_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bag_minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), "class_id", (F.col("key") == F.col("class_id")).alias("kept"))


def op10_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secret_owners.scan(table(spark, sf_dir, "documents"))
    return secret_owners.judge(scanned).withColumnRenamed("key", "doc_id")


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = token_align.alignments(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                   public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumnRenamed("key", "doc_id")


def op12_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold, docs = ecoc_langid.fold, table(spark, sf_dir, "documents")
    learned = fold("doc_id", 4) != 2
    model = toxicity_nnpu.learn(docs.where(learned), table(spark, sf_dir, "labels").where(learned))
    return toxicity_nnpu.score(docs, model).select(
        F.col("key").alias("doc_id"), (fold("key", 4) == 2).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = landed(spelling_groups.count_words(table(spark, sf_dir, "documents")), "words")
    return spelling_groups.groups(words).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {name: fn for name, fn in sorted(globals().items()) if name.startswith("op")}

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE: dict[str, str] = {
    "op3_line_dedup": r"""
WITH RECURSIVE l AS (SELECT doc_id, p, lines[p] AS raw, string_split(lower(trim(lines[p])), ' ') AS w
           FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS p
                 FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL))),
f AS (SELECT w, min((doc_id, p)) AS first FROM l WHERE w <> [''] GROUP BY w),
v AS (SELECT w, first, 0 AS slot, w AS v FROM f WHERE len(w) >= 8 UNION ALL
      SELECT w, first, i, list_concat(list_slice(w, 1, i - 1), list_slice(w, i + 1, len(w)))
      FROM (SELECT w, first, unnest(range(1, len(w) + 1)) AS i FROM f WHERE len(w) >= 8)),
m AS (SELECT v FROM v GROUP BY v HAVING count(DISTINCT w) > 1),
c AS (SELECT * FROM v SEMI JOIN m USING (v)),
e AS MATERIALIZED (SELECT DISTINCT a.first AS late, b.first AS early FROM c a JOIN c b ON a.v = b.v AND b.first < a.first
      AND (a.slot = b.slot OR a.slot = 0 OR b.slot = 0)),
r AS (SELECT 0 AS round, first, 'open' AS state FROM (SELECT late AS first FROM e UNION SELECT early FROM e) UNION ALL
      SELECT r.round + 1, r.first, CASE WHEN r.state <> 'open' THEN r.state WHEN coalesce(bool_or(o.state = 'stays'), false) THEN 'goes'
             WHEN coalesce(bool_or(o.state = 'open'), false) THEN 'open' ELSE 'stays' END
      FROM r LEFT JOIN e ON e.late = r.first LEFT JOIN r o ON o.first = e.early
      WHERE EXISTS (SELECT 1 FROM r x WHERE x.state = 'open') GROUP BY r.round, r.first, r.state),
g AS (SELECT first FROM r WHERE state = 'goes' GROUP BY first),
gone AS (SELECT l.doc_id, l.p FROM l JOIN f ON l.w = f.w LEFT JOIN g ON g.first = f.first
         WHERE g.first IS NOT NULL OR f.first <> (l.doc_id, l.p)),
t AS (SELECT l.doc_id, count(*) AS n_lines, count(gone.p) AS n_dropped,
             string_agg(CASE WHEN gone.p IS NULL THEN raw END, chr(10) ORDER BY l.p) AS kept
      FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.p = l.p GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(kept, '')) AS text_sha256
FROM documents d LEFT JOIN t USING (doc_id)""",
    "op8_phrase_index": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS.format("text")} AS w FROM benchmark),
i AS (SELECT DISTINCT item, list_slice(w, s, s + least(10, len(w)) - 1) AS g
      FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS n FROM i),
g AS (SELECT r, s, n, list_slice(w, s, s + n - 1) AS g
      FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT g.r, g.s, g.n, i.item FROM g JOIN i ON g.g = i.g),
n_hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.items, '')) AS items_sha256,
       coalesce(n_hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit USING (r) LEFT JOIN items USING (r)""",
}
ORACLE["op3_line_dedup_every"] = ORACLE["op3_line_dedup"]
