"""The corpus pipeline: five stages over ``documents``, each a DataFrame written before the next one reads it.

Language ID rejects documents without a determined language, line dedup takes out
repeated lines, near-duplicate detection keeps one document of each class,
decontamination drops documents with benchmark passages, and SentencePiece encodes
the rest.  Null texts count as empty; all stages but the last keep the columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usertrail.llm import bag_minhash, ecoc_langid, line_dedup, phrase_index, sp_nbest
from usertrail.llm.common import landed, table


def determined_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn the languages from the documents; texts without a letter, or between two languages, go."""
    model = ecoc_langid.train(docs)
    found = ecoc_langid.predict(docs, model)
    sure = (F.col("lang_id.lang") != ecoc_langid.UNDETERMINED) & ~F.col("lang_id.ambiguous")
    return found.where(sure).select("doc.*")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop repeated lines; ``n_chars`` follows the text."""
    found = line_dedup.dedup(docs)
    out = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return found.select(*[out[c].alias(c) if c in out else F.col(f"doc.`{c}`") for c in docs.columns])


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return bag_minhash.one_of_each(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a benchmark passage occurs; equal texts share their fate."""
    text_key = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    index = phrase_index.build_index(docs.select(text_key.alias("t"), "text"), key="t")
    hit = phrase_index.find(index, table(spark, sf_dir, "benchmark")).where("n_hit > 0").select("key").distinct()
    return docs.join(hit, text_key == F.col("key"), "left_anti")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, with its N-best losses, in place of the text."""
    import public_tokenizers

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc"), "text")
    found = sp_nbest.encode(rows, public_tokenizers.path("piece_bpe_32k.model"), key="doc", alternatives=False)
    return found.select("key.*", *[c for c in found.columns if c != "key"])


STAGES = [
    ("language ID", determined_language),
    ("line dedup", without_repeated_lines),
    ("near-duplicates", one_of_near_duplicates),
    ("decontamination", without_benchmarks),
    ("SentencePiece", encoded),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = landed(docs, f"stage-{k + 1}")
    return docs
