"""Stages of the corpus pipeline; each takes (spark, docs, sf_dir) and gives documents to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlake.llm import decontam, langid, neardup, packing, pii
from liftlake.llm.util import saved, table
from liftlake.session import broadcast_if_small

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Words of a shingle in the near-duplicate stage; op10's contract fixes four for its own query.
NEAR_DUPLICATE_WORDS = 5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; a null ``lang`` is filled with the prediction, ``und`` goes.

    Without any labelled document there is nothing to learn from: then no document is
    rejected and no ``lang`` filled.
    """
    docs = docs.select(*COLUMNS)
    model = langid.fit(langid.learned_from(docs))
    if model is None:
        return docs
    found = langid.identify(docs, model, keep=tuple(COLUMNS))
    named = found.where(F.col("lang_pred") != langid.UNKNOWN)
    return named.select("k_doc_id", "k_text", F.coalesce("k_lang", "lang_pred"), "k_source", "k_n_chars").toDF(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the one with the smallest id.

    Rows that repeat an id and its text become one. Rows without id take part by
    their text and go where a document with an id says the same.
    """
    docs = docs.select(*COLUMNS)
    text = F.coalesce("text", F.lit(""))
    # Ids of their own for rows without one, behind all others; equal texts share one.
    nameless = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(text), 2)
    keyed = docs.select(*COLUMNS, F.coalesce("doc_id", nameless).alias("key"), F.md5(text.cast("binary")).alias("digest"))
    judged = neardup.near_duplicates(keyed.select("key", "text"), id_col="key", size=NEAR_DUPLICATE_WORDS)
    gone = saved(judged.where("not kept").select(F.col("doc_id").alias("key")).distinct(), "dropped")
    kept = keyed.join(broadcast_if_small(gone), "key", "left_anti")
    # Few documents come twice, so the others need not be sorted out by a shuffle of their texts.
    again = saved(keyed.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "digest"), "repeated")
    once = kept.join(broadcast_if_small(again), ["key", "digest"], "left_anti")
    first = kept.join(broadcast_if_small(again), ["key", "digest"], "left_semi").groupBy("key", "digest").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), *COLUMNS)).alias("row"))
    return once.select(*COLUMNS).unionByName(first.select(*[F.col(f"row.{c}").alias(c) for c in COLUMNS]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark; texts are scanned, not shuffled."""
    return decontam.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` follows the new text, null texts stay null."""
    found = pii.detect(docs.select(*COLUMNS), keep=("doc_id", "text", "lang", "source", "n_chars"), redact="[{}]")
    changed = F.size("spans") > 0
    return found.select(
        "k_doc_id", F.when(changed, F.col("redacted")).otherwise(F.col("k_text")), "k_lang", "k_source",
        F.when(changed, F.length("redacted").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("k_n_chars"))).toDF(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in training sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]
