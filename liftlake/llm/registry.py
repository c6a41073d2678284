"""Registered queries of the training-data operators and the SQL twins that exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlake.llm import (decontam, fertility, langid, linededup, lm, neardup, packing, periodic, pii, quality_fm, token_files, warc,
                          whitening)
from liftlake.llm.util import fold, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document by the benchmark's 13-word windows."""
    judged = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                         "contaminated")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(langid.learned_from(docs)))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines and passages of every document, where they stood, and the documents whose occurrence stays."""
    found = linededup.deduplicate(table(spark, sf_dir, "documents"), unit="line", passage=linededup.PASSAGE_WORDS)
    removed = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return found.select("doc_id", "n_removed", removed.alias("removed"), F.length("clean_text").cast("bigint").alias("clean_chars"),
                        F.sha2("clean_text", 256).alias("clean_sha256"), "sources")


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page."""
    return warc.derive(table(spark, sf_dir, "pages"))


def op5_kneser_ney_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document, learned from six sevenths of them."""
    docs = table(spark, sf_dir, "documents")
    scored = lm.score(docs, lm.train(lm.learned_from(docs)))
    return scored.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the patterns' spans, and all spans."""
    found = pii.detect(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in pii.KINDS), F.sha2(pii.joined("base_spans"), 256).alias("base_sha256"),
                        pii.joined("spans").alias("spans"), (F.size("spans") - F.size("base_spans")).cast("bigint").alias("n_added"))


def op7_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels of four fifths of them."""
    docs = table(spark, sf_dir, "documents")
    machine = quality_fm.fit(docs, quality_fm.learned_from(table(spark, sf_dir, "labels")))
    return quality_fm.score(docs, machine).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op8_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, tokeniser measures and verdict of every document."""
    judged = fertility.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                         "n_tokens", "script", *fertility.MEASURES)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and digest of every document's token ids, read back from the files they were written to."""
    return token_files.write(table(spark, sf_dir, "documents")).documents(spark)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, a tenth of them made periodic, and the text without their repetitions, as digests."""
    return periodic.digests(periodic.detect(table(spark, sf_dir, "documents"), rewrite=periodic.planted)).drop("n_words")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the leading components, whitened, one row a component."""
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.by_component(vectors, whitening.fit(vectors))


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_OP1_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 13) k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') gram
      FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 13) + 2)) i FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT k FROM g),
x AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') gram
      FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) i FROM d, s)),
hits AS (SELECT doc_id, x.k, i, item_id FROM x JOIN g ON x.gram = g.gram AND x.k = g.k),
words AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) n_items, string_agg(item_id, ',' ORDER BY item_id) ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP10_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id r FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a),
c AS (SELECT doc_id, min(r) component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) n_shingles, component_id, doc_id = component_id kept
FROM c LEFT JOIN n USING (doc_id)
"""


def queries():
    ops = (op1_decontamination, op2_language_id, op3_substring_dedup, op4_warc_derivatives, op5_kneser_ney_lm, op6_pii, op7_quality_fm,
           op8_fertility_rules, op9_best_fit_packing, op10_minhash_near_dedup, op11_token_files, op12_periodic_runs,
           op13_embedding_whitening)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": _OP1_SQL, "op10_minhash_near_dedup": _OP10_SQL}
