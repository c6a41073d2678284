"""Substring deduplication by hashed units: lines, paragraphs, or sentences inside lines.

Units are normalised (A-Z lower-cased, white space collapsed, end marks cut) and
hashed; digests are grouped over the whole corpus and all but the earliest ranked
occurrence are removed from the texts. Offsets always refer to the original text.
On demand, every passage of at least so many words that stands twice is removed
as well, wherever it begins and ends (``passages``).
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlake.llm import passages, textnum
from liftlake.llm.util import saved

# How a text is cut. Each unit takes the marks that end it along.
UNITS = {
    "sentence": re.compile(r"[^\n.!?]*[\n.!?]+|[^\n.!?]+"),
    "line": re.compile(r"[^\n]*\n|[^\n]+"),
    "paragraph": re.compile(r"[^\n]+(?:\n[^\n]+)*\n*|\n+"),
}
MIN_WORDS = 8
# Words of a repeated passage that is found without regard to units, where that is asked for.
PASSAGE_WORDS = 50

_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_SPACE = re.compile("[\x20\t-\r]+")


def normal(unit: str) -> str:
    return " ".join(x for x in _SPACE.split(unit.translate(_AZ)) if x).rstrip(".!? ")


def _picked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("version"))


def units(docs: DataFrame, id_col: str, text_col: str, unit: str, min_words: int) -> DataFrame:
    """Units of at least ``min_words`` words: digest, doc_id, version (hash of the text), nth, start, stop."""
    cut = UNITS[unit]

    def run(batches):
        for batch in textnum.parts(batches):
            rows = []
            for key, version, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1).to_pylist()):
                for nth, m in enumerate(cut.finditer(text)):
                    if m.end() - m.start() >= 2 * min_words - 1:
                        n = normal(m[0])
                        if n.count(" ") >= min_words - 1:
                            digest = hashlib.blake2b(n.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                            rows.append((digest, key, version, nth, m.start(), m.end()))
            cols = list(zip(*rows)) or [[]] * 6
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             ["digest", "doc_id", "version", "nth", "start", "stop"])

    return _picked(docs, id_col, text_col).mapInArrow(run, "digest binary, doc_id bigint, version bigint, nth int, start int, stop int")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line",
            min_words: int = MIN_WORDS, passage: int | None = None) -> DataFrame:
    """Occurrences to remove: doc_id, version, start, stop, kept_id (document of the occurrence that stays), passage (or unit).

    Rank: smallest id (null last), then the text's hash, then place in the text.
    With ``passage``, windows of so many words are units as well; one that overlaps
    the occurrence that stays is not removed.
    """
    found = units(docs, id_col, text_col, unit, min_words)
    if passage is not None:
        found = saved(found.unionByName(passages.windows(_picked(docs, id_col, text_col), passage)), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "version", "nth")
    # Written first: a join with a stored table can be split where one unit is very frequent.
    groups = saved(found.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("kept")).where("n > 1"), "groups")
    # Digests of windows have eight bytes, those of units sixteen.
    overlaps = (F.length("digest") == 8) & F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("version") == F.col("kept.version")) \
        & (F.col("nth") < F.col("kept.nth") + F.lit(passage or 0))
    return found.join(groups, "digest").where((rank != F.col("kept")) & ~overlaps) \
        .select("doc_id", "version", "start", "stop", F.col("kept.doc_id").alias("kept_id"), (F.length("digest") == 8).alias("passage"))


def _disjoint(batches):
    """mapInArrow: sorted spans of each row, those that overlap joined."""
    for batch in batches:
        spans = batch.column(2)
        n = np.diff(spans.offsets.to_numpy())
        flat = spans.flatten()
        row = np.repeat(np.arange(len(n), dtype=np.int64), n)
        start, stop = (flat.field(k).to_numpy().astype(np.int64) + (row << 32) for k in (0, 1))
        reach = np.maximum.accumulate(stop)
        first = np.concatenate(([True], start[1:] >= reach[:-1]))[:len(start)]
        at = np.flatnonzero(first)
        low, row = (1 << 32) - 1, row[at]
        ends = reach[np.append(at[1:], len(reach)) - 1] if len(at) else reach
        joined = pa.StructArray.from_arrays([pa.array((x & low).astype(np.int32)) for x in (start[at], ends)], ["start", "stop"])
        offsets = np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.ListArray.from_arrays(pa.array(offsets), joined), batch.column(3)],
                                         ["doc_id", "version", "removed", "sources"])


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line",
                min_words: int = MIN_WORDS, passage: int | None = None) -> DataFrame:
    """Per document: doc_id, clean_text, n_removed, removed (sorted (start, stop), code points), sources (sorted ids).

    A null text stays null, an empty one empty. Rows with equal id and text count
    as one document and are returned as often as they come; rows of one id with
    different texts are told apart. Rows without id rank last. Texts without a unit
    of ``min_words`` words pass unchanged; other columns are not read. With ``passage``,
    repeated runs of at least so many words go too, whatever units they cross.
    """
    found = saved(repeats(docs, id_col, text_col, unit, min_words, passage), "repeats")
    # Spans that overlap for sure are joined before any are collected: a passage has at least so many characters, so
    # passages that begin within so many of each other overlap. A text then has a span per stretch, not one per word.
    near = F.when(F.col("passage"), F.floor(F.col("start") / F.lit(2 * passage - 1))).otherwise(F.col("start").cast("bigint")) \
        if passage is not None else F.col("start")
    # Dealt by document once, which both groupings can use.
    joined = found.repartition("doc_id", "version").groupBy("doc_id", "version", "passage", near.alias("near")).agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.collect_set("kept_id").alias("kept"))
    per_doc = joined.groupBy("doc_id", "version").agg(
        F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("removed"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("kept")))).alias("sources"))
    if passage is not None:
        per_doc = per_doc.mapInArrow(_disjoint, "doc_id bigint, version bigint, removed array<struct<start:int,stop:int>>, sources array<bigint>")
    per_doc = per_doc.withColumnsRenamed({"doc_id": "r_id", "version": "r_version"})
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("version"))
    joined = base.join(per_doc, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("version") == F.col("r_version")), "left")
    none = F.array().cast("array<struct<start:int,stop:int>>")
    removed = F.coalesce("removed", none)
    ends = F.concat(F.array(F.lit(0)), F.transform(removed, lambda s: s["stop"]))
    starts = F.concat(F.transform(removed, lambda s: s["start"]), F.array(F.length("text")))
    rest = F.array_join(F.zip_with(ends, starts, lambda a, b: F.substring(F.col("text"), a + 1, b - a)), "")
    return joined.select("doc_id", F.when(F.size(removed) > 0, rest).otherwise(F.col("text")).alias("clean_text"),
                         F.size(removed).cast("bigint").alias("n_removed"), removed.alias("removed"),
                         F.coalesce("sources", F.array().cast("array<bigint>")).alias("sources"))
