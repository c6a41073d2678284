"""Benchmark decontamination: a hash set of normalised test n-grams against all token windows.

Only DataFrame functions. The distinct n-grams of the benchmark are counted.
Windows are dropped inside the scan of a text unless their hash is in a set that
travels with the tasks: the hashes themselves up to ``MAX_LITERAL``, beyond a bitmap
of bounded size that lets a few others pass. What is left meets the n-gram table,
which is broadcast up to ``MAX_BROADCAST`` and shuffled beyond. A hit counts when the
words agree, not only their hash. Texts themselves are never a key: a verdict belongs
to an id and a digest, and only documents with a hit are looked up by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftlake.llm.util import saved
from liftlake.session import broadcast_if_small

WINDOW_WORDS = 13
MIN_PERCENT = 5
# Hashes that stand in the plan: about 20 bytes each in every task's closure.
MAX_LITERAL = 20_000
# Rows of the n-gram table that are broadcast: about 200 bytes each.
MAX_BROADCAST = 1_000_000
# Bits of the bitmap per n-gram, and the most in all (16 MB in every executor).
BITS_PER_GRAM = 64
MAX_BITS = 1 << 27

# A word is a run of digits, a-z and characters beyond ASCII; these separate words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD, ANY_CASE_SEPARATORS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal_words(text) -> Column:
    """Words of a text in order; null has none. Only A-Z change case."""
    text = F.coalesce(F.col(text).cast("string"), F.lit("")) if isinstance(text, str) else text
    ascii_only = F.length(text) == F.octet_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _gram_table(benchmark: DataFrame, item_col: str, text_col: str, words: int) -> DataFrame:
    """Distinct n-grams: size, gram, hash, items (ids that hold it)."""
    w = benchmark.select(F.col(item_col).cast("string").alias("item_id"), normal_words(text_col).alias("w")).where("size(w) > 0")
    size = F.least(F.size("w"), F.lit(words))
    grams = w.select("item_id", size.alias("size"), F.explode(
        F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.array_join(F.slice("w", i, size), " "))).alias("gram"))
    return grams.groupBy("size", "gram").agg(F.collect_set("item_id").alias("items")) \
        .withColumn("hash", _window_hash(F.transform(F.split("gram", " "), lambda x: F.xxhash64(x)), F.lit(1), F.col("size")))


def _window_hash(hashes: Column, at: Column, size: Column) -> Column:
    return F.xxhash64(F.slice(hashes, at, size))


def _bitmap(grams: DataFrame, count: int) -> tuple[Column, int]:
    """Bits of the n-gram hashes as an array of 64-bit numbers, and their number."""
    bits = 1 << 16
    while bits < min(BITS_PER_GRAM * count, MAX_BITS):
        bits *= 2
    place = F.pmod("hash", F.lit(bits))
    words = grams.select(F.shiftright(place, 6).alias("word"), place.bitwiseAND(F.lit(63)).cast("int").alias("bit")) \
        .groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("set"))
    every = grams.sparkSession.range(bits >> 6).select(F.col("id").alias("word")).join(words, "word", "left")
    filled = F.array_sort(F.collect_list(F.struct("word", F.coalesce("set", F.lit(0).cast("bigint")).alias("set"))))
    return every.agg(F.transform(filled, lambda x: x["set"]).alias("bitmap")).scalar(), bits


def verdicts(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
             item_text: str = "text", words: int = WINDOW_WORDS, percent: int = MIN_PERCENT, hits_only: bool = False) -> DataFrame:
    """Per distinct (id, digest of the text): v_id, v_digest, copies, n_words, n_hit, n_items, items, contaminated, spans.

    With ``hits_only`` documents without a window that may be hit have no row.
    """
    grams = _gram_table(benchmark, item_col, item_text, words)
    found = grams.select("size", "hash").limit(MAX_LITERAL + 1).collect()
    few = len(found) <= MAX_LITERAL
    sizes = sorted({r["size"] for r in found} if few
                   else {r["size"] for r in grams.select("size").distinct().collect()})  # at most ``words`` values
    hashes = sorted({r["hash"] for r in found}) if few else None
    count = len(found) if few else grams.count()

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.struct(F.col(id_col).alias("id"), F.md5(text.cast("binary")).alias("digest"))
    base = docs.select(key.alias("doc"), normal_words(text).alias("w"))
    base = base.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    if few:
        may_hit = lambda hash_: hash_.isin(hashes)
    else:
        bitmap, bits = _bitmap(grams, count)
        base = base.withColumn("bitmap", bitmap)
        may_hit = lambda hash_: F.getbit(F.get("bitmap", F.shiftright(F.pmod(hash_, F.lit(bits)), 6).cast("int")),
                                         F.pmod(hash_, F.lit(64)).cast("int")) == 1
    places = [_places(size, may_hit) for size in sizes]
    windows = F.concat(*places) if places else F.array().cast("array<struct<at:int,size:int,hash:bigint>>")
    rows = base.select("doc", F.size("w").cast("bigint").alias("n_words"), "w", windows.alias("windows"))
    rows = rows.select("doc", "n_words", F.transform("windows", lambda x: F.struct(
        x["at"].alias("at"), x["hash"].alias("hash"),
        F.array_join(F.slice("w", x["at"] + 1, x["size"]), " ").alias("gram"), x["size"].alias("size"))).alias("windows"))
    # Without "outer" Spark would add a filter on the windows, find them twice and reason about their large condition.
    rows = rows.select("doc", "n_words", F.posexplode_outer("windows").alias("nth", "window")).select("doc", "n_words", "nth", "window.*")
    rows = rows.where("nth is not null") if hits_only else rows
    table = grams.select(F.col("hash").alias("g_hash"), F.col("gram").alias("g_gram"), "items")
    table = F.broadcast(table) if count <= MAX_BROADCAST else table
    met = rows.join(table, (F.col("hash") == F.col("g_hash")) & (F.col("gram") == F.col("g_gram")), "left")
    met = met.where(F.col("nth").isNull() | (F.col("nth") == 0) | F.col("items").isNotNull())
    hit = F.col("items").isNotNull()
    per_doc = met.groupBy("doc", "n_words").agg(
        F.count_if(F.coalesce(F.col("nth"), F.lit(0)) == 0).alias("copies"),
        F.array_sort(F.collect_set(F.when(hit, F.struct("at", "size")))).alias("spans"),
        F.flatten(F.collect_set("items")).alias("items"))
    # Spans sorted by start: each adds what lies beyond the farthest end so far.
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["at"] + s["size"] - F.greatest(a["end"], s["at"]))).alias("n"),
        F.greatest(a["end"], s["at"] + s["size"]).alias("end")))
    out = per_doc.select(
        F.col("doc.id").alias("v_id"), F.col("doc.digest").alias("v_digest"), "copies", "n_words",
        covered["n"].cast("bigint").alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"), "spans")
    return out.select(
        "v_id", "v_digest", "copies", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items",
        ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))).alias("contaminated"), "spans")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", words: int = WINDOW_WORDS,
                  percent: int = MIN_PERCENT) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items (sorted ids), contaminated, spans.

    A window is ``words`` consecutive words of an item; an item of fewer, but not
    none, is one window. A document word inside any occurrence of a window is hit.
    ``contaminated``: hits reach ``percent`` of the words. ``spans`` lists the hit
    windows as (first word from 0, words), sorted; they may overlap.

    Null text, in either table, has no words; a null item id is left out of
    ``items``. Equal rows are counted and returned as often as they come. An empty
    benchmark, or one without words, hits nothing. Other columns are not read,
    whatever their names.
    """
    judged = verdicts(docs, benchmark, id_col, text_col, item_col, item_text, words, percent)
    return judged.select(
        F.col("v_id").alias(id_col), "n_words", "n_hit", "n_items", "items", "contaminated", "spans",
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def _places(size: int, may_hit) -> Column:
    """Structs (at, size, hash) of the windows of one size that may be hit."""
    last = F.size("h") - size
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    shaped = F.transform(at, lambda i: F.struct(
        i.alias("at"), F.lit(size).alias("size"), _window_hash(F.col("h"), i + 1, F.lit(size)).alias("hash")))
    return F.filter(shaped, lambda x: may_hit(x["hash"]))


def _met(docs: DataFrame, judged: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    """Rows of ``docs`` as one struct ``row``, joined with verdicts by id and digest; the verdicts are broadcast where they are few."""
    digest = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("d_id"), digest.alias("d_digest"))
    same = F.col("d_id").eqNullSafe(F.col("v_id")) & (F.col("d_digest") == F.col("v_digest"))
    return rows.join(broadcast_if_small(judged), same, how)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Documents that are not contaminated, with all their columns, whatever their names; see ``contamination`` for the rule.

    The texts are scanned for verdicts, of which only those of contaminated documents
    are stored; a second scan leaves these out.
    """
    bad = saved(verdicts(docs, benchmark, id_col, text_col, hits_only=True, **options).where("contaminated").select("v_id", "v_digest"), "contaminated")
    return _met(docs, bad, id_col, text_col, "left_anti").select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words: int = WINDOW_WORDS, **options) -> DataFrame:
    """All documents with their hit words cut out of the text; the text between stays as it is.

    What follows a cut word up to the next word goes with it; case and separators
    elsewhere survive. Documents without hits are unchanged, null texts stay null.
    """
    hit = verdicts(docs, benchmark, id_col, text_col, words=words, hits_only=True, **options).where("n_hit > 0")
    met = _met(docs, saved(hit.select("v_id", "v_digest", "spans"), "hits"), id_col, text_col, "left")
    text = F.col(f"row.{text_col}")
    pieces = F.regexp_extract_all(text, F.lit(f"({ANY_CASE_WORD}|{ANY_CASE_SEPARATORS})"), F.lit(1))
    # Words and separators alternate: word j is piece 2j, what follows it 2j + 1, and a leading separator -1.
    shift = text.rlike(f"^{ANY_CASE_WORD}").cast("int") - 1
    numbered = F.transform(pieces, lambda p, k: F.struct(p.alias("p"), (k + shift).alias("k")))
    rest = F.filter(numbered, lambda x: ~F.exists("spans", lambda s: (2 * s["at"] <= x["k"]) & (x["k"] < 2 * (s["at"] + s["size"]))))
    joined = F.array_join(F.transform(rest, lambda x: x["p"]), "")
    clean = F.when(F.size("spans") > 0, joined).otherwise(text)
    return met.select(*[clean.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
