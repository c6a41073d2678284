"""Quality rules with tokeniser fertility: public vocabularies measure how well a text fits them.

Characters per token and the entropy of the tokens come from a byte-level BPE, the
share of the words' bytes that become byte-fallback tokens from a sentence-piece BPE. Bands of accepted values
are set from the quartiles of each language over the whole corpus, wide enough that
only outliers fall outside. A small language's quartiles are drawn towards its
script's, a small script's towards those of all sound documents, so every sound
document is judged.
"""

from __future__ import annotations

import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlake.llm import bpe, textnum
from liftlake.llm.util import saved
from liftlake.session import broadcast_if_small

MIN_WORDS = 50
# A band reaches so many interquartile ranges beyond a quartile; a range counts at least this share of its median.
REACH = {"chars_per_token": 2.0, "entropy": 3.0, "fallback_share": 3.0}
LEAST_SPREAD = 0.03
# Short texts vary more: a band widens downwards by sqrt(1 + SHORT_TOKENS / tokens).
SHORT_TOKENS = 400
# Above: so many times the upper quartile of characters per token, and this share of fallback tokens at least.
LONG_TOKENS, LEAST_FALLBACK = 3.0, 0.1
# Bands are broadcast up to this many.
MAX_BANDS = 10_000
# Entropy is measured against the most that this many tokens can have, so long texts compare with short ones.
ENTROPY_TOKENS = 1000
# The wider group counts as so many documents beside a group's own: few, as languages differ more than their texts.
MIN_GROUP = 5
# A group's range beyond the wider group's counts in full only with many more documents than this.
WIDE_GROUP = 200
# Least values in any corpus. Characters a token can't be compared between scripts: the lower
# edge of a script of few documents is drawn towards the least value instead.
FLOORS = {"chars_per_token": 0.3, "entropy": 0.3}

# The symbols counted, and the scripts told apart by their first and last letters.
SYMBOLS = b"#*$%&|<>"
SCRIPTS = (("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF),
           ("devanagari", 0x900, 0x97F), ("thai", 0xE00, 0xE7F), ("hangul", 0xAC00, 0xD7AF), ("kana", 0x3040, 0x30FF), ("han", 0x4E00, 0x9FFF))
MEASURES = ("chars_per_token", "fallback_share", "entropy")

_IS_SYMBOL = np.zeros(256, np.int64)
_IS_SYMBOL[list(SYMBOLS)] = 1


class Pieces:
    """Byte-fallback tokens of texts under a sentence-piece vocabulary.

    A word whose characters are all pieces themselves never falls back, so only
    words with another character are tokenised.
    """

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.fallback = np.array([self.model.is_byte(k) for k in range(len(pieces))])
        self.other = re.compile("[^ \t-\r" + "".join(map(re.escape, sorted({p for p in pieces if len(p) == 1}))) + "]")

    def fallback_tokens(self, text: str) -> int:
        if not self.other.search(text):
            return 0
        words = [w for w in re.split("[ \t-\r]+", text) if self.other.search(w)]
        return sum(int(self.fallback[ids].sum()) for ids in self.model.encode(words, num_threads=1) if ids)


_ready: dict[str, Pieces] = {}


def _script(data: np.ndarray) -> str:
    """Script with the most letters; "none" without letters of a listed script."""
    if not len(data):
        return "none"
    if data.max() < 128:
        return "latin" if (textnum.LOWER[data] >= 97).any() else "none"
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    counts = [int(((points >= a) & (points <= b)).sum()) for _, a, b in SCRIPTS]
    return SCRIPTS[int(np.argmax(counts))][0] if max(counts) else "none"


def _duplicate_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            n += line in seen
            seen.add(line)
    return n


def _repeated_words(hashes: np.ndarray) -> int:
    """Words inside 3-word windows that occur at least twice."""
    if len(hashes) < 3:
        return 0
    _, place, count = np.unique(textnum.shingles(hashes, 3), return_inverse=True, return_counts=True)
    twice = count[place] > 1
    hit = np.zeros(len(hashes), bool)
    for k in range(3):
        hit[k:k + len(twice)] |= twice
    return int(hit.sum())


def _entropy(ids: np.ndarray) -> float:
    """Entropy of the token distribution, against the most that the tokens, or ENTROPY_TOKENS of them, can have."""
    if len(ids) < 2:
        return 0.0
    _, n = np.unique(ids, return_counts=True)
    p = n / len(ids)
    return float(-(p * np.log(p)).sum() / np.log(min(len(ids), ENTROPY_TOKENS)))


def measured(docs: DataFrame, id_col: str, text_col: str, lang_col: str | None, files: tuple[str, str], piece_file: str) -> DataFrame:
    """Per document the base counts, the script and the three measures."""
    names = ["doc_id", "lang", "script", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", *MEASURES]

    def run(batches):
        encoder = bpe.byte_bpe(*files)
        if piece_file not in _ready:
            _ready[piece_file] = Pieces(piece_file)
        pieces = _ready[piece_file]
        for batch in textnum.parts(batches):
            data, offsets = textnum.text_bytes(batch.column(1))
            starts, ends, per_text = textnum.words(data, offsets)
            hashes = textnum.word_hashes(data, starts, ends)

            def summed(x):
                return np.diff(np.concatenate(([0], np.cumsum(x)))[offsets])

            chars = summed((data & 0xC0) != 0x80)
            word_chars = chars - summed(textnum.IS_SPACE[data])
            sizes = np.diff(offsets) - summed(textnum.IS_SPACE[data])
            cols = [[] for _ in range(7)]
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = encoder.encode(text)
                # A fallback token is one byte.
                fallback = pieces.fallback_tokens(text)
                row = (_script(data[offsets[k]:offsets[k + 1]]), _duplicate_lines(text), _repeated_words(hashes[per_text[k]:per_text[k + 1]]),
                       len(ids), float(chars[k] / max(1, len(ids))), min(1.0, fallback / max(1, sizes[k])), _entropy(ids))
                for c, x in zip(cols, row):
                    c.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(cols[0], pa.string()), pa.array(np.diff(per_text)), pa.array(word_chars),
                 pa.array(summed(_IS_SYMBOL[data])), *(pa.array(c, pa.int64()) for c in cols[1:4]), *(pa.array(c, pa.float64()) for c in cols[4:])], names)

    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), lang.alias("lang"))
    return picked.mapInArrow(run, "doc_id bigint, lang string, script string, n_words bigint, word_chars bigint, n_symbols bigint, "
                                  "n_dup_lines bigint, n_repeat_words bigint, n_tokens bigint, " + ", ".join(f"{m} double" for m in MEASURES))


def quartiles(table: DataFrame, *group: str) -> DataFrame:
    """Per group, or of all: n and the quartiles of each measure, with the group's or "all" before their names."""
    name = group[0] if group else "all"
    sums = [F.percentile_approx(m, [0.25, 0.5, 0.75], 10_000).alias(f"{name}_{m}") for m in MEASURES]
    for g in group:
        table = table.where(F.col(g).isNotNull()).withColumnRenamed(g, f"{g}_key")
    return table.groupBy(*(f"{g}_key" for g in group)).agg(F.count(F.lit(1)).alias(f"{name}_n"), *sums)


def _drawn(group: str, measure: str, wider: list):
    """Quartiles of a group, drawn towards the wider group's; without the group those of the wider one."""
    n, q = F.coalesce(f"{group}_n", F.lit(0)), F.col(f"{group}_{measure}")
    return [(n * F.coalesce(q[k], wider[k]) + MIN_GROUP * wider[k]) / (n + MIN_GROUP) for k in range(3)]


def _inside(stretch):
    """Whether each measure of a row joined with its groups' quartiles lies in its band."""
    q, spread = {}, {}
    lang_n = F.coalesce("lang_n", F.lit(0))
    for m in MEASURES:
        script, every = ([F.col(f"{g}_{m}")[k] for k in range(3)] for g in ("script", "all"))
        wider = script if m == "chars_per_token" else _drawn("script", m, every)
        q[m] = _drawn("lang", m, wider)
        own, most = q[m][2] - q[m][0], wider[2] - wider[0]
        spread[m] = F.least(own, most + F.greatest(own - most, F.lit(0.0)) * lang_n / (lang_n + WIDE_GROUP))

    def reach(m):
        return REACH[m] * F.greatest(spread[m], LEAST_SPREAD * q[m][1])

    chars, entropy, fallback = (q[m] for m in ("chars_per_token", "entropy", "fallback_share"))
    n = F.greatest(lang_n, F.col("script_n"))
    low = (n * (chars[0] - reach("chars_per_token") * stretch) + MIN_GROUP * FLOORS["chars_per_token"]) / (n + MIN_GROUP)
    return F.col("chars_per_token").between(F.greatest(low, F.lit(FLOORS["chars_per_token"])), LONG_TOKENS * chars[2]) \
        & (F.col("entropy") >= F.greatest(entropy[0] - reach("entropy") * stretch, F.lit(FLOORS["entropy"]))) \
        & (F.col("fallback_share") <= F.greatest(F.lit(LEAST_FALLBACK), fallback[2] + reach("fallback_share")))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", min_words: int = MIN_WORDS,
          files: tuple[str, str] | None = None, piece_file: str | None = None, given: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Per document: the base counts, base_failed, the measures, n_tokens, script and kept.

    Base: too few words, or more than half of them in repeated 3-word windows. A
    document that passes is kept if each measure lies in the band of its language,
    drawn towards its script and all sound documents the more the fewer it has. ``given`` sets bands for all by measure instead. Null text counts as empty and
    fails; a null language takes the script's bands; equal rows are judged alike;
    an empty table gives an empty result; other columns are not read.
    """
    table = saved(measured(docs, id_col, text_col, lang_col, files or bpe.default_files(),
                           piece_file or public_tokenizers.path("piece_bpe_32k.model")), "fertility")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    table = table.withColumn("base_failed", failed)
    if given is not None:
        inside = F.lit(True)
        for m, (low, high) in given.items():
            inside = inside & F.col(m).between(low, high)
        return table.withColumn("kept", ~F.col("base_failed") & inside)
    sound = table.where("not base_failed")
    # A handful of rows: joined by broadcast, so that documents are not dealt by their few languages.
    own, script = (broadcast_if_small(saved(quartiles(sound, g), "bands", 1), MAX_BANDS) for g in ("lang", "script"))
    out = table.join(script, F.col("script") == F.col("script_key"), "left").join(own, F.col("lang") == F.col("lang_key"), "left") \
        .crossJoin(F.broadcast(saved(quartiles(sound), "bands", 1)))
    inside = _inside(F.sqrt(1 + SHORT_TOKENS / F.greatest("n_tokens", F.lit(1))))
    return out.select(*table.columns, (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"))
