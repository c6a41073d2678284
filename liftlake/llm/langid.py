"""Language identification in two steps: the family first, then close relatives by pairwise linear SVMs.

Texts are counts of hashed byte 3-grams over lower-cased letters. Linear
support vector machines tell families apart (one against the rest) and, inside
a family, each pair of languages (one against one, by votes and then by margin).
All weights stand in one table, so a text is read once for all machines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftlake.llm import textnum
from liftlake.llm.util import fold

FEATURES = 1 << 13
# Texts that the machines are fitted on: per language, and in all; each language gets its share of the latter.
SAMPLE_PER_LANGUAGE = 400
MAX_SAMPLE = 3_000
# Languages are labels; a table with more distinct ones is not a language table and is refused.
MAX_LANGUAGES = 500
UNKNOWN = "und"
# Bytes read at a time, and bytes of the cut of a sampled text.
_PART = 1 << 20
_CUT = 60

# Families of frequent languages by ISO 639-1 code; any other language is its own family.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "is", "lb", "nl", "nb", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "finnic": ("et", "fi"),
    "semitic": ("ar", "he", "mt"),
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}

_CLASS = np.zeros(256, np.int32)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = np.arange(27, 155)


def _grams(data: np.ndarray) -> np.ndarray:
    """Feature of the 3-gram that begins at each byte (runs of non-letters are one space)."""
    c = _CLASS[data]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] > 0) | (c[:-1] > 0)
    c = np.concatenate(([0], c[keep], [0]))
    code = (c[:-2] * 155 + c[1:-1]) * 155 + c[2:]
    return ((code.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64)


def _shares(data: np.ndarray) -> tuple[bytes, bytes]:
    """Features of a text that occur (uint16), and their shares (float32)."""
    counts = np.zeros(FEATURES, np.int64)
    for at in range(0, len(data), _PART):
        counts += np.bincount(_grams(data[at:at + _PART]), minlength=FEATURES)
    found = np.flatnonzero(counts)
    return found.astype(np.uint16).tobytes(), (counts[found] / counts.sum()).astype(np.float32).tobytes()


def _sample_shares(batches):
    """mapInArrow: per labelled text its shares, and those of a short cut that stands for short documents."""
    for batch in textnum.parts(batches):
        data, offsets = textnum.text_bytes(batch.column(1))
        cols = [[], [], [], []]
        for a, b in zip(offsets[:-1], offsets[1:]):
            third = a + (b - a) // 3
            for k, x in enumerate((*_shares(data[a:b]), *_shares(data[third:min(b, third + _CUT)]))):
                cols[k].append(x)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.binary()) for c in cols)], ["lang", "i", "v", "ci", "cv"])


def _matrix(rows: list[tuple[bytes, bytes]]) -> np.ndarray:
    out = np.zeros((len(rows), FEATURES), np.float32)
    for k, (i, v) in enumerate(rows):
        out[k, np.frombuffer(i, np.uint16)] = np.frombuffer(v, np.float32)
    return out


def _svm(x: np.ndarray, y: np.ndarray, rounds: int = 150, weight: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, balanced classes, accelerated gradient descent; y is +1, -1 or, for rows left out, 0.

    Rows are left out by weight, so that the matrix, the driver's largest, is never copied.
    """
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), np.where(y < 0, 0.5 / max(1, (y < 0).sum()), 0)).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    b = vb = 0.0
    rate = 1.0 / (2.0 * float((share * np.einsum("ij,ij->i", x, x)).sum()) + 2.0 + weight)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v + vb)) * share * y
        new, new_b = v + rate * (2 * (slack @ x) - weight * v), vb + rate * 2 * float(slack.sum())
        speed = k / (k + 3)
        v, vb = new + speed * (new - w), new_b + speed * (new_b - b)
        w, b = new, new_b
    return w, b


class Model:
    """Fitted machines. ``table``: a weight per feature and machine; ``bias``: one per machine."""

    def __init__(self, shares: list[tuple[bytes, bytes]], langs: list[str]):
        self.langs = sorted(set(langs))
        self.family_of = [_FAMILY.get(x.lower(), f"only {x}") for x in self.langs]
        self.families = sorted(set(self.family_of))
        x = _matrix(shares)
        lang = np.array([self.langs.index(v) for v in langs])
        scale = 1 / np.sqrt(x.mean(axis=0) + 1e-5)
        x *= scale
        family = np.array([self.families.index(f) for f in self.family_of])[lang]
        columns, self.pairs = [], []
        for f in range(len(self.families)):
            columns.append(_svm(x, np.where(family == f, 1, -1).astype(np.float32)))
        for f in self.families:
            own = [k for k, v in enumerate(self.family_of) if v == f]
            for i, a in enumerate(own):
                for b in own[i + 1:]:
                    columns.append(_svm(x, (lang == a).astype(np.float32) - (lang == b)))
                    self.pairs.append((a, b))
        self.table = np.array([w * scale for w, _ in columns], np.float32).T.copy()
        self.bias = np.array([b for _, b in columns])

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Margin of every machine for every text of a batch."""
        out = np.empty((len(offsets) - 1, len(self.bias)))
        for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
            total, n = np.zeros(len(self.bias)), 0
            for at in range(a, b, _PART):
                g = _grams(data[at:min(b, at + _PART)])
                n += len(g)
                # Few features repeat often, so they are counted before they are weighed.
                total += np.bincount(g, minlength=FEATURES) @ self.table if len(g) > 4096 else self.table[g].sum(axis=0)
            out[k] = total / max(1, n) + self.bias
        return out

    def predict(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score, the share of the family's and the pairs' machines in favour."""
        nf = len(self.families)
        fam = margins[:, :nf].argmax(axis=1)
        sure = 1 / (1 + np.exp(-4 * np.clip(margins[np.arange(len(fam)), fam], -20, 20)))
        votes = np.full((len(margins), len(self.langs)), -np.inf)
        worst = np.full((len(margins), len(self.langs)), np.inf)
        for k, f in enumerate(self.family_of):
            votes[fam == self.families.index(f), k] = 0
        for j, (a, b) in enumerate(self.pairs):
            m = np.clip(margins[:, nf + j], -20, 20)
            # A vote counts 1, the margin decides between equal votes.
            votes[:, a] += (m > 0) + 0.001 * m
            votes[:, b] += (m <= 0) - 0.001 * m
            worst[:, a] = np.minimum(worst[:, a], m)
            worst[:, b] = np.minimum(worst[:, b], -m)
        best = votes.argmax(axis=1)
        w = worst[np.arange(len(best)), best]
        score = sure * np.where(np.isinf(w), 1.0, 1 / (1 + np.exp(-4 * np.where(np.isinf(w), 0, w))))
        return [self.langs[k] for k in best], score


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """Fit on a bounded sample of the labelled rows given, a share of each language; None without any.

    More than ``MAX_LANGUAGES`` distinct labels are an error: none is left out silently.
    """
    labelled = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                           F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    labelled = labelled.where(F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if not counts:
        return None
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} distinct languages in {lang_col}")
    wanted = shares(counts, per_language, max(MAX_SAMPLE, len(counts)))
    # About twice the share is drawn by hash, so that hardly any language gets less; of these the first by hash are taken.
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("language sample")), F.lit(1_000_003))
    limit, share = F.lit(0), F.lit(0)
    for lang, n in sorted(counts.items()):
        most = -(-(2 * wanted[lang] + 20) * 1_000_003 // n)
        limit = F.when(F.col("lang") == lang, F.lit(min(1_000_003, most))).otherwise(limit)
        share = F.when(F.col("lang") == lang, F.lit(wanted[lang])).otherwise(share)
    order = Window.partitionBy("lang").orderBy("draw", F.xxhash64("text"))
    drawn = labelled.withColumn("draw", draw).where(F.col("draw") < limit).withColumn("nth", F.row_number().over(order)) \
        .where(F.col("nth") <= share).select("lang", "text").mapInArrow(
        _sample_shares, "lang string, i binary, v binary, ci binary, cv binary")
    rows = drawn.orderBy(F.xxhash64("i", "v"), "lang").collect()
    model = Model([(r["i"], r["v"]) for r in rows] + [(r["ci"], r["cv"]) for r in rows], [r["lang"] for r in rows] * 2)
    del rows
    textnum._release()
    return model


def shares(counts: dict[str, int], per_language: int, most: int) -> dict[str, int]:
    """Texts to take of each language: all of a small one, and an equal part of what is left of ``most`` for larger ones."""
    out, left = {}, most
    for k, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = max(1, min(n, per_language, left // (len(counts) - k)))
        left -= out[lang]
    return out


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, lang_pred, score, and the ``keep`` columns. Only the text is looked at.

    ``und`` with score 0 for a null text, a text without letters, or without a
    model. Empty tables give empty results, repeated rows are judged alike.
    """
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                         letters.alias("letters"), *[F.col(c).alias(f"k_{c}") for c in keep])
    names = ["doc_id", "lang_pred", "score", *(f"k_{c}" for c in keep)]

    def run(batches):
        for batch in textnum.parts(batches):
            known = batch.column(2).to_numpy(zero_copy_only=False).astype(bool) & (model is not None)
            if model is not None:
                lang, score = model.predict(model.margins(*textnum.text_bytes(batch.column(1))))
            else:
                lang, score = [UNKNOWN] * len(known), np.zeros(len(known))
            lang = [x if k else UNKNOWN for x, k in zip(lang, known)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(np.where(known, score, 0.0)), *batch.columns[3:]], names)

    kept = "".join(f", `k_{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return picked.mapInArrow(run, "doc_id bigint, lang_pred string, score double" + kept)


def learned_from(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents a model may learn from: all but a fixed quarter."""
    return docs.where(fold(id_col, 4) != 2)
