"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

Every feature has a weight and a short vector; the products of the vectors of all
pairs of a text's features are summed in linear time, as half of (square of the
sum minus sum of the squares). Words are hashed and share one unit of weight per
text; structure (word length, symbols, repetition, capitals, lines ...) and
metadata (size) are binned, one feature per bin. The machine is fitted in numpy on
a bounded sample of labelled documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlake.llm import textnum
from liftlake.llm.util import fold

WORD_BITS = 15
FACTORS = 8
# Labelled documents the machine is fitted on.
SAMPLE = 6_000
THRESHOLD = 0.3

# Structure and metadata: name and the edges of its bins.
BINS = (
    ("words", (1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000)),
    ("characters per word", (2, 3, 4, 4.5, 5, 5.5, 6, 7, 8, 10, 15)),
    ("distinct words share", (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)),
    ("symbols per word", (0.001, 0.01, 0.03, 0.1, 0.2, 0.3, 0.5, 1)),
    ("punctuation per word", (0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.5, 1)),
    ("digits share", (0.0005, 0.002, 0.01, 0.05, 0.2)),
    ("capitals share", (0.005, 0.01, 0.02, 0.03, 0.05, 0.1, 0.3, 0.6)),
    ("words a line", (1, 2, 4, 8, 12, 16, 24, 32, 64, 128)),
    ("repeated neighbours share", (0.001, 0.01, 0.05, 0.1, 0.3, 0.6)),
    ("bytes beyond ASCII share", (0.001, 0.01, 0.02, 0.04, 0.08, 0.3)),
)
WORDS = 1 << WORD_BITS
FEATURES = WORDS + sum(len(edges) + 1 for _, edges in BINS)

_SYMBOL, _PUNCT, _DIGIT, _CAPITAL = (np.zeros(256, np.int64) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>=_{}[]\\^~")] = 1
_PUNCT[list(b".,;:!?\"'()-")] = 1
_DIGIT[48:58] = 1
_CAPITAL[65:91] = 1


def features(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of texts: feature numbers, their values, and n + 1 offsets of each text's features."""
    raw, offsets = textnum.text_bytes(column)
    data = textnum.LOWER[raw]
    starts, ends, per_text = textnum.words(data, offsets)
    hashes = textnum.word_hashes(data, starts, ends)

    def summed(x):
        return np.diff(np.concatenate(([0], np.cumsum(x)))[offsets])

    n_words = np.diff(per_text)
    some, size = np.maximum(n_words, 1), np.maximum(np.diff(offsets), 1)
    same = np.zeros(len(hashes), np.int64)
    same[1:] = hashes[1:] == hashes[:-1]
    same[per_text[:-1][n_words > 0]] = 0
    text_same = np.diff(np.concatenate(([0], np.cumsum(same)))[per_text])
    shapes = [n_words, (size - summed(textnum.IS_SPACE[data])) / some, None, summed(_SYMBOL[raw]) / some, summed(_PUNCT[raw]) / some,
              summed(_DIGIT[raw]) / size, summed(_CAPITAL[raw]) / size, n_words / (1 + summed(raw == 10)), text_same / some, summed(raw >= 128) / size]
    slots = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int32)
    numbers, values, bounds = [], [], [0]
    distinct = np.zeros(len(some))
    for k, (a, b) in enumerate(zip(per_text[:-1], per_text[1:])):
        found = np.unique(slots[a:b])
        distinct[k] = len(found) / some[k]
        numbers.append(found)
        values.append(np.full(len(found), 1 / np.sqrt(max(1, len(found)))))
    shapes[2] = distinct
    base = WORDS
    binned = []
    for (_, edges), x in zip(BINS, shapes):
        binned.append(base + np.searchsorted(np.array(edges), x, "right"))
        base += len(edges) + 1
    binned = np.array(binned, np.int32).T
    share = np.full(len(BINS), 1 / np.sqrt(len(BINS)))
    for k in range(len(some)):
        numbers[k] = np.concatenate((numbers[k], binned[k]))
        values[k] = np.concatenate((values[k], share))
        bounds.append(bounds[-1] + len(numbers[k]))
    return (np.concatenate(numbers) if numbers else np.zeros(0, np.int32), np.concatenate(values).astype(np.float32) if values else np.zeros(0, np.float32),
            np.array(bounds))


class Machine:
    """Weights of a fitted factorisation machine."""

    def __init__(self, factors: int = FACTORS, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.bias = 0.0
        self.w = np.zeros(FEATURES, np.float32)
        self.v = (0.05 * rng.standard_normal((FEATURES, factors))).astype(np.float32)

    def raw(self, numbers, values, bounds):
        """Score before the logistic, and the factor sums that its gradient needs."""
        x = values[:, None] * self.v[numbers]
        at = bounds[:-1]
        sums = np.add.reduceat(x, at, axis=0)
        squares = np.add.reduceat(x * x, at, axis=0)
        linear = np.add.reduceat(values * self.w[numbers], at)
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1), sums

    def probability(self, numbers, values, bounds):
        return 1 / (1 + np.exp(-np.clip(self.raw(numbers, values, bounds)[0].astype(float), -30, 30)))

    def fit(self, texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.1,
            decay: float = 1e-4, seed: int = 5):
        """Logistic loss with both labels of equal total weight, AdaGrad over shuffled batches."""
        rng = np.random.default_rng(seed)
        share = min(max(labels.mean(), 0.01), 0.99)
        weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share))
        gw, gv, gb = np.full(FEATURES, 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for a in range(0, len(order), batch):
                pick = order[a:a + batch]
                numbers = np.concatenate([texts[k][0] for k in pick])
                values = np.concatenate([texts[k][1] for k in pick])
                sizes = np.array([len(texts[k][0]) for k in pick])
                bounds = np.concatenate(([0], np.cumsum(sizes)))
                z, sums = self.raw(numbers, values, bounds)
                err = (1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30))) - labels[pick]) * weight[pick] / len(pick)
                err_of = np.repeat(err, sizes)
                d_w = np.bincount(numbers, weights=err_of * values, minlength=FEATURES)
                d_v = (err_of * values)[:, None] * (np.repeat(sums, sizes, axis=0) - values[:, None] * self.v[numbers])
                used, place = np.unique(numbers, return_inverse=True)
                grad_v = np.zeros((len(used), self.v.shape[1]))
                np.add.at(grad_v, place, d_v)
                grad_v += decay * self.v[used]
                grad_w = d_w[used] + decay * self.w[used]
                gw[used] += grad_w ** 2
                gv[used] += grad_v ** 2
                gb += err.sum() ** 2
                self.w[used] -= (rate * grad_w / np.sqrt(gw[used])).astype(np.float32)
                self.v[used] -= (rate * grad_v / np.sqrt(gv[used])).astype(np.float32)
                self.bias -= rate * float(err.sum()) / np.sqrt(gb)
        return self


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        sample: int = SAMPLE) -> Machine | None:
    """Fit on at most ``sample`` labelled ids, drawn by a hash of the id; None without any labelled document.

    Null ids and labels are left out; of several labels of an id the highest holds.
    """
    drawn = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("label")) \
        .where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label")) \
        .orderBy(F.xxhash64("doc_id", F.lit("quality sample")), "doc_id").limit(sample)

    def run(batches):
        for batch in textnum.parts(batches, 0):
            numbers, values, bounds = features(batch.column(0))
            cuts = list(zip(bounds[:-1], bounds[1:]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([numbers[a:b].astype(np.int32).tobytes() for a, b in cuts], pa.binary()),
                 pa.array([values[a:b].tobytes() for a, b in cuts], pa.binary())], ["label", "numbers", "shares"])

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(drawn), "doc_id").select("text", "label").mapInArrow(run, "label int, numbers binary, shares binary") \
        .orderBy(F.xxhash64("numbers"), "label").limit(2 * sample).collect()
    if not rows:
        return None
    labels_of = np.array([float(r["label"] > 0) for r in rows])
    return Machine().fit([(np.frombuffer(r["numbers"], np.int32), np.frombuffer(r["shares"], np.float32)) for r in rows], labels_of)


def score(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, score (0 to 1), predicted (1 from the threshold on).

    Null text counts as empty, and an empty text is scored by its structure.
    Without a machine every score is 0.5. A null id stays null, equal rows are
    scored alike, an empty table gives an empty result; other columns are not read.
    """

    def run(batches):
        for batch in textnum.parts(batches):
            n = batch.num_rows
            p = machine.probability(*features(batch.column(1))) if machine is not None else np.full(n, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return picked.mapInArrow(run, "doc_id bigint, score double, predicted int")


def learned_from(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The labels a machine may learn from: all but those of a fixed fifth of the ids."""
    return labels.where(fold(id_col, 5) != 0)
