"""Windows of consecutive words that stand more than once in a corpus, wherever they begin.

Each window belongs to the smallest hash among its shorter word runs (its anchor),
so equal windows have equal anchors. A first scan counts anchors with what stands
around them; the repeated ones are written as sorted arrays to the shared folder.
A second scan gives a row for each place of a repeated anchor: one for all of its
windows where its surroundings are the same everywhere, else one per window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlake.llm import shared_arrays as files
from liftlake.llm import textnum
from liftlake.session import shared_dir

# The shorter runs have this share of a window's words.
ANCHOR_SHARE = 0.4
# Bytes of text whose anchors make a shard.
SHARD_BYTES, MIN_SHARDS = 32 << 20, 8
# Shards that a worker keeps mapped.
MAX_MAPPED = 8192
# Anchors of a task that are merged before they are sent on.
BLOCK = 1 << 20

SCHEMA = "digest binary, doc_id bigint, version bigint, nth int, start int, stop int"


def _rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each on, put together from runs of doubled length."""
    n = len(hashes) - size + 1
    run, have, factor = hashes, 1, textnum._BASE
    out, done = None, 0
    while True:
        if size & have:
            out = run[:n].copy() if out is None else out * factor + run[done:done + n]
            done += have
        if 2 * have > size:
            return textnum.mix(out + np.uint64(size))
        run = run[:-have] * factor + run[have:]
        have, factor = 2 * have, factor * factor


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of ``width`` values from each on, the last one of equals."""
    low, place, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = low[:-step], low[step:]
        place = np.where(right <= left, place[step:], place[:-step])
        low = np.minimum(left, right)
        have += step
    return place


class Windows:
    """Windows of a part's texts by anchor. ``first``, ``many``: the windows of each; ``whole``: hash of all their words."""

    def __init__(self, column: pa.Array, size: int):
        data, offsets = textnum.text_bytes(column)
        self.data = data
        self.starts, self.ends, self.per_text = textnum.words(data, offsets)
        self.offsets = offsets
        n = len(self.starts)
        texts = np.diff(self.per_text)
        none = np.zeros(0, np.int64)
        self.first, self.many, self.anchor, self.whole = none, none, none.view(np.uint64), none.view(np.uint64)
        if not (texts >= size).any():
            return
        hashes = textnum.word_hashes(textnum.LOWER[data], self.starts, self.ends)
        short = max(1, int(ANCHOR_SHARE * size))
        runs = _rolled(hashes, short)
        self.hashes = _rolled(hashes, size)
        place = _smallest(runs, size - short + 1)
        left = np.repeat(self.per_text[1:], texts) - np.arange(n)
        whole = np.flatnonzero(left[:len(self.hashes)] >= size)
        own = place[whole]
        cut = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1))
        self.first, self.many = whole[cut], np.diff(np.append(cut, len(whole)))
        self.anchor = runs[own[cut]]
        # The first and the last window overlap, so they tell all words between.
        last = self.hashes[self.first + self.many - 1]
        self.whole = textnum.mix(self.hashes[self.first] * textnum._BASE + last + self.many.astype(np.uint64))


def _count(size: int, shards: int):
    """mapInArrow: anchors of a block with their surroundings, by shard; equal ones once, with whether they were."""

    def flushed(anchor, whole):
        anchor, whole = np.concatenate(anchor), np.concatenate(whole)
        shard = (anchor % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((whole, anchor, shard))
        anchor, whole, shard = anchor[order], whole[order], shard[order]
        first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1]))))
        twice = (np.diff(np.append(first, len(anchor))) > 1).astype(np.uint8)
        anchor, whole, shard = anchor[first], whole[first], shard[first]
        at = np.concatenate(([0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]))
        cuts = list(zip(at[:-1], at[1:]))
        return pa.RecordBatch.from_arrays(
            [pa.array(shard[at[:-1]]), *(pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (anchor, whole, twice))],
            ["shard", "anchors", "wholes", "twice"])

    def run(batches):
        anchor, whole, n = [], [], 0
        for batch in textnum.parts(batches, 0):
            w = Windows(batch.column(0), size)
            if len(w.anchor):
                anchor.append(w.anchor)
                whole.append(w.whole)
                n += len(w.anchor)
            if n >= BLOCK:
                yield flushed(anchor, whole)
                anchor, whole, n = [], [], 0
        if n:
            yield flushed(anchor, whole)

    return run


def _joined(t: pa.Table, name: str, dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_py(), dtype) for x in t.column(name)])


def _write(folder: str):
    """Write a shard's repeated anchors, and which of them have different surroundings."""

    def run(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        anchor, whole, twice = (_joined(t, c, d) for c, d in (("anchors", np.uint64), ("wholes", np.uint64), ("twice", np.uint8)))
        order = np.argsort(anchor, kind="stable")
        anchor, whole, twice = anchor[order], whole[order], twice[order]
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        mixed = np.minimum.reduceat(whole, first) != np.maximum.reduceat(whole, first)
        repeated = (np.diff(np.append(first, len(anchor))) > 1) | (np.maximum.reduceat(twice, first) > 0)
        files.write(folder, f"anchor{shard}.keys", anchor[first][repeated])
        files.write(folder, f"anchor{shard}.mixed", mixed[repeated].astype(np.uint8))
        return pa.table({"shard": [shard], "n": [int(repeated.sum())]})

    return run


def _look(folder: str, shards: int, there: set, arrays: dict, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each anchor whether it is repeated, and whether its surroundings differ."""
    found, mixed = np.zeros(len(anchor), bool), np.zeros(len(anchor), bool)
    shard = (anchor % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    values, first = np.unique(shard[order], return_index=True)
    for s, a, b in zip(values.tolist(), first, np.append(first[1:], len(order))):
        if s not in there:
            continue
        rows = order[a:b]
        if s not in arrays:
            while len(arrays) >= MAX_MAPPED:
                del arrays[next(iter(arrays))]
            arrays[s] = files.mapped(folder, f"anchor{s}.keys", np.uint64), files.mapped(folder, f"anchor{s}.mixed", np.uint8)
        keys, flags = arrays[s]
        at = np.minimum(np.searchsorted(keys, anchor[rows]), len(keys) - 1)
        hit = keys[at] == anchor[rows]
        found[rows], mixed[rows] = hit, hit & (flags[at] > 0)
    return found, mixed


def windows(picked: DataFrame, size: int, shards: int | None = None) -> DataFrame:
    """Places whose windows may be repeated, of rows (doc_id, text, version): digest, doc_id, version, nth (word), start, stop (code points).

    Every window of ``size`` words that stands twice is in such rows at all of its places; equal digests mean equal words (64-bit hashes).
    """
    spark = picked.sparkSession
    if shards is None:
        held = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(MIN_SHARDS, -(-held // SHARD_BYTES))
    folder = shared_dir(spark, "anchors")
    counted = picked.select("text").mapInArrow(_count(size, shards), "shard bigint, anchors binary, wholes binary, twice binary")
    # A row per shard, that is, per ``SHARD_BYTES`` of text; more tasks than shards, so that hardly any task gets several.
    there = {r["shard"] for r in counted.repartition(3 * shards, "shard").groupBy("shard").applyInArrow(_write(folder), "shard bigint, n bigint").collect() if r["n"]}

    def run(batches):
        arrays: dict = {}
        for batch in textnum.parts(batches):
            w = Windows(batch.column(1), size)
            found, mixed = _look(folder, shards, there, arrays, w.anchor)
            if not found.any():
                continue
            first, many, whole, mixed = w.first[found], w.many[found], w.whole[found], mixed[found]
            apart = np.repeat(first[mixed], many[mixed]) + np.arange(many[mixed].sum()) \
                - np.repeat(np.cumsum(many[mixed]) - many[mixed], many[mixed])
            nth = np.concatenate((first[~mixed], apart))
            last = np.concatenate((first[~mixed] + many[~mixed], apart + 1)) + size - 2
            digest = np.concatenate((whole[~mixed], w.hashes[apart]))
            text = np.searchsorted(w.per_text, nth, "right") - 1
            chars = np.concatenate(([0], np.cumsum((w.data & 0xC0) != 0x80)))
            begin = chars[w.offsets[text]]
            take = pa.array(text)
            digests = pa.Array.from_buffers(pa.binary(8), len(digest), [None, pa.py_buffer(digest.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [digests, batch.column(0).take(take), batch.column(2).take(take), pa.array((nth - w.per_text[text]).astype(np.int32)),
                 pa.array((chars[w.starts[nth]] - begin).astype(np.int32)), pa.array((chars[w.ends[last]] - begin).astype(np.int32))],
                ["digest", "doc_id", "version", "nth", "start", "stop"])

    return picked.mapInArrow(run, SCHEMA) if there else spark.createDataFrame([], SCHEMA)
