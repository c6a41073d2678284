"""Runs of periodic words, found on an enhanced suffix array.

A run shows itself by squares ``uu``. The last square of a run with root length
``q`` can't move on by a word, so its two halves begin suffixes that agree in
exactly ``q`` words: they lie in one LCP interval of depth ``q``, in different
children. For each interval every suffix outside its largest child is asked
whether the suffix ``q`` words before or after it lies in the same interval (a
look into the inverse suffix array); small children make that n log n questions.
A square found is rotated to the left as far as the words agree, by doubling
steps over the ranks that sorted the suffixes, which gives the run; runs of the
same stretch are merged to the one with the smallest period.

Everything works on arrays over the texts of a batch at once, without tree nodes.
A word's number belongs to its text, so suffixes of different texts share nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlake.llm import textnum

LEAST_WORDS = 6
LEAST_PERIODS = 4


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array by prefix doubling, and the ranks of each step: ``ranks[k]`` orders the first ``2**k`` symbols.

    Past the end counts as smaller than any symbol. In the last ranks all differ: they are the inverse suffix array.
    """
    n = len(symbols)
    ranks = [np.unique(symbols, return_inverse=True)[1].astype(np.int32)]
    order = np.argsort(ranks[0], kind="stable")
    step = 1
    while True:
        rank = ranks[-1]
        sorted_rank = rank[order]
        new = np.empty(n, bool)
        new[0] = True
        new[1:] = sorted_rank[1:] != sorted_rank[:-1]
        if new.all():
            return order, ranks
        # Only groups of equal ranks are sorted on, by the rank ``step`` symbols on.
        alone = new & np.append(new[1:], True)
        open_at = np.flatnonzero(~alone)
        place = order[open_at]
        after = place + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1).astype(np.int64)
        moved = np.argsort(sorted_rank[open_at].astype(np.int64) * (n + 1) + second + 1, kind="stable")
        order[open_at] = place[moved]
        key = second[moved]
        first = new[open_at].copy()
        first[1:] |= key[1:] != key[:-1]
        # A rank is the place of its group's first suffix, so ranks of settled suffixes stay.
        group = np.maximum.accumulate(np.where(first, open_at, 0))
        rank = rank.copy() if step > 1 else _first_places(order, sorted_rank, n)
        rank[order[open_at]] = group
        ranks.append(rank)
        step *= 2


def _first_places(order, sorted_rank, n):
    """Ranks as the place of the first suffix with an equal one."""
    out = np.empty(n, np.int32)
    out[order] = np.searchsorted(sorted_rank, sorted_rank, "left")
    return out


def _common(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Length of the common beginning of pairs of suffixes, by doubling steps from the largest."""
    a, b = a.copy(), b.copy()
    length = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 2, -1, -1):
        inside = np.maximum(a, b) < n
        same = inside & (ranks[k][np.minimum(a, n - 1)] == ranks[k][np.minimum(b, n - 1)])
        step = same.astype(np.int64) << k
        length += step
        a += step
        b += step
    return length


def _smaller(lcp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest places to the left and right with a smaller value (-1 and n where none is), for places ``at``.

    Minima over stretches of doubling lengths are climbed up as long as they are not smaller, and down again.
    """
    n = len(lcp)
    value = lcp[at]
    left, right = at - 1, at + 1
    minima = [lcp]
    active_l, active_r = np.ones(len(at), bool), np.ones(len(at), bool)
    level = 0
    while True:
        width = 1 << level
        table = minima[level]
        # table[i]: minimum of lcp[i : i + width]
        ok = active_l & (left - width + 1 >= 0)
        ok[ok] = table[left[ok] - width + 1] >= value[ok]
        left = left - ok * width
        active_l = ok
        ok = active_r & (right + width <= n)
        ok[ok] = table[right[ok]] >= value[ok]
        right = right + ok * width
        active_r = ok
        if not (active_l.any() or active_r.any()) or 2 * width > n:
            break
        minima.append(np.minimum(table[:-width], table[width:]) if len(table) > width else table[:0])
        level += 1
    for k in range(level, -1, -1):
        width, table = 1 << k, minima[k]
        ok = left - width + 1 >= 0
        ok[ok] = table[left[ok] - width + 1] >= value[ok]
        left = left - ok * width
        ok = right + width <= n
        ok[ok] = table[right[ok]] >= value[ok]
        right = right + ok * width
    return left, right


def runs(symbols: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (start, length, period) of all runs of at least ``max(least, periods * period)`` symbols, by start, then period.

    ``periods`` is at least 2. The period of a row is the smallest of its stretch.
    """
    n = len(symbols)
    none = np.zeros((0, 3), np.int64)
    if n < max(least, periods):
        return none
    order, ranks = suffix_array(symbols)
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    lcp = np.zeros(n, np.int64)  # lcp[k]: of the suffixes at places k - 1 and k
    lcp[1:] = _common(ranks, order[:-1], order[1:], n)

    # Intervals: places with one depth between the same smaller neighbours bound the children of one interval.
    at = np.flatnonzero(lcp)
    if not len(at):
        return none
    left, right = _smaller(lcp, at)  # lcp[0] = 0 stands left of all
    by_interval = np.lexsort((at, right, left))
    at, left, right = at[by_interval], left[by_interval], right[by_interval]
    first = np.ones(len(at), bool)
    first[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    last = np.append(first[1:], True)
    # Children: one ends before each bound, and one after the last bound reaches the end of the interval.
    begin = np.concatenate((np.where(first, left, np.roll(at, 1)), at[last]))
    end = np.concatenate((at, right[last]))
    interval = np.cumsum(first) - 1
    owner = np.concatenate((interval, interval[last]))
    size = end - begin
    largest = np.lexsort((-size, owner))
    keep = np.ones(len(size), bool)
    keep[largest[np.append(True, owner[largest][1:] != owner[largest][:-1])]] = False
    begin, end, owner, size = begin[keep], end[keep], owner[keep], size[keep]
    depth, low, high = lcp[at[first]], left[first], right[first]

    found = []
    ends = np.cumsum(size)
    for a, b in _slices(ends, 1 << 20):
        many = size[a:b]
        child = np.repeat(np.arange(a, b), many)
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + begin[child]
        suffix, q = order[place], depth[owner[child]]
        for sign in (1, -1):
            other = suffix + sign * q
            ok = np.flatnonzero((other >= 0) & (other < n))
            there = inverse[other[ok]]
            c = child[ok]
            o = owner[c]
            hit = (there >= low[o]) & (there < high[o]) & ((there < begin[c]) | (there >= end[c]))
            ok = ok[hit]
            found.append(np.stack((np.minimum(suffix[ok], other[ok]), q[ok]), axis=1))
    squares = np.unique(np.concatenate(found), axis=0) if found else none[:, :2]
    if not len(squares):
        return none

    # Rotate each square to the left while the word before it equals the one that ends its first half.
    start, q = squares[:, 0].copy(), squares[:, 1]
    for k in range(len(ranks) - 1, -1, -1):
        back = start - (1 << k)
        same = back >= 0
        same[same] = ranks[k][back[same]] == ranks[k][back[same] + q[same]]
        start = np.where(same, back, start)
    stop = squares[:, 0] + 2 * q
    order = np.lexsort((q, stop, start))
    start, stop, q = start[order], stop[order], q[order]
    merged = np.append(True, (start[1:] != start[:-1]) | (stop[1:] != stop[:-1]))
    merged &= stop - start >= np.maximum(least, periods * q)
    out = np.stack((start, stop - start, q), axis=1)[merged]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _slices(ends: np.ndarray, most: int):
    """Stretches of items whose sizes add up to about ``most``."""
    at = 0
    while at < len(ends):
        done = ends[at - 1] if at else 0
        to = max(int(np.searchsorted(ends, done + most, "right")), at + 1)
        yield at, to
        at = to


def dropped(found: np.ndarray, n: int) -> np.ndarray:
    """Whether each of ``n`` words stands in a run after the run's first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, found[:, 0] + found[:, 2], 1)
    np.add.at(steps, found[:, 0] + found[:, 1], -1)
    return np.cumsum(steps)[:n] > 0


Rewrite = Callable[[object, int], "np.ndarray | None"]


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, periods: int = LEAST_PERIODS,
           rewrite: Rewrite | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, runs (array of start, length, period) and collapsed text.

    Words are what white space separates. ``collapsed`` keeps the first period of
    each run, words joined by one space. ``rewrite`` may replace the words of a
    document before the search: from its id and number of words it gives the
    places of the words to take, or None. Null and empty texts have no words, no
    runs and an empty collapsed text. A null id stays null; repeated rows and ids
    are rows of their own; an empty table gives an empty result; other columns are
    not read. Texts are searched whole, in batches of about a megabyte; a longer
    text is a batch of its own.
    """
    def run(batches):
        for batch in textnum.parts(batches):
            yield _detect(batch, least, periods, rewrite)

    schema = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _detect(batch: pa.RecordBatch, least: int, periods: int, rewrite: Rewrite | None) -> pa.RecordBatch:
    keys = batch.column(0).to_pylist()
    data, offsets = textnum.text_bytes(batch.column(1))
    starts, ends, bounds = textnum.words(data, offsets)
    if rewrite is not None:
        taken = np.arange(len(starts))
        for key, a, b in zip(keys, bounds[:-1], bounds[1:]):
            if (places := rewrite(key, int(b - a))) is not None:
                taken[a:b] = places + a
        starts, ends = starts[taken], ends[taken]
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(keys)), sizes)
    numbers = textnum.word_numbers(data, starts, ends) if len(starts) else np.zeros(0, np.int64)
    found = runs(owner * (numbers.max(initial=0) + 1) + numbers, least, periods)
    gone = dropped(found, len(starts))
    mine = owner[found[:, 0]]
    per_text = np.searchsorted(mine, np.arange(len(keys) + 1))
    fields = [pa.array(found[:, 0] - bounds[mine]), pa.array(found[:, 1]), pa.array(found[:, 2])]
    listed = pa.ListArray.from_arrays(pa.array(per_text, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), listed, _joined(data, starts, ends, bounds, gone)],
                                      ["doc_id", "n_words", "runs", "collapsed"])


def _joined(data, starts, ends, bounds, gone) -> pa.Array:
    """Texts of the kept words, joined by one space, as one string column."""
    kept = np.flatnonzero(~gone)
    of_text = np.searchsorted(kept, bounds)
    a, size = starts[kept], ends[kept] - starts[kept]
    room = size + 1
    last = of_text[1:][np.diff(of_text) > 0] - 1
    room[last] -= 1  # no space after a text's last word
    at = np.concatenate(([0], np.cumsum(room)))
    out = np.full(at[-1], 0x20, np.uint8)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(at[:-1], size) + inside] = data[np.repeat(a, size) + inside]
    return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(at[of_text].astype(np.int64)), pa.py_buffer(out)]) \
        .cast(pa.string())


def planted(key, n: int) -> np.ndarray | None:
    """The rewriting of the registered query: in a tenth of the documents, words from some place on repeat with a period."""
    h = zlib.crc32(b"" if key is None else str(key).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def digests(found: DataFrame) -> DataFrame:
    """Counts, the run of the greatest exponent and digests, out of the rows of ``detect``."""
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    # Exponents are compared as fractions: a / b > c / d where a * d > c * b. Runs come by start, then period.
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(
        r["length"].cast("decimal(19,0)") * best["period"] > best["length"].cast("decimal(19,0)") * r["period"], r).otherwise(best))
    picked = found.withColumn("best", best)
    return picked.select(
        "doc_id", "n_words", F.size("runs").cast("bigint").alias("n_runs"), *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
