"""Interpolated modified Kneser-Ney model of two or three words, counted in Spark, memory-mapped by the scoring workers.

Words, contexts (the one or two words before) and n-grams are 64-bit hashes. Each
task counts its own part of the corpus with numpy and sends sorted blocks (hashes and
counts, byte planes apart so that they compress) to shards; a shard merges its
blocks and writes sorted arrays to the shared folder. The longest n-grams are
counted; a shorter one counts in how many contexts it stands. N-grams are dealt by
their context, so what is known of it lies in one shard; the few contexts that open
a large share of all n-grams are dealt by the n-gram. The number of shards follows
the bytes of text; sums over shards are Spark's, so the driver sees counts of counts
and the frequent contexts only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlake.llm import shared_arrays as files
from liftlake.llm import textnum
from liftlake.llm.util import fold, saved
from liftlake.session import shared_dir

# Tokens counted by a task before their block goes out.
FLUSH_TOKENS = 2_000_000
# A context's n-grams are dealt one by one when it is more than this share of all; so there are at most 1 / share such contexts.
HOT_SHARE = 1 / 256
# Bytes of text whose n-grams make a shard.
SHARD_BYTES, MIN_SHARDS = 32 << 20, 8
# Arrays that a worker keeps mapped.
MAX_MAPPED = 8192

# Hashes of the marks before the first and after the last word of a text; words never take them on purpose.
BEGIN, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0x27D4EB2F165667C5)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _planes(a: np.ndarray) -> bytes:
    return a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()


def _unplaned(b, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def _tokens(column, order):
    """Of a batch: the token before the previous one (for an order of 3), the previous and the current token as hashes, and n + 1 offsets of each text's tokens."""
    data, offsets = textnum.text_bytes(column)
    data = textnum.LOWER[data]
    starts, ends, per_text = textnum.words(data, offsets)
    n = len(per_text) - 1
    bounds = per_text + np.arange(n + 1)
    current = np.empty(bounds[-1], np.uint64)
    last = np.zeros(bounds[-1], bool)
    last[bounds[1:] - 1] = True
    current[last] = END
    current[~last] = textnum.word_hashes(data, starts, ends)

    def shifted(tokens):
        out = np.empty_like(tokens)
        out[1:] = tokens[:-1]
        out[bounds[:-1]] = BEGIN
        return out

    previous = shifted(current)
    return shifted(previous) if order == 3 else None, previous, current, bounds


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of a hash; it grows with the hash, so sorted hashes have sorted shards."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _pair(previous: np.ndarray, current: np.ndarray) -> np.ndarray:
    return textnum.mix(previous * _BASE + current)


def _contexts(order: int, before: np.ndarray, previous: np.ndarray) -> np.ndarray:
    """Hash of the words that an n-gram of an order begins with."""
    return previous if order == 2 else _pair(before, previous)


def _gram_shard(context, grams, hot, shards):
    at = np.minimum(np.searchsorted(hot, context), max(0, len(hot) - 1))
    return _shard(np.where(hot[at] == context, grams, context) if len(hot) else context, shards)


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _flushed(batches, order, block):
    """Collect tokens of the batches and hand about FLUSH_TOKENS at a time to ``block``."""
    held, size = [], 0

    def joined():
        return (None if part[0] is None else np.concatenate(part) for part in zip(*held))

    for batch in textnum.parts(batches, 0):
        *tokens, _ = _tokens(batch.column(0), order)
        held.append(tokens)
        size += len(tokens[-1])
        if size >= FLUSH_TOKENS:
            yield from block(*joined())
            held, size = [], 0
    if size:
        yield from block(*joined())


def _by_shard(shard: np.ndarray, **columns):
    """Rows (shard, one binary per column) of arrays that are sorted by shard."""
    values, first = np.unique(shard, return_index=True)
    ends = np.append(first[1:], len(shard))
    arrays = [pa.array(values, pa.int64())]
    arrays += [pa.array([_planes(np.ascontiguousarray(c[a:b])) for a, b in zip(first, ends)], pa.binary()) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, ["shard", *columns])


def _count_words(order, shards):
    """Blocks of words; of three words also of pairs that are frequent in a block, in shards of negative number."""

    def block(before, previous, current):
        keys, counts = np.unique(current, return_counts=True)
        yield _by_shard(_shard(keys, shards), keys=keys, counts=counts.astype(np.uint32))
        if order == 3:
            # A pair of a large share of all tokens has at least half that share where it is counted at all.
            keys, counts = np.unique(_contexts(3, before, previous), return_counts=True)
            many = counts >= HOT_SHARE / 2 * len(current)
            keys, counts = keys[many][::-1], counts[many][::-1]
            if len(keys):
                yield _by_shard(-1 - _shard(keys, shards), keys=keys, counts=counts.astype(np.uint32))

    return lambda batches: _flushed(batches, order, block)


def _count_grams(order, shards, hot):
    def block(before, previous, current):
        context = _contexts(order, before, previous)
        # Order by shard, then roughly by context and word; what this leaves unmerged the shard merges.
        shard = _gram_shard(context, _pair(context, current), hot, shards)
        high, low = np.uint64(32), np.uint64(0xFFFFFFFF)
        by = np.argsort((context & (low << high)) | (current >> high))
        if len(hot):
            by = by[np.argsort(shard[by], kind="stable")]
        context, previous, current, shard = context[by], previous[by], current[by], shard[by]
        new = np.concatenate(([True], (context[1:] != context[:-1]) | (current[1:] != current[:-1])))
        first = np.flatnonzero(new)
        counts = np.diff(np.append(first, len(new))).astype(np.uint32)
        yield _gram_blocks(shard[first], context[first], previous[first] if order == 3 else None, current[first], counts)

    return lambda batches: _flushed(batches, order, block)


def _gram_blocks(shard, context, last, current, counts):
    """Rows (shard, contexts, runs, words, counts, lasts) of arrays that are sorted by shard; ``lasts``: the last word of a context of two."""
    values, first = np.unique(shard, return_index=True)
    ends = np.append(first[1:], len(shard))
    rows = {"contexts": [], "runs": [], "words": [], "counts": [], "lasts": []}
    for a, b in zip(first, ends):
        v = context[a:b]
        at = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        rows["contexts"].append(_planes(v[at]))
        rows["runs"].append(_planes(np.diff(np.append(at, b - a)).astype(np.uint32)))
        rows["words"].append(_planes(np.ascontiguousarray(current[a:b])))
        rows["counts"].append(_planes(np.ascontiguousarray(counts[a:b])))
        rows["lasts"].append(None if last is None else _planes(last[a:b][at]))
    return pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), *(pa.array(r, pa.binary()) for r in rows.values())], ["shard", *rows])


def _column(t: pa.Table, name: str, dtype) -> np.ndarray:
    parts = [_unplaned(b.as_buffer(), dtype) for b in t.column(name)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


# What a shard has to tell beside its files: sums over shards of five numbers each, by level of the model and key.
_TOLD = pa.list_(pa.struct([("level", pa.int32()), ("key", pa.int64()), *((c, pa.int64()) for c in "abcde")]))
_TOLD_SQL = "array<struct<level:int, key:bigint, a:bigint, b:bigint, c:bigint, d:bigint, e:bigint>>"


def _tell(level: int, counts: np.ndarray, keys=(), stats=()) -> list[dict]:
    """Counts of counts (key null), and the statistics of frequent contexts."""
    numbers = [int((counts == k).sum()) for k in (1, 2, 3, 4)] + [int((counts >= 3).sum())]
    rows = [(None, numbers), *((int(k), [*map(int, s), 0]) for k, s in zip(np.asarray(keys, np.uint64).view(np.int64), stats))]
    return [{"level": level, "key": k, **dict(zip("abcde", n))} for k, n in rows]


def _write_words(folder):
    def run(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        keys, counts = _merged(_column(t, "keys", np.uint64), _column(t, "counts", np.uint32).astype(np.int64))
        words = shard >= 0
        if words:
            files.write(folder, f"word{shard}.keys", keys)
            files.write(folder, f"word{shard}.counts", counts)
        top = np.argsort(-counts, kind="stable")[:2 * int(1 / HOT_SHARE)]
        return pa.table({"words": [words], "types": [len(keys) * words], "tokens": [int(counts.sum()) * words],
                         "top": pa.array([keys[top].view(np.int64)], pa.list_(pa.int64())), "top_n": pa.array([counts[top]], pa.list_(pa.int64()))})

    return run


def _write_grams(folder, order, level, shards, hot, hot_below):
    """Merge a shard's n-grams of one level, write counts and what is known of contexts; sends the level below its counts."""
    kind = _KINDS[level]

    def run(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        runs = _column(t, "runs", np.uint32)
        v = np.repeat(_column(t, "contexts", np.uint64), runs)
        w, c = _column(t, "words", np.uint64), _column(t, "counts", np.uint32).astype(np.int64)
        last = np.repeat(_column(t, "lasts", np.uint64), runs) if level == 3 else None
        by = np.lexsort((w, v))
        v, w, c = v[by], w[by], c[by]
        first = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (w[1:] != w[:-1]))))
        c = np.add.reduceat(c, first)
        v, w = v[first], w[first]
        grams = _pair(v, w)
        by_gram = np.argsort(grams)
        files.write(folder, f"{kind}{shard}.keys", grams[by_gram])
        files.write(folder, f"{kind}{shard}.counts", np.minimum(c[by_gram], 255).astype(np.uint8))
        large = np.flatnonzero(c[by_gram] >= 255)
        files.write(folder, f"{kind}{shard}.large", np.concatenate((grams[by_gram][large], c[by_gram][large].astype(np.uint64))))
        at = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        stats = np.stack([np.add.reduceat(x.astype(np.int64), at) for x in (c, c == 1, c == 2, c >= 3)], axis=1)
        contexts = v[at]
        is_hot = np.isin(contexts, hot)
        files.write(folder, f"{kind}context{shard}.keys", contexts[~is_hot])
        files.write(folder, f"{kind}context{shard}.stats", stats[~is_hot])
        told = _tell(level, c, contexts[is_hot], stats[is_hot]) + _received(t)
        if level == 3:
            # A pair counts the different words before it; one at a text's beginning, which has none, counts as often as it stands.
            last = last[by][first]
            seen = np.where(last == BEGIN, c, 1)
            by = np.lexsort((w, last, _gram_shard(last, _pair(last, w), hot_below, shards)))
            last, w, seen = last[by], w[by], seen[by]
            first = np.flatnonzero(np.concatenate(([True], (last[1:] != last[:-1]) | (w[1:] != w[:-1]))))
            seen, last, w = np.add.reduceat(seen, first), last[first], w[first]
            out = _gram_blocks(_gram_shard(last, _pair(last, w), hot_below, shards), last, None, w, seen.astype(np.uint32))
        else:
            words, seen = _merged(w, np.ones(len(w), np.int64))
            out = _by_shard(_shard(words, shards), keys=words, counts=seen.astype(np.uint32))
        return pa.Table.from_batches([out]).append_column("told", pa.array([told] + [None] * (out.num_rows - 1), _TOLD))

    return run


def _received(t: pa.Table) -> list[dict]:
    return [r for x in t.column("told") if x.is_valid for r in x.as_py()] if "told" in t.column_names else []


def _write_continuations(folder):
    def run(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        keys, n = _merged(_column(t, "keys", np.uint64), _column(t, "counts", np.uint32).astype(np.int64))
        files.write(folder, f"word{shard}.contexts", n)
        return pa.table({"total": [int(n.sum())], "told": pa.array([_tell(1, n) + _received(t)], _TOLD)})

    return run


def _discounts(n: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more from counts of counts.

    A usual value stands where one can't be told, and where the estimate is not
    above 0: a discount of 0 could leave nothing to the lower order.
    """
    n1, n2, n3, n4 = (float(x) for x in n[:4])
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    told = [(k - (k + 1) * y * b / a if a and b else 0.0, usual) for k, (a, b, usual) in enumerate(((n1, n2, 0.5), (n2, n3, 1.0), (n3, n4, 1.5)), 1)]
    return np.array([0.0, *(min(d, k) if d > 0.01 else usual for k, (d, usual) in enumerate(told, 1))])


_KINDS = {2: "pair", 3: "triple"}
# Written last: what it stands beside is whole.
_MARK = "model"
_SENT = "contexts binary, runs binary, words binary, counts binary, lasts binary"


@dataclass
class Level:
    """What holds for all n-grams of a length: discounts, and the statistics of frequent contexts."""

    hot: np.ndarray
    hot_stats: np.ndarray
    discounts: np.ndarray


@dataclass
class Model:
    """Where the arrays are, and the few numbers that hold for all of them."""

    folder: str
    order: int
    shards: int
    tokens: int
    types: int
    levels: dict[int, Level]
    word_discounts: np.ndarray
    continuations: int
    word_spread: float


def train(docs: DataFrame, text_col: str = "text", order: int = 2, shards: int | None = None) -> Model:
    """Count and write a model of the texts; null and empty texts count as their end mark alone.

    ``order``: words of the longest n-grams, 2 or 3.
    """
    if order not in _KINDS:
        raise ValueError("order is 2 or 3")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if shards is None:
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(MIN_SHARDS, -(-size // SHARD_BYTES))
    folder = shared_dir(spark, "lm")

    def by_shard(rows: DataFrame, merge, schema: str) -> DataFrame:
        # More tasks than shards, so that hardly any task gets several.
        return rows.repartition(3 * shards, "shard").groupBy("shard").applyInArrow(merge, schema)

    counted = texts.mapInArrow(_count_words(order, shards), "shard bigint, keys binary, counts binary")
    words = saved(by_shard(counted, _write_words(folder), "words boolean, types bigint, tokens bigint, top array<bigint>, top_n array<bigint>"), "lm-words")
    tokens, types = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    top = words.select("words", F.inline(F.arrays_zip(F.col("top").alias("k"), F.col("top_n").alias("n"))))
    # At most 2 / HOT_SHARE of either kind.
    frequent = top.where((F.col("n") > F.lit(HOT_SHARE / 2 * tokens)) & (~F.col("words") | (F.col("n") > F.lit(HOT_SHARE * tokens)))).collect()
    first = {2: BEGIN, 3: _pair(np.array([BEGIN]), np.array([BEGIN]))[0]}
    hot = {level: np.unique(np.array([r["k"] for r in frequent if r["words"] == (level == 2)] + [int(np.uint64(first[level]).view(np.int64))],
                                     np.int64).view(np.uint64)) for level in (2, 3)}

    sent = texts.mapInArrow(_count_grams(order, shards, hot[order]), f"shard bigint, {_SENT}")
    if order == 3:
        sent = by_shard(sent, _write_grams(folder, order, 3, shards, hot[3], hot[2]), f"shard bigint, {_SENT}, told {_TOLD_SQL}")
    seen = by_shard(sent, _write_grams(folder, order, 2, shards, hot[2], None), f"shard bigint, keys binary, counts binary, told {_TOLD_SQL}")
    done = saved(by_shard(seen, _write_continuations(folder), f"total bigint, told {_TOLD_SQL}"), "lm-told")

    total = done.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    sums = done.select(F.inline("told")).groupBy("level", "key").agg(*(F.sum(c).alias(c) for c in "abcde")).collect()
    numbers = {(r["level"], r["key"]): np.array([r[c] for c in "abcde"], float) for r in sums}
    levels = {}
    for level in range(2, order + 1):
        stats = [numbers.get((level, int(k)), np.zeros(5))[:4] for k in hot[level].view(np.int64)]
        levels[level] = Level(hot[level], np.array(stats), _discounts(numbers.get((level, None), np.zeros(5))))
    word_n = numbers.get((1, None), np.zeros(5))
    d = _discounts(word_n)
    spread = float(d[1] * word_n[0] + d[2] * word_n[1] + d[3] * word_n[4]) / total if total else 1.0
    files.write(folder, _MARK, np.array([shards], np.int64))
    return Model(folder, order, shards, tokens, types, levels, d, total, spread)


class Reader:
    """A worker's view of a model; arrays are mapped when a shard is first asked for."""

    def __init__(self, model: Model):
        self.m = model
        # A shard without entries has no files, so a folder that this worker does not see must not look like empty shards.
        if files.mapped(model.folder, _MARK, np.int64)[0] != model.shards:
            raise ValueError(f"{model.folder} holds another model")
        self.open: dict[tuple[str, int], np.ndarray] = {}

    def _array(self, name: str, shard: int, dtype) -> np.ndarray:
        if (name, shard) not in self.open:
            while len(self.open) >= MAX_MAPPED:
                del self.open[next(iter(self.open))]
            kind, part = name.split(".")
            try:
                found = files.mapped(self.m.folder, f"{kind}{shard}.{part}", dtype)
            except FileNotFoundError:  # a shard without entries has no files
                found = np.zeros(0, dtype)
            self.open[name, shard] = found
        return self.open[name, shard]

    def _look(self, kind: str, keys: np.ndarray, shard: np.ndarray):
        """For keys grouped by shard: (slice of the keys, places in the shard's arrays, whether found, shard)."""
        values, first = np.unique(shard, return_index=True)
        for s, a, b in zip(values, first, np.append(first[1:], len(shard))):
            table = self._array(f"{kind}.keys", int(s), np.uint64)
            if not len(table):
                continue
            at = np.searchsorted(table, keys[a:b])
            at[at == len(table)] = 0
            yield slice(a, b), at, table[at] == keys[a:b], int(s)

    def words(self, keys: np.ndarray):
        """Of sorted word hashes: their count, and the probability of the word whatever its context."""
        m = self.m
        count, spread = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for part, at, ok, s in self._look("word", keys, _shard(keys, m.shards)):
            count[part] = np.where(ok, self._array("word.counts", s, np.int64)[at], 0)
            spread[part] = np.where(ok, self._array("word.contexts", s, np.int64)[at], 0)
        floor = m.word_spread / (m.types + 1)
        if not m.continuations:
            return count, np.full(len(keys), floor)
        return count, (spread - m.word_discounts[np.minimum(spread, 3)]) / m.continuations + floor

    def contexts(self, level: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted context hashes: what was counted after them, and the share left to the lower order."""
        m, info = self.m, self.m.levels[level]
        stats = np.zeros((len(keys), 4))
        kind = f"{_KINDS[level]}context"
        for part, at, ok, s in self._look(kind, keys, _shard(keys, m.shards)):
            table = self._array(f"{kind}.stats", s, np.int64).reshape(-1, 4)
            stats[part] = np.where(ok[:, None], table[at], 0)
        at = np.minimum(np.searchsorted(info.hot, keys), len(info.hot) - 1)
        mine = info.hot[at] == keys
        stats[mine] = info.hot_stats[at[mine]]
        total = stats[:, 0]
        left = stats[:, 1:] @ info.discounts[1:]
        return total, np.where(total > 0, left / np.maximum(total, 1), 1.0)

    def grams(self, level: int, context: np.ndarray, current: np.ndarray) -> np.ndarray:
        """Counts of n-grams."""
        kind, keys = _KINDS[level], _pair(context, current)
        shard = _gram_shard(context, keys, self.m.levels[level].hot, self.m.shards)
        order = np.lexsort((keys, shard))
        keys, shard = keys[order], shard[order]
        found = np.zeros(len(keys), np.int64)
        for part, at, ok, s in self._look(kind, keys, shard):
            c = np.where(ok, self._array(f"{kind}.counts", s, np.uint8)[at], 0).astype(np.int64)
            many = np.flatnonzero(c == 255)
            if len(many):
                large = self._array(f"{kind}.large", s, np.uint64).reshape(2, -1)
                c[many] = large[1][np.searchsorted(large[0], keys[part][many])].astype(np.int64)
            found[part] = c
        out = np.empty_like(found)
        out[order] = found
        return out

    def score(self, before: np.ndarray, previous: np.ndarray, current: np.ndarray, bounds: np.ndarray):
        """Per text: known tokens, log10 probability under add-one word frequency and under the model."""
        m = self.m
        keys, cur = np.unique(current, return_inverse=True)
        count, low = self.words(keys)
        p = low[cur]
        for level, info in m.levels.items():
            context = _contexts(level, before, previous)
            keys, place = np.unique(context, return_inverse=True)
            total, left = self.contexts(level, keys)
            c = self.grams(level, context, current)
            p = (c - info.discounts[np.minimum(c, 3)]) / np.maximum(total[place], 1) + left[place] * p
        base = np.log10((count + 1) / (m.tokens + (m.types + 1)))
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        sums = [np.bincount(text, weights=x, minlength=len(bounds) - 1) for x in ((count > 0)[cur], base[cur], np.log10(p))]
        return sums[0].astype(np.int64), sums[1], sums[2]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Tokens are the words, A-Z lower-cased, and one end mark; a null or empty text
    is the end mark alone. Unknown words take the share the lower order leaves to
    them. A null id stays null, repeated rows are scored alike, an empty table gives
    an empty result; other columns are not read.
    """

    def run(batches):
        reader = Reader(model)
        for batch in textnum.parts(batches):
            *tokens, bounds = _tokens(batch.column(1), model.order)
            known, base, own = reader.score(*tokens, bounds)
            n = np.diff(bounds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.tokens)), pa.array(base), pa.array(own),
                 pa.array(10 ** (-own / n))], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, "
                                  "perplexity double")


def learned_from(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents a model may learn from: all but a fixed seventh."""
    return docs.where(fold(id_col, 7) != 2)
