"""Vector best-fit packing of tokenised documents into sequences.

Only lengths decide where a piece may go, so the packing is planned on the
histogram of piece lengths: at most ``tokens`` numbers, whatever the corpus. The
plan fills groups of like bins, long pieces first; a piece goes to the bins it
leaves with the smallest weighted residual norm (or that have the largest
weighted dot product with it) among those with room for its tokens, one more
document and its attention cost (squared length). Pieces are then numbered
within their length by two-level counting and look up their place in the plan.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from liftlake.llm import bpe, textnum
from liftlake.llm.util import saved
from liftlake.session import broadcast_if_small

TOKENS = 1024
END_ID = 2
# Pieces of one length that are numbered together, about; a length has as many groups as that takes, and at least a few.
GROUP, LEAST_GROUPS = 500_000, 64


def plan(counts: dict[int, int], tokens: int = TOKENS, max_documents: int | None = None, max_attention: int | None = None,
         weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm") -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first piece, pieces, first sequence, offset): consecutive pieces go to consecutive sequences.

    ``counts``: pieces per length. Capacities left out never bind. ``weights`` are
    those of the residual shares of tokens, documents and attention cost.
    """
    max_documents = tokens if max_documents is None else max_documents
    max_attention = tokens * tokens if max_attention is None else max_attention
    size = np.array([tokens, max_documents, max_attention], float)
    w = np.array(weights)
    # Groups of like bins: room for tokens, documents, attention; number of bins; first bin.
    room = np.zeros((0, 3))
    many: list[int] = []
    first: list[int] = []
    bins = 0
    slots = []
    for length in sorted(counts, reverse=True):
        left, placed = counts[length], 0
        need = np.array([length, 1, length * length], float)
        if (need > size).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")

        def put(at: int, offset: int, n: int, each: int):
            nonlocal placed, left
            for k in range(each):
                slots.append((length, placed, n, at, offset + k * length))
                placed += n
            left -= n * each

        while left:
            fits = (room >= need).all(axis=1)
            if fits.any():
                share, part = room / size, need / size
                cost = ((share - part) ** 2 * w).sum(axis=1) if rule == "norm" else -(share * part * w).sum(axis=1)
                g = int(np.where(fits, cost, np.inf).argmin())
                source = room[g].copy()
            else:
                g, source = -1, size.copy()
            each = int(min(source // need))
            n = left // each if g < 0 else min(left // each, many[g])
            if not n:
                each, n = left, 1
            rest = source - each * need
            offset = tokens - int(source[0])
            if g < 0:
                at, bins = bins, bins + n
            else:
                at = first[g]
                first[g] += n
                many[g] -= n
                if not many[g]:
                    room = np.delete(room, g, axis=0)
                    del many[g], first[g]
            put(at, offset, n, each)
            if rest[0] >= 1 and rest[1] >= 1 and rest[2] >= 1:
                room = np.vstack([room, rest])
                many.append(n)
                first.append(at)
    return slots


def groups_of(pieces: int) -> int:
    """Groups that so many pieces of one length are dealt to."""
    return max(LEAST_GROUPS, -(-pieces // GROUP))


def tokenised(docs: DataFrame, id_col: str, text_col: str, tokens: int, end_id: int, files: tuple[str, str],
              with_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""

    def run(batches):
        encoder = bpe.byte_bpe(*files)
        for batch in textnum.parts(batches):
            rows, ids_out = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encoder.encode(text), np.uint16(end_id)).astype("<u4")
                head = len(ids) % tokens or min(tokens, len(ids))
                cuts = [0, *range(head, len(ids) + 1, tokens)]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    rows.append((key, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                    if with_ids:
                        ids_out.append(ids[a:b].astype(np.int32))
            cols = list(zip(*rows))
            arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(ids_out, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                         F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return picked.mapInArrow(run, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: int = TOKENS, end_id: int = END_ID,
         files: tuple[str, str] | None = None, with_ids: bool = False, **capacities) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document's ids are those of its text and ``end_id``. Only documents beyond
    ``tokens`` are cut, into full pieces but for the first. Null and empty texts
    are one piece of one id; a null id stays null; repeated rows are packed as often
    as they come; an empty table packs into nothing. Other columns are not read.
    ``capacities`` go to ``plan``; a piece that exceeds one is an error.
    """
    pieces = saved(tokenised(docs, id_col, text_col, tokens, end_id, files or bpe.default_files(), with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``tokens`` rows
    slots = sorted(plan(counts, tokens, **capacities))

    groups = F.array(*[F.lit(groups_of(counts.get(length, 0))) for length in range(tokens + 1)])
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(groups, F.col("length").cast("int"))))
    parts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))  # a row per ``GROUP`` pieces, and ``LEAST_GROUPS`` a length
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("nth", F.row_number().over(order) - 1).join(broadcast_if_small(starts), ["length", "part"]) \
        .withColumn("nth", F.col("nth") + F.col("before")).drop("part", "before")

    table = np.array(slots, np.int64).reshape(-1, 5)
    where = {int(x): (a, b) for x, a, b in zip(*_ranges(table[:, 0]))}
    names = [*pieces.columns[:5], "sequence_id", "offset", *(["ids"] if with_ids else [])]

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            nth = batch.column("nth").to_numpy()
            slot = np.empty(len(length), np.int64)
            for x in np.unique(length):
                a, b = where[int(x)]
                mine = length == x
                slot[mine] = a + np.searchsorted(table[a:b, 1], nth[mine], "right") - 1
            found = {"sequence_id": pa.array(table[slot, 3] + nth - table[slot, 1]), "offset": pa.array(table[slot, 4])}
            yield pa.RecordBatch.from_arrays([found.get(c) if c in found else batch.column(c) for c in names], names)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return ranked.mapInArrow(place, schema + ", ids array<int>" * with_ids)


def _ranges(keys: np.ndarray):
    """Distinct values of a sorted array with where each begins and ends."""
    values, first = np.unique(keys, return_index=True)
    return values, first, np.append(first[1:], len(keys))
