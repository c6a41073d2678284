"""Token ids as Arrow files of equal-length sequences.

Documents are put in ascending id order by a range shuffle; each range becomes a
pair of Arrow IPC files, written in a stream of record batches:

- ``sequences-NNNNN.arrow``: ``ids`` and ``mask``, fixed-size lists of ``length``
  entries, ``rows`` sequences a batch. The documents of the range follow each
  other without gaps; only the range's last sequence is padded (mask 0).
- ``documents-NNNNN.arrow``: ``doc_id``, ``start`` (ids before it in the range)
  and ``n_tokens``.

``manifest.arrow`` has a line per range: documents, tokens and sequences in it and
before it. Nothing is compressed, so a memory-mapped file gives any sequence as a
view: batch ``k // rows``, row ``k % rows``; masks are packed into bits.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from liftlake.llm import textnum
from liftlake.session import shared_dir

LENGTH = 2048
ROWS = 64
END_ID = 1
# Text of one range of documents, so of one pair of files; there are as many ranges as that takes.
RANGE_BYTES = 64 << 20
# Documents listed in one batch of a documents file.
LISTED = 4096
MANIFEST = "manifest.arrow"
_LISTING = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
_COUNTS = "part int, documents bigint, tokens bigint, sequences bigint"


@lru_cache(2)
def _tokenizer(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Tokenizer.from_file(path)


# -- files of the shared folder ------------------------------------------------------------


def _store(folder: str):
    """File system and path of a folder."""
    from pyarrow import fs

    u = urlparse(folder)
    if u.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(u.path) if u.scheme else folder
    return fs.FileSystem.from_uri(folder)


def _opened(folder: str, name: str) -> pa.ipc.RecordBatchFileReader:
    """Reader over a mapped file; from a store without local paths over a file read at the places asked for."""
    from pyarrow import fs

    store, path = _store(folder)
    local = isinstance(store, fs.LocalFileSystem)
    return pa.ipc.open_file(pa.memory_map(f"{path}/{name}") if local else store.open_input_file(f"{path}/{name}"))


class _File:
    """An Arrow file written under a name of the attempt's own and renamed when whole, so a repeated task leaves one."""

    def __init__(self, folder: str, name: str, schema: pa.Schema):
        self.store, self.path = _store(folder)
        self.name, self.attempt, self.schema = name, f".{name}.{uuid.uuid4().hex}", schema
        self.store.create_dir(self.path, recursive=True)
        self.sink = self.store.open_output_stream(f"{self.path}/{self.attempt}")
        self.writer = pa.ipc.new_file(self.sink, schema)

    def put(self, *columns: pa.Array):
        self.writer.write_batch(pa.RecordBatch.from_arrays(list(columns), schema=self.schema))

    def close(self):
        self.writer.close()
        self.sink.close()
        self.store.move(f"{self.path}/{self.attempt}", f"{self.path}/{self.name}")


class _Range:
    """Writes the pair of files of one range of documents, a batch at a time."""

    def __init__(self, folder: str, part: int, length: int, rows: int, kind: np.dtype):
        self.length, self.room, self.kind = length, length * rows, kind
        fields = [(name, pa.list_(t, length)) for name, t in (("ids", pa.from_numpy_dtype(kind)), ("mask", pa.bool_()))]
        self.sequences = _File(folder, f"sequences-{part:05d}.arrow", pa.schema(fields))
        self.listing = _File(folder, f"documents-{part:05d}.arrow", _LISTING)
        self.waiting = np.zeros(0, kind)
        self.listed: list[pa.RecordBatch] = []
        self.documents = self.tokens = self.written = 0

    def _sequences(self, ids: np.ndarray, mask: pa.Array):
        self.sequences.put(*(pa.FixedSizeListArray.from_arrays(a, self.length) for a in (pa.array(ids), mask)))
        self.written += len(ids) // self.length

    def _list(self, at_least: int):
        """Write the documents listed so far in batches of a fixed number of rows."""
        waiting = pa.Table.from_batches(self.listed, _LISTING).combine_chunks()
        at = 0
        while waiting.num_rows - at >= at_least:
            for batch in waiting.slice(at, LISTED).to_batches():
                self.listing.put(*batch.columns)
            at += LISTED
        self.listed = waiting.slice(at).to_batches()

    def put(self, keys: pa.Array, ids: np.ndarray, sizes: np.ndarray):
        starts = self.tokens + np.cumsum(sizes) - sizes
        self.listed.append(pa.RecordBatch.from_arrays([keys, pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=_LISTING))
        self.documents += len(sizes)
        self.tokens += len(ids)
        self._list(LISTED)
        self.waiting = np.concatenate((self.waiting, ids))
        whole = len(self.waiting) // self.room * self.room
        full = pa.array(np.ones(self.room, bool))
        for at in range(0, whole, self.room):
            self._sequences(self.waiting[at:at + self.room], full)
        self.waiting = self.waiting[whole:].copy()

    def close(self) -> tuple[int, int, int]:
        """Documents, tokens and sequences of the range; only its last sequence is padded."""
        self._list(1)
        if n := len(self.waiting):
            size = -(-n // self.length) * self.length
            ids = np.zeros(size, self.kind)
            ids[:n] = self.waiting
            self._sequences(ids, pa.array(np.arange(size) < n))
        self.sequences.close()
        self.listing.close()
        return self.documents, self.tokens, self.written


# -- writing -------------------------------------------------------------------------------

# Different units whose ids a worker keeps, about.
_KEPT_UNITS = 600_000
# Units encoded together.
_TOGETHER = 4_000

# How the default tokenizer cuts a text before its merges. Files that say otherwise encode whole texts.
_NORMAL = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_END_OF_WORD = "</w>"

# Bytes of a plain word: ASCII letters and those of Latin-1 (0xC3 and a byte) 1, digits 2, marks 3, all others 0.
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = 3
_CLASS[0x30:0x3A] = 2
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = 1
# Apostrophes may begin a contraction and this sign a special token.
_CLASS[[0x27, 0x3C]] = 0
_SECOND = np.zeros(256, bool)
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False  # multiplication and division


class _Ragged:
    """Rows of different lengths in one growing array."""

    def __init__(self, kind):
        self.flat, self.ends = np.zeros(0, kind), np.zeros(0, np.int64)

    def extend(self, flat: np.ndarray, sizes: np.ndarray):
        self.ends = np.concatenate((self.ends, len(self.flat) + np.cumsum(sizes)))
        self.flat = np.concatenate((self.flat, flat))

    def bounds(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.where(rows > 0, self.ends[rows - 1], 0), self.ends[rows]


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of ``size`` entries from each ``begin`` on, in a row."""
    done = np.cumsum(size)
    out = np.repeat(begin - (done - size), size)
    out += np.arange(len(out))
    return out


class UnitEncoder:
    """Ids of whole texts, each different unit encoded once.

    The default tokenizer drops white space, and none of its pieces, normalisations or
    special tokens reaches across it; so a text's ids are those of its words. A plain
    word (see ``_CLASS``) is lower-cased and cut here as the tokenizer would: into runs of
    letters, single digits and runs of marks. Other words are units as they are. Units
    are known by hash and compared byte by byte.
    """

    def __init__(self, tokenizer_file: str, end_id: int):
        self.tokenizer, self.end_id = _tokenizer(tokenizer_file), end_id
        self.kind = _kind(self.tokenizer)
        self.cut, self.is_last = _cutter(tokenizer_file)
        self._forget()

    def _forget(self):
        self.hashes, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted by hash; row of each
        self.units, self.ids = _Ragged(np.uint8), _Ragged(self.kind)

    def _plain(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in a row as the tokenizer gives them, and their numbers."""
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        each = [np.array(e.ids, self.kind) for e in found]
        return np.concatenate([np.zeros(0, self.kind), *each]), np.array([len(e) for e in each], np.int64)

    def _cut_ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of cut units in a row, and their numbers; a unit's last id is one that ends a word."""
        flats, sizes = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)]
        for k in range(0, len(starts), _TOGETHER):
            a, b = starts[k:k + _TOGETHER], ends[k:k + _TOGETHER]
            size = b - a
            joined = np.full(int((size + 1).sum()), 0x20, np.uint8)
            joined[_spread(np.cumsum(size + 1) - size - 1, size)] = data[_spread(a, size)]
            found = np.array(self.cut.encode_batch_fast([joined.tobytes().decode()], add_special_tokens=False)[0].ids, self.kind)
            flats.append(found)
            sizes.append(np.diff(np.flatnonzero(self.is_last[found]), prepend=-1))
        return np.concatenate(flats), np.concatenate(sizes)

    def _rows_of(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Rows of different units, sorted by hash; unknown ones are encoded first."""
        if len(self.hashes) > _KEPT_UNITS:
            self._forget()
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == hashes[inside]
        rows = np.full(len(hashes), -1)
        rows[known] = self.rows[at[known]]
        if not self._same(rows[known], data, starts[known], ends[known]):
            self._forget()  # another unit of the same hash: too rare to keep both
            return self._rows_of(hashes, data, starts, ends, cut)
        for new, encoded in ((np.flatnonzero(~known & cut), self._cut_ids),
                             (np.flatnonzero(~known & ~cut), lambda d, x, y: self._plain([d[i:j].tobytes() for i, j in zip(x, y)]))):
            if len(new):
                rows[new] = len(self.ids.ends) + np.arange(len(new))
                self.ids.extend(*encoded(data, starts[new], ends[new]))
                size = ends[new] - starts[new]
                self.units.extend(data[_spread(starts[new], size)], size)
        new = np.flatnonzero(~known)
        self.hashes = np.insert(self.hashes, at[new], hashes[new])
        self.rows = np.insert(self.rows, at[new], rows[new])
        return rows

    def _same(self, rows: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bool:
        begin, end = self.units.bounds(rows)
        size = ends - starts
        return bool((end - begin == size).all()) and bool((self.units.flat[_spread(begin, size)] == data[_spread(starts, size)]).all())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, ``end_id`` after each, and the number of each text's ids."""
        data, offsets = textnum.text_bytes(texts)
        if self.cut is None:
            flat, sizes = self._plain([data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])])
            return np.insert(flat, np.cumsum(sizes), self.end_id), sizes + 1
        data, starts, ends, cut, bounds = _units(data, offsets)
        # The end id is one more unit after each text's last.
        last = bounds[1:] + np.arange(len(texts))
        is_end = np.zeros(len(starts) + len(texts), bool)
        is_end[last] = True
        begin, size = np.zeros(len(is_end), np.int64), np.ones(len(is_end), np.int64)
        flat = self.ids.flat
        if len(starts):
            hashes = textnum.word_hashes(data, starts, ends)
            different, first, numbers = np.unique(hashes, return_index=True, return_inverse=True)
            model = first[numbers]
            if (ends - starts != (ends - starts)[model]).any() or not textnum.same_bytes(data, starts, starts[model], ends - starts):
                # Two units of one hash: without it, then.
                different, first, numbers = np.unique(np.arange(len(starts)), return_index=True, return_inverse=True)
                flat, counts = self._plain([data[a:b].tobytes() for a, b in zip(starts, ends)])
                a, b = np.cumsum(counts) - counts, np.cumsum(counts)
            else:
                a, b = self.ids.bounds(self._rows_of(different, data, starts[first], ends[first], cut[first]))
                flat = self.ids.flat
            begin[~is_end], size[~is_end] = a[numbers], (b - a)[numbers]
        done = np.cumsum(size)
        begin[is_end] = len(flat)
        ids = np.append(flat, np.array([self.end_id], self.kind))[_spread(begin, size)]
        return ids, np.diff(done[last], prepend=0)


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with plain words lower-cased; starts and ends of units, whether they were cut here, and n + 1 offsets of each text's units."""
    starts, ends, bounds = textnum.words(data, offsets)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return data, none, none, none.astype(bool), np.zeros(len(offsets), np.int64)
    kind = _CLASS[data]
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    second = after & _SECOND[data]
    kind[second] = 1
    # A first byte without a second one of a letter, and a second one by itself, are not plain.
    alone = data == 0xC3
    alone[:-1] &= ~second[1:]
    kind[alone] = 0
    word = np.repeat(np.arange(len(starts)), ends - starts)
    at = _spread(starts, ends - starts)
    plain = np.ones(len(starts), bool)
    plain[word[kind[at] == 0]] = False
    inside = at[plain[word]]
    lowered = data.copy()
    part = data[inside]
    up = ((part >= 0x41) & (part <= 0x5A)) | (second[inside] & (part <= 0x9E))
    lowered[inside[up]] += 32
    # In plain words a unit begins with the word, where the class changes, and with each digit.
    begins = np.zeros(len(data) + 1, bool)
    previous = np.zeros(len(data), np.uint8)
    previous[1:] = kind[:-1]
    begins[inside[(kind[inside] != previous[inside]) | (kind[inside] == 2)]] = True
    begins[starts] = True
    unit_starts = np.flatnonzero(begins)
    of_word = np.searchsorted(starts, unit_starts, "right") - 1
    unit_ends = np.append(unit_starts[1:], len(data))
    unit_ends = np.minimum(unit_ends, ends[of_word])
    return lowered, unit_starts, unit_ends, plain[of_word], np.searchsorted(of_word, bounds)


@lru_cache(2)
def _cutter(tokenizer_file: str) -> tuple[Tokenizer | None, np.ndarray]:
    """The tokenizer for units that are cut and lower-cased already, and which ids end a unit; None if the file cuts otherwise."""
    tokenizer = Tokenizer.from_file(tokenizer_file)
    said = json.loads(tokenizer.to_str())
    cuts = [x.get("pattern") for x in (said["pre_tokenizer"] or {}).get("pretokenizers", ())]
    is_last = np.zeros(tokenizer.get_vocab_size(), bool)
    if said["normalizer"] != _NORMAL or cuts != [{"Regex": _PATTERN}, None] or said["model"].get("end_of_word_suffix") != _END_OF_WORD:
        return None, is_last
    tokenizer.normalizer = normalizers.Sequence([])
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    for token, n in tokenizer.get_vocab().items():
        is_last[n] = token.endswith(_END_OF_WORD)
    return tokenizer, is_last


def _kind(tokenizer: Tokenizer) -> np.dtype:
    return np.dtype(np.uint16 if tokenizer.get_vocab_size() <= 1 << 16 else np.int32)


def write(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
          rows: int = ROWS, end_id: int = END_ID, tokenizer_file: str | None = None, range_bytes: int = RANGE_BYTES) -> TokenFiles:
    """Encode every whole text, append ``end_id`` and write the ids in ascending id order.

    Null ids come first; rows of one id follow each other by a hash of their text,
    equal rows each for themselves, so a repeated id may fill several ranges. Null
    and empty texts are one id, ``end_id``; an empty table gives an empty manifest.
    Other columns are not read. Without ``folder`` a new one of the shared folder is
    taken.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "token-files")
    tokenizer_file = tokenizer_file or public_tokenizers.path("word_bpe_49k.json")
    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = picked.agg(F.sum(F.octet_length("text") + 1).alias("n")).first()["n"] or 0
    spread = min(4 * spark.sparkContext.defaultParallelism, -(-size // (1 << 20)))
    ranges = max(1, spread, -(-size // range_bytes))

    def run(batches):
        part, out, encoder = TaskContext.get().partitionId(), None, UnitEncoder(tokenizer_file, end_id)
        for batch in textnum.parts(batches):
            out = out or _Range(folder, part, length, rows, encoder.kind)
            out.put(batch.column(0), *encoder.encode(batch.column(1)))
        if out is not None:
            documents, tokens, sequences = out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([n]) for n in (documents, tokens, sequences))],
                                             ["part", "documents", "tokens", "sequences"])

    order = ["doc_id", "digest", "row"]
    dealt = picked.withColumn("digest", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id()) \
        .repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "text")
    counted = sorted(dealt.mapInArrow(run, _COUNTS).collect())  # one row a range, that is, per ``range_bytes`` of text
    columns = {name: np.array([r[name] for r in counted], np.int64) for name in ("part", "documents", "tokens", "sequences")}
    lines = dict(columns)
    for name in ("documents", "tokens", "sequences"):
        lines[f"{name}_before"] = np.cumsum(columns[name]) - columns[name]
    lines = pa.RecordBatch.from_arrays([pa.array(v) for v in lines.values()], list(lines))
    manifest = _File(folder, MANIFEST, lines.schema)
    manifest.put(*lines.columns)
    manifest.close()
    return TokenFiles(folder)


# -- reading -------------------------------------------------------------------------------


def _flat(column: pa.Array) -> np.ndarray:
    """Values of a fixed-size-list column as a view of the file's bytes."""
    return column.flatten().to_numpy(zero_copy_only=True)


class TokenFiles:
    """Random access to written sequences and documents; mapped files are opened once and only what is asked for is read."""

    def __init__(self, folder: str):
        self.folder = folder
        batch = _opened(folder, MANIFEST).read_all()
        self.manifest = {name: batch.column(name).to_numpy() for name in batch.column_names}

    @lru_cache(64)  # noqa: B019 - the readers live as long as this object
    def _file(self, kind: str, line: int) -> pa.ipc.RecordBatchFileReader:
        return _opened(self.folder, f"{kind}-{self.manifest['part'][line]:05d}.arrow")

    def __len__(self) -> int:
        """Sequences in all."""
        return int(self.manifest["sequences"].sum())

    def _line(self, column: str, n: int) -> int:
        return int(np.searchsorted(self.manifest[column], n, "right")) - 1

    def sequence(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence ``k``, views of the mapped file."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        line = self._line("sequences_before", k)
        file = self._file("sequences", line)
        length = file.schema.field("ids").type.list_size
        at, row = divmod(k - int(self.manifest["sequences_before"][line]), self._rows(line))
        batch = file.get_batch(at)
        return _flat(batch.column(0))[row * length:(row + 1) * length], batch.column(1).flatten().slice(row * length, length)

    def _rows(self, line: int) -> int:
        return self._file("sequences", line).get_batch(0).num_rows

    def tokens(self, start: int, n: int) -> np.ndarray:
        """Ids from place ``start`` of the whole stream; a view unless they cross a batch or a range."""
        out = []
        while n > 0:
            line = self._line("tokens_before", start)
            file, rows = self._file("sequences", line), self._rows(line)
            room = rows * file.schema.field("ids").type.list_size
            at, skip = divmod(start - int(self.manifest["tokens_before"][line]), room)
            left = int(self.manifest["tokens_before"][line] + self.manifest["tokens"][line]) - start
            piece = _flat(file.get_batch(at).column(0))[skip:skip + min(n, left)]
            if not len(piece):
                raise IndexError(start)
            out.append(piece)
            start, n = start + len(piece), n - len(piece)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)

    def document(self, nth: int) -> tuple[int | None, np.ndarray]:
        """Id and tokens of the ``nth`` document in file order."""
        line = self._line("documents_before", nth)
        at, row = divmod(nth - int(self.manifest["documents_before"][line]), LISTED)
        batch = self._file("documents", line).get_batch(at)
        key, start, n = (batch.column(c)[row].as_py() for c in range(3))
        return key, self.tokens(start + int(self.manifest["tokens_before"][line]), n)

    def documents(self, spark: SparkSession) -> DataFrame:
        """What the files hold of every document: doc_id, start, n_tokens, ids_crc32 (of 32-bit ids), one task a range."""
        folder, lines = self.folder, len(self.manifest["part"])
        schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
        if not lines:
            return spark.createDataFrame([], schema)

        def run(batches):
            files = TokenFiles(folder)
            for batch in batches:
                for line in batch.column(0).to_pylist():
                    yield from files._digests(line)

        return spark.range(0, lines, 1, lines).mapInArrow(run, schema)

    def _digests(self, line: int):
        file, listing = self._file("sequences", line), self._file("documents", line)
        before = int(self.manifest["tokens_before"][line])
        at, flat, first = -1, np.zeros(0, np.uint16), 0  # the batch at hand and the place of its first id in the range
        for b in range(listing.num_record_batches):
            listed = listing.get_batch(b)
            digests = []
            for place, n in zip(listed.column(1).to_pylist(), listed.column(2).to_pylist()):
                digest = 0
                while n:
                    while place >= first + len(flat):
                        first += len(flat)
                        at += 1
                        flat = _flat(file.get_batch(at).column(0))
                    piece = flat[place - first:place - first + n]
                    digest = zlib.crc32(piece.astype("<u4").tobytes(), digest)
                    place, n = place + len(piece), n - len(piece)
                digests.append(digest)
            starts = pa.array(listed.column(1).to_numpy() + before)
            yield pa.RecordBatch.from_arrays([listed.column(0), starts, listed.column(2), pa.array(digests, pa.int64())],
                                             ["doc_id", "start", "n_tokens", "ids_crc32"])
