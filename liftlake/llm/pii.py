"""Personal data in whole texts: exact patterns plus a character BiLSTM-CRF.

The patterns give e-mail addresses, IPv4 addresses, card numbers and phone
numbers. Windows around such spans, around values that are assigned to a secret's
name, and around digits that are neither, are the labelled data on which the tagger
is trained in numpy on the driver, with rewritten forms of the same spans that the
patterns do not cover (numbers without a plus, other separators, other names and
alphabets of secrets). The tagger then reads every stretch of text within
``REACH`` characters of a digit or an @, which each kind contains, in windows that
overlap by half. Each character takes its tag from the window in which it lies
deepest; the joined tags give spans for the whole text. A span is added if it
stands the kind's own test and does not overlap a pattern's span. Secrets have no
pattern of their own: all of them are the tagger's.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlake.llm import textnum
from liftlake.llm.bilstm_crf import Tagger
from liftlake.llm.util import saved

KINDS = ("email", "ip", "card", "phone")
# The kinds that the tagger knows.
TAGGED = (*KINDS, "secret")
SECRET = len(KINDS)
WINDOW = 96
REACH = 40
# Labelled windows the tagger is fitted on, per kind (and for stretches without a span).
SAMPLE = 250
# Other forms of each secret in the sample.
REWRITTEN_SECRETS = 3

# The four patterns, written so that each start is tried once.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_TRIGGER = re.compile("[0-9@]")
# Labels for training: a value of mixed letters and digits that is assigned to a secret's name.
_NAMED = re.compile(r"(?i)\b(token|secret|api[_-]?key|password|passwd|access[_-]?key|auth)(['\"]?\s{0,3}[=:]\s{0,3}['\"]?)([A-Za-z0-9+/_-]{16,128})")
_VALUE = re.compile(r"[A-Za-z0-9+/_=.-]+")
_DIGIT = re.compile("[0-9]")
_PHONE_FORM = re.compile(r"[+(]?[0-9][0-9 ().+/-]*[0-9]\Z")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(int(d) * 2 - 9 * (d > "4") for d in digits[-2::-2])) % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def _small_parts(s: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in s.split("."))


def _emails(text: str):
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        floor = m.end() if m else at + 1
        at = text.find("@", floor)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' spans, sorted by start, then kind."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _small_parts(m[0])]
        for m in _CARD.finditer(text):
            d = _digits(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found)


def named_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of values assigned to a secret's name."""
    return [(m.start(3), SECRET, m.end(3)) for m in _NAMED.finditer(text) if _plausible(SECRET, m[3])]


def _plausible(kind: int, s: str) -> bool:
    """The test a tagged span of a kind must stand."""
    d = _digits(s)
    if kind == SECRET:
        return 16 <= len(s) <= 256 and bool(_VALUE.fullmatch(s)) and len(d) >= 2 and len(set(s)) >= 8 and any(c.isalpha() for c in s)
    if kind == 0:
        return bool(re.fullmatch(r"[^\s@]+\s?@\s?[^\s@]+\.[^\s@]*[A-Za-z0-9]", s))
    if kind == 1:
        parts = re.split(r"[^0-9]+", s)
        return len(parts) == 4 and all(parts) and _small_parts(".".join(parts))
    if kind == 2:
        return bool(re.fullmatch(r"[0-9][0-9 ./_-]*[0-9]", s)) and 12 <= len(d) <= 19 and luhn(d)
    return bool(_PHONE_FORM.match(s)) and 9 <= len(d) <= 15 and any(c in " ().+/-" for c in s) and s.count("(") == s.count(")")


# -- the tagger's view of a text -------------------------------------------------

_CODES = np.full(0x3000, 98, np.uint8)
_CODES[:128] = np.where(np.arange(128) < 32, 97, np.arange(128) - 31)
_OTHER, _PAD = 99, 0
N_CODES = 100
O_TAG = 0


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < len(_CODES), _CODES[np.minimum(points, len(_CODES) - 1)], _OTHER).astype(np.uint8)


def _stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text within reach of a digit or @."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _windows(a: int, b: int) -> list[int]:
    """Starts of half-overlapping windows over a stretch."""
    return list(range(a, max(a + 1, b - WINDOW // 2), WINDOW // 2))


def _tags(length: int, spans, offset: int) -> np.ndarray:
    tags = np.zeros(length, np.int8)
    for start, kind, end in spans:
        a, b = max(0, start - offset), min(length, end - offset)
        if a < b:
            tags[a:b] = 2 * kind + 2
            if start >= offset:
                tags[a] = 2 * kind + 1
    return tags


def _tagged_spans(text: str, tags: np.ndarray, at: int):
    """Spans (start, kind, end) of tags that begin at position ``at`` of the text."""
    inside = np.flatnonzero(tags != O_TAG)
    k = 0
    while k < len(inside):
        kind = (int(tags[inside[k]]) - 1) // 2
        j = k + 1
        while j < len(inside) and inside[j] == inside[j - 1] + 1 and int(tags[inside[j]]) == 2 * kind + 2:
            j += 1
        yield int(inside[k]) + at, kind, int(inside[j - 1]) + 1 + at
        k = j


def find(texts: list[str], tagger: Tagger | None, batch: int = 256) -> list[tuple[list, list]]:
    """For each text the patterns' spans and all spans."""
    base = [base_spans(t) for t in texts]
    if tagger is None:
        return [(b, b) for b in base]
    jobs, codes = [], []
    for n, text in enumerate(texts):
        for a, b in _stretches(text):
            c = _codes(text[a:b])
            for w in _windows(0, b - a):
                x = np.full(WINDOW, _PAD, np.uint8)
                x[:min(WINDOW, b - a - w)] = c[w:w + WINDOW]
                codes.append(x)
                jobs.append((n, a, b, w))
    spans: list[list] = [[] for _ in texts]
    depth = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])
    paths = [tagger.decode(np.array(codes[k:k + batch])) for k in range(0, len(codes), batch)]
    paths = np.concatenate(paths) if paths else np.zeros((0, WINDOW), np.int8)
    k = 0
    while k < len(jobs):
        n, a, b, _ = jobs[k]
        tags, best = np.zeros(b - a, np.int8), np.full(b - a, -1)
        while k < len(jobs) and jobs[k][:3] == (n, a, b):
            w = jobs[k][3]
            size = min(WINDOW, b - a - w)
            deep = depth[:size].copy()
            if w == 0:
                deep[:WINDOW // 2] = WINDOW
            if w + WINDOW >= b - a:
                deep[min(size, WINDOW // 2):] = WINDOW
            take = deep > best[w:w + size]
            tags[w:w + size][take] = paths[k][:size][take]
            best[w:w + size][take] = deep[take]
            k += 1
        spans[n] += _tagged_spans(texts[n], tags, a)
    out = []
    for text, known, extra in zip(texts, base, spans):
        added, end = [], 0
        for start, kind, stop in sorted(extra):
            while stop > start and text[stop - 1] in " .,;:!?\n":
                stop -= 1
            while start < stop and text[start] in " \n":
                start += 1
            if kind == SECRET and start < stop:
                start, stop = _whole_value(text, start, stop)
            edge = (start and text[start - 1].isalnum()) or (stop < len(text) and text[stop].isalnum())
            if start < end or edge or not _plausible(kind, text[start:stop]):
                continue
            if any(start < b and a < stop for a, _, b in known):
                continue
            added.append((start, kind, stop))
            end = stop
        out.append((known, sorted(known + added)))
    return out


def _whole_value(text: str, start: int, stop: int) -> tuple[int, int]:
    """The run of a value's characters that most of a span lies in."""
    runs = [(min(stop, b) - max(start, a), a, b) for a, b in _runs(text, start, stop)]
    if not runs:
        return start, stop
    _, a, b = max(runs)
    return a, b


def _runs(text: str, start: int, stop: int):
    a = start
    while a > 0 and start - a < 256 and _VALUE.match(text[a - 1]):
        a -= 1
    for m in _VALUE.finditer(text, a, min(len(text), stop + 256)):
        if m.start() >= stop:
            return
        end = m.end()
        while text[end - 1] in ".=-" and end > m.start() + 1:  # marks after the value
            end -= 1
        if end > start:
            yield m.start(), end


# -- training --------------------------------------------------------------------

_NAMES = ("token", "secret", "api_key", "apikey", "API-KEY", "password", "passwd", "access_key", "auth", "client_secret", "Bearer", "SECRET_KEY", "pwd", "key")
_SIGNS = (" = ", "=", ": ", ":", "=\"", ": \"", " = '", " ", "\": \"", " is ")
_ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
              "abcdefghijklmnopqrstuvwxyz0123456789_-")
_HEADS = ("", "", "", "sk_live_", "ghp_", "AKIA", "xoxb-")


def _another_secret(text: str, start: int, stop: int, rng: np.random.Generator) -> tuple[str, int, int]:
    """The window with the secret, its name and its sign exchanged; where the new one stands."""
    def one(of):
        return of[int(rng.integers(len(of)))]

    alphabet = one(_ALPHABETS)
    value = one(_HEADS) + "".join(one(alphabet) for _ in range(int(rng.integers(20, 44))))
    value = value if _plausible(SECRET, value) else value + "4f2a9c1e"
    m = next((m for m in _NAMED.finditer(text) if m.start(3) == start), None)
    before = text[:m.start()] + one(_NAMES) + one(_SIGNS) if m else text[:start]
    return before + value + text[stop:], len(before), len(before) + len(value)


def _rewritten(kind: int, s: str, rng: np.random.Generator) -> str:
    """Another way to write the same datum."""
    d = _digits(s)
    pick = int(rng.integers(4))
    if kind == 0:
        return s.replace("@", (" @ ", "@ ", " @", "@")[pick])
    if kind == 2:
        sep = (".", "/", "-", " ")[pick]
        return sep.join(d[k:k + 4] for k in range(0, len(d), 4))
    if kind == 3 and len(d) >= 10:
        d = d[-10:]
        return (f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"{d[:3]} {d[3:6]} {d[6:]}")[pick]
    return s


def labelled_windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Stretches of text around each span, or around digits that are none: kind (-1 for none), text, span, order."""

    def run(batches):
        for batch in textnum.parts(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                if not _TRIGGER.search(text):
                    continue
                known = sorted(base_spans(text) + named_secrets(text))
                for start, kind, end in known:
                    # A span longer than a window begins with it.
                    a = max(0, start - max(0, WINDOW - (end - start)) // 2)
                    rows.append((kind, text[a:a + WINDOW], start - a, min(end - a, WINDOW)))
                for a, b in _stretches(text):
                    for w in _windows(a, b):
                        if not any(s < w + WINDOW and w < e for s, _, e in known):
                            rows.append((-1, text[w:w + WINDOW], 0, 0))
            cols = list(zip(*rows)) or [[], [], [], []]
            order = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest() for t in cols[1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()),
                 pa.array(cols[3], pa.int32()), pa.array(order, pa.string())], ["kind", "window", "start", "stop", "nth"])

    return _picked(docs, id_col, text_col).mapInArrow(run, "kind int, window string, start int, stop int, nth string")


def _picked(docs, id_col, text_col):
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, epochs: int = 12,
        seed: int = 3) -> Tagger | None:
    """Train the tagger on at most ``sample`` windows of each kind; None if no text holds a span."""
    windows = saved(labelled_windows(docs, id_col, text_col).distinct(), "windows")
    rows = []
    for kind in range(-1, len(TAGGED)):
        rows += windows.where(F.col("kind") == kind).orderBy("nth", "window", "start").limit(sample).collect()
    if all(r["kind"] < 0 for r in rows):
        return None
    rng = np.random.default_rng(seed)
    codes, tags = [], []

    def add(window: str, spans):
        x = np.full(WINDOW, _PAD, np.uint8)
        c = _codes(window[:WINDOW])
        x[:len(c)] = c
        codes.append(x)
        tags.append(_tags(WINDOW, spans, 0))

    for r in rows:
        text, kind, a, b = r["window"], r["kind"], r["start"], r["stop"]
        if kind < 0:
            add(text, [])
            continue
        known = base_spans(text)
        # What is known of the whole text holds where the window cuts it.
        add(text, [*[s for s in known if s[2] <= a or s[0] >= b], *[s for s in named_secrets(text) if s[2] <= a or s[0] >= b], (a, kind, b)])
        if kind == SECRET:
            for _ in range(REWRITTEN_SECRETS):
                moved, start, stop = _another_secret(text, a, b, rng)
                add(moved, [*[s for s in base_spans(moved) if s[2] <= start or s[0] >= stop], (start, kind, stop)])
            continue
        new = _rewritten(kind, text[a:b], rng)
        if new != text[a:b]:
            moved = text[:a] + new + text[b:]
            others = [s for s in base_spans(moved) if s[2] <= a or s[0] >= a + len(new)]
            add(moved, [*others, (a, kind, a + len(new))])
    tagger = Tagger(N_CODES, 2 * len(TAGGED) + 1, seed=seed)
    tagger.fit(np.array(codes), np.array(tags), epochs=epochs, seed=seed)
    textnum._release()
    return tagger


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tagger: Tagger | None = None, train: bool = True,
           keep: tuple[str, ...] = (), redact: str | None = None) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans, and ``keep`` columns.

    The counts and ``base_spans`` are those of the patterns; ``spans`` holds all.
    Both are arrays of (start, kind, end), in code points, end exclusive, sorted by
    start and then by kind as listed in ``TAGGED``. With ``redact`` (such as "[{}]") the
    text comes back as ``redacted`` with each span, merged where spans overlap,
    replaced by its kind in capitals. Null text counts as empty; a null id stays
    null; equal rows are returned as often as they come. Without a tagger one is
    fitted on ``docs`` unless ``train`` is off; then the patterns stand alone.
    """
    if tagger is None and train:
        tagger = fit(docs, id_col, text_col)
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def run(batches):
        for batch in textnum.parts(batches):
            texts = batch.column(1).to_pylist()
            found = find(texts, tagger)
            listed = [[[{"start": a, "kind": TAGGED[k], "end": b} for a, k, b in f[x]] for f in found] for x in (0, 1)]
            counts = [pa.array([sum(k == c for _, k, _ in f[0]) for f in found], pa.int64()) for c in range(len(KINDS))]
            arrays = [batch.column(0), *counts, pa.array(listed[0], span), pa.array(listed[1], span), *batch.columns[2:]]
            names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_spans", "spans", *(f"k_{c}" for c in keep)]
            if redact is not None:
                arrays.append(pa.array([_redacted(t, f[1], redact) for t, f in zip(texts, found)], pa.string()))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays(arrays, names)

    spans = "array<struct<start:bigint,kind:string,end:bigint>>"
    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                         *[F.col(c).alias(f"k_{c}") for c in keep])
    kept = "".join(f", `k_{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + f", base_spans {spans}, spans {spans}" + kept
    return picked.mapInArrow(run, schema + ", redacted string" * (redact is not None))


def _redacted(text: str, spans, form: str) -> str:
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], form.format(TAGGED[kind].upper())]
        at = max(at, end)
    return "".join([*out, text[at:]])


def joined(spans):
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
