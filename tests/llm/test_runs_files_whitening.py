"""Periodic runs, token files and whitening against brute force, round trips and another eigensolver."""

import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from conftest import SMALL
from liftlake.llm import periodic, registry, token_files, whitening

SETTINGS = {"max_examples": 150, "deadline": None}
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EDGE = [None, "", " \n\t", "x", "é é é é é é", "a " * 5000, "tick tock " * 40 + "end", "the same text twice", "the same text twice", "z" * 20000,
        (None, "a row without an id"), (3, "one id, another text"), (3, "one id, another text"), "no break and spaces"]


def frame(spark, texts, clash=False):
    rows = [(*(t if isinstance(t, tuple) else (i, t)), "en", None, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    if clash:
        for c in ("runs", "best", "start", "length", "period", "collapsed", "n_words", "digest", "row", "part", "tokens", "ids"):
            df = df.selectExpr("*", f"'x' as {c}")
    return df


# -- periodic runs ---------------------------------------------------------------


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(w, least=6, periods=4):
    found = {}
    for q in range(1, len(w) // periods + 1):
        same = [w[i] == w[i + q] for i in range(len(w) - q)] + [False]
        i = 0
        while i < len(same):
            if not same[i]:
                i += 1
                continue
            j = i
            while same[j]:
                j += 1
            if j + q - i >= max(least, periods * q):
                found.setdefault((i, j + q - i), q)  # the smallest period of a stretch comes first
            i = j
    return sorted((start, length, q) for (start, length), q in found.items())


def brute_digest(key, text):
    w = words(text)
    h = zlib.crc32(b"" if key is None else str(key).encode())
    n = len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + math.floor((n - a) / (3 + g % 8))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = sorted(brute_runs(w), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None,) * 3
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (key, len(found), *best, 1000 * best[1] // best[2] if found else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


@settings(**SETTINGS)
@given(st.lists(st.integers(0, 2), max_size=40), st.integers(1, 12), st.integers(0, 30), st.sampled_from([(6, 4), (2, 2), (6, 3)]))
def test_runs_of_random_words(w, p, a, limits):
    periodic_tail = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    for text in (w, periodic_tail, periodic_tail + w + periodic_tail):
        got = [tuple(map(int, r)) for r in periodic.runs(np.array(text, np.int64), *limits)]
        assert got == sorted(brute_runs(text, *limits), key=lambda r: (r[0], r[2]))


def test_runs_of_fibonacci_words_and_of_one_symbol():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    for text in (b, [7] * 500, [1, 2, 3] * 100 + [4] + [1, 2] * 90):
        got = [tuple(map(int, r)) for r in periodic.runs(np.array(text, np.int64), 2, 2)]
        assert got == sorted(brute_runs(text, 2, 2), key=lambda r: (r[0], r[2]))


def test_equal_hashes_do_not_make_equal_words(monkeypatch):
    monkeypatch.setattr(periodic.textnum, "word_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a b c d e f g g g g g g"])], ["doc_id", "text"])
    assert periodic._detect(batch, 6, 4, None).column("runs").to_pylist() == [[{"start": 6, "length": 6, "period": 1}]]


def test_periodic_query_on_real_texts(spark):
    got = registry.queries()["op12_periodic_runs"](spark, SMALL)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for c, t in got.dtypes if "sha" not in c} == {"bigint"}
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    expected = sorted(brute_digest(*r) for r in texts)
    assert sorted(map(tuple, got.collect())) == expected
    assert sum(r[1] for r in expected) > 5


def test_periodic_edge_cases(spark):
    expected = sorted((brute_digest(*(t if isinstance(t, tuple) else (i, t))) for i, t in enumerate(EDGE)), key=repr)
    for clash in (False, True):
        found = periodic.digests(periodic.detect(frame(spark, EDGE, clash), rewrite=periodic.planted)).drop("n_words")
        assert sorted(map(tuple, found.collect()), key=repr) == expected
    assert periodic.detect(frame(spark, [])).count() == 0


def test_collapsed_texts(spark):
    rows = periodic.detect(frame(spark, ["so " * 7 + "it goes", "a b a b a b a b c", None])).orderBy("doc_id").collect()
    assert [r["collapsed"] for r in rows] == ["so it goes", "a b c", ""]
    assert [[tuple(x) for x in r["runs"]] for r in rows] == [[(0, 7, 1)], [(0, 8, 2)], []]


# -- token files -----------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def plain_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def expected_rows(tokenizer, rows):
    out, start = [], 0
    for key, text in rows:
        ids = plain_ids(tokenizer, text)
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_query_on_real_texts(spark, tokenizer):
    got = registry.queries()["op11_token_files"](spark, SMALL)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "start", "n_tokens", "ids_crc32")]
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, got.collect())) == expected_rows(tokenizer, sorted(map(tuple, texts), key=lambda r: r[0]))


@pytest.mark.parametrize("clash", [False, True])
def test_token_files_round_trip(spark, tokenizer, tmp_path, clash):
    files = token_files.write(frame(spark, EDGE, clash), str(tmp_path / "files"), length=16, rows=3, range_bytes=5000)
    assert len(files.manifest["part"]) > 2
    stored = [files.document(k) for k in range(len(EDGE))]
    keyed = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(EDGE)]
    assert sorted((repr(k), ids.tolist()) for k, ids in stored) == sorted((repr(k), plain_ids(tokenizer, t)) for k, t in keyed)
    keys = [k for k, _ in stored]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    stream = np.concatenate([ids for _, ids in stored])
    masked = [ids[np.asarray(mask)] for ids, mask in map(files.sequence, range(len(files)))]
    assert (np.concatenate(masked) == stream).all()
    mapped = pa.total_allocated_bytes()
    assert all(len(ids) == len(mask) == 16 and not ids.flags.owndata for ids, mask in map(files.sequence, range(len(files))))
    assert pa.total_allocated_bytes() == mapped  # views of the files, not copies
    assert (files.tokens(5, 100) == stream[5:105]).all() and len(files.tokens(5, 0)) == 0
    rows = files.documents(spark).collect()
    starts = np.concatenate(([0], np.cumsum([len(ids) for _, ids in stored])))
    assert sorted((r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows) == [
        (int(a), len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for a, (_, ids) in zip(starts, stored)]
    with pytest.raises(IndexError):
        files.sequence(len(files))
    again = token_files.write(frame(spark, EDGE, clash), str(tmp_path / "files"), length=16, rows=3, range_bytes=5000)  # a repeated job
    assert sorted(map(tuple, again.documents(spark).collect()), key=repr) == sorted(map(tuple, rows), key=repr)


def test_token_files_of_an_empty_table(spark, tmp_path):
    files = token_files.write(frame(spark, []), str(tmp_path / "files"))
    assert len(files) == 0 and files.documents(spark).collect() == []


ODD = ["<|endoftext|> a<|endoftext|>b <|startoftext|>", "it's  THE'S \u0301x \u0308", "a\x01b \x01 c", "ÀÉ×÷ß ÿŸ éÉ9É,é", "Ã\u00a0x Â©", "1234 a1b2,,.c <3 «x»", "e\u0301E\u0301"]


@settings(**SETTINGS)
@given(st.lists(st.text(alphabet="aAbZ1 9,.-é\u0301\u0308ÉÀß×'sΣς\n\tń \u00a0\u2003\u0085\u200bſ漢<|>\x01ÿÞ", max_size=60), min_size=1, max_size=5))
def test_ids_by_unit_are_those_of_whole_texts(texts):
    encoder = token_files.UnitEncoder(public_tokenizers.path("word_bpe_49k.json"), 1)
    texts += ODD
    for _ in range(2):  # the second time all units are known
        ids, sizes = encoder.encode(pa.array(texts))
        plain = [plain_ids(encoder.tokenizer, t) for t in texts]
        assert ids.tolist() == [i for p in plain for i in p] and sizes.tolist() == [len(p) for p in plain]


def test_every_character_in_context(tokenizer):
    encoder = token_files.UnitEncoder(public_tokenizers.path("word_bpe_49k.json"), 1)
    texts = [f"x{c}y {c} 1{c}É{c}" for c in map(chr, [*range(0x0, 0x600), *range(0x2000, 0x2100)])]
    ids, sizes = encoder.encode(pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in plain_ids(tokenizer, t)]


def test_units_of_equal_hash_are_told_apart(monkeypatch, tokenizer):
    texts = ["some words, and more: É1", "other words"]
    encoder = token_files.UnitEncoder(public_tokenizers.path("word_bpe_49k.json"), 1)
    expected = [i for t in texts for i in plain_ids(tokenizer, t)]
    monkeypatch.setattr(token_files.textnum, "word_hashes", lambda data, a, b: np.zeros(len(a), np.uint64))
    assert encoder.encode(pa.array(texts))[0].tolist() == expected
    # One unit a batch: each batch's unit has the hash of the one before.
    for word in ("some", "other", "some"):
        assert encoder.encode(pa.array([word]))[0].tolist() == plain_ids(tokenizer, word)


def test_another_tokenizer_encodes_whole_texts(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = ["two  spaces and 'quotes'", None, "", "É\n\n"]
    files = token_files.write(frame(spark, texts), str(tmp_path / "files"), tokenizer_file=path, end_id=2)
    assert [files.document(k)[1].tolist() for k in range(4)] == [plain.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


# -- whitening -------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<double>"


def plain_whitening(rows, k=32):
    """Covariance and eigenvectors by numpy, exact deviations by whole numbers."""
    x = np.floor(np.array(rows, float) * 64).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total)) for row in x]
    return centred, e[::-1][:k], q[:, ::-1][:, :k], e.sum(), deviation


def check_whitening(got, rows, keys):
    centred, e, q, trace, deviation = plain_whitening(rows)
    by_key = {}
    for r in got:
        by_key.setdefault(r["vec_id"], {})[r["component"]] = r
    assert sorted(by_key) == sorted(keys)
    for i, key in enumerate(keys):
        mine = by_key[key]
        assert sorted(mine) == list(range(1, len(e) + 1))
        assert {r["deviation"] for r in mine.values()} == {deviation[i]} and {r["n"] for r in mine.values()} == {len(rows)}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] <= 1e-9
    np.testing.assert_allclose([by_key[keys[0]][c + 1]["explained"] for c in range(len(e))], e / trace, rtol=1e-9)
    white = np.array([[by_key[key][c + 1]["whitened"] for c in range(len(e))] for key in keys])
    plain = centred @ q / np.sqrt(e)
    signs = np.sign((white * plain).sum(axis=0))
    np.testing.assert_allclose(white * signs, plain, atol=1e-8)


def test_whitening_query_on_real_vectors(spark):
    got = registry.queries()["op13_embedding_whitening"](spark, SMALL)
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"),
                          ("explained", "double"), ("identity_error", "double")]
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    check_whitening(got.collect(), [r["embedding"] for r in rows], [r["vec_id"] for r in rows])


def test_whitening_edge_cases(spark):
    rng = np.random.default_rng(5)
    good = [rng.standard_normal(4).tolist() for _ in range(40)]
    bad = [None, [], [1.0, None, 2.0, 3.0], [1.0, float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0, 0.0], [1.0, 2.0], [1e300, 0.0, 0.0, 0.0]]
    rows = list(enumerate([*good, *bad]))
    df = spark.createDataFrame(rows, VECTORS)
    for c in ("d", "j", "n", "s", "v", "i", "at", "whitened", "deviation", "explained"):
        df = df.selectExpr("*", f"'x' as {c}")
    check_whitening(whitening.by_component(df, whitening.fit(df)).collect(), good, list(range(40)))
    twice = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 5.0])], VECTORS)
    out = whitening.by_component(twice, whitening.fit(twice)).collect()  # two distinct vectors: one direction
    assert sorted((r["vec_id"] or 0, r["component"], r["n"]) for r in out) == [(0, 1, 3), (1, 1, 3), (1, 1, 3)]
    for rows in ([], [(1, None)], [(1, [2.0, 3.0]), (2, [2.0, 3.0])]):  # nothing, nothing usable, no variance
        df = spark.createDataFrame(rows, VECTORS)
        assert whitening.by_component(df, whitening.fit(df)).collect() == []


def test_whitening_of_large_entries_is_exact(spark):
    rows = [[1e9 + 0.5, -3.0], [-1e9, 4.25], [7.0, 1e12], [0.0, 0.0]]
    df = spark.createDataFrame(list(enumerate(rows)), VECTORS)
    model = whitening.fit(df)
    x = [[math.floor(64 * c) + 1_000_000 for c in r] for r in rows]
    sums = [sum(c) for c in zip(*x)]
    assert list(model.sums) == sums
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.transform(df, model).collect()}
    assert got == {i: sum((4 * a - s) ** 2 for a, s in zip(r, sums)) for i, r in enumerate(x)}


@pytest.mark.parametrize("spectrum", ["random", "three values", "low rank", "one outlier", "equal"])
@pytest.mark.parametrize("m", [1, 2, 5, 33, 64])
def test_spectral_splitting(m, spectrum):
    rng = np.random.default_rng(m)
    values = {"random": rng.random(m) + 0.1, "three values": np.resize([3.0, 1.0, 2.0], m), "low rank": np.where(np.arange(m) <= m // 2, 1 + rng.random(m), 0),
              "one outlier": np.append(1e5, rng.random(m - 1)), "equal": np.full(m, 2.5)}[spectrum]
    q = np.linalg.qr(rng.standard_normal((m, m)))[0]
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    e, x = whitening.spectral(v, 32)
    np.testing.assert_allclose(e, np.sort(values)[::-1][:32], atol=1e-13 * values.max() * m)
    np.testing.assert_allclose(x.T @ x, np.eye(len(e)), atol=1e-12)
    assert np.linalg.norm(v @ x - x * e) <= 1e-12 * np.linalg.norm(v)


def test_polar_factor():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    e, q = np.linalg.eigh(a)
    np.testing.assert_allclose(whitening.sign_factor(a), (q * np.sign(e)) @ q.T, atol=1e-11)
