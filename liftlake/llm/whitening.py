"""Whitening of embeddings by spectral divide and conquer.

Entries become whole numbers, so counts, sums and products of centred entries are
exact: every order of tasks, and every repeated one, gives the same covariance.
Its eigenvectors come from polar decompositions (QDWH): the polar factor of the
covariance less a shift is a matrix sign, hence the projector on the subspace of
the eigenvalues above the shift. The subspace is split again and again until
single components are left. The matrix has the square of a vector's length,
whatever the number of rows; the components are broadcast to a scan of the rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
SCALE = 64
SHIFT = 1_000_000
# Longest vectors: the covariance of the fit is this many numbers squared on the driver.
MAX_DIMENSION = 2048
# An entry whose whole number a double can't hold exactly counts as not finite.
LARGEST = 2.0 ** 53
# Variance below this share of the largest one is rounding: there is no direction to whiten.
NO_VARIANCE = 1e-12
# Rows worked on at a time.
ROWS = 4096
# Partial covariances per core that a fit adds up.
PARTIALS = 4


# -- polar decomposition and splitting -----------------------------------------------


def sign_factor(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by dynamically weighted Halley steps in QR form."""
    m = len(a)
    norm = np.linalg.norm(a)
    x, low, eye = a / norm, np.finfo(float).eps, np.eye(m)
    for _ in range(12):
        d = np.cbrt(4 * (1 - low * low) / low ** 4)
        root = np.sqrt(1 + d)
        p = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low * low) / (low * low * root))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        factor = np.linalg.qr(np.vstack((np.sqrt(r) * x, eye)))[0]
        new = q / r * x + (p - q / r) / np.sqrt(r) * (factor[:m] @ factor[m:].T)
        new = (new + new.T) / 2
        low = min(low * (p + q * low * low) / (1 + r * low * low), 1.0)
        moved = np.linalg.norm(new - x)
        x = new
        if 1 - low < 1e-15 and moved < 1e-8 * np.sqrt(m):
            break
    return x


def _shifts(a: np.ndarray):
    """Where to cut a spectrum: the median of the diagonal, its mean, then points around the mean."""
    diagonal = np.diag(a)
    mean = diagonal.mean()
    spread = np.linalg.norm(a - mean * np.eye(len(a))) / np.sqrt(len(a))
    yield np.median(diagonal)
    for k in (0, 0.13, -0.13, 0.29, -0.29, 0.53, -0.53, 0.79, -0.79):
        yield mean + k * spread


def _cut(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the subspaces above and below a shift, both not empty."""
    m = len(a)
    rng = np.random.default_rng(m)
    for shift in _shifts(a):
        moved = a - shift * np.eye(m)
        if not np.linalg.norm(moved):
            continue
        above = (sign_factor(moved) + np.eye(m)) / 2
        k = int(round(np.trace(above)))
        if not 0 < k < m or np.linalg.norm(above @ above - above) > 1e-9 * m:
            continue
        part = np.linalg.qr(above @ rng.standard_normal((m, k)))[0]
        for _ in range(2):
            part = np.linalg.qr(above @ part)[0]
        whole = np.linalg.qr(part, mode="complete")[0]
        upper, lower = whole[:, :k], whole[:, k:]
        if np.linalg.norm(lower.T @ a @ upper) <= 1e-11 * np.linalg.norm(a):
            return upper, lower
    raise ArithmeticError("no shift separates the spectrum")


def spectral(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    Subspaces wait on a stack, the one with the larger eigenvalues on top; once
    enough components are found, what lies below is not split any more. Equal
    eigenvalues give any basis of their subspace.
    """
    noise = 1e-14 * len(v) * max(np.linalg.norm(v), np.finfo(float).tiny)
    found, stack = [], [np.eye(len(v))]
    while stack and len(found) < wanted:
        basis = stack.pop()
        a = basis.T @ v @ basis
        a = (a + a.T) / 2
        if np.linalg.norm(a - np.diag(np.diag(a))) <= noise:
            found.extend(basis[:, k] for k in np.argsort(-np.diag(a), kind="stable"))
            continue
        upper, lower = _cut(a)
        stack += [basis @ lower, basis @ upper]
    vectors = np.linalg.qr(np.array(found[:wanted]).T.reshape(len(v), -1))[0]
    values = np.einsum("ij,ik,kj->j", vectors, v, vectors, optimize=True)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    largest = np.abs(vectors).argmax(axis=0) if vectors.size else np.zeros(0, int)
    return values[order], vectors * np.where(vectors[largest, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


# -- sums over the rows ------------------------------------------------------------------


def _matrix(column: pa.Array, dimension: int | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of finite vectors, by vector length (or of one length alone): row numbers and ``floor(SCALE * c)``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    out = []
    for d in np.unique(lengths) if dimension is None else [dimension]:
        rows = np.flatnonzero(lengths == d)
        if not d or not len(rows):
            continue
        values = flat[starts[rows][:, None] + np.arange(d)]
        with np.errstate(over="ignore", invalid="ignore"):
            whole = np.floor(values * SCALE)
            good = (np.abs(whole) < LARGEST).all(axis=1)  # false for null, NaN and infinity as well
        if good.any():
            out.append((rows[good], whole[good].astype(np.int64)))
    return out


def _pieces(batches, dimension=None):
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            for rows, whole in _matrix(part.column(part.num_columns - 1), dimension):
                yield part, rows, whole


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def _sums(batches):
    """Per vector length met: entry number, rows and sum of the whole numbers."""
    totals: dict[int, list] = {}
    for _, _, whole in _pieces(batches):
        held = totals.setdefault(whole.shape[1], [0, 0])
        held[0] += len(whole)
        few = np.abs(whole).max() <= 1 << 48  # the sum of a part then fits a 64-bit number
        held[1] = held[1] + (whole.sum(axis=0).astype(object) if few else whole.astype(object).sum(axis=0))
    for d, (n, sums) in totals.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n, np.int64)),
             _decimals(sums)], ["d", "j", "n", "s"])


def _products(centre: np.ndarray):
    """Sums of products of entries less a whole centre, exact; the upper triangle."""
    d = len(centre)
    upper = np.triu_indices(d)

    def emit(total):
        return pa.RecordBatch.from_arrays([pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)),
                                           _decimals(total[upper])], ["i", "j", "s"])

    def run(batches):
        total, bound, any_row = np.zeros((d, d)), 0, False
        for _, _, whole in _pieces(batches, d):
            y = whole - centre
            most = np.abs(y).max(axis=1)
            # Products of small entries add up exactly as doubles; rows with a large one take whole numbers without limit.
            small = most < 1 << 20
            for row in y[~small].astype(object):
                yield emit(np.outer(row, row))
            y = y[small]
            if not len(y):
                continue
            any_row = True
            weight = len(y) * int(most[small].max()) ** 2
            if bound + weight >= 1 << 53:
                yield emit(total)
                total, bound = np.zeros((d, d)), 0
            f = y.astype(float)
            total += f.T @ f
            bound += weight
        if any_row:
            yield emit(total)

    return run


@dataclass(frozen=True)
class Model:
    """What a fit leaves: rows, exact sums, eigenvalues and components (as columns), trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.values]


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Model | None:
    """Mean and leading components of the floored, scaled vectors; None without a usable vector.

    Two scans: counts and sums, then products of entries centred on the whole
    number nearest to their mean (what is left of the mean is taken off exactly).
    Vectors of another length than the commonest (of equally common ones, the
    longest) don't take part, nor do empty ones.
    """
    spark = vectors.sparkSession
    picked = vectors.select(F.col(vector_col).cast("array<double>").alias("v"))
    picked = picked.coalesce(PARTIALS * spark.sparkContext.defaultParallelism)
    sums = picked.mapInArrow(_sums, "d int, j int, n bigint, s decimal(38,0)")
    rows = sums.groupBy("d", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s")) \
        .orderBy(F.desc("n"), F.desc("d"), "j").limit(MAX_DIMENSION + 1).collect()
    if not rows:
        return None
    d, n = rows[0]["d"], rows[0]["n"]
    if d > MAX_DIMENSION:
        raise ValueError(f"vectors of {d} entries; at most {MAX_DIMENSION} are supported")
    sums = [int(r["s"]) for r in rows[:d]]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    products = picked.mapInArrow(_products(np.array(centre, np.int64)), "i int, j int, s decimal(38,0)")
    rest = [s - n * c for s, c in zip(sums, centre)]
    v = np.zeros((d, d))
    for r in products.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # d (d + 1) / 2 rows
        i, j = r["i"], r["j"]
        v[i, j] = v[j, i] = (n * int(r["s"]) - rest[i] * rest[j]) / (n * n)  # whole numbers, rounded once
    values, basis = spectral(v, min(components, d))
    real = values > NO_VARIANCE * max(values[0], 0.0)
    return Model(n, tuple(s + n * SHIFT for s in sums), values[real], basis[:, real], float(np.trace(v)))


def _whiteners(model: Model):
    """Function of whole numbers (without the shift): whitened rows, and exact squared deviations."""
    n = model.n
    means = [s - n * SHIFT for s in model.sums]
    centre = np.array([m // n for m in means], np.int64)
    part = np.array([m % n / n for m in means])
    left = [m % n for m in means]
    turn = model.vectors / np.sqrt(model.values)

    def run(whole):
        y = whole - centre
        most = int(np.abs(y).max(initial=0)) + 1
        exact = np.int64 if len(centre) * (n * most) ** 2 < 1 << 63 else object
        far = n * y.astype(exact) - np.array(left, exact)
        return (y - part) @ turn, (far * far).sum(axis=1)

    return run


def transform(vectors: DataFrame, model: Model | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector: vec_id, whitened (array, by component), deviation (decimal, exact).

    ``deviation`` is the sum over entries of ``(n * x - S)^2``. Rows whose vector
    is null, empty, of another length than the fit's, or holds a null, a non-finite
    entry or one beyond 2^53 / 64 are left out. A null id stays null; repeated rows
    and repeated ids are rows of their own; other columns are not read. Directions
    without variance have no component: equal vectors give empty arrays. Without a
    model (an empty table, no usable vector) the result is empty.
    """
    def run(batches):
        whiten = _whiteners(model)
        for part, rows, whole in _pieces(batches, len(model.sums)):
            white, far = whiten(whole)
            offsets = np.arange(len(rows) + 1, dtype=np.int32) * white.shape[1]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(rows)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(white.ravel())),
                 pa.array(far).cast(pa.decimal128(38, 0)) if far.dtype != object else _decimals(far)],
                ["vec_id", "whitened", "deviation"])

    schema = "vec_id bigint, whitened array<double>, deviation decimal(38,0)"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    return vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, schema)


def identity_error(vectors: DataFrame, model: Model | None, vector_col: str = "embedding") -> float | None:
    """Largest absolute entry of the whitened rows' covariance less the identity; None without components."""
    if model is None or not len(model.values):
        return None
    k = len(model.values)

    def run(batches):
        whiten = _whiteners(model)
        total = np.zeros((k + 1, k))
        for _, _, whole in _pieces(batches, len(model.sums)):
            white = whiten(whole)[0]
            total[:k] += white.T @ white
            total[k] += white.sum(axis=0)
        at = np.indices(total.shape, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at[0].ravel()), pa.array(at[1].ravel()), pa.array(total.ravel())], ["i", "j", "s"])

    picked = vectors.select(F.col(vector_col).cast("array<double>").alias("v")) \
        .coalesce(PARTIALS * vectors.sparkSession.sparkContext.defaultParallelism)
    total = np.zeros((k + 1, k))
    for r in picked.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        total[r["i"], r["j"]] = r["s"] / model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def by_component(vectors: DataFrame, model: Model | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``transform`` with a row per vector and component, and the fit's figures beside it.

    ``deviation`` is null where it exceeds a 64-bit number; ``transform`` has it whole.
    """
    error = identity_error(vectors, model, vector_col)
    explained = F.array(*(F.lit(e) for e in (model.explained if model else []))).cast("array<double>")
    rows = transform(vectors, model, id_col, vector_col).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("bigint").alias("n"),
        F.expr("try_cast(deviation as bigint)").alias("deviation"), "whitened", F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"))
