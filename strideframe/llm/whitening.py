"""Whitening of embeddings by a covariance that is put together from variances only.

1. Entries c become whole numbers floor(scale * c) + offset; vectors are packed to bytes as narrow as their entries allow, so that equal
   vectors have equal bytes. The fit list is every distinct vector once.
2. One pass sums each dimension: n, S. A second pass centres the vectors at the whole numbers nearest to the means and sums, for each
   dimension and for each sum of two dimensions, the centred values and their squares: d + d (d - 1) / 2 quantities, exact in whole
   numbers; a task adds up its own rows, and only its sums are shuffled.
3. What lies between that centre and the mean (less than one) is taken out of these sums exactly: n^2 var = n sum(u^2) - sum(u)^2. By
   polarisation cov(i, j) = (var(i + j) - var(i) - var(j)) / 2, again in whole numbers, rounded once. eigh of this matrix gives the
   components, numbered by falling eigenvalue, of which at most max_components are returned.
4. Rows are projected where they are; a further pass over the fit list measures the covariance of the whitened values.

Null vectors, and those with null, NaN or infinite entries, are dropped, and so are vectors of another length than the most common one (of
equally common ones the shortest) and vectors with an entry beyond 2^50 once scaled, where the whole numbers would not be exact. Components
whose eigenvalue is not above 1e-12 of the largest (constant or dependent dimensions) can't be whitened and are left out, so less than two
distinct vectors give no rows. Repeated rows and null ids are rows like others. A deviation that no 64-bit integer holds is null. Empty tables
give empty results. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release

LIMIT = 2.0**50
#: Cells of the rows x pairs block that a task computes at a time.
CELLS = 1 << 21


class Whitening(NamedTuple):
    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float


def _packed(matrix: np.ndarray) -> list[bytes]:
    """Rows of whole numbers as bytes: the width, and entries of that many bytes."""
    low, high = matrix.min(1), matrix.max(1)
    width = np.select([(low >= -(2 ** (8 * w - 1))) & (high < 2 ** (8 * w - 1)) for w in (2, 4)], [2, 4], 8)
    return [bytes([w]) + row.astype(f"<i{w}").tobytes() for w, row in zip(width, matrix, strict=True)]


def unpacked(vectors: pa.Array) -> np.ndarray:
    """A matrix of whole numbers, without the offset."""
    return np.stack([np.frombuffer(v[1:], f"<i{v[0]}").astype(np.int64) for v in vectors.to_pylist()]) if len(vectors) else np.empty((0, 0), np.int64)


def whole_vectors(df: DataFrame, *, vector: str = "embedding", key: str = "vec_id", scale: float = 64.0) -> DataFrame:
    """The key and x, the packed floor(scale * entry), of all vectors that can be used."""
    v = F.col(vector).cast("array<double>")
    usable = F.col(vector).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(F.abs(c * scale) < LIMIT, F.lit(False)))
    rows = df.where(usable).select(F.col(key).alias("key"), v.alias("v"))
    lengths = rows.groupBy(F.size("v").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length").first()
    rows = rows.where(F.size("v") == (lengths["length"] if lengths else 0))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = b["v"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b["key"], pa.array(_packed(np.floor(d * scale).astype(np.int64)), pa.binary())], ["key", "x"])

    kind = df.schema[key].dataType.simpleString()
    return rows.mapInArrow(pack, f"key {kind}, x binary")


def _exact(values: np.ndarray, power: int) -> list[int]:
    """Exact column sums of values ** power."""
    top = int(np.abs(values).max(initial=0)) ** power * len(values)
    if top >= 2**62:
        values = values.astype(object)
    return [int(s) for s in (values**power).sum(0)]


def pair_sums(u: np.ndarray) -> np.ndarray:
    """Columns of u, and after them the sums of every two of them."""
    i, j = np.triu_indices(u.shape[1], 1)
    return np.hstack([u, u[:, i] + u[:, j]])


def _totals(fit: DataFrame, of, columns: int) -> DataFrame:
    """Over all rows of fit, by place: the exact sums of the values and squares that of(matrix) gives."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, rows = [0] * columns, [0] * columns, 0
        for b in batches:
            step = max(1, CELLS // max(1, columns))
            for at in range(0, b.num_rows, step):
                q = of(unpacked(b["x"].slice(at, step)))
                first = [x + y for x, y in zip(first, _exact(q, 1), strict=True)]
                second = [x + y for x, y in zip(second, _exact(q, 2), strict=True)]
            rows += b.num_rows
        if rows:
            text = lambda v: pa.array([str(x) for x in v])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(columns)), text(first), text(second), pa.array(np.full(columns, rows))], ["at", "first", "second", "rows"])

    sums = fit.mapInArrow(partial, "at long, first string, second string, rows long")
    whole = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("first", "second")]
    return sums.groupBy("at").agg(*whole, F.sum("rows").alias("rows")).orderBy("at")


def _assembled(first: list[int], second: list[int], n: int, d: int) -> np.ndarray:
    """The covariance matrix from sums of values and squares of d columns and their pair sums."""
    scaled = [n * q - s * s for s, q in zip(first, second, strict=True)]  # n^2 times the variances
    cov = np.zeros((d, d))
    for i in range(d):
        cov[i, i] = scaled[i] / (n * n)
    for at, (i, j) in enumerate(zip(*np.triu_indices(d, 1), strict=True), d):
        cov[i, j] = cov[j, i] = (scaled[at] - scaled[i] - scaled[j]) / (2 * n * n)
    return cov


def fit_whitening(fit: DataFrame, *, max_components: int = 16) -> Whitening | None:
    """The whitening of the distinct packed vectors of fit (x, made by cut()); None without any."""
    one = fit.first()
    if one is None:
        return None
    d = (len(one.x) - 1) // one.x[0]
    dims = _totals(fit, lambda x: x, d).collect()
    n, sums = dims[0]["rows"], [int(r["first"]) for r in dims]
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    quantities = _totals(fit, lambda x: pair_sums(x - centre), d + d * (d - 1) // 2).collect()
    cov = _assembled([int(r["first"]) for r in quantities], [int(r["second"]) for r in quantities], n, d)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:max_components]
    order = order[values[order] > 1e-12 * max(values.max(), 0)]
    values, vectors = values[order], vectors[:, order]
    model = Whitening(n, sums, vectors, values, float(np.trace(cov)), 0.0)
    return model._replace(identity_error=_identity_error(fit, model))


def whitened(x: np.ndarray, model: Whitening) -> np.ndarray:
    whole = np.array([s // model.n for s in model.sums], np.int64)
    part = np.array([s % model.n / model.n for s in model.sums])
    return ((x - whole) - part) @ model.components / np.sqrt(model.eigenvalues)


def _identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = len(model.eigenvalues)
    if not k:
        return 0.0

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((k + 1, k + 1)), 0
        for b in batches:
            for at in range(0, b.num_rows, 8192):
                z = whitened(unpacked(b["x"].slice(at, 8192)), model)
                z = np.hstack([z, np.ones((len(z), 1))])
                total += z.T @ z
            rows += b.num_rows
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange((k + 1) ** 2)), pa.array(total.ravel())], ["at", "value"])

    got = fit.mapInArrow(partial, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").collect()
    moments = np.array([r["value"] for r in got]).reshape(k + 1, k + 1) / model.n
    return float(np.abs(moments[:k, :k] - np.outer(moments[k, :k], moments[k, :k]) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Of each row the exact sum over dimensions of (n * x - S)^2."""
    whole = np.array([s // n for s in sums], np.int64)
    u = x - whole
    rest = np.array([s % n for s in sums], object)
    top = int(np.abs(u).max(initial=0)) + 1
    if (n * top) ** 2 * x.shape[1] < 2**62:
        return ((n * u - rest.astype(np.int64)) ** 2).sum(1).tolist()
    return ((n * u.astype(object) - rest) ** 2).sum(1).tolist()


def whiten(df: DataFrame, *, vector: str = "embedding", key: str = "vec_id", scale: float = 64.0, offset: int = 1_000_000, max_components: int = 16) -> tuple[DataFrame, Whitening | None]:
    """A row for each usable vector of df and component: key, component, n, deviation, whitened, explained and identity_error; and the fitted model, whose sums include the offset."""
    kind = df.schema[key].dataType.simpleString()
    out = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = whole_vectors(df, vector=vector, key=key, scale=scale)
    fit = cut(rows.select("x").distinct())
    model = fit_whitening(fit, max_components=max_components)
    release(fit)
    if model is None or not len(model.eigenvalues):
        return df.sparkSession.createDataFrame([], out), model
    k, explained = len(model.eigenvalues), model.eigenvalues / model.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                x = unpacked(b["x"].slice(at, 4096))
                m, z = len(x), whitened(x, model)
                far = [v if v < 2**63 else None for v in deviations(x, model.n, model.sums)]
                take = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [b["key"].slice(at, 4096).take(pa.array(take)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), pa.array(far, pa.int64()).take(pa.array(take)), pa.array(z.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, model.identity_error))],
                    [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(project, out), model._replace(sums=[s + model.n * offset for s in model.sums])
