"""Whitening of embeddings: vectors become coordinates along the leading principal components, with unit variance.

A vector's entries, as doubles, become the integers floor(scale * c). The fit list holds each distinct integer vector once. Its sums are
exact; its covariance (divisor n) is summed from centred vectors: each partition adds up its own matrix in blocks, Spark adds the entries up by
place, and only the dim x dim result comes to the driver, where max_dim bounds it. There a Householder reduction makes it tridiagonal, Sturm counts
bisect the leading eigenvalues, and inverse iteration, made orthogonal to the earlier vectors of a cluster of near eigenvalues, gives the
components. The projection is broadcast: max_dim x components numbers.

Defined results: vectors that are null, empty or hold a null, NaN or infinite entry are dropped, and so are those of another dimension than most vectors
have (of equal counts the greater dimension). Repeated rows give repeated results; copies count once in fitting. Components without variance
beyond rounding can't be whitened and are left out, so a table of equal vectors gives none. An empty table gives an empty result. Of a component's two
signs the one with its largest entry positive is taken. Other columns are kept; columns named deviation or whitened are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import stored

EPS = float(np.finfo(float).eps)
SAFE = 2**62


@dataclass
class Model:
    scale: float
    dim: int
    n: int = 0
    sums: list[int] = field(default_factory=list)  # exact
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))  # eigenvalues, falling
    components: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # a row each
    explained: list[float] = field(default_factory=list)
    identity_error: float | None = None

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: long where it fits, else Python integers."""
        most = int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        if most < SAFE:
            return x * self.n - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.apart(x).astype(float) / self.n

    def deviation(self, x: np.ndarray) -> list[int]:
        z = self.apart(x)
        if z.dtype != object and int(np.abs(z).max(initial=0)) ** 2 * max(1, self.dim) < SAFE:
            return (z * z).sum(axis=1).tolist()
        z = z.astype(object)
        return [int(v) for v in (z * z).sum(axis=1)]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.values)[:, None]).T


def integers(vector: Column, scale: float) -> Column:
    return F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))


def usable(vector: Column) -> Column:
    """Whether a vector has entries and all of them are finite numbers."""
    finite = F.forall(vector, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _added(rows: DataFrame, dim: int, size: tuple[int, int], part: Callable[[np.ndarray], np.ndarray], kind: T.DataType) -> DataFrame:
    """i, j, v: the sum over all blocks of vectors of what part makes of each, entry by entry. A partition adds up its own first."""
    exact = isinstance(kind, T.DecimalType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                here = part(_matrix(batch.column("x"), dim))
                total = here if total is None else total + here
        if total is not None:
            i, j = np.indices(size).reshape(2, -1).astype(np.int32)
            flat = total.reshape(-1)
            v = pa.array([int(a) for a in flat]).cast(pa.decimal128(38, 0)) if exact else pa.array(flat.astype(float))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), v], names=["i", "j", "v"])

    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("v", kind)])
    return rows.select("x").mapInArrow(run, schema).groupBy("i", "j").agg(F.sum("v").alias("v"))


def _collected(added: DataFrame, size: tuple[int, int], kind) -> np.ndarray:
    out = np.zeros(size, dtype=kind)
    for r in added.collect():  # as many rows as the matrix has entries
        out[r.i, r.j] = int(r.v) if kind is object else r.v
    return out


def exact_sums(x: np.ndarray) -> np.ndarray:
    if int(np.abs(x).max(initial=0)) * len(x) < SAFE:
        return x.sum(axis=0).astype(object)[None, :]
    return x.astype(object).sum(axis=0)[None, :]


# -- eigenvectors of a small symmetric matrix --------------------------------------------------------------------------
def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and the orthogonal q with q.T @ a @ q tridiagonal, by Householder reflections."""
    a, n = np.array(a, dtype=float), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if length <= abs(v[0]):  # nothing below the off-diagonal
            continue
        v[0] += np.copysign(length, v[0])
        v /= np.linalg.norm(v)
        lower = a[k + 1 :, k + 1 :]
        p = lower @ v
        w = p - (v @ p) * v
        lower -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1, k] = -np.copysign(length, a[k + 1, k])
        a[k + 2 :, k] = 0
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def below(diagonal: list[float], squares: list[float], x: float, tiny: float) -> int:
    """How many eigenvalues lie below x: the negative terms of the Sturm sequence of the tridiagonal matrix."""
    count, t = 0, 1.0
    for d, s in zip(diagonal, [0.0, *squares], strict=True):
        t = d - x - s / t
        if abs(t) < tiny:
            t = -tiny
        count += t < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> list[float]:
    """The k largest eigenvalues, falling, by bisection."""
    n, d, s = len(diagonal), diagonal.tolist(), (off * off).tolist()
    reach = np.append(0, np.abs(off)) + np.append(np.abs(off), 0)
    low, high = float((diagonal - reach).min()), float((diagonal + reach).max())
    size = max(abs(low), abs(high))
    tiny, out = EPS * EPS * size, []
    for i in range(min(k, n)):
        a, b = low - EPS * size, (out[-1] if out else high) + 2 * EPS * size
        while b - a > 2 * EPS * max(abs(a), abs(b)) + tiny:
            middle = (a + b) / 2
            if middle in (a, b):
                break
            if n - below(d, s, middle, tiny) > i:  # more than i eigenvalues are at middle or above
                a = middle
            else:
                b = middle
        out.append((a + b) / 2)
    return out


def solved(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """(T - shift) x = b for tridiagonal T, by elimination with row exchanges; a vanishing pivot is replaced by tiny."""
    n = len(diagonal)
    d, up, up2, low, x = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * n, off.tolist(), b.tolist()
    for i in range(n - 1):
        if abs(low[i]) > abs(d[i]):
            d[i], low[i] = low[i], d[i]
            up[i], d[i + 1] = d[i + 1], up[i]
            up2[i], up[i + 1] = up[i + 1], 0.0
            x[i], x[i + 1] = x[i + 1], x[i]
        if abs(d[i]) < tiny:
            d[i] = tiny
        f = low[i] / d[i]
        d[i + 1] -= f * up[i]
        up[i + 1] -= f * up2[i]
        x[i + 1] -= f * x[i]
    if abs(d[-1]) < tiny:
        d[-1] = tiny
    for i in range(n - 1, -1, -1):
        if i + 1 < n:
            x[i] -= up[i] * x[i + 1]
        if i + 2 < n:
            x[i] -= up2[i] * x[i + 2]
        x[i] /= d[i]
    return np.array(x)


def leading(a: np.ndarray, k: int, cluster: float = 1e-3, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and their unit eigenvectors (rows) of a symmetric matrix."""
    largest = float(np.abs(a).max(initial=0))
    if not largest:
        return np.zeros(min(k, len(a))), np.eye(len(a))[:k]
    diagonal, off, q = tridiagonal(a / largest)
    values = leading_values(diagonal, off, k)
    size = max(float(np.abs(diagonal).max(initial=0)), float(np.abs(off).max(initial=0)))
    rng, vectors, start = np.random.default_rng(7), [], 0
    for i, value in enumerate(values):
        if i and values[i - 1] - value > cluster * size:
            start = i
        z = rng.standard_normal(len(diagonal))
        for _ in range(rounds):
            z = solved(diagonal, off, value, z / np.linalg.norm(z), EPS * size)
            for _ in (0, 1):  # twice is enough
                for other in vectors[start:]:
                    z -= (other @ z) * other
        vectors.append(z / np.linalg.norm(z))
    out = np.array([q @ z for z in vectors]).reshape(len(values), len(a))
    for v in out:
        v /= np.linalg.norm(v) * np.copysign(1.0, v[np.abs(v).argmax()])
    return largest * np.array(values), out


# -- the operator ------------------------------------------------------------------------------------------------------
def fit(rows: DataFrame, vector: str = "embedding", components: int = 4, scale: float = 256, max_dim: int = 2048) -> Model:
    good = rows.select(F.col(vector).alias("v")).where(usable(F.col("v")))
    most = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("d").desc()).first()
    if most is None:
        return Model(scale, 0)
    if most.d > max_dim:
        raise ValueError(f"vectors of {most.d} entries; at most {max_dim} are taken")
    dim, model = most.d, Model(scale, most.d)
    fit_list = stored(good.where(F.size("v") == dim).select(integers(F.col("v"), scale).alias("x")).distinct(), "fit-list")
    model.n = fit_list.count()
    model.sums = _collected(_added(fit_list, dim, (1, dim), exact_sums, T.DecimalType(38, 0)), (1, dim), object)[0].tolist()
    covariance = _collected(_added(fit_list, dim, (dim, dim), lambda x: (y := model.centred(x)).T @ y, T.DoubleType()), (dim, dim), float) / model.n
    covariance, trace = (covariance + covariance.T) / 2, float(np.trace(covariance))
    values, vectors = leading(covariance, min(components, dim))
    real = values > dim * EPS * max(trace, 0.0)
    model.values, model.components = values[real], vectors[real]
    model.explained = [float(v) / trace for v in model.values]
    k = len(model.values)
    if k:  # the whitened fit list is centred: its vectors are, exactly
        spread = _collected(_added(fit_list, dim, (k, k), lambda x: (w := model.whitened(x)).T @ w, T.DoubleType()), (k, k), float) / model.n
        model.identity_error = float(np.abs(spread - np.eye(k)).max())
    return model


def whiten(rows: DataFrame, model: Model, vector: str = "embedding") -> DataFrame:
    """The usable rows with deviation (decimal: the sum of (n * x - sums)^2) and whitened (array of double, as many as components)."""
    names = ["deviation", "whitened"]
    rows = rows.drop(*names).where(usable(F.col(vector)) & (F.size(vector) == model.dim))
    schema = T.StructType([*rows.schema.fields, T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    sent, x, dim = rows.sparkSession.sparkContext.broadcast(model), "_whitening_x", model.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            m = _matrix(batch.column(x), dim) if batch.num_rows else np.zeros((0, dim), dtype=np.int64)
            w = model.whitened(m)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.reshape(-1)))
            far = pa.array(model.deviation(m), type=pa.decimal128(38, 0))
            keep = [c for c in batch.schema.names if c != x]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), far, lists], names=[*keep, *names])

    return rows.withColumn(x, integers(F.col(vector), model.scale)).mapInArrow(run, schema)
