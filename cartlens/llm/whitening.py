"""Embedding whitening with a covariance recovered by polarisation.

1. The fit list is each distinct integer vector once: a hot vector is one row
   after the map-side half of the distinct.  It is written to the shared
   folder, as three jobs read it.
2. ``n`` and the sums ``S`` of every dimension.
3. With ``c = n*x - S``, the exact sums of ``c_i^2`` for every dimension and of
   ``(c_i + c_j)^2`` for every pair of dimensions.  They are scaled variances,
   and by polarisation ``2 * cov(i, j) = var(i + j) - var(i) - var(j)``; the
   differences are taken on whole numbers, so nothing cancels.
4. The covariance goes to ``eigh`` on the driver (dimensions squared, however
   many rows there are); rows are projected where they lie.

Sums are Python integers in the tasks and ``decimal(38, 0)`` between them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm.common import map_arrow, slices
from cartlens.llm.vectors import matrix, scaled, usable, usual_length
from cartlens.runtime import scratch_folder

#: Components from here on count as not finite, so that integers stay below 2^47.
LIMIT = 1 << 40
# Rows squared at a time; with LIMB bits a limb, sums of limb products fit in 64 bits.
ROWS, LIMB = 4096, 24

WHOLE = pa.decimal128(38, 0)
NAMES = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
TYPES = ["long", "int", "long", "decimal(38,0)", "double", "double", "double"]
OUT = ", ".join(f"{name} {kind}" for name, kind in zip(NAMES, TYPES))


@dataclass
class Whitening:
    """A fitted transform; all arrays are bounded by the dimensions."""

    n: int                    # vectors in the fit list
    sums: list[int]           # S
    directions: np.ndarray    # dimensions x components, unit columns
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float
    scale: int
    offset: int


def integer_vectors(rows: DataFrame, vector_col: str, scale: int, offset: int, *ids: Column) -> DataFrame:
    """(ids..., x) of the rows that take part."""
    some = rows.select(*[c.alias(f"_{i}") for i, c in enumerate(ids)], F.col(vector_col).alias("_v"))
    return (some.where(usable(F.col("_v"), LIMIT))
                .select(*[f"_{i}" for i in range(len(ids))], scaled(F.col("_v"), scale, offset).alias("x")))


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n*x - S``, exactly: 64-bit integers where two of them can be added and
    cut into two limbs, Python integers beyond."""
    mean = [s // n for s in sums]
    rest = [s - n * m for s, m in zip(sums, mean)]
    y = x - np.array(mean, np.int64)
    if (int(np.abs(y).max(initial=0)) + 1) * n < 1 << 2 * LIMB - 2:
        return y * n - np.array(rest, np.int64)
    return y.astype(object) * n - np.array(rest, object)


def squares(c: np.ndarray, axis: int) -> list[int]:
    """Exact sums of squares along an axis of at most ``2^14`` numbers."""
    if c.dtype == object:
        return [int(v) for v in (c * c).sum(axis=axis)]
    spec = "ij,ij->j" if axis == 0 else "ij,ij->i"
    most = int(np.abs(c).max(initial=0))
    if most * most * c.shape[axis] < 1 << 62:
        return np.einsum(spec, c, c).tolist()
    high, low = c >> LIMB, c & ((1 << LIMB) - 1)
    parts = zip(np.einsum(spec, high, high).tolist(), np.einsum(spec, high, low).tolist(), np.einsum(spec, low, low).tolist())
    return [(hh << 2 * LIMB) + (hl << LIMB + 1) + ll for hh, hl, ll in parts]


def polarised(c: np.ndarray) -> list[int]:
    """Exact sums over the rows of ``c_i^2``, then of ``(c_i + c_j)^2`` for i < j."""
    out = squares(c, 0)
    for i in range(c.shape[1] - 1):
        out += squares(c[:, i:i + 1] + c[:, i + 1:], 0)
    return out


def covariance(n: int, d: int, sums: list[int]) -> np.ndarray:
    """The covariance of x (divisor n) from ``polarised`` sums over the fit list."""
    own, at, out = sums[:d], d, np.zeros((d, d))
    for i in range(d):
        out[i, i] = own[i] / n ** 3
        for j in range(i + 1, d):
            out[i, j] = out[j, i] = (sums[at] - own[i] - own[j]) / (2 * n ** 3)
            at += 1
    return out


def _summed(fit_list: DataFrame, d: int, size: int, function: Callable[[np.ndarray], list[int]]) -> list[int]:
    """The sums of ``function`` over blocks of the fit list: ``size`` integers.
    A task sends one row per sum, and so does the aggregate to the driver."""
    def run(batches):
        total = [0] * size
        for batch in slices(batches, ROWS):
            total = [a + b for a, b in zip(total, function(matrix(batch.column("x"), d)))]
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([Decimal(v) for v in total], WHOLE)],
                                         names=["at", "v"])

    sums = map_arrow(fit_list, run, "at int, v decimal(38,0)").groupBy("at").agg(F.sum("v").alias("v"))
    out = [0] * size
    for row in sums.collect():
        out[row["at"]] = int(row["v"])
    return out


def _identity_error(fit_list: DataFrame, d: int, project: Callable[[np.ndarray], np.ndarray], k: int, n: int) -> float:
    """The largest entry of the whitened fit list's covariance minus the identity.
    Tasks send means and centred sums of products, which are then joined."""
    def run(batches):
        count, mean, moment = 0, np.zeros(k), np.zeros((k, k))
        for batch in slices(batches, ROWS):
            w = project(matrix(batch.column("x"), d))
            m = w.mean(axis=0)
            gap, total = m - mean, count + len(w)
            moment += (w - m).T @ (w - m) + np.outer(gap, gap) * (count * len(w) / total)
            mean, count = mean + gap * (len(w) / total), total
        i, j = np.divmod(np.arange(k * k), k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k * k), pa.int32()), pa.array(np.full(k * k, count)), pa.array(mean[i]), pa.array(mean[j]),
             pa.array(moment.ravel())], names=["at", "n", "a", "b", "m"])

    cells = map_arrow(fit_list, run, "at int, n long, a double, b double, m double").groupBy("at").agg(
        F.sum(F.col("n") * F.col("a")).alias("a"), F.sum(F.col("n") * F.col("b")).alias("b"),
        F.sum(F.col("m") + F.col("n") * F.col("a") * F.col("b")).alias("m"))
    worst = 0.0
    for row in cells.collect():
        one = 1.0 if row["at"] % k == row["at"] // k else 0.0
        worst = max(worst, abs(row["m"] / n - (row["a"] / n) * (row["b"] / n) - one))
    return worst


def fit(rows: DataFrame, vector_col: str = "embedding", components: int = 16, scale: int = 64,
        offset: int = 1_000_000) -> Whitening | None:
    """The whitening of ``x = floor(scale * c) + offset``, fitted on each
    distinct x vector once; None if no component has any variance.

    Rows whose vector is null or has a null or non-finite component (or one of
    2^40 or more) take no part, nor do vectors of another length than the most
    common one (the greater of two equally common).  Components whose
    eigenvalue is zero to double precision (at most d * 2^-52 of the largest)
    do not exist: there is nothing to scale to one.  Equal eigenvalues come in
    the order of ``eigh``.  Repeated rows count once; an empty table, and one
    with a single distinct vector, give None.  Other columns are ignored."""
    spark = rows.sparkSession
    some = integer_vectors(rows, vector_col, scale, offset)
    d = usual_length(some, "x")
    if not d:
        return None
    path = scratch_folder(spark, "whitening")
    some.where(F.size("x") == d).distinct().write.parquet(path)
    fit_list = spark.read.parquet(path)
    *sums, n = _summed(fit_list, d, d + 1, lambda x: [*_column_sums(x), len(x)])
    v = covariance(n, d, _summed(fit_list, d, d + d * (d - 1) // 2, lambda x: polarised(centred(x, n, sums))))
    e, vectors = np.linalg.eigh(v)
    e, vectors = e[::-1], vectors[:, ::-1]
    k = int(np.count_nonzero(e[:components] > d * np.finfo(float).eps * max(e[0], 0.0)))
    if not k:
        return None
    model = Whitening(n, sums, vectors[:, :k].copy(), e[:k].copy(), e[:k] / np.trace(v), 0.0, scale, offset)
    model.identity_error = _identity_error(fit_list, d, lambda x: projected(centred(x, n, sums), model), k, n)
    return model


def _column_sums(x: np.ndarray) -> list[int]:
    return x.sum(axis=0).tolist()  # at most ROWS numbers below 2^47


def projected(c: np.ndarray, model: Whitening) -> np.ndarray:
    """Whitened values of centred rows."""
    away = (c / model.n).astype(float) if c.dtype == object else c / float(model.n)
    return (away @ model.directions) / np.sqrt(model.eigenvalues)


def transform(rows: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per remaining row and component: ``vec_id``, ``component`` (from
    1), ``n``, ``deviation`` (the sum over dimensions of ``(n*x - S)^2``, exact,
    ``decimal(38, 0)``), ``whitened``, ``explained``, ``identity_error``.

    The rows that ``fit`` leaves out are left out here too.  Repeated rows are
    returned each, null ids as null."""
    d, k = model.directions.shape
    some = integer_vectors(rows, vector_col, model.scale, model.offset, F.col(id_col).cast("bigint")).where(F.size("x") == d)

    def run(batches):
        for batch in slices(batches, ROWS):
            c = centred(matrix(batch.column("x"), d), model.n, model.sums)
            m = len(c)
            who = np.repeat(np.arange(m), k)
            deviation = pa.array([Decimal(v) for v in squares(c, 1)], WHOLE)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_0").take(pa.array(who)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * k, model.n)), deviation.take(pa.array(who)), pa.array(projected(c, model).ravel()),
                 pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, model.identity_error))],
                names=NAMES)

    return map_arrow(some, run, OUT)


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, scale: int = 64,
           offset: int = 1_000_000) -> DataFrame:
    """``fit`` on all rows and ``transform`` of all rows; no rows where nothing varies."""
    model = fit(rows, vector_col, components, scale, offset)
    return transform(rows, model, id_col, vector_col) if model else nothing(rows.sparkSession)


def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], OUT)
