"""Whitening of embeddings by the exact eigenvectors of their integer covariance.

Entries are rounded down to 1/1024, so sums of products are integers and are added up without rounding on the cluster. What
remains is as large as the square of the dimension, whatever the rows: its characteristic polynomial is found modulo primes,
one task per few primes, and each component's root and null space in a task of its own (see `charpoly`).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Context, Decimal, localcontext
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import charpoly
from veilframe.llm.common import column
from veilframe.session import stage

#: Entries are taken in units of 1 / SCALE, plus OFFSET. The offset changes sums but no covariance.
SCALE, OFFSET = 1024, 100_000
_EXACT = 1 << 53


@dataclass(frozen=True)
class Whitening:
    """The fit: number of vectors, sums of their units (without offset), and per component what it explains, n times the
    root of its eigenvalue, and its unit vector."""

    n: int
    sums: tuple[int, ...]
    explained: tuple[float, ...]
    deviations: tuple[float, ...]
    vectors: tuple[tuple[float, ...], ...]


def finite_vectors(df: DataFrame, vector: str) -> Column:
    """Whether a vector is there, not empty, and holds neither null nor anything but finite numbers."""
    v = column(vector)
    return F.coalesce(
        v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False),
    )


def _units(vectors: pa.Array, size: int) -> np.ndarray:
    """Entries in units without offset: whole doubles where all of them are exact, else Python integers."""
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)
    with np.errstate(over="ignore"):
        units = np.floor(flat * SCALE)
    if units.size and not np.abs(units).max() < _EXACT:
        return np.array([math.floor(Fraction(x) * SCALE) for x in flat.flat], dtype=object).reshape(flat.shape)
    return units


def _products(units: np.ndarray) -> np.ndarray:
    """Exact sums of products of columns, a column of ones (number and sums of rows) in front."""
    if units.dtype != object:
        most = max(1, int(np.abs(units).max(initial=0)))
        if most * most < _EXACT:
            rows, out = _EXACT // (most * most), 0
            for at in range(0, len(units), min(rows, 1 << 20)):
                some = np.c_[np.ones(len(units[at : at + rows])), units[at : at + rows]]
                out = out + (some.T @ some).astype(np.int64).astype(object)
            return out
        units = units.astype(np.int64).astype(object)
    some = np.concatenate([np.full((len(units), 1), 1, dtype=object), units], axis=1)
    return some.T.dot(some)


def scatter(df: DataFrame, vector: str, size: int) -> list[list[int]]:
    """(size + 1)^2 exact sums over all rows: their number, sums, and sums of products.

    Every task adds up its rows and gives out one row per row of the matrix; those are added up by their number. Only the
    finished matrix comes to the driver.
    """

    def partial(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                some = _products(_units(batch.column(0), size))
                total = some if total is None else total + some
        if total is not None:
            yield _numbered(enumerate(total.tolist()))

    def summed(batches):
        totals: dict[int, list[int]] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = list(map(int, row))
                totals[i] = [a + b for a, b in zip(totals[i], row, strict=True)] if i in totals else row
        yield _numbered(totals.items())

    kind = "i int, sums array<string>"
    rows = df.select(column(vector).alias("v")).mapInArrow(partial, kind).repartition("i").mapInArrow(summed, kind).collect()
    out = [[0] * (size + 1)] * (size + 1)
    for row in rows:
        out[row.i] = list(map(int, row.sums))
    return out


def _numbered(rows) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in rows], pa.int32()), pa.array([list(map(str, r)) for _, r in rows], pa.list_(pa.string()))], ["i", "sums"],
    )


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(x - matrix), the highest first, of a positive semidefinite integer matrix.

    Tasks find it modulo some primes each, then each coefficient is put together by itself.
    """
    size = len(matrix)
    primes = charpoly.enough_primes(sum(matrix[i][i] for i in range(size)), size)

    def reduced(batches):
        for batch in batches:
            ks, ps, rs = [], [], []
            for p in batch.column(0).to_pylist():
                here = np.array([[v % p for v in row] for row in matrix], np.int64)
                ks += range(size + 1)
                ps += [p] * (size + 1)
                rs += charpoly.polynomial_mod(here, p).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(ps, pa.int64()), pa.array(rs, pa.int64())], ["k", "p", "r"])

    def joined(table: pa.Table) -> pa.Table:
        value = charpoly.remaindered(table.column("r").to_pylist(), table.column("p").to_pylist())
        return pa.table({"k": table.column("k")[:1], "value": pa.chunked_array([[str(value)]], pa.string())})

    tasks = max(1, min(len(primes) // 4, 64))
    residues = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks).mapInArrow(reduced, "k int, p long, r long")
    rows = residues.groupBy("k").applyInArrow(joined, "k int, value string").collect()
    return [int(r.value) for r in sorted(rows)]


def fit_whitening(df: DataFrame, vector: str = "embedding", components: int = 8) -> Whitening:
    """Fits on all rows of `df`, whose vectors must be finite and of one length.

    There are at most as many components as the covariance has eigenvalues above zero: none for no row, one row, or
    equal rows. An eigenvalue that counts several times has as many components, orthogonal to each other.
    """
    spark = df.sparkSession
    first = df.select(F.size(column(vector)).alias("size")).first()
    size = first.size if first else 0
    (n, *sums), *products = scatter(df, vector, size) if size else [[0]]
    matrix = [[n * v - a * b for v, b in zip(row[1:], sums, strict=True)] for row, a in zip(products, sums, strict=True)]
    trace = sum(matrix[i][i] for i in range(size))
    if not trace:
        return Whitening(n, tuple(sums), (), (), ())
    polynomial = characteristic_polynomial(spark, matrix)

    def component(batches):
        for batch in batches:
            out = []
            for k in batch.column(0).to_pylist():
                found = charpoly.isolate(polynomial, k, trace)
                if found is not None:
                    root, start, count = found
                    with localcontext(Context(prec=charpoly.DIGITS)):
                        vector = [float(x) for x in charpoly.null_space(matrix, root, count)[k - start]]
                        out.append((k, float(root / trace), float(root.sqrt()), vector))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64())))],
                ["k", "explained", "deviation", "vector"],
            )

    most = min(components, size)
    rows = spark.range(1, most + 1, 1, most).mapInArrow(component, "k long, explained double, deviation double, vector array<double>").collect()
    rows.sort()
    return Whitening(
        n, tuple(sums), tuple(r.explained for r in rows), tuple(r.deviation for r in rows), tuple(tuple(r.vector) for r in rows),
    )


def _squares(deviations: np.ndarray) -> list[int]:
    """Exact sums of squares per row of integers below 2^62, in four limbs of 20 bits; Python integers as they are."""
    if deviations.dtype == object:
        return (deviations * deviations).sum(axis=1).tolist()
    rest, limbs = np.abs(deviations), []
    for _ in range(4):
        limbs.append(rest & 0xFFFFF)
        rest = rest >> 20
    out = [0] * len(deviations)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            part = (a * b).sum(axis=1)
            if part.any():
                out = [x + (y << 20 * (i + j)) for x, y in zip(out, part.tolist(), strict=True)]
    return out


def whiten(df: DataFrame, model: Whitening, vector: str = "embedding", name: str = "whitened", deviation: str = "deviation") -> DataFrame:
    """`df` with its vectors whitened (array of doubles, the largest component first), and each one's deviation.

    A whitened entry is the vector less the mean, unrounded, projected on a component, over the root of its eigenvalue.
    The deviation is the exact sum of (n * entry - sum)^2, a decimal; null where that has more than 38 digits. Only the
    projection is in doubles, so beside entries a million million times larger small components lose digits.
    """
    size = len(model.sums)
    n, sums, trend = model.n, list(model.sums), np.array(model.vectors).T
    fits = n * _EXACT < 1 << 62 and max(map(abs, sums), default=0) < 1 << 61
    names = df.columns

    def mapped(batches):
        for batch in batches:
            units = _units(batch.column(names.index(vector)), size)
            exact = np.array(sums, dtype=np.int64 if fits else object)
            if not fits or units.dtype == object:
                away = units.astype(np.int64 if units.dtype != object else object).astype(object) * n - exact
            else:
                away = units.astype(np.int64) * n - exact
            white = away.astype(np.float64) @ trend / np.array(model.deviations) if model.vectors else np.zeros((len(away), 0))
            squares = [Decimal(s) if s < 10**38 else None for s in _squares(away)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(white.tolist(), pa.list_(pa.float64())), pa.array(squares, pa.decimal128(38, 0))],
                names=[*names, name, deviation],
            )

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(mapped, f"{fields}, `{name}` array<double>, `{deviation}` decimal(38,0)")


def identity_error(white: DataFrame, components: int, name: str = "whitened") -> float:
    """The largest absolute entry of the covariance of whitened vectors less the identity, by all rows, centred first."""
    if not components:
        return 0.0
    entry = [column(name)[i] for i in range(components)]
    mean = white.agg(*[F.avg(e).alias(f"m_{i}") for i, e in enumerate(entry)]).first()
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    sums = white.agg(*[F.avg((entry[i] - F.lit(mean[i])) * (entry[j] - F.lit(mean[j]))) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(sums, pairs, strict=True))


def whitened_components(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """One row per vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, or holds null or non-finite entries are left out; repeated rows and missing ids
    count like others. Where lengths differ, the most common one is fitted (of equally common ones the longest) and
    vectors of other lengths are left out. Without an eigenvalue above zero there are no components, so no rows.
    """
    rows = df.where(finite_vectors(df, vector)).select(column(id_column).alias("id"), column(vector).alias("v"))
    common = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    rows = rows.where(F.size("v") == (common.size if common else 0))
    model = fit_whitening(rows, "v", components)
    white = stage(whiten(rows, model, "v").drop("v"), "whitened")
    error, explained = identity_error(white, len(model.vectors)), F.array(*map(F.lit, model.explained)).cast("array<double>")
    return white.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        F.col("id").alias(id_column), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
