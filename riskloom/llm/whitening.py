"""Embedding whitening: eigenvectors by spectral divide and conquer over QDWH polar decompositions.

Vectors are put on a grid of whole numbers, so their sums and products over any number of rows are exact whole numbers.
The tasks sum them; what comes to the driver is one row for each pair of dimensions. There the covariance is taken
apart: the polar factor of a shifted covariance has eigenvalues of 1 and -1 only, so half its sum with the identity
projects on the eigenvectors above the shift. Bases of the projector's range and null space split the covariance into
two smaller ones, until each is one component. The whitening matrix (dimensions x components) is sent to the tasks.
"""
from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from riskloom.llm.common import at_rest, mapped, table

#: Steps of the grid in 1, and what is added to each entry.
GRID, OFFSET = 64, 1_000_000
#: Entries beyond this have no exact products in 64 bits.
LARGEST = 1 << 24
#: The covariance comes to the driver as a row for each pair of dimensions, a million at most, and is sent to all tasks.
MOST_DIMENSIONS = 1024
EPS = float(np.finfo(np.float64).eps)


# ---- the spectral method ---------------------------------------------------------------------------------------

def polar_sign(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix (its sign), by dynamically weighted Halley iterations.

    Each iteration takes the QR decomposition of [sqrt(c) X; I], which needs no inverse and is backward stable.
    """
    n = len(a)
    norm = np.sqrt(np.abs(a).sum(axis=0).max() * np.abs(a).sum(axis=1).max())
    if norm == 0:
        return np.eye(n)
    x = a / norm
    # A lower bound on the least singular value; one that is too high costs iterations, not accuracy.
    diagonal = np.abs(np.diag(np.linalg.qr(x, mode="r"))).min()
    low = min(max(diagonal / np.sqrt(n), EPS), 1.0)
    for _ in range(60):
        d = (4 * (1 - low * low) / low ** 4) ** (1 / 3) if low < 1 else 0.0
        wide = np.sqrt(1 + d)
        weight = wide + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - low * low) / (low * low * wide), 0.0))
        b = (weight - 1) ** 2 / 4
        c = weight + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(n)]))
        new = b / c * x + (weight - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        step = np.abs(new - x).max()
        x, low = new, min(low * (weight + b * low * low) / (1 + c * low * low), 1.0)
        if step < (5 * EPS) ** (1 / 3) and abs(1 - low) < 10 * EPS or step < 4 * EPS:
            break
    # One Newton-Schulz step takes the last rounding away.
    x = 1.5 * x - 0.5 * (x @ x @ x)
    return (x + x.T) / 2


def _range_and_null(projector: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the range and the null space of a projector, by QR of its largest columns, twice."""
    order = np.argsort(-np.diag(projector), kind="stable")
    chosen: list[np.ndarray] = []
    rest = projector[:, order].copy()
    # Column pivoting: the longest column left, then its part is taken out of all others.
    for _ in range(rank):
        j = int(np.argmax((rest * rest).sum(axis=0)))
        v = rest[:, j] / np.linalg.norm(rest[:, j])
        chosen.append(v)
        rest -= np.outer(v, v @ rest)
    start = projector @ np.stack(chosen, axis=1)
    q, _ = np.linalg.qr(start, mode="complete")
    return q[:, :rank], q[:, rank:]


def _split_at(a: np.ndarray) -> Iterator[float]:
    """Shifts to try: between the middle ones of the diagonal, their mean, other quantiles."""
    d = np.sort(np.diag(a))
    n = len(d)
    yield (d[(n - 1) // 2] + d[n // 2]) / 2
    yield d.mean()
    gaps = np.diff(d)
    if len(gaps):
        i = int(gaps.argmax())
        yield (d[i] + d[i + 1]) / 2
    for q in (0.25, 0.75, 0.1, 0.9, 0.4, 0.6):
        yield float(np.quantile(d, q))
    radius = np.abs(a).sum(axis=1) - np.abs(np.diag(a))
    low, high = (np.diag(a) - radius).min(), (np.diag(a) + radius).max()
    for q in np.linspace(0.05, 0.95, 19):
        yield float(low + q * (high - low))


def spectrum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, by spectral divide and conquer.

    A part whose off-diagonal entries are below the rounding of the whole matrix is diagonal already: any basis of it
    serves.
    """
    a = (a + a.T) / 2
    scale = float(np.abs(a).max(initial=0.0))

    def apart(part: np.ndarray, basis: np.ndarray) -> list[tuple[float, np.ndarray]]:
        n = len(part)
        off = part - np.diag(np.diag(part))
        if n == 1 or np.abs(off).max() <= EPS * scale / 4:
            return [(float(part[i, i]), basis[:, i]) for i in range(n)]
        if n == 2:
            # One rotation takes two components apart.
            angle = 0.5 * np.arctan2(2 * part[0, 1], part[0, 0] - part[1, 1])
            turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
            values = np.diag(turn.T @ part @ turn)
            return [(float(values[i]), basis @ turn[:, i]) for i in range(2)]
        for shift in _split_at(part):
            projector = (polar_sign(part - shift * np.eye(n)) + np.eye(n)) / 2
            rank = round(float(np.trace(projector)))
            if 0 < rank < n and abs(np.trace(projector) - rank) < 1e-6:
                above, below = _range_and_null(projector, rank)
                left = above.T @ part @ below
                if np.abs(left).max() <= 100 * n * EPS * scale:
                    break
        else:
            # All eigenvalues agree to rounding.
            return [(float(part[i, i]), basis[:, i]) for i in range(n)]
        one = above.T @ part @ above
        two = below.T @ part @ below
        return apart((one + one.T) / 2, basis @ above) + apart((two + two.T) / 2, basis @ below)

    if not len(a):
        return np.zeros(0), np.zeros((0, 0))
    found = apart(a, np.eye(len(a)))
    vectors = np.stack([v for _, v in found], axis=1)
    # What the splits left between components, to first order; then one more pass over the orthonormal basis.
    vectors, _ = np.linalg.qr(vectors)
    for _ in range(2):
        inner = vectors.T @ a @ vectors
        value = np.diag(inner)
        gap = value[None, :] - value[:, None]
        turn = np.where(np.abs(gap) > 1e-6 * scale, inner / np.where(gap == 0, 1, gap), 0.0)
        np.fill_diagonal(turn, 0)
        vectors, _ = np.linalg.qr(vectors @ (np.eye(len(a)) + turn))
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    # Either sign will do; the entry that is largest is positive.
    vectors = vectors[:, order]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(a))])
    return values[order], vectors * np.where(sign == 0, 1, sign)


# ---- the table -------------------------------------------------------------------------------------------------

def usable(vectors: DataFrame, vector: str) -> Column:
    """Whether a vector is there and all its entries are numbers."""
    c = F.col(vector)
    number = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda e: F.coalesce(
        number(e.cast("double")), F.lit(False))), F.lit(False))


def _grid(column: pa.Array, dimensions: int) -> np.ndarray:
    """Rows of floor(GRID * c), exact in doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.floor(flat * GRID).reshape(-1, dimensions)
    if np.abs(x).max(initial=0) >= LARGEST:
        raise OverflowError(f"an entry is {LARGEST / GRID:.0f} or more: its products are not exact")
    return x


def _products(batches: Iterator[np.ndarray], dimensions: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums and sums of products of whole-number rows, exact: BLAS on pieces whose sums stay below 2**53."""
    n, total = 0, np.zeros(dimensions, object)
    product = np.zeros((dimensions, dimensions), object)
    for x in batches:
        most = max(1, int(np.abs(x).max(initial=0)))
        rows = max(1, (1 << 53) // (most * most))
        for at in range(0, len(x), rows):
            piece = x[at:at + rows]
            product += (piece.T @ piece).astype(np.int64).astype(object)
            total += piece.sum(axis=0).astype(np.int64).astype(object)
        n += len(x)
    return n, total, product


def moments(vectors: DataFrame, vector: str, dimensions: int) -> tuple[int, list[int], list[list[int]]]:
    """Rows, sums and sums of products of the grid entries without OFFSET, exact. One row for each pair of dimensions
    comes to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, product = _products((_grid(b.column(0), dimensions) for b in batches), dimensions)
        if not n:
            return
        wide = pa.decimal128(38, 0)
        for i in range(dimensions):
            # Row i of the products, then the sum; number -1 holds the count.
            values = [Decimal(v) for v in product[i].tolist()] + [Decimal(total[i])]
            yield pa.record_batch([pa.array([i] * (dimensions + 1), pa.int32()),
                                   pa.array(range(dimensions + 1), pa.int32()), pa.array(values, wide)],
                                  ["i", "j", "v"])
        yield pa.record_batch([pa.array([-1], pa.int32()), pa.array([0], pa.int32()), pa.array([Decimal(n)], wide)],
                              ["i", "j", "v"])

    parts = vectors.select(vector).transform(mapped, run, "i int, j int, v decimal(38,0)")
    n, total = 0, [0] * dimensions
    product = [[0] * dimensions for _ in range(dimensions)]
    for i, j, v in parts.groupBy("i", "j").agg(F.sum("v").cast("decimal(38,0)")).collect():
        if i < 0:
            n = int(v)
        elif j == dimensions:
            total[i] = int(v)
        else:
            product[i][j] = int(v)
    return n, total, product


def covariance(n: int, total: list[int], product: list[list[int]]) -> np.ndarray:
    """Divisor n. The centred sums n * product - total * total are whole numbers; they are rounded once, at the end."""
    d = len(total)
    out = np.zeros((d, d))
    for i in range(d):
        for j in range(i + 1):
            out[i, j] = out[j, i] = (n * product[i][j] - total[i] * total[j]) / (n * n)
    return out


def whitened(table_: DataFrame, components: int = 32, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of each usable vector and component.

    Vectors that are null or empty, or hold null or a non-finite entry, are dropped. A table's vectors have one length;
    those of another length than the most common one (the longest of equally common ones) are dropped too.
    Components whose eigenvalue is 0 to rounding can't be whitened and are not listed: equal vectors, or one alone,
    give no rows, like an empty table. Null keys and repeated rows stay. Entries of 262,144 or more raise
    OverflowError, and so does a deviation beyond 64 bits. Other columns are not read.
    """
    spark = table_.sparkSession
    kind = table_.schema[key].dataType
    schema = (T.StructType().add(key, kind).add("component", "integer").add("n", "long").add("deviation", "long")
              .add("whitened", "double").add("explained", "double").add("identity_error", "double"))
    clean = table_.filter(usable(table_, vector)).select(
        F.col(key).alias("key"), F.transform(vector, lambda e: e.cast("double")).alias("x"))
    lengths = clean.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    d = lengths["d"]
    if d > MOST_DIMENSIONS:
        raise ValueError(f"{d} dimensions; the covariance is kept to {MOST_DIMENSIONS}")
    clean = clean.filter(F.size("x") == d)
    n, total, product = moments(clean, "x", d)
    v = covariance(n, total, product)
    trace = float(np.trace(v))
    values, vectors = spectrum(v)
    shown = [i for i in range(min(components, d)) if values[i] > d * EPS * max(float(values[0]), 0.0) * 8]
    if not shown:
        return spark.createDataFrame([], schema)
    matrix = vectors[:, shown] / np.sqrt(values[shown])[None, :]
    mean_whole = np.array([s // n for s in total], np.float64)
    mean_rest = np.array([(s % n) / n for s in total])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _grid(b.column(1), d)
            # Exact: whole numbers below 2**63, or an error.
            far = [int(t) for t in total]
            reach = max((int(np.abs(x).max(initial=0)) * n + max(map(abs, far))) ** 2 * d, 1)
            if reach < 1 << 63:
                centred = x.astype(np.int64) * n - np.array(far, np.int64)[None, :]
                deviation = pa.array((centred * centred).sum(axis=1))
            else:
                deviation = pa.array([sum((n * int(e) - t) ** 2 for e, t in zip(row, far, strict=True))
                                      for row in x.tolist()], pa.int64())
            y = ((x - mean_whole) - mean_rest) @ matrix
            flat = pa.array(y.reshape(-1))
            offsets = pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32))
            yield pa.record_batch([b.column(0), deviation, pa.ListArray.from_arrays(offsets, flat)],
                                  ["key", "deviation", "y"])

    out = T.StructType().add("key", kind).add("deviation", "long").add("y", T.ArrayType(T.DoubleType()))
    rows = at_rest(clean.transform(mapped, run, out), "whitened")
    error = identity_error(rows, len(shown), n)
    explained = F.array(*[F.lit(float(values[i]) / trace) for i in shown])
    return rows.select(F.col("key").alias(key), "deviation", F.posexplode("y").alias("pos", "whitened")).select(
        key, (F.col("pos") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("pos") + 1).alias("explained"), F.lit(error).alias("identity_error"))


def identity_error(rows: DataFrame, components: int, n: int) -> float:
    """The largest absolute entry of the covariance of y less the identity, from the written rows: their mean first,
    then the products of what is centred on it."""
    mean = np.zeros(components)
    for i, s in rows.select(F.posexplode("y").alias("i", "v")).groupBy("i").agg(F.sum("v")).collect():
        mean[i] = s / n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product = np.zeros((components, components))
        for b in batches:
            y = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, components) - mean
            product += y.T @ y
        index = np.arange(components * components)
        yield pa.record_batch([pa.array((index // components).astype(np.int32)),
                               pa.array((index % components).astype(np.int32)), pa.array(product.reshape(-1))],
                              ["i", "j", "v"])

    parts = rows.select("y").transform(mapped, run, "i int, j int, v double")
    entry = F.sum("v") / F.lit(float(n)) - F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.lit(0.0))
    return float(parts.groupBy("i", "j").agg(F.abs(entry).alias("e")).agg(F.max("e")).first()[0])


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
