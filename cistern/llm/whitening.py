"""Whitening of embeddings: eigenvectors of the exact covariance, found in float32 and corrected in higher precision.

Entries become integers, so sums are exact: tasks add up vectors centred on the nearest integer to the mean and their
products, and the driver holds one number for each pair of dimensions, whatever the number of rows. The eigenvectors
of the covariance are computed in float32 and corrected by the iteration of Ogita and Aishima, which is matrix products in
extended precision. Where eigenvalues are closer than the iteration can tell apart, the vectors of such a cluster are
turned by the eigenvectors of the covariance within their space, shifted by the cluster's mean; the iteration then goes on.

Vectors that are null or hold null or non-finite entries (or any of 2**42 and more) are dropped, and so are empty ones and
those of another length than most have (of equally frequent lengths the smaller counts). Ids may be null or repeated: each
row is a vector. A component without variance (constant or dependent dimensions, a single vector) has null in `whitened` and
is left out of identity_error; without any variance `explained` is null. `deviation` is null where it exceeds 63 bits. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Shares of the largest eigenvalue below which a variance is none.
LEAST = 1e-12
#: Of the largest entry of the covariance: eigenvalues closer than this are solved within their space.
CLUSTER = 1e-9
ROWS = 4096


def vectors(column: pa.Array, length: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, entries as integers) of the valid vectors of a column; without a length: (rows, their lengths)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros(0, np.int64), np.zeros((0, length or 0), np.int64)
    at = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~(np.abs(flat) < 2.0**42))])
    size = np.diff(at)
    valid = column.is_valid().to_numpy(zero_copy_only=False) & (size > 0) & (bad[at[1:]] == bad[at[:-1]])
    if length is None:
        own = np.flatnonzero(valid)
        return own, size[own]
    own = np.flatnonzero(valid & (size == length))
    x = flat[at[own][:, None] + np.arange(length)]
    return own, np.floor(SCALE * x).astype(np.int64) + SHIFT


def _exact(x: np.ndarray, rows: int) -> np.ndarray:
    """As float64 where sums of so many products are exact in it, else as Python integers."""
    most = int(np.abs(x).max(initial=0))
    return x.astype(np.float64) if most * most * max(1, rows) < 1 << 53 else x.astype(object)


def _integers(x: np.ndarray) -> list[int]:
    return [int(v) for v in x.ravel().tolist()]


def _moments(length: int, centre: np.ndarray):
    """Of each task: the number of vectors, and for each dimension or pair of dimensions the sums; as decimal text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, [0] * length, [0] * (length * length)
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                _, x = vectors(batch.column(0).slice(i, ROWS), length)
                y = _exact(x - centre, len(x))
                n += len(y)
                sums = [a + b for a, b in zip(sums, _integers(y.sum(0)), strict=True)]
                products = [a + b for a, b in zip(products, _integers(y.T @ y), strict=True)]
        if n:
            cells = [n, *sums, *products]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cells)), pa.int32()), pa.array(map(str, cells), pa.string())], ["cell", "v"])

    return run


def _summed(of: DataFrame, cells: int) -> list[int]:
    """One exact number for each cell: as many as pairs of dimensions."""
    rows = of.groupBy("cell").agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("string").alias("v")).collect()
    out = [0] * cells
    for r in rows:
        out[r["cell"]] = int(r["v"])
    return out


def moments(embeddings: DataFrame, vec: str = "embedding") -> tuple[int, list[int], list[list[int]]]:
    """(n, sums S, products): exact; products[i][j] is the sum of (n * x_i - S_i) * (n * x_j - S_j) over the vectors, over n."""
    column = embeddings.select(vec)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(vectors(batch.column(0))[1], pa.int64())], ["length"])

    most = column.mapInArrow(lengths, "length long").groupBy("length").count().orderBy(F.desc("count"), "length").first()
    if most is None:
        return 0, [], []
    d = most["length"]

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = [0] * d, 0
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                _, x = vectors(batch.column(0).slice(i, ROWS), d)
                n += len(x)
                sums = [a + b for a, b in zip(sums, _integers(_exact(x, len(x)).sum(0)), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array(map(str, [n, *sums]), pa.string())], ["cell", "v"])

    n, *sums = _summed(column.mapInArrow(total, "cell int, v string"), d + 1)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    found = _summed(column.mapInArrow(_moments(d, np.array(centre, np.int64)), "cell int, v string"), 1 + d + d * d)
    rest, square = found[1 : d + 1], found[d + 1 :]
    # The centre is off the mean by half at most; the rest is taken off exactly.
    products = [[n * square[i * d + j] - rest[i] * rest[j] for j in range(d)] for i in range(d)]
    return n, sums, products


def eigenvectors(a: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix, to double precision.

    A float32 solution is corrected until corrections no longer shrink. Each round is four matrix products.
    """
    d = len(a)
    a = a.astype(np.longdouble)
    size = np.abs(a).max(initial=0)
    if not d or size == 0:
        return np.zeros(d), np.eye(d)
    a = a / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    eye, eps, last = np.eye(d, dtype=np.longdouble), np.finfo(np.longdouble).eps, np.inf
    for _ in range(rounds):
        r = eye - x.T @ x
        s = x.T @ (a @ x)
        s = (s + s.T) / 2
        e = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(e)
        # Eigenvalues closer than this are a cluster: their difference can't be told from errors of x, or is so small
        # that a division by it would magnify rounding.
        near = max(2 * (np.sqrt((off**2).sum()) + np.sqrt((r**2).sum())), CLUSTER)
        gap = e[None, :] - e[:, None]
        apart = np.abs(gap) > near
        fix = np.where(apart, (s + e[None, :] * r) / np.where(apart, gap, 1), r / 2)
        np.fill_diagonal(fix, np.diag(r) / 2)
        x = x + x @ fix
        x = _turned(a, x, e, near)
        change = np.abs(fix).max()
        if change < 8 * d * eps or (change >= last / 2 and change < 1e-15):
            break
        last = change
    x = x / np.sqrt((x**2).sum(0))
    e = ((a @ x) * x).sum(0)
    order = np.argsort(-e, kind="stable")
    return (e[order] * size).astype(np.float64), x[:, order].astype(np.float64)


def _turned(a: np.ndarray, x: np.ndarray, e: np.ndarray, near: float) -> np.ndarray:
    """x with the vectors of each cluster of eigenvalues turned within their space."""
    order = np.argsort(e, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(e[order]) > near) + 1):
        if len(own) < 2:
            continue
        v = x[:, own]
        mean = e[own].mean()
        # Shifted by the mean, the differences within the cluster are most of what is left.
        t = v.T @ (a @ v - mean * v)
        most = np.abs(t).max()
        if most > 0:
            turn = np.linalg.eigh((t / most).astype(np.float64))[1].astype(np.longdouble)
            turn = turn + turn @ ((np.eye(len(own), dtype=np.longdouble) - turn.T @ turn) / 2)  # orthogonal beyond double
            x[:, own] = v @ turn
    return x


def whiten(embeddings: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each valid vector and component."""
    rows = embeddings.select(F.col(vec_id).alias("vec_id"), F.col(vec).alias("vec"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    n, sums, products = moments(rows, "vec")
    d, schema = len(sums), f"vec_id {kind}, deviation long, whitened array<double>"
    cov = _ratios(products, n * n) if n else np.zeros((0, 0))
    e, x = eigenvectors(cov)
    k = min(components, d)
    some = e[:k] > LEAST * max(e[0], 0) if d else np.zeros(0, bool)
    axes = np.where(some, x[:, :k] / np.sqrt(np.where(some, e[:k], 1)), np.nan) if d else np.zeros((0, 0))
    centre = [(2 * s + n) // (2 * n) for s in sums] if n else []
    # x - S / n is (x - centre) - rest / n, and n * x - S is n * (x - centre) - rest.
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    base, part = np.array(centre, np.int64), np.array([r / n for r in rest])

    def projected(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for i in range(0, len(column), ROWS):
            own, v = vectors(column.slice(i, ROWS), d)
            y = v - base
            yield own + i, y, (y - part) @ axes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, y, z in projected(batch.column(1)):
                if not len(own):
                    continue
                most = int(np.abs(y).max(initial=0)) * n + max(map(abs, rest))
                exact = y if most * most * d < 1 << 62 else y.astype(object)
                far = ((n * exact - np.array(rest, exact.dtype)) ** 2).sum(1).tolist()
                told = pa.array([v if v < 1 << 63 else None for v in far], pa.int64())
                lists = pa.ListArray.from_arrays(np.arange(0, z.size + 1, k, dtype=np.int32), pa.array(z.ravel(), pa.float64(), from_pandas=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), told, lists], ["vec_id", "deviation", "whitened"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(k + k * k)
        for batch in batches:
            for _, _, z in projected(batch.column(0)):
                sums += np.concatenate([z.sum(0), (z.T @ z).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums)], ["cell", "v"])

    if not n:
        return _lines(rows.mapInArrow(run, schema).where(F.lit(False)), 0, [], 0.0)
    found = rows.select("vec").mapInArrow(spread, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(k + k * k)
    for r in found:
        total[r["cell"]] = r["v"] if r["v"] is not None else np.nan
    mean = total[:k] / n
    off = np.abs(total[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k))[np.ix_(some, some)]
    trace = float(np.trace(cov))
    shares = [float(v) / trace if trace > 0 else None for v in e[:k]]
    return _lines(rows.mapInArrow(run, schema), n, shares, float(off.max(initial=0)))


def _ratios(numbers: list[list[int]], by: int) -> np.ndarray:
    """Quotients in extended precision."""
    part = 1 << 64
    return np.array([[np.longdouble(v // by) + np.longdouble(v % by * part // by) / np.longdouble(part) for v in row] for row in numbers], np.longdouble)


def _lines(rows: DataFrame, n: int, shares: list[float | None], error: float) -> DataFrame:
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.element_at(F.array(*(F.lit(s).cast("double") for s in shares or [None])), F.col("at") + 1)
    return each.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        explained.alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
