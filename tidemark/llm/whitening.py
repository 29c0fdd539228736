"""Whitening of embeddings by a bidiagonal qd solver.

The covariance is never formed. Rows of integers are centred exactly; each task folds its rows block by block into a
triangle by QR, and triangles are folded in groups of ``FAN`` until one is left. The driver brings that triangle, as
wide as a vector, to bidiagonal form by Householder reflections, finds its singular values by dqds, which keeps small
ones relatively accurate, and the vectors belonging to the largest by twisted factorisations. Where values lie so close
together that those cannot be told apart, inverse iteration with orthogonalisation takes their place.

Defined cases: vectors that are null or hold null or non-finite entries are left out; a vector shorter than the longest
counts as continued by entries of zero; entries beyond 2**40 after scaling are an error; components whose singular
value is no more than rounding error of the largest do not exist, so constant or single vectors give no rows; repeated
rows and ids are rows of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.lineage import cut
from tidemark.llm.centroids import finite

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
FAN = 64
LIMIT = 1 << 40
EPS = float(np.finfo(float).eps)
CLOSE = 1e-4


# --- the solver: a triangle in, singular values and right vectors out ------------------------------------------------

def _reflector(x: np.ndarray) -> np.ndarray | None:
    """Unit u such that x - 2 u (u.x) is zero behind its first entry."""
    u, size = x.copy(), np.linalg.norm(x)
    if not size or not x[1:].any():
        return None
    u[0] += size if x[0] >= 0 else -size
    return u / np.linalg.norm(u)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, v) with r = u b v' for some orthogonal u."""
    b, n = r.astype(float).copy(), len(r)
    v = np.eye(n)
    for k in range(n):
        if (u := _reflector(b[k:, k])) is not None:
            b[k:, k:] -= 2 * np.outer(u, u @ b[k:, k:])
        if k < n - 2 and (u := _reflector(b[k, k + 1:])) is not None:
            b[k:, k + 1:] -= 2 * np.outer(b[k:, k + 1:] @ u, u)
            v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ u, u)
    return np.diagonal(b).copy(), np.diagonal(b, 1).copy(), v


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list, list, list] | None:
    """One dqds transform: new q and e, and the intermediate d; None where the shift is too large."""
    new_q, new_e, ds, d = [], [], [], q[0] - shift
    for i in range(len(e)):
        if d < 0:
            return None
        ds.append(d)
        top = d + e[i]
        ratio = q[i + 1] / top if top else 1.0
        new_q.append(top)
        new_e.append(e[i] * ratio)
        d = d * ratio - shift
    return None if d < 0 else (new_q + [d], new_e, ds + [d])


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, falling, by dqds with deflation.

    In a sweep without shift 1/d are the diagonal of the inverse, so the inverse of their sum is a shift that never
    passes the least value.
    """
    found, work = [], [(list(diagonal ** 2), list(above ** 2), 0.0)]
    while work:
        q, e, base = work.pop()
        while q:
            # A link that is negligible beside both its neighbours separates two blocks.
            apart = next((i for i in reversed(range(len(e)))
                          if e[i] <= EPS * EPS * (base + q[i]) or e[i] <= EPS * EPS * (base + q[i + 1])), None)
            if len(q) == 1:
                found.append(base + q[0])
                break
            if apart is not None:
                work.append((q[:apart + 1], e[:apart], base))
                q, e = q[apart + 1:], e[apart + 1:]
                continue
            if q[0] < q[-1]:  # small values leave at the end
                q, e = q[::-1], e[::-1]
            q, e, ds = _sweep(q, e, 0.0)
            shift = 1 / sum(1 / d for d in ds) if min(ds) > 0 else 0.0
            while shift and (moved := _sweep(q, e, shift)) is None:
                shift = shift / 2 if shift > EPS * base else 0.0
            if shift:
                (q, e, _), base = moved, base + shift
    return np.sort(found)[::-1]


def twisted_vector(diagonal: np.ndarray, above: np.ndarray, value: float) -> np.ndarray:
    """Unit eigenvector of b'b for an eigenvalue, from the twisted factorisation whose pivot is least."""
    n, q, tiny = len(diagonal), diagonal ** 2, EPS * EPS * (value or 1.0)
    links = diagonal[:-1] * above
    down, up, s, p = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    s[0] = -value
    for i in range(n - 1):
        down[i] = (s[i] + q[i]) or tiny
        s[i + 1] = above[i] ** 2 * s[i] / down[i] - value
    p[-1] = q[-1] - value
    for i in reversed(range(n - 1)):
        up[i] = (above[i] ** 2 + p[i + 1]) or tiny
        p[i] = p[i + 1] * q[i] / up[i] - value
    twist = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[twist] = 1.0
    for i in reversed(range(twist)):
        z[i] = -links[i] / down[i] * z[i + 1]
    for i in range(twist, n - 1):
        z[i + 1] = -links[i] / up[i] * z[i]
    return z / np.linalg.norm(z)


def largest(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right vectors as columns) of the largest ``most`` that are more than rounding error."""
    diagonal, above, v = bidiagonal(r)
    values = squared_singular_values(diagonal, above)
    if not len(values) or not values[0] > 0:
        return np.zeros(0), np.zeros((len(r), 0))
    values = values[:most][np.sqrt(values[:most]) > 8 * len(r) * EPS * np.sqrt(values[0])]
    above = np.where(np.abs(above) <= EPS * EPS * np.sqrt(values[0]), 0.0, above)
    vectors, rng = np.zeros((len(r), len(values))), np.random.default_rng(0)
    square = np.diag(diagonal) + np.diag(above, 1)
    square = square.T @ square
    first = 0
    for i, value in enumerate(values):
        if i and values[i - 1] - value > CLOSE * values[i - 1]:
            first = i
        alone = first == i and (i + 1 == len(values) or value - values[i + 1] > CLOSE * value)
        if alone:
            vectors[:, i] = twisted_vector(diagonal, above, value)
            continue
        z, before = rng.standard_normal(len(r)), vectors[:, first:i]
        moved = square - value * (1 + 2 * EPS * (i - first)) * np.eye(len(r)) + EPS * EPS * value * np.eye(len(r))
        for _ in range(4):
            try:
                z = np.linalg.solve(moved, z)
            except np.linalg.LinAlgError:  # exactly singular: a hair beside the value is not
                moved += 4 * EPS * value * np.eye(len(r))
                z = np.linalg.solve(moved, z)
            for _ in range(2):
                z -= before @ (before.T @ z)
            z /= np.linalg.norm(z)
        vectors[:, i] = z
    return np.sqrt(values), v @ vectors


# --- passes over the rows --------------------------------------------------------------------------------------------

def integers(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE,
             shift: int = SHIFT) -> DataFrame:
    """(vec_id, x) of the vectors without null or non-finite entries."""
    c, most = F.col(vector).cast("array<double>"), F.lit(2.0 * LIMIT)  # larger ones are an error later on, whatever they are
    return vectors.where(finite(c)).select(
        F.col(vec_id).alias("vec_id"), F.transform(c, lambda v: F.floor(F.least(F.greatest(v * scale, -most), most)) + shift).alias("x"))


def _matrix(column: pa.ListArray, width: int, fill: int) -> np.ndarray:
    values, sizes = column.flatten().to_numpy(), pc.list_value_length(column).to_numpy()
    if values.size and np.abs(values).max() > LIMIT:
        raise OverflowError("scaled entries must lie within 2**40 of zero")
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.full((len(sizes), width), fill, np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def totals(rows: DataFrame, fill: int = SHIFT) -> tuple[int, list[int]]:
    """(number of rows, exact sum per dimension)."""
    def run(batches: Iterator[pa.RecordBatch]):
        n, present, sums = 0, np.zeros(0, np.int64), np.zeros(0, object)
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = pc.list_value_length(batch.column("x")).to_numpy()
            x = _matrix(batch.column("x"), max(int(sizes.max()), len(sums)), 0)
            more = x.shape[1] - len(sums)
            n += len(x)
            present = np.pad(present, (0, more)) + (sizes[:, None] > np.arange(x.shape[1])).sum(axis=0)
            sums = np.pad(sums, (0, more)) + x.sum(axis=0)
        # Place -1 counts rows, those of vectors without entries included.
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *range(len(sums))], pa.int32()), pa.array([n, *present.tolist()], pa.int64()),
             pa.array([Decimal(0), *(Decimal(int(s)) for s in sums)], pa.decimal128(38, 0))], ["i", "n", "s"])

    parts = rows.mapInArrow(run, "i int, n bigint, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    by_place = {r["i"]: (r["n"], int(r["s"])) for r in parts.collect()}
    n, _ = by_place.pop(-1, (0, 0))
    return n, [s + fill * (n - present) for _, (present, s) in sorted(by_place.items())]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S exactly: as longs, or as Python's integers where longs would overflow."""
    if x.size and n * int(np.abs(x).max()) + max(map(abs, sums)) >= 1 << 62:
        return x.astype(object) * n - np.array(sums, object)
    return x * n - np.array(sums, np.int64)


def deviations(c: np.ndarray) -> pa.Array:
    """Exact sums of squares of centred rows."""
    if c.dtype != object and c.size and int(np.abs(c).max()) ** 2 * c.shape[1] < 1 << 63:
        return pa.array((c ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
    return pa.array([Decimal(sum(int(v) ** 2 for v in row)) for row in c], pa.decimal128(38, 0))


def triangle(rows: DataFrame, n: int, sums: list[int], fill: int = SHIFT) -> np.ndarray:
    """The triangle r of the QR factorisation of all centred rows."""
    width = len(sums)

    def run(batches: Iterator[pa.RecordBatch]):
        r = np.zeros((0, width))
        for batch in batches:
            c = centred(_matrix(batch.column("x"), width, fill), n, sums)
            r = np.linalg.qr(np.concatenate([r, c.astype(float) / n]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([r.tobytes()])], ["part", "r"])

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        rs = [np.frombuffer(b).reshape(-1, width) for b in group.sort_values("part")["r"]]
        r = np.linalg.qr(np.concatenate(rs), mode="r")
        return pd.DataFrame({"part": [int(group["part"].iloc[0]) // FAN], "r": [r.tobytes()]})

    parts = cut(rows.mapInArrow(run, "part bigint, r binary"))
    while (last := parts.agg(F.max("part")).first()[0]) is not None and last > 0:
        parts = cut(parts.groupBy(F.expr(f"part div {FAN}").alias("g")).applyInPandas(fold, "part bigint, r binary"))
    r = np.concatenate([np.zeros((0, width)), *(np.frombuffer(p["r"]).reshape(-1, width) for p in parts.collect())])
    return np.concatenate([r, np.zeros((width - len(r), width))])


def identity_error(projected: DataFrame, n: int, size: int) -> float:
    """Largest entry of the covariance of the whitened rows minus the identity. The rows' mean is zero but for rounding;
    what it is gets taken off."""
    def run(batches: Iterator[pa.RecordBatch]):
        sums, products = np.zeros(size), np.zeros((size, size))
        for batch in batches:
            w = batch.column("whitened").flatten().to_numpy().reshape(-1, size)
            sums += w.sum(axis=0)
            products += w.T @ w
        both = np.concatenate([sums, products.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(both))), pa.array(both)], ["i", "s"])

    parts = projected.select("whitened").mapInArrow(run, "i bigint, s double").groupBy("i").agg(F.sum("s").alias("s"))
    both = np.array([r["s"] for r in parts.orderBy("i").collect()]) / n
    mean, products = both[:size], both[size:].reshape(size, size)
    return float(np.abs(products - np.outer(mean, mean) - np.eye(size)).max())


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """One row per vector kept and component: vec_id, component (from 1), n, deviation (decimal), whitened, explained,
    identity_error."""
    rows = integers(vectors, vec_id, vector, scale, shift)
    kind = rows.schema["vec_id"].dataType.simpleString()
    n, sums = totals(rows, shift)
    width = len(sums)
    r = triangle(rows, n, sums, shift) if width else np.zeros((0, 0))
    values, directions = largest(r, components)
    scaled = directions / np.where(values > 0, values, 1.0) * np.sqrt(n)
    explained = (values ** 2 / ((r ** 2).sum() or 1.0)).tolist()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            c = centred(_matrix(batch.column("x"), width, shift), n, sums)
            w = (c.astype(float) / n) @ scaled
            offsets = np.arange(0, w.size + 1, max(1, len(values)), dtype=np.int32) if len(values) else np.zeros(len(c) + 1, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), deviations(c), pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))],
                ["vec_id", "deviation", "whitened"])

    projected = rows.mapInArrow(run, f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")
    error = identity_error(projected, n, len(values)) if len(values) else 0.0
    return projected.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(F.array(*map(F.lit, explained)).cast("array<double>"), F.col("place")).alias("explained"),
        F.lit(error).alias("identity_error"))
