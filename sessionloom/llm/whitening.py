"""Whitening of embeddings by the singular values of their centred rows.

Blockwise QR: each task folds its centred rows into one triangle R, and triangles are folded together in rounds of FAN until
one is left; R'R is n times the covariance, which is never formed. Householder reflections bring R to an upper bidiagonal B.
The squares of B's singular values come from shifted quotient-difference steps (dqds) without subtractions but for the
shift, so small ones are as accurate as large ones. A twisted factorisation of B'B less a squared singular value gives its
vector; the reflections carry it back to a whitening direction.

Only triangles (columns x columns) and sums reach the driver, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import written
from .vectors import matrix

#: Triangles that one task folds together, and rows folded at once.
FAN, ROWS = 32, 4_096
EPS = np.finfo(float).eps


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of B, and V, with r = U B V' for some U with orthonormal columns."""
    a, d = r.astype(float).copy(), r.shape[1]
    v = np.eye(d)

    def reflect(x: np.ndarray) -> np.ndarray | None:
        """The unit vector whose reflection leaves only the first entry of x."""
        w = x.copy()
        w[0] += np.copysign(np.linalg.norm(x), x[0])
        length = np.linalg.norm(w)
        return w / length if length > 0 and np.any(x[1:]) else None

    for i in range(d):
        if (w := reflect(a[i:, i])) is not None:
            a[i:, i:] -= 2 * np.outer(w, w @ a[i:, i:])
        if i < d - 2 and (w := reflect(a[i, i + 1 :])) is not None:
            a[i:, i + 1 :] -= 2 * np.outer(a[i:, i + 1 :] @ w, w)
            v[:, i + 1 :] -= 2 * np.outer(v[:, i + 1 :] @ w, w)
    return np.diagonal(a)[:d].copy(), np.diagonal(a, 1)[: d - 1].copy(), v


def dqds_step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float] | None:
    """One step on squares of diagonal and superdiagonal, and the least d met; None where the shift is too large."""
    n = len(q)
    qq, ee = np.empty(n), np.empty(n - 1)
    d = least = q[0] - shift
    for i in range(n - 1):
        if d < 0:
            return None
        qq[i] = d + e[i]
        ratio = q[i + 1] / qq[i] if qq[i] > 0 else np.inf
        if not np.isfinite(ratio):
            return None
        ee[i] = e[i] * ratio
        d = d * ratio - shift
        least = min(least, d)
    qq[-1] = d
    return None if d < 0 else (qq, ee, least)


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The squares of an upper bidiagonal's singular values, falling."""
    out: list[float] = []
    scale = max(np.abs(diagonal).max(initial=0), np.abs(above).max(initial=0))
    if not scale:
        return np.zeros(len(diagonal))
    todo = [((diagonal / scale) ** 2, (above / scale) ** 2, 0.0)]
    while todo:
        q, e, moved = todo.pop()
        while len(q):
            small = np.flatnonzero(e <= EPS**2 * (moved + np.minimum(q[:-1], q[1:])))
            if len(small):
                at = int(small[-1])
                if at == len(q) - 2:  # the last one stands alone
                    out.append(moved + q[-1])
                    q, e = q[:-1], e[:-1]
                    continue
                todo.append((q[: at + 1], e[:at], moved))
                q, e = q[at + 1 :], e[at + 1 :]
                continue
            if len(q) == 1:
                out.append(moved + q[0])
                break
            if q[0] < q[-1]:  # the large end comes first: the reversal has the same singular values
                q, e = q[::-1].copy(), e[::-1].copy()
            least = dqds_step(q, e, 0.0)
            if least is None:  # a zero on the diagonal that no step can move: nudge it
                q = np.maximum(q, np.finfo(float).tiny / EPS)
                continue
            b, c = q[-1] + e[-1], q[-2] * e[-1]
            near = 2 * c / (q[-2] + b + np.sqrt((q[-2] - b) ** 2 + 4 * c)) if c > 0 else 0.0
            near = max(0.0, q[-1] - near)
            for shift in (min(near, least[2]), 0.9 * least[2], 0.5 * least[2], 0.1 * least[2]):
                if shift > 0 and (step := dqds_step(q, e, shift)) is not None:
                    q, e, moved = step[0], step[1], moved + shift
                    break
            else:
                q, e = least[0], least[1]
    return np.sort(np.array(out))[::-1] * scale**2


def twisted(diagonal: np.ndarray, above: np.ndarray, value: float, skip: int = 0) -> np.ndarray:
    """A unit vector z with B'B z = value z, from the twisted factorisation at the place where its pivot is least (or the
    skip-th least)."""
    n = len(diagonal)
    tiny = EPS * max(value, (diagonal**2).max(), np.finfo(float).tiny)
    pivot, low = diagonal**2, np.zeros(n - 1)
    good = diagonal[:-1] != 0
    low[good] = above[good] / diagonal[:-1][good]
    s, p, down, up = np.empty(n), np.empty(n), np.empty(n - 1), np.empty(n - 1)
    s[0] = -value
    for i in range(n - 1):
        d = s[i] + pivot[i]
        d = d if abs(d) > tiny * EPS else tiny * EPS
        down[i] = pivot[i] * low[i] / d
        s[i + 1] = down[i] * low[i] * s[i] - value
    p[-1] = pivot[-1] - value
    for i in range(n - 2, -1, -1):
        d = pivot[i] * low[i] ** 2 + p[i + 1]
        d = d if abs(d) > tiny * EPS else tiny * EPS
        up[i] = low[i] * pivot[i] / d
        p[i] = p[i + 1] * pivot[i] / d - value
    k = int(np.argsort(np.abs(s + p + value), kind="stable")[min(skip, n - 1)])
    z = np.zeros(n)
    z[k] = 1
    for i in range(k - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def directions(r: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest squared singular values of a triangle, falling, and their right vectors as columns, as many as asked.

    Where values lie so close that their vectors from single factorisations aren't orthogonal, they are made so, and turned within
    what they span until each is a singular vector.
    """
    diagonal, above, back = bidiagonal(r)
    values = squared_singular_values(diagonal, above)
    many = min(many, len(values))
    starts = [0, *(np.flatnonzero(above == 0) + 1), len(diagonal)]
    # a block's vectors are zero elsewhere; equal values of different blocks have different vectors
    owners = sorted(((-v, a, b) for a, b in zip(starts, starts[1:], strict=False) for v in squared_singular_values(diagonal[a:b], above[a : b - 1])))
    z, seen = np.zeros((len(diagonal), many)), {}
    bi = np.diag(diagonal) + np.diag(above, 1)
    for j, (value, a, b) in enumerate(owners[:many]):
        near = [i for i in seen.get((a, b), []) if values[i] + value <= 1e-3 * max(values[i], EPS)]
        for skip in range(b - a):
            v = np.zeros(len(diagonal))
            v[a:b] = twisted(diagonal[a:b], above[a : b - 1], -value, skip) if b - a > 1 else 1.0
            for _ in range(2):
                v -= z[:, near] @ (z[:, near].T @ v)
            if np.linalg.norm(v) > 1e-3:
                break
        z[:, j] = v / np.linalg.norm(v)
        seen.setdefault((a, b), []).append(j)
    close = np.flatnonzero(np.diff(values[:many]) >= -1e-3 * values[: many - 1]) if many > 1 else []
    for run in np.split(np.asarray(close), np.flatnonzero(np.diff(close) > 1) + 1) if len(close) else []:
        cols = np.arange(run[0], run[-1] + 2)
        small = bi @ z[:, cols]
        turn = np.linalg.svd(small, full_matrices=False)[2].T
        z[:, cols] = z[:, cols] @ turn
    return values[:many], np.linalg.qr(back @ z)[0]


@dataclass
class Whitening:
    n: int  # distinct vectors
    dim: int
    sums: np.ndarray  # of each component, Python integers
    values: np.ndarray  # falling eigenvalues of the covariance, none of them zero
    vectors: np.ndarray  # their unit vectors as columns
    trace: float
    wide: bool  # deviations need more than a long's arithmetic
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return x - np.array([float(s) / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sums of (n x - S)^2, exact; an OverflowError beyond a long."""
        if not self.wide:
            d = self.n * x - np.array([int(s) for s in self.sums], np.int64)
            return (d * d).sum(1)
        out = [sum((self.n * int(v) - int(s)) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        if any(v >= 1 << 63 for v in out):
            raise OverflowError("a deviation exceeds a long")
        return np.array(out, np.int64)


def whole_rows(embeddings: DataFrame, factor: int) -> DataFrame:
    """(vec_id, x), written: x as longs of equal length, shorter vectors followed by zeros."""
    v = F.col("embedding").cast("array<double>")
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = embeddings.select("vec_id", v.alias("v")).where(F.col("v").isNotNull() & ~odd)
    far = F.exists("v", lambda c: F.abs(c * factor) >= 2.0**62)
    whole = F.when(far, F.raise_error(F.lit("a component exceeds a long"))).otherwise(F.transform("v", lambda c: F.floor(c * factor).cast("long")))
    rows = written(rows.select("vec_id", whole.alias("x")))
    least, most = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if least == most:
        return rows
    return written(rows.select("vec_id", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(most) - F.size("x"))).alias("x")))


def longs(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, dim)


def folded(stack: list[np.ndarray], dim: int) -> np.ndarray:
    """One triangle of so many columns for a pile of rows."""
    pile = np.concatenate([*stack, np.zeros((dim, dim))])
    return np.linalg.qr(pile, mode="r")


def triangle(fit: DataFrame, found: Whitening) -> np.ndarray:
    """R of the centred rows of a table of x: one for each partition, then folded together FAN at a time."""

    def by_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyspark

        r = np.zeros((found.dim, found.dim))
        for batch in batches:
            x = longs(batch.column(0), found.dim)
            for a in range(0, len(x), ROWS):
                r = folded([r, found.centred(x[a : a + ROWS])], found.dim)
        part = pyspark.TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([r.ravel().tolist()])], names=["part", "r"])

    def together(group: pa.Table) -> pa.Table:
        r = folded([matrix(group["r"], found.dim**2).reshape(-1, found.dim)], found.dim)
        return pa.table({"part": pa.array([group["part"][0].as_py() // FAN], pa.int64()), "r": pa.array([r.ravel().tolist()])})

    parts = fit.rdd.getNumPartitions()
    rs = fit.mapInArrow(by_partition, "part long, r array<double>")
    while parts > 1:
        rs = rs.groupBy(F.expr(f"part div {FAN}")).applyInArrow(together, "part long, r array<double>")
        parts = -(-parts // FAN)
    got = rs.toArrow()
    return folded([matrix(got["r"], found.dim**2).reshape(-1, found.dim)], found.dim)


def identity_error(fit: DataFrame, found: Whitening) -> float:
    """The largest entry, without sign, of the whitened rows' covariance less the identity. Each task centres its rows on their own
    mean; means and products are merged in Spark, a row for each pair of components."""
    k = len(found.values)

    def by_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, m2 = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = found.project(longs(batch.column(0), found.dim))
            if len(w):
                own = w.mean(0)
                apart, total = own - mean, n + len(w)
                m2 += (w - own).T @ (w - own) + np.outer(apart, apart) * n * len(w) / total
                mean, n = mean + apart * len(w) / total, total
        if n:
            i, j = (a.ravel() for a in np.indices((k, k)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (i, j, np.full(k * k, n), mean[i], mean[j], m2.ravel())], names=["i", "j", "n", "a", "b", "m2"])

    own = fit.mapInArrow(by_partition, "i long, j long, n long, a double, b double, m2 double")
    n = F.col("n")
    sums = own.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum(n * F.col("a")).alias("a"), F.sum(n * F.col("b")).alias("b"), F.sum(F.col("m2") + n * F.col("a") * F.col("b")).alias("m2"))
    cov = (F.col("m2") - F.col("a") * F.col("b") / n) / n
    return float(sums.agg(F.max(F.abs(cov - (F.col("i") == F.col("j")).cast("double")))).first()[0])


def fit_whitening(rows: DataFrame, components: int) -> Whitening | None:
    """The whitening of rows (x), from each distinct x once; None where nothing varies."""
    fit = written(rows.select("x").distinct())
    first = rows.select(F.size("x").alias("dim")).first()
    if first is None or not first.dim:
        return None
    dim = first.dim
    place = fit.select(F.posexplode("x").alias("at", "c"))
    sums = {r["at"]: r for r in place.groupBy("at").agg(F.count("*").alias("n"), F.sum(F.col("c").cast("decimal(38,0)")).alias("s"), F.max(F.abs("c")).alias("most")).collect()}  # a row for each component
    n = sums[0].n
    totals = np.array([int(sums[j].s) for j in range(dim)], object)
    most = max(n * int(sums[j].most) + abs(int(sums[j].s)) for j in range(dim))
    found = Whitening(n, dim, totals, np.zeros(0), np.zeros((dim, 0)), 0.0, wide=dim * most * most >= 1 << 62)
    r = triangle(fit, found) / np.sqrt(n)
    values, vectors = directions(r, components)
    real = values > EPS**2 * n * max(values[0], 0) if len(values) else np.zeros(0, bool)
    if not real.any():
        return None
    found.values, found.vectors, found.trace = values[real], vectors[:, real], float((r**2).sum())
    found.identity_error = identity_error(fit, found)
    return found


def whitened(embeddings: DataFrame, components: int = 4, factor: int = 256) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for each row and component.

    Components become x = floor(factor * c). Directions, n and covariances are those of the distinct x, each once, divisor n.
    Rows whose vector is null or holds null or non-finite components are dropped; null and repeated ids stay; shorter vectors count as
    followed by zeros; other columns are ignored. Directions without variance have no rows, so an empty table, or one of
    equal vectors, gives an empty result. A component or deviation that exceeds a long is an error.
    """
    spark = embeddings.sparkSession
    id_type = dict(embeddings.dtypes)["vec_id"]
    rows = whole_rows(embeddings, factor)
    found = fit_whitening(rows, components)
    schema = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if found is None:
        return spark.createDataFrame([], schema)
    held = spark.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        k = len(w.values)
        for batch in batches:
            x = longs(batch.column(1), w.dim)
            rows = np.repeat(np.arange(len(x)), k)
            part = np.tile(np.arange(k), len(x))
            columns = [batch.column(0).take(pa.array(rows)), pa.array((part + 1).astype(np.int32)), pa.array(np.full(len(rows), w.n)), pa.array(w.deviation(x)[rows]), pa.array(w.project(x).ravel()), pa.array((w.values / w.trace)[part]), pa.array(np.full(len(rows), w.identity_error))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
