"""Whitening of vectors: blockwise QR of the centred rows, then a bidiagonal qd solver for the small triangle."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disclens.sources.staging import stage

VECTOR, SCALED = "embedding", "x"
SCALE = 256
COMPONENTS = 4
FAN_IN = 32
BLOCK_ROWS = 4_096
EPS = float(np.finfo(float).eps)
#: Eigenvalues closer than this, relatively, are parted by inverse iteration as well.
CLOSE = 1e-4
EXACT = 1 << 62


# -- the small triangle ------------------------------------------------------


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(diagonal, above, right)`` of an upper bidiagonal ``left.T @ r @ right``, by Householder reflections from both sides."""
    a = np.array(r, float)
    n = len(a)
    right = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        most = np.abs(x).max(initial=0.0)
        if most == 0 or not np.any(x[1:]):
            return None
        v = x / most
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        return v / np.linalg.norm(v)

    for k in range(n):
        v = reflector(a[k:, k].copy())
        if v is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        v = reflector(a[k, k + 1 :].copy()) if k + 2 < n else None
        if v is not None:
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
            right[:, k + 1 :] -= 2 * np.outer(right[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _qd_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One differential qd transform with a shift; None where the shift lies above the least eigenvalue."""
    d = q[0] - shift
    over, off = [], []
    for k in range(len(e)):
        if d < 0:
            return None
        top = d + e[k]
        ratio = q[k + 1] / top if top > 0 else 1.0
        over.append(top)
        off.append(e[k] * ratio)
        d = d * ratio - shift
    if d < 0:
        return None
    return [*over, d], off


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal, falling, each to high relative accuracy, by shifted dqds.

    A segment is cut where an off-diagonal is negligible, turned where its
    small end is in front, and shifted by what its last two rows promise; a
    shift that turns out too large is cut down, at last to none.
    """
    found: list[float] = []
    todo = [((np.asarray(diagonal, float) ** 2).tolist(), (np.asarray(above, float) ** 2).tolist(), 0.0)]
    while todo:
        q, e, base = todo.pop()
        tries = 0
        while len(q) > 1:
            cut = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= EPS * EPS * (base + min(q[k], q[k + 1])) or e[k] < 1e-290), None)
            if cut is not None:
                if cut + 1 == len(e):
                    found.append(q.pop() + base)
                    e.pop()
                else:
                    todo.append((q[cut + 1 :], e[cut + 1 :], base))
                    q, e = q[: cut + 1], e[:cut]
                tries = 0
                continue
            if q[0] < q[-1]:
                q.reverse()
                e.reverse()
            # The least eigenvalue of the last two rows, taken a little short.
            a, b, c = q[-2], e[-1], q[-1]
            whole = a + b + c
            least = 2 * a * c / (whole + np.sqrt(max(whole * whole - 4 * a * c, 0.0))) if whole > 0 else 0.0
            shift = float(least) * (1 - 1e-3) / 4**tries if tries < 4 else 0.0
            moved = _qd_step(q, e, shift) if shift > base * EPS else None
            if moved is None and shift > base * EPS:
                tries += 1
                continue
            if moved is None:
                moved, shift = _qd_step(q, e, 0.0), 0.0
            (q, e), base, tries = moved, base + shift, 0
        found += [x + base for x in q]
    return np.sort(np.array(found))[::-1]


def _twisted(diagonal: np.ndarray, above: np.ndarray, value: float, start: np.ndarray | None = None) -> np.ndarray:
    """The unit eigenvector of ``B.T @ B`` at ``value``, by a twisted factorisation; with a start, one step of inverse iteration from it."""
    n = len(diagonal)
    q, off = diagonal**2, diagonal[:-1] * above
    tiny = EPS * EPS * max(value, float(q.max(initial=0.0)), 1e-280)
    down, up = np.empty(n), np.empty(n)  # the pivots from above, from below
    s, p = np.empty(n), np.empty(n)
    lower, upper = np.empty(max(n - 1, 0)), np.empty(max(n - 1, 0))
    s[0] = -value
    for k in range(n - 1):
        down[k] = s[k] + q[k]
        if abs(down[k]) < tiny:
            down[k] = -tiny
        lower[k] = off[k] / down[k]
        s[k + 1] = above[k] ** 2 * (s[k] / down[k]) - value
    down[n - 1] = s[n - 1] + q[n - 1]
    p[n - 1] = q[n - 1] - value
    for k in range(n - 2, -1, -1):
        up[k + 1] = above[k] ** 2 + p[k + 1]
        if abs(up[k + 1]) < tiny:
            up[k + 1] = -tiny
        upper[k] = off[k] / up[k + 1]
        p[k] = p[k + 1] * (q[k] / up[k + 1]) - value
    if start is None:
        twist = int(np.argmin(np.abs(s + p + value)))
        z = np.zeros(n)
        z[twist] = 1.0
        for k in range(twist - 1, -1, -1):
            z[k] = -lower[k] * z[k + 1]
        for k in range(twist, n - 1):
            z[k + 1] = -upper[k] * z[k]
        return z / np.linalg.norm(z)
    z = start.copy()
    for k in range(n - 1):
        z[k + 1] -= lower[k] * z[k]
    pivots = np.where(np.abs(down) < tiny, tiny, down)
    z /= pivots
    for k in range(n - 2, -1, -1):
        z[k] -= lower[k] * z[k + 1]
    return z / np.linalg.norm(z)


def right_vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Orthonormal right singular vectors, in columns, of an upper bidiagonal at its first squared singular values.

    The bidiagonal is cut into unreduced segments, whose vectors are apart by
    their places. Within a segment, values that hardly differ are gone through
    in order, each vector iterated against those before it.
    """
    n, scale = len(diagonal), float(max(np.abs(diagonal).max(initial=0), np.abs(above).max(initial=0)))
    cuts = [k + 1 for k in range(n - 1) if abs(above[k]) <= EPS * scale / 8]
    held: list[tuple[float, int, int]] = []
    for lo, hi in zip([0, *cuts], [*cuts, n]):
        held += [(float(v), lo, hi) for v in squared_singular_values(diagonal[lo:hi], above[lo : hi - 1])]
    held.sort(key=lambda h: (-h[0], h[1]))
    out = np.zeros((n, len(values)))
    for k, (value, lo, hi) in enumerate(held[: len(values)]):
        d, e = diagonal[lo:hi], above[lo : hi - 1]
        z = _twisted(d, e, value)
        near = [m for m in range(k) if held[m][1] == lo and held[m][0] - value <= CLOSE * held[m][0]]
        for round_ in range(4 if near else 0):
            before = out[lo:hi, near]
            z = z - before @ (before.T @ z)
            if np.linalg.norm(z) < 0.1:
                z = np.cos(np.arange(1, hi - lo + 1) * (k + 1.0 + round_))
                z -= before @ (before.T @ z)
            z = _twisted(d, e, value * (1 + EPS * (4 + k)), z / np.linalg.norm(z))
        if near:
            for _ in range(2):
                z -= out[lo:hi, near] @ (out[lo:hi, near].T @ z)
            z /= np.linalg.norm(z)
        out[lo:hi, k] = z
    return out


@dataclass(frozen=True)
class Whitening:
    """What was fitted: rows, their sums by dimension, and the directions (in columns) with their variances."""

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray
    variances: np.ndarray
    total: float


# -- the rows ----------------------------------------------------------------


def scaled_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """The rows whose vector is whole, with it in whole numbers: ``x = floor(scale * entry)``."""
    whole = F.col(VECTOR).isNotNull() & ~F.exists(
        VECTOR, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    )
    x = F.transform(VECTOR, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    rows = vectors.where(F.coalesce(whole, F.lit(False)) & (F.size(VECTOR) > 0))
    return rows.select("vec_id", x.alias(SCALED))


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(lo, BLOCK_ROWS)
            x = part.column(part.schema.get_field_index(SCALED))
            yield part, x.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> pa.Array:
    """Per row, the sum over dimensions of ``(n * x - sums) ** 2``, exact."""
    most = n * int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) + max(map(abs, sums), default=0)
    if len(sums) * most * most < EXACT:
        off = n * x - np.array(sums, np.int64)
        return pa.array((off * off).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0))
    off = x.astype(object) * n - np.array(sums, object)
    exact = [int(v) for v in (off * off).sum(axis=1)]
    return pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    whole = [s // n for s in sums]
    rest = np.array([(s - n * w) / n for s, w in zip(sums, whole)])
    return (x - np.array(whole, np.int64)).astype(float) - rest


def _totals(fit: DataFrame, width: int) -> tuple[int, tuple[int, ...]]:
    """Rows, and the exact sum of each dimension; a row of sums for each part of the table meets per dimension."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for _, x in _matrices(batches, width):
            n += len(x)
            safe = int(np.abs(x.astype(float)).max(initial=0)) < 2**50
            part = x.sum(axis=0) if safe else x.astype(object).sum(axis=0)
            total = [t + int(v) for t, v in zip(total, part)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int32()), pa.array(map(Decimal, total), pa.decimal128(38, 0)), pa.array([n] * width, pa.int64())],
            names=["dimension", "total", "n"],
        )

    found = (
        fit.mapInArrow(sums, "dimension int, total decimal(38,0), n long")
        .groupBy("dimension")
        .agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        .orderBy("dimension")
        .collect()
    )
    return (int(found[0].n), tuple(int(r.total) for r in found)) if found else (0, (0,) * width)


def _triangle(fit: DataFrame, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """R of the QR of all centred rows: of the rows of each part in blocks, then of ``FAN_IN`` triangles at a time until one is left."""
    width = len(sums)

    def packed(node: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["node", "r"])

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for _, x in _matrices(batches, width):
            r = np.linalg.qr(np.vstack([r, _centred(x, n, sums)]), mode="r")
        if len(r):
            yield packed(TaskContext.get().partitionId(), r)

    def of_triangles(key: tuple, triangles: pa.Table) -> pa.Table:
        r = np.zeros((0, width))
        for own in triangles.sort_by("node")["r"].to_pylist():
            r = np.linalg.qr(np.vstack([r, np.frombuffer(own).reshape(-1, width)]), mode="r")
        return pa.Table.from_batches([packed(key[0].as_py(), r)])

    level = stage(fit.mapInArrow(of_rows, "node long, r binary"))
    while level.agg(F.count(F.lit(1))).first()[0] > 1:
        parents = F.floor(F.col("node") / FAN_IN).alias("parent")
        level = stage(level.groupBy(parents).applyInArrow(of_triangles, "node long, r binary"))
    r = np.frombuffer(level.first().r).reshape(-1, width)
    return np.vstack([r, np.zeros((width - len(r), width))])


def fit_whitening(fit: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """The directions of largest variance of ``fit(x)``, rows of whole numbers, and their variances; divisor n."""
    n, sums = _totals(fit, width)
    if n == 0:
        return Whitening(0, sums, np.zeros((width, 0)), np.zeros(0), 0.0)
    r = _triangle(fit, n, sums)
    diagonal, above, right = bidiagonal(r)
    variances = squared_singular_values(diagonal, above) / n
    directions = right @ right_vectors(diagonal, above, variances[:components])
    return Whitening(n, sums, directions, variances[:components], float(variances.sum()))


def _projected(rows: DataFrame, fitted: Whitening, key: bool) -> DataFrame:
    """Each row's whitened figures, null along a direction without variance; with its id and deviation where asked for."""
    n, sums, width = fitted.n, fitted.sums, len(fitted.sums)
    count = len(fitted.variances)
    room = fitted.total * width * EPS
    spread = [float(v) if v > room else None for v in fitted.variances]
    turned = fitted.directions / np.array([np.sqrt(v) if v else 1.0 for v in spread])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, width):
            z = _centred(x, n, sums) @ turned
            figures = [pa.array(z[:, k], pa.float64()) if spread[k] else pa.nulls(len(z), pa.float64()) for k in range(count)]
            own = [part.column(part.schema.get_field_index("vec_id")), _deviations(x, n, sums)] if key else []
            yield pa.RecordBatch.from_arrays([*own, *figures], names=[*(["vec_id", "deviation"] if key else []), *(f"z{k}" for k in range(count))])

    kind = dict(rows.dtypes).get("vec_id")
    head = f"vec_id {kind}, deviation decimal(38,0), " if key else ""
    return rows.mapInArrow(project, head + ", ".join(f"z{k} double" for k in range(count)))


def _identity_error(fit: DataFrame, fitted: Whitening) -> float | None:
    """Largest absolute entry of the covariance of the whitened rows minus the identity, over directions with variance."""
    count = len(fitted.variances)
    pairs = [(a, b) for a in range(count) for b in range(a, count)]
    sums = _projected(fit, fitted, key=False).agg(*[F.covar_pop(f"z{a}", f"z{b}") for a, b in pairs]).first()
    errors = [abs(v - (a == b)) for (a, b), v in zip(pairs, sums) if v is not None]
    return max(errors, default=None)


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Vectors along the directions of their largest variances, each direction brought to variance 1.

    The purchase-history records hold no vectors, so this is general:
    ``vectors(vec_id, embedding)``, other columns ignored. Rows whose vector is
    missing, empty, or holds a missing or non-finite entry are left out. Entries
    become whole numbers, ``x = floor(scale * entry)``; the fit is over the
    distinct x, so copies weigh nothing more.

    Returns, for each row and component (at most ``components``, and at most the
    dimensions), ``(vec_id, component, n, deviation, whitened, explained,
    identity_error)``: the component from 1 by falling variance, the distinct
    vectors, the exact ``sum((n * x - sums) ** 2)`` as a decimal, the centred
    row along the component over its standard deviation, the component's share
    of the total variance, and how far the covariance of all whitened
    components is from the identity.

    Vectors of the most frequent dimension (of the larger on ties) are a space;
    others do not fit in and are left out. A direction without variance has no
    whitened figure, and with no variance at all nothing is explained. Rows that
    repeat are returned each; an empty table gives no rows.

    What reaches the driver is bounded by the dimension d alone: d sums and one
    d x d triangle. Its Householder bidiagonal gives the variances by dqds and
    the directions by twisted factorisations.
    """
    if components < 1:
        raise ValueError("at least one component is asked for")
    rows = stage(scaled_vectors(vectors, scale))
    widths = rows.groupBy(F.size(SCALED).alias("width")).agg(F.count(F.lit(1)).alias("n"))
    common = widths.orderBy(F.desc("n"), F.desc("width")).first()
    width = common.width if common else 1
    rows = rows.where(F.size(SCALED) == width)
    fit = stage(rows.select(SCALED).distinct())
    fitted = fit_whitening(fit, width, components)
    count = len(fitted.variances)
    if fitted.n == 0:
        empty = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        nothing = [F.lit(None).cast(c.split()[-1]).alias(c.split()[0]) for c in empty.replace("(38,0)", "").split(", ")]
        return rows.select("vec_id", *nothing).withColumn("deviation", F.col("deviation").cast("decimal(38,0)")).where("false")
    share = [float(v / fitted.total) if fitted.total > 0 else None for v in fitted.variances]
    sides = F.array(
        *[
            F.struct(
                F.lit(k + 1).alias("component"),
                F.col(f"z{k}").alias("whitened"),
                F.lit(share[k]).cast("double").alias("explained"),
            )
            for k in range(count)
        ]
    )
    error = _identity_error(fit, fitted)
    return (
        _projected(rows, fitted, key=True)
        .select("vec_id", "deviation", F.explode(sides).alias("side"))
        .select(
            "vec_id",
            "side.component",
            F.lit(fitted.n).cast("long").alias("n"),
            "deviation",
            "side.whitened",
            "side.explained",
            F.lit(error).cast("double").alias("identity_error"),
        )
    )
