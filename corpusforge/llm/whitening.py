"""Operator 12: whitening directions of embeddings through QR, bidiagonal form, dqds and twisted factorisations.

Vectors become whole numbers first (x = floor(scale * c) + shift), so their sums
and deviations are exact. Each task centres its rows and folds them, block after
block, into one upper triangle R (QR of R over the next block); the triangles of
the tasks are folded in groups of 32 until one is left. That R has d x d
entries whatever the number of rows, and R'R / n is the covariance; it is never
formed. Householder reflections turn R into a bidiagonal B, dqds finds the
squares of its singular values to high relative accuracy, and the twisted
factorisation of B'B - lambda (stationary from the top, progressive from the
bottom, joined where their defect is least) gives each singular vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm.tables import Scratch

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
#: rows of one QR step; triangles folded at a time
BLOCK, FOLD = 2048, 32
_EPS = np.finfo(float).eps


# ---- d x d work: the triangle of the corpus, not its rows ------------------


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, w) with r = u B w' for orthogonal u and w, by Householder reflections."""
    a, n = r.astype(float).copy(), r.shape[1]
    w = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.linalg.norm(x)
        if size == 0 or not np.any(x[1:]):
            return None
        v = x.copy()
        v[0] += np.copysign(size, x[0])
        return v / np.linalg.norm(v)

    for k in range(n):
        if (v := reflector(a[k:, k])) is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < n - 2 and (v := reflector(a[k, k + 1 :])) is not None:
            a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
            w[:, k + 1 :] -= 2 * np.outer(w[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), w


def _dqds_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One differential quotient-difference step with a shift; the third list is d, all of it >= 0 in a valid step."""
    d = q[0] - shift
    out_q, out_e, seen = [], [], [d]
    for i in range(len(e)):
        t = d + e[i]
        out_q.append(t)
        ratio = q[i + 1] / t if t else np.inf
        out_e.append(e[i] * ratio if e[i] else 0.0)
        d = d * ratio - shift if t else q[i + 1] - shift
        seen.append(d)
    out_q.append(d)
    return out_q, out_e, seen


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, falling.

    A value is taken off the bottom once its coupling is negligible. Shifts
    come from the last d, which is never below the smallest value; a step that
    goes negative is done again with a smaller shift, at last with none.
    """
    q, e = [float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in above]
    floor = (max([*q, *e, 0.0]) * _EPS**2) or 1e-300
    q = [max(x, floor * _EPS) for x in q]
    values: list[float] = []
    todo = [(q, e, 0.0)]  # blocks with the shift they carry
    while todo:
        q, e, carried = todo.pop()
        guess, rounds = 0.0, 0
        while len(q) > 1:
            # to leave out e[i] moves values by e[i] + sqrt(q[i] e[i]) at most
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] + (q[i] * e[i]) ** 0.5 <= _EPS * 0.25 * (carried + q[i + 1])), None)
            if cut is not None:
                if cut < len(e) - 1:
                    todo.append((q[: cut + 1], e[:cut], carried))
                    q, e = q[cut + 1 :], e[cut + 1 :]
                else:
                    values.append(q.pop() + carried)
                    e.pop()
                guess = min(guess, min(q))
                continue
            if rounds > 1000 + 40 * len(q):
                raise ArithmeticError("dqds did not converge")
            shift = guess
            for attempt in range(4):
                new_q, new_e, d = _dqds_step(q, e, shift)
                if min(d) >= 0:
                    break
                late = min(d[:-1]) >= 0  # only the last is negative: shift + d is a close lower bound
                shift = max(shift + d[-1], 0.0) if late and attempt == 0 else shift / 4 if attempt < 2 else 0.0
            q, e, carried = new_q, new_e, carried + shift
            guess = max(min(d), 0.0)
            if guess != d[-1]:
                guess *= 0.5
            rounds += 1
        values.append(q[0] + carried)
    return np.sort(np.array(values))[::-1]


def _factors(q: np.ndarray, ld: np.ndarray, lam: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of L D L' - lam: multipliers from the top and from the bottom, the pivots from the top, the defects of each twist.

    ``q`` is D, ``ld`` the off-diagonal divided by D (L).
    """
    n = len(q)
    tiny = _EPS * max(float(q.max()), 1e-300) * _EPS
    s, p = np.empty(n), np.empty(n)
    up, down, pivots = np.empty(max(n - 1, 0)), np.empty(max(n - 1, 0)), np.empty(n)
    s[0] = -lam
    for i in range(n):
        pivots[i] = (s[i] + q[i]) or -tiny
        if i < n - 1:
            up[i] = q[i] * ld[i] / pivots[i]
            s[i + 1] = up[i] * ld[i] * s[i] - lam
    p[n - 1] = q[n - 1] - lam
    for i in range(n - 2, -1, -1):
        pivot = (q[i] * ld[i] ** 2 + p[i + 1]) or -tiny
        t = q[i] / pivot
        down[i] = ld[i] * t
        p[i] = p[i + 1] * t - lam
    return up, down, pivots, s + p + lam


def _twisted(q: np.ndarray, ld: np.ndarray, lam: float) -> np.ndarray:
    up, down, _, defect = _factors(q, ld, lam)
    k = int(np.argmin(np.abs(defect)))
    z = np.zeros(len(q))
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -up[i] * z[i + 1]
    for i in range(k, len(q) - 1):
        z[i + 1] = -down[i] * z[i]
    return z / np.linalg.norm(z)


def _apart(q: np.ndarray, ld: np.ndarray, lam: float, others: list[np.ndarray], seed: int) -> np.ndarray:
    """A vector of a value that others lie close to: inverse iteration from the twisted vector (or a fixed random one),
    held orthogonal to theirs. The solves pivot, as the twisted factors of such values grow without bound."""
    n = len(q)
    t = np.diag(q + np.concatenate([[0.0], q[:-1] * ld**2])) + np.diag(q[:-1] * ld, 1) + np.diag(q[:-1] * ld, -1)
    t -= lam * (1 + 4 * _EPS) * np.eye(n)
    t[np.diag_indices(n)] += np.where(np.abs(t).sum(axis=1) == 0, _EPS * lam, 0.0)
    z = np.random.default_rng(seed).standard_normal(n) if others else _twisted(q, ld, lam)

    def freed(z: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for o in others:
                z = z - (o @ z) * o
        return z / np.linalg.norm(z)

    z = freed(z)
    for _ in range(3):
        try:
            z = freed(np.linalg.solve(t, z))
        except np.linalg.LinAlgError:  # exactly singular: move the shift a little
            t -= 8 * _EPS * lam * np.eye(n)
    return z


def bidiagonal_vectors(diagonal: np.ndarray, above: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest squared singular values, falling, and their right singular vectors as columns.

    Where a coupling is negligible the matrix falls apart and each part is
    solved alone. Values closer than 1e-3 of their size are one cluster.
    """
    n = len(diagonal)
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    ends = [i + 1 for i in range(n - 1) if abs(above[i]) <= 8 * _EPS * scale] + [n]
    found: list[tuple[float, int, np.ndarray]] = []
    start = 0
    for end in ends:
        a, b = diagonal[start:end].astype(float), above[start : end - 1].astype(float)
        a = np.where(np.abs(a) < _EPS * scale * _EPS, _EPS * scale * _EPS or 1e-300, a)
        q, ld = a * a, b / a[:-1]
        cluster: list[np.ndarray] = []
        last = None
        values = dqds(a, b)
        for i, lam in enumerate(values[:k]):
            if last is None or last - lam > 1e-3 * last:
                cluster = []
            close = bool(cluster) or (i + 1 < len(values) and lam - values[i + 1] <= 1e-3 * lam)
            z = _apart(q, ld, lam, cluster, i) if close else _twisted(q, ld, lam)
            cluster, last = [*cluster, z], lam
            whole = np.zeros(n)
            whole[start:end] = z
            found.append((lam, len(found), whole))
        start = end
    found.sort(key=lambda x: (-x[0], x[1]))
    return np.array([x[0] for x in found[:k]]), np.array([x[2] for x in found[:k]]).T.reshape(n, -1)


def whitening_directions(r: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, unit eigenvectors as columns, trace) of R'R / n for up to ``k`` directions.

    Directions without variance (a singular value at rounding level) are left
    out. The largest entry of a direction is positive.
    """
    if not np.any(r):
        return np.zeros(0), np.zeros((r.shape[1], 0)), 0.0
    diagonal, above, w = bidiagonal(r)
    values, z = bidiagonal_vectors(diagonal, above, k)
    trace = float((r * r).sum()) / n
    keep = values > (values[0] if len(values) else 0) * (_EPS * max(r.shape)) ** 2
    values, v = values[keep] / n, (w @ z)[:, keep]
    for j in range(v.shape[1]):
        v[:, j] *= np.sign(v[np.argmax(np.abs(v[:, j])), j])
    return values, v, trace


# ---- rows: Spark tasks -----------------------------------------------------


def _whole(col: pa.ChunkedArray | pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places of usable vectors, their whole numbers) of a list column; with ``dim`` None only one length may occur."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    lengths = np.array(col.value_lengths().fill_null(-1))
    at = np.flatnonzero(lengths == dim)
    taken = col.take(pa.array(at))
    c = np.array(taken.flatten().cast(pa.float64()).fill_null(np.nan), dtype=float).reshape(len(at), dim)
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(c * SCALE)
        fine = (np.isfinite(x) & (np.abs(x) < 2.0**62)).all(axis=1)
    return at[fine], x[fine].astype(np.int64) + SHIFT


def _usable(vector: Column) -> Column:
    """True for a vector without null or non-finite entries (or entries too large for a long)."""
    return F.coalesce(F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double") * SCALE) < 2.0**62, F.lit(False))), F.lit(False))


def fit_whitening(spark: SparkSession, vectors: DataFrame, vector: str, k: int, scratch: Scratch) -> dict | None:
    """n, dim, sums S, directions, eigenvalues and trace over all usable rows; None without any.

    Sums come back as one row per dimension; triangles are folded in the
    cluster, and one d x d triangle reaches the driver.
    """
    usable = vectors.where(_usable(F.col(vector))).select(F.col(vector).cast("array<double>").alias("v"))
    # rows per length: the commonest length is that of the table (the longer one of equals)
    lengths = usable.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not lengths:
        return None
    dim, n = int(lengths[0]["dim"]), int(lengths[0]["n"])
    if dim == 0:
        return None

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            _, x = _whole(batch.column(0), dim)
            part = x.sum(axis=0, dtype=np.int64)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(total, pa.int64())], ["i", "s"])

    rows = usable.mapInArrow(sums, "i int, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    s = [0] * dim
    for row in rows:
        s[row["i"]] = int(row["s"])
    mean, rest = np.array([v // n for v in s], dtype=np.int64), np.array([v % n for v in s], dtype=float)
    shift = rest / n  # x - S/n as (x - whole part) - fraction: no digits are lost

    def triangle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dim))
        for batch in batches:
            _, x = _whole(batch.column(0), dim)
            for a in range(0, len(x), BLOCK):
                y = (x[a : a + BLOCK] - mean).astype(float) - shift
                r = np.linalg.qr(np.vstack([r, y]), mode="r")
        if len(r):
            from pyspark import TaskContext

            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], ["part", "r"]
            )

    def fold(key: tuple, table: pa.Table) -> pa.Table:
        r = np.zeros((0, dim))
        for part in table.sort_by("part").column("r").to_pylist():
            r = np.linalg.qr(np.vstack([r, np.array(part).reshape(-1, dim)]), mode="r")
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "r": pa.array([r.ravel().tolist()], pa.list_(pa.float64()))})

    # a task's triangle is stored, so that a lost executor costs its tasks alone
    parts = scratch.keep(usable.mapInArrow(triangle, "part long, r array<double>"), "triangles")
    width = parts.agg(F.max("part")).first()[0]
    level = 0
    while width > 0:
        level, width = level + 1, width // FOLD
        folded = parts.withColumn("part", F.expr(f"part div {FOLD}")).groupBy("part").applyInArrow(fold, "part long, r array<double>")
        after = scratch.keep(folded, f"triangles{level}")
        scratch.drop(parts)
        parts = after
    r = np.array(parts.first()["r"]).reshape(-1, dim)
    if len(r) < dim:
        r = np.vstack([r, np.zeros((dim - len(r), dim))])
    values, directions, trace = whitening_directions(r, n, min(k, dim))
    return {"n": n, "dim": dim, "sums": s, "mean": mean, "shift": shift, "values": values, "directions": directions, "trace": trace}


def whiten(spark: SparkSession, vectors: DataFrame, vector: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component (1 to ``k``, by falling eigenvalue): component, n, deviation, whitened,
    explained and identity_error, beside the other columns of ``vectors``.

    Usable are rows whose vector has the table's length (the commonest one; the
    longer of equals) and no null or non-finite entry (nor one whose scaled
    value exceeds a long). Repeated rows and null ids count like others. The
    covariance is over all usable rows, divisor n. ``deviation`` is exact; null
    where it exceeds a long. A direction without variance has no rows, so one
    row alone, equal rows or an empty table give none. Columns of the added
    names are replaced.
    """
    scratch = Scratch(spark, "whiten")
    added = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    vectors = vectors.drop(*[c for c in added if c != vector])
    others = [f for f in vectors.schema.fields if f.name != vector]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in others], "component int, n long, deviation long, whitened double, explained double, identity_error double"])
    fit = fit_whitening(spark, vectors, vector, k, scratch)
    if fit is None or len(fit["values"]) == 0:
        return spark.createDataFrame([], schema)
    n, dim, sums, mean, shift = (fit[x] for x in ("n", "dim", "sums", "mean", "shift"))
    map_ = fit["directions"] / np.sqrt(fit["values"])
    count = map_.shape[1]
    # n*x - S = n * (x - mean) - rest, both exact in long while n * (largest entry) fits
    rest = [v % n for v in sums]
    rest_array = np.array(rest, dtype=np.int64)

    def deviations(x: np.ndarray) -> list[int | None]:
        y = x - mean
        bound = n * int(np.abs(y).max(initial=0)) + n
        if bound * bound * dim < 2**63:
            g = n * y - rest_array
            return (g * g).sum(axis=1).tolist()
        out = [sum((n * a - b) ** 2 for a, b in zip(row, rest)) for row in y.tolist()]
        return [v if v < 2**63 else None for v in out]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _whole(batch.column(batch.num_columns - 1), dim)
            y = (x - mean).astype(float) - shift
            kept = [batch.column(i).take(pa.array(at)) for i in range(len(others))]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(deviations(x), pa.int64()), pa.array((y @ map_).tolist(), pa.list_(pa.float64()))],
                [*[f.name for f in others], "__deviation", "__white"],
            )

    names = [f"`{f.name}`" for f in others]
    read = vectors.where(_usable(F.col(f"`{vector}`"))).select(*names, F.col(f"`{vector}`").cast("array<double>").alias("__v"))
    inner = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in others], "__deviation long, __white array<double>"])
    white = scratch.keep(read.mapInArrow(project, inner), "white")

    # covariance of what came out, against the identity; the values are centred, their means only rounding
    w = [F.col("__white")[i] for i in range(count)]
    means = [F.avg(w[i]).alias(f"m{i}") for i in range(count)]
    products = [F.avg(w[i] * w[j]).alias(f"p{i}_{j}") for i in range(count) for j in range(i, count)]
    got = white.agg(*means, *products).first()
    error = max(abs(got[f"p{i}_{j}"] - got[f"m{i}"] * got[f"m{j}"] - (i == j)) for i in range(count) for j in range(i, count))
    shares = F.array(*[F.lit(float(v / fit["trace"])) for v in fit["values"]])
    out = white.select(*names, "__deviation", F.posexplode("__white").alias("__i", "whitened"))
    return out.select(
        *names, (F.col("__i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), F.col("__deviation").alias("deviation"),
        "whitened", F.element_at(shares, F.col("__i") + 1).alias("explained"), F.lit(float(error)).alias("identity_error"),
    )
