"""Whitening of embeddings by cyclic Jacobi rotations.

Three passes over the vectors: exact sums, the scatter of the vectors centred on the exact
mean, and the projection. A task adds up what it has read and passes one row for each
dimension or pair of dimensions on, so shuffles and the driver see d * d numbers, whatever the
number of vectors. The driver turns the covariance diagonal: sweeps meet every pair of
dimensions once, d / 2 disjoint pairs at a time, and end when each off-diagonal entry is below
the rounding of its own two diagonal ones, which keeps small eigenvalues accurate and not just
the large ones. The whitening matrix is broadcast.

Cases: rows without a vector, or with null or non-finite entries, are dropped; an empty table
gives no rows; a null id stays null; equal and repeated rows each count; vectors of different
lengths are lists of their own, each fitted by itself (empty ones have no component and so no
row); a component without variance (all vectors equal, or fewer vectors than dimensions)
whitens to 0 and is left out of ``identity_error``; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .vectors import by_length, usable, whole

OFFSET = 100_000
#: 1024 c stays below 2^52, so that the sum of two such numbers is exact.
MOST = float(1 << 52)


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of a symmetric matrix. A column's
    entry of largest size is positive."""
    a = np.array(matrix, float)
    d = len(a)
    v = np.eye(d)
    ring = np.arange(d + d % 2)  # the players of a round robin; the last one of an odd number rests
    tiny = np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            half = len(ring) // 2
            p, q = np.minimum(ring[:half], ring[: half - 1 : -1]), np.maximum(ring[:half], ring[: half - 1 : -1])
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
            p, q = p[q < d], q[q < d]
            off, app, aqq = a[p, q], a[p, p], a[q, q]
            turn = np.abs(off) > tiny * np.sqrt(np.abs(app * aqq))
            if not turn.any():
                continue
            turned = True
            p, q, off, app, aqq = p[turn], q[turn], off[turn], app[turn], aqq[turn]
            theta = (aqq - app) / (2 * off)
            t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(theta, 1))
            c = 1 / np.hypot(t, 1)
            s = t * c
            rows_p, rows_q = a[p].copy(), a[q].copy()
            a[p], a[q] = c[:, None] * rows_p - s[:, None] * rows_q, s[:, None] * rows_p + c[:, None] * rows_q
            cols_p, cols_q = a[:, p].copy(), a[:, q].copy()
            a[:, p], a[:, q] = c * cols_p - s * cols_q, s * cols_p + c * cols_q
            a[p, p], a[q, q] = app - t * off, aqq + t * off
            a[p, q] = a[q, p] = 0.0
            own_p, own_q = v[:, p].copy(), v[:, q].copy()
            v[:, p], v[:, q] = c * own_p - s * own_q, s * own_p + c * own_q
        if not turned:
            break
    else:
        raise ArithmeticError(f"off-diagonals did not vanish in {sweeps} sweeps")
    order = np.argsort(-np.diag(a), kind="stable")
    v = v[:, order]
    return np.diag(a)[order], v * np.where(np.take_along_axis(v, np.abs(v).argmax(axis=0)[None, :], 0) < 0, -1.0, 1.0)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(length, at, total) of a task; at -1 stands the number of vectors."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for rows, values in by_length(batch.column(0)):
            x = np.append(whole(values, MOST) + OFFSET, np.ones((len(rows), 1), np.int64), axis=1)
            d = values.shape[1]
            part = np.array([sum(c) for c in x.T.tolist()], object) if np.abs(x).max() > 1 << 40 else x.sum(axis=0).astype(object)
            total[d] = total.get(d, 0) + part
    out = [(d, k if k < d else -1, Decimal(int(t))) for d, own in total.items() for k, t in enumerate(own)]
    cols = list(zip(*out, strict=True)) or [(), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.decimal128(38, 0)), strict=True)], names=["length", "at", "total"])


def _centred(values: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: 64-bit numbers where they fit, Python's otherwise."""
    x = whole(values, MOST) + OFFSET
    if max(abs(int(x.max())), abs(int(x.min()))) * n < 1 << 61 and max(map(abs, sums)) < 1 << 61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _scatter(shared):  # type: ignore[no-untyped-def]
    """(length, i, j, total), i <= j: sums of products of the centred vectors of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits, total = shared.value, {}
        for batch in batches:
            for _, values in by_length(batch.column(0)):
                d = values.shape[1]
                n, sums = fits[d]
                z = (_centred(values, n, sums) / n).astype(float)
                total[d] = total.get(d, 0) + z.T @ z
        for d, own in total.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(own[i, j])], names=["length", "i", "j", "total"])

    return run


def _project(shared):  # type: ignore[no-untyped-def]
    """Of rows (vec_id, v): (vec_id, length, deviation, w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits = shared.value
        for batch in batches:
            for rows, values in by_length(batch.column(1)):
                d = values.shape[1]
                n, sums, matrix = fits[d]
                far = _centred(values, n, sums)
                if far.dtype != object and int(np.abs(far).max()) ** 2 * d >= 1 << 62:
                    far = far.astype(object)
                deviation = [Decimal(int(x)) for x in (far * far).sum(axis=1)]
                w = (far / n).astype(float) @ matrix
                lists = pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32), w.ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), d, np.int32)), pa.array(deviation, pa.decimal128(38, 0)), lists], names=["vec_id", "length", "deviation", "w"])

    return run


def fitted(spark, vectors: DataFrame):  # type: ignore[no-untyped-def]
    """{length: (n, sums, eigenvalues, eigenvectors)} of vectors (vec_id, v)."""
    only = vectors.select("v")
    sums = only.mapInArrow(_sums, "length int, at int, total decimal(38,0)").groupBy("length", "at").agg(F.sum("total").alias("total")).collect()
    found: dict[int, dict[int, int]] = {}
    for r in sums:
        found.setdefault(r["length"], {})[r["at"]] = int(r["total"])
    means = {d: (own[-1], [own[k] for k in range(d)]) for d, own in found.items()}
    shared = spark.sparkContext.broadcast(means)
    scatter = {d: np.zeros((d, d)) for d in means}
    for r in only.mapInArrow(_scatter(shared), "length int, i int, j int, total double").groupBy("length", "i", "j").agg(F.sum("total").alias("total")).collect():
        scatter[r["length"]][[r["i"], r["j"]], [r["j"], r["i"]]] = r["total"]
    return {d: (n, own, *jacobi(scatter[d] / n)) for d, (n, own) in means.items()}


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector and each of its first ``components`` components: (vec_id, length,
    component, n, deviation decimal, whitened, eigenvalue, explained, identity_error). The
    driver holds d * d numbers for each length d of vectors."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col).where(F.size("v") > 0)
    fits = fitted(spark, rows)
    matrices, facts = {}, []
    for d, (n, sums, values, axes) in fits.items():
        trace, k = float(values.sum()), min(components, d)
        some = values[:k] > max(float(values[0]), 0) * np.finfo(float).eps * d
        matrices[d] = (n, sums, np.where(some, axes[:, :k] / np.sqrt(np.where(some, values[:k], 1)), 0.0))
        facts += [(d, c + 1, n, float(values[c]), float(values[c] / trace) if trace > 0 else 0.0, bool(some[c])) for c in range(k)]
    shared = spark.sparkContext.broadcast(matrices)
    white = materialize(rows.mapInArrow(_project(shared), "vec_id long, length int, deviation decimal(38,0), w array<double>"), "whitened")
    # The covariance of what has been written, centred on its own mean before multiplying
    means = {r["length"]: list(r)[1:] for r in white.groupBy("length").agg(*(F.avg(F.get("w", F.lit(c))).alias(f"m{c}") for c in range(components))).collect()}
    live = {(d, c - 1) for d, c, *_, some in facts if some}
    error = dict.fromkeys(fits, 0.0)
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    for d, own in means.items():  # one number for each length; embeddings of a table have one
        away = [F.get("w", F.lit(c)) - F.lit(own[c]) for c in range(min(components, d))]
        seen = [(i, j) for i, j in pairs if {(d, i), (d, j)} <= live]
        if seen:
            cov = white.where(F.col("length") == d).agg(*(F.avg(away[i] * away[j]).alias(f"c{i}_{j}") for i, j in seen)).first()
            error[d] = max(abs(cov[f"c{i}_{j}"] - (i == j)) for i, j in seen)
    facts = spark.createDataFrame([(d, c, n, e, x, error[d]) for d, c, n, e, x, _ in facts], "length int, component int, n long, eigenvalue double, explained double, identity_error double")
    each = white.select("vec_id", "length", "deviation", F.posexplode("w").alias("at", "whitened")).withColumn("component", F.col("at") + 1)
    return each.join(F.broadcast(facts), ["length", "component"]).select("vec_id", "length", "component", "n", "deviation", "whitened", "eigenvalue", "explained", "identity_error")
