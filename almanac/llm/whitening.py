"""Whitening by a one-sided Jacobi SVD of what a blockwise QR leaves of the centred rows.

Entries are whole numbers floor(1024 c), so sums are exact and a row is centred as (n x - S) / n with an exact
numerator (adding 100,000 to every entry changes no numerator). Each task folds its rows block by block into one triangle R (R'R is the sum of the rows'
outer products, which is never formed), and triangles of 64 tasks at a time are folded again, twice. Plane rotations then make R's columns orthogonal: their lengths over sqrt(n) are the
standard deviations, to high relative accuracy also for small ones, and the product of the rotations has the components.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.vectors import finite_vector, long_list, summed, whole

COMPONENTS = 8
#: Rows folded into a triangle at once, and triangles folded into one.
BLOCK, FAN = 2048, 64


def fold(*parts: np.ndarray) -> np.ndarray:
    """The square triangle R with R'R equal to the sum of the parts' own."""
    dim = parts[0].shape[1]
    r = np.linalg.qr(np.vstack(parts), mode="r")
    return r if len(r) == dim else np.vstack([r, np.zeros((dim - len(r), dim))])


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, v): r @ v has orthogonal columns of these lengths, in falling order, and v is orthogonal."""
    a, v = r.astype(np.float64).copy(), np.eye(r.shape[1])
    # Longest columns first: fewer sweeps, and small deviations keep their relative accuracy.
    order = np.argsort(-np.linalg.norm(a, axis=0), kind="stable")
    a, v, eps, dim = a[:, order], v[:, order], np.finfo(float).eps, r.shape[1]
    for _ in range(sweeps):
        turned = False
        for p in range(dim - 1):
            for q in range(p + 1, dim):
                pair = a[:, [p, q]]
                (x, cross), (_, y) = pair.T @ pair
                if abs(cross) <= 8 * eps * math.sqrt(x * y):
                    continue
                turned = True
                zeta = (y - x) / (2 * cross)
                t = math.copysign(1, zeta) / (abs(zeta) + math.hypot(1, zeta))
                c = 1 / math.hypot(1, t)
                turn = np.array([[c, c * t], [-c * t, c]])
                a[:, [p, q]] = pair @ turn
                v[:, [p, q]] = v[:, [p, q]] @ turn
        if not turned:
            break
    lengths = np.linalg.norm(a, axis=0)
    order = np.argsort(-lengths, kind="stable")
    return lengths[order], v[:, order]


def totals(df: DataFrame, vector: str, dim: int) -> tuple[int, list[int]]:
    """How many rows are whole, and the exact sums of their entries."""

    def make(batches):
        n, s = 0, np.zeros(dim, np.int64)
        for b in batches:
            _, m = whole(b.column(0), dim)
            n, s = n + len(m), s + m.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), long_list(s[None])], names=["n", "part"])

    got = df.select(vector).mapInArrow(make, "n long, part array<bigint>").agg(F.sum("n").alias("n"), summed("part", dim).alias("s")).first()
    n = got.n or 0
    return n, [int(v or 0) for v in got.s]


class Centre:
    """Takes whole entries to exact numerators n x - S, and to centred rows."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        # |n x - S| is under n times the span of 2 * LARGEST; beyond 2^62 the numerators are Python's own whole numbers.
        self.small = n * 2**29 < 2**62

    def numerators(self, m: np.ndarray) -> np.ndarray:
        return self.n * m - np.array(self.sums, np.int64) if self.small else self.n * m.astype(object) - np.array(self.sums, object)

    def rows(self, m: np.ndarray) -> np.ndarray:
        return self.numerators(m).astype(np.float64) / self.n


def triangle(df: DataFrame, vector: str, dim: int, centre: Centre) -> np.ndarray:
    """R of all centred rows: one triangle per task, then FAN of them to one, twice; the driver folds one for every FAN * FAN tasks."""

    def make(batches):
        from pyspark import TaskContext

        r = np.zeros((dim, dim))
        for b in batches:
            _, m = whole(b.column(0), dim)
            for at in range(0, len(m), BLOCK):
                r = fold(r, centre.rows(m[at : at + BLOCK]))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["task", "r"])

    def join(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("task")
        return pd.DataFrame({"task": [t["task"].iloc[0] // FAN], "r": [fold(*(np.frombuffer(x).reshape(dim, dim) for x in t["r"])).tobytes()]})

    parts = df.select(vector).mapInArrow(make, "task long, r binary")
    for _ in range(2):
        parts = parts.groupBy(F.expr(f"task div {FAN}")).applyInPandas(join, "task long, r binary")
    found = parts.collect()
    return fold(*(np.frombuffer(p.r).reshape(dim, dim) for p in found)) if found else np.zeros((dim, dim))


class Basis:
    """The components of a table of vectors: n, exact sums, falling eigenvalues, and projections that whiten.

    A component whose deviation is no more than rounding (dim * 2^-52 of the largest) has eigenvalue 0 and no whitened values.
    """

    def __init__(self, centre: Centre, lengths: np.ndarray, v: np.ndarray, most: int):
        k = min(most, len(lengths))
        self.centre, self.n = centre, centre.n
        deviations = lengths / math.sqrt(centre.n)
        flat = deviations <= len(lengths) * 2.0**-52 * (deviations[0] if len(deviations) else 0)
        deviations = np.where(flat, 0.0, deviations)
        self.values, self.trace = deviations[:k] ** 2, float((deviations**2).sum())
        self.project = np.where(flat[:k], np.nan, v[:, :k] / np.where(flat[:k], 1.0, deviations[:k]))
        self.explained = self.values / self.trace if self.trace else np.zeros(k)

    def whitened(self, m: np.ndarray) -> np.ndarray:
        return self.centre.rows(m) @ self.project


def fit(df: DataFrame, vector: str, dim: int, most: int = COMPONENTS) -> Basis | None:
    """Two passes over the rows: exact sums, then the triangle. None without any row."""
    n, sums = totals(df, vector, dim)
    if not n:
        return None
    centre = Centre(n, sums)
    return Basis(centre, *jacobi(triangle(df, vector, dim, centre)), most)


def identity_error(df: DataFrame, vector: str, dim: int, basis: Basis) -> float | None:
    """Largest entry of the whitened rows' covariance less the identity, over the components that vary; null if none does."""
    use = np.flatnonzero(basis.values > 0)
    k = len(use)
    if not k:
        return None

    def make(batches):
        s, c = np.zeros(k), np.zeros((k, k))
        for b in batches:
            _, m = whole(b.column(0), dim)
            for at in range(0, len(m), BLOCK):
                w = basis.whitened(m[at : at + BLOCK])[:, use]
                s, c = s + w.sum(axis=0), c + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([[*s, *c.ravel()]], pa.list_(pa.float64()))], names=["part"])

    made = df.select(vector).mapInArrow(make, "part array<double>")
    got = np.array(made.agg(F.array(*(F.sum(F.col("part")[i]) for i in range(k + k * k))).alias("s")).first().s) / basis.n
    return float(np.abs(got[k:].reshape(k, k) - np.outer(got[:k], got[:k]) - np.eye(k)).max())


def whiten(df: DataFrame, most: int = COMPONENTS, vector: str = "embedding", ident: str = "vec_id") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each whole vector and component.

    Rows without a vector, or with null or non-finite entries, are left out, and so are vectors shorter than the longest: they lack entries.
    Rows that share an id, or have none, are rows of their own. A component that does not vary has null whitened values and
    explains 0. A deviation beyond 64 bits is null. An empty table gives an empty result.
    """
    spark, kind = df.sparkSession, df.schema[ident].dataType.simpleString()
    schema = f"{ident} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    dim = df.where(finite_vector(F.col(vector))).agg(F.max(F.size(vector))).first()[0] or 0
    basis = fit(df, vector, dim, most) if dim else None
    if basis is None:
        return spark.createDataFrame([], schema)
    error, k = identity_error(df, vector, dim, basis), len(basis.values)

    def make(batches):
        for b in batches:
            places, m = whole(b.column(1), dim)
            for at in range(0, len(m), BLOCK):
                part, ids = m[at : at + BLOCK], b.column(0).take(pa.array(np.repeat(places[at : at + BLOCK], k)))
                up = basis.centre.numerators(part)
                if not (up.dtype == np.int64 and float(np.abs(up).max()) ** 2 * dim < 2**62):
                    up = up.astype(object)
                far = (up * up).sum(axis=1)
                far = pa.array([int(x) if x < 2**63 else None for x in far.tolist()], pa.int64())
                w = basis.whitened(part).ravel()
                rows = len(part)
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, basis.n)), far.take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(w, mask=np.isnan(w)), pa.array(np.tile(basis.explained, rows)), pa.array([error] * (rows * k), pa.float64()),
                ], names=[ident, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return df.select(F.col(ident), F.col(vector)).mapInArrow(make, schema)


def op13_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
