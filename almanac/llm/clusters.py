"""Centroid clustering in whole numbers: float32 products screen the centroids, exact sums decide.

A vector's score against a centroid c is |c|^2 - 2 x.c. The product comes from one float32 matrix
multiplication, whose error is at most gamma(dim + 2) |x| |c| in whatever order it adds (the two more
are for the roundings of x and c themselves). That gives an interval for each score; where one
interval lies below all others its centroid is the nearest, and only where intervals overlap are the
squared distances of the overlapping centroids recomputed in 64-bit whole numbers, equal ones going
to the smaller number. So assignments, sums and centroids are exact and do not depend on the order of rows,
on the machine or on its matrix library.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.packed import scratch, settle
from almanac.llm.vectors import finite_vector, long_list, summed, whole

CLUSTERS, DIM, ROUNDS, SEED = 8, 64, 10, 3
#: Vectors that are screened at once.
BLOCK = 4096


def gamma(n: int, unit: float = 2.0**-24) -> float:
    """Bound of the relative error of n roundings, itself rounded up."""
    return n * unit / (1 - n * unit) * (1 + 1e-12)


def intervals(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of |c|^2 - 2 x.c for each row of x and each centroid."""
    product = (x.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    squares = (centroids.astype(np.float64) ** 2).sum(axis=1)
    lengths = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))[:, None] * np.sqrt(squares)
    middle = squares - 2 * product
    # The float64 steps round by 2^-53 each; 1e-13 of all magnitudes covers them many times over.
    spread = 2 * gamma(x.shape[1] + 2) * lengths * (1 + 1e-12) + 1e-13 * (squares + 2 * lengths)
    return middle - spread, middle + spread


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """(number of the nearest centroid of each row, how many rows needed exact distances)."""
    low, high = intervals(x, centroids)
    open_ = low <= high.min(axis=1, keepdims=True)
    out = open_.argmax(axis=1)
    unsure = np.flatnonzero(open_.sum(axis=1) > 1)
    if len(unsure):
        exact = np.full((len(unsure), len(centroids)), np.iinfo(np.int64).max)
        for j, c in enumerate(centroids):
            at = np.flatnonzero(open_[unsure, j])
            exact[at, j] = ((x[unsure[at]] - c) ** 2).sum(axis=1)
        out[unsure] = exact.argmin(axis=1)
    return out, len(unsure)


def whole_vectors(df: DataFrame, vector: str, ident: str, dim: int) -> DataFrame:
    """(id, v): each kept row and the 32-bit whole numbers of its vector, as bytes."""
    kind = df.schema[ident].dataType.simpleString()

    def make(batches):
        for b in batches:
            places, m = whole(b.column(1), dim)
            raw, size = m.astype("<i4").tobytes(), 4 * dim
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(places)), pa.array([raw[i : i + size] for i in range(0, len(raw), size)], pa.binary())], names=["id", "v"])

    return df.select(F.col(ident), F.col(vector)).mapInArrow(make, f"id {kind}, v binary")


def blocks(batch: pa.RecordBatch, dim: int):
    """(place, matrix) of at most BLOCK vectors at a time."""
    column = batch.column(batch.schema.get_field_index("v"))
    for at in range(0, len(column), BLOCK):
        part = column.slice(at, BLOCK)
        yield at, np.frombuffer(b"".join(part.to_pylist()), "<i4").reshape(len(part), dim).astype(np.int64)


def sums(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, n, s): how many vectors are nearest to each centroid, and their sums; one row per task and cluster is shuffled."""
    k, dim = centroids.shape

    def make(batches):
        n, s = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in batches:
            for _, x in blocks(b, dim):
                of, _unsure = nearest(x, centroids)
                # Sums of a block stay under 2^53, so the float64 product is exact.
                s += ((np.arange(k)[:, None] == of).astype(np.float64) @ x.astype(np.float64)).astype(np.int64)
                n += np.bincount(of, minlength=k)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used]), long_list(s[used])], names=["cluster", "n", "part"])

    made = vectors.mapInArrow(make, "cluster int, n long, part array<bigint>")
    return made.groupBy("cluster").agg(F.sum("n").alias("n"), summed("part", dim).alias("s"))


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance): the nearest centroid and the exact squared distance to it."""
    k, dim = centroids.shape
    kind = vectors.schema["id"].dataType.simpleString()

    def make(batches):
        for b in batches:
            got = [(of, ((x - centroids[of]) ** 2).sum(axis=1)) for _, x in blocks(b, dim) for of in [nearest(x, centroids)[0]]]
            of, far = (np.concatenate(c) if got else np.empty(0, np.int64) for c in (zip(*got, strict=True) if got else ((), ())))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(of.astype(np.int32)), pa.array(far.astype(np.int64))], names=["id", "cluster", "distance"])

    return vectors.mapInArrow(make, f"id {kind}, cluster int, distance long")


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def first_centroids(df: DataFrame, vector: str, ident: str, dim: int, k: int, seed: int) -> np.ndarray:
    """The k kept vectors with the smallest hash of seed and id, in that order; equal hashes by the vectors' own order. A null id hashes as the word null."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(ident).cast("string"), F.lit("null"))), 256)
    v = F.transform(F.col(vector), lambda e: F.floor(F.lit(1024.0) * e.cast("double")))
    kept = df.where(finite_vector(F.col(vector)) & (F.size(vector) == dim))
    rows = kept.select(key.alias("key"), v.alias("v")).orderBy("key", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), dim)


def cluster(df: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, vector: str = "embedding", ident: str = "vec_id", dim: int = DIM) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each kept row of df.

    Kept are vectors of `dim` entries, none null or non-finite; rows that share an id, or have none, are rows of their own.
    With fewer than k kept vectors there are as many centroids; with none the result is empty. Ties go to the smaller
    number, an empty cluster keeps its centroid. What comes to the driver is the k centroids of each round.
    """
    spark = df.sparkSession
    centroids = first_centroids(df, vector, ident, dim, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"{ident} {df.schema[ident].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    with scratch(spark):
        # Rounds read 4 bytes an entry from the shared folder.
        vectors = settle(whole_vectors(df, vector, ident, dim))
        for _ in range(rounds):
            for r in sums(vectors, centroids).collect():
                centroids[r.cluster] = [int(v) // r.n for v in r.s]
        far = {r.cluster: int(r.d) for r in assigned(vectors, centroids).groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    names = F.array(*(F.lit(digest(c)) for c in centroids))
    of = F.array(*(F.lit(far.get(j, 0)).cast("decimal(38,0)") for j in range(len(centroids))))
    out = assigned(whole_vectors(df, vector, ident, dim), centroids)
    number = F.col("cluster")
    return out.select(F.col("id").alias(ident), "cluster", "distance", of[number].cast("long").alias("cluster_inertia"), F.lit(sum(far.values())).cast("decimal(38,0)").cast("long").alias("inertia"), names[number].alias("centroid_sha256"))


def op12_interval_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    rounds = []
    for i in range(ROUNDS + 1):
        rounds.append(f"""
e{i} AS MATERIALIZED (SELECT id, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT v.id, c.k, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{i} c ON v.j = c.j GROUP BY v.id, c.k) GROUP BY id)""")
        if i < ROUNDS:
            rounds.append(f"""
c{i + 1} AS MATERIALIZED (SELECT c.k, c.j, coalesce(n.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT e.k, v.j, floor(sum(v.x) / count(*))::BIGINT AS x FROM e{i} e JOIN v ON v.id = e.id GROUP BY e.k, v.j) n ON c.k = n.k AND c.j = n.j)""")
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
v AS MATERIALIZED (SELECT id, unnest(range({DIM})) AS j, unnest(x) AS x FROM kept),
s AS (SELECT id, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), x) - 1 AS k FROM kept ORDER BY k LIMIT {CLUSTERS}),
c0 AS MATERIALIZED (SELECT s.k, v.j, v.x FROM s JOIN v USING (id)),{",".join(rounds)},
f AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) AS sha FROM c{ROUNDS} GROUP BY k)
SELECT vec_id, e.k::INT AS cluster, e.d AS distance, (sum(e.d) OVER (PARTITION BY e.k))::BIGINT AS cluster_inertia, (sum(e.d) OVER ())::BIGINT AS inertia, f.sha AS centroid_sha256 FROM e{ROUNDS} e JOIN kept USING (id) JOIN f ON f.k = e.k"""


ORACLE = _oracle()
