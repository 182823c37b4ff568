"""Exchanges of packed arrays: many small records travel as one row per bucket.

A task turns its rows into numpy columns, deals them into buckets by a hash and emits
one row per bucket whose columns are the raw bytes of those arrays. Spark shuffles the
rows by bucket, and the number of buckets follows the size of the input. Equal content meets in
one bucket, so operators combine what is equal within a group of documents before they send it: a
value that a third of all rows have is one record a group then.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside the operators: it sorts after every real id.
NULL_ID = 2**63 - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's spark.checkpoint.dir. A local session without one gets a temporary folder; a cluster without one is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


class Scratch:
    """The intermediate tables of one operator, deleted through the session's own file systems (a classic session's). Within `with scratch(spark)`, settle and by_group note what they write; it goes at the end, also after an error."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.tables = spark, [], []

    def clear(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for at in self.paths:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(conf).delete(path, True)
        self.paths, self.tables = [], []


class _Open(threading.local):
    """The scratches of this thread that are open, the innermost last."""

    def __init__(self):
        self.all: list[Scratch] = []


_open = _Open()
_sweeping, _lock = 0, threading.Lock()

#: Spark's setting that deletes the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession):
    """Within it, each write deletes its shuffle files when it ends: what is settled needs them no more.

    The setting is the session's: a plan that others keep and run again meanwhile makes its shuffle files anew. Operators
    in several threads share it, and the last to end takes it back.
    """
    global _sweeping
    with _lock:
        if not _sweeping:
            swept.before = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
        _sweeping += 1
    try:
        yield
    finally:
        with _lock:
            _sweeping -= 1
            if not _sweeping:
                spark.conf.set(CLEANUP, swept.before)


@contextmanager
def scratch(spark: SparkSession):
    """An operator's own scratch. What it returns must be kept by `kept`, which writes outside it."""
    mine = Scratch(spark)
    _open.all.append(mine)
    try:
        with swept(spark):
            yield mine
    finally:
        _open.all.remove(mine)
        mine.clear()


def written(df: DataFrame, at: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def settle(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives lost executors."""
    at = f"{shared_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    if _open.all:
        _open.all[-1].paths.append(at)
    return written(df, at)


def kept(df: DataFrame) -> DataFrame:
    """An operator's result, written beside its scratch: small records, not texts. It stays in the shared folder."""
    return written(df, f"{shared_dir(df.sparkSession)}/result-{uuid.uuid4().hex}")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder that all executors share, without its lineage. Spark deletes the files with the last plan that needs them where cleanCheckpoints is set."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def by_group(df: DataFrame, groups: int, key: str = "g") -> DataFrame:
    """Write df clustered by an integer column, as a bucketed table in the shared folder.

    Later cogroups on the column read it in place instead of shuffling the texts again.
    """
    spark = df.sparkSession
    name = f"grouped_{uuid.uuid4().hex}"
    at = f"{shared_dir(spark)}/{name}"
    if _open.all:
        _open.all[-1].paths.append(at)
        _open.all[-1].tables.append(name)
    (
        df.repartition(groups, key)
        .write.bucketBy(groups, key)
        .sortBy(key)
        .option("compression", "zstd")
        .option("path", at)
        .format("parquet")
        .saveAsTable(name)
    )
    return spark.table(name)


def tune(spark: SparkSession) -> None:
    """Arrow batches of a few MB: documents can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def total_bytes(df: DataFrame, column: str) -> int:
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def pieces(size: int, each: int = 8 << 20, least: int = 64, most: int = 100_000) -> int:
    """How many buckets keep one near `each` bytes. Spark allows `most` buckets of a table; beyond 0.8 TB of text buckets grow instead."""
    return min(most, max(least, -(-size // each)))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def deal(ids: np.ndarray, groups: int) -> np.ndarray:
    """Group of each id: what pmod(xxhash64(id), groups) gives in Spark SQL."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    with np.errstate(over="ignore"):
        h = np.uint64(42) + p5 + np.uint64(8)
        h = h ^ (turn(np.asarray(ids).astype(np.int64).view(np.uint64) * p2, 31) * p1)
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h = h ^ (h >> np.uint64(32))
    return np.mod(h.view(np.int64), groups).astype(np.int32)


def schema(*columns: str) -> str:
    return "g int, " + ", ".join(f"{c} binary" for c in columns)


def scatter(group: np.ndarray, groups: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row per group that has records: the bytes of its part of every column."""
    group = group.astype(np.uint16 if groups <= 65536 else np.int32)
    order = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[order], np.arange(groups + 1))
    used = np.flatnonzero(cuts[1:] > cuts[:-1])
    arrays = [pa.array(used.astype(np.int32))]
    for column in columns.values():
        raw, size = np.ascontiguousarray(column[order]).tobytes(), column.itemsize
        arrays.append(pa.array([raw[cuts[u] * size : cuts[u + 1] * size] for u in used], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=["g", *columns])


def gather(table: pa.Table, column: str, dtype) -> np.ndarray:
    """The arrays of a packed column one after the other, from Arrow's own buffers: values of a chunk lie there without gaps."""
    raw = []
    for part in table.column(column).chunks:
        part = (part.drop_null() if part.null_count else part).cast(pa.large_binary())
        if len(part):
            ends = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
            if ends[-1] > ends[0]:
                raw.append(part.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0])))
    return np.frombuffer(raw[0] if len(raw) == 1 else b"".join(raw), dtype)


def split(table: pa.Table, kind: str, dtypes: dict[str, type]) -> dict[int, tuple[np.ndarray, ...]]:
    """Packed replies of one kind by document."""
    if not table.num_rows:
        return {}
    part = table.filter(pa.compute.equal(table.column("kind"), kind))
    columns = [gather(part, c, t) for c, t in dtypes.items()]
    if not len(columns[0]):
        return {}
    order = np.argsort(columns[0], kind="stable")
    columns = [c[order] for c in columns]
    ids, at = np.unique(columns[0], return_index=True)
    ends = np.append(at[1:], len(columns[0]))
    return {int(d): tuple(c[i:j] for c in columns[1:]) for d, i, j in zip(ids, at, ends, strict=True)}


def with_id(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, data): ids without nulls and the texts' bytes; a null text is empty."""
    return df.select(F.coalesce(F.col(doc).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("data"))


def with_group(df: DataFrame, groups: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(g, doc_id, data): as with_id, and the group of each document."""
    return with_id(df, doc, text).select(F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int").alias("g"), "doc_id", "data")


def back(column: str = "doc_id"):
    """The stand-in for a null id becomes null again."""
    return F.when(F.col(column) != NULL_ID, F.col(column))
