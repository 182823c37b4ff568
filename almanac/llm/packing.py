"""Harmonic packing of token ids into sequences of a fixed capacity.

A document's ids are cut into pieces whose lengths are the capacity divided by a power of two,
down to 64, and one tail below that. Class k holds the lengths in (capacity / (k + 1), capacity / k], and
each of its bins takes exactly k pieces, so a piece's bin follows from its number within the class
alone: workers number their pieces from an offset (a prefix sum over the few class counts of
all tasks) and fill bins independently. The at most k - 1 pieces left over in each class, a
bounded number in all, are packed first-fit by decreasing length.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almanac.llm.packed import kept, tune

CAPACITY, SHORTEST, END = 4096, 64, 2
#: Words whose ids a task remembers.
REMEMBERED = 600_000


def byte_letters() -> dict[int, str]:
    """The printable letter for each byte of byte-level vocabularies: itself where it is printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Ids(dict):
    """Ids of words. A word never shares a token with its neighbours, so a text's ids are its words' ids in order."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.model, self.letters = self.whole.model, byte_letters()
        self.marks, self.end = b".,!?;:#$%&*|", struct.pack("<I", END)

    def one(self, word: bytes) -> bytes:
        """Letters only: the model alone, on its alphabet. All else takes the whole tokenizer."""
        text = word.decode()
        if word.isalpha():
            ids = [t.id for t in self.model.tokenize(text)]
        elif text.isalpha() and "À" <= min(c for c in text if not c.isascii()) and max(text) <= "ɏ" and text == text.lower():
            ids = [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, word)))]
        else:
            ids = self.whole.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: bytes) -> bytes:
        core = word.rstrip(self.marks)
        if core and core != word and (core.isalpha() or core.decode().isalpha()):
            ids = self[core] + self[word[len(core) :]]
        else:
            ids = self.one(word)
        self[word] = ids
        return ids

    def of(self, text: bytes) -> bytes:
        """The ids of a text and its end, as little-endian numbers of 32 bits."""
        if len(self) > REMEMBERED:
            self.clear()
        return b"".join(map(self.__getitem__, text.lower().split())) + self.end


def cut(n: int) -> list[int]:
    """Lengths of the pieces of n ids: whole sequences, falling powers of two, a tail."""
    out, size = [CAPACITY] * (n // CAPACITY), CAPACITY // 2
    n %= CAPACITY
    while size >= SHORTEST:
        if n >= size:
            out.append(size)
            n -= size
        size //= 2
    return out + [n] * (n > 0)


def pieces(docs: DataFrame, path: str) -> DataFrame:
    """One row per piece, with the task that made it and its number there within its class."""
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, task int, number long"

    def make(batches):
        from pyspark import TaskContext

        task, ids_of, count = TaskContext.get().partitionId(), Ids(path), {}
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw, start = ids_of.of(text or b""), 0
                for n in cut(len(raw) // 4):
                    k = CAPACITY // n
                    rows.append((doc, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), len(raw) // 4, k, task, count.get(k, 0)))
                    count[k] = count.get(k, 0) + 1
                    start += n
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(),) * 5 + (pa.int32(),) * 2 + (pa.int64(),), strict=True)], names=[f.split()[0] for f in fields.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(make, fields)


def first_fit(table: pd.DataFrame) -> pd.DataFrame:
    """The left-over pieces, fewer than the sum of all k: by decreasing length into the first bin with room."""
    table = table.sort_values(["length", "class", "place"], ascending=[False, True, True], kind="stable")
    room = np.empty(0, np.int64)
    bins = []
    for n in table["length"]:
        fits = np.flatnonzero(room >= n)
        if not len(fits):
            room = np.append(room, CAPACITY)
            fits = [len(room) - 1]
        room[fits[0]] -= n
        bins.append(fits[0])
    return table.assign(class_=0, bin=np.array(bins, np.int64))[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class_", "bin", "place"]].rename(columns={"class_": "class"})


def pack(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row per piece.

    A null or empty text is its end id alone. Repeated rows are packed each. The tokenizer's
    file must be readable at `path` on every worker.
    """
    tune(docs.sparkSession)
    made = kept(pieces(docs, path))
    tasks = made.groupBy("class", "task").agg(F.count("*").alias("n"))
    ahead = W.partitionBy("class").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    tasks = tasks.select("class", "task", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"), F.sum("n").over(W.partitionBy("class")).alias("all"))
    placed = made.join(tasks, ["class", "task"]).withColumn("place", F.col("ahead") + F.col("number")).withColumn("bin", F.expr("place div class"))
    full = F.col("bin") < F.expr("all div class")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "bin", "place"]
    rest = placed.where(~full).select(*columns).groupBy().applyInPandas(first_fit, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, bin long, place long")
    everything = placed.where(full).select(*columns).unionByName(rest)
    # A bin has at most 4096 pieces; the id joins class and number of the bin.
    inside = W.partitionBy("sequence_id").orderBy(F.desc("length"), "place", "start", "doc_id", "ids_crc32").rowsBetween(W.unboundedPreceding, -1)
    return everything.withColumn("sequence_id", F.col("bin") * F.lit(CAPACITY + 1) + F.col("class")).withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
