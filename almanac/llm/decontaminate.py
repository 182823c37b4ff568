"""Benchmark decontamination by winnowing.

Of every window of ten words the smallest hash of its five-word grams is the fingerprint: equal windows have
equal fingerprints wherever they stand, so no shared span of ten words is missed. An item
of fewer words is one window, its own gram its fingerprint. The benchmark's fingerprints make a bit map of a fixed
size; a document keeps the windows whose fingerprint is in it, as runs of neighbouring windows. Then
fingerprints are joined and hits extended to whole windows, compared as text: a false bit or an
equal gram with other words around it costs a row and changes no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.packed import checkpointed
from almanac.llm.words import hashes, runs

WINDOW, GRAM = 10, 5
#: Bits of the map are 2 to this power: 2 MB, whatever the benchmark's size.
BITS = 24
#: Parts into which each window's rows are dealt before they are joined.
SALTS = 16

#: Bytes to words: A-Z in lower case, everything but 0-9, a-z and bytes of non-ASCII characters a blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(TABLE).split()


def fingerprints(h: np.ndarray, size: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The fingerprint of every window of `size` words: the least hash of its grams; a window no longer than a gram is one gram."""
    if len(h) < size:
        return h[:0]
    g = runs(h, gram if size == WINDOW else size)
    n = len(h) - size + 1
    out = g[:n].copy()
    for j in range(1, len(g) - n + 1):
        np.minimum(out, g[j : n + j], out=out)
    return out


def item_windows(benchmark: DataFrame, text: str = "text", ident: str = "item_id") -> DataFrame:
    """(item, size, fingerprint, words): every window of every item."""
    fields = "item string, size int, fingerprint long, words string"

    def make(batches):
        for b in batches:
            out: list[tuple] = []
            for item, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words_of(data)
                size = min(len(w), WINDOW)
                if size:
                    out += [(item, size, f, b" ".join(w[i : i + size])) for i, f in enumerate(fingerprints(hashes(w), size).view(np.int64).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t).cast(to) for i, (t, to) in enumerate(((pa.string(),) * 2, (pa.int32(),) * 2, (pa.int64(),) * 2, (pa.binary(), pa.string())))], names=["item", "size", "fingerprint", "words"])

    return benchmark.select(F.coalesce(F.col(ident).cast("string"), F.lit("null")), F.col(text).cast("binary")).mapInArrow(make, fields)


def bit_map(windows: DataFrame, bits: int = BITS) -> np.ndarray:
    """Which remainders of 2^bits the fingerprints have, as 64-bit words. At most 2^(bits - 6) rows come to the driver."""
    place = F.expr(f"fingerprint & {2**bits - 1}")
    rows = windows.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST((fingerprint & {2**bits - 1}) & 63 AS INT))")).alias("w")).collect()
    out = np.zeros(2 ** (bits - 6), np.uint64)
    for r in rows:
        out[r["at"]] = np.uint64(r.w & 0xFFFFFFFFFFFFFFFF)
    return out


def found_runs(h: np.ndarray, size: int, bit: np.ndarray) -> list[tuple[int, int]]:
    """(first word, end) of the runs of neighbouring windows whose fingerprints are in the map."""
    f = fingerprints(h, size)
    at = f & np.uint64(64 * len(bit) - 1)
    hit = np.flatnonzero((bit[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1))
    if not len(hit):
        return []
    cut = np.flatnonzero(np.diff(hit) > 1)
    return list(zip(hit[np.append(0, cut + 1)].tolist(), (hit[np.append(cut, len(hit) - 1)] + size).tolist(), strict=True))


def document_runs(docs: DataFrame, bit: np.ndarray, sizes: list[int], text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(doc, n_words, runs), a row for each row of docs: runs are (start, size, words) of neighbouring windows that may be an item's."""
    spark = docs.sparkSession
    kind = docs.schema[ident].dataType.simpleString()
    told = spark.sparkContext.broadcast(bit)
    run = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()), ("words", pa.binary())]))

    def make(batches):
        for b in batches:
            counts, found = [], []
            for data in b.column(1).to_pylist():
                w = words_of(data)
                h = hashes(w)
                counts.append(len(w))
                found.append([{"start": i, "size": s, "words": b" ".join(w[i:j])} for s in sizes for i, j in found_runs(h, s, told.value)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(found, run)], names=["doc", "n_words", "runs"])

    return docs.select(F.col(ident), F.col(text).cast("binary")).mapInArrow(make, f"doc {kind}, n_words long, runs array<struct<start: int, size: int, words: binary>>")


def windows_of(run: Column) -> Column:
    """The windows of a run, as (start, size, words)."""
    w = F.split(run["words"].cast("string"), " ")
    return F.transform(F.sequence(F.lit(0), F.size(w) - run["size"]), lambda i: F.struct((run["start"] + i).alias("start"), run["size"].alias("size"), F.array_join(F.slice(w, i + 1, run["size"]), " ").alias("words")))


def merged(spans: Column) -> Column:
    """Sorted (start, end) spans as maximal disjoint ones; touching spans become one."""
    kind = "array<struct<start: int, end: int>>"
    last = lambda a: F.element_at(a, -1)
    joins = lambda a, s: (F.size(a) > 0) & (F.coalesce(F.try_element_at(a, F.lit(-1))["end"], F.lit(-1)) >= s["start"])
    grown = lambda a, s: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], s["end"]).alias("end"))))
    return F.aggregate(spans, F.array().cast(kind), lambda a, s: F.when(joins(a, s), grown(a, s)).otherwise(F.concat(a, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", ident: str = "doc_id", item: str = "item_id") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_spans), a row for each row of docs.

    hit_spans are the maximal runs of hit words as (start, end). Null and empty texts have no words and are never hit; rows that
    share an id are judged each by its own text. Items are told apart by their id as text: rows of one id are one item, and rows without an
    id are the item `null`. Items with equal windows share them: a window is kept once, its items are looked up once for each
    distinct set of windows that documents have, not for each document. An empty benchmark hits nothing.
    """
    windows = checkpointed(item_windows(benchmark, text, item).groupBy("size", "fingerprint", "words").agg(F.collect_set("item").alias("items")).withColumn("window", F.monotonically_increasing_id()))
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())
    read = checkpointed(document_runs(docs, bit_map(windows), sizes, text, ident).withColumn("row", F.monotonically_increasing_id()))
    # Extend: every window of a candidate run against the benchmark's, by its words. Of the benchmark only what occurs is dealt to all salts.
    candidates = read.select("row", F.explode("runs").alias("r")).select("row", F.explode(windows_of(F.col("r"))).alias("w")).select("row", "w.*")
    occurring = candidates.select("size", "words").distinct().join(windows.select("size", "words", "window"), ["size", "words"])
    salted = occurring.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # A document may repeat a window, so the place is part of the salt.
    dealt = candidates.withColumn("salt", F.pmod(F.hash("row", "start"), F.lit(SALTS)))
    hits = dealt.join(salted, ["size", "words", "salt"]).select("row", "start", (F.col("start") + F.col("size")).alias("end"), "window")
    by_row = hits.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"), F.sort_array(F.collect_set("window")).alias("windows"))
    by_row = checkpointed(by_row.withColumn("set", F.sha2(F.to_json(F.struct("windows")), 256)))
    sets = by_row.groupBy("set").agg(F.first("windows").alias("windows")).select("set", F.explode("windows").alias("window"))
    items = sets.join(windows.select("window", F.explode("items").alias("item")), "window").select("set", "item").distinct()
    names = items.groupBy("set").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("items_sha256"))
    # Sets are dealt by salts as well: one set may be that of a third of all hit documents.
    names = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    told = by_row.withColumn("salt", F.pmod(F.hash("row"), F.lit(SALTS))).join(names, ["set", "salt"]).select("row", "spans", "n_items", "items_sha256")
    clean = F.lit(0).cast("long")
    out = read.select("row", "doc", "n_words").join(told, "row", "left")
    out = out.withColumn("hit_spans", merged(F.coalesce("spans", F.array().cast("array<struct<start: int, end: int>>"))))
    n_hit = F.aggregate("hit_spans", clean, lambda n, s: n + s["end"] - s["start"])
    return out.select(F.col("doc").alias(ident), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", clean).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), F.col("n_items").isNotNull().alias("contaminated"), "hit_spans")


def op11_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return decontaminate(read("documents"), read("benchmark")).drop("hit_spans")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, {_WORDS} AS w FROM documents),
b AS MATERIALIZED (SELECT item_id, w, least(len(w), 10) AS size FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
v AS MATERIALIZED (SELECT DISTINCT coalesce(item_id::VARCHAR, 'null') AS item, size, array_to_string(w[i : i + size - 1], ' ') AS words FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM b)),
k AS (SELECT id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM b) WHERE len(w) >= size),
h AS MATERIALIZED (SELECT k.id, k.i, k.size, v.item FROM k JOIN v ON v.size = k.size AND v.words = array_to_string(k.w[k.i : k.i + k.size - 1], ' ')),
n AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest(range(i, i + size)) AS p FROM h) GROUP BY id),
s AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, item FROM h) GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_items IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (id) LEFT JOIN s USING (id)"""
