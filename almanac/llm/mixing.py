"""Mixing sources to target weights, with DataFrame functions only.

Every row gets a key from a hash of its id, which orders the rows of a source at random. The
keys are cut into ranges; sums of the ranges, then sums within a range, give each row's
distributed prefix sum of sizes. A source is taken whole for every full epoch of its budget and once
more up to the word where the rest of the budget ends. A hot source is many ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almanac.llm.packed import checkpointed, scratch, settle

#: Rows of one range, about.
RANGE_ROWS = 20_000
#: No source is repeated more often.
EPOCHS = 3
#: Sources whose cuts are broadcast at most, and parts of a source's rows where there are more.
BROADCAST, SALTS = 100_000, 64


def n_words(text: str = "text") -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources by code point, null last, weigh 1, 2, 3, repeating. A target is the level times
    the weight, but 3 times the source's size at most; the level at which the targets use up all
    sizes is found in order of the ratios at which sources reach their limit.
    """
    name = W.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("w", F.pmod(F.row_number().over(name) - 1, F.lit(3)) + 1)
    s = s.withColumn("most", F.lit(EPOCHS) * F.col("source_size"))
    ratio = W.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = ratio.rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(everything)).withColumn("left", F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0)))
    s = s.withColumn("weights", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    # A source is at its limit if the level, were it shared from here on, would exceed it; the first that is not sets the level.
    s = s.withColumn("free", F.col("left") * F.col("w") <= F.col("most") * F.col("weights"))
    level = F.min(F.when(F.col("free"), F.struct(F.col("most") / F.col("w"), "source", F.col("left").alias("left"), F.col("weights").alias("weights")))).over(everything)
    s = s.withColumn("at", level)
    share = F.col("at.left").cast("double") * F.col("w") / F.col("at.weights")
    return s.select("source", "source_size", F.when(F.col("free"), share).otherwise(F.col("most").cast("double")).alias("target"))


def random_key(seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def range_of(ranges: Column) -> Column:
    """The range of a key: its first 32 bits, scaled, so ranges are in the order of keys."""
    return F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * ranges / F.lit(2**32))


def epochs_of(budget: Column) -> Column:
    return F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """(doc_id, size, source_size, target, taken), a row for each row of docs.

    taken counts words, repeats included; one row of a source may be taken in part, at the cut.
    Null texts have size 0 and take nothing; a null source is a source. Rows that share an id
    follow each other by size; a source without words has target 0.
    """
    rows = docs.select("doc_id", "source", n_words().alias("size"), random_key(seed).alias("key"))
    rows = rows.withColumn("part", range_of(F.lit(max(64, docs.count() // RANGE_ROWS))))
    # Not map-side only: sizes by source and range are few, whatever the source.
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    ahead = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("part_before", F.coalesce(F.sum("part_size").over(ahead), F.lit(0)))
    goal = targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size"))).withColumnRenamed("source", "of")
    # One row per source and range: small beside the rows, so both joins carry it to them.
    known = parts.select(F.col("source").alias("s"), F.col("part").alias("p"), "part_before").join(goal, F.col("s").eqNullSafe(F.col("of"))).drop("of")
    within = W.partitionBy("source", "part").orderBy("key", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("in_part", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    budget = F.floor("target")
    epochs = epochs_of(budget)
    rest = budget - epochs * F.col("source_size")
    once = F.greatest(F.lit(0), F.least("size", rest - F.col("part_before") - F.col("in_part")))
    return rows.select("doc_id", "size", "source_size", "target", (epochs * F.col("size") + once).cast("long").alias("taken"))


def cuts(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """(of, epochs, cut, left, ties), a row for each source: whole epochs, and where the last one ends.

    Rows before `cut`, a struct (key, size, same) that rows are compared with, are taken once more. The rows equal to it, `ties` of them, share `left`
    words. Sources whose budget is whole epochs have no cut. Texts are read once, not shuffled: their sizes and keys are written to the scratch and serve both sums and order.
    """
    rows = docs.select("source", n_words().alias("size"), random_key(seed).alias("key"), F.xxhash64("text").alias("same")).where("size > 0")
    rows = settle(rows.withColumn("part", range_of(F.lit(max(64, docs.count() // RANGE_ROWS)))))
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    ahead = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("part_before", F.coalesce(F.sum("part_size").over(ahead), F.lit(0)))
    budget = F.floor("target")
    goal = targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size"))).select(F.col("source").alias("of"), epochs_of(budget).alias("epochs"), (budget - epochs_of(budget) * F.col("source_size")).alias("rest"))
    # Of each source only the range in which the budget ends is put in order.
    ends = parts.join(goal, F.col("source").eqNullSafe(F.col("of"))).where("rest > 0 and part_before <= rest and rest < part_before + part_size").select(F.col("source").alias("s"), F.col("part").alias("p"), (F.col("rest") - F.col("part_before")).alias("here"))
    near = rows.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).groupBy("s", "here", F.struct("key", "size", "same").alias("cut")).agg(F.count("*").alias("ties"))
    words = F.col("ties") * F.col("cut.size")
    within = W.partitionBy("s").orderBy("cut").rowsBetween(W.unboundedPreceding, -1)
    near = near.withColumn("before", F.coalesce(F.sum(words).over(within), F.lit(0))).where((F.col("before") <= F.col("here")) & (F.col("here") < F.col("before") + words))
    return goal.join(near.select("s", "cut", (F.col("here") - F.col("before")).alias("left"), "ties"), F.col("of").eqNullSafe(F.col("s")), "left").select("of", "epochs", "cut", "left", "ties")


def repeat(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """docs as the mix takes it: every row once per full pass over it, and a last time cut to the words that are left to take.

    Rows that the mix takes nothing of are not in it. Cut rows have the words taken, joined by
    single spaces, and n_chars to match where docs has it. Rows equal in id, source and text at the cut share its words evenly.
    A row's share follows from its own key and its source's cut, so texts stay where they are read, unless there are more than BROADCAST sources.
    """
    row = docs.select(F.struct(*docs.columns).alias("_row"), F.col("source").alias("_source"), n_words().alias("_size"), random_key(seed).alias("_key"), F.xxhash64("text").alias("_same")).where("_size > 0")
    with scratch(docs.sparkSession):
        ends = checkpointed(cuts(docs, seed))
    if ends.limit(BROADCAST + 1).count() <= BROADCAST:
        out = row.join(F.broadcast(ends), F.col("_source").eqNullSafe(F.col("of")))
    else:
        # A hot source is dealt out by its rows' keys.
        salt = F.pmod(F.xxhash64("_key"), F.lit(SALTS))
        dealt = ends.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = row.join(dealt, F.col("_source").eqNullSafe(F.col("of")) & (salt == F.col("_part")))
    here = F.struct(F.col("_key").alias("key"), F.col("_size").alias("size"), F.col("_same").alias("same"))
    once = F.when(F.col("cut").isNull(), F.lit(0)).when(here < F.col("cut"), F.col("_size")).when(here == F.col("cut"), F.floor(F.col("left") / F.col("ties"))).otherwise(F.lit(0)).cast("long")
    turns = F.concat(F.array_repeat(F.col("_size"), F.col("epochs").cast("int")), F.when(once > 0, F.array(once)).otherwise(F.array().cast("array<bigint>")))
    out = out.select("_row", "_size", F.explode(turns).alias("_words")).withColumn("_cut", F.col("_words") < F.col("_size"))
    short = F.array_join(F.slice(F.regexp_extract_all("_row.text", F.lit(r"([^\x20\x09-\x0D]+)"), 1), F.lit(1), F.col("_words").cast("int")), " ")
    text = F.when(F.col("_cut"), short).otherwise(F.col("_row.text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_cut"), F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return out.select(*(new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix:' || doc_id) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s),
r AS (SELECT *, 3 * source_size AS most, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER f, 0) AS rem, sum(w) OVER () - coalesce(sum(w) OVER f, 0) AS ws
      FROM w WINDOW f AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT rem, ws FROM r WHERE rem * w <= most * ws ORDER BY most / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN r.rem * w <= most * r.ws THEN l.rem::DOUBLE * w / l.ws ELSE most::DOUBLE END AS target FROM r, l),
c AS (SELECT d.*, t.source_size, t.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM c)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken FROM b
"""
