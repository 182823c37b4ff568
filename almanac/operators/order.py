"""Places in an order, and what stands at them, without one task that has all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almanac.functions.cross import finite
from almanac.sources.shared import checkpointed


def positions(df: DataFrame, order: list[str], out: str = "position") -> DataFrame:
    """df with each row's place, from 0, in the order of the given columns, which should tell rows apart.

    Rows are dealt out by ranges and sorted within them; the sizes of the ranges, one number a partition, come to the driver,
    and a row's place is what lies before its range plus its place there. The sorted rows are written to the shared folder, so
    that a lost executor does not deal them out anew. Rows equal in all columns of the order follow each other in either order.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    done = checkpointed(dealt)
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND(2**33 - 1)
    sizes = {r.p: r.n for r in done.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    ahead, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        ahead.append(total)
        total += sizes.get(p, 0)
    before = F.array(*map(F.lit, ahead)) if ahead else F.array(F.lit(0))
    return done.withColumn(out, F.get(before, part.cast("int")).cast("long") + place).drop("_m")


def evenly_spaced(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """k rows spread evenly over an order: those at the places round(i (n - 1) / (k - 1)), halves to the even place, with `sample`, i.

    For k = 1 the first row. With fewer than k rows some come more than once; of none, none.
    """
    if type(k) is not int or k < 1:
        raise ValueError("a sample has at least one row")
    placed = positions(df, order, "_place")
    n = placed.agg(F.count("*").alias("n")).scalar()
    wanted = df.sparkSession.range(k).select(F.col("id").alias("sample"), F.bround(F.col("id") * (n - 1) / F.lit(max(1, k - 1))).cast("long").alias("_place"))
    return placed.join(wanted, "_place").drop("_place")


#: Cells to an octave in the first histogram, and linear cells within one of those in the second.
OCTAVE, FINE = 8, 1024


def code(x: Column) -> Column:
    """A whole number that never falls where x rises: cells of equal ratio on either side of zero."""
    size = F.floor(F.log2(F.abs(x)) * OCTAVE) + 1100 * OCTAVE
    return F.when(x > 0, size).when(x < 0, -size).otherwise(F.lit(0)).cast("int")


def quantiles(df: DataFrame, by: list[str], x: str, probabilities: list[float]) -> DataFrame:
    """(by, n, q): exact quantiles of each group's finite values, linear between neighbours, as an array in the order of the probabilities.

    Selection instead of sorting: a histogram over a monotone code finds the cell of each wanted rank, a second one within
    that cell (linear between its least and largest value) a cell of that; only values there are put in order. A cell whose least and largest value agree needs no rows
    at all, so values that many rows share cost nothing. Groups without a finite value are absent; a null group is a group.
    """
    if not probabilities or not all(0 <= p <= 1 for p in probabilities):
        raise ValueError("probabilities lie in [0, 1]")
    rows = df.select(F.struct(*by, F.lit(0).alias("_")).alias("_g"), finite(F.col(x).cast("double")).alias("_x")).where("_x is not null").withColumn("_c", code(F.col("_x")))
    cells = [F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")]
    ahead = lambda *of: W.partitionBy(*of[:-1]).orderBy(of[-1]).rowsBetween(W.unboundedPreceding, -1)
    before = lambda *of: F.coalesce(F.sum("_n").over(ahead(*of)), F.lit(0))
    place = lambda p: (F.col("_all") - 1) * F.lit(float(p))
    ranks = F.array_distinct(F.array(*(f(place(p)).cast("long") for p in probabilities for f in (F.floor, F.ceil))))
    first = rows.groupBy("_g", "_c").agg(*cells).withColumn("_before", before("_g", "_c")).withColumn("_all", F.sum("_n").over(W.partitionBy("_g")))
    first = first.withColumn("_r", F.explode(F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")))))
    sure = lambda t: t.where("_lo = _hi").select("_g", "_r", F.col("_lo").alias("_v"), "_all")
    open_ = first.where("_lo < _hi")
    inner = rows.join(open_.select("_g", "_c", "_lo", "_hi").distinct(), ["_g", "_c"])
    inner = inner.withColumn("_f", F.least(F.lit(FINE - 1), F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * FINE))).drop("_lo", "_hi")
    second = inner.groupBy("_g", "_c", "_f").agg(*cells).withColumn("_in", before("_g", "_c", "_f"))
    second = second.join(open_.select("_g", "_c", "_r", "_before", "_all"), ["_g", "_c"]).withColumn("_k", F.col("_r") - F.col("_before") - F.col("_in")).where("_k >= 0 and _k < _n")
    last = second.where("_lo < _hi")
    sorted_ = inner.join(last.select("_g", "_c", "_f").distinct(), ["_g", "_c", "_f"]).withColumn("_k", F.row_number().over(W.partitionBy("_g", "_c", "_f").orderBy("_x")) - 1)
    picked = last.select("_g", "_c", "_f", "_k", "_r", "_all").join(sorted_, ["_g", "_c", "_f", "_k"]).select("_g", "_r", F.col("_x").alias("_v"), "_all")
    found = sure(first).unionByName(sure(second)).unionByName(picked).groupBy("_g").agg(F.max("_all").alias("_all"), F.map_from_entries(F.collect_set(F.struct("_r", "_v"))).alias("_m"))
    at = lambda p, f: F.element_at("_m", f(place(p)).cast("long"))
    values = [at(p, F.floor) + (at(p, F.ceil) - at(p, F.floor)) * (place(p) - F.floor(place(p))) for p in probabilities]
    return found.select(*(F.col(f"_g.{c}").alias(c) for c in by), F.col("_all").alias("n"), F.array(*values).alias("q"))
