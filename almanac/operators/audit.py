"""Audits: whether a plan looks ahead, and whether two tables say the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def causality(panel: DataFrame, plan: Callable[[DataFrame], DataFrame], columns: list[str], cuts: list[int], tolerance: float = 1e-12) -> DataFrame:
    """(inst, dt, t, cut, column, whole, cut_value): cells whose value changes when the panel ends at a cut, a calendar position `t`. Empty for a plan that looks only back.

    The plan takes a panel (dt, t, inst, ...) and adds columns; it may group by inst and dt and order by t. All cuts are evaluated in one
    pass: the panel is taken once as it is and once for each cut up to its position, each copy with instruments and dates of
    its own, so that windows and cross-sections stay within a copy. Values are compared by key, with a
    relative and absolute tolerance; null differs from any value.
    """
    copies = F.array(F.struct(F.lit(None).cast("int").alias("cut")), *(F.struct(F.lit(c).alias("cut")) for c in cuts))
    many = panel.withColumn("_copy", F.explode(copies)).where(F.col("_copy.cut").isNull() | (F.col("t") <= F.col("_copy.cut")))
    tag = F.coalesce(F.col("_copy.cut"), F.lit(-1))
    # Struct keys: equal only within one copy.
    many = many.withColumn("inst", F.struct(tag.alias("cut"), F.col("inst").alias("of"))).withColumn("dt", F.struct(tag.alias("cut"), F.col("dt").alias("of"))).drop("_copy")
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns))).alias("v")
    done = plan(many).select(F.col("inst.cut").alias("cut"), F.col("inst.of").alias("inst"), F.col("dt.of").alias("dt"), "t", values).select("cut", "inst", "dt", "t", "v.*")
    whole = done.where("cut = -1").select("inst", "t", "column", F.col("value").alias("whole"), "dt", F.explode(F.array(*map(F.lit, cuts))).alias("cut")).where("t <= cut")
    parts = done.where("cut <> -1").select("inst", "t", "column", F.col("value").alias("cut_value"), F.col("dt").alias("_dt"), "cut")
    both = whole.join(parts, ["inst", "t", "column", "cut"], "full_outer")
    a, b = F.col("whole"), F.col("cut_value")
    same = F.coalesce(F.abs(a - b) <= tolerance * F.greatest(F.lit(1.0), F.abs(a), F.abs(b)), a.eqNullSafe(b))
    return both.where(~same).select("inst", F.coalesce("dt", "_dt").alias("dt"), "t", "cut", "column", "whole", "cut_value")


def _sealed(df: DataFrame, key: list[str], columns: list[str], buckets: int) -> DataFrame:
    """(bucket, n, a, b): a bucket's rows, and the sums of two hashes of its rows; the order of rows does not matter, repeats do."""
    row = [F.col(c) for c in (*key, *columns)]
    nulls = F.array(*(c.isNull() for c in row))
    x = df.select(bucket(key, buckets).alias("bucket"), F.xxhash64(*row, nulls).alias("a"), F.xxhash64(F.lit(1), *reversed(row), nulls).alias("b"))
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    return x.groupBy("bucket").agg(F.count("*").alias("n"), total("a").alias("a"), total("b").alias("b"))


def bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def differing_buckets(first: DataFrame, second: DataFrame, key: list[str], columns: list[str], buckets: int = 1024) -> list[int]:
    """Numbers of the buckets of keys in which two tables differ: one aggregation of each, no rows are shuffled, at most `buckets` numbers come to the driver."""
    a, b = (_sealed(x, key, columns, buckets) for x in (first, second))
    other = b.select(F.col("bucket"), *(F.col(c).alias(f"_{c}") for c in ("n", "a", "b")))
    unlike = reduce(lambda p, q: p | q, (~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("n", "a", "b")))
    return sorted(r.bucket for r in a.join(other, "bucket", "full_outer").where(unlike).select("bucket").collect())


def differences(first: DataFrame, second: DataFrame, key: list[str], columns: list[str], buckets: int = 1024) -> DataFrame:
    """(key, difference, changed): rows by key that only one table has (`missing` from the second, `unexpected` there), are `repeated` unequally often, or are `changed`, with the names of the changed columns.

    Tables are compared by sums of row hashes first. Equal tables cost that one aggregation and give an empty table that reads
    nothing more; otherwise only rows of differing buckets are joined by key. Nulls are equal to each other, also in keys. A
    repeated key is compared by its number of rows and its least values.
    """
    found = differing_buckets(first, second, key, columns, buckets)
    out = first.select(*key).withColumn("difference", F.lit("")).withColumn("changed", F.array().cast("array<string>"))
    if not found:
        return first.sparkSession.createDataFrame([], out.schema)
    there = bucket(key, buckets).isin(*found) if len(found) < buckets else F.lit(True)
    g = F.struct(*key).alias("_k")
    rows = lambda df, side: df.where(there).groupBy(g).agg(F.count("*").alias(f"_n{side}"), *(F.min(c).alias(f"_{side}{i}") for i, c in enumerate(columns)))
    both = rows(first, "a").join(rows(second, "b").withColumnRenamed("_k", "_h"), F.col("_k") == F.col("_h"), "full_outer")
    names = F.array_compact(F.array(*(F.when(~F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}")), F.lit(c)) for i, c in enumerate(columns)))) if columns else F.array().cast("array<string>")
    kind = F.when(F.col("_nb").isNull(), "missing").when(F.col("_na").isNull(), "unexpected").when(F.col("_na") != F.col("_nb"), "repeated").when(F.size(names) > 0, "changed")
    k = F.coalesce("_k", "_h")
    return both.select(k.alias("_k"), kind.alias("difference"), F.when(kind == "changed", names).otherwise(F.array().cast("array<string>")).alias("changed")).where("difference is not null").select(*(F.col(f"_k.{c}").alias(c) for c in key), "difference", "changed")


def replay(raw: DataFrame, factors: DataFrame | None, stored: DataFrame, buckets: int = 1024) -> DataFrame:
    """(instrument, dt, difference, changed): where canonical bars rebuilt from raw ones differ from those that are stored. Empty if the store can be replayed."""
    from almanac.plans.canonical import canonical

    rebuilt = canonical(raw, factors)
    return differences(rebuilt, stored, ["instrument", "dt"], [c for c in rebuilt.columns if c not in ("instrument", "dt")], buckets)
