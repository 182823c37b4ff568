"""Event ledgers: quarantine, merging with conflicts, and activity spans. Revision chains are in almanac.operators.ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def quarantine(events: DataFrame, key: str, published: str, period: str, value: str, number: str) -> DataFrame:
    """events with `reason`: invalid_key, invalid_date, ambiguous_duplicate, malformed_number, or null for sound rows.

    value is text; a later reason in the list overrides an earlier one. An empty value is missing, not malformed.
    """
    parsed = F.expr(f"try_cast(nullif({value}, '') AS double)")
    n = F.count("*").over(W.partitionBy(key, published, period))
    bad = F.col(value).isNotNull() & (F.col(value) != "") & (parsed.isNull() | F.isnan(parsed) | (F.abs(parsed) == float("inf")))
    reason = F.when(bad, "malformed_number").when(n > 1, "ambiguous_duplicate").when(F.col(period) > F.col(published), "invalid_date").when(F.col(key).isNull(), "invalid_key")
    return events.withColumn(number, F.when(~bad, parsed)).withColumn("reason", reason)


def merge_same_day(events: DataFrame, keys: list[str], value: str, ident: str) -> DataFrame:
    """One row per key and value with its idents in order; status CONFLICT where a key has several values, else VALID."""
    merged = events.groupBy(*keys, value).agg(F.sort_array(F.collect_list(ident)).alias("ids"), F.count("*").alias("n"))
    return merged.withColumn("status", F.when(F.count("*").over(W.partitionBy(*keys)) > 1, "CONFLICT").otherwise("VALID"))


def active_until(events: DataFrame, key: str, start: str, length: int) -> DataFrame:
    """(.., until): an event is active for `length` calendar positions, or until the key's next position with an event, which clears it.

    Events of one position share their end.
    """
    w = W.partitionBy(key).orderBy(start).rangeBetween(1, W.unboundedFollowing)
    later = F.min(start).over(w)
    return events.withColumn("until", F.least(F.col(start) + length, F.coalesce(later, F.col(start) + length)) - 1)


def published_by(events: DataFrame, published: str, end) -> tuple[DataFrame, DataFrame]:
    """(events published until `end`, those after it): later ones are left out, not quarantined; a missing date stays to be judged."""
    late = F.coalesce(F.col(published) > F.lit(end).cast("date"), F.lit(False))
    return events.where(~late), events.where(late)
