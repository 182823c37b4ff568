"""Fiscal precedence over a stream of published statements.

State per key: the events whose date the watermark has not passed yet, the newest period so far, and the event that
counts now. Keys are kept by groups; an event-time timer stands at the first publication date or end of a value in a group; when
the watermark passes it, the events of the dates passed are judged in order, however they came in, and the next timer is set. What leaves the
stream is each value with the dates on which it counts, so a batch interval join gives what a batch as-of join gives.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Days for which a publication and a fiscal period count.
PUBLICATION_AGE, FISCAL_AGE = 400, 550
DAY_MS = 86_400_000
#: Groups of keys. Keys of a group are called together and kept in one value, since each call and each access to the state leaves the Python worker.
GROUPS = 512


class Precedence(StatefulProcessor):
    """Events (key, pub, stat, ord, value) of a group of keys in, (key, pub, stat, value, from_day, to_day) out; days count from 1970-01-01.

    A group's state is one value, {key: [pending events by day, newest period so far, the event that counts now]} with events
    (day, stat, ord, value), and the day at whose end the group's timer stands: the first at which it has something to do.
    """

    def __init__(self, publication_age: int = PUBLICATION_AGE, fiscal_age: int = FISCAL_AGE):
        self.publication_age, self.fiscal_age = publication_age, fiscal_age

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "keys binary, due int")

    def read(self) -> tuple[dict, int | None]:
        known = self.state.get()
        return (pickle.loads(bytes(known[0])), known[1]) if known else ({}, None)

    def write(self, keys: dict, due: int | None) -> None:
        """Notes the state, with a timer at the first day that waits or at which a value ends, unless one stands at `due` that comes no later."""
        # The watermark passes a date when nothing of it can come any more.
        first = min((day for pending, _, current in keys.values() for day in (*pending, *([self.ends(*current[:2])] if current else []))), default=None)
        if first is not None and (due is None or first < due):
            self.handle.registerTimer((first + 1) * DAY_MS)
            due = first
        self.state.update((pickle.dumps(keys), due))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        keys, due = self.read()
        for t in rows:
            for k, day, stat, order, value in zip(*(t[c].tolist() for c in ("key", "day", "stat", "ord", "value")), strict=True):
                event = (int(day), int(stat), int(order), None if pd.isna(value) else float(value))
                pending = keys.setdefault(k, [{}, None, None])[0]
                # Of one publication date the newest period counts, of equal ones the highest order.
                if event[0] not in pending or pending[event[0]][1:3] < event[1:3]:
                    pending[event[0]] = event
        self.write(keys, due)
        yield from ()

    def ends(self, pub: int, stat: int) -> int:
        return min(pub + self.publication_age, stat + self.fiscal_age)

    def judged(self, known: list, passed: int) -> Iterator[tuple]:
        """A key's values that end by the day `passed`, up to which every day has come whole, with the days on which they counted."""
        pending, newest, current = known
        for day in [*sorted(d for d in pending if d <= passed), None]:
            event = pending.pop(day, None)
            if event and newest is not None and event[1] < newest:
                continue
            # A value counts from the day after its publication.
            if current and (event or self.ends(*current[:2]) <= passed):
                pub, stat, _, value = current
                until = self.ends(pub, stat) if event is None else min(day, self.ends(pub, stat))
                if pub < until:
                    yield pub, stat, value, pub + 1, until
                current = None
            if event:
                newest, current = event[1], event
        known[1:] = newest, current

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # The first timer of a group does the work of all that the watermark has passed.
        passed = timerValues.getCurrentWatermarkInMs() // DAY_MS - 1
        keys, due = self.read()
        out = [(k, *row) for k, known in keys.items() for row in self.judged(known, passed)]
        # A timer that stood up to now has gone off.
        self.write(keys, due if due is not None and due > passed else None)
        if out:
            names, days = ("key", "pub", "stat", "value", "from_day", "to_day"), ("pub", "stat", "from_day", "to_day")
            yield pd.DataFrame({c: list(x) for c, x in zip(names, zip(*out, strict=True), strict=True)}).astype({c: "int32" for c in days} | {"value": "float64"})

    def close(self) -> None:
        pass


def validity(events: DataFrame, key: str, published: str, period: str, order: str, value: str, lateness: str, publication_age: int = PUBLICATION_AGE, fiscal_age: int = FISCAL_AGE, groups: int = GROUPS) -> DataFrame:
    """(key, pub, stat, value, start_dt, end_dt) of a stream of events that come at most `lateness` after the newest date so far; later ones are dropped by the watermark.

    An event of an older period than one published before is dropped. A value counts from the day after its publication until, and on, the day of
    the next event, publication_age days after it and fiscal_age days after its period, whichever is first. The newest event counts
    even if its value is null. Events without a key, date or period are dropped. A value leaves when the watermark passes the end of its days.
    The session's state store must be RocksDB's. Keys are dealt out to `groups` by their hash; all that is kept of the keys of one is read and written together.
    """
    days = lambda c: F.unix_date(F.col(c).cast("date"))
    told = events.where(F.col(key).isNotNull() & F.col(published).isNotNull() & F.col(period).isNotNull())
    rows = told.select(F.pmod(F.xxhash64(key), F.lit(groups)).cast("int").alias("group"), F.col(key).alias("key"), F.col(published).cast("timestamp").alias("at"), days(published).alias("day"), days(period).alias("stat"), F.col(order).cast("long").alias("ord"), F.col(value).cast("double").alias("value"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.withWatermark("at", lateness).groupBy("group").transformWithStateInPandas(Precedence(publication_age, fiscal_age), f"key {kind}, pub int, stat int, value double, from_day int, to_day int", "Append", "EventTime")
    date = lambda c: F.date_from_unix_date(c)
    return out.select("key", date("pub").alias("pub"), date("stat").alias("stat"), "value", date("from_day").alias("start_dt"), date("to_day").alias("end_dt"))


def batches(df: DataFrame, number: Column, path: str, most: int) -> None:
    """Rows in arrival order for a file stream: one write for each batch number, 0 to most - 1, so that files are listed in that order."""
    for n in range(most):
        df.where(number == n).coalesce(1).write.mode("append").parquet(path)
