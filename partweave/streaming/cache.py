"""A cache whose entries expire a fixed time after they were put, over a table and over a stream.

A get finds an entry put at most ``ttl`` seconds before; it does not refresh it, and an expired one goes.  A miss puts
the value; a full cache first loses the entry that was put first, whatever its key.  Accesses of one cache are read in
time order with its entries at hand, never gathered: what is held is at most ``most`` entries, or one time for a key
in a cache without bound.  The order of one cache's accesses decides what is found, so a cache is read by one task;
keys of caches without bound do not touch one another and are dealt apart.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TTL, MOST = 3600, 64
OUT = "cache string, key string, ts double, id long, hit boolean"


def access(entries: OrderedDict, key: str, ts: float, ttl: float, most: int | None) -> bool:
    """Whether the cache holds the key; if not, it does from now on.  ``entries`` are in the order they were put."""
    put = entries.get(key)
    if put is not None and ts - put <= ttl:
        return True
    entries.pop(key, None)
    if most is not None and len(entries) >= most:
        entries.popitem(last=False)
    entries[key] = ts
    return False


def accesses(events: DataFrame, ttl: float = TTL, most: int | None = MOST) -> DataFrame:
    """``events(cache, key, ts, id)`` -> ``(cache, key, ts, id, hit)``: whether each access found an entry.

    Accesses of one time go by ``id``.  ``most=None``: caches without bound.
    """
    by = ["cache"] if most is not None else ["cache", "key"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, entries = None, OrderedDict()
        for pdf in batches:
            found = []
            for at, key, ts in zip(zip(*[pdf[c] for c in by], strict=True), pdf["key"], pdf["ts"], strict=True):
                if at != current:
                    current, entries = at, OrderedDict()
                found.append(access(entries, key, ts, ttl, most))
            yield pdf.assign(hit=found)

    e = events.select(F.col("cache").cast("string").alias("cache"), F.col("key").cast("string").alias("key"), F.col("ts").cast("double").alias("ts"), F.col("id").cast("long").alias("id"))
    return e.where("key IS NOT NULL AND ts IS NOT NULL").repartition(*by).sortWithinPartitions(*by, "ts", "id").mapInPandas(run, OUT)


def hits(events: DataFrame, key: str = "key", ts: str = "ts", tie: str = "id", ttl: float = TTL) -> DataFrame:
    """-> ``(key, ts, id, hit)``: accesses of a cache without bound on its entries; ``ts`` are seconds."""
    e = events.select(F.lit("").alias("cache"), F.col(key).alias("key"), F.col(ts).alias("ts"), F.col(tie).alias("id"))
    return accesses(e, ttl, None).select("key", "ts", "id", "hit")


class CacheState(StatefulProcessor):
    """The entries of one cache between micro-batches; a timer drops them ``ttl`` after the last access."""

    def __init__(self, ttl: float, most: int | None):
        self.ttl, self.most = ttl, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getValueState("entries", "keys array<string>, puts array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        entries = OrderedDict()
        if self.entries.exists():
            keys, puts = self.entries.get()
            entries = OrderedDict(zip(keys, puts, strict=True))
        pdf = pd.concat(rows).sort_values(["ts", "id"], kind="stable")  # one cache's rows of one micro-batch: the trigger bounds them
        found = [access(entries, k, t, self.ttl, self.most) for k, t in zip(pdf["key"], pdf["ts"], strict=True)]
        self.entries.update((list(entries), list(entries.values())))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(timerValues.getCurrentProcessingTimeInMs() + self.ttl * 1000))
        yield pdf[["cache", "key", "ts", "id"]].assign(hit=found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.entries.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_accesses(events: DataFrame, ttl: float = TTL, most: int | None = MOST) -> DataFrame:
    """``accesses`` over a stream ``(cache string, key string, ts double, id long)`` whose micro-batches follow in time.

    State needs the RocksDB store (``spark.sql.streaming.stateStore.providerClass``).
    """
    by = ["cache"] if most is not None else ["cache", "key"]
    e = events.select("cache", "key", "ts", "id").where("key IS NOT NULL AND ts IS NOT NULL")
    return e.groupBy(*by).transformWithStateInPandas(CacheState(ttl, most), OUT, "Append", "ProcessingTime")


def stream_hits(events: DataFrame, ttl: float = TTL) -> DataFrame:
    """``hits`` over a stream ``(key string, ts double, id long)``; state is one time per key."""
    return stream_accesses(events.select(F.lit("").alias("cache"), "key", "ts", "id"), ttl, None).select("key", "ts", "id", "hit")


def evict(entries: DataFrame, most: int = MOST) -> DataFrame:
    """The newest entries ``(key, ts)``, as many as the cache holds."""
    return entries.orderBy(F.col("ts").desc(), "key").limit(most)
