"""Settling on a feed of observations: when an address showed the same fingerprint several times in a row."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "key string, settled_at timestamp"


class Settling(StatefulProcessor):
    """State of an address: the last fingerprint and how often it was seen in a row; and observations that the watermark hasn't passed, which may still be preceded by others."""

    def __init__(self, times: int):
        self.times = times

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "fingerprint string, n int, done boolean")
        self.waiting = handle.getListState("waiting", "at timestamp, tie string, fingerprint string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.run.exists() and self.run.get()[2]:
            return
        new = [(t.to_pydatetime(), tie, f) for part in rows for t, tie, f in zip(part["at"], part["tie"], part["fingerprint"], strict=True)]
        self.waiting.put(sorted([*self.waiting.get(), *new], key=lambda x: (x[0], x[1])) if self.waiting.exists() else sorted(new, key=lambda x: (x[0], x[1])))
        for at in {x[0] for x in new}:
            self.handle.registerTimer(int(pd.Timestamp(at).value // 1_000_000) + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.waiting.exists():
            return
        passed = timerValues.getCurrentWatermarkInMs()
        last, n, done = self.run.get() if self.run.exists() else (None, 0, False)
        rest, settled = [], None
        for at, tie, fingerprint in self.waiting.get():
            if done:
                break
            if pd.Timestamp(at).value // 1_000_000 >= passed:
                rest.append((at, tie, fingerprint))
                continue
            n = n + 1 if n and fingerprint == last else 1
            last = fingerprint
            if n >= self.times:
                settled, done = at, True
        self.run.update((last, n, done))
        if rest and not done:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if settled is not None:
            yield pd.DataFrame({"key": [key[0]], "settled_at": [settled]})

    def close(self) -> None:
        pass


def settled(observations: DataFrame, key: str = "url", at: str = "fetched_at", tie: str = "seq", fingerprint: str = "fingerprint", times: int = 3, delay: str = "1 hour") -> DataFrame:
    """(key, settled_at) of each address of a stream, once, when the watermark has passed that observation; rows later than `delay` are left out.

    The RocksDB state store is needed, as the state has timers. Of a settled address nothing but that is kept.
    """
    rows = observations.select(F.col(key).cast("string").alias("key"), F.col(at).alias("at"), F.col(tie).cast("string").alias("tie"), F.col(fingerprint).cast("string").alias("fingerprint"))
    grouped = rows.withWatermark("at", delay).groupBy("key")
    return grouped.transformWithStateInPandas(statefulProcessor=Settling(times), outputStructType=SCHEMA, outputMode="Append", timeMode="EventTime")
