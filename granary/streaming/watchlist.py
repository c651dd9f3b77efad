"""A list of watched keys with a time to live, kept as the state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a watched() stream says: an entry begins, is renewed, is hit by an event, or ends.
BEGUN, RENEWED, HIT, ENDED = "begun", "renewed", "hit", "ended"


class Watch(StatefulProcessor):
    """One key: until when it is watched. A timer at that time ends it; a renewal moves the timer."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        made, seen = [], pd.concat(list(rows)).sort_values(["ts", "kind"], kind="stable")
        until = self.until.get()[0] if self.until.exists() else None
        for kind, ts in zip(seen["kind"], seen["ts"], strict=True):
            at = int(ts.timestamp() * 1000)
            live = until is not None and at < until
            if kind == "watch":
                if until is not None:
                    self.handle.deleteTimer(until)
                    if not live:
                        made.append((key[0], ENDED, until))
                until = at + self.seconds * 1000
                self.handle.registerTimer(until)
                self.until.update((until,))
                made.append((key[0], RENEWED if live else BEGUN, at))
            elif live:
                made.append((key[0], HIT, at))
        yield told(made)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = self.until.get()[0] if self.until.exists() else None
        made = []
        if until is not None and until <= expiredTimerInfo.getExpiryTimeInMs():
            self.until.clear()
            made.append((key[0], ENDED, until))
        yield told(made)

    def close(self) -> None:
        pass


def told(rows: list[tuple]) -> pd.DataFrame:
    text = lambda i: pd.Series([str(r[i]) for r in rows], dtype=object)
    return pd.DataFrame({"key": text(0), "state": text(1), "at_ms": pd.Series([r[2] for r in rows], dtype="int64")})


def watched(rows: DataFrame, key: str, seconds: int, late: str) -> DataFrame:
    """(key, state, at_ms) of a stream of rows (key, kind, ts): kind "watch" begins or renews an entry for so many seconds, any other kind is an
    event, told only while its key is watched. The state of a key goes when its time is over, by event time."""
    keyed = rows.select(F.col(key).cast("string").alias("key"), "kind", "ts").withWatermark("ts", late).groupBy("key")
    return keyed.transformWithStateInPandas(statefulProcessor=Watch(seconds), outputStructType="key string, state string, at_ms long", outputMode="Append", timeMode="EventTime")
