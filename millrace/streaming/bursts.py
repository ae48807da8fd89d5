"""Burst detection as a stream: a mode for each source in keyed state, with a timer that ends the burst of a source that falls silent."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from millrace.functions.workers import importable
from millrace.operators.tuning import BURST
from millrace.streaming.queries import _ROCKS, _STORE, TIMES, TRIGGER, _started

COLUMNS = ["source", "at", "total", "delta", "mode", "refresh_seconds"]
SCHEMA = "source string, at timestamp, total long, delta long, mode string, refresh_seconds int"
#: Refresh intervals of both modes, in seconds.
REFRESH = {"burst": 5, "normal": 1}


class BurstMode(StatefulProcessor):
    """A source's total, mode and last sample; samples come in the order of time.

    A source without a sample for ``silence`` milliseconds falls back to normal at that moment: by its timer, or when its next sample shows the gap,
    whichever comes first, so that batches make no difference: the timer waits ``grain`` longer, until a sample of that moment would be known. Its state goes ``keep`` milliseconds after the last sample: it then starts anew.
    """

    def __init__(self, threshold: int, silence: int, keep: int, grain: int) -> None:
        self.threshold, self.silence, self.keep, self.grain = threshold, silence, keep, grain

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "total long, mode string, last long")

    def _fall(self, key: tuple, total: int, last: int) -> tuple:
        return (key[0], pd.Timestamp(last + self.silence, unit="ms"), total, 0, "normal", REFRESH["normal"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        samples = pd.concat(list(rows)).sort_values("at")
        total, mode, last = self.state.get() if self.state.exists() else (0, "normal", None)
        out = []
        for at, count in zip(samples["at"], samples["count"].astype(int), strict=True):
            now = int(at.timestamp() * 1000)
            if last is not None and now - last > self.keep:
                total, last = 0, None if mode == "normal" else last
            if last is not None and mode == "burst" and now - last > self.silence:
                out.append(self._fall(key, total, last))
                mode = "normal"
            # The first sample has nothing to be compared with.
            delta = count if total else 0
            total, last = total + count, now
            turned = "burst" if delta >= self.threshold else "normal"
            if turned != mode:
                mode = turned
                out.append((key[0], at, total, delta, mode, REFRESH[mode]))
        self._wait(int(total), mode, last)
        yield pd.DataFrame(out, columns=COLUMNS)

    def _wait(self, total: int, mode: str, last: int) -> None:
        """Keeps the state and one timer: for the end of a burst, or for the end of the state."""
        self.state.update((total, mode, last))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        self.handle.registerTimer(last + (self.silence if mode == "burst" else self.keep) + self.grain + 1)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        if self.state.exists():
            total, mode, last = self.state.get()
            if mode == "burst":
                out.append(self._fall(key, total, last))
                self.state.update((total, "normal", last))
                self.handle.registerTimer(last + self.keep + self.grain + 1)
            else:
                self.state.clear()
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        """Nothing to close."""


def transitions(events: DataFrame, grain: str = "1 hour", threshold: int = BURST, silence: timedelta = timedelta(minutes=90), keep: timedelta = timedelta(days=30), watermark: str = "2 minutes") -> DataFrame:
    """Transitions of each event type between normal and burst, from its counts in closed windows. Starts with the RocksDB state store only."""
    importable(events.sparkSession)
    counted = events.withWatermark("event_time", watermark).groupBy(F.window("event_time", grain).alias("w"), F.col("event_type").alias("source")).agg(F.count("*").alias("count"))
    # The window's own column keeps the watermark that the timers go by.
    samples = counted.select("source", F.col("w.start").alias("at"), "count", F.window_time("w").alias("closed"))
    mode = BurstMode(threshold, *(int(x.total_seconds() * 1000) for x in (silence, keep, pd.Timedelta(grain))))
    return samples.groupBy("source").transformWithStateInPandas(mode, SCHEMA, "Append", "EventTime")


def write_bursts(events: DataFrame, path: str, checkpoint: str, once: bool = False, **kinds) -> StreamingQuery:
    """Appends transitions as JSON files."""
    writer = transitions(events, **kinds).writeStream.outputMode("append").format("json").option("timestampFormat", TIMES).option("path", path).option("checkpointLocation", checkpoint)
    conf = events.sparkSession.conf
    before = conf.get(_STORE)
    conf.set(_STORE, _ROCKS)
    try:
        return _started(writer, once, TRIGGER).start()
    finally:
        conf.set(_STORE, before)
