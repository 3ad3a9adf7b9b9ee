"""Streaming forms: rule hits and windowed counts over arriving lines, and boot numbers by tick reset."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener

from fieldtrace.operators import prescan

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(lines: DataFrame) -> DataFrame:
    """Events of arriving lines; stateless."""
    return prescan.rule_events(lines)


def windowed_counts(events: DataFrame, ts: str, kind: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events per type and five-minute window; rows later than the watermark are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def sessions(events: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of activity per key."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


class _Boots(StatefulProcessor):
    """Keeps of each file its boot number, last tick and last line; forgotten after a time without lines."""

    def __init__(self, by: str, ttl_ms: int):
        self.by, self.ttl_ms = by, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("boot", "boot int, last double, line long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        boot, last, line = self.state.get() if self.state.exists() else (0, None, -1)
        frame = pd.concat(list(rows)).sort_values("line_no", kind="stable")
        numbers, late = [], []
        for n, tick in zip(frame.line_no.tolist(), frame.tick.tolist(), strict=True):
            behind = n <= line
            late.append(behind)
            if not behind:
                if tick == tick:  # lines without a tick belong where they stand
                    boot, last = boot + (last is not None and tick < last), tick
                line = n
            numbers.append(None if behind else boot)
        self.state.update((boot, last, line))
        yield pd.DataFrame({self.by: [key[0]] * len(frame), "line_no": frame.line_no.to_numpy(), "tick": frame.tick.to_numpy(), "boot": pd.array(numbers, "Int32"), "late": late})

    def close(self) -> None:
        pass


def boot_numbers(ticks: DataFrame, by: str = "file_id", ttl_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """Boot number of each arriving line (`by`, line_no, tick): it rises where a tick falls below the last one.

    Lines of a file come in order from batch to batch, in any order within one.  A line that comes behind a later one is
    `late`: it gets no number and changes none.  A file that is silent for `ttl_ms` is forgotten, and begins again at 0.
    """
    ticks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kind = ticks.schema[by].dataType.simpleString()
    own = ticks.select(by, F.col("line_no").cast("long"), F.col("tick").cast("double"))
    return own.groupBy(by).transformWithStateInPandas(_Boots(by, ttl_ms), f"{by} {kind}, line_no long, tick double, boot int, late boolean", "Append", "ProcessingTime")


class Progress(StreamingQueryListener):
    """Progress of streams as rows: the last `keep` reports; one for each `every` rows read at least."""

    SCHEMA = "name string, batch long, read long, total long, seconds double, watermark string, at string"

    def __init__(self, every: int = 0, keep: int = 10_000):
        self.every = every
        self.rows: deque[tuple] = deque(maxlen=keep)
        self.errors: deque[str] = deque(maxlen=keep)
        self.totals: dict[str, int] = {}
        self.shown: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.totals.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        key = str(p.id)
        self.totals[key] = self.totals.get(key, 0) + p.numInputRows
        if self.totals[key] - self.shown.get(key, 0) >= max(1, self.every):
            self.shown[key] = self.totals[key]
            self.rows.append((p.name, p.batchId, p.numInputRows, self.totals[key], (p.batchDuration or 0) / 1000, dict(p.eventTime or {}).get("watermark"), p.timestamp))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.exception:
            self.errors.append(event.exception)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.SCHEMA)
