"""What a run did: stages with their outcome, and counters observed while rows are written, in an audit table."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from fieldtrace.sources.versions import Tables

SCHEMA = "bundle_id string, stage string, status string, at double, seconds double, message string, counters map<string,long>"


class Audit:
    """Rows about one run; `flush` adds them to the table `audit` of a folder, if there is one."""

    def __init__(self, spark: SparkSession, run: str, folder: str | None = None):
        self.spark, self.run, self.folder = spark, run, folder
        self.rows: list[tuple] = []
        self.observed: dict[str, list[Observation]] = {}

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        """A stage begins, and ends well or with an error, which passes on."""
        begun = time.time()
        self.rows.append((self.run, name, "start", begun, None, None, {}))
        try:
            yield
        except BaseException as e:
            self.rows.append((self.run, name, "error", time.time(), time.time() - begun, str(e)[:500], {}))
            self.flush()
            raise
        self.rows.append((self.run, name, "ok", time.time(), time.time() - begun, None, self.counters(name)))

    def counted(self, stage: str, df: DataFrame, **counters: Column) -> DataFrame:
        """`df`, whose rows are counted as they pass: no second scan.  The frame must be run once, within the stage."""
        seen = Observation()
        self.observed.setdefault(stage, []).append(seen)
        return df.observe(seen, *(c.alias(k) for k, c in counters.items()))

    def counters(self, stage: str) -> dict[str, int]:
        """Counters of a stage that has run; equal names add up."""
        out: dict[str, int] = {}
        for seen in self.observed.get(stage, ()):
            for k, v in seen.get.items():
                out[k] = out.get(k, 0) + (v or 0)
        return out

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, SCHEMA)

    def flush(self) -> None:
        if self.folder and self.rows:
            Tables(self.spark, self.folder).append({"audit": self.table()})
            self.rows = []
