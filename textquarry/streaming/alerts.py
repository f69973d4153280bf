"""Alerts on a stream when a project's phase differs from the one before, in keyed state.

Rows may come in any order within the watermark's delay. A key's rows wait in its state until the
watermark has passed them and are then looked at in order of time, so that the alerts of a stream
are those of ``phase_changes`` over a table of the same rows, however they are dealt to batches.
Rows that come later than the watermark are left out. A key that is silent for longer than ``forget``
is forgotten, state and all: its next row is a first one.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..runtime import ship

if TYPE_CHECKING:
    import pandas as pd

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PhaseAlerts(StatefulProcessor):
    """State of a key: the rows that wait (time, phase), and the last that was looked at.

    A timer stands at the earliest row that waits; when it fires, all rows that are due are looked at.
    """

    def __init__(self, keys: list[str], phase: str, time: str, forget_ms: int):
        self.keys, self.phase, self.time, self.forget_ms = keys, phase, time, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, phase string")
        self.last = handle.getValueState("last", "at long, phase string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        new = []
        for frame in rows:
            for at, phase in zip(frame[self.time], frame[self.phase], strict=True):
                us = int(at.value // 1000)
                if us // 1000 > passed:
                    new.append((us, None if phase is None or phase != phase else str(phase)))
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(us for us, _ in new) // 1000)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        import pandas as pd

        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(((r[0], r[1]) for r in self.waiting.get()), key=lambda r: (r[0], r[1] is not None, r[1] or ""))
        due = [r for r in rows if r[0] // 1000 <= passed]
        last = self.last.get() if self.last.exists() else None
        out = []
        for at, phase in due:
            if last is not None and at - last[0] <= self.forget_ms * 1000 and last[1] is not None and phase is not None and phase != last[1]:
                out.append((*key, last[1], phase, pd.Timestamp(at * 1000, tz="UTC")))
            last = (at, phase)
        if due:
            left = rows[len(due) :]
            if left:
                self.waiting.put(left)
                self.handle.registerTimer(left[0][0] // 1000)
            else:
                self.waiting.clear()
            self.last.update(last)
            self.handle.registerTimer(last[0] // 1000 + self.forget_ms + 1)
        elif last is not None and last[0] // 1000 + self.forget_ms < passed:
            self.last.clear()
        if out:
            yield pd.DataFrame(out, columns=[*self.keys, "before", self.phase, self.time])

    def close(self) -> None:
        pass


def phase_alerts(projects: DataFrame, keys: list[str], phase: str = "phase", time: str = "created_at", late: str = "1 hour", forget_days: int = 3650) -> DataFrame:
    """The changes of a stream of rows (keys, phase, time after 1970): keys, before, phase, time. Start it within ``rocks``."""
    ship(projects.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in projects.schema}
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "before string", f"`{phase}` string", f"`{time}` timestamp"])
    timed = projects.select(*keys, F.col(phase).cast("string").alias(phase), F.col(time).cast("timestamp").alias(time)).where(F.col(time).isNotNull()).withWatermark(time, late)
    processor = PhaseAlerts(keys, phase, time, forget_days * 86_400_000)
    return timed.groupBy(*keys).transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, off the heap and checkpointed by increments."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def phase_changes(projects: DataFrame, keys: list[str], phase: str = "phase", time: str = "created_at", forget_days: int = 3650) -> DataFrame:
    """The changes of a table: keys, before, phase, time. Rows of one time are taken in the order of their phase, null first."""
    order = Window.partitionBy(*keys).orderBy(time, F.col(phase).asc_nulls_first())
    recent = F.unix_micros(F.col(time)) - F.unix_micros(F.lag(time).over(order)) <= forget_days * 86_400_000_000
    rows = projects.select(*keys, F.col(phase).cast("string").alias(phase), F.col(time).cast("timestamp").alias(time)).where(F.col(time).isNotNull())
    seen = rows.withColumns({"before": F.lag(phase).over(order), "_recent": recent})
    return seen.where(F.col("_recent") & (F.col("before") != F.col(phase))).select(*keys, "before", phase, time)
