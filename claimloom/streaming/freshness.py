"""Which ids are due for another check, by state timers: one value and one timer an id."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from claimloom.functions.scalars import instant

#: The state store that keeps timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Freshness(StatefulProcessor):
    """Holds an id's last check, in microseconds, and a timer when it has lasted its time."""

    def __init__(self, lasts_ms: int):
        self.lasts_ms = lasts_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        checks = [x for part in rows for x in part["checked"].tolist() if not pd.isna(x)]
        held = self.last.get()[0] if self.last.exists() else None
        if not checks:  # nothing that reads as a time: as if it had never been checked
            if held is None:
                yield self._due(key, None)
            return
        latest = int(max(checks))
        if held is not None and held >= latest:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((latest,))
        due = latest // 1000 + self.lasts_ms
        if due <= timerValues.getCurrentWatermarkInMs():  # late already
            yield self._due(key, latest)
        else:
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._due(key, self.last.get()[0])

    def _due(self, key, last) -> pd.DataFrame:
        return pd.DataFrame({"id": [str(key[0])], "last": pd.Series([None if last is None else pd.Timestamp(last, unit="us")], dtype="datetime64[us]")})

    def close(self) -> None:
        pass


def due(log: DataFrame, lasts_days: float, id_col: str = "id", checked_col: str = "checked_at", time_col: str = "at", late: str = "0 seconds") -> DataFrame:
    """(id, last): an id when its last check is ``lasts_days`` old by the watermark of ``time_col``, each time that comes about.

    ``checked_col`` is text or a time. One that does not read as a time counts for nothing: an id with no other is due at
    once, with no ``last``. A time in the future is believed, and lasts from then on. A check that comes later moves the
    timer. Set ``spark.sql.streaming.stateStore.providerClass`` to ``PROVIDER`` before the stream starts.
    """
    kinds = dict(log.dtypes)
    checked = instant(F.col(checked_col)) if kinds[checked_col] == "string" else F.col(checked_col).cast("timestamp")
    rows = log.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.unix_micros(checked).alias("checked"), time_col).withWatermark(time_col, late)
    schema = StructType([StructField("id", StringType()), StructField("last", TimestampType())])
    return rows.groupBy("id").transformWithStateInPandas(_Freshness(int(lasts_days * 86_400_000)), schema, "append", "eventTime")
