"""Keyed state machines: those by days in batches of keys (:mod:`.days`), and two for ``transformWithState`` row by row.

State that is to go after a time is cleared by a timer.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from . import days


class Retract(StatefulProcessor):
    """Each row, and before each repeat of a key the row before it with its amounts negated and its own time.

    The last row is kept until ``seconds`` of event time have passed.
    """

    seconds = 10

    def __init__(self, schema: T.StructType, amounts: list[str]):
        self.schema, self.amounts = schema, amounts

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("row", self.schema)

    def handleInputRows(self, key, rows, timerValues):
        make = Row(*self.schema.names)
        before = make(*self.state.get()) if self.state.exists() else None
        for row in rows:
            if before is not None:
                values = before.asDict()
                yield make(*(-v if n in self.amounts and v is not None else v for n, v in values.items()))
            yield row
            before = row
        self.state.update(tuple(before[n] for n in self.schema.names))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(int((before["row_time"] + timedelta(seconds=self.seconds)).timestamp() * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.state.exists():
            self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


class LastWithin(StatefulProcessor):
    """Of the rows of a key the one with the largest ``row_ts``, given when ``seconds`` have passed since the first."""

    seconds = 5

    def __init__(self, schema: T.StructType):
        self.schema = schema

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("row", self.schema)

    def handleInputRows(self, key, rows, timerValues):
        best = Row(*self.schema.names)(*self.state.get()) if self.state.exists() else None
        if best is None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.seconds * 1000)
        for row in rows:
            if best is None or row["row_ts"] >= best["row_ts"]:
                best = row
        self.state.update(tuple(best))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        row = Row(*self.schema.names)(*self.state.get())
        self.state.clear()
        yield row

    def close(self) -> None:
        pass


def _add(schema: T.StructType, *names: str) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(n, T.LongType()) for n in names)])


_METRIC = T.StructType([T.StructField("row_time", T.TimestampType())])


def apply(df: DataFrame, processor: StatefulProcessor, key: str, schema: T.StructType, time_mode: str = "eventTime") -> DataFrame:
    """Runs a processor by key; in event time the rows it gives keep ``row_time`` and its watermark, so that a window may follow."""
    times = {"eventTimeColumnName": "row_time"} if time_mode == "eventTime" and "row_time" in schema.names else {}
    return df.groupBy(key).transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode=time_mode, **times)


def repair_is_new(df: DataFrame, key: str = "mid") -> DataFrame:
    return days.apply(df, days.RepairIsNew(key), df.schema)


def repair_logs(df: DataFrame, key: str = "device") -> DataFrame:
    """As :func:`repair_is_new`, but no row is late, as the state is not bound to event time; rows without a time pass as they are."""
    return days.apply(df, days.RepairIsNew(key), df.schema, event_time=False)


def daily_visitors(df: DataFrame, key: str = "mid") -> DataFrame:
    """Adds ``uv``; a key's state goes after a day."""
    return days.apply(df, days.DailyVisitor(key, 1), _add(df.schema, "uv"))


def home_detail_visitors(df: DataFrame, key: str = "mid") -> DataFrame:
    return days.apply(df, days.HomeDetailVisitor(key, 1), _add(_METRIC, "home_uv", "detail_uv"))


def daily_users(df: DataFrame, key: str = "user_id") -> DataFrame:
    return days.apply(df, days.DailyUser(key), df.schema)


def login_metrics(df: DataFrame, key: str = "user_id") -> DataFrame:
    return days.apply(df, days.Login(key), _add(_METRIC, "uu", "back"))


def retracted(df: DataFrame, amounts: list[str], key: str = "id") -> DataFrame:
    """Rows with their repeats taken back: ``amounts`` are numbers."""
    return apply(df, Retract(df.schema, amounts), key, df.schema)


def last_within(df: DataFrame, key: str = "id") -> DataFrame:
    """The last of a key's rows by ``row_ts`` within five seconds of processing time from the first."""
    return apply(df, LastWithin(df.schema), key, df.schema, time_mode="processingTime")
