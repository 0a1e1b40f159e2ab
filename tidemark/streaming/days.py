"""Keyed state by days, a batch of many keys at a time: what a key's last (or first) day was, for ``transformWithStateInPandas``.

Keys are dealt over buckets, and a bucket's state is a map by key. So a batch comes as a few large frames, whose rows
are worked out by columns; per key only its state is read and written. Rows of a key are taken in the order of their
time within a batch, rows of one time in the order they came in.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

#: Below every day.
NEVER = np.iinfo(np.int64).min
_DAY_MS = 86_400_000


class Days(StatefulProcessor):
    """Calls ``step`` with a bucket's rows; ``ttl_days`` after a key's last day its state goes."""

    #: Whether rows without a time, which have no place among a key's days, are given as they are; else they go.
    gives_untimed = False

    def __init__(self, key: str, ttl_days: int | None = None):
        self.key, self.ttl_days = key, ttl_days

    def init(self, handle) -> None:
        self.handle, self.days = handle, handle.getMapState("days", "key string", "day long")

    def names(self, frame: pd.DataFrame) -> pd.Series:
        """What state is kept by."""
        return frame[self.key]

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows), ignore_index=True)
        timed = frame["row_time"].notna()
        if self.gives_untimed and not timed.all():
            yield frame[~timed].drop(columns="__bucket", errors="ignore")
        frame = frame[timed]
        if not len(frame):
            return
        frame = frame.sort_values("row_time", kind="stable", ignore_index=True)
        day = frame["row_time"].to_numpy().astype("datetime64[D]").astype(np.int64)
        codes, names = pd.factorize(self.names(frame).fillna("\x1f"))
        known = np.array([self._read(n) for n in names], np.int64)
        order = np.argsort(codes, kind="stable")
        first = np.zeros(len(codes), bool)
        first[order] = np.concatenate(([True], codes[order][1:] != codes[order][:-1]))
        before = np.empty(len(codes), np.int64)
        before[order] = np.concatenate(([NEVER], day[order][:-1]))
        before[first] = known[codes[first]]
        out, kept = self.step(frame.drop(columns="__bucket", errors="ignore"), day, before, first, codes, known)
        for name, old, new in zip(names, known.tolist(), kept.tolist()):
            if new != old:
                self.days.updateValue((name,), (new,))
        if self.ttl_days:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(int(day.max() + 1 + self.ttl_days) * _DAY_MS)
        yield out

    def _read(self, name: str) -> int:
        return self.days.getValue((name,))[0] if self.days.containsKey((name,)) else NEVER

    def last(self, day: np.ndarray, codes: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Each key's state if it is the day of its last row."""
        kept = known.copy()
        kept[codes] = day  # later rows come later
        return kept

    def step(self, frame, day, before, first, codes, known) -> tuple[pd.DataFrame, np.ndarray]:
        """The rows to give and each key's state; ``before`` is the day of the row before, of the state or ``NEVER``."""
        raise NotImplementedError

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        past = timerValues.getCurrentWatermarkInMs() // _DAY_MS - self.ttl_days
        old = [name for (name,), (day,) in self.days.iterator() if day < past]
        for name in old:
            self.days.removeKey((name,))
        if self.days.exists():
            self.handle.registerTimer((past + 2 * self.ttl_days + 1) * _DAY_MS)
        return iter([])

    def close(self) -> None:
        pass


class RepairIsNew(Days):
    """Later claims of a new device on another day than its first become 0; the first row sets the day, the day before unless it says new."""

    gives_untimed = True

    def step(self, frame, day, before, first, codes, known):
        claims = (frame["is_new"] == "1").to_numpy(bool)
        starts = first & (known[codes] == NEVER)
        state = known.copy()
        state[codes[starts]] = np.where(claims, day, day - 1)[starts]
        wrong = claims & ~starts & (state[codes] != day)
        return frame.assign(is_new=frame["is_new"].mask(wrong, "0")), state


class DailyVisitor(Days):
    """Adds ``uv``: 1 for a key's first row of a day."""

    def step(self, frame, day, before, first, codes, known):
        return frame.assign(uv=(before != day).astype(np.int64)), self.last(day, codes, known)


class HomeDetailVisitor(Days):
    """``home_uv`` and ``detail_uv``, by two states; rows without either are not given."""

    def names(self, frame):
        return frame[self.key].fillna("\x1f") + "\x1e" + np.where(frame["page_id"] == "home", "home", "detail")

    def step(self, frame, day, before, first, codes, known):
        new, home = before != day, (frame["page_id"] == "home").to_numpy(bool)
        out = pd.DataFrame({"row_time": frame["row_time"], "home_uv": home.astype(np.int64), "detail_uv": (~home).astype(np.int64)})
        return out[new], self.last(day, codes, known)


class DailyUser(Days):
    """A key's first row of a day; others are not given."""

    def step(self, frame, day, before, first, codes, known):
        return frame[before != day], self.last(day, codes, known)


class Login(Days):
    """``uu`` for a key's first login of a day, ``back`` for one eight days or more after the last."""

    def step(self, frame, day, before, first, codes, known):
        new = before != day
        back = (before != NEVER) & (day - np.where(before == NEVER, day, before) >= 8)
        return pd.DataFrame({"row_time": frame["row_time"], "uu": 1, "back": back.astype(np.int64)})[new], self.last(day, codes, known)


def apply(df: DataFrame, processor: Days, schema: T.StructType, event_time: bool = True, buckets: int | None = None) -> DataFrame:
    """Runs a processor over ``buckets`` of its key, as many as shuffle partitions unless given; their number is the checkpoint's for good.

    In event time the rows given keep ``row_time`` and its watermark, so that a window may follow.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(processor.key), F.lit(buckets)).cast("int"))
    mode = {"timeMode": "eventTime", "eventTimeColumnName": "row_time"} if event_time else {"timeMode": "none"}
    return dealt.groupBy("__bucket").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", **mode)
