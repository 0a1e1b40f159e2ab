"""Tables that streams look values up in, as they stand when a batch begins."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from ..sinks.store import KeyedStore, Version


class Lookup(Protocol):
    def current(self, spark: SparkSession) -> DataFrame: ...


class Aged:
    """A dictionary that another system keeps: held for ``max_age`` seconds after it was read, then read anew."""

    def __init__(self, read: Callable[[SparkSession], DataFrame], max_age: float = 3_600, clock: Callable[[], float] = time.monotonic):
        self._read, self._max_age, self._clock = read, max_age, clock
        self._held: DataFrame | None = None
        self._since = 0.0

    def current(self, spark: SparkSession) -> DataFrame:
        if self._held is None or self._clock() - self._since >= self._max_age:
            if self._held is not None:
                self._held.unpersist()
            self._held, self._since = self._read(spark).persist(), self._clock()
        return self._held


class Snapshot:
    """What ``pick`` takes of a :class:`KeyedStore`, by the version that its writer has named last: held until there is a newer one.

    So an update shows in the next batch, without a restart, and a batch sees one version of it throughout. ``max_age``
    bounds in seconds how long rows are held at all. Before the first version there are no rows, of ``schema``.
    """

    def __init__(self, store: KeyedStore, schema: str, pick: Callable[[DataFrame], DataFrame] = lambda rows: rows, max_age: float = 86_400, clock: Callable[[], float] = time.monotonic):
        self._store, self._schema, self._pick, self._max_age, self._clock = store, schema, pick, max_age, clock
        self._held: tuple[Version, DataFrame] | None = None
        self._since = 0.0

    def current(self, spark: SparkSession) -> DataFrame:
        version = self._store.version(spark)
        if version is None:
            return self._pick(spark.createDataFrame([], self._schema))
        if self._held is None or self._held[0] != version or self._clock() - self._since >= self._max_age:
            if self._held is not None:
                self._held[1].unpersist()
            self._held, self._since = (version, self._pick(self._store.read(spark, version)).persist()), self._clock()
        return self._held[1]
