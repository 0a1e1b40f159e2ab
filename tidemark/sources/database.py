"""A database table as a stream: its rows as they stood when the stream began, then its change log."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..names import plain_name


def connection(connect: str, arguments: str):
    """A DB-API connection: ``connect`` names the function as module:function, ``arguments`` is a JSON list for it."""
    module, _, function = connect.partition(":")
    return getattr(import_module(module), function)(*json.loads(arguments))


@dataclass
class Rows(InputPartition):
    """Rows of the snapshot with ``low <= key < high``, as of a place in the log."""

    low: int | None
    high: int | None
    seq: int


@dataclass
class Changes(InputPartition):
    """Entries of the log with ``after < seq <= upto``."""

    after: int
    upto: int


class _Reader(DataSourceStreamReader):
    """Offsets say whether the snapshot is read, and up to where the log is.

    The first batch reads the snapshot as of the log's place that the checkpoint holds for it: a row that the log has
    changed since is taken as it was before that change. So a replay gives the same rows, whatever has happened
    meanwhile, parts of a snapshot agree though each reads in a transaction of its own, and the log goes on right there.
    """

    def __init__(self, options: dict[str, str]):
        self.options = options
        self.table, self.log, self.key = (plain_name(options[n]) for n in ("table", "log", "key"))
        self.parts, self.most = int(options.get("partitions", "4")), int(options.get("entries", "100000"))

    def _connect(self):
        return connection(self.options["connect"], self.options["arguments"])

    def _one(self, sql: str) -> tuple:
        own = self._connect()
        try:
            cursor = own.cursor()
            cursor.execute(sql)
            return cursor.fetchone()
        finally:
            own.close()

    def initialOffset(self) -> dict:
        return {"snapshot": 0, "seq": -1}

    def latestOffset(self) -> dict:
        return {"snapshot": 1, "seq": self._one(f"select coalesce(max(seq), -1) from {self.log}")[0]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if start["snapshot"]:
            bounds = [*range(start["seq"], end["seq"], self.most), end["seq"]]
            return [Changes(a, b) for a, b in zip(bounds, bounds[1:])]
        low, high = self._one(f"select min({self.key}), max({self.key}) from {self.table}")
        if low is None:
            return [Rows(None, None, end["seq"])]
        step = (high - low) // self.parts + 1
        bounds = [None, *range(low + step, high + 1, step), None]
        return [Rows(a, b, end["seq"]) for a, b in zip(bounds, bounds[1:])]

    def read(self, partition) -> Iterator[tuple[str]]:
        own = self._connect()
        try:
            cursor = own.cursor()
            yield from self._changes(cursor, partition) if isinstance(partition, Changes) else self._rows(cursor, partition)
        finally:
            own.close()

    def _changes(self, cursor, part: Changes) -> Iterator[tuple[str]]:
        cursor.execute(f"select seq, op, before_row, after_row, ts_ms from {self.log} where seq > {int(part.after)} and seq <= {int(part.upto)} order by seq")
        for seq, op, before, after, ts_ms in cursor:
            yield (json.dumps({"before": before and json.loads(before), "after": after and json.loads(after), "op": op, "ts_ms": ts_ms, "seq": seq}),)

    def _rows(self, cursor, part: Rows) -> Iterator[tuple[str]]:
        cursor.execute("begin")  # rows and log are read as of one moment
        within = lambda key: key is not None and (part.low is None or key >= part.low) and (part.high is None or key < part.high)
        cursor.execute(f"select before_row, after_row from {self.log} where seq > {int(part.seq)} order by seq")
        since: dict[int, dict | None] = {}
        for before, after in cursor:
            before = before and json.loads(before)
            since.setdefault((before or json.loads(after))[self.key], before or None)
        bounds = [*([f"{self.key} >= {int(part.low)}"] if part.low is not None else []), *([f"{self.key} < {int(part.high)}"] if part.high is not None else [])]
        cursor.execute(f"select * from {self.table}" + (f" where {' and '.join(bounds)}" if bounds else ""))
        names = [d[0] for d in cursor.description]
        give = lambda row: (json.dumps({"before": None, "after": row, "op": "r", "ts_ms": 0, "seq": part.seq}),)
        for values in cursor:
            row = dict(zip(names, values))
            if row[self.key] not in since:
                yield give(row)
        for key, row in since.items():
            if row is not None and within(key):
                yield give(row)


class ChangeTable(DataSource):
    """The data source ``change_table``: ``value string``, change events as JSON with ``before, after, op, ts_ms, seq``."""

    @classmethod
    def name(cls) -> str:
        return "change_table"

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(dict(self.options))


def table_changes(spark: SparkSession, connect: str, arguments: list, table: str, log: str, key: str, **options: str) -> DataFrame:
    """A stream of a table's rows (``op`` r) and then of the entries of its log, none lost and none twice over restarts.

    ``key`` is a whole number. The log has ``seq, op, before_row, after_row, ts_ms``: ``seq`` grows with each entry, rows
    are JSON objects of all columns, and an entry is written in the transaction that changes the row. ``partitions`` is
    the number of tasks that read the snapshot, ``entries`` the most of the log that one task reads.
    """
    spark.dataSource.register(ChangeTable)
    return spark.readStream.format("change_table").options(connect=connect, arguments=json.dumps(arguments), table=table, log=log, key=key, **options).load()
