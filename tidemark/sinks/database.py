"""A database table as the end of a stream: rows are staged by tasks and moved by the driver in one transaction."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

from ..names import plain_name
from ..sources.database import connection


@dataclass
class Staged(WriterCommitMessage):
    """What one task has staged."""

    token: str
    rows: int


class _Writer(DataSourceStreamWriter):
    """Two phases: each task stages its rows under a token of its own; a batch's tokens are moved to the table together.

    The batch's number is kept in the same transaction, so a replayed batch moves nothing. What failed tasks have staged
    goes with the next batch's move.
    """

    def __init__(self, options: dict[str, str], columns: list[str]):
        self.options, self.columns = options, [plain_name(c) for c in columns]
        self.table, self.writer = plain_name(options["table"]), options["writer"]
        self.staged, self.epochs = f"{self.table}_staged", f"{self.table}_epochs"
        self.rows, self.mark = int(options.get("rows", "500")), options.get("mark", "?")

    def _connect(self):
        return connection(self.options["connect"], self.options["arguments"])

    def write(self, iterator: Iterator) -> Staged:
        token, n, own = uuid.uuid4().hex, 0, self._connect()
        marks = ", ".join([self.mark] * (len(self.columns) + 2))
        try:
            cursor = own.cursor()
            for rows in batched(iterator, self.rows):
                cursor.executemany(f"insert into {self.staged} (writer, token, {', '.join(self.columns)}) values ({marks})", [(self.writer, token, *(r[c] for c in self.columns)) for r in rows])
                own.commit()  # small transactions; nobody reads what is staged
                n += len(rows)
        finally:
            own.close()
        return Staged(token, n)

    def _finish(self, tokens: list[str], batch_id: int | None) -> None:
        own = self._connect()
        try:
            cursor = own.cursor()
            if batch_id is not None:
                cursor.execute(f"select count(*) from {self.epochs} where writer = {self.mark} and epoch >= {self.mark}", (self.writer, batch_id))
                if not cursor.fetchone()[0]:
                    names = ", ".join(self.columns)
                    for token in tokens:
                        cursor.execute(f"insert into {self.table} ({names}) select {names} from {self.staged} where writer = {self.mark} and token = {self.mark}", (self.writer, token))
                    cursor.execute(f"delete from {self.epochs} where writer = {self.mark}", (self.writer,))
                    cursor.execute(f"insert into {self.epochs} (writer, epoch) values ({self.mark}, {self.mark})", (self.writer, batch_id))
            cursor.execute(f"delete from {self.staged} where writer = {self.mark}", (self.writer,))
            own.commit()
        finally:
            own.close()

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        self._finish([m.token for m in messages if m and m.rows], batchId)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        self._finish([], None)


class TransactionalTable(DataSource):
    """The data source ``transactional_table``, for streams alone."""

    @classmethod
    def name(cls) -> str:
        return "transactional_table"

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        wanted = json.loads(self.options["columns"])
        missing = [c for c in wanted if c not in schema.names]
        if missing:
            raise ValueError(f"no such columns: {missing}")
        return _Writer(dict(self.options), wanted)


def create_tables(connect: str, arguments: list, table: str, columns: dict[str, str]) -> None:
    """Create a table, that of its staged rows and that of its batches, unless they exist. ``columns`` has types of the database."""
    listed = ", ".join(f"{plain_name(c)} {kind}" for c, kind in columns.items())
    own = connection(connect, json.dumps(arguments))
    try:
        cursor = own.cursor()
        cursor.execute(f"create table if not exists {plain_name(table)} ({listed})")
        cursor.execute(f"create table if not exists {table}_staged (writer varchar(200), token varchar(32), {listed})")
        cursor.execute(f"create table if not exists {table}_epochs (writer varchar(200), epoch bigint)")
        own.commit()
    finally:
        own.close()


def write_table(df: DataFrame, checkpoint: str, connect: str, arguments: list, table: str, columns: list[str], writer: str, rows: int = 500, trigger: dict | None = None):
    """Start a query that appends ``columns``, in this order, to a table: each row once, over failed tasks and restarts.

    ``writer`` names the query: its batches count for themselves, so each checkpoint needs a name of its own. ``rows``
    go into the database at a time. The tables have to be there (see :func:`create_tables`).
    """
    df.sparkSession.dataSource.register(TransactionalTable)
    options = {"connect": connect, "arguments": json.dumps(arguments), "table": table, "columns": json.dumps(columns), "writer": writer, "rows": str(rows)}
    return df.writeStream.format("transactional_table").options(**options).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
