"""Left joins of streams as changelogs: rows come at once, are taken back and corrected."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..sinks.store import DELETED

INSERT, RETRACT, DELETE = "insert", "retract", "delete"


class LeftJoin(StatefulProcessor):
    """For each key the last left row and the last row of each right side; gives what has changed once a batch.

    A left row is given at once, with nulls for sides that are not there. When a side comes, changes or goes, the row
    given before is retracted and the new one inserted. When the left row goes, the row is deleted.
    """

    def __init__(self, sides: T.StructType, ttl_ms: int | None):
        self.sides, self.ttl_ms = sides, ttl_ms

    def init(self, handle) -> None:
        # State holds plain fields: for each side whether it is there, and its columns.
        flat = [T.StructField(f"s{i}_{j}", f.dataType) for i, s in enumerate(self.sides) for j, f in enumerate([T.StructField("here", T.BooleanType()), *s.dataType.fields])]
        self.state = handle.getValueState("sides", T.StructType(flat), self.ttl_ms)

    def _load(self) -> dict[str, tuple | None]:
        values, found = iter(self.state.get() or ()) if self.state.exists() else iter(()), {}
        for side in self.sides:
            here = next(values, False)
            columns = tuple(next(values, None) for _ in side.dataType.fields)
            found[side.name] = columns if here else None
        return found

    def _keep(self, sides: dict[str, tuple | None]) -> None:
        if all(v is None for v in sides.values()):
            self.state.clear()
        else:
            self.state.update(tuple(x for s in self.sides for v in [sides[s.name]] for x in (v is not None, *(v or (None,) * len(s.dataType.fields)))))

    def handleInputRows(self, key, rows, timerValues):
        names, before = self.sides.names, self._load()
        now = dict(before)
        for row in sorted(rows, key=lambda r: (r["order"] is not None, r["order"])):
            now[row["side"]] = None if row["op"] == DELETE else tuple(row[row["side"]][f.name] for f in self.sides[row["side"]].dataType.fields)
        if now == before:
            return
        left = names[0]
        give = lambda mark, values: Row("key", "mark", *names)(key[0], mark, *(values[n] for n in names))
        if before[left] is not None:
            yield give(DELETE if now[left] is None else RETRACT, before)
        if now[left] is not None:
            yield give(INSERT, now)
        self._keep(now)

    def close(self) -> None:
        pass


def left_join(left: DataFrame, rights: Mapping[str, DataFrame], key: str, order: str = "ts", op: str = "op", ttl_ms: int | None = None) -> DataFrame:
    """``mark, key`` and the columns of all sides: the changelog of a stream joined with others, each equal to it in ``key``.

    Every side has ``key``, ``op`` (``delete`` ends the row, anything else sets it) and ``order``; its other columns are
    given. Names that several sides share are the left side's, the others' get the side's name before them. A side has
    one row for a key at a time; the last by ``order`` counts, nulls first. Rows with a null key go. Marks: ``insert`` gives
    a row, ``retract`` takes back the one given last, before its correction, ``delete`` takes it back for good. State is
    kept for ``ttl_ms`` of processing time after a key's last row, for ever without it.
    """
    sides = {"left": left, **rights}
    own = {n: [f for f in df.schema.fields if f.name not in (key, op, order)] for n, df in sides.items()}
    kinds = T.StructType([T.StructField(n, T.StructType([T.StructField(f.name, f.dataType) for f in fields])) for n, fields in own.items()])
    rows = None
    for n, df in sides.items():
        values: list[Column] = [(F.struct(*(f.name for f in own[n])) if m == n else F.lit(None)).cast(kinds[m].dataType).alias(m) for m in sides]
        tagged = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.lit(n).alias("side"), F.col(op).alias("op"), F.col(order).alias("order"), *values)
        rows = tagged if rows is None else rows.unionByName(tagged)
    schema = T.StructType([T.StructField("key", left.schema[key].dataType), T.StructField("mark", T.StringType()), *kinds.fields])
    mode = "none" if ttl_ms is None else "processingTime"
    found = rows.groupBy("key").transformWithState(statefulProcessor=LeftJoin(kinds, ttl_ms), outputStructType=schema, outputMode="append", timeMode=mode)
    taken, columns = {key, "mark"}, []
    for n, fields in own.items():
        for f in fields:
            name = f.name if f.name not in taken else f"{n}_{f.name}"
            taken.add(name)
            columns.append(F.col(n)[f.name].alias(name))
    return found.select("mark", F.col("key").alias(key), *columns)


def upserts(marked: DataFrame) -> DataFrame:
    """A batch of a changelog as rows for a :class:`tidemark.sinks.store.KeyedStore`: what is inserted, and the ends of what is deleted.

    A retraction is followed by its correction in the same batch, so it needs no row of its own.
    """
    return marked.where(F.col("mark") != RETRACT).withColumn(DELETED, F.col("mark") == DELETE).drop("mark")


def topic_rows(marked: DataFrame, key: str) -> DataFrame:
    """``key, value`` of a changelog for a compacted topic: rows as JSON, and a null value for each one taken back."""
    body = F.to_json(F.struct(*(c for c in marked.columns if c != "mark")))
    return marked.select(F.col(key).cast("string").alias("key"), F.when(F.col("mark") == INSERT, body).alias("value"))
