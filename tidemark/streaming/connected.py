"""Change records and their routing configuration as two streams in one keyed state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators.etl import listed_entries
from ..schemas import CONFIG_CHANGE, STRINGS

_ROUTE = ("sink_table", "sink_columns", "sink_pk")
_STATE = "ts_ms long, " + ", ".join(f"{c} string" for c in _ROUTE)
#: The source of a table's records of one type; no table's name holds it.
_BETWEEN = "\x1f"


class Routes(StatefulProcessor):
    """Holds the routing rows by source and adds them to the records of that source; records of no source go.

    The rows of a batch that change the configuration come before its records. A change older than the one known of its
    source is left out; a deleted source keeps its time, so that no older row brings it back.
    """

    def init(self, handle) -> None:
        self.routes = handle.getMapState("routes", "source string", _STATE)

    def _put(self, changes: pd.DataFrame) -> None:
        for row in changes.sort_values("ts_ms", kind="stable").itertuples(index=False):
            known = self.routes.getValue((row.source,)) if self.routes.containsKey((row.source,)) else None
            if known is None or row.ts_ms >= known[0]:
                self.routes.updateValue((row.source,), (int(row.ts_ms), *((None,) * 3 if row.op == "d" else (getattr(row, c) for c in _ROUTE))))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._put(initialState)

    def handleInputRows(self, key, rows, timerValues):
        held, changes = [], []
        for frame in rows:
            changed = frame["is_config"].astype(bool)
            changes.append(frame[changed])
            held.append(frame[~changed])
        changes = pd.concat(changes)
        if len(changes):
            self._put(changes)
        known = {source: value for (source,), value in self.routes.iterator()}
        for frame in held:
            frame = frame[frame["source"].map(lambda s: s in known and known[s][1] is not None).astype(bool)]
            if len(frame):
                found = {c: frame["source"].map({s: v[i + 1] for s, v in known.items()}) for i, c in enumerate(_ROUTE)}
                yield frame.assign(**found).drop(columns=["deal", "is_config", "source", "op", "ts_ms"])

    def close(self) -> None:
        pass


def config_changes(values: DataFrame) -> DataFrame:
    """``op, ts_ms`` and the routing row of each change of the configuration table from JSON values: the row before a deletion, else the one after."""
    parsed = values.select(F.from_json("value", CONFIG_CHANGE).alias("r")).where("r.op is not null").select("r.*")
    row = F.when(F.col("op") == "d", F.col("before")).otherwise(F.col("after"))
    return parsed.select("op", F.coalesce("ts_ms", F.lit(0)).alias("ts_ms"), row.alias("c")).select("op", "ts_ms", "c.*")


def _routing(config: DataFrame, sink_type: str, by_type: bool) -> DataFrame:
    source = F.concat("source_table", F.lit(_BETWEEN), F.coalesce("source_type", F.lit(""))) if by_type else F.col("source_table")
    return config.where((F.col("sink_type") == sink_type) & F.col("source_table").isNotNull()).select(source.alias("source"), "op", "ts_ms", *_ROUTE)


def routed(changes: DataFrame, config: DataFrame, sink_type: str = "dim", preloaded: DataFrame | None = None, by_type: bool = False, deals: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records of the sources that the configuration names while they come: ``sink_table, sink_columns, sink_pk, type, ts, data`` and the columns ``keep``.

    ``changes(table, type, ts, data)`` and ``config`` (see :func:`config_changes`) are streams; ``preloaded`` is a table
    of routing rows known before the first batch. Sources are tables, or with ``by_type`` tables and types of change.
    ``data`` has the listed columns alone. Records are dealt evenly over ``deals`` groups by content, whatever their
    table, and each change of the configuration goes to every group, which keeps all routing rows; so a table with most
    records is no one task's work. Without ``deals`` there are as many as shuffle partitions; like these, the number is
    the checkpoint's from the first start on. Records whose table or data is null go.
    """
    spark = changes.sparkSession
    deals = deals or int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = F.concat("table", F.lit(_BETWEEN), F.coalesce("type", F.lit(""))) if by_type else F.col("table")
    body = F.to_json(F.struct("data"))
    records = changes.where("table is not null and data is not null").select(
        F.pmod(F.xxhash64("table", "ts", body), F.lit(deals)).cast("int").alias("deal"), F.lit(False).alias("is_config"), source.alias("source"),
        F.lit(None).cast("string").alias("op"), F.lit(None).cast("long").alias("ts_ms"), *(F.lit(None).cast("string").alias(c) for c in _ROUTE),
        "type", F.col("ts").cast("string").alias("ts"), body.alias("body"), *keep,
    )
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal")
    rows = _routing(config, sink_type, by_type).select(
        everywhere, F.lit(True).alias("is_config"), "source", "op", "ts_ms", *_ROUTE,
        *(F.lit(None).cast("string").alias(c) for c in ("type", "ts", "body")), *(F.lit(None).cast(changes.schema[c].dataType).alias(c) for c in keep),
    )
    start = None
    if preloaded is not None:
        table = preloaded.withColumns({"op": F.lit("r"), "ts_ms": F.lit(0).cast("long")})
        start = _routing(table, sink_type, by_type).select(everywhere, "source", "op", "ts_ms", *_ROUTE).groupBy("deal")
    text = T.StringType()
    schema = T.StructType([*(T.StructField(c, text) for c in (*_ROUTE, "type", "ts", "body")), *(changes.schema[c] for c in keep)])
    found = records.unionByName(rows).groupBy("deal").transformWithStateInPandas(statefulProcessor=Routes(), outputStructType=schema, outputMode="append", timeMode="none", initialState=start)
    data = F.from_json("body", T.StructType([T.StructField("data", STRINGS)]))["data"]
    return found.select(*_ROUTE, "type", "ts", listed_entries(data, F.col("sink_columns")).alias("data"), *keep)
