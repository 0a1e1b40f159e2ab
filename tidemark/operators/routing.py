"""Routing of change records by configuration rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sinks.store import latest
from .etl import listed_entries


def current_config(changes: DataFrame, sink_type: str, key: tuple[str, ...]) -> DataFrame:
    """The routing rows in force after change events ``before, after, op, ts_ms``: the last of each key, deleted ones out."""
    row = F.when(F.col("op") == "d", F.col("before")).otherwise(F.col("after"))
    rows = changes.select("op", "ts_ms", row.alias("c")).select("op", "ts_ms", "c.*").where(F.col("sink_type") == sink_type)
    return latest(rows, list(key), ["ts_ms"]).where("op <> 'd'").drop("op", "ts_ms")


def route_dimensions(changes: DataFrame, config: DataFrame, drop_deletes: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records of the tables that the configuration names: ``sink_table, type, data`` with the listed columns alone, and the columns ``keep`` of either.

    The configuration has a row for each routed table, so it is small; Spark broadcasts it below its own threshold.
    """
    rows = changes.where("type <> 'delete'") if drop_deletes else changes
    joined = rows.join(config.select("source_table", "sink_table", "sink_columns", *(c for c in keep if c not in changes.columns)), F.col("table") == F.col("source_table"))
    return joined.select("sink_table", "type", listed_entries(F.col("data"), F.col("sink_columns")).alias("data"), *keep)


def route_facts(changes: DataFrame, config: DataFrame) -> DataFrame:
    """As :func:`route_dimensions`, by table and type, with ``ts``."""
    wanted = config.select("source_table", "source_type", "sink_table", "sink_columns")
    joined = changes.join(wanted, (F.col("table") == F.col("source_table")) & (F.col("type") == F.col("source_type")))
    return joined.select("sink_table", "ts", listed_entries(F.col("data"), F.col("sink_columns")).alias("data"))
