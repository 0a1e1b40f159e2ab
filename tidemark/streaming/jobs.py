"""Streaming jobs: how a transform is run over a stream, and the jobs that need ``foreachBatch``."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import etl, routing
from ..plans import dws
from ..sinks.store import KeyedStore
from ..sinks.writers import dimension_columns, once_per_batch, upsert, upserted
from . import processors
from .lookups import Lookup, Snapshot


def run(df: DataFrame, checkpoint: str, path: str | None = None, each: Callable[[DataFrame, int], None] | None = None, trigger: dict | None = None):
    """Start a query that appends Parquet to ``path`` (each row once) or calls ``each``; by default it ends when the input does."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    return (writer.foreachBatch(each) if each else writer.format("parquet").option("path", path).outputMode("append")).start()


def split_logs(path: str) -> Callable[[DataFrame, int], None]:
    """A batch function that parts log values into dirty data and the five log tables in one pass, a folder for each ``tag``."""

    def each(batch: DataFrame, batch_id: int) -> None:
        dirty, parts = F.lit("dirty_data").alias("tag"), etl.parsed(batch.select("value"))
        rows = etl.tagged_split(parts).unionByName(parts.where("log is null").select(dirty, "value"))
        rows.write.mode("overwrite").partitionBy("tag").parquet(f"{path}/batch_id={batch_id}")

    return each


def device_rows(values: DataFrame) -> DataFrame:
    """What the log job's state gets of each value, parsed here and nowhere else: ``device, row_time, is_new, was, common, parts, value``.

    Records without a device or a time have no ``row_time``; values that are no record have no parts and keep ``value``.
    Both are dealt over 64 names that no device has.
    """
    logs = etl.with_parts(etl.parsed(values.select("value")))
    mid, flag, at = etl.field("common.mid", "string"), etl.field("common.is_new", "string"), F.timestamp_millis(etl.field("ts", "bigint"))
    timed = mid.isNotNull() & at.isNotNull()
    spread = F.concat(F.lit("\x1f"), F.pmod(F.xxhash64("value"), F.lit(64)).cast("string"))
    packed = F.transform("parts", lambda p: F.concat(p["tag"], F.lit("\t"), p["rest"]))  # one text for each: fewer objects in the state's rows
    return logs.select(F.when(timed, mid).otherwise(spread).alias("device"), F.when(timed, at).alias("row_time"), flag.alias("is_new"), flag.alias("was"), "common", packed.alias("parts"), F.when(F.col("parts").isNull(), F.col("value")).alias("value"))


def write_logs(path: str) -> Callable[[DataFrame, int], None]:
    """A batch function over :func:`device_rows` behind their state: all tables and dirty data in one write, a folder for each ``tag``."""

    def each(batch: DataFrame, batch_id: int) -> None:
        common = F.when(F.col("is_new").eqNullSafe(F.col("was")), F.col("common")).otherwise(etl.common_with(F.parse_json("common"), F.col("is_new")))
        parts = F.transform("parts", lambda p: F.struct(F.substring_index(p, "\t", 1).alias("tag"), F.substring(p, F.instr(p, "\t") + 1, F.lit(1 << 30)).alias("rest")))
        # A record has a row for each part, a dirty value one row of its own: no input row is read twice.
        dirty = F.array(F.struct(F.lit("dirty_data").alias("tag"), F.col("value").alias("rest")))
        rows = batch.select(F.when(F.col("parts").isNotNull(), common).alias("common"), F.coalesce(parts, dirty).alias("parts"))
        etl.put_together(rows).write.mode("overwrite").partitionBy("tag").parquet(f"{path}/batch_id={batch_id}")

    return each


def log_job(values: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Start the log split as one query: each value parsed once, repaired by device, and all rows written by one function.

    Dirty values and records without a device or a time go past the devices' state in the same query.
    """
    return run(processors.repair_logs(device_rows(values)), checkpoint, each=write_logs(path), trigger=trigger)


def route(config: Callable[[], DataFrame], path: str, facts: bool = False) -> Callable[[DataFrame, int], None]:
    """A batch function that routes change records by the configuration as it stands when the batch begins."""

    def each(batch: DataFrame, batch_id: int) -> None:
        routed = (routing.route_facts if facts else routing.route_dimensions)(batch, config())
        routed.write.mode("overwrite").partitionBy("sink_table").parquet(f"{path}/batch_id={batch_id}")

    return each


def dimension_store(path: str) -> KeyedStore:
    """All dimension tables in one store, a folder for each in every batch: ``sink_table, key`` and ``data``, a map of texts."""
    return KeyedStore(path, ["sink_table", "key"], ["__ts", "__n"], parts=["sink_table"])


def _dimension_rows(routed: DataFrame) -> DataFrame:
    """Rows for :func:`dimension_store` from ``sink_table, sink_pk, ts, data`` and ``__n``; rows without their key go."""
    key = F.try_element_at("data", F.coalesce("sink_pk", F.lit("id")))
    return routed.select("sink_table", key.alias("key"), "data", F.col("ts").cast("bigint").alias("__ts"), "__n").where("key is not null")


def dimensions(config: Callable[[], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """A batch function that routes change records to dimension tables and keeps the last row of each key, in one write.

    A table is there as soon as the first batch is. The configuration has a row for each table and is read when the
    batch begins. Records are in the order of ``ts``, then in that of the batch.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        now = config().withColumn("sink_columns", F.concat_ws(",", F.coalesce("sink_pk", F.lit("id")), "sink_columns"))
        numbered = batch.withColumn("__n", F.monotonically_increasing_id())
        routed = routing.route_dimensions(numbered.where("data is not null"), now, drop_deletes=True, keep=("sink_pk", "ts", "__n"))
        dimension_store(path).write(_dimension_rows(routed), batch_id)

    return each


def connected_dimensions(path: str) -> Callable[[DataFrame, int], None]:
    """A batch function that keeps the last row of each key of what :func:`tidemark.streaming.connected.routed` gives.

    The same as :func:`dimensions` with the configuration as a stream of its own. Deletions of rows are left out, as there.
    A table's key has to be among its listed columns. Rows of one key and time are in the order of the columns kept
    beside them, if any (an offset), else in no order.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        known = {"sink_table", "sink_columns", "sink_pk", "type", "ts", "data"}
        order = F.struct(*(c for c in batch.columns if c not in known), F.lit(0).alias("__0"))
        dimension_store(path).write(_dimension_rows(batch.where("type <> 'delete'").withColumn("__n", order)), batch_id)

    return each


def dimension_table(rows: DataFrame, sink_table: str, columns: list[str]) -> DataFrame:
    """One dimension table from the rows of :func:`dimension_store`."""
    return rows.where(F.col("sink_table") == sink_table).select(*(F.col("data")[c].alias(c) for c in columns))


def dimension(spark, path: str, row: dict[str, str | None]) -> DataFrame:
    """The rows of a dimension table that :func:`dimensions` keeps."""
    columns, _ = dimension_columns(row)
    return dimension_table(dimension_store(path).read(spark), row["sink_table"], columns)


def dimension_lookup(path: str, sink_table: str, *columns: str, max_age: float = 86_400) -> Snapshot:
    """One dimension table for :func:`with_lookups`, by name and columns."""
    return Snapshot(dimension_store(path), "sink_table string, key string, data map<string, string>", lambda rows: dimension_table(rows, sink_table, list(columns)), max_age)


def with_lookups(enrich: Callable[..., DataFrame], lookups: Mapping[str, Lookup], write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A batch function that writes ``enrich(batch, frames)`` with the lookups' frames as they stand when the batch begins."""

    def each(batch: DataFrame, batch_id: int) -> None:
        write(enrich(batch, {n: lookup.current(batch.sparkSession) for n, lookup in lookups.items()}), batch_id)

    return each


def keep_latest_details(path: str) -> Callable[[DataFrame, int], None]:
    """A batch function that keeps the last row of each order line. A summary is then a batch over :func:`latest_details`.

    The other way to the same net amounts is :func:`tidemark.streaming.processors.retracted`, in which a negated earlier
    row carries its old time and is dropped by a window that has closed.
    """
    return upsert(path, ["id"], ["row_time"])


def latest_details(spark, path: str) -> DataFrame:
    return upserted(spark, path, ["id"])


def order_summaries(details: DataFrame, dims: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Amounts by product and by province of the latest order lines."""
    amounts = dws.order_amounts(details)
    return dws.sku_order(amounts, dims), dws.province_order(amounts, dims["base_province"])
