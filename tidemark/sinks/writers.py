"""Writers for batches and for ``foreachBatch``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..names import plain_name
from .store import KeyedStore


def kafka_values(df: DataFrame, topic: str | None = None, key: str | None = None) -> DataFrame:
    """``topic, key, value`` rows for the Kafka writer; without a topic each row's ``sink_table`` names it and is left out of the value."""
    body = [c for c in df.columns if c != "sink_table" or topic]
    return df.select(F.lit(topic).alias("topic") if topic else F.col("sink_table").alias("topic"), (F.col(key) if key else F.lit(None)).cast("string").alias("key"), F.to_json(F.struct(*body)).alias("value"))


def kafka_stream(df: DataFrame, servers: str, checkpoint: str):
    """At least once; consumers that need each record once drop repeats by key."""
    return df.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.transaction.timeout.ms", "900000").option("checkpointLocation", checkpoint).start()


def by_sink_table(df: DataFrame, path: str, mode: str = "append") -> None:
    """One folder for each ``sink_table``."""
    df.write.mode(mode).partitionBy("sink_table").json(path)


def once_per_batch(path: str):
    """A ``foreachBatch`` function that writes a batch to its own folder, so that a replayed batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def upsert(path: str, keys: list[str], order: list[str], every: int = 16):
    """A ``foreachBatch`` function that keeps the last row of each key; see :class:`tidemark.sinks.store.KeyedStore`."""
    return KeyedStore(path, keys, order, every).write


def upserted(spark, path: str, keys: list[str]) -> DataFrame | None:
    """What :func:`upsert` has kept; later batches win. None before the first batch."""
    return KeyedStore(path, keys).read(spark)


def dimension_columns(config: dict[str, str | None]) -> tuple[list[str], str]:
    """A dimension table's columns and key from its routing row; the key is ``id`` unless named, and among the columns."""
    key = config.get("sink_pk") or "id"
    columns = [c for c in (config.get("sink_columns") or "").split(",") if c]
    return (columns if key in columns else [key, *columns]), key


def ensure_dimension(spark, config: dict[str, str | None], database: str = "default") -> str:
    """Create the dimension table of a routing row unless it exists; every column is text.

    Names other than plain ones are refused. ``sink_extend`` holds options of another engine's tables and is not used.
    """
    columns, _ = dimension_columns(config)
    for name in (database, config["sink_table"], *columns):
        plain_name(name)
    table = f"`{database}`.`{config['sink_table']}`"
    spark.sql(f"create table if not exists {table} ({', '.join(f'`{c}` string' for c in columns)}) using parquet")
    return f"{database}.{config['sink_table']}"


def dimension_rows(df: DataFrame, config: dict[str, str | None], *more: str) -> DataFrame:
    """Text rows of one dimension from routed records; nulls stay null."""
    columns, _ = dimension_columns(config)
    return df.select(*(F.col("data")[c].cast("string").alias(c) for c in columns), *more)


def append_rows(df: DataFrame, columns: list[str], path: str, fmt: str = "parquet") -> None:
    """Append in the order of the sink's columns; others are left out."""
    df.select(*columns).write.mode("append").format(fmt).save(path)


def console(df: DataFrame):
    return df.writeStream.format("console").option("truncate", "false").start()
