"""Batch and streaming readers. Kafka and JDBC need their jars on the cluster; file streams are the tested path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import CDC, LOG


def kafka_options(servers: str, topic: str, group: str, starting: str = "latest") -> dict[str, str]:
    """Options of a Kafka reader: committed records only; offsets come from the checkpoint, else from ``starting``."""
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "kafka.group.id": group, "startingOffsets": starting, "kafka.isolation.level": "read_committed", "failOnDataLoss": "false"}


def kafka_values(spark: SparkSession, **options: str) -> DataFrame:
    """``value string`` of a topic, null for tombstones."""
    return spark.readStream.format("kafka").options(**options).load().select(F.col("value").cast("string").alias("value"))


def file_values(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """``value string`` of a folder of text files, a stream."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def socket_csv(spark: SparkSession, host: str, port: int, schema: T.StructType) -> DataFrame:
    """Lines of comma-separated fields from a socket, typed by ``schema``."""
    return csv_fields(spark.readStream.format("socket").options(host=host, port=port).load(), schema)


def csv_fields(lines: DataFrame, schema: T.StructType) -> DataFrame:
    parts = F.split("value", ",")
    return lines.select(*(F.get(parts, F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)))


def changes(values: DataFrame) -> DataFrame:
    """Database changes from JSON values, with ``proc_time``; values that are no JSON object are dropped."""
    parsed = values.select(F.from_json("value", CDC).alias("r"), F.current_timestamp().alias("proc_time"))
    return parsed.where("r is not null and (r.table is not null or r.type is not null)").select("r.*", "proc_time")


def with_event_time(df: DataFrame, seconds: str = "ts", delay: str | None = None, name: str = "row_time") -> DataFrame:
    """Adds the event time of a field of seconds and, with a ``delay``, its watermark."""
    timed = df.withColumn(name, F.timestamp_seconds(F.col(seconds).try_cast("bigint")))
    return timed.withWatermark(name, delay) if delay else timed


def logs(values: DataFrame) -> DataFrame:
    """Application log records from JSON values, with ``row_time`` cut to seconds."""
    parsed = values.select(F.from_json("value", LOG).alias("r")).where("r is not null").select("r.*")
    return parsed.withColumn("row_time", F.timestamp_seconds(F.floor(F.col("ts") / 1000)))


def jdbc_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A database table or, with ``query``, its result; read anew in every batch that uses it."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def config_rows(table: DataFrame, sink_type: str) -> DataFrame:
    """The preloaded routing rows of one kind of sink."""
    return table.where(F.col("sink_type") == sink_type)


def row_query(spark: SparkSession, table: str, **equal: str) -> DataFrame:
    """The rows of a dimension table in which every named column has its value."""
    found = spark.read.table(table)
    for column, value in equal.items():
        found = found.where(F.col(column) == value)
    return found
