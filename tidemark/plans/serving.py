"""The two served answers over the summaries."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.etl import on_day
from ..operators.windows import top

#: The name of the series of visitors by channel; fixed value.
CHANNELS = "渠道"


def day_or_today(day: int) -> int:
    """A day as yyyyMMdd; 0 is today, in the session's one zone."""
    return day or int(datetime.now(timezone.utc).strftime("%Y%m%d"))


def gmv(province_orders: DataFrame, day: int = 0, time: str = "stt", amount: str = "order_amount") -> DataFrame:
    """``gmv``: a day's order amount; 0 without orders."""
    return on_day(province_orders, time, day_or_today(day)).agg(F.coalesce(F.sum(amount), F.lit(0)).alias("gmv"))


def gmv_json(province_orders: DataFrame, day: int = 0, time: str = "stt", amount: str = "order_amount") -> DataFrame:
    """``value``: the answer's body, ``{"status":0,"data":n}``."""
    return gmv(province_orders, day, time, amount).select(F.concat(F.lit('{"status":0,"data":'), F.col("gmv").cast("string"), F.lit("}")).alias("value"))


def channel_visitors(views: DataFrame, day: int = 0, limit: int = 10, time: str = "stt") -> DataFrame:
    """``ch, uv_ct`` of the day's ``limit`` channels with the most visitors."""
    return top(on_day(views, time, day_or_today(day)).groupBy("ch").agg(F.sum("uv").alias("uv_ct")), "uv_ct", "ch", limit)


def channel_visitors_json(views: DataFrame, day: int = 0, limit: int = 10, time: str = "stt") -> DataFrame:
    """``value``: the answer's body, ``{"status":0,"data":{"categories":[..],"series":[{"name":..,"data":[..]}]}}``; at most ``limit`` channels come together."""
    rows = channel_visitors(views, day, limit, time).withColumn("rn", F.row_number().over(Window.orderBy(F.desc("uv_ct"), "ch")))
    listed = rows.agg(F.array_sort(F.collect_list(F.struct("rn", F.coalesce("ch", F.lit("")).alias("ch"), "uv_ct"))).alias("r"))
    series = F.array(F.struct(F.lit(CHANNELS).alias("name"), F.transform("r", lambda x: x["uv_ct"]).alias("data")))
    data = F.struct(F.transform("r", lambda x: x["ch"]).alias("categories"), series.alias("series"))
    return listed.select(F.to_json(F.struct(F.lit(0).alias("status"), data.alias("data"))).alias("value"))
