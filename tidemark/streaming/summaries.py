"""The seven window summaries on streams: a feed's JSON values in, rows of the sink's columns out.

Each puts together the reader, the state machine and the window of :mod:`tidemark.plans.dws`. A window's row comes once,
when the watermark has passed the window; :func:`tidemark.streaming.jobs.run` starts them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import etl
from ..operators.windows import page_metrics
from ..plans import dws
from ..schemas import ORDER_DETAIL, strings
from ..sources.readers import logs, with_event_time
from . import processors


def _pages(values: DataFrame, delay: str) -> DataFrame:
    """Page records flat, with the watermark on ``row_time``."""
    rows = logs(values).withWatermark("row_time", delay)
    return rows.select("common.mid", "common.uid", "common.vc", "common.ch", "common.ar", "common.is_new", "page.page_id", "page.last_page_id", "page.item", "page.item_type", "page.during_time", "row_time")


def keyword(values: DataFrame, delay: str = "3 seconds") -> DataFrame:
    """Search words by window; needs the table function ``ik_analyze`` (:func:`tidemark.functions.text.register`)."""
    found = logs(values).withWatermark("row_time", delay)
    found = etl.search_words(found).select("row_time", F.col("page.item").alias("fullword"))
    spark = found.sparkSession
    words = spark.sql("select row_time, word as keyword from {found}, lateral ik_analyze(fullword)", found=found)
    return dws.keyword(words)


def page_view(values: DataFrame, delay: str = "4 seconds") -> DataFrame:
    rows = processors.daily_visitors(_pages(values, delay))
    return dws.page_view(page_metrics(rows, F.col("last_page_id"), F.col("during_time")))


def home_detail(values: DataFrame, delay: str = "3 seconds") -> DataFrame:
    return dws.home_detail(processors.home_detail_visitors(etl.home_and_detail(_pages(values, delay))))


def user_login(values: DataFrame, delay: str = "3 seconds") -> DataFrame:
    return dws.user_login(processors.login_metrics(etl.logins(_pages(values, delay)), "uid"))


def cart_users(values: DataFrame, delay: str = "5 seconds") -> DataFrame:
    """From the cart table's records: ``user_id`` and ``ts`` in seconds."""
    rows = values.select(F.from_json("value", strings("user_id", "ts")).alias("r")).select("r.*")
    return dws.cart_users(processors.daily_users(with_event_time(rows, delay=delay)))


def _amounts(values: DataFrame, delay: str) -> DataFrame:
    """Order lines with decimal amounts, repeats taken back."""
    rows = etl.present(values, empty_too=True).select(F.from_json("value", ORDER_DETAIL).alias("r")).select("r.*").where("id is not null")
    rows = dws.order_amounts(with_event_time(rows, delay=delay)).select("id", "order_id", "sku_id", "province_id", *dws.AMOUNTS, "row_time")
    return processors.retracted(rows, list(dws.AMOUNTS))


def sku_order(values: DataFrame, dims: dict[str, DataFrame], delay: str = "3 seconds") -> DataFrame:
    """With dimensions as they are when the stream starts; :func:`sku_sums` and :func:`tidemark.streaming.jobs.with_lookups` follow their changes."""
    return dws.sku_order(_amounts(values, delay), dims)


def sku_sums(values: DataFrame, delay: str = "3 seconds") -> DataFrame:
    """:func:`sku_order` without the names, which ``dws.sku_named`` adds batch by batch."""
    return dws.sku_sums(_amounts(values, delay))


def province_order(values: DataFrame, provinces: DataFrame, delay: str = "3 seconds") -> DataFrame:
    return dws.province_order(_amounts(values, delay), provinces)


def province_sums(values: DataFrame, delay: str = "3 seconds") -> DataFrame:
    """:func:`province_order` without the name, which ``dws.province_named`` adds batch by batch."""
    return dws.province_sums(_amounts(values, delay))
