"""Tumbling event-time windows and the aggregates over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import time_label


def tumble(df: DataFrame, time: str, keys: list[str], size: str = "10 seconds", **aggregates: Column) -> DataFrame:
    """``stt, edt``, the keys and the aggregates of each window. The window is closed by the watermark on streams."""
    grouped = df.groupBy(F.window(time, size).alias("__w"), *keys).agg(*(a.alias(n) for n, a in aggregates.items()))
    return grouped.select(time_label(F.col("__w.start")).alias("stt"), time_label(F.col("__w.end")).alias("edt"), *keys, *aggregates)


def page_metrics(df: DataFrame, last_page: Column, during: Column) -> DataFrame:
    """``pv`` 1, ``sv`` 1 for a page without a page before it, ``dur`` the time on it."""
    return df.withColumns({"pv": F.lit(1).cast("long"), "sv": (F.coalesce(last_page, F.lit("")) == "").cast("long"), "dur": F.coalesce(during, F.lit(0)).cast("long")})


def top(df: DataFrame, value: str, tie: str, n: int = 10) -> DataFrame:
    return df.orderBy(F.desc(value), F.asc(tie)).limit(n)
