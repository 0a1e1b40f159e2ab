"""Scalar functions of the feeds. Times are in the session's one zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_empty(c: Column) -> Column:
    """Null or no characters."""
    return F.coalesce(c, F.lit("")) == ""


def day_of_millis(c: Column) -> Column:
    return F.date_format(F.timestamp_millis(c), "yyyy-MM-dd")


def text_of_millis(c: Column) -> Column:
    return F.date_format(F.timestamp_millis(c), "yyyy-MM-dd HH:mm:ss")


def millis_of_text(c: Column, full: bool = True) -> Column:
    return F.unix_millis(F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss" if full else "yyyy-MM-dd")))


def day_number(c: Column) -> Column:
    """yyyyMMdd as a number."""
    return F.date_format(c, "yyyyMMdd").cast("int")


def today_number() -> Column:
    return day_number(F.current_date())


def now_millis() -> Column:
    return F.unix_millis(F.current_timestamp())


def time_label(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def amount(number: Column, price: Column) -> Column:
    """number * price as decimals of two places; the text of the product has four."""
    return (number.try_cast("decimal(16,2)") * price.try_cast("decimal(16,2)")).cast("string")


def amount_or_zero(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("0.0")).try_cast("decimal(16,4)")


def negated(c: Column) -> Column:
    return -c.try_cast("decimal(16,4)")


def listed(csv: Column, value: Column) -> Column:
    """Whether a comma-separated list holds the value, by exact text."""
    return F.array_contains(F.split(csv, ","), value)
