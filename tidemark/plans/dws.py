"""Window summaries, each with its sink's columns in order (``ts`` is the time of writing)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import amount_or_zero, now_millis
from ..operators.etl import any_metric
from ..operators.joins import dim_join, snowflake
from ..operators.windows import tumble


def _stamped(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", now_millis())


def keyword(df: DataFrame, time: str = "row_time") -> DataFrame:
    """From rows of ``keyword``."""
    return _stamped(tumble(df, time, ["keyword"], keyword_count=F.count("*")))


def page_view(df: DataFrame, time: str = "row_time") -> DataFrame:
    """From rows of ``vc, ch, ar, is_new, uv, sv, pv, dur``."""
    return _stamped(tumble(df, time, ["vc", "ch", "ar", "is_new"], uv=F.sum("uv"), sv=F.sum("sv"), pv=F.sum("pv"), dur=F.sum("dur")))


def home_detail(df: DataFrame, time: str = "row_time") -> DataFrame:
    return _stamped(tumble(any_metric(df, "home_uv", "detail_uv"), time, [], home_uv=F.sum("home_uv"), detail_uv=F.sum("detail_uv")))


def user_login(df: DataFrame, time: str = "row_time") -> DataFrame:
    return _stamped(tumble(any_metric(df, "uu", "back"), time, [], back=F.sum("back"), uu=F.sum("uu")))


def cart_users(df: DataFrame, time: str = "row_time") -> DataFrame:
    return _stamped(tumble(df, time, [], uu=F.count("*")))


AMOUNTS = {"original_amount": "split_original_amount", "activity_amount": "split_activity_amount", "coupon_amount": "split_coupon_amount", "order_amount": "split_total_amount"}


def order_amounts(details: DataFrame) -> DataFrame:
    """Order lines with their amounts as decimals; missing ones are 0."""
    return details.withColumns({n: amount_or_zero(F.col(c)) for n, c in AMOUNTS.items()})


def sku_sums(amounts: DataFrame, time: str = "row_time") -> DataFrame:
    """Amounts by product."""
    return tumble(amounts, time, ["sku_id"], **{n: F.sum(n) for n in AMOUNTS})


def sku_named(sums: DataFrame, dims: Mapping[str, DataFrame]) -> DataFrame:
    """The sink's columns of :func:`sku_sums`: six dimensions are joined to a row for each window and product."""
    wide = snowflake(
        sums,
        [
            (dims["sku_info"], "sku_id", "id", {"sku_name": "sku_name", "spu_id": "spu_id", "tm_id": "trademark_id", "category3_id": "category3_id"}),
            (dims["spu_info"], "spu_id", "id", {"spu_name": "spu_name"}),
            (dims["base_trademark"], "trademark_id", "id", {"tm_name": "trademark_name"}),
            (dims["base_category3"], "category3_id", "id", {"name": "category3_name", "category2_id": "category2_id"}),
            (dims["base_category2"], "category2_id", "id", {"name": "category2_name", "category1_id": "category1_id"}),
            (dims["base_category1"], "category1_id", "id", {"name": "category1_name"}),
        ],
    )
    names = [f"{p}_{s}" for p in ("trademark", "category1", "category2", "category3", "sku", "spu") for s in ("id", "name")]
    return _stamped(wide).select("stt", "edt", *names, *AMOUNTS, "ts")


def sku_order(amounts: DataFrame, dims: Mapping[str, DataFrame], time: str = "row_time") -> DataFrame:
    """Amounts by product with its names."""
    return sku_named(sku_sums(amounts, time), dims)


def province_sums(amounts: DataFrame, time: str = "row_time") -> DataFrame:
    """Amounts and different orders by province.

    Orders are summed first, each in a group of its own, and their groups are counted then: a stream can do so, too, and
    no window's orders come together in one buffer, however many a province has.
    """
    orders = amounts.groupBy(F.window(time, "10 seconds").alias("__o"), "province_id", "order_id").agg(F.sum("order_amount").alias("order_amount"))
    return tumble(orders.withColumn("__t", F.window_time("__o")), "__t", ["province_id"], order_count=F.count("order_id"), order_amount=F.sum("order_amount"))


def province_named(sums: DataFrame, provinces: DataFrame) -> DataFrame:
    """The sink's columns of :func:`province_sums`."""
    return _stamped(dim_join(sums, provinces, "province_id", "id", {"name": "province_name"})).select("stt", "edt", "province_id", "province_name", "order_count", "order_amount", "ts")


def province_order(amounts: DataFrame, provinces: DataFrame, time: str = "row_time") -> DataFrame:
    """Amounts and orders by province with its name."""
    return province_named(province_sums(amounts, time), provinces)
