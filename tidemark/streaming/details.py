"""Detail tables on streams whose rows come at once and are corrected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import dictionary_join
from ..plans import dwd
from . import changelog


def order_detail(changes: DataFrame, ttl: str, state_ms: int | None = None) -> DataFrame:
    """The changelog of order lines with their order, activity and coupon: ``mark`` and the lines' fields.

    ``changes`` has ``row_time`` with a watermark; a line and its order are ``ttl`` apart at most, as
    :func:`tidemark.plans.dwd.order_detail` has it. Activity and coupon may come at any time: a line is given without
    them, taken back when one comes and given anew. What is known of a line is kept for ``state_ms`` of processing time.
    """
    lines = dwd.ordered_lines(changes, ttl=ttl).drop("d_time", "o_time", "o_id")
    activity, coupon = (side.drop(f"{n}_time") for side, n in zip(dwd.line_sides(changes), "ac"))
    known = lambda side, key: side.select(F.col(key).alias("d_id"), F.lit("insert").alias("op"), F.lit(None).cast("string").alias("order"), *(c for c in side.columns if c != key))
    left = lines.withColumns({"op": F.lit("insert"), "order": F.col("d_ts")})
    return changelog.left_join(left, {"activity": known(activity, "a_order_detail_id"), "coupon": known(coupon, "c_order_detail_id")}, "d_id", order="order", ttl_ms=state_ms)


def order_detail_rows(marked: DataFrame, dic: DataFrame) -> DataFrame:
    """A batch of :func:`order_detail` as the table's columns behind ``mark``; lines whose source the dictionary lacks go."""
    return dwd.order_columns(dictionary_join(marked, dic, "d_source_type", "source_type_name"), "mark")
