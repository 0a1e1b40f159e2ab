"""Batch forms of the keyed state machines, over a stated order of arrival. For batches only; streams use ``streaming.processors``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def repair_is_new(df: DataFrame, key: str, day: Column, order: list[str], flag: str = "is_new") -> DataFrame:
    """A device's first record sets its first day, the day before unless the record says new; later claims of new on another day become 0."""
    w = Window.partitionBy(key).orderBy(*order)
    first_flag, first_day = F.first(flag).over(w), F.first(day).over(w)
    state = F.when(first_flag == "1", first_day).otherwise(F.date_sub(first_day, 1))
    later = F.row_number().over(w) > 1
    return df.withColumns({"__s": state, "__l": later}).withColumn(flag, F.when(F.col("__l") & (F.col(flag) == "1") & (F.col("__s") != day), "0").otherwise(F.col(flag))).drop("__s", "__l")


def first_of_day(df: DataFrame, keys: list[str], day: Column, order: list[str], name: str = "uv") -> DataFrame:
    """1 where a key's day differs from that of its record before, else 0; all rows stay."""
    before = F.lag(day).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, F.when(before.isNull() | (before != day), 1).otherwise(0).cast("long"))


def login_metrics(df: DataFrame, key: str, day: Column, order: list[str], gap_days: int = 8) -> DataFrame:
    """``uu``: first login of a day; ``back``: such a login ``gap_days`` or more after the day of the one before."""
    before = F.lag(day).over(Window.partitionBy(key).orderBy(*order))
    uu = before.isNull() | (before != day)
    back = before.isNotNull() & (before != day) & (F.datediff(day, before) >= gap_days)
    return df.withColumns({"uu": uu.cast("long"), "back": F.coalesce(back, F.lit(False)).cast("long")})


def retract_and_emit(df: DataFrame, key: list[str], amounts: list[str], order: list[str]) -> DataFrame:
    """Each row, and before each repeat of a key the row before it with its amounts negated and its own time."""
    w = Window.partitionBy(*key).orderBy(*order)
    following = df.withColumn("__again", F.lead(F.lit(1)).over(w))
    taken_back = following.where("__again = 1").drop("__again").withColumns({a: -F.col(a) for a in amounts})
    return df.withColumn("retracted", F.lit(False)).unionByName(taken_back.withColumn("retracted", F.lit(True)))


def latest_by_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last by ``order``."""
    w = Window.partitionBy(*key).orderBy(*(F.desc_nulls_last(c) for c in order))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
