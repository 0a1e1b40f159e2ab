"""Joins. The sizes of dictionaries and dimensions are left to Spark's own broadcast threshold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def detail_join(left: DataFrame, right: DataFrame, on: Column, how: str = "inner", times: tuple[str, str] | None = None, ttl: str | None = None) -> DataFrame:
    """An equi-join. On streams ``times`` and ``ttl`` bound how far the two sides' times may be apart, which lets state go."""
    if times and ttl:
        a, b = times
        on = on & F.expr(f"{a} >= {b} - interval {ttl} and {a} <= {b} + interval {ttl}")
    return left.join(right, on, how)


def dictionary_join(df: DataFrame, dic: DataFrame, code: str, name: str) -> DataFrame:
    """Adds the dictionary's name of a code; rows without an entry go. May be used twice, under two names."""
    table = dic.select(F.col("dic_code").alias("__code"), F.col("dic_name").alias(name))
    return df.join(table, F.col(code) == F.col("__code")).drop("__code")


def interval_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], left_time: str, right_time: str, lower: str, upper: str) -> DataFrame:
    """Pairs of equal keys with ``right_time - lower <= left_time <= right_time + upper``, both ends in."""
    on = reduce(lambda a, b: a & b, (F.col(a) == F.col(b) for a, b in keys))
    return left.join(right, on & F.expr(f"{left_time} >= {right_time} - interval {lower} and {left_time} <= {right_time} + interval {upper}"))


def dim_join(df: DataFrame, dim: DataFrame, key: str, dim_key: str, columns: dict[str, str]) -> DataFrame:
    """Adds columns of a dimension's row by its key; a miss leaves them null and the row stays."""
    table = dim.select(F.col(dim_key).alias("__dim"), *(F.col(c).alias(n) for c, n in columns.items()))
    return df.join(table, F.col(key) == F.col("__dim"), "left").drop("__dim")


def snowflake(df: DataFrame, steps: list[tuple[DataFrame, str, str, dict[str, str]]]) -> DataFrame:
    """A chain of :func:`dim_join`: each step's key may come from an earlier one."""
    for dim, key, dim_key, columns in steps:
        df = dim_join(df, dim, key, dim_key, columns)
    return df


def dim_row(dim: DataFrame, **equal) -> DataFrame:
    """The dimension's rows in which all named columns have their values."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), equal.items(), dim)
