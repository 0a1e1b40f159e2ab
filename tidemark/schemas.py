"""Record layouts of the feeds."""

from __future__ import annotations

from pyspark.sql import types as T

STRINGS = T.MapType(T.StringType(), T.StringType())


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


#: A database change: seconds in ``ts``, all columns as strings in ``data``, replaced values in ``old``.
CDC = T.StructType([*strings("database", "table", "type", "ts"), T.StructField("data", STRINGS), T.StructField("old", STRINGS)])
PAGE = T.StructType([*strings("page_id", "last_page_id", "item", "item_type"), T.StructField("during_time", T.LongType())])
#: An application log record: milliseconds in ``ts``.
LOG = T.StructType(
    [
        T.StructField("common", strings("mid", "uid", "vc", "ch", "ar", "is_new")),
        T.StructField("page", PAGE),
        T.StructField("ts", T.LongType()),
        T.StructField("err", STRINGS),
        T.StructField("start", STRINGS),
        T.StructField("displays", T.ArrayType(STRINGS)),
        T.StructField("actions", T.ArrayType(STRINGS)),
    ]
)
CONFIG = strings("source_table", "source_type", "sink_table", "sink_type", "sink_columns", "sink_pk", "sink_extend")
CONFIG_CHANGE = T.StructType([T.StructField("before", CONFIG), T.StructField("after", CONFIG), T.StructField("op", T.StringType()), T.StructField("ts_ms", T.LongType())])
ORDER_DETAIL = strings(
    "id", "order_id", "user_id", "sku_id", "sku_name", "province_id", "activity_id", "activity_rule_id", "coupon_id", "date_id", "create_time", "source_id",
    "source_type", "source_type_name", "sku_num", "split_original_amount", "split_activity_amount", "split_coupon_amount", "split_total_amount", "ts",
)
DIC = strings("dic_code", "dic_name")
EMP = T.StructType([T.StructField("empno", T.IntegerType()), T.StructField("ename", T.StringType()), T.StructField("deptno", T.IntegerType()), T.StructField("ts", T.LongType())])
DEPT = T.StructType([T.StructField("deptno", T.IntegerType()), T.StructField("dname", T.StringType()), T.StructField("ts", T.LongType())])
