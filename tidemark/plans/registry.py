"""All queries by name over the star-schema tables, each with the SQL that gives the same rows.

The tables stand in for the feeds: an event's user is the device and its type the page or channel, an order line is an
order detail, an order an order record, a part a product, a supplier a province.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar, text
from ..operators import etl, joins, routing, state, windows
from ..sinks import writers
from ..sources.readers import with_event_time
from . import dwd, dws, serving

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder}/{name}.parquet")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


_LABEL = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_BUCKET = "time_bucket(interval '10 seconds', ts)"
_WINDOW = f"{_LABEL.format(_BUCKET)} as stt, {_LABEL.format(f'{_BUCKET} + interval 10 seconds')} as edt"


def _day():
    return F.to_date("ts")



# ---- filters and projections


@query("select event_id, event_type from events where event_type not in ('error', 'signup')")
def etl_filter(t):
    return etl.drop_types(t.events, ["error", "signup"], "event_type").select("event_id", "event_type")


@query("select event_id, kind from (select event_id, case when event_id % 7 <> 0 then event_type end as kind from events) where kind is not null and kind <> 'view'")
def etl_filter_strict(t):
    rows = t.events.select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("kind"))
    return etl.drop_types(rows, ["view"], "kind", keep_missing=False)


@query("select event_id, value from (select event_id, case event_id % 3 when 0 then null when 1 then '' else event_type end as value from events) where value is not null and value <> ''")
def present_values(t):
    rows = t.events.select("event_id", F.when(F.col("event_id") % 3 == 2, F.col("event_type")).when(F.col("event_id") % 3 == 1, "").alias("value"))
    return etl.present(rows, empty_too=True)


def _order_changes(t) -> DataFrame:
    """A customer's orders as states of one record: an insertion, then updates with the replaced state."""
    before = F.lag("o_orderstatus").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = t.orders.withColumn("before", before)
    old = F.when(F.col("before") != F.col("o_orderstatus"), F.create_map(F.lit("order_status"), F.col("before")))
    data = F.create_map(F.lit("id"), F.col("o_orderkey").cast("string"), F.lit("order_status"), F.col("o_orderstatus"))
    return rows.select(F.lit("order_info").alias("table"), F.when(F.col("before").isNull(), "insert").otherwise("update").alias("type"), data.alias("data"), old.alias("old"))


@query("""
select cast(o_orderkey as varchar) as id, o_orderstatus as order_status, before from (
  select *, lag(o_orderstatus) over (partition by o_custkey order by o_orderdate, o_orderkey) as before from orders)
where o_orderstatus = 'F' and before <> 'F'""")
def status_transition(t):
    return etl.pick(etl.moved_to(_order_changes(t), "order_info", "order_status", "F"), ["id", "order_status"]).select("id", "order_status", F.col("old")["order_status"].alias("before"))


@query("select count(*) as n, type from (select case when lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) is null then 'insert' else 'update' end as type from orders) group by type")
def changes_by_type(t):
    return etl.of_table(_order_changes(t), "order_info").groupBy("type").agg(F.count("*").alias("n"))


@query("select event_id, cast(props ->> '$.k' as bigint) as k from events")
def json_extract(t):
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("select event_id, 'event_type=' || event_type || ',user_id=' || user_id as picked from events")
def config_projection(t):
    kept = etl.listed_entries(etl.as_map("event_id", "event_type", "user_id"), F.lit("user_id,event_type,missing"))
    entries = F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return t.events.select("event_id", F.array_join(entries, ",").alias("picked"))


@query("select tag, count(*) as n from (select case when json_valid(v) and json_type(v) = 'OBJECT' then 'clean' else 'dirty' end as tag from (select props as v from events union all select text from conversations)) group by tag")
def dirty_split(t):
    clean, dirty = etl.dirty_split(t.events.select(F.col("props").alias("value")).unionByName(t.conversations.select(F.col("text").alias("value"))))
    return clean.select(F.lit("clean").alias("tag")).unionByName(dirty.select(F.lit("dirty").alias("tag"))).groupBy("tag").agg(F.count("*").alias("n"))


def _log_values(t) -> DataFrame:
    """Events as log records: errors with a page, signups as starts, views with two displays, clicks with an action."""
    one = lambda kind, column: F.when(F.col("event_type") == kind, F.create_map(F.lit("id"), F.col(column).cast("string")))
    common = F.struct(*(F.col("user_id" if c in ("mid", "uid") else "event_type").cast("string").alias(c) for c in ("mid", "uid", "vc", "ch", "ar", "is_new")))
    page = F.struct(F.col("event_type").alias("page_id"), F.lit(None).cast("string").alias("last_page_id"))
    displays = F.when(F.col("event_type") == "view", F.array(etl.as_map("event_id"), etl.as_map("user_id")))
    actions = F.when(F.col("event_type") == "click", F.array(etl.as_map("event_id")))
    record = F.struct(common.alias("common"), page.alias("page"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), one("error", "event_id").alias("err"), one("signup", "event_id").alias("start"), displays.alias("displays"), actions.alias("actions"))
    return t.events.select(F.to_json(record).alias("value"))


@query("""
with c as (
  select *, '{"ar":"' || event_type || '","ch":"' || event_type || '","is_new":"' || event_type || '","mid":"' || user_id || '","uid":"' || user_id || '","vc":"' || event_type || '"}' as common,
    '{"page_id":"' || event_type || '"}' as page, '{"event_id":"' || event_id || '"}' as one, '{"user_id":"' || user_id || '"}' as two, epoch_us(ts) // 1000 as ms from events)
select 'err' as tag, '{"id":"' || event_id || '"}' as value from c where event_type = 'error' union all
select 'start', '{"id":"' || event_id || '"}' from c where event_type = 'signup' union all
select 'display', '{"common":' || common || ',"page":' || page || ',"ts":' || ms || ',"display":' || one || '}' from c where event_type = 'view' union all
select 'display', '{"common":' || common || ',"page":' || page || ',"ts":' || ms || ',"display":' || two || '}' from c where event_type = 'view' union all
select 'action', '{"common":' || common || ',"page":' || page || ',"action":' || one || '}' from c where event_type = 'click' union all
select 'page', '{"common":' || common || ',"page":' || page || ',"ts":' || ms || '}' from c where event_type <> 'signup'""")
def five_way_split(t):
    return etl.tagged_split(etl.parsed(_log_values(t)))


@query("""
select id, added from (
  select l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber as id, l_quantity,
    lag(l_quantity) over (partition by l_orderkey order by l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as before,
    case when lag(l_quantity) over (partition by l_orderkey order by l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) is null then cast(l_quantity as bigint) else cast(l_quantity as bigint) - cast(lag(l_quantity) over (partition by l_orderkey order by l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as bigint) end as added
  from lineitem) where before is null or l_quantity > before""")
def cart_add_delta(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    rows = t.lineitem.withColumn("before", F.lag("l_quantity").over(w))
    number = lambda c: F.create_map(F.lit("sku_num"), F.col(c).cast("int").cast("string"))
    ident = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("id")
    changes = rows.select(ident, F.lit("cart_info").alias("table"), F.when(F.col("before").isNull(), "insert").otherwise("update").alias("type"), number("l_quantity").alias("data"), F.when(F.col("before").isNotNull(), number("before")).alias("old"))
    return etl.cart_additions(changes).select("id", F.col("added").cast("bigint").alias("added"))


@query("select event_id from events where event_type in ('view', 'purchase')")
def home_detail_filter(t):
    return etl.home_and_detail(t.events, "event_type", ("view", "purchase")).select("event_id")


@query("select event_id from (select event_id, case when user_id % 5 = 0 then '' else cast(user_id as varchar) end as uid, case event_type when 'view' then null when 'click' then 'login' else event_type end as last from events) where uid <> '' and (last is null or last = 'login')")
def login_filter(t):
    last = F.when(F.col("event_type") == "view", None).when(F.col("event_type") == "click", "login").otherwise(F.col("event_type"))
    rows = t.events.select("event_id", F.when(F.col("user_id") % 5 == 0, "").otherwise(F.col("user_id").cast("string")).alias("uid"), last.alias("last_page_id"))
    return etl.logins(rows).select("event_id")


@query("select event_id from events where event_type = 'click' and user_id % 2 = 0")
def search_filter(t):
    page = F.struct(F.when(F.col("event_type") == "click", "search").alias("last_page_id"), F.lit("keyword").alias("item_type"), F.when(F.col("user_id") % 2 == 0, F.col("event_type")).alias("item"))
    return etl.search_words(t.events.withColumn("page", page)).select("event_id")


@query("select event_id from events where event_type = 'signup' or event_type = 'purchase'")
def nonzero_metrics(t):
    rows = t.events.select("event_id", (F.col("event_type") == "signup").cast("int").alias("uu"), (F.col("event_type") == "purchase").cast("int").alias("back"))
    return etl.any_metric(rows, "uu", "back").select("event_id")


# ---- joins


@query("""
select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(o_custkey as varchar) as user_id, p_name as sku_name, c_mktsegment as segment, n_name as nation
from lineitem join orders on l_orderkey = o_orderkey left join part on l_partkey = p_partkey left join customer on o_custkey = c_custkey and c_acctbal > 0
join nation on n_nationkey = l_suppkey % 30""")
def order_wide(t):
    dic = t.nation.select(F.col("n_nationkey").cast("string").alias("dic_code"), F.col("n_name").alias("dic_name"))
    rows = joins.detail_join(t.lineitem, t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = joins.detail_join(rows, t.part, F.col("l_partkey") == F.col("p_partkey"), "left")
    rows = joins.detail_join(rows, t.customer.where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left")
    rows = joins.dictionary_join(rows.withColumn("code", (F.col("l_suppkey") % 30).cast("string")), dic, "code", "nation")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("o_custkey").cast("string").alias("user_id"), F.col("p_name").alias("sku_name"), F.col("c_mktsegment").alias("segment"), "nation")


@query("select l_orderkey, l_linenumber, l_partkey, a.n_name as type_name, b.n_name as reason_name from lineitem join nation a on a.n_nationkey = l_partkey % 25 join nation b on b.n_nationkey = l_suppkey % 40 where l_returnflag = 'R'")
def refund_wide_two_dicts(t):
    dic = t.nation.select(F.col("n_nationkey").cast("string").alias("dic_code"), F.col("n_name").alias("dic_name"))
    rows = t.lineitem.where("l_returnflag = 'R'").withColumns({"a": (F.col("l_partkey") % 25).cast("string"), "b": (F.col("l_suppkey") % 40).cast("string")})
    return joins.dictionary_join(joins.dictionary_join(rows, dic, "a", "type_name"), dic, "b", "reason_name").select("l_orderkey", "l_linenumber", "l_partkey", "type_name", "reason_name")


@query("select a.l_orderkey, a.l_partkey, count(*) as n from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey = b.l_partkey where a.l_returnflag = 'R' and b.l_returnflag = 'A' group by 1, 2")
def composite_key_join(t):
    a, b = t.lineitem.where("l_returnflag = 'R'").select("l_orderkey", "l_partkey"), t.lineitem.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"))
    return joins.detail_join(a, b, (F.col("l_orderkey") == F.col("o")) & (F.col("l_partkey") == F.col("p"))).groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n"))


def _purchases_and_clicks(t):
    side = lambda kind, p: t.events.where(F.col("event_type") == kind).select(F.col("event_id").alias(f"{p}_id"), F.col("user_id").alias(f"{p}_user"), F.col("ts").alias(f"{p}_ts"))
    return side("click", "c"), side("purchase", "p")


_PAIRS = "select c.event_id as c_id, p.event_id as p_id from events c join events p on c.user_id = p.user_id where c.event_type = 'click' and p.event_type = 'purchase' and c.ts >= p.ts - interval {} and c.ts <= p.ts + interval {}"


@query(_PAIRS.format("15 minutes", "5 seconds"))
def interval_join(t):
    return joins.interval_join(*_purchases_and_clicks(t), [("c_user", "p_user")], "c_ts", "p_ts", "15 minutes", "5 seconds").select("c_id", "p_id")


@query(_PAIRS.format("6 hours", "6 hours"))
def interval_join_wide(t):
    return joins.interval_join(*_purchases_and_clicks(t), [("c_user", "p_user")], "c_ts", "p_ts", "6 hours", "6 hours").select("c_id", "p_id")


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, s_name, n_name, r_name from lineitem left join supplier on s_suppkey = l_suppkey and s_acctbal > 0 left join nation on n_nationkey = s_nationkey left join region on r_regionkey = n_regionkey")
def dim_snowflake(t):
    steps = [
        (t.supplier.where("s_acctbal > 0"), "l_suppkey", "s_suppkey", {"s_name": "s_name", "s_nationkey": "nation_id"}),
        (t.nation, "nation_id", "n_nationkey", {"n_name": "n_name", "n_regionkey": "region_id"}),
        (t.region, "region_id", "r_regionkey", {"r_name": "r_name"}),
    ]
    return joins.snowflake(t.lineitem, steps).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "s_name", "n_name", "r_name")


@query("select p_partkey, p_name from part where p_brand = 'Brand#4' and p_size = 5")
def dim_lookup(t):
    return joins.dim_row(t.part, p_brand="Brand#4", p_size=5).select("p_partkey", "p_name")


_CONFIG = [("view", "", "dim_view", "dim", "event_id,user_id"), ("click", "", "dim_click", "dim", "event_id"), ("signup", "", "dim_old", "dim", "event_id"), ("error", "insert", "dwd_error", "dwd", "event_id,user_id")]


def _config(t) -> DataFrame:
    row = "struct<source_table:string,source_type:string,sink_table:string,sink_type:string,sink_columns:string>"
    events = [(None, c, "c", 1) for c in _CONFIG] + [(_CONFIG[2], None, "d", 2), (_CONFIG[0], (*_CONFIG[0][:4], "event_id,value"), "u", 3)]
    return t.spark.createDataFrame(events, f"before {row}, after {row}, op string, ts_ms long")


def _event_changes(t) -> DataFrame:
    return t.events.select(F.col("event_type").alias("table"), F.lit("insert").alias("type"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("string").alias("ts"), etl.as_map("event_id", "user_id", "value").alias("data"))


@query("select case event_type when 'view' then 'dim_view' else 'dim_click' end as sink_table, cast(event_id as varchar) as id, case event_type when 'view' then 2 else 1 end as n_columns from events where event_type in ('view', 'click')")
def config_routing(t):
    routed = routing.route_dimensions(_event_changes(t), routing.current_config(_config(t), "dim", ("source_table",)))
    return routed.select("sink_table", F.col("data")["event_id"].alias("id"), F.size(F.map_keys("data")).alias("n_columns"))


@query("select 'dwd_error' as sink_table, cast(event_id as varchar) as id, cast(user_id as varchar) as user_id from events where event_type = 'error'")
def config_routing_facts(t):
    routed = routing.route_facts(_event_changes(t), routing.current_config(_config(t), "dwd", ("source_table", "source_type")))
    return routed.select("sink_table", F.col("data")["event_id"].alias("id"), F.col("data")["user_id"].alias("user_id"))


# ---- state machines, in the order of time


@query("""
select event_id, case when rn > 1 and flag = '1' and case when f = '1' then d1 else d1 - 1 end <> cast(ts as date) then '0' else flag end as is_new from (
  select event_id, ts, flag, row_number() over w as rn, first_value(flag) over w as f, cast(first_value(ts) over w as date) as d1
  from (select *, case when event_type in ('signup', 'view') then '1' else '0' end as flag from events) window w as (partition by user_id order by ts, event_id))""")
def is_new_repair(t):
    rows = t.events.withColumn("is_new", F.when(F.col("event_type").isin("signup", "view"), "1").otherwise("0"))
    return state.repair_is_new(rows, "user_id", _day(), ["ts", "event_id"]).select("event_id", "is_new")


_FIRST = "cast(coalesce(cast(lag(ts) over (partition by {} order by ts, event_id) as date) <> cast(ts as date), true) as bigint)"


@query(f"""
select {_WINDOW}, ch, cast(sum(uv) as bigint) as uv, cast(sum(sv) as bigint) as sv, count(*) as pv, cast(sum(k) as bigint) as dur from (
  select *, event_type as ch, {_FIRST.format('user_id')} as uv, cast(event_type = 'view' as bigint) as sv, cast(props ->> '$.k' as bigint) as k from events)
group by {_BUCKET}, ch""")
def uv_sv_pv_window(t):
    rows = state.first_of_day(t.events, ["user_id"], _day(), ["ts", "event_id"])
    rows = windows.page_metrics(rows, F.when(F.col("event_type") != "view", F.col("event_type")), F.from_json("props", "k bigint")["k"]).withColumn("ch", F.col("event_type"))
    return windows.tumble(rows, "ts", ["ch"], uv=F.sum("uv"), sv=F.sum("sv"), pv=F.sum("pv"), dur=F.sum("dur"))


@query(f"""
select {_WINDOW}, vc, ch, ar, is_new, cast(sum(uv) as bigint) as uv, cast(sum(sv) as bigint) as sv, count(*) as pv, cast(sum(k) as bigint) as dur from (
  select *, cast(event_id % 3 as varchar) as vc, event_type as ch, cast(user_id % 5 as varchar) as ar, case when event_id % 2 = 1 and f = 1 and rn > 1 and first_day <> cast(ts as date) then '0' when event_id % 2 = 1 and f = 0 and rn > 1 and first_day - 1 <> cast(ts as date) then '0' else cast(event_id % 2 as varchar) end as is_new,
    {_FIRST.format('user_id')} as uv, cast(event_type = 'view' as bigint) as sv, cast(props ->> '$.k' as bigint) as k
  from (select *, first(event_id % 2) over w as f, cast(first(ts) over w as date) as first_day, row_number() over w as rn from events window w as (partition by user_id order by ts, event_id)))
group by {_BUCKET}, vc, ch, ar, is_new""")
def page_view_window(t):
    rows = t.events.withColumns({"vc": (F.col("event_id") % 3).cast("string"), "ch": F.col("event_type"), "ar": (F.col("user_id") % 5).cast("string"), "is_new": (F.col("event_id") % 2).cast("string")})
    rows = state.repair_is_new(rows, "user_id", _day(), ["ts", "event_id"])
    rows = state.first_of_day(rows, ["user_id"], _day(), ["ts", "event_id"])
    rows = windows.page_metrics(rows, F.when(F.col("event_type") != "view", F.col("event_type")), F.from_json("props", "k bigint")["k"])
    return dws.page_view(rows, "ts").drop("ts")


@query(f"""
select {_WINDOW}, cast(sum(case when event_type = 'view' then uv else 0 end) as bigint) as home_uv, cast(sum(case when event_type = 'purchase' then uv else 0 end) as bigint) as detail_uv from (
  select *, {_FIRST.format('user_id, event_type')} as uv from events where event_type in ('view', 'purchase')) where uv = 1 group by {_BUCKET}""")
def home_detail_uv(t):
    rows = state.first_of_day(etl.home_and_detail(t.events, "event_type", ("view", "purchase")), ["user_id", "event_type"], _day(), ["ts", "event_id"])
    home, uv = F.col("event_type") == "view", F.col("uv")
    rows = rows.withColumns({"home_uv": F.when(home, uv).otherwise(0), "detail_uv": F.when(~home, uv).otherwise(0)})
    return dws.home_detail(rows, "ts").drop("ts")


@query(f"select {_WINDOW}, count(*) as uu from (select *, {_FIRST.format('user_id')} as uv from events where event_type = 'purchase') where uv = 1 group by {_BUCKET}")
def cart_uu(t):
    rows = state.first_of_day(t.events.where("event_type = 'purchase'"), ["user_id"], _day(), ["ts", "event_id"]).where("uv = 1")
    return dws.cart_users(rows, "ts").drop("ts")


@query(f"""
select {_WINDOW}, cast(sum(cast(before is not null and date_diff('day', before, d) >= 8 as bigint)) as bigint) as back, count(*) as uu from (
  select ts, cast(ts as date) as d, cast(lag(ts) over (partition by user_id order by ts, event_id) as date) as before from events where event_type = 'signup') where before is null or before <> d group by {_BUCKET}""")
def login_back(t):
    rows = state.login_metrics(t.events.where("event_type = 'signup'"), "user_id", _day(), ["ts", "event_id"])
    return dws.user_login(rows, "ts").drop("ts")


_LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
_ORDERED = f"partition by l_orderkey, l_linenumber order by {', '.join(_LINE_ORDER)}"


@query(f"""
with x as (select l_orderkey, l_linenumber, cast(l_extendedprice as decimal(16,2)) as amount, lead(1) over ({_ORDERED}) as again from lineitem)
select l_orderkey, l_linenumber, cast(sum(a) as double) as net, count(*) as n from (
  select l_orderkey, l_linenumber, amount as a from x union all select l_orderkey, l_linenumber, -amount from x where again = 1) group by 1, 2""")
def retract_dedup(t):
    rows = t.lineitem.withColumn("amount", F.col("l_extendedprice").cast("decimal(16,2)"))
    emitted = state.retract_and_emit(rows, ["l_orderkey", "l_linenumber"], ["amount"], _LINE_ORDER)
    return emitted.groupBy("l_orderkey", "l_linenumber").agg(F.sum("amount").cast("double").alias("net"), F.count("*").alias("n"))


@query(f"select l_orderkey, l_linenumber, l_extendedprice from (select *, row_number() over (partition by l_orderkey, l_linenumber order by {', '.join(c + ' desc' for c in _LINE_ORDER)}) as n from lineitem) where n = 1")
def latest_by_key(t):
    return state.latest_by_key(t.lineitem, ["l_orderkey", "l_linenumber"], _LINE_ORDER).select("l_orderkey", "l_linenumber", "l_extendedprice")


# ---- windows and answers


@query("""
select strftime(time_bucket(interval '10 seconds', l_shipdate), '%Y-%m-%d %H:%M:%S') as stt, l_partkey as sku_id, p_name as sku_name,
  cast(sum(cast(l_extendedprice as decimal(16,2))) as double) as original_amount, cast(sum(cast(l_tax as decimal(16,2))) as double) as coupon_amount
from lineitem left join part on p_partkey = l_partkey group by time_bucket(interval '10 seconds', l_shipdate), l_partkey, p_name""")
def sku_window(t):
    sums = windows.tumble(t.lineitem, "l_shipdate", ["l_partkey"], original_amount=F.sum(F.col("l_extendedprice").cast("decimal(16,2)")), coupon_amount=F.sum(F.col("l_tax").cast("decimal(16,2)")))
    named = joins.dim_join(sums, t.part, "l_partkey", "p_partkey", {"p_name": "sku_name"})
    return named.select("stt", F.col("l_partkey").alias("sku_id"), "sku_name", F.col("original_amount").cast("double").alias("original_amount"), F.col("coupon_amount").cast("double").alias("coupon_amount"))


@query("""
select strftime(time_bucket(interval '10 seconds', l_shipdate), '%Y-%m-%d %H:%M:%S') as stt, l_suppkey as province_id, s_name as province_name, count(distinct l_orderkey) as order_count, cast(sum(cast(l_extendedprice as decimal(16,2))) as double) as order_amount
from lineitem left join supplier on s_suppkey = l_suppkey group by time_bucket(interval '10 seconds', l_shipdate), l_suppkey, s_name""")
def province_window(t):
    rows = t.lineitem.select(F.col("l_shipdate").alias("row_time"), F.col("l_suppkey").alias("province_id"), F.col("l_orderkey").alias("order_id"), F.col("l_extendedprice").cast("decimal(16,2)").alias("order_amount"))
    provinces = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return dws.province_order(rows, provinces).select("stt", "province_id", "province_name", "order_count", F.col("order_amount").cast("double").alias("order_amount"))


@query(f"select {_WINDOW}, cast(sum(cast(event_type = 'view' as bigint)) as bigint) as views, cast(sum(cast(event_type = 'click' as bigint)) as bigint) as clicks from events group by {_BUCKET}")
def global_window(t):
    kind = lambda k: F.sum((F.col("event_type") == k).cast("long"))
    return windows.tumble(t.events, "ts", [], views=kind("view"), clicks=kind("click"))


@query("select stt, keyword, count(*) as keyword_count from (select strftime(to_timestamp((doc_id // 10) * 10) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as stt, unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x))) as keyword from documents) group by 1, 2")
def keyword_window(t):
    words = t.documents.select(F.timestamp_seconds("doc_id").alias("row_time"), F.explode(text.latin_words(F.col("text"))).alias("keyword"))
    return dws.keyword(words).drop("edt", "ts")


@query("select word, count(*) as n from (select unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x))) as word from benchmark) group by word")
def keyword_table_function(t):
    text.register(t.spark)
    t.benchmark.createOrReplaceTempView("fullwords")
    return t.spark.sql("select word, count(*) as n from fullwords, lateral ik_analyze(text) group by word")


@query("select cast(coalesce(sum(cast(o_totalprice as decimal(16,2))), 0) as double) as gmv from orders where o_orderdate = '1997-05-28'")
def gmv_day(t):
    return serving.gmv(t.orders.withColumn("order_amount", F.col("o_totalprice").cast("decimal(16,2)")), 19970528, "o_orderdate").select(F.col("gmv").cast("double").alias("gmv"))


@query("select cast(coalesce(sum(o_totalprice), 0) as double) as gmv from orders where o_orderdate = '1901-01-01'")
def gmv_empty_day(t):
    return serving.gmv(t.orders.withColumn("order_amount", F.col("o_totalprice").cast("decimal(16,2)")), 19010101, "o_orderdate").select(F.col("gmv").cast("double").alias("gmv"))


def _views(t) -> DataFrame:
    rows = state.first_of_day(t.events, ["user_id"], _day(), ["ts", "event_id"]).withColumn("ch", F.col("event_type"))
    return rows.groupBy(F.window("ts", "10 seconds").alias("w"), "ch").agg(F.sum("uv").alias("uv")).select(F.col("w.start").alias("stt"), "ch", "uv")


_CHANNELS = f"select event_type as ch, cast(sum(uv) as bigint) as uv_ct from (select *, {_FIRST.format('user_id')} as uv from events) where cast(ts as date) = '2024-01-02' group by 1 order by 2 desc, 1 limit 3"


@query(_CHANNELS)
def channel_uv_topk(t):
    return serving.channel_visitors(_views(t), 20240102, 3)


@query(f"""select '{{"status":0,"data":{{"categories":[' || string_agg('"' || ch || '"', ',' order by uv_ct desc, ch) || '],"series":[{{"name":"渠道","data":[' || string_agg(uv_ct, ',' order by uv_ct desc, ch) || ']}}]}}}}' as value from ({_CHANNELS})""")
def channel_uv_json(t):
    return serving.channel_visitors_json(_views(t), 20240102, 3)


@query("""select '{"status":0,"data":' || cast(coalesce(sum(cast(o_totalprice as decimal(16,2))), 0) as varchar) || '}' as value from orders where o_orderdate = '1997-05-28'""")
def gmv_json(t):
    return serving.gmv_json(t.orders.withColumn("order_amount", F.col("o_totalprice").cast("decimal(16,2)")), 19970528, "o_orderdate")


# ---- scalar functions


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(cast(cast(l_quantity as decimal(16,2)) * cast(l_extendedprice as decimal(16,2)) as decimal(33,4)) as varchar) as amount from lineitem")
def decimal_scale4(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", scalar.amount(F.col("l_quantity"), F.col("l_extendedprice")).alias("amount"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as date_id, cast(strftime(o_orderdate, '%Y%m%d') as integer) as day_number from orders")
def date_fmt(t):
    return t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_id"), scalar.day_number(F.col("o_orderdate")).alias("day_number"))


@query("select event_id, cast(date_diff('day', cast('2024-01-01' as date), cast(ts as date)) as integer) as days from events")
def day_diff(t):
    return t.events.select("event_id", F.datediff(_day(), F.to_date(F.lit("2024-01-01"))).alias("days"))


@query("select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as text, strftime(ts, '%Y-%m-%d') as day, cast(epoch_ms(date_trunc('second', ts)) as bigint) as millis from events")
def unixtime(t):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = t.events.select("event_id", scalar.text_of_millis(ms).alias("text"), scalar.day_of_millis(ms).alias("day"))
    return rows.withColumn("millis", scalar.millis_of_text(F.col("text")))


@query("select event_id, cast(-value as double) as negated, event_type in ('view', 'click') as listed, event_id % 2 = 0 as empty from events")
def small_functions(t):
    return t.events.select(
        "event_id", scalar.negated(F.col("value").cast("string")).cast("double").alias("negated"), scalar.listed(F.lit("view,click"), F.col("event_type")).alias("listed"),
        scalar.is_empty(F.when(F.col("event_id") % 2 == 1, F.col("event_type"))).alias("empty"),
    )


@query("select event_type as topic, count(*) as n from events where event_type in ('view', 'click') group by 1")
def topic_routing(t):
    rows = t.events.where("event_type in ('view', 'click')").select(F.col("event_type").alias("sink_table"), "event_id")
    return writers.kafka_values(rows).where("value not like '%sink_table%'").groupBy("topic").agg(F.count("*").alias("n"))


# ---- detail tables from change records built of the star schema


def _shop_changes(t) -> DataFrame:
    """Order lines, their orders (inserted, and cancelled where finished), activities of parts and coupons of suppliers, as change records."""
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"), F.col("l_extendedprice").cast("decimal(16,2)"))
    money = lambda c: F.col(c).cast("decimal(16,2)").cast("string")
    m = lambda **kv: F.create_map(*(x for k, v in kv.items() for x in (F.lit(k), v.cast("string"))))
    none = F.lit(None).cast("map<string,string>")
    record = lambda df, table, data, kind="insert", old=none: df.select(F.lit(table).alias("table"), F.lit(kind).alias("type"), F.lit("1700000000").alias("ts"), data.alias("data"), old.alias("old"))
    li, o = t.lineitem, t.orders
    detail = m(id=key, order_id=F.col("l_orderkey"), sku_id=F.col("l_partkey"), sku_name=F.lit("x"), create_time=F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"), source_id=F.lit("0"), source_type=F.col("l_suppkey") % 30, sku_num=F.col("l_quantity").cast("int"), order_price=money("l_extendedprice"), split_activity_amount=money("l_discount"), split_coupon_amount=money("l_tax"), split_total_amount=money("l_extendedprice"))
    order = m(id=F.col("o_orderkey"), user_id=F.col("o_custkey"), province_id=F.col("o_custkey") % 34, operate_time=F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), order_status=F.lit("1003"))
    parts = [
        record(li, "order_detail", detail),
        record(o, "order_info", order),
        record(o.where("o_orderstatus = 'F'"), "order_info", order, "update", m(order_status=F.lit("1001"))),
        record(li.where("l_partkey % 2 = 0"), "order_detail_activity", m(order_detail_id=key, activity_id=F.col("l_partkey"), activity_rule_id=F.lit("7"))),
        record(li.where("l_suppkey % 3 = 0"), "order_detail_coupon", m(order_detail_id=key, coupon_id=F.col("l_suppkey"))),
    ]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union


def _dic(t) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").cast("string").alias("dic_code"), F.col("n_name").alias("dic_name"))


_MONEY = "cast(cast({} as decimal(16,2)) as varchar)"
_LINE_ID = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') || '-' || cast(l_extendedprice as decimal(16,2))"
_ORIGINAL = "cast(cast(cast(cast(l_quantity as integer) as decimal(16,2)) * cast(l_extendedprice as decimal(16,2)) as decimal(33,4)) as varchar)"
_LINES = """lineitem join orders on l_orderkey = o_orderkey join nation on n_nationkey = l_suppkey % 30"""
_DETAIL_TAIL = f"""case when l_partkey % 2 = 0 then cast(l_partkey as varchar) end as activity_id, case when l_partkey % 2 = 0 then '7' end as activity_rule_id, case when l_suppkey % 3 = 0 then cast(l_suppkey as varchar) end as coupon_id"""
_DETAIL_SPLITS = f"""cast(cast(l_quantity as integer) as varchar) as sku_num, {_ORIGINAL} as split_original_amount, {_MONEY.format('l_discount')} as split_activity_amount, {_MONEY.format('l_tax')} as split_coupon_amount, {_MONEY.format('l_extendedprice')} as {{total}}"""


@query(f"""
select {_LINE_ID} as id, cast(l_orderkey as varchar) as order_id, cast(o_custkey as varchar) as user_id, cast(l_partkey as varchar) as sku_id, 'x' as sku_name, cast(o_custkey % 34 as varchar) as province_id,
  {_DETAIL_TAIL}, strftime(l_shipdate, '%Y-%m-%d') as date_id, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') as create_time, '0' as source_id, cast(l_suppkey % 30 as varchar) as source_type, n_name as source_type_name,
  {_DETAIL_SPLITS.format(total='split_total_amount')}, '1700000000' as ts
from {_LINES}""")
def dwd_order_detail(t):
    return dwd.order_detail(_shop_changes(t), _dic(t))


@query(f"""
select {_LINE_ID} as id, cast(l_orderkey as varchar) as order_id, cast(o_custkey as varchar) as user_id, cast(l_partkey as varchar) as sku_id, 'x' as sku_name, cast(o_custkey % 34 as varchar) as province_id,
  {_DETAIL_TAIL}, strftime(o_orderdate, '%Y-%m-%d') as date_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as cancel_time, '0' as source_id, cast(l_suppkey % 30 as varchar) as source_type_code, n_name as source_type_name,
  {_DETAIL_SPLITS.format(total='split_total_amount')}, '1700000000' as ts
from {_LINES} where o_orderstatus = 'F'""")
def dwd_cancel_detail(t):
    return dwd.cancel_detail(_shop_changes(t), _dic(t))


@query("""
select cast(event_id as varchar) as id, cast(user_id as varchar) as user_id, cast(event_id % 100 as varchar) as sku_id, case when before is null then cast(n as varchar) else cast(n - before as varchar) end as sku_num,
  cast(cast(epoch(date_trunc('second', ts)) as bigint) as varchar) as ts, cast(event_id % 30 as varchar) as source_type, n_name as source_type_name
from (select *, lag(n) over (partition by user_id order by ts, event_id) as before from (select *, cast(floor(value) as integer) as n from events where event_type = 'purchase'))
join nation on n_nationkey = event_id % 30 where before is null or n > before""")
def dwd_cart_add(t):
    rows = t.events.where("event_type = 'purchase'").withColumn("n", F.floor("value").cast("int").cast("string"))
    rows = rows.withColumn("before", F.lag("n").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    data = F.create_map(*(x for k, v in {"id": "event_id", "user_id": "user_id", "sku_id": F.col("event_id") % 100, "sku_num": "n", "source_type": F.col("event_id") % 30}.items() for x in (F.lit(k), F.col(v).cast("string") if isinstance(v, str) else v.cast("string"))))
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")
    changes = rows.select(F.lit("cart_info").alias("table"), F.when(F.col("before").isNull(), "insert").otherwise("update").alias("type"), seconds.alias("ts"), data.alias("data"), F.when(F.col("before").isNotNull(), F.create_map(F.lit("sku_num"), F.col("before"))).alias("old"))
    return dwd.cart_add(changes, _dic(t))


def _change(df: DataFrame, table: str, kind: str, data: dict, old: dict | None = None, ts=None) -> DataFrame:
    """Change records of one table from columns."""
    m = lambda kv: F.create_map(*(x for k, v in kv.items() for x in (F.lit(k), (F.col(v) if isinstance(v, str) else v).cast("string"))))
    was = m(old) if old else F.lit(None).cast("map<string,string>")
    return df.select(F.lit(table).alias("table"), F.lit(kind).alias("type"), (F.lit("1700000000") if ts is None else ts.cast("string")).alias("ts"), m(data).alias("data"), was.alias("old"))


def _refund_changes(t) -> DataFrame:
    """Returned lines as refunds asked for and paid, finished orders as refunding and then refunded."""
    back = t.lineitem.where("l_returnflag = 'R'")
    price = F.col("l_extendedprice").cast("decimal(16,2)")
    at = F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")
    of_line = {"id": "l_linenumber", "user_id": "l_suppkey", "order_id": "l_orderkey", "sku_id": "l_partkey"}
    refund = of_line | {"refund_type": F.col("l_suppkey") % 30, "refund_num": F.col("l_quantity").cast("int"), "refund_amount": price, "refund_reason_type": F.col("l_partkey") % 27, "refund_reason_txt": F.lit("why"), "create_time": at, "refund_status": F.lit("0705")}
    paid = of_line | {"payment_type": F.col("l_suppkey") % 30, "callback_time": at, "total_amount": price, "refund_status": F.when(F.col("l_linestatus") == "F", "0701").otherwise("0702")}
    done = t.orders.where("o_orderstatus = 'F'")
    order = lambda code: {"id": "o_orderkey", "user_id": "o_custkey", "province_id": F.col("o_custkey") % 34, "order_status": F.lit(code)}
    parts = [
        _change(back, "order_refund_info", "insert", refund), _change(back.where("l_linenumber <= 4"), "order_refund_info", "update", refund, {"refund_status": F.lit("0701")}), _change(back, "refund_payment", "insert", paid),
        _change(done, "order_info", "update", order("1005"), {"order_status": F.lit("1002")}), _change(done, "order_info", "update", order("1006"), {"order_status": F.lit("1005")}),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(f"""
select cast(l_linenumber as varchar) as id, cast(l_suppkey as varchar) as user_id, cast(l_orderkey as varchar) as order_id, cast(l_partkey as varchar) as sku_id, cast(o_custkey % 34 as varchar) as province_id,
  strftime(l_shipdate, '%Y-%m-%d') as date_id, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') as create_time, cast(l_suppkey % 30 as varchar) as refund_type_code, a.n_name as refund_type_name,
  cast(l_partkey % 27 as varchar) as refund_reason_type_code, b.n_name as refund_reason_type_name, 'why' as refund_reason_txt, cast(cast(l_quantity as integer) as varchar) as refund_num, {_MONEY.format('l_extendedprice')} as refund_amount, '1700000000' as ts
from lineitem join orders on l_orderkey = o_orderkey join nation a on a.n_nationkey = l_suppkey % 30 join nation b on b.n_nationkey = l_partkey % 27 where l_returnflag = 'R' and o_orderstatus = 'F'""")
def dwd_order_refund(t):
    return dwd.order_refund(_refund_changes(t), _dic(t)).drop("row_op_ts")


@query(f"""
select cast(p.l_linenumber as varchar) as id, cast(o_custkey as varchar) as user_id, cast(p.l_orderkey as varchar) as order_id, cast(p.l_partkey as varchar) as sku_id, cast(o_custkey % 34 as varchar) as province_id,
  cast(p.l_suppkey % 30 as varchar) as payment_type_code, n_name as payment_type_name, strftime(p.l_shipdate, '%Y-%m-%d') as date_id, strftime(p.l_shipdate, '%Y-%m-%d %H:%M:%S') as callback_time,
  cast(cast(r.l_quantity as integer) as varchar) as refund_num, {_MONEY.format('p.l_extendedprice')} as refund_amount, '1700000000' as ts
from lineitem p join orders on p.l_orderkey = o_orderkey join nation on n_nationkey = p.l_suppkey % 30 join lineitem r on r.l_orderkey = p.l_orderkey and r.l_partkey = p.l_partkey
where p.l_returnflag = 'R' and p.l_linestatus = 'F' and r.l_returnflag = 'R' and r.l_linenumber <= 4 and o_orderstatus = 'F'""")
def dwd_refund_pay_suc(t):
    return dwd.refund_paid(_refund_changes(t), _dic(t)).drop("row_op_ts")


@query(f"""
with pays as (
  select l_orderkey as p_order, l_suppkey as p_user, l_partkey % 30 as kind, epoch(l_shipdate) + case l_partkey % 3 when 0 then 600 when 1 then -4 else 1000 end as paid_at from lineitem where l_linenumber = 1)
select {_LINE_ID} as order_detail_id, cast(l_orderkey as varchar) as order_id, cast(p_user as varchar) as user_id, cast(l_partkey as varchar) as sku_id, 'x' as sku_name, cast(o_custkey % 34 as varchar) as province_id,
  {_DETAIL_TAIL}, cast(kind as varchar) as payment_type_code, k.n_name as payment_type_name, 'then' as callback_time, '0' as source_id, cast(l_suppkey % 30 as varchar) as source_type_code, nation.n_name as source_type_name,
  {_DETAIL_SPLITS.format(total='split_payment_amount')}, cast(cast(paid_at as bigint) as varchar) as ts
from {_LINES} join pays on p_order = l_orderkey and epoch(l_shipdate) >= paid_at - 900 and epoch(l_shipdate) <= paid_at + 5 join nation k on k.n_nationkey = kind""")
def dwd_pay_detail_suc(t):
    at = F.unix_seconds(F.col("l_shipdate").cast("timestamp")) + F.when(F.col("l_partkey") % 3 == 0, 600).when(F.col("l_partkey") % 3 == 1, -4).otherwise(1000)
    paid = _change(t.lineitem.where("l_linenumber = 1"), "payment_info", "insert", {"user_id": "l_suppkey", "order_id": "l_orderkey", "payment_type": F.col("l_partkey") % 30, "callback_time": F.lit("then")}, ts=at)
    changes, paid = _shop_changes(t), with_event_time(paid)
    details = dwd.order_detail(changes, _dic(t), lines=dwd.paid_lines(changes, paid)).withColumn("row_time", F.to_timestamp("create_time"))
    return dwd.pay_detail(paid, details, _dic(t))


_AMOUNTS = ", ".join(f"cast(sum(cast({e} as decimal(16,4))) as double) as {n}" for n, e in {"original_amount": "cast(l_quantity as integer) * cast(l_extendedprice as decimal(16,2))", "activity_amount": "cast(l_discount as decimal(16,2))", "coupon_amount": "cast(l_tax as decimal(16,2))", "order_amount": "cast(l_extendedprice as decimal(16,2))"}.items())


@query(f"""
with sums as (
  select strftime(time_bucket(interval '10 seconds', l_shipdate), '%Y-%m-%d %H:%M:%S') as stt, strftime(time_bucket(interval '10 seconds', l_shipdate) + interval 10 seconds, '%Y-%m-%d %H:%M:%S') as edt, l_partkey, {_AMOUNTS}
  from {_LINES} group by 1, 2, 3)
select stt, edt, cast(p_size as varchar) as trademark_id, m.n_name as trademark_name, cast(c2.r_regionkey % 3 as varchar) as category1_id, c1.r_name as category1_name, cast(c3.n_regionkey as varchar) as category2_id, c2.r_name as category2_name,
  cast(p_partkey % 30 as varchar) as category3_id, c3.n_name as category3_name, cast(l_partkey as varchar) as sku_id, p_name as sku_name, cast(p_partkey % 120 as varchar) as spu_id, s_name as spu_name, original_amount, activity_amount, coupon_amount, order_amount
from sums left join part on p_partkey = l_partkey left join supplier on s_suppkey = p_partkey % 120 left join nation m on m.n_nationkey = p_size left join nation c3 on c3.n_nationkey = p_partkey % 30
left join region c2 on c2.r_regionkey = c3.n_regionkey left join region c1 on c1.r_regionkey = c2.r_regionkey % 3""")
def dws_sku_order(t):
    text_of = lambda df, **columns: df.select(*((F.col(c) if isinstance(c, str) else c).cast("string").alias(n) for n, c in columns.items()))
    dims = {
        "sku_info": text_of(t.part, id="p_partkey", sku_name="p_name", spu_id=F.col("p_partkey") % 120, tm_id="p_size", category3_id=F.col("p_partkey") % 30),
        "spu_info": text_of(t.supplier, id="s_suppkey", spu_name="s_name"),
        "base_trademark": text_of(t.nation, id="n_nationkey", tm_name="n_name"),
        "base_category3": text_of(t.nation, id="n_nationkey", name="n_name", category2_id="n_regionkey"),
        "base_category2": text_of(t.region, id="r_regionkey", name="r_name", category1_id=F.col("r_regionkey") % 3),
        "base_category1": text_of(t.region, id="r_regionkey", name="r_name"),
    }
    details = dwd.order_lines(_shop_changes(t), _dic(t)).withColumn("row_time", F.to_timestamp("create_time"))
    rows = dws.sku_order(dws.order_amounts(details), dims).drop("ts")
    return rows.withColumns({n: F.col(n).cast("double") for n in dws.AMOUNTS})
