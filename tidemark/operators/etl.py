"""Parsing, filters, projections and the log split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import is_empty
from ..schemas import STRINGS


def drop_types(df: DataFrame, types: list[str], column: str = "type", keep_missing: bool = True) -> DataFrame:
    """Records whose type is none of ``types``; those without a type stay or go by ``keep_missing``."""
    wanted = ~F.col(column).isin(types)
    return df.where(F.coalesce(wanted, F.lit(keep_missing)))


def present(df: DataFrame, column: str = "value", empty_too: bool = False) -> DataFrame:
    """Records that are not tombstones and, with ``empty_too``, not empty."""
    return df.where(~is_empty(F.col(column)) if empty_too else F.col(column).isNotNull())


def of_table(df: DataFrame, table: str, *types: str) -> DataFrame:
    found = df.where(F.col("table") == table)
    return found.where(F.col("type").isin(*types)) if types else found


def moved_to(df: DataFrame, table: str, column: str, *codes: str) -> DataFrame:
    """Updates that set ``column`` to one of ``codes``, from another value."""
    return of_table(df, table, "update").where(F.col("data")[column].isin(*codes) & F.col("old")[column].isNotNull())


def cart_additions(df: DataFrame, table: str = "cart_info", number: str = "sku_num") -> DataFrame:
    """Insertions, and updates that raise ``number``, with ``added``: the number, or by how much it rose."""
    new, old = F.col("data")[number].try_cast("int"), F.col("old")[number].try_cast("int")
    insert = F.col("type") == "insert"
    return of_table(df, table).where(insert | ((F.col("type") == "update") & old.isNotNull() & (new > old))).withColumn("added", F.when(insert, F.col("data")[number]).otherwise((new - old).cast("string")))


def pick(df: DataFrame, keys: list[str], column: str = "data") -> DataFrame:
    """Map entries as columns; missing keys are null."""
    return df.select("*", *(F.col(column)[k].alias(k) for k in keys))


def listed_entries(data: Column, csv: Column) -> Column:
    """The entries of a map whose keys a comma-separated list names, by exact text."""
    return F.map_filter(data, lambda k, _: F.array_contains(F.split(csv, ","), k))


def search_words(df: DataFrame) -> DataFrame:
    return df.where("page.last_page_id = 'search' and page.item_type = 'keyword' and page.item is not null")


def home_and_detail(df: DataFrame, column: str = "page_id", pages: tuple[str, ...] = ("home", "good_detail")) -> DataFrame:
    return df.where(F.col(column).isin(*pages))


def logins(df: DataFrame, uid: str = "uid", last_page: str = "last_page_id", page: str = "login") -> DataFrame:
    """Records with a user that begin a session or come from the login page."""
    return df.where(~is_empty(F.col(uid)) & (is_empty(F.col(last_page)) | (F.col(last_page) == page)))


def any_metric(df: DataFrame, *names: str) -> DataFrame:
    wanted = F.lit(False)
    for n in names:
        wanted = wanted | (F.coalesce(F.col(n), F.lit(0)) != 0)
    return df.where(wanted)


def on_day(df: DataFrame, column: str, day: int) -> DataFrame:
    """Rows of a day given as yyyyMMdd; a range, so that it reaches the scan."""
    start = f"{day // 10000:04d}-{day // 100 % 100:02d}-{day % 100:02d}"
    return df.where((F.col(column) >= F.expr(f"timestamp_ntz '{start} 00:00:00'")) & (F.col(column) < F.expr(f"timestamp_ntz '{start} 00:00:00' + interval 1 day")))


def parsed(values: DataFrame) -> DataFrame:
    """``value`` and ``log``, the JSON object it holds as a variant, with all its fields; null where it holds none."""
    log = F.try_parse_json(F.col("value"))
    return values.withColumn("log", log).withColumn("log", F.when(fields("log").isNotNull(), F.col("log")))


def fields(log: str = "log") -> Column:
    """The fields of a variant that is an object; null for any other."""
    return F.try_variant_get(log, "$", "map<string,variant>")


def dirty_split(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Log records that are JSON objects, and the ``value`` of all others, nulls too."""
    tagged = parsed(values)
    return tagged.where("log is not null").drop("log"), tagged.where("log is null").drop("log")


def field(path: str, kind: str = "variant", log: str = "log") -> Column:
    """A part of a log record; null where it is missing, null or of another kind."""
    found = F.try_variant_get(log, f"$.{path}", kind)
    return F.when(~F.is_variant_null(found), found) if kind == "variant" else found


def with_is_new(log: Column, flag: Column) -> Column:
    """The record's JSON text with another ``common.is_new`` and all else as it is."""
    common = F.parse_json(common_with(F.try_variant_get(log, "$.common", "variant"), flag))
    return F.to_json(F.transform_values(log.cast("map<string,variant>"), lambda k, x: F.when(k == "common", common).otherwise(x)))


def common_with(common: Column, flag: Column) -> Column:
    """The JSON text of a record's ``common``, a variant, with another ``is_new``."""
    new = F.parse_json(F.to_json(F.named_struct(F.lit("x"), flag)))
    return F.to_json(F.transform_values(F.try_variant_get(common, "$", "map<string,variant>"), lambda k, x: F.when(k == "is_new", F.variant_get(new, "$.x", "variant")).otherwise(x)))


LOG_TABLES = ("err", "start", "display", "action", "page")


#: What a log record gives, all of it with the record's ``common`` left out, which may still change.
PARTS = "array<struct<tag: string, rest: string>>"


def with_parts(logs: DataFrame) -> DataFrame:
    """Adds to :func:`parsed` log records ``common``, its JSON text, and ``parts``: what each gives, without ``common``; null for no record.

    An error goes out alone and leaves the record. A record with a start gives that alone. Any other gives a row for each
    display (common, page, ts, display) and each action (common, page, action) and the page record without these lists.
    Fields of any name go on as they are.
    """
    known = lambda x: F.when(~F.is_variant_null(x), x)
    read = logs.withColumn("__f", fields())
    read = read.withColumns({**{f"__{n}": known(F.col("__f")[n]) for n in ("err", "start", "common", "page", "ts")}, **{f"__{n}": F.try_variant_get(F.col("__f")[n], "$", "array<variant>") for n in ("displays", "actions")}})
    row = lambda tag, value: F.struct(F.lit(tag).alias("tag"), F.to_json(value).alias("rest"))
    none = F.array().cast(PARTS)
    body = lambda one, name, *more: F.struct(*(F.col(f"__{c}").alias(c) for c in more), one.alias(name))
    lists = lambda column, name, *more: F.coalesce(F.transform(column, lambda one: row(name, body(one, name, *more))), none)
    filled = lambda name: F.coalesce(F.size(f"__{name}") > 0, F.lit(False))
    rest = F.map_filter("__f", lambda k, x: ~k.isin("err", "common") & ~((k == "displays") & filled("displays")) & ~((k == "actions") & filled("actions")))
    whole = F.concat(lists("__displays", "display", "page", "ts"), lists("__actions", "action", "page"), F.array(row("page", rest)))
    parts = F.concat(F.when(F.col("__err").isNotNull(), F.array(row("err", F.col("__err")))).otherwise(none), F.when(F.col("__start").isNotNull(), F.array(row("start", F.col("__start")))).otherwise(whole))
    return read.select(*logs.columns, F.to_json("__common").alias("common"), F.when(F.col("__f").isNotNull(), parts).alias("parts"))


def put_together(rows: DataFrame) -> DataFrame:
    """``tag, value``: a row for each of ``parts``, with ``common`` put back where it belongs; none without parts.

    Rows without parts go only after the lists are taken apart: a filter on what was parsed would be moved down to the
    scan, and parse each value anew for each time it names it.
    """
    each = rows.select("common", F.explode_outer("parts").alias("p")).where("p is not null").select("common", "p.tag", "p.rest")
    bare = F.col("tag").isin("err", "start") | F.col("common").isNull()
    more = F.when(F.col("rest") == "{}", "}").otherwise(F.concat(F.lit(","), F.substring("rest", 2, 1 << 30)))
    return each.select("tag", F.when(bare, F.col("rest")).otherwise(F.concat(F.lit('{"common":'), F.col("common"), more)).alias("value"))


def tagged_split(logs: DataFrame) -> DataFrame:
    """``tag, value`` of :func:`parsed` log records: all rows of :data:`LOG_TABLES` (see :func:`with_parts`), in one pass."""
    return put_together(with_parts(logs))


def log_split(logs: DataFrame) -> dict[str, DataFrame]:
    """The rows of :func:`tagged_split` as five tables of ``value``."""
    split = tagged_split(logs)
    return {tag: split.where(F.col("tag") == tag).select("value") for tag in LOG_TABLES}


def as_map(*columns: str) -> Column:
    """Columns as a map of texts."""
    return F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c).cast("string")))).cast(STRINGS)
