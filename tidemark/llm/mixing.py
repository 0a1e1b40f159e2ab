"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import KEY, WORD, cut, join_back, keyed

#: Weights of the sources in order, repeating; fixed values.
WEIGHTS = (5, 2, 1)
#: Slots lie on 2^31 points; each is the golden ratio less 1 of them on from the one before. Fixed values.
POINTS, TURN = 1 << 31, 1_327_217_885
_BUCKETS = 1024
_PIECE = 4096


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, weight, target`` from ``sizes(source, size)``: one row for each source.

    Weights go by the sources' order, null last. The targets share ``share`` times all sizes by weight; none is above
    ``most`` times its source's size, the excess goes to the others by weight. In the order of size over weight the
    first sources are held at the limit, and one pass over that order finds how many.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row for each source
    listed = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (turn % len(WEIGHTS) + 1).cast("int")).cast("double"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    cap = F.col("source_size") * F.lit(most)
    level = (F.sum("source_size").over(Window.partitionBy()) * F.lit(share) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # A source is held if the level of all that follow it is above its limit; held ones come first.
    ranked = listed.withColumns({"level": level, "cap": cap}).withColumn("held", F.col("level") * F.col("weight") >= F.col("cap"))
    shared = F.min(F.when(~F.col("held"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(Window.partitionBy())
    return ranked.withColumn("target", F.when(F.col("held"), F.col("cap")).otherwise(shared["level"] * F.col("weight"))).select("source", "source_size", "weight", "target")


def _running(df: DataFrame, group: str, order: str, value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the group before this one.

    ``order`` is unique hex text, spread evenly. Rows are bucketed by its first digits, so that a large group is
    sorted in 1,024 pieces; only the pieces' sums are added up in one place.
    """
    bucketed = df.withColumn("__b", (F.conv(F.substring(order, 1, 4), 16, 10).cast("int") / (65_536 // _BUCKETS)).cast("int"))
    sums = bucketed.groupBy(group, "__b").agg(F.sum(value).alias("__s"))
    base = sums.withColumn("__base", F.coalesce(F.sum("__s").over(Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col(group).alias("__g"), F.col("__b").alias("__c"), "__base")
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(group, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = bucketed.withColumn("__in", inside).join(base, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__b") == F.col("__c")))
    return joined.withColumn(name, F.col("__base") + F.col("__in")).drop("__b", "__c", "__g", "__in", "__base")


def schedule(goals: DataFrame, block: int) -> DataFrame:
    """``slot, source, rank``: which source each slot of the mix takes from, and which of its blocks, from 0 on.

    There is a slot for each ``block`` words of all targets. Slot s lies at the golden-ratio point s, and its source is
    the one in whose stretch of the cumulative targets that lies, so that every stretch of slots holds each source in
    its share. Slots are ranked in pieces of 4,096, so that a large source's are never in one place.
    """
    goals = goals.where("goal > 0")
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row for each source
    whole = F.sum("goal").over(Window.partitionBy())
    point = lambda words: F.floor(words.cast("double") / whole * POINTS)
    ends = F.sum("goal").over(order.rowsBetween(Window.unboundedPreceding, 0))
    edges = cut(goals.select("source", point(ends - F.col("goal")).alias("low"), point(ends).alias("high"), whole.alias("whole")))
    slots = -(-(edges.agg(F.max("whole")).first()[0] or 0) // block)
    cell = lambda x: F.floor(x / (POINTS // _PIECE))  # noqa: E731  a slot meets the few sources of its cell
    grid = edges.where("low < high").select("source", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high") - 1))).alias("cell"))
    points = edges.sparkSession.range(slots).select(F.col("id").alias("slot"), (F.col("id") % POINTS * TURN % POINTS).alias("point"))
    placed = points.withColumn("cell", cell(F.col("point"))).join(grid, "cell").where("point >= low and point < high")
    pieces = placed.select("slot", "source", F.floor(F.col("slot") / _PIECE).alias("piece"))
    counts = pieces.groupBy("source", "piece").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("source").alias("g"), F.col("piece").alias("c"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    local = F.row_number().over(Window.partitionBy("source", "piece").orderBy("slot")) - 1
    same = F.col("source").eqNullSafe(F.col("g")) & (F.col("piece") == F.col("c"))
    return pieces.withColumn("local", local).join(base, same).select("slot", "source", (F.col("base") + F.col("local")).alias("rank"))


def mix(docs: DataFrame, block: int = 64, seed: str = "mix", share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs(doc_id, text, source)``: a row for each row of ``docs``, and its fragments in the mix's order.

    The first has ``doc_id, size, source, source_size, target, taken, first_slot, n_slots`` and the :data:`common.KEY`
    of its row. The second has ``slot, source, rank, doc_id, start, copy, size, first_word, end_word`` and the key: the
    words that a slot takes from a document.
    Each source's documents are shuffled by digest and laid end to end, and once more, up to ``most`` times. That
    stream is cut in blocks of ``block`` words. The schedule's slot of rank r takes its source's block r, so a source
    gives as many words as slots fall to it: its target up to a few blocks, and never more than ``most`` times any
    document. Null and empty texts have size 0 and give nothing; a null source is a source of its own, after the
    others; null ids and repeated rows are rows like any other. Reruns agree. Sources are taken to be few enough for
    one row each in one task. No rows give no rows.
    """
    rows = keyed(docs.select("doc_id", "text", "source")).withColumn("size", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")).drop("text")
    rows = cut(rows.withColumn("order", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")))))
    goals = cut(targets(rows, share, most).withColumn("goal", F.round("target").cast("long")))
    slots = cut(schedule(goals, block))
    have = slots.groupBy(F.col("source").alias("h")).agg(F.count("*").alias("blocks"))
    known = goals.join(have, F.col("source").eqNullSafe(F.col("h")), "left").select(F.col("source").alias("g"), "source_size", "target", F.coalesce("blocks", F.lit(0)).alias("blocks"))
    placed = _running(rows, "source", "order", "size", "start").join(known, F.col("source").eqNullSafe(F.col("g"))).drop("g", "order")
    placed = cut(placed.withColumn("row", F.monotonically_increasing_id()))
    # Copy c of a document holds the words from c * source_size + start on of its source's stream.
    end = F.least(F.col("blocks") * block, F.floor(F.col("source_size") * most))
    laid = placed.where("size > 0 and blocks > 0").withColumns({"end": end, "copy": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(int(-(-most // 1)) - 1).cast("long")))})
    laid = laid.withColumn("u", F.col("copy") * F.col("source_size") + F.col("start")).withColumn("v", F.least(F.col("u") + F.col("size"), "end")).where("u < v")
    laid = laid.withColumn("rank", F.explode(F.sequence(F.expr(f"u div {block}"), F.expr(f"(v - 1) div {block}"))))
    laid = laid.withColumns({"first_word": F.greatest("u", F.col("rank") * block) - F.col("u"), "end_word": F.least("v", (F.col("rank") + 1) * block) - F.col("u")})
    taken_from = slots.select("slot", F.col("source").alias("s"), F.col("rank").alias("r"))
    fragments = laid.join(taken_from, F.col("source").eqNullSafe(F.col("s")) & (F.col("rank") == F.col("r"))).select(
        "row", "slot", "source", "rank", "doc_id", "start", "copy", "size", "first_word", "end_word", *KEY
    )
    sums = fragments.groupBy("row").agg(F.sum(F.col("end_word") - F.col("first_word")).alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n_slots"))
    full = placed.join(sums, "row", "left").select(
        "doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", F.coalesce("n_slots", F.lit(0)).alias("n_slots"), *KEY
    )
    return full, fragments.drop("row")


def mixed_documents(docs: DataFrame, block: int = 64, seed: str = "mix") -> DataFrame:
    """``docs`` as the mix holds them: each copy of a row of which half the words or more are taken; all columns.

    A copy stands where the first slot that takes from it does: each partition, and so each file written, is a part of
    the mix dealt out by key, in the order of its slots. Texts are shuffled once. Null and empty texts are in no slot.
    Of rows equal in id and text the first of each copy stands for all. No rows give no rows.
    """
    _, fragments = mix(docs, block, seed)
    copies = fragments.groupBy(*KEY, "start", "copy").agg(F.min("slot").alias("__slot"), F.sum(F.col("end_word") - F.col("first_word")).alias("taken"), F.max("size").alias("size"))
    copies = copies.where("2 * taken >= size").groupBy(*KEY, "copy").agg(F.min("__slot").alias("__slot")).drop("copy")
    return join_back(keyed(docs), copies, "inner").sortWithinPartitions("__slot").drop("__slot")
