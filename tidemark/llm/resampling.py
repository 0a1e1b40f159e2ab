"""Importance resampling towards a target distribution: bucket gains as an array, sorted runs, merges by tournament."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let

#: Number of buckets that features are hashed to.
BUCKETS = 10_000
_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of a merge, at least, and the most merges that a draw is cut into, but for ties.
PIECE, PIECES = 4_096, 16_384
_BLOCK = 8_192
_ROW = "doc_id long, n_features long, weight long, score long"


def feature_words(text: Column) -> Column:
    """Words of a text with A-Z in lower case: runs of digits, a-z and all from U+0080 on; none for null."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, _APART), "")


def feature_buckets(words: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of each word and of each two words in a row, joined by a space: the CRC-32 of the UTF-8 bytes modulo ``buckets``."""
    bucket = lambda x: (F.crc32(x.cast("binary")) % buckets).cast("int")
    fewer = lambda w: F.greatest(F.size(w) - 1, F.lit(0))
    pairs = lambda w: F.zip_with(F.slice(w, F.lit(1), fewer(w)), F.slice(w, F.lit(2), fewer(w)), lambda a, b: bucket(F.concat(a, F.lit(" "), b)))
    return let(words, lambda w: F.concat(F.transform(w, bucket), pairs(w)))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: the features of all texts by bucket, added up in each task before the shuffle."""
    return texts.select(F.explode(feature_buckets(feature_words(F.col("text")), buckets)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row, ``gains array<long>``: floor(1000 * ln) of how much likelier each bucket is in ``target`` than in ``docs``, each count and one."""
    own, aim = bucket_counts(docs, buckets), bucket_counts(target, buckets)
    sides = own.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(aim.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    counts = cut(sides.unionByName(every).groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t")))
    whole = counts.select(F.struct(F.sum("s").alias("s"), F.sum("t").alias("t"))).scalar()
    ratio = (F.col("t") + 1) * (F.col("w.s") + buckets) / ((F.col("s") + 1) * (F.col("w.t") + buckets))
    listed = counts.select("bucket", "s", "t", whole.alias("w")).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))
    return listed.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "gain"))), lambda x: x["gain"]).alias("gains"))


def scored(docs: DataFrame, target: DataFrame, seed: int = 7, least_words: int = 20, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_features, weight, score, eligible`` of each row of ``docs``.

    ``weight`` is the mean of the gains of a document's features, rounded down, 0 without any. ``score`` adds a Gumbel
    number drawn by the id, so that the highest scores are a draw by weight without replacement. ``eligible``: at
    least ``least_words`` words.
    """
    array_of = cut(gains(docs.select("text"), target.select("text"), buckets))
    words = docs.select("doc_id", feature_words(F.col("text")).alias("__w"))
    featured = words.select("doc_id", F.size("__w").alias("__n"), feature_buckets(F.col("__w"), buckets).alias("__b"), array_of.scalar().alias("__g"))
    total = F.aggregate("__b", F.lit(0).cast("long"), lambda a, b: a + F.get(F.col("__g"), b))
    summed = featured.select("doc_id", "__n", F.size("__b").cast("long").alias("n_features"), total.alias("__t"))
    weighed = summed.withColumn("weight", F.when(F.col("n_features") > 0, F.expr("(__t - pmod(__t, n_features)) div n_features")).otherwise(F.lit(0)).cast("long"))
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0)))
    return weighed.select("doc_id", "n_features", "weight", (F.col("weight") + noise).cast("long").alias("score"), (F.col("__n") >= least_words).alias("eligible"))


def _bounds(high: DataFrame, histogram: list[tuple[int, int]], piece: int) -> list[tuple[int, int, int]]:
    """Where merges begin after the first: keys (-score, 0, id), so that each has some ``piece`` rows. A score with more rows is cut by their ids."""
    crowded, bounds, held = [], [], 0
    for score, n in histogram:
        if held and held + n > piece:
            bounds.append((-score, -1, 0))
            held = 0
        held += n
        if n > piece:
            crowded.append((score, n))
    for score, n in crowded:
        parts = -(-n // piece)
        cuts = high.where(F.col("score") == score).agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10_000)).first()[0] or []
        bounds += [(-score, 0, i) for i in sorted(set(cuts))]
    return sorted(bounds)


def _key(score: int, doc_id: int | None, n_features: int, weight: int) -> tuple[int, int, int, int, int]:
    """Highest scores first, then smaller ids, null ids last; the rest settles ties of equal ids."""
    return -score, doc_id is None, doc_id or 0, n_features, weight


def _runs(bounds: list[tuple[int, int, int]]):
    """Sorted rows of a partition to its run's blocks: ``piece, run, seq, n`` and lists of values, equal rows once with ``copies``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        from pyspark import TaskContext

        run, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            values = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            for at in range(0, len(values), _BLOCK):
                blocks: dict[int, dict[tuple, int]] = {}
                for doc_id, n_features, weight, score in values[at : at + _BLOCK]:
                    piece = blocks.setdefault(bisect_right(bounds, (-score, int(doc_id is None), doc_id or 0)), {})
                    piece[(doc_id, n_features, weight, score)] = piece.get((doc_id, n_features, weight, score), 0) + 1
                columns = [pa.array([[row[i] for row in b] for b in blocks.values()], pa.list_(pa.int64())) for i in range(4)]
                copies = [list(b.values()) for b in blocks.values()]
                numbers = [pa.array(list(blocks), pa.int32()), pa.array([run] * len(blocks), pa.int32()), pa.array(range(seq, seq + len(blocks)), pa.int64()), pa.array(list(map(sum, copies)), pa.int64())]
                seq += len(blocks)
                yield pa.RecordBatch.from_arrays([*numbers, *columns, pa.array(copies, pa.list_(pa.int64()))], names=["piece", "run", "seq", "n", "doc_id", "n_features", "weight", "score", "copies"])

    return pack


def _entries(table: pa.Table, offsets: np.ndarray, blocks: list[int]) -> Iterator[tuple[tuple, int]]:
    """The keys of a run in order, with their places in the flat columns; a block at a time becomes Python numbers."""
    for b in blocks:
        columns = [table[c][b].values.to_pylist() for c in ("score", "doc_id", "n_features", "weight")]
        yield from zip(map(_key, *columns), range(int(offsets[b]), int(offsets[b + 1])))


def _tournament(runs: list[Iterator[tuple[tuple, int]]]) -> Iterator[int]:
    """Places in the order of their keys over all sorted runs, by a tree of losers.

    Each inner node keeps the loser of its match and the winner plays on; when the champion's run moves on, only the
    matches on its way to the root are played again.
    """
    end = ((float("inf"),), -1)
    k = len(runs)
    heads = [next(r, end) for r in runs]
    losers = [-1] * k  # node 0 is not used; run i enters at node (i + k) // 2

    def climb(player: int) -> int:
        node = (player + k) // 2
        while node:
            if losers[node] < 0:  # first round: wait for an opponent
                losers[node] = player
                return -1
            if heads[losers[node]] < heads[player]:
                losers[node], player = player, losers[node]
            node //= 2
        return player

    champion = -1
    for player in range(k):
        won = climb(player)
        champion = won if won >= 0 else champion
    while heads[champion] is not end:
        yield heads[champion][1]
        heads[champion] = next(runs[champion], end)
        champion = climb(champion)


def _merged(starts: dict[int, int], draws: int):
    """The rows of one piece, merged from their runs, with the number of those ``before`` each in the whole order; stops where the draw is full."""

    def merge(table: pa.Table) -> pa.Table:
        before = starts[table["piece"][0].as_py()]
        table = table.sort_by([("run", "ascending"), ("seq", "ascending")]).combine_chunks()
        lengths = table["copies"].combine_chunks().value_lengths().to_numpy()
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        blocks: dict[int, list[int]] = {}
        for i, run in enumerate(table["run"].to_pylist()):
            blocks.setdefault(run, []).append(i)
        flat = {c: table[c].combine_chunks().flatten() for c in ("doc_id", "n_features", "weight", "score", "copies")}
        copies, order, firsts = flat["copies"].to_pylist(), array("q"), array("q")
        for place in _tournament([_entries(table, offsets, b) for b in blocks.values()]):
            order.append(place)
            firsts.append(before)
            before += copies[place]
            if before >= draws:
                break
        rest = np.setdiff1d(np.arange(offsets[-1]), np.frombuffer(order, np.int64))  # not drawn: in no order
        order, firsts = np.concatenate((np.frombuffer(order, np.int64), rest)), np.concatenate((np.frombuffer(firsts, np.int64), np.full(len(rest), draws)))
        return pa.table({**{c: v.take(pa.array(order)) for c, v in flat.items()}, "before": pa.array(firsts, pa.int64())})

    return merge


def draw(rows: DataFrame, percent: int = 25) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of each row: ranks from 1 on for the draw, null for all others.

    Of the N ``eligible`` rows of ``rows``, as :func:`scored` gives them, ``percent`` * N // 100 of highest score are
    drawn; ties go to smaller ids, null ids last. Scores are whole numbers of a narrow range, so the count of each says
    at which score the draw is full; rows below it need no order. All others are sorted where they lie, one run for each
    partition, and written as blocks. Each piece of the order, some thousand rows, is merged from its runs in a task of
    its own, and the last one stops at the draw's count. Rows of a score that alone fills several pieces are cut by id,
    and equal rows travel once with their number, so no group has to fit in one task. Other columns are ignored. No rows
    give no rows.
    """
    rows = cut(rows.select("doc_id", "n_features", "weight", "score", "eligible"))
    counts = [tuple(r) for r in rows.where("eligible").groupBy("score").agg(F.count("*")).orderBy(F.desc("score")).collect()]  # a row for each whole number that scores take
    draws, held, lowest = percent * sum(n for _, n in counts) // 100, 0, None
    for score, n in counts:
        if held >= draws:
            break
        held, lowest = held + n, score
    plain = ("doc_id", "n_features", "weight", "score")
    if lowest is None:
        return rows.select(*plain, F.lit(None).cast("long").alias("rank"))
    chosen = F.col("eligible") & (F.col("score") >= lowest)
    high = rows.where(chosen).select(*plain)
    bounds = _bounds(high, [c for c in counts if c[0] >= lowest], max(PIECE, -(-draws // PIECES)))
    lists = ", ".join(f"{c} array<long>" for c in (*plain, "copies"))
    runs = high.sortWithinPartitions(F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight").mapInArrow(_runs(bounds), f"piece int, run int, seq long, n long, {lists}")
    runs = cut(runs)
    starts, before = {}, 0
    for piece, n in runs.groupBy("piece").agg(F.sum("n")).orderBy("piece").collect():  # some 16,384 at most, and those of ties
        starts[piece] = before
        before += n
    merged = runs.groupBy("piece").applyInArrow(_merged(starts, draws), f"{_ROW}, copies long, before long")
    ranked = merged.select(*plain, "before", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).withColumn("rank", F.col("before") + F.col("copy"))
    ranked = ranked.select(*plain, F.when(F.col("rank") <= draws, F.col("rank")).alias("rank"))
    return ranked.unionByName(rows.where(~chosen).select(*plain, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7, least_words: int = 20) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of each row of ``docs``, drawn towards the texts of ``target``.

    Null and empty texts have no features, weight 0 and are never drawn. Rows without an id draw the number of an empty
    id and come last among ties. Repeated rows come back repeated, each with a rank of its own. A target without texts
    leaves all gains to the documents' own counts. Other columns are ignored; no rows give no rows.
    """
    return draw(scored(docs, target, seed, least_words), percent)
