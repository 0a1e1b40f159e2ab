"""Line dedup: repeated runs of line IDs, named by prefix doubling, and what later copies of them hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, words

_DOC = "struct<none: boolean, id: bigint, hash: bigint, size: int>"
_LANES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)


def _doc() -> Column:
    """A document among all: ids in order and null ids last, then the text's hash and length for ids that repeat."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(F.lit(7), "text").alias("hash"), F.coalesce(F.octet_length("text"), F.lit(-1)).alias("size"))


def _sequences(docs: DataFrame) -> DataFrame:
    """``doc, at, place, c, w``: a row for each line with a word. ``at`` counts those lines, ``place`` all lines; ``c`` is the line's ID, ``w`` its number of words."""
    parts = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("place"))), lambda p: p["x"].rlike(r"[^\x20\x09-\x0D]"))
    lines = docs.select(_doc().alias("doc"), F.posexplode(parts).alias("at", "p"))
    return lines.select("doc", "at", F.col("p.place").alias("place"), F.unhex(F.md5(F.trim("p.x"))).alias("c"), F.size(words(F.col("p.x"))).alias("w"))


def _named(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of pairs of names, 128 bits in two lanes that mix both parts."""
    x = (left ^ (left >> np.uint64(32))) * _LANES + np.roll(right, 1, axis=1) * _LANES[::-1]
    x ^= np.roll(x, 1, axis=1) >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x += right + (x >> np.uint64(31))
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(30))


def _least_runs(words_before: np.ndarray, first: np.ndarray, last: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of fewest lines with ``min_words`` words from each line on and up to each line, inside segments.

    ``words_before`` has one number more than lines; ``first`` and ``last`` are the ends of each line's segment. Any
    longer run is covered by such ones inside it: a line lies in the run from its first line on, or in the one that
    ends at the line.
    """
    n = len(first)
    at = np.arange(n)
    on = np.searchsorted(words_before, words_before[:-1] + min_words, "left")
    back = np.searchsorted(words_before, words_before[1:] - min_words, "right") - 1
    from_here, to_here = on <= last, back >= first
    starts = np.concatenate([at[from_here], back[to_here]])
    ends = np.concatenate([on[from_here], at[to_here] + 1])
    runs = np.unique(starts * (n + 1) + ends)
    return runs // (n + 1), runs % (n + 1) - runs // (n + 1)


def _runs(min_words: int):
    """Rows of documents with their repeated lines in order to ``doc, at, size, places, rank``, one for each run of least size."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, lists = batch.column(0), batch.column(1)
            flat, lengths = lists.flatten(), np.diff(lists.offsets.to_numpy())
            n = len(flat)
            if not n:
                continue
            at, place, w = (flat.field(name).to_numpy(zero_copy_only=False) for name in ("at", "place", "w"))
            owner = np.repeat(np.arange(len(lengths)), lengths)
            begins = np.concatenate(([True], (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)))
            starts = np.flatnonzero(begins)
            segment = np.cumsum(begins) - 1
            last = np.append(starts[1:], n)[segment]
            run_at, size = _least_runs(np.concatenate(([0], np.cumsum(w, dtype=np.int64))), starts[segment], last, min_words)
            # Level k names the 2^k lines from a line on by the names of their halves; two that overlap name any run.
            name = np.frombuffer(b"".join(flat.field("c").to_pylist()), dtype=np.uint64).reshape(n, 2)
            rank = np.empty((len(size), 2), dtype=np.uint64)
            for k in range(int(size.max(initial=1)).bit_length()):
                if k:
                    half = 1 << (k - 1)
                    name = _named(name, np.concatenate([name[half:], np.zeros((min(half, n), 2), np.uint64)])[:n])
                level = np.flatnonzero((size >> k) == 1)
                low = run_at[level]
                rank[level] = _named(_named(name[low], name[low + size[level] - (1 << k)]), np.repeat(size[level].astype(np.uint64)[:, None], 2, axis=1))
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(run_at, size)
            places = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(place[inside], pa.int32()))
            ranks = pa.Array.from_buffers(pa.binary(16), len(rank), [None, pa.py_buffer(np.ascontiguousarray(rank))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([docs.take(pa.array(owner[run_at])), pa.array(at[run_at], pa.int32()), pa.array(size, pa.int32()), places, ranks], names=["doc", "at", "size", "places", "rank"])

    return over


def repeated_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``doc, gone``: the places of the lines to delete, all in later copies of runs of ``min_words`` words or more.

    A line that stands more than once is a suffix of its document's sequence of line IDs. Each document's repeated lines
    come together in order, and each stretch of them is named by prefix doubling: the name of 2^k lines comes from the
    names of its halves, and two names that overlap give a run of any size its rank. All suffixes with one rank are a
    longest-common-prefix interval of that size. The earliest suffix of an interval is kept and the run is deleted at
    the others; deleted runs that overlap or touch make up a maximal one. Ranks only have to tell runs apart, so they
    are 128-bit digests, no number has to be dealt over all rows and doubling needs no shuffle.
    """
    seq = cut(_sequences(docs).withColumn("h", F.xxhash64("c")))
    repeated = seq.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    suffixes = seq.join(repeated, "h", "left_semi").groupBy("doc").agg(F.collect_set(F.struct("at", "place", "c", "w")).alias("lines"))
    suffixes = suffixes.select("doc", F.array_sort("lines").alias("lines"))
    ranked = cut(suffixes.mapInArrow(_runs(min_words), f"doc {_DOC}, at int, size int, places array<int>, rank binary"))
    intervals = ranked.groupBy("rank").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = ranked.join(intervals, "rank").where(F.struct("doc", "at") > F.col("first"))
    # A copy that overlaps the first one in its own document leaves the first whole.
    kept = F.when(F.col("doc") == F.col("first.doc"), F.greatest(F.col("first.at") + F.col("size") - F.col("at"), F.lit(0))).otherwise(F.lit(0))
    return later.select("doc", F.explode(F.slice("places", kept + 1, F.col("size"))).alias("place")).groupBy("doc").agg(F.collect_set("place").alias("gone"))


def dedup_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """All columns of ``docs``, the text without later copies of repeated runs, and ``n_deleted`` lines (long).

    A run is one or more lines in a row, lines without a word left out, that hold ``min_words`` words together and stand
    in the same order at an earlier place: in a document with a smaller id, or further up in the same one. Lines are
    compared without space at their ends. The earliest copy stays. A document of which nothing is left has an empty
    text. Null and empty texts stay as they are. Rows equal in id and text are one document and lose the same lines;
    null ids come after all others. A column called ``n_deleted`` is replaced. No rows give no rows.
    """
    gone = repeated_runs(docs.select("doc_id", "text"), min_words).select(F.col("doc").alias("__doc"), F.col("gone").alias("__gone"))
    joined = docs.drop("n_deleted").withColumn("__own", _doc()).join(gone, F.col("__own") == F.col("__doc"), "left").drop("__own", "__doc")
    # The lines are a column, not bound inside the expression: a Python function over nested lambdas does not run.
    parted = joined.withColumn("__lines", F.when(F.col("__gone").isNotNull(), F.split("text", "\n")))
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone"), lambda i: F.get("__lines", i)), "\n")
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(left)
    deleted = F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long")
    return parted.withColumns({"text": text, "n_deleted": deleted}).drop("__gone", "__lines")
