"""Byte-level BPE by folds of ranked merges in Spark's higher-order functions."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, let

#: Above every rank.
NO_RANK = 1 << 30
_ID_BITS = 20
_KEY_BASE = 1 << 31
_PAIR_BUCKETS = 65_521
#: The most words that are folded once and broadcast, and their most bytes.
HEAD, LONGEST = 524_288, 48
#: The most rows and bytes that are looked up or put together at a time.
BATCH_ROWS, BATCH_BYTES = 1_000, 32 << 20
_IDS = T.ArrayType(T.IntegerType())


def load_ranks(path: str) -> dict[bytes, int]:
    """The rank file's tokens: lines of base64 and rank. Read by the driver alone."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


def java_pattern(pattern: str) -> str:
    """The splitting pattern with white space of all scripts, as the public tokenizers read it."""
    return "(?U)" + pattern


def _merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    pieces = [word[i : i + 1] for i in range(len(word))]
    while len(pieces) > 1:
        rank, at = min((ranks.get(pieces[i] + pieces[i + 1], NO_RANK), i) for i in range(len(pieces) - 1))
        if rank == NO_RANK:
            break
        pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
    return [ranks[p] for p in pieces]


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> tuple[list[list[int]], list[int], list[str], dict[str, int]]:
    """The rank map of pairs of ids by bucket, keys and ranks in turn; the bytes' ids; the tokens' bytes in hex; the tokens that no merges reach."""
    ranks = load_ranks(path)
    pairs: list[list[int]] = [[] for _ in range(_PAIR_BUCKETS)]
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                key = a * 65_536 + b
                pairs[key % _PAIR_BUCKETS] += [key + _KEY_BASE, rank]
    pieces = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    unreached = {token.hex().upper(): rank for token, rank in ranks.items() if len(token) > 1 and _merge(token, ranks) != [rank]}
    return pairs, [ranks[bytes([i])] for i in range(256)], pieces, unreached


def _with_literals(df: DataFrame, **tables) -> DataFrame:
    """Adds columns that each hold one (value, type) as a scalar subquery of one row.

    Plans name such a literal briefly and tasks get it as one block of bytes. Each column is to be used once, in the
    next projection, so that the optimizer puts the literal in its place and no row carries it.
    """
    spark = df.sparkSession
    return df.select("*", *(spark.createDataFrame([(value,)], f"v {kind}").scalar().alias(name) for name, (value, kind) in tables.items()))


class Codec:
    """The columns that encode and decode by one rank file of up to 65,536 tokens."""

    def __init__(self, path: str, pattern: str):
        self.pattern = java_pattern(pattern)
        self._pairs, self._single, self.pieces, self._unreached = _vocabulary(path)

    def tokens(self, text: Column) -> Column:
        """The pattern's matches in a text, in order; none for null."""
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))

    def with_ranks(self, df: DataFrame, name: str, body, **tables) -> DataFrame:
        """``df`` with the column ``name``: ``body(word -> ids, *tables)``, with the rank map bound once for a row's words."""
        tables |= {"__pairs": (self._pairs, "array<array<bigint>>"), "__single": (self._single, "array<bigint>")}
        wide = _with_literals(df, **tables)

        def bind(names: list[str], bound: list[Column]) -> Column:
            if names:
                return let(F.col(names[0]), lambda v: bind(names[1:], [*bound, v]))
            *own, pairs, single = bound
            return body(lambda word: self._encode_word(pairs, single, word), *own)

        return wide.withColumn(name, bind(list(tables), [])).drop(*tables)

    def _encode_word(self, pairs: Column, single: Column, word: Column) -> Column:
        """The ids of one match: its bytes' ids, folded by the merge of least rank, leftmost first, till none is left.

        An item is the rank of the merge with the next id, above the id itself, so that the least item is the next merge.
        """
        mask, none = (1 << _ID_BITS) - 1, F.lit(NO_RANK << _ID_BITS)
        at_key = lambda key: let(F.get(pairs, (key % _PAIR_BUCKETS).cast("int")), lambda bucket: F.get(bucket, F.array_position(bucket, key + _KEY_BASE).cast("int")))
        # A key that its bucket lacks gives the bucket's first key or null; keys are above all ranks.
        item = lambda left, right: F.shiftleft(F.least(let(left * 65_536 + right, at_key), F.lit(NO_RANK).cast("long")), _ID_BITS) + left
        id_at = lambda a, i: F.get(a, i.cast("int")).bitwiseAND(mask)

        def merge(a: Column, least: Column) -> Column:
            def put(at: Column, new: Column) -> Column:
                return F.concat(
                    F.slice(a, F.lit(1), F.greatest(at.cast("int") - 2, F.lit(0))),
                    F.when(at > 1, F.array(item(id_at(a, at - 2), new))).otherwise(F.array().cast("array<bigint>")),
                    F.array(F.when(at + 1 < F.size(a), item(new, id_at(a, at + 1))).otherwise(none + new)),
                    F.slice(a, at.cast("int") + 2, F.size(a)),
                )

            return let(F.array_position(a, least), lambda at: let(F.shiftright(least, _ID_BITS), lambda new: put(at, new)))

        step = lambda a, _: let(F.array_min(a), lambda least: F.when(least >= none, a).otherwise(merge(a, least)))
        first = lambda s: F.transform(s, lambda x, i: F.when(i + 1 < F.size(s), item(x, F.get(s, i + 1))).otherwise(none + x))
        singles = F.transform(F.split(F.decode(word.cast("binary"), "ISO-8859-1"), ""), lambda c: F.get(single, F.ascii(c)))
        folded = let(singles, lambda s: F.aggregate(F.sequence(F.lit(1), F.size(s)), first(s), step))
        ids = F.transform(folded, lambda x: x.bitwiseAND(mask).cast("int"))
        for token, rank in self._unreached.items():  # none or a few; whole tokens come before merges
            ids = F.when(F.hex(word.cast("binary")) == token, F.array(F.lit(rank))).otherwise(ids)
        return ids


def distinct_words(docs: DataFrame, codec: Codec) -> DataFrame:
    """``word, n``: each different match in all texts and its number; counted before the shuffle."""
    return docs.select(F.explode(codec.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _head(words: DataFrame, most: int) -> DataFrame:
    """The words more frequent than some count, the least for which they are ``most`` or fewer."""
    sizes = words.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n"))
    taken, least = 0, None
    for row in sizes.toLocalIterator():
        taken += row["words"]
        if taken > most:
            least = row["n"]
            break
    return words if least is None else words.where(F.col("n") > least)


def _ends(lengths: np.ndarray) -> np.ndarray:
    """The ends of runs laid one after the other, after a zero."""
    return np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))


def _runs(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Runs of ``values``, one after the other."""
    ends = _ends(lengths)
    return values[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], lengths)]


def _offsets(lists: pa.ListArray) -> np.ndarray:
    offsets = lists.offsets.to_numpy()
    return offsets - offsets[0]


def _lists(offsets: np.ndarray, values) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limits of Arrow batches to those above; lower ones stay.

    Batches are limited by session settings alone, read when a plan runs. By default they take 10,000 rows, whose
    words' offsets and bytes stand several times over in the JVM and in both Python workers of a task.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def _looked_up(df: DataFrame, tokens: str, found: tuple) -> DataFrame:
    """``df`` without ``tokens`` and with ``__known, __rare``, looked up in ``found`` some rows at a time; see :func:`_look_up`."""
    small_batches(df.sparkSession)
    kept = df.drop(tokens)
    schema = T.StructType([*kept.schema.fields, T.StructField("__known", T.ArrayType(_IDS)), T.StructField("__rare", T.ArrayType(T.StringType()))])
    shared, n = df.sparkSession.sparkContext.broadcast(found), len(kept.columns)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *_look_up(batch.column(n), shared.value)], names=schema.names)
            pa.default_memory_pool().release_unused()

    return df.select(*kept.columns, tokens).mapInArrow(over, schema)


def _look_up(tokens: pa.ListArray, found: tuple) -> tuple[pa.ListArray, pa.ListArray]:
    """Each row's other words in order, and the ids of its known words in one list more than these: up to each of them and after the last."""
    words, starts, lengths, ids = found  # the last run is that of an unknown word, empty
    flat, offsets = tokens.flatten(), _offsets(tokens)
    at = pc.fill_null(pc.index_in(flat, value_set=words), len(words)).to_numpy()
    rare = at == len(words)
    known, ends = _runs(ids, starts[at], lengths[at]), _ends(lengths[at])
    # A list ends where a rare word stands and where its row ends.
    stops = np.concatenate([2 * np.flatnonzero(rare) + 1, 2 * offsets[1:]])
    stops = np.sort(stops, kind="stable") // 2
    lists = _lists(np.concatenate(([0], ends[stops])), pa.array(known, pa.int32()))
    rare_before = _ends(rare)[offsets]
    return _lists(rare_before + np.arange(len(offsets)), lists), _lists(rare_before, flat.filter(pa.array(rare)))


def _concatenated(ids: Column, pieces: Column) -> Column:
    """The pieces of ids, given in hex by id, as one binary."""
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""))


def encode(docs: DataFrame, path: str, pattern: str, head: int = HEAD, longest: int = LONGEST, columns: list[str] | None = None) -> DataFrame:
    """All columns of ``docs``, or ``columns``, ``ids array<int>`` of the whole ``text`` without special tokens, and ``decoded binary`` of the ids.

    Each match of ``pattern`` is encoded separately. The words are counted over all texts. The most frequent, ``head``
    of them at most and none above ``longest`` bytes, are folded once each and broadcast with their ids, at most some
    60 MB whatever the input; texts look their words up there, some rows at a time. Every other word is folded where it
    stands by the same columns, and its ids are put in their place. So the texts are never shuffled. The time for one
    match grows with the square of its length. Null and empty texts have no ids. Repeated rows, null ids and other
    columns stay as they are; columns called ``ids`` and ``decoded`` are replaced. No rows give no rows.
    """
    give = lambda ids, pieces: F.struct(ids.alias("ids"), _concatenated(ids, pieces).alias("decoded"))
    return _encoded(docs, path, pattern, head, longest, columns, give, __pieces=Codec(path, pattern).pieces)


def _encoded(docs: DataFrame, path: str, pattern: str, head: int, longest: int, columns: list[str] | None, give, **lists: list[str]) -> DataFrame:
    """``docs``, or its ``columns``, with the fields that ``give(ids, *lists)`` makes of a row's ids: known words' ids and the other words' folds, put together."""
    codec = Codec(path, pattern)
    words = cut(distinct_words(docs, codec).where(F.octet_length("word") <= longest))  # read twice, counted once
    table = codec.with_ranks(_head(words, head).select("word"), "ids", lambda encode_word: encode_word(F.col("word"))).toArrow()  # at most ``head`` words of ``longest`` bytes
    known, found = table["word"].combine_chunks().cast(pa.string()), table["ids"].combine_chunks()
    lengths = np.append(pc.list_value_length(found).to_numpy(), 0).astype(np.int32)
    found = (known, _ends(lengths)[:-1].astype(np.int32), lengths, found.flatten().to_numpy().astype(np.int32))

    kept = [c for c in columns or docs.columns if c not in ("ids", "decoded")]
    coded = _looked_up(docs.select(*kept, codec.tokens(F.col("text")).alias("__tokens")), "__tokens", found)
    put = lambda encode_word: F.flatten(F.zip_with("__known", F.transform("__rare", encode_word), lambda ids, fold: F.concat(ids, F.coalesce(fold, F.array().cast(_IDS)))))
    coded = codec.with_ranks(coded, "__coded", lambda encode_word, *own: let(put(encode_word), lambda ids: give(ids, *own)), **{k: (v, "array<string>") for k, v in lists.items()})
    return coded.select(*kept, "__coded.*")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """All columns of a table and ``decoded binary``, the bytes of ``ids``; null ids give null."""
    wide = _with_literals(encoded.drop("decoded"), __pieces=(Codec(path, pattern).pieces, "array<string>"))
    return wide.withColumn("decoded", let(F.col("__pieces"), lambda pieces: _concatenated(F.col("ids"), pieces))).drop("__pieces")


def _digested(ids: pa.ListArray, pieces: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The number of ids of each row, the digest of them and that of their pieces, which stand one after the other in memory when taken."""
    offsets = _offsets(ids)
    flat = ids.flatten().to_numpy().astype("<u4")
    _, ends, data = pieces.take(pa.array(flat, pa.int32())).buffers()
    stops, data = np.frombuffer(ends, np.int32)[offsets] if len(flat) else np.zeros(len(offsets), np.int32), memoryview(data or b"")
    sha = lambda whole, bounds: pa.array([hashlib.sha256(whole[a:b]).hexdigest() for a, b in zip(bounds, bounds[1:])], pa.string())
    return pa.array(np.diff(offsets), pa.int64()), sha(flat.data.cast("B") if len(flat) else memoryview(b""), offsets * 4), sha(data, stops)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row of ``docs``; ids as little-endian unsigned 32-bit integers.

    The ids are those of :func:`encode`; they are digested and their pieces put together in Arrow batches, which takes
    less time than a function of Spark's for each id, and neither ids nor bytes have to be kept.
    """
    coded = _encoded(docs.select("doc_id", "text"), path, pattern, HEAD, LONGEST, ["doc_id"], lambda ids: F.struct(ids.alias("ids")))
    shared = docs.sparkSession.sparkContext.broadcast([bytes.fromhex(x) for x in Codec(path, pattern).pieces])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(shared.value, pa.binary())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *_digested(batch.column(1), pieces)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = T.StructType([coded.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return coded.mapInArrow(over, schema)
