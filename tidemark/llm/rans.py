"""Token ids in files: static range asymmetric numeral systems in independent interleaved blocks."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_folder

#: Frequencies of a table add up to 2^20; states lie from 2^31 on and give off 32 bits at a time.
SCALE, LOW, WORD_BITS = 20, 31, 32
#: Ids of a block, states that take turns in it, and steps from one checkpoint to the next.
BLOCK, LANES, CHECK = 65_536, 32, 512
#: Blocks that a task codes at a time.
GROUP = 64
_HEAD = struct.Struct("<4sHHIIII")  # magic, version, lanes, ids, words, checkpoints, steps between them
_MAGIC, _VERSION = b"tANS", 1
_DOCS = "array<struct<doc_id: bigint, start: bigint, n: bigint>>"


# Texts to ids

_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ſ", r"!-/:-@\[-`{-~"
#: Stretches that no match of the splitter crosses. Letters, digits and signs that all versions of Unicode know end where
#: something follows that is surely of another class; anything else reaches up to white space, where matches begin and end.
_STRETCH = re.compile(
    rf" ?[{_LETTERS}]++(?![^\x00-\x7F])|'[{_LETTERS}]++(?![^\x00-\x7F])| ?[0-9]++(?![^\x00-\x7F])"
    rf"| ?(?!'[A-Za-z])[{_SIGNS}]++(?![^A-Za-z0-9\x09-\x0D\x20])| ?\S+|\s+(?!\S)|\s+"
)
#: Stretches that are one match of the splitter.
_ONE = re.compile(rf" ?[{_LETTERS}]+| ?[0-9]+| ?[{_SIGNS}]+")
#: Bytes as the library's model spells them: those that print in Latin-1 as they are, all others from U+0100 on.
_SPELLED = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}
#: White space to some regular expression engines only.
_UNSURE = re.compile("[\x1c-\x1f\x85᠎​⁠﻿]")
#: Stretches that a task remembers, the longest of them, and characters taken at a time.
_KNOWN, _LONGEST, _CHARS = 700_000, 256, 1 << 21


class _Places(dict):
    """Numbers of stretches; a new one gets the next number and is noted in ``new``.

    One that is very long, or that engines may cut up differently, gets none and sets ``odd``.
    """

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.odd = False

    def __missing__(self, stretch: str) -> int:
        if len(stretch) > _LONGEST or _UNSURE.search(stretch):
            self.odd = True
            return 0
        self[stretch] = place = len(self)
        self.new.append(stretch)
        return place


class Encoder:
    """The library's ids of whole texts; a stretch of text that comes again is looked up."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.encode_special_tokens = True  # their strings in a text are text
        self._forget()

    def _forget(self) -> None:
        self.places = _Places()
        self.lengths, self.starts, self.flat = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int32)

    def _learn(self) -> None:
        if self.places.new:
            model = self.library.model
            spelled = lambda x: x.replace(" ", chr(_SPELLED[32])) if x.isascii() else x.encode().decode("latin-1").translate(_SPELLED)
            found = [[t.id for t in model.tokenize(spelled(x))] if _ONE.fullmatch(x) else self.library.encode(x, add_special_tokens=False).ids for x in self.places.new]
            self.places.new = []
            self.lengths = np.concatenate((self.lengths, np.fromiter(map(len, found), np.int32, len(found))))
            self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(found), np.int32)))
            self.starts = np.cumsum(self.lengths) - self.lengths

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and how many each has."""
        if len(self.places) > _KNOWN:
            self._forget()
        at, counts, odd = [], [], {}
        for i, text in enumerate(texts):
            found = _STRETCH.findall(text)
            numbers = np.fromiter(map(self.places.__getitem__, found), np.int32, len(found))
            if self.places.odd:
                self.places.odd, numbers = False, numbers[:0]
                odd[i] = np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)
            counts.append(len(numbers))
            at.append(numbers)
        self._learn()
        at = np.concatenate(at) if at else np.empty(0, np.int32)
        lengths = self.lengths[at]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.starts[at] - ends[:-1], lengths)]
        bounds = ends[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))]
        sizes = np.diff(bounds)
        if odd:
            pieces = np.split(ids, bounds[1:-1])
            for i, found in odd.items():
                pieces[i], sizes[i] = found, len(found)
            ids = np.concatenate(pieces)
        return ids, sizes


@lru_cache(maxsize=2)
def _encoder(spec: str) -> Encoder:
    return Encoder(spec)


def _in_turn(texts: list[str]) -> Iterator[list[str]]:
    """Texts in lists of some two million characters, a longer one alone."""
    now, size = [], 0
    for text in texts:
        if now and size + len(text) > _CHARS:
            yield now
            now, size = [], 0
        now.append(text)
        size += len(text)
    if now:
        yield now


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000):
    """Arrow batches of ``rows`` rows at most while plans run inside; texts and blocks are large rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def tokenized(docs: DataFrame, spec: str, end_id: int, wide: bool = False) -> DataFrame:
    """``doc_id, ids binary`` in ascending order of ids over all partitions: the whole text's ids and ``end_id``, 16 bits each or, if ``wide``, 32.

    ``spec`` is the tokenizer's JSON text. Texts are dealt to sorted ranges once. Null ids come first; rows of one id
    are in the order of their texts' hash.
    """
    spark, kind = docs.sparkSession, np.dtype("<u4" if wide else "<u2")
    shared = spark.sparkContext.broadcast(spec)
    ranged = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("__h", F.xxhash64("text")).repartitionByRange("doc_id", "__h").sortWithinPartitions("doc_id", "__h")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(shared.value), kind.type(end_id)
        for batch in batches:
            coded = []
            for texts in _in_turn(batch.column(1).to_pylist()):
                ids, sizes = encode(texts)
                ids = ids.astype(kind)
                for a, n in zip(np.cumsum(sizes) - sizes, sizes):
                    coded.append(np.append(ids[a : a + n], end).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(coded, pa.binary())], names=["doc_id", "ids"])

    with small_batches(spark):
        return cut(ranged.select("doc_id", "text").mapInArrow(over, "doc_id long, ids binary"))


# Frequency tables


def _flat(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of binaries, and how many each row has."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind) if data and len(column) else np.empty(0, kind), np.diff(ends) // kind.itemsize


def id_counts(coded: DataFrame, wide: bool = False) -> DataFrame:
    """``id, n`` over all rows, added up in each task first."""
    kind = np.dtype("<u4" if wide else "<u2")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64)
        for batch in batches:
            now = np.bincount(_flat(batch.column(0), kind)[0])
            if len(now) > len(held):
                held, now = now, held
            held[: len(now)] += now
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(held[found], pa.int64())], names=["id", "n"])

    return coded.select("ids").mapInArrow(over, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def frequencies(counts: dict[int, int]) -> dict[int, int]:
    """Whole frequencies that add up to 2^20, one at least for each id that there is, else in proportion; what is left goes to the commonest."""
    room, whole = (1 << SCALE) - len(counts), sum(counts.values())
    if room < 0:
        raise ValueError(f"more than {1 << SCALE} different ids")
    table = {i: 1 + n * room // whole for i, n in sorted(counts.items())}
    if table:
        most = min(counts, key=lambda i: (-counts[i], i))
        table[most] += (1 << SCALE) - sum(table.values())
    return table


class Coder:
    """Encodes and decodes blocks of ids by one table of frequencies."""

    def __init__(self, table: dict[int, int]):
        ids = np.array(sorted(table), np.int64)
        own = np.array([table[i] for i in ids.tolist()], np.int64)
        size = int(ids[-1]) + 1 if len(ids) else 0
        self.freq, self.cum = np.ones(size, np.uint64), np.zeros(size, np.uint64)
        self.freq[ids], self.cum[ids] = own, np.cumsum(own) - own
        self.slots = np.repeat(ids, own).astype(np.uint32)

    def encode(self, ids: np.ndarray) -> list[bytes]:
        """Blocks of ``BLOCK`` ids, the last one shorter. All blocks advance together, a step of ``LANES`` ids of each at a time, from the end."""
        if not len(ids):
            return []
        blocks = -(-len(ids) // BLOCK)
        sizes = np.full(blocks, BLOCK)
        sizes[-1] = len(ids) - (blocks - 1) * BLOCK
        steps = -(-int(sizes.max()) // LANES)
        padded = np.full(blocks * BLOCK, ids[0], np.int32)
        padded[: len(ids)] = ids
        lanes = np.ascontiguousarray(padded.reshape(blocks, BLOCK // LANES, LANES)[:, :steps].transpose(1, 0, 2)).reshape(steps, -1)
        ends, lane = np.repeat(sizes, LANES), np.tile(np.arange(LANES), blocks)
        even = int(sizes.min()) // LANES  # up to this step all lanes are in use
        state = np.full(blocks * LANES, 1 << LOW, np.uint64)
        given, out, marks = np.empty((steps, blocks * LANES), np.uint32), np.zeros((steps, blocks * LANES), bool), {}
        up, down, full = np.uint64(SCALE), np.uint64(WORD_BITS), np.uint64(LOW - SCALE + WORD_BITS)
        for s in range(steps - 1, -1, -1):
            f = self.freq[lanes[s]]
            gives = state >= f << full
            used = None if s < even else s * LANES + lane < ends
            if used is not None:
                gives &= used
            given[s], out[s] = state, gives  # the low 32 bits
            less = np.where(gives, state >> down, state)
            whole = less // f
            coded = (whole << up) + (less - whole * f) + self.cum[lanes[s]]
            state = coded if used is None else np.where(used, coded, state)
            if s % CHECK == 0:
                marks[s] = state
        found = []
        for b in range(blocks):
            own = slice(b * LANES, (b + 1) * LANES)
            mine, n = out[:, own], int(sizes[b])
            words, before = given[:, own][mine], np.concatenate(([0], np.cumsum(mine.sum(axis=1))))
            starts = range(0, -(-n // LANES), CHECK)
            values = ids[b * BLOCK : b * BLOCK + n].astype("<u4")
            record = [_HEAD.pack(_MAGIC, _VERSION, LANES, n, len(words), len(starts), CHECK)]
            for s in starts:
                record += [struct.pack("<II", before[s], zlib.crc32(values[s * LANES : (s + CHECK) * LANES])), marks[s][own].astype("<u8").tobytes()]
            record.append(words.astype("<u4").tobytes())
            record.append(struct.pack("<I", zlib.crc32(b"".join(record))))
            found.append(b"".join(record))
        return found

    def decode(self, records: list[bytes]) -> list[np.ndarray]:
        """The ids of whole blocks. All stretches between checkpoints of all blocks are decoded together, each from its own states.

        A record that does not match its checksum, or a stretch whose ids do not match theirs, stops the job.
        """
        states, places, counts, sums, words, sizes, base = [], [], [], [], [], [], 0
        for record in records:
            magic, version, lanes, n, n_words, marks, check = _HEAD.unpack_from(record)
            if (magic, version, lanes, check) != (_MAGIC, _VERSION, LANES, CHECK) or zlib.crc32(record[:-4]) != struct.unpack("<I", record[-4:])[0]:
                raise ValueError("a block does not match its checksum or is of another format")
            width, at = 8 + 8 * LANES, _HEAD.size
            for k in range(marks):
                before, crc = struct.unpack_from("<II", record, at + k * width)
                states.append(np.frombuffer(record, "<u8", LANES, at + k * width + 8))
                places.append(base + before)
                counts.append(min(CHECK * LANES, n - k * CHECK * LANES))
                sums.append(crc)
            words.append(np.frombuffer(record, "<u4", n_words, at + marks * width))
            sizes.append(marks)
            base += n_words
        if not records:
            return []
        state, place, left = np.array(states, np.uint64), np.array(places), np.array(counts)
        words = np.concatenate([*words, np.zeros(1, np.uint32)]).astype(np.uint64)
        steps = -(-int(left.max()) // LANES)
        even, lane = int(left.min()) // LANES, np.arange(LANES)
        ids = np.empty((steps, *state.shape), np.uint32)
        up, down, low, mask = np.uint64(SCALE), np.uint64(WORD_BITS), np.uint64(1 << LOW), np.uint64((1 << SCALE) - 1)
        for s in range(steps):
            slot = state & mask
            ids[s] = found = self.slots[slot]
            less = self.freq[found] * (state >> up) + slot - self.cum[found]
            takes = less < low
            if s >= even:
                used = s * LANES + lane < left[:, None]
                takes &= used
                less = np.where(used, less, state)
            number = np.cumsum(takes, axis=1)
            at = np.where(takes, place[:, None] + number - 1, -1)  # the last word is a filler
            state = np.where(takes, less << down | words[at], less)
            place += number[:, -1]
        flat = ids.transpose(1, 0, 2).reshape(len(left), -1)
        stretches = [flat[k, :n] for k, n in enumerate(counts)]
        for stretch, crc in zip(stretches, sums):
            if zlib.crc32(np.ascontiguousarray(stretch).astype("<u4")) != crc:
                raise ValueError("a stretch of ids does not match its checksum")
        ends = np.cumsum(sizes)
        return [np.concatenate(stretches[end - n : end]) for n, end in zip(sizes, ends)]


# Files


def write_ids(coded: DataFrame, folder: str, wide: bool = False) -> None:
    """Write the rows of ``coded(doc_id, ids)``, partition by partition in their order, below ``folder``.

    ``table(id, freq)`` holds the shared frequencies. ``blocks(part, block, start, n, record, docs)`` has a row for each
    block: its place among the part's ids, its bytes, and of each document that it holds ids of the id, the place of the
    first in the part and the number. A record is: magic ``tANS``, version and number of lanes (16 bits each), ids,
    words, checkpoints, steps between them (32 bits each); for each checkpoint the number of words before it, the CRC-32
    of the ids up to the next as 32-bit integers, and all lanes' states (64 bits each); the words (32 bits each); the
    CRC-32 of all before. All numbers are little-endian. Id k of a block belongs to lane k modulo the lanes. Decoding
    may start at any checkpoint.
    """
    spark, kind = coded.sparkSession, np.dtype("<u4" if wide else "<u2")
    with small_batches(spark):
        counts = dict(map(tuple, id_counts(coded, wide).collect()))  # a row for each id of the vocabulary
        table = frequencies(counts)
        spark.createDataFrame(sorted(table.items()), "id long, freq long").coalesce(1).write.parquet(f"{folder}/table")
        shared = spark.sparkContext.broadcast(table)

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            coder, part, block, base = Coder(shared.value), TaskContext.get().partitionId(), 0, 0
            held: list[np.ndarray] = []
            docs: list[tuple[int | None, int, int]] = []
            end = 0

            def flush(all_of_it: bool) -> Iterator[pa.RecordBatch]:
                nonlocal held, docs, block, base
                ids = np.concatenate(held) if held else np.empty(0, kind)
                most = GROUP * BLOCK
                while len(ids) >= most or (all_of_it and len(ids)):
                    now, ids = ids[:most], ids[most:]
                    records, lists, first = coder.encode(now), [], 0
                    starts = [base + b * BLOCK for b in range(len(records))]
                    sizes = [min(BLOCK, len(now) - b * BLOCK) for b in range(len(records))]
                    for a, n in zip(starts, sizes):
                        while docs[first][1] + docs[first][2] <= a:
                            first += 1
                        last = first
                        while last < len(docs) and docs[last][1] < a + n:
                            last += 1
                        lists.append([dict(zip(("doc_id", "start", "n"), d)) for d in docs[first:last]])
                    base += len(now)
                    docs = [d for d in docs[first:] if d[1] + d[2] > base]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * len(records), pa.int32()), pa.array(range(block, block + len(records)), pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int32()), pa.array(records, pa.binary()),
                         pa.array(lists, pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])))],
                        names=["part", "block", "start", "n", "record", "docs"],
                    )
                    block += len(records)
                held = [ids]

            for batch in batches:
                ids, sizes = _flat(batch.column(1), kind)
                for doc_id, n in zip(batch.column(0).to_pylist(), sizes.tolist()):
                    docs.append((doc_id, end, n))
                    end += n
                held.append(ids)
                yield from flush(False)
            yield from flush(True)

        coded.select("doc_id", "ids").mapInArrow(over, f"part int, block int, start long, n int, record binary, docs {_DOCS}").write.option("compression", "none").parquet(f"{folder}/blocks")


def read_ids(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """A row for each document and block that it lies in, from the files alone: ``part, doc_id, start, n, at, size, crc`` and, if wanted, ``ids``.

    ``start`` is the document's place in its part and ``n`` its number of ids; ``at`` is where in it the piece begins,
    ``size`` the piece's ids and ``crc`` their CRC-32 as little-endian 32-bit integers.
    """
    table = {r["id"]: r["freq"] for r in spark.read.parquet(f"{folder}/table").collect()}  # a row for each id of the vocabulary
    shared = spark.sparkContext.broadcast(table)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, GROUP):
                some = batch.slice(k, GROUP)
                out = []
                for part, base, lies, found in zip(some["part"].to_pylist(), some["start"].to_pylist(), some["docs"].to_pylist(), coder.decode(some["record"].to_pylist())):
                    values = found.astype("<u4")
                    for d in lies:
                        a, b = max(d["start"], base), min(d["start"] + d["n"], base + len(values))
                        piece = values[a - base : b - base]
                        out.append((part, d["doc_id"], d["start"], d["n"], a - d["start"], b - a, zlib.crc32(piece), *((piece.tolist(),) if ids else ())))
                columns = list(zip(*out))
                kinds = [pa.int32(), *[pa.int64()] * 6, *((pa.list_(pa.int64()),) if ids else ())]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["part", "doc_id", "start", "n", "at", "size", "crc", *(("ids",) if ids else ())])

    blocks = spark.read.parquet(f"{folder}/blocks").select("part", "start", "record", "docs")
    return blocks.mapInArrow(over, "part int, doc_id long, start long, n long, at long, size long, crc long" + (", ids array<bigint>" if ids else ""))


_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """The product of two polynomials over two elements, modulo that of CRC-32; the top bit is the constant term."""
    product = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            product ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return product


def joined_crc(first: int, second: int, size: int) -> int:
    """The CRC-32 of two stretches of bytes one after the other from those of each; ``size`` bytes are in the second."""
    shift, power, n = 1 << 31, 1 << 30, 8 * size
    while n:
        if n & 1:
            shift = _times(shift, power)
        power, n = _times(power, power), n >> 1
    return _times(shift, first) ^ second


def _one_crc(pieces) -> int:
    whole = 0
    for piece in pieces:
        whole = joined_crc(whole, piece["crc"], 4 * piece["size"])
    return whole


def archived(docs: DataFrame, spec: str, folder: str, end_id: int = 2, wide: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each row of ``docs``, from files written below ``folder`` and read back.

    Null and empty texts are the end id alone. Rows without an id come first, repeated rows come back as often, rows of
    one id in the order of their texts' hash. A document that lies in several blocks gets the checksum of its pieces put
    together; its ids never are. Other columns are ignored. No rows give no rows.
    """
    spark = docs.sparkSession
    write_ids(tokenized(docs, spec, end_id, wide), folder, wide)
    with small_batches(spark, 4 * GROUP):
        pieces = cut(read_ids(spark, folder))
    join_up = F.pandas_udf(lambda s: pd.Series([_one_crc(x) for x in s], dtype="int64"), "long")
    whole = pieces.where("size = n").select("part", "doc_id", "start", "n", "crc")
    cut_up = pieces.where("size < n").groupBy("part", "doc_id", "start", "n").agg(F.array_sort(F.collect_list(F.struct("at", "size", "crc"))).alias("all"))
    every = whole.unionByName(cut_up.select("part", "doc_id", "start", "n", join_up("all").alias("crc")))
    sizes = spark.read.parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("n")).orderBy("part").collect()  # a row for each part, as many as tasks wrote them
    bases = np.concatenate(([0], np.cumsum([n for _, n in sizes], dtype=np.int64)))
    parts = spark.createDataFrame([(part, int(b)) for (part, _), b in zip(sizes, bases)], "part int, base long")
    return every.join(F.broadcast(parts), "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def archive(docs: DataFrame, spec: str, end_id: int = 2) -> DataFrame:
    """:func:`archived` in a new folder below the shared one."""
    return archived(docs, spec, shared_folder(docs, "token-ids"), end_id)
