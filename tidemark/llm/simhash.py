"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .components import connected_components


def _fingerprint(text: bytes | None, width: int, seed: int) -> int:
    """bytes.split() parts at space and U+0009 to U+000D; bytes.lower() changes A-Z alone."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    if len(tokens) <= width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(tokens), seed)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(b" ".join(tokens[i : i + width]), seed) for i in range(len(tokens) - width + 1)]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):  # bounded memory for very long texts
        block = np.array(hashes[at : at + 65_536], dtype=">u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    value = 0
    for bit in 2 * ones > len(hashes):
        value = value << 1 | int(bit)
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """All columns of ``docs`` and ``__fp long``: the majority bits of the XXH64 of each shingle of ``width`` words."""
    return docs.withColumn("__fp", F.pandas_udf(lambda s: pd.Series([_fingerprint(x, width, seed) for x in s], dtype="int64"), "long")(F.col("text").cast("binary")))


def ball_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """``(u, v)`` links that join all of ``fp long`` within ``radius`` bits of each other.

    Each fingerprint is sent to every variant within half the radius; two within the radius meet at one at least.
    At a variant the fingerprints are sorted, and each is checked against the one before it. For an even radius all
    that meet are within the radius of each other, so this chain joins them all, and no pairs are emitted.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    masks = [sum(1 << b for b in bits) for k in range(radius // 2 + 1) for bits in combinations(range(64), k)]
    signed = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m) for m in masks))
    met = prints.select("fp", F.explode(signed).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    pairs = met.withColumn("before", before).where("before is not null").select(F.col("before").alias("u"), F.col("fp").alias("v")).distinct()
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, fingerprint, component_id``.

    Words are runs of anything but space and U+0009 to U+000D of the text with A-Z in lower case. Fewer words than
    ``width`` are one shingle; no words, empty or null texts have the fingerprint zero, which links like any other.
    component_id is the smallest id reachable by links; rows without an id take part and get the component of the
    others that they link with, or null. Repeated rows come back repeated. Other columns are ignored; no rows give none.
    """
    prints = cut(fingerprints(docs.select("doc_id", "text"), width, seed).select("doc_id", F.col("__fp").alias("fp")))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = connected_components(ball_links(classes.select("fp"), radius))
    grouped = cut(classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    least = cut(grouped.groupBy("component").agg(F.min("first_id").alias("component_id")))
    known = cut(grouped.join(least, "component").select("fp", "component_id"))
    return prints.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: A pair at Jaccard 0.8 misses all 32 bands of 5 minima with a chance of (1 - 0.8 ** 5) ** 32 = 3e-6, however many texts there are.
BANDS, MINIMA = 32, 5
#: Odd multipliers, one for each minimum.
_MIX = np.random.default_rng(64).integers(1 << 62, 1 << 63, BANDS * MINIMA, dtype=np.uint64) | np.uint64(1)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _shingles(text: bytes | None, width: int, seed: int) -> np.ndarray:
    """The sorted XXH64 of the different shingles of a text; none without a word."""
    tokens = (text or b"").lower().split()
    digest = xxhash.xxh64_intdigest
    hashes = {digest(b" ".join(tokens[i : i + width]), seed) for i in range(max(len(tokens) - width, 0) + 1)} if tokens else set()
    return np.sort(np.fromiter(hashes, dtype=np.uint64, count=len(hashes)))


def _bands(shingles: np.ndarray) -> list[int]:
    """One key for each band of minima: two sets have a band's key in common with their Jaccard similarity to the power of ``MINIMA``."""
    if not len(shingles):
        return []
    least = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 4_096):
        x = shingles[at : at + 4_096, None] * _MIX
        x ^= x >> np.uint64(32)
        x *= _GOLDEN
        np.minimum(least, x.min(axis=0), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLDEN
    for minimum in least.reshape(BANDS, MINIMA).T:
        keys = (keys ^ minimum) * _GOLDEN
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64).tolist()


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _similarities(one: np.ndarray, flat: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The exact Jaccard similarity of a set to each of the sets whose members are sorted in ``flat``."""
    lo, hi = np.searchsorted(flat, one, "left"), np.searchsorted(flat, one, "right")
    counts = hi - lo
    at = np.repeat(lo - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    both = np.bincount(owner[at], minlength=len(sizes))
    return both / (len(one) + sizes - both)


def _tile_links(similarity: float):
    """Links between components among the sets of two tiles of a bucket, one for each set and component it reaches.

    Sets of the component with the most rows are only compared with others: each pair of two components has one side
    outside of it.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, components = rows["node"].to_numpy(), rows["component"].to_numpy()
        names, counts = np.unique(components, return_counts=True)
        u, v = [], []
        if len(names) > 1:
            sets = [np.frombuffer(x, dtype=np.uint64) for x in rows["shingles"]]
            sizes = np.array([len(x) for x in sets])
            flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(flat)
            flat, owner = flat[order], owner[order]
            for q in np.flatnonzero(components != names[counts.argmax()]):
                near = np.flatnonzero((_similarities(sets[q], flat, owner, sizes) >= similarity) & (components != components[q]))
                near = near[np.unique(components[near], return_index=True)[1]]
                u += [nodes[q]] * len(near)
                v += nodes[near].tolist()
        return pd.DataFrame({"u": pd.Series(u, dtype="int64"), "v": pd.Series(v, dtype="int64")})

    return run


def ball_buckets(prints: DataFrame, radius: int = 2) -> DataFrame:
    """``(node, key)`` for each ``(node, fp)`` whose fingerprint others share or reach by links of :func:`ball_links`: one key for all that are linked."""
    found = cut(connected_components(ball_links(prints.select("fp").distinct(), radius))).withColumnRenamed("node", "fp")
    return prints.join(found, "fp", "left").select("node", F.xxhash64(F.lit("ball"), F.coalesce("component", "fp")).alias("key")).distinct()


def similar_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, seed: int = 42, radius: int = 2, bands: int = BANDS) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, component_id``, linked from a Jaccard similarity of ``similarity`` of shingles on.

    Texts meet by their SimHash fingerprints, by ball hashing as in :func:`near_duplicates`: all that are linked within
    ``radius`` bits are one bucket. Near copies at ``similarity`` itself may differ in a seventh of the bits, more than a
    ball can hold at any size; for these the sets of shingles also meet in bands of minima (see ``BANDS``). Each link is
    decided by the exact similarity of the two sets. Equal sets are one class. In each bucket all are held against its
    smallest node, and the links are joined to components. Buckets that still hold more than one component are then compared whole:
    n classes are dealt over sqrt(n) / 8 tiles, and each pair of tiles is one task's work that skips what is joined.
    Texts without a word are one group; texts of up to ``width`` words link only if their words are equal. Nulls, ties
    and repeats are as for :func:`near_duplicates`.
    """
    packed = F.pandas_udf(lambda s: pd.Series([_shingles(x, width, seed).tobytes() for x in s], dtype="object"), "binary")
    banded = F.pandas_udf(lambda s: pd.Series([_bands(np.frombuffer(x, dtype=np.uint64))[:bands] for x in s], dtype="object"), "array<bigint>")
    alike = F.pandas_udf(
        lambda a, b: pd.Series([_jaccard(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)) for x, y in zip(a, b)], dtype="float64"), "double"
    )
    marked = fingerprints(docs.select("doc_id", "text"), seed=seed).select("doc_id", F.col("__fp").alias("fp"), packed(F.col("text").cast("binary")).alias("shingles"))
    prints = cut(marked.withColumn("node", F.xxhash64("shingles")).withColumn("keys", banded("shingles")))
    classes = cut(prints.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("keys").alias("keys")))
    balls = ball_buckets(prints.where(F.octet_length("shingles") > 0).select("node", "fp").distinct(), radius)
    members = classes.select("node", F.explode("keys").alias("key")).unionByName(balls)
    crowds = members.groupBy("key").agg(F.min("node").alias("star"), F.count("*").alias("n"), F.bit_xor("node").alias("mark")).where("n > 1")
    crowds = crowds.groupBy("n", "mark", "star").agg(F.min("key").alias("key"))  # bands with the same members are one bucket
    shared = cut(members.join(crowds, "key").select("key", "node", "star", "n"))
    met = cut(shared.select("node").distinct())
    met = F.broadcast(met) if met.count() <= 1_000_000 else met  # so that the sets of all others are not shuffled
    sets = cut(prints.select("node", "shingles").join(met, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles")))
    rays = shared.where("node <> star").select(F.col("star").alias("u"), F.col("node").alias("v")).distinct()
    side = lambda n, s: sets.select(F.col("node").alias(n), F.col("shingles").alias(s))
    edges = cut(rays.join(side("v", "b"), "v").join(side("u", "a"), "u").where(alike("a", "b") >= similarity).select("u", "v"))
    found = cut(connected_components(edges))
    known = shared.where("n > 2").join(found, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("component"))
    split = known.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("key")
    placed = known.join(split, "key").withColumn("tiles", F.ceil(F.sqrt("n") / 8).cast("int"))
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("node", F.lit("tile")), F.col("tiles")).cast("int"))
    dealt = placed.select("key", "node", "component", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    dealt = dealt.select("key", "node", "component", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi")).join(sets, "node")
    more = cut(dealt.groupBy("key", "lo", "hi").applyInPandas(_tile_links(similarity), "u long, v long"))
    joined = found
    if not more.isEmpty():
        joined = connected_components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))
    grouped = cut(classes.select("node", "first_id").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")))
    least = cut(grouped.groupBy("component").agg(F.min("first_id").alias("component_id")))
    known = cut(grouped.join(least, "component").select("node", "component_id"))
    return prints.select("doc_id", "node").join(known, "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their group of :func:`similar_groups`; all columns.

    Rows without an id stay. Of rows with a kept id repeated, all stay.
    """
    groups = similar_groups(docs.select("doc_id", "text"), width, similarity, seed)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
