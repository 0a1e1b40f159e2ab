"""The draw against a plain one: scores, ties, repeated rows, and merges over many runs and pieces."""

import os
import random

import brute
import pytest
from pyspark.sql import functions as F

from tidemark.llm import resampling

DATA = "/root/testdata/sf0.01"


def rows(found):
    return sorted(map(tuple, found), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_documents_towards_the_benchmark(spark):
    docs, target = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    want = brute.resampled([tuple(r) for r in docs.select("doc_id", "text").collect()], [r[0] for r in target.select("text").collect()])
    assert rows(resampling.resample(docs, target).collect()) == rows(want) and sum(r[-1] is not None for r in want) > 200


def test_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, other scripts, clashing names, an empty target and no rows."""
    rng = random.Random(12)
    prose = lambda n: " ".join(rng.choice(["Ab", "ba", "é字", "x1", "don't", "Ça"]) for _ in range(n))
    odd = [(None, None), (None, prose(30)), (1, ""), (2, " \x00\n!?"), (3, prose(19)), (4, prose(20)), (5, prose(60_000)), (6, "one")]
    odd += [(7, "same words " * 15)] * 9 + [(10 + k, prose(25)) for k in range(50)]
    docs = spark.createDataFrame([(i, t, 1, 2.0, "r") for i, t in odd], "doc_id long, text string, rank int, score double, eligible string").repartition(3)
    target = spark.createDataFrame([(1, "Ab ba"), (2, None)], "item_id long, text string")
    for some, aim in ((docs, target), (docs, target.limit(0)), (docs.limit(0), target), (docs.where("doc_id < 4"), target)):
        want = brute.resampled([tuple(r) for r in some.select("doc_id", "text").collect()], [r[0] for r in aim.select("text").collect()])
        assert rows(resampling.resample(some, aim).collect()) == rows(want)


@pytest.mark.parametrize("spread", [100_000, 3])
def test_many_pieces(spark, monkeypatch, spread):
    """Runs of many partitions, pieces of a few rows, scores that alone fill pieces, and one row a third of all."""
    monkeypatch.setattr(resampling, "PIECE", 64)
    monkeypatch.setattr(resampling, "PIECES", 32)
    made = spark.range(9_000, numPartitions=7).select(
        F.when(F.col("id") % 3 == 0, 42).when(F.col("id") % 101 == 0, None).otherwise(F.col("id")).alias("doc_id"),
        F.lit(5).cast("long").alias("n_features"), F.lit(0).cast("long").alias("weight"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.pmod(F.xxhash64("id"), F.lit(spread))).cast("long").alias("score"), (F.col("id") % 5 > 0).alias("eligible"),
    )
    found = resampling.draw(made, 40).collect()
    some = [tuple(r) for r in made.collect()]
    order = sorted((r for r in some if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    draws = 40 * len(order) // 100
    want = [(*r[:4], k + 1 if k < draws else None) for k, r in enumerate(order)] + [(*r[:4], None) for r in some if not r[4]]
    assert rows(found) == rows(want)


def test_tournament():
    rng = random.Random(1)
    for k in (1, 2, 3, 5, 8, 13):
        runs = [sorted((rng.randrange(9), i, j) for j in range(rng.randrange(0, 7))) for i in range(k)]
        places = {key: n for n, key in enumerate(x for r in runs for x in r)}
        merged = list(resampling._tournament([iter([(key, places[key]) for key in r]) for r in runs]))
        assert merged == [places[key] for key in sorted(places)]
