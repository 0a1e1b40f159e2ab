"""Each stage of the pipeline on its predecessor's rows, against brute force."""

import os
from collections import Counter

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_source_mixing import plain

from tidemark.llm import bpe, lines
from tidemark.llm.queries import vocabulary

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages(spark, tmp_path):
    import tiktoken

    docs, seen = spark.read.parquet(f"{DATA}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns or k == len(corpus_pipeline.STAGES) - 1
    raw, clean, lined, unique, mixed = seen
    marked = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r["doc_id"] in raw}
    assert {i for i, t in marked.items() if not t} <= set(clean) <= set(raw)  # documents marked clean stay
    toxic = {i for i, t in marked.items() if t}
    assert toxic and len(toxic & set(clean)) <= 0.4 * len(toxic) and all(clean[i] == raw[i] for i in clean)
    gone = brute.deleted_lines(sorted(clean.items()))
    want = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in clean.items()}
    assert lined == {i: t for i, t in want.items() if brute.words(t) or t == clean[i]}
    shingles = {i: {tuple(brute.words(t.lower())[k : k + 5]) for k in range(max(len(brute.words(t)) - 4, 1))} for i, t in lined.items()}
    near = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    assert set(unique) <= set(lined)
    assert all(any(near(i, j) >= 0.8 for j in lined if j < i) for i in set(lined) - set(unique))
    assert not any(near(i, j) >= 0.8 for i in unique for j in unique if j < i)
    assert set(mixed) <= set(unique) and all(mixed[i] == unique[i] for i in mixed)
    sources = {r["doc_id"]: r["source"] for r in spark.read.parquet(str(tmp_path / "simhash_near_dedup")).collect()}
    copies = Counter(r["doc_id"] for r in docs.collect())
    taken, _ = plain([(i, t, sources[i]) for i, t in unique.items()], 64)
    for i, size, _, words, _ in taken:
        assert copies[i] <= 2 and abs(copies[i] * size - words) <= size
        assert copies[i] == 2 or words < 1.5 * size or not size
    path, pattern = vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    for r in docs.collect():
        assert r["decoded"] == mixed[r["doc_id"]] and list(r["ids"]) == enc.encode_ordinary(r["decoded"]) and r["n_tokens"] == len(r["ids"])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_run(spark, tmp_path):
    """All stages in one go, none written out between, give the rows of the stages one by one."""
    whole = corpus_pipeline.run(spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    rows = lambda df: sorted(map(repr, df.collect()))
    assert whole.columns == docs.columns and rows(whole) == rows(docs) and docs.count() > 200


def test_a_function_of_python_over_cleaned_texts(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    docs = spark.createDataFrame([(1, passage), (2, "own\n" + passage), (3, None)], "doc_id long, text string")
    size = F.pandas_udf(lambda s: s.fillna("").str.len(), "long")
    assert sorted(r[0] for r in lines.dedup_lines(docs).select(size("text")).collect()) == [0, 3, len(passage)]


EXTRA = "n_deleted long, ids string, decoded string, component_id long, score double, raw string, features string, size long, slot long, copy long, taken long, kinds string, doc struct<x: int>"


def test_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, ties, clashing names and empty tables."""
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
    more = (1, "a", "b", 2, 0.5, "c", "d", 3, 4, 5, 6, "e", (7,))
    none = (None,) * len(more)
    long = " ".join(f"w{k}" for k in range(60_000))
    prose = " ".join(f"p{k}" for k in range(90))
    rows = [(1, prose, "en", "s", 1, *more), (1, prose, "en", "s", 1, *more), (2, prose + " x", None, None, None, *none), (3, None, None, None, None, *none), (4, "", "en", "s", 0, *more), (5, " \n\t", "en", "s", 3, *more), (6, long, "en", "t", 9, *more)]
    rows += [(None, "no id but words " * 5, "en", "s", 1, *more), (None, None, None, None, None, *none), (7, "a\n" * 3000 + prose, "en", "t", 1, *more), (8, "one", "en", "t", 1, *more), (9, "ab" * 2_000, "en", "t", 1, *more)]
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(1, 0, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = {"toxicity": 12, "line_dedup": 12, "simhash_near_dedup": None, "mixing": None, "byte_bpe": None}
    for table, empty in ((docs, False), (docs.limit(0), True)):
        for name, stage in corpus_pipeline.STAGES:
            before = table
            stage(spark, table, str(tmp_path)).write.mode("overwrite").parquet(str(tmp_path / f"{name}{empty}"))
            table = spark.read.parquet(str(tmp_path / f"{name}{empty}"))
            assert name == "byte_bpe" or table.columns == before.columns
            assert table.count() == 0 if empty else table.count() == (kept[name] or table.count()) > 0
        if not empty:
            unique = spark.read.parquet(str(tmp_path / "simhash_near_dedupFalse")).collect()
            ids = sorted(r["doc_id"] for r in unique if r["doc_id"] is not None)
            assert ids == [1, 1, 3, 6, 7, 8, 9] and sum(r["doc_id"] is None for r in unique) == 2  # 2 is near 1; 4 and 5 are like 3
            texts = {r["doc_id"]: r["text"] for r in unique}
            coded = table.collect()
            assert all(r["decoded"] == texts[r["doc_id"]] for r in coded if r["doc_id"] is not None) and {r["doc_id"] for r in coded} >= {1, 6}
