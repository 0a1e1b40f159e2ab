"""Null ids, repeated rows, clashing names, empty tables and very long words for the operators without tests of their own for these."""

import time

import brute
import numpy as np
import pytest

from tidemark.llm import bpe, common, embeddings, lines, secrets, simhash, urls
from tidemark.llm.queries import vocabulary


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = [float(x) for x in rng.standard_normal(8)]
    near = [x + 0.01 for x in base]
    rows = [(1, base, 0), (1, base, 0), (2, near, 0), (None, base, 0), (None, None, None), (3, base, None), (4, near, 1)]
    df = spark.createDataFrame([(*r, 5, "c", 1, "k") for r in rows], "vec_id long, embedding array<double>, label int, n_links int, component string, node int, kept string")
    same([tuple(r) for r in embeddings.near_duplicates(df).collect()], [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True), (None, 0, None, True), (None, 0, None, True)])
    alone = spark.createDataFrame([(1, None, 0), (2, [], 0)], "vec_id long, embedding array<double>, label int")
    same([tuple(r) for r in embeddings.near_duplicates(alone).collect()], [(1, 0, 1, True), (2, 0, 2, True)])


def test_large_labels_are_found_in_passes(spark):
    """Labels above ``whole`` go through the sorted passes; what they find is what a whole comparison finds."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 24))
    rows = [(int(k), [float(x) for x in base[k % 300] + (0.08 * rng.standard_normal(24) if k >= 300 else 0)], 0) for k in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {tuple(r) for r in embeddings.near_duplicates(df, whole=100).collect()}
    want = brute.embeddings(rows)
    assert len(got & want) >= 0.99 * len(want) and len(got) == len(want)


def test_tokens(spark):
    import tiktoken

    path, pattern = vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    long = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(5_000))
    rows = [(1, "again and again"), (1, "again and again"), (None, "again"), (None, None), (2, ""), (3, long), (4, f"x {long} 字字字" * 2)]
    df = spark.createDataFrame([(*r, "c", b"d", 1) for r in rows], "doc_id long, text string, ids string, decoded binary, n_tokens int")
    began = time.perf_counter()
    out = bpe.encode(df, path, pattern).collect()
    same([(r["doc_id"], r["text"], r["ids"], bytes(r["decoded"])) for r in out], [(i, t, enc.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows])
    assert time.perf_counter() - began < 240 and bpe.encode(df.limit(0), path, pattern).count() == 0


def test_secrets_by_both_ways_and_without_rows(spark):
    texts = ["token = abcdef1", "xoxb-1234567890-abc", None, "", "no secret here", "ghp_" + "aB3" * 13, "ghx_" + "aB3" * 13, "K" * 100_000 + " api_key:'0123456789abcdef0123456789'", "passwd= secret: 'x1y2z3'", "AIza" + "x" * 40 + " eyJh.eyJz.c"]
    rows = [(i, t, "c", 1) for i, t in enumerate(texts)] + [(0, texts[0], "c", 1), (None, texts[1], "c", 1), (None, texts[1], "c", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kinds string, found int")
    want = [(i, *brute.secrets(t)) for i, t, *_ in rows]
    same([tuple(r) for r in secrets.digest(df).collect()], want)
    spans = lambda found: [(r["doc_id"], [tuple(s) for s in r["found"]]) for r in found.collect()]
    same(spans(secrets.scan(df, broadcast_rows=0)), spans(secrets.scan(df)))
    assert secrets.digest(df.limit(0)).count() == 0
    assert secrets.trigram_query("ab(cd)+ef") == [frozenset({"abc", "bcd", "cde", "def"})] and secrets.trigram_query("abc|d?") == [frozenset()] and secrets.trigram_query("[xyz]bc") == [frozenset({c + "bc"}) for c in "xyz"]
    assert secrets.trigram_query(r"a\.bc\x20d[^x]efg(?:hi){0,2}jkl") == [frozenset({"a.b", ".bc", "bc ", "c d", "efg", "jkl"})]


def test_lines(spark):
    run = "\n".join(" ".join(f"r{k}w{j}" for j in range(13)) for k in range(5))
    rows = [(1, run), (1, run), (None, run), (None, None), (3, ""), (2, f"own\n\n{run}\nown tail"), (4, "x\n" * 20_000 + run)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, n_deleted int, gone string")
    got = [(r["doc_id"], (r["text"] or "")[:12], r["n_deleted"]) for r in lines.dedup_lines(df).collect()]
    # 50 of the 20,000 equal lines are the first run of 50 words; all later ones repeat it.
    same(got, [(1, run[:12], 0), (1, run[:12], 0), (None, "", 5), (None, "", 0), (3, "", 0), (2, "own\n\nown tai", 5), (4, "x\n" * 6, 19_950 + 5)])
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_fingerprints_and_urls(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, None), (7, ""), (8, " ")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, component_id string, fp int")
    got = [tuple(r) for r in simhash.near_duplicates(df).collect()]
    same([(i, c) for i, _, c in got], [(5, 5), (5, 5), (None, 5), (None, 7), (7, 7), (8, 7)])
    pages = spark.createDataFrame([(None, "http://a.com/en/", "x", "y"), (1, None, "x", "y"), (1, None, "x", "y")], "page_id long, url string, host string, verdict string")
    same([tuple(r) for r in urls.judge(pages, urls.rule_table(spark)).collect()], [(None, "a.com", "/en/", "com/en/", "block"), (1, "", "", None, "allow"), (1, "", "", None, "allow")])
    assert urls.judge(pages, urls.rule_table(spark).limit(0)).where("verdict = 'allow'").count() == 3


def test_a_cluster_has_to_name_its_checkpoint_folder():
    class Conf:
        def get(self, _):
            return None

    class Context:
        master = "spark://host:7077"
        getConf = lambda self: Conf()
        getCheckpointDir = lambda self: None

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common._checkpoint_folder(Context())
