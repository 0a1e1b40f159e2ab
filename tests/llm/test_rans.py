"""Token ids: the library's own, exact round trips through blocks, and files that are read back."""

import os
import random
import struct
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from tidemark.llm import rans

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spec():
    import public_tokenizers

    return Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")


@pytest.fixture(scope="module")
def library(spec):
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(spec)
    own.encode_special_tokens = True
    return own


def plain(rows, library):
    """rows: (doc_id, text), of different ids; the query's rows"""
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_texts_to_ids(spec, library, monkeypatch):
    rng = random.Random(11)
    alphabet = [*"ab'sdmZ1 9 \n\t\r\x0b\x0c.,!éßªµ×字ж́٠ 　  \x00\x1b\x7f", "'ll", " 's", "  ", "\n\n", "<|endoftext|>", "\x1c", "\x85", "﻿", "​", "😀"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(6_000)] + ["x" * 1_000 + " y", "", "字" * 3_000]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for known in (700_000, 50):
        monkeypatch.setattr(rans, "_KNOWN", known)
        encode, got = rans.Encoder(spec), []
        for some in rans._in_turn(texts * 2):
            ids, sizes = encode(some)
            got += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
        assert got == want * 2


def test_blocks():
    rng = np.random.default_rng(11)
    ids = np.minimum(rng.geometric(0.01, 300_000) - 1, 3_000)
    ids[[5, 77_777]] = 65_535
    table = rans.frequencies(Counter(ids.tolist()))
    assert sum(table.values()) == 1 << 20 and min(table.values()) >= 1
    coder = rans.Coder(table)
    for n in (0, 1, 31, 32, 33, 16_384, 65_535, 65_536, 65_537, 300_000):
        records = coder.encode(ids[:n])
        assert len(records) == -(-n // rans.BLOCK)
        assert np.array_equal(np.concatenate([np.empty(0, np.uint32), *coder.decode(records)]), ids[:n])
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    assert sum(map(len, records)) < 1.06 * len(ids) * -(share * np.log2(share)).sum() / 8 + 100
    one = rans.Coder(rans.frequencies({7: 9}))
    assert one.decode(one.encode(np.full(70_000, 7)))[1].tolist() == [7] * (70_000 - rans.BLOCK)
    broken = bytearray(records[0])
    broken[5_000] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        coder.decode([bytes(broken)])


def test_checksums_of_stretches():
    rng = random.Random(3)
    for _ in range(50):
        a, b = rng.randbytes(rng.randrange(400)), rng.randbytes(rng.randrange(400))
        assert rans.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_documents(spark, spec, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = sorted(map(tuple, rans.archive(docs, spec).collect()))
    assert got == plain([tuple(r) for r in docs.select("doc_id", "text").collect()], library)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_odd_rows(spark, spec, library, tmp_path):
    """Nulls, empty and very long texts over several blocks, repeated rows, clashing names, shuffled input and no rows."""
    rng = random.Random(4)
    long = " ".join(rng.choice(["ab", "word", "x9", "é,"]) for _ in range(150_000))
    rows = [(None, "no id"), (1, None), (2, ""), (3, "x" * 9_000), (5, long), (4, "<|endoftext|> it's #2"), *((k, f"text {k} " * (k % 50)) for k in range(10, 400))]
    rng.shuffle(rows)
    schema = "doc_id long, text string, start string, part long, n int"
    docs = spark.createDataFrame([(*r, "s", 1, 2) for r in rows], schema).repartition(3)
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(map(tuple, rans.archived(docs, spec, str(tmp_path / "a")).collect()), key=key) == plain(rows, library)
    ids = {}
    for r in rans.read_ids(spark, str(tmp_path / "a"), ids=True).orderBy("at").collect():
        ids.setdefault(r["doc_id"], []).extend(r["ids"])
    assert ids == {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    assert rans.archive(docs.limit(0), spec).count() == 0
    again = spark.createDataFrame([(7, "same"), (7, "same"), (7, "other one"), (8, None)], "doc_id long, text string")
    found = sorted(map(tuple, rans.archive(again, spec).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == [7, 7, 7, 8] and Counter(r[2:] for r in found) == Counter(r[2:] for r in plain([(7, "same")] * 2 + [(7, "other one"), (8, "")], library))
    assert all(b[1] == a[1] + a[2] for a, b in zip(found, found[1:])) and found[0][1] == 0
    assert sorted(map(tuple, rans.archived(docs, spec, str(tmp_path / "w"), wide=True).collect()), key=key) == plain(rows, library)
