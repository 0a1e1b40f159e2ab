"""The mix against a plain version of the schedule: slots decide how much each source gives."""

import hashlib
import random

import brute

from tidemark.llm import mixing

RNG = random.Random(5)
SCHEMA = "doc_id long, text string, source string, taken long, slot string"
ROWS = [(i, " ".join("w" for _ in range(RNG.choice([0, 1, 7, 40, 300]))), RNG.choice(["a", "b", "é", None, "字"]), 1, "x") for i in range(120)]
ROWS += [(500, None, "a", 1, "x"), (501, "", None, 1, "x"), (None, "no id " * 9, "b", 1, "x"), (None, "no id " * 9, "b", 1, "x"), (7, ROWS[7][1], ROWS[7][2], 1, "x"), (502, "long " * 30_000, "long", 1, "x"), (503, None, "nothing", 1, "x")]


def plain(rows, block):
    """(doc_id, size, target, taken, first slot, slots) by walking through the slots one after the other"""
    sizes, streams = {}, {}
    for i, t, s, *_ in rows:
        n = len(brute.words(t))
        sizes[s] = sizes.get(s, 0) + n
        streams.setdefault(s, []).append((hashlib.md5(f"mix:{'' if i is None else i}:{n}".encode()).hexdigest(), i, n))
    goal = brute.targets(sizes)
    order = [s for s in sorted((s for s in sizes if s is not None), key=str.encode) + [None] * (None in sizes) if round(goal[s])]
    whole, edge, stretches = sum(round(goal[s]) for s in order), 0, []
    for s in order:
        stretches.append((s, edge / whole * 2**31 // 1, (edge := edge + round(goal[s])) / whole * 2**31 // 1))
    words = {s: [k for _ in range(2) for k, (_, _, n) in enumerate(sorted(streams[s])) for _ in range(n)] for s in order}
    at, found = dict.fromkeys(order, 0), {}
    for slot in range(-(-whole // block)):
        source = next(s for s, low, high in stretches if low <= slot * 1_327_217_885 % 2**31 < high)
        part = words[source][at[source] : at[source] + block]
        for k in part:
            found.setdefault((source, k), []).append(slot)
        at[source] += len(part)
    out = []
    for s, docs in streams.items():
        for k, (_, i, n) in enumerate(sorted(docs)):
            slots = found.get((s, k), [])
            out.append((i, n, round(goal[s], 6), len(slots), min(slots, default=None)))
    return sorted(out, key=repr), goal


def test_slots_decide(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    seen = []
    for block in (16, 64):
        full, fragments = mixing.mix(df, block=block)
        rows = full.collect()
        want, goal = plain(ROWS, block)
        assert sorted(((r["doc_id"], r["size"], round(r["target"], 6), r["taken"], r["first_slot"]) for r in rows), key=repr) == want
        assert all(r["taken"] <= 2 * r["size"] for r in rows) and sum(r["n_slots"] for r in rows) == fragments.count()
        for s, words in goal.items():
            assert abs(sum(r["taken"] for r in rows if r["source"] == s) - words) <= 4 * block
        seen.append(sorted((repr(r["doc_id"]), r["taken"]) for r in rows))
    assert seen[0] != seen[1]  # the schedule shows in the result
    again, _ = mixing.mix(df.repartition(5), block=64)
    assert sorted((repr(r["doc_id"]), r["taken"]) for r in again.collect()) == seen[1]


def test_a_stretch_of_slots_has_all_sources_in_their_shares(spark):
    df = spark.createDataFrame([(i, "w " * 640, "abc"[i % 3], 1, "x") for i in range(90)], SCHEMA)
    full, fragments = mixing.mix(df)
    of_slot = {r["slot"]: r["source"] for r in fragments.collect()}
    slots = sorted(of_slot)
    assert slots == list(range(len(slots)))
    goal = {r["source"]: r["target"] for r in full.collect()}
    for begin in range(0, len(slots) - 100, 50):
        part = [of_slot[s] for s in range(begin, begin + 100)]
        assert all(abs(part.count(s) - 100 * goal[s] / sum(goal.values())) <= 3 for s in goal)


def test_documents_in_slot_order(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    mixed = mixing.mixed_documents(df)
    rows = [(r["doc_id"], r["text"]) for r in mixed.collect()]
    assert mixed.columns == df.columns
    copies = {k: rows.count(k) for k in set(rows)}
    originals = [(i, t) for i, t, *_ in ROWS]
    full, fragments = mixing.mix(df)
    assert all(n <= 2 * originals.count(k) and brute.words(k[1]) for k, n in copies.items())
    for r in full.collect():
        text = next(t for i, t in originals if i == r["doc_id"])
        if originals.count((r["doc_id"], text)) == 1 and r["size"]:
            assert abs(copies.get((r["doc_id"], text), 0) * r["size"] - r["taken"]) <= r["size"]
    assert mixed.limit(0).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0 and mixing.mix(df.limit(0))[0].count() == 0
