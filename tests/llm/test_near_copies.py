"""The pipeline's near-dedup stage against the components of all pairs of shingle sets at 0.8 or more."""

import random

from tidemark.llm import simhash


def shingles(text):
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))}


def wanted(rows):
    """The smallest id of each component of the pairs at 0.8 or more; pairs without a shingle in common are skipped."""
    sets, holders, root = {i: shingles(t) for i, t in rows}, {}, {i: i for i, _ in rows}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for j in {j for x in s for j in holders[x] if j < i}:
            both = len(s & sets[j])
            if both / (len(s) + len(sets[j]) - both) >= 0.8:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in sets}


def linked(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(df).collect()}


def fresh(n, rng):
    return [f"w{rng.getrandbits(40):x}" for _ in range(n)]


def changed(words, runs, rng):
    """A copy in which a run of each given length, far from the others, has other words: length + 4 shingles each."""
    out, step = list(words), len(words) // len(runs)
    for k, n in enumerate(runs):
        out[k * step + 5 : k * step + 5 + n] = fresh(n, rng)
    return out


def test_families_of_a_template(spark):
    """150 texts at about 0.7 to each other, of which each two are a pair at about 0.9; no chain between pairs."""
    rng, rows = random.Random(1), []
    template = fresh(250, rng)
    for k in range(75):
        one = template + fresh(50, rng)
        for text in (one, changed(one, [10], rng)):
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    want = wanted(rows)
    assert len(set(want.values())) == 75
    assert linked(spark, rows) == want


def test_recall_among_many_texts(spark):
    """300 pairs just above 0.8 among 6,000 other texts."""
    rng, rows = random.Random(2), []
    for _ in range(300):
        one = fresh(204, rng)
        rows += [(len(rows), " ".join(one)), (len(rows) + 1, " ".join(changed(one, [18], rng)))]
    rows += [(len(rows) + k, " ".join(fresh(60, rng))) for k in range(6_000)]
    want = wanted(rows)
    assert len(set(want.values())) == 6_300
    assert linked(spark, rows) == want


def test_links_are_exact_at_the_threshold(spark):
    """Pairs at 0.8 itself, just below it and at 0.75: 180 shingles, of which 20, 21 and 26 differ."""
    rng, rows = random.Random(3), []
    for n in (16, 17, 22):
        for _ in range(60):
            one = fresh(184, rng)
            rows += [(len(rows), " ".join(one)), (len(rows) + 1, " ".join(changed(one, [n], rng)))]
    want = wanted(rows)
    assert [sum(want[i] != i for i in range(k, k + 120)) for k in (0, 120, 240)] == [60, 0, 0]
    assert linked(spark, rows) == want


def test_fingerprint_balls_alone(spark):
    """Without any band of minima, long texts with one word changed at the end meet by their fingerprints; others do not."""
    rng, rows = random.Random(4), []
    for k in range(40):
        one = fresh(1_500, rng)
        rows += [(2 * k, " ".join(one)), (2 * k + 1, " ".join(one[:-1] + fresh(1, rng)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    linked_by_op8 = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    alone = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(df, bands=0).collect()}
    assert alone == linked_by_op8 and sum(c != i for i, c in alone.items()) > 20
    assert linked(spark, rows) == wanted(rows)
