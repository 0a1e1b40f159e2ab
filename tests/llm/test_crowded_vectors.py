"""Near-duplicate vectors in a crowded label, against all pairs."""

import numpy as np

from tidemark.llm import embeddings


def test_crowded_label(spark):
    """3,000 vectors at about 0.83 to each other, of which 200 have a copy at about 0.94."""
    rng = np.random.default_rng(5)
    centre, noise = np.ones(64), rng.standard_normal((3_000, 64))
    x = centre + 0.45 * noise
    x[200:400] = x[:200] + 0.4 * rng.standard_normal((200, 64))
    x = x.astype(np.float32)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.93
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    while True:
        least = np.minimum(root, np.where(near, root[None, :], len(x)).min(axis=1))
        if (least == root).all():
            break
        root = least
    assert 100 < near.any(axis=1).sum() < 2_500
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df).collect()}
    assert got == {i: (int(near[i].sum()), int(root[i])) for i in range(len(x))}


def recall(spark, x, label, passes):
    """The share of linked vectors that get their right component with no exact check after the passes."""
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))], "vec_id long, embedding array<double>, label int")
    exact, sorted_alone = ({r["vec_id"]: r["component_id"] for r in embeddings.near_duplicates(df, passes=passes, whole=w).collect()} for w in (1 << 30, 0))
    linked = [i for i, c in exact.items() if c != i]
    assert len(linked) > 100 and all(exact[sorted_alone[i]] == exact[i] for i in exact)  # nothing is linked that should not be
    return sum(sorted_alone[i] == exact[i] for i in linked) / len(linked)


def test_recall_of_passes_alone(spark):
    """Spread vectors and a crowd with no exact check: rounds go on till one joins nothing."""
    rng = np.random.default_rng(8)
    spread = rng.standard_normal((1_500, 48))
    spread[1_000:] = spread[:500] + 0.3 * rng.standard_normal((500, 48))
    crowd = np.ones(48) + 0.45 * rng.standard_normal((500, 48))
    crowd[400:] = crowd[:100] + 0.2 * rng.standard_normal((100, 48))
    assert recall(spark, np.concatenate([spread, crowd]), np.repeat([0, 1], [1_500, 500]), 24) >= 0.95


def test_passes_grow_with_the_label(spark):
    """Large labels take more passes; both ways give the same on spread vectors."""
    few, many, most = (embeddings._passes(n, 0.93, 24, 16) for n in (1_000, 1_000_000, 10_000_000))
    assert 24 <= few < many < most
    rng = np.random.default_rng(6)
    x = rng.standard_normal((600, 32))
    x[300:] = x[:300] + 0.2 * rng.standard_normal((300, 32))
    df = spark.createDataFrame([(i, v.tolist(), i % 300 % 2) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    rows = lambda out: sorted(map(tuple, out.collect()))
    assert rows(embeddings.near_duplicates(df, whole=0)) == rows(embeddings.near_duplicates(df))


def test_no_size_ends_the_exact_check(spark):
    """20 pairs in a tight crowd of 66,000, of which a round finds so few that rounds would end: none may be lost."""
    rng = np.random.default_rng(12)
    x = (np.ones(48) + 0.1 * rng.standard_normal((66_000, 48))).astype(np.float32)
    x[20:40] = x[:20] + 0.033 * rng.standard_normal((20, 48)).astype(np.float32)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = {i: int((unit @ unit[i] >= 0.99897).sum()) - 1 for i in range(40)}
    assert sum(want.values()) > 30
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    got = embeddings.near_duplicates(df, threshold=0.99897).where("vec_id < 40")
    assert {r["vec_id"]: r["n_links"] for r in got.collect()} == want
