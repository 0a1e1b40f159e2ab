"""Near-duplicate vectors by sorted projection passes, and an exact check of all that they may have missed."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut
from .components import connected_components

BITS = 60
TILE = 2_048
#: Rows of the largest tile: a pair of them is what a task holds at a time, whatever the size of the label.
_MOST = 16_384
#: Rows of a tile that are held against the other tile at a time.
_STRIP = 512
MISS = 1e-4
_EDGES = "u long, v long"


@lru_cache(maxsize=4)
def _planes(round_no: int, passes: int, dim: int) -> np.ndarray:
    """(dim, passes * BITS) normal vectors of a round; the same for each run and task."""
    return np.random.default_rng([20_011 + dim, round_no]).standard_normal((dim, passes * BITS))


def _unit(packed, kind) -> np.ndarray:
    x = np.frombuffer(b"".join(packed), dtype=kind).astype(np.float64).reshape(len(packed), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _passes(rows: int, threshold: float, least: int, window: int) -> int:
    """Passes after which a pair at ``threshold`` among ``rows`` evenly spread ones is missed with a chance of ``MISS`` at most.

    A pair falls within the window where its hashes agree in the first log2(rows / window) bits.
    """
    agree = 1 - math.acos(min(max(threshold, -1.0), 1.0)) / math.pi
    met = agree ** max(math.log2(max(rows, 1) / window), 1.0)
    return max(least, math.ceil(math.log(MISS) / math.log1p(-met))) if met < 1 else least


def _hashed(kind, round_no: int):
    weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)

    def run(batches):
        for rows in batches:
            for (dim, passes), same in rows.groupby(["dim", "passes"]):
                unit, planes = _unit(list(same["vector"]), kind), _planes(round_no, int(passes), int(dim))
                for p in range(int(passes)):
                    key = (unit @ planes[:, p * BITS : (p + 1) * BITS] > 0) @ weights
                    yield same.assign(pass_no=np.int32(p), key=key)[["pass_no", "label", "dim", "key", "cid", "joined", "vector"]]

    return run


def _neighbours(window: int, threshold: float, kind):
    """Links that join new sets among the rows of one sorted slice, each row held against the next ``window``; rows that are ``joined`` already are left out."""

    def run(batches):
        tail = None
        for rows in batches:
            if tail is not None:
                rows = pd.concat([tail, rows], ignore_index=True)
            tail = rows.iloc[-window:]
            found = []
            for _, same in rows.groupby(["pass_no", "label", "dim"], sort=False):
                unit, ids, joined = _unit(list(same["vector"]), kind), same["cid"].to_numpy(), same["joined"].to_numpy()
                if len(ids) < 2:
                    continue
                other = joined[:-1] != joined[1:]
                link = other & ((unit[:-1] * unit[1:]).sum(axis=1) >= threshold)
                found.append((ids[:-1][link], ids[1:][link]))
                run_no = np.concatenate([[0], np.cumsum(other & ~link)])  # rows of one run are joined by now
                for k in range(2, min(window, len(ids) - 1) + 1):
                    new = np.flatnonzero((run_no[:-k] != run_no[k:]) & (joined[:-k] != joined[k:]) & ((unit[:-k] * unit[k:]).sum(axis=1) >= threshold))
                    if len(new):
                        _, first = np.unique(np.stack([run_no[new], run_no[new + k]]), axis=1, return_index=True)
                        found.append((ids[new[first]], ids[new[first] + k]))
            if found:
                u, v = (np.concatenate(x) for x in zip(*found))
                yield pd.DataFrame({"u": u, "v": v})

    return run


def _join(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``root``, which gives each place the smallest one it is joined with, after the links ``u, v`` are added."""
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            least = root[root]
            if (least == root).all():
                break
            root = least


def _tile_edges(threshold: float, kind):
    """Links that join the vectors of two tiles of one label: each one's link to the smallest it reaches in these tiles."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        lo, hi = rows["lo"].iloc[0], rows["hi"].iloc[0]
        a, b = rows[rows["tile"] == lo], rows[rows["tile"] == hi]
        if not len(a) or not len(b):
            return pd.DataFrame({"u": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64")})
        left, right = _unit(list(a["vector"]), kind), _unit(list(b["vector"]), kind)
        names, place = np.unique(np.concatenate([a["cid"].to_numpy(), b["cid"].to_numpy()]), return_inverse=True)
        root = np.arange(len(names))
        for at in range(0, len(a), _STRIP):  # a strip of the matrix at a time, however large the tile
            i, j = np.nonzero(left[at : at + _STRIP] @ right.T >= threshold)
            root = _join(root, place[at + i], place[len(a) + j])
        moved = np.flatnonzero(root != np.arange(len(names)))
        return pd.DataFrame({"u": names[moved], "v": names[root[moved]]})

    return run


def _tile_links(threshold: float, kind):
    """For each vector of two tiles of one component, how many ids its linked classes hold."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        lo, hi = rows["lo"].iloc[0], rows["hi"].iloc[0]
        a, b = rows[rows["tile"] == lo], rows[rows["tile"] == hi]
        if not len(a) or not len(b):
            return pd.DataFrame({"cid": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64")})
        left, right, n_left, n_right = _unit(list(a["vector"]), kind), _unit(list(b["vector"]), kind), a["n"].to_numpy(), b["n"].to_numpy()
        of_left, of_right = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        for at in range(0, len(a), _STRIP):  # a strip of the matrix at a time, however large the tile
            near = left[at : at + _STRIP] @ right.T >= threshold
            if lo == hi:
                near[np.arange(len(near)), at + np.arange(len(near))] = False
            of_left[at : at + _STRIP] = near @ n_right
            of_right += n_left[at : at + _STRIP] @ near
        if lo == hi:
            return pd.DataFrame({"cid": a["cid"], "links": of_left})
        return pd.DataFrame({"cid": [*a["cid"], *b["cid"]], "links": [*of_left, *of_right]})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, passes: int = 24, window: int = 16, whole: int | None = None) -> DataFrame:
    """One row for each vector: ``vec_id, n_links, component_id, kept``.

    Vectors are compared only within one label. Equal vectors are one class from the start. A link is what reaches
    ``threshold`` by cosine in double precision. Classes are sorted in ``passes`` or more passes by label and by 60
    concatenated random sign hashes, range-partitioned, and each is held against the next ``window`` rows; the passes
    grow with the label (see :func:`_passes`). Rows at the edge of a range partition meet in other passes. All links are
    joined to components. Then what the passes may have missed is looked for in every label, however large: its n
    classes are dealt over n / max(2,048, 8 sqrt(n)) tiles of at most some 16,384 rows and compared whole, in pairs of
    tiles, each pair one group's matrix product, a strip at a time. So the links found do not depend on a label's size.
    That is n^2 work; a task holds two tiles.

    A caller who can do with the passes alone names in ``whole`` the classes of the largest label to compare whole:
    larger ones are sorted in further rounds by new hashes, each of twice the passes of the one before, rows joined
    already left out, till a round joins no more than ``MISS`` of the classes.

    A window is bounded, so a component's links are counted whole at last: its m classes are dealt over sqrt(m) / 2
    tiles, each pair of tiles is one group's matrix product that gives only sums, and the pairs are dealt over all
    tasks. That is m^2 work and m^1.5 / 2 rows shuffled for a component.

    Null, empty and zero vectors, vectors with null or non-finite components and vectors without a label link with
    nothing: n_links 0, their own component. Rows without an id come back with no component and link with nothing.
    Equal ids with equal vectors are one row; equal ids with different vectors are two. Other columns are ignored.
    No rows give no rows.
    """
    element = vectors.schema["embedding"].dataType.elementType
    kind, tag = (np.float32, "float") if isinstance(element, T.FloatType) else (np.float64, "double")
    rows = vectors.select("vec_id", F.col("label").alias("label"), F.col("embedding").cast(f"array<{tag}>").alias("e"))
    sound = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    rows = rows.select(
        "vec_id", F.col("label").cast("string").alias("label"), "e",
        F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("e") > 0) & sound, F.lit(False)).alias("ok"),
    ).withColumns({"d1": F.xxhash64(F.lit(1), "label", "e"), "d2": F.xxhash64(F.lit(2), "label", "e")})
    pack = F.pandas_udf(lambda s: s.map(lambda x: np.asarray(x, dtype=kind).tobytes()), "binary")
    classes = cut(
        rows.where("ok").groupBy("d1", "d2").agg(F.min("vec_id").alias("cid"), F.count_distinct("vec_id").alias("n"), F.first("label").alias("label"), F.first("e").alias("e"))
        .select("d1", "d2", "cid", "n", "label", F.size("e").alias("dim"), pack("e").alias("vector"))
    )
    # A node is a class: one vector id may stand in two of them.
    spark = vectors.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    classes = classes.withColumn("node", F.xxhash64("d1", "d2"))
    labels = cut(classes.groupBy("label", "dim").agg(F.count("*").alias("rows")))
    sized = classes.select("label", "dim", F.col("node").alias("cid"), "vector").join(labels, ["label", "dim"])
    exact = F.lit(True) if whole is None else F.col("rows") <= whole
    tiled = sized.where(exact).withColumn("tiles", F.ceil(F.col("rows") / F.least(F.greatest(F.lit(TILE), 8 * F.sqrt("rows")), F.lit(_MOST))).cast("int"))
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("cid", F.lit("label")), F.col("tiles")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "label", "dim", "cid", "vector", "tile", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi")
    )
    # The rows are partitioned by label or component already, which would do for the groups: deal the tiles out anew.
    edges = tiled.repartition("label", "dim", "lo", "hi").groupBy("label", "dim", "lo", "hi").applyInPandas(_tile_edges(threshold, kind), _EDGES)
    counts = F.udf(lambda n: _passes(n, threshold, passes, window), "int")
    planned = cut(labels.select("label", "dim", "rows", counts("rows").alias("passes")))
    large = planned.where(~exact)

    def links(some: DataFrame, round_no: int, known: DataFrame | None) -> DataFrame:
        """The new links of one round over the labels ``some``."""
        rows = sized.drop("rows").join(some.select("label", "dim", (F.col("passes") * (1 << max(round_no - 1, 0))).alias("passes")), ["label", "dim"])
        rows = rows.withColumn("joined", F.col("cid")) if known is None else rows.join(known.select(F.col("node").alias("cid"), "component"), "cid", "left").withColumn("joined", F.coalesce("component", "cid"))
        hashed = rows.select("label", "dim", "cid", "joined", "vector", "passes").mapInPandas(_hashed(kind, round_no), "pass_no int, label string, dim int, key long, cid long, joined long, vector binary")
        order = ["pass_no", "label", "dim", "key", "cid"]
        return hashed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInPandas(_neighbours(window, threshold, kind), _EDGES)

    found = cut(connected_components(edges.unionByName(links(planned, 0, None))))
    crowd, round_no = 0 if whole is None else large.agg(F.sum("rows")).first()[0] or 0, 0
    while crowd:
        round_no += 1
        new = cut(links(large, round_no, found))
        joins = new.count()
        if joins:
            found = cut(connected_components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(new)))
        if joins <= MISS * crowd:
            break
    members = cut(found.join(classes.select(F.col("node"), "cid", "n", "vector"), "node"))
    sizes = cut(members.groupBy("component").agg(F.count("*").alias("m"), F.min("cid").alias("component_id")))
    placed = members.join(sizes, "component").withColumn("tiles", F.ceil(F.col("m") / (2 * F.sqrt("m"))).cast("int"))
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("node", F.lit("tile")), F.col("tiles")).cast("int"))
    dealt = placed.select(
        "component", F.col("node").alias("cid"), "n", "vector", "tile",
        F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"),
    ).withColumns({"lo": F.least("tile", "other"), "hi": F.greatest("tile", "other")}).drop("other")
    counted = dealt.repartition("component", "lo", "hi").groupBy("component", "lo", "hi").applyInPandas(_tile_links(threshold, kind), "cid long, links long").groupBy(F.col("cid").alias("node")).agg(F.sum("links").alias("links"))
    known = (
        classes.select("d1", "d2", "node", "cid", "n")
        .join(members.join(sizes, "component").select("node", "component_id"), "node", "left")
        .join(counted, "node", "left")
        .select("d1", "d2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "cid").alias("component_id"))
    )
    linked = rows.where("ok").select("vec_id", "d1", "d2").distinct().join(cut(known), ["d1", "d2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", "d1", "d2").distinct().select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
