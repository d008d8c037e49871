import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridcells.llm import centroids


def plain(rows, k=8, rounds=10, scale=1024, width=64):
    """The clustering as it is stated, with Python's integers."""
    kept = [(i, [math.floor(np.float64(x) * scale) for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "~", r[1]))
    at = [v for _, v in first[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(at)):
            mine = [v for (_, v), c in zip(kept, of, strict=True) if c == j]
            if mine:
                at[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    done = [(i, *nearest(v)) for i, v in kept]
    total = {c: sum(d for _, d, e in done if e == c) for _, _, c in done}
    def fits(x):
        return x if x < 1 << 63 else None
    return [(i, c, d, fits(total[c]), fits(sum(total.values())), hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest()) for i, d, c in done]


def run(df, **how):
    return sorted(map(tuple, centroids.digests(centroids.cluster_vectors(df, **how)).collect()), key=str)


def test_as_stated(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    want = sorted(plain([(r.vec_id, r.embedding) for r in df.collect()]), key=str)
    assert run(df) == want
    assert run(df.repartition(7), block=16) == want


def test_odd_vectors(spark):
    rng = random.Random(3)
    rows = [(i % 30, [rng.choice((0.0, 0.25, -0.5, 1.0)) for _ in range(4)]) for i in range(60)]
    rows += [(100, None), (101, []), (102, [1.0, 2.0, 3.0]), (103, [1.0, None, 2.0, 3.0]), (104, [1.0, float("nan"), 0.0, 0.0]),
             (105, [float("inf"), 0.0, 0.0, 0.0]), (106, [1.0] * 5), (None, [0.5] * 4), (None, [9.5] * 4), (7, [0.25] * 4), (7, [0.25] * 4)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns(
        {"cluster": F.lit(1), "v": F.lit("x"), "far": F.lit(None).cast("binary"), "distance": F.lit("y")})
    assert run(df, width=4, k=5) == sorted(plain(rows, k=5, width=4), key=str)
    assert run(df, width=4, k=500, rounds=2) == sorted(plain(rows, k=500, rounds=2, width=4), key=str)
    assert run(df.limit(0), width=4) == [] and run(df.where("vec_id = 101"), width=4) == []
    assert run(df.where("vec_id = 7"), width=4, rounds=0) == sorted(plain([r for r in rows if r[0] == 7], rounds=0, width=4), key=str)


def test_equal_vectors_keep_empty_centroids(spark):
    rows = [(i, [0.5, 0.5]) for i in range(40)] + [(99, [3.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = run(df, width=2, k=6)
    assert got == sorted(plain(rows, k=6, width=2), key=str) and len({r[1] for r in got}) <= 2


def test_components_beyond_32_bits(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) * 10 ** rng.randint(0, 6 if i % 3 else 5) for _ in range(8)]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert run(df, width=8, k=3) == sorted(plain(rows, k=3, width=8), key=str)
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 1.5])], "vec_id bigint, embedding array<double>")
    got = {r[0]: r for r in centroids.cluster_vectors(huge, width=2, k=1).collect()}
    assert len(got) == 3 and all(r.distance is None and r.inertia is None for r in got.values())


def test_bounds_spare_distances_and_lose_none():
    rng = np.random.default_rng(5)
    middle = rng.integers(-1000, 1000, (8, 64))
    vectors = middle[rng.integers(0, 8, 4000)] + rng.integers(-60, 60, (4000, 64))
    pivots = middle.tolist()
    c = centroids.Centroids((middle + rng.integers(-9, 9, (8, 64))).tolist(), pivots)
    cluster, best, measured = centroids.assign(vectors, centroids.pivot_distances(vectors, pivots), c)
    every = ((vectors[:, None, :] - np.array(c.at)[None]) ** 2).sum(-1)
    assert (cluster == every.argmin(1)).all() and (best == every.min(1)).all()
    assert measured < 2 * len(vectors)                       # 8 times that without bounds


@pytest.mark.parametrize("scale", [1, 7])
def test_ties_go_to_the_smaller_number(scale):
    at = [[0, 0], [2, 0], [0, 2], [2, 0]]
    vectors = np.array([[1, 0], [1, 1], [2, 0], [0, 1], [2, 2]]) * scale
    c = centroids.Centroids([[x * scale for x in v] for v in at], [[x * scale for x in v] for v in at[:2]])
    cluster, _, _ = centroids.assign(vectors, centroids.pivot_distances(vectors, c.pivots), c)
    assert cluster.tolist() == [0, 0, 1, 0, 1]
