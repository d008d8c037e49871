import random
import statistics

import pytest

from gridcells.operators.selection import median_by_selection


def groups_of(rows):
    out = {}
    for k, s, v in rows:
        out.setdefault((k, s), [])
        if v is not None:
            out[k, s].append(v)
    return {g: statistics.median(v) if v else None for g, v in out.items()}


@pytest.mark.parametrize("few,cuts", [(0, 1 << 16), (0, 3), (10, 4), (1 << 18, 1 << 16)])
def test_medians(spark, few, cuts):
    rng = random.Random(few + cuts)
    kinds = [lambda: rng.gauss(0, 1), lambda: float(rng.randrange(3)), lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300), lambda: None,
             lambda: rng.choice([0.0, -0.0, 5e-324, 1.0, float("inf"), float("-inf")]), lambda: 1 + rng.randrange(4) * 2.0 ** -52]
    rows = [(k, s, kinds[k]()) for k in range(6) for s in ("a", None) for _ in range(rng.randrange(1, 60))]
    rows += [(7, None, None), (8, "x", 1e308), (8, "x", 1.7e308)]
    df = spark.createDataFrame(rows, "k int, s string, v double").repartition(3)
    got = {(r.k, r.s): r.v for r in median_by_selection(df, ["k", "s"], "v", cuts=cuts, few=few).collect()}
    want = groups_of(rows)
    assert got.keys() == want.keys()
    for g, x in want.items():
        if g == (8, "x"):
            assert abs(got[g] - 1.35e308) < 1e295
        elif x is not None and x != x:
            assert got[g] != got[g]
        else:
            assert got[g] == x or abs(got[g] - x) <= 1e-15 * abs(x), g
    whole = [v for _, _, v in rows if v is not None and abs(v) < 1e307]
    few_rows = df.where("abs(v) < 1e307")
    assert median_by_selection(few_rows, [], "v", cuts=cuts, few=few).first().v == pytest.approx(statistics.median(whole), rel=1e-14)
    assert median_by_selection(df.limit(0), [], "v").first().v is None and median_by_selection(df.limit(0), ["k"], "v").count() == 0


def test_a_hot_group_is_counted_in_parts(spark):
    df = spark.range(200_000, numPartitions=6).selectExpr("id % 3 = 0 as k", "sin(id) * exp(id % 700) as v")
    got = {r.k: r.v for r in median_by_selection(df, ["k"], "v", few=50).collect()}
    want = {r.k: r.m for r in df.groupBy("k").agg({"v": "median"}).withColumnRenamed("median(v)", "m").collect()}
    assert got == want
