"""Modes by candidates against plain counts."""

import random
from collections import Counter

import pytest

from gridcells.operators import modes, profile


def plain(values):
    counts = Counter(v for v in values if v is not None and v == v)
    return min(((-n, v) for v, n in counts.items()), default=(None, None))


@pytest.mark.parametrize("buckets,leaders", [(1, 1), (4, 1), (64, 2), (1 << 14, 8)])
def test_modes(spark, buckets, leaders):
    rng = random.Random(buckets)
    rows = []
    for i in range(3000):
        rows.append((rng.choice("abc") * rng.randrange(1, 4), f"u{i}", None, "hot" if i % 3 == 0 else f"w{rng.randrange(700)}",
                     rng.choice([0.0, -0.0, float("nan"), 1.5, float(rng.randrange(50))]), rng.randrange(400)))
    df = spark.createDataFrame(rows, "few string, once string, none string, hot string, x double, k int").repartition(5)
    for j, c in enumerate(df.columns):
        neg, value = plain([r[j] + 0.0 if c == "x" else r[j] for r in rows])
        got = modes.mode_of(df, c, buckets, leaders).first()
        assert (got.x, got.n) == (value, None if neg is None else -neg), c


def test_a_frequent_value_leaves_few_groups(spark):
    df = spark.range(20_000).selectExpr("if(id % 3 = 0, 'hot', concat('v', id)) as s")
    plan = modes.mode_of(df, "s")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan and "pmod" in plan.split("Filter", 1)[1]       # one bucket is left to count
    assert modes.mode_of(df, "s").first().asDict() == {"x": "hot", "n": 6667}


def test_modes_of_odd_columns(spark):
    df = spark.createDataFrame([(True, [1, 2], "é" * 30_000), (False, [1, 2], "é" * 30_000), (None, None, "")], "b boolean, a array<int>, t string")
    got = {r.column: (r.mode, r.count_) for r in modes.column_modes(df).withColumnRenamed("count", "count_").collect()}
    assert got == {"b": ("false", 1), "a": ("[1, 2]", 2), "t": ("é" * 30_000, 2)}
    empty = modes.column_modes(df.limit(0), ["b", "t"]).collect()
    assert [(r.column, r.mode) for r in empty] == [("b", None), ("t", None)]


def test_statistics_take_them(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 0.0), ("b", -0.0), ("a", None), (None, 2.0)], "s string, v double")
    for approx in (False, True):
        rows = {r.column: r for r in profile.statistics(df, approx=approx).collect()}
        assert rows["s"].min_text == "a" and rows["s"].unique == 2 and rows["v"].unique == 3


def test_profiles_do_not_expand(spark, synthetic):
    for out in (profile.dimension_info(synthetic), profile.coverage(synthetic.df, synthetic.df, list(synthetic.dims)),
                profile.query_cost(synthetic, synthetic), profile.statistics(synthetic.df)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Expand" not in plan
