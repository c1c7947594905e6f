"""Exact quantiles over range partitions against sorting."""

import random

from matchgrid.operators import aggs


def plain(values, share):
    v = sorted(values)
    at = share * (len(v) - 1)
    lo = int(at)
    hi = min(lo + 1, len(v) - 1)
    return v[lo] + (v[hi] - v[lo]) * (at - lo)


def test_quantiles_of_hot_tied_and_small_groups(spark):
    rnd = random.Random(2)
    rows = [("hot", rnd.choice([1.5, 1.5, 1.5, rnd.random() * 10])) for _ in range(4000)] + [("one", 4.0), ("two", 1.0), ("two", 2.0), ("none", None)]
    rows += [(None, float(i)) for i in range(11)] + [("two", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = {"q0": 0.0, "q25": 0.25, "mid": 0.5, "q99": 0.99, "q1": 1.0}
    for parts in (1, 7):
        got = {r["k"]: r for r in aggs.exact_quantiles(df, ["k"], "v", shares, parts).collect()}
        assert set(got) == {"hot", "one", "two", None}
        for k, r in got.items():
            for name, share in shares.items():
                assert abs(r[name] - plain([v for g, v in rows if g == k and v is not None], share)) < 1e-12
    g = aggs.with_quantiles(df.groupBy("k").count(), df, ["k"], "v", {"mid": 0.5}).collect()
    assert {r["k"]: r["mid"] for r in g}[None] == 5.0 and {r["k"]: r["mid"] for r in g}["none"] is None and len(g) == 5


def test_no_rows_give_no_quantiles(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert aggs.exact_quantiles(df, ["k"], "v", {"mid": 0.5}).count() == 0
