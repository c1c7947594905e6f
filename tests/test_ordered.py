"""The two-level helpers give the same result as one plain pass, also when chunks are tiny or one key is hot."""

import random

import pandas as pd
from pyspark.sql import functions as F

from matchgrid.operators import bands, ordered, windows


def frame(spark, n=400, seed=1):
    rnd = random.Random(seed)
    rows = []
    for key in ("hot", "b", "c"):
        frames = sorted(rnd.sample(range(2000), n if key == "hot" else n // 20))
        rows += [(key, f, rnd.choice([1, 2, None]), rnd.randint(0, 3)) for f in frames]
    return spark.createDataFrame(rows, "k string, t int, v int, c int"), pd.DataFrame(rows, columns=["k", "t", "v", "c"])


def test_along_equals_plain_pass(spark):
    df, pdf = frame(spark)
    specs = [ordered.Prev("p", ["t"]), ordered.Prev("n", ["t"], False), ordered.Known("lk", F.col("v")), ordered.Known("nk", F.col("v"), False, False),
             ordered.Running("s", F.col("c")), ordered.Running("m", F.col("c"), "max", inclusive=False)]
    got = ordered.along(df, ["k"], ["t"], specs, span=16).select("k", "t", "p.t", F.col("n.t").alias("nt"), "lk", "nk", "s", "m").orderBy("k", "t").collect()
    want = []
    for k, g in pdf.sort_values(["k", "t"]).groupby("k"):
        rows = g.to_dict("records")
        for i, r in enumerate(rows):
            before = [x["v"] for x in rows[: i + 1] if x["v"] == x["v"] and x["v"] is not None]
            after = [x["v"] for x in rows[i + 1:] if x["v"] == x["v"] and x["v"] is not None]
            want.append((k, r["t"], rows[i - 1]["t"] if i else None, rows[i + 1]["t"] if i + 1 < len(rows) else None, before[-1] if before else None,
                         after[0] if after else None, sum(x["c"] for x in rows[: i + 1]), max((x["c"] for x in rows[:i]), default=None)))
    assert [tuple(r) for r in got] == want


def test_smooth_mask_bridges_and_drops(spark):
    on = [1, 1, 0, 0, 1, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 1, 1, 1, 1, 1]
    df = spark.createDataFrame([("x", i, bool(v)) for i, v in enumerate(on)], "k string, t int, m boolean")
    got = windows.smooth_mask(df, ["k"], "t", "m", merge_gap=2, min_len=3, span=4).orderBy("start").collect()
    assert [(r["start"], r["end"]) for r in got] == [(0, 5), (16, 20)]


def test_band_join_equals_brute_force(spark):
    rnd = random.Random(3)
    a = [("k", i, rnd.randint(0, 300)) for i in range(80)]
    b = [("k", i, rnd.randint(0, 300)) for i in range(80)]
    da = spark.createDataFrame(a, "k string, a int, ta int")
    db = spark.createDataFrame(b, "k string, b int, tb int")
    got = bands.band_join(da, db, ["k"], F.col("ta"), F.col("tb"), -2, 7).select("a", "b").collect()
    want = {(x[1], y[1]) for x in a for y in b if -2 <= y[2] - x[2] <= 7}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_global_rank_is_a_permutation_in_order(spark):
    df = spark.range(500).withColumn("v", F.abs(F.hash("id")) % 97)
    got = ordered.global_rank(df, [("v", False), ("id", True)], parts=7).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 501))
    assert [(-r["v"], r["id"]) for r in got] == sorted((-r["v"], r["id"]) for r in got)
