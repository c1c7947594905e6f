import itertools
import random

from pyspark.sql import functions as F

from matchgrid.operators import graph, joins, matching, sampling, spatial, trackers


def boxes(n, seed, frames=3):
    rnd = random.Random(seed)
    return [("g", f, i, rnd.random() * 0.8, rnd.random() * 0.8, 0.05 + rnd.random() * 0.2, 0.05 + rnd.random() * 0.2) for f in range(frames) for i in range(n)]


def iou(a, b):
    return trackers._iou(a, b)


def test_box_pairs_equal_brute_force_in_a_crowded_frame(spark):
    rows = boxes(150, 5)
    df = spark.createDataFrame(rows, "g string, f int, d long, bbox_x double, bbox_y double, bbox_w double, bbox_h double")
    got = {(r["f"], r["d"], r["d_b"]) for r in spatial.box_pairs(df, None, ["g", "f"], "d", "d", 0.3).collect()}
    want = {(a[1], a[2], b[2]) for a, b in itertools.combinations(rows, 2) if a[1] == b[1] and iou(a[3:], b[3:]) >= 0.3}
    assert got == want and want


def test_point_pairs_equal_brute_force(spark):
    rnd = random.Random(9)
    p = [("g", i, rnd.uniform(-50, 300), rnd.uniform(0, 300)) for i in range(120)]
    df = spark.createDataFrame(p, "g string, i int, x double, y double")
    other = df.select("g", F.col("i").alias("j"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    got = {(r["i"], r["j"]) for r in spatial.point_pairs(df, other, ["g"], [F.col("x"), F.col("y")], [F.col("qx"), F.col("qy")], 17.0).collect()}
    want = {(a[1], b[1]) for a in p for b in p if ((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) ** 0.5 <= 17.0}
    assert got == want


def test_greedy_rounds_equal_the_ordered_pass(spark):
    rnd = random.Random(2)
    pairs = [("g", a, b, rnd.randint(0, 9)) for a in range(12) for b in range(12) if rnd.random() < 0.5]
    df = spark.createDataFrame(pairs, "g string, a int, b int, s int")
    order = [("s", False), ("a", True), ("b", True)]
    rounds = {tuple(r) for r in matching.greedy_match(df, ["g"], "a", "b", order).collect()}
    used_a, used_b, want = set(), set(), set()
    for g, a, b, _s in sorted(pairs, key=lambda p: (-p[3], p[1], p[2])):
        if a not in used_a and b not in used_b:
            want.add((g, a, b))
            used_a.add(a)
            used_b.add(b)
    assert rounds == want


def test_best_matching_is_optimal():
    rnd = random.Random(4)
    for _ in range(60):
        n, m = rnd.randint(1, 5), rnd.randint(1, 5)
        gain = {(i, j): rnd.randint(1, 20) / 10 for i in range(n) for j in range(m) if rnd.random() < 0.6}
        got = sum(gain[i, j] for i, j in trackers.best_matching(gain).items())
        best = 0.0
        for cols in itertools.permutations(list(range(m)) + [None] * n, n):
            best = max(best, sum(gain.get((i, j), 0.0) for i, j in enumerate(cols) if j is not None))
        assert abs(got - best) < 1e-9


def test_components_equal_union_find(spark):
    rnd = random.Random(8)
    edges = [("k", rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [("k", i, i + 1) for i in range(100, 160)]
    nodes = sorted({x for e in edges for x in e[1:]})
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for _k, a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    nd = spark.createDataFrame([("k", n) for n in nodes], "k string, node long")
    ed = spark.createDataFrame(edges, "k string, src long, dst long")
    got = {r["node"]: r["component"] for r in graph.components(nd, ed, "node", ["k"]).collect()}
    assert got == {n: find(n) for n in nodes}


def test_difficulty_flags_both_boxes(spark):
    rows = [("g", "yolo", "r", 1, 1, "player", 0.9, 0.1, 0.1, 0.2, 0.2), ("g", "yolo", "r", 1, 2, "player", 0.9, 0.11, 0.1, 0.2, 0.2),
            ("g", "yolo", "r", 2, 1, "ball", 0.2, 0.1, 0.1, 0.2, 0.2), ("g", "hand_label", "h", 3, 1, "ball", None, 0.1, 0.1, 0.2, 0.2)]
    df = spark.createDataFrame(rows, "game_id string, source string, run_id string, frame_index int, detection_id long, label string, confidence double, bbox_x double, bbox_y double, bbox_w double, bbox_h double")
    got = {(r["frame_index"], r["detection_id"]): (r["low_conf"], r["crowded"], r["no_ball"]) for r in joins.difficulty(df, ["game_id", "source", "run_id", "frame_index"]).collect()}
    assert got == {(1, 1): (False, True, True), (1, 2): (False, True, True), (2, 1): (True, False, False), (3, 1): (False, False, False)}


def test_spacing_respects_gap_and_order(spark):
    rows = [("c", 10, 5.0), ("c", 12, 9.0), ("c", 40, 1.0), ("c", 60, 8.0), ("d", 11, 2.0)]
    df = spark.createDataFrame(rows, "clip string, frame int, score double")
    got = {(r["clip"], r["frame"]) for r in sampling.spaced(df, "clip", "frame", [("score", False), ("frame", True)], 25).collect()}
    assert got == {("c", 12), ("c", 60), ("d", 11)}


def test_probability_sample_has_exact_inclusion(spark):
    rows = [(f"m{m}", f"c{c}", w, n) for m in range(2) for c in range(3) for w in range(10) for n in range(1 + w % 3)]
    df = spark.createDataFrame(rows, "match string, clip string, win int, node long")
    got = sampling.probability_sample(df, "match", ["clip", "win"], ["node"], {"m0": 6, "m1": 50}).collect()
    assert sum(r["match"] == "m0" for r in got) == 6 and sum(r["match"] == "m1" for r in got) == 30
    assert all(abs(r["pi"] - (6 if r["match"] == "m0" else 30) / 30 / r["m"]) < 1e-12 for r in got)


def test_large_groups_in_rounds_equal_the_ordered_pass(spark, monkeypatch):
    rnd = random.Random(6)
    rows = [("a" if i % 3 else "b", rnd.randint(0, 30), rnd.randint(0, 30), rnd.randint(0, 9) / 10) for i in range(600)]
    df = spark.createDataFrame(rows, "f string, l long, r long, fit double").dropDuplicates(["f", "l", "r"])
    order = [("fit", False), ("l", True), ("r", True)]
    want, used = set(), set()
    for f, left, right, fit in sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], -r[3], r[1], r[2])):
        if not used & {(f, "l", left), (f, "r", right)}:
            used |= {(f, "l", left), (f, "r", right)}
            want.add((f, left, right))
    for limit in (0, 250, 1000):  # all in rounds, the larger group only, none
        monkeypatch.setattr(matching, "WALKED_PAIRS", limit)
        got = [tuple(r) for r in matching.greedy_match(df, ["f"], "l", "r", order).collect()]
        assert set(got) == want and len(got) == len(want)


def test_teacher_score_without_broadcast(spark):
    """Both sides of the pairs come placed by frame out of larger joins."""
    from matchgrid.catalog import load_all
    from matchgrid.catalog.registry import QUERIES

    load_all()
    query = lambda: sorted(map(str, QUERIES["a34_teacher_score"](spark, "/root/testdata/sf0.001").collect()))
    want = query()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert query() == want and len(want) == 25
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_crowds_of_boxes_exactly_at_the_limit(spark):
    """An overlap of 0.2 and a distance of 0.6 widths, as far as doubles go: decided in pixels, as the SQL does."""
    rows = [("a", 0, 0.52, 0.32, 0.15, 0.2125), ("a", 1, 0.54, 0.52, 0.188, 0.26), ("a", 2, 0.44, 0.34, 0.13, 0.1875),
            ("b", 0, 0.28, 0.68, 0.116, 0.17), ("b", 1, 0.08, 0.64, 0.146, 0.2075), ("b", 3, 0.18, 0.26, 0.15, 0.2125), ("b", 5, 0.18, 0.42, 0.15, 0.2125)]
    size = (1920.0, 1080.0)
    px = [(f, d, x * size[0], y * size[1], w * size[0], h * size[1]) for f, d, x, y, w, h in rows]
    df = spark.createDataFrame(px, "f string, detection_id long, bbox_x double, bbox_y double, bbox_w double, bbox_h double")
    got = {r["f"]: (r["largest"], round(r["score"], 7)) for r in graph.crowd_scores(df, ["f"], extent=size).collect()}
    assert got == {"a": (1, 1.0), "b": (2, 2.1409396)}


def test_box_pairs_in_pixels_equal_those_in_shares(spark):
    schema = "g string, f int, d long, bbox_x double, bbox_y double, bbox_w double, bbox_h double"
    rows = boxes(150, 7)
    px = [(*r[:3], r[3] * 1024, r[4] * 512, r[5] * 1024, r[6] * 512) for r in rows]
    found = [{(r["f"], r["d"], r["d_b"]) for r in spatial.box_pairs(spark.createDataFrame(b, schema), None, ["g", "f"], "d", "d", 0.3, extent=e).collect()}
             for b, e in ((rows, (1.0, 1.0)), (px, (1024.0, 512.0)))]
    assert found[0] == found[1] and found[0]


def test_components_in_a_pass_per_frame_equal_those_in_rounds(spark, monkeypatch):
    rnd = random.Random(4)
    nodes = [(f, n) for f in ("a", "b", "c") for n in range(40)]
    edges = [(f, rnd.randrange(30), rnd.randrange(30)) for f, m in (("a", 60), ("b", 14)) for _ in range(m)]
    nd, ed = spark.createDataFrame(nodes, "f string, node long"), spark.createDataFrame(edges, "f string, src long, dst long")
    want = {tuple(r) for r in graph.components(nd, ed, "node", ["f"]).select("f", "node", "component").collect()}
    for limit in (1_000_000, 20, 0):  # all in passes, the larger frame in rounds, all in rounds
        monkeypatch.setattr(graph, "WALKED_LINKS", limit)
        got = graph.frame_components(nd, ed, "node", ["f"]).select("f", "node", "component").collect()
        assert len(got) == len(nodes) and {tuple(r) for r in got} == want


def test_pairs_of_ordinary_and_crowded_frames_in_one_table(spark):
    rnd = random.Random(6)
    p = [(f, i, rnd.uniform(-50, 300), rnd.uniform(0, 300)) for f, n in (("few", 30), ("many", 90), ("one", 1)) for i in range(n)]
    df = spark.createDataFrame(p, "f string, i long, x double, y double")
    pairs = spatial.point_pairs(df.where("i % 2 = 0"), df.where("i % 2 = 1").toDF("f", "j", "qx", "qy"), ["f"], [F.col("x"), F.col("y")], [F.col("qx"), F.col("qy")], 40.0)
    want = {(a[0], a[1], b[1]) for a in p for b in p if a[0] == b[0] and a[1] % 2 == 0 and b[1] % 2 == 1 and ((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) ** 0.5 <= 40.0}
    assert {(r["f"], r["i"], r["j"]) for r in pairs.collect()} == want and {w[0] for w in want} == {"few", "many"}


def test_homographies_over_several_slices_of_a_batch(spark, monkeypatch):
    from matchgrid.operators import homography

    monkeypatch.setattr(homography, "FRAMES", 2)
    h = [[2.0, 0.1, 3.0], [0.2, 1.5, -1.0], [0.01, 0.02, 1.0]]
    rows = []
    for f in range(7):
        for u, v in [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.3, 0.7), (0.8, 0.2)][: 3 + f]:
            x, y, w = (a * u + b * (v + f) + c for a, b, c in h)
            rows.append(("g", f, u, v + f, x / w, y / w))
    rows += [("flat", 0, float(i), 0.0, float(i), 0.0) for i in range(5)]  # do not determine a map
    df = spark.createDataFrame(rows, "game_id string, frame_index int, u double, v double, pitch_x double, pitch_y double").coalesce(1)
    got = {(r["game_id"], r["frame_index"]): (r["H"] is not None, r["n_points"], r["mean_err_m"]) for r in homography.fit_homographies(df).collect()}
    assert set(got) == {("g", f) for f in range(1, 7)} | {("flat", 0)} and got["flat", 0] == (False, 5, None)
    assert all(got["g", f][0] and got["g", f][1] == min(6, 3 + f) and got["g", f][2] < 1e-6 for f in range(1, 7))
