"""Event groups and followed clusters against plain walks over all rows."""

import random

from matchgrid.operators import sampling, trackers


def events_by_hand(rows, span, dist):
    got, order = {}, {}
    for clip in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == clip), key=lambda r: (r[1], r[4]))
        for i, (_, f, x, y, c) in enumerate(mine):
            near = [p for p in mine[:i] if f - p[1] <= span and None not in (x, y, p[2], p[3]) and abs(x - p[2]) < dist and abs(y - p[3]) < dist]
            if near:
                got[clip, f, c] = got[clip, near[0][1], near[0][4]]
            else:
                got[clip, f, c] = f"{clip}:{order.setdefault(clip, 0)}"
                order[clip] += 1
    return got


def test_events_equal_a_walk_over_pairs(spark):
    rnd = random.Random(5)
    rows = []
    for clip, frames in (("hot", 150), ("a", 12), ("b", 1)):
        for f in range(frames):
            for c in range(rnd.randrange(0, 6)):
                spot = (0.5, 0.5) if rnd.random() < 0.2 else (round(rnd.random() * 0.3 - 0.1, 3), round(rnd.random() * 0.2, 3))
                rows.append((clip, f, *(spot if rnd.random() < 0.97 else (None, 0.1)), c))
    schema = "clip string, frame int, x double, y double, cand long"
    got = sampling.event_groups(spark.createDataFrame(rows, schema), "clip").collect()
    assert len(got) == len(rows)
    assert {(r["clip"], r["frame"], r["cand"]): r["event"] for r in got} == events_by_hand(rows, 3, 0.03)
    assert sampling.event_groups(spark.createDataFrame([], schema), "clip").count() == 0


def test_followed_clusters_take_the_best_free_track(spark):
    rnd = random.Random(8)
    rows = [("g", f, c, rnd.randrange(8) / 10, rnd.randrange(3) / 10, 0.25, 0.25) for f in range(60) if f % 20 < 13 for c in range(rnd.randrange(1, 6))]
    df = spark.createDataFrame(rows, "game_id string, frame_index int, component long, x double, y double, w double, h double")
    got = {(r["frame_index"], r["component"]): r["cluster_track"] for r in trackers.cluster_tracks(df, "game_id").collect()}

    def share(a, b):
        w = max(0.0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))
        h = max(0.0, min(a[4] + a[6], b[4] + b[6]) - max(a[4], b[4]))
        return w * h / min(a[5] * a[6], b[5] * b[6])

    want, last = {}, {}
    for f in sorted({r[1] for r in rows}):
        here = [r for r in rows if r[1] == f]
        links = sorted((-share(r, box), t, r[2]) for r in here for t, box in last.items() if f - box[1] <= 5 and share(r, box) >= 0.5)
        taken = {}
        for _, t, c in links:
            if t not in taken and c not in taken.values():
                taken[t] = c
        new = {c: t for t, c in taken.items()}
        for r in here:
            t = new.get(r[2], len({*want.values()}))
            want[f, r[2]], last[t] = t, r
    assert got == want


def test_a_frame_pass_of_no_rows_is_empty(spark):
    df = spark.createDataFrame([], "clip string, win long, frame_index int, detection_id long, x double, y double")
    assert trackers.window_tracklets(df, "clip", "win").count() == 0
