import hashlib
import json
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from matchgrid.functions import ids, stats
from matchgrid.operators import maintain, metrics, snapshots, splits, trackers
from matchgrid.sources import readers, writers
from matchgrid.streaming import streams


def tmp():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


DET = "game_id string, frame_index int, detection_id long, bbox_x double, bbox_y double, bbox_w double, bbox_h double"


def walk(seed=1, frames=60):
    rnd = random.Random(seed)
    rows = []
    for g in ("g1", "g2"):
        pos = [[rnd.random() * 0.7, rnd.random() * 0.7] for _ in range(5)]
        for f in range(frames):
            for d, p in enumerate(pos):
                p[0] += rnd.uniform(-0.02, 0.02)
                p[1] += rnd.uniform(-0.02, 0.02)
                if rnd.random() < 0.85:
                    rows.append((g, f, d, p[0], p[1], 0.1, 0.15))
    return rows


def test_object_tracker_stream_equals_batch(spark):
    df = spark.createDataFrame(walk(), DET)
    batch = {tuple(r) for r in trackers.iou_tracks(df, 5, 0.3).collect()}
    folder = tmp()
    for i in range(4):
        df.where(F.floor(F.col("frame_index") / 15) == i).coalesce(1).write.mode("append").parquet(folder)
    s = spark.readStream.schema(DET).option("maxFilesPerTrigger", 1).parquet(folder)
    stream = {tuple(r) for r in streams.run_to_table(streams.iou_tracks(s, 5, 0.3)).collect()}
    assert stream == batch
    per = {}
    for _g, f, d, t in batch:
        per.setdefault((_g, f), []).append(t)
    assert all(len(v) == len(set(v)) for v in per.values())


def test_ball_tracker_stream_equals_batch_and_fills_gaps(spark):
    rnd = random.Random(3)
    rows = [("c", f, 0, 0.2 + f * 0.005, 0.4, 0.02, 0.02, rnd.uniform(0.61, 0.9)) for f in range(80) if not 20 <= f < 24 and not 40 <= f < 60]
    schema = "clip string, frame_index int, detection_id long, bbox_x double, bbox_y double, bbox_w double, bbox_h double, confidence double"
    df = spark.createDataFrame(rows, schema)
    frames = spark.range(80).select(F.lit("c").alias("clip"), F.col("id").cast("int").alias("frame_index"))
    pts = {r["frame_index"]: r for r in trackers.ball_points(df, frames, span=16).collect()}
    assert [pts[f]["origin"] for f in (19, 20, 23, 24, 40, 59, 60)] == ["detected", "interpolated", "interpolated", "detected", "none", "none", "detected"]
    assert abs(pts[21]["x"] - (0.2 + 21 * 0.005)) < 1e-9
    assert (pts[0]["track_id"], pts[79]["track_id"]) == (1, 2)
    folder = tmp()
    for lo, hi in ((0, 30), (30, 80)):
        df.where((F.col("frame_index") >= lo) & (F.col("frame_index") < hi)).coalesce(1).write.mode("append").parquet(folder)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = {(r["frame_index"], r["track_id"]) for r in streams.run_to_table(streams.ball_tracks(s)).collect()}
    assert got == {(f, r["track_id"]) for f, r in pts.items() if r["origin"] == "detected"}


def test_best_path_prefers_the_smooth_ball(spark):
    rows = [("c", f, 0, 0.1 + 0.004 * f, 0.5, 0.02, 0.02, 0.8) for f in range(30)] + [("c", f, 1, (f * 37 % 100) / 100, 0.1, 0.02, 0.02, 0.5) for f in range(30)]
    df = spark.createDataFrame(rows, "clip string, frame_index int, detection_id long, bbox_x double, bbox_y double, bbox_w double, bbox_h double, confidence double")
    got = trackers.best_path(df).collect()
    assert sorted((r["frame_index"], r["detection_id"], r["track_no"]) for r in got) == [(f, 0, 1) for f in range(30)]


def on_frames(rows, merge_gap, min_len):
    out = []
    for clip in sorted({r[0] for r in rows}):
        spans = []
        for f in sorted(r[1] for r in rows if r[0] == clip and r[2]):
            if spans and f - spans[-1][1] - 1 <= merge_gap:
                spans[-1][1] = f
            else:
                spans.append([f, f])
        out += [(clip, lo, hi) for lo, hi in spans if hi - lo + 1 >= min_len]
    return out


def test_mask_stream_gives_open_segments_in_any_batches(spark):
    rnd = random.Random(4)
    rows = [(c, i, i % 20 < 8 or rnd.random() < 0.1) for c in ("c", "d") for i in range(100)] + [("e", 1, None), ("c", 30, True), ("d", 5, True)]
    want = on_frames(rows, 3, 4)
    assert any(hi >= 97 for _, _, hi in want) or len(want) > 2
    for parts in (1, 4):
        folder, kept = tmp(), tmp()
        cut = rows[:]
        rnd.shuffle(cut)  # in four batches most frames are late
        got = None
        for i in range(parts):
            part = spark.createDataFrame(cut[i::parts], "clip string, frame int, is_on boolean")
            part.coalesce(1).write.mode("append").parquet(folder)
            s = spark.readStream.schema(part.schema).parquet(folder)
            got = streams.segments_of(s, "clip", 3, 4, kept)
        assert sorted((r["clip"], r["start"], r["end"]) for r in got.collect()) == want


def test_upsert_is_the_same_for_one_and_several_batches_and_repeats(spark):
    rnd = random.Random(9)
    rows = [(rnd.randrange(7), rnd.randrange(40), i) for i in range(200)]
    best = {}
    for k, ts, i in rows:
        best[k] = max(best.get(k, (-1, -1)), (ts, i))
    schema = "k int, ts int, id int"
    for parts in (1, 5):
        folder, kept = tmp(), tmp()
        for i in range(parts):
            spark.createDataFrame(rows[i::parts], schema).coalesce(1).write.mode("append").parquet(folder)
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        got = streams.upsert_stream(s, ["k"], ["ts", "id"], kept)
        assert {r["k"]: (r["ts"], r["id"]) for r in got.collect()} == best
        # Everything has been read: running it again changes nothing.
        assert streams.upsert_stream(s, ["k"], ["ts", "id"], kept).count() == len(best)


def put(folder, name, text):
    with open(f"{folder}/{name}", "w") as f:
        f.write(text)


def test_sidecar_and_verdict_readers(spark):
    d = tmp()
    put(d, "north_seg001.jsonl", "\n".join([
        json.dumps({"frame_index": 3, "bbox": {"x": 0.1, "y": 0.2, "w": 0.1, "h": 0.1}, "center": None, "tags": ["player", "labeller", "human_checked"]}),
        json.dumps({"frame_index": 4, "bbox": None, "center": None, "tags": ["no_ball", "labeller"]}), "{broken"]))
    got = {r["frame_index"]: r for r in readers.read_sidecars(spark, d).collect()}
    assert got[3]["game_id"] == "north_seg001" and got[3]["label"] == "player" and got[3]["checked"]
    assert got[4]["marker"] == "no_ball" and got[4]["label"] is None and len(got) == 2
    v = tmp()
    put(v, "c1.jsonl", "\n".join([json.dumps({"frame_index": 1, "box_index": 0, "verdict": "ball"}), "nonsense", json.dumps({"frame_index": 2, "verdict": "ball"})]))
    rows = readers.read_verdict_log(spark, v).collect()
    assert [(r["game_id"], r["vsource"], r["frame_index"], r["verdict"]) for r in rows] == [("c1", "sidecar", 1, "ball")]


def test_yolo_calibration_review_and_cache_readers(spark):
    y = tmp()
    put(y, "north_seg002_000012_png.rf.abc123.txt", "0 0.5 0.5 0.2 0.4\n2 0.1 0.1 0.4 0.1\n9 0.1 0.1 0.1 0.1\n")
    rows = readers.read_yolo_labels(spark, y, ["player", "referee", "ball"]).orderBy("detection_id").collect()
    assert [(r["clip"], r["frame_index"], r["detection_id"], r["label"]) for r in rows] == [("north_seg002", 12, 0, "player"), ("north_seg002", 12, 1, "ball")]
    assert abs(rows[0]["bbox_x"] - 0.4) < 1e-9 and rows[1]["bbox_x"] == 0.0
    c = tmp()
    h = [1.0, 0, 0, 0, 1, 0, 0, 0, 1]
    put(c, "a.json", json.dumps({"clip": "a", "frames": {"5": {"frame_index": 5, "H": h, "image_size": [1920, 1080], "correspondences": [{"image": [0.1, 0.2], "pitch_id": "p", "pitch_xy": [1, 2]}]}, "6": {"frame_index": 6, "H": [1.0]}}}))
    cal, kp, bad = readers.read_calibrations(spark, c)
    assert [r["frame_index"] for r in cal.collect()] == [5] and kp.first()["pitch_y"] == 2.0 and bad.first()["n_skipped"] == 1
    a, b = tmp(), tmp()
    put(a, "v.json", json.dumps({"frames": {"1": {"verdict": "yes"}, "x": {"verdict": "yes"}, "2": {"verdict": "maybe"}}}))
    put(b, "v.json", json.dumps({"frames": {"9": {"verdict": "no"}}}))
    put(b, "w.json", json.dumps({"frames": {"7": {"verdict": "no"}}}))
    got = {(r["video_stem"], r["frame_index"], r["verdict"]) for r in readers.read_broadcast_reviews(spark, [a, b]).collect()}
    assert got == {("v", 1, "yes"), ("w", 7, "no")}
    k = tmp()
    put(k, "q.jsonl", '{"frame_size": [1920, 1080], "stride": 1}\n{"f": 0, "c": [[0.1, 0.2, 0.3, 0.4, 0.9]]}\n{"f": 1, "c": []}\n')
    head, rows = readers.read_detection_cache(spark, k)
    assert head.first()["frame_size"] == [1920, 1080]
    assert sorted((r["frame_index"], r["confidence"]) for r in rows.collect() if r["confidence"]) == [(0, 0.9)] and rows.count() == 2


def test_snapshot_is_immutable_and_checked(spark):
    items = snapshots.item_hash(spark.createDataFrame([("a", "train", "x"), ("b", "train", "y")], "item_id string, split string, payload string"), ["item_id", "split", "payload"])
    root = tmp()
    writers.write_snapshot(items, snapshots.content_hash(items), root, "d", 1)
    assert writers.load_snapshot(spark, root, "d", 1).count() == 2
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        writers.write_snapshot(items, snapshots.content_hash(items), root, "d", 1)
    items.limit(1).write.mode("append").parquet(f"{root}/d/v=1/items")
    with pytest.raises(writers.TamperedSnapshot):
        writers.load_snapshot(spark, root, "d", 1)
    assert snapshots.content_hash(items.repartition(5)).first() == snapshots.content_hash(items.coalesce(1)).first()


def test_hash_rules_match_big_integers(spark):
    keys = [f"clip_{i}" for i in range(300)]
    df = spark.createDataFrame([(k,) for k in keys], "k string").select("k", *[ids.sha1_mod("k", m).alias(f"m{m}") for m in (4, 5, 10)])
    for r in df.collect():
        n = int(hashlib.sha1(r["k"].encode()).hexdigest(), 16)
        assert (r["m4"], r["m5"], r["m10"]) == (n % 4, n % 5, n % 10)


def test_missing_register_fails_closed(spark):
    empty = spark.createDataFrame([], "match_key string, split string")
    with pytest.raises(splits.SplitRegisterError):
        splits.require_register(empty, "match")


def test_precedence_keeps_stronger_method(spark):
    base = spark.createDataFrame([("g", 1, "ball", "complete", "hand_series"), ("g", 2, "ball", "absent", "sidecar_marker")], "game_id string, frame_index int, cls_group string, state string, method string")
    new = spark.createDataFrame([("g", 1, "ball", "absent", "verdict", 0), ("g", 2, "ball", "complete", "verdict", 1), ("g", 2, "ball", "partial", "verdict", 2)], "game_id string, frame_index int, cls_group string, state string, method string, seq int")
    got = {r["frame_index"]: (r["state"], r["method"]) for r in maintain.upsert_label_states(base, new).collect()}
    assert got == {1: ("complete", "hand_series"), 2: ("partial", "verdict")}


def test_threshold_walk_refuses_other_buckets(spark):
    df = spark.createDataFrame([("A", 0.9, "ball", "v1"), ("R", 0.9, "ball", "v1")], "bucket string, p_real double, verdict string, scorer_version string")
    with pytest.raises(metrics.NotExchangeable):
        metrics.learn_then_test(df)


def test_exact_bounds(spark):
    row = spark.range(1).select(stats.binomial_tail(F.lit(9), F.lit(10), F.lit(0.8)).alias("t"), stats.clopper_pearson_lower(F.lit(10), F.lit(10), 0.1).alias("c")).first()
    assert abs(row["t"] - (10 * 0.8**9 * 0.2 + 0.8**10)) < 1e-7
    assert abs(row["c"] - 0.1 ** 0.1) < 1e-6
