"""Joins of detections, tracklets, marks and calibrations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchgrid.functions import boxes, pitch
from matchgrid.operators import bands, spatial

BOX = ["bbox_x", "bbox_y", "bbox_w", "bbox_h"]


def crowded_flags(detection: DataFrame, frame_keys: Sequence[str], det_id: str = "detection_id", min_iou: float = 0.5) -> DataFrame:
    """Both boxes of any pair with enough overlap are crowded."""
    keys = list(frame_keys)
    p = spatial.box_pairs(detection, None, keys, det_id, det_id, min_iou)
    both = p.select(*keys, F.explode(F.array(det_id, f"{det_id}_b")).alias(det_id)).distinct()
    return detection.join(both.withColumn("crowded", F.lit(True)), [*keys, det_id], "left").withColumn(
        "crowded", F.coalesce("crowded", F.lit(False))
    )


def difficulty(detection: DataFrame, frame_keys: Sequence[str], conf: float = 0.4, min_iou: float = 0.5) -> DataFrame:
    """Why a detection needs a person: low confidence, crowding, or no ball in its frame."""
    keys = list(frame_keys)
    d = crowded_flags(detection, keys, min_iou=min_iou)
    ball = detection.groupBy(*keys).agg(F.bool_or(boxes.is_ball()).alias("has_ball"))
    d = d.join(ball, keys).withColumn("low_conf", F.coalesce(F.col("confidence") < conf, F.lit(False)))
    d = d.withColumn("no_ball", ~F.col("has_ball")).drop("has_ball")
    return d.withColumn("needs_review", F.col("low_conf") | F.col("crowded") | F.col("no_ball"))


def match_verdicts(verdicts: DataFrame, balls: DataFrame, frame_keys: Sequence[str], min_iou: float = 0.5) -> DataFrame:
    """Best-overlap ball box of each verdict; the corrected box is tried as well.

    ``verdicts`` has ``verdict_id, verdict, vsource, box, corrected`` (structs of x, y, w, h). A candidate
    ``not_ball`` never rejects a hand-placed box: that is a conflict and stays unmatched.
    """
    keys = list(frame_keys)
    probes = verdicts.withColumn("probe", F.explode(F.array_compact(F.array("box", "corrected"))))
    probes = probes.select(*keys, "verdict_id", *[F.col(f"probe.{c}").alias(f"bbox_{c}") for c in "xywh"])
    pairs = spatial.box_pairs(probes, balls, keys, "verdict_id", "detection_id", min_iou, right_cols=["source", "run_id"])
    first = F.struct(F.col("iou"), -F.col("detection_id"))
    best = pairs.groupBy(*keys, "verdict_id").agg(F.max_by(F.struct("detection_id", "source", "run_id", "iou"), first).alias("m"))
    d = verdicts.join(best, [*keys, "verdict_id"], "left")
    conflict = (F.col("verdict") == "not_ball") & (F.col("vsource") == "cand") & F.coalesce(F.col("m.source") == "hand_label", F.lit(False))
    d = d.withColumn("conflict", conflict)
    m = F.when(~conflict, F.col("m"))
    return d.withColumn("matched_id", m["detection_id"]).withColumn("matched_source", m["source"]).withColumn("match_iou", m["iou"]).drop("m")


def candidate_links(tracklets: DataFrame, key: str = "clip", max_gap: int = 12, max_speed: float = 0.035,
                    with_a: Sequence[str] = (), with_b: Sequence[str] = ()) -> DataFrame:
    """Tracklet pairs that may be one person: a short gap, a plausible speed, not different teams. Columns ``with_a`` of the
    first and ``with_b`` of the second tracklet follow.

    The gap is a band join on frames; a pair is only formed inside its bucket, cheapest tests first.
    """
    a = tracklets.select(key, F.col("track_id").alias("a"), F.col("end_frame").alias("__ae"), F.col("end_x").alias("__ax"), F.col("end_y").alias("__ay"), F.col("team").alias("__at"), *with_a)
    b = tracklets.select(key, F.col("track_id").alias("b"), F.col("start_frame").alias("__bs"), F.col("start_x").alias("__bx"), F.col("start_y").alias("__by"), F.col("team").alias("__bt"), *with_b)
    gap = F.col("__bs") - F.col("__ae")
    dx, dy = F.col("__bx") - F.col("__ax"), F.col("__by") - F.col("__ay")
    dist = F.sqrt(dx * dx + dy * dy)  # as in its SQL, and several times cheaper than hypot
    ok = (F.col("__at").isNull() | F.col("__bt").isNull() | (F.col("__at") == F.col("__bt"))) & (dist <= gap * max_speed)
    p = bands.band_join(a, b, [key], F.col("__ae"), F.col("__bs"), 1, max_gap, extra=ok)
    return p.select(key, "a", "b", gap.alias("gap"), dist.alias("distance"), *with_a, *with_b)


def nearest_mark(preds: DataFrame, marks: DataFrame, frame_keys: Sequence[str], width: float = 1920.0, height: float = 1080.0) -> DataFrame:
    """Distance in pixels to the nearest mark of the frame, null when the frame has none. The marks of a frame are few
    and meet its predictions as one list."""
    keys = list(frame_keys)
    place = F.struct((F.col("x") * width).alias("x"), (F.col("y") * height).alias("y"))
    m = marks.groupBy(*keys).agg(F.collect_list(place).alias("__m"))
    return preds.join(m, keys, "left").withColumn("near_px", _nearest("__m", width, height)).drop("__m")


def _nearest(points: str, width: float, height: float) -> Column:
    """Smallest distance of ``x, y`` to the listed points."""
    far = lambda p: F.sqrt(F.pow(F.col("x") * width - p["x"], 2) + F.pow(F.col("y") * height - p["y"], 2))
    return F.array_min(F.transform(points, far))


def frame_keys_union(boxes_: DataFrame, checks: DataFrame, markers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frames named by any of three sources, with a flag for each."""
    out = None
    for name, df in (("has_boxes", boxes_), ("has_checks", checks), ("has_marker", markers)):
        k = df.select(*keys).distinct().withColumn(name, F.lit(True))
        out = k if out is None else out.join(k, list(keys), "full")
    return out.fillna(False, ["has_boxes", "has_checks", "has_marker"])


def project_boxes(detection: DataFrame, calibration: DataFrame, margin_m: float = 5.0, drop_outside: bool = False) -> DataFrame:
    """Pitch position of every box with ``calib_ok``, ``in_pitch`` and ``in_bounds``; frames without a usable
    calibration keep their rows."""
    d = detection.join(calibration.select("game_id", "frame_index", "H", "k1", "calib_confidence"), ["game_id", "frame_index"], "left")
    d = d.withColumn("calib_ok", F.col("H").isNotNull())
    d = d.withColumn("k1", F.coalesce("k1", F.lit(0.0))).withColumn("ax", boxes.centre_x()).withColumn("ay", boxes.anchor_y())
    ux, uy = pitch.undistort("ax", "ay", "k1")
    d = d.withColumn("ux", ux).withColumn("uy", uy)
    px, py, pw = pitch.apply_homography(pitch.h_cells(), "ux", "uy")
    d = d.withColumn("px", px).withColumn("py", py).withColumn("pw", pw)
    good = F.col("calib_ok") & (F.abs("pw") >= pitch.WEIGHT_TOLERANCE)
    nan = F.lit(float("nan"))
    d = d.withColumn("x_m", F.when(good, F.col("px") / F.col("pw")).otherwise(nan)).withColumn("y_m", F.when(good, F.col("py") / F.col("pw")).otherwise(nan))
    d = d.drop("ax", "ay", "ux", "uy", "px", "py", "pw")

    def inside(margin: float) -> Column:
        # NaN sorts above every number in Spark, so an unusable position is never inside.
        return (F.abs("x_m") <= pitch.PITCH_LENGTH / 2 + margin) & (F.abs("y_m") <= pitch.PITCH_WIDTH / 2 + margin)

    d = d.withColumn("in_pitch", inside(0.0)).withColumn("in_bounds", inside(margin_m))
    return d.where(F.col("in_bounds") | ~F.col("calib_ok")) if drop_outside else d


def near_frames(rows: DataFrame, training: DataFrame, clip: str, frame: str, reach: int = 5) -> DataFrame:
    """Flag rows within ``reach`` frames of a training image: the training frames are fanned out and equi-joined."""
    t = training.select(clip, F.explode(F.sequence(F.col(frame) - reach, F.col(frame) + reach)).alias(frame)).distinct()
    return rows.join(t.withColumn("near_training", F.lit(True)), [clip, frame], "left").withColumn(
        "near_training", F.coalesce("near_training", F.lit(False))
    )


def window_progress(frames: DataFrame, complete: DataFrame, labelled: DataFrame, agreement: DataFrame, size: int = 250,
                    max_complete: float = 0.5) -> DataFrame:
    """Whole windows of ``size`` frames with labelled counts and mean agreement; nearly done windows are left out."""
    keys = ["game_id", "win"]
    win = F.floor(F.col("frame_index") / size).cast("long").alias("win")
    n = frames.groupBy("game_id").agg((F.max("frame_index") + 1).alias("n"))
    w = n.where(F.col("n") >= size).select("game_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / size).cast("long") - 1)).alias("win"))
    c = complete.select("game_id", "frame_index", win).distinct().groupBy(*keys).agg(F.count("*").alias("complete"))
    lb = labelled.select("game_id", "frame_index", win).distinct().groupBy(*keys).agg(F.count("*").alias("labelled"))
    ag = agreement.select("game_id", "agreement", win).groupBy(*keys).agg(F.avg("agreement").alias("agreement"))
    d = w.join(c, keys, "left").join(lb, keys, "left").join(ag, keys, "left").fillna(0, ["complete", "labelled"])
    return d.where(F.col("complete") <= max_complete * size).withColumn("start_frame", F.col("win") * size)


def neighbour_distance(points: DataFrame, processed: DataFrame, clip: str, frame: str, node: str, shift: int,
                       width: float = 1280.0, height: float = 720.0, out: str = "d") -> DataFrame:
    """Distance to the nearest point one sample away: NaN when that sample was never processed, 999 when it was
    processed but holds no point. The candidate points of a sample are few and travel as one list."""
    place = F.struct((F.col("x") * width).alias("x"), (F.col("y") * height).alias("y"))
    oth = points.groupBy(clip, (F.col(frame) - shift).alias(frame)).agg(F.collect_list(place).alias("__o"))
    seen = processed.select(clip, (F.col(frame) - shift).alias(frame)).distinct().withColumn("__seen", F.lit(True))
    d = points.join(oth, [clip, frame], "left").join(seen, [clip, frame], "left").withColumn("__d", _nearest("__o", width, height))
    value = F.when(F.col("__seen").isNull(), F.lit(float("nan"))).otherwise(F.coalesce("__d", F.lit(999.0)))
    return d.withColumn(out, value).drop("__d", "__o", "__seen")


def reprojection(points: DataFrame, proposals: DataFrame, keys: Sequence[str], width: float = 1920.0, height: float = 1080.0) -> DataFrame:
    """Error in pixels and metres of each ground-truth point under each proposal of its frame."""
    d = points.join(proposals, list(keys))
    h = pitch.h_cells()
    ix, iy, iw = pitch.apply_homography(pitch.invert_homography(h), "pitch_x", "pitch_y")
    det = h[0] * (h[4] * h[8] - h[5] * h[7]) - h[1] * (h[3] * h[8] - h[5] * h[6]) + h[2] * (h[3] * h[7] - h[4] * h[6])
    front = iw / det > pitch.WEIGHT_TOLERANCE
    err = F.hypot((ix / iw - F.col("u")) * width, (iy / iw - F.col("v")) * height)
    fx, fy, fw = pitch.apply_homography(h, "u", "v")
    return d.withColumn("err_px", F.when((iw != 0) & (det != 0) & front, err)).withColumn(
        "err_m", F.when(fw != 0, F.hypot(fx / fw - F.col("pitch_x"), fy / fw - F.col("pitch_y"))))


def link_similarity(vectors: DataFrame, links: DataFrame, group: str, vec_id: str, vector: str, k: int = 3) -> DataFrame:
    """Cosine of the mean vectors: the last ``k`` of side ``a`` against the first ``k`` of side ``b``.

    Vectors are unrolled to (group, position) rows, so a mean is an ordinary distributed aggregate.
    """
    from matchgrid.operators.windows import top_k

    def side(order: list[Column], name: str) -> DataFrame:
        v = top_k(vectors, [group], order, k)
        e = v.select(F.col(group).alias(name), F.posexplode(vector).alias("pos", "val"))
        return e.groupBy(name, "pos").agg(F.avg(F.col("val").cast("double")).alias("v"))

    a = side([F.desc(vec_id)], "a").withColumnRenamed("v", "va")
    b = side([F.asc(vec_id)], "b").withColumnRenamed("v", "vb")
    j = links.join(a, "a").join(b, ["b", "pos"])
    g = j.groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("dot"), F.sum(F.col("va") * F.col("va")).alias("na"), F.sum(F.col("vb") * F.col("vb")).alias("nb"))
    s = g.select("a", "b", (F.col("dot") / F.sqrt(F.col("na") * F.col("nb"))).alias("similarity"))
    return links.join(s, ["a", "b"], "left")


def merge_two_sources(a: DataFrame, b: DataFrame, frame_keys: Sequence[str], radius: float, bonus: float = 0.0) -> DataFrame:
    """Union of two candidate sets: pairs closer than ``radius`` become one candidate with the higher score (plus an
    agreement bonus on the logit scale), placed where the surer source put it. Columns ``id, x, y, p``."""
    from matchgrid.functions.stats import logit, sigmoid
    from matchgrid.operators.matching import greedy_match

    keys = list(frame_keys)
    la = a.select(*keys, F.col("id").alias("ida"), F.col("x").alias("xa"), F.col("y").alias("ya"), F.col("p").alias("pa"))
    lb = b.select(*keys, F.col("id").alias("idb"), F.col("x").alias("xb"), F.col("y").alias("yb"), F.col("p").alias("pb"))
    pairs = spatial.point_pairs(la, lb, keys, [F.col("xa"), F.col("ya")], [F.col("xb"), F.col("yb")], radius)
    m = greedy_match(pairs, keys, "ida", "idb", [("dist", True), ("ida", True), ("idb", True)])
    j = la.join(m, [*keys, "ida"], "left").join(lb, [*keys, "idb"], "left")
    hi = F.col("pb").isNull() | (F.col("pa") >= F.col("pb"))
    top = F.greatest("pa", "pb")
    p = F.when(F.col("idb").isNotNull(), sigmoid(logit(top) + bonus) if bonus else top).otherwise(F.col("pa"))
    both = j.select(*keys, "ida", "idb", F.when(hi, F.col("xa")).otherwise(F.col("xb")).alias("x"), F.when(hi, F.col("ya")).otherwise(F.col("yb")).alias("y"), p.alias("p"))
    rest = lb.join(m.select(*keys, "idb"), [*keys, "idb"], "left_anti").select(*keys, F.lit(None).cast("long").alias("ida"), "idb", F.col("xb").alias("x"), F.col("yb").alias("y"), F.col("pb").alias("p"))
    return both.unionByName(rest)
