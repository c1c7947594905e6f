"""The enriched views of the detection store: joins and arbitration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.functions import boxes, pitch
from matchgrid.functions.labels import GT_PREFIX, run_group
from matchgrid.session import small_side

FRAME = ["game_id", "frame_index"]
UNUSABLE = ("failed", "rejected", "not_broadcast", "too_few_points")


def frame_features(frame: DataFrame, game: DataFrame) -> DataFrame:
    return frame.join(small_side(game), "game_id")


def batch_rank(detection: DataFrame) -> DataFrame:
    """Rank the label batches of every frame; all rows of the rank-1 batch are canonical.

    The aggregation runs map-side first, so the window only ever sees a few batches per frame.
    """
    g = (
        detection.withColumn("run_group", run_group())
        .groupBy(*FRAME, "run_group")
        .agg(
            F.bool_or(F.col("source") == "hand_label").alias("has_hand"),
            F.bool_or(F.col("run_id").startswith(GT_PREFIX)).alias("is_gt"),
            F.max("run_id").alias("max_run"),
        )
    )
    w = Window.partitionBy(*FRAME).orderBy(F.desc("has_hand"), F.desc("is_gt"), F.desc("max_run"))
    return g.withColumn("rnk", F.rank().over(w))


def winning_group(detection: DataFrame) -> DataFrame:
    """The canonical batch of each frame, in one aggregation.

    All flushed runs of a game are one batch and every other run is a batch of its own, so the winner follows from two
    flags and two maxima per frame: a flush with a hand row, else the last other run with a hand row, else a flush,
    else the last run.
    """
    hand, gt = F.col("source") == "hand_label", F.col("run_id").startswith(GT_PREFIX)
    g = detection.groupBy(*FRAME).agg(
        F.bool_or(hand & gt).alias("gt_hand"),
        F.bool_or(gt).alias("gt_any"),
        F.max(F.when(hand & ~gt, F.col("run_id"))).alias("run_hand"),
        F.max(F.when(~gt, F.col("run_id"))).alias("run_any"),
    )
    flush = F.concat(F.lit("gt_import:"), "game_id")
    win = F.when(F.col("gt_hand"), flush).otherwise(F.coalesce("run_hand", F.when(F.col("gt_any"), flush), "run_any"))
    return g.select(*FRAME, win.alias("win_group"))


def detections_enriched(detection: DataFrame, frame: DataFrame, run: DataFrame) -> DataFrame:
    """Detections with frame and run columns and the ``canonical`` flag.

    Instead of joining the rank table back, the winning batch of a frame is one row; only frames
    present in ``frame`` are kept.
    """
    best = winning_group(detection)
    return (
        detection.withColumn("run_group", run_group())
        .join(frame.select(*FRAME, "is_broadcast"), FRAME)
        .join(best, FRAME)
        .join(small_side(run.select("run_id", "stage", "model_name")), "run_id", "left")
        .withColumn("canonical", F.col("run_group") == F.col("win_group"))
        .drop("win_group")
    )


def tracks_enriched(detection: DataFrame, track_meta: DataFrame) -> DataFrame:
    keys = ["game_id", "source", "run_id", "track_id"]
    return detection.where("track_id IS NOT NULL").join(track_meta, keys)


def track_meta(detection: DataFrame) -> DataFrame:
    """Per track: label, extent and number of boxes."""
    first = F.struct("frame_index", "detection_id")
    return (
        detection.where("track_id IS NOT NULL")
        .groupBy("game_id", "source", "run_id", "track_id")
        .agg(
            F.min_by("label", first).alias("track_label"),
            F.min("frame_index").alias("start_frame"),
            F.max("frame_index").alias("end_frame"),
            F.count("*").alias("n_boxes"),
        )
    )


def best_calibration(calibration: DataFrame) -> DataFrame:
    """One calibration per frame: hand, then accepted, then the best proposal; none on flagged frames.

    ``row_number() = 1`` becomes a group limit that is applied before the shuffle as well.
    """
    flagged = calibration.where("review_status = 'not_broadcast'").select(*FRAME).distinct()
    tier = F.when(F.col("source") == "hand_label", 1).when(F.col("review_status") == "accepted", 2).otherwise(3)
    w = Window.partitionBy(*FRAME).orderBy(
        "tier_rank",
        F.when(F.col("tier_rank") == 3, F.col("quality")).desc_nulls_last(),
        F.col("created_at").desc_nulls_last(),
        F.desc("run_id"),
        "source",
    )
    names = F.when(F.col("tier_rank") == 1, "hand").when(F.col("tier_rank") == 2, "accepted").otherwise("proposed")
    return (
        calibration.where(F.col("H").isNotNull() & ~F.col("review_status").isin(*UNUSABLE))
        .join(flagged, FRAME, "left_anti")
        .withColumn("tier_rank", tier)
        .withColumn("rn", F.row_number().over(w))
        .where("rn = 1")
        .withColumn("tier", names)
        .drop("rn", "tier_rank")
    )


def detections_on_pitch(detection: DataFrame, best: DataFrame) -> DataFrame:
    """Anchor point, lens correction and homography of every detection, with a status."""
    cal = best.select(
        *FRAME, "H", "quality", F.coalesce("distortion_k1", F.lit(0.0)).alias("k1"), F.col("tier").alias("cal_tier")
    )
    d = detection.join(cal, FRAME, "left")
    d = d.withColumn("k1", F.coalesce("k1", F.lit(0.0)))
    d = d.withColumn("anchor_x", boxes.centre_x()).withColumn("anchor_y", boxes.anchor_y())
    ux, uy = pitch.undistort("anchor_x", "anchor_y", "k1")
    d = d.withColumn("ux", ux).withColumn("uy", uy)
    px, py, pw = pitch.apply_homography(pitch.h_cells(), "ux", "uy")
    d = d.withColumn("px", px).withColumn("py", py).withColumn("pw", pw)
    d = d.withColumn("projection_status", pitch.projection_status(F.col("H").isNotNull(), "quality", F.col("pw")))
    st = F.col("projection_status")
    x, y = F.col("px") / F.col("pw"), F.col("py") / F.col("pw")
    return (
        d.withColumn("x_pitch", pitch.guarded(st, x))
        .withColumn("y_pitch", pitch.guarded(st, y))
        .withColumn("x_pitch_norm", pitch.guarded(st, (x + pitch.PITCH_LENGTH / 2) / pitch.PITCH_LENGTH))
        .withColumn("y_pitch_norm", pitch.guarded(st, (y + pitch.PITCH_WIDTH / 2) / pitch.PITCH_WIDTH))
        .withColumn("uncertainty", 1.0 - F.col("quality"))
        .drop("ux", "uy", "px", "py", "pw")
    )


def player_trajectory(
    detection: DataFrame, meta: DataFrame, game_id: str, track_id: int, source: str | None = None, run_id: str | None = None
) -> DataFrame:
    """One track in time order with its identity; the filters reach the scan."""
    d = detection.where((F.col("game_id") == game_id) & (F.col("track_id") == track_id))
    m = meta.where((F.col("game_id") == game_id) & (F.col("track_id") == track_id))
    if source is not None:
        d = d.where(F.col("source") == source)
    if run_id is not None:
        d = d.where(F.col("run_id") == run_id)
    return tracks_enriched(d, m).orderBy("frame_index", "source", "run_id", "detection_id")
