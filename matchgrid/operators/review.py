"""Operators of the review loop: disagreement, pre-verification, merging passes, card order, motion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.operators import ordered, windows
from matchgrid.session import cut_lineage


def _px(a: Column, b: Column, w: float, h: float) -> Column:
    return F.sqrt(F.pow((a["x"] - b["x"]) * w, 2) + F.pow((a["y"] - b["y"]) * h, 2))


def spread_order(cards: DataFrame, clip: str, frame: str, box: str, frames: int = 25) -> DataFrame:
    """Coarse-to-fine order: the first card of every clip-second before any second card.

    The position in the whole order comes from range partitioning, not from one global window.
    """
    d = cards.withColumn("__h", F.sha1(F.concat(F.col(clip), F.lit(":"), F.col(frame), F.lit(":"), F.col(box))))
    w = Window.partitionBy(clip, F.floor(F.col(frame) / frames)).orderBy("__h")
    d = d.withColumn("bucket_rank", (F.row_number().over(w) - 1).cast("long"))
    return ordered.global_rank(d, [("bucket_rank", True), ("__h", True)], out="position").drop("__h")


def disagreement(df: DataFrame, key: str, frame: str, people: str, agree_px: float = 60.0, width: float = 1920.0,
                 height: float = 1080.0, reach: int = 5, span: int = ordered.SPAN) -> DataFrame:
    """How far the forward and backward pass (structs ``fwd``, ``bwd``) and the person counts disagree."""
    d = windows.rolling_outlier(df, [key], frame, people, reach, span=span)
    f, b = F.col("fwd"), F.col("bwd")
    mismatch = f.isNull() != b.isNull()
    d = d.withColumn("gap", F.when(f.isNotNull() & b.isNotNull(), _px(f, b, width, height))).withColumn("mismatch", mismatch)
    grown = F.least(F.greatest((F.col("gap") - agree_px) / (3 * agree_px), F.lit(0.0)), F.lit(1.0))
    d = d.withColumn("ball_component", F.when(F.col("mismatch"), 1.0).when(F.col("gap").isNull(), 0.0).otherwise(grown))
    odd = F.coalesce(F.col("median") != F.col(people), F.lit(False))
    d = d.withColumn("person_flag", odd).withColumn("person_component", F.when(odd, 0.5).otherwise(0.0))
    return d.withColumn("score", F.greatest("ball_component", "person_component"))


def preverify(df: DataFrame, key: str, frame: str, max_step_px: float, min_conf: float, agree_px: float = 60.0,
              width: float = 1920.0, height: float = 1080.0, span: int = ordered.SPAN) -> DataFrame:
    """All failing reasons of a frame and its priority for a person; no reason means it may pass."""
    p = F.col("fwd")
    has = df.where(p.isNotNull()).select(key, frame, (p["x"] * width).alias("__x"), (p["y"] * height).alias("__y"))
    steps = windows.step_to_neighbours(has, [key], frame, "__x", "__y", span=span).select(key, frame, "max_step")
    d = df.join(steps, [key, frame], "left")
    differ = p.isNotNull() & (F.col("mismatch") | F.coalesce(F.col("gap") > agree_px, F.lit(False)))
    rough = p.isNotNull() & (F.coalesce(F.col("max_step"), F.lit(0.0)) > max_step_px)
    asked = p.isNotNull() & ~differ & ~rough
    conf = p["confidence"]
    reasons = F.array_compact(
        F.array(
            F.when(p.isNull(), "no_ball_proposal"),
            F.when(differ, "tracker_disagree"),
            F.when(rough, "track_not_smooth"),
            F.when(asked & (conf.isNull() | (conf < min_conf)), "verifier_low_conf"),
        )
    )
    margin = F.when(asked, F.lit(1.0) - F.coalesce(conf, F.lit(0.0))).otherwise(0.0)
    return d.withColumn("reasons", reasons).withColumn("priority", F.greatest(F.col("score"), margin))


def merge_passes(fwd: DataFrame, bwd: DataFrame, keys: Sequence[str], t: str, agree_px: float = 60.0, width: float = 1920.0,
                 height: float = 1080.0, fill_agree: bool = True, span: int = ordered.SPAN) -> DataFrame:
    """Merge a forward and a backward pass (columns ``origin, x, y, track_id, confidence``).

    Agreeing frames take the forward point unless only the backward one was detected; otherwise the side
    whose track has more support wins (a tie goes forward). Tracks are renumbered when side or id changes.
    """
    keys = list(keys)

    def prepared(d: DataFrame, name: str) -> DataFrame:
        d = d.withColumn("__k", F.when(F.col("origin") != "none", F.col("track_id")))
        weight = F.when(F.col("origin") == "detected", F.col("confidence")).otherwise(0.0)
        d = windows.track_support(d, keys, t, "__k", weight, "support", span=span).drop("__k")
        return d.select(*keys, t, F.struct(*[c for c in d.columns if c not in (*keys, t)]).alias(name))

    # Both passes are long plans and are read again by the renumbering: store the joined rows once.
    j = cut_lineage(prepared(cut_lineage(fwd), "f").join(prepared(cut_lineage(bwd), "b"), [*keys, t]))
    f, b = F.col("f"), F.col("b")
    fh, bh = f["origin"] != "none", b["origin"] != "none"
    fd, bd = f["origin"] == "detected", b["origin"] == "detected"
    agree = F.when(bd & ~fd, "b").otherwise("f")
    strong = F.when(F.round(f["support"], 9) >= F.round(b["support"], 9), "f").otherwise("b")
    both = F.when(_px(f, b, width, height) <= agree_px, agree).otherwise(strong)
    only_f = F.when(fd | F.lit(not fill_agree), "f")
    only_b = F.when(bd | F.lit(not fill_agree), "b")
    j = j.withColumn("side", F.when(fh & bh, both).when(fh, only_f).when(bh, only_b))
    j = j.withColumn("pick", F.when(F.col("side") == "f", f).when(F.col("side") == "b", b))
    j = j.withColumn("key", F.struct("side", F.col("pick.track_id").alias("id")))
    # Only frames with a point are numbered, but an empty frame between two points starts a new track.
    d = ordered.with_islands(j, keys, [t], lambda r, p: r["side"].isNotNull() & ~r["key"].eqNullSafe(p["key"]), ["side", "key"], "__id", span=span)
    head = d.groupBy(*keys).agg(F.min_by("side", t).alias("__s0"))
    # The first row always counts as a start; take it back where it holds no point.
    j = d.join(head, keys).withColumn("__id", F.col("__id") - F.when(F.col("__s0").isNull(), 1).otherwise(0))
    return j.select(
        *keys, t,
        F.coalesce("side", F.lit("-")).alias("side"),
        F.when(F.col("side").isNotNull(), F.col("__id")).alias("track_id"),
        F.coalesce(F.col("pick.origin"), F.lit("none")).alias("origin"),
        F.col("pick.x").alias("x"), F.col("pick.y").alias("y"), F.col("pick.confidence").alias("confidence"),
    )


def compensated_motion(detection: DataFrame, reach: int = 3, median: str = "disc") -> DataFrame:
    """Vertical motion of each track over ``2 * reach`` frames, less the median motion of the frame pair."""
    p = (
        detection.where("track_id IS NOT NULL")
        .groupBy("game_id", "track_id", "frame_index")
        .agg(F.avg(F.col("bbox_y") + F.col("bbox_h") / 2).alias("cy"))
    )
    a = p.select("game_id", "track_id", (F.col("frame_index") + reach).alias("frame_index"), F.col("cy").alias("c0"))
    b = p.select("game_id", "track_id", (F.col("frame_index") - reach).alias("frame_index"), F.col("cy").alias("c1"))
    m = a.join(b, ["game_id", "track_id", "frame_index"]).withColumn("dy", F.col("c1") - F.col("c0")).drop("c0", "c1")
    q = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY dy)") if median == "disc" else F.percentile("dy", 0.5)
    cam = m.groupBy("game_id", "frame_index").agg(q.alias("cam_dy"))
    return m.join(cam, ["game_id", "frame_index"]).withColumn("rel_dy", F.col("dy") - F.col("cam_dy"))
