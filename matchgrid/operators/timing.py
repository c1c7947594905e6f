"""Clocks and predictions in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchgrid.operators.ordered import Known, Prev, along
from matchgrid.session import small_side


def continuous_time(rows: DataFrame, game: DataFrame) -> DataFrame:
    """Seconds from kick-off from ``(half, half_s)``; an unknown half is an error."""
    d = rows.join(small_side(game.select("game_id", "half2_start_continuous_s")), "game_id")
    bad = F.raise_error(F.concat(F.lit("unknown half "), F.col("half").cast("string"))).cast("double")
    t = F.when(F.col("half") == 1, F.col("half_s")).when(F.col("half") == 2, F.col("half_s") + F.col("half2_start_continuous_s")).otherwise(bad)
    return d.withColumn("t", t)


def predicted_place(rows: DataFrame, anchors: DataFrame, clip: str, frame: str, sigma0: float, k_static: float = 6.0,
                    k_vel: float = 4.0, span: int = 4096) -> DataFrame:
    """Place predicted from the last two anchors before each row (constant velocity) and its spread in pixels.

    Anchors and row frames share one time line; the last anchor, which carries the one before it, is brought forward.
    """
    a = along(anchors.select(clip, frame, "x", "y"), [clip], [frame], [Prev("p", [frame, "x", "y"])], span=span)
    a = a.select(clip, frame, F.struct(F.col(frame).alias("f"), "x", "y", F.col(f"p.{frame}").alias("pf"), F.col("p.x").alias("px"), F.col("p.y").alias("py")).alias("a"))
    line = rows.select(clip, frame).distinct().join(a, [clip, frame], "full")
    line = along(line, [clip], [frame], [Known("last", F.col("a"), True, inclusive=False)], span=span)
    g = F.col(frame) - F.col("last.f")
    v = F.col("last.pf").isNotNull()
    dt = F.col("last.f") - F.col("last.pf")
    x = F.when(v, F.col("last.x") + (F.col("last.x") - F.col("last.px")) / dt * g).otherwise(F.col("last.x"))
    y = F.when(v, F.col("last.y") + (F.col("last.y") - F.col("last.py")) / dt * g).otherwise(F.col("last.y"))
    s = F.lit(sigma0) + F.when(v, k_vel).otherwise(k_static) * g
    line = line.select(clip, frame, x.alias("pred_x"), y.alias("pred_y"), s.alias("sigma"))
    return rows.join(line, [clip, frame], "left")
