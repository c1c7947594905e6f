"""Counting and summary aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.functions import boxes
from matchgrid.functions.labels import LABELLED_STATES
from matchgrid.session import cut_lineage

FRAME = ["game_id", "frame_index"]
GOLD_METHODS = ("hand_series", "hand_frame", "verdict")
SILVER_METHODS = ("offline_audited",)


def flag_in(df: DataFrame, keys_df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Boolean ``out``: does the key occur in ``keys_df``."""
    hit = keys_df.select(*keys).distinct().withColumn(out, F.lit(True))
    return df.join(hit, list(keys), "left").withColumn(out, F.coalesce(out, F.lit(False)))


def source_overlap(detection: DataFrame) -> DataFrame:
    return detection.groupBy(*FRAME).agg(
        F.size(F.collect_set("source")).cast("long").alias("n_sources"),
        F.concat_ws(",", F.sort_array(F.collect_set("source"))).alias("sources"),
        F.count("*").alias("n"),
    )


def frame_complete(states: DataFrame, groups: Sequence[str] = ("ball", "player")) -> DataFrame:
    """Frames where every class group is complete or absent (one pass, no distinct expansion)."""
    done = F.col("state").isin(*LABELLED_STATES)
    g = states.where(done).groupBy(*FRAME).agg(*[F.bool_or(F.col("cls_group") == x).alias(f"__{x}") for x in groups])
    ok = None
    for x in groups:
        ok = F.col(f"__{x}") if ok is None else ok & F.col(f"__{x}")
    return g.where(ok).select(*FRAME)


def frame_state_pivot(states: DataFrame) -> DataFrame:
    def pick(g: str) -> Column:
        return F.max(F.when(F.col("cls_group") == g, F.col("state")))

    return states.groupBy(*FRAME).agg(
        pick("ball").alias("ball_state"),
        pick("player").alias("player_state"),
        F.bool_or(F.col("method").isin("hand_series", "hand_frame")).alias("any_hand"),
    )


def label_coverage(states: DataFrame, split: Column) -> DataFrame:
    """Labelled, fully and partly labelled frames per clip, per split and in total."""
    per = frame_state_pivot(states)
    b = F.coalesce(F.col("ball_state").isin(*LABELLED_STATES), F.lit(False))
    p = F.coalesce(F.col("player_state").isin(*LABELLED_STATES), F.lit(False))
    part = F.coalesce(F.col("ball_state") == "partial", F.lit(False)) | F.coalesce(
        F.col("player_state") == "partial", F.lit(False)
    )
    f = per.select("game_id", split.alias("split"), b.alias("b"), p.alias("p"), part.alias("part"))
    both = F.col("b") & F.col("p")
    return (
        f.rollup("split", "game_id")
        .agg(
            F.count("*").alias("frames"),
            F.count_if("b").alias("ball_labelled"),
            F.count_if("p").alias("player_labelled"),
            F.count_if(both).alias("fully_labelled"),
            F.count_if(~both & (F.col("part") | (F.col("b") != F.col("p")))).alias("partial"),
        )
        .withColumn("split", F.coalesce("split", F.lit("(all)")))
        .withColumn("game_id", F.coalesce("game_id", F.lit("(all)")))
    )


def label_tiers(states: DataFrame) -> DataFrame:
    tier = (
        F.when(F.col("method").isin(*GOLD_METHODS), "gold")
        .when(F.col("method").isin(*SILVER_METHODS), "silver")
        .otherwise("other")
    )
    return (
        states.where(F.col("state").isin(*LABELLED_STATES))
        .groupBy("game_id", "method", F.coalesce("teacher_version", F.lit("")).alias("teacher_version"))
        .agg(F.count("*").alias("n"))
        .withColumn("tier", tier)
    )


def read_states(
    table: DataFrame, games=None, cls_group: str | None = None, states=None, frames=None
) -> DataFrame:
    """Optional filters over label states; an empty list selects no row."""
    out = table
    if games is not None:
        out = out.where(F.col("game_id").isin(*games) if games else F.lit(False))
    if cls_group is not None:
        out = out.where(F.col("cls_group") == cls_group)
    if states is not None:
        out = out.where(F.col("state").isin(*states) if states else F.lit(False))
    if frames is not None:
        out = out.where(F.col("frame_index").isin(*frames) if frames else F.lit(False))
    return out


def tracklet_summary(detection: DataFrame, keys: Sequence[str], min_frames: int = 25) -> DataFrame:
    """First and last frame and centre of each track with at least ``min_frames`` boxes."""
    pos = F.struct("frame_index", "source", "run_id", "detection_id")
    centre = F.struct(boxes.centre_x().alias("x"), boxes.centre_y().alias("y"))
    g = (
        detection.where("track_id IS NOT NULL")
        .groupBy(*keys)
        .agg(
            F.min("frame_index").alias("start_frame"),
            F.max("frame_index").alias("end_frame"),
            F.count("*").alias("n"),
            F.min_by(centre, pos).alias("__s"),
            F.max_by(centre, pos).alias("__e"),
        )
        .where(F.col("n") >= min_frames)
    )
    return g.select(
        *keys, "start_frame", "end_frame", "n",
        F.col("__s.x").alias("start_x"), F.col("__s.y").alias("start_y"),
        F.col("__e.x").alias("end_x"), F.col("__e.y").alias("end_y"),
    )


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], parts: int | None = None) -> DataFrame:
    """Exact quantiles per group, interpolated between neighbours, as columns named by ``shares``; nulls do not count.

    Equal values are counted first, then ranked by range partitions of (group, value): a partition sums its own counts and
    one row per group and partition carries them on. So neither one buffer nor one task holds a large group. Groups without
    a value have no row.
    """
    keys = list(keys)
    n_parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    # Stored: a repeated sort must not move rows to other partitions.
    d = cut_lineage(d.repartitionByRange(n_parts, *keys, "__v").withColumn("__pid", F.spark_partition_id()))
    part = d.groupBy(*keys, "__pid").agg(F.sum("__n").alias("__in"))
    along = Window.partitionBy(*keys).orderBy("__pid")
    part = part.select(*keys, "__pid", (F.sum("__in").over(along) - F.col("__in")).alias("__before"), F.sum("__in").over(Window.partitionBy(*keys)).alias("__all"))
    inside = Window.partitionBy(*keys, "__pid").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"p.{k}")) for k in [*keys, "__pid"]]
    d = d.withColumn("__upto", F.sum("__n").over(inside)).alias("d").join(part.alias("p"), reduce(lambda a, b: a & b, same))
    end = F.col("__before") + F.col("__upto")
    d = d.select(*[F.col(f"d.{k}") for k in keys], "__v", "__all", (end - F.col("__n")).alias("__from"), end.alias("__to"))
    found = []
    for i, share in enumerate(shares.values()):
        at = F.lit(float(share)) * (F.col("__all") - 1)
        for name, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            found.append(F.max(F.when((F.col("__from") <= rank) & (rank < F.col("__to")), F.col("__v"))).alias(f"__{name}{i}"))
    g = d.groupBy(*keys).agg(F.max("__all").alias("__all"), *found)
    for i, (out, share) in enumerate(shares.items()):
        at = F.lit(float(share)) * (F.col("__all") - 1)
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        g = g.withColumn(out, F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (at - F.floor(at))))
    return g.select(*keys, *shares)


def with_quantiles(groups: DataFrame, df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``groups``, one row per group, with the exact quantiles of ``df``; null keys are a group as well."""
    q = exact_quantiles(df, keys, value, shares)
    same = reduce(lambda a, b: a & b, [F.col(f"g.{k}").eqNullSafe(F.col(f"q.{k}")) for k in keys])
    return groups.alias("g").join(q.alias("q"), same, "left").select("g.*", *[F.col(f"q.{c}") for c in shares])


def run_summary(detection: DataFrame, run_keys: Sequence[str], track_keys: Sequence[str]) -> DataFrame:
    """Track length statistics of a tracker run."""
    per = detection.where("track_id IS NOT NULL").groupBy(*track_keys).agg(F.count("*").alias("n"))
    g = per.groupBy(*run_keys).agg(
        F.count("*").alias("tracklets"),
        F.count_if(F.col("n") >= 25).alias("ge25"),
        F.round(F.avg(F.when(F.col("n") == 1, 1.0).otherwise(0.0)), 6).alias("singleton_share"),
    )
    return with_quantiles(g, per, run_keys, "n", {"median": 0.5, "p90": 0.9})
