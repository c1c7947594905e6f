"""Jobs composed from the operators: item tables, training export, mining rounds."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.functions.boxes import is_ball
from matchgrid.functions.labels import GT_PREFIX, LABELLED_STATES, provenance_tier
from matchgrid.operators import sampling
from matchgrid.operators.aggs import frame_state_pivot
from matchgrid.session import cut_lineage

FRAME = ["game_id", "frame_index"]

# The buckets in their order and their shares of a round.
QUOTAS = {"U": 0.35, "M": 0.20, "N": 0.15, "A": 0.10, "G": 0.05, "R": 0.15}


def tracking_items(detection: DataFrame) -> DataFrame:
    """One item per labelled frame: its boxes in a fixed order, its kind and the best tier of the boxes that decide it.

    The list is bounded by the boxes of one image.
    """
    d = detection.where(F.col("run_id").startswith(GT_PREFIX)).withColumn("tier", provenance_tier("source", "reviewed"))
    box = F.struct("source", "label", "bbox_x", "bbox_y", "bbox_w", "bbox_h", "tier")
    g = d.groupBy(*FRAME).agg(
        F.array_sort(F.collect_list(box)).alias("boxes"), F.bool_or(is_ball()).alias("ball"),
        F.min(F.when(is_ball(), F.col("tier"))).alias("ball_tier"), F.min("tier").alias("any_tier"))
    return g.select(
        F.concat("game_id", F.lit(":"), "frame_index").alias("item_id"), *FRAME, F.when(F.col("ball"), "ball").otherwise("other_boxes").alias("label_kind"),
        F.coalesce("ball_tier", "any_tier").alias("tier"), "boxes")


def export_decisions(canonical: DataFrame, states: DataFrame, groups: Sequence[str] = ("ball", "player")) -> DataFrame:
    """Whether a frame may be exported: every class group must be labelled; else the first reason against it."""
    n = canonical.groupBy(*FRAME).agg(F.count("*").alias("n_boxes"))
    d = n.join(frame_state_pivot(states), FRAME, "left")
    cols = [F.col(f"{g}_state") for g in groups]
    none, part = cols[0].isNull(), F.coalesce(cols[0] == "partial", F.lit(False))
    for c in cols[1:]:
        none, part = none & c.isNull(), part | F.coalesce(c == "partial", F.lit(False))
    why = F.when(none, "no_state").when(part, "partial")
    for g, c in zip(groups, cols, strict=True):
        why = why.when(~F.coalesce(c.isin(*LABELLED_STATES), F.lit(False)), f"{g}_unreviewed")
    return d.withColumn("decision", why.otherwise("export"))


def round_targets(matches: DataFrame, budget: int, per_match_cap: float) -> DataFrame:
    """``match, cap, U, M, N, A, R``: cards that each bucket may take in a match. The budget is shared out over the buckets,
    each bucket's part over the matches; ``matches`` has one row per match."""
    n = matches.count()
    cap = max(1, math.ceil(per_match_cap * budget), math.ceil(budget / n)) if n else 1
    spark = matches.sparkSession
    quotas = spark.createDataFrame([(b, q, budget) for b, q in QUOTAS.items() if b != "G"], "bucket string, quota double, room long")
    goal = sampling.allocate(quotas, F.lit(budget), "bucket", "quota", "room").select("bucket", F.col("share").alias("goal"))
    d = matches.select("match", F.explode(F.array(*map(F.lit, "UMNAR"))).alias("bucket")).join(F.broadcast(goal), "bucket")  # five goals
    d = d.withColumn("weight", F.lit(1.0)).withColumn("room", F.lit(cap))
    d = sampling.allocate(d, F.col("goal"), "match", "weight", "room", ["bucket"])
    return d.groupBy("match").pivot("bucket", list("UMNAR")).agg(F.first("share")).withColumn("cap", F.lit(cap))


def mine_round(pool: DataFrame, budget: int = 300, seed: int = 0, per_match_cap: float = 0.15, per_clip: int = 3, gap_s: float = 3.0) -> DataFrame:
    """Cards of one round: buckets in order, best rank first, at most ``per_clip`` cards of a clip (the audit bucket ``A``
    aside), no two of a clip within ``gap_s`` seconds, quotas per match and bucket; the random bucket comes last and takes
    what the others left.

    Within a bucket, spacing and the clip's cap only look at the clip, and the quota keeps the first cards in rank order;
    so the clips are settled by themselves and the quota is a rank over what they give. No match or clip is one pass.
    """
    h = F.sha1(F.concat_ws(":", F.lit(str(seed)), "match", "clip", F.col("frame").cast("string"), F.col("node_id").cast("string")))
    pos = F.conv(F.substring(h, 1, 8), 16, 10).cast("double")
    arms = [("U", F.col("u"), F.col("u_rank")), ("M", F.col("m"), -F.col("m_rank")), ("N", F.col("n"), -F.col("n_rank")), ("A", F.col("a"), pos), ("R", F.lit(True), pos)]
    clip = ["match", "clip"]
    d = pool.withColumn("__gap", F.floor(F.col("fps") * gap_s).cast("long") + 1)
    picks = F.array_compact(F.array(*[F.when(ok, F.struct(F.lit(b).alias("bucket"), r.cast("double").alias("rank"))) for b, ok, r in arms]))
    d = cut_lineage(d.select(*clip, "frame", "node_id", "__gap", F.explode(picks).alias("p")).select(*clip, "frame", "node_id", "__gap", "p.bucket", "p.rank"))
    limits = cut_lineage(round_targets(pool.select("match").distinct(), budget, per_match_cap))
    order = ["rank", "clip", "frame", "node_id"]
    taken = None
    for b, _, _ in arms:
        own = d.where(F.col("bucket") == b).drop("bucket")
        quota = F.col(b)
        if taken is not None:
            # Places beside earlier cards are closed: equal stretches of one gap and their neighbours meet.
            s = F.floor(F.col("frame") / F.col("__gap"))
            near = own.withColumn("s", F.explode(F.array(s - 1, s, s + 1))).alias("o").join(
                taken.select(*clip, F.col("frame").alias("f"), s.alias("s")).alias("t"), [*clip, "s"]).where(F.abs(F.col("frame") - F.col("f")) < F.col("__gap"))
            own = own.join(near.select(*clip, "frame").distinct(), [*clip, "frame"], "left_anti")
            used = taken.groupBy("match").agg(F.count("*").alias("__used"), *[F.count_if(F.col("bucket") == x).alias(f"__{x}") for x in "UMNAR"])
            now = limits.join(used, "match", "left").na.fill(0)
            if b == "R":  # what the others could not fill
                quota = F.col("R") + sum((F.col(x) - F.col(f"__{x}") for x in "UMNA"), F.lit(0))
            now = now.select("match", F.least(quota, F.col("cap") - F.col("__used")).alias("__quota"))
        else:
            now = limits.select("match", F.least(quota, F.col("cap")).alias("__quota"))
        got = sampling.spaced(own, clip, "frame", [(c, True) for c in ("rank", "node_id", "frame")], F.col("__gap"))
        if b != "A":
            have = taken.where("bucket <> 'A'").groupBy(*clip).agg(F.count("*").alias("__n")) if taken is not None else None
            got = got.withColumn("__place", F.row_number().over(Window.partitionBy(*clip).orderBy("rank", "frame", "node_id")))
            got = got.join(have, clip, "left") if have is not None else got.withColumn("__n", F.lit(0))
            got = got.where(F.col("__place") + F.coalesce("__n", F.lit(0)) <= per_clip).drop("__place", "__n")
        got = got.withColumn("__turn", F.row_number().over(Window.partitionBy("match").orderBy(*order))).join(now, "match").where("__turn <= __quota")
        got = got.select(*clip, "frame", "node_id", "__gap", F.lit(b).alias("bucket"), "rank")
        taken = cut_lineage(got if taken is None else taken.unionByName(got))
    return taken.drop("__gap")
