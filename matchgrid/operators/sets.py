"""Set operations over label sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_source_wins(sources: Sequence[DataFrame], clip: str) -> tuple[DataFrame, DataFrame]:
    """Union of label folders in order; a clip comes from the first folder that has it.

    Returns the rows and the clips found in several folders.
    """
    allr = None
    for i, s in enumerate(sources):
        s = s.withColumn("source_rank", F.lit(i))
        allr = s if allr is None else allr.unionByName(s, allowMissingColumns=True)
    first = allr.groupBy(clip).agg(F.min("source_rank").alias("__w"), F.size(F.collect_set("source_rank")).cast("long").alias("n_sources"))
    rows = allr.join(first.select(clip, "__w"), clip).where("source_rank = __w").drop("__w")
    return rows, first.where("n_sources > 1").select(clip, F.col("__w").alias("source_rank"), "n_sources")


def ball_states(no_ball: DataFrame, human_ball: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``conflict`` where both sets have the frame, else ``absent`` or ``complete``."""
    a = no_ball.select(*keys).distinct().withColumn("__a", F.lit(True))
    b = human_ball.select(*keys).distinct().withColumn("__b", F.lit(True))
    state = F.when(F.col("__a") & F.col("__b"), "conflict").when(F.col("__a"), "absent").otherwise("complete")
    return a.join(b, list(keys), "full").withColumn("state", state).drop("__a", "__b")


def player_states(marked: DataFrame, box_frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A players-complete marker with boxes is complete, without any box it is absent."""
    m, b = marked.select(*keys).distinct(), box_frames.select(*keys).distinct()
    complete = m.intersect(b).withColumn("state", F.lit("complete"))
    return complete.unionByName(m.exceptAll(b).withColumn("state", F.lit("absent")))


def union_ids(tables: Sequence[DataFrame], col: str) -> DataFrame:
    out = tables[0].select(col)
    for t in tables[1:]:
        out = out.union(t.select(col))
    return out.distinct()


def stateless_frames(canonical: DataFrame, states: DataFrame, keys: Sequence[str]) -> DataFrame:
    return canonical.select(*keys).distinct().join(states.select(*keys).distinct(), list(keys), "left_anti")


def export_frame_sets(canonical: DataFrame, requested: Sequence[str], scope: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Per frame: does it hold requested labels, other labels, labels out of scope."""
    lab = F.lower(F.col("label"))
    return canonical.groupBy(*keys).agg(
        F.bool_or(lab.isin(*requested)).alias("has_requested"),
        F.bool_or(lab.isin(*scope) & ~lab.isin(*requested)).alias("has_unrequested"),
        F.bool_or(~lab.isin(*scope)).alias("has_out_of_scope"),
    )


def scored_frames(marks: DataFrame, no_ball: DataFrame, not_broadcast: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frames scored for the ball: marked frames, and no-ball frames that are neither marked nor off air."""
    ball = marks.select(*keys).distinct()
    empty = no_ball.select(*keys).distinct().join(ball, list(keys), "left_anti").join(
        not_broadcast.select(*keys).distinct(), list(keys), "left_anti")
    return ball.withColumn("kind", F.lit("ball")).unionByName(empty.withColumn("kind", F.lit("no_ball")))

