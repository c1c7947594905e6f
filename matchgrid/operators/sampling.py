"""Ordering and sampling of review cards. Random choices come from hashes of the row keys."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.functions import ids
from matchgrid.functions.labels import bin_centre, sampling_weight
from matchgrid.functions.stats import rounded
from matchgrid.operators.windows import top_k
from matchgrid.session import cut_lineage, small_side


def triage_key() -> Column:
    """What a decision list is ordered by: most uncertain first for ``ask``, surest first otherwise."""
    return (
        F.when(F.col("decision") == "ask", rounded("uncertainty", 6))
        .when(F.col("decision") == "merge", -F.col("similarity"))
        .otherwise(F.col("similarity"))
    )


def triage_order(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Place of each link in its decision list, by :func:`triage_key`, then ``a, b``. Every link is shuffled; links of tracklets
    are placed without that by :func:`linking.triaged_links`."""
    w = Window.partitionBy(*keys, "decision").orderBy(triage_key(), "a", "b")
    return links.withColumn("place", F.row_number().over(w).cast("long"))


def risky_frames(rows: DataFrame, keys: Sequence[str], score: Column, frame: str, k: int) -> DataFrame:
    d = rows.withColumn("risk", score)
    return top_k(d, keys, [F.desc("risk"), F.col(frame)], k, out="place")


def round_robin(rows: DataFrame, group: str, order: Sequence[Column], count: int) -> DataFrame:
    """Take the best row of each group in turn until ``count`` rows: at most ``count`` rows per group are shuffled."""
    d = top_k(rows, [group], order, count, out="turn")
    return d.orderBy("turn", group).limit(count)


def exponential_race(rows: DataFrame, key: Column, weight: Column, top: int | None = None) -> DataFrame:
    """Weighted sample without replacement: order by ``-ln(u) / w``; ``top`` is taken per task, then merged."""
    d = rows.withColumn("race", -F.ln(ids.hashed_uniform(key)) / F.greatest(weight, F.lit(1e-9)))
    return d.orderBy("race").limit(top) if top else d


def candidate_race(rows: DataFrame, key: Column, conf: str, top: int, tau: float = 0.25) -> DataFrame:
    return exponential_race(rows, key, sampling_weight(bin_centre(conf), tau), top)


def adaptive_race(rows: DataFrame, bands: DataFrame, key: Column, conf: str, top: int, target: int = 50) -> DataFrame:
    """The race with more weight where a confidence band has few decided verdicts. ``bands`` has ten rows."""
    band = F.least(F.floor(F.col(conf) * 10 + 1e-9), F.lit(9)).cast("int")
    d = rows.withColumn("band", band).join(F.broadcast(bands.select("band", "decided")), "band", "left")
    need = 1.0 + F.greatest(F.lit(0.0), 1.0 - F.coalesce("decided", F.lit(0)) / float(target))
    return exponential_race(d, key, sampling_weight(bin_centre(conf)) * need, top)


def page_mix(focused: DataFrame, uniform: DataFrame, order: str, page: int, group: str, ratio: int = 3) -> DataFrame:
    """``ratio`` focused cards for each uniform one, one card per event ``group``; both streams are cut to a page first."""
    def stream(df: DataFrame, name: str, per: int, offset: int) -> DataFrame:
        d = top_k(df, [group], [F.col(order)], 1).orderBy(order).limit(page)
        w = Window.orderBy(order)  # at most one page of rows
        d = d.withColumn("__r", F.row_number().over(w) - 1)
        slot = F.floor(F.col("__r") / per) * (ratio + 1) + F.col("__r") % per + offset
        return d.withColumn("slot", slot.cast("long")).withColumn("stream", F.lit(name)).drop("__r")

    both = stream(focused, "focused", ratio, 0).unionByName(stream(uniform, "uniform", 1, ratio))
    both = top_k(both, [group], [F.col("slot")], 1)
    return both.orderBy("slot").limit(page)


def allocate(strata: DataFrame, total: Column, key: str, weight: str, room: str, groups: Sequence[str] = ()) -> DataFrame:
    """``strata`` with ``share``: whole parts of ``total`` (one value per group) in proportion to the weights, none above its
    room.

    A round gives every stratum with room the whole part of its due, as far as it has room; what is left over goes in ones
    to the largest remainders that still have room (ties by key). What full strata could not take is due anew in the next
    round. One row per stratum: the rounds run over a small table, and each but the last fills a stratum.
    """
    g, keep = list(groups), strata.columns
    w = Window.partitionBy(*g)
    d = strata.withColumns({"share": F.lit(0).cast("long"), "__left": total.cast("long")})
    while True:
        room_left = F.col(room) - F.col("share")
        d = d.withColumn("__open", (F.col("__left") > 0) & (F.coalesce(F.col(weight), F.lit(0)) > 0) & (F.coalesce(room_left, F.lit(0)) > 0))
        if d.where("__open").isEmpty():
            return d.select(*keep, "share")
        mass = F.sum(F.when(F.col("__open"), F.col(weight).cast("double"))).over(w)
        d = d.withColumn("__due", F.when(F.col("__open"), F.col("__left") * F.col(weight).cast("double") / mass))
        d = d.withColumn("__whole", F.when(F.col("__open"), F.least(F.floor("__due"), room_left)).otherwise(0).cast("long"))
        d = d.withColumn("__spare", F.col("__left") - F.sum("__whole").over(w))
        takes = F.col("__open") & (room_left > F.col("__whole"))
        order = Window.partitionBy(*g).orderBy(takes.desc(), (F.floor("__due") - F.col("__due")), F.col(key).cast("string"))
        one = F.when(takes & (F.row_number().over(order) <= F.col("__spare")), 1).otherwise(0)
        d = d.withColumn("__got", F.col("__whole") + one)
        d = d.withColumn("__left", F.col("__left") - F.sum("__got").over(w)).withColumn("share", F.col("share") + F.col("__got"))
        d = cut_lineage(d.select(*keep, "share", "__left"))


def probability_sample(units: DataFrame, stratum: str, unit: Sequence[str], node: Sequence[str], n_per_stratum: dict, seed: int = 0) -> DataFrame:
    """Draw units (clip windows) per stratum and one node of each, with the exact inclusion probability ``pi = n / N / m``.

    A draw is the hash rank of the unit in its stratum, so the sample is uniform and repeatable.
    """
    spark = units.sparkSession
    alloc = spark.createDataFrame([(str(k), int(v)) for k, v in n_per_stratum.items()], f"{stratum} string, n_draw int")
    key_u = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in unit])
    key_n = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in (*unit, *node)])
    pick = F.min_by(F.struct(*node), F.sha1(key_n))
    u = units.groupBy(stratum, *unit).agg(F.count("*").alias("m"), pick.alias("__n"))
    big_n = u.groupBy(stratum).agg(F.count("*").alias("frame_units"))
    # Allocation and unit counts: one row per stratum.
    u = u.join(F.broadcast(alloc), stratum).join(small_side(big_n), stratum)
    limit = max([int(v) for v in n_per_stratum.values()] + [1])
    d = top_k(u.withColumn("__h", F.sha1(key_u)), [stratum], [F.col("__h")], limit, out="draw").where("draw <= n_draw")
    n = F.least("n_draw", "frame_units")
    return d.withColumn("pi", n / F.col("frame_units") / F.col("m")).select(stratum, *unit, "__n.*", "m", "frame_units", "pi", "draw")


#: Gaps in one stretch of the time line.
STRETCH = 64


def _settled(pdf: pd.DataFrame, frame: str, by: list[str], up: list[bool], home: int) -> pd.DataFrame:
    """What a stretch can settle by itself: an undecided row that comes before all undecided rows within its gap is taken,
    one within the gap of a taken row is dropped, until nothing changes. Rows beyond the stretch are only looked at."""
    d = pdf.sort_values(by, ascending=up, kind="stable").reset_index(drop=True)
    d["__rank"] = np.arange(len(d))
    d = d.sort_values(frame, kind="stable").reset_index(drop=True)
    at, gap, rank = d[frame].to_numpy(), d["__reach"].to_numpy(), d["__rank"].to_numpy()
    state, own = d["__state"].to_numpy().copy(), (d["__home"] == home).to_numpy()
    low, high = np.searchsorted(at, at - gap, side="right"), np.searchsorted(at, at + gap, side="left")
    changed = True
    while changed:
        changed = False
        for i in np.flatnonzero((state == 0) & own):
            near = state[low[i] : high[i]]
            if (near == 1).any():
                state[i], changed = -1, True
            elif not ((near == 0) & (rank[low[i] : high[i]] < rank[i])).any():
                state[i], changed = 1, True
    d["__state"] = state
    return d[own & (state >= 0)].drop(columns="__rank")


def spaced(rows: DataFrame, clip: str | Sequence[str], frame: str, order: Sequence[tuple[str, bool]], gap: int | Column, top: int | None = None) -> DataFrame:
    """Best rows first, skipping any closer than ``gap`` frames to one already taken in the clip.

    Rows of one frame are first reduced to the best one, which cannot change the result. Taking the best row first is the
    same as taking, at once, every row that comes before all undecided rows within its gap: the time line is cut in
    stretches of ``STRETCH`` gaps, each settles what it can with the rows of a gap on either side, and rounds go on until
    the chains across its ends are settled too. So a long clip is spread over many tasks and no pass runs over all of it.
    ``gap`` may be a column that is constant in a clip; frames are whole numbers.
    """
    cols, keys = rows.columns, [clip] if isinstance(clip, str) else list(clip)
    by, up = [c for c, _ in order], [a for _, a in order]
    if frame not in by:
        by, up = [*by, frame], [*up, True]
    rank = F.struct(*[F.col(c) if asc else -F.col(c) for c, asc in zip(by, up, strict=True)])
    rest = [c for c in cols if c not in (*keys, frame)]
    best = rows.groupBy(*keys, frame).agg(F.min_by(F.struct(*rest), rank).alias("__r")).select(*keys, frame, "__r.*").select(*cols)
    wide = F.lit(gap) if isinstance(gap, int) else gap
    best = cut_lineage(best.withColumn("__reach", wide.cast("long")))
    size = F.greatest(F.col("__reach"), F.lit(1)) * STRETCH
    at = F.floor(F.col(frame) / size)
    d = best.select(*keys, *[c for c in dict.fromkeys([frame, *by])], "__reach").withColumn("__home", at).withColumn("__state", F.lit(0))
    names, schema, last = d.columns, d.schema, len(keys)

    def settle(part: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _settled(pdf, frame, by, up, part[last])[names]

    while True:
        seen = F.array_distinct(F.array("__home", F.floor((F.col(frame) - F.col("__reach")) / size), F.floor((F.col(frame) + F.col("__reach")) / size)))
        parts = d.withColumn("__part", F.explode(seen)).groupBy(*keys, "__part")
        d = cut_lineage(parts.applyInPandas(settle, schema))
        if d.where("__state = 0").isEmpty():
            break
    out = best.drop("__reach").join(d.select(*keys, frame), [*keys, frame], "left_semi")
    if not top:
        return out
    return out.orderBy(*[F.col(c).asc() if a else F.col(c).desc() for c, a in zip(by, up, strict=True)]).limit(top)


def evenly_spread(place: Column, n: int, total: int) -> Column:
    """Whether the 0-based ``place`` is the middle of one of ``n`` equal stretches of ``total`` ordered items.

    Stretches are at least one item long, so their middles differ; a place can only be the middle of the stretch it
    lies in or of the next.
    """
    if n > total:
        raise ValueError(f"asked for {n} of {total}")
    if n == 0:
        return F.lit(False)
    width = total / n
    at = F.floor(place / F.lit(width))
    hit = F.lit(False)
    for i in (at - 1, at, at + 1):
        hit = hit | ((i >= 0) & (i < n) & (F.floor(i * F.lit(width) + F.lit(width / 2)) == place))
    return hit


def even_holdout(items: DataFrame, name: str, share: float) -> DataFrame:
    """Items at evenly spread positions of the name order (numbered by range partitioning)."""
    from matchgrid.operators.ordered import global_rank

    r = global_rank(items.select(name).distinct(), [(name, True)], "__p")
    total = r.count()
    return r.where(evenly_spread(F.col("__p") - 1, int(total * share), total)).select(name)


def hard_negatives(pool: DataFrame, clip: str, frame: str, score: str, cell: float = 0.05, per: int = 2, tie: Sequence[str] = ()) -> DataFrame:
    """Best-scored nodes first, at most ``per`` in a location cell of a clip."""
    d = pool.withColumn("gx", F.floor(F.col("x") / cell).cast("long")).withColumn("gy", F.floor(F.col("y") / cell).cast("long"))
    return top_k(d, [clip, "gx", "gy"], [F.desc(score), F.col(frame), *[F.col(c) for c in tie]], per, out="place")


def panel_windows(segments: DataFrame, clip: str, n_frames: str, fps: float, frames: int = 5) -> DataFrame:
    """Disjoint windows of ``frames`` samples, ``gap`` frames apart; the last frame of a clip is not used."""
    gap = frames * max(1, round(0.2 * fps / frames))
    span = gap * (frames - 1) + 1
    d = segments.withColumn("__n", F.floor((F.col(n_frames) - 1 - span) / (gap * frames)) + 1)
    d = d.where("__n > 0").withColumn("win", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    start = F.col("win") * gap * frames
    return d.select(clip, "win", start.alias("start"), (start + span - 1).alias("end"), F.lit(gap).alias("gap"))


def hash_audit(rows: DataFrame, key: Column, modulus: int = 10) -> DataFrame:
    """Deterministic one-in-ten audit by hash."""
    return rows.withColumn("audit", ids.sha1_mod(key, modulus) == 0)


def strata_audit(rows: DataFrame, keys: Sequence[str], frame: str, share: float, seed: int = 0) -> DataFrame:
    """One row from each contiguous stratum of a window: about ``share`` of its rows, at least one."""
    keys = list(keys)
    n = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*keys).orderBy(frame)  # a review window is a few hundred frames
    d = rows.withColumn("__i", F.row_number().over(w) - 1).join(n, keys)
    m = F.least(F.col("__n"), F.greatest(F.lit(1), F.bround(F.col("__n") * share))).cast("long")
    d = d.withColumn("stratum", F.floor(F.col("__i") * m / F.col("__n")).cast("long"))
    h = F.sha1(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col(frame).cast("string")))
    return d.groupBy(*keys, "stratum").agg(F.min_by(frame, h).alias(frame))


def redeal(items: DataFrame, keys: Sequence[str], bucket: str, slot: str, rank: Column) -> DataFrame:
    """Deal the items of a bucket, best rank first, into the slots the bucket already holds."""
    keys = list(keys)
    ws = Window.partitionBy(*keys, bucket).orderBy(slot)
    wr = Window.partitionBy(*keys, bucket).orderBy(rank)
    slots = items.select(*keys, bucket, F.col(slot).alias("new_slot"), F.row_number().over(ws).alias("__i"))
    ranked = items.withColumn("__i", F.row_number().over(wr))
    return ranked.join(slots, [*keys, bucket, "__i"]).drop("__i")


def queue(cands: DataFrame, gold: DataFrame, complete: DataFrame, keys: Sequence[str], score: Column, top: int, legal: Column) -> tuple[DataFrame, DataFrame]:
    """Best candidates that may be asked for, and the number rejected by the first failing rule."""
    from matchgrid.operators.aggs import flag_in

    d = flag_in(flag_in(cands, gold, keys, "__gold"), complete, keys, "__done")
    why = F.when(~legal, "not_train").when(F.col("__gold"), "already_gold").when(F.col("__done"), "complete_window")
    d = d.withColumn("why", why).withColumn("score", score)
    items = d.where("why IS NULL").drop("why", "__gold", "__done").orderBy(F.desc("score"), *keys).limit(top)
    return items, d.where("why IS NOT NULL").groupBy("why").agg(F.count("*").alias("n"))


def diverse_representatives(pool: DataFrame, features: Sequence[str], rank: Sequence[Column], k: int, seed: int = 7) -> DataFrame:
    """K-means over the features; the best-ranked row of each cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    d = VectorAssembler(inputCols=list(features), outputCol="__f").transform(pool)
    m = KMeans(k=k, seed=seed, featuresCol="__f", predictionCol="cluster", maxIter=10).fit(d)
    return top_k(m.transform(d).drop("__f"), ["cluster"], rank, 1)


def event_groups(cands: DataFrame, clip: str, span_frames: int = 3, dist: float = 0.03) -> DataFrame:
    """Event of each candidate, ``clip:n`` with n from 0 in order of the events' first candidates.

    Columns ``frame, x, y, cand``; ``cand`` is unique in its frame. A candidate belongs to the event of the earliest one
    before it (by frame, then ``cand``) that is at most ``span_frames`` frames away and nearer than ``dist`` in x and in y;
    without such a one, or without a place, it begins an event. So every candidate has one parent, found by a join on
    cells of place and time, and its event is the root above it. Of candidates on exactly the same spot of a frame only the first
    can be a parent. A long clip is spread over all tasks.
    """
    from matchgrid.operators.graph import roots
    from matchgrid.operators.ordered import Running, along

    def cells(name: str, lo: Column, hi: Column, width: float) -> Column:
        return F.explode(F.sequence(F.floor(lo / width).cast("long"), F.floor(hi / width).cast("long"))).alias(name)

    # Cells are twice as wide as the reach, so a candidate looks into one or two of them on each axis.
    wide = 2 * dist
    firsts = cands.groupBy(clip, "frame", "x", "y").agg(F.min("cand").alias("cand"))
    firsts = firsts.select(clip, F.struct("frame", "cand").alias("parent"), F.col("x").alias("px"), F.col("y").alias("py"),
                           F.floor(F.col("frame") / (span_frames + 1)).cast("long").alias("ct"),
                           *[F.floor(F.col(v) / wide).cast("long").alias(f"c{v}") for v in "xy"])
    seek = cands.select(clip, F.struct("frame", "cand").alias("node"), "x", "y", cells("ct", F.col("frame") - span_frames, F.col("frame"), span_frames + 1))
    for v in "xy":
        seek = seek.select("*", cells(f"c{v}", F.col(v) - dist, F.col(v) + dist, wide))
    near = (F.abs(F.col("x") - F.col("px")) < dist) & (F.abs(F.col("y") - F.col("py")) < dist)
    before = (F.col("parent") < F.col("node")) & (F.col("node.frame") - F.col("parent.frame") <= span_frames)
    links = seek.join(firsts, [clip, "ct", "cx", "cy"]).where(near & before).groupBy(clip, "node").agg(F.min("parent").alias("parent"))
    d = cands.withColumn("node", F.struct("frame", "cand")).join(roots(links, [clip], "node", "parent"), [clip, "node"], "left")
    d = d.withColumn("parent", F.coalesce("parent", "node")).select(clip, "frame", "cand", "parent")
    begin = d.where((F.col("parent.frame") == F.col("frame")) & (F.col("parent.cand") == F.col("cand"))).select(clip, "frame", "cand")
    begin = along(begin, [clip], ["frame", "cand"], [Running("n", F.lit(1).cast("long"), inclusive=False)])
    begin = begin.select(clip, F.struct("frame", "cand").alias("parent"), F.concat_ws(":", clip, F.col("n").cast("string")).alias("event"))
    return d.join(begin, [clip, "parent"]).drop("parent")
