"""Window operators: latest rows, gaps and islands, ranks, carried values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.operators import ordered


def latest_result(results: DataFrame, keys: Sequence[str], cohort: str, order: Sequence[Column]) -> DataFrame:
    """Latest result per key; a null cohort is a cohort of its own."""
    w = Window.partitionBy(*keys, F.coalesce(F.col(cohort).cast("string"), F.lit("-1"))).orderBy(*order)
    return results.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def _changed(name: str):
    return lambda row, prev: ~row[name].eqNullSafe(prev[name])


def runs(df: DataFrame, keys: Sequence[str], t: str, value: str, aggs: Sequence[Column] = (), span: int = ordered.SPAN) -> DataFrame:
    """Run-length encoding: maximal runs of equal ``value`` along ``t``."""
    d = ordered.with_islands(df, keys, [t], _changed(value), [value], "run_no", span=span)
    return d.groupBy(*keys, "run_no", value).agg(
        F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("n"), *aggs
    )


def smooth_mask(
    df: DataFrame, keys: Sequence[str], t: str, mask: str, merge_gap: int, min_len: int, span: int = ordered.SPAN
) -> DataFrame:
    """On-segments of a boolean mask: bridge off-gaps up to ``merge_gap`` frames, drop segments shorter than
    ``min_len``. Ends are inclusive.

    Only on-frames are numbered: a new segment starts where the step to the previous on-frame is too long.
    """
    on = df.where(F.col(mask)).select(*keys, t)
    seg = ordered.with_islands(on, keys, [t], lambda r, p: (r[t] - p[t] - 1) > merge_gap, [t], "seg_no", span=span)
    out = seg.groupBy(*keys, "seg_no").agg(F.min(t).alias("start"), F.max(t).alias("end"))
    return out.where(F.col("end") - F.col("start") + 1 >= min_len).drop("seg_no")


def run_neighbours(run_df: DataFrame, keys: Sequence[str], value: str, bad: Column, span: int = ordered.SPAN) -> DataFrame:
    """For each run: start of the next and of the previous run that satisfies ``bad``, not counting itself."""
    mark = F.when(bad, F.col("start"))
    specs = [ordered.Known("next_start", mark, False, False), ordered.Known("prev_start", mark, True, False)]
    return ordered.along(run_df, keys, ["start"], specs, span=span)


def flicker_runs(run_df: DataFrame, keys: Sequence[str], value: str, max_run: int = 2, span: int = ordered.SPAN) -> DataFrame:
    """Short runs between two runs of the same value."""
    specs = [ordered.Prev("before", [value]), ordered.Prev("after", [value], False)]
    d = ordered.along(run_df, keys, ["start"], specs, span=span)
    same = F.col("before").isNotNull() & F.col("after").isNotNull() & F.col(f"before.{value}").eqNullSafe(F.col(f"after.{value}"))
    return d.withColumn("flicker", same & (F.col("n") <= max_run)).drop("before", "after")


def change_points(df: DataFrame, keys: Sequence[str], t: str, value: str, span: int = ordered.SPAN) -> DataFrame:
    d = ordered.with_neighbour(df, keys, [t], [value], "prev", span=span)
    return d.where(F.col("prev").isNotNull() & (F.col(f"prev.{value}") != F.col(value))).drop("prev")


def rolling_outlier(df: DataFrame, keys: Sequence[str], t: str, value: str, reach: int = 5, span: int = ordered.SPAN) -> DataFrame:
    """``median`` of the up to ``reach`` neighbours on either side (self excluded), rounded half to even.

    Neighbours over a chunk edge are supplied by sending the edge rows to the next chunk as well, so no
    window holds more than one chunk of a key.
    """
    keys = list(keys)
    # Dense positions are needed for "the 5 rows before": number the rows first.
    d = ordered.with_running(df, keys, [t], F.lit(1).cast("long"), "__pos", span=span)
    ch = F.floor(F.col("__pos") / span).cast("long")
    lo = F.floor((F.col("__pos") - reach) / span).cast("long")
    hi = F.floor((F.col("__pos") + reach) / span).cast("long")
    d = d.withColumn("__home", ch).withColumn("__c", F.explode(F.array_distinct(F.array(lo, ch, hi))))
    w = Window.partitionBy(*keys, "__c").orderBy("__pos")
    before = F.collect_list(value).over(w.rowsBetween(-reach, -1))
    after = F.collect_list(value).over(w.rowsBetween(1, reach))
    d = d.withColumn("__nb", F.array_sort(F.concat(before, after))).where("__home = __c")
    n = F.size("__nb")
    mid = (n / 2).cast("int")
    med = F.when(n % 2 == 1, F.get("__nb", mid).cast("double")).otherwise((F.get("__nb", mid - 1) + F.get("__nb", mid)) / 2.0)
    d = d.withColumn("median", F.when(n > 0, F.bround(med).cast("long")))
    return d.drop("__pos", "__home", "__c", "__nb")


def gap_interpolate(
    df: DataFrame, keys: Sequence[str], t: str, accepted: Column, cols: Sequence[str], max_gap: int, span: int = ordered.SPAN
) -> DataFrame:
    """Fill rows between two accepted samples at most ``max_gap`` frames apart, linearly in time.

    Adds ``origin`` (``detected``, ``interpolated``, ``none``), ``gap_left``, ``gap_right`` and ``<col>_i``.
    """
    val = F.when(accepted, F.struct(t, *cols))
    d = df.withColumn("__acc", accepted)
    d = ordered.along(d, keys, [t], [ordered.Known("__p", val), ordered.Known("__n", val, False)], span=span)
    gap = F.col(f"__n.{t}") - F.col(f"__p.{t}")
    inside = ~F.col("__acc") & F.col("__p").isNotNull() & F.col("__n").isNotNull() & (gap <= max_gap)
    frac = (F.col(t) - F.col(f"__p.{t}")) / gap
    for c in cols:
        v = F.col(f"__p.{c}") + (F.col(f"__n.{c}") - F.col(f"__p.{c}")) * frac
        d = d.withColumn(f"{c}_i", F.when(F.col("__acc"), F.col(c)).when(inside, v))
    d = d.withColumn("origin", F.when(F.col("__acc"), "detected").when(inside, "interpolated").otherwise("none"))
    d = d.withColumn("gap_left", F.when(inside, F.col(t) - F.col(f"__p.{t}"))).withColumn(
        "gap_right", F.when(inside, F.col(f"__n.{t}") - F.col(t))
    )
    return d.drop("__p", "__n", "__acc")


def rank_in_frame(df: DataFrame, frame_keys: Sequence[str], score: str, out: str = "frame_rank") -> DataFrame:
    """Number of strictly higher scores in the frame.

    Equal scores are one row before the window, so the window holds distinct scores only.
    """
    keys = list(frame_keys)
    g = df.groupBy(*keys, score).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn(out, F.coalesce(F.sum("__n").over(w), F.lit(0)).cast("long")).drop("__n")
    return df.join(g, [*keys, score], "left")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str | None = None) -> DataFrame:
    """First ``k`` rows per key; the limit also runs before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn(out or "__rn", F.row_number().over(w)).where(F.col(out or "__rn") <= k)
    return d if out else d.drop("__rn")


def track_support(df: DataFrame, keys: Sequence[str], t: str, track: str, weight: Column, out: str, span: int = ordered.SPAN) -> DataFrame:
    """Sum of ``weight`` over the run of equal track id around each row."""
    d = ordered.with_islands(df, keys, [t], _changed(track), [track], "__run", span=span)
    s = d.groupBy(*keys, "__run").agg(F.sum(weight).alias(out))
    return d.join(s, [*keys, "__run"], "left").drop("__run")


def static_cells(df: DataFrame, keys: Sequence[str], frame: str, x: str, y: str, cell: float, min_frames: int) -> DataFrame:
    """Flag rows whose location cell is occupied in at least ``min_frames`` distinct frames of the clip."""
    d = df.withColumn("__gx", F.floor(F.col(x) / cell)).withColumn("__gy", F.floor(F.col(y) / cell))
    g = d.select(*keys, "__gx", "__gy", frame).distinct().groupBy(*keys, "__gx", "__gy").agg(F.count("*").alias("__n"))
    g = g.where(F.col("__n") >= min_frames).withColumn("static", F.lit(True)).drop("__n")
    return (
        d.join(g, [*keys, "__gx", "__gy"], "left")
        .withColumn("static", F.coalesce("static", F.lit(False)))
        .drop("__gx", "__gy")
    )


def longest_streak(df: DataFrame, keys: Sequence[str], t: str, ok: str, span: int = ordered.SPAN) -> DataFrame:
    """Longest run of rows with ``ok`` per key (0 when there is none)."""
    r = runs(df, keys, t, ok, span=span)
    return r.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col(ok), F.col("n"))), F.lit(0)).alias("streak"))


def tile_timeline(spans: DataFrame, keys: Sequence[str], start: str, end: str, total: str, span: int = ordered.SPAN) -> DataFrame:
    """Tracked and skipped stretches that cover ``[0, total)``.

    Overlapping spans are cut at the furthest end so far; the holes between them become ``skipped``.
    """
    keys = list(keys)
    d = spans.where(F.col(end) > F.col(start))
    d = ordered.along(d, keys, [start, end], [ordered.Running("__top", F.col(end), "max", inclusive=False)], span=span)
    cursor = F.coalesce(F.col("__top"), F.lit(0))
    d = d.withColumn("__cur", cursor).withColumn("__from", F.greatest(F.col(start), F.col("__cur")))
    tracked = d.where(F.col(end) > F.col("__from")).select(*keys, F.col("__from").alias("lo"), F.col(end).alias("hi"), F.lit("tracked").alias("kind"))
    hole = d.where(F.col(start) > F.col("__cur")).select(*keys, F.col("__cur").alias("lo"), F.col(start).alias("hi"), F.lit("skipped").alias("kind"))
    tail = (
        spans.groupBy(*keys)
        .agg(F.max(end).alias("lo"), F.max(total).alias("hi"))
        .where(F.col("hi") > F.col("lo"))
        .select(*keys, "lo", "hi", F.lit("skipped").alias("kind"))
    )
    return tracked.unionByName(hole).unionByName(tail)


def first_version(items: DataFrame, parent: DataFrame, version: int) -> DataFrame:
    """Carry ``first_version`` of items already in the parent; new and returning items start at ``version``."""
    p = parent.select("item_id", F.col("first_version").alias("__fv"))
    return items.join(p, "item_id", "left").withColumn("first_version", F.coalesce("__fv", F.lit(version))).drop("__fv")


def bucket_penalty_order(df: DataFrame, keys: Sequence[str], bucket: Column, score: Column, tie: Sequence[str], penalty: float) -> DataFrame:
    """Uncertainty order in which each further row of a time bucket is pushed back by ``penalty``."""
    w = Window.partitionBy(*keys, "__b").orderBy("score", *tie)
    d = df.withColumn("__b", bucket).withColumn("score", score)
    d = d.withColumn("rank_in_bucket", (F.row_number().over(w) - 1).cast("long"))
    return d.withColumn("priority", F.col("score") + penalty * F.col("rank_in_bucket")).drop("__b")


def step_to_neighbours(df: DataFrame, keys: Sequence[str], t: str, x: str, y: str, span: int = ordered.SPAN) -> DataFrame:
    """Largest step to the row one frame before or after (null when there is none)."""
    d = ordered.along(df, keys, [t], [ordered.Prev("p", [t, x, y]), ordered.Prev("q", [t, x, y], False)], span=span)

    def step(n: str) -> Column:
        near = F.abs(F.col(f"{n}.{t}") - F.col(t)) == 1
        return F.when(near, F.hypot(F.col(f"{n}.{x}") - F.col(x), F.col(f"{n}.{y}") - F.col(y)))

    return d.withColumn("max_step", F.greatest(step("p"), step("q"))).drop("p", "q")
