"""Pair joins of boxes and points inside a frame, pruned by a grid.

The grid is as fine as the frame is crowded (one cell for ordinary frames, finer cells once a frame
holds many boxes), so a frame with very many rows is cut into many small cells and never paired in full.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.functions.boxes import iou

BOXES_PER_CELL = 32


def _grid_size(n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.sqrt(n / F.lit(float(BOXES_PER_CELL))))).cast("int")


def _with_cells(df: DataFrame, box: Sequence[str], extent: tuple[float, float]) -> DataFrame:
    """One row per covered grid cell of ``__g`` x ``__g`` cells over the picture (outside is clamped)."""
    x, y, w, h = (F.col(c) for c in box)

    def cells(lo: Column, hi: Column, size: float) -> Column:
        return F.sequence(_clamped_cell(lo, size), _clamped_cell(hi, size))

    return df.withColumn("__cx", F.explode(cells(x, x + w, extent[0]))).withColumn("__cy", F.explode(cells(y, y + h, extent[1])))


def _clamped_cell(v: Column, size: float) -> Column:
    return F.least(F.greatest(F.floor(v / F.lit(float(size)) * F.col("__g")).cast("int"), F.lit(0)), F.col("__g") - 1)


def box_pairs(
    left: DataFrame,
    right: DataFrame | None,
    frame_keys: Sequence[str],
    left_id: str,
    right_id: str,
    min_iou: float,
    left_cols: Sequence[str] = (),
    right_cols: Sequence[str] = (),
    box: Sequence[str] = ("bbox_x", "bbox_y", "bbox_w", "bbox_h"),
    strict: bool = False,
    extent: tuple[float, float] = (1.0, 1.0),
) -> DataFrame:
    """Overlapping pairs of a frame with ``IoU >= min_iou`` (``>`` when ``strict``) and their ``iou``. ``extent`` is the width
    and height of the picture in the units of the boxes.

    With ``right=None`` it is a self join with ``left_id < right_id`` and the right columns get the
    suffix ``_b``. In crowded frames a pair meeting in several cells is kept only in the cell of its intersection corner.
    """
    keys = list(frame_keys)
    self_join = right is None
    lcols = list(dict.fromkeys([left_id, *left_cols]))
    rcols = list(dict.fromkeys([right_id, *right_cols]))
    if self_join:
        # Both sides are the same rows under two names, so they are shuffled once; the grid follows from a count beside them.
        both = list(dict.fromkeys([*lcols, *rcols]))
        d = left.select(*keys, *both, *[F.col(c).alias(f"__l{i}") for i, c in enumerate(box)])
        d = d.withColumn("__g", _grid_size(F.count("*").over(Window.partitionBy(*keys))))
        lhs = d.select(*keys, *lcols, *[f"__l{i}" for i in range(4)], "__g")
        rhs = d.select(*keys, *[F.col(c).alias(f"{c}_b") for c in rcols], *[F.col(f"__l{i}").alias(f"__r{i}") for i in range(4)], "__g")
    else:
        # Joined, not united: only frames with both sides have pairs, and Spark 4.1.2 counts the partitions of a union of two
        # sides that are already placed by frame differently in the two inputs of a join ("Can't zip RDDs").
        n = left.groupBy(*keys).count().join(right.groupBy(*keys).agg(F.count("*").alias("__m")), keys)
        n = n.select(*keys, _grid_size(F.greatest("count", "__m")).alias("__g"))
        lhs = left.select(*keys, *lcols, *[F.col(c).alias(f"__l{i}") for i, c in enumerate(box)]).join(n, keys)
        rhs = right.select(*keys, *rcols, *[F.col(c).alias(f"__r{i}") for i, c in enumerate(box)]).join(n, keys)
    lb = [F.col(f"__l{i}") for i in range(4)]
    rb = [F.col(f"__r{i}") for i in range(4)]
    corner_x, corner_y = F.greatest(lb[0], rb[0]), F.greatest(lb[1], rb[1])
    test = (corner_x < F.least(lb[0] + lb[2], rb[0] + rb[2])) & (corner_y < F.least(lb[1] + lb[3], rb[1] + rb[3]))
    if self_join:
        test = test & (F.col(left_id) < F.col(f"{right_id}_b"))
    # Ordinary frames are one cell: their rows meet where they lie. Only crowded frames are dealt to cells.
    pairs = lhs.where("__g = 1").drop("__g").join(rhs.where("__g = 1").drop("__g"), keys).where(test)
    cells = _with_cells(lhs.where("__g > 1"), [f"__l{i}" for i in range(4)], extent)
    cells = cells.join(_with_cells(rhs.where("__g > 1"), [f"__r{i}" for i in range(4)], extent).drop("__g"), [*keys, "__cx", "__cy"])
    first = (_clamped_cell(corner_x, extent[0]) == F.col("__cx")) & (_clamped_cell(corner_y, extent[1]) == F.col("__cy"))
    pairs = pairs.unionByName(cells.where(test & first).drop("__g", "__cx", "__cy")).withColumn("iou", iou(*lb, *rb))
    keep = F.col("iou") > min_iou if strict else F.col("iou") >= min_iou
    return pairs.where(keep).drop(*[f"__l{i}" for i in range(4)], *[f"__r{i}" for i in range(4)])


def point_pairs(
    left: DataFrame,
    right: DataFrame,
    frame_keys: Sequence[str],
    left_xy: Sequence[Column],
    right_xy: Sequence[Column],
    radius: float,
    how: str = "inner",
) -> DataFrame:
    """Pairs of a frame closer than or at ``radius`` (in the units of the given coordinates), with ``dist``.

    An ordinary frame's points meet where they lie. In a crowded frame they meet in cells of one radius: a left point is
    sent to its 3 x 3 neighbour cells, a right point to its own.
    """
    keys = list(frame_keys)
    r = F.lit(float(radius))
    n = left.groupBy(*keys).count().join(right.groupBy(*keys).agg(F.count("*").alias("__m")), keys)
    n = n.select(*keys, (F.greatest("count", "__m") > BOXES_PER_CELL).alias("__many"))
    lhs = left.withColumn("__lx", left_xy[0]).withColumn("__ly", left_xy[1]).join(n, keys)
    rhs = right.withColumn("__rx", right_xy[0]).withColumn("__ry", right_xy[1]).join(n, keys)
    pairs = lhs.where("NOT __many").drop("__many").join(rhs.where("NOT __many").drop("__many"), keys)
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    cell = lambda v: F.floor(F.col(v) / r).cast("long")
    lcell = lhs.where("__many").drop("__many").withColumn("__dx", F.explode(near)).withColumn("__dy", F.explode(near))
    lcell = lcell.withColumn("__cx", cell("__lx") + F.col("__dx")).withColumn("__cy", cell("__ly") + F.col("__dy")).drop("__dx", "__dy")
    rcell = rhs.where("__many").drop("__many").withColumn("__cx", cell("__rx")).withColumn("__cy", cell("__ry"))
    pairs = pairs.unionByName(lcell.join(rcell, [*keys, "__cx", "__cy"]).drop("__cx", "__cy"))
    dist = F.hypot(F.col("__lx") - F.col("__rx"), F.col("__ly") - F.col("__ry"))
    return pairs.withColumn("dist", dist).where(F.col("dist") <= r).drop("__lx", "__ly", "__rx", "__ry")
