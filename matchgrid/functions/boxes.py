"""Box geometry as column expressions. Boxes are normalised top-left ``x, y, w, h``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label groups.
BALL_LABELS = ("ball", "in_play_ball", "out_of_play_ball")
PLAYER_LABELS = ("player", "player_sub", "referee", "coach", "person")


def c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def clip(v, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c(v)))


def intersection(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    ax, ay, aw, ah, bx, by, bw, bh = (c(v) for v in (ax, ay, aw, ah, bx, by, bw, bh))
    iw = F.least(ax + aw, bx + bw) - F.greatest(ax, bx)
    ih = F.least(ay + ah, by + bh) - F.greatest(ay, by)
    zero = F.lit(0.0)
    return F.greatest(iw, zero) * F.greatest(ih, zero)


def iou(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Intersection over union; 0 when the union is empty."""
    aw, ah, bw, bh = c(aw), c(ah), c(bw), c(bh)
    inter = intersection(ax, ay, aw, ah, bx, by, bw, bh)
    union = aw * ah + bw * bh - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def overlap_coefficient(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Intersection over the smaller area; 0 when that area is empty."""
    aw, ah, bw, bh = c(aw), c(ah), c(bw), c(bh)
    smaller = F.least(aw * ah, bw * bh)
    return F.when(smaller > 0, intersection(ax, ay, aw, ah, bx, by, bw, bh) / smaller).otherwise(F.lit(0.0))


def centre_x(x="bbox_x", w="bbox_w") -> Column:
    return c(x) + c(w) / 2.0


def centre_y(y="bbox_y", h="bbox_h") -> Column:
    return c(y) + c(h) / 2.0


def pixel_distance(ax, ay, bx, by, width=1920, height=1080) -> Column:
    return F.hypot((c(ax) - c(bx)) * F.lit(float(width)), (c(ay) - c(by)) * F.lit(float(height)))


def box_radius_px(w, h, width=1920, height=1080) -> Column:
    """Half the diagonal of the box, in pixels."""
    return F.hypot(c(w) * F.lit(float(width)), c(h) * F.lit(float(height))) / 2.0


def anchor_y(label="label", y="bbox_y", h="bbox_h") -> Column:
    """A ball is anchored at its centre, everything else at the bottom of its box."""
    return F.when(c(label).isin(*BALL_LABELS), c(y) + c(h) / 2.0).otherwise(c(y) + c(h))


def to_centre_box(x, y, w, h) -> list[Column]:
    """Training-label form: centre, clamped to the unit square, with the size."""
    return [clip(c(x) + c(w) / 2.0, 0.0, 1.0), clip(c(y) + c(h) / 2.0, 0.0, 1.0), clip(w, 0.0, 1.0), clip(h, 0.0, 1.0)]


def from_centre_box(cx, cy, w, h) -> list[Column]:
    return [clip(c(cx) - c(w) / 2.0, 0.0, 1.0), clip(c(cy) - c(h) / 2.0, 0.0, 1.0), clip(w, 0.0, 1.0), clip(h, 0.0, 1.0)]


def is_ball(label="label") -> Column:
    return F.lower(c(label)).isin(*BALL_LABELS)


def class_group(label="label") -> Column:
    """``ball``, ``player`` or null."""
    return F.when(is_ball(label), F.lit("ball")).when(F.lower(c(label)).isin(*PLAYER_LABELS), F.lit("player"))
