"""Camera calibration as column expressions: lens model, homography, pitch coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchgrid.functions.boxes import c

# Fixed values.
QUALITY_GATE = 0.3
WEIGHT_TOLERANCE = 1e-12
DEFAULT_ASPECT = 16.0 / 9.0
PITCH_LENGTH, PITCH_WIDTH = 105.0, 68.0


def _radius2(x, y, aspect) -> Column:
    dx = (c(x) - 0.5) * 2.0
    dy = (c(y) - 0.5) * 2.0 / (F.lit(aspect) if isinstance(aspect, float) else c(aspect))
    return dx * dx + dy * dy


def undistort(x, y, k1, aspect=DEFAULT_ASPECT) -> tuple[Column, Column]:
    """Observed image point to the straight-line image point (division model, closed form)."""
    s = F.lit(1.0) + c(k1) * _radius2(x, y, aspect)
    flat = c(k1) == 0
    return (
        F.when(flat, c(x)).otherwise(F.lit(0.5) + (c(x) - 0.5) / s),
        F.when(flat, c(y)).otherwise(F.lit(0.5) + (c(y) - 0.5) / s),
    )


def distort(x, y, k1, aspect=DEFAULT_ASPECT) -> tuple[Column, Column]:
    """Inverse of :func:`undistort`; NaN where the lens model has no real root."""
    disc = F.lit(1.0) - 4.0 * c(k1) * _radius2(x, y, aspect)
    f = F.when(disc >= 0, F.lit(2.0) / (F.lit(1.0) + F.sqrt(disc))).otherwise(F.lit(float("nan")))
    return F.lit(0.5) + (c(x) - 0.5) * f, F.lit(0.5) + (c(y) - 0.5) * f


def h_cells(h="H") -> list[Column]:
    return [F.element_at(c(h), i) for i in range(1, 10)]


def apply_homography(h: list[Column], x, y) -> tuple[Column, Column, Column]:
    x, y = c(x), c(y)
    return h[0] * x + h[1] * y + h[2], h[3] * x + h[4] * y + h[5], h[6] * x + h[7] * y + h[8]


def invert_homography(h: list[Column]) -> list[Column]:
    """Adjugate of the 3 x 3 matrix: the inverse up to scale, which is all a projective map needs."""
    a, b, d, e, f, g, i, j, k = h
    return [
        f * k - g * j, d * j - b * k, b * g - d * f,
        g * i - e * k, a * k - d * i, d * e - a * g,
        e * j - f * i, b * i - a * j, a * f - b * e,
    ]


def projection_status(has_h: Column, quality, weight: Column, gate: float = QUALITY_GATE) -> Column:
    q = c(quality)
    return (
        F.when(~has_h, F.lit("no_calibration"))
        .when(q.isNull() | (q < gate), F.lit("low_quality"))
        .when(F.abs(weight) < WEIGHT_TOLERANCE, F.lit("degenerate"))
        .otherwise(F.lit("ok"))
    )


def guarded(status: Column, value: Column) -> Column:
    """Value when ok, null without a calibration, NaN when a calibration exists but cannot be used."""
    return F.when(status == "ok", value).when(status == "no_calibration", F.lit(None).cast("double")).otherwise(
        F.lit(float("nan"))
    )


def pitch_to_image(h: list[Column], px, py, k1, aspect=DEFAULT_ASPECT) -> tuple[Column, Column]:
    ix, iy, iw = apply_homography(invert_homography(h), px, py)
    ux = F.when(iw != 0, ix / iw)
    uy = F.when(iw != 0, iy / iw)
    dx, dy = distort(ux, uy, k1, aspect)
    flat = c(k1) == 0
    return F.when(flat, ux).otherwise(dx), F.when(flat, uy).otherwise(dy)
