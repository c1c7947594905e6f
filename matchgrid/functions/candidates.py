"""Scores of ball candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchgrid.functions.boxes import c


def gap_plausibility(left, right, run) -> Column:
    """Chance that an interpolated point is right: the anchors' geometric mean, less for longer gaps."""
    mean = F.sqrt(F.greatest(c(left), F.lit(0.0)) * F.greatest(c(right), F.lit(0.0)))
    return F.least(F.lit(1.0), mean * F.pow(F.lit(0.85), F.greatest(c(run) - 1, F.lit(0)).cast("double")))


def suggestion_score(conf, dist_px, sigma, bonus=None) -> Column:
    """Log confidence (floored at 0.05) minus the squared distance to the predicted place."""
    s = F.ln(F.greatest(c(conf), F.lit(0.05)))
    d, sg = c(dist_px), c(sigma)
    s = s - F.when(d.isNotNull(), d * d / (2.0 * sg * sg)).otherwise(F.lit(0.0))
    return s if bonus is None else s + bonus


def near_sample(dist, gate: float) -> Column:
    """Is a neighbour sample within ``gate``: null when that sample does not exist (NaN)."""
    return F.when(~F.isnan(c(dist)), c(dist) <= gate)
