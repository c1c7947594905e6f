"""Statistics as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchgrid.functions.boxes import c

# Confidence -> precision knots of the detector.
CONFIDENCE_KNOTS = ((0.15, 0.04), (0.55, 0.42), (0.65, 0.79), (0.75, 0.96), (0.85, 0.995))


def ratio(num, den) -> Column:
    """``num / den``, null when the denominator is 0."""
    return F.when(c(den) != 0, c(num).cast("double") / c(den))


def rounded(v, digits: int) -> Column:
    """A number that is not negative, rounded by ``digits``, as SQL engines without decimals do it. ``round`` goes through a decimal
    number per row, at 40 times the cost or so."""
    return F.floor(c(v) * 10.0**digits + 0.5) / 10.0**digits


def f1(p, r) -> Column:
    p, r = c(p), c(r)
    return F.when(p.isNull() | r.isNull(), F.lit(None).cast("double")).when(p + r > 0, 2 * p * r / (p + r)).otherwise(
        F.lit(0.0)
    )


def logit(p, eps: float = 1e-6) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), c(p)))
    return F.ln(q / (F.lit(1.0) - q))


def sigmoid(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c(z)))


def calibrated(p, a, b) -> Column:
    return sigmoid(F.lit(a) * logit(p) + F.lit(b))


def interpolate(x, knots) -> Column:
    """Piecewise linear interpolation, constant outside the knots."""
    x = c(x)
    out = F.when(x <= knots[0][0], F.lit(float(knots[0][1])))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
        out = out.when(x <= x1, F.lit(y0) + (x - x0) * F.lit((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.lit(float(knots[-1][1])))


def confidence_logodds(conf) -> Column:
    import math

    return interpolate(conf, [(x, math.log(p / (1 - p))) for x, p in CONFIDENCE_KNOTS])


def wilson_lower(k, n, z: float = 1.96) -> Column:
    """Lower Wilson bound of a proportion, 0 for an empty sample."""
    k, n = c(k).cast("double"), c(n).cast("double")
    p = k / n
    z2 = z * z
    centre = p + z2 / (2 * n)
    spread = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return F.when(n > 0, F.greatest(F.lit(0.0), (centre - spread) / (1 + z2 / n))).otherwise(F.lit(0.0))


def _lgamma(x: Column) -> Column:
    """Log gamma for x >= 1: the Stirling series after shifting the argument by 8."""
    shift = 8
    prod = reduce(lambda a, i: a + F.ln(x + i), range(1, shift), F.ln(x))
    y = x + shift
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + series - prod


def binomial_tail(k, n, p) -> Column:
    """Exact ``P(X >= k)`` of a binomial, summed over its terms in log space."""
    k, n, p = c(k).cast("long"), c(n).cast("long"), c(p).cast("double")
    nd = n.cast("double")

    def term(i: Column) -> Column:
        d = i.cast("double")
        return F.exp(
            _lgamma(nd + 1) - _lgamma(d + 1) - _lgamma(nd - d + 1) + d * F.ln(p) + (nd - d) * F.ln(F.lit(1.0) - p)
        )

    safe_k = F.when((k > 0) & (k <= n), k).otherwise(n)
    total = F.aggregate(F.sequence(safe_k, n), F.lit(0.0), lambda a, i: a + term(i))
    return (
        F.when(k <= 0, F.lit(1.0))
        .when((k > n) | (p <= 0), F.lit(0.0))
        .when(p >= 1, F.lit(1.0))
        .otherwise(F.least(F.lit(1.0), total))
    )


def clopper_pearson_lower(k, n, alpha: float = 0.1, steps: int = 60) -> Column:
    """One-sided exact lower bound of a proportion, by bisection inside one expression."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def step(a: Column, _i: Column) -> Column:
        mid = (a["lo"] + a["hi"]) / 2
        high = binomial_tail(k, n, mid) > alpha
        return F.struct(
            F.when(high, a["lo"]).otherwise(mid).alias("lo"), F.when(high, mid).otherwise(a["hi"]).alias("hi")
        )

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["lo"]
    return F.when((c(n) <= 0) | (c(k) <= 0), F.lit(0.0)).otherwise(found)


def exact_fps(fps) -> Column:
    """Exact rate of a rounded frame rate: 29.97 is 30000/1001, any other rate stays itself."""
    f = c(fps)
    k = F.bround(f * 1.001)
    ntsc = (k > 0) & (F.abs(f - k / 1.001) < 0.01)
    return F.when(ntsc, k * 1000.0 / 1001.0).otherwise(f)
