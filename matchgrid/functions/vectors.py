"""Vector codes."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchgrid.functions.boxes import c


def wave_planes(dim: int, bits: int = 8) -> list[list[float]]:
    """Fixed hyperplanes given by a rule, so that every session cuts space alike."""
    return [[math.cos(i * (b + 1) * 0.7 + b) for i in range(dim)] for b in range(bits)]


def lsh_code(vector, planes: list[list[float]]) -> Column:
    """One bit per plane: on which side the vector lies."""
    v = c(vector)

    def side(i: int, plane: list[float]) -> Column:
        p = F.array(*[F.lit(x) for x in plane])
        dot = F.aggregate(F.zip_with(v, p, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
        return F.when(dot > 0, F.lit(1 << i)).otherwise(F.lit(0))

    return reduce(lambda a, b: a + b, [side(i, p) for i, p in enumerate(planes)])
