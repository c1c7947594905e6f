"""Append-only logs: the latest line of a key wins, a null verdict takes the key back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERDICT_KEY = ("game_id", "vsource", "frame_index", "box_index")


def latest_per_key(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key. ``max_by`` is combined map-side, so a hot key never gathers its history."""
    rest = [c for c in log.columns if c not in keys]
    return (
        log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last")).select(*keys, "__last.*")
    )


def latest_verdicts(log: DataFrame, keys: Sequence[str] = VERDICT_KEY, order: Sequence[str] = ("ts", "line_no")) -> DataFrame:
    """Live verdicts: the latest line per key, unless it is a tombstone."""
    return latest_per_key(log, keys, order).where("verdict IS NOT NULL")


def latest_pair_labels(log: DataFrame, a: Sequence[Column], b: Sequence[Column], order: Sequence[str]) -> DataFrame:
    """Latest verdict per unordered pair: the two sides are put in canonical order first."""
    sa, sb = (F.struct(*[c.alias(f"k{i}") for i, c in enumerate(side)]) for side in (a, b))
    d = log.withColumn("lo", F.least(sa, sb)).withColumn("hi", F.greatest(sa, sb))
    return latest_per_key(d, ["lo", "hi"], order).where("verdict IS NOT NULL")
