"""Ingest of label sources: parse, replace per clip, resolve, and report whether anything changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchgrid.operators import maintain, snapshots, windows


def changed(before: DataFrame, after: DataFrame, cols: list[str]) -> DataFrame:
    """One row: fingerprints before and after, and whether the table is unchanged."""
    a = maintain.fingerprint(before, cols).withColumn("side", F.lit("before"))
    both = a.unionByName(maintain.fingerprint(after, cols).withColumn("side", F.lit("after")))
    aggs = []
    for side in ("before", "after"):
        here = F.col("side") == side
        aggs += [F.max(F.when(here, F.col("n"))).alias(f"rows_{side}"), F.max(F.when(here, F.concat_ws(":", "n", "hi", "lo"))).alias(f"fp_{side}")]
    return both.agg(*aggs).withColumn("unchanged", F.col("fp_before") == F.col("fp_after"))


def ingest_states(base: DataFrame, batch: DataFrame, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """New state table after a precedence upsert, and its change report. A second run reports ``unchanged``."""
    new = maintain.upsert_label_states(base, batch, seq)
    return new, changed(base, new, base.columns)


def bump(current: DataFrame, parent: DataFrame | None, version: int) -> tuple[DataFrame, DataFrame]:
    """Items of the next version with ``first_version`` carried over, and the counts of the diff."""
    if parent is None:
        return current.withColumn("first_version", F.lit(version)), current.agg(F.count("*").alias("added"))
    items = windows.first_version(current, parent, version)
    d = snapshots.diff_items(current, parent).groupBy("change", "split").agg(F.count("*").alias("n"))
    return items, d
