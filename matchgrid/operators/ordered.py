"""Ordered (per key, per time) calculations that survive one hot key.

A plain ``Window.partitionBy(key).orderBy(t)`` puts a whole key into one task. Every helper here
works in two levels instead: a window inside ``(key, chunk)`` with ``chunk = floor(t / span)``, one
summary row per chunk, a window over those summaries (``span`` times fewer rows) and a join back.
A key with a third of all rows is spread over all its chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.session import cut_lineage

SPAN = 4096
_CH = "__chunk"


def _chunked(df: DataFrame, t: str, span: int, chunk: Column | None) -> DataFrame:
    return df.withColumn(_CH, chunk if chunk is not None else F.floor(F.col(t) / F.lit(span)).cast("long"))


def _order(order: Sequence[str], reverse: bool) -> list[Column]:
    return [F.col(c).desc() if reverse else F.col(c).asc() for c in order]


def _join_back(df: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    # Keys are never null in a stored table, so a plain equi join on (keys, chunk) is enough.
    return df.join(summary, [*keys, _CH], "left")


class Prev(NamedTuple):
    """Struct of ``cols`` of the row before (``back``) or after."""

    out: str
    cols: Sequence[str]
    back: bool = True


class Known(NamedTuple):
    """Last (``back``) or next non-null ``value``, at the row itself when ``inclusive``."""

    out: str
    value: Column
    back: bool = True
    inclusive: bool = True


class Running(NamedTuple):
    """Running ``sum`` or ``max`` of ``value``, up to the row itself when ``inclusive``."""

    out: str
    value: Column
    how: str = "sum"
    inclusive: bool = True


def along(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: Sequence[Prev | Known | Running],
    *,
    span: int = SPAN,
    chunk: Column | None = None,
) -> DataFrame:
    """Add all ``specs`` in one pass: one shuffle of the rows, one summary row per chunk, one join back."""
    keys, order = list(keys), list(order)
    d = _chunked(df, order[0], span, chunk)
    fwd = Window.partitionBy(*keys, _CH).orderBy(*_order(order, False))
    rev = Window.partitionBy(*keys, _CH).orderBy(*_order(order, True))
    afwd = Window.partitionBy(*keys).orderBy(F.col(_CH).asc())
    arev = Window.partitionBy(*keys).orderBy(F.col(_CH).desc())
    first, unb = Window.unboundedPreceding, Window.unboundedPreceding
    pos = F.struct(*order)
    edges, fars, finals, drops = [], [], [], []
    for i, sp in enumerate(specs):
        v, loc, edge, far = f"__v{i}", f"__l{i}", f"__e{i}", f"__f{i}"
        drops += [v, loc, far]
        if isinstance(sp, Running):
            fn = {"sum": F.sum, "max": F.max}[sp.how]
            d = d.withColumn(v, sp.value).withColumn(loc, fn(v).over(fwd.rowsBetween(first, 0 if sp.inclusive else -1)))
            edges.append(fn(v).alias(edge))
            fars.append(fn(edge).over(afwd.rowsBetween(unb, -1)).alias(far))
            if sp.how == "sum":
                both = F.coalesce(F.col(loc), F.lit(0)) + F.coalesce(F.col(far), F.lit(0))
            else:
                both = F.greatest(loc, far)
        elif isinstance(sp, Prev):
            w, a = (fwd, afwd) if sp.back else (rev, arev)
            pick = F.max_by if sp.back else F.min_by
            d = d.withColumn(v, F.struct(*sp.cols)).withColumn(loc, F.lag(v).over(w))
            edges.append(pick(v, pos).alias(edge))
            fars.append(F.lag(edge).over(a).alias(far))
            both = F.coalesce(loc, far)
        else:
            w, a = (fwd, afwd) if sp.back else (rev, arev)
            pick = F.max_by if sp.back else F.min_by
            frame = w.rowsBetween(first, 0 if sp.inclusive else -1)
            d = d.withColumn(v, sp.value).withColumn(loc, F.last(v, ignorenulls=True).over(frame))
            edges.append(pick(v, F.when(F.col(v).isNotNull(), pos)).alias(edge))
            fars.append(F.last(edge, ignorenulls=True).over(a.rowsBetween(unb, -1)).alias(far))
            both = F.coalesce(loc, far)
        finals.append((sp.out, both))
    summary = d.groupBy(*keys, _CH).agg(*edges).select(*keys, _CH, *fars)
    d = _join_back(d, summary, keys)
    for out, col in finals:
        d = d.withColumn(out, col)
    return d.drop(*drops, _CH)


def with_neighbour(df, keys, order, cols, out, *, back=True, span: int = SPAN, chunk: Column | None = None) -> DataFrame:
    return along(df, keys, order, [Prev(out, cols, back)], span=span, chunk=chunk)


def with_known(df, keys, order, value, out, *, back=True, inclusive=True, span: int = SPAN, chunk: Column | None = None) -> DataFrame:
    return along(df, keys, order, [Known(out, value, back, inclusive)], span=span, chunk=chunk)


def with_running(df, keys, order, value, out, *, how="sum", span: int = SPAN, chunk: Column | None = None) -> DataFrame:
    return along(df, keys, order, [Running(out, value, how)], span=span, chunk=chunk)


def with_islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    starts_new: Callable[[Column, Column], Column],
    cols: Sequence[str],
    out: str = "island",
    *,
    span: int = SPAN,
    chunk: Column | None = None,
) -> DataFrame:
    """Number the runs of a key from 1. ``starts_new(row, previous)`` gets two structs with ``cols``.

    One shuffle of the rows: breaks are counted inside a chunk, and the summary of a chunk (first row,
    last row, number of breaks) settles the break at its edge and its offset.
    """
    keys, order = list(keys), list(order)
    d = _chunked(df, order[0], span, chunk).withColumn("__v", F.struct(*cols))
    local = Window.partitionBy(*keys, _CH).orderBy(*_order(order, False))
    d = d.withColumn("__p", F.lag("__v").over(local))
    inner = F.when(F.col("__p").isNull(), F.lit(0)).when(starts_new(F.col("__v"), F.col("__p")), F.lit(1)).otherwise(F.lit(0))
    d = d.withColumn("__f", inner.cast("long"))
    d = d.withColumn("__cum", F.sum("__f").over(local.rowsBetween(Window.unboundedPreceding, 0)))
    pos = F.struct(*order)
    edge = d.groupBy(*keys, _CH).agg(
        F.min_by("__v", pos).alias("__first"), F.max_by("__v", pos).alias("__last"), F.sum("__f").alias("__n")
    )
    across = Window.partitionBy(*keys).orderBy(_CH)
    edge = edge.withColumn("__pl", F.lag("__last").over(across))
    at_edge = F.when(F.col("__pl").isNull(), 1).when(starts_new(F.col("__first"), F.col("__pl")), 1).otherwise(0).cast("long")
    edge = edge.withColumn("__e", at_edge)
    before = F.sum(F.col("__n") + F.col("__e")).over(across.rowsBetween(Window.unboundedPreceding, -1))
    edge = edge.select(*keys, _CH, (F.coalesce(before, F.lit(0)) + F.col("__e")).alias("__off"))
    return (
        _join_back(d, edge, keys)
        .withColumn(out, F.col("__off") + F.col("__cum"))
        .drop("__v", "__p", "__f", "__cum", "__off", _CH)
    )


def global_rank(df: DataFrame, order: Sequence[tuple[str, bool]], out: str = "rank", parts: int | None = None) -> DataFrame:
    """1-based position in a total order given as ``(column, ascending)``, without one task holding the table.

    Range partitioning sorts the rows over all tasks; only one count per partition is summed up.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() if asc else F.col(c).desc_nulls_last() for c, asc in order]
    d = df.repartitionByRange(n, *by).sortWithinPartitions(*by)
    d = d.withColumn("__pid", F.spark_partition_id()).withColumn("__mid", F.monotonically_increasing_id())
    # Stored once: the numbering must not change when a lost executor makes Spark repeat the sort.
    d = cut_lineage(d)
    sizes = d.groupBy("__pid").agg(F.count("*").alias("__n"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select("__pid", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    pos = F.col("__mid") - F.shiftleft(F.col("__pid").cast("long"), 33)
    # The offsets hold one row per partition, so their size is bounded by the partition count.
    return (
        d.join(F.broadcast(offs), "__pid").withColumn(out, F.col("__off") + pos + 1).drop("__pid", "__mid", "__off")
    )
