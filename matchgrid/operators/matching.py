"""Greedy one-to-one matching of candidate pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchgrid.session import cut_lineage


#: Pairs of the largest group that one task walks in order; larger groups are solved in rounds over all tasks.
WALKED_PAIRS = 1_000_000


class _Walk:
    """Takes pairs in order, each id once. The running state is the ids taken in the current group."""

    def __init__(self, key: tuple):
        self.key, self.lefts, self.rights = key, set(), set()

    def step(self, row):
        left, right = row[-2:]
        if left in self.lefts or right in self.rights:
            return ()
        self.lefts.add(left)
        self.rights.add(right)
        return ((*self.key, left, right),)

    def close(self):
        return ()


def greedy_match(pairs: DataFrame, keys: Sequence[str], left: str, right: str, order: Sequence[tuple[str, bool]]) -> DataFrame:
    """Pairs ``(left, right)`` chosen best first, each id used once per group.

    ``order`` is a total order as ``(column, ascending)``. A group of at most ``WALKED_PAIRS`` pairs is one ordered pass: its
    pairs are shuffled once. Larger groups are solved in rounds (see :func:`_in_rounds`).
    """
    from matchgrid.operators.scan import ordered_scan

    keys = list(keys)
    rank = F.struct(*[(F.col(name) if asc else -F.col(name)).alias(f"o{i}") for i, (name, asc) in enumerate(order)])
    pairs = cut_lineage(pairs.select(*keys, rank.alias("__r"), left, right))
    types = dict(pairs.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in (*keys, left, right))
    large = cut_lineage(pairs.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > WALKED_PAIRS).select(*keys))
    if large.isEmpty():
        return cut_lineage(ordered_scan(pairs, keys, ["__r"], _Walk, schema, sent=[*keys, left, right]))
    walked = ordered_scan(pairs.join(large, keys, "left_anti"), keys, ["__r"], _Walk, schema, sent=[*keys, left, right])
    return cut_lineage(walked.unionByName(_in_rounds(pairs.join(large, keys, "left_semi"), keys, left, right)))


def _in_rounds(pairs: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """The ordered walk over ``__r`` in rounds: a pair that is first for both of its ends is always taken, so all such pairs
    are taken at once and their ends leave; the rest is solved the same way. Each round is a few aggregations over all
    tasks, so the largest group is shared by the cluster."""
    rest = cut_lineage(pairs)
    taken = None
    while not rest.isEmpty():
        first_l = rest.groupBy(*keys, left).agg(F.min("__r").alias("__l"))
        first_r = rest.groupBy(*keys, right).agg(F.min("__r").alias("__q"))
        marked = rest.join(first_l, [*keys, left]).join(first_r, [*keys, right])
        marked = cut_lineage(marked.withColumn("__best", (F.col("__r") == F.col("__l")) & (F.col("__r") == F.col("__q"))).drop("__l", "__q"))
        best = marked.where("__best").select(*keys, left, right)
        taken = best if taken is None else taken.unionByName(best)
        open_ = marked.where("NOT __best").drop("__best").join(best.select(*keys, left), [*keys, left], "left_anti")
        rest = cut_lineage(open_.join(best.select(*keys, right), [*keys, right], "left_anti"))
    return pairs.select(*keys, left, right).limit(0) if taken is None else taken


def score_detections(
    dets: DataFrame, gts: DataFrame, ignore: DataFrame | None, keys: Sequence[str], pairs: DataFrame, ignore_pairs: DataFrame | None
) -> DataFrame:
    """Outcome per detection: ``hit``, ``ignored`` (lands on an ignore region) or ``false``.

    A detection takes the best free ground truth in order of confidence.
    """
    keys = list(keys)
    ranked = pairs.select(*keys, "det_id", "gt_id", "confidence", "fit")
    m = greedy_match(
        ranked, keys, "det_id", "gt_id", [("confidence", False), ("det_id", True), ("fit", False), ("gt_id", True)]
    ).withColumn("__hit", F.lit(True))
    d = dets.join(m, [*keys, "det_id"], "left")
    out = F.when(F.col("__hit"), "hit")
    if ignore_pairs is not None:
        ig = ignore_pairs.select(*keys, "det_id").distinct().withColumn("__ig", F.lit(True))
        d = d.join(ig, [*keys, "det_id"], "left")
        out = out.when(F.col("__ig"), "ignored")
    # Every metric reads the scored detections again: store them once.
    return cut_lineage(d.withColumn("outcome", out.otherwise("false")).drop("__hit", "__ig"))


def running_precision(scored: DataFrame, keys: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Cumulative hits and detections by falling confidence, in two levels over confidence chunks."""
    from matchgrid.operators import ordered

    d = scored.where("outcome <> 'ignored'").withColumn("__neg", -F.col("confidence"))
    d = d.withColumn("__hit", F.when(F.col("outcome") == "hit", 1).otherwise(0).cast("long"))
    chunk = F.floor(F.col("__neg") * 1024).cast("long")
    order = ["__neg", *tie]
    specs = [ordered.Running("tp", F.col("__hit")), ordered.Running("n", F.lit(1).cast("long"))]
    d = ordered.along(d, keys, order, specs, chunk=chunk)
    return d.withColumn("precision", F.col("tp") / F.col("n")).drop("__neg", "__hit")


def average_precision(scored: DataFrame, n_gt: DataFrame, keys: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Interpolated AP on 101 recall points under the precision envelope.

    True positives count up one by one, so the curve has one group of rows per ``tp``. A recall point x lies
    between the groups ``floor(x * n_gt)`` and the next one: the lookup is an equi join on ``tp``.
    """
    from matchgrid.operators import ordered

    keys = list(keys)
    r = running_precision(scored, keys, tie)
    per = r.groupBy(*keys, "tp").agg(F.max("precision").alias("first_p"), F.max_by("precision", "n").alias("last_p"), F.max("precision").alias("best"))
    # Envelope: the best precision at this recall or any higher one.
    per = per.withColumn("__rev", -F.col("tp"))
    best = F.col("best")
    specs = [ordered.Running("env", best, "max"), ordered.Running("later", best, "max", inclusive=False)]
    per = ordered.along(per, keys, ["__rev"], specs)
    last = F.greatest(F.col("last_p"), F.coalesce(F.col("later"), F.lit(0.0)))
    # One row per true positive, read three times below: stored once.
    per = cut_lineage(per.select(*keys, "tp", F.col("env").alias("e_first"), last.alias("e_last")))
    top = per.groupBy(*keys).agg(F.max("tp").alias("tp_max"))
    grid = n_gt.where("n_gt > 0").join(top, keys, "left").withColumn("tp_max", F.coalesce("tp_max", F.lit(-1).cast("long")))
    grid = grid.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(100))))
    t = F.floor(F.col("i") * F.col("n_gt") / 100).cast("long")
    grid = grid.withColumn("tp", F.least(t, F.col("tp_max"))).withColumn("tp_next", F.col("tp") + 1)
    left = per.select(*keys, "tp", "e_last")
    right = per.select(*keys, F.col("tp").alias("tp_next"), "e_first")
    g = grid.join(left, [*keys, "tp"], "left").join(right, [*keys, "tp_next"], "left")
    # The curve starts at (0, 1) and ends at (1, 0).
    x, n = F.col("i") / 100.0, F.col("n_gt")
    y0 = F.coalesce(F.col("e_last"), F.lit(1.0))
    x0 = F.col("tp") / n
    beyond = F.col("tp") >= F.col("tp_max")
    x1 = F.when(beyond, F.lit(1.0)).otherwise(F.col("tp_next") / n)
    y1 = F.when(beyond, F.lit(0.0)).otherwise(F.col("e_first"))
    y = F.when(F.col("i") == 100, F.lit(0.0)).when(x1 > x0, y0 + (y1 - y0) * (x - x0) / (x1 - x0)).otherwise(y1)
    y = F.when(F.col("tp_max") < 0, F.lit(0.0)).otherwise(y)
    weight = F.when(F.col("i").isin(0, 100), 0.5).otherwise(1.0)
    return g.groupBy(*keys).agg((F.sum(y * weight) / 100.0).alias("ap"))


def precision_recall_at(scored: DataFrame, n_gt: DataFrame, keys: Sequence[str], conf: float) -> DataFrame:
    from matchgrid.functions.stats import f1, ratio

    keys = list(keys)
    keep = (F.col("confidence") >= conf) & (F.col("outcome") != "ignored")
    g = scored.groupBy(*keys).agg(F.count_if(keep & (F.col("outcome") == "hit")).alias("tp"), F.count_if(keep).alias("n"))
    d = n_gt.join(g, keys, "left").fillna(0, ["tp", "n"])
    d = d.withColumn("precision", ratio("tp", "n")).withColumn("recall", ratio("tp", "n_gt"))
    return d.withColumn("f1", f1("precision", "recall"))


def best_f1(scored: DataFrame, n_gt: DataFrame, keys: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Best F1 over all thresholds and the confidence where it occurs (the lowest one on a tie)."""
    keys = list(keys)
    r = running_precision(scored, keys, tie)
    at = r.groupBy(*keys, "confidence").agg(F.max("tp").alias("tp"), F.max("n").alias("n")).join(n_gt, keys)
    f = 2.0 * F.col("tp") / (F.col("n") + F.col("n_gt"))
    pick = F.struct(F.col("f1").alias("f1"), (-F.col("confidence")).alias("neg"))
    return at.withColumn("f1", f).groupBy(*keys).agg(F.max(pick).alias("b")).select(
        *keys, F.col("b.f1").alias("f1_max"), F.when(F.col("b.f1") > 0, -F.col("b.neg")).alias("conf_at_f1_max")
    )

