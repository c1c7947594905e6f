"""Scores of detectors, trackers, label policies and reviewers."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.functions import boxes, ids, stats
from matchgrid.functions.labels import panel_outcome
from matchgrid.functions.stats import f1, ratio
from matchgrid.operators import aggs, ordered, windows

OUTCOMES = ("hit", "off", "miss", "false_ball", "true_empty")
CORRECT = ("ball", "corrected")
WRONG = ("not_ball", "box_off")


def upper_bound(near: DataFrame, marks: DataFrame, keys: Sequence[str], radii: Sequence[float], strong: float) -> DataFrame:
    """Frames with a mark whose best (or best strong) candidate lies within each radius."""
    best = near.groupBy(*keys).agg(F.min("near_px").alias("best"), F.min(F.when(F.col("confidence") >= strong, F.col("near_px"))).alias("strong"))
    fr = marks.select(*keys).distinct().join(best, list(keys), "left")
    fr = fr.withColumn("radius", F.explode(F.array(*[F.lit(r) for r in radii])))
    return fr.groupBy("radius").agg(
        F.count("*").alias("ball_frames"), F.count_if(F.col("best") <= F.col("radius")).alias("det_any"),
        F.count_if(F.col("strong") <= F.col("radius")).alias("det_strong"))


def machine_disagreement(near: DataFrame, radius: float) -> DataFrame:
    """Name of the disagreement between a machine verdict and the human marks (``has_ball``, ``near_px``)."""
    is_near = F.coalesce(F.col("near_px") <= radius, F.lit(False))
    says = F.col("verdict") == "ball"
    kind = (
        F.when(~F.col("has_ball") & says, "false_ball_no_ball_frame")
        .when(is_near & (F.col("verdict") == "not_ball"), "false_not_ball")
        .when(F.col("has_ball") & ~is_near & says, "false_ball")
        .otherwise("agree")
    )
    return near.withColumn("disagreement", kind)


def node_labels(near: DataFrame, pos_px: float, elsewhere_px: float) -> DataFrame:
    """1 close to a confirmed ball; 0 far from every mark of a marked frame, or on a no-ball frame; else -1."""
    pos = F.coalesce(F.col("near_px") <= pos_px, F.lit(False))
    far = F.coalesce(F.col("near_px") > elsewhere_px, F.lit(True))
    return near.withColumn("label", F.when(pos, 1).when((F.col("has_ball") & far) | F.col("no_ball"), 0).otherwise(-1))


def gold_ball_frames(states: DataFrame, detection: DataFrame, run_prefix: str, width: int = 1920) -> DataFrame:
    """Frames with a gold ball state, the gold position and the predicted one (first box by id), in pixels."""
    k = ["game_id", "frame_index"]
    gold = states.where(F.col("method").isin("hand_series", "hand_frame", "verdict") & F.col("state").isin("complete", "absent"))
    st = gold.where("cls_group = 'ball'").groupBy(*k).agg(F.max("state").alias("ball_state"))
    x = boxes.centre_x() * width
    d = detection.where(boxes.is_ball())
    g = d.where("source = 'hand_label'").groupBy(*k).agg(F.min_by(x, "detection_id").alias("__g"))
    p = d.where((F.col("source") != "hand_label") & F.col("run_id").startswith(run_prefix)).groupBy(*k).agg(F.min_by(x, "detection_id").alias("pred_x"))
    j = st.join(g, k, "left").join(p, k, "left")
    return j.withColumn("gold_x", F.when(F.col("ball_state") == "complete", F.col("__g"))).drop("__g")


def confusion(df: DataFrame, stratum: str, pred: str, truth: str) -> DataFrame:
    """Confusion counts and ratios per stratum and over all of them."""
    p, t = F.col(pred), F.col(truth)
    g = df.rollup(stratum).agg(
        F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))
    g = g.withColumn(stratum, F.coalesce(stratum, F.lit("(all)")))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    g = g.withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), n)).withColumn("precision", ratio("tp", F.col("tp") + F.col("fp")))
    g = g.withColumn("recall", ratio("tp", F.col("tp") + F.col("fn")))
    return g.withColumn("f1", f1("precision", "recall"))


# --- evaluation panels ---------------------------------------------------------------------------------------------


def panel_counts(frames: DataFrame, radii: Sequence[float], per: Sequence[str] = ("match", "win"), size: int = 5,
                 include_partial: bool = False) -> DataFrame:
    """Outcome counts per window and radius. Frames need ``state, dist, pi``; a window with an unlabelled frame is
    dropped unless ``include_partial``."""
    d = frames.withColumn("radius", F.explode(F.array(*[F.lit(float(r)) for r in radii])))
    d = d.withColumn("outcome", F.when(F.col("state").isNotNull(), panel_outcome("state", "dist", "radius")))
    g = d.groupBy(*per, "radius").agg(
        F.max("pi").alias("pi"), F.count("state").alias("labelled"), F.count("*").alias("frames"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])
    return g if include_partial else g.where((F.col("labelled") == F.col("frames")) & (F.col("frames") == size))


def ratios(df: DataFrame) -> DataFrame:
    hit, off, miss, fb, te = (F.col(o) for o in OUTCOMES)
    return (df.withColumn("recall", ratio(hit, hit + off + miss)).withColumn("precision", ratio(hit, hit + off + fb))
            .withColumn("false_ball_rate", ratio(fb, fb + te)))


def ht_totals(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Horvitz-Thompson totals: counts weighted by the inverse inclusion probability."""
    return counts.groupBy(*keys).agg(*[F.sum(F.col(o) / F.col("pi")).alias(o) for o in OUTCOMES])


def panel_pooled(counts: DataFrame) -> DataFrame:
    """Ratio of sums (``frame_weighted``) and mean of the matches' ratios (``match_averaged``)."""
    per = ht_totals(counts, ["match", "radius"])
    fw = ratios(per.groupBy("radius").agg(*[F.sum(o).alias(o) for o in OUTCOMES])).select(
        F.lit("frame_weighted").alias("pooling"), "radius", "recall", "precision", "false_ball_rate")
    ma = ratios(per).groupBy("radius").agg(*[F.avg(c).alias(c) for c in ("recall", "precision", "false_ball_rate")]).select(
        F.lit("match_averaged").alias("pooling"), "radius", "recall", "precision", "false_ball_rate")
    return fw.unionByName(ma)


# Cumulative probabilities of a Poisson(1) draw; the part beyond 20 is smaller than the step of a hashed uniform.
_POISSON1 = tuple(itertools.accumulate(math.exp(-1) / math.factorial(k) for k in range(21)))


def poisson_weight(key: Column) -> Column:
    """A Poisson(1) weight that depends on the key only, so that a repeated task draws the same sample."""
    u = ids.hashed_uniform(key)
    out = F.lit(len(_POISSON1))
    for i in reversed(range(len(_POISSON1))):
        out = F.when(u < _POISSON1[i], F.lit(i)).otherwise(out)
    return out


def bootstrap_ratios(counts: DataFrame, strata: Sequence[str], unit: Sequence[str], draws: int, seed: int = 0) -> DataFrame:
    """Cluster bootstrap of the panel ratios: whole windows are reweighted inside their stratum.

    Each window is fanned out to its draws and summed map-side; what is shuffled is one row per stratum and draw.
    """
    key = F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), *[F.col(c).cast("string") for c in unit])
    d = counts.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    d = d.withColumn("w", poisson_weight(key) / F.col("pi")).where("w > 0")
    per = d.groupBy(*strata, "draw").agg(*[F.sum(F.col(o) * F.col("w")).alias(o) for o in OUTCOMES])
    return ratios(per)


def interval(draws: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Percentile interval of each metric over the draws."""
    aggs = []
    for c in cols:
        aggs += [F.percentile(c, 0.025).alias(f"{c}_lo"), F.percentile(c, 0.975).alias(f"{c}_hi")]
    return draws.groupBy(*keys).agg(*aggs)


def repeat_spread(pairs: DataFrame, radius: float = 10.0) -> DataFrame:
    """Presence agreement of repeated placements and the spread of their distances (``state_a, state_b, dist_px``)."""
    both = (F.col("state_a") == "ball") & (F.col("state_b") == "ball")
    known = F.col("state_a").isNotNull() & F.col("state_b").isNotNull()
    on_air = known & (F.col("state_a") != "not_broadcast") & (F.col("state_b") != "not_broadcast")
    d = F.when(both, F.col("dist_px"))
    g = pairs.agg(
        F.count("*").alias("cards"), F.count_if(~known).alias("pending"), F.count_if(on_air & both).alias("both_ball"),
        F.count_if(on_air & (F.col("state_a") != F.col("state_b"))).alias("presence_disagree"),
        F.count_if(on_air & (F.col("state_a") == "no_ball") & (F.col("state_b") == "no_ball")).alias("both_no_ball"),
        F.max(d).alias("max_px"),
        F.avg(F.when(d <= 5, 1.0).when(d.isNotNull(), 0.0)).alias("share_5px"),
        F.avg(F.when(d <= radius, 1.0).when(d.isNotNull(), 0.0)).alias("share_radius"))
    one = pairs.select(F.lit(0).alias("__one"), d.alias("__px"))
    return aggs.with_quantiles(g.withColumn("__one", F.lit(0)), one, ["__one"], "__px", {"median_px": 0.5, "p90_px": 0.9}).drop("__one")


# --- replay of a tracker against marks -----------------------------------------------------------------------------


def replay_counts(frames: DataFrame, radii: Sequence[float], clip: str = "clip") -> DataFrame:
    """Hit, wrong, miss and false counts by origin, per clip and pooled over clips, per radius.

    Frames need ``kind`` (``ball`` or ``no_ball``), ``origin`` (``detected``, ``interpolated``, ``none``) and ``dist``.
    """
    d = frames.withColumn("radius", F.explode(F.array(*[F.lit(float(r)) for r in radii])))
    ball, det, interp = F.col("kind") == "ball", F.col("origin") == "detected", F.col("origin") == "interpolated"
    near = F.coalesce(F.col("dist") <= F.col("radius"), F.lit(False))
    g = d.groupingSets([[clip, "radius"], ["radius"]], clip, "radius").agg(
        F.count_if(ball).alias("ball_frames"), F.count_if(ball & det & near).alias("hit_detected"),
        F.count_if(ball & interp & near).alias("hit_interp"), F.count_if(ball & det & ~near).alias("wrong_detected"),
        F.count_if(ball & interp & ~near).alias("wrong_interp"), F.count_if(ball & ~det & ~interp).alias("miss"),
        F.count_if(~ball).alias("no_ball_frames"), F.count_if(~ball & (det | interp)).alias("false_points"))
    g = g.withColumn(clip, F.coalesce(clip, F.lit("(all)")))
    hit, wrong = F.col("hit_detected") + F.col("hit_interp"), F.col("wrong_detected") + F.col("wrong_interp")
    return (g.withColumn("precision", ratio(hit, hit + wrong + F.col("false_points"))).withColumn("recall", ratio(hit, "ball_frames"))
            .withColumn("wrong_per_prediction", ratio(wrong, hit + wrong)))


def clip_metrics(frames: DataFrame, clip: str, t: str, catastrophic_px: float = 200.0, recover: int = 3, span: int = ordered.SPAN) -> DataFrame:
    """Per clip: IoU, recall, precision, share within the radius, catastrophic share, longest streak, recovery.

    Frames need ``has_gt, has_pred, iou, dist, radius_px, occlusion``. An occlusion counts as recovered when one of
    the next ``recover`` frames has a prediction.
    """
    both = F.col("has_gt") & F.col("has_pred")
    ok = both & (F.col("dist") <= F.col("radius_px"))
    g = frames.groupBy(clip).agg(
        F.count("*").alias("frames"), F.avg("iou").alias("mean_iou"),
        (100 * F.coalesce(ratio(F.count_if(both), F.count_if("has_gt")), F.lit(0.0))).alias("recall_pct"),
        (100 * F.coalesce(ratio(F.count_if(both), F.count_if("has_pred")), F.lit(0.0))).alias("precision_pct"),
        F.count_if(F.col("has_gt") & ~F.col("has_pred")).alias("failures"),
        (100 * F.coalesce(ratio(F.count_if(ok), F.count_if(both)), F.lit(0.0))).alias("within_radius_pct"),
        (100 * F.coalesce(ratio(F.count_if(both & (F.col("dist") > catastrophic_px)), F.count_if(both)), F.lit(0.0))).alias("catastrophic_pct"))
    g = aggs.with_quantiles(g, frames, [clip], "iou", {"median_iou": 0.5})
    streak = windows.longest_streak(frames.withColumn("__ok", F.coalesce(ok, F.lit(False))), [clip], t, "__ok", span=span)
    occ = frames.where("occlusion").select(clip, F.col(t).alias("__o"), F.explode(F.sequence(F.col(t) + 1, F.col(t) + recover)).alias(t))
    rec = occ.join(frames.where("has_pred").select(clip, t).distinct().withColumn("__h", F.lit(1)), [clip, t], "left")
    rec = rec.groupBy(clip, "__o").agg(F.max(F.coalesce("__h", F.lit(0))).alias("r")).groupBy(clip).agg((100 * F.avg("r")).alias("recovery_pct"))
    return g.join(streak, clip, "left").join(rec, clip, "left").withColumn("recovery_pct", F.coalesce("recovery_pct", F.lit(100.0)))


# --- verdicts, audits, thresholds ----------------------------------------------------------------------------------


def hit_rates(cards: DataFrame, bucket: str = "bucket") -> DataFrame:
    v = F.col("verdict")
    ok, bad, un = v.isin(*CORRECT), v.isin(*WRONG), v == "unsure"
    g = cards.where(ok | bad | un).groupBy(F.coalesce(bucket, F.lit("?")).alias(bucket)).agg(
        F.count("*").alias("n"), F.count_if(ok).alias("correct"), F.count_if(bad).alias("wrong"), F.count_if(un).alias("unsure"))
    return g.withColumn("hit_rate", ratio("correct", F.col("correct") + F.col("wrong")))


def gold_check(cards: DataFrame, share: float = 0.10, min_n: int = 5) -> DataFrame:
    """Planted-wrong cards that a reviewer accepted as they were."""
    g = cards.where((F.col("bucket") == "G") & F.col("verdict").isin(*CORRECT, *WRONG)).agg(
        F.count("*").alias("n"), F.count_if(F.col("verdict") == "ball").alias("accepted_wrong"))
    rate = ratio("accepted_wrong", "n")
    return g.withColumn("accept_rate", rate).withColumn("flagged", F.coalesce((F.col("n") >= min_n) & (rate > share), F.lit(False)))


def verdict_tally(verdicts: DataFrame, keys: Sequence[str]) -> DataFrame:
    v = F.col("verdict")
    g = verdicts.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(v == "ball").alias("ball"), F.count_if(v == "corrected").alias("corrected"),
        F.count_if(v == "not_ball").alias("not_ball"), F.count_if(v == "unsure").alias("unsure"))
    good = F.col("ball") + F.col("corrected")
    return g.withColumn("precision", ratio(good, good + F.col("not_ball"))).withColumn("clean_precision", ratio("ball", good + F.col("not_ball")))


def confidence_bands(verdicts: DataFrame, conf: str = "confidence") -> DataFrame:
    """Decided verdicts and precision per tenth of confidence; ``unsure`` carries no information."""
    band = F.least(F.greatest(F.floor(F.col(conf) * 10 + 1e-9), F.lit(0)), F.lit(9)).cast("int")
    v = F.col("verdict")
    d = verdicts.where(F.col(conf).isNotNull() & v.isin("ball", "corrected", "not_ball")).groupBy(band.alias("band")).agg(
        F.count("*").alias("decided"), F.count_if(v != "not_ball").alias("hits"))
    return d.withColumn("precision", ratio("hits", "decided"))


def decision_boundary(bands: DataFrame, fallback: float = 0.25, min_decided: int = 5) -> DataFrame:
    """Confidence at which precision first crosses one half, interpolated between band centres. At most ten rows."""
    k = bands.where(F.col("decided") >= min_decided).withColumn("centre", F.col("band") / 10.0 + 0.05)
    w = Window.orderBy("band")  # ten bands at most
    k = k.withColumn("pc", F.lag("centre").over(w)).withColumn("pp", F.lag("precision").over(w))
    x = F.col("pc") + (0.5 - F.col("pp")) * (F.col("centre") - F.col("pc")) / (F.col("precision") - F.col("pp"))
    hit = k.where((F.col("pp") < 0.5) & (F.col("precision") >= 0.5)).withColumn("x", x)
    return hit.agg(F.coalesce(F.min_by("x", "band"), F.lit(fallback)).alias("tau"))


def kish(df: DataFrame, keys: Sequence[str], pi: str = "pi") -> DataFrame:
    w = 1.0 / F.col(pi)
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(w).alias("sw"), F.sum(w * w).alias("sw2"))
    return g.select(*keys, "n", (F.col("sw") * F.col("sw") / F.col("sw2")).alias("n_eff"))


class NotExchangeable(ValueError):
    """Verdicts that may not be pooled reached the threshold test."""


def learn_then_test(audits: DataFrame, keys: Sequence[str] = (), target: float = 0.98, delta: float = 0.1,
                    fallback: float = 0.95, check: bool = True) -> DataFrame:
    """Lowest confidence threshold whose precision passes a fixed-sequence test from 0.99 down to 0.50.

    Rows need ``bucket, p_real, verdict, scorer_version``. Audits are first counted per hundredth of confidence, so
    the walk runs over 50 grid rows per group. Tops that no labels could settle are skipped; the walk stops at the
    first failure. Refuses other buckets and mixed scorer versions.
    """
    keys = list(keys)
    if check:
        bad = audits.agg(F.count_if(F.coalesce(F.col("bucket") != "A", F.lit(True))).alias("b"), F.countDistinct("scorer_version").alias("v")).first()
        if bad["b"]:
            raise NotExchangeable("only audit-bucket verdicts are exchangeable with the accepted set")
        if bad["v"] > 1:
            raise NotExchangeable("audits come from several scorer versions")
    v = F.col("verdict")
    u = audits.where(v.isin(*CORRECT, *WRONG) & F.col("p_real").isNotNull())
    # A grid point t = i/100 counts rows with p >= t: the cell is the highest grid point at or below p.
    cell = F.least(F.floor(F.col("p_real") * 100 + 1e-9), F.lit(99)).cast("int")
    h = u.where(F.col("p_real") >= 0.5).groupBy(*keys, cell.alias("cell")).agg(F.count("*").alias("c"), F.count_if(v.isin(*CORRECT)).alias("k"))
    groups = audits.select(*keys).distinct() if keys else audits.sparkSession.range(1).select()
    grid = groups.withColumn("cell", F.explode(F.sequence(F.lit(50), F.lit(99)))).join(h, [*keys, "cell"], "left").fillna(0, ["c", "k"])
    w = Window.partitionBy(*keys).orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    g = grid.withColumn("n", F.sum("c").over(w)).withColumn("kk", F.sum("k").over(w))
    n_min = math.ceil(math.log(delta) / math.log(target))
    g = g.withColumn("p_value", F.when(F.col("n") > 0, stats.binomial_tail("kk", "n", F.lit(target))).otherwise(1.0))
    # Once a tested point was reached, later ones count whatever their size (n only grows going down).
    g = g.withColumn("tested", (F.col("n") >= n_min) | (F.col("cell") == 50))
    failed = F.max(F.when(F.col("tested") & (F.col("p_value") > delta), 1).otherwise(0)).over(w)
    g = g.withColumn("valid", F.col("tested") & (failed == 0))
    out = g.groupBy(*keys).agg(
        F.min(F.when(F.col("valid"), F.col("cell"))).alias("cell"), F.max("n").alias("n_audits"),
        F.min_by(F.when(F.col("valid"), F.struct("n", "kk", "p_value")), F.when(F.col("valid"), F.col("cell"))).alias("b"))
    thr = F.col("cell") / 100.0
    return out.select(
        *keys, F.when(F.col("cell").isNotNull(), "valid").otherwise("no_valid_threshold").alias("status"), thr.alias("threshold"),
        F.coalesce(thr, F.lit(fallback)).alias("effective_threshold"), F.col("b.n").alias("n"), F.col("b.kk").alias("k"),
        F.col("b.p_value").alias("p_value"), "n_audits")


def fit_platt(df: DataFrame, p: str, y: str, min_per_class: int = 10, iters: int = 50) -> dict | None:
    """Platt scaling with smoothed targets: a logistic regression on the logit, fitted by Spark.

    A target between 0 and 1 is two weighted rows, one per class, and equal scores are summed first. Returns ``None``
    when a class is too small.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    cells = df.select(stats.logit(p).alias("x"), F.col(y).cast("int").alias("y")).where("y IS NOT NULL").groupBy("x", "y").agg(F.count("*").alias("n"))
    size = {r["y"]: r["n"] for r in cells.groupBy("y").agg(F.sum("n").alias("n")).collect()}  # two classes
    pos, neg = size.get(1, 0), size.get(0, 0)
    if min(pos, neg) < min_per_class:
        return None
    target = F.when(F.col("y") == 1, (pos + 1) / (pos + 2)).otherwise(1 / (neg + 2))
    both = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), target.alias("w")), F.struct(F.lit(0.0).alias("label"), (1 - target).alias("w"))))
    rows = cells.select("x", "n", both.alias("s")).select(array_to_vector(F.array("x")).alias("features"), "s.label", (F.col("s.w") * F.col("n")).alias("weight"), "x")
    model = LogisticRegression(weightCol="weight", maxIter=iters, tol=1e-12, regParam=0.0).fit(rows)
    a, b = float(model.coefficients[0]), float(model.intercept)
    z = F.col("x") * a + b
    loss = F.col("weight") * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - F.col("label") * z)
    return {"a": a, "b": b, "n": pos + neg, "nll": float(rows.agg(F.sum(loss)).first()[0])}


def calibration_error(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    g = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("conf"), F.avg(F.col(y).cast("double")).alias("acc"))
    return g.agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def auroc(df: DataFrame, keys: Sequence[str], p: str, y: str) -> DataFrame:
    """Area under the ROC curve by rank sums; equal scores share their rank.

    Rows are counted per distinct score first, and the running negatives are summed in two levels.
    """
    keys = list(keys) or ["__all"]
    d = df if keys != ["__all"] else df.withColumn("__all", F.lit(1))
    g = d.groupBy(*keys, p).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    g = ordered.with_running(g, keys, [p], F.col("neg"), "cum", chunk=F.floor(F.col(p) * 1024).cast("long"))
    win = F.sum(F.col("pos") * (F.col("cum") - F.col("neg") + F.col("neg") / 2.0))
    out = g.groupBy(*keys).agg(ratio(win, F.sum("pos") * F.sum("neg")).alias("auroc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return out.drop("__all")


def answered_frames(rows: DataFrame, asked: DataFrame, frame_keys: Sequence[str]) -> DataFrame:
    """Frames all of whose questions were answered: correct when exactly the near candidates were called a ball.

    Set equality is a count of mismatching rows, so no id list is collected.
    """
    says = F.col("verdict") == "ball"
    g = rows.groupBy(*frame_keys).agg(
        F.count("*").alias("n"), F.bool_or("near").alias("any_near"), F.bool_or(says).alias("any_said"),
        F.bool_or(says & ~F.col("near")).alias("false_ball_frame"), F.bool_or(F.col("near") & ~says).alias("missed_near"))
    d = g.join(asked, list(frame_keys)).where(F.col("n") == F.col("n_asked"))
    same = ~F.col("false_ball_frame") & ~F.col("missed_near")
    ball = F.col("kind") == "ball"
    return d.withColumn("answerable", ~ball | F.col("any_near")).withColumn(
        "correct", F.when(ball, F.col("any_near") & same).otherwise(~F.col("any_said")))


def first_loss(df: DataFrame, keys: Sequence[str], dist: str, hit: Column) -> DataFrame:
    """Distance of the first miss of a track, or its last distance when it never misses (censored)."""
    d = df.withColumn("__hit", F.coalesce(hit, F.lit(False)))
    g = d.groupBy(*keys).agg(F.min(F.when(~F.col("__hit"), F.col(dist))).alias("loss"), F.max(dist).alias("last"))
    return g.select(*keys, F.coalesce("loss", "last").alias("first_loss"), F.col("loss").isNull().alias("censored"))


def gate_curve(df: DataFrame, thresholds: Sequence[float], score: str, hit: Column) -> DataFrame:
    d = df.withColumn("__hit", F.coalesce(hit, F.lit(False))).withColumn("gate", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    emit = F.coalesce(F.col(score) > F.col("gate"), F.lit(False))
    g = d.groupBy("gate").agg(F.count("*").alias("n"), F.count_if(emit).alias("emitted"), F.count_if(emit & F.col("__hit")).alias("hits"))
    return g.withColumn("coverage", ratio("emitted", "n")).withColumn("precision", ratio("hits", "emitted")).withColumn("recall", ratio("hits", "n"))


def paired_difference(df: DataFrame, cluster: Sequence[str], a: str, b: str, draws: int, seed: int = 0) -> DataFrame:
    """Mean paired difference with a cluster bootstrap interval."""
    per = df.groupBy(*cluster).agg(F.sum(F.col(b) - F.col(a)).alias("s"), F.count("*").alias("c"))
    key = F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), *[F.col(x).cast("string") for x in cluster])
    d = per.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("w", poisson_weight(key))
    m = d.groupBy("draw").agg(ratio(F.sum(F.col("w") * F.col("s")), F.sum(F.col("w") * F.col("c"))).alias("m"))
    m = m.select(F.lit(None).cast("double").alias("d"), "m").unionByName(per.agg((F.sum("s") / F.sum("c")).alias("d")).withColumn("m", F.lit(None).cast("double")))
    return m.agg(F.max("d").alias("diff"), F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))


def best_segment_result(results: DataFrame, keys: Sequence[str], accepted: str, run_at: str) -> DataFrame:
    """Per segment the result with most accepted frames; a later run wins only with strictly more."""
    rest = [c for c in results.columns if c not in keys]
    return results.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(accepted), -F.col(run_at))).alias("r")).select(*keys, "r.*")


def player_frame_complete(expected: DataFrame, checks: DataFrame, frame_keys: Sequence[str]) -> DataFrame:
    """A frame is complete when every expected cluster was verified and the whole-frame sweep is ok. A count verdict
    must equal the number of boxes; ``unsure`` never completes."""
    k = list(frame_keys)
    ok = F.col("verdict").isin("ok", "fixed") | ((F.col("verdict") == "count_n") & (F.col("count") == F.col("n_boxes")))
    c = checks.withColumn("ok", F.coalesce(ok, F.lit(False))).groupBy(*k, "cluster_id").agg(F.bool_or("ok").alias("ok"))
    j = expected.select(*k, "cluster_id").distinct().join(c, [*k, "cluster_id"], "left")
    done = j.groupBy(*k).agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("clusters_ok"))
    sweep = c.where("cluster_id = '__sweep__'").select(*k, F.col("ok").alias("sweep_ok"))
    return done.join(sweep, k, "left").withColumn("complete", F.col("clusters_ok") & F.coalesce("sweep_ok", F.lit(False)))


def progress_series(results: DataFrame, keys: Sequence[str], version: str, n_items: str, run_at: str) -> DataFrame:
    """One result per version (most items, then latest run) and its growth over the version before."""
    k = list(keys)
    rest = [c for c in results.columns if c not in (*k, version)]
    g = results.groupBy(*k, version).agg(F.max_by(F.struct(*rest), F.struct(n_items, run_at)).alias("r")).select(*k, version, "r.*")
    g = ordered.with_neighbour(g, k, [version], [n_items], "prev")
    return g.withColumn("growth", F.col(n_items) - F.col(f"prev.{n_items}")).drop("prev")


def frame_jitter(pos: DataFrame, clip: str, frame: str, track: str, gate: float = 1.5, min_pairs: int = 4) -> DataFrame:
    """Displacement of tracks between neighbouring frames and the shift they share, per frame pair."""
    nxt = pos.select(clip, track, (F.col(frame) - 1).alias(frame), F.col("x").alias("__x"), F.col("y").alias("__y"))
    p = pos.join(nxt, [clip, track, frame]).withColumn("dx", F.col("__x") - F.col("x")).withColumn("dy", F.col("__y") - F.col("y"))
    p = p.withColumn("disp", F.hypot("dx", "dy")).where(F.col("disp") < gate)
    g = p.groupBy(clip, frame).agg(
        F.count("*").alias("pairs"), F.percentile("disp", 0.5).alias("median_disp"), F.percentile("disp", 0.95).alias("p95_disp"),
        F.hypot(F.percentile("dx", 0.5), F.percentile("dy", 0.5)).alias("common_shift"))
    return g.where(F.col("pairs") >= min_pairs)


def tier_at(reviews: DataFrame, frames: DataFrame, keys: Sequence[str], frame: str) -> DataFrame:
    """2 inside an interval a person checked (array of structs ``lo, hi``), else 3."""
    d = frames.join(reviews, list(keys), "left")
    inside = F.exists(F.col("intervals"), lambda i: (d[frame] >= i["lo"]) & (d[frame] <= i["hi"]))
    return d.withColumn("tier", F.when(F.coalesce(inside, F.lit(False)), 2).otherwise(3)).drop("intervals")


def review_summary(reviews: DataFrame, n_frames: str) -> DataFrame:
    """Frames checked, share of the track, and purity (no split and not unsure)."""
    checked = F.aggregate("intervals", F.lit(0).cast("long"), lambda a, i: a + (i["hi"] - i["lo"] + 1))
    d = reviews.withColumn("checked", checked)
    share = F.when(F.col(n_frames) > 0, F.least(F.lit(1.0), F.col("checked") / F.col(n_frames))).otherwise(0.0)
    return d.withColumn("share", share).withColumn("pure", (F.size("split_at") == 0) & ~F.col("unsure"))
