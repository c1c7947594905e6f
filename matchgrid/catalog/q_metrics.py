"""Scores, audits, thresholds, components."""

import math

from pyspark.sql import functions as F

from matchgrid.catalog.q_windows import PAIRS
from matchgrid.catalog.registry import query
from matchgrid.functions import stats
from matchgrid.operators import graph, logs, metrics
from matchgrid.session import cut_lineage

R = [10.0, 20.0]

#: A Poisson(1) draw from a uniform u: cumulative probabilities as far as a double can tell them apart.
POISSON = "CASE " + " ".join(f"WHEN u < {sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))!r}::DOUBLE THEN {k}" for k in range(21)) + " ELSE 21 END"


def r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


@query("a07_confusion", """
WITH d AS (SELECT source, confidence >= 0.3 AS p, reviewed AS t FROM detection WHERE confidence IS NOT NULL),
g AS (SELECT coalesce(source, '(all)') AS source, count_if(p AND t)::BIGINT AS tp, count_if(p AND NOT t)::BIGINT AS fp, count_if(NOT p AND t)::BIGINT AS fn, count_if(NOT p AND NOT t)::BIGINT AS tn FROM d GROUP BY ROLLUP (source))
SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM g""")
def _(t):
    d = t.detection.where("confidence IS NOT NULL").select("source", (F.col("confidence") >= 0.3).alias("p"), F.col("reviewed").alias("t"))
    return metrics.confusion(d, "source", "p", "t").select("source", "tp", "fp", "fn", "tn", *r6("accuracy", "precision", "recall", "f1"))


PANEL = """
pr AS (SELECT *, unnest([10.0, 20.0])::DOUBLE AS radius FROM panel_frame),
po AS (SELECT *, CASE WHEN state IS NULL OR state = 'not_broadcast' THEN NULL WHEN state = 'no_ball' THEN CASE WHEN dist IS NULL THEN 'true_empty' ELSE 'false_ball' END
   WHEN dist IS NULL THEN 'miss' WHEN dist <= radius THEN 'hit' ELSE 'off' END AS o FROM pr),
pc AS (SELECT match, win, radius, max(pi) AS pi, count_if(o = 'hit')::BIGINT AS hit, count_if(o = 'off')::BIGINT AS off_, count_if(o = 'miss')::BIGINT AS miss, count_if(o = 'false_ball')::BIGINT AS fb, count_if(o = 'true_empty')::BIGINT AS te
   FROM po GROUP BY ALL HAVING count(state) = 5 AND count(*) = 5)"""
RAT = 'round({h} / ({h} + {o} + {m}), 6) AS recall, round({h} / ({h} + {o} + {f}), 6) AS "precision", round({f} / ({f} + {t}), 6) AS false_ball_rate'


@query("p26_panel_outcome", f"WITH {PANEL} SELECT match, frame, radius, o AS outcome FROM po WHERE state IS NOT NULL")
def _(t):
    from matchgrid.functions.labels import panel_outcome

    d = t.panel_frame.where("state IS NOT NULL").withColumn("radius", F.explode(F.array(*[F.lit(x) for x in R])))
    return d.select("match", "frame", "radius", panel_outcome("state", "dist", "radius").alias("outcome"))


@query("a11_panel_ratios", f"""
WITH {PANEL}, s AS (SELECT match, radius, sum(hit / pi) AS h, sum(off_ / pi) AS o, sum(miss / pi) AS m, sum(fb / pi) AS f, sum(te / pi) AS t FROM pc GROUP BY ALL)
SELECT match, radius, {RAT.format(h='h', o='o', m='m', f='f', t='t')} FROM s""")
def _(t):
    c = metrics.panel_counts(t.panel_frame, R)
    return metrics.ratios(metrics.ht_totals(c, ["match", "radius"])).select("match", "radius", *r6("recall", "precision", "false_ball_rate"))


BOOT = f"""
{PANEL}, dr AS (SELECT pc.*, unnest(range(40)) AS draw FROM pc),
du AS (SELECT *, (CAST('0x' || substr(sha1(concat('0:', draw, ':', match, ':', win)), 1, 15) AS BIGINT) + 0.5::DOUBLE) / 1152921504606846976.0::DOUBLE AS u FROM dr),
dw AS (SELECT *, ({POISSON}) / pi AS w FROM du),
ds AS (SELECT match, radius, draw, sum(hit * w) AS h, sum(off_ * w) AS o, sum(miss * w) AS m, sum(fb * w) AS f, sum(te * w) AS t FROM dw WHERE w > 0 GROUP BY ALL),
dq AS (SELECT match, radius, draw, h / nullif(h + o + m, 0) AS recall, h / nullif(h + o + f, 0) AS prec FROM ds)"""


@query("a12_panel_bootstrap", f"""
WITH {BOOT} SELECT match, radius, round(quantile_cont(recall, 0.025), 5) AS recall_lo, round(quantile_cont(recall, 0.975), 5) AS recall_hi,
 round(quantile_cont(prec, 0.025), 5) AS precision_lo, round(quantile_cont(prec, 0.975), 5) AS precision_hi FROM dq GROUP BY ALL""")
def _(t):
    d = metrics.bootstrap_ratios(metrics.panel_counts(t.panel_frame, R), ["match", "radius"], ["match", "win"], 40)
    ci = metrics.interval(d, ["match", "radius"], ["recall", "precision"])
    return ci.select("match", "radius", *[F.round(c, 5).alias(c) for c in ("recall_lo", "recall_hi", "precision_lo", "precision_hi")])


@query("a13_panel_pooled", f"""
WITH {PANEL}, s AS (SELECT match, radius, sum(hit / pi) AS h, sum(off_ / pi) AS o, sum(miss / pi) AS m, sum(fb / pi) AS f, sum(te / pi) AS t FROM pc GROUP BY ALL),
a AS (SELECT radius, sum(h) AS h, sum(o) AS o, sum(m) AS m, sum(f) AS f, sum(t) AS t FROM s GROUP BY ALL)
SELECT 'frame_weighted' AS pooling, radius, {RAT.format(h='h', o='o', m='m', f='f', t='t')} FROM a
UNION ALL SELECT 'match_averaged', radius, round(avg(h / (h + o + m)), 6), round(avg(h / (h + o + f)), 6), round(avg(f / (f + t)), 6) FROM s GROUP BY radius""")
def _(t):
    return metrics.panel_pooled(metrics.panel_counts(t.panel_frame, R)).select("pooling", "radius", *r6("recall", "precision", "false_ball_rate"))


@query("a14_replay_counts", """
WITH f AS (SELECT match AS clip, CASE WHEN state = 'ball' THEN 'ball' ELSE 'no_ball' END AS kind, CASE WHEN dist IS NULL THEN 'none' ELSE src END AS origin, dist, unnest([10.0, 20.0])::DOUBLE AS radius FROM panel_frame WHERE state IN ('ball', 'no_ball')),
g AS (SELECT coalesce(clip, '(all)') AS clip, radius, count_if(kind = 'ball')::BIGINT AS ball_frames, count_if(kind = 'ball' AND origin = 'detected' AND dist <= radius)::BIGINT AS hit_detected, count_if(kind = 'ball' AND origin = 'interpolated' AND dist <= radius)::BIGINT AS hit_interp,
 count_if(kind = 'ball' AND origin = 'detected' AND dist > radius)::BIGINT AS wrong_detected, count_if(kind = 'ball' AND origin = 'interpolated' AND dist > radius)::BIGINT AS wrong_interp, count_if(kind = 'ball' AND origin = 'none')::BIGINT AS miss,
 count_if(kind = 'no_ball')::BIGINT AS no_ball_frames, count_if(kind = 'no_ball' AND origin <> 'none')::BIGINT AS false_points FROM f GROUP BY GROUPING SETS ((clip, radius), (radius)))
SELECT *, round((hit_detected + hit_interp) / (hit_detected + hit_interp + wrong_detected + wrong_interp + false_points), 6) AS "precision", round((hit_detected + hit_interp) / ball_frames, 6) AS recall FROM g""")
def _(t):
    f = t.panel_frame.where("state IN ('ball', 'no_ball')").select(
        F.col("match").alias("clip"), F.when(F.col("state") == "ball", "ball").otherwise("no_ball").alias("kind"),
        F.when(F.col("dist").isNull(), "none").otherwise(F.col("src")).alias("origin"), "dist")
    d = metrics.replay_counts(f, R)
    return d.select("clip", "radius", "ball_frames", "hit_detected", "hit_interp", "wrong_detected", "wrong_interp", "miss", "no_ball_frames", "false_points", *r6("precision", "recall"))


@query("a15_clip_metrics", """
WITH f AS (SELECT clip, frame, is_on AS g, code <> 1 AS p, value, CASE WHEN is_on AND code <> 1 THEN value END AS dist, (NOT is_on AND person_count = 2) AS occ FROM frame_status),
k AS (SELECT *, coalesce(g AND p AND dist <= 12, false) AS ok FROM f),
b AS (SELECT *, CASE WHEN ok IS DISTINCT FROM lag(ok) OVER (PARTITION BY clip ORDER BY frame) THEN 1 ELSE 0 END AS nw FROM k),
i AS (SELECT *, sum(nw) OVER (PARTITION BY clip ORDER BY frame) AS run_no FROM b),
st AS (SELECT clip, coalesce(max(CASE WHEN ok THEN n END), 0) AS streak FROM (SELECT clip, run_no, ok, count(*) AS n FROM i GROUP BY ALL) GROUP BY clip),
oc AS (SELECT o.clip, o.frame, max(CASE WHEN p.p THEN 1 ELSE 0 END) AS r FROM f o LEFT JOIN f p ON p.clip = o.clip AND p.frame BETWEEN o.frame + 1 AND o.frame + 3 WHERE o.occ GROUP BY ALL),
rc AS (SELECT clip, 100 * avg(coalesce(r, 0)) AS recovery_pct FROM oc GROUP BY clip),
a AS (SELECT clip, count(*) AS frames, 100 * coalesce(count_if(g AND p) / nullif(count_if(g), 0), 0) AS recall_pct, 100 * coalesce(count_if(g AND p) / nullif(count_if(p), 0), 0) AS precision_pct, count_if(g AND NOT p)::BIGINT AS failures,
  100 * coalesce(count_if(ok) / nullif(count_if(g AND p), 0), 0) AS within_radius_pct, 100 * coalesce(count_if(dist > 40) / nullif(count_if(g AND p), 0), 0) AS catastrophic_pct, quantile_cont(CASE WHEN g AND p THEN value / 100 END, 0.5) AS median_iou FROM k GROUP BY clip)
SELECT a.clip, frames, round(recall_pct, 4) AS recall_pct, round(precision_pct, 4) AS precision_pct, failures, round(within_radius_pct, 4) AS within_radius_pct, round(catastrophic_pct, 4) AS catastrophic_pct, round(median_iou, 6) AS median_iou, streak, round(coalesce(recovery_pct, 100), 4) AS recovery_pct
FROM a JOIN st USING (clip) LEFT JOIN rc USING (clip)""")
def _(t):
    p = F.col("code") != 1
    both = F.col("is_on") & p
    f = t.frame_status.select("clip", "frame", F.col("is_on").alias("has_gt"), p.alias("has_pred"), F.when(both, F.col("value") / 100).alias("iou"),
                              F.when(both, F.col("value")).alias("dist"), F.lit(12.0).alias("radius_px"), (~F.col("is_on") & (F.col("person_count") == 2)).alias("occlusion"))
    d = metrics.clip_metrics(f, "clip", "frame", 40.0, 3, span=64)
    four = [F.round(c, 4).alias(c) for c in ("recall_pct", "precision_pct", "within_radius_pct", "catastrophic_pct", "recovery_pct")]
    return d.select("clip", "frames", "failures", "streak", F.round("median_iou", 6).alias("median_iou"), *four)


@query("a16_hit_rates", """
SELECT bucket, count(*) AS n, count_if(verdict IN ('ball', 'corrected'))::BIGINT AS correct, count_if(verdict IN ('not_ball', 'box_off'))::BIGINT AS wrong, count_if(verdict = 'unsure')::BIGINT AS unsure,
 round(count_if(verdict IN ('ball', 'corrected')) / count_if(verdict <> 'unsure'), 6) AS hit_rate FROM card GROUP BY bucket""")
def _(t):
    return metrics.hit_rates(t.card).select("bucket", "n", "correct", "wrong", "unsure", *r6("hit_rate"))


@query("a16_gold_check", """
SELECT count(*) AS n, count_if(verdict = 'ball')::BIGINT AS accepted_wrong, round(count_if(verdict = 'ball') / count(*), 6) AS accept_rate, count_if(verdict = 'ball') / count(*) > 0.1 AND count(*) >= 5 AS flagged
FROM card WHERE bucket = 'G' AND verdict <> 'unsure'""")
def _(t):
    return metrics.gold_check(t.card).select("n", "accepted_wrong", *r6("accept_rate"), "flagged")


@query("a17_wilson_bound", """
WITH g AS (SELECT match, bucket, count(*)::DOUBLE AS n, count_if(verdict IN ('ball', 'corrected'))::DOUBLE AS k FROM card GROUP BY ALL)
SELECT match, bucket, round(greatest(0, (k / n + 3.8416 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 6) AS wilson FROM g""")
def _(t):
    g = t.card.groupBy("match", "bucket").agg(F.count("*").alias("n"), F.count_if(F.col("verdict").isin("ball", "corrected")).alias("k"))
    return g.select("match", "bucket", F.round(stats.wilson_lower("k", "n"), 6).alias("wilson"))


TAIL = "least(1.0, list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p})))))"


@query("a17_binomial_tail", f"""
WITH g AS (SELECT match, bucket, count(*) AS n, count_if(verdict IN ('ball', 'corrected'))::BIGINT AS k FROM card GROUP BY ALL)
SELECT match, bucket, n, k, round({TAIL.format(p='0.93')}, 6) AS tail FROM g""")
def _(t):
    g = t.card.groupBy("match", "bucket").agg(F.count("*").alias("n"), F.count_if(F.col("verdict").isin("ball", "corrected")).alias("k"))
    return g.select("match", "bucket", "n", "k", F.round(stats.binomial_tail("k", "n", F.lit(0.93)), 6).alias("tail"))


@query("a18_threshold_walk", f"""
WITH u AS (SELECT match, p_real, verdict IN ('ball', 'corrected') AS ok FROM card WHERE bucket = 'A' AND verdict <> 'unsure'),
g AS (SELECT match, unnest(range(50, 100)) AS cell FROM (SELECT DISTINCT match FROM card WHERE bucket = 'A')),
c AS (SELECT g.match, g.cell, count(u.match) AS n, count_if(ok)::BIGINT AS k FROM g LEFT JOIN u ON u.match = g.match AND u.p_real + 1e-11 >= g.cell / 100 GROUP BY ALL),
p AS (SELECT *, CASE WHEN n = 0 THEN 1 ELSE {TAIL.format(p='0.90')} END AS pv, n >= 22 OR cell = 50 AS tested FROM c),
v AS (SELECT *, max(CASE WHEN tested AND pv > 0.1 THEN 1 ELSE 0 END) OVER (PARTITION BY match ORDER BY cell DESC) AS failed FROM p)
SELECT match, CASE WHEN min(CASE WHEN tested AND failed = 0 THEN cell END) IS NULL THEN 'no_valid_threshold' ELSE 'valid' END AS status, round(coalesce(min(CASE WHEN tested AND failed = 0 THEN cell END) / 100, 0.95), 4) AS effective_threshold, max(n) AS n_audits FROM v GROUP BY match""")
def _(t):
    d = metrics.learn_then_test(t.card.where("bucket = 'A'"), ["match"], target=0.90)
    return d.select("match", "status", F.round("effective_threshold", 4).alias("effective_threshold"), "n_audits")


@query("a19_kish_size", "SELECT match, bucket, count(*) AS n, round(power(sum(1 / pi), 2) / sum(1 / (pi * pi)), 4) AS n_eff FROM card GROUP BY ALL")
def _(t):
    return metrics.kish(t.card, ["match", "bucket"]).select("match", "bucket", "n", F.round("n_eff", 4).alias("n_eff"))


@query("a20_platt_fit")
def _(t):
    """Platt parameters of the detector confidence against reviewed rows; no row when a class is too small."""
    d = t.detection.where("confidence IS NOT NULL").withColumn("y", F.col("reviewed").cast("int"))
    fit = metrics.fit_platt(d, "confidence", "y")
    return t.spark.createDataFrame([(fit["a"], fit["b"], fit["n"])] if fit else [], "a double, b double, n long")


@query("a21_isotonic_fit")
def _(t):
    """Monotone precision curve of the confidence and the lowest confidence reaching the target."""
    from matchgrid.operators.learn import isotonic_curve

    return isotonic_curve(t.detection.where("confidence IS NOT NULL").withColumn("y", F.col("reviewed").cast("double")), "confidence", "y")


@query("a22_calibration_error", """
WITH b AS (SELECT least(floor(confidence * 10), 9) AS bin, count(*) AS n, avg(confidence) AS c, avg(CASE WHEN reviewed THEN 1.0 ELSE 0.0 END) AS a FROM detection WHERE confidence IS NOT NULL GROUP BY 1)
SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM b""")
def _(t):
    d = t.detection.where("confidence IS NOT NULL").withColumn("y", F.col("reviewed").cast("int"))
    return metrics.calibration_error(d, "confidence", "y").select(*r6("ece"), "n")


@query("a22_auroc", """
WITH d AS (SELECT game_id, round(confidence, 6) AS s, reviewed AS y FROM detection WHERE confidence IS NOT NULL),
g AS (SELECT game_id, s, count_if(y) AS p, count_if(NOT y) AS n FROM d GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY game_id ORDER BY s ROWS UNBOUNDED PRECEDING) - n AS below FROM g)
SELECT game_id, round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) AS auroc, sum(p)::BIGINT AS n_pos, sum(n)::BIGINT AS n_neg FROM c GROUP BY game_id""")
def _(t):
    d = t.detection.where("confidence IS NOT NULL").select("game_id", F.round("confidence", 6).alias("s"), F.col("reviewed").cast("int").alias("y"))
    return metrics.auroc(d, ["game_id"], "s", "y").select("game_id", *r6("auroc"), "n_pos", "n_neg")


@query("a23_leave_one_out_scorer")
def _(t):
    """Boosted-tree node scorer trained on all matches but one group, scored on that group: AUROC against the raw score."""
    from matchgrid.operators.learn import leave_one_out

    d = t.detection.where("confidence IS NOT NULL").select(
        F.pmod(F.hash("game_id"), F.lit(2)).alias("fold"), "confidence", "bbox_x", "bbox_y", "bbox_w", "bbox_h", F.col("reviewed").cast("double").alias("label"))
    return leave_one_out(d, "fold", ["confidence", "bbox_x", "bbox_y", "bbox_w", "bbox_h"], "label", "confidence")


@query("a25_confidence_bands", """
SELECT CAST(least(floor(confidence * 10 + 1e-9), 9) AS INT) AS band, count(*) AS decided, count_if(verdict <> 'not_ball')::BIGINT AS hits, round(count_if(verdict <> 'not_ball') / count(*), 6) AS "precision"
FROM verdict_log WHERE verdict IN ('ball', 'corrected', 'not_ball') GROUP BY 1""")
def _(t):
    return metrics.confidence_bands(t.verdict_log).select("band", "decided", "hits", *r6("precision"))


@query("a25_decision_boundary", """
WITH v AS (SELECT value / 50 AS c, verdict FROM (SELECT *, (line_no % 50)::DOUBLE AS value FROM verdict_log) WHERE verdict IN ('ball', 'corrected', 'not_ball')),
b AS (SELECT least(floor(c * 10 + 1e-9), 9) AS band, count(*) AS n, count_if(verdict <> 'not_ball') / count(*) AS p FROM v GROUP BY 1 HAVING count(*) >= 5),
k AS (SELECT *, band / 10 + 0.05 AS x, lag(band / 10 + 0.05) OVER (ORDER BY band) AS px, lag(p) OVER (ORDER BY band) AS pp FROM b)
SELECT round(coalesce((SELECT arg_min(px + (0.5 - pp) * (x - px) / (p - pp), band) FROM k WHERE pp < 0.5 AND p >= 0.5), 0.25), 6) AS tau""")
def _(t):
    v = t.verdict_log.withColumn("c", (F.col("line_no") % 50).cast("double") / 50)
    return metrics.decision_boundary(metrics.confidence_bands(v, "c")).select(*r6("tau"))


@query("a26_verdict_tally", """
WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_id, vsource, frame_index, box_index ORDER BY ts DESC, line_no DESC) AS rn FROM verdict_log) WHERE rn = 1 AND verdict IS NOT NULL)
SELECT vsource, count(*) AS n, count_if(verdict = 'ball')::BIGINT AS ball, count_if(verdict = 'corrected')::BIGINT AS corrected, count_if(verdict = 'not_ball')::BIGINT AS not_ball,
 round(count_if(verdict IN ('ball', 'corrected')) / count_if(verdict <> 'unsure'), 6) AS "precision", round(count_if(verdict = 'ball') / count_if(verdict <> 'unsure'), 6) AS clean_precision FROM l GROUP BY vsource""")
def _(t):
    return metrics.verdict_tally(logs.latest_verdicts(t.verdict_log), ["vsource"]).select("vsource", "n", "ball", "corrected", "not_ball", *r6("precision", "clean_precision"))


COMP = f"""
{PAIRS},
nd AS (SELECT clip, lo AS node FROM pair UNION SELECT clip, hi FROM pair),
eg AS (SELECT clip, lo AS a, hi AS b FROM pair WHERE verdict = 'same' UNION SELECT clip, hi, lo FROM pair WHERE verdict = 'same'),
reach AS (SELECT clip, node, node AS other FROM nd UNION SELECT r.clip, r.node, e.b FROM reach r JOIN eg e ON e.clip = r.clip AND e.a = r.other),
cc AS (SELECT clip, node, min(other) AS component FROM reach GROUP BY ALL),
cl AS (SELECT clip, node, dense_rank() OVER (PARTITION BY clip ORDER BY component) - 1 AS cluster_id FROM cc)"""


def pair_labels(t):
    d = logs.latest_pair_labels(t.pair_log, [F.col("clip"), F.col("a")], [F.col("clip"), F.col("b")], ["line_no"])
    return d.select(F.col("lo.k0").alias("clip"), F.col("lo.k1").alias("lo"), F.col("hi.k1").alias("hi"), "verdict")


@query("a30_identity_clusters", f"WITH RECURSIVE {COMP} SELECT clip, node, cluster_id FROM cl")
def _(t):
    return graph.identity_clusters(pair_labels(t))


@query("j27_contradicted_verdicts", f"""
WITH RECURSIVE {COMP} SELECT p.clip, p.lo, p.hi, a.cluster_id FROM pair p JOIN cl a ON a.clip = p.clip AND a.node = p.lo JOIN cl b ON b.clip = p.clip AND b.node = p.hi WHERE p.verdict = 'different' AND a.cluster_id = b.cluster_id""")
def _(t):
    lab = pair_labels(t)
    return graph.contradictions(lab, graph.identity_clusters(lab))


LINKED = """
pb AS (SELECT game_id, frame_index, detection_id AS d, bbox_x * 1920 AS x, bbox_y * 1080 AS y, bbox_w * 1920 AS w, bbox_h * 1080 AS h FROM detection WHERE label <> 'in_play_ball'),
ov AS (SELECT a.game_id, a.frame_index, a.d AS a, b.d AS b, greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) AS i,
  a.w * a.h + b.w * b.h AS s, sqrt(power(a.x + a.w / 2 - b.x - b.w / 2, 2) + power(a.y + a.h / 2 - b.y - b.h / 2, 2)) AS cd, (a.w + b.w) / 2 AS mw FROM pb a JOIN pb b ON a.game_id = b.game_id AND a.frame_index = b.frame_index AND a.d < b.d),
lk AS (SELECT *, i / (s - i) AS iou FROM ov WHERE i / (s - i) > 0.2 OR cd < 0.6 * mw),
e2 AS (SELECT game_id, frame_index, a, b FROM lk UNION ALL SELECT game_id, frame_index, b, a FROM lk),
reach AS (SELECT game_id, frame_index, d, d AS other FROM pb UNION SELECT r.game_id, r.frame_index, r.d, e.b FROM reach r JOIN e2 e ON e.game_id = r.game_id AND e.frame_index = r.frame_index AND e.a = r.other),
cc AS (SELECT game_id, frame_index, d, min(other) AS c FROM reach GROUP BY ALL),
sz AS (SELECT game_id, frame_index, c, count(*) AS n FROM cc GROUP BY ALL),
pf AS (SELECT game_id, frame_index, max(n) AS largest, sum(CASE WHEN n >= 3 THEN n ELSE 0 END) AS in_crowds, sum(n * (n - 1) / 2) AS pairs, sum(n) AS n_boxes FROM sz GROUP BY ALL),
si AS (SELECT ov.game_id, ov.frame_index, sum(i / (s - i)) AS s FROM ov JOIN cc p ON p.game_id = ov.game_id AND p.frame_index = ov.frame_index AND p.d = ov.a JOIN cc q ON q.game_id = ov.game_id AND q.frame_index = ov.frame_index AND q.d = ov.b WHERE p.c = q.c GROUP BY ALL),
cw AS (SELECT pf.*, CASE WHEN pairs > 0 THEN coalesce(s, 0) / pairs ELSE 0 END AS mean_iou FROM pf LEFT JOIN si USING (game_id, frame_index))"""


PICTURE = (1920.0, 1080.0)


def person_boxes(t):
    """Boxes in pixels of :data:`PICTURE`, stored, as every pair join reads them anew."""
    d = t.detection.where("label <> 'in_play_ball'")
    return cut_lineage(d.select("game_id", "frame_index", "detection_id", *[(F.col(f"bbox_{v}") * size).alias(f"bbox_{v}") for v, size in zip("xywh", PICTURE * 2, strict=True)]))


@query("a29_crowd_score", f"""
WITH RECURSIVE {LINKED} SELECT game_id, frame_index, largest, in_crowds::BIGINT AS in_crowds, n_boxes::BIGINT AS n_boxes, round(mean_iou, 7) AS mean_iou, round(largest + 0.25 * in_crowds + mean_iou, 7) AS score FROM cw""")
def _(t):
    d = graph.crowd_scores(person_boxes(t), ["game_id", "frame_index"], extent=PICTURE)
    return d.select("game_id", "frame_index", "largest", "in_crowds", "n_boxes", F.round("mean_iou", 7).alias("mean_iou"), F.round("score", 7).alias("score"))


@query("j25_node_clusters", """
WITH RECURSIVE q AS (SELECT clip, frame_index, detection_id AS d, x * 1280 AS x, y * 720 AS y, confidence FROM ball_candidate),
e AS (SELECT a.clip, a.frame_index, a.d AS a, b.d AS b FROM q a JOIN q b ON a.clip = b.clip AND a.frame_index = b.frame_index AND a.d <> b.d WHERE sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 80),
reach AS (SELECT clip, frame_index, d, d AS other FROM q UNION SELECT r.clip, r.frame_index, r.d, e.b FROM reach r JOIN e ON e.clip = r.clip AND e.frame_index = r.frame_index AND e.a = r.other),
c AS (SELECT clip, frame_index, d, min(other) AS component FROM reach GROUP BY ALL)
SELECT c.clip, c.frame_index, component, count(*) AS members, round(avg(x), 4) AS x, round(max(confidence), 6) AS best FROM c JOIN q ON q.clip = c.clip AND q.frame_index = c.frame_index AND q.d = c.d GROUP BY ALL""")
def _(t):
    p = t.ball_candidate.select("clip", "frame_index", "detection_id", (F.col("x") * 1280).alias("x"), (F.col("y") * 720).alias("y"), "confidence", (F.col("detection_id") % 2).alias("src"))
    k = ["clip", "frame_index"]
    c = graph.node_clusters(p, k, "detection_id", F.col("x"), F.col("y"), 80.0)
    m = graph.merged_nodes(p, c, k, "detection_id", "src", "confidence")
    return m.select(*k, "component", "members", F.round("x", 4).alias("x"), F.round(F.array_max(F.transform("by_source", lambda s: s["score"])), 6).alias("best"))


@query("a31_review_tier", """
WITH r AS (SELECT DISTINCT concat('g', user_id % 25) AS game_id, CAST(user_id % 40 * 10 AS INT) AS lo FROM events WHERE event_type = 'purchase')
SELECT f.game_id, f.frame_index, CAST(CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.game_id = f.game_id AND f.frame_index BETWEEN lo AND lo + 4) THEN 2 ELSE 3 END AS INT) AS tier FROM frame f""")
def _(t):
    e = t.events.where("event_type = 'purchase'")
    lo = (F.col("user_id") % 40 * 10).cast("int")
    # A track's intervals are its review record: one short list per game.
    r = e.groupBy(F.concat(F.lit("g"), F.col("user_id") % 25).alias("game_id")).agg(F.collect_set(F.struct(lo.alias("lo"), (lo + 4).alias("hi"))).alias("intervals"))
    return metrics.tier_at(r, t.frame.select("game_id", "frame_index"), ["game_id"], "frame_index").select("game_id", "frame_index", "tier")


@query("a32_repeat_spread", """
WITH p AS (SELECT a.match, a.state AS sa, b.state AS sb, CASE WHEN a.dist IS NOT NULL AND b.dist IS NOT NULL THEN abs(a.dist - b.dist) END AS d FROM panel_frame a JOIN panel_frame b ON b.match = a.match AND b.frame = a.frame + 1 WHERE a.frame % 2 = 0)
SELECT count(*) AS cards, count_if(sa IS NULL OR sb IS NULL)::BIGINT AS pending, count_if(sa = 'ball' AND sb = 'ball')::BIGINT AS both_ball, count_if(sa <> sb AND sa <> 'not_broadcast' AND sb <> 'not_broadcast')::BIGINT AS presence_disagree,
 round(quantile_cont(CASE WHEN sa = 'ball' AND sb = 'ball' THEN d END, 0.5), 4) AS median_px, round(quantile_cont(CASE WHEN sa = 'ball' AND sb = 'ball' THEN d END, 0.9), 4) AS p90_px,
 round(avg(CASE WHEN sa = 'ball' AND sb = 'ball' AND d IS NOT NULL THEN CASE WHEN d <= 5 THEN 1.0 ELSE 0.0 END END), 6) AS share_5px FROM p""")
def _(t):
    a = t.panel_frame.where("frame % 2 = 0").select("match", "frame", F.col("state").alias("state_a"), F.col("dist").alias("da"))
    b = t.panel_frame.select("match", (F.col("frame") - 1).alias("frame"), F.col("state").alias("state_b"), F.col("dist").alias("db"))
    p = a.join(b, ["match", "frame"]).withColumn("dist_px", F.abs(F.col("da") - F.col("db")))
    return metrics.repeat_spread(p).select("cards", "pending", "both_ball", "presence_disagree", F.round("median_px", 4).alias("median_px"), F.round("p90_px", 4).alias("p90_px"), *r6("share_5px"))


@query("a33_suggested_vs_blind", """
WITH pr AS (SELECT shown, unnest([10.0, 20.0])::DOUBLE AS radius, state, dist, pi FROM panel_frame WHERE state IN ('ball', 'no_ball')),
s AS (SELECT radius, shown, sum(CASE WHEN state = 'ball' AND dist <= radius THEN 1 / pi ELSE 0 END) AS h, sum(CASE WHEN state = 'ball' THEN 1 / pi ELSE 0 END) AS n, sum(CASE WHEN dist IS NOT NULL THEN 1 / pi ELSE 0 END) AS p FROM pr GROUP BY ALL)
SELECT radius, round(max(CASE WHEN shown THEN h / n END) - max(CASE WHEN NOT shown THEN h / n END), 6) AS recall_diff, round(max(CASE WHEN shown THEN h / p END) - max(CASE WHEN NOT shown THEN h / p END), 6) AS precision_diff FROM s GROUP BY radius""")
def _(t):
    d = t.panel_frame.where("state IN ('ball', 'no_ball')")
    c = metrics.panel_counts(d, R, per=["match", "win", "shown"], include_partial=True)
    m = metrics.ratios(metrics.ht_totals(c, ["radius", "shown"]))

    def diff(c):
        return F.round(F.max(F.when(F.col("shown"), F.col(c))) - F.max(F.when(~F.col("shown"), F.col(c))), 6)

    return m.groupBy("radius").agg(diff("recall").alias("recall_diff"), diff("precision").alias("precision_diff"))


@query("a35_machine_answers", """
WITH r AS (SELECT match, win, frame, coalesce(dist <= 10, false) AS near, CASE WHEN o = 1 THEN 'ball' ELSE 'not_ball' END AS verdict, state FROM (SELECT *, CASE WHEN dist <= 14 OR frame % 17 = 0 THEN 1 ELSE 0 END AS o FROM panel_frame) WHERE state IN ('ball', 'no_ball')),
q AS (SELECT match, win, count(*) AS n_asked, CASE WHEN bool_or(state = 'ball') THEN 'ball' ELSE 'no_ball' END AS kind FROM panel_frame WHERE state IN ('ball', 'no_ball') GROUP BY ALL),
g AS (SELECT match, win, count(*) AS n, bool_or(near) AS an, bool_or(verdict = 'ball') AS sb, bool_or(verdict = 'ball' AND NOT near) AS fb, bool_or(near AND verdict <> 'ball') AS mn FROM r GROUP BY ALL)
SELECT g.match, g.win, kind, (kind <> 'ball' OR an) AS answerable, CASE WHEN kind = 'ball' THEN an AND NOT fb AND NOT mn ELSE NOT sb END AS correct FROM g JOIN q USING (match, win) WHERE n = n_asked""")
def _(t):
    p = t.panel_frame.where("state IN ('ball', 'no_ball')")
    says = F.when((F.coalesce(F.col("dist") <= 14, F.lit(False))) | (F.col("frame") % 17 == 0), "ball").otherwise("not_ball")
    rows = p.select("match", "win", F.coalesce(F.col("dist") <= 10, F.lit(False)).alias("near"), says.alias("verdict"))
    asked = p.groupBy("match", "win").agg(F.count("*").alias("n_asked"), F.when(F.bool_or(F.col("state") == "ball"), "ball").otherwise("no_ball").alias("kind"))
    return metrics.answered_frames(rows, asked, ["match", "win"]).select("match", "win", "kind", "answerable", "correct")


@query("a36_first_loss", """
SELECT match, win, coalesce(min(CASE WHEN NOT coalesce(dist <= 10, false) THEN frame % 5 END), max(frame % 5)) AS first_loss, min(CASE WHEN NOT coalesce(dist <= 10, false) THEN frame % 5 END) IS NULL AS censored FROM panel_frame WHERE state = 'ball' GROUP BY ALL""")
def _(t):
    d = t.panel_frame.where("state = 'ball'").withColumn("off", F.col("frame") % 5)
    return metrics.first_loss(d, ["match", "win"], "off", F.col("dist") <= 10)


@query("a36_gate_curve", """
WITH g AS (SELECT unnest([0.0, 0.2, 0.4, 0.6])::DOUBLE AS gate), d AS (SELECT confidence, reviewed FROM detection WHERE source <> 'hand_label')
SELECT gate, count(*) AS n, count_if(confidence > gate)::BIGINT AS emitted, count_if(confidence > gate AND reviewed)::BIGINT AS hits, round(count_if(confidence > gate AND reviewed) / count_if(confidence > gate), 6) AS "precision" FROM d, g GROUP BY gate""")
def _(t):
    d = t.detection.where("source <> 'hand_label'")
    return metrics.gate_curve(d, [0.0, 0.2, 0.4, 0.6], "confidence", F.col("reviewed")).select("gate", "n", "emitted", "hits", *r6("precision"))


@query("a36_paired_bootstrap", f"""
WITH c AS (SELECT game_id, sum(CASE WHEN confidence >= 0.3 THEN 1 ELSE 0 END - CASE WHEN reviewed THEN 1 ELSE 0 END) AS s, count(*) AS c FROM detection WHERE confidence IS NOT NULL GROUP BY game_id),
d AS (SELECT *, unnest(range(200)) AS draw FROM c),
u AS (SELECT *, (CAST('0x' || substr(sha1(concat('0:', draw, ':', game_id)), 1, 15) AS BIGINT) + 0.5::DOUBLE) / 1152921504606846976.0::DOUBLE AS u FROM d),
w AS (SELECT *, {POISSON} AS w FROM u),
m AS (SELECT draw, sum(w * s) / sum(w * c) AS m FROM w GROUP BY draw)
SELECT round((SELECT sum(s) / sum(c) FROM c), 6) AS diff, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m""")
def _(t):
    d = t.detection.where("confidence IS NOT NULL").select("game_id", F.col("reviewed").cast("int").alias("a"), (F.col("confidence") >= 0.3).cast("int").alias("b"))
    return metrics.paired_difference(d, ["game_id"], "a", "b", 200).select(*r6("diff", "lo", "hi"))


@query("a37_best_segment_result", """
SELECT game_id, run_id, frame_index, q FROM (SELECT game_id, frame_index, run_id, CAST(round(quality * 100) AS INT) AS q, row_number() OVER (PARTITION BY game_id, frame_index ORDER BY CAST(round(quality * 100) AS INT) DESC, run_id) AS rn FROM calibration) WHERE rn = 1""")
def _(t):
    c = t.calibration.select("game_id", "frame_index", "run_id", F.round(F.col("quality") * 100).cast("int").alias("q"), F.substring("run_id", 6, 2).cast("int").alias("at"))
    return metrics.best_segment_result(c, ["game_id", "frame_index"], "q", "at").select("game_id", "run_id", "frame_index", "q")


@query("a39_player_frame_complete", """
WITH ex AS (SELECT DISTINCT game_id, frame_index, concat('c', track_id % 2) AS cluster_id FROM detection WHERE track_id IS NOT NULL),
ck AS (SELECT game_id, frame_index, CASE WHEN track_id IS NULL THEN '__sweep__' ELSE concat('c', track_id % 2) END AS cluster_id, CASE source WHEN 'yolo' THEN 'ok' WHEN 'sam3' THEN 'count_n' ELSE 'unsure' END AS verdict, detection_id AS cnt, 1 AS nb FROM detection),
o AS (SELECT game_id, frame_index, cluster_id, bool_or(verdict IN ('ok', 'fixed') OR (verdict = 'count_n' AND cnt = nb)) AS ok FROM ck GROUP BY ALL),
d AS (SELECT ex.game_id, ex.frame_index, bool_and(coalesce(ok, false)) AS cok FROM ex LEFT JOIN o USING (game_id, frame_index, cluster_id) GROUP BY ALL)
SELECT d.game_id, d.frame_index, cok AND coalesce(s.ok, false) AS complete FROM d LEFT JOIN (SELECT * FROM o WHERE cluster_id = '__sweep__') s USING (game_id, frame_index)""")
def _(t):
    d = t.detection
    cid = F.concat(F.lit("c"), F.col("track_id") % 2)
    ex = d.where("track_id IS NOT NULL").select("game_id", "frame_index", cid.alias("cluster_id"))
    v = F.when(F.col("source") == "yolo", "ok").when(F.col("source") == "sam3", "count_n").otherwise("unsure")
    ck = d.select("game_id", "frame_index", F.coalesce(cid, F.lit("__sweep__")).alias("cluster_id"), v.alias("verdict"), F.col("detection_id").alias("count"), F.lit(1).alias("n_boxes"))
    return metrics.player_frame_complete(ex, ck, ["game_id", "frame_index"]).select("game_id", "frame_index", "complete")


@query("a40_progress_series", """
WITH r AS (SELECT clip, CAST(frame_index // 100 AS INT) AS version, count(*) AS n FROM item GROUP BY ALL)
SELECT clip, version, n AS n_items, n - lag(n) OVER (PARTITION BY clip ORDER BY version) AS growth FROM r""")
def _(t):
    r = t.item.groupBy("clip", F.floor(F.col("frame_index") / 100).cast("int").alias("version")).agg(F.count("*").alias("n_items")).withColumn("run_at", F.col("version"))
    return metrics.progress_series(r, ["clip"], "version", "n_items", "run_at").select("clip", "version", "n_items", "growth")


@query("a42_audit_pass_rate", """
SELECT teacher_version, count(*) AS n, count_if(state = 'complete')::BIGINT AS passed, round(count_if(state = 'complete') / count(*), 6) AS pass_rate FROM frame_label_state WHERE teacher_version IS NOT NULL GROUP BY teacher_version""")
def _(t):
    g = t.frame_label_state.where("teacher_version IS NOT NULL").groupBy("teacher_version").agg(F.count("*").alias("n"), F.count_if(F.col("state") == "complete").alias("passed"))
    return g.select("*", F.round(stats.ratio("passed", "n"), 6).alias("pass_rate"))


@query("a43_frame_jitter", """
WITH p AS (SELECT game_id AS clip, frame_index AS f, track_id, avg(bbox_x) * 10 AS x, avg(bbox_y) * 10 AS y FROM detection WHERE track_id IS NOT NULL GROUP BY ALL),
d AS (SELECT a.clip, a.f, b.x - a.x AS dx, b.y - a.y AS dy, sqrt(power(b.x - a.x, 2) + power(b.y - a.y, 2)) AS disp FROM p a JOIN p b ON a.clip = b.clip AND a.track_id = b.track_id AND b.f = a.f + 1)
SELECT clip, f AS frame, count(*) AS pairs, round(quantile_cont(disp, 0.5), 5) AS median_disp, round(sqrt(power(quantile_cont(dx, 0.5), 2) + power(quantile_cont(dy, 0.5), 2)), 5) AS common_shift FROM d WHERE disp < 6 GROUP BY ALL HAVING count(*) >= 2""")
def _(t):
    p = t.detection.where("track_id IS NOT NULL").groupBy(F.col("game_id").alias("clip"), F.col("frame_index").alias("frame"), "track_id").agg((F.avg("bbox_x") * 10).alias("x"), (F.avg("bbox_y") * 10).alias("y"))
    return metrics.frame_jitter(p, "clip", "frame", "track_id", 6.0, 2).select("clip", "frame", "pairs", F.round("median_disp", 5).alias("median_disp"), F.round("common_shift", 5).alias("common_shift"))


@query("a45_round_budget", """
SELECT game_id, count_if(verdict IS NULL)::BIGINT AS open_cards, count_if(ts >= TIMESTAMP '2024-01-15')::BIGINT AS recent_cards, greatest(0, least(300 - count_if(verdict IS NULL), 200 - count_if(ts >= TIMESTAMP '2024-01-15')))::BIGINT AS allowed FROM verdict_log GROUP BY game_id""")
def _(t):
    g = t.verdict_log.groupBy("game_id").agg(F.count_if(F.col("verdict").isNull()).alias("open_cards"), F.count_if(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")).alias("recent_cards"))
    return g.withColumn("allowed", F.greatest(F.lit(0).cast("long"), F.least(300 - F.col("open_cards"), 200 - F.col("recent_cards"))))


@query("a46_classifier_tally", """
SELECT coalesce(source, '(all)') AS source, coalesce(game_id, '(all)') AS match, coalesce(label, '(all)') AS label, count(*) AS n FROM detection GROUP BY CUBE (source, game_id, label)""")
def _(t):
    g = t.detection.select("source", F.col("game_id").alias("match"), "label").cube("source", "match", "label").agg(F.count("*").alias("n"))
    return g.select(*[F.coalesce(c, F.lit("(all)")).alias(c) for c in ("source", "match", "label")], "n")


@query("a44_export_manifest", """
SELECT coalesce(split, '(all)') AS split, coalesce(label_kind, '(all)') AS label_kind, count(*) AS images, sum(tier)::BIGINT AS boxes, count(DISTINCT clip) AS clips FROM item GROUP BY GROUPING SETS ((split, label_kind), (split), ())""")
def _(t):
    g = t.item.groupingSets([["split", "label_kind"], ["split"], []], "split", "label_kind").agg(
        F.count("*").alias("images"), F.sum("tier").cast("long").alias("boxes"), F.countDistinct("clip").alias("clips"))
    return g.select(*[F.coalesce(c, F.lit("(all)")).alias(c) for c in ("split", "label_kind")], "images", "boxes", "clips")
