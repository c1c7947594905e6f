"""Spatial, band, nearest and matching joins."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchgrid.catalog.q_store import BEST, with_h
from matchgrid.catalog.registry import query
from matchgrid.functions import boxes
from matchgrid.functions.labels import link_decision, link_uncertainty, tracking_kind
from matchgrid.functions.stats import rounded
from matchgrid.operators import aggs, bands, joins, matching, snapshots, spatial, store
from matchgrid.session import cut_lineage

FRAME = ["game_id", "frame_index"]
RUN_FRAME = ["game_id", "source", "run_id", "frame_index"]


def iou_sql(a, b):
    w = f"greatest(least({a}bbox_x + {a}bbox_w, {b}bbox_x + {b}bbox_w) - greatest({a}bbox_x, {b}bbox_x), 0)"
    h = f"greatest(least({a}bbox_y + {a}bbox_h, {b}bbox_y + {b}bbox_h) - greatest({a}bbox_y, {b}bbox_y), 0)"
    inter = f"({w} * {h})"
    return f"({inter} / ({a}bbox_w * {a}bbox_h + {b}bbox_w * {b}bbox_h - {inter}))"


CROWD = f"""
pr AS (SELECT a.game_id, a.source, a.run_id, a.frame_index, a.detection_id AS d1, b.detection_id AS d2 FROM detection a JOIN detection b
  ON a.game_id = b.game_id AND a.source = b.source AND a.run_id = b.run_id AND a.frame_index = b.frame_index AND a.detection_id < b.detection_id
  WHERE {iou_sql('a.', 'b.')} >= 0.5),
cr AS (SELECT game_id, source, run_id, frame_index, d1 AS detection_id FROM pr UNION SELECT game_id, source, run_id, frame_index, d2 FROM pr)"""


@query("j07_crowded_boxes", f"""
WITH {CROWD} SELECT d.game_id, d.source, d.run_id, d.frame_index, d.detection_id, c.detection_id IS NOT NULL AS crowded
FROM detection d LEFT JOIN cr c USING (game_id, source, run_id, frame_index, detection_id)""")
def _(t):
    return joins.crowded_flags(t.detection, RUN_FRAME).select(*RUN_FRAME, "detection_id", "crowded")


DIFF = f"""
{CROWD},
hb AS (SELECT game_id, source, run_id, frame_index, bool_or(label IN ('ball', 'in_play_ball', 'out_of_play_ball')) AS has_ball FROM detection GROUP BY ALL),
df AS (SELECT d.*, c.detection_id IS NOT NULL AS crowded, coalesce(confidence < 0.4, false) AS low_conf, NOT has_ball AS no_ball
FROM detection d LEFT JOIN cr c USING (game_id, source, run_id, frame_index, detection_id) JOIN hb USING (game_id, source, run_id, frame_index))"""


@query("c04_difficulty_flags", f"""
WITH {DIFF} SELECT game_id, source, run_id, frame_index, detection_id, low_conf, crowded, no_ball, (low_conf OR crowded OR no_ball) AS needs_review FROM df""")
def _(t):
    return joins.difficulty(t.detection, RUN_FRAME).select(*RUN_FRAME, "detection_id", "low_conf", "crowded", "no_ball", "needs_review")


@query("a41_difficulty_report", f"""
WITH {DIFF} SELECT source, run_id, count(*) AS total, count_if(low_conf)::BIGINT AS low_conf, count_if(crowded)::BIGINT AS crowded, count_if(no_ball)::BIGINT AS no_ball,
 count_if(low_conf OR crowded OR no_ball)::BIGINT AS flagged FROM df GROUP BY ALL""")
def _(t):
    d = joins.difficulty(t.detection, RUN_FRAME)
    return d.groupBy("source", "run_id").agg(F.count("*").alias("total"), *[F.count_if(c).alias(c) for c in ("low_conf", "crowded", "no_ball")],
                                             F.count_if("needs_review").alias("flagged"))


def verdict_boxes(t):
    v = t.verdict_box
    box = F.struct(F.col("bx").alias("x"), F.col("by_").alias("y"), F.col("bw").alias("w"), F.col("bh").alias("h"))
    cor = F.when(F.col("cx").isNotNull(), F.struct(F.col("cx").alias("x"), F.col("by_").alias("y"), F.col("bw").alias("w"), F.col("bh").alias("h")))
    return v.select(*FRAME, "verdict_id", "verdict", "vsource", box.alias("box"), cor.alias("corrected"))


VMATCH = f"""
pb AS (SELECT game_id, frame_index, verdict_id, bx AS bbox_x, by_ AS bbox_y, bw AS bbox_w, bh AS bbox_h FROM verdict_box
  UNION ALL SELECT game_id, frame_index, verdict_id, cx, by_, bw, bh FROM verdict_box WHERE cx IS NOT NULL),
vp AS (SELECT p.game_id, p.frame_index, p.verdict_id, d.detection_id, d.source, {iou_sql('p.', 'd.')} AS iou FROM pb p JOIN detection d USING (game_id, frame_index) WHERE d.label = 'in_play_ball'),
vb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY verdict_id ORDER BY iou DESC, detection_id) AS rn FROM vp WHERE iou >= 0.3) WHERE rn = 1),
vm AS (SELECT v.*, b.detection_id, b.source AS msource, b.iou, coalesce(v.verdict = 'not_ball' AND v.vsource = 'cand' AND b.source = 'hand_label', false) AS conflict
  FROM verdict_box v LEFT JOIN vb b USING (verdict_id))"""


@query("j08_best_iou_match", f"""
WITH {VMATCH} SELECT game_id, frame_index, verdict_id, verdict, conflict, CASE WHEN NOT conflict THEN detection_id END AS matched_id, round(CASE WHEN NOT conflict THEN iou END, 6) AS match_iou FROM vm""")
def _(t):
    balls = t.detection.where(boxes.is_ball())
    return joins.match_verdicts(verdict_boxes(t), balls, FRAME, 0.3).select(
        *FRAME, "verdict_id", "verdict", "conflict", "matched_id", F.round("match_iou", 6).alias("match_iou"))


@query("c05_verdict_import_report", f"""
WITH {VMATCH} SELECT verdict, count(*) AS verdicts, count_if(detection_id IS NOT NULL AND NOT conflict)::BIGINT AS matched,
 count_if(detection_id IS NULL OR conflict)::BIGINT AS unmatched, count_if(conflict)::BIGINT AS conflicts FROM vm GROUP BY verdict""")
def _(t):
    d = joins.match_verdicts(verdict_boxes(t), t.detection.where(boxes.is_ball()), FRAME, 0.3)
    return d.groupBy("verdict").agg(F.count("*").alias("verdicts"), F.count_if(F.col("matched_id").isNotNull()).alias("matched"),
                                    F.count_if(F.col("matched_id").isNull()).alias("unmatched"), F.count_if("conflict").alias("conflicts"))


def fold_sql(pairs, f, d, g, order):
    """Greedy matching as a fold over the ordered pairs of every frame."""
    return f"""
pq AS (SELECT *, row_number() OVER (PARTITION BY {f} ORDER BY {order}) AS k FROM {pairs}),
fold AS (SELECT {f}, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS ud, CAST([] AS BIGINT[]) AS ug, CAST(NULL AS BIGINT) AS md, CAST(NULL AS BIGINT) AS mg FROM (SELECT DISTINCT {f} FROM pq)
 UNION ALL SELECT {f}, p.k, CASE WHEN NOT list_contains(r.ud, p.{d}) AND NOT list_contains(r.ug, p.{g}) THEN list_append(r.ud, p.{d}) ELSE r.ud END,
  CASE WHEN NOT list_contains(r.ud, p.{d}) AND NOT list_contains(r.ug, p.{g}) THEN list_append(r.ug, p.{g}) ELSE r.ug END,
  CASE WHEN NOT list_contains(r.ud, p.{d}) AND NOT list_contains(r.ug, p.{g}) THEN p.{d} END, CASE WHEN NOT list_contains(r.ud, p.{d}) AND NOT list_contains(r.ug, p.{g}) THEN p.{g} END
  FROM fold r JOIN pq p USING ({f}) WHERE p.k = r.k + 1)"""


MATCH_IOU = 0.3
DET_SQL = f"""
dets AS (SELECT game_id, frame_index, CASE WHEN label = 'in_play_ball' THEN 'ball' ELSE label END AS cls, detection_id AS det_id, confidence, bbox_x, bbox_y, bbox_w, bbox_h FROM detection WHERE source <> 'hand_label'),
gta AS (SELECT game_id, frame_index, CASE WHEN label = 'in_play_ball' THEN 'ball' ELSE label END AS cls, detection_id AS gt_id, bbox_x, bbox_y, bbox_w, bbox_h, track_id IS NULL AS ign FROM detection WHERE source = 'hand_label'),
gtf AS (SELECT DISTINCT game_id, frame_index, cls FROM gta WHERE NOT ign),
cand AS (SELECT d.game_id, d.frame_index, d.cls, d.det_id, g.gt_id, d.confidence, g.ign, {iou_sql('d.', 'g.')} AS fit FROM dets d JOIN gta g USING (game_id, frame_index, cls)),
good AS (SELECT * FROM cand WHERE fit >= {MATCH_IOU} AND NOT ign),
{fold_sql('good', 'game_id, frame_index, cls', 'det_id', 'gt_id', 'confidence DESC, det_id, fit DESC, gt_id')},
mt AS (SELECT game_id, frame_index, cls, md AS det_id, mg AS gt_id FROM fold WHERE md IS NOT NULL),
ig AS (SELECT DISTINCT game_id, frame_index, cls, det_id FROM cand WHERE ign AND fit >= {MATCH_IOU}),
sc AS (SELECT d.game_id, d.frame_index, d.cls, d.det_id, d.confidence, mt.gt_id, CASE WHEN mt.gt_id IS NOT NULL THEN 'hit' WHEN ig.det_id IS NOT NULL THEN 'ignored' ELSE 'false' END AS outcome
  FROM dets d JOIN gtf USING (game_id, frame_index, cls) LEFT JOIN mt USING (game_id, frame_index, cls, det_id) LEFT JOIN ig USING (game_id, frame_index, cls, det_id)),
ng AS (SELECT cls, count(*) AS n_gt FROM gta WHERE NOT ign GROUP BY cls)"""
CLS_FRAME = [*FRAME, "cls"]


def scored_detections(t):
    """Detections of the frames that carry ground truth of their class, with the match outcome, and the ground-truth counts."""
    cls = F.when(F.col("label") == "in_play_ball", "ball").otherwise(F.col("label"))
    d = t.detection.select(*FRAME, cls.alias("cls"), "detection_id", "confidence", *joins.BOX, (F.col("source") == "hand_label").alias("hand"), F.col("track_id").isNull().alias("ign"))
    # Only classes of a frame with ground truth count. Their boxes are read several times below and numbered by a sort of all
    # detections: stored once.
    counts = F.max(F.col("hand") & ~F.col("ign")).over(Window.partitionBy(*CLS_FRAME))
    d = cut_lineage(d.withColumn("counts", counts).where("counts").drop("counts"))
    gt = d.where("hand").withColumnRenamed("detection_id", "gt_id")
    dets = d.where("NOT hand").withColumnRenamed("detection_id", "det_id").drop("hand", "ign")
    both = cut_lineage(spatial.box_pairs(dets, gt, CLS_FRAME, "det_id", "gt_id", MATCH_IOU, left_cols=["confidence"], right_cols=["ign"]).withColumnRenamed("iou", "fit"))
    pairs, ip = both.where("NOT ign").drop("ign"), both.where("ign").select(*CLS_FRAME, "det_id")
    gt, ign = gt.where("NOT ign"), gt.where("ign")
    dets = dets.select(*CLS_FRAME, "det_id", "confidence")
    out = matching.score_detections(dets, gt, ign, CLS_FRAME, pairs, ip)
    return out, gt.groupBy("cls").agg(F.count("*").alias("n_gt"))


@query("j09_greedy_match", f"WITH RECURSIVE {DET_SQL} SELECT game_id, frame_index, cls, det_id, gt_id, outcome FROM sc")
def _(t):
    return scored_detections(t)[0].select(*CLS_FRAME, "det_id", "gt_id", "outcome")


AP_SQL = f"""
{DET_SQL},
cu AS (SELECT *, sum(CASE WHEN outcome = 'hit' THEN 1 ELSE 0 END) OVER w AS tp, count(*) OVER w AS n FROM sc WHERE outcome <> 'ignored'
  WINDOW w AS (PARTITION BY cls ORDER BY confidence DESC, game_id, frame_index, det_id ROWS UNBOUNDED PRECEDING)),
pt AS (SELECT cls, CAST(tp AS BIGINT) AS tp, max(tp / n) AS best, arg_max(tp / n, n) AS last_p FROM cu GROUP BY cls, tp),
ev AS (SELECT *, max(best) OVER (PARTITION BY cls ORDER BY tp DESC ROWS UNBOUNDED PRECEDING) AS env FROM pt),
e2 AS (SELECT cls, tp, env AS e_first, greatest(last_p, coalesce(lead(env) OVER (PARTITION BY cls ORDER BY tp), 0)) AS e_last FROM ev),
gr AS (SELECT ng.cls, n_gt, i, (SELECT max(tp) FROM e2 WHERE e2.cls = ng.cls) AS tpm FROM ng, (SELECT unnest(range(101)) AS i) r),
g2 AS (SELECT *, least(i * n_gt // 100, tpm) AS tp FROM gr),
g3 AS (SELECT g2.*, coalesce(a.e_last, 1.0) AS y0, b.e_first FROM g2 LEFT JOIN e2 a ON a.cls = g2.cls AND a.tp = g2.tp LEFT JOIN e2 b ON b.cls = g2.cls AND b.tp = g2.tp + 1),
g4 AS (SELECT *, tp / n_gt AS x0, CASE WHEN tp >= tpm THEN 1.0 ELSE (tp + 1) / n_gt END AS x1, CASE WHEN tp >= tpm THEN 0.0 ELSE e_first END AS y1 FROM g3),
ap AS (SELECT cls, sum((CASE WHEN i IN (0, 100) THEN 0.5 ELSE 1.0 END) * CASE WHEN i = 100 THEN 0 WHEN x1 > x0 THEN y0 + (y1 - y0) * (i / 100 - x0) / (x1 - x0) ELSE y1 END) / 100 AS ap FROM g4 GROUP BY cls)"""


@query("a08_average_precision", f"WITH RECURSIVE {AP_SQL} SELECT cls, round(ap, 6) AS ap FROM ap")
def _(t):
    sc, ng = scored_detections(t)
    return matching.average_precision(sc, ng, ["cls"], ["game_id", "frame_index", "det_id"]).select("cls", F.round("ap", 6).alias("ap"))


@query("a09_precision_recall_f1", f"""
WITH RECURSIVE {DET_SQL},
p AS (SELECT ng.cls, n_gt, count_if(outcome = 'hit' AND confidence >= 0.3)::BIGINT AS tp, count_if(outcome <> 'ignored' AND confidence >= 0.3)::BIGINT AS n FROM ng LEFT JOIN sc USING (cls) GROUP BY ALL)
SELECT cls, n_gt, tp, n, round(tp / n, 6) AS "precision", round(tp / n_gt, 6) AS recall, round(2 * tp / (n + n_gt), 6) AS f1 FROM p""")
def _(t):
    sc, ng = scored_detections(t)
    return matching.precision_recall_at(sc, ng, ["cls"], 0.3).select("cls", "n_gt", "tp", "n", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("a09_best_f1", f"""
WITH RECURSIVE {DET_SQL},
cu AS (SELECT cls, confidence, sum(CASE WHEN outcome = 'hit' THEN 1 ELSE 0 END) AS h, count(*) AS c FROM sc WHERE outcome <> 'ignored' GROUP BY ALL),
c2 AS (SELECT cls, confidence, sum(h) OVER w AS tp, sum(c) OVER w AS n FROM cu WINDOW w AS (PARTITION BY cls ORDER BY confidence DESC)),
f AS (SELECT c2.*, 2 * tp / (n + n_gt) AS f1 FROM c2 JOIN ng USING (cls))
SELECT cls, round(f1, 6) AS f1_max, round(confidence, 6) AS conf_at_f1_max FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY f1 DESC, confidence DESC) AS rn FROM f) WHERE rn = 1""")
def _(t):
    sc, ng = scored_detections(t)
    return matching.best_f1(sc, ng, ["cls"], ["game_id", "frame_index", "det_id"]).select(
        "cls", F.round("f1_max", 6).alias("f1_max"), F.round("conf_at_f1_max", 6).alias("conf_at_f1_max"))


@query("a10_detector_scores", f"""
WITH RECURSIVE {AP_SQL},
p AS (SELECT ng.cls, n_gt, count_if(outcome = 'hit' AND confidence >= 0.3)::BIGINT AS tp, count_if(outcome <> 'ignored' AND confidence >= 0.3)::BIGINT AS n FROM ng LEFT JOIN sc USING (cls) GROUP BY ALL)
SELECT cls, metric, round(value, 6) AS value FROM (
 SELECT cls, 'ap50' AS metric, ap AS value FROM ap UNION ALL SELECT cls, 'precision', tp / n FROM p UNION ALL SELECT cls, 'recall', tp / n_gt FROM p
 UNION ALL SELECT cls, 'n_gt', n_gt FROM p UNION ALL SELECT 'all', 'map50', avg(ap) FROM ap)""")
def _(t):
    from matchgrid.plans.evaluate import detector_scores

    sc, ng = scored_detections(t)
    return detector_scores(sc, ng, ["game_id", "frame_index", "det_id"]).select("cls", "metric", F.round("value", 6).alias("value"))


LINK = """
lk AS (SELECT a.clip, a.track_id AS a, b.track_id AS b, b.start_frame - a.end_frame AS gap, sqrt(power(b.start_x - a.end_x, 2) + power(b.start_y - a.end_y, 2)) AS distance
FROM tracklet a JOIN tracklet b ON a.clip = b.clip AND b.start_frame - a.end_frame BETWEEN 1 AND 12
WHERE (a.team IS NULL OR b.team IS NULL OR a.team = b.team) AND sqrt(power(b.start_x - a.end_x, 2) + power(b.start_y - a.end_y, 2)) <= 0.035 * (b.start_frame - a.end_frame))"""


@query("j10_gap_bridging_links", f"WITH {LINK} SELECT clip, a, b, gap, round(distance, 6) AS distance FROM lk")
def _(t):
    return joins.candidate_links(t.tracklet).select("clip", "a", "b", "gap", rounded("distance", 6).alias("distance"))


TRIAGE = f"""
{LINK}, sm AS (SELECT *, CASE WHEN a % 7 = 0 THEN NULL ELSE (a * 31 + b * 17) % 100 / CAST(100 AS DOUBLE) END AS similarity FROM lk),
tr AS (SELECT *, CASE WHEN similarity IS NULL THEN 'ask' WHEN similarity >= 0.80 THEN 'merge' WHEN similarity < 0.55 THEN 'reject' ELSE 'ask' END AS decision,
  coalesce(abs(similarity - 0.675), 0) AS uncertainty FROM sm)"""


def given_similarity():
    return F.when(F.col("a") % 7 != 0, (F.col("a") * 31 + F.col("b") * 17) % 100 / 100.0)


@query("p21_link_decision", f"WITH {TRIAGE} SELECT clip, a, b, decision, round(uncertainty, 6) AS uncertainty FROM tr")
def _(t):
    d = joins.candidate_links(t.tracklet).withColumn("similarity", given_similarity())
    return d.select("clip", "a", "b", link_decision("similarity").alias("decision"), rounded(link_uncertainty("similarity"), 6).alias("uncertainty"))


@query("t03_triage_lists", f"""
WITH {TRIAGE} SELECT clip, a, b, decision, row_number() OVER (PARTITION BY clip, decision ORDER BY CASE decision WHEN 'ask' THEN round(uncertainty, 6)
  WHEN 'merge' THEN -similarity ELSE similarity END, a, b) AS place FROM tr""")
def _(t):
    from matchgrid.operators.linking import triaged_links

    return triaged_links(t.tracklet, given_similarity()).select("clip", "a", "b", "decision", "place")


EVID = """
el AS (SELECT game_id, frame_index FROM frame),
er AS (SELECT DISTINCT game_id, frame_index AS ef FROM verdict_log UNION SELECT DISTINCT game_id, frame_index * 7 AS ef FROM verdict_log),
ea AS (SELECT el.game_id, el.frame_index, er.ef, row_number() OVER (PARTITION BY el.game_id, el.frame_index ORDER BY abs(er.ef - el.frame_index), er.ef) AS rn
  FROM el LEFT JOIN er ON er.game_id = el.game_id)"""


def evidence(t):
    v = t.verdict_log.select("game_id", "frame_index")
    return v.union(v.select("game_id", (F.col("frame_index") * 7).alias("frame_index"))).withColumnRenamed("frame_index", "ef")


@query("j11_nearest_evidence", f"WITH {EVID} SELECT game_id, frame_index, ef FROM ea WHERE rn = 1")
def _(t):
    d = bands.asof_nearest(t.frame.select(*FRAME), evidence(t), ["game_id"], "frame_index", "ef", ["ef"], span=64)
    return d.select(*FRAME, F.col("near.ef").alias("ef"))


@query("j12_nearest_within_window", f"WITH {EVID} SELECT game_id, frame_index, CASE WHEN abs(ef - frame_index) <= 5 THEN ef END AS ef, coalesce(abs(ef - frame_index) <= 5, false) AS found FROM ea WHERE rn = 1")
def _(t):
    d = bands.asof_nearest(t.frame.select(*FRAME), evidence(t), ["game_id"], "frame_index", "ef", ["ef"], max_dist=5, span=64)
    return d.select(*FRAME, F.col("near.ef").alias("ef"), F.col("near").isNotNull().alias("found"))


SPANS = """
sp AS (SELECT DISTINCT concat('g', user_id % 25) AS game_id, CAST(user_id * 11 % 500 AS BIGINT) AS lo, CAST(user_id * 11 % 500 + 3 AS BIGINT) AS hi FROM events WHERE event_type = 'error')"""


def spans(t):
    e = t.events.where("event_type = 'error'")
    lo = F.col("user_id") * 11 % 500
    return e.select(F.concat(F.lit("g"), F.col("user_id") % 25).alias("game_id"), lo.alias("lo"), (lo + 3).alias("hi")).distinct()


@query("j13_interval_exclusion", f"""
WITH {SPANS} SELECT game_id, frame_index FROM frame f WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.game_id = f.game_id AND f.frame_index BETWEEN lo - 10 AND hi + 10)""")
def _(t):
    s = spans(t).select("game_id", (F.col("lo") - 10).alias("lo"), (F.col("hi") + 10).alias("hi"))
    return bands.interval_exists(t.frame.select(*FRAME), s, ["game_id"], "frame_index", "lo", "hi", 32).where(~F.col("inside")).select(*FRAME)


@query("j14_proximity_exclusion", """
SELECT game_id, frame_index FROM frame f WHERE NOT EXISTS (SELECT 1 FROM verdict_log v WHERE v.game_id = f.game_id AND abs(v.frame_index * 7 - f.frame_index) <= 3)""")
def _(t):
    v = t.verdict_log.select("game_id", (F.col("frame_index") * 7).alias("lab"))
    return bands.band_exists(t.frame.select(*FRAME), v, ["game_id"], "frame_index", "lab", -3, 3).where(~F.col("near")).select(*FRAME)


@query("j15_window_block", """
SELECT game_id, frame_index FROM frame f WHERE NOT EXISTS (SELECT 1 FROM verdict_log v WHERE v.game_id = f.game_id AND v.verdict IS NOT NULL AND (v.frame_index * 7) // 50 = f.frame_index // 50)""")
def _(t):
    w = F.floor(F.col("frame_index") / 50)
    b = t.verdict_log.where("verdict IS NOT NULL").select("game_id", F.floor(F.col("frame_index") * 7 / 50).alias("w")).distinct()
    return t.frame.select(*FRAME, w.alias("w")).join(b, ["game_id", "w"], "left_anti").select(*FRAME)


NEAR = """
nm AS (SELECT c.clip, c.frame_index, c.detection_id, c.confidence, min(sqrt(power((c.x - m.x) * 1920, 2) + power((c.y - m.y) * 1080, 2))) AS d
  FROM ball_candidate c LEFT JOIN ball_mark m USING (clip, frame_index) GROUP BY ALL),
n1 AS (SELECT *, d AS near_px FROM nm)"""


@query("j16_nearest_mark", f"WITH {NEAR} SELECT clip, frame_index, detection_id, round(near_px, 4) AS near_px FROM n1")
def _(t):
    return joins.nearest_mark(t.ball_candidate, t.ball_mark, ["clip", "frame_index"]).select(
        "clip", "frame_index", "detection_id", F.round("near_px", 4).alias("near_px"))


@query("j16_detector_upper_bound", f"""
WITH {NEAR}, fr AS (SELECT DISTINCT clip, frame_index FROM ball_mark), rd AS (SELECT unnest([50.0, 100.0, 200.0])::DOUBLE AS radius)
SELECT radius, count(*) AS ball_frames, count_if(best <= radius)::BIGINT AS det_any, count_if(strong <= radius)::BIGINT AS det_strong FROM (
 SELECT fr.clip, fr.frame_index, min(near_px) AS best, min(CASE WHEN confidence >= 0.6 THEN near_px END) AS strong FROM fr LEFT JOIN n1 USING (clip, frame_index) GROUP BY ALL), rd GROUP BY radius""")
def _(t):
    from matchgrid.operators.metrics import upper_bound

    near = joins.nearest_mark(t.ball_candidate, t.ball_mark, ["clip", "frame_index"])
    return upper_bound(near, t.ball_mark, ["clip", "frame_index"], [50.0, 100.0, 200.0], 0.6)


@query("j17_three_key_sets", """
WITH b AS (SELECT DISTINCT game_id, frame_index FROM detection WHERE source = 'hand_label'), c AS (SELECT DISTINCT game_id, frame_index FROM verdict_log),
m AS (SELECT DISTINCT game_id, frame_index FROM frame_label_state WHERE state = 'absent')
SELECT game_id, frame_index, b.game_id IS NOT NULL AS has_boxes, c.game_id IS NOT NULL AS has_checks, m.game_id IS NOT NULL AS has_marker
FROM b FULL JOIN c USING (game_id, frame_index) FULL JOIN m USING (game_id, frame_index)""")
def _(t):
    return joins.frame_keys_union(t.detection.where("source = 'hand_label'"), t.verdict_log, t.frame_label_state.where("state = 'absent'"), FRAME)


@query("p27_tracking_kind", """
WITH b AS (SELECT game_id, frame_index, bool_or(label = 'in_play_ball') AS lb FROM detection WHERE source = 'hand_label' GROUP BY ALL), c AS (SELECT DISTINCT game_id, frame_index FROM verdict_log),
m AS (SELECT game_id, frame_index, CASE WHEN bool_or(state = 'partial') THEN 'not_broadcast' WHEN bool_or(state = 'absent') THEN 'no_ball' END AS marker FROM frame_label_state GROUP BY ALL)
SELECT game_id, frame_index, CASE WHEN marker = 'not_broadcast' THEN 'not_broadcast' WHEN lb THEN 'ball' WHEN marker = 'no_ball' THEN 'no_ball' WHEN b.game_id IS NOT NULL THEN 'other_boxes'
  WHEN c.game_id IS NOT NULL THEN 'check_only' ELSE 'empty' END AS kind FROM b FULL JOIN c USING (game_id, frame_index) FULL JOIN m USING (game_id, frame_index)""")
def _(t):
    b = t.detection.where("source = 'hand_label'").groupBy(*FRAME).agg(F.bool_or(boxes.is_ball()).alias("lb"))
    c = t.verdict_log.select(*FRAME).distinct().withColumn("c", F.lit(True))
    m = t.frame_label_state.groupBy(*FRAME).agg(F.bool_or(F.col("state") == "partial").alias("p"), F.bool_or(F.col("state") == "absent").alias("a"))
    j = b.join(c, FRAME, "full").join(m, FRAME, "full")
    mark = F.when(F.col("p"), "not_broadcast").when(F.col("a"), "no_ball")
    return j.select(*FRAME, tracking_kind(mark, F.coalesce("lb", F.lit(False)), F.col("lb").isNotNull(), F.coalesce("c", F.lit(False))).alias("kind"))


PROJ = f"""
WITH {BEST},
cb AS (SELECT game_id, frame_index, h1, h2, h3, h4, h5, h6, h7, h8, h9, distortion_k1 AS k1, quality FROM best WHERE quality >= 0.2),
a AS (SELECT d.*, cb.*, d.bbox_x + d.bbox_w / 2 AS ax, CASE WHEN label = 'in_play_ball' THEN bbox_y + bbox_h / 2 ELSE bbox_y + bbox_h END AS ay FROM detection d LEFT JOIN cb USING (game_id, frame_index)),
u AS (SELECT *, CASE WHEN k1 = 0 THEN ax ELSE 0.5 + (ax - 0.5) / (1 + k1 * (power(2 * (ax - 0.5), 2) + power(2 * (ay - 0.5) / (CAST(16 AS DOUBLE) / 9), 2))) END AS ux,
   CASE WHEN k1 = 0 THEN ay ELSE 0.5 + (ay - 0.5) / (1 + k1 * (power(2 * (ax - 0.5), 2) + power(2 * (ay - 0.5) / (CAST(16 AS DOUBLE) / 9), 2))) END AS uy FROM a),
x AS (SELECT *, (h1 * ux + h2 * uy + h3) / (h7 * ux + h8 * uy + h9) AS xm, (h4 * ux + h5 * uy + h6) / (h7 * ux + h8 * uy + h9) AS ym FROM u)"""


@query("p10_project_boxes", PROJ + """
SELECT game_id, frame_index, detection_id, h1 IS NOT NULL AS calib_ok, round(xm, 7) AS x_m, round(ym, 7) AS y_m, coalesce(abs(xm) <= 52.5 AND abs(ym) <= 34, false) AS in_pitch,
 coalesce(abs(xm) <= 57.5 AND abs(ym) <= 39, false) AS in_bounds FROM x""")
def _(t):
    cal = store.best_calibration(with_h(t.calibration)).where("quality >= 0.2").select(
        *FRAME, "H", F.col("distortion_k1").alias("k1"), F.col("quality").alias("calib_confidence"))
    d = joins.project_boxes(t.detection, cal)
    num = lambda c: F.round(F.when(~F.isnan(c), F.col(c)), 7).alias(c)
    return d.select(*FRAME, "detection_id", "calib_ok", num("x_m"), num("y_m"), "in_pitch", "in_bounds")


@query("j18_project_match", PROJ + """
SELECT game_id, count(*) AS n, count(xm) AS projected, count_if(abs(xm) <= 57.5 AND abs(ym) <= 39)::BIGINT AS in_bounds FROM x GROUP BY game_id""")
def _(t):
    cal = store.best_calibration(with_h(t.calibration)).where("quality >= 0.2").select(
        *FRAME, "H", F.col("distortion_k1").alias("k1"), F.col("quality").alias("calib_confidence"))
    d = joins.project_boxes(t.detection, cal)
    return d.groupBy("game_id").agg(F.count("*").alias("n"), F.count(F.when(~F.isnan("x_m"), 1)).alias("projected"), F.count_if("in_bounds").alias("in_bounds"))


@query("j19_snapshot_diff", """
WITH p AS (SELECT item_id, split, sha256(concat_ws('|', item_id, label_kind)) AS h FROM item WHERE frame_index % 7 <> 0),
c AS (SELECT item_id, split, sha256(concat_ws('|', item_id, CASE WHEN tier = 2 THEN 'ball' ELSE label_kind END)) AS h FROM item WHERE frame_index % 11 <> 0)
SELECT item_id, coalesce(c.split, p.split) AS split, CASE WHEN p.h IS NULL THEN 'added' WHEN c.h IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM c FULL JOIN p USING (item_id) WHERE p.h IS NULL OR c.h IS NULL OR p.h <> c.h""")
def _(t):
    p = snapshots.item_hash(t.item.where("frame_index % 7 <> 0"), ["item_id", "label_kind"])
    c = t.item.where("frame_index % 11 <> 0").withColumn("label_kind", F.when(F.col("tier") == 2, "ball").otherwise(F.col("label_kind")))
    return snapshots.diff_items(snapshots.item_hash(c, ["item_id", "label_kind"]), p)


CONTAM = """
tr AS (SELECT CASE WHEN frame_index % 50 = 7 THEN concat('g', (CAST(substr(clip, 2) AS INT) + 3) % 25) ELSE clip END AS clip, concat('m', CAST(substr(clip, 2) AS INT) // 3) AS match_key, split FROM item),
fl AS (SELECT 'eval_heldout_match' AS split, count_if(match_key IN (SELECT match_key FROM tr WHERE split = 'train'))::BIGINT AS n_contaminated, count(*) AS n FROM tr WHERE split = 'eval_heldout_match'
 UNION ALL SELECT 'eval_in_match', count_if(clip IN (SELECT clip FROM tr WHERE split = 'train'))::BIGINT, count(*) FROM tr WHERE split = 'eval_in_match')"""


def keyed_items(t):
    n = F.substring("clip", 2, 9).cast("int")
    moved = F.when(F.col("frame_index") % 50 == 7, F.concat(F.lit("g"), (n + 3) % 25)).otherwise(F.col("clip"))
    return t.item.select(moved.alias("clip"), F.concat(F.lit("m"), F.floor(n / 3)).alias("match_key"), "split")


@query("j20_contamination", f"WITH {CONTAM} SELECT split, n_contaminated, n, n_contaminated > 0 AS contaminated FROM fl")
def _(t):
    d = keyed_items(t)
    return snapshots.contamination(d, d)


@query("p30_contamination_flags", f"""
WITH {CONTAM}, f2 AS (SELECT *, n_contaminated > 0 AS contaminated FROM fl)
SELECT split, n_contaminated, n, contaminated FROM f2 UNION ALL SELECT 'eval_all', sum(n_contaminated)::BIGINT, sum(n)::BIGINT, bool_or(contaminated) FROM f2 UNION ALL SELECT 'train', 0, 0, NULL""")
def _(t):
    d = keyed_items(t)
    return snapshots.with_overall_flag(snapshots.contamination(d, d))


@query("j22_near_training_frames", """
WITH tr AS (SELECT DISTINCT clip, frame_index FROM item WHERE split = 'train' AND tier = 1)
SELECT i.item_id, EXISTS (SELECT 1 FROM tr WHERE tr.clip = i.clip AND abs(tr.frame_index - i.frame_index) <= 5) AS near_training FROM item i""")
def _(t):
    tr = t.item.where("split = 'train' AND tier = 1")
    return joins.near_frames(t.item, tr, "clip", "frame_index").select("item_id", "near_training")


@query("j23_window_progress", """
WITH n AS (SELECT game_id, max(frame_index) + 1 AS n FROM frame GROUP BY ALL), w AS (SELECT game_id, unnest(range(n // 50)) AS win FROM n),
done AS (SELECT game_id, frame_index FROM frame_label_state WHERE state IN ('complete', 'absent') GROUP BY ALL HAVING count(DISTINCT cls_group) = 2),
c AS (SELECT game_id, frame_index // 50 AS win, count(*) AS complete FROM done GROUP BY ALL),
l AS (SELECT game_id, frame_index // 50 AS win, count(DISTINCT frame_index) AS labelled FROM detection WHERE source = 'hand_label' GROUP BY ALL),
a AS (SELECT game_id, frame_index // 50 AS win, avg(confidence) AS agreement FROM detection WHERE confidence IS NOT NULL GROUP BY ALL)
SELECT game_id, CAST(win AS BIGINT) AS win, coalesce(complete, 0) AS complete, coalesce(labelled, 0) AS labelled, round(agreement, 6) AS agreement FROM w LEFT JOIN c USING (game_id, win) LEFT JOIN l USING (game_id, win) LEFT JOIN a USING (game_id, win)
WHERE coalesce(complete, 0) <= 0.2 * 50""")
def _(t):
    ag = t.detection.where("confidence IS NOT NULL").select(*FRAME, F.col("confidence").alias("agreement"))
    d = joins.window_progress(t.frame, aggs.frame_complete(t.frame_label_state), t.detection.where("source = 'hand_label'"), ag, 50, 0.2)
    return d.select("game_id", "win", "complete", "labelled", F.round("agreement", 6).alias("agreement"))


NB = """
pt AS (SELECT clip, frame_index AS f, detection_id, x * 1280 AS x, y * 720 AS y FROM ball_candidate), pf AS (SELECT DISTINCT game_id AS clip, frame_index AS f FROM frame WHERE is_broadcast IS NOT NULL),
nb AS (SELECT a.clip, a.f, a.detection_id, min(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))) AS d FROM pt a LEFT JOIN pt b ON a.clip = b.clip AND b.f = a.f + 1 GROUP BY ALL)"""


@query("j24_neighbour_samples", f"""
WITH {NB} SELECT nb.clip, nb.f AS frame_index, nb.detection_id, round(CASE WHEN pf.f IS NULL THEN NULL ELSE coalesce(d, 999) END, 4) AS d_next FROM nb LEFT JOIN pf ON pf.clip = nb.clip AND pf.f = nb.f + 1""")
def _(t):
    pf = t.frame.where("is_broadcast IS NOT NULL").select(F.col("game_id").alias("clip"), "frame_index")
    d = joins.neighbour_distance(t.ball_candidate, pf, "clip", "frame_index", "detection_id", 1, out="d_next")
    return d.select("clip", "frame_index", "detection_id", F.round(F.when(~F.isnan("d_next"), F.col("d_next")), 4).alias("d_next"))


@query("p28_node_plausibility", f"""
WITH {NB}, q AS (SELECT nb.clip, nb.f, nb.detection_id, d, pf.f IS NOT NULL AS seen FROM nb LEFT JOIN pf ON pf.clip = nb.clip AND pf.f = nb.f + 1)
SELECT clip, f AS frame_index, detection_id, CASE WHEN NOT seen THEN NULL ELSE coalesce(d <= 60, false) END AS plausible, CASE WHEN seen THEN coalesce(d <= 2, false) END AS static_nb FROM q""")
def _(t):
    from matchgrid.functions.candidates import near_sample

    pf = t.frame.where("is_broadcast IS NOT NULL").select(F.col("game_id").alias("clip"), "frame_index")
    d = joins.neighbour_distance(t.ball_candidate, pf, "clip", "frame_index", "detection_id", 1)
    return d.select("clip", "frame_index", "detection_id", near_sample("d", 60.0).alias("plausible"), near_sample("d", 2.0).alias("static_nb"))


MERGE = f"""
ma AS (SELECT clip, frame_index, detection_id AS ida, x * 1280 AS xa, y * 720 AS ya, confidence AS pa FROM ball_candidate WHERE detection_id % 2 = 0),
mb AS (SELECT clip, frame_index, detection_id AS idb, x * 1280 AS xb, y * 720 AS yb, confidence AS pb FROM ball_candidate WHERE detection_id % 2 = 1),
mp AS (SELECT ma.clip, ma.frame_index, ida, idb, sqrt(power(xa - xb, 2) + power(ya - yb, 2)) AS dist FROM ma JOIN mb USING (clip, frame_index) WHERE sqrt(power(xa - xb, 2) + power(ya - yb, 2)) <= 60),
{fold_sql('mp', 'clip, frame_index', 'ida', 'idb', 'dist, ida, idb')},
mm AS (SELECT clip, frame_index, md AS ida, mg AS idb FROM fold WHERE md IS NOT NULL),
mx AS (SELECT clip, frame_index, ida, idb, xa, ya, pa, xb, yb, pb FROM ma LEFT JOIN mm USING (clip, frame_index, ida) LEFT JOIN mb USING (clip, frame_index, idb)),
my AS (SELECT clip, frame_index, ida, idb, CASE WHEN pb IS NULL OR pa >= pb THEN xa ELSE xb END AS x, CASE WHEN pb IS NULL OR pa >= pb THEN ya ELSE yb END AS y,
   CASE WHEN idb IS NULL THEN pa ELSE 1 / (1 + exp(-(ln(greatest(0.000001, least(0.999999, greatest(pa, pb))) / (1 - greatest(0.000001, least(0.999999, greatest(pa, pb))))) + 0.5))) END AS p FROM mx
  UNION ALL SELECT clip, frame_index, NULL, idb, xb, yb, pb FROM mb WHERE NOT EXISTS (SELECT 1 FROM mm WHERE mm.clip = mb.clip AND mm.frame_index = mb.frame_index AND mm.idb = mb.idb))"""


@query("j26_two_source_merge", f"WITH RECURSIVE {MERGE} SELECT clip, frame_index, ida, idb, round(x, 4) AS x, round(y, 4) AS y, round(p, 6) AS p FROM my")
def _(t):
    c = t.ball_candidate.select("clip", "frame_index", F.col("detection_id").alias("id"), (F.col("x") * 1280).alias("x"), (F.col("y") * 720).alias("y"), F.col("confidence").alias("p"))
    c = cut_lineage(c)  # both sources are read several times, and numbering the boxes moves whole rows
    d = joins.merge_two_sources(c.where("id % 2 = 0"), c.where("id % 2 = 1"), ["clip", "frame_index"], 60.0, 0.5)
    return d.select("clip", "frame_index", "ida", "idb", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round("p", 6).alias("p"))


REPRO = """
cp AS (SELECT * FROM calibration WHERE review_status NOT IN ('rejected', 'not_broadcast')),
kp AS (SELECT k.*, c.run_id, c.source, h1, h2, h3, h4, h5, h6, h7, h8, h9, h1 * (h5 * h9 - h6 * h8) - h2 * (h4 * h9 - h6 * h7) + h3 * (h4 * h8 - h5 * h7) AS det,
  (h5 * h9 - h6 * h8) * pitch_x + (h3 * h8 - h2 * h9) * pitch_y + (h2 * h6 - h3 * h5) AS ix, (h6 * h7 - h4 * h9) * pitch_x + (h1 * h9 - h3 * h7) * pitch_y + (h3 * h4 - h1 * h6) AS iy,
  (h4 * h8 - h5 * h7) * pitch_x + (h2 * h7 - h1 * h8) * pitch_y + (h1 * h5 - h2 * h4) AS iw FROM keypoint k JOIN cp c USING (game_id, frame_index)),
rp AS (SELECT *, CASE WHEN iw <> 0 AND det <> 0 AND iw / det > 1e-12 THEN sqrt(power((ix / iw - u) * 1920, 2) + power((iy / iw - v) * 1080, 2)) END AS err_px,
  sqrt(power((h1 * u + h2 * v + h3) / (h7 * u + h8 * v + h9) - pitch_x, 2) + power((h4 * u + h5 * v + h6) / (h7 * u + h8 * v + h9) - pitch_y, 2)) AS err_m FROM kp)"""


def reprojected(t):
    c = with_h(t.calibration.where("review_status NOT IN ('rejected', 'not_broadcast')")).select(*FRAME, "run_id", "source", "H")
    return joins.reprojection(t.keypoint, c, FRAME)


@query("j28_reprojection_error", f"WITH {REPRO} SELECT game_id, frame_index, point_idx, run_id, round(err_px, 3) AS err_px, round(err_m, 5) AS err_m FROM rp")
def _(t):
    return reprojected(t).select(*FRAME, "point_idx", "run_id", F.round("err_px", 3).alias("err_px"), F.round("err_m", 5).alias("err_m"))


@query("a48_calibration_summary", f"""
WITH {REPRO}, f AS (SELECT run_id, game_id, frame_index, avg(err_px) AS mean_px FROM rp GROUP BY ALL)
SELECT run_id, CASE WHEN CAST(substr(game_id, 2) AS INT) < 4 THEN 'eval_heldout_match' ELSE 'train' END AS split, count(*) AS frames, count(DISTINCT game_id) AS clips, count_if(mean_px <= 5)::BIGINT AS ok5, count_if(mean_px <= 500)::BIGINT AS ok500,
  round(avg(mean_px), 2) AS mean_px, round(quantile_cont(mean_px, 0.5), 3) AS median_px FROM f GROUP BY ALL""")
def _(t):
    f = reprojected(t).groupBy("run_id", *FRAME).agg(F.avg("err_px").alias("mean_px"))
    split = F.when(F.substring("game_id", 2, 9).cast("int") < 4, "eval_heldout_match").otherwise("train")
    f = f.withColumn("split", split)
    g = f.groupBy("run_id", "split").agg(F.count("*").alias("frames"), F.countDistinct("game_id").alias("clips"), F.count_if(F.col("mean_px") <= 5).alias("ok5"),
                                         F.count_if(F.col("mean_px") <= 500).alias("ok500"), F.round(F.avg("mean_px"), 2).alias("mean_px"))
    return aggs.with_quantiles(g, f, ["run_id", "split"], "mean_px", {"median_px": 0.5}).withColumn("median_px", F.round("median_px", 3))


@query("j29_audit_failure_spread", """
SELECT c.clip, c.frame_index, c.detection_id, round(c.confidence + CASE WHEN EXISTS (SELECT 1 FROM verdict_log v WHERE v.verdict = 'not_ball' AND v.game_id = c.clip AND abs(v.frame_index * 7 - c.frame_index) <= 25) THEN 1 ELSE 0 END, 6) AS score FROM ball_candidate c""")
def _(t):
    v = t.verdict_log.where("verdict = 'not_ball'").select(F.col("game_id").alias("clip"), (F.col("frame_index") * 7).alias("fail"))
    d = bands.band_exists(t.ball_candidate, v, ["clip"], "frame_index", "fail", -25, 25)
    return d.select("clip", "frame_index", "detection_id", F.round(F.col("confidence") + F.when(F.col("near"), 1.0).otherwise(0.0), 6).alias("score"))


@query("j30_human_machine_disagreement", f"""
WITH {NEAR}, k AS (SELECT n1.*, EXISTS (SELECT 1 FROM ball_mark m WHERE m.clip = n1.clip AND m.frame_index = n1.frame_index) AS has_ball,
  CASE WHEN confidence >= 0.4 THEN 'ball' ELSE 'not_ball' END AS verdict FROM n1)
SELECT clip, frame_index, detection_id, CASE WHEN NOT has_ball AND verdict = 'ball' THEN 'false_ball_no_ball_frame' WHEN near_px <= 150 AND verdict = 'not_ball' THEN 'false_not_ball'
  WHEN has_ball AND coalesce(near_px > 150, true) AND verdict = 'ball' THEN 'false_ball' ELSE 'agree' END AS disagreement FROM k""")
def _(t):
    from matchgrid.operators.metrics import machine_disagreement

    near = joins.nearest_mark(t.ball_candidate, t.ball_mark, ["clip", "frame_index"])
    near = aggs.flag_in(near, t.ball_mark, ["clip", "frame_index"], "has_ball").withColumn(
        "verdict", F.when(F.col("confidence") >= 0.4, "ball").otherwise("not_ball"))
    return machine_disagreement(near, 150.0).select("clip", "frame_index", "detection_id", "disagreement")


@query("a24_node_training_labels", f"""
WITH {NEAR}, k AS (SELECT n1.*, EXISTS (SELECT 1 FROM ball_mark m WHERE m.clip = n1.clip AND m.frame_index = n1.frame_index) AS has_ball,
  EXISTS (SELECT 1 FROM frame_label_state s WHERE s.game_id = n1.clip AND s.frame_index = n1.frame_index AND s.cls_group = 'ball' AND s.state = 'absent') AS nob FROM n1)
SELECT clip, frame_index, detection_id, CAST(CASE WHEN near_px <= 100 THEN 1 WHEN (has_ball AND coalesce(near_px > 150, true)) OR nob THEN 0 ELSE -1 END AS INT) AS label FROM k""")
def _(t):
    from matchgrid.operators.metrics import node_labels

    near = joins.nearest_mark(t.ball_candidate, t.ball_mark, ["clip", "frame_index"])
    near = aggs.flag_in(near, t.ball_mark, ["clip", "frame_index"], "has_ball")
    nob = t.frame_label_state.where("cls_group = 'ball' AND state = 'absent'").select(F.col("game_id").alias("clip"), "frame_index")
    return node_labels(aggs.flag_in(near, nob, ["clip", "frame_index"], "no_ball"), 100.0, 150.0).select("clip", "frame_index", "detection_id", "label")


SIM = """
vv AS (SELECT vec_id % 40 AS g, vec_id, embedding, row_number() OVER (PARTITION BY vec_id % 40 ORDER BY vec_id) AS r1, row_number() OVER (PARTITION BY vec_id % 40 ORDER BY vec_id DESC) AS r2 FROM embeddings),
ua AS (SELECT g AS a, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM vv WHERE r2 <= 3), ub AS (SELECT g AS b, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM vv WHERE r1 <= 3),
ma AS (SELECT a, pos, avg(v) AS va FROM ua GROUP BY ALL), mb AS (SELECT b, pos, avg(v) AS vb FROM ub GROUP BY ALL),
li AS (SELECT DISTINCT vec_id % 40 AS a, (vec_id + label) % 40 AS b FROM embeddings WHERE vec_id % 40 <> (vec_id + label) % 40)"""


@query("j31_link_similarity", f"""
WITH {SIM} SELECT a, b, round(sum(va * vb) / sqrt(sum(va * va) * sum(vb * vb)), 5) AS similarity FROM li JOIN ma USING (a) JOIN mb USING (b, pos) GROUP BY a, b""")
def _(t):
    v = t.embeddings.withColumn("g", F.col("vec_id") % 40)
    li = t.embeddings.select((F.col("vec_id") % 40).alias("a"), ((F.col("vec_id") + F.col("label")) % 40).alias("b")).where("a <> b").distinct()
    return joins.link_similarity(v, li, "g", "vec_id", "embedding").select("a", "b", F.round("similarity", 5).alias("similarity"))


@query("j33_gold_frames", """
WITH st AS (SELECT game_id, frame_index, max(CASE WHEN cls_group = 'ball' THEN state END) AS bs FROM frame_label_state WHERE method IN ('hand_series', 'hand_frame', 'verdict') AND state IN ('complete', 'absent') GROUP BY ALL HAVING bool_or(cls_group = 'ball')),
g AS (SELECT game_id, frame_index, arg_min((bbox_x + bbox_w / 2) * 1920, detection_id) AS gx FROM detection WHERE source = 'hand_label' AND label = 'in_play_ball' GROUP BY ALL),
p AS (SELECT game_id, frame_index, arg_min((bbox_x + bbox_w / 2) * 1920, detection_id) AS px FROM detection WHERE source <> 'hand_label' AND starts_with(run_id, 'yolo_') AND label = 'in_play_ball' GROUP BY ALL)
SELECT game_id, frame_index, bs AS ball_state, round(CASE WHEN bs = 'complete' THEN gx END, 4) AS gold_x, round(px, 4) AS pred_x FROM st LEFT JOIN g USING (game_id, frame_index) LEFT JOIN p USING (game_id, frame_index)""")
def _(t):
    from matchgrid.operators.metrics import gold_ball_frames

    return gold_ball_frames(t.frame_label_state, t.detection, "yolo_").select(
        *FRAME, "ball_state", F.round("gold_x", 4).alias("gold_x"), F.round("pred_x", 4).alias("pred_x"))


@query("j34_payload_ground_truth", """
SELECT item_id, CAST(json_extract(payload, '$.n') AS BIGINT) AS n, CASE WHEN label_kind = 'ball' THEN CASE WHEN tier <= 2 THEN 'gt' ELSE 'ignore' END WHEN label_kind = 'no_ball' THEN 'empty' ELSE 'none' END AS role FROM item""")
def _(t):
    n = F.from_json("payload", "n bigint")["n"]
    role = F.when(F.col("label_kind") == "ball", F.when(F.col("tier") <= 2, "gt").otherwise("ignore")).when(F.col("label_kind") == "no_ball", "empty").otherwise("none")
    return t.item.select("item_id", n.alias("n"), role.alias("role"))


@query("a38_content_hash", """
WITH i AS (SELECT item_id, sha256(concat_ws('|', item_id, split, label_kind, payload)) AS h FROM item),
b AS (SELECT substr(sha1(item_id), 1, 4) AS b, sha256(string_agg(item_id || ' ' || h, chr(10) ORDER BY item_id || ' ' || h)) AS bh, count(*) AS n FROM i GROUP BY ALL)
SELECT sha256(string_agg(bh, chr(10) ORDER BY b)) AS content_hash, CAST(sum(n) AS BIGINT) AS n_items FROM b""")
def _(t):
    return snapshots.content_hash(snapshots.item_hash(t.item, ["item_id", "split", "label_kind", "payload"]))


@query("a06_count_summary", """
SELECT split, label_kind, CAST(tier AS INT) AS tier, count(*) AS n, count(DISTINCT clip) AS clips, CAST(grouping_id(split, label_kind, tier) AS BIGINT) AS level FROM item GROUP BY GROUPING SETS ((split), (split, label_kind), (split, tier))""")
def _(t):
    return snapshots.count_summary(t.item)
