"""Window operators over frame sequences, logs and candidate pools."""

from pyspark.sql import functions as F

from matchgrid.catalog.registry import query
from matchgrid.functions import ids
from matchgrid.functions.stats import logit
from matchgrid.operators import logs, windows
from matchgrid.operators.review import disagreement, merge_passes, preverify, spread_order


@query("w04_latest_verdicts", """
SELECT game_id, vsource, frame_index, box_index, verdict, line_no, confidence FROM (
 SELECT *, row_number() OVER (PARTITION BY game_id, vsource, frame_index, box_index ORDER BY ts DESC, line_no DESC) AS rn FROM verdict_log)
WHERE rn = 1 AND verdict IS NOT NULL""")
def _(t):
    return logs.latest_verdicts(t.verdict_log).select(
        "game_id", "vsource", "frame_index", "box_index", "verdict", "line_no", "confidence")


PAIRS = """
pl AS (SELECT clip, least(a, b) AS lo, greatest(a, b) AS hi, verdict, line_no FROM pair_log),
pair AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clip, lo, hi ORDER BY line_no DESC) AS rn FROM pl) WHERE rn = 1 AND verdict IS NOT NULL)"""


@query("w05_latest_pair_labels", f"WITH {PAIRS} SELECT clip, lo, hi, verdict, line_no FROM pair")
def _(t):
    d = logs.latest_pair_labels(t.pair_log, [F.col("clip"), F.col("a")], [F.col("clip"), F.col("b")], ["line_no"])
    return d.select(F.col("lo.k0").alias("clip"), F.col("lo.k1").alias("lo"), F.col("hi.k1").alias("hi"), "verdict", "line_no")


@query("w06_smooth_mask", """
WITH o AS (SELECT clip, frame, frame - lag(frame) OVER (PARTITION BY clip ORDER BY frame) - 1 AS hole FROM frame_status WHERE is_on),
s AS (SELECT *, sum(CASE WHEN hole IS NULL OR hole > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY clip ORDER BY frame) AS seg FROM o)
SELECT clip, min(frame) AS "start", max(frame) AS "end" FROM s GROUP BY clip, seg HAVING max(frame) - min(frame) + 1 >= 4""")
def _(t):
    return windows.smooth_mask(t.frame_status, ["clip"], "frame", "is_on", merge_gap=2, min_len=4, span=64)


RUNS = """
b AS (SELECT clip, frame, {v} AS v, CASE WHEN {v} IS DISTINCT FROM lag({v}) OVER (PARTITION BY clip ORDER BY frame)
       OR row_number() OVER (PARTITION BY clip ORDER BY frame) = 1 THEN 1 ELSE 0 END AS nw FROM frame_status),
i AS (SELECT *, sum(nw) OVER (PARTITION BY clip ORDER BY frame) AS run_no FROM b),
r AS (SELECT clip, CAST(run_no AS BIGINT) AS run_no, v, min(frame) AS "start", max(frame) AS "end", count(*) AS n FROM i GROUP BY ALL)"""


@query("w07_run_length", f"WITH {RUNS.format(v='code')} SELECT clip, run_no, v AS code, \"start\", \"end\", n FROM r")
def _(t):
    return windows.runs(t.frame_status, ["clip"], "frame", "code", span=64)


@query("w08_next_bad_run", f"""
WITH {RUNS.format(v='code')}
SELECT clip, "start", v AS code,
 min(CASE WHEN v <> 2 THEN "start" END) OVER (PARTITION BY clip ORDER BY "start" ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_start,
 max(CASE WHEN v <> 2 THEN "start" END) OVER (PARTITION BY clip ORDER BY "start" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_start
FROM r""")
def _(t):
    r = windows.runs(t.frame_status, ["clip"], "frame", "code", span=64)
    return windows.run_neighbours(r, ["clip"], "code", F.col("code") != 2, span=64).select(
        "clip", "start", "code", "next_start", "prev_start")


@query("w09_count_flicker", f"""
WITH {RUNS.format(v='person_count')}
SELECT clip, "start", v AS person_count, n, coalesce(lag(v) OVER w = lead(v) OVER w AND n <= 2, false) AS flicker FROM r
WINDOW w AS (PARTITION BY clip ORDER BY "start")""")
def _(t):
    r = windows.runs(t.frame_status, ["clip"], "frame", "person_count", span=64)
    return windows.flicker_runs(r, ["clip"], "person_count", 2, span=64).select("clip", "start", "person_count", "n", "flicker")


@query("w09_change_points", """
SELECT clip, frame, person_count FROM (SELECT *, lag(person_count) OVER (PARTITION BY clip ORDER BY frame) AS p FROM frame_status)
WHERE p IS NOT NULL AND p <> person_count""")
def _(t):
    return windows.change_points(t.frame_status, ["clip"], "frame", "person_count", span=64).select("clip", "frame", "person_count")


@query("w10_rolling_outlier", """
SELECT clip, frame, person_count, m AS median, coalesce(m <> person_count, false) AS outlier FROM (
SELECT *, CAST(round_even(median(person_count) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING EXCLUDE CURRENT ROW), 0) AS BIGINT) AS m
FROM frame_status)""")
def _(t):
    d = windows.rolling_outlier(t.frame_status, ["clip"], "frame", "person_count", 5, span=64)
    return d.select("clip", "frame", "person_count", "median",
                    F.coalesce(F.col("median") != F.col("person_count"), F.lit(False)).alias("outlier"))


GAPS = """
g AS (SELECT clip, frame, value, is_on,
  last_value(CASE WHEN is_on THEN frame END IGNORE NULLS) OVER w1 AS pf, last_value(CASE WHEN is_on THEN value END IGNORE NULLS) OVER w1 AS pv,
  first_value(CASE WHEN is_on THEN frame END IGNORE NULLS) OVER w2 AS nf, first_value(CASE WHEN is_on THEN value END IGNORE NULLS) OVER w2 AS nv
  FROM frame_status WINDOW w1 AS (PARTITION BY clip ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  w2 AS (PARTITION BY clip ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("w11_gap_interpolate", f"""
WITH {GAPS}
SELECT clip, frame, CASE WHEN is_on THEN 'detected' WHEN nf - pf <= 3 THEN 'interpolated' ELSE 'none' END AS origin,
 round(CASE WHEN is_on THEN value WHEN nf - pf <= 3 THEN pv + (nv - pv) * ((frame - pf) / (nf - pf)) END, 4) AS value_i FROM g""")
def _(t):
    d = windows.gap_interpolate(t.frame_status, ["clip"], "frame", F.col("is_on"), ["value"], 3, span=64)
    return d.select("clip", "frame", "origin", F.round("value_i", 4).alias("value_i"))


@query("p31_gap_plausibility", f"""
WITH {GAPS}
SELECT clip, frame, round(least(1.0, sqrt((pv % 1) * (nv % 1)) * power(0.85, nf - pf - 2)), 6) AS plausibility FROM g
WHERE NOT is_on AND nf - pf <= 6""")
def _(t):
    from matchgrid.functions.candidates import gap_plausibility

    d = windows.gap_interpolate(t.frame_status, ["clip"], "frame", F.col("is_on"), ["value"], 6, span=64)
    from matchgrid.operators.ordered import with_known

    val = F.when(F.col("is_on"), F.col("value") % 1)
    d = with_known(d, ["clip"], ["frame"], val, "l", span=64)
    d = with_known(d, ["clip"], ["frame"], val, "r", back=False, span=64)
    run = F.col("gap_left") + F.col("gap_right") - 1
    return d.where("origin = 'interpolated'").select(
        "clip", "frame", F.round(gap_plausibility("l", "r", run), 6).alias("plausibility"))


@query("w12_rank_in_frame", """
SELECT match, clip, frame, node_id, CAST(rank() OVER (PARTITION BY match, clip, frame ORDER BY p_real DESC) - 1 AS BIGINT) AS frame_rank FROM pool""")
def _(t):
    return windows.rank_in_frame(t.pool, ["match", "clip", "frame"], "p_real").select("match", "clip", "frame", "node_id", "frame_rank")


@query("w13_top_candidates", """
SELECT clip, frame_index, detection_id, CAST(rn AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY clip, frame_index
 ORDER BY confidence DESC, detection_id) AS rn FROM ball_candidate WHERE confidence >= 0.1) WHERE rn <= 2""")
def _(t):
    d = windows.top_k(t.ball_candidate.where("confidence >= 0.1"), ["clip", "frame_index"],
                      [F.desc("confidence"), F.col("detection_id")], 2, out="place")
    return d.select("clip", "frame_index", "detection_id", F.col("place").cast("long").alias("place"))


@query("w14_spread_order", """
WITH k AS (SELECT clip, frame_index, detection_id, sha1(concat(clip, ':', frame_index, ':', detection_id)) AS h FROM ball_candidate),
r AS (SELECT *, row_number() OVER (PARTITION BY clip, frame_index // 25 ORDER BY h) - 1 AS bucket_rank FROM k)
SELECT clip, frame_index, detection_id, CAST(bucket_rank AS BIGINT) AS bucket_rank, row_number() OVER (ORDER BY bucket_rank, h) AS position FROM r""")
def _(t):
    return spread_order(t.ball_candidate, "clip", "frame_index", "detection_id").select(
        "clip", "frame_index", "detection_id", "bucket_rank", "position")


@query("w15_track_support", """
WITH d AS (SELECT clip, frame, code, value, CASE WHEN code IS DISTINCT FROM lag(code) OVER (PARTITION BY clip ORDER BY frame) THEN 1 ELSE 0 END AS nw FROM frame_status),
i AS (SELECT *, sum(nw) OVER (PARTITION BY clip ORDER BY frame) AS r FROM d)
SELECT clip, frame, round(sum(value) OVER (PARTITION BY clip, r), 4) AS support FROM i""")
def _(t):
    d = windows.track_support(t.frame_status, ["clip"], "frame", "code", F.col("value"), "support", span=64)
    return d.select("clip", "frame", F.round("support", 4).alias("support"))


@query("w17_static_cells", """
WITH p AS (SELECT *, floor(x / 0.05) AS gx, floor(y / 0.05) AS gy FROM pool),
c AS (SELECT match, gx, gy FROM p GROUP BY ALL HAVING count(DISTINCT (clip, frame)) >= 6)
SELECT p.match, p.clip, p.frame, p.node_id, c.match IS NOT NULL AS static FROM p LEFT JOIN c USING (match, gx, gy)""")
def _(t):
    d = t.pool.withColumn("cf", F.struct("clip", "frame"))
    return windows.static_cells(d, ["match"], "cf", "x", "y", 0.05, 6).select("match", "clip", "frame", "node_id", "static")


@query("w19_timeline_tiles", """
WITH s AS (SELECT clip, start_frame AS s, end_frame + 1 AS e FROM tracklet),
c AS (SELECT *, coalesce(max(e) OVER (PARTITION BY clip ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cur FROM s)
SELECT clip, greatest(s, cur) AS lo, e AS hi, 'tracked' AS kind FROM c WHERE e > greatest(s, cur)
UNION ALL SELECT clip, cur, s, 'skipped' FROM c WHERE s > cur
UNION ALL SELECT clip, max(e), 4100, 'skipped' FROM s GROUP BY clip HAVING max(e) < 4100""")
def _(t):
    s = t.tracklet.select("clip", "start_frame", (F.col("end_frame") + 1).alias("end_frame"), F.lit(4100).alias("total"))
    return windows.tile_timeline(s, ["clip"], "start_frame", "end_frame", "total", span=512)


@query("w20_positional_id", """
SELECT game_id, frame_index, source, detection_id, row_number() OVER (PARTITION BY game_id, frame_index, source ORDER BY detection_id) - 1 AS position
FROM detection""")
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("game_id", "frame_index", "source").orderBy("detection_id")
    return t.detection.select("game_id", "frame_index", "source", "detection_id",
                              (F.row_number().over(w) - 1).cast("long").alias("position"))


@query("w21_longest_streak", f"""
WITH {RUNS.format(v='is_on')} SELECT clip, coalesce(max(CASE WHEN v THEN n END), 0) AS streak FROM r GROUP BY clip""")
def _(t):
    return windows.longest_streak(t.frame_status, ["clip"], "frame", "is_on", span=64)


MOTION = """
p AS (SELECT game_id, track_id, frame_index AS f, avg(bbox_y + bbox_h / 2) AS cy, max(bbox_h) AS h FROM detection WHERE track_id IS NOT NULL GROUP BY ALL),
m AS (SELECT a.game_id, a.track_id, a.f + 3 AS f, b.cy - a.cy AS dy FROM p a JOIN p b ON a.game_id = b.game_id AND a.track_id = b.track_id AND b.f = a.f + 6),
cam AS (SELECT game_id, f, quantile_disc(dy, 0.5) AS cam_dy FROM m GROUP BY ALL)"""


@query("w22_compensated_motion", f"""
WITH {MOTION} SELECT m.game_id, m.track_id, m.f AS frame_index, round(m.dy - cam.cam_dy, 6) AS rel_dy FROM m JOIN cam USING (game_id, f)""")
def _(t):
    from matchgrid.operators.review import compensated_motion

    return compensated_motion(t.detection, 3, median="disc").select(
        "game_id", "track_id", "frame_index", F.round("rel_dy", 6).alias("rel_dy"))


@query("w23_first_version", """
WITH parent AS (SELECT item_id, frame_index % 3 + 1 AS first_version FROM item WHERE frame_index % 5 <> 0)
SELECT i.item_id, coalesce(p.first_version, 4) AS first_version FROM item i LEFT JOIN parent p USING (item_id)""")
def _(t):
    parent = t.item.where("frame_index % 5 <> 0").select("item_id", (F.col("frame_index") % 3 + 1).alias("first_version"))
    return windows.first_version(t.item, parent, 4).select("item_id", "first_version")


@query("w24_uncertainty_order", """
WITH s AS (SELECT game_id, frame_index, detection_id, abs(1.2 * ln(greatest(0.000001, least(0.999999, confidence)) / (1 - greatest(0.000001, least(0.999999, confidence)))) - 0.3) AS score,
  floor(frame_index / 25 / 60) AS b FROM detection WHERE confidence IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY game_id, b ORDER BY round(score, 6), frame_index, detection_id) - 1 AS k FROM s)
SELECT game_id, frame_index, detection_id, k AS rank_in_bucket, round(score + 0.15 * k, 4) AS priority FROM r""")
def _(t):
    d = t.detection.where("confidence IS NOT NULL")
    score = F.round(F.abs(F.lit(1.2) * logit("confidence") - 0.3), 6)
    d = windows.bucket_penalty_order(d, ["game_id"], F.floor(F.col("frame_index") / 25 / 60), score,
                                     ["frame_index", "detection_id"], 0.15)
    return d.select("game_id", "frame_index", "detection_id", "rank_in_bucket", F.round("priority", 4).alias("priority"))


STRONG = """
b AS (SELECT clip, frame_index, arg_max((x, y, confidence), (confidence, -detection_id)) AS s, count(*) AS people FROM ball_candidate GROUP BY ALL),
q AS (SELECT clip, frame_index, s[1] AS x, s[2] AS y, s[3] AS confidence, people FROM b)"""


def strongest(t):
    return (t.ball_candidate.groupBy("clip", "frame_index")
            .agg(F.max_by(F.struct("x", "y", "confidence"), F.struct("confidence", -F.col("detection_id"))).alias("s"),
                 F.count("*").alias("people"))
            .select("clip", "frame_index", "s.*", "people"))


@query("w25_step_to_neighbours", f"""
WITH {STRONG.replace('s[1]', 's[1]')},
z AS (SELECT *, lag(frame_index) OVER w AS pf, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(frame_index) OVER w AS nf, lead(x) OVER w AS nx, lead(y) OVER w AS ny
  FROM q WINDOW w AS (PARTITION BY clip ORDER BY frame_index))
SELECT clip, frame_index, round(greatest(CASE WHEN frame_index - pf = 1 THEN sqrt((px - x) * (px - x) + (py - y) * (py - y)) END,
 CASE WHEN nf - frame_index = 1 THEN sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) END), 6) AS max_step FROM z""")
def _(t):
    return windows.step_to_neighbours(strongest(t), ["clip"], "frame_index", "x", "y", span=64).select(
        "clip", "frame_index", F.round("max_step", 6).alias("max_step"))


PASSES = """
fw AS (SELECT clip, frame_index, arg_max((x, y, confidence), (confidence, -detection_id)) AS s FROM ball_candidate WHERE detection_id % 3 <> 0 GROUP BY ALL),
bw AS (SELECT clip, frame_index, arg_max((x, y, confidence), (y, -detection_id)) AS s FROM ball_candidate WHERE detection_id % 3 <> 1 GROUP BY ALL),
pc AS (SELECT game_id AS clip, frame_index, count_if(label <> 'in_play_ball')::BIGINT AS people FROM detection GROUP BY ALL),
j AS (SELECT pc.clip, pc.frame_index, people, fw.s[1] AS fx, fw.s[2] AS fy, bw.s[1] AS bx, bw.s[2] AS by_, fw.s[3] AS fc
  FROM pc LEFT JOIN fw USING (clip, frame_index) LEFT JOIN bw USING (clip, frame_index)),
k AS (SELECT *, sqrt(power((fx - bx) * 1920, 2) + power((fy - by_) * 1080, 2)) AS gap, (fx IS NULL) <> (bx IS NULL) AS mismatch,
  CAST(round_even(median(people) OVER (PARTITION BY clip ORDER BY frame_index ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING EXCLUDE CURRENT ROW), 0) AS BIGINT) AS m FROM j),
sc AS (SELECT clip, frame_index, people, fx, fy, fc, round(gap, 4) AS gap, mismatch, CASE WHEN mismatch THEN 1.0::DOUBLE WHEN gap IS NULL THEN 0.0::DOUBLE
   ELSE round(least(greatest((gap - 60) / 180, 0), 1), 6) END AS ball_component, CASE WHEN m <> people THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS person_component,
   coalesce(m <> people, false) AS person_flag FROM k)"""


def passes(t):
    c = t.ball_candidate
    pos = F.struct("x", "y", "confidence")
    fw = c.where("detection_id % 3 <> 0").groupBy("clip", "frame_index").agg(
        F.max_by(pos, F.struct("confidence", -F.col("detection_id"))).alias("fwd"))
    bw = c.where("detection_id % 3 <> 1").groupBy("clip", "frame_index").agg(
        F.max_by(pos, F.struct("y", -F.col("detection_id"))).alias("bwd"))
    pc = t.detection.groupBy(F.col("game_id").alias("clip"), "frame_index").agg(
        F.count_if(F.col("label") != "in_play_ball").alias("people"))
    return pc.join(fw, ["clip", "frame_index"], "left").join(bw, ["clip", "frame_index"], "left")


@query("w18_disagreement", f"""
WITH {PASSES} SELECT clip, frame_index, gap, mismatch, ball_component, person_component, person_flag, greatest(ball_component, person_component) AS score FROM sc""")
def _(t):
    return disagreement(passes(t), "clip", "frame_index", "people", span=64).select(
        "clip", "frame_index", F.round("gap", 4).alias("gap"), "mismatch", F.round("ball_component", 6).alias("ball_component"),
        "person_component", "person_flag", F.round("score", 6).alias("score"))


@query("w26_preverify", f"""
WITH {PASSES},
st AS (SELECT *, lag(frame_index) OVER w AS pf, lag(fx) OVER w AS px, lag(fy) OVER w AS py, lead(frame_index) OVER w AS nf, lead(fx) OVER w AS nx, lead(fy) OVER w AS ny
  FROM sc WHERE fx IS NOT NULL WINDOW w AS (PARTITION BY clip ORDER BY frame_index)),
v AS (SELECT sc.*, coalesce(greatest(CASE WHEN st.frame_index - pf = 1 THEN sqrt(power((px - st.fx) * 1920, 2) + power((py - st.fy) * 1080, 2)) END,
   CASE WHEN nf - st.frame_index = 1 THEN sqrt(power((nx - st.fx) * 1920, 2) + power((ny - st.fy) * 1080, 2)) END), 0) AS step
   FROM sc LEFT JOIN st USING (clip, frame_index)),
rs AS (SELECT *, fx IS NULL AS r1, fx IS NOT NULL AND (mismatch OR coalesce(gap > 60, false)) AS r2, fx IS NOT NULL AND step > 900 AS r3 FROM v),
rr AS (SELECT *, fx IS NOT NULL AND NOT r2 AND NOT r3 AS asked FROM rs)
SELECT clip, frame_index, concat_ws(',', CASE WHEN r1 THEN 'no_ball_proposal' END, CASE WHEN r2 THEN 'tracker_disagree' END, CASE WHEN r3 THEN 'track_not_smooth' END,
  CASE WHEN asked AND fc < 0.3 THEN 'verifier_low_conf' END) AS reasons,
  round(greatest(greatest(ball_component, person_component), CASE WHEN asked THEN 1 - fc ELSE 0 END), 6) AS priority FROM rr""")
def _(t):
    d = disagreement(passes(t), "clip", "frame_index", "people", span=64)
    return preverify(d, "clip", "frame_index", max_step_px=900.0, min_conf=0.3, span=64).select(
        "clip", "frame_index", F.concat_ws(",", "reasons").alias("reasons"), F.round("priority", 6).alias("priority"))


@query("w27_merge_passes", """
WITH f AS (SELECT clip, frame, CASE WHEN is_on THEN 'detected' WHEN code = 1 OR person_count = 2 THEN 'interpolated' ELSE 'none' END AS src, value / 30 AS x, value / 40 AS y, person_count AS tid, value / 100 AS conf FROM frame_status),
b AS (SELECT clip, frame, CASE WHEN code = 2 THEN 'detected' WHEN person_count = 3 THEN 'interpolated' ELSE 'none' END AS src, value / 31 AS x, value / 40 AS y, code + 1 AS tid, value / 90 AS conf FROM frame_status),
fs AS (SELECT *, CASE WHEN src = 'none' THEN NULL ELSE tid END AS k FROM f), bs AS (SELECT *, CASE WHEN src = 'none' THEN NULL ELSE tid END AS k FROM b),
f1 AS (SELECT *, CASE WHEN k IS DISTINCT FROM lag(k) OVER (PARTITION BY clip ORDER BY frame) THEN 1 ELSE 0 END AS nw FROM fs),
f2 AS (SELECT *, sum(nw) OVER (PARTITION BY clip ORDER BY frame) AS r FROM f1),
f3 AS (SELECT *, sum(CASE WHEN src = 'detected' THEN conf ELSE 0 END) OVER (PARTITION BY clip, r) AS sup FROM f2),
b1 AS (SELECT *, CASE WHEN k IS DISTINCT FROM lag(k) OVER (PARTITION BY clip ORDER BY frame) THEN 1 ELSE 0 END AS nw FROM bs),
b2 AS (SELECT *, sum(nw) OVER (PARTITION BY clip ORDER BY frame) AS r FROM b1),
b3 AS (SELECT *, sum(CASE WHEN src = 'detected' THEN conf ELSE 0 END) OVER (PARTITION BY clip, r) AS sup FROM b2),
m AS (SELECT f3.clip, f3.frame, f3.src AS fsrc, b3.src AS bsrc, f3.tid AS ft, b3.tid AS bt, f3.x AS fx, b3.x AS bx,
  CASE WHEN f3.src = 'none' AND b3.src = 'none' THEN NULL
       WHEN f3.src <> 'none' AND b3.src <> 'none' THEN
         CASE WHEN sqrt(power((f3.x - b3.x) * 1920, 2) + power((f3.y - b3.y) * 1080, 2)) <= 60
              THEN CASE WHEN b3.src = 'detected' AND f3.src <> 'detected' THEN 'b' ELSE 'f' END
              ELSE CASE WHEN round(f3.sup, 9) >= round(b3.sup, 9) THEN 'f' ELSE 'b' END END
       WHEN f3.src = 'detected' THEN 'f' WHEN b3.src = 'detected' THEN 'b' END AS side
  FROM f3 JOIN b3 USING (clip, frame)),
n AS (SELECT *, CASE side WHEN 'f' THEN ft WHEN 'b' THEN bt END AS tid FROM m),
o AS (SELECT *, CASE WHEN side IS NOT NULL AND (side IS DISTINCT FROM lag(side) OVER w OR tid IS DISTINCT FROM lag(tid) OVER w) THEN 1 ELSE 0 END AS nw FROM n WINDOW w AS (PARTITION BY clip ORDER BY frame))
SELECT clip, frame, coalesce(side, '-') AS side, CASE WHEN side IS NOT NULL THEN CAST(sum(nw) OVER (PARTITION BY clip ORDER BY frame) AS BIGINT) END AS track_id,
  round(CASE side WHEN 'f' THEN fx WHEN 'b' THEN bx END, 6) AS x FROM o""")
def _(t):
    s = t.frame_status
    fsrc = F.when(F.col("is_on"), "detected").when((F.col("code") == 1) | (F.col("person_count") == 2), "interpolated").otherwise("none")
    bsrc = F.when(F.col("code") == 2, "detected").when(F.col("person_count") == 3, "interpolated").otherwise("none")
    f = s.select("clip", "frame", fsrc.alias("origin"), (F.col("value") / 30).alias("x"), (F.col("value") / 40).alias("y"),
                 F.col("person_count").alias("track_id"), (F.col("value") / 100).alias("confidence"))
    b = s.select("clip", "frame", bsrc.alias("origin"), (F.col("value") / 31).alias("x"), (F.col("value") / 40).alias("y"),
                 (F.col("code") + 1).alias("track_id"), (F.col("value") / 90).alias("confidence"))
    return merge_passes(f, b, ["clip"], "frame", span=64).select("clip", "frame", "side", "track_id", F.round("x", 6).alias("x"))


@query("x09_card_windows", """
SELECT clip, frame_index // 50 AS window_no, count(*) AS n, round(max(confidence), 6) AS best FROM ball_candidate GROUP BY ALL""")
def _(t):
    return t.ball_candidate.groupBy("clip", F.floor(F.col("frame_index") / 50).cast("int").alias("window_no")).agg(
        F.count("*").alias("n"), F.round(F.max("confidence"), 6).alias("best"))


@query("p25_window_ids", """
SELECT game_id, frame_index, concat(game_id, '_w', lpad(CAST(frame_index // 100 AS STRING), 4, '0')) AS window_id,
  concat(game_id, '_f', (frame_index // 250) * 250) AS series_id, frame_index // 50 AS window_2s, frame_index // 25 AS bucket FROM frame""")
def _(t):
    f = F.col("frame_index")
    return t.frame.select("game_id", "frame_index", ids.window_id("game_id", "frame_index", 100).alias("window_id"),
                          F.concat("game_id", F.lit("_f"), F.floor(f / 250) * 250).alias("series_id"),
                          F.floor(f / 50).cast("int").alias("window_2s"), F.floor(f / 25).cast("int").alias("bucket"))
