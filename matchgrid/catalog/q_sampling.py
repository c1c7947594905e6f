"""Orders, samples, scalar rules."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchgrid.catalog.q_metrics import LINKED, PICTURE, person_boxes
from matchgrid.catalog.registry import query
from matchgrid.functions import boxes, candidates, ids, labels, stats
from matchgrid.functions.labels import bucket_flags, frame_risk, is_false, is_true
from matchgrid.operators import aggs, bands, graph, sampling, store


def node_pool(t):
    """Pool nodes with the extremes of their source scores."""
    return t.pool.withColumn("smax", F.col("p_real")).withColumn("smin", F.col("p_real") * 0.5).withColumn("n_sources", F.when(F.col("src") == "sam3", 1).otherwise(2))


@query("p01_tri_state", "SELECT match, clip, frame, node_id, coalesce(plausible = true, false) AS sure, coalesce(plausible = false, false) AS implausible, coalesce(static_flag = true, false) AS static FROM pool")
def _(t):
    return t.pool.select("match", "clip", "frame", "node_id", is_true("plausible").alias("sure"), is_false("plausible").alias("implausible"), is_true("static_flag").alias("static"))


@query("p02_anchor_point", """
SELECT game_id, frame_index, detection_id, round(bbox_x + bbox_w / 2, 6) AS ax, round(CASE WHEN label IN ('ball', 'in_play_ball', 'out_of_play_ball') THEN bbox_y + bbox_h / 2 ELSE bbox_y + bbox_h END, 6) AS ay FROM detection""")
def _(t):
    return t.detection.select("game_id", "frame_index", "detection_id", F.round(boxes.centre_x(), 6).alias("ax"), F.round(boxes.anchor_y(), 6).alias("ay"))


NEXT_BOX = """
nb AS (SELECT game_id, frame_index, detection_id, bbox_x AS ax, bbox_y AS ay, bbox_w AS aw, bbox_h AS ah, lead(bbox_x) OVER w AS bx, lead(bbox_y) OVER w AS by_, lead(bbox_w) OVER w AS bw, lead(bbox_h) OVER w AS bh FROM detection WINDOW w AS (PARTITION BY game_id, frame_index ORDER BY detection_id)),
nx AS (SELECT *, greatest(least(ax + aw, bx + bw) - greatest(ax, bx), 0) * greatest(least(ay + ah, by_ + bh) - greatest(ay, by_), 0) AS i FROM nb WHERE bx IS NOT NULL)"""


def next_boxes(t):
    a = t.detection.select("game_id", "frame_index", "detection_id", *[F.col(f"bbox_{c}").alias(f"a{c}") for c in "xywh"])
    b = t.detection.select("game_id", "frame_index", (F.col("detection_id") - 1).alias("detection_id"), *[F.col(f"bbox_{c}").alias(f"b{c}") for c in "xywh"])
    return a.join(b, ["game_id", "frame_index", "detection_id"])


AB = [f"{s}{c}" for s in "ab" for c in "xywh"]


@query("p03_iou", f"WITH {NEXT_BOX} SELECT game_id, frame_index, detection_id, round(i / (aw * ah + bw * bh - i), 7) AS iou FROM nx")
def _(t):
    return next_boxes(t).select("game_id", "frame_index", "detection_id", F.round(boxes.iou(*AB), 7).alias("iou"))


@query("p04_distances", f"""
WITH {NEXT_BOX} SELECT game_id, frame_index, detection_id, round(i / least(aw * ah, bw * bh), 7) AS overlap, round(sqrt(power((ax + aw / 2 - bx - bw / 2) * 1920, 2) + power((ay + ah / 2 - by_ - bh / 2) * 1080, 2)), 5) AS dist_px,
 round(sqrt(power(aw * 1920, 2) + power(ah * 1080, 2)) / 2, 5) AS radius_px FROM nx""")
def _(t):
    d = next_boxes(t)
    dist = boxes.pixel_distance(boxes.centre_x("ax", "aw"), boxes.centre_y("ay", "ah"), boxes.centre_x("bx", "bw"), boxes.centre_y("by", "bh"))
    return d.select("game_id", "frame_index", "detection_id", F.round(boxes.overlap_coefficient(*AB), 7).alias("overlap"), F.round(dist, 5).alias("dist_px"), F.round(boxes.box_radius_px("aw", "ah"), 5).alias("radius_px"))


@query("p05_box_conversion", """
SELECT game_id, frame_index, detection_id, round(greatest(0, least(1, bbox_x + bbox_w / 2)), 6) AS cx, round(greatest(0, least(1, bbox_y + bbox_h / 2)), 6) AS cy, round(greatest(0, least(1, bbox_x - bbox_w / 2)), 6) AS tx, CASE label WHEN 'player' THEN 0 WHEN 'referee' THEN 1 ELSE 2 END AS cls_id FROM detection""")
def _(t):
    b = ["bbox_x", "bbox_y", "bbox_w", "bbox_h"]
    cen, top = boxes.to_centre_box(*b), boxes.from_centre_box(*b)
    cls = F.when(F.col("label") == "player", 0).when(F.col("label") == "referee", 1).otherwise(2)
    return t.detection.select("game_id", "frame_index", "detection_id", F.round(cen[0], 6).alias("cx"), F.round(cen[1], 6).alias("cy"), F.round(top[0], 6).alias("tx"), cls.alias("cls_id"))


@query("p07_lens_round_trip", """
WITH c AS (SELECT game_id, frame_index, run_id, distortion_k1 AS k1, (frame_index % 50) / 50.0::DOUBLE AS x, (frame_index % 31) / 31.0::DOUBLE AS y FROM calibration),
u AS (SELECT *, 0.5 + (x - 0.5) / (1 + k1 * (power(2 * (x - 0.5), 2) + power(2 * (y - 0.5) * 9 / 16, 2))) AS ux, 0.5 + (y - 0.5) / (1 + k1 * (power(2 * (x - 0.5), 2) + power(2 * (y - 0.5) * 9 / 16, 2))) AS uy FROM c)
SELECT game_id, frame_index, run_id, round(ux, 6) AS ux, round(uy, 6) AS uy, round(0.5 + (ux - 0.5) * 2 / (1 + sqrt(1 - 4 * k1 * (power(2 * (ux - 0.5), 2) + power(2 * (uy - 0.5) * 9 / 16, 2)))), 6) AS back_x FROM u""")
def _(t):
    from matchgrid.functions import pitch

    c = t.calibration.select("game_id", "frame_index", "run_id", F.col("distortion_k1").alias("k1"), (F.col("frame_index") % 50 / 50.0).alias("x"), (F.col("frame_index") % 31 / 31.0).alias("y"))
    ux, uy = pitch.undistort("x", "y", "k1")
    c = c.withColumn("ux", ux).withColumn("uy", uy)
    bx, _by = pitch.distort("ux", "uy", "k1")
    return c.select("game_id", "frame_index", "run_id", F.round("ux", 6).alias("ux"), F.round("uy", 6).alias("uy"), F.round(bx, 6).alias("back_x"))


@query("p08_pitch_to_image", """
WITH k AS (SELECT k.*, run_id, h1, h2, h3, h4, h5, h6, h7, h8, h9 FROM keypoint k JOIN calibration USING (game_id, frame_index)),
i AS (SELECT *, (h5 * h9 - h6 * h8) * pitch_x + (h3 * h8 - h2 * h9) * pitch_y + (h2 * h6 - h3 * h5) AS ix, (h6 * h7 - h4 * h9) * pitch_x + (h1 * h9 - h3 * h7) * pitch_y + (h3 * h4 - h1 * h6) AS iy, (h4 * h8 - h5 * h7) * pitch_x + (h2 * h7 - h1 * h8) * pitch_y + (h1 * h5 - h2 * h4) AS iw FROM k)
SELECT game_id, frame_index, run_id, point_idx, round(CASE WHEN iw <> 0 THEN ix / iw END, 5) AS img_x, round(CASE WHEN iw <> 0 THEN iy / iw END, 5) AS img_y FROM i""")
def _(t):
    from matchgrid.catalog.q_store import with_h
    from matchgrid.functions import pitch

    d = t.keypoint.join(with_h(t.calibration).select("game_id", "frame_index", "run_id", "H"), ["game_id", "frame_index"])
    x, y = pitch.pitch_to_image(pitch.h_cells(), "pitch_x", "pitch_y", F.lit(0.0))
    return d.select("game_id", "frame_index", "run_id", "point_idx", F.round(x, 5).alias("img_x"), F.round(y, 5).alias("img_y"))


@query("p09_continuous_time", """
SELECT f.game_id, f.frame_index, CASE WHEN f.frame_index % 2 = 0 THEN f.continuous_time_s ELSE f.continuous_time_s + g.half2_start_continuous_s END AS t FROM frame f JOIN game g USING (game_id)""")
def _(t):
    from matchgrid.operators.timing import continuous_time

    f = t.frame.select("game_id", "frame_index", (F.col("frame_index") % 2 + 1).alias("half"), F.col("continuous_time_s").alias("half_s"))
    return continuous_time(f, t.game).select("game_id", "frame_index", "t")


@query("p11_provenance_tier", "SELECT game_id, frame_index, detection_id, CAST(CASE WHEN source = 'hand_label' THEN 1 WHEN reviewed THEN 2 ELSE 3 END AS INT) AS tier FROM detection")
def _(t):
    return t.detection.select("game_id", "frame_index", "detection_id", labels.provenance_tier("source", "reviewed").alias("tier"))


@query("p12_class_group", "SELECT game_id, CASE WHEN lower(label) LIKE '%ball' THEN 'ball' ELSE 'player' END AS cls_group, count(*) AS n FROM detection GROUP BY ALL")
def _(t):
    return t.detection.groupBy("game_id", boxes.class_group().alias("cls_group")).agg(F.count("*").alias("n"))


@query("p13_tag_parsing", """
SELECT game_id, frame_index, detection_id, label AS cls, CASE WHEN source = 'hand_label' THEN 'labeller' ELSE source END AS provenance, reviewed AS checked FROM detection""")
def _(t):
    prov = F.when(F.col("source") == "hand_label", "labeller").otherwise(F.col("source"))
    tags = F.array_compact(F.array(prov, F.col("label"), F.when(F.col("reviewed"), "human_checked")))
    d = t.detection.withColumn("tags", tags)
    return d.select("game_id", "frame_index", "detection_id", labels.object_class("tags").alias("cls"), labels.provenance("tags").alias("provenance"), labels.is_checked("tags").alias("checked"))


@query("p18_content_id", """
SELECT game_id, frame_index, detection_id, substr(sha256(concat_ws('|', frame_index, label, CAST(round_even(bbox_x * 1000000, 0) AS BIGINT), CAST(round_even(bbox_y * 1000000, 0) AS BIGINT), CAST(round_even(bbox_w * 1000000, 0) AS BIGINT), CAST(round_even(bbox_h * 1000000, 0) AS BIGINT))), 1, 16) AS content_id FROM detection""")
def _(t):
    return t.detection.select("game_id", "frame_index", "detection_id", ids.content_id("frame_index", "label", "bbox_x", "bbox_y", "bbox_w", "bbox_h").alias("content_id"))


@query("p19_source_filter", """
SELECT 'default' AS rule, count_if(source = 'hand_label' OR reviewed)::BIGINT AS n FROM detection UNION ALL SELECT 'empty', 0 UNION ALL SELECT 'reviewed_yolo', count_if(reviewed OR source = 'yolo')::BIGINT FROM detection""")
def _(t):
    rules = {"default": None, "empty": [], "reviewed_yolo": ["reviewed", "yolo"]}
    one = t.detection.agg(*[F.count_if(labels.source_filter(v)).alias(k) for k, v in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in rules])).alias("r")).select("r.*")


BUCKET = """
bk AS (SELECT *, p_real AS smax, p_real * 0.5 AS smin, coalesce(static_flag, false) AS st, coalesce(NOT plausible, false) AS imp FROM pool),
bf AS (SELECT match, clip, frame, node_id, x, y, p_real, smax, NOT gap_frame AND NOT st AND (p_real BETWEEN 0.30 AND 0.90 OR (src <> 'sam3' AND smax - smin >= 0.35)) AS u, gap_frame AND NOT imp AND p_real >= 0.2 AS m,
 (st OR imp) AND smax >= 0.5 AS n, p_real >= 0.5 AS a, CASE WHEN p_real < 0.5 THEN -1 WHEN p_real < 0.7 THEN 0 WHEN p_real < 0.8 THEN 1 WHEN p_real < 0.9 THEN 2 WHEN p_real < 0.95 THEN 3 WHEN p_real < 0.98 THEN 4 ELSE 5 END AS a_band FROM bk)"""


@query("p20_bucket_flags", f"WITH {BUCKET} SELECT match, clip, frame, node_id, u, m, n, a, a_band FROM bf")
def _(t):
    f = bucket_flags()
    return node_pool(t).select("match", "clip", "frame", "node_id", *[f[k].alias(k) for k in ("u", "m", "n", "a", "a_band")])


@query("p22_frame_risk", """
SELECT game_id, frame_index, detection_id, round(0.25 * least(detection_id, 10) / 10 + 0.25 * (1 - confidence) + 0.5 * (1 - bbox_x), 6) AS risk FROM detection WHERE confidence IS NOT NULL""")
def _(t):
    return t.detection.where("confidence IS NOT NULL").select("game_id", "frame_index", "detection_id", F.round(frame_risk("detection_id", "confidence", "bbox_x"), 6).alias("risk"))


@query("p23_confidence_logodds", """
WITH k AS (SELECT game_id, frame_index, detection_id, confidence AS c FROM detection WHERE confidence IS NOT NULL)
SELECT game_id, frame_index, detection_id, round(CASE WHEN c <= 0.15 THEN ln(0.04 / 0.96) WHEN c <= 0.55 THEN ln(0.04 / 0.96) + (c - 0.15) * (ln(0.42 / 0.58) - ln(0.04 / 0.96)) / 0.4 WHEN c <= 0.65 THEN ln(0.42 / 0.58) + (c - 0.55) * (ln(0.79 / 0.21) - ln(0.42 / 0.58)) / 0.1
 WHEN c <= 0.75 THEN ln(0.79 / 0.21) + (c - 0.65) * (ln(0.96 / 0.04) - ln(0.79 / 0.21)) / 0.1 WHEN c <= 0.85 THEN ln(0.96 / 0.04) + (c - 0.75) * (ln(0.995 / 0.005) - ln(0.96 / 0.04)) / 0.1 ELSE ln(0.995 / 0.005) END, 5) AS logodds FROM k""")
def _(t):
    return t.detection.where("confidence IS NOT NULL").select("game_id", "frame_index", "detection_id", F.round(stats.confidence_logodds("confidence"), 5).alias("logodds"))


@query("p24_suggestion_rank", """
WITH a AS (SELECT clip, frame_index, arg_min(x, detection_id) AS ax, arg_min(y, detection_id) AS ay FROM ball_mark GROUP BY ALL),
b AS (SELECT *, lag(frame_index) OVER w AS pf, lag(ax) OVER w AS px, lag(ay) OVER w AS py FROM a WINDOW w AS (PARTITION BY clip ORDER BY frame_index)),
c AS (SELECT c.*, b.frame_index AS af, ax, ay, pf, px, py FROM ball_candidate c ASOF JOIN b ON c.clip = b.clip AND c.frame_index > b.frame_index),
d AS (SELECT *, CASE WHEN pf IS NOT NULL THEN ax + (ax - px) / (af - pf) * (frame_index - af) ELSE ax END AS qx, CASE WHEN pf IS NOT NULL THEN ay + (ay - py) / (af - pf) * (frame_index - af) ELSE ay END AS qy, 12 + CASE WHEN pf IS NOT NULL THEN 4 ELSE 6 END * (frame_index - af) AS sg FROM c)
SELECT clip, frame_index, detection_id, round(ln(greatest(confidence, 0.05)) - (power((x - qx) * 1920, 2) + power((y - qy) * 1080, 2)) / (2 * sg * sg), 3) AS score FROM d""")
def _(t):
    from matchgrid.operators.timing import predicted_place

    a = t.ball_mark.groupBy("clip", "frame_index").agg(F.min_by("x", "detection_id").alias("x"), F.min_by("y", "detection_id").alias("y"))
    d = predicted_place(t.ball_candidate, a, "clip", "frame_index", sigma0=12.0, span=64).where("pred_x IS NOT NULL")
    dist = boxes.pixel_distance("x", "y", "pred_x", "pred_y")
    return d.select("clip", "frame_index", "detection_id", F.round(candidates.suggestion_score("confidence", dist, "sigma"), 3).alias("score"))


@query("p29_review_stratum", """
SELECT item_id, CASE WHEN CAST(json_extract(payload, '$.n') AS BIGINT) % 3 = 0 THEN 'random' WHEN CAST(json_extract(payload, '$.n') AS BIGINT) % 3 = 1 THEN 'edge' ELSE 'unknown' END AS stratum FROM item""")
def _(t):
    n = F.from_json("payload", "n bigint")["n"]
    return t.item.select("item_id", F.when(n % 3 == 0, "random").when(n % 3 == 1, "edge").otherwise("unknown").alias("stratum"))


@query("f07_exact_fps", """
WITH f AS (SELECT game_id, frame_index, CASE frame_index % 4 WHEN 0 THEN 29.97 WHEN 1 THEN 25.0 WHEN 2 THEN 59.94 ELSE 23.976 END::DOUBLE AS fps FROM frame)
SELECT game_id, frame_index, round(CASE WHEN abs(fps - round_even(fps * 1.001, 0) / 1.001) < 0.01 THEN round_even(fps * 1.001, 0) * 1000 / 1001 ELSE fps END, 6) AS exact FROM f""")
def _(t):
    k = F.col("frame_index") % 4
    fps = F.when(k == 0, 29.97).when(k == 1, 25.0).when(k == 2, 59.94).otherwise(23.976)
    return t.frame.select("game_id", "frame_index", F.round(stats.exact_fps(fps), 6).alias("exact"))


@query("f06_canonical_payload", """
SELECT game_id, frame_index, detection_id, concat('{"label":"', label, '","track":', coalesce(CAST(track_id AS STRING), 'null'), '}') AS payload FROM detection""")
def _(t):
    p = F.to_json(F.struct("label", F.col("track_id").alias("track")), {"ignoreNullFields": "false"})
    return t.detection.select("game_id", "frame_index", "detection_id", p.alias("payload"))


@query("k03_sql_functions", """
SELECT game_id, frame_index, detection_id, round(greatest(0.3 - bbox_x, 0) * 0 + 0.5 + (bbox_x - 0.5) / (1 + 0.1 * (power(2 * (bbox_x - 0.5), 2) + power(2 * (bbox_y - 0.5) * 9 / 16, 2))), 6) AS ux FROM detection""")
def _(t):
    from matchgrid.functions.sqlfuncs import register

    register(t.spark)
    return t.detection.selectExpr("game_id", "frame_index", "detection_id", "round(undistort_x(bbox_x, bbox_y, 0.1D), 6) AS ux")


@query("k07_lsh_code", """
WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), b AS (SELECT unnest(range(8)) AS bit),
d AS (SELECT vec_id, bit, sum(v * cos(pos * (bit + 1) * 0.7 + bit)) AS dot FROM e, b GROUP BY ALL)
SELECT vec_id, CAST(sum(CASE WHEN dot > 0 THEN power(2, bit) ELSE 0 END) AS INT) AS code FROM d GROUP BY vec_id""")
def _(t):
    from matchgrid.functions.vectors import lsh_code, wave_planes

    return t.embeddings.select("vec_id", lsh_code("embedding", wave_planes(64)).alias("code"))


@query("t02_risky_frames", """
WITH r AS (SELECT game_id, track_id, frame_index, detection_id, round(0.25 * least(detection_id, 10) / 10 + 0.25 * (1 - confidence) + 0.5 * (1 - bbox_x), 6) AS risk FROM detection WHERE confidence IS NOT NULL AND track_id IS NOT NULL)
SELECT * FROM (SELECT game_id, track_id, frame_index, detection_id, CAST(row_number() OVER (PARTITION BY game_id, track_id ORDER BY risk DESC, frame_index, detection_id) AS INT) AS place FROM r) WHERE place <= 5""")
def _(t):
    d = t.detection.where("confidence IS NOT NULL AND track_id IS NOT NULL").withColumn("fr", F.struct("frame_index", "detection_id"))
    r = F.round(frame_risk("detection_id", "confidence", "bbox_x"), 6)
    return sampling.risky_frames(d, ["game_id", "track_id"], r, "fr", 5).select("game_id", "track_id", "frame_index", "detection_id", "place")


@query("t04_target_queue", """
WITH c AS (SELECT clip AS game_id, frame_index, max(confidence) AS pr FROM ball_candidate GROUP BY ALL),
x AS (SELECT c.*, EXISTS (SELECT 1 FROM verdict_log v WHERE v.game_id = c.game_id AND v.verdict = 'not_ball' AND abs(v.frame_index * 7 - c.frame_index) <= 25) AS af FROM c),
k AS (SELECT x.* FROM x WHERE CAST(substr(game_id, 2) AS INT) >= 9 AND NOT EXISTS (SELECT 1 FROM frame_label_state s WHERE s.game_id = x.game_id AND s.frame_index = x.frame_index AND s.method = 'hand_series' AND s.cls_group = 'ball')
  AND NOT EXISTS (SELECT 1 FROM (SELECT game_id, frame_index FROM frame_label_state WHERE state IN ('complete', 'absent') GROUP BY ALL HAVING count(DISTINCT cls_group) = 2) d WHERE d.game_id = x.game_id AND d.frame_index = x.frame_index))
SELECT game_id, frame_index, round(pr + CASE WHEN af THEN 1 ELSE 0 END, 6) AS score FROM k ORDER BY score DESC, game_id, frame_index LIMIT 300""")
def _(t):
    c = t.ball_candidate.groupBy(F.col("clip").alias("game_id"), "frame_index").agg(F.max("confidence").alias("pr"))
    fail = t.verdict_log.where("verdict = 'not_ball'").select("game_id", (F.col("frame_index") * 7).alias("f"))
    c = bands.band_exists(c, fail, ["game_id"], "frame_index", "f", -25, 25)
    gold = t.frame_label_state.where("method = 'hand_series' AND cls_group = 'ball'")
    score = F.round(F.col("pr") + F.when(F.col("near"), 1.0).otherwise(0.0), 6)
    items, _rej = sampling.queue(c, gold, aggs.frame_complete(t.frame_label_state), ["game_id", "frame_index"], score, 300, F.substring("game_id", 2, 9).cast("int") >= 9)
    return items.select("game_id", "frame_index", "score")


@query("t05_spaced_crowded_frames", f"""
WITH RECURSIVE {LINKED},
rk AS (SELECT game_id, frame_index, round(largest + 0.25 * in_crowds + mean_iou, 6) AS score FROM cw),
od AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY score DESC, frame_index) AS k FROM rk),
fd AS (SELECT game_id, CAST(0 AS BIGINT) AS k, CAST([] AS INT[]) AS taken, CAST(NULL AS INT) AS f FROM (SELECT DISTINCT game_id FROM od)
 UNION ALL SELECT d.game_id, o.k, CASE WHEN len(list_filter(d.taken, lambda z: abs(z - o.frame_index) < 25)) = 0 THEN list_append(d.taken, o.frame_index) ELSE d.taken END,
  CASE WHEN len(list_filter(d.taken, lambda z: abs(z - o.frame_index) < 25)) = 0 THEN o.frame_index END FROM fd d JOIN od o ON o.game_id = d.game_id AND o.k = d.k + 1)
SELECT game_id, f AS frame_index FROM fd WHERE f IS NOT NULL""")
def _(t):
    d = graph.crowd_scores(person_boxes(t), ["game_id", "frame_index"], extent=PICTURE).select("game_id", "frame_index", F.round("score", 6).alias("score"))
    return sampling.spaced(d, "game_id", "frame_index", [("score", False), ("frame_index", True)], 25).select("game_id", "frame_index")


@query("t10_allocation", """
WITH RECURSIVE s AS (SELECT match, count(*) AS weight, count_if(p_real >= 0.8)::BIGINT AS room FROM pool GROUP BY match),
r AS (SELECT 0 AS i, match, weight, room, CAST(0 AS BIGINT) AS share, CAST((SELECT floor(sum(room) * 0.9) FROM s) AS BIGINT) AS due_all FROM s
 UNION ALL
 SELECT i + 1, match, weight, room, share + got, CAST(due_all - sum(got) OVER () AS BIGINT) FROM (
  SELECT *, whole + CASE WHEN takes AND row_number() OVER (ORDER BY takes DESC, floor(due) - due, match) <= due_all - sum(whole) OVER () THEN 1 ELSE 0 END AS got FROM (
   SELECT *, is_open AND room - share > whole AS takes FROM (
    SELECT *, CASE WHEN is_open THEN least(CAST(floor(due) AS BIGINT), room - share) ELSE 0 END AS whole FROM (
     SELECT *, CASE WHEN is_open THEN due_all * CAST(weight AS DOUBLE) / sum(CASE WHEN is_open THEN CAST(weight AS DOUBLE) END) OVER () END AS due, bool_or(is_open) OVER () AS going FROM (
      SELECT *, due_all > 0 AND weight > 0 AND share < room AS is_open FROM r)) WHERE going))))
SELECT match, weight, room, share FROM r QUALIFY i = max(i) OVER ()""")
def _(t):
    """Nine tenths of the strong nodes of all matches, shared out by the number of nodes, none above a match's own."""
    s = t.pool.groupBy("match").agg(F.count("*").alias("weight"), F.count_if(F.col("p_real") >= 0.8).alias("room"))
    total = F.floor(F.sum("room").over(Window.partitionBy()) * 0.9)  # one row per match
    return sampling.allocate(s.withColumn("total", total), F.col("total"), "match", "weight", "room").drop("total")


@query("t06_round_robin", """
SELECT game_id, frame_index, detection_id FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY confidence DESC, frame_index, detection_id) AS turn FROM detection WHERE confidence IS NOT NULL) ORDER BY turn, game_id LIMIT 120""")
def _(t):
    d = t.detection.where("confidence IS NOT NULL")
    return sampling.round_robin(d, "game_id", [F.desc("confidence"), F.col("frame_index"), F.col("detection_id")], 120).select("game_id", "frame_index", "detection_id")


RACE = """
rc AS (SELECT clip, frame_index, detection_id, confidence, (CAST('0x' || substr(sha1(concat(clip, ':', frame_index, ':', detection_id)), 1, 15) AS BIGINT) + 0.5::DOUBLE) / 1152921504606846976.0::DOUBLE AS u,
  (floor(least(greatest(confidence, 0), 0.999999) * 100) + 0.5) / 100 AS b FROM ball_candidate),
rw AS (SELECT *, 4.9 * exp(-0.5 * power((b - 0.25) / 0.1, 2)) + 0.02 AS w FROM rc)"""


def card_key():
    return F.concat(F.col("clip"), F.lit(":"), F.col("frame_index"), F.lit(":"), F.col("detection_id"))


@query("t07_exponential_race", f"WITH {RACE} SELECT clip, frame_index, detection_id FROM rw ORDER BY -ln(u) / w LIMIT 500")
def _(t):
    return sampling.candidate_race(t.ball_candidate, card_key(), "confidence", 500).select("clip", "frame_index", "detection_id")


@query("t08_adaptive_race", f"""
WITH {RACE}, bd AS (SELECT CAST(least(floor(confidence * 10 + 1e-9), 9) AS INT) AS band, count(*) AS n FROM verdict_log WHERE verdict IN ('ball', 'corrected', 'not_ball') GROUP BY 1)
SELECT clip, frame_index, detection_id FROM rw LEFT JOIN bd ON bd.band = CAST(least(floor(confidence * 10 + 1e-9), 9) AS INT) ORDER BY -ln(u) / (w * (1 + greatest(0, 1 - coalesce(n, 0) / 900))) LIMIT 500""")
def _(t):
    from matchgrid.operators.metrics import confidence_bands

    return sampling.adaptive_race(t.ball_candidate, confidence_bands(t.verdict_log), card_key(), "confidence", 500, 900).select("clip", "frame_index", "detection_id")


@query("t09_page_mix")
def _(t):
    """Three focused cards to one uniform card, one per event."""
    c = t.ball_candidate.withColumn("event", F.concat_ws(":", "clip", F.floor(F.col("frame_index") / 4)))
    foc = sampling.exponential_race(c, card_key(), labels.sampling_weight(labels.bin_centre("confidence")))
    uni = sampling.exponential_race(c, F.concat(F.lit("u:"), card_key()), F.lit(1.0))
    return sampling.page_mix(foc, uni, "race", 200, "event").select("slot", "stream", "clip", "frame_index", "detection_id")


@query("t11_probability_sample", """
WITH s AS (SELECT match, clip, CAST(frame // 10 AS INT) AS win, frame, node_id FROM pool WHERE p_real >= 0.5),
u AS (SELECT match, clip, win, count(*) AS m, arg_min((frame, node_id), sha1(concat_ws(':', '0', clip, win, frame, node_id))) AS n FROM s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY match ORDER BY sha1(concat_ws(':', '0', clip, win))) AS draw, count(*) OVER (PARTITION BY match) AS big FROM u)
SELECT match, clip, win, n[1] AS frame, n[2] AS node_id, m, round(least(8, big) / big / m, 8) AS pi FROM r WHERE draw <= 8""")
def _(t):
    s = t.pool.where("p_real >= 0.5").select("match", "clip", F.floor(F.col("frame") / 10).cast("int").alias("win"), "frame", "node_id")
    n = {f"g{i}": 8 for i in range(25)}
    return sampling.probability_sample(s, "match", ["clip", "win"], ["frame", "node_id"], n).select("match", "clip", "win", "frame", "node_id", "m", F.round("pi", 8).alias("pi"))


@query("t12_diverse_nodes")
def _(t):
    """Best node of each k-means cluster over place and time."""
    p = t.pool.withColumn("t", F.col("frame") / 50.0)
    return sampling.diverse_representatives(p, ["x", "y", "t"], [F.abs(F.col("p_real") - 0.5), F.col("clip"), F.col("frame"), F.col("node_id")], 12).select("cluster", "clip", "frame", "node_id", "p_real")


@query("t14_even_holdout", """
WITH r AS (SELECT clip, row_number() OVER (ORDER BY clip) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT clip FROM pool)), k AS (SELECT max(n) AS n, CAST(floor(max(n) * 0.1) AS BIGINT) AS c FROM r),
q AS (SELECT CAST(floor(i * (n / c) + (n / c) / 2) AS BIGINT) AS p FROM k, (SELECT unnest(range(10000)) AS i) WHERE i < c)
SELECT clip FROM r WHERE p IN (SELECT p FROM q)""")
def _(t):
    return sampling.even_holdout(t.pool, "clip", 0.1)


@query("t15_hard_negatives", f"""
WITH {BUCKET}, h AS (SELECT *, floor(x / 0.05) AS gx, floor(y / 0.05) AS gy FROM bf WHERE n)
SELECT clip, frame, node_id, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY clip, gx, gy ORDER BY smax DESC, frame, node_id) AS place FROM h) WHERE place <= 2""")
def _(t):
    return sampling.hard_negatives(node_pool(t).where(bucket_flags()["n"]), "clip", "frame", "smax", tie=["node_id"]).select("clip", "frame", "node_id", "place")


@query("t16_panel_tiles", """
WITH s AS (SELECT game_id AS clip, max(frame_index) + 1 AS n FROM frame GROUP BY ALL), k AS (SELECT clip, CAST(floor((n - 1 - 21) / 25) + 1 AS BIGINT) AS c FROM s WHERE floor((n - 1 - 21) / 25) + 1 > 0)
SELECT clip, win, win * 25 AS "start", win * 25 + 20 AS "end" FROM (SELECT clip, unnest(range(c)) AS win FROM k)""")
def _(t):
    s = t.frame.groupBy(F.col("game_id").alias("clip")).agg((F.max("frame_index") + 1).alias("n"))
    return sampling.panel_windows(s, "clip", "n", 25.0).select("clip", "win", "start", "end")


@query("t17_hash_audit", """
WITH k AS (SELECT game_id, frame_index, sha1(concat(game_id, ':', frame_index)) AS h FROM frame),
m AS (SELECT *, CAST(list_sum(list_transform(string_split(h, ''), lambda x: CASE WHEN x = '' THEN 0 ELSE CAST('0x' || x AS INT) END)) AS BIGINT) % 5 AS m5, CAST('0x' || right(h, 1) AS INT) % 2 AS m2 FROM k)
SELECT game_id, frame_index, m5 = 0 AND m2 = 0 AS audit FROM m""")
def _(t):
    return sampling.hash_audit(t.frame, F.concat(F.col("game_id"), F.lit(":"), F.col("frame_index"))).select("game_id", "frame_index", "audit")


@query("t17_strata_audit", """
WITH r AS (SELECT game_id, frame_index // 100 AS win, frame_index, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY game_id, frame_index // 100) AS n FROM frame WINDOW w AS (PARTITION BY game_id, frame_index // 100 ORDER BY frame_index)),
s AS (SELECT *, floor(i * least(n, greatest(1, round_even(n * 0.05, 0))) / n) AS st FROM r)
SELECT game_id, CAST(win AS INT) AS win, CAST(st AS BIGINT) AS stratum, arg_min(frame_index, sha1(concat_ws(':', '0', game_id, win, frame_index))) AS frame_index FROM s GROUP BY ALL""")
def _(t):
    d = t.frame.select("game_id", F.floor(F.col("frame_index") / 100).cast("int").alias("win"), "frame_index")
    return sampling.strata_audit(d, ["game_id", "win"], "frame_index", 0.05)


@query("t18_redeal", """
WITH c AS (SELECT * FROM card QUALIFY row_number() OVER (PARTITION BY match, frame, box ORDER BY p_real, pi, verdict, bucket) = 1)
SELECT match, bucket, row_number() OVER (PARTITION BY match, bucket ORDER BY frame * 10 + box) AS place, frame * 10 + box AS slot FROM c""")
def _(t):
    from matchgrid.operators.windows import top_k

    c = top_k(t.card, ["match", "frame", "box"], [F.col("p_real"), F.col("pi"), F.col("verdict"), F.col("bucket")], 1).withColumn("slot", F.col("frame") * 10 + F.col("box"))
    d = sampling.redeal(c, ["match"], "bucket", "slot", F.col("slot"))
    from pyspark.sql import Window

    w = Window.partitionBy("match", "bucket").orderBy("new_slot")
    return d.select("match", "bucket", F.row_number().over(w).cast("long").alias("place"), F.col("new_slot").alias("slot"))


@query("t21_auto_accept", """
SELECT match, clip, frame, node_id, round(p_real, 6) AS p_real FROM pool p WHERE p_real >= 0.8 AND coalesce(plausible, true) AND NOT gap_frame
 AND NOT EXISTS (SELECT 1 FROM verdict_log v WHERE v.game_id = p.match AND v.frame_index // 10 = p.frame // 10)""")
def _(t):
    b = t.verdict_log.select(F.col("game_id").alias("match"), F.floor(F.col("frame_index") / 10).alias("w")).distinct()
    p = t.pool.where("p_real >= 0.8 AND coalesce(plausible, true) AND NOT gap_frame").withColumn("w", F.floor(F.col("frame") / 10))
    return p.join(b, ["match", "w"], "left_anti").select("match", "clip", "frame", "node_id", F.round("p_real", 6).alias("p_real"))


@query("t22_gold_cards", """
WITH m AS (SELECT clip, frame_index, detection_id, x, y, CAST('0x' || substr(sha1(concat(clip, ':', frame_index, ':', detection_id)), 1, 15) AS BIGINT) AS h FROM ball_mark)
SELECT clip, frame_index, detection_id, round(15 + 15 * ((h % 1000) / 1000), 4) AS shift_px, round(greatest(0, least(1, x + (15 + 15 * ((h % 1000) / 1000)) * cos(2 * pi() * (h // 1000 % 1000) / 1000) / 1920)), 6) AS cx FROM m""")
def _(t):
    h = ids.hash60(card_key())
    th = 2 * F.pi() * (F.expr("h div 1000") % 1000) / 1000
    m = t.ball_mark.withColumn("h", h)
    d = 15 + 15 * (F.col("h") % 1000 / 1000)
    return m.select("clip", "frame_index", "detection_id", F.round(d, 4).alias("shift_px"), F.round(boxes.clip(F.col("x") + d * F.cos(th) / 1920, 0.0, 1.0), 6).alias("cx"))


@query("t23_pseudo_labels", """
WITH s AS (SELECT DISTINCT clip, frame_index AS f FROM ball_candidate WHERE confidence >= 0.7)
SELECT clip, frame_index, detection_id, CASE WHEN confidence >= 0.6 THEN 'strong' ELSE 'weak' END AS category FROM ball_candidate c WHERE confidence BETWEEN 0.3 AND 0.69 AND EXISTS (SELECT 1 FROM s WHERE s.clip = c.clip AND abs(s.f - c.frame_index) <= 3)""")
def _(t):
    strong = t.ball_candidate.where("confidence >= 0.7").select("clip", F.col("frame_index").alias("f"))
    c = t.ball_candidate.where("confidence BETWEEN 0.3 AND 0.69")
    d = bands.band_exists(c, strong, ["clip"], "frame_index", "f", -3, 3).where("near")
    return d.select("clip", "frame_index", "detection_id", F.when(F.col("confidence") >= 0.6, "strong").otherwise("weak").alias("category"))


@query("w16_event_groups", """
WITH RECURSIVE c AS (SELECT clip, frame_index AS frame, detection_id AS cand, x, y FROM ball_candidate),
p AS (SELECT a.clip, a.frame, a.cand, min(b.frame::BIGINT * 1000000 + b.cand) AS up FROM c a JOIN c b ON b.clip = a.clip AND b.frame BETWEEN a.frame - 3 AND a.frame
 AND (b.frame < a.frame OR b.cand < a.cand) AND abs(a.x - b.x) < 0.03 AND abs(a.y - b.y) < 0.03 GROUP BY ALL),
n AS (SELECT c.clip, c.frame, c.cand, c.frame::BIGINT * 1000000 + c.cand AS me, p.up FROM c LEFT JOIN p USING (clip, frame, cand)),
r AS (SELECT clip, frame, cand, me, me AS root FROM n WHERE up IS NULL UNION ALL SELECT n.clip, n.frame, n.cand, n.me, r.root FROM n JOIN r ON n.clip = r.clip AND n.up = r.me)
SELECT clip, frame, cand, concat(clip, ':', dense_rank() OVER (PARTITION BY clip ORDER BY root) - 1) AS event FROM r""")
def _(t):
    """Event of each candidate: close in place, at most three frames apart."""
    c = t.ball_candidate.select("clip", F.col("frame_index").alias("frame"), F.col("detection_id").alias("cand"), "x", "y")
    return sampling.event_groups(c, "clip")


@query("t19_even_grid", """
WITH r AS (SELECT game_id, frame_index, row_number() OVER (PARTITION BY game_id ORDER BY frame_index) - 1 AS p, count(*) OVER (PARTITION BY game_id) AS n FROM frame)
SELECT game_id, frame_index FROM r WHERE floor(p * 12 / n) <> floor((p - 1) * 12 / n)""")
def _(t):
    from matchgrid.operators.ordered import Running, along

    d = along(t.frame, ["game_id"], ["frame_index"], [Running("p", F.lit(1).cast("long"), inclusive=False)], span=256)
    n = t.frame.groupBy("game_id").agg(F.count("*").alias("n"))
    d = d.join(n, "game_id")
    return d.where(F.floor(F.col("p") * 12 / F.col("n")) != F.floor((F.col("p") - 1) * 12 / F.col("n"))).select("game_id", "frame_index")
