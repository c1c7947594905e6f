"""Trackers, streams, sources and sinks, composed jobs."""

import uuid

from pyspark.sql import functions as F

from matchgrid.catalog.q_joins import LINK
from matchgrid.catalog.q_maintain import CANON, canonical_rows
from matchgrid.catalog.q_metrics import PICTURE, person_boxes
from matchgrid.catalog.q_sampling import node_pool
from matchgrid.catalog.registry import query
from matchgrid.functions.labels import bucket_flags
from matchgrid.functions.stats import rounded
from matchgrid.operators import graph, snapshots, trackers, windows
from matchgrid.plans import evaluate, jobs
from matchgrid.session import cut_lineage, ensure_checkpoint_dir
from matchgrid.sources import label_log, writers
from matchgrid.streaming import streams


def scratch(t) -> str:
    return f"{ensure_checkpoint_dir(t.spark)}/out-{uuid.uuid4().hex}"


@query("x02_iou_tracker")
def _(t):
    """Track id per detection (sequential assignment per game)."""
    return trackers.iou_tracks(t.detection)


def candidates(t):
    """Candidates, stored, as the passes of a tracker read them several times, and the processed frames."""
    c = t.ball_candidate.select("clip", "frame_index", "detection_id", "confidence", "bbox_x", "bbox_y", "bbox_w", "bbox_h")
    return cut_lineage(c), t.frame.select(F.col("game_id").alias("clip"), "frame_index")


@query("x03_ball_tracker")
def _(t):
    """One ball point per frame with gaps closed."""
    c, f = candidates(t)
    return trackers.ball_points(c, f, start=0.5)


@query("x04_bidirectional_ball")
def _(t):
    """Forward and backward ball pass, merged."""
    c, f = candidates(t)
    return trackers.bidirectional_ball(c, f, start=0.5)


@query("x05_best_path")
def _(t):
    """Candidates on the best path of each clip."""
    return trackers.best_path(t.ball_candidate)


@query("x06_cluster_tracks")
def _(t):
    """Person clusters followed over frames."""
    b = person_boxes(t)
    c = graph.person_clusters(b, ["game_id", "frame_index"], extent=PICTURE)
    return trackers.cluster_tracks(trackers.union_boxes(b, c, ["game_id", "frame_index"]), "game_id")


@query("k02_tracker_registry")
def _(t):
    """Points per origin of every registered ball tracker."""
    c, f = candidates(t)
    out = None
    for name, fn in trackers.TRACKERS.items():
        d = fn(c, f).groupBy("origin").agg(F.count("*").alias("n")).select(F.lit(name).alias("tracker"), "origin", "n")
        out = d if out is None else out.unionByName(d)
    return out


def event_stream(t, per_trigger=None):
    return streams.file_stream(t.spark, t.sf_dir, "events.parquet", t.events.schema, per_trigger)


@query("x08_stream_latest_verdicts", """
SELECT game_id, box_index, verdict, line_no FROM (SELECT user_id % 25 AS game_id, CAST(floor(value) % 3 AS INT) AS box_index, CASE event_type WHEN 'purchase' THEN 'ball' WHEN 'click' THEN 'not_ball' WHEN 'view' THEN 'unsure' END AS verdict, event_id AS line_no,
 row_number() OVER (PARTITION BY user_id % 25, CAST(floor(value) % 3 AS INT) ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND verdict IS NOT NULL""")
def _(t):
    v = F.when(F.col("event_type") == "purchase", "ball").when(F.col("event_type") == "click", "not_ball").when(F.col("event_type") == "view", "unsure")
    s = event_stream(t).select((F.col("user_id") % 25).alias("game_id"), (F.floor("value") % 3).cast("int").alias("box_index"), v.alias("verdict"), F.col("event_id").alias("line_no"), "ts")
    d = streams.latest_verdicts(s, ["game_id", "box_index"], ["ts", "line_no"])
    return streams.run_to_table(d, "complete").select("game_id", "box_index", "verdict", "line_no")


@query("x09_stream_tumbling", """
SELECT event_type, strftime(time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS "start", count(*) AS n FROM events GROUP BY ALL""")
def _(t):
    s = event_stream(t).withColumn("ts", F.col("ts").cast("timestamp"))
    d = streams.run_to_table(streams.tumbling_counts(s, ["event_type"], "ts", "1 hour", "10 minutes"), "complete")
    return d.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("x10_stream_sessions", """
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS nw FROM events),
s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS "start", count(*) AS n FROM s GROUP BY user_id, sid""")
def _(t):
    s = event_stream(t).withColumn("ts", F.col("ts").cast("timestamp"))
    d = streams.run_to_table(streams.sessions(s, ["user_id"], "ts", "6 hours", "1 hour"), "complete")
    return d.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("x11_stream_idempotent_upsert", """
SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def _(t):
    return streams.upsert_stream(event_stream(t).select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("x12_stream_one_card_per_window", """
SELECT user_id, strftime(time_bucket(INTERVAL '2 hours', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS win FROM events GROUP BY ALL""")
def _(t):
    s = event_stream(t).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    d = streams.run_to_table(streams.one_per_window(s, ["user_id"], "ts", "2 hours", "4 hours"))
    return d.select("user_id", F.date_format("win", "yyyy-MM-dd HH:mm:ss").alias("win"))


@query("x01_stream_gap_sentinels", """
WITH e AS (SELECT CAST(user_id AS STRING) AS k, CAST(epoch_us(ts) AS DOUBLE) / 1000000 AS t, event_id FROM events), l AS (SELECT *, lag(t) OVER (PARTITION BY k ORDER BY t, event_id) AS p FROM e)
SELECT k AS "key", 'gap' AS kind, -1::BIGINT AS seq, round(t - p, 3) AS step FROM l WHERE t - p > 36000 UNION ALL SELECT k, 'frame', event_id, 0 FROM e""")
def _(t):
    s = event_stream(t).select(F.col("user_id").cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("event_id").alias("seq"))
    d = streams.run_to_table(streams.gap_sentinels(s, "key", 36000.0))
    return d.select("key", "kind", "seq", F.round(F.col("t1") - F.col("t0"), 3).alias("step"))


@query("x13_stream_mask_segments", """
WITH f AS (SELECT CAST(user_id AS STRING) AS clip, CAST(event_id AS INT) AS frame, value > 20 AS is_on FROM events),
o AS (SELECT clip, frame, frame - lag(frame) OVER (PARTITION BY clip ORDER BY frame) - 1 AS hole FROM f WHERE is_on),
s AS (SELECT *, sum(CASE WHEN hole IS NULL OR hole > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY clip ORDER BY frame) AS seg FROM o),
g AS (SELECT clip, min(frame) AS s, max(frame) AS e FROM s GROUP BY clip, seg HAVING max(frame) - min(frame) + 1 >= 20)
SELECT clip, s AS "start", e AS "end" FROM g""")
def _(t):
    s = event_stream(t).select(F.col("user_id").cast("string").alias("clip"), F.col("event_id").cast("int").alias("frame"), (F.col("value") > 20).alias("is_on"))
    return streams.segments_of(s, "clip", 100, 20)


# The verdict log as two writers' logs of two appends each; lines of the second append with a confidence of 0.97 or more are cut in half.
LOG_SQL = """
half AS (SELECT max(line_no) // 2 AS half FROM verdict_log),
ln AS (SELECT vsource AS writer, game_id, frame_index, box_index, verdict, ts, line_no, line_no > half AND confidence >= 0.97 AS torn FROM verdict_log, half),
nu AS (SELECT *, row_number() OVER (PARTITION BY writer ORDER BY line_no) AS seq FROM ln)"""
LOG_KEYS = ["game_id", "frame_index", "box_index"]


def label_log_folder(t) -> str:
    root = f"{scratch(t)}/log"
    d = t.verdict_log.select("vsource", *LOG_KEYS, "verdict", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "line_no", "confidence")
    half = d.agg(F.max("line_no")).first()[0] // 2
    for writer in ("sidecar", "cand"):
        mine = d.where(F.col("vsource") == writer).drop("vsource")
        label_log.append(mine.where(F.col("line_no") <= half), root, writer, ["line_no"])
        later = label_log.lines(mine.where(F.col("line_no") > half), ["line_no"], label_log.last_number(t.spark, root, writer))
        sure = F.get_json_object("value", "$.confidence").cast("double") >= 0.97
        label_log.append_lines(later.select(F.when(sure, F.expr("left(value, length(value) div 2)")).otherwise(F.col("value")).alias("value")), root, writer)
    return root


LOG_SCHEMA = "game_id string, frame_index int, box_index int, verdict string, ts long, line_no long"


@query("s23_label_log", f"""
WITH {LOG_SQL} SELECT game_id, frame_index, box_index, r.v AS verdict, r.w AS writer, r.l AS line_no FROM (SELECT game_id, frame_index, box_index, arg_max({{'v': verdict, 'w': writer, 'l': line_no}}, (ts, writer, line_no)) AS r FROM ln WHERE NOT torn GROUP BY ALL) WHERE r.v IS NOT NULL""")
def _(t):
    """Live labels of an appended log with torn lines."""
    log = label_log.read(t.spark, label_log_folder(t), LOG_SCHEMA)
    return label_log.live(log, LOG_KEYS, "verdict").select(*LOG_KEYS, "verdict", "writer", "line_no")


@query("s23_log_health", f"""
WITH {LOG_SQL} SELECT writer, count(*) AS n_lines, count_if(torn)::BIGINT AS n_torn, max(seq) FILTER (WHERE NOT torn) - count_if(NOT torn)::BIGINT AS n_missing FROM nu GROUP BY writer""")
def _(t):
    """Lines, torn lines and missing numbers of each writer."""
    return label_log.health(label_log.read(t.spark, label_log_folder(t), LOG_SCHEMA))


DET_COLS = "game_id string, source string, run_id string, frame_index int, detection_id long, label string, bbox_x double"


@query("s01_parquet_round_trip", "SELECT game_id, source, run_id, frame_index, detection_id, label, round(bbox_x, 6) AS bbox_x FROM detection")
def _(t):
    root = scratch(t)
    writers.export_table(t.detection.select(*[c.strip().split()[0] for c in DET_COLS.split(",")]), root, "detection")
    return writers.import_table(t.spark, root, "detection", DET_COLS).withColumn("bbox_x", F.round("bbox_x", 6))


@query("s15_match_json", """
WITH d AS (SELECT game_id, frame_index, string_agg(concat('{"detection_id":', detection_id, ',"label":"', label, '"}'), ',' ORDER BY detection_id) AS d FROM detection GROUP BY ALL),
k AS (SELECT game_id, frame_index, string_agg(concat('{"detection_id":', detection_id, ',"track_id":', track_id, '}'), ',' ORDER BY detection_id) AS k FROM detection WHERE track_id IS NOT NULL GROUP BY ALL)
SELECT f.game_id, f.frame_index, concat('{"frame_index":', f.frame_index, ',"detections":[', coalesce(d, ''), '],"tracks":[', coalesce(k, ''), ']}') AS json FROM frame f LEFT JOIN d USING (game_id, frame_index) LEFT JOIN k USING (game_id, frame_index)""")
def _(t):
    k = ["game_id", "frame_index"]
    return writers.match_json(t.frame.select(*k), t.detection.select(*k, "detection_id", "label"), t.detection.where("track_id IS NOT NULL").select(*k, "detection_id", "track_id"))


@query("s18_training_labels", """
WITH l AS (SELECT game_id, frame_index, printf('%d %.6f %.6f %.6f %.6f', CASE label WHEN 'player' THEN 0 WHEN 'referee' THEN 1 ELSE 2 END, greatest(0, least(1, bbox_x + bbox_w / 2)), greatest(0, least(1, bbox_y + bbox_h / 2)), bbox_w, bbox_h) AS line FROM detection)
SELECT game_id, frame_index, count(*) AS n_boxes, length(string_agg(line, chr(10)))::BIGINT AS n_chars, substr(min(line), 1, 1) AS first_class FROM l GROUP BY ALL""")
def _(t):
    d = writers.training_labels(t.detection, ["player", "referee", "in_play_ball"], ["game_id", "frame_index"])
    return d.select("game_id", "frame_index", "n_boxes", F.length("text").cast("long").alias("n_chars"), F.substring("text", 1, 1).alias("first_class"))


@query("s20_match_table", """
WITH r AS (SELECT game_id AS match, frame_index // 50 AS segment, run_id, frame_index % 50 AS local_frame, quality >= 0.3 AS ok FROM calibration),
n AS (SELECT match, segment, run_id, count_if(ok) AS n FROM r GROUP BY ALL), b AS (SELECT match, segment, arg_max(run_id, (n, CASE run_id WHEN 'cal_r1' THEN 1 ELSE 0 END)) AS run_id FROM n GROUP BY ALL)
SELECT r.match, CAST(r.segment AS INT) AS segment, CAST(r.segment * 50 + r.local_frame AS INT) AS global_frame, r.ok AS accepted FROM r JOIN b USING (match, segment, run_id)""")
def _(t):
    seg = F.floor(F.col("frame_index") / 50).cast("int")
    r = t.calibration.select(F.col("game_id").alias("match"), seg.alias("segment"), F.substring("run_id", 6, 2).cast("int").alias("run_at"), (F.col("frame_index") % 50).alias("local_frame"), (F.col("quality") >= 0.3).alias("accepted"))
    s = r.select("match", "segment").distinct().withColumn("start", F.col("segment") * 50)
    return writers.match_table(s, r).select("match", "segment", F.col("global_frame").cast("int").alias("global_frame"), "accepted")


@query("s22_appended_results", """
SELECT split, label_kind AS metric, count(*)::DOUBLE AS value, 2::BIGINT AS runs FROM item GROUP BY split, label_kind""")
def _(t):
    path = f"{scratch(t)}/eval_result"
    r = t.item.groupBy("split", F.col("label_kind").alias("metric")).agg(F.count("*").cast("double").alias("value"))
    for run in (1, 2):
        writers.append_results(r.withColumn("run_at", F.lit(run)), path)
    d = t.spark.read.parquet(path)
    n = d.groupBy("split", "metric").agg(F.count("*").alias("runs"))
    return windows.latest_result(d.withColumn("cohort", F.lit(None).cast("string")), ["split", "metric"], "cohort", [F.desc("run_at")]).join(n, ["split", "metric"]).select("split", "metric", "value", "runs")


@query("s17_snapshot_verify", """
SELECT split, count(*) AS n FROM item GROUP BY split""")
def _(t):
    root = scratch(t)
    items = snapshots.item_hash(t.item, ["item_id", "split", "label_kind", "payload"])
    writers.write_snapshot(items, snapshots.content_hash(items), root, "tracking", 1)
    return writers.load_snapshot(t.spark, root, "tracking", 1).groupBy("split").agg(F.count("*").alias("n"))


@query("s13_flat_detections", """
SELECT f.game_id, f.frame_index, count(d.detection_id) AS n_boxes, coalesce(string_agg(d.label, ',' ORDER BY d.detection_id), '') AS labels FROM frame f LEFT JOIN detection d USING (game_id, frame_index) GROUP BY ALL""")
def _(t):
    k = ["game_id", "frame_index"]
    g = t.detection.groupBy(*k).agg(F.array_sort(F.collect_list(F.struct("detection_id", "label"))).alias("b"))
    d = t.frame.select(*k).join(g, k, "left")
    return d.select(*k, F.coalesce(F.size("b"), F.lit(0)).cast("long").alias("n_boxes"), F.coalesce(F.concat_ws(",", F.transform("b", lambda x: x["label"])), F.lit("")).alias("labels"))


@query("k01_evaluation_rows", """
SELECT s.split, CASE WHEN c.cohort = 0 THEN NULL ELSE c.cohort END AS cohort, concat('n_', i.label_kind) AS metric, count(*)::DOUBLE AS value, s.split = 'train' AS contaminated
FROM item i, (SELECT unnest(['train', 'eval_heldout_match', 'eval_in_match', 'eval_all']) AS split) s, (SELECT unnest([0, 2])::INT AS cohort) c
WHERE (i.split = s.split OR (s.split = 'eval_all' AND i.split LIKE 'eval%')) AND (c.cohort = 0 OR i.frame_index % 3 + 1 <= c.cohort) GROUP BY ALL""")
def _(t):
    items = t.item.withColumn("first_version", F.col("frame_index") % 3 + 1)
    flags = t.spark.createDataFrame([(s, s == "train") for s in ("train", "eval_heldout_match", "eval_in_match", "eval_all")], "split string, contaminated boolean")
    return evaluate.evaluate("label_kinds", items, flags, cohort=2)


@query("c02_tracking_items", """
WITH b AS (SELECT game_id, frame_index, bool_or(label = 'in_play_ball') AS lb, min(CASE WHEN label = 'in_play_ball' THEN CASE WHEN source = 'hand_label' THEN 1 WHEN reviewed THEN 2 ELSE 3 END END) AS bt, min(CASE WHEN source = 'hand_label' THEN 1 WHEN reviewed THEN 2 ELSE 3 END) AS at_,
 string_agg(concat(source, ':', label), ',' ORDER BY source, label, bbox_x, bbox_y, bbox_w, bbox_h) AS p FROM detection WHERE starts_with(run_id, 'gt_import_') GROUP BY ALL)
SELECT concat(game_id, ':', frame_index) AS item_id, CASE WHEN lb THEN 'ball' ELSE 'other_boxes' END AS label_kind, CAST(coalesce(CASE WHEN lb THEN bt END, at_) AS INT) AS tier, p AS boxes FROM b""")
def _(t):
    d = jobs.tracking_items(t.detection)
    return d.select("item_id", "label_kind", "tier", F.concat_ws(",", F.transform("boxes", lambda b: F.concat_ws(":", b["source"], b["label"]))).alias("boxes"))


@query("c06_training_export", f"""
WITH {CANON}, st AS (SELECT game_id, frame_index, max(CASE WHEN cls_group = 'ball' THEN state END) AS bs, max(CASE WHEN cls_group = 'player' THEN state END) AS ps FROM frame_label_state GROUP BY ALL),
f AS (SELECT game_id, frame_index, count(*) AS n FROM cn GROUP BY ALL)
SELECT f.game_id, f.frame_index, n AS n_boxes, CASE WHEN bs IS NULL AND ps IS NULL THEN 'no_state' WHEN bs = 'partial' OR ps = 'partial' THEN 'partial' WHEN coalesce(bs, 'unreviewed') = 'unreviewed' THEN 'ball_unreviewed' WHEN coalesce(ps, 'unreviewed') = 'unreviewed' THEN 'player_unreviewed' ELSE 'export' END AS decision
FROM f LEFT JOIN st USING (game_id, frame_index)""")
def _(t):
    return jobs.export_decisions(canonical_rows(t), t.frame_label_state).select("game_id", "frame_index", "n_boxes", "decision")


@query("c09_mining_round")
def _(t):
    """Cards of one round over the whole pool: buckets in order, spacing, per-clip and per-match caps."""
    f = bucket_flags()
    p = node_pool(t)
    p = p.select("match", "clip", "frame", "node_id", "fps", "x", "y", "p_real", *[f[k].alias(k) for k in ("u", "m", "n", "a", "a_band", "u_rank", "m_rank", "n_rank")])
    return jobs.mine_round(p, budget=300)


LINKING = f"""
{LINK}, v AS (SELECT track_id, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM crop),
side AS (SELECT track_id, pos, avg(x) AS x FROM v GROUP BY ALL),
near AS (SELECT a, b, round(sum(p.x * q.x) / sqrt(sum(p.x * p.x) * sum(q.x * q.x)), 4) AS similarity FROM lk JOIN side p ON p.track_id = a JOIN side q ON q.track_id = b AND q.pos = p.pos GROUP BY a, b),
sc AS (SELECT lk.*, similarity, CASE WHEN similarity IS NULL THEN 'ask' WHEN similarity >= 0.80 THEN 'merge' WHEN similarity < 0.55 THEN 'reject' ELSE 'ask' END AS decision,
  coalesce(abs(similarity - 0.675), 0) AS uncertainty FROM lk LEFT JOIN near USING (a, b))"""


def linked(t):
    """Compared tracklets and the identities that merging leaves."""
    from matchgrid.operators import linking

    found = linking.compared(t.tracklet, t.crop)
    return found, linking.merged_identities(t.tracklet, linking.decided_links(*found[:2]).where("decision = 'merge'"))


@query("c11_tracklet_links", f"""
WITH {LINKING} SELECT clip, a, b, gap, round(distance, 6) AS distance, similarity, decision, row_number() OVER (PARTITION BY clip, decision
  ORDER BY CASE decision WHEN 'ask' THEN round(uncertainty, 6) WHEN 'merge' THEN -similarity ELSE similarity END, a, b) AS place FROM sc""")
def _(t):
    from matchgrid.operators import linking

    d = linking.scored_links(t.tracklet, t.crop)
    return d.select("clip", "a", "b", "gap", rounded("distance", 6).alias("distance"), "similarity", "decision", "place")


@query("c11_identities")
def _(t):
    """Every tracklet with its identity and the identity's number of tracklets and frames."""
    members = linked(t)[1]
    size = members.groupBy("clip", "identity").agg(F.count("*").alias("tracklets"), F.sum(F.col("end_frame") - F.col("start_frame") + 1).alias("frames"))
    return members.join(size, ["clip", "identity"]).select("clip", "track_id", "identity", "tracklets", "frames")


@query("c11_linking_report")
def _(t):
    """Every link with its decision, its place in the list, the identities of its ends and what is left to do."""
    from matchgrid.operators import linking

    found, members = linked(t)
    d = linking.reported_links(*found, members)
    return d.select("clip", "a", "b", "similarity", "decision", "place", "identity_a", "identity_b", "outcome")


def _overlap(a: str, b: str) -> str:
    """SQL of the IoU of two boxes."""
    side = lambda v, s: f"greatest(0, least({a}.bbox_{v} + {a}.bbox_{s}, {b}.bbox_{v} + {b}.bbox_{s}) - greatest({a}.bbox_{v}, {b}.bbox_{v}))"
    both = f"({side('x', 'w')} * {side('y', 'h')})"
    return f"{both} / ({a}.bbox_w * {a}.bbox_h + {b}.bbox_w * {b}.bbox_h - {both})"


RATES = ", ".join(
    f"sum(hit) FILTER (WHERE side = '{side}'{where}) / sum(1) FILTER (WHERE side = '{side}'{where}) AS person_{side}_{name}"
    for side in ("recall", "precision") for name, where in [*((b, f" AND bucket = '{b}'") for b in ("isolated", "touching", "overlapping")), ("all", "")])


@query("a34_teacher_score", f"""
WITH fr AS (SELECT game_id, frame_index, width, height, bool_or(cls_group = 'ball') AS ball, bool_or(cls_group = 'player') AS person
  FROM frame_label_state JOIN frame USING (game_id, frame_index) WHERE method IN ('hand_series', 'hand_frame', 'verdict') GROUP BY ALL),
d AS (SELECT *, CASE WHEN source = 'hand_label' THEN 'recall' ELSE 'precision' END AS side FROM detection WHERE source IN ('hand_label', 'yolo') AND label IN ('in_play_ball', 'player')),
ball AS (SELECT game_id, frame_index, side, arg_min({{'x': bbox_x + bbox_w / 2, 'y': bbox_y + bbox_h / 2}}, (-coalesce(confidence, 1), detection_id)) AS at_ FROM d WHERE label = 'in_play_ball' GROUP BY ALL),
b AS (SELECT fr.*, g.at_ AS g, p.at_ AS p, sqrt((g.at_.x - p.at_.x) * width * ((g.at_.x - p.at_.x) * width) + (g.at_.y - p.at_.y) * height * ((g.at_.y - p.at_.y) * height)) AS away
  FROM fr LEFT JOIN ball g ON g.game_id = fr.game_id AND g.frame_index = fr.frame_index AND g.side = 'recall' LEFT JOIN ball p ON p.game_id = fr.game_id AND p.frame_index = fr.frame_index AND p.side = 'precision' WHERE ball),
balls AS (SELECT game_id, count(*) AS n_ball_frames, count_if(away <= 10) / nullif(count(g), 0) AS ball_recall_10px, count_if(away <= 25) / nullif(count(g), 0) AS ball_recall_25px,
  count_if(away <= 10) / nullif(count(p), 0) AS ball_precision_10px, count_if(away <= 25) / nullif(count(p), 0) AS ball_precision_25px FROM b GROUP BY ALL),
per AS (SELECT d.* FROM d SEMI JOIN (SELECT * FROM fr WHERE person) fr USING (game_id, frame_index) WHERE label = 'player'),
pr AS (SELECT a.game_id, a.frame_index, list([{{'g': a.detection_id, 'p': b.detection_id}}] ORDER BY {_overlap('a', 'b')} DESC, a.detection_id, b.detection_id) AS l
  FROM per a JOIN per b USING (game_id, frame_index) WHERE a.side = 'recall' AND b.side = 'precision' AND {_overlap('a', 'b')} >= 0.5 GROUP BY ALL),
met AS (SELECT game_id, frame_index, unnest(list_reduce(l, lambda acc, e: CASE WHEN len(list_filter(acc, lambda q: q.g = e[1].g OR q.p = e[1].p)) > 0 THEN acc ELSE list_concat(acc, e) END)) AS m FROM pr),
hit AS (SELECT game_id, frame_index, unnest([m.g, m.p]) AS detection_id FROM met),
most AS (SELECT a.game_id, a.frame_index, a.detection_id, max({_overlap('a', 'b')}) AS most FROM per a JOIN per b USING (game_id, frame_index, side) WHERE a.detection_id <> b.detection_id GROUP BY ALL),
t AS (SELECT game_id, side, CASE WHEN coalesce(most, 0) < 0.1 THEN 'isolated' WHEN most < 0.3 THEN 'touching' ELSE 'overlapping' END AS bucket,
  CAST((game_id, frame_index, detection_id) IN (SELECT (game_id, frame_index, detection_id) FROM hit) AS INT) AS hit FROM per LEFT JOIN most USING (game_id, frame_index, detection_id)),
persons AS (SELECT * FROM (SELECT game_id, count(*) AS n_player_frames FROM fr WHERE person GROUP BY ALL) LEFT JOIN (SELECT game_id, {RATES} FROM t GROUP BY ALL) USING (game_id))
SELECT * REPLACE (coalesce(n_ball_frames, 0) AS n_ball_frames, coalesce(n_player_frames, 0) AS n_player_frames) FROM balls FULL JOIN persons USING (game_id)""")
def _(t):
    """Ball and persons of the machine boxes on gold frames, one row per match."""
    gold = F.col("method").isin(*evaluate.GOLD_METHODS)
    fr = t.frame_label_state.where(gold).groupBy("game_id", "frame_index").agg(F.bool_or(F.col("cls_group") == "ball").alias("ball"), F.bool_or(F.col("cls_group") == "player").alias("person"))
    fr = fr.join(t.frame.select("game_id", "frame_index", "width", "height"), ["game_id", "frame_index"])
    kind = F.when(F.col("label") == "in_play_ball", "ball").when(F.col("label") == "player", "person")
    d = t.detection.where("source IN ('hand_label', 'yolo')").withColumn("kind", kind).where("kind IS NOT NULL")
    d = cut_lineage(d.select("game_id", "frame_index", "detection_id", "source", "kind", "confidence", "bbox_x", "bbox_y", "bbox_w", "bbox_h"))
    return evaluate.teacher_scores(fr, d.where("source = 'hand_label'"), d.where("source = 'yolo'"), "game_id", ["game_id", "frame_index"])
