"""Portable views that give the driver tables the shape of a detection store.

The text is valid in Spark SQL and in DuckDB, so both sides of a check start from the same rows.
This is test-data plumbing, not an operator.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

VIEWS: dict[str, str] = {}

VIEWS["game"] = """
SELECT concat('g', n_nationkey) AS game_id, n_name AS home_team, CAST(25.0 AS DOUBLE) AS fps,
       CAST(n_nationkey % 4 AS INT) AS match_bucket, CAST(2700 + n_nationkey AS DOUBLE) AS half2_start_continuous_s
FROM nation
"""

VIEWS["run"] = """
SELECT 'gt_import_labeller' AS run_id, 'detection' AS stage, 'hand_label' AS src, 'human' AS model_name
UNION ALL SELECT 'gt_import_yolo', 'detection', 'yolo', 'yolo'
UNION ALL SELECT 'gt_import_sam3', 'detection', 'sam3', 'sam3'
UNION ALL SELECT 'roboflow_v11', 'detection', 'hand_label', 'human'
UNION ALL SELECT 'yolo_r1', 'detection', 'yolo', 'yolo_r1'
"""

VIEWS["frame"] = """
SELECT concat('g', o_orderkey % 25) AS game_id, CAST(floor(o_orderkey / 25) AS INT) AS frame_index,
       floor(o_orderkey / 25) / CAST(25 AS DOUBLE) AS continuous_time_s, 1920 AS width, 1080 AS height,
       CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS is_broadcast
FROM orders
"""

VIEWS["detection"] = """
SELECT game_id, frame_index, frame_index / CAST(25 AS DOUBLE) AS continuous_time_s, CAST(rn - 1 AS BIGINT) AS detection_id,
       source, run_id, label, CASE WHEN source = 'hand_label' THEN NULL ELSE confidence END AS confidence,
       bbox_x, bbox_y, bbox_w, bbox_h, track_id, reviewed
FROM (
  SELECT d.*, row_number() OVER (PARTITION BY game_id, frame_index ORDER BY l_linenumber, l_partkey, l_suppkey,
                                 l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS rn
  FROM (
    SELECT concat('g', l_orderkey % 25) AS game_id, CAST(floor(l_orderkey / 25) AS INT) AS frame_index,
         l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus,
         CASE l_returnflag WHEN 'A' THEN 'hand_label' WHEN 'N' THEN 'yolo' ELSE 'sam3' END AS source,
         CASE WHEN l_linestatus = 'F'
              THEN CASE l_returnflag WHEN 'A' THEN 'gt_import_labeller' WHEN 'N' THEN 'gt_import_yolo' ELSE 'gt_import_sam3' END
              ELSE CASE l_returnflag WHEN 'A' THEN 'roboflow_v11' WHEN 'N' THEN 'yolo_r1' ELSE 'sam3_r1' END END AS run_id,
         CASE l_partkey % 5 WHEN 0 THEN 'in_play_ball' WHEN 1 THEN 'referee' ELSE 'player' END AS label,
         l_discount * CAST(5 AS DOUBLE) + l_tax * CAST(6 AS DOUBLE) AS confidence,
         (l_partkey % 40) / CAST(50 AS DOUBLE) AS bbox_x, (l_suppkey % 35) / CAST(50 AS DOUBLE) AS bbox_y,
         (50 + l_quantity) / CAST(500 AS DOUBLE) AS bbox_w, (60 + l_quantity) / CAST(400 AS DOUBLE) AS bbox_h,
         CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE CAST(l_suppkey % 30 AS INT) END AS track_id,
         (l_linestatus = 'O' OR l_returnflag = 'A') AS reviewed
    FROM lineitem) d) t
"""

VIEWS["calibration"] = """
SELECT concat('g', o_orderkey % 25) AS game_id, CAST(floor(o_orderkey / 25) AS INT) AS frame_index,
       CASE WHEN o_custkey % 7 = 0 AND k = 1 THEN 'hand_label' WHEN k = 1 THEN 'model' ELSE 'classical' END AS source,
       concat('cal_r', k) AS run_id,
       CASE WHEN o_custkey % 7 = 0 AND k = 1 THEN 'hand'
            WHEN o_orderpriority LIKE '1%' THEN 'accepted' WHEN o_orderpriority LIKE '2%' THEN 'rejected'
            WHEN o_orderpriority LIKE '3%' AND k = 2 THEN 'not_broadcast' ELSE 'proposed' END AS review_status,
       (o_custkey % 101) / CAST(100 AS DOUBLE) AS quality,
       CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_orderdate END AS created_at,
       (o_custkey % 5) / CAST(50 AS DOUBLE) AS distortion_k1,
       CAST(105 AS DOUBLE) AS h1, (o_custkey % 9) / CAST(10 AS DOUBLE) AS h2, CAST(-52.5 AS DOUBLE) AS h3,
       (o_orderkey % 7) / CAST(10 AS DOUBLE) AS h4, CAST(68 AS DOUBLE) AS h5, CAST(-34 AS DOUBLE) AS h6,
       CAST(0 AS DOUBLE) AS h7, (o_custkey % 4) / CAST(10 AS DOUBLE) AS h8, CAST(1 AS DOUBLE) AS h9
FROM (SELECT orders.*, 1 AS k FROM orders UNION ALL SELECT orders.*, 2 AS k FROM orders) kk
WHERE (k = 1 AND o_orderkey % 3 <> 0) OR (k = 2 AND o_orderkey % 2 = 0)
"""

VIEWS["frame_label_state"] = """
SELECT concat('g', o_orderkey % 25) AS game_id, CAST(floor(o_orderkey / 25) AS INT) AS frame_index, cls_group,
       CASE (o_custkey + gi) % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'absent' WHEN 2 THEN 'partial' ELSE 'unreviewed' END AS state,
       CASE (o_custkey + 2 * gi) % 5 WHEN 0 THEN 'hand_series' WHEN 1 THEN 'hand_frame' WHEN 2 THEN 'verdict'
            WHEN 3 THEN 'offline_audited' ELSE 'sidecar_marker' END AS method,
       CASE WHEN (o_custkey + 2 * gi) % 5 = 3 THEN concat('offline_v', o_custkey % 3) END AS teacher_version
FROM (SELECT orders.*, 'ball' AS cls_group, 0 AS gi FROM orders
      UNION ALL SELECT orders.*, 'player' AS cls_group, 1 AS gi FROM orders) g
WHERE (o_orderkey + gi) % 6 <> 0
"""

VIEWS["verdict_log"] = """
SELECT concat('g', user_id % 25) AS game_id, CASE WHEN user_id % 2 = 0 THEN 'sidecar' ELSE 'cand' END AS vsource,
       CAST(user_id * 3 % 40 AS INT) AS frame_index, CAST(floor(value) % 3 AS INT) AS box_index, ts, event_id AS line_no,
       CASE event_type WHEN 'purchase' THEN 'ball' WHEN 'signup' THEN 'corrected' WHEN 'click' THEN 'not_ball'
            WHEN 'view' THEN 'unsure' END AS verdict,
       (event_id % 100) / CAST(100 AS DOUBLE) AS confidence
FROM events
"""

VIEWS["frame_status"] = """
SELECT concat('clip', user_id) AS clip, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS frame,
       (event_type IN ('view', 'click', 'purchase')) AS is_on,
       CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END AS code,
       CAST(length(props) % 4 + user_id % 3 AS INT) AS person_count, value
FROM events
"""

VIEWS["tracklet"] = """
SELECT concat('clip', o_custkey % 50) AS clip, o_orderkey AS track_id, CAST(o_orderkey % 4000 AS INT) AS start_frame,
       CAST(o_orderkey % 4000 + o_custkey % 40 AS INT) AS end_frame,
       (o_custkey % 97) / CAST(97 AS DOUBLE) AS start_x, (o_orderkey % 89) / CAST(89 AS DOUBLE) AS start_y,
       (o_orderkey % 83) / CAST(83 AS DOUBLE) AS end_x, (o_custkey % 79) / CAST(79 AS DOUBLE) AS end_y,
       CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS team
FROM orders
"""

# Crops of a tracklet's player: three vectors each, shared by tracklets that start alike; some tracklets have none.
VIEWS["crop"] = """
SELECT o_orderkey AS track_id, vec_id, embedding
FROM (SELECT orders.*, 0 AS k FROM orders UNION ALL SELECT orders.*, 1 AS k FROM orders UNION ALL SELECT orders.*, 2 AS k FROM orders) o
JOIN embeddings ON vec_id = o_orderkey % 4000 % 4 + k
WHERE o_custkey % 7 <> 0
"""

# The pool keys its nodes by (match, clip, frame, node_id); source scores are kept as two columns.
VIEWS["pool"] = """
SELECT game_id AS match, concat(game_id, '_seg', lpad(CAST(CAST(floor(frame_index / 50) AS BIGINT) AS STRING), 3, '0')) AS clip,
       CAST(frame_index % 50 AS INT) AS frame, detection_id AS node_id,
       CAST(25 AS DOUBLE) AS fps, bbox_x + bbox_w / 2 AS x, bbox_y + bbox_h / 2 AS y, bbox_w AS w, bbox_h AS h,
       source AS src, coalesce(confidence, CAST(1 AS DOUBLE)) AS p_real,
       CASE WHEN track_id IS NULL THEN NULL ELSE track_id % 5 <> 0 END AS plausible, detection_id % 9 = 8 AS gap_frame,
       CASE WHEN track_id % 6 = 0 THEN true WHEN track_id % 6 = 1 THEN false END AS static_flag
FROM detection
"""

# Human ball marks: hand boxes of ball labels; predictions: the strongest machine ball per frame.
VIEWS["ball_mark"] = """
SELECT game_id AS clip, frame_index, bbox_x + bbox_w / 2 AS x, bbox_y + bbox_h / 2 AS y, detection_id
FROM detection WHERE source = 'hand_label' AND label = 'in_play_ball'
"""

VIEWS["ball_candidate"] = """
SELECT game_id AS clip, frame_index, bbox_x + bbox_w / 2 AS x, bbox_y + bbox_h / 2 AS y, confidence, detection_id,
       bbox_x, bbox_y, bbox_w, bbox_h
FROM detection WHERE source <> 'hand_label'
"""

VIEWS["item"] = """
SELECT concat('tracking:g', o_orderkey % 25, ':', CAST(floor(o_orderkey / 25) AS BIGINT)) AS item_id,
       concat('g', o_orderkey % 25) AS clip,
       CAST(floor(o_orderkey / 25) AS INT) AS frame_index,
       CASE o_custkey % 4 WHEN 0 THEN 'ball' WHEN 1 THEN 'no_ball' WHEN 2 THEN 'other_boxes' ELSE 'not_broadcast' END AS label_kind,
       CAST(o_custkey % 3 + 1 AS INT) AS tier,
       CASE WHEN o_orderkey % 25 < 4 THEN 'eval_heldout_match' WHEN o_orderkey % 25 < 9 THEN 'eval_in_match' ELSE 'train' END AS split,
       concat('{"n":', o_custkey % 1000, '}') AS payload
FROM orders
"""


# A batch of label-state writes; ``seq`` is the arrival order inside the batch.
VIEWS["state_batch"] = """
SELECT game_id, frame_index, CASE WHEN label = 'in_play_ball' THEN 'ball' ELSE 'player' END AS cls_group,
       CASE source WHEN 'hand_label' THEN 'complete' WHEN 'yolo' THEN 'partial' ELSE 'absent' END AS state,
       CASE WHEN track_id IS NULL THEN 'hand_frame' WHEN track_id % 4 = 0 THEN 'verdict' WHEN track_id % 4 = 1 THEN 'offline_audited'
            WHEN track_id % 4 = 2 THEN 'sidecar_marker' ELSE 'hand_series' END AS method,
       detection_id AS seq
FROM detection
"""

VIEWS["pair_log"] = """
SELECT concat('clip', user_id % 20) AS clip, CAST(user_id % 31 AS BIGINT) AS a, CAST(event_id * 7 % 31 AS BIGINT) AS b, event_id AS line_no,
       CASE event_type WHEN 'purchase' THEN 'same' WHEN 'click' THEN 'different' WHEN 'view' THEN 'unknown' WHEN 'signup' THEN 'different' END AS verdict
FROM events WHERE user_id % 31 <> event_id * 7 % 31
"""

# Names as they occur on disk: clip files and image exports.
VIEWS["clip_name"] = """
SELECT o_orderkey AS name_id,
       CASE o_orderkey % 6
         WHEN 0 THEN concat('north_east_2025', lpad(CAST(o_custkey % 1000 AS STRING), 4, '0'), '_seg', o_custkey % 97)
         WHEN 1 THEN concat('/data/clips/east_seg', lpad(CAST(o_custkey % 97 AS STRING), 3, '0'), '.mp4')
         WHEN 2 THEN concat('North vs West 1_seg', o_custkey % 97)
         WHEN 3 THEN concat('west_1st_seg', lpad(CAST(o_custkey % 97 AS STRING), 4, '0'), '.jsonl')
         WHEN 4 THEN concat('unknown match (', o_custkey % 50, ')')
         ELSE concat('plain_', o_custkey % 50) END AS name,
       CASE o_orderkey % 4
         WHEN 0 THEN concat('train/north_east_seg', lpad(CAST(o_custkey % 97 AS STRING), 3, '0'), '_', lpad(CAST(o_orderkey % 5000 AS STRING), 6, '0'), '_png.rf.', substr(sha1(CAST(o_orderkey AS STRING)), 1, 12), '.jpg')
         WHEN 1 THEN concat('valid/north_west_1st_seg', lpad(CAST(o_custkey % 97 AS STRING), 3, '0'), '_frame_', lpad(CAST(o_orderkey % 5000 AS STRING), 6, '0'), '.jpg')
         WHEN 2 THEN concat('train/north_west_1st_f', o_orderkey % 5000, '.jpg')
         ELSE concat('train/picture', '.jpg') END AS image
FROM orders
"""

# Reviewed boxes: the latest live verdict of a key with the box it was given on.
VIEWS["verdict_box"] = """
SELECT game_id, vsource, frame_index, box_index, verdict, line_no AS verdict_id,
       (line_no % 40) / CAST(50 AS DOUBLE) AS bx, (line_no * 7 % 35) / CAST(50 AS DOUBLE) AS by_,
       CAST(0.15 AS DOUBLE) AS bw, CAST(0.22 AS DOUBLE) AS bh,
       CASE WHEN verdict = 'corrected' THEN (line_no % 40) / CAST(50 AS DOUBLE) + CAST(0.03 AS DOUBLE) END AS cx
FROM verdict_log WHERE verdict IS NOT NULL
"""

# Labelled pitch points: three per frame.
VIEWS["keypoint"] = """
SELECT concat('g', o_orderkey % 25) AS game_id, CAST(floor(o_orderkey / 25) AS INT) AS frame_index, point_idx,
       (o_custkey * (point_idx + 3) % 1000) / CAST(1000 AS DOUBLE) AS u, (o_orderkey * (point_idx + 7) % 997) / CAST(997 AS DOUBLE) AS v,
       CAST(o_custkey * (point_idx + 3) % 105 AS DOUBLE) - CAST(52.5 AS DOUBLE) AS pitch_x,
       CAST(o_orderkey * (point_idx + 7) % 68 AS DOUBLE) - CAST(34 AS DOUBLE) AS pitch_y
FROM (SELECT orders.*, 0 AS point_idx FROM orders UNION ALL SELECT orders.*, 1 AS point_idx FROM orders
      UNION ALL SELECT orders.*, 2 AS point_idx FROM orders) p
"""


# A labelled evaluation panel: human state and mark, prediction, inclusion probability of the 5-frame window.
VIEWS["panel_frame"] = """
SELECT concat('g', o_orderkey % 25) AS match, CAST(floor(o_orderkey / 25) AS INT) AS frame, CAST(floor(o_orderkey / 125) AS INT) AS win,
       CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_custkey % 5 = 0 THEN 'no_ball' WHEN o_custkey % 11 = 0 THEN 'not_broadcast' ELSE 'ball' END AS state,
       CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE abs(o_orderkey % 13 - 6) * CAST(4.75 AS DOUBLE) END AS dist,
       CASE o_orderkey % 4 WHEN 0 THEN 'interpolated' ELSE 'detected' END AS src,
       CAST(0.05 AS DOUBLE) * (1 + floor(o_orderkey / 125) % 4) AS pi, o_custkey % 3 = 0 AS shown
FROM orders
"""

# Judged cards of mining rounds.
VIEWS["card"] = """
SELECT concat('g', l_orderkey % 25) AS match, CAST(floor(l_orderkey / 25) AS INT) AS frame, l_linenumber AS box,
       CASE l_suppkey % 6 WHEN 0 THEN 'U' WHEN 1 THEN 'M' WHEN 2 THEN 'N' WHEN 3 THEN 'R' WHEN 4 THEN 'A' ELSE 'G' END AS bucket,
       CASE WHEN l_partkey % 29 = 0 THEN 'unsure' WHEN l_partkey % 97 = 0 THEN 'not_ball' WHEN l_partkey % 131 = 0 THEN 'box_off'
            WHEN l_partkey % 7 = 0 THEN 'corrected' ELSE 'ball' END AS verdict,
       0.4 + (l_partkey % 60) / CAST(100 AS DOUBLE) AS p_real, 'v1' AS scorer_version, l_quantity / CAST(50 AS DOUBLE) AS pi
FROM lineitem
"""

def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(_inline(VIEWS[name], sf_dir))


def _inline(sql: str, sf_dir: str) -> str:
    """Replace table and view names after FROM and JOIN by files and nested queries."""

    def sub(m: re.Match) -> str:
        lead, word = m.groups()
        if word in BASE_TABLES:
            return f"{lead} parquet.`{sf_dir}/{word}.parquet` AS {word}"
        if word in VIEWS:
            return f"{lead} ({_inline(VIEWS[word], sf_dir)}) AS {word}"
        return m.group(0)

    return re.sub(r"(FROM|JOIN)\s+([a-z_]+)\b", sub, sql)
