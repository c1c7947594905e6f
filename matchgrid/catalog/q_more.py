"""Further operators: adapters, fits, samples, idempotent ingest."""

from pyspark.sql import functions as F

from matchgrid.catalog.q_jobs import scratch
from matchgrid.catalog.registry import query
from matchgrid.functions import ids
from matchgrid.operators import homography, snapshots, trackers, windows
from matchgrid.plans import ingest
from matchgrid.sources import readers, writers


@query("x07_window_tracklets")
def _(t):
    """Candidate tracklets inside each 50-frame window."""
    d = t.ball_candidate.withColumn("win", F.floor(F.col("frame_index") / 50).cast("long"))
    return trackers.window_tracklets(d, "clip", "win")


@query("k06_homography_fit")
def _(t):
    """Homography per clip-second from its labelled points."""
    p = t.keypoint.withColumn("sec", F.floor(F.col("frame_index") / 25).cast("int"))
    return homography.fit_homographies(p, ["game_id", "sec"])


@query("t20_stratified_frames", """
WITH s AS (SELECT clip, frame_index, CASE WHEN CAST(substr(clip, 2) AS INT) < 4 THEN 'heldout' WHEN label_kind = 'no_ball' THEN 'no_ball' WHEN tier = 1 THEN 'seen_sure' ELSE 'seen' END AS stratum FROM item),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha1(concat('0:', clip, ':', frame_index))) AS rn FROM s)
SELECT clip, frame_index, stratum FROM r WHERE stratum = 'heldout' OR rn <= 100""")
def _(t):
    n = F.substring("clip", 2, 9).cast("int")
    st = F.when(n < 4, "heldout").when(F.col("label_kind") == "no_ball", "no_ball").when(F.col("tier") == 1, "seen_sure").otherwise("seen")
    d = t.item.select("clip", "frame_index", st.alias("stratum")).withColumn("h", F.sha1(F.concat(F.lit("0:"), "clip", F.lit(":"), "frame_index")))
    few = windows.top_k(d.where("stratum <> 'heldout'"), ["stratum"], [F.col("h")], 100)
    return few.unionByName(d.where("stratum = 'heldout'")).drop("h")


@query("s12_pool_adapter", """
SELECT game_id AS match, frame_index AS frame, detection_id, round(greatest(0, least(1, bbox_x + bbox_w / 2)), 6) AS x, round(greatest(0, least(1, bbox_y + bbox_h / 2)), 6) AS y, round(greatest(0, least(1, confidence)), 5) AS score FROM detection WHERE confidence IS NOT NULL""")
def _(t):
    box = F.struct(*[F.col(f"bbox_{c}").alias(c) for c in "xywh"])
    d = t.detection.where("confidence IS NOT NULL").select(F.col("game_id").alias("clip"), "frame_index", box.alias("bbox"), F.lit(None).cast("struct<x:double,y:double>").alias("center"),
                                                          "confidence", F.col("detection_id").cast("string").alias("detector_sha"))
    p = readers.pool_from_labels(d, F.col("clip"), 25.0)
    return p.select("match", "frame", F.col("detector_sha").cast("long").alias("detection_id"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round(F.col("p_real").cast("double"), 5).alias("score"))


@query("s16_csv_fan_out", "SELECT game_id, frame_index, detection_id, label, track_id FROM detection")
def _(t):
    root = scratch(t)
    d = t.detection.select("game_id", "frame_index", "detection_id", "label", "track_id")
    writers.write_csvs({"detections": d, "frames": t.frame.select("game_id", "frame_index")}, root)
    return t.spark.read.schema(d.schema).option("header", True).csv(f"{root}/detections")


@query("s19_auto_accept_sink", "SELECT match, clip, frame, node_id FROM pool WHERE p_real >= 0.8")
def _(t):
    path = f"{scratch(t)}/auto"
    rows = t.pool.where(F.col("p_real") >= 0.8).select("match", "clip", "frame", "node_id")
    writers.write_auto_accept(rows, t.game.select(F.col("game_id").alias("match")), path)
    back = t.spark.read.schema("clip string, frame int, node_id long, match string").json(path)
    return back.where("clip IS NOT NULL").select("match", "clip", "frame", "node_id")


@query("c01_idempotent_ingest", """
SELECT 2 AS run, count(*) AS rows_after, true AS unchanged FROM (SELECT game_id, frame_index, cls_group FROM frame_label_state UNION SELECT game_id, frame_index, cls_group FROM state_batch)""")
def _(t):
    k = ["game_id", "frame_index", "cls_group", "state", "method"]
    once, _r = ingest.ingest_states(t.frame_label_state.select(*k), t.state_batch)
    _again, report = ingest.ingest_states(once, t.state_batch)
    return report.select(F.lit(2).alias("run"), "rows_after", "unchanged")


@query("c03_snapshot_bump", """
WITH p AS (SELECT item_id, split, sha256(concat_ws('|', item_id, label_kind)) AS h FROM item WHERE frame_index % 7 <> 0),
c AS (SELECT item_id, split, sha256(concat_ws('|', item_id, CASE WHEN tier = 2 THEN 'ball' ELSE label_kind END)) AS h FROM item WHERE frame_index % 11 <> 0)
SELECT CASE WHEN p.h IS NULL THEN 'added' WHEN c.h IS NULL THEN 'removed' ELSE 'changed' END AS change, coalesce(c.split, p.split) AS split, count(*) AS n FROM c FULL JOIN p USING (item_id) WHERE p.h IS NULL OR c.h IS NULL OR p.h <> c.h GROUP BY ALL""")
def _(t):
    p = snapshots.item_hash(t.item.where("frame_index % 7 <> 0"), ["item_id", "label_kind"]).withColumn("first_version", F.lit(1))
    c = t.item.where("frame_index % 11 <> 0").withColumn("label_kind", F.when(F.col("tier") == 2, "ball").otherwise(F.col("label_kind")))
    return ingest.bump(snapshots.item_hash(c, ["item_id", "label_kind"]), p, 2)[1]


@query("c13_progress_report", """
SELECT split, count(DISTINCT clip) AS clips, count(*) AS items, count_if(tier = 1)::BIGINT AS gold, round(count_if(tier = 1) / count(*), 6) AS gold_share FROM item GROUP BY split""")
def _(t):
    g = t.item.groupBy("split").agg(F.countDistinct("clip").alias("clips"), F.count("*").alias("items"), F.count_if(F.col("tier") == 1).alias("gold"))
    return g.withColumn("gold_share", F.round(F.col("gold") / F.col("items"), 6))


@query("f02_hash_keys", """
SELECT game_id, frame_index, CAST('0x' || substr(sha1(concat(game_id, ':', frame_index)), 1, 15) AS BIGINT) AS h60 FROM frame""")
def _(t):
    return t.frame.select("game_id", "frame_index", ids.hash60(F.concat("game_id", F.lit(":"), "frame_index")).alias("h60"))
