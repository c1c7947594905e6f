"""Readers of label, verdict, calibration and detection files. All files of a kind are read as one DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchgrid.functions import boxes, ids, labels

BOX = "struct<x:double,y:double,w:double,h:double>"
POINT = "struct<x:double,y:double>"


def stem(path: Column | None = None) -> Column:
    """Clip name of a path, by default of the file that a row comes from."""
    return ids.clip_stem(source_file() if path is None else path)


def source_file() -> Column:
    """Path of the file that a row comes from, with its escapes undone (a plus sign is not one)."""
    return F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))


def read_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """Ground-truth lines ``{frame_index, bbox, center, tags}``; the file name is the game."""
    d = spark.read.schema(f"frame_index int, bbox {BOX}, center {POINT}, tags array<string>").option("mode", "DROPMALFORMED").json(folder)
    d = d.select(stem().alias("game_id"), "*").where("frame_index IS NOT NULL")
    return d.withColumn("label", labels.object_class("tags")).withColumn("provenance", labels.provenance("tags")).withColumn(
        "checked", F.coalesce(labels.is_checked("tags"), F.lit(False))).withColumn("marker", labels.marker("tags"))


def read_machine_labels(spark: SparkSession, folder: str, wanted: Sequence[str], min_conf: float = 0.0) -> DataFrame:
    """Detector lines with a class and a confidence filter. The cheap text test runs before the JSON parser."""
    schema = f"frame_index int, bbox {BOX}, center {POINT}, tags array<string>, confidence double, track_id long, detector_sha string"
    text = spark.read.text(folder).select(stem().alias("clip"), "value")
    hint = F.lit(False)
    for w in wanted:
        hint = hint | F.col("value").contains(w)
    d = text.where(hint).select("clip", F.from_json("value", schema).alias("j")).select("clip", "j.*")
    lab = F.get(F.filter("tags", lambda t: t.isin(*wanted)), F.lit(0))
    d = d.withColumn("label", lab).withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))
    return d.where(F.col("label").isNotNull() & F.col("bbox").isNotNull() & (F.col("confidence") >= min_conf))


def read_yolo_labels(spark: SparkSession, folder: str, classes: Sequence[str]) -> DataFrame:
    """Text labels ``cls cx cy w h``, one file per image; the position of a line is its detection id."""
    d = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True)
    s, f = ids.image_stem_and_frame(source_file())
    d = d.select(s.alias("clip"), f.alias("frame_index"), F.posexplode(F.split(F.rtrim("value"), "\n")).alias("detection_id", "line"))
    p = F.split(F.trim("line"), r"\s+")
    v = [F.get(p, F.lit(i)).try_cast("double") for i in range(1, 5)]
    top = boxes.from_centre_box(*v)
    cls = F.get(F.array(*[F.lit(c) for c in classes]), F.get(p, F.lit(0)).try_cast("int"))
    d = d.select("clip", "frame_index", "detection_id", cls.alias("label"), *[t.alias(f"bbox_{c}") for t, c in zip(top, "xywh", strict=True)])
    return d.where("label IS NOT NULL AND bbox_x IS NOT NULL AND frame_index IS NOT NULL")


def read_frame_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of frames with nested detections; the position in the array is the detection id."""
    det = f"struct<label:string,confidence:double,bbox:{BOX}>"
    d = spark.read.schema(f"uri string, detections array<{det}>").option("multiLine", True).json(path)
    s, f = ids.image_stem_and_frame("uri")
    return d.select(s.alias("clip"), f.alias("frame_index"), F.posexplode("detections").alias("detection_id", "d")).select("clip", "frame_index", "detection_id", "d.*")


def read_broadcast_reviews(spark: SparkSession, folders: Sequence[str], verdicts: Sequence[str] = ("yes", "no", "unsure")) -> DataFrame:
    """Review files ``{frames: {"<n>": {...}}}``; bad keys and verdicts are dropped, the first folder wins per file stem."""
    out = None
    entry = "struct<verdict:string,pred:string,p_yes:double,reason:string,ts_s:double,ts:string>"
    for rank, folder in enumerate(folders):
        d = spark.read.schema(f"frames map<string,{entry}>").option("multiLine", True).json(folder)
        d = d.select(stem().alias("video_stem"), F.lit(rank).alias("rank"), F.explode("frames").alias("k", "v"))
        out = d if out is None else out.unionByName(d)
    best = out.groupBy("video_stem").agg(F.min("rank").alias("rank"))
    d = out.join(best, ["video_stem", "rank"], "left_semi").where(F.col("k").rlike("^[0-9]+$") & F.col("v.verdict").isin(*verdicts))
    return d.select("video_stem", F.col("k").cast("int").alias("frame_index"), "v.*")


def read_calibrations(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calibration documents: ``(calibrations, keypoints, skipped frames)``. A frame without nine H values is skipped."""
    corr = "struct<image:array<double>,pitch_id:string,pitch_xy:array<double>>"
    entry = f"struct<frame_index:int,H:array<double>,H_convention:string,image_size:array<int>,correspondences:array<{corr}>>"
    d = spark.read.schema(f"clip string, frames map<string,{entry}>").option("multiLine", True).json(folder)
    d = d.select(F.coalesce("clip", stem()).alias("game_id"), F.explode("frames").alias("k", "v"))
    ok = F.col("k").rlike("^[0-9]+$") & (F.coalesce(F.size("v.H"), F.lit(-1)) == 9) & ~F.exists("v.H", lambda x: x.isNull())
    good, bad = d.where(F.coalesce(ok, F.lit(False))), d.where(~F.coalesce(ok, F.lit(False)))
    cal = good.select("game_id", F.col("k").cast("int").alias("frame_index"), F.col("v.H").alias("H"), F.col("v.H_convention").alias("h_convention"),
                      F.get("v.image_size", F.lit(0)).alias("image_width"), F.get("v.image_size", F.lit(1)).alias("image_height"))
    kp = good.select("game_id", F.col("k").cast("int").alias("frame_index"), F.posexplode("v.correspondences").alias("point_idx", "c"))
    kp = kp.select("game_id", "frame_index", "point_idx", F.col("c.pitch_id").alias("keypoint_id"), F.get("c.image", F.lit(0)).alias("u"), F.get("c.image", F.lit(1)).alias("v"),
                   F.get("c.pitch_xy", F.lit(0)).alias("pitch_x"), F.get("c.pitch_xy", F.lit(1)).alias("pitch_y"))
    return cal, kp, bad.groupBy("game_id").agg(F.count("*").alias("n_skipped"))


def read_verdict_log(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict lines; broken lines and lines without a key are dropped, the source defaults to ``sidecar``.

    The line order is kept by the offset of the line in its file.
    """
    schema = f"clip string, frame_index int, box_index int, source string, verdict string, bbox {BOX}, label string, corrected_bbox {BOX}, ts string, confidence double"
    d = spark.read.text(folder).select(stem().alias("file_clip"), F.monotonically_increasing_id().alias("line_no"), "value")
    d = d.withColumn("j", F.from_json("value", schema)).where("j.frame_index IS NOT NULL AND j.box_index IS NOT NULL")
    return d.select(F.col("file_clip").alias("game_id"), F.coalesce("j.source", F.lit("sidecar")).alias("vsource"), "j.frame_index", "j.box_index", "j.verdict",
                    "j.bbox", "j.label", "j.corrected_bbox", "j.ts", "j.confidence", "line_no")


def read_detection_cache(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Caches of a header line and ``{f, c: [[x, y, w, h, conf]]}`` lines: ``(headers, candidates)``.

    A frame without candidates stays as one row with null boxes.
    """
    t = spark.read.text(folder).select(stem().alias("clip"), "value")
    f = F.get_json_object("value", "$.f")
    head = t.where(f.isNull()).select("clip", F.from_json("value", "frame_size array<int>, stride int, model string").alias("h")).select("clip", "h.*")
    rows = t.where(f.isNotNull()).select("clip", F.from_json("value", "f int, c array<array<double>>").alias("j"))
    rows = rows.select("clip", F.col("j.f").alias("frame_index"), F.posexplode_outer("j.c").alias("cand", "b"))
    return head, rows.select("clip", "frame_index", "cand", *[F.get("b", F.lit(i)).alias(n) for i, n in enumerate(("bbox_x", "bbox_y", "bbox_w", "bbox_h", "confidence"))])


POOL_SCHEMA = (
    "match string, clip string, frame int, fps float, x double, y double, w double, h double, track_id int, sources array<string>, "
    "source_scores array<float>, n_sources int, solver_post float, sam2_agree boolean, plausible boolean, static_flag boolean, "
    "gap_frame boolean, embedding array<float>, p_real float, scorer_version string, detector_sha string"
)


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POOL_SCHEMA).option("recursiveFileLookup", True).parquet(path)


def pool_constraints() -> dict[str, Column]:
    """Good-row conditions of the pool schema."""
    unit = lambda c: F.col(c).between(0, 1)
    return {
        "match_present": F.col("match").isNotNull(), "clip_present": F.col("clip").isNotNull(), "frame_valid": F.col("frame") >= 0,
        "x_in_unit": unit("x"), "y_in_unit": unit("y"), "fps_positive": F.col("fps") > 0,
        "sources_match_scores": F.size("sources") == F.size("source_scores"), "n_sources_matches": F.size("sources") == F.col("n_sources"),
        "scores_in_unit": F.forall("source_scores", lambda s: (s >= 0) & (s <= 1)), "p_real_in_unit": F.col("p_real").isNull() | unit("p_real"),
    }


def pool_from_labels(rows: DataFrame, match: Column, fps: float, sha: str | None = None) -> DataFrame:
    """Detector labels in pool form: explicit centre or box centre, clamped, one source per node."""
    x = F.coalesce(F.col("center.x"), F.col("bbox.x") + F.col("bbox.w") / 2)
    y = F.coalesce(F.col("center.y"), F.col("bbox.y") + F.col("bbox.h") / 2)
    conf = boxes.clip("confidence", 0.0, 1.0)
    return rows.select(
        match.alias("match"), "clip", F.col("frame_index").alias("frame"), F.lit(fps).cast("float").alias("fps"), boxes.clip(x, 0.0, 1.0).alias("x"),
        boxes.clip(y, 0.0, 1.0).alias("y"), F.col("bbox.w").alias("w"), F.col("bbox.h").alias("h"), F.array(F.lit("detector")).alias("sources"),
        F.array(conf.cast("float")).alias("source_scores"), F.lit(1).alias("n_sources"), conf.cast("float").alias("p_real"),
        F.coalesce("detector_sha", F.lit(sha)).alias("detector_sha"))


def read_clip_spans(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.schema("segments array<struct<name:string,start_s:double,end_s:double>>").option("multiLine", True).json(path)
    return d.select(F.explode("segments").alias("s")).select(ids.canonical_clip_id("s.name").alias("clip"), F.col("s.start_s").alias("lo"), F.col("s.end_s").alias("hi"))


def discover_sources(registry: DataFrame) -> DataFrame:
    """Folders to ingest: entries not excluded, the fallback where no path is given."""
    return registry.where(F.coalesce("ingest", F.lit(True))).select("name", F.coalesce("path", "fallback").alias("path")).where("path IS NOT NULL")


def detection_rows(frames: DataFrame) -> DataFrame:
    """Typed detection rows from frames with aligned ``detections`` and ``track_ids`` lists; a length mismatch is an error."""
    ok = F.col("track_ids").isNull() | (F.size("detections") == F.size("track_ids"))
    checked = F.when(ok, F.col("detections")).otherwise(F.raise_error(F.lit("track ids do not match the detections")).cast(frames.schema["detections"].dataType))
    d = frames.select("game_id", "frame_index", "track_ids", F.posexplode(checked).alias("detection_id", "d"))
    return d.select("game_id", "frame_index", "detection_id", "d.*", F.get("track_ids", F.col("detection_id")).alias("track_id"))

