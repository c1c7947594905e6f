"""Writers: partitioned Parquet, versioned snapshots, CSV, nested JSON, training labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchgrid.functions import boxes

#: Partition columns per table; tables that are not listed are small and written as one file.
LAYOUT = {
    "frame": ["game_id"], "detection": ["game_id", "source"], "track_meta": ["game_id", "source"], "calibration": ["game_id", "source"],
    "frame_label_state": ["game_id"], "pitch_keypoint": ["game_id"],
}


def export_table(df: DataFrame, root: str, name: str) -> str:
    """Write one table in its layout. Rows are placed by partition first, with a salt, so that a partition becomes a
    few files and one hot game is written by several tasks. Existing partitions that are not touched stay."""
    path = f"{root}/{name}"
    part = LAYOUT.get(name)
    if part:
        salt = F.pmod(F.hash(*df.columns), F.lit(8)) if "frame_index" not in df.columns else F.floor(F.col("frame_index") / 4096) % 8
        w = df.repartition(*part, salt).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*part)
        w.parquet(path)
    else:
        df.coalesce(1).write.mode("overwrite").parquet(path)
    return path


def import_table(spark: SparkSession, root: str, name: str, schema) -> DataFrame:
    """Read a table back with an explicit schema and column order; partition filters prune folders."""
    cols = schema.fieldNames() if hasattr(schema, "fieldNames") else [c.strip().split()[0] for c in schema.split(",")]
    return spark.read.schema(schema).parquet(f"{root}/{name}").select(*cols)


def write_snapshot(items: DataFrame, manifest: DataFrame, root: str, dataset: str, version: int) -> str:
    """Immutable version: writing an existing one is an error."""
    path = f"{root}/{dataset}/v={version}"
    items.write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/items")
    manifest.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")
    return path


class TamperedSnapshot(RuntimeError):
    """The stored items no longer give the content hash of the manifest."""


def load_snapshot(spark: SparkSession, root: str, dataset: str, version: int, verify: bool = True) -> DataFrame:
    from matchgrid.operators.snapshots import content_hash

    path = f"{root}/{dataset}/v={version}"
    items = spark.read.parquet(f"{path}/items")
    if verify:
        want = spark.read.json(f"{path}/manifest").first()["content_hash"]
        if content_hash(items).first()["content_hash"] != want:
            raise TamperedSnapshot(f"{dataset} v{version}")
    return items


def match_json(frames: DataFrame, detections: DataFrame, tracks: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """One JSON document per frame with its detections and tracks, in detection order. The document of a match is the
    ordered list of these rows, so it is never built in one task."""
    k = ["game_id", "frame_index"]

    def nest(df: DataFrame, name: str) -> DataFrame:
        s = F.struct(*[c for c in df.columns if c not in k])
        return df.groupBy(*k).agg(F.array_sort(F.collect_list(s)).alias(name))

    d = frames.join(nest(detections, "detections"), k, "left").join(nest(tracks, "tracks"), k, "left")
    cols = ["detections", "tracks"]
    if positions is not None:
        d, cols = d.join(nest(positions, "pitch_positions"), k, "left"), [*cols, "pitch_positions"]
    body = F.to_json(F.struct("frame_index", *[F.coalesce(c, F.array()).alias(c) for c in cols]))
    return d.select(*k, body.alias("json"))


def write_csvs(tables: dict[str, DataFrame], root: str) -> list[str]:
    """CSV fan-out; a table without rows of interest is simply not passed in."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{root}/{name}")
    return sorted(tables)


def write_tracks(tracks: DataFrame, meta: DataFrame, root: str) -> None:
    tracks.write.mode("overwrite").partitionBy("game_id").parquet(f"{root}/tracks")
    meta.write.mode("overwrite").json(f"{root}/tracks_meta")


def training_labels(rows: DataFrame, classes: Sequence[str], keys: Sequence[str] = ("split", "game_id", "frame_index")) -> DataFrame:
    """Label text per frame: ``class cx cy w h`` lines with clamped centre boxes, in a fixed order."""
    cls = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1
    b = boxes.to_centre_box("bbox_x", "bbox_y", "bbox_w", "bbox_h")
    line = F.format_string("%d %.6f %.6f %.6f %.6f", cls.cast("int"), *b)
    d = rows.where(F.col("label").isin(*classes)).withColumn("__l", line)
    return d.groupBy(*keys).agg(F.concat_ws("\n", F.array_sort(F.collect_list("__l"))).alias("text"), F.count("*").alias("n_boxes"))


def write_training_labels(text: DataFrame, root: str) -> None:
    text.repartition("split", "game_id").write.mode("overwrite").partitionBy("split").parquet(f"{root}/labels")


def append_results(results: DataFrame, path: str, splits: Sequence[str] = ("train", "eval_heldout_match", "eval_in_match", "eval_all")) -> None:
    """Append evaluation rows; a split outside the list is an error. The check runs inside the write."""
    ok = F.when(F.col("split").isin(*splits), F.col("split")).otherwise(F.raise_error(F.concat(F.lit("unknown split "), F.col("split"))))
    results.withColumn("split", ok).write.mode("append").parquet(path)


def match_table(segments: DataFrame, results: DataFrame) -> DataFrame:
    """Frames of the best result of each segment on the match clock: global frame = segment start + local frame."""
    from matchgrid.operators.metrics import best_segment_result

    n = results.groupBy("match", "segment", "run_at").agg(F.count_if("accepted").alias("n_ok"))
    best = best_segment_result(n, ["match", "segment"], "n_ok", "run_at").select("match", "segment", "run_at")
    d = results.join(best, ["match", "segment", "run_at"], "left_semi").join(segments, ["match", "segment"])
    return d.withColumn("global_frame", F.col("start") + F.col("local_frame"))


def write_auto_accept(rows: DataFrame, matches: DataFrame, path: str) -> None:
    """Accepted rows per match in a fixed order; a match that has none any more is overwritten with an empty file."""
    empty = matches.select("match").distinct().join(rows.select("match").distinct(), "match", "left_anti")
    marker = empty.select("match", *[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes if c != "match"])
    d = rows.unionByName(marker).repartition("match").sortWithinPartitions("match", "clip", "frame")
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("match").json(path)
