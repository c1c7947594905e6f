"""Structured Streaming forms of the label log, the card windows and the trackers."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from matchgrid.operators.logs import latest_per_key
from matchgrid.operators.trackers import BALL_COLS, LOW, START, BallTrack, IouTracks, ball_columns
from matchgrid.session import ensure_checkpoint_dir


def file_stream(spark: SparkSession, folder: str, pattern: str, schema, per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (r.option("maxFilesPerTrigger", per_trigger) if per_trigger else r).parquet(folder)


def run_to_table(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run a stream over everything available into a Parquet table in the shared folder and read it back.

    ``complete`` results replace the table per trigger; ``append`` results are written once per batch id, so a
    repeated batch after a failure overwrites itself.
    """
    spark = stream.sparkSession
    base = folder or f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{base}/table"

    def sink(df: DataFrame, batch: int) -> None:
        if mode == "complete":
            df.write.mode("overwrite").parquet(f"{out}/batch=0")
        else:
            df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).option("basePath", out).parquet(out).select(*stream.columns)


def latest_verdicts(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Live verdict per key from an append stream. A late record with an older time never wins; a null verdict
    takes the key back. State is one row per key."""
    rest = [c for c in log.columns if c not in keys]
    g = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return g.select(*keys, "r.*").where("verdict IS NOT NULL")


def tumbling_counts(events: DataFrame, keys: Sequence[str], ts: str, width: str, delay: str) -> DataFrame:
    g = events.withWatermark(ts, delay).groupBy(*keys, F.window(ts, width).alias("w"))
    return g.agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, keys: Sequence[str], ts: str, gap: str, delay: str) -> DataFrame:
    g = events.withWatermark(ts, delay).groupBy(*keys, F.session_window(ts, gap).alias("w"))
    return g.agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def one_per_window(cards: DataFrame, keys: Sequence[str], ts: str, width: str, delay: str) -> DataFrame:
    """At most one card per key and window; the state of closed windows is dropped with the watermark."""
    d = cards.withColumn("win", F.window(ts, width)["start"]).withWatermark("win", delay)
    return d.dropDuplicates([*keys, "win"])


def upsert_stream(stream: DataFrame, keys: Sequence[str], order: Sequence[str], folder: str | None = None, live: str | None = None) -> DataFrame:
    """Run a stream over everything available as an upsert: the row with the largest ``order`` stays for each key.

    A batch is reduced to one row per key and replaces what was written under its batch id, so a batch that is repeated
    after a failure changes nothing, and late rows never win. Where ``live`` is named, a row with a null in it takes the
    key back. A later run with the same folder goes on where the last one ended.
    """
    spark = stream.sparkSession
    base = folder or f"{ensure_checkpoint_dir(spark)}/upsert-{uuid.uuid4().hex}"

    def sink(df: DataFrame, batch: int) -> None:
        latest_per_key(df, keys, order).write.mode("overwrite").parquet(f"{base}/rows/batch={batch}")

    q = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    log = spark.read.schema(stream.schema).option("basePath", f"{base}/rows").parquet(f"{base}/rows").select(*stream.columns)
    d = latest_per_key(log, keys, order).select(*stream.columns)
    return d.where(F.col(live).isNotNull()) if live else d


def _stateful(df: DataFrame, key: str, fn, schema: str) -> DataFrame:
    return df.groupBy(key).applyInPandasWithState(fn, schema, "state string", "append", GroupStateTimeout.NoTimeout)


def gap_sentinels(records: DataFrame, key: str, max_step_s: float) -> DataFrame:
    """Frame records with a gap row where the clock jumps by more than ``max_step_s`` (columns ``t`` seconds, ``seq``)."""

    def fn(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        last = json.loads(state.get[0]) if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["t", "seq"])  # the rows of one key in one micro-batch
        out = []
        for t, seq in zip(rows["t"], rows["seq"], strict=True):
            if last is not None and t - last > max_step_s:
                out.append((k[0], "gap", float(last), float(t), -1))
            out.append((k[0], "frame", float(t), float(t), int(seq)))
            last = float(t) if last is None else max(last, float(t))
        state.update((json.dumps(last),))
        yield pd.DataFrame(out, columns=["key", "kind", "t0", "t1", "seq"])

    return _stateful(records, key, fn, "key string, kind string, t0 double, t1 double, seq long")


def iou_tracks(detections: DataFrame, max_age: int = 30, min_iou: float = 0.3) -> DataFrame:
    """Streaming form of the multi-object tracker: open tracks are the state of a game. Files must arrive in frame order
    and hold whole frames."""

    def fn(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        tracks, nxt = json.loads(state.get[0]) if state.exists else ([], 1)
        core = IouTracks(max_age, min_iou, [[i, tuple(b), a] for i, b, a in tracks], nxt)
        rows = pd.concat(list(batches)).sort_values(["frame_index", "detection_id"])
        out = []
        for f, g in rows.groupby("frame_index", sort=True):
            found = core.frame(list(g[["bbox_x", "bbox_y", "bbox_w", "bbox_h"]].itertuples(index=False, name=None)))
            out += [(k[0], int(f), int(d), int(i)) for d, i in zip(g["detection_id"], found, strict=True)]
        state.update((json.dumps([core.tracks, core.next_id]),))
        yield pd.DataFrame(out, columns=["game_id", "frame_index", "detection_id", "track_id"])

    return _stateful(detections, "game_id", fn, "game_id string, frame_index int, detection_id long, track_id long")


def ball_tracks(cands: DataFrame, key: str = "clip", **params) -> DataFrame:
    """Streaming form of the single-ball tracker: emits the accepted candidate of each frame. Gaps are closed downstream."""

    def fn(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        core = BallTrack(**params, now=json.loads(state.get[0]) if state.exists else None)
        rows = pd.concat(list(batches)).sort_values(["frame_index", "detection_id"])
        out = []
        for f, g in rows.groupby("frame_index", sort=True):
            out += [(k[0], *r) for r in core.frame(int(f), list(g[BALL_COLS].itertuples(index=False, name=None)))]
        state.update((json.dumps(core.now),))
        yield pd.DataFrame(out, columns=["clip", "frame_index", "track_id", "x", "y", "w", "h", "confidence"])

    d = ball_columns(cands, params.get("start", START), params.pop("low", LOW)).select(key, "frame_index", *BALL_COLS)
    return _stateful(d, key, fn, "clip string, frame_index int, track_id long, x double, y double, w double, h double, confidence double")


def _united(spans: list[list[int]], reach: int) -> list[list[int]]:
    """Spans in order, those with at most ``reach`` frames between them made one."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo - out[-1][1] - 1 <= reach:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def mask_segments(frames: DataFrame, key: str, merge_gap: int, min_len: int) -> DataFrame:
    """Changes of the broadcast segments of an on/off stream (columns ``frame, is_on``), for :func:`upsert_stream` with the keys
    ``key, start``, order ``version`` and live column ``end``.

    On-frames with at most ``merge_gap`` frames between them make a segment; those shorter than ``min_len`` are not shown.
    The open segment is shown with its end so far. A late frame may lengthen or unite segments: a start that is gone
    comes as a row with a null end. The state is the segments of a clip, not its frames; a null ``is_on`` is off.
    """

    def fn(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        version, old = json.loads(state.get[0]) if state.exists else (0, [])
        spans = old
        for rows in batches:
            spans = _united([*spans, *([f, f] for f in rows["frame"].tolist())], merge_gap)
        shown, now = ({lo: hi for lo, hi in part if hi - lo + 1 >= min_len} for part in (old, spans))
        out = [(k[0], lo, hi, version) for lo, hi in now.items() if shown.get(lo) != hi]
        out += [(k[0], lo, None, version) for lo in shown if lo not in now]
        state.update((json.dumps([version + 1, spans]),))
        yield pd.DataFrame(out, columns=["key", "start", "end", "version"]).astype({"end": "Int32"})

    kind = frames.schema[key].dataType.simpleString()
    schema = f"key {kind}, start int, end int, version long"
    on = frames.where("is_on AND frame IS NOT NULL").select(key, "frame")
    return _stateful(on, key, fn, schema).withColumnRenamed("key", key)


def segments_of(frames: DataFrame, key: str, merge_gap: int, min_len: int, folder: str | None = None) -> DataFrame:
    """Segments of everything an on/off stream holds now, the open ones with their end so far."""
    changes = mask_segments(frames, key, merge_gap, min_len)
    return upsert_stream(changes, [key, "start"], ["version"], folder, live="end").drop("version")
