"""Trackers over stored detections.

A tracker is an ordered pass per game or clip with a small running state (open tracks), fed by Spark in frame
order; see :mod:`matchgrid.operators.scan`. Everything that does not depend on the sequential rule (gap
interpolation, summaries, merging of passes) stays a DataFrame operation. Where no track can survive a hole in the
detections, a clip is cut there and its parts run as separate tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchgrid.operators import ordered, review
from matchgrid.operators.scan import frame_scan
from matchgrid.session import cut_lineage

# --- assignment ----------------------------------------------------------------------------------------------------


def _assign_min(cost: list[list[float]]) -> list[int]:
    """Column of each row in a cheapest perfect assignment of a square matrix (shortest augmenting paths)."""
    n = len(cost)
    inf = math.inf
    u, v, owner = [0.0] * n, [0.0] * n, [-1] * n
    for r in range(n):
        dist, prev, done = [inf] * n, [-1] * n, [False] * n
        col, row, low = -1, r, 0.0
        while True:
            best, at = inf, -1
            for j in range(n):
                if done[j]:
                    continue
                d = low + cost[row][j] - u[row] - v[j]
                if d < dist[j]:
                    dist[j], prev[j] = d, col
                if dist[j] < best:
                    best, at = dist[j], j
            col, low = at, best
            done[col] = True
            if owner[col] < 0:
                break
            row = owner[col]
        u[r] += low
        for j in range(n):
            if done[j] and j != col:
                u[owner[j]] += low - dist[j]
                v[j] -= low - dist[j]
        while col >= 0:
            back = prev[col]
            owner[col] = owner[back] if back >= 0 else r
            col = back
    out = [-1] * n
    for j, r in enumerate(owner):
        out[r] = j
    return out


def best_matching(gain: dict[tuple[int, int], float]) -> dict[int, int]:
    """Matching with the largest total gain; only pairs with a positive gain count. Solved per connected component."""
    rows: dict[int, list[int]] = {}
    cols: dict[int, list[int]] = {}
    for i, j in gain:
        rows.setdefault(i, []).append(j)
        cols.setdefault(j, []).append(i)
    seen: set[int] = set()
    out: dict[int, int] = {}
    for start in rows:
        if start in seen:
            continue
        ri, cj, todo = [], [], [start]
        seen.add(start)
        known = set()
        while todo:
            i = todo.pop()
            ri.append(i)
            for j in rows[i]:
                if j not in known:
                    known.add(j)
                    cj.append(j)
                    for k in cols[j]:
                        if k not in seen:
                            seen.add(k)
                            todo.append(k)
        if len(ri) == 1:
            i = ri[0]
            out[i] = max(sorted(rows[i]), key=lambda j: gain[i, j])
            continue
        if len(cj) == 1:
            j = cj[0]
            out[max(sorted(cols[j]), key=lambda i: gain[i, j])] = j
            continue
        ri.sort()
        cj.sort()
        n = max(len(ri), len(cj))
        cost = [[-gain.get((ri[a], cj[b]), 0.0) if a < len(ri) and b < len(cj) else 0.0 for b in range(n)] for a in range(n)]
        for a, b in enumerate(_assign_min(cost)):
            if a < len(ri) and b < len(cj) and (ri[a], cj[b]) in gain:
                out[ri[a]] = cj[b]
    return out


def _iou(a: tuple, b: tuple) -> float:
    iw = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    if iw <= 0:
        return 0.0
    ih = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    if ih <= 0:
        return 0.0
    inter = iw * ih
    return inter / (a[2] * a[3] + b[2] * b[3] - inter)


# --- multi-object tracker ------------------------------------------------------------------------------------------


class IouTracks:
    """Open tracks of one game. ``frame(dets)`` takes the boxes of one frame and returns their track ids.

    A track ages by one on each frame with detections that leaves it unmatched, and ends when it is older than
    ``max_age``. Ids start at 1.
    """

    def __init__(self, max_age: int = 30, min_iou: float = 0.3, tracks=(), next_id: int = 1):
        self.max_age, self.min_iou = max_age, min_iou
        self.tracks: list[list] = [list(t) for t in tracks]  # [id, box, age]
        self.next_id = next_id

    def frame(self, dets: list[tuple]) -> list[int]:
        gain = {}
        for i, t in enumerate(self.tracks):
            for j, b in enumerate(dets):
                g = _iou(t[1], b) - self.min_iou
                if g > 0:
                    gain[i, j] = g
        got = best_matching(gain) if gain else {}
        found: list[int | None] = [None] * len(dets)
        for i, t in enumerate(self.tracks):
            j = got.get(i)
            if j is None:
                t[2] += 1
            else:
                t[1], t[2] = dets[j], 0
                found[j] = t[0]
        for j, b in enumerate(dets):
            if found[j] is None:
                found[j] = self.next_id
                self.tracks.append([self.next_id, b, 0])
                self.next_id += 1
        self.tracks = [t for t in self.tracks if t[2] <= self.max_age]
        return found


class _TrackFrames:
    """Rows ``(detection_id, box...)`` of a frame to rows with their track."""

    def __init__(self, max_age: int, min_iou: float):
        self.core = IouTracks(max_age, min_iou)

    def frame(self, f, rows):
        found = self.core.frame([r[1:] for r in rows])
        return [(f, r[0], i) for r, i in zip(rows, found, strict=True)]


def iou_tracks(detection: DataFrame, max_age: int = 30, min_iou: float = 0.3, key: str = "game_id") -> DataFrame:
    """Track id of every detection, by best total overlap from frame to frame."""
    schema = f"{key} string, frame_index int, detection_id long, track_id long"
    cols = ["detection_id", "bbox_x", "bbox_y", "bbox_w", "bbox_h"]
    return frame_scan(detection, [key], "frame_index", cols, lambda: _TrackFrames(max_age, min_iou), schema)


# --- single-ball tracker -------------------------------------------------------------------------------------------


# Fixed values of the single-ball tracker.
START, JUMP, LOW, REACH, GROWTH, MAX_MISSED = 0.6, 0.8, 0.1, 40.0, 25.0, 12
#: Reach and distances are in pixels of this picture.
PICTURE = (1920.0, 1080.0)
BALL_COLS = ["detection_id", "cx", "cy", "confidence", "trust", "bbox_x", "bbox_y", "bbox_w", "bbox_h"]


def ball_columns(cands: DataFrame, start: float = START, low: float = LOW) -> DataFrame:
    """Candidates worth a look with what the tracker needs of each: its centre in pixels and ``trust``, the part of the
    reach within which it is believed."""
    d = cands.where(F.col("confidence") >= low)
    for c, v, side, scale in (("cx", "x", "w", PICTURE[0]), ("cy", "y", "h", PICTURE[1])):
        d = d.withColumn(c, (F.col(f"bbox_{v}") + F.col(f"bbox_{side}") / 2) * scale)
    return d.withColumn("trust", F.least(F.lit(1.0), F.col("confidence") / start))


class BallTrack:
    """The live ball track in frame order. ``frame(f, rows)`` takes rows of :data:`BALL_COLS`.

    The running state is the seven numbers in ``now``: track id (0: none is live), frame, place and speed in pixels, and
    the number of tracks so far.
    """

    def __init__(self, start=START, jump=JUMP, reach=REACH, growth=GROWTH, max_missed=MAX_MISSED, now=None):
        self.start, self.jump, self.reach, self.growth, self.max_missed = start, jump, reach, growth, max_missed
        self.now = list(now) if now else [0, 0, 0.0, 0.0, 0.0, 0.0, 0]

    def frame(self, f, rows):
        tid, last, x, y, vx, vy, n = self.now
        gap = f - last
        if gap > self.max_missed + 1:
            tid = 0
        floor, weights = self.start, None
        if tid:
            # A weight falls from the confidence at the predicted place to 0 at the end of the reach; below it: not believed.
            floor, limit = self.jump, self.reach + self.growth * gap
            away = [math.hypot(r[1] - x - vx * gap, r[2] - y - vy * gap) / limit for r in rows]
            weights = [r[3] * (1 - a) if a <= r[4] else -1.0 for a, r in zip(away, rows, strict=True)]
        if weights and max(weights) >= 0:
            r = rows[weights.index(max(weights))]
            sx, sy = (r[1] - x) / gap, (r[2] - y) / gap
            still = vx == 0 and vy == 0
            self.now = [tid, f, r[1], r[2], sx if still else (vx + sx) / 2, sy if still else (vy + sy) / 2, n]
        else:
            r = max(rows, key=lambda r: r[3])
            if r[3] < floor:
                self.now[0] = tid
                return []
            self.now = [n + 1, f, r[1], r[2], 0.0, 0.0, n + 1]
        return [(f, self.now[0], *map(float, (*r[5:9], r[3])))]


def ball_points(cands: DataFrame, frames: DataFrame, clip: str = "clip", span: int = ordered.SPAN, **params) -> DataFrame:
    """One point per processed frame: ``origin`` is ``detected``, ``interpolated`` or ``none``.

    The pass only emits accepted candidates. A clip is cut where two candidate frames are further apart than a track
    can live, so the parts are independent; track ids are numbered through by the sum over earlier parts.
    Gaps between two accepted points of one track are interpolated afterwards, as a DataFrame operation.
    """
    missed = params.get("max_missed", MAX_MISSED)
    c = ball_columns(cands, params.get("start", START), params.pop("low", LOW)).select(clip, "frame_index", *BALL_COLS)
    fr = c.select(clip, "frame_index").distinct()
    part = ordered.with_islands(fr, [clip], ["frame_index"], lambda r, p: r["frame_index"] - p["frame_index"] - 1 > missed, ["frame_index"], "part", span=span)
    schema = f"{clip} string, part long, frame_index int, local_id long, x double, y double, w double, h double, confidence double"
    pts = frame_scan(c.join(part, [clip, "frame_index"]), [clip, "part"], "frame_index", BALL_COLS, lambda: BallTrack(**params), schema)
    # The pass is read several times below: store its few points once.
    pts = cut_lineage(pts)
    n = pts.groupBy(clip, "part").agg(F.max("local_id").alias("n"))
    n = ordered.along(n, [clip], ["part"], [ordered.Running("before", F.col("n"), inclusive=False)], span=span).select(clip, "part", "before")
    pts = pts.join(n, [clip, "part"]).withColumn("track_id", F.col("local_id") + F.col("before")).drop("part", "local_id", "before")
    d = frames.select(clip, "frame_index").distinct().join(pts, [clip, "frame_index"], "left")
    box = F.when(F.col("track_id").isNotNull(), F.struct("frame_index", "track_id", "x", "y", "w", "h"))
    d = ordered.along(d, [clip], ["frame_index"], [ordered.Known("p", box), ordered.Known("q", box, False)], span=span)
    det = F.col("track_id").isNotNull()
    mid = ~det & (F.col("p.track_id") == F.col("q.track_id"))
    r = (F.col("frame_index") - F.col("p.frame_index")) / (F.col("q.frame_index") - F.col("p.frame_index"))
    out = d.withColumn("origin", F.when(det, "detected").when(mid, "interpolated").otherwise("none"))
    for v in "xywh":
        out = out.withColumn(v, F.when(det, F.col(v)).when(mid, F.col(f"p.{v}") + (F.col(f"q.{v}") - F.col(f"p.{v}")) * r))
    return out.withColumn("track_id", F.coalesce("track_id", F.when(mid, F.col("p.track_id")))).drop("p", "q")


def bidirectional_ball(cands: DataFrame, frames: DataFrame, clip: str = "clip", span: int = ordered.SPAN, **params) -> DataFrame:
    """Forward and backward pass, merged. The backward pass runs on negated frame numbers."""
    p = {"max_missed": 6, "growth": 15.0, **params}

    def centred(d: DataFrame) -> DataFrame:
        return d.withColumn("x", F.col("x") + F.col("w") / 2).withColumn("y", F.col("y") + F.col("h") / 2).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))

    fwd = ball_points(cands, frames, clip, span, **p)
    neg = lambda d: d.withColumn("frame_index", -F.col("frame_index"))
    bwd = neg(ball_points(neg(cands), neg(frames.select(clip, "frame_index")), clip, span, **p))
    return review.merge_passes(centred(fwd), centred(bwd), [clip], "frame_index", span=span)


# --- best path over a whole part -----------------------------------------------------------------------------------


# Fixed values of the best path: reach and its growth per frame in pixels, cost of a move by its squared share of the reach
# and at most, cost of a skipped frame, of a track's start and of its end.
PATH_REACH, PATH_GROWTH, MOVE, MOST, SKIP, ENTER, LEAVE = 30.0, 40.0, 3.0, 8.0, 0.3, 4.0, 0.5


class _PathFrames:
    """Best scores of all ways that end in a candidate, one layer of arrays per frame; rows ``(id, x, y, emission)``.

    A way may end and another may start later, so a fresh start stands on the best ended way so far. Of equal ways
    the fresh start comes first, then the nearest layer, then the smaller id.
    """

    def __init__(self, max_gap: int):
        self.max_gap, self.layers = max_gap, []
        self.found, self.parent, self.linked = [], [], []
        self.ended, self.ended_at = 0.0, -1

    def frame(self, f, rows):
        x, y, emission = (np.array([r[i] for r in rows], dtype=float) for i in (1, 2, 3))
        self.layers = [layer for layer in self.layers if f - layer[0] <= self.max_gap]
        gains, owners = [np.full((len(rows), 1), self.ended - ENTER)], [[self.ended_at]]
        for at, lx, ly, score, node in self.layers:
            gap = f - at
            share = (np.square(x[:, None] - lx) + np.square(y[:, None] - ly)) / (PATH_REACH + PATH_GROWTH * gap) ** 2
            gains.append(score - np.minimum(MOST, MOVE * share) - SKIP * (gap - 1))
            owners.append(node)
        gain, owner = np.hstack(gains), np.concatenate(owners).astype(int)
        pick = gain.argmax(axis=1)
        score = gain[np.arange(len(rows)), pick] + emission
        node = np.arange(len(self.found), len(self.found) + len(rows))
        self.found += [(f, r[0]) for r in rows]
        self.parent += owner[pick].tolist()
        self.linked += (pick > 0).tolist()
        self.layers.insert(0, (f, x, y, score, node))
        top = int(score.argmax())
        if score[top] - LEAVE > self.ended:
            self.ended, self.ended_at = float(score[top]) - LEAVE, int(node[top])
        return ()

    def end(self):
        way, at = [], self.ended_at
        while at >= 0:
            way.append(at)
            at = self.parent[at]
        number = np.cumsum([not self.linked[i] for i in reversed(way)])
        return [(*self.found[i], int(n)) for i, n in zip(reversed(way), number, strict=True)]


def best_path(cands: DataFrame, clip: str = "clip", low: float = 0.1, top: int = 8, max_gap: int = 12, bias: float = 1.0, span: int = ordered.SPAN) -> DataFrame:
    """Candidates on the best path of each clip. Parts further apart than ``max_gap`` cannot be linked, and the best
    set of tracks of a clip is the union over its parts."""
    from matchgrid.functions.stats import confidence_logodds
    from matchgrid.operators.windows import top_k

    c = cands.where(F.col("confidence") >= low)
    c = top_k(c, [clip, "frame_index"], [F.desc("confidence"), F.col("detection_id")], top)
    c = c.select(clip, "frame_index", "detection_id", *[((F.col(f"bbox_{v}") + F.col(f"bbox_{side}") / 2) * scale).alias(f"c{v}") for v, side, scale in (("x", "w", PICTURE[0]), ("y", "h", PICTURE[1]))], (confidence_logodds("confidence") + bias).alias("emission"))
    fr = c.select(clip, "frame_index").distinct()
    part = ordered.with_islands(fr, [clip], ["frame_index"], lambda r, p: r["frame_index"] - p["frame_index"] > max_gap, ["frame_index"], "part", span=span)
    schema = f"{clip} string, part long, frame_index int, detection_id long, track_no long"
    return frame_scan(c.join(part, [clip, "frame_index"]), [clip, "part"], "frame_index", ["detection_id", "cx", "cy", "emission"], lambda: _PathFrames(max_gap), schema)


# --- cluster tracks ------------------------------------------------------------------------------------------------


class _Followed:
    """Tracks as arrays; each frame links rows ``(id, numbers...)`` to them one to one, cheapest pair first.

    ``cost(tracks, rows, gaps)`` gives a matrix with infinity where no link may be. Of equal costs the older track comes first,
    or the smaller row where ``row_first``. A track is open for ``memory`` frames, counted to this frame or, where
    ``lagged``, to the frame before it that had rows.
    """

    def __init__(self, cost, width: int, memory: int, first: int, row_first: bool = False, lagged: bool = False):
        self.cost, self.memory, self.next, self.row_first, self.lagged = cost, memory, first, row_first, lagged
        self.ids, self.seen, self.at, self.before = np.empty(0, int), np.empty(0, int), np.empty((0, width)), None

    def frame(self, f, rows):
        new = np.array([r[1:] for r in rows], dtype=float)
        clock = self.before if self.lagged and self.before is not None else f
        keep = clock - self.seen <= self.memory
        ids, seen, at, self.before = self.ids[keep], self.seen[keep], self.at[keep], f
        track = np.full(len(rows), -1)
        left = self.cost(at[:, None, :], new[None, :, :], (f - seen)[:, None])
        left = left.T if self.row_first else left
        while left.size and np.isfinite(left.min()):
            a, b = np.unravel_index(left.argmin(), left.shape)
            left[a, :] = left[:, b] = np.inf
            i, j = (b, a) if self.row_first else (a, b)
            track[j], seen[i], at[i] = ids[i], f, new[j]
        fresh = track < 0
        track[fresh] = np.arange(self.next, self.next + fresh.sum())
        self.next += int(fresh.sum())
        self.ids, self.seen = np.append(ids, track[fresh]), np.append(seen, np.full(fresh.sum(), f))
        self.at = np.vstack([at, new[fresh]])
        return [(f, r[0], int(i)) for r, i in zip(rows, track, strict=True)]


def _uncovered(least: float):
    """Cost of two boxes: minus the part of the smaller one that the other covers, where that is at least ``least``."""

    def cost(a, b, _gap):
        sides = [np.maximum(np.minimum(a[..., i] + a[..., i + 2], b[..., i] + b[..., i + 2]) - np.maximum(a[..., i], b[..., i]), 0.0) for i in (0, 1)]
        small = np.minimum(a[..., 2] * a[..., 3], b[..., 2] * b[..., 3])
        part = np.divide(sides[0] * sides[1], small, out=np.zeros_like(small), where=small > 0)
        return np.where(part >= least, -part, np.inf)

    return cost


def _apart(speed: float):
    """Cost of two points: their distance, where ``speed`` per frame reaches it."""

    def cost(a, b, gap):
        d = np.hypot(a[..., 0] - b[..., 0], a[..., 1] - b[..., 1])
        return np.where(d <= speed * np.maximum(gap, 1), d, np.inf)

    return cost


def cluster_tracks(clusters: DataFrame, key: str, max_gap: int = 5, overlap: float = 0.5) -> DataFrame:
    """Track id of every person cluster (``component`` and union box ``x, y, w, h`` per frame)."""
    schema = f"{key} string, frame_index int, component long, cluster_track long"
    return frame_scan(clusters, [key], "frame_index", ["component", "x", "y", "w", "h"], lambda: _Followed(_uncovered(overlap), 4, max_gap, 0), schema)


def union_boxes(boxes: DataFrame, clusters: DataFrame, keys: list[str], det: str = "detection_id") -> DataFrame:
    d = boxes.join(clusters, [*keys, det])
    g = d.groupBy(*keys, "component").agg(
        F.min("bbox_x").alias("x"), F.min("bbox_y").alias("y"), F.max(F.col("bbox_x") + F.col("bbox_w")).alias("x2"),
        F.max(F.col("bbox_y") + F.col("bbox_h")).alias("y2"), F.count("*").alias("people"))
    return g.withColumn("w", F.col("x2") - F.col("x")).withColumn("h", F.col("y2") - F.col("y")).drop("x2", "y2")


#: Tracker plug-ins by name: function(candidates, frames) -> points.
TRACKERS: dict[str, Callable[..., DataFrame]] = {"online": ball_points, "bidirectional": bidirectional_ball}


def window_tracklets(cands: DataFrame, clip: str, window: str, speed_px: float = 60.0, memory: int = 30, width: float = 1920.0, height: float = 1080.0) -> DataFrame:
    """Tracklet number of each candidate inside its review window; a window is one independent pass."""
    d = cands.select(clip, window, "frame_index", "detection_id", (F.col("x") * width).alias("px"), (F.col("y") * height).alias("py"))
    schema = f"{clip} string, {window} long, frame_index int, detection_id long, tracklet long"
    cost = _apart(speed_px * height / 1080)
    return frame_scan(d, [clip, window], "frame_index", ["detection_id", "px", "py"], lambda: _Followed(cost, 2, memory, 1, row_first=True, lagged=True), schema)
