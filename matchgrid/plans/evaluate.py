"""Evaluation runs: metric tables per class, split and cohort."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchgrid.operators import matching, snapshots, spatial

#: name -> function(items) -> DataFrame(metric, value)
ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def adapter(name: str):
    """Register an evaluation adapter."""

    def add(fn):
        ADAPTERS[name] = fn
        return fn

    return add


def detector_scores(scored: DataFrame, n_gt: DataFrame, tie: Sequence[str], conf: float = 0.3) -> DataFrame:
    """Long table of AP, precision, recall and ground-truth count per class, and the mean AP."""
    ap = matching.average_precision(scored, n_gt, ["cls"], tie)
    pr = matching.precision_recall_at(scored, n_gt, ["cls"], conf)

    def row(df: DataFrame, col: str, metric: str) -> DataFrame:
        return df.select("cls", F.lit(metric).alias("metric"), F.col(col).cast("double").alias("value"))

    mean = ap.agg(F.avg("ap").alias("v")).select(F.lit("all").alias("cls"), F.lit("map50").alias("metric"), F.col("v").alias("value"))
    out = row(ap, "ap", "ap50")
    for col in ("precision", "recall", "n_gt"):
        out = out.unionByName(row(pr, col, col))
    return out.unionByName(mean)


def evaluate(name: str, items: DataFrame, flags: DataFrame, cohort: int | None = None) -> DataFrame:
    """Result rows of one adapter for every evaluation split, over all items and over the fixed cohort.

    ``flags`` holds ``split, contaminated``. The split loop has four fixed entries.
    """
    fn, out = ADAPTERS[name], None
    for split in ("train", "eval_heldout_match", "eval_in_match", "eval_all"):
        for c in (None, cohort) if cohort is not None else (None,):
            rows = fn(snapshots.select_items(items, split, c))
            rows = rows.select(F.lit(split).alias("split"), F.lit(c).cast("int").alias("cohort"), "metric", F.col("value").cast("double").alias("value"))
            out = rows if out is None else out.unionByName(rows)
    return out.join(F.broadcast(flags.select("split", "contaminated")), "split", "left")  # four rows: one per split


@adapter("label_kinds")
def _label_kinds(items: DataFrame) -> DataFrame:
    return items.groupBy(F.concat(F.lit("n_"), "label_kind").alias("metric")).agg(F.count("*").alias("value"))


# Fixed values of the teacher's score: methods that count as gold, radii of a ball hit in pixels, least overlap of a person hit,
# and how much a person may overlap another one of the same side to fall into a bucket.
GOLD_METHODS = ("hand_series", "hand_frame", "verdict")
BALL_RADII = (10, 25)
PERSON_IOU = 0.5
OVERLAP_BUCKETS = (("isolated", 0.1), ("touching", 0.3), ("overlapping", None))


def overlap_buckets(boxes: DataFrame, frame_keys: Sequence[str], box_id: str = "detection_id") -> DataFrame:
    """Boxes with ``bucket``, by their largest overlap with another box of the frame."""
    k = list(frame_keys)
    pairs = spatial.box_pairs(boxes, None, k, box_id, box_id, 0.0, strict=True)
    ends = F.explode(F.array(box_id, f"{box_id}_b")).alias(box_id)
    most = pairs.select(*k, ends, "iou").groupBy(*k, box_id).agg(F.max("iou").alias("__most"))
    bucket, most_of = None, F.coalesce("__most", F.lit(0.0))
    for name, below in OVERLAP_BUCKETS:
        test = F.lit(True) if below is None else most_of < below
        bucket = F.when(test, name) if bucket is None else bucket.when(test, name)
    return boxes.join(most, [*k, box_id], "left").withColumn("bucket", bucket).drop("__most")


def teacher_scores(frames: DataFrame, gold: DataFrame, pred: DataFrame, match: str, frame_keys: Sequence[str]) -> DataFrame:
    """One row per match: recall and precision of a teacher's ball and persons on gold frames; null where nothing counts.

    ``frames`` has the match, the frame keys, ``width, height`` and ``ball``, ``person``: is the frame gold for them. ``gold`` and
    ``pred`` have the frame keys, ``detection_id``, ``kind`` (``ball``, ``person``), ``confidence`` and the box. A side has one ball per
    frame, the surest, of equal ones the smallest id. Persons are matched one to one, best overlap first.
    """
    k = list(frame_keys)
    box = ["bbox_x", "bbox_y", "bbox_w", "bbox_h"]

    def ball(d: DataFrame, side: str) -> DataFrame:
        place = F.struct((F.col("bbox_x") + F.col("bbox_w") / 2).alias("x"), (F.col("bbox_y") + F.col("bbox_h") / 2).alias("y"))
        first = F.struct(-F.coalesce("confidence", F.lit(1.0)), "detection_id")
        return d.where("kind = 'ball'").groupBy(*k).agg(F.min_by(place, first).alias(side))

    b = frames.where("ball").join(ball(gold, "g"), k, "left").join(ball(pred, "p"), k, "left")
    dx, dy = (F.col("g.x") - F.col("p.x")) * F.col("width"), (F.col("g.y") - F.col("p.y")) * F.col("height")
    b = b.withColumn("away", F.sqrt(dx * dx + dy * dy))
    hits = {r: F.count_if(F.col("away") <= r) for r in BALL_RADII}
    part = lambda n, of: F.when(of > 0, n / of)
    balls = b.groupBy(match).agg(
        F.count("*").alias("n_ball_frames"), *[part(n, F.count("g")).alias(f"ball_recall_{r}px") for r, n in hits.items()],
        *[part(n, F.count("p")).alias(f"ball_precision_{r}px") for r, n in hits.items()])

    seen = frames.where("person").select(match, *k)
    sides = {name: d.where("kind = 'person'").join(seen, k).select(match, *k, "detection_id", *box) for name, d in (("recall", gold), ("precision", pred))}
    pairs = spatial.box_pairs(sides["recall"].withColumnRenamed("detection_id", "gold_id"), sides["precision"], k, "gold_id", "detection_id", PERSON_IOU)
    met = matching.greedy_match(pairs, k, "gold_id", "detection_id", [("iou", False), ("gold_id", True), ("detection_id", True)])
    tally = None
    for name, found in (("recall", met.select(*k, F.col("gold_id").alias("detection_id"))), ("precision", met.select(*k, "detection_id"))):
        d = overlap_buckets(sides[name], k).join(found.withColumn("hit", F.lit(1)), [*k, "detection_id"], "left")
        d = d.groupBy(match, "bucket").agg(F.count("*").alias("n"), F.count("hit").alias("hit")).withColumn("side", F.lit(name))
        tally = d if tally is None else tally.unionByName(d)
    cols = []
    for name in sides:
        for bucket in [*(x for x, _ in OVERLAP_BUCKETS), "all"]:
            mine = (F.col("side") == name) & (F.lit(bucket == "all") | (F.col("bucket") == bucket))
            cols.append(part(F.sum(F.when(mine, F.col("hit"))), F.sum(F.when(mine, F.col("n")))).alias(f"person_{name}_{bucket}"))
    persons = seen.groupBy(match).agg(F.count("*").alias("n_player_frames")).join(tally.groupBy(match).agg(*cols), match, "left")
    return balls.join(persons, match, "full").fillna(0, ["n_ball_frames", "n_player_frames"])
