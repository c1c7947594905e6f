"""Connected components: identity clusters over pair verdicts, box clusters inside frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.operators import spatial
from matchgrid.operators.scan import ordered_scan
from matchgrid.session import cut_lineage

#: Links of the largest group whose components one task finds in a pass; larger groups are solved in rounds.
WALKED_LINKS = 1_000_000


def components(nodes: DataFrame, edges: DataFrame, node: str = "node", keys: Sequence[str] = ()) -> DataFrame:
    """Smallest reachable node id per node (``component``), by min-label hooking with pointer jumping.

    Edges are ``src, dst``. Every round is one map-side combined minimum over the edges and one lookup of the
    label's own label, so path length halves per round. Each round is checkpointed to shared storage.
    """
    k = list(keys)
    und = edges.select(*k, "src", "dst").where("src <> dst")
    und = cut_lineage(und.unionByName(und.select(*k, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    lab = cut_lineage(nodes.select(*k, F.col(node)).distinct().withColumn("component", F.col(node)))
    while True:
        src = lab.select(*k, F.col(node).alias("src"), F.col("component").alias("__l"))
        best = und.join(src, [*k, "src"]).groupBy(*k, F.col("dst").alias(node)).agg(F.min("__l").alias("__m"))
        new = lab.join(best, [*k, node], "left").withColumn("__c", F.least("component", F.coalesce("__m", "component")))
        new = new.select(*k, node, F.col("component").alias("__old"), F.col("__c").alias("component"))
        # Pointer jumping: the label of my label. The lookup side has one row per node.
        parent = new.select(*k, F.col(node).alias("component"), F.col("component").alias("__g"))
        new = new.join(parent, [*k, "component"], "left")
        new = new.select(*k, node, "__old", F.least("component", F.coalesce("__g", "component")).alias("component"))
        new = cut_lineage(new)
        changed = not new.where("component <> __old").isEmpty()
        lab = new.drop("__old")
        if not changed:
            return lab


class _Unions:
    """The links of one group in any order; emits each node whose component is another one. Holds linked nodes only."""

    def __init__(self, key: tuple):
        self.key, self.up = key, {}

    def root(self, t):
        up = self.up
        while t in up:
            if up[t] in up:
                up[t] = up[up[t]]
            t = up[t]
        return t

    def step(self, row):
        a, b = self.root(row[-2]), self.root(row[-1])
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return ()

    def close(self):
        return [(*self.key, t, self.root(t)) for t in self.up]


def frame_components(nodes: DataFrame, edges: DataFrame, node: str, keys: Sequence[str]) -> DataFrame:
    """As :func:`components`, for groups that are small and many, as frames are: a group is one pass over its links, so links
    are shuffled once. Groups of more than ``WALKED_LINKS`` links are solved in rounds."""
    k = list(keys)
    edges = cut_lineage(edges.select(*k, "src", "dst"))
    large = cut_lineage(edges.groupBy(*k).agg(F.count("*").alias("__n")).where(F.col("__n") > WALKED_LINKS).select(*k))
    types = dict(edges.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in k) + f", {node} {types['src']}, component {types['src']}"
    if large.isEmpty():
        moved = ordered_scan(edges, k, [], _Unions, schema)
    else:
        theirs = edges.join(large, k, "left_semi")
        ends = theirs.select(*k, F.col("src").alias(node)).unionByName(theirs.select(*k, F.col("dst").alias(node)))
        moved = ordered_scan(edges.join(large, k, "left_anti"), k, [], _Unions, schema).unionByName(components(ends, theirs, node, k))
    # Read again by whoever groups by component: stored once.
    moved = cut_lineage(moved)
    return nodes.select(*k, node).distinct().join(moved, [*k, node], "left").withColumn("component", F.coalesce("component", node))


def roots(links: DataFrame, keys: Sequence[str], node: str, parent: str) -> DataFrame:
    """The topmost ancestor of every node that has a parent, by pointer jumping.

    ``links`` has one row per such node and no cycle. A round replaces each parent by its own parent, so paths halve; the
    looked-up side has one row per node, and each round is stored.
    """
    k = list(keys)
    at = cut_lineage(links.select(*k, node, parent))
    while True:
        up = at.select(*k, F.col(node).alias(parent), F.col(parent).alias("__up"))
        moved = at.join(up, [*k, parent], "left").select(*k, node, F.coalesce("__up", parent).alias(parent), F.col("__up").isNotNull().alias("__moved"))
        moved = cut_lineage(moved)
        at = moved.drop("__moved")
        if moved.where("__moved").isEmpty():
            return at


def identity_clusters(labels: DataFrame, clip: str = "clip") -> DataFrame:
    """Cluster of every labelled tracklet (SAME is transitive) with compact ids in key order.

    ``labels`` has ``clip, lo, hi, verdict``: one row per unordered pair.
    """
    nodes = labels.select(clip, F.col("lo").alias("node")).unionByName(labels.select(clip, F.col("hi").alias("node"))).distinct()
    edges = labels.where("verdict = 'same'").select(clip, F.col("lo").alias("src"), F.col("hi").alias("dst"))
    comp = components(nodes, edges, "node", [clip])
    # Ids are numbered over the distinct components, not over the nodes.
    ids = comp.select(clip, "component").distinct()
    w = Window.partitionBy(clip).orderBy("component")
    ids = ids.withColumn("cluster_id", (F.row_number().over(w) - 1).cast("long"))
    return comp.join(ids, [clip, "component"]).select(clip, "node", "cluster_id")


def contradictions(labels: DataFrame, clusters: DataFrame, clip: str = "clip") -> DataFrame:
    """DIFFERENT verdicts whose two sides ended up in one SAME cluster."""
    a = clusters.select(clip, F.col("node").alias("lo"), F.col("cluster_id").alias("__a"))
    b = clusters.select(clip, F.col("node").alias("hi"), F.col("cluster_id").alias("__b"))
    d = labels.where("verdict = 'different'").join(a, [clip, "lo"]).join(b, [clip, "hi"])
    return d.where("__a = __b").select(clip, "lo", "hi", F.col("__a").alias("cluster_id"))


def cluster_report(labels: DataFrame, clusters: DataFrame, n_tracklets: DataFrame, clip: str = "clip") -> DataFrame:
    """Clusters, unknown rate, contradictions and the share of pairs that never had to be asked, per clip."""
    lab = labels.groupBy(clip).agg(F.count("*").alias("n_labels"), F.count_if(F.col("verdict") == "unknown").alias("n_unknown"))
    cl = clusters.groupBy(clip).agg(F.countDistinct("cluster_id").alias("n_clusters"))
    bad = contradictions(labels, clusters, clip).groupBy(clip).agg(F.count("*").alias("n_contradictions"))
    d = lab.join(cl, clip).join(bad, clip, "left").join(n_tracklets, clip, "left").fillna(0, ["n_contradictions"])
    pairs = F.col("n_tracklets") * (F.col("n_tracklets") - 1) / 2.0
    saved = F.when(pairs > 0, F.greatest(F.lit(0.0), 1.0 - F.col("n_labels") / pairs)).otherwise(0.0)
    return d.withColumn("unknown_rate", F.col("n_unknown") / F.col("n_labels")).withColumn("saved", saved)


def person_links(boxes: DataFrame, frame_keys: Sequence[str], det: str, min_iou: float = 0.2, centre_frac: float = 0.6,
                 extent: tuple[float, float] = (1.0, 1.0), overlaps: DataFrame | None = None) -> DataFrame:
    """Pairs of boxes of a frame that stand together: enough overlap, or centres close for their width. ``overlaps`` are all
    overlapping pairs, where they are known.

    A pair within ``centre_frac`` of the mean width always has its centre-width boxes touching, so both rules are
    found by one overlap join of boxes widened to squares of their own width about the centre, plus the plain boxes.
    """
    k = list(frame_keys)
    over = spatial.box_pairs(boxes, None, k, det, det, min_iou, strict=True, extent=extent) if overlaps is None else overlaps.where(F.col("iou") > min_iou)
    over = over.select(*k, F.col(det).alias("src"), F.col(f"{det}_b").alias("dst"))
    cx, cy = F.col("bbox_x") + F.col("bbox_w") / 2, F.col("bbox_y") + F.col("bbox_h") / 2
    # A square of side w about each centre: two squares overlap if both centre offsets are below the mean width.
    sq = boxes.select(*k, det, (cx - F.col("bbox_w") / 2).alias("bbox_x"), (cy - F.col("bbox_w") / 2).alias("bbox_y"), F.col("bbox_w"),
                      F.col("bbox_w").alias("bbox_h"), *[F.col(f"bbox_{v}").alias(f"o{v}") for v in "xywh"])
    own = [f"o{v}" for v in "xywh"]
    near = spatial.box_pairs(sq, None, k, det, det, 0.0, left_cols=own, right_cols=own, strict=True, extent=extent)
    # In the order of the SQL's terms: a pair exactly at the limit falls to the same side.
    off = lambda v, side: F.col(f"o{v}") + F.col(f"o{side}") / 2 - F.col(f"o{v}_b") - F.col(f"o{side}_b") / 2
    d2 = F.sqrt(F.pow(off("x", "w"), 2) + F.pow(off("y", "h"), 2))
    near = near.where(d2 < (F.col("ow") + F.col("ow_b")) / 2 * centre_frac).select(*k, F.col(det).alias("src"), F.col(f"{det}_b").alias("dst"))
    return over.unionByName(near).distinct()


def person_clusters(boxes: DataFrame, frame_keys: Sequence[str], det: str = "detection_id", extent: tuple[float, float] = (1.0, 1.0),
                    overlaps: DataFrame | None = None) -> DataFrame:
    """Component of every box inside its frame; ``extent`` is the picture's size in the units of the boxes. ``overlaps``: see
    :func:`person_links`."""
    k = list(frame_keys)
    return frame_components(boxes.select(*k, det), person_links(boxes, k, det, extent=extent, overlaps=overlaps), det, k)


def crowd_scores(boxes: DataFrame, frame_keys: Sequence[str], det: str = "detection_id", crowd: int = 3,
                 extent: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Largest cluster + a quarter of the boxes in crowds + mean overlap of the pairs inside clusters."""
    k = list(frame_keys)
    ov = cut_lineage(spatial.box_pairs(boxes, None, k, det, det, 0.0, strict=True, extent=extent))
    comp = person_clusters(boxes, k, det, extent, ov)
    size = comp.groupBy(*k, "component").agg(F.count("*").alias("size"))
    per = size.groupBy(*k).agg(
        F.max("size").alias("largest"), F.sum(F.when(F.col("size") >= crowd, F.col("size")).otherwise(0)).alias("in_crowds"),
        F.sum(F.col("size") * (F.col("size") - 1) / 2.0).alias("pairs"), F.sum("size").alias("n_boxes"))
    # Every overlapping pair is linked or joined by others; only pairs inside one cluster count.
    a = comp.select(*k, F.col(det), F.col("component").alias("__a"))
    b = comp.select(*k, F.col(det).alias(f"{det}_b"), F.col("component").alias("__b"))
    s = ov.join(a, [*k, det]).join(b, [*k, f"{det}_b"]).where("__a = __b").groupBy(*k).agg(F.sum("iou").alias("sum_iou"))
    d = per.join(s, k, "left").withColumn("mean_iou", F.when(F.col("pairs") > 0, F.coalesce("sum_iou", F.lit(0.0)) / F.col("pairs")).otherwise(0.0))
    return d.withColumn("score", F.col("largest") + 0.25 * F.col("in_crowds") + F.col("mean_iou")).drop("sum_iou", "pairs")


def node_clusters(points: DataFrame, frame_keys: Sequence[str], node: str, x: Column, y: Column, radius: float = 8.0) -> DataFrame:
    """Single-linkage clusters of candidate points of all sources in a frame."""
    k = list(frame_keys)
    p = points.select(*k, F.col(node).alias("src"), x.alias("__x"), y.alias("__y"))
    q = p.select(*k, F.col("src").alias("dst"), F.col("__x").alias("__qx"), F.col("__y").alias("__qy"))
    pairs = spatial.point_pairs(p, q, k, [F.col("__x"), F.col("__y")], [F.col("__qx"), F.col("__qy")], radius)
    return frame_components(points.select(*k, node), pairs.where("src < dst").select(*k, "src", "dst"), node, k)


def merged_nodes(points: DataFrame, clusters: DataFrame, frame_keys: Sequence[str], node: str, source: str, score: str) -> DataFrame:
    """One node per cluster: mean place, sources with their best score, number of members."""
    k = [*frame_keys, "component"]
    d = points.join(clusters, [*frame_keys, node])
    per = d.groupBy(*k, source).agg(F.max(score).alias("s"), F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    return per.groupBy(*k).agg(
        (F.sum("sx") / F.sum("n")).alias("x"), (F.sum("sy") / F.sum("n")).alias("y"), F.sum("n").alias("members"),
        F.array_sort(F.collect_list(F.struct(F.col(source).alias("source"), F.col("s").alias("score")))).alias("by_source"))
