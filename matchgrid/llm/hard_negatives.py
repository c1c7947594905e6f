"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Candidates are put in the order of a Hilbert curve through all dimensions and cut in blocks of ``ROWS`` rows; a block is one
row of a Parquet table, with the smallest and largest component per dimension (its zone map) and its labels beside its
vectors. For an anchor, interval arithmetic on the zone map gives the least and greatest inner product that any row of the
block can have. Blocks are chosen from the zone maps alone, then only the chosen ones are read:

1. positives: each anchor's best rows of its own label. The block the anchor stands in gives a first bound; further blocks
   are read where the greatest possible product reaches it;
2. negatives: each positive has a window of scores. Blocks whose interval misses all windows of an anchor are not read. A
   share of the blocks goes first, and its results raise the lower ends of the windows for the others.

Bounds never exclude a row that counts, so results are exact. Anchors are taken ``ANCHORS`` at a time in curve order, so
neighbours need the same blocks and memory does not grow with their number; every task keeps the best rows per anchor only.

Rows with a null key, a null label, a null vector, or a null or non-finite component take no part, nor do components beyond
``LARGEST`` in size, whose products no long can hold. Vectors are compared with vectors of the same length only. Equal
scores follow the smaller key; repeated rows are rows of their own. An anchor without another row of its label has no
positives and gives no rows; so does an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.llm.common import numbered, stored, unstore

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: The window of a negative's score, in percent of the positive's.
LOW, HIGH = 30, 90
#: Candidates in a block.
ROWS = 512
#: Anchors per pass over the blocks.
ANCHORS = 4096
#: One block in so many is read first to raise the lower ends of the windows.
FIRST = 8
LARGEST = 1 << 27
#: Bits per dimension of the curve.
BITS = 4
_LEAST = np.iinfo(np.int64).min


def hilbert_keys(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each row on a Hilbert curve through all dimensions, as bytes that sort like the place.

    Each component's top ``bits`` bits (of a fixed range, larger values at its ends) are turned from axes into the
    transposed index, all rows at once.
    """
    n, d = x.shape
    top = 1 << (bits - 1)
    # Half of the range of a unit vector's components, so that the usual small ones differ.
    v = np.clip((x + SCALE // 2) * (1 << bits) // SCALE, 0, (1 << bits) - 1).astype(np.uint32)
    q = top
    while q > 1:
        for i in range(d):
            low = np.uint32(q - 1)
            inside = (v[:, i] & q) != 0
            swap = np.where(inside, 0, (v[:, 0] ^ v[:, i]) & low).astype(np.uint32)
            v[:, 0] ^= np.where(inside, low, swap)
            v[:, i] ^= swap
        q >>= 1
    for i in range(1, d):
        v[:, i] ^= v[:, i - 1]
    turn = np.zeros(n, np.uint32)
    q = top
    while q > 1:
        turn ^= np.where(v[:, d - 1] & q, np.uint32(q - 1), np.uint32(0))
        q >>= 1
    v ^= turn[:, None]
    planes = [((v >> np.uint32(b)) & 1).astype(np.uint8) for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes, axis=1), axis=1)


def usable(vector: Column, label: Column, key: Column, scale: int) -> Column:
    good = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * scale) < LARGEST)
    return F.coalesce(key.isNotNull() & label.isNotNull() & (F.size(vector) > 0) & F.forall(vector, good), F.lit(False))


def on_curve(rows: DataFrame) -> DataFrame:
    """``rows`` (``key, label, x``) with ``dims`` and ``place``, the key on the curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            place: list[bytes] = [b""] * b.num_rows
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                keys = hilbert_keys(lists.take(pa.array(at)).flatten().to_numpy().reshape(len(at), d))
                for i, k in zip(at, keys, strict=True):
                    place[i] = k.tobytes()
            yield pa.record_batch([*b.columns, pa.array(sizes, pa.int32()), pa.array(place, pa.binary())], names=["key", "label", "x", "dims", "place"])

    return rows.select("key", "label", "x").mapInArrow(run, "key long, label long, x array<long>, dims int, place binary")


def blocks_of(ordered: DataFrame, rows: int = ROWS) -> DataFrame:
    """One row per block: ``block, dims, labels`` (distinct), ``low, high`` (the zone map), and the rows: ``keys, places``
    (numbers of the rows), ``own`` (labels), ``xs`` (all components). ``ordered`` is sorted inside its partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 33, 0

        def block(t: pa.Table) -> pa.RecordBatch:
            nonlocal made
            t = t.combine_chunks()
            d = t.column("dims")[0].as_py()
            key, own, row = (t.column(c).to_numpy() for c in ("key", "label", "row"))
            x = t.column("x").chunk(0).flatten().to_numpy().reshape(-1, d)
            made += 1
            out = [first + made, d, np.unique(own), x.min(axis=0), x.max(axis=0), key, row, own, x.ravel()]
            kinds = [pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 7]
            return pa.record_batch([pa.array([v], k) for v, k in zip(out, kinds, strict=True)], names=["block", "dims", "labels", "low", "high", "keys", "places", "own", "xs"])

        held: list[pa.Table] = []
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.concat_tables([*held, pa.Table.from_batches([b])])
            while t.num_rows:
                d = t.column("dims").to_numpy()
                end = int(np.argmax(d != d[0])) or len(d)  # rows of one length
                if min(end, rows) == t.num_rows < rows:
                    break
                yield block(t.slice(0, min(end, rows)))
                t = t.slice(min(end, rows))
            held = [t] if t.num_rows else []
        if held:
            yield block(held[0])

    many = ", ".join(f"{c} array<long>" for c in ("labels", "low", "high", "keys", "places", "own", "xs"))
    return ordered.select("key", "label", "x", "dims", "row").mapInArrow(run, f"block long, dims int, {many}")


class Anchors:
    """A bounded number of anchors of one length, as arrays."""

    def __init__(self, rows: list):
        self.key, self.row, self.label = (np.array([r[c] for r in rows], np.int64) for c in ("key", "row", "label"))
        self.x = np.array([r["x"] for r in rows], np.int64)
        self.dims = self.x.shape[1]

    def _exact_as_doubles(self, largest: int) -> bool:
        return int(np.abs(self.x).max(initial=0)) * max(1, largest) * self.dims < 1 << 53

    def products(self, x: np.ndarray) -> np.ndarray:
        """Inner products of all anchors with rows, exact."""
        if self._exact_as_doubles(int(np.abs(x).max(initial=0))):
            return (self.x.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
        return self.x @ x.T

    def interval(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product that each anchor can have with rows inside the bounds (anchors x blocks)."""
        up, down = np.maximum(self.x, 0), np.minimum(self.x, 0)
        if self._exact_as_doubles(int(max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)))):
            up, down, low, high = (v.astype(np.float64) for v in (up, down, low, high))
        return (up @ low.T + down @ high.T).astype(np.int64), (up @ high.T + down @ low.T).astype(np.int64)


def chosen(blocks: DataFrame, anchors: Anchors, wanted: Callable) -> DataFrame:
    """``block, who``: the blocks that some anchor must read, and the numbers of those anchors; from the zone maps alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                low, high = (b.column(c).flatten().to_numpy().reshape(b.num_rows, -1) for c in (2, 3))
                must = wanted(anchors, b.column(0).to_numpy(), b.column(1).to_pylist(), *anchors.interval(low, high))
                who = [np.flatnonzero(must[:, j]) for j in range(b.num_rows)]
                some = [j for j, w in enumerate(who) if len(w)]
                yield pa.record_batch([b.column(0).take(pa.array(some, pa.int64())), pa.array([who[j] for j in some], pa.list_(pa.int32()))], names=["block", "who"])

    zones = blocks.where(F.col("dims") == anchors.dims).select("block", "labels", "low", "high")
    return zones.mapInArrow(run, "block long, who array<int>")


def best_rows(blocks: DataFrame, need: DataFrame, anchors: Anchors, width: int, windows: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """``anchor, slot, score, key, row``: the best rows that one task has seen, per anchor and window.

    Without windows: the best rows of the anchor's own label but itself. With windows (lower and upper ends, anchors x
    slots): the best rows of other labels inside each.
    """
    slots = windows[0].shape[1] if windows else 1
    a = len(anchors.key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = np.full((a, slots, width), _LEAST)
        key, row = np.full((a, slots, width), np.iinfo(np.int64).max), np.full((a, slots, width), -1)
        for b in batches:
            for i in range(b.num_rows):
                who = b.column(1)[i].values.to_numpy()
                keys, places, own = (b.column(c)[i].values.to_numpy() for c in (2, 3, 4))
                x = b.column(5)[i].values.to_numpy().reshape(len(keys), -1)
                order = np.lexsort((places, keys))  # equal scores keep this order
                keys, places, own, x = keys[order], places[order], own[order], x[order]
                few = Anchors.__new__(Anchors)
                few.x, few.dims = anchors.x[who], anchors.dims
                s = few.products(x)
                same = anchors.label[who][:, None] == own[None, :]
                out = (~same | (anchors.row[who][:, None] == places[None, :])) if windows is None else same
                s = np.where(out, _LEAST, s)
                rank = np.argsort(-np.maximum(s, _LEAST + 1), axis=1, kind="stable")
                ranked = np.take_along_axis(s, rank, axis=1)
                for w in range(slots):
                    if windows is None:
                        start, least = np.zeros(len(who), np.int64), np.full(len(who), _LEAST + 1)
                    else:
                        start, least = (ranked > windows[1][who, w][:, None]).sum(axis=1), windows[0][who, w]
                    at = np.minimum(start[:, None] + np.arange(width), len(keys) - 1)
                    got = np.take_along_axis(ranked, at, axis=1)
                    good = (start[:, None] + np.arange(width) < len(keys)) & (got >= least[:, None]) & (got > _LEAST)
                    some = np.flatnonzero(good.any(axis=1))
                    if not len(some):
                        continue
                    pick = np.take_along_axis(rank, at, axis=1)[some]
                    mine = who[some]
                    s2 = np.concatenate([score[mine, w], np.where(good[some], got[some], _LEAST)], axis=1)
                    k2 = np.concatenate([key[mine, w], keys[pick]], axis=1)
                    r2 = np.concatenate([row[mine, w], places[pick]], axis=1)
                    top = np.lexsort((r2, k2, -np.maximum(s2, _LEAST + 1)), axis=1)[:, :width]
                    score[mine, w], key[mine, w], row[mine, w] = (np.take_along_axis(v, top, axis=1) for v in (s2, k2, r2))
        i, w, j = np.nonzero(score > _LEAST)
        for c in range(0, len(i), 50_000):
            p = (i[c : c + 50_000], w[c : c + 50_000], j[c : c + 50_000])
            cols = [pa.array(v, k) for v, k in zip((p[0], p[1], score[p], key[p], row[p]), (pa.int32(), pa.int32(), *[pa.int64()] * 3), strict=True)]
            yield pa.record_batch(cols, names=["anchor", "slot", "score", "key", "row"])

    d = blocks.join(F.broadcast(need) if need.limit(20_001).count() <= 20_000 else need, "block")
    d = d.select("block", "who", "keys", "places", "own", "xs").mapInArrow(run, "anchor int, slot int, score long, key long, row long")
    w = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "key", "row")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= width)


def positives(blocks: DataFrame, anchors: Anchors, n: int) -> DataFrame:
    """``anchor, slot, score, key, row, rank``: the best rows of each anchor's label, exact."""
    home = blocks.select("block", F.explode("places").alias("row")).join(F.broadcast(blocks.sparkSession.createDataFrame(
        [(int(r), i) for i, r in enumerate(anchors.row)], "row long, i int")), "row")
    home = stored(home.groupBy("block").agg(F.array_sort(F.collect_list("i")).alias("who")))
    first = stored(best_rows(blocks, home, anchors, n, None))
    own_block = np.zeros(len(anchors.key), np.int64)
    for r in home.select("block", F.explode("who").alias("i")).collect():  # one row per anchor of the pass
        own_block[r["i"]] = r["block"]
    bound = np.full(len(anchors.key), _LEAST)
    for r in first.where(F.col("rank") == n).select("anchor", "score").collect():  # at most one row per anchor of the pass
        bound[r["anchor"]] = r["score"]

    def wanted(a: Anchors, block: np.ndarray, labels: list, least: np.ndarray, greatest: np.ndarray) -> np.ndarray:
        has = np.stack([np.isin(a.label, held) for held in labels], axis=1)
        return has & (greatest >= bound[:, None]) & (own_block[:, None] != block[None, :])

    need = stored(chosen(blocks, anchors, wanted))
    d = first.drop("rank").unionByName(best_rows(blocks, need, anchors, n, None).drop("rank"))
    w = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "key", "row")
    out = stored(d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n))
    for t in (home, first, need):
        unstore(t)
    return out


def negatives(blocks: DataFrame, anchors: Anchors, scores: np.ndarray, n: int, low: int, high: int) -> DataFrame:
    """``anchor, slot, score, key, row, rank`` of the rows of other labels inside the windows of the positives' scores
    (anchors x positives; ``_LEAST`` where there is none), exact."""
    none = scores == _LEAST
    value = np.where(none, 0, scores)
    # low * positive <= 100 * negative <= high * positive, as whole numbers; no positive: an empty window.
    bottom, top = np.where(none, 1, -((-low * value) // 100)), np.where(none, 0, high * value // 100)
    top = np.where(bottom > top, _LEAST, top)  # empty windows, as those of positives below zero, meet no block
    bottom = np.where(top == _LEAST, np.iinfo(np.int64).max, bottom)

    def inside(bottom: np.ndarray, share: Callable) -> Callable:
        def wanted(a: Anchors, block: np.ndarray, labels: list, least: np.ndarray, greatest: np.ndarray) -> np.ndarray:
            other = np.stack([a.label != held[0] if len(held) == 1 else np.ones(len(a.label), bool) for held in labels], axis=1)
            met = np.zeros(least.shape, bool)
            for w in range(bottom.shape[1]):
                met |= (greatest >= bottom[:, w][:, None]) & (least <= top[:, w][:, None])
            return met & other & share(block)[None, :]

        return wanted

    mixed = lambda b: (b ^ (b >> 33)) * 0x9E3779B1 % (1 << 20)
    early = stored(chosen(blocks, anchors, inside(bottom, lambda b: mixed(b) % FIRST == 0)))
    first = stored(best_rows(blocks, early, anchors, n, (bottom, top)))
    raised = bottom.copy()
    for r in first.where(F.col("rank") == n).select("anchor", "slot", "score").collect():  # one row per anchor and positive of the pass
        raised[r["anchor"], r["slot"]] = r["score"]
    late = stored(chosen(blocks, anchors, inside(raised, lambda b: mixed(b) % FIRST != 0)))
    d = first.drop("rank").unionByName(best_rows(blocks, late, anchors, n, (raised, top)).drop("rank"))
    w = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "key", "row")
    out = stored(d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n))
    for t in (early, first, late):
        unstore(t)
    return out


def mine(vectors: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label", scale: int = SCALE, n_positives: int = POSITIVES,
         n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, rows: int = ROWS, per_pass: int = ANCHORS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``; ``anchor`` says which rows are anchors
    (null counts as not)."""
    spark = vectors.sparkSession
    own = F.col(label) if isinstance(label, str) else label
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    good = usable(F.col(vector), own, F.col(key), scale)
    d = vectors.where(good).select(F.col(key).cast("long").alias("key"), own.cast("long").alias("label"),
                                   F.transform(F.col(vector), lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("x"))
    d = stored(on_curve(d))
    # The key and the components part equal places, so that a very common vector is no single range.
    order = ["dims", "place", "key", "x"]
    d = stored(d.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id()))
    blocks = stored(blocks_of(d.sortWithinPartitions("row"), rows))
    is_anchor = vectors.where(good & F.coalesce(anchor, F.lit(False))).select(F.col(key).cast("long").alias("key")).distinct()
    some = stored(numbered(d.join(is_anchor, "key", "left_semi").select("key", "label", "x", "row", "dims"), ["dims", "row"], "number"))
    total = some.count()
    out = []
    for start in range(0, total, per_pass):  # a bounded number of anchors at a time
        part = some.where(F.col("number").between(start, start + per_pass - 1)).orderBy("number").collect()
        for dims in sorted({r["dims"] for r in part}):
            out.append(one_pass(blocks, [r for r in part if r["dims"] == dims], n_positives, n_negatives, low, high))
    unstore(d)
    if not out:
        return spark.createDataFrame([], kind)
    done = out[0]
    for o in out[1:]:
        done = done.unionByName(o)
    return done


def one_pass(blocks: DataFrame, rows: list, n_positives: int, n_negatives: int, low: int, high: int) -> DataFrame:
    """The result for a bounded list of anchors of one length."""
    anchors = Anchors(rows)
    close = positives(blocks, anchors, n_positives)
    scores = np.full((len(rows), n_positives), _LEAST)
    for r in close.select("anchor", "rank", "score").collect():  # positives of the anchors of the pass
        scores[r["anchor"], r["rank"] - 1] = r["score"]
    far = negatives(blocks, anchors, scores, n_negatives, low, high)
    names = blocks.sparkSession.createDataFrame([(i, int(k)) for i, k in enumerate(anchors.key)], "anchor int, anchor_id long")
    p = close.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("key").alias("positive_id"), F.col("score").alias("positive_score"))
    d = far.select("anchor", "slot", F.col("key").alias("negative_id"), F.col("score").alias("negative_score"), "rank").join(p, ["anchor", "slot"])
    d = d.join(F.broadcast(names), "anchor")  # at most the anchors of a pass
    return d.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
