"""Exact Jaccard similarity join in metric space.

The Jaccard distance is a metric on sets. Pivots cut the space into Voronoi regions; a set also goes to each region that
a partner within the threshold could call home, and pairs are looked for inside regions only.

Level 1. Unrelated documents are all at distance 1, so document pivots alone would leave them in one region. The first
pivots are therefore all one-element sets: a set x is at distance 1 - 1/|x| from each of its elements and at 1 from the
others. Its home is the first of its elements in a global order (rare ones first); the boundary window is the prefix of
|x| - t + 1 elements, where t is the smallest overlap a partner must have. Two sets within the threshold meet in at
least one region, since else they would lack more elements than the threshold allows.

Level 2. Each region takes one of its sets as pivot, and a large one a few more (their number grows with the logarithm of its
members): the sets whose prefixes hold the most shared elements, as such lie in the middle of a group of near copies, while a
much edited copy is near to few others. Exact distances to the pivots are found. Sets within the threshold are linked to the
pivot, so a dense region needs no pairs of its own.

Level 3. Regions that still hold sets of more than one component join the rest: pairs in the same component are settled,
pairs whose distances to a common pivot differ by more than the threshold are excluded by the triangle inequality, and so
are pairs whose sizes or element counts per bucket are too far apart (both are lower bounds of the distance). All other
pairs are checked exactly. Large regions are joined block by block.

Equal sets are one class from the start. Elements are 64-bit hashes of word rows, so results are exact but for their collisions. Null, empty and blank texts have an
empty set and no links; a null key has no links and a null component. Rows of one key share its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchgrid.llm.common import bounded_batches, link_components, map_batches, stored, unstore
from matchgrid.session import small_side

WORDS, PERCENT = 3, 90
#: Hash buckets whose sizes tell frequent words from rare ones: an element is as rare as its rarest word. The order affects
#: speed only.
ORDER_BITS = 18
#: Least number of buckets of the lower bound, and elements per bucket in large sets.
PROFILE, PER_BUCKET = 64, 16
#: Sets of a region (or of one pivot) that are compared exactly in one block.
BLOCK = 512
#: Members of a region whose bounds are compared in one group.
REGION = 4096
#: Members of a region from which on it has more than one pivot.
CROWD = 64
#: Bytes of text hashed at a time; a worker holds some 30 times as many.
STRETCH = 1 << 20

_RANDOM = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the number of words up to the end of each text."""
    with np.errstate(over="ignore"):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        blank = np.concatenate([[True], _BLANK[raw]])
        edge = np.flatnonzero(blank[1:] != blank[:-1])
        first, last = edge[::2], edge[1::2]  # words are raw[first:last]
        # In place, as these have eight bytes per byte of text.
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.take(_RANDOM, _LOWER[raw], out=sums[1:])
        sums[1:] *= _powers(_BASE, len(raw))
        np.cumsum(sums, out=sums)
        spans = sums[last] - sums[first]
        del sums
        word = mixed(spans * _powers(_INVERSE, len(raw))[first] + (last - first).astype(np.uint64))
        return word, np.searchsorted(first, np.cumsum([len(t) + 1 for t in texts]))


def word_rows(texts: list[bytes], words: int = WORDS, levels: np.ndarray | None = None) -> list[np.ndarray]:
    """Sorted distinct hashes of the rows of ``words`` words of each text (a shorter text: of all its words). With the
    levels of the word buckets: pairs of the hashes and of their elements' levels."""
    with np.errstate(over="ignore"):
        word, cut = hashed_words(texts)
        level = None if levels is None else levels[(word >> np.uint64(64 - ORDER_BITS)).astype(np.int64)]
        out, start = [], 0
        for stop in cut:
            w = word[start:stop]
            n = min(words, len(w))
            h = np.full(max(0, len(w) - n + 1) if n else 0, n, np.uint64)
            for j in range(n):
                h = mixed(h * _BASE + w[j : len(w) - n + 1 + j])
            if level is None:
                out.append(np.unique(h))
            else:
                h, at = np.unique(h, return_index=True)
                own = level[start:stop]
                out.append((h, np.minimum.reduce([own[at + j] for j in range(n)]) if n else own))
            start = stop
    return out


def stretches(column: pa.Array) -> Iterator[list[bytes]]:
    """The texts of a batch, a stretch of bytes at a time."""
    group, size = [], 0
    for t in column:
        raw = (t.as_py() or "").encode()
        group.append(raw)
        size += len(raw)
        if size >= STRETCH:
            yield group
            group, size = [], 0
    if group:
        yield group


def each_set(column: pa.Array, words: int, levels: np.ndarray | None = None):
    """Sets of the texts of a batch."""
    for group in stretches(column):
        yield from word_rows(group, words, levels)


def word_levels(docs: DataFrame, text: str) -> np.ndarray:
    """Levels of the hash buckets of words: the logarithm of the number of words of all texts in each, in half steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << ORDER_BITS, np.int64)
        for b in batches:
            for group in stretches(b.column(0)):
                n += np.bincount((hashed_words(group)[0] >> np.uint64(64 - ORDER_BITS)).astype(np.int64), minlength=len(n))
        at = np.flatnonzero(n)  # once per task
        for a in range(0, len(at), 50_000):
            some = at[a : a + 50_000]
            yield pa.record_batch([pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], names=["bucket", "n"])

    bounded_batches(docs.sparkSession)
    n = docs.select(F.col(text)).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    levels = np.zeros(1 << ORDER_BITS, np.uint8)
    rows = n.select("bucket", F.round(2 * F.log2("n")).cast("int").alias("level")).where("level > 0").toPandas()  # at most 2^ORDER_BITS rows
    levels[rows["bucket"].to_numpy(np.int64)] = rows["level"].to_numpy(np.int64)
    return levels


def classes_of(docs: DataFrame, key: str, text: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows ``key, n, cls`` of all documents, and one row per class of equal sets: ``cls, node, rep, n,
    prefix, profile`` (``node``: a number for the class, ``rep``: its smallest key)."""
    levels = docs.sparkSession.sparkContext.broadcast(word_levels(docs, text))  # one byte per bucket

    def make():
        def step(b: pa.RecordBatch) -> pa.Table:
            n, cls, prefix, profile = [], [], [], []
            for s, level in each_set(b.column(1), words, levels.value):
                need = len(s) - (percent * len(s) + 99) // 100 + 1 if len(s) else 0
                n.append(len(s))
                cls.append(xxhash.xxh3_128_digest(s.tobytes()))
                prefix.append(s[np.argsort(level, kind="stable")[:need]].view(np.int64))
                profile.append(packed_profile(s))
            return pa.table([b.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(profile, pa.binary())],
                            names=["key", "n", "cls", "prefix", "profile"])

        return step

    kind = docs.schema[key].dataType.simpleString()
    sets = stored(map_batches(docs.select(F.col(key).alias("key"), F.col(text)), make, f"key {kind}, n long, cls binary, prefix array<long>, profile binary"))
    used = sets.where("n > 0 and key is not null")
    classes = used.groupBy("cls").agg(F.min("key").alias("rep"), *[F.first(c).alias(c) for c in ("n", "prefix", "profile")])
    return sets.select("key", "n", "cls"), stored(classes.withColumn("node", F.monotonically_increasing_id()))


def packed_profile(elements: np.ndarray) -> bytes:
    """Elements per bucket of their last bits, in one, two or four bytes each as their size needs; the first byte says how
    many. The number of buckets is a power of two that grows with the set, so that large sets differ too."""
    size = max(PROFILE, 1 << (len(elements) // PER_BUCKET).bit_length())
    n = np.bincount((elements & np.uint64(size - 1)).astype(np.int64), minlength=size)
    width = 1 if n.max() < 1 << 8 else 2 if n.max() < 1 << 16 else 4
    return bytes([width]) + n.astype(f"<u{width}").tobytes()


class Profiles:
    """Profiles of many sets, and bounds on what two of them share."""

    def __init__(self, raws: list[bytes]):
        counts = [np.frombuffer(r, f"<u{r[0]}", offset=1).astype(np.int32) for r in raws]
        self.size = np.array([len(c) for c in counts], np.int64)
        self.coarse = np.stack([c.reshape(-1, PROFILE).sum(axis=0) for c in counts]) if counts else np.zeros((0, PROFILE), np.int32)
        self.fine = {}
        for b in np.unique(self.size[self.size > PROFILE]):
            rows = np.flatnonzero(self.size >= b)  # larger profiles fold, as buckets go by last bits
            place = np.full(len(counts), -1)
            place[rows] = np.arange(len(rows))
            self.fine[int(b)] = (place, np.stack([counts[r].reshape(-1, b).sum(axis=0) for r in rows]))

    def within(self, x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, percent: int) -> np.ndarray:
        """False only for pairs of rows ``x, y`` with ``nx, ny`` elements that cannot reach the threshold."""
        good = 100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)
        at = np.flatnonzero(good)
        for size in (PROFILE, *self.fine):
            own = np.minimum(self.size[x[at]], self.size[y[at]])
            mine = at if size == PROFILE else at[own == size]
            place, table = (np.arange(len(self.size)), self.coarse) if size == PROFILE else self.fine[size]
            for a in range(0, len(mine), 4096):
                m = mine[a : a + 4096]
                shared = np.minimum(table[place[x[m]]], table[place[y[m]]]).sum(axis=1)
                good[m] = 100 * shared >= percent * (nx[m] + ny[m] - shared)
            at = at[good[at]]
        return good


def with_profiles(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` that pass the lower bounds, with their sizes."""
    c = classes.select("node", "n")
    d = pairs.join(c.toDF("a", "na"), "a").join(c.toDF("b", "nb"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    p = classes.select("node", "profile")
    d = d.join(p.toDF("a", "pa"), "a").join(p.toDF("b", "pb"), "b").select("a", "b", "na", "nb", "pa", "pb")

    def make():
        def step(b: pa.RecordBatch) -> pa.Table:
            if not b.num_rows:
                return pa.table(b.columns[:4], names=["a", "b", "na", "nb"])
            at = np.arange(b.num_rows)
            both = Profiles(b.column(4).to_pylist() + b.column(5).to_pylist())
            good = both.within(at, at + b.num_rows, b.column(2).to_numpy(), b.column(3).to_numpy(), percent)
            return pa.table(b.columns[:4], names=["a", "b", "na", "nb"]).filter(pa.array(good))

        return step

    return map_batches(d, make, "a long, b long, na long, nb long")


def unsettled(members: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a < b`` of members of a region that lie in different components and pass all bounds, with ``s, m, na, nb``.

    Members are compared block by block: a region is cut in blocks of ``REGION`` members, and each pair of blocks is a
    group of its own. Pairs that fail a bound are never written.
    """
    n_blocks = F.ceil(F.col("m") / REGION).cast("int")
    d = members.withColumn("own", F.pmod(F.xxhash64("node", "s"), n_blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    d = d.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    d = d.select("s", "i", "j", "own", "node", "n", "m", "c", "away", "profile").repartition("s", "i", "j").sortWithinPartitions("s", "i", "j", "n")
    near = 1 - percent / 100 + 1e-9
    names = ["a", "b", "s", "m", "na", "nb"]

    def settle(t: pa.Table) -> Iterator[pa.RecordBatch]:
        s, i, j, own, node, n, m, c, away = (t.column(k).to_numpy() for k in ("s", "i", "j", "own", "node", "n", "m", "c", "away"))
        profiles = Profiles(t.column("profile").to_pylist())
        left = np.arange(len(s))
        step = 0
        while len(left):  # all rows with the row 1, 2, 3, ... places further on, as long as group and size allow
            step += 1
            left = left[left + step < len(s)]
            right = left + step
            same = (s[left] == s[right]) & (i[left] == i[right]) & (j[left] == j[right]) & (100 * n[left] >= percent * n[right])  # sizes rise
            left, right = left[same], right[same]
            good = (c[left] != c[right]) & ~(np.abs(away[left] - away[right]) > near) & ((i[left] == j[left]) | (own[left] != own[right]))
            x, y = left[good], right[good]
            ok = profiles.within(x, y, n[x], n[y], percent)
            x, y = x[ok], y[ok]
            if len(x):
                swap = node[x] > node[y]
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                yield pa.record_batch([pa.array(v, pa.int64()) for v in (node[x], node[y], s[x], m[x], n[x], n[y])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.concat_tables([*held, pa.Table.from_batches([b])])
            last = [t.column(k)[t.num_rows - 1].as_py() for k in ("s", "i", "j")]
            here = np.logical_and.reduce([t.column(k).to_numpy() == v for k, v in zip(("s", "i", "j"), last, strict=True)])
            done = int(np.argmax(here))  # the last group may go on in the next batch
            yield from settle(t.slice(0, done)) if done else []
            held = [t.slice(done)]
        if held:
            yield from settle(held[0])

    return d.mapInArrow(run, "a long, b long, s long, m long, na long, nb long")


def sets_of(docs: DataFrame, pairs: DataFrame, classes: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """``node, elements`` of the classes in ``pairs``, from the texts of their smallest keys. The list of classes is sent to
    the texts where its size allows it, so that texts need not be shuffled."""

    def make():
        def step(b: pa.RecordBatch) -> pa.Table:
            sets = list(each_set(b.column(1), words))
            mine = [i for i, c in enumerate(b.column(2).to_pylist()) if xxhash.xxh3_128_digest(sets[i].tobytes()) == c]  # a key may have more texts
            return pa.table([b.column(0).take(pa.array(mine, pa.int64())), pa.array([sets[i].view(np.int64) for i in mine], pa.list_(pa.int64()))], names=["node", "elements"])

        return step

    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    c = stored(classes.select("node", "cls", F.col("rep").alias("__rep")).join(nodes, "node", "left_semi"))
    chosen = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(small_side(c), F.col("__key") == F.col("__rep"))
    return stored(map_batches(chosen.select("node", "__text", "cls"), make, "node long, elements array<long>"))


def overlaps(pairs: DataFrame, sets: DataFrame, group: list[str]) -> DataFrame:
    """``pairs`` with ``both``, the exact size of the intersection; the members of a group travel once."""
    g = F.concat_ws(":", *group)
    p = pairs.withColumn("g", g)
    members = p.select("g", F.col("a").alias("node")).unionByName(p.select("g", F.col("b").alias("node"))).distinct().join(sets, "node").withColumnRenamed("g", "of")

    def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        at = {r: i for i, r in enumerate(right["node"])}
        flat = np.concatenate(right["elements"].to_list()) if len(right) else np.zeros(0, np.int64)
        sizes = np.array([len(x) for x in right["elements"]], np.int64)
        _, local = np.unique(flat, return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        out = np.zeros(len(left), np.int64)
        mark = np.zeros(int(local.max(initial=-1)) + 1, bool)
        ib = left["b"].map(at).to_numpy()
        for a, rows in left.groupby("a").indices.items():
            own = local[starts[at[a]] : starts[at[a] + 1]]
            mark[own] = True
            for r in rows:
                j = ib[r]
                out[r] = np.count_nonzero(mark[local[starts[j] : starts[j + 1]]])
            mark[own] = False
        left["both"] = out
        return left

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in p.schema) + ", both long"
    return p.groupBy("g").cogroup(members.groupBy("of")).applyInPandas(count, fields).drop("g")


def with_pivots(places: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Members of the regions of two or more sets, ``s, node, n, m, p`` (``m``: members, ``p``: the main pivot), and all
    pivots of the regions, ``s, pivot``. Every pivot is the best of a slice of its region, which no task holds as a whole."""
    sizes = places.groupBy("s").agg(F.count("*").alias("m")).where("m > 1")
    members = stored(places.join(sizes, "s"))
    prefix = F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + 1
    middle = members.groupBy("node").agg((F.sum("m") / F.first(prefix)).alias("shared"))
    slices = F.when(F.col("m") >= CROWD, F.floor(F.log2(F.col("m") * (2 / CROWD)))).otherwise(1).cast("int")
    best = members.join(middle, "node").withColumn("slice", F.pmod(F.xxhash64("node", "s"), slices))
    best = stored(best.groupBy("s", "slice").agg(F.max(F.struct("shared", F.col("node").alias("pivot"))).alias("best")))
    main = best.groupBy("s").agg(F.max("best").alias("best")).select("s", F.col("best.pivot").alias("p"))
    regions = stored(members.join(main, "s"))
    unstore(members)
    return regions, best.select("s", "best.pivot")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Per document ``key, n_shingles, component_id``, and the links found between classes (``a, b, both, na, nb``): all
    that join a class to its pivots, and all between classes that those leave apart."""
    rows, classes = classes_of(docs, key, text, words, percent)
    linked = 100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))
    places = classes.select("node", "n", F.explode("prefix").alias("s"))
    regions, pivots = with_pivots(places, percent)
    stars = regions.select("s", "node").join(pivots, "s").where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    stars = stored(with_profiles(stars, classes, percent))
    per_pivot = stars.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    stars = stars.join(per_pivot, "a").withColumn("k", F.pmod(F.xxhash64("b"), "blocks")).drop("blocks")
    found = stored(overlaps(stars, sets_of(docs, stars, classes, key, text, words), ["a", "k"]).drop("k"))
    links = found.where(linked)
    comp = link_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))

    share = F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
    # Distances to the pivots of a set's own regions, which its prefix bounds in number.
    away = found.groupBy(F.col("b").alias("node")).agg(F.map_from_entries(F.collect_list(F.struct("a", 1 - share))).alias("far"))
    known = classes.select("node").join(comp, "node", "left").join(away, "node", "left").select("node", F.coalesce("component", "node").alias("c"), "far")
    d = stored(regions.join(known, "node").withColumn("away", F.when(F.col("node") == F.col("p"), 0.0).otherwise(F.col("far")[F.col("p")])).drop("far", "p"))
    open_regions = d.groupBy("s").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("s")
    rest = unsettled(d.join(open_regions, "s").join(classes.select("node", "profile"), "node"), percent)
    known_pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # A pair of sets is checked in the largest region they share, so that a set travels to few regions.
    rest = rest.groupBy("a", "b").agg(F.max(F.struct("m", "s")).alias("at"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    rest = stored(rest.select("a", "b", "na", "nb", F.col("at.s").alias("s")).join(known_pairs, ["a", "b"], "left_anti"))
    here = rest.select("s", F.col("a").alias("node")).unionByName(rest.select("s", F.col("b").alias("node"))).distinct()
    rest = rest.join(here.groupBy("s").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "s")
    rest = rest.withColumn("ba", F.pmod(F.xxhash64("a"), "blocks")).withColumn("bb", F.pmod(F.xxhash64("b"), "blocks")).drop("blocks")
    more = overlaps(rest, sets_of(docs, rest, classes, key, text, words), ["s", "ba", "bb"]).where(linked).select("a", "b", "both", "na", "nb")
    # Of two pivots that met in both orders one link is kept.
    up = F.col("a") < F.col("b")
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "both", F.when(up, F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(up, F.col("nb")).otherwise(F.col("na")).alias("nb"))
    links = stored(links.distinct().unionByName(more))
    for t in (regions, pivots, stars, found, d, rest):
        unstore(t)
    comp = link_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    named = classes.select("cls", "rep", "node").join(comp, "node", "left").withColumn("c", F.coalesce("component", "node"))
    least = named.join(named.groupBy("c").agg(F.min("rep").alias("first")), "c").select("cls", "first")
    alone = F.when(F.col("key").isNotNull(), F.coalesce("first", "key"))
    out = rows.join(least, "cls", "left").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), alone.alias("component_id"))
    return out, links
