"""Removal of repeated strings with suffix orders built column by column.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else goes. Texts are UTF-8 bytes, matches
never cross texts, and all strings are judged on the input.

1. Texts that are equal as a whole form one class; a class of two or more is covered from end to end.
2. Every string of ``LENGTH`` bytes contains an anchor: a gram of ``GRAM`` bytes whose hash is smallest among all grams
   of the string. Equal strings have equal anchors at equal places. Only the surroundings of anchors that occur twice or
   more are looked at further: the bytes that a string holding the anchor can reach.
3. The surroundings of one anchor form a collection of aligned texts. Its suffix order is built from the last column to
   the first: each round puts one more symbol before every text, moves the texts into the order of their longer
   suffixes (stable by symbol, like the insertion into a Burrows-Wheeler transform), and updates the common prefixes of
   neighbours. A string is repeated where the common prefix with a neighbour reaches ``LENGTH``. Collections pass
   through in sorted order, batch after batch, as sequential files; only one batch of columns is in memory.

An anchor with more than ``LARGE`` surroundings is not gathered: its strings are counted by their hashes, which combines
before the shuffle and gives the same spans.

Null text counts as empty; texts shorter than ``LENGTH`` lose nothing unless a longer string covers them, so nothing.
Repeated rows are copies of each other. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchgrid.llm.common import map_batches, release_shuffles, stored, unstore
from matchgrid.session import BROADCAST_LIMIT_BYTES, estimated_bytes

LENGTH, GRAM = 400, 32
#: Surroundings of one anchor that are ordered together.
LARGE = 20_000
#: Surroundings whose columns are in memory at a time, unless one anchor has more.
GROUPED = 8_000
STRETCH = 1 << 21

_RANDOM = np.random.default_rng(8).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
SPANS = "cls binary, start long, stop long"


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(1, n), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes at each place that has so many after it."""
    n = len(raw)
    if n < size:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_RANDOM[raw] * _powers(_BASE, n))])
        h = (sums[size:] - sums[:-size]) * _powers(_INVERSE, n)[: n - size + 1]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def _sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    """``least`` over every ``width`` consecutive values, by doubling."""
    have = 1
    while have * 2 <= width:
        x = least(x[:-have], x[have:])
        have *= 2
    return least(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of all grams that are smallest in some string of ``length`` bytes."""
    if len(text) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    width = length - gram + 1
    found = []
    for a in range(0, len(text) - length + 1, STRETCH):  # overlapping stretches keep memory bounded in long texts
        h = gram_hashes(np.frombuffer(text, np.uint8)[a : a + STRETCH + length - 1], gram)
        low = _sliding(h, width, np.minimum)
        reach = np.zeros(len(h) + width - 1, np.uint64)
        reach[width - 1 : width - 1 + len(low)] = low
        at = np.flatnonzero(_sliding(reach, width, np.maximum) == h)
        found.append((h[at], at + a))
    h, at = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    if len(found) > 1:
        at, first = np.unique(at, return_index=True)
        h = h[first]
    return h, at


def repeated(windows: list[bytes], places: np.ndarray, group: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> list[np.ndarray]:
    """For distinct texts that hold their group's anchor at ``places``: the starts of strings of ``length`` bytes that
    another text of the group has at the same distance from the anchor. Groups must be consecutive."""
    m, width, centre = len(windows), 2 * length - gram, length - gram
    if m == 0:
        return []
    columns = np.zeros((width, m), np.uint8)
    low = (centre - places).astype(np.int64)
    high = low + np.array([len(w) for w in windows], np.int64)
    for j, w in enumerate(windows):
        columns[low[j] : high[j], j] = np.frombuffer(w, np.uint8)
    order = np.arange(m)
    same = np.concatenate([[False], group[1:] == group[:-1]])  # fixed: groups keep their places in the order
    common = np.zeros(m, np.int32)
    hits = np.zeros((centre + 1, m), bool)
    base = np.cumsum(~same).astype(np.int64) * 512
    for c in range(width - 1, -1, -1):
        symbol = columns[c][order].astype(np.int64)
        there = (low[order] <= c) & (c < high[order])
        symbol[~there] = 256
        keyed = base + symbol
        grown = common + 1
        if (keyed[1:] >= keyed[:-1]).all():
            match = np.concatenate([[False], keyed[1:] == keyed[:-1]]) & there
            common = np.where(match, grown, 0)
        else:
            moved = np.argsort(keyed, kind="stable")
            keyed, there = keyed[moved], there[moved]
            match = np.concatenate([[False], keyed[1:] == keyed[:-1]]) & there
            shared = np.zeros(m, np.int32)
            at = np.flatnonzero(match)
            lower, upper = moved[at - 1] + 1, moved[at] + 1  # old places between the two neighbours
            near = upper - lower == 1
            shared[at[near]] = grown[lower[near]]
            far = at[~near]
            if len(far):
                ends = np.stack([lower[~near], upper[~near]], axis=1).ravel()
                shared[far] = np.minimum.reduceat(np.append(grown, np.int32(0)), ends)[::2]
            common, order = shared, order[moved]
        if c <= centre:
            long = common >= length
            long[:-1] |= long[1:]  # the neighbour before is repeated as well
            hits[c, order[long]] = True
    return [np.flatnonzero(hits[low[j] :, j]) for j in range(m)]


def to_spans(starts: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """Runs of bytes covered by strings at sorted starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length) + 1
    return [(int(s[0]), int(s[-1]) + length) for s in np.split(starts, cut)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def cut_out(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in spans:
        parts.append(raw[at:a])
        at = b
    return b"".join(parts) + raw[at:]


def text_class(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def find_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, large: int = LARGE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``cls, copies, n_bytes`` of every class of equal texts, ``cls, spans`` of the classes that lose a part (classes of two
    or more long texts lose all and may be listed), and ``cls, raw, copies`` of a text of each class that shares an anchor.
    The first and the last are stored."""

    def make_anchors():
        def step(b: pa.RecordBatch) -> pa.Table:
            found = [anchors(t.as_py() or b"", length, gram) for t in b.column(1)]
            return pa.table([b.column(0), b.column(2), pa.array([len(t.as_py() or b"") for t in b.column(1)], pa.int64()),
                             pa.array([h.view(np.int64) for h, _ in found], pa.list_(pa.int64())), pa.array([p for _, p in found], pa.list_(pa.int64()))],
                            names=["cls", "key", "n_bytes", "h", "at"])

        return step

    rows = docs.select(text_class(F.col(text)).alias("cls"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("raw"), F.col(key).alias("key"))
    kind = docs.schema[key].dataType.simpleString()
    rows = map_batches(rows, make_anchors, f"cls binary, key {kind}, n_bytes long, h array<long>, at array<long>")
    classes = stored(rows.groupBy("cls").agg(F.count("*").alias("copies"), F.min("key").alias("rep"), *[F.first(c).alias(c) for c in ("n_bytes", "h", "at")]))
    places = classes.select("cls", F.explode(F.arrays_zip("h", "at")).alias("x")).select("cls", "x.h", "x.at")
    often = places.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    shared = places.join(often, "h").groupBy("cls").agg(F.collect_list(F.struct("at", "h", "m")).alias("places"))
    # Texts are read again for the classes that share an anchor: the row with the smallest key stands for its class.
    texts = docs.select(text_class(F.col(text)).alias("cls"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("raw"), F.col(key).alias("key"))
    wanted = shared.join(classes.select("cls", "copies", "rep"), "cls").withColumnRenamed("cls", "own")
    texts = stored(texts.join(wanted, (F.col("cls") == F.col("own")) & F.col("key").eqNullSafe(F.col("rep"))).select("cls", "raw", "places", "copies"))
    release_shuffles(docs.sparkSession)

    def make_windows():
        centre = length - gram

        def table(out: list[tuple]) -> pa.Table:
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
            return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["h", "digest", "off", "window", "cls", "a"])

        def step(b: pa.RecordBatch) -> Iterator[pa.Table]:
            out: list[tuple] = []
            known = set()
            for cls, raw, places in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                raw = raw.as_py()
                for p in places.as_py():
                    if p["m"] > large:
                        continue
                    a = max(0, p["at"] - centre)
                    w = raw[a : p["at"] + length]
                    off = p["at"] - a
                    digest = hashlib.blake2b(w, digest_size=16, salt=off.to_bytes(4, "little")).digest()
                    key = (p["h"], digest)
                    out.append((p["h"], digest, off, None if key in known else w, cls, a))
                    known.add(key)
                    if len(out) >= 20_000:
                        yield table(out)
                        out = []
            yield table(out)

        return step

    windows = map_batches(texts.select("cls", "raw", "places"), make_windows, "h long, digest binary, off int, window binary, cls binary, a long")
    windows = windows.repartition("h").sortWithinPartitions("h", "digest", F.col("window").isNull())
    starts = windows.mapInArrow(_ordered(length, gram), SPANS)

    def make_grams():
        centre = length - gram

        def step(b: pa.RecordBatch) -> pa.Table:
            cls, h, at = [], [], []
            for c, raw, places in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                hot = [p["at"] for p in places.as_py() if p["m"] > large]
                if hot:
                    g = gram_hashes(np.frombuffer(raw.as_py(), np.uint8), length)
                    for s in sorted({s for p in hot for s in range(max(0, p - centre), min(len(g), p + 1))}):
                        cls.append(c)
                        h.append(g[s])
                        at.append(s)
            return pa.table([pa.array(cls, pa.binary()), pa.array(np.array(h, np.uint64).view(np.int64), pa.int64()), pa.array(at, pa.int64())], names=["cls", "g", "start"])

        return step

    hot = texts.where(F.exists("places", lambda p: p["m"] > large))
    grams = map_batches(hot.select("cls", "raw", "places"), make_grams, "cls binary, g long, start long")
    twice = grams.groupBy("g").agg(F.count("*").alias("m")).where("m > 1").select("g")
    starts = starts.unionByName(grams.join(twice, "g", "left_semi").select("cls", "start", (F.col("start") + length).alias("stop")))

    gathered = starts.groupBy("cls").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    return classes.select("cls", "copies", "n_bytes"), gathered, texts.select("cls", "raw", "copies")


def _ordered(length: int, gram: int):
    """Repeated spans of the collections in a stream sorted by anchor and content."""

    def settle(rows: list[dict]) -> list[tuple[bytes, int, int]]:
        texts: list[tuple] = []  # anchor, place, bytes, occurrences
        for r in rows:
            if texts and texts[-1][0] == r["h"] and texts[-1][4] == r["digest"]:
                texts[-1][3].append((r["cls"], r["a"]))
            else:
                texts.append((r["h"], r["off"], r["window"], [(r["cls"], r["a"])], r["digest"]))
        group = np.array([t[0] for t in texts], np.int64)
        alone = np.concatenate([[True], group[1:] != group[:-1]])
        alone &= np.append(alone[1:], True)  # a collection of one distinct text needs no order
        some = np.flatnonzero(~alone)
        starts = dict(zip(some, repeated([texts[i][2] for i in some], np.array([texts[i][1] for i in some], np.int64), group[some], length, gram), strict=True))
        out = []
        for i, (_, off, w, where, _) in enumerate(texts):
            if len(where) > 1 and len(w) >= length:
                spans = [(0, len(w))]  # equal surroundings are repeated as a whole
            else:
                spans = to_spans(starts[i], length) if i in starts else []
            out += [(cls, a + s, a + e) for cls, a in where for s, e in spans]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.binary(), pa.int64(), pa.int64())

        def give(rows: list[dict]) -> pa.RecordBatch:
            cols = list(zip(*settle(rows), strict=True)) or [()] * 3
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["cls", "start", "stop"])

        held: list[dict] = []
        for b in batches:
            for a in range(0, b.num_rows, GROUPED):
                held += b.slice(a, GROUPED).to_pylist()
                last = held[-1]["h"]
                keep = len(held)
                while keep and held[keep - 1]["h"] == last:
                    keep -= 1
                if keep >= GROUPED // 2:  # whole collections only; the last one may go on
                    yield give(held[:keep])
                    held = held[keep:]
        if held:
            yield give(held)

    return run


def kept_parts(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, large: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """``cls, copies, n_bytes`` of all classes, and ``cls, n_removed, n_spans, kept`` (bytes) of those that lose a part."""
    classes, gathered, texts = find_spans(docs, key, text, length, gram, large)
    partly = gathered.join(texts.where(f"copies = 1 or octet_length(raw) < {length}").select("cls", "raw"), "cls")

    def make():
        def step(b: pa.RecordBatch) -> pa.Table:
            removed, count, kept = [], [], []
            for spans, raw in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                runs = merged([(s["start"], s["stop"]) for s in spans])
                removed.append(sum(e - s for s, e in runs))
                count.append(len(runs))
                kept.append(cut_out(raw.as_py(), runs))
            return pa.table([b.column(0), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], names=["cls", "n_removed", "n_spans", "kept"])

        return step

    return classes, map_batches(partly.select("cls", "spans", "raw"), make, "cls binary, n_removed long, n_spans long, kept binary")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, large: int = LARGE) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept_sha256`` per row."""
    classes, partly = kept_parts(docs, key, text, length, large=large)
    partly = partly.select("cls", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    d = docs.select(F.col(key), text_class(F.col(text)).alias("cls"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("own"))
    d = d.join(classes.join(partly, "cls", "left"), "cls")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    nothing = F.sha2(F.lit(""), 256)
    return d.select(
        F.col(key), "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, nothing).otherwise(F.coalesce("kept_sha256", "own")).alias("kept_sha256"))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """All columns of ``docs``, with the repeated strings cut out of ``text``; bytes of characters cut in two are dropped.

    Only rows whose class may lose something meet their spans in a shuffle, once; the digests of those classes are sent to
    the rows where their size allows it (equal digests cost a row a shuffle, nothing else).
    """
    classes, gathered, texts = find_spans(docs, key, text, length)
    gone = classes.where(f"copies > 1 and n_bytes >= {length}").select("cls", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop"))).alias("spans"))
    changed = stored(gathered.join(gone, "cls", "left_anti").unionByName(gone))
    unstore(classes)
    unstore(texts)
    release_shuffles(docs.sparkSession)

    def make():
        def step(b: pa.RecordBatch) -> pa.Table:
            at = b.schema.get_field_index(text)
            kept = []
            for t, spans in zip(b.column(at), b.column(b.num_columns - 1), strict=True):
                t, spans = t.as_py(), spans.as_py()
                kept.append(t if spans is None else cut_out((t or "").encode(), merged([(s["start"], s["stop"]) for s in spans])).decode(errors="ignore"))
            t = pa.Table.from_batches([b]).drop_columns("__spans")
            return t.set_column(at, text, pa.array(kept, pa.string()))

        return step

    d = docs.withColumn("__own", text_class(F.col(text)))
    short = stored(changed.select(F.xxhash64("cls").alias("__short")).distinct())
    small = estimated_bytes(short) <= BROADCAST_LIMIT_BYTES
    met = d.join(F.broadcast(short), F.xxhash64("__own") == F.col("__short"), "left_semi") if small else d
    met = met.join(changed.select(F.col("cls").alias("__own"), F.col("spans").alias("__spans")), "__own", "left").select(*docs.columns, "__spans")
    out = map_batches(met, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
    return out.unionByName(d.join(F.broadcast(short), F.xxhash64("__own") == F.col("__short"), "left_anti").select(*docs.columns)) if small else out
