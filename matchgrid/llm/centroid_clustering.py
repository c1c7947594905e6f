"""Lloyd's clustering with the dimensions dealt out in shards.

The columns of the vectors are cut in blocks of ``BLOCK``; a shard holds one block of every vector and the same slice of
every centroid. In a round

1. each shard's tasks compute the exact partial squared distances of their slices to all centroid slices;
2. the partial distances of a vector are added over the shards (a sum per vector), and the nearest centroid is taken, the
   smaller number at a tie;
3. the assignment goes back to the shards, and each updates its own slice: sums per centroid and column, combined before
   the shuffle, then the floor of sum / count. A centroid without vectors stays.

Components are integers, ``floor(scale * x)``, so all sums are exact whatever their order. Only vectors with exactly ``dims``
components, none of them null or non-finite, are kept; so are left out those with a component beyond ``LARGEST`` in size,
whose squared distance no long can hold. The first centroids are the kept vectors with the smallest digests of their
keys; equal digests (a repeated key) follow in the order of their components, and null keys come last. With fewer vectors
than centroids there are fewer centroids. A sum of distances beyond the range of longs is null. Repeated rows are vectors of
their own; an empty table gives no rows.

The centroids (centroids x dims integers) are the only thing that meets in one place.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.llm.common import map_batches, stored, unstore

DIMS, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
#: Columns of a shard.
BLOCK = 16
#: Largest size of a component, as an integer: 64 squares of differences of such numbers fit a long.
LARGEST = 1 << 27


def usable(vector: Column, dims: int, scale: int) -> Column:
    """True for vectors that take part; never null."""
    x = lambda v: v.cast("double") * scale
    good = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(x(v)) < LARGEST)  # noqa: E731  (an infinity is larger)
    return F.coalesce((F.size(vector) == dims) & F.forall(vector, good), F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda v: F.floor(v.cast("double") * scale).cast("long"))


def first_centroids(vectors: DataFrame, n: int, seed: int = 1) -> np.ndarray:
    """The ``n`` vectors whose keys have the smallest digests."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    chosen = vectors.select(digest.alias("digest"), "x").orderBy(F.col("digest").asc_nulls_last(), "x").limit(n).collect()  # n rows
    return np.array([r["x"] for r in chosen], np.int64)


def shards(vectors: DataFrame, dims: int, block: int) -> DataFrame:
    """``shard, row, x``: one row per vector and block of columns."""
    cuts = [F.struct(F.lit(i).alias("shard"), F.slice("x", a + 1, min(block, dims - a)).alias("x")) for i, a in enumerate(range(0, dims, block))]
    d = vectors.select("row", F.explode(F.array(*cuts)).alias("s")).select("s.shard", "row", "s.x")
    return stored(d)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def partial_distances(parts: DataFrame, centroids: np.ndarray, block: int) -> DataFrame:
    """``row, p0, p1, ...``: squared distances of a block of a vector to the same slice of every centroid."""
    k = len(centroids)
    names = [f"p{j}" for j in range(k)]

    def make():
        def step(b: pa.RecordBatch) -> list[pa.Table]:
            out, shard = [], b.column(0).to_numpy()
            for s in np.unique(shard):  # a batch may end one shard and begin the next
                mine = b.filter(pa.array(shard == s))
                x, c = matrix(mine.column(2)), centroids[:, s * block : (s + 1) * block]
                far = [pa.array(((x - c[j]) ** 2).sum(axis=1), pa.int64()) for j in range(k)]
                out.append(pa.table([mine.column(1), *far], names=["row", *names]))
            return out

        return step

    return map_batches(parts, make, "row long, " + ", ".join(f"{n} long" for n in names))


def assigned(parts: DataFrame, centroids: np.ndarray, block: int) -> DataFrame:
    """``row, cluster, distance`` of every vector: partial distances added, the nearest centroid taken."""
    k = len(centroids)
    d = partial_distances(parts, centroids, block).groupBy("row").agg(*[F.sum(f"p{j}").alias(f"p{j}") for j in range(k)])
    best = F.least(*[F.struct(F.col(f"p{j}").alias("distance"), F.lit(j).alias("cluster")) for j in range(k)]) if k > 1 else F.struct(F.col("p0").alias("distance"), F.lit(0).alias("cluster"))
    return d.select("row", best.alias("b")).select("row", "b.cluster", "b.distance")


def updated(parts: DataFrame, labels: DataFrame, centroids: np.ndarray, block: int) -> np.ndarray:
    """New centroids: each shard floors the mean of its own columns over the vectors of each centroid."""
    k = len(centroids)

    def make():
        def step(b: pa.RecordBatch) -> pa.Table:
            group = b.column(0).to_numpy() * k + b.column(1).to_numpy()
            rows = []
            for g in np.unique(group):
                mine = b.filter(pa.array(group == g))
                # Whole sums may leave the range of longs, so their halves travel apart.
                x = matrix(mine.column(2))
                rows.append((g // k, g % k, mine.num_rows, (x >> 16).sum(axis=0), (x & 0xFFFF).sum(axis=0)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            return pa.table([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=["shard", "cluster", "n", "high", "low"])

        return step

    d = parts.join(labels.select("row", "cluster"), "row").select("shard", "cluster", "x")
    sums = map_batches(d, make, "shard int, cluster int, n long, high array<long>, low array<long>")
    sums = sums.select("shard", "cluster", "n", F.posexplode(F.arrays_zip("high", "low")).alias("column", "s"))
    sums = sums.groupBy("shard", "cluster", "column").agg(F.sum("n").alias("n"), F.sum("s.high").alias("high"), F.sum("s.low").alias("low"))
    new = centroids.copy()
    for r in sums.collect():  # at most one row per centroid and column
        new[r["cluster"], r["shard"] * block + r["column"]] = ((r["high"] << 16) + r["low"]) // r["n"]
    return new


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = DIMS, centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE,
            block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """``key, cluster, distance`` per kept row after ``rounds`` rounds and a last assignment, and the final centroids."""
    d = vectors.where(usable(F.col(vector), dims, scale))
    d = stored(d.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), integers(F.col(vector), scale).alias("x")))
    middle = first_centroids(d, centroids)
    if not len(middle):
        return d.select(F.col("key").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), middle
    parts = shards(d, dims, block)
    for _ in range(rounds):
        labels = stored(assigned(parts, middle, block))
        middle = updated(parts, labels, middle, block)
        unstore(labels)
    labels = assigned(parts, middle, block)
    return stored(d.select("row", F.col("key").alias(key)).join(labels, "row").select(key, "cluster", "distance")), middle


def report(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Every kept row with its cluster, squared distance, the sums of distances of its cluster and of all, and the digest of
    its centroid."""
    d, middle = cluster(vectors, key, vector)
    spark = d.sparkSession
    digests = [(j, hashlib.sha256(",".join(map(str, m)).encode()).hexdigest()) for j, m in enumerate(middle.tolist())]
    names = spark.createDataFrame(digests, "number int, centroid_sha256 string")
    # One row per centroid.
    sums = d.groupBy(F.col("cluster").alias("number")).agg(F.try_sum("distance").alias("cluster_inertia"))
    sums = sums.withColumn("inertia", F.try_sum("cluster_inertia").over(Window.partitionBy()))
    return d.join(F.broadcast(sums.join(names, "number")), F.col("cluster") == F.col("number")).select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
