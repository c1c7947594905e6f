"""Sharding by extendible hashing, with DataFrame operations only.

A directory is indexed by the leading bits of a hash of the key. A bucket that is over its byte limit is split on the
next bit, the others stay, until every shard fits. Splits are settled eight bits at a time from sums, never by moving
rows: a bucket's sum at every depth follows from the sums at the deepest one.

A row larger than the limit is a shard of its own. Rows of one key share all bits of its hash; after those, the bits of a
row number decide, so even a third of all rows under one key is spread. Null keys count as the empty text, null texts as
no bytes. An empty table has no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchgrid.llm.common import stored

STEP = 8
#: Bits of the key's checksum; those of the row number's checksum follow.
KEY_BITS = 128


def _bits(value: Column) -> Column:
    return F.lpad(F.bin(value), STEP, "0")


def _all_bits(checksum: Column) -> Column:
    digits = F.transform(F.sequence(F.lit(1), F.lit(KEY_BITS // 4), F.lit(2)), lambda i: _bits(F.conv(F.substring(checksum, i, F.lit(2)), 16, 10).cast("int")))
    return F.array_join(digits, "")


def shards(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, shard, depth, shard_bytes, shard_docs`` per row; ``shard`` is the bit prefix (root: empty)."""
    rows = docs.select(F.col(key), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"))
    rows = stored(rows.withColumn("__row", F.monotonically_increasing_id()))
    left = rows.withColumn("__k", F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))).withColumn("__label", F.lit(""))
    done = None
    while True:
        # The bits after a row's label: a label of a lone key may be longer than the others of its round.
        at = (F.length("__label") / 4).cast("int") + 1
        digits = F.concat("__k", F.md5(F.col("__row").cast("string")))
        left = left.withColumn("__v", F.conv(F.substring(digits, at, F.lit(2)), 16, 10).cast("int"))
        leaves = left.groupBy("__label", "__v").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("c"), F.min("__k").alias("k"), F.max("__k").alias("other"))
        leaves = stored(leaves)
        depths = F.explode(F.sequence(F.lit(0 if done is None else 1), F.lit(STEP)))
        every = leaves.select("__label", "__v", "b", "c", depths.alias("d")).withColumn("p", F.substring(_bits(F.col("__v")), F.lit(1), F.col("d")))
        sums = every.groupBy("__label", "d", "p").agg(F.sum("b").alias("shard_bytes"), F.sum("c").alias("shard_docs"))
        fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1))
        # The shallowest bucket that fits is the shard: all above it were split.
        best = every.join(fits, ["__label", "d", "p"]).groupBy("__label", "__v").agg(
            F.min(F.struct("d", "p", "shard_bytes", "shard_docs")).alias("s"))
        # A lone key's rows part no earlier than at its last bit, so the splits up to there are taken at once.
        deeper = F.concat("__label", _bits(F.col("__v")))
        lone = (F.col("k") == F.col("other")) & (F.length("__label") < KEY_BITS)
        goes_on = F.when(lone, _all_bits(F.col("k"))).otherwise(deeper)
        best = stored(leaves.join(best, ["__label", "__v"], "left").select("__label", "__v", "s", goes_on.alias("__next")))
        over = not best.where("s is null").isEmpty()
        placed = left.join(best, ["__label", "__v"])
        placed = stored(placed) if over else placed
        mine = placed.where(F.col("s").isNotNull()).select(
            F.col(key), "n_bytes", F.concat("__label", F.col("s.p")).alias("shard"), (F.col("s.d") + F.length("__label")).cast("int").alias("depth"),
            "s.shard_bytes", "s.shard_docs")
        done = mine if done is None else done.unionByName(mine)
        if not over:
            return done
        left = placed.where(F.col("s").isNull()).select(F.col(key), "n_bytes", "__row", "__k", F.col("__next").alias("__label"))


def directory(assigned: DataFrame) -> DataFrame:
    """One row per shard: its depth, size and the directory slots that point to it (each slot is as deep as the deepest
    shard)."""
    one = assigned.select("shard", "depth", "shard_bytes", "shard_docs").distinct()
    deepest = one.agg(F.max("depth")).first()[0] or 0
    return one.withColumn("n_slots", F.pow(F.lit(2.0), F.lit(deepest) - F.col("depth")))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, key: str = "doc_id") -> None:
    """Documents as Parquet, one folder per shard (unique keys)."""
    docs.join(assigned.select(key, "shard"), key).write.partitionBy("shard").parquet(path)
