"""Helpers of the training-data operators: tables, shared storage, Arrow mapping, row numbers, components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where none is named, one in the warehouse: executors share no local
    folders."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch").rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: later stages never replay its plan, and a
    lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstore(df: DataFrame) -> None:
    """Delete the files behind a ``stored`` table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of steps that are stored and done: it does so when the driver's JVM collects
    garbage, which in a short job may come too late for the disks."""
    spark.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of a batch that a worker holds, where the session names no bound: a batch of whole texts has no other
    one than its number of rows."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def give_back() -> None:
    """Return a worker's free memory to the machine at the end of a task, as the worker lives on through later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # there in glibc only
    if trim:
        trim(0)


def map_batches(df: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """``mapInArrow`` with a function made once per task, applied batch by batch: it gives a table or several
    (Spark bounds a batch in rows and bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for b in batches:
            out = step(b)
            for part in [out] if isinstance(out, pa.Table | pa.RecordBatch) else out:
                yield from part.to_batches() if isinstance(part, pa.Table) else [part]
        del step
        give_back()

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Gapless row numbers from 0 over all rows in the given order: ranges are sorted in parallel, and only one count
    per range meets in one place."""
    d = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    d = stored(d)
    part = F.shiftright("__m", 33)
    sizes = d.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__p", F.coalesce(before, F.lit(0)).alias("__start"))
    # One row per range partition: bounded by the number of shuffle partitions.
    d = d.withColumn("__p", part).join(F.broadcast(starts), "__p")
    local = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    return d.withColumn(name, F.col("__start") + local).drop("__m", "__p", "__start")


def link_components(links: DataFrame) -> DataFrame:
    """``node, component`` (smallest reachable id) of every node that has a link; ``links`` has ``src, dst`` longs.

    Alternating star contraction: each round points every node at the smallest neighbour it can see. Sums over a
    node's links are combined before the shuffle, so a hub does not meet its links in one task. The table is stored
    once per round, and the number of rounds grows with the logarithm of the longest path.
    """
    links = links.where("src <> dst")
    both = links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    edges = stored(both.distinct())
    label = edges.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("c"))
    label = stored(label.select(F.col("src").alias("node"), "c"))
    while True:
        seen = edges.join(label.select(F.col("node").alias("dst"), "c"), "dst").groupBy("src").agg(F.min("c").alias("m"))
        new = label.join(seen.withColumnRenamed("src", "node"), "node", "left").select("node", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        # A label's own best label, and what any member of its group has learnt: paths halve, and whole groups move together.
        hook = new.groupBy(F.col("old").alias("h")).agg(F.min("c").alias("hc"))
        new = new.join(hook, F.col("c") == F.col("h"), "left").select("node", "old", F.least("c", "hc").alias("c"))
        new = stored(new)
        moved = not new.where("c <> old").isEmpty()
        unstore(label)
        label = new.select("node", "c")
        if not moved:
            unstore(edges)
            return label.withColumnRenamed("c", "component")
