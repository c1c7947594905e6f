"""Append-only label log: numbered JSON lines per writer; torn lines are found, later lines supersede earlier ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from matchgrid.operators.logs import latest_per_key
from matchgrid.operators.ordered import global_rank

_TORN = "__torn"


def lines(rows: DataFrame, order: Sequence[str], after: int = 0) -> DataFrame:
    """The rows as JSON texts (``value``), numbered in their order from ``after`` + 1 in the field ``seq``.

    The numbers come from range partitions and their sizes, so no task holds all rows. Nulls are written out: a null verdict is
    a line that takes a label back.
    """
    d = global_rank(rows, [(c, True) for c in order], "seq").withColumn("seq", F.col("seq").cast("long") + after)
    return d.select(F.to_json(F.struct("seq", *rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def append_lines(values: DataFrame, folder: str, writer: str) -> None:
    values.select("value").write.mode("append").text(f"{folder}/writer={writer}")


def append(rows: DataFrame, folder: str, writer: str, order: Sequence[str]) -> None:
    """Append rows to one writer's log. A writer appends one batch at a time; different writers need not wait for each other.

    A failed append leaves no line, as files appear when the job commits; lines that were written are never changed.
    """
    append_lines(lines(rows, order, last_number(rows.sparkSession, folder, writer)), folder, writer)


def last_number(spark: SparkSession, folder: str, writer: str) -> int:
    """The largest number a writer has given to a whole line, 0 at first. A torn line's number is given again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/writer={writer}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return 0
    return read(spark, folder, "seq long").where(F.col("writer") == writer).agg(F.max("seq")).first()[0] or 0


def read(spark: SparkSession, folder: str, schema: str | StructType) -> DataFrame:
    """All lines: ``writer, seq``, the columns of ``schema`` and ``torn``. A line is torn if it is no whole JSON object or has no
    number; blank lines are none. A field that is missing or of another kind is null, the line is still whole if it parses."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = [f.name for f in kind if f.name != "seq"]
    full = StructType([StructField("seq", LongType()), *[f for f in kind if f.name != "seq"], StructField(_TORN, StringType())])
    d = spark.read.schema("value string, writer string").option("basePath", folder).text(folder).where("trim(value) <> ''")
    row = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _TORN})
    d = d.select("writer", row.alias("r"))
    torn = F.col("r").isNull() | F.col(f"r.{_TORN}").isNotNull() | F.col("r.seq").isNull()
    return d.select("writer", F.when(~torn, F.col("r.seq")).alias("seq"), *[F.col(f"r.{c}").alias(c) for c in names], torn.alias("torn"))


def live(log: DataFrame, keys: Sequence[str], value: str, order: Sequence[str] = ("ts", "writer", "seq")) -> DataFrame:
    """The last whole line of each key, unless it takes the label back. Lines that were read twice count once."""
    return latest_per_key(log.where("NOT torn").drop("torn"), keys, order).where(F.col(value).isNotNull())


def health(log: DataFrame) -> DataFrame:
    """Per writer: lines, torn lines, and numbers below the largest one that no whole line has."""
    return log.groupBy("writer").agg(F.count("*").alias("n_lines"), F.count_if("torn").alias("n_torn"), (F.coalesce(F.max("seq"), F.lit(0)) - F.countDistinct("seq")).alias("n_missing"))
