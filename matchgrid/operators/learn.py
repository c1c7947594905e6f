"""Learned scorers built on the distributed learners of Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchgrid.operators.metrics import auroc


def isotonic_curve(df: DataFrame, p: str, y: str) -> DataFrame:
    """Monotone fit of ``y`` on ``p``: the step points as rows. Equal scores are averaged with their weight first."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    g = df.groupBy(p).agg(F.avg(y).alias("label"), F.count("*").cast("double").alias("weight"))
    g = VectorAssembler(inputCols=[p], outputCol="features").transform(g)
    m = IsotonicRegression(weightCol="weight").fit(g)
    rows = list(zip([float(v) for v in m.boundaries], [float(v) for v in m.predictions], strict=True))
    return df.sparkSession.createDataFrame(rows, "boundary double, precision double")


def precision_threshold(curve: DataFrame, target: float) -> DataFrame:
    return curve.where(F.col("precision") >= target).agg(F.min("boundary").alias("threshold"))


def leave_one_out(df: DataFrame, fold: str, features: Sequence[str], label: str, baseline: str, trees: int = 5) -> DataFrame:
    """AUROC of a boosted-tree scorer on each held-out fold, next to the raw score. Folds are few; rows stay distributed."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    d = VectorAssembler(inputCols=list(features), outputCol="features").transform(df)
    folds = [r[0] for r in d.select(fold).distinct().orderBy(fold).collect()]
    out = None
    for f in folds:
        m = GBTClassifier(featuresCol="features", labelCol=label, maxIter=trees, maxDepth=4, seed=7).fit(d.where(F.col(fold) != f))
        s = m.transform(d.where(F.col(fold) == f)).select(F.lit(f).alias(fold), vector_to_array("probability")[1].alias("p"), F.col(baseline).alias("__b"), F.col(label).cast("int").alias("y"))
        a = auroc(s, [fold], "p", "y").withColumnRenamed("auroc", "model_auroc")
        b = auroc(s, [fold], "__b", "y").select(fold, F.col("auroc").alias("baseline_auroc"))
        row = a.join(b, fold)
        out = row if out is None else out.unionByName(row)
    return out
