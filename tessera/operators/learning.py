"""Training data from distance vectors, and a decision tree on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.aggregate import is_trivial
from tessera.operators.alignment import canonical

# Place in the vector of thirteen -> threshold of its measure alone.
THRESHOLDS = {5: 0.430, 7: 0.144, 8: 0.087, 9: 0.165, 11: 0.144, 12: 0.500}


def training_data(vectors: DataFrame, reference: DataFrame, thresholds: dict[int, float] | None = None) -> DataFrame:
    """``e1, e2, dist, label`` (1 / 0): the reference's pairs that aren't found
    at distance 0 by every thresholded measure, and the others that pass some
    threshold.  Missing distances pass none."""
    thresholds = THRESHOLDS if thresholds is None else thresholds
    ref = canonical(reference).select("a", "b").distinct().withColumn("r", F.lit(1))
    rows = canonical(vectors).join(ref, ["a", "b"], "left")
    passes = F.lit(False)
    for k, t in thresholds.items():
        passes = passes | F.coalesce(F.get("dist", F.lit(k)) <= t, F.lit(False))
    weights = [1.0 if k in thresholds else 0.0 for k in range(max(thresholds) + 1)]
    some = F.exists(F.slice("dist", 1, len(weights)), lambda x: x.isNotNull())
    hard = ~(is_trivial(F.slice("dist", 1, len(weights)), weights) & some)
    return rows.where((F.col("r").isNotNull() & hard) | (F.col("r").isNull() & passes)).select(
        "e1", "e2", "dist", F.coalesce("r", F.lit(0)).cast("double").alias("label")
    )


def decision_tree(data: DataFrame, places: Sequence[int], depth: int = 5):
    """Fitted pipeline model: entropy tree over some places of the vector.
    Missing distances count as 1."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    flat = with_features(data, places)
    tree = DecisionTreeClassifier(labelCol="label", featuresCol="features", impurity="entropy", maxDepth=depth, seed=7)
    return Pipeline(stages=[VectorAssembler(inputCols=[f"d{k}" for k in places], outputCol="features"), tree]).fit(flat)


def with_features(data: DataFrame, places: Sequence[int]) -> DataFrame:
    return data.select("*", *[F.coalesce(F.get("dist", F.lit(k)), F.lit(1.0)).alias(f"d{k}") for k in places])
