"""Order-preserving dictionary of string identifiers.

Iterative graph plans shuffle their identifiers in every round; eight-byte
codes that sort like the strings keep those shuffles small and let minima over
codes stand for minima over strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.runtime import Workspace


def build(ids: DataFrame, ws: Workspace, tag: str = "dict") -> DataFrame:
    """``id, code`` for the distinct non-null values of the only column of
    ``ids``.  A range-partitioned sort numbers partitions in order, so codes
    sort as the strings do (by code point); the table is written once because
    its ranges come from a sample."""
    ids = ids.toDF("id").where("id is not null").distinct()
    return ws.cut(ids.orderBy("id").withColumn("code", F.monotonically_increasing_id()), tag)
