"""Top N items within every group by a window over score and identifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the score that means "no path".
NO_PATH = 1.7976931348623157e308


def pair_scores(edges: DataFrame) -> DataFrame:
    """``from_idx, to_idx, score`` of similarity edges: the smallest ``sim.d``
    over all rows of the pair and all measures, nulls and the "no path" value
    left out.  Pairs without a score and rows with a null end are left out.  The
    minimum is taken within the row first, then map-side, then per pair."""
    kept = F.filter("sim", lambda x: x["d"].isNotNull() & (x["d"] != F.lit(NO_PATH)))
    best = F.array_min(F.transform(kept, lambda x: x["d"]))
    return (
        edges.select("from_idx", "to_idx", best.alias("d"))
        .where("from_idx is not null and to_idx is not null and d is not null")
        .groupBy("from_idx", "to_idx")
        .agg(F.min("d").alias("score"))
    )


def top_n(df: DataFrame, group: str, score: str, item: str, n: int) -> DataFrame:
    """The ``n`` rows of the smallest ``score`` in each ``group``, equal scores
    by the smaller ``item``, with their ``rank``; all rows of a smaller group.

    The filter on ``row_number`` lets the optimiser put a group limit before the
    shuffle, so a task sends at most ``n`` rows of a group, and one after it.
    Null scores come last, null groups are one group; rows that tie in score and
    item are ranked in an undefined order among themselves.
    """
    w = Window.partitionBy(group).orderBy(F.col(score).asc_nulls_last(), F.col(item).asc_nulls_last())
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
