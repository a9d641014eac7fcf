"""Alignments: sets of matchings ``e1, e2, p`` and their evaluation.

Two pairs are the same if their ends are, in either order.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.aggregate import aggregate, weights_label


def canonical(df: DataFrame) -> DataFrame:
    """Adds ``a``, ``b``: the ends in order."""
    return df.withColumn("a", F.least("e1", "e2")).withColumn("b", F.greatest("e1", "e2"))


def _keys(df: DataFrame) -> DataFrame:
    return canonical(df).select("a", "b").distinct()


def intersect(x: DataFrame, y: DataFrame) -> DataFrame:
    """Rows of ``x`` whose pair is in ``y``, whatever ``p``."""
    return canonical(x).join(_keys(y), ["a", "b"], "left_semi").drop("a", "b")


def subtract(x: DataFrame, y: DataFrame) -> DataFrame:
    """Rows of ``x`` whose pair isn't in ``y``."""
    return canonical(x).join(_keys(y), ["a", "b"], "left_anti").drop("a", "b")


def union(x: DataFrame, y: DataFrame) -> DataFrame:
    """Rows of both, equal ones once; a pair with several ``p`` stays several rows."""
    return x.select("e1", "e2", "p").unionByName(y.select("e1", "e2", "p")).distinct()


def left(x: DataFrame) -> DataFrame:
    return x.select(F.col("e1").alias("e")).distinct()


def right(x: DataFrame) -> DataFrame:
    return x.select(F.col("e2").alias("e")).distinct()


def entities(x: DataFrame) -> DataFrame:
    return x.select(F.col("e1").alias("e")).unionAll(x.select(F.col("e2").alias("e"))).distinct()


def matches_of(x: DataFrame, entity: str) -> DataFrame:
    """Rows that name ``entity`` on either side, nearest first."""
    return x.where((F.col("e1") == entity) | (F.col("e2") == entity)).orderBy("p", "e1", "e2")


def best(x: DataFrame) -> DataFrame:
    """Nearest row of each ``e1``: smallest ``p``, then smallest ``e2``."""
    w = Window.partitionBy("e1").orderBy(F.col("p").asc_nulls_last(), "e2")
    return x.select("e1", "e2", "p", F.row_number().over(w).alias("k")).where("k = 1").drop("k")


def covers(x: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``covered``: whether the alignment has the pair."""
    keys = _keys(x).withColumn("covered", F.lit(True))
    return canonical(pairs).join(keys, ["a", "b"], "left").withColumn("covered", F.coalesce("covered", F.lit(False))).drop("a", "b")


def from_distances(df: DataFrame, aggregator: str, weights: Sequence[float], t: float, dist: str = "dist", inclusive: bool = True) -> DataFrame:
    """Alignment of the pairs whose aggregated distance is at most ``t``."""
    p = aggregate(aggregator, F.col(dist), weights)
    out = df.select("e1", "e2", p.alias("p"))
    return out.where(F.col("p") <= t if inclusive else F.col("p") < t).distinct()


def f_measure(p: Column, r: Column, a: float) -> Column:
    """(1 + a) P R / (a P + R), ``a`` itself and not its square; 0 if P + R = 0."""
    return F.when(p + r > 0, (1 + a) * p * r / (a * p + r)).otherwise(0.0)


def f_beta(p: Column, r: Column, beta: float) -> Column:
    """The usual F-measure, with the square of ``beta``."""
    return f_measure(p, r, beta * beta)


def _measures(df: DataFrame) -> DataFrame:
    """Precision, recall and F-measures of ``tp, fp, fn``; 0 where undefined."""
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    df = df.withColumn("precision", p).withColumn("recall", r)
    for name, a in (("f1", 1.0), ("f2", 2.0), ("f05", 0.5)):
        df = df.withColumn(name, f_measure(F.col("precision"), F.col("recall"), a))
    return df


def statistics(x: DataFrame, reference: DataFrame) -> DataFrame:
    """One row ``tp, fp, fn, precision, recall, f1, f2, f05``: distinct pairs of
    ``x`` against those of ``reference`` in one full join; all 0 if both are empty."""
    got, ref = _keys(x).withColumn("g", F.lit(1)), _keys(reference).withColumn("r", F.lit(1))
    both = got.join(ref, ["a", "b"], "full")
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")
    g, r = F.col("g").isNotNull(), F.col("r").isNotNull()
    return _measures(both.agg(n(g & r).alias("tp"), n(g & ~r).alias("fp"), n(~g & r).alias("fn")))


#: Thresholds of a sweep in thousandths: 1, 11, ... 991.
SWEEP = list(range(1, 1000, 10))


def sweep(x: DataFrame, reference: DataFrame, thresholds: Sequence[float] | None = None) -> DataFrame:
    """``statistics`` of the pairs with ``p`` at most ``t`` for every threshold,
    in one pass: each pair is counted at the first threshold it passes, and the
    counts are summed upwards over the thresholds."""
    ts = sorted(thresholds if thresholds is not None else [k / 1000 for k in SWEEP])
    spark = x.sparkSession
    pairs = canonical(x).where("p is not null").groupBy("a", "b").agg(F.min("p").alias("p"))
    ref = _keys(reference).withColumn("r", F.lit(1))
    steps = F.array(*[F.lit(float(t)) for t in ts])
    first = F.size(F.filter(steps, lambda t: t < F.col("p")))
    counts = pairs.join(ref, ["a", "b"], "left").groupBy(first.alias("k")).agg(
        F.count("r").alias("hit"), F.count("*").alias("all")
    )
    grid = spark.createDataFrame([(k, float(t)) for k, t in enumerate(ts)], "k int, t double")
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # one row a threshold
    runs = grid.join(counts, "k", "left").select(
        "t", F.sum(F.coalesce("hit", F.lit(0))).over(w).alias("tp"), F.sum(F.coalesce("all", F.lit(0))).over(w).alias("n")
    )
    total = ref.agg(F.count("*").alias("total"))
    out = runs.join(F.broadcast(total)).select(  # one row
        "t", F.col("tp").cast("bigint").alias("tp"), (F.col("n") - F.col("tp")).cast("bigint").alias("fp"),
        (F.col("total") - F.col("tp")).cast("bigint").alias("fn"),
    )
    return _measures(out)


def progressive(x: DataFrame, reference: DataFrame, step: float = 0.001) -> DataFrame:
    """Rows of a fine sweep at which the recall rises."""
    n = round(1 / step)
    df = sweep(x, reference, [k * step for k in range(n + 1)])
    w = Window.orderBy("t")
    return df.withColumn("before", F.coalesce(F.max("recall").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).where(
        "recall > before"
    ).drop("before")


def grid_search(
    df: DataFrame, reference: DataFrame, names: Sequence[str], aggregators: Sequence[str],
    thresholds: Sequence[float], choices: Sequence[float] = (0.0, 1.0), top: int = 100, dist: str = "dist",
) -> DataFrame:
    """Best weightings of a distance vector by F0.5: every combination of
    ``choices`` and aggregators, each with all thresholds.

    One pass: a pair's aggregated distances under all weightings are exploded and
    counted by weighting and first threshold passed, so the shuffle carries
    counts, not pairs.  ``weighting, aggregator, t, tp, fp, fn, ...``, the
    ``top`` rows (a report)."""
    ts = sorted(thresholds)
    grid = [(a, ws) for a in aggregators for ws in product(choices, repeat=len(names)) if any(w > 0 for w in ws)]
    ref = _keys(reference).withColumn("r", F.lit(1))
    pairs = canonical(df).join(ref, ["a", "b"], "left")
    steps = F.array(*[F.lit(float(t)) for t in ts])

    def cell(i: int, a: str, ws: Sequence[float]) -> Column:
        p = aggregate(a, F.col(dist), ws)
        return F.struct(F.lit(i).alias("w"), F.size(F.filter(steps, lambda t: t < p)).alias("k"), p.isNotNull().alias("has"))

    cells = F.array(*[cell(i, a, ws) for i, (a, ws) in enumerate(grid)])
    counts = pairs.select("a", "b", "r", F.explode(cells).alias("c")).where("c.has").groupBy("c.w", "a", "b").agg(
        F.min("c.k").alias("k"), F.max("r").alias("r")
    ).groupBy("w", "k").agg(F.count("r").alias("hit"), F.count("*").alias("all"))
    spark = df.sparkSession
    plan = spark.createDataFrame(
        [(i, a, weights_label(names, ws), k, float(t)) for i, (a, ws) in enumerate(grid) for k, t in enumerate(ts)],
        "w int, aggregator string, weighting string, k int, t double",
    )
    win = Window.partitionBy("w").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    runs = plan.join(counts, ["w", "k"], "left").select(
        "aggregator", "weighting", "t", F.sum(F.coalesce("hit", F.lit(0))).over(win).alias("tp"), F.sum(F.coalesce("all", F.lit(0))).over(win).alias("n")
    )
    total = ref.agg(F.count("*").alias("total"))
    out = runs.join(F.broadcast(total)).select(
        "aggregator", "weighting", "t", F.col("tp").cast("bigint").alias("tp"), (F.col("n") - F.col("tp")).cast("bigint").alias("fp"),
        (F.col("total") - F.col("tp")).cast("bigint").alias("fn"),
    )
    return _measures(out).orderBy(F.desc("f05"), "aggregator", "weighting", "t").limit(top)


def split_reference(reference: DataFrame, found: DataFrame, near: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Trivial pairs of the reference (found at distance 0) and hard ones (not
    found within ``near``)."""
    trivial = intersect(reference, found.where("p <= 0"))
    hard = subtract(subtract(reference, found.where(F.col("p") <= near)), trivial)
    return trivial, hard


def compose(ab: DataFrame, ac: DataFrame) -> DataFrame:
    """B-C links from A-B and A-C links: ``e1`` (B), ``e2`` (C)."""
    return ab.select(F.col("e1").alias("k"), F.col("e2").alias("b")).join(
        ac.select(F.col("e1").alias("k"), F.col("e2").alias("c")), "k"
    ).select(F.col("b").alias("e1"), F.col("c").alias("e2")).distinct()


def coverage(x: DataFrame, subtrees: DataFrame) -> DataFrame:
    """For each ``root`` of ``root, node`` rows: nodes matched by the alignment
    (``matched``), all nodes, and their ratio."""
    named = entities(x).withColumnRenamed("e", "node").withColumn("hit", F.lit(1))
    rows = subtrees.select("root", "node").distinct().join(named, "node", "left")
    return rows.groupBy("root").agg(F.count("hit").alias("matched"), F.count("*").alias("nodes")).withColumn(
        "ratio", F.col("matched") / F.col("nodes")
    )
