"""Similarity flooding over pairwise connectivity graphs, as joins and sums.

Graphs are edge tables ``src, dst``; pairs are ``x`` (first graph) and ``y``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.runtime import Workspace

RESIDUAL = 1e-4
ROUNDS = 20


def connectivity(g1: DataFrame, g2: DataFrame, keep: DataFrame | None = None, label: str | None = None) -> DataFrame:
    """Edges ``x, y -> x2, y2`` for every edge of the one and of the other graph.

    Their number is the product of the graphs' by definition; ``keep`` (``x,
    y``) restricts both ends to given pairs by joins, without ever making the
    product, and ``label`` names an edge column that must agree."""
    a = g1.select(F.col("src").alias("x"), F.col("dst").alias("x2"), *([F.col(label).alias("l")] if label else [])).distinct()
    b = g2.select(F.col("src").alias("y"), F.col("dst").alias("y2"), *([F.col(label).alias("l")] if label else [])).distinct()
    on = ["l"] if label else []
    if keep is not None:
        pairs = keep.select("x", "y").distinct()
        made = pairs.join(a, "x").join(b, ["y", *on])
        return made.join(pairs.toDF("x2", "y2"), ["x2", "y2"], "left_semi").select("x", "y", "x2", "y2")
    if label:
        return a.join(b, "l").select("x", "y", "x2", "y2")
    # every edge with every edge: spread one side over buckets so that it's an equi-join
    n = 16
    left = a.withColumn("k", F.pmod(F.xxhash64("x", "x2"), F.lit(n)))
    right = b.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    return left.join(right, "k").select("x", "y", "x2", "y2")


def propagation(pcg: DataFrame) -> DataFrame:
    """Edges ``x, y -> x2, y2, w`` both ways, each node's weight shared evenly
    over its edges of one direction: 1 / out-degree along, 1 / in-degree back;
    what two edges bring between the same nodes is summed."""
    out = Window.partitionBy("x", "y")
    back = Window.partitionBy("x2", "y2")
    rows = pcg.withColumn("fw", 1 / F.count("*").over(out)).withColumn("bw", 1 / F.count("*").over(back))
    both = rows.select("x", "y", "x2", "y2", F.col("fw").alias("w")).unionAll(
        rows.select(F.col("x2").alias("x"), F.col("y2").alias("y"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("bw").alias("w"))
    )
    return both.groupBy("x", "y", "x2", "y2").agg(F.sum("w").alias("w"))


def flood(pg: DataFrame, start: DataFrame, rounds: int = ROUNDS, eps: float = RESIDUAL) -> DataFrame:
    """``x, y, sim``: fixed point of ``s = (s0 + s + T s) / max``.

    ``start`` gives ``x, y, s0``; pairs of the graph that it lacks start at 0.
    Ends after ``rounds`` or when the Euclidean change falls below ``eps``."""
    ws = Workspace(pg.sparkSession, "flood")
    pg = ws.cut(pg, "pg")
    ends = pg.select("x", "y").unionAll(pg.select("x2", "y2")).distinct()
    base = ws.cut(ends.unionAll(start.select("x", "y")).distinct().join(start, ["x", "y"], "left").select("x", "y", F.coalesce("s0", F.lit(0.0)).alias("s0")), "base")
    cur = ws.cut(base.withColumn("s", F.col("s0")), "s0")
    for k in range(rounds):
        got = cur.select("x", "y", "s").join(pg, ["x", "y"]).groupBy(F.col("x2").alias("x"), F.col("y2").alias("y")).agg(F.sum(F.col("s") * F.col("w")).alias("in"))
        raw = ws.cut(cur.join(got, ["x", "y"], "left").select("x", "y", "s0", F.col("s").alias("old"), (F.col("s0") + F.col("s") + F.coalesce("in", F.lit(0.0))).alias("r")), f"raw{k}")
        top = raw.agg(F.max("r")).first()[0]
        nxt = ws.cut(raw.select("x", "y", "s0", "old", (F.col("r") / F.lit(float(top or 1.0))).alias("s")), f"s{k + 1}")
        change = nxt.agg(F.sqrt(F.sum((F.col("s") - F.col("old")) ** 2))).first()[0]
        ws.drop(f"raw{k}", f"s{k}")
        cur = nxt
        if change is None or change < eps:
            break
    return cur.select("x", "y", F.col("s").alias("sim"))


def similarity_flooding(g1: DataFrame, g2: DataFrame, start: DataFrame, keep: DataFrame | None = None, rounds: int = ROUNDS, eps: float = RESIDUAL) -> DataFrame:
    return flood(propagation(connectivity(g1, g2, keep)), start, rounds, eps)
