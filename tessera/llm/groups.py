"""Consolidating pairwise matches into groups: alternating star rewrites.

Large-star links every larger neighbour of a node to the smallest node of its
neighbourhood; small-star does the same with the smaller neighbours.  Both keep
the connected components and, alternated until the links stay as they are,
leave every record linked to its component's minimum.

A round is an aggregation (combined map-side, so a hub with a third of all
links is no hot task) and an equi-join of the links with one row per node,
which AQE may split on skew.  Links are pairs of eight-byte codes that sort
like the identifiers; each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans import dictionary
from tessera.plans.runtime import Workspace

MOST_ROUNDS = 200


def large_star(links: DataFrame) -> DataFrame:
    """Links ``a, b`` (any order) -> ``a > b``: each neighbour larger than the
    node, linked to the minimum of the node and its neighbours."""
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Links ``a > b`` -> each node and its smaller neighbours, linked to the
    minimum of these neighbours."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def groups(pairs: DataFrame) -> DataFrame:
    """``record, group_id`` for every non-null identifier in the columns ``e1``
    and ``e2`` of ``pairs``.

    Rows with two ends link them, whatever else they hold; a row with one end
    names a record only; equal ends, repeated rows and either order change
    nothing.  ``group_id`` is the smallest identifier (by code point) of the
    group; a record without links is its own group.  Empty strings are
    identifiers.  Other columns are ignored; no pairs give no rows.
    """
    ws = Workspace(pairs.sparkSession, "groups")
    pairs = ws.cut(pairs.select("e1", "e2").distinct(), "pairs")
    words = dictionary.build(pairs.select("e1").unionAll(pairs.select("e2")), ws)
    links = (
        pairs.where("e1 <> e2")
        .join(words.toDF("e1", "a"), "e1")
        .join(words.toDF("e2", "b"), "e2")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    links = ws.cut(links, "links")
    size, before = F.struct(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))), None
    for k in range(MOST_ROUNDS):
        now = tuple(links.agg(size).first()[0])
        if now == before or not now[0]:
            break
        before = now
        nxt = ws.cut(small_star(ws.cut(large_star(links), f"large{k}")), f"small{k}")
        ws.drop(f"large{k}", *([f"small{k - 1}"] if k else ["links"]))
        links = nxt
    else:
        raise RuntimeError("no fixed point")
    leaders = links.select("b").distinct().join(words.select(F.col("code").alias("b"), F.col("id").alias("g")), "b")
    named = links.join(leaders, "b").select("a", "g")
    return words.join(named.withColumnRenamed("a", "code"), "code", "left").select(
        F.col("id").alias("record"), F.coalesce("g", "id").alias("group_id")
    )
