"""Parent-child links to full hierarchies, by hash splitters.

Every node has at most one parent, so the links form trees and cycles.  A node
is a splitter if a hash of its identifier says so (about one in ``every``) or
if it has no parent.

1. Walk: each node finds its next splitter by pointer doubling that stops
   there, carrying the exact nodes it passed.  Gaps between splitters are short
   (geometric), so a few rounds do, whatever the depth of the trees.
2. Reduce: splitters point to their next splitter; doubling over this graph, a
   fraction ``1/every`` of the nodes, finds roots, depths and cycles.
3. Expand: a node's result is its splitter's plus its own walk.
Nodes that pass no splitter within the walk (cycles without one, rare long
gaps) are solved among themselves first.

All rounds are equi-joins on eight-byte codes between tables written to the
shared folder; the pointed-to side is unique, so AQE may split a hot parent.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans import dictionary
from tessera.plans.runtime import Workspace

SPLIT_EVERY = 8


def _spark(df: DataFrame) -> SparkSession:
    return df.sparkSession


def _double(ws: Workspace, start: DataFrame, tag: str, rounds: int | None) -> tuple[DataFrame, int, int]:
    """Pointer doubling over ``v, tgt, dist, mn, done``: rows that are done keep
    their target, others take their target's.  Ends when none is active, after
    ``rounds``, or once the steps taken exceed the active rows, when only rows
    that never end are left.  Returns the table, its active count, its round."""
    cur, r = ws.cut(start, f"{tag}0"), 0
    last = False
    while True:
        active = cur.where("not done").count()
        if not active or last or (rounds is not None and r >= rounds):
            return cur, active, r
        last = rounds is None and (1 << r) > active
        to = cur.select(
            F.col("v").alias("k"), F.col("tgt").alias("t2"), F.col("dist").alias("d2"),
            F.col("mn").alias("m2"), F.col("done").alias("e2"),
            *([F.col("path").alias("p2")] if "path" in cur.columns else []),
        )
        # only active rows go to their target; the others stay as they are
        nxt = cur.where("not done").withColumn("k", F.col("tgt")).join(to, "k", "left")
        hit = F.col("t2").isNotNull()
        cols = [
            F.col("v"),
            F.when(hit, F.col("t2")).otherwise(F.col("tgt")).alias("tgt"),
            F.when(hit, F.col("dist") + F.col("d2")).otherwise(F.col("dist")).alias("dist"),
            F.when(hit, F.least("mn", "m2")).otherwise(F.col("mn")).alias("mn"),
            F.when(hit, F.col("e2")).otherwise(F.col("done")).alias("done"),
        ]
        if "path" in cur.columns:
            cols.append(F.when(hit, F.concat("path", "p2")).otherwise(F.col("path")).alias("path"))
        cur = ws.cut(nxt.select(cols).unionByName(cur.where("done")), f"{tag}{r + 1}")
        if r:
            ws.drop(f"{tag}{r}")
        r += 1


def resolve(links: DataFrame, split_every: int = SPLIT_EVERY) -> tuple[DataFrame, DataFrame, DataFrame, Workspace]:
    """Solve ``child, parent`` links in codes.

    Returns ``(nodes, solved, dict, workspace)``: ``nodes`` ``v, parent``;
    ``solved`` ``v, root, depth`` with depth -1 on a cycle and -2 below one, and
    the walk ``tgt, path`` to the next splitter (null where there is none);
    ``dict`` ``id, code``.
    """
    spark = _spark(links)
    ws = Workspace(spark, "hierarchy")
    links = links.select(F.col("child").alias("c"), F.col("parent").alias("p")).where(
        "c is not null and not rlike(c, '^\\\\s*$')"
    )
    links = links.select("c", F.when(~F.col("p").rlike(r"^\s*$"), F.col("p")).alias("p")).distinct()
    links = ws.cut(links, "links")
    words = dictionary.build(links.select("c").unionAll(links.select("p")), ws)
    # the lowest bit of a code tells whether the identifier's hash makes it a splitter
    is_split = (F.pmod(F.xxhash64("id"), F.lit(split_every)) == 0).cast("long")
    words = words.select("id", (F.col("code") * 2 + is_split).alias("code"))
    kids = links.where("p is not null").join(words.toDF("c", "v"), "c").join(words.toDF("p", "parent"), "p")
    # a child named twice with different parents keeps the smallest one
    nodes = (
        kids.select("v", "parent")
        .unionAll(words.select(F.col("code").alias("v"), F.lit(None).cast("long").alias("parent")))
        .groupBy("v")
        .agg(F.min("parent").alias("parent"))
    )
    nodes = ws.cut(nodes, "nodes")
    n = nodes.count()

    def chosen(c):
        return F.col(c).bitwiseAND(F.lit(1)) == 1

    start = nodes.select(
        "v",
        F.coalesce("parent", "v").alias("tgt"),
        F.col("parent").isNotNull().cast("long").alias("dist"),
        F.col("v").alias("mn"),
        (F.col("parent").isNull() | chosen("parent")).alias("done"),
        F.when(F.col("parent").isNotNull(), F.array("v")).otherwise(F.array().cast("array<bigint>")).alias("path"),
    )
    # walks longer than any gap to be expected are left to _unsplit, so paths stay short
    rounds = min(10, math.ceil(math.log2(split_every * (math.log(max(n, 2)) + 12))))
    walked, active, _ = _double(ws, start, "walk", rounds)
    walked = walked.withColumn("oncyc", F.lit(False)).withColumn("cyc", F.lit(None).cast("long"))
    if active:
        # no splitter within the walk: solve these among themselves
        walked = _unsplit(ws, walked, nodes)
    # reduced graph: hash splitters and roots; it also ends at splitters from
    # which the way up meets only a cycle without splitters
    stop = (F.col("dist") == 0) | F.col("cyc").isNotNull()
    red = walked.where((F.col("dist") == 0) | chosen("v")).select(
        "v",
        F.when(stop, F.col("v")).otherwise(F.col("tgt")).alias("tgt"),
        F.when(stop, 0).otherwise(F.col("dist")).cast("long").alias("dist"),
        "mn",
        stop.alias("done"),
    )
    red, left, _ = _double(ws, red, "red", None)
    ends = red.select(F.col("v").alias("s"), F.col("tgt").alias("s_end"), F.col("dist").alias("s_dist"))
    rings = walked.where(F.col("cyc").isNotNull() & chosen("v")).select(
        F.col("v").alias("s_end"), F.col("cyc").alias("s_cyc")
    )
    marks = rings
    members = None
    if left:
        on = red.where("not done").select(F.col("tgt").alias("v")).distinct()
        on = ws.cut(on.join(red.select("v", "mn"), "v"), "oncycle")
        marks = marks.unionByName(on.select(F.col("v").alias("s_end"), F.col("mn").alias("s_cyc")))
        members = (
            on.join(walked.select("v", "path"), "v").select(F.explode("path").alias("v"), F.lit(True).alias("member")).distinct()
        )
    ends = ws.cut(ends.join(marks, "s_end", "left"), "ends")
    all_ = walked.withColumn("s", F.when(F.col("cyc").isNull(), F.col("tgt"))).join(ends, "s", "left")
    if members is not None:
        all_ = all_.join(members, "v", "left")
    else:
        all_ = all_.withColumn("member", F.lit(None).cast("boolean"))
    loop = F.coalesce("cyc", "s_cyc")
    on_it = F.col("oncyc") | F.coalesce("member", F.lit(False))
    solved = all_.select(
        "v",
        F.coalesce(loop, F.col("s_end")).alias("root"),
        F.when(loop.isNull(), F.col("dist") + F.col("s_dist"))
        .otherwise(F.when(on_it, -1).otherwise(-2))
        .cast("int")
        .alias("depth"),
        "tgt",
        "path",
    )
    return nodes, ws.cut(solved, "solved"), words, ws


def _unsplit(ws: Workspace, walked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Finish the walks that met no splitter: those that leave the set join the
    walk of the node they leave to, the others are on or below a cycle."""
    rest = walked.where("not done").select("v").join(nodes, "v")
    rest = ws.cut(rest, "rest")
    inner = rest.select(F.col("v").alias("parent"), F.lit(True).alias("inside"))
    start = rest.join(inner, "parent", "left").select(
        "v", F.col("parent").alias("tgt"), F.lit(1).cast("long").alias("dist"),
        F.col("v").alias("mn"), F.col("inside").isNull().alias("done"), F.array("v").alias("path"),
    )
    # paths only where the walk ends; cycles are told by their images
    plain, left, _ = _double(ws, start.drop("path"), "rest_", None)
    done = walked.where("done")
    out = done
    leave = plain.where("done").select("v", F.col("tgt").alias("x"), F.col("dist").alias("d1"), F.col("mn").alias("m1"))
    if leave.limit(1).count():
        paths, _, _ = _double(ws, start, "restp_", max(1, math.ceil(math.log2(leave.agg(F.max("d1")).first()[0] + 1))))
        via = leave.join(
            done.select(F.col("v").alias("x"), "tgt", "dist", "mn", "done", F.col("path").alias("p2"), "oncyc", "cyc"), "x"
        ).join(paths.where("done").select("v", F.col("path").alias("p1")), "v")
        out = out.unionByName(
            via.select(
                "v", "tgt", (F.col("d1") + F.col("dist")).alias("dist"), F.least("m1", "mn").alias("mn"),
                "done", F.concat("p1", "p2").alias("path"), "oncyc", "cyc",
            )
        )
    if left:
        ring = plain.where("not done")
        on = ring.select(F.col("tgt").alias("v")).distinct()
        on = ring.join(on, "v", "left_semi").select(F.col("v").alias("c"), F.col("mn").alias("cyc"))
        on = ws.cut(on, "ring")
        out = out.unionByName(
            ring.join(on.withColumnRenamed("c", "tgt"), "tgt")
            .join(on.select(F.col("c").alias("v"), F.lit(True).alias("is_on")), "v", "left")
            .select(
                "v", "tgt", "dist", "mn", F.lit(True).alias("done"), F.lit(None).cast("array<bigint>").alias("path"),
                F.coalesce("is_on", F.lit(False)).alias("oncyc"), "cyc",
            )
        )
    return ws.cut(out, "walked")


def hierarchy(links: DataFrame, split_every: int = SPLIT_EVERY) -> DataFrame:
    """``node, root_node, node_depth`` for every node of ``child, parent`` links.

    A null or blank parent gives no parent, a null or blank child no node;
    repeated links count once; a child with several parents keeps the smallest
    (``several_parents`` lists such children).
    Depth -1 marks a node on a cycle (its root is the cycle's smallest node), -2
    one whose way up ends in a cycle.  Other columns are ignored; an empty table
    gives no rows.
    """
    _, solved, words, _ = resolve(links, split_every)
    ids = words.select(F.col("id").alias("node"), F.col("code").alias("v"))
    roots = words.select(F.col("id").alias("root_node"), F.col("code").alias("root"))
    # roots are few against nodes: name them before the wide join
    named = solved.select("root").distinct().join(roots, "root")
    return (
        solved.select("v", "root", F.col("depth").alias("node_depth"))
        .join(named, "root").join(ids, "v").select("node", "root_node", "node_depth")
    )


def several_parents(links: DataFrame) -> DataFrame:
    """``child, parents``: children that the links give more than one parent, with
    the sorted parents; ``hierarchy`` keeps the first of them."""
    named = links.select("child", "parent").where("not rlike(child, '^\\s*$') and not rlike(parent, '^\\s*$')").distinct()
    return named.groupBy("child").agg(F.array_sort(F.collect_list("parent")).alias("parents")).where(F.size("parents") > 1)


def paths(links: DataFrame, split_every: int = SPLIT_EVERY) -> DataFrame:
    """``node, root_node, node_depth, ancestor, distance``: one row for each node
    of a tree and each node on its way up, itself (distance 0) included; read
    from ``ancestor`` it lists all descendants.  Exact paths are put together
    from walks: a node's own, then its splitter's, and so on.  Nodes on or below
    cycles have no path to a root and are left out (see ``hierarchy``).
    """
    _, solved, words, ws = resolve(links, split_every)
    tree = solved.where("depth >= 0").select(
        "v", "root", "depth", F.when(F.size("path") > 0, F.col("tgt")).alias("up"),
        F.when(F.size("path") > 0, F.col("path")).otherwise(F.array("v")).alias("part"),
    )
    tree = ws.cut(tree, "tree")
    # splitters above each splitter, itself included, by doubling
    split = tree.select(F.col("up").alias("v")).where("v is not null").distinct()
    jump = ws.cut(tree.join(split, "v", "left_semi").select(F.col("v").alias("s"), F.col("up").alias("m")), "jump0")
    above = ws.cut(jump.select("s", F.col("s").alias("t")), "above0")
    k = 0
    while jump.where("m is not null").limit(1).count():
        on = jump.where("m is not null")
        more = on.join(above.withColumnRenamed("s", "m"), "m").select("s", "t")
        far = on.join(jump.select(F.col("s").alias("m"), F.col("m").alias("m2")), "m").select("s", F.col("m2").alias("m"))
        above, jump, k = ws.cut(above.unionAll(more), f"above{k + 1}"), ws.cut(far, f"jump{k + 1}"), k + 1
    # a node's way up is its own walk and the walks of the splitters above
    own = tree.select("v", "root", "depth", F.lit(0).cast("int").alias("base"), "part")
    rest = (
        tree.where("up is not null").select("v", "root", "depth", F.col("up").alias("s")).join(above, "s")
        .join(tree.select(F.col("v").alias("t"), F.col("depth").alias("t_depth"), "part"), "t")
        .select("v", "root", "depth", (F.col("depth") - F.col("t_depth")).alias("base"), "part")
    )
    res = own.unionAll(rest).select("v", "root", "depth", "base", F.posexplode("part").alias("pos", "a"))
    name = lambda new, code: words.select(F.col("id").alias(new), F.col("code").alias(code))
    return (
        res.join(name("node", "v"), "v").join(name("root_node", "root"), "root").join(name("ancestor", "a"), "a")
        .select("node", "root_node", F.col("depth").alias("node_depth"), "ancestor", (F.col("base") + F.col("pos")).cast("int").alias("distance"))
    )
