"""Taxonomy graphs as edge tables ``src, dst, w`` (child -> parent).

Searches are fix-points over frontiers, for many sources at once: a round joins
the rows that got better with the edges, keeps minima, and writes both to the
shared folder.  Cycles end because a row must get strictly better.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.curie import shorten
from tessera.operators.hierarchy import _double
from tessera.plans.runtime import Workspace

# Predicates that make a taxonomy, predicates that name things.
TAXONOMIC = ["skos:broader", "dcterms:subject", "rdfs:subClassOf"]
TAXONOMIC_URIS = [
    "http://www.w3.org/2004/02/skos/core#broader",
    "http://purl.org/dc/terms/subject",
    "http://www.w3.org/2000/01/rdf-schema#subClassOf",
]
LABEL = ["rdfs:label", "foaf:name", "dbpprop:name"]
LABEL_URIS = [
    "http://www.w3.org/2000/01/rdf-schema#label",
    "http://xmlns.com/foaf/0.1/name",
    "http://dbpedia.org/property/name",
]
# Names of categories that gather things and are no concepts.
AGGREGATES = [
    r"category:\d\d\d\d_.+", r"category:.+?_\d\d\d\d", r"category:.+?_of_.+", r"category:.+?_in_.+",
    r"category:.+?_births", r"category:.+?_deaths", r"category:.+?_albums",
]

#: Export value of "no path".
NO_PATH = 1.7976931348623157e308


def from_triples(triples: DataFrame, predicates: Sequence[str] = (*TAXONOMIC, *TAXONOMIC_URIS), prefixes: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """Distinct edges of weight 1 from the taxonomic statements; null and blank
    ends are left out."""
    prefixes = list(prefixes)
    rows = triples.where(F.col("p").isin(*predicates)).select(
        shorten(F.col("s"), prefixes).alias("src"), shorten(F.col("o"), prefixes).alias("dst")
    )
    return rows.where("src is not null and trim(dst) <> ''").distinct().withColumn("w", F.lit(1).cast("bigint"))


def labels(triples: DataFrame, predicates: Sequence[str] = (*LABEL, *LABEL_URIS)) -> DataFrame:
    """``uri, labels``: sorted distinct labels of each subject, in any language."""
    return (
        triples.where(F.col("p").isin(*predicates) & F.col("o").isNotNull())
        .groupBy(F.col("s").alias("uri")).agg(F.array_sort(F.collect_set("o")).alias("labels"))
    )


def unique_labels(triples: DataFrame, predicates: Sequence[str] = (*LABEL, *LABEL_URIS)) -> DataFrame:
    """``uri, label``; an entity with another number of labels than one is an error."""
    one = F.when(F.size("labels") == 1, F.col("labels")[0]).otherwise(
        F.raise_error(F.concat(F.lit("not one label: "), F.col("uri"))).cast("string")
    )
    return labels(triples, predicates).select("uri", one.alias("label"))


def by_label(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges over rdfs:subClassOf between labels, and all nodes (``id``), those
    without an edge included.  Unlabelled ends keep their identifier."""
    names = triples.where(F.col("p") == "rdfs:label").groupBy(F.col("s").alias("k")).agg(F.min("o").alias("n"))
    named = lambda df, c: df.join(names.withColumnRenamed("k", c), c, "left").withColumn(c, F.coalesce("n", c)).drop("n")
    edges = named(named(from_triples(triples, ["rdfs:subClassOf"]), "src"), "dst").select("src", "dst", "w").distinct()
    nodes = named(triples.select(F.col("s").alias("src")).distinct(), "src").select(F.col("src").alias("id"))
    return edges, nodes.unionAll(edges.select("dst")).distinct()


def numeric(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges over dense codes from 0 in the order of the identifiers, and their
    dictionary ``id, code``; numbered by partition offsets, not in one task."""
    ws = Workspace(edges.sparkSession, "numeric")
    ids = ws.cut(nodes(edges).orderBy("id").withColumn("m", F.monotonically_increasing_id()), "ids")
    part = F.shiftright("m", 33)
    counts = ids.groupBy(part.alias("part")).count().collect()  # one row a partition
    offsets, at = [], 0
    for r in sorted(counts, key=lambda r: r["part"]):
        offsets.append((r["part"], at))
        at += r["count"]
    offsets = edges.sparkSession.createDataFrame(offsets, "part bigint, base bigint")
    words = ids.withColumn("part", part).join(F.broadcast(offsets), "part", "left").select(
        "id", (F.col("base") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).alias("code")
    )
    out = edges.join(words.toDF("src", "s"), "src").join(words.toDF("dst", "d"), "dst")
    return out.select(F.col("s").alias("src"), F.col("d").alias("dst"), "w"), words


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionAll(edges.select("dst")).distinct()


def merge(spark: SparkSession, s: str, t: str) -> DataFrame:
    """Two edges of weight 0 that make ``s`` and ``t`` one."""
    return spark.createDataFrame([(s, t, 0), (t, s, 0)], "src string, dst string, w bigint")


def join_graphs(*graphs: DataFrame) -> DataFrame:
    out = graphs[0]
    for g in graphs[1:]:
        out = out.unionByName(g)
    return out.groupBy("src", "dst").agg(F.min("w").alias("w"))


def is_aggregate(c) -> object:
    """Whether a CURIE names a category that gathers things (unanchored)."""
    out = F.lit(False)
    for p in AGGREGATES:
        out = out | c.rlike(p)
    return out


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")


def _strides(ws: Workspace, steps: DataFrame, most: int = 12, growth: int = 64) -> DataFrame:
    """``node, next, w``: least weights of up to ``2 ** most`` edges at once, so
    that a deep search needs fewer rounds; doubling ends early if the table gets
    more than ``growth`` times as large as that of the edges."""
    n, cur = None, steps
    for k in range(most):
        two = cur.join(cur.select(F.col("node").alias("next"), F.col("next").alias("far"), F.col("w").alias("w2")), "next")
        nxt = cur.unionAll(two.select("node", F.col("far").alias("next"), (F.col("w") + F.col("w2")).alias("w")))
        nxt = ws.cut(nxt.groupBy("node", "next").agg(F.min("w").alias("w")).select("node", "next", "w"), f"stride{k}")
        n = steps.count() if n is None else n
        size, before = nxt.count(), cur.count()
        if size > growth * n:
            break
        cur = nxt
        if size == before:  # all that can be reached in any number of steps
            break
    return cur


def _spread(start: DataFrame, edges: DataFrame, keys: list[str], walls: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Minimal ``d`` of every ``keys, node`` reached from ``start`` (``keys, node,
    d``).  Rows whose keys and node are in ``walls`` are reached but not left."""
    ws = Workspace(start.sparkSession, "search")
    on = [*keys, "node"]
    steps = edges.groupBy("src", "dst").agg(F.min("w").alias("w"))
    steps = ws.cut(steps.select(F.col("src").alias("node"), F.col("dst").alias("next"), "w"), "edges")
    if walls is None and most is None:
        steps = _strides(ws, steps)
    best = ws.cut(start.groupBy(*on).agg(F.min("d").alias("d")), "best0")
    front, k = best, 0
    while (most is None or k < most) and front.limit(1).count():
        made = front.join(steps, "node").groupBy(*keys, F.col("next").alias("node")).agg(F.min(F.col("d") + F.col("w")).alias("d"))
        new = made.join(best.withColumnRenamed("d", "old"), on, "left").where("old is null or d < old").drop("old")
        new = ws.cut(new, f"new{k}")
        best = ws.cut(best.unionByName(new).groupBy(*on).agg(F.min("d").alias("d")), f"best{k + 1}")
        front = new.join(walls, on, "left_anti") if walls is not None else new
        if k:
            ws.drop(f"new{k - 1}", f"best{k - 1}")
        k += 1
    return best


def shortest_distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``s, node, d``: least weight from every source (``id``) to every node it
    reaches, itself (0) included."""
    return _spread(sources.select(F.col("id").alias("s"), F.col("id").alias("node"), F.lit(0).cast("bigint").alias("d")).distinct(), edges, ["s"])


def all_distances(edges: DataFrame) -> DataFrame:
    """``i, j, d`` of all connected pairs by min-plus squaring of the distance
    table (0 on the diagonal) until it stays; log2(longest path) rounds."""
    ws = Workspace(edges.sparkSession, "minplus")
    diag = nodes(edges).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0).cast("bigint").alias("d"))
    cur = diag.unionAll(edges.select("src", "dst", "w")).groupBy("i", "j").agg(F.min("d").alias("d"))
    cur, k = ws.cut(cur, "d0"), 0
    sign = lambda df: tuple(df.agg(F.count("*"), F.sum("d"), F.bit_xor(F.xxhash64("i", "j", "d"))).first())
    old, now = None, sign(cur)
    while old != now:
        two = cur.select("i", F.col("j").alias("m"), F.col("d").alias("a")).join(cur.select(F.col("i").alias("m"), "j", F.col("d").alias("b")), "m")
        cur = ws.cut(two.groupBy("i", "j").agg(F.min(F.col("a") + F.col("b")).alias("d")), f"d{k + 1}")
        ws.drop(f"d{k}")
        old, now, k = now, sign(cur), k + 1
    return cur


def shortest_paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``s, t, d, path``: one cheapest path of each pair (``s, t``) as an array of
    ``node, w`` of the edge taken, without the target; the smaller predecessor
    wins ties.  No row without a path; an empty path if ``s = t``.

    Predecessors come from the distances, the path is read back from the target."""
    ws = Workspace(edges.sparkSession, "paths")
    dist = ws.cut(shortest_distances(edges, pairs.select(F.col("s").alias("id")).distinct()), "dist")
    tight = (
        dist.join(edges.select(F.col("src").alias("node"), F.col("dst").alias("to"), "w"), "node")
        .join(dist.select("s", F.col("node").alias("to"), F.col("d").alias("d_to")), ["s", "to"])
        .where("d + w = d_to and node <> to")
    )
    # of tight edges one from a strictly nearer node, or of weight 0 from an earlier hop
    hops = ws.cut(_hops(dist, tight), "hops")
    pred = tight.join(hops.select("s", F.col("node").alias("node"), F.col("h").alias("h1")), ["s", "node"]).join(
        hops.select("s", F.col("node").alias("to"), F.col("h").alias("h2")), ["s", "to"]
    ).where("h1 + 1 = h2").groupBy("s", "to").agg(F.min(F.struct("node", "w")).alias("p"))
    pred = ws.cut(pred, "pred")
    cur = pairs.select("s", "t").distinct().join(dist.select("s", F.col("node").alias("t"), "d"), ["s", "t"])
    cur = cur.select("s", "t", "d", F.col("t").alias("at"), F.array().cast(f"array<{pred.schema['p'].dataType.simpleString()}>").alias("path"))
    out, k = [], 0
    while True:
        cur = ws.cut(cur, f"cur{k}")
        out.append(cur.where("at = s").select("s", "t", "d", "path"))
        rest = cur.where("at <> s")
        if not rest.limit(1).count():
            break
        cur = rest.join(pred.withColumnRenamed("to", "at"), ["s", "at"]).select(
            "s", "t", "d", F.col("p.node").alias("at"), F.concat(F.array("p"), F.col("path")).alias("path")
        )
        k += 1
    res = out[0]
    for o in out[1:]:
        res = res.unionAll(o)
    return res


def _hops(dist: DataFrame, tight: DataFrame) -> DataFrame:
    """``s, node, h``: fewest tight edges from the source."""
    ws = Workspace(dist.sparkSession, "hops")
    steps = ws.cut(tight.select("s", "node", F.col("to").alias("next")).distinct(), "tight")
    best = ws.cut(dist.where("node = s").select("s", "node", F.lit(0).alias("h")), "h0")
    front, k = best, 0
    while front.limit(1).count():
        new = front.join(steps, ["s", "node"]).select("s", F.col("next").alias("node"), (F.col("h") + 1).alias("h")).distinct()
        front = ws.cut(new.join(best.select("s", "node"), ["s", "node"], "left_anti"), f"f{k}")
        best = ws.cut(best.unionByName(front), f"h{k + 1}")
        k += 1
    return best


def reachable(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """``s, node, depth``: everything reached from each source (``id``) along
    edges, itself (0) included; depth counts edges, at most ``most``."""
    start = sources.select(F.col("id").alias("s"), F.col("id").alias("node"), F.lit(0).cast("bigint").alias("d")).distinct()
    return _spread(start, edges.withColumn("w", F.lit(1).cast("bigint")), ["s"], most=most).withColumnRenamed("d", "depth")


def subsumers(edges: DataFrame, sources: DataFrame) -> DataFrame:
    return reachable(edges, sources).select("s", "node")


def subsumer_graph(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Edges above any of the sources (multi-source ancestor edges)."""
    found = reachable(edges, sources).select(F.col("node").alias("src")).distinct()
    return edges.join(found, "src", "left_semi").select("src", "dst", "w")


def subsumed(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``root, node``: descendants of each root (``id``), itself included."""
    return reachable(reverse(edges), roots).select(F.col("s").alias("root"), "node")


#: Most words of 64 roots that a task of ``subtree_sizes`` follows at once.
ROOT_WORDS = 32


def subtree_sizes(edges: DataFrame, roots: DataFrame, marked: DataFrame) -> DataFrame:
    """``root, marked, nodes``: how many descendants each root (``id``) has, itself
    included, and how many of them are among ``marked`` (``id``), without a row for
    each pair of both.

    Nodes with one parent count for the next node up that is a root or has several
    (pointer doubling; those whose way up is a cycle count for none).  The graph
    of these nodes goes to tasks that follow a share of the roots each, as bits,
    along all edges until nothing is new."""
    ws = Workspace(edges.sparkSession, "subtrees")
    up = ws.cut(edges.select("src", "dst").distinct(), "up")
    tops = ws.cut(roots.select("id").distinct(), "tops")
    one = up.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.min("dst").alias("parent"))
    ids = nodes(up).unionAll(tops).distinct().join(one, "id", "left").join(tops.withColumn("top", F.lit(True)), "id", "left")
    stop = F.col("top").isNotNull() | F.coalesce(F.col("n") != 1, F.lit(True))
    zero = F.lit(0).cast("long")
    start = ids.select(F.col("id").alias("v"), F.when(stop, F.col("id")).otherwise(F.col("parent")).alias("tgt"), zero.alias("dist"), zero.alias("mn"), stop.alias("done"))
    ends = _double(ws, start, "end", None)[0].where("done").select("v", "tgt")
    hit = marked.select(F.col("id").alias("v")).distinct().withColumn("hit", F.lit(1))
    weight = ends.join(hit, "v", "left").groupBy(F.col("tgt").alias("id")).agg(F.count("hit").alias("m"), F.count("*").alias("n"))
    # a root's edge to itself keeps those in whose descendants have one parent each
    steps = up.join(ends.where("v = tgt").select(F.col("v").alias("src")), "src").join(ends.select(F.col("v").alias("dst"), "tgt"), "dst")
    steps = steps.select("src", F.col("tgt").alias("dst")).unionAll(tops.select(F.col("id").alias("src"), F.col("id").alias("dst"))).distinct()
    coded, words = numeric(ws.cut(steps.withColumn("w", zero), "steps"))
    words = ws.cut(words, "words")
    n = tops.count()
    width = max(1, min(ROOT_WORDS, math.ceil(n / (64 * 48))))
    parts = max(1, math.ceil(n / (64 * width)))
    row = lambda df, kind, *c: df.select(F.lit(kind).alias("kind"), *[(F.col(x) if x else zero).cast("long").alias(k) for k, x in zip("abc", c)])
    shared = row(coded, 0, "dst", "src", None).unionAll(row(weight.join(words, "id"), 1, "code", "n", "m"))
    shared = shared.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    own = row(tops.join(words, "id"), 2, "code", None, None).withColumn("part", F.pmod(F.xxhash64("a"), F.lit(parts)).cast("int"))
    found = shared.unionByName(own).repartition(parts, "part").groupBy("part").applyInArrow(_follow, "code long, marked long, nodes long")
    return found.join(words, "code").select(F.col("id").alias("root"), "marked", "nodes")


def _follow(t: pa.Table) -> pa.Table:
    """Edges ``a, b`` (kind 0), nodes ``a`` with weights ``b, c`` (1) and roots ``a``
    (2) -> the summed weights of what each root reaches."""
    kind, a, b, c = (t.column(k).to_numpy() for k in ("kind", "a", "b", "c"))
    roots = a[kind == 2]
    src, dst = a[kind == 0], b[kind == 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    size = int(a[kind < 2].max(initial=-1)) + 1
    weights = np.zeros((2, size))
    weights[:, a[kind == 1]] = c[kind == 1], b[kind == 1]
    sums = []
    for at in range(0, len(roots), 64 * ROOT_WORDS):
        some = roots[at : at + 64 * ROOT_WORDS]
        k = np.arange(len(some))
        reach = np.zeros((size, -(-len(some) // 64)), np.uint64)
        reach[some, k // 64] = np.uint64(1) << (k % 64).astype(np.uint64)
        new = np.zeros(size, bool)
        new[some] = True
        while new.any():
            live = np.flatnonzero(new[src])
            new[:] = False
            for lo in range(0, len(live), 200_000):
                part = live[lo : lo + 200_000]
                to, first = np.unique(dst[part], return_index=True)
                got = np.bitwise_or.reduceat(reach[src[part]], first, axis=0) | reach[to]
                new[to[(got != reach[to]).any(1)]] = True
                reach[to] = got
        for w in range(reach.shape[1]):
            bits = np.unpackbits(np.ascontiguousarray(reach[:, w : w + 1]).view(np.uint8), axis=1, bitorder="little")
            sums.append((weights @ bits.astype(np.float64))[:, : max(0, min(64, len(some) - 64 * w))])
    both = np.concatenate(sums, axis=1).astype(np.int64) if sums else np.zeros((2, 0), np.int64)
    return pa.table({"code": pa.array(roots, pa.int64()), "marked": pa.array(both[0]), "nodes": pa.array(both[1])})


def leafs(edges: DataFrame) -> DataFrame:
    """Nodes without an edge into them."""
    return nodes(edges).join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def subsumed_leafs(edges: DataFrame, roots: DataFrame) -> DataFrame:
    return subsumed(edges, roots).join(leafs(edges).withColumnRenamed("id", "node"), "node", "left_semi").select("root", "node")


def environment(edges: DataFrame, sources: DataFrame, depth: int) -> DataFrame:
    """``s, src, dst, w``: edges met within ``depth`` steps from each source."""
    near = reachable(edges, sources, most=depth - 1).where(F.col("depth") < depth) if depth > 0 else None
    if near is None:
        return edges.limit(0).select(F.col("src").alias("s"), "src", "dst", "w")
    return near.select("s", F.col("node").alias("src")).join(edges, "src").select("s", "src", "dst", "w")


def all_paths(edges: DataFrame, pairs: DataFrame, most: int = 20) -> DataFrame:
    """``s, t, path``: every path of at most ``most`` edges, none of them twice.
    Their number may be exponential; ``most`` is the bound."""
    ws = Workspace(edges.sparkSession, "allpaths")
    steps = ws.cut(edges.select(F.col("src").alias("at"), F.col("dst").alias("next")).distinct(), "edges")
    want = pairs.select("s", "t").distinct()
    cur = want.select("s", F.col("s").alias("at")).distinct().select("s", "at", F.array("at").alias("path"), F.array().cast("array<string>").alias("used"))
    out = None
    for k in range(most):
        edge = F.concat_ws("\u0001", F.col("at").cast("string"), F.col("next").cast("string"))
        cur = ws.cut(
            cur.join(steps, "at").where(~F.array_contains("used", edge))
            .select("s", F.col("next").alias("at"), F.concat("path", F.array("next")).alias("path"), F.concat("used", F.array(edge)).alias("used")),
            f"p{k}",
        )
        hit = cur.join(want.withColumnRenamed("t", "at"), ["s", "at"]).select("s", F.col("at").alias("t"), "path")
        out = hit if out is None else out.unionAll(hit)
        if not cur.limit(1).count():
            break
    return out


def cleanup(edges: DataFrame, most: int = 100) -> DataFrame:
    """Without aggregate categories, then without nodes that have no parent, for
    at most ``most`` rounds or until nothing changes (roots of the rest stay if
    they are on cycles only)."""
    ws = Workspace(edges.sparkSession, "cleanup")
    cur = edges.where(~is_aggregate(F.col("src")) & ~is_aggregate(F.col("dst")))
    cur = ws.cut(cur, "c0")
    n = cur.count()
    for k in range(most):
        nxt = ws.cut(cur.join(cur.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst", "w"), f"c{k + 1}")
        ws.drop(f"c{k}")
        m = nxt.count()
        cur = nxt
        if m == n:
            break
        n = m
    return cur


def lcs_candidates(edges: DataFrame, pairs: DataFrame, include_endpoints: bool = False) -> DataFrame:
    """``s, t, v, w``: common subsumers of each pair and the weight of the way
    ``s -> v`` plus ``t -> v``.

    ``v`` is reached from ``s``, and from ``t`` by a way whose inner nodes aren't
    reached from ``s``; ``t`` itself is no candidate unless ``include_endpoints``
    (and then with weight s -> t)."""
    ws = Workspace(edges.sparkSession, "lcs")
    want = ws.cut(pairs.select("s", "t").distinct(), "pairs")
    up = ws.cut(shortest_distances(edges, want.select(F.col("s").alias("id")).distinct()), "up")
    walls = ws.cut(want.join(up.select("s", "node"), "s").select("s", "t", "node"), "walls")
    start = want.select("s", "t", F.col("t").alias("node"), F.lit(0).cast("bigint").alias("d"))
    met = _spread(start, edges, ["s", "t"], walls)
    both = met.join(up.select("s", "node", F.col("d").alias("d_s")), ["s", "node"])
    if not include_endpoints:
        both = both.where("node <> t")
    return both.select("s", "t", F.col("node").alias("v"), (F.col("d") + F.col("d_s")).alias("w"))


def lcs(edges: DataFrame, pairs: DataFrame, include_endpoints: bool = False) -> DataFrame:
    """The candidate of least weight, ties by node: ``s, t, v, w``."""
    c = lcs_candidates(edges, pairs, include_endpoints)
    return c.groupBy("s", "t").agg(F.min(F.struct("w", "v")).alias("b")).select("s", "t", "b.v", "b.w")


def similarity(edges: DataFrame, pairs: DataFrame, root: str, most: float = 77.0) -> DataFrame:
    """``s, t, lcs, cotopic, cotopic_normalized, wu_palmer_sim, wu_palmer_dist``.

    Structural cotopic is the weight over the least common subsumer, its
    normalised form over ``most``.  Wu-Palmer is 2 l / (w + 2 l) with l the
    weight from the subsumer to ``root`` (0 if it is the root).  Null without a
    common subsumer, Wu-Palmer also if it doesn't reach the root."""
    found = lcs(edges, pairs)
    down = shortest_distances(reverse(edges), edges.sparkSession.createDataFrame([(root,)], "id string")).select(F.col("node").alias("v"), F.col("d").alias("l"))
    sim = F.when(F.col("w") + F.col("l") > 0, 2 * F.col("l") / (F.col("w") + 2 * F.col("l"))).when(F.col("l").isNotNull(), 1.0)
    out = pairs.select("s", "t").distinct().join(found, ["s", "t"], "left").join(down, "v", "left")
    return out.select(
        "s", "t", F.col("v").alias("lcs"), F.col("w").cast("double").alias("cotopic"), (F.col("w") / most).alias("cotopic_normalized"),
        sim.alias("wu_palmer_sim"), (1 - sim).alias("wu_palmer_dist"),
    )


def path_length_histogram(edges: DataFrame, of: DataFrame) -> DataFrame:
    """``len, n``: least common subsumer weights over all ordered pairs of the
    nodes ``of`` (``id``), by a join on common subsumers."""
    up = shortest_distances(edges, of)
    two = up.select(F.col("s").alias("a"), "node", F.col("d").alias("da")).join(up.select(F.col("s").alias("b"), "node", F.col("d").alias("db")), "node")
    least = two.where("a <> b").groupBy("a", "b").agg(F.min(F.col("da") + F.col("db")).alias("len"))
    return least.groupBy("len").agg(F.count("*").alias("n"))


def rdfs_closure(triples: DataFrame) -> DataFrame:
    """Statements with those entailed by rdfs:subClassOf and rdfs:subPropertyOf
    (transitive, inherited by instances) and skos:broader as transitive property;
    ``s, p, o``.  Domain and range give types too."""
    ws = Workspace(triples.sparkSession, "rdfs")
    t = ws.cut(triples.select("s", "p", "o").where("s is not null and trim(o) <> ''").distinct(), "t")

    def above(p: str) -> DataFrame:
        e = t.where(F.col("p") == p).select(F.col("s").alias("src"), F.col("o").alias("dst"), F.lit(1).cast("bigint").alias("w"))
        return ws.cut(reachable(e, e.select(F.col("src").alias("id")).distinct()).where("depth > 0"), "above_" + p.split(":")[1])

    sub_p, sub_c, broader = above("rdfs:subPropertyOf"), above("rdfs:subClassOf"), above("skos:broader")
    props = t.unionAll(t.join(sub_p.select(F.col("s").alias("p"), "node"), "p").select("s", F.col("node").alias("p"), "o"))
    props = ws.cut(props.distinct(), "props")
    dom = t.where("p = 'rdfs:domain'").select(F.col("s").alias("p"), F.col("o").alias("c"))
    ran = t.where("p = 'rdfs:range'").select(F.col("s").alias("p"), F.col("o").alias("c"))
    typed = (
        props.where("p = 'rdf:type'").select("s", F.col("o").alias("c"))
        .unionAll(props.join(dom, "p").select("s", "c")).unionAll(props.join(ran, "p").select(F.col("o").alias("s"), "c"))
    ).distinct()
    typed = typed.unionAll(typed.join(sub_c.select(F.col("s").alias("c"), "node"), "c").select("s", F.col("node").alias("c")))
    name = lambda df, p: df.select("s", F.lit(p).alias("p"), F.col("node").alias("o"))
    return (
        props.unionAll(name(sub_p, "rdfs:subPropertyOf")).unionAll(name(sub_c, "rdfs:subClassOf")).unionAll(name(broader, "skos:broader"))
        .unionAll(typed.select("s", F.lit("rdf:type").alias("p"), F.col("c").alias("o"))).distinct()
    )


def sub_dataset(triples: DataFrame, concepts: DataFrame, member: str = "dcterms:subject") -> DataFrame:
    """Statements of a small data set about some concepts (``id``): their types,
    the taxonomy above these, and all labels of what occurs (``s, p, o``)."""
    types = triples.where(F.col("p") == member).join(concepts.select(F.col("id").alias("s")).distinct(), "s", "left_semi").select("s", "p", "o")
    types = types.where("o is not null").distinct()
    broader = from_triples(triples, ["skos:broader"])
    upper = subsumer_graph(broader, types.select(F.col("o").alias("id")).distinct()).select(F.col("src").alias("s"), F.lit("skos:broader").alias("p"), F.col("dst").alias("o"))
    known = concepts.select("id").unionAll(types.select("o")).unionAll(upper.select("s")).unionAll(upper.select("o")).toDF("s").distinct()
    named = triples.where(F.col("p").isin(*LABEL) & F.col("o").isNotNull()).join(known, "s", "left_semi").select("s", F.lit("rdfs:label").alias("p"), "o")
    return types.unionAll(upper).unionAll(named).distinct()


def redirected(ids: DataFrame, redirects: DataFrame, most: int = 5) -> DataFrame:
    """``id, target`` after following ``id, target`` redirects for up to ``most``
    steps; what isn't redirected stays."""
    step = redirects.groupBy(F.col("id").alias("k")).agg(F.min("target").alias("t"))
    out = ids.select("id", F.col("id").alias("target"))
    for _ in range(most):
        out = out.join(step, F.col("target") == F.col("k"), "left").select("id", F.coalesce("t", "target").alias("target"))
    return out
