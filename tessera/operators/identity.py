"""Identifiers: rewriting along sameAs links, and minting from labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.runtime import Workspace


def same_as_groups(links: DataFrame) -> DataFrame:
    """``id, canonical``: smallest identifier of everything linked (``e1, e2``),
    by propagating minima with pointer jumping until nothing changes."""
    ws = Workspace(links.sparkSession, "sameas")
    edges = links.select("e1", "e2").where("e1 is not null and e2 is not null")
    edges = ws.cut(edges.unionAll(edges.select(F.col("e2").alias("e1"), F.col("e1").alias("e2"))).distinct(), "edges")
    cur = ws.cut(edges.groupBy(F.col("e1").alias("id")).agg(F.least(F.min("e2"), F.first("e1")).alias("canonical")), "c0")
    k = 0
    while True:
        near = edges.join(cur.select(F.col("id").alias("e2"), "canonical"), "e2").groupBy(F.col("e1").alias("id")).agg(F.min("canonical").alias("m"))
        # a node also takes what its present canonical has found
        far = cur.select(F.col("id").alias("c"), F.col("canonical").alias("cc"))
        nxt = cur.join(near, "id").join(far, F.col("canonical") == F.col("c"), "left").select(
            "id", F.least("canonical", "m", "cc").alias("canonical"), (F.least("canonical", "m", "cc") < F.col("canonical")).alias("new")
        )
        nxt = ws.cut(nxt, f"c{k + 1}")
        ws.drop(f"c{k}")
        cur, k = nxt.select("id", "canonical"), k + 1
        if not nxt.where("new").limit(1).count():
            return cur


def rewrite(triples: DataFrame, links: DataFrame) -> DataFrame:
    """Statements with linked subjects and objects replaced by the canonical
    identifier; statements that become equal are kept once."""
    c = same_as_groups(links)
    out = triples.join(c.toDF("s", "cs"), "s", "left").join(c.toDF("o", "co"), "o", "left")
    rest = [x for x in triples.columns if x not in ("s", "o")]
    return out.select(F.coalesce("cs", "s").alias("s"), F.coalesce("co", "o").alias("o"), *rest).select(*triples.columns).distinct()


def mint(triples: DataFrame, namespace: str, label: str = "rdfs:label", languages: Sequence[str] = ("en", "fr", "es")) -> DataFrame:
    """``s, minted``: an identifier from each subject's label in the first of the
    languages that it has (ties: the smallest label)."""
    rank = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang"))
    rows = triples.where((F.col("p") == label) & F.col("lang").isin(*languages) & (F.trim("o") != ""))
    best = rows.groupBy("s").agg(F.min(F.struct(rank.alias("r"), "o")).alias("b"))
    return best.select("s", F.concat(F.lit(namespace), F.url_encode(F.replace("b.o", F.lit(" "), F.lit("_")))).alias("minted"))
