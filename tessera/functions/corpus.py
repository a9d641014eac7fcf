"""TF-IDF cosine and its soft variant over label tables ``id, label``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.plans.runtime import Workspace


def token_table(df: DataFrame) -> DataFrame:
    """``id, token, tf``."""
    return df.select("id", F.explode(tokens(F.col("label"))).alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))


def document_frequencies(df: DataFrame) -> DataFrame:
    return token_table(df).groupBy("token").agg(F.count("*").alias("df"))


def length_distribution(df: DataFrame) -> DataFrame:
    """``n_tokens, n``: how many labels have how many tokens."""
    return df.select(F.size(tokens(F.col("label"))).alias("n_tokens")).where("n_tokens >= 0").groupBy("n_tokens").agg(F.count("*").alias("n"))


def idf(corpus: DataFrame) -> DataFrame:
    """``token, idf`` = ln(documents / documents with the token)."""
    n = corpus.count()
    return document_frequencies(corpus).select("token", F.log(F.lit(float(max(n, 1))) / F.col("df")).alias("idf"))


def _vectors(df: DataFrame, weights: DataFrame) -> DataFrame:
    """``unit_vectors`` with the tokens' weights ``idf``."""
    rows = token_table(df).join(weights, "token").select("id", "token", "idf", (F.log(F.col("tf") + 1) * F.col("idf")).alias("u"))
    norm = F.sqrt(F.sum(F.col("u") ** 2).over(Window.partitionBy("id")))
    return rows.withColumn("norm", norm).where("norm > 0").select("id", "token", "idf", (F.col("u") / F.col("norm")).alias("v"))


def _leading(x: DataFrame, size: Column, least: float) -> DataFrame:
    """Tokens of each ``id``, rarest first, as long as the ``size`` (a sum) of it and
    the more frequent ones isn't under ``least``: pairs over it share one of them."""
    w = Window.partitionBy("id").orderBy(F.desc("idf"), "token").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return x.withColumn("rest", F.sum(size).over(w)).where(F.col("rest") >= least - 1e-9).drop("rest")


def unit_vectors(df: DataFrame, weights: DataFrame) -> DataFrame:
    """``id, token, v``: ln(tf + 1) * idf, scaled to unit length; tokens without
    a weight count nothing."""
    return _vectors(df, weights).select("id", "token", "v")


def tfidf(a: DataFrame, b: DataFrame, weights: DataFrame, least: float = 0.0) -> DataFrame:
    """``id1, id2, sim`` of labels that share a token: a sparse product joined on
    tokens.  ``least`` leaves out smaller similarities; their pairs aren't made
    unless they share a rare token: the frequent ones alone don't reach ``least``."""
    x, y = _vectors(a, weights), _vectors(b, weights)
    left, right = x.select(F.col("id").alias("id1"), "token", F.col("v").alias("v1")), y.select(F.col("id").alias("id2"), "token", F.col("v").alias("v2"))
    if least > 0:
        rare = lambda z, k: _leading(z, F.col("v") ** 2, least**2).select(F.col("id").alias(k), "token")
        hits = rare(x, "id1").join(rare(y, "id2"), "token").select("id1", "id2").distinct().join(left, "id1").join(right, ["id2", "token"])
    else:
        hits = left.join(right, "token")
    return hits.groupBy("id1", "id2").agg(F.sum(F.col("v1") * F.col("v2")).alias("sim")).where(F.col("sim") > least)


def soft_tfidf(a: DataFrame, b: DataFrame, weights: DataFrame, inner: Callable[[Column, Column], Column], theta: float, least: float = 0.0, block: int = 1, others: Callable[[DataFrame, DataFrame], DataFrame] | None = None, candidates: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """``id1, id2, sim``: tokens may match others with an inner similarity of at
    least ``theta``; each token of the first takes its closest.  Token pairs are
    made once per distinct pair that shares its first ``block`` signs (0: all
    pairs of the two vocabularies, which must be small) or that ``others`` names:
    from both vocabularies, ``x`` and ``y``, the pairs with other first signs that
    ``inner`` may bring to ``theta``.  Without it these are lost.  ``candidates``
    names all pairs of the vocabularies that ``inner`` may bring to ``theta``, and
    stands for ``block`` and ``others``.  ``inner`` is at most 1, so label pairs
    over ``least`` meet by one of the first's rarest tokens: the others' weights
    don't sum up to ``least``."""
    x, y = _vectors(a, weights), unit_vectors(b, weights)
    head = lambda c: F.substring(c, 1, block) if block else F.lit("")
    tx = x.select(F.col("token").alias("t1")).distinct().withColumn("h", head(F.col("t1")))
    ty = y.select(F.col("token").alias("t2")).distinct().withColumn("h", head(F.col("t2")))
    if candidates:
        pairs = candidates(tx.select(F.col("t1").alias("x")), ty.select(F.col("t2").alias("y"))).toDF("t1", "t2")
    else:
        pairs = tx.join(ty, "h").select("t1", "t2")
    if others and block and not candidates:
        pairs = pairs.union(others(tx.select(F.col("t1").alias("x")), ty.select(F.col("t2").alias("y")))).distinct()
    ws = Workspace(a.sparkSession, "soft")
    near = ws.cut(pairs.select("t1", "t2", inner(F.col("t1"), F.col("t2")).alias("s")).where(F.col("s") >= theta), "near")
    first = lambda z: z.select(F.col("id").alias("id1"), F.col("token").alias("t1"), F.col("v").alias("v1"))
    second = y.select(F.col("id").alias("id2"), F.col("token").alias("t2"), F.col("v").alias("v2"))
    met = first(_leading(x, F.col("v"), least)).join(near, "t1").join(second, "t2").select("id1", "id2").distinct()
    hits = met.join(first(x), "id1").join(near, "t1").join(second, ["id2", "t2"])
    best = hits.groupBy("id1", "id2", "t1").agg(F.max_by(F.col("v1") * F.col("v2") * F.col("s"), F.struct("s", "v2")).alias("g"))
    return best.groupBy("id1", "id2").agg(F.sum("g").alias("sim")).where(F.col("sim") > least)
