"""Functions behind an interactive matching tool; each gives a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import taxonomy
from tessera.plans.runtime import Workspace


def search(entities: DataFrame, query: str, n: int = 10) -> DataFrame:
    """The ``n`` entities (``uri``) that contain the query in any case, earliest
    and shortest first: by place times length, then identifier."""
    at = F.instr(F.lower("uri"), query.lower()) - 1
    return entities.where(at >= 0).select("uri", (at * F.length("uri")).alias("rank")).distinct().orderBy("rank", "uri").limit(n)


def dashboard(entities: DataFrame, edges: DataFrame, t: float) -> DataFrame:
    """``kind, n``: sources with an exact match, with one within ``t``, with none."""
    best = F.array_min(F.transform(F.filter("sim", lambda x: x["d"].isNotNull()), lambda x: x["d"]))
    near = edges.groupBy(F.col("from_idx").alias("i")).agg(F.min(best).alias("d"))
    kind = F.when(F.col("d") == 0, "exact").when(F.col("d") <= t, "approximate").otherwise("none")
    return entities.select("i").distinct().join(near, "i", "left").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def matches(edges: DataFrame, source: int, t: float, accepted: DataFrame | None = None, skip_exact: bool = False) -> DataFrame:
    """``to_idx, d, m, kind``: ranked matches of one source by its best distance
    and measure: exact, approximate (within ``t``), and accepted ones."""
    best = F.array_min(F.transform(F.filter("sim", lambda x: x["d"].isNotNull()), lambda x: F.struct(x["d"].alias("d"), x["m"].alias("m"))))
    rows = edges.where(F.col("from_idx") == source).select("to_idx", best.alias("b")).where("b is not null")
    rows = rows.groupBy("to_idx").agg(F.min("b").alias("b")).select("to_idx", "b.d", "b.m")
    kind = F.when(F.col("d") == 0, "exact").when(F.col("d") <= t, "approximate")
    if accepted is not None:
        mine = accepted.where(F.col("from_idx") == source).select("to_idx", F.lit(True).alias("yes")).distinct()
        rows = rows.join(mine, "to_idx", "full")
        kind = F.when(F.coalesce("yes", F.lit(False)), "accepted").otherwise(kind)
    out = rows.select("to_idx", "d", "m", kind.alias("kind")).where("kind is not null")
    out = out.where("kind <> 'exact'") if skip_exact else out
    return out.orderBy(F.col("d").asc_nulls_last(), "m", "to_idx")


class Links:
    """Accepted links; every change is a new written table."""

    SCHEMA = "from_idx int, to_idx int"

    def __init__(self, spark):
        self.ws, self.k = Workspace(spark, "links"), 0
        self.table = self.ws.cut(spark.createDataFrame([], self.SCHEMA), "links0")

    def _set(self, df: DataFrame) -> None:
        self.k += 1
        self.table = self.ws.cut(df.distinct(), f"links{self.k}")
        self.ws.drop(f"links{self.k - 1}")

    def accept(self, s: int, t: int) -> None:
        self._set(self.table.unionAll(self.ws.spark.createDataFrame([(s, t)], self.SCHEMA)))

    def reject(self, s: int, t: int) -> None:
        self._set(self.table.where(~((F.col("from_idx") == s) & (F.col("to_idx") == t))))

    def clear(self) -> None:
        self._set(self.table.limit(0))


def path(edges: DataFrame, s: str, t: str) -> DataFrame:
    return taxonomy.shortest_paths(edges, edges.sparkSession.createDataFrame([(s, t)], "s string, t string"))


def subsumer(edges: DataFrame, s: str, t: str) -> DataFrame:
    return taxonomy.lcs(edges, edges.sparkSession.createDataFrame([(s, t)], "s string, t string"))


def cotopic(edges: DataFrame, s: str, t: str, most: float = 77.0) -> DataFrame:
    """``cotopic, cotopic_normalized``; the export value of "no path" without a
    common subsumer."""
    one = edges.sparkSession.createDataFrame([(s, t)], "s string, t string")
    c = one.join(taxonomy.lcs(edges, one), ["s", "t"], "left")
    w = F.coalesce(F.col("w").cast("double"), F.lit(taxonomy.NO_PATH))
    return c.select(w.alias("cotopic"), (w / most).alias("cotopic_normalized"))
