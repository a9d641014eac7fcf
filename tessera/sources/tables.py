"""Readers and writers of alignments, distance tables, matrices and graphs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.curie import shorten
from tessera.operators.taxonomy import NO_PATH

# ---- readers


def read_lst(spark: SparkSession, path: str) -> DataFrame:
    """``e1, e2, p`` from ``(a, b, p)`` lines; other lines are skipped."""
    pattern = r"^\((.+?),\s*(.+?),\s*(\d\.\d+(?:E-?\d+)?)\)$"
    at = lambda i: F.regexp_extract("value", pattern, i)
    return spark.read.text(path).where(F.col("value").rlike(pattern)).select(at(1).alias("e1"), at(2).alias("e2"), at(3).cast("double").alias("p"))


def read_md(spark: SparkSession, path: str, prefixes: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """``e1, e2, p`` (p = 1) from ``a - b`` lines, identifiers shortened."""
    pattern = r"^(.+?)\s-\s(.+?)$"
    at = lambda i: shorten(F.regexp_extract("value", pattern, i), prefixes)
    return spark.read.text(path).where(F.col("value").rlike(pattern)).select(at(1).alias("e1"), at(2).alias("e2"), F.lit(1.0).alias("p"))


def read_alignment_xml(spark: SparkSession, path: str) -> DataFrame:
    """``e1, e2, relation, p`` from the cells of alignment RDF/XML files."""
    value = "entity1 struct<`_rdf:resource`:string>, entity2 struct<`_rdf:resource`:string>, relation string, measure struct<_VALUE:double>"
    df = spark.read.format("xml").option("rowTag", "Cell").schema(value).load(path)
    return df.select(
        F.col("entity1.`_rdf:resource`").alias("e1"), F.col("entity2.`_rdf:resource`").alias("e2"), "relation", F.col("measure._VALUE").alias("p")
    )


def read_result_xml(spark: SparkSession, path: str) -> DataFrame:
    """``precision, recall`` of evaluation results (``output`` elements)."""
    text = spark.read.option("wholetext", True).text(path)
    at = lambda tag: F.regexp_extract("value", rf"<(?:\w+:)?{tag}[^>]*>\s*([-+.\dEe]+)\s*<", 1).cast("double")
    return text.select(at("precision").alias("precision"), at("recall").alias("recall"))


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    """``i, j, d`` from lines of ``(i,j,d),(i,j,d)...``; lines may be empty."""
    cells = F.explode(F.regexp_extract_all("value", F.lit(r"\((\d+,\d+,[^)]+)\)"), F.lit(1)))
    parts = F.split("c", ",")
    return spark.read.text(path).select(cells.alias("c")).select(
        parts[0].cast("int").alias("i"), parts[1].cast("int").alias("j"), F.trim(parts[2]).cast("double").alias("d")
    )


def merge_sparse(tables: Sequence[DataFrame]) -> DataFrame:
    """``from, to, sim``: per pair the distances ``d`` of all measures ``m`` (the
    place of the table), sorted by measure."""
    rows = None
    for m, t in enumerate(tables):
        one = t.select("i", "j", "d", F.lit(m).alias("m"))
        rows = one if rows is None else rows.unionAll(one)
    sim = F.array_sort(F.collect_list(F.struct("m", "d")))
    return rows.groupBy(F.col("i").alias("from"), F.col("j").alias("to")).agg(F.transform(sim, lambda x: F.struct(x["d"].alias("d"), x["m"].alias("m"))).alias("sim"))


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """``row, col, val`` of coordinates.  Comments are skipped, and in each file
    the size line, the first line of numbers; files of entries only (such as parts
    written by ``matrix_market_lines``) begin with another line and are told by
    their lack of a comment."""
    pattern = r"^\s*(\d+)\s+(\d+)\s+([-+.\dEe]+)\s*$"
    at = lambda i: F.regexp_extract("value", pattern, i)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_n"))
    entry = ~F.col("value").startswith("%") & F.col("value").rlike(pattern)
    files = lines.groupBy("_file").agg(F.max(F.col("value").startswith("%")).alias("_head"), F.min(F.when(entry, F.col("_n"))).alias("_first"))
    return lines.where(entry).join(files, "_file").where(~(F.col("_head") & (F.col("_n") == F.col("_first")))).select(
        at(1).cast("bigint").alias("row"), at(2).cast("bigint").alias("col"), at(3).cast("double").alias("val")
    )


def to_double(c):
    """Number with decimal comma; ``inf`` is the export value of "no path"."""
    return F.when(F.lower(F.trim(c)) == "inf", NO_PATH).otherwise(F.regexp_replace(F.trim(c), ",", ".").try_cast("double"))


def read_distances(spark: SparkSession, path: str, measures: int, with_lcs: bool = False, sep: str = ";", header: bool = True) -> DataFrame:
    """``e1, e2, lcs, dist`` of distance-vector files; labels may be quoted, a
    blank subsumer is null."""
    names = ["e1", "e2", *(["lcs"] if with_lcs else []), *[f"d{k}" for k in range(measures)]]
    df = spark.read.csv(path, sep=sep, quote='"', escape='"', header=header, schema=", ".join(f"{n} string" for n in names), enforceSchema=True)
    lcs = F.nullif(F.trim("lcs"), F.lit("")) if with_lcs else F.lit(None).cast("string")
    return df.select("e1", "e2", lcs.alias("lcs"), F.array(*[to_double(F.col(f"d{k}")) for k in range(measures)]).alias("dist"))


def read_dot(spark: SparkSession, path: str) -> DataFrame:
    """``src, dst`` of the ``"a" -> "b"`` lines of a Graphviz file."""
    pattern = r'"(.+?)" -> "(.+?)"'
    at = lambda i: F.regexp_extract("value", pattern, i)
    return spark.read.text(path).where(F.col("value").rlike(pattern)).select(at(1).alias("src"), at(2).alias("dst"))


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """``i, uri`` from ``i,uri`` lines."""
    at = lambda i: F.regexp_extract("value", r"^(\d+),(.*)$", i)
    return spark.read.text(path).where(F.col("value").rlike(r"^\d+,")).select(at(1).cast("int").alias("i"), at(2).alias("uri"))


def read_import_job(spark: SparkSession, path: str) -> DataFrame:
    """``name, value`` of the leaf elements of a job or source description."""
    leaf = F.explode(F.regexp_extract_all("value", F.lit(r"<(\w+)(?:\s[^>]*)?>[^<]+</\1>"), F.lit(0)))
    text = spark.read.option("wholetext", True).text(path).select(leaf.alias("x"))
    return text.select(F.regexp_extract("x", r"^<(\w+)", 1).alias("name"), F.trim(F.regexp_extract("x", r">([^<]*)<", 1)).alias("value"))


# ---- writers: lines as a column, so that any text sink takes them


def lst_lines(alignment: DataFrame) -> DataFrame:
    return alignment.select(F.concat(F.lit("("), "e1", F.lit(","), "e2", F.lit(","), F.col("p").cast("string"), F.lit(")")).alias("value"))


def sparse_lines(edges: DataFrame, t: float | None = None) -> DataFrame:
    """A line a source: ``(i,j,d),(i,j,d)``; ``t`` keeps distances below it."""
    edges = edges if t is None else edges.where(F.col("d") < t)
    cell = F.concat(F.lit("("), F.col("i").cast("string"), F.lit(","), F.col("j").cast("string"), F.lit(","), F.col("d").cast("string"), F.lit(")"))
    rows = edges.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", cell.alias("c")))).alias("cs"))
    return rows.select(F.array_join(F.transform("cs", lambda c: c["c"]), ",").alias("value"))


def any_below(vectors: DataFrame, t: float, dist: str = "dist") -> DataFrame:
    """Rows with some distance below ``t``."""
    return vectors.where(F.exists(dist, lambda x: x < t))


def ntriples_lines(triples: DataFrame) -> DataFrame:
    """N-Triples of ``s, p, o, o_kind, lang, dtype``."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    node = lambda c: F.when(F.startswith(c, F.lit("_:")), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    tail = F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), "lang")).when(F.col("dtype").isNotNull(), F.concat(F.lit("^^<"), "dtype", F.lit(">"))).otherwise("")
    o = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), esc(F.col("o")), F.lit('"'), tail)).otherwise(node(F.col("o")))
    return triples.select(F.concat(node(F.col("s")), F.lit(" <"), "p", F.lit("> "), o, F.lit(" .")).alias("value"))


def dot_lines(edges: DataFrame, label: str | None = None) -> DataFrame:
    """Edge lines of a Graphviz graph, without its braces."""
    tail = F.concat(F.lit(' [label="'), F.col(label).cast("string"), F.lit('"]')) if label else F.lit("")
    return edges.select(F.concat(F.lit('  "'), F.col("src").cast("string"), F.lit('" -> "'), F.col("dst").cast("string"), F.lit('"'), tail).alias("value"))


def matrix_market_lines(matrix: DataFrame) -> DataFrame:
    """``row col val`` lines that ``read_matrix_market`` reads."""
    return matrix.select(F.concat_ws(" ", F.col("row").cast("string"), F.col("col").cast("string"), F.col("val").cast("string")).alias("value"))


def link_lines(links: DataFrame) -> DataFrame:
    """``= s t`` for confidence 1, ``< c s t`` otherwise."""
    c = F.col("confidence")
    head = F.when(c.isNull(), F.lit("? ")).when(c == 1, F.lit("= ")).otherwise(F.concat(F.lit("< "), c.cast("string"), F.lit(" ")))
    return links.select(F.concat(head, "source", F.lit(" "), "target").alias("value"))


def split_by_confidence(links: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Accepted links and those to verify."""
    return links.where(F.col("confidence") >= least), links.where((F.col("confidence") < least) | F.col("confidence").isNull())


def write_distances(df: DataFrame, path: str, sep: str = ";") -> None:
    """Quoted CSV of ``e1, e2, lcs, dist`` with one column a distance."""
    n = df.select(F.coalesce(F.max(F.size("dist")), F.lit(0))).first()[0]
    cols = [F.get("dist", F.lit(k)).alias(f"d{k}") for k in range(n)]
    df.select("e1", "e2", "lcs", *cols).write.csv(path, sep=sep, header=True, quoteAll=True)


def entity_lines(entities: DataFrame) -> DataFrame:
    return entities.select(F.concat_ws(",", F.col("i").cast("string"), "uri").alias("value"))
