"""Registered queries of the core operators, with the SQL to check them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import aggregate as A
from tessera.functions import corpus
from tessera.functions import distance as D
from tessera.functions import text as X
from tessera.functions.curie import prefix_list, shorten
from tessera.operators import alignment, flooding, hierarchy, identity, learning, pairs, patterns, rules, service
from tessera.operators import taxonomy as G
from tessera.plans.runtime import Workspace, table
from tessera.sources import rdf, tables
from tessera.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


# ---- views of the tables

SHORT = """
    ids AS (SELECT DISTINCT x FROM (SELECT s AS x FROM triples UNION ALL SELECT o FROM triples) WHERE x IS NOT NULL),
    short AS (SELECT x, coalesce(arg_max(prefix || ':' || substr(x, length(uri) + 1), length(uri)), x) AS y
              FROM ids LEFT JOIN prefixes ON starts_with(x, uri) GROUP BY x),
    t AS (SELECT coalesce(a.y, s) AS s, p, coalesce(b.y, o) AS o, o_kind, lang
          FROM triples LEFT JOIN short a ON s = a.x LEFT JOIN short b ON o = b.x)"""
EDGES = """
    edges AS (SELECT DISTINCT s AS src, o AS dst FROM t
              WHERE p IN ('skos:broader', 'dcterms:subject', 'rdfs:subClassOf') AND s IS NOT NULL AND trim(o) <> '')"""
STAR = """
    star AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer
             UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
             UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
             UNION SELECT 'r' || r_regionkey, 'root' FROM region)"""
REACH = """
    reach AS (SELECT src AS s, src AS node, 0 AS depth FROM star
              UNION SELECT reach.s, star.dst, depth + 1 FROM reach JOIN star ON node = star.src)"""
MATCH = "m AS (SELECT DISTINCT e1, e2, p, found_by FROM matchings WHERE e1 IS NOT NULL AND e2 IS NOT NULL AND p IS NOT NULL)"
VECTORS = """
    d AS (SELECT from_idx, to_idx, unnest(sim) AS x FROM sim_edges),
    v AS (SELECT from_idx, to_idx, min(CASE WHEN x.m = 5 AND x.d < 1e300 THEN x.d END) AS d0, min(CASE WHEN x.m = 11 AND x.d < 1e300 THEN x.d END) AS d1,
                 min(CASE WHEN x.m = 12 AND x.d < 1e300 THEN x.d END) AS d2, min(CASE WHEN x.m = 10 THEN x.d END) AS eq
          FROM d GROUP BY from_idx, to_idx)"""
VECTOR_NAMES = ["lev", "sub", "qgr"]


def short_triples(spark: SparkSession, d: str) -> DataFrame:
    names = prefix_list(table(spark, d, "prefixes"))
    t = table(spark, d, "triples")
    return t.withColumn("s", shorten(F.col("s"), names)).withColumn("o", shorten(F.col("o"), names))


def parent_links(spark: SparkSession, d: str) -> DataFrame:
    t = short_triples(spark, d).where(F.col("p").isin("skos:broader", "rdfs:subClassOf"))
    return t.select(F.col("s").alias("child"), F.col("o").alias("parent"))


def star(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers below nations below regions below one root."""
    def edge(name: str, a: str, ka: str, b: str | None, kb: str | None) -> DataFrame:
        df = table(spark, d, name)
        dst = F.concat(F.lit(b), F.col(kb).cast("string")) if b else F.lit("root")
        return df.select(F.concat(F.lit(a), F.col(ka).cast("string")).alias("src"), dst.alias("dst"))

    out = edge("customer", "c", "c_custkey", "n", "c_nationkey").union(edge("supplier", "s", "s_suppkey", "n", "s_nationkey"))
    out = out.union(edge("nation", "n", "n_nationkey", "r", "n_regionkey")).union(edge("region", "r", "r_regionkey", None, None))
    return out.distinct().withColumn("w", F.lit(1).cast("bigint"))


def matchings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "matchings").select("e1", "e2", "p", "found_by").where("e1 is not null and e2 is not null and p is not null").distinct()


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """``e1, e2, dist, eq`` from the similarity edges: Levenshtein, substring and
    q-gram distances, and relaxed equality."""
    x = table(spark, d, "sim_edges").select("from_idx", "to_idx", F.explode("sim").alias("x")).select("from_idx", "to_idx", "x.d", "x.m")
    near = F.col("d") < 1e300
    rows = x.groupBy("from_idx", "to_idx").agg(
        *[F.min(F.when((F.col("m") == m) & near, F.col("d"))).alias(f"d{k}") for k, m in enumerate((5, 11, 12))], F.min(F.when(F.col("m") == 10, F.col("d"))).alias("eq")
    )
    return rows.select(F.col("from_idx").alias("e1"), F.col("to_idx").alias("e2"), F.array("d0", "d1", "d2").alias("dist"), "eq")


def food_labels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cul = table(spark, d, "cul_foods").select("uri", F.lower("food_name").alias("label"))
    return cul, table(spark, d, "wik_foods").select("uri", F.lower("label").alias("label"))


#: Accented letters of the food names and their base: the checking engine counts
#: edits in bytes, so both sides compare plain letters where edits matter.
ACCENTED, PLAIN = "éèêëàâäùûüôöîïçñß", "eeeeaaauuuooiicns"


def plain_labels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return tuple(df.withColumn("label", F.translate("label", ACCENTED, PLAIN)) for df in food_labels(spark, d))


PLAIN_FOODS = f"""
    a AS (SELECT DISTINCT uri, translate(lower(food_name), '{ACCENTED}', '{PLAIN}') AS x FROM cul_foods WHERE food_name IS NOT NULL),
    b AS (SELECT DISTINCT uri, translate(lower(label), '{ACCENTED}', '{PLAIN}') AS y FROM wik_foods WHERE label IS NOT NULL)"""
FOODS = """
    a AS (SELECT DISTINCT uri, lower(food_name) AS x FROM cul_foods WHERE food_name IS NOT NULL),
    b AS (SELECT DISTINCT uri, lower(label) AS y FROM wik_foods WHERE label IS NOT NULL)"""


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return name_alignment(spark, d)


# ---- hierarchies (p1)


P1_SQL = f"""WITH RECURSIVE {SHORT},
    e AS (SELECT DISTINCT s AS c, CASE WHEN trim(o) <> '' THEN o END AS q FROM t WHERE p IN ('skos:broader', 'rdfs:subClassOf') AND trim(s) <> ''),
    l AS (SELECT c, q FROM e WHERE q IS NOT NULL), n AS (SELECT c AS x FROM e UNION SELECT q FROM l),
    r AS (SELECT c AS x, q AS a FROM l UNION SELECT r.x, l.q FROM r JOIN l ON r.a = l.c),
    y AS (SELECT x FROM r WHERE x = a), top AS (SELECT x FROM n WHERE x NOT IN (SELECT c FROM l)),
    g AS (SELECT n.x, count(r.a) AS d, min(r.a) FILTER (r.a IN (SELECT x FROM y)) AS cyc, min(r.a) FILTER (r.a IN (SELECT x FROM top)) AS root
          FROM n LEFT JOIN r ON n.x = r.x GROUP BY n.x)"""


@query(P1_SQL + """
    SELECT x AS node, coalesce(cyc, root, x) AS root_node, CASE WHEN cyc IS NULL THEN d WHEN x IN (SELECT x FROM y) THEN -1 ELSE -2 END::INT AS node_depth FROM g""")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(parent_links(spark, d))


@query(P1_SQL + """,
    z AS (SELECT x, coalesce(root, x) AS root, d FROM g WHERE cyc IS NULL), w AS (SELECT x, a FROM r UNION ALL SELECT x, x FROM n)
    SELECT z.x AS node, z.root AS root_node, z.d::INT AS node_depth, w.a AS ancestor, (z.d - b.d)::INT AS distance FROM z JOIN w ON z.x = w.x JOIN z b ON w.a = b.x""")
def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.paths(parent_links(spark, d))


# ---- similarity joins and alignments

QGRAM_SQL = f"""WITH {FOODS},
    ga AS (SELECT DISTINCT x, substr('#' || x || '#', i, 2) AS g FROM (SELECT DISTINCT x FROM a), unnest(range(1, length(x) + 2)) r(i)),
    gb AS (SELECT DISTINCT y, substr('#' || y || '#', i, 2) AS g FROM (SELECT DISTINCT y FROM b), unnest(range(1, length(y) + 2)) r(i)),
    na AS (SELECT x, count(*) AS n FROM ga GROUP BY x), nb AS (SELECT y, count(*) AS n FROM gb GROUP BY y),
    hits AS (SELECT x, y, count(*) AS k FROM ga JOIN gb USING (g) GROUP BY x, y),
    found AS (SELECT x, y, 1 - k / (na.n + nb.n - k) AS d FROM hits JOIN na USING (x) JOIN nb USING (y)),
    best AS (SELECT a.uri AS e1, b.uri AS e2, min(d) AS p FROM found JOIN a USING (x) JOIN b USING (y) WHERE d <= 0.3 GROUP BY 1, 2)
    """


@query(QGRAM_SQL + "SELECT e1, e2, round(p, 6) AS p FROM best")
def name_alignment(spark: SparkSession, d: str) -> DataFrame:
    return pairs.qgram_join(*food_labels(spark, d), 0.3).select("e1", "e2", F.round("p", 6).alias("p"))


@query(f"""WITH {PLAIN_FOODS}, f AS (
    SELECT a.uri AS e1, b.uri AS e2, min(levenshtein(x, y) / greatest(length(x), length(y))) AS p FROM a, b
    WHERE abs(length(x) - length(y)) <= 0.2 * greatest(length(x), length(y)) GROUP BY 1, 2)
    SELECT e1, e2, round(p, 6) AS p FROM f WHERE p <= 0.2""")
def levenshtein_alignment(spark: SparkSession, d: str) -> DataFrame:
    return pairs.levenshtein_join(*plain_labels(spark, d), 0.2).select("e1", "e2", F.round("p", 6).alias("p"))


@query(f"WITH {FOODS} SELECT DISTINCT a.uri AS e1, b.uri AS e2, 0.0::DOUBLE AS p FROM a JOIN b ON x = y")
def equality_alignment(spark: SparkSession, d: str) -> DataFrame:
    return pairs.equality_join(*food_labels(spark, d))


@query(f"WITH {FOODS} SELECT DISTINCT a.uri AS e1, b.uri AS e2, 0.0::DOUBLE AS p FROM a JOIN b ON strip_accents(x) = strip_accents(y)")
def relaxed_alignment(spark: SparkSession, d: str) -> DataFrame:
    return pairs.relaxed_join(*food_labels(spark, d))


@query("""WITH n AS (SELECT DISTINCT p_name AS x FROM part)
    SELECT a.x AS e1, b.x AS e2, round(1 - jaro_similarity(a.x, b.x), 6) AS p FROM n a JOIN n b ON substr(a.x, 1, 1) = substr(b.x, 1, 1)
    WHERE 1 - jaro_similarity(a.x, b.x) <= 0.3""")
def jaro_blocked(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "part").select(F.col("p_name").alias("e"), F.col("p_name").alias("label"))
    out = pairs.blocked_join(n, n, lambda c: F.array(F.substring(c, 1, 1)), D.jaro_standard, 0.3)
    return out.select("e1", "e2", F.round("p", 6).alias("p"))


@query()
def distance_vectors(spark: SparkSession, d: str) -> DataFrame:
    cul, wik = food_labels(spark, d)
    return pairs.all_vectors(cul, wik, prefilter=0.4)


@query("""SELECT s_name AS e2, min(levenshtein('Supplier#000000042', s_name) / greatest(18, length(s_name))) AS levenshtein,
    min(CASE WHEN s_name = 'Supplier#000000042' THEN 0.0 ELSE 1.0 END)::DOUBLE AS equality FROM supplier GROUP BY s_name""")
def one_against_all(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_name", F.col("s_name").alias("label"))
    return pairs.one_against_all("Supplier#000000042", s, {k: D.DISTANCES[k] for k in ("levenshtein", "equality")})


@query("""WITH n AS (SELECT DISTINCT p_name AS x FROM part)
    SELECT a.x AS e1, b.x AS e2, (-levenshtein(a.x, b.x))::DOUBLE AS nw FROM n a JOIN n b ON a.x <= b.x""")
def alignment_scores(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "part").select("p_name").distinct()
    a, b = n.select(F.col("p_name").alias("e1")), n.select(F.col("p_name").alias("e2"))
    # the distinct names of a small product list, all against all
    return a.join(b, F.col("e1") <= F.col("e2")).select("e1", "e2", D.needleman_wunsch(F.col("e1"), F.col("e2")).alias("nw"))


@query(QGRAM_SQL + "SELECT e1, e2, CASE WHEN p <= 0.05 THEN 'tight' WHEN p <= 0.2 THEN 'near' ELSE 'loose' END AS bucket FROM best")
def threshold_buckets(spark: SparkSession, d: str) -> DataFrame:
    found = pairs.qgram_join(*food_labels(spark, d), 0.3)
    return pairs.buckets(found, {"tight": 0.05, "near": 0.2, "loose": 0.3}).select("e1", "e2", "bucket")


@query(QGRAM_SQL + "SELECT e1 AS source, e2 AS target, round(1 - p / 0.25, 6) AS confidence FROM best WHERE p <= 0.25")
def rule_links(spark: SparkSession, d: str) -> DataFrame:
    # the join gives each pair's smallest distance over all names, which is the rule's
    (a, b), rule = food_labels(spark, d), rules.Comparison("name", "name", D.DISTANCES["qgrams-2"], 0.25, True, distance="p")
    near = pairs.qgram_join(a, b, 0.25).select(F.col("e1").alias("source"), F.col("e2").alias("target"), "p")
    return rules.generate_links(rule, a, b, candidates=near).select("source", "target", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH c AS (SELECT DISTINCT uri, translate(lower(food_name), '{ACCENTED}', '{PLAIN}') AS x, country_code AS k FROM cul_foods WHERE country_code IS NOT NULL AND food_name IS NOT NULL),
    w AS (SELECT DISTINCT uri, translate(lower(label), '{ACCENTED}', '{PLAIN}') AS y, country_code AS k FROM wik_foods JOIN places ON origin = place_name WHERE label IS NOT NULL),
    q AS (SELECT DISTINCT c.uri AS source, w.uri AS target, 1.0 AS code FROM c JOIN w ON c.k = w.k),
    p AS (SELECT source, target, code, min(levenshtein(x, y) / greatest(length(x), length(y))) AS d
          FROM q JOIN c ON source = c.uri JOIN w ON target = w.uri GROUP BY ALL)
    SELECT source, target, round((code + CASE WHEN d <= 0.6 THEN 1 - d / 0.3 ELSE -1.0 END) / 2, 6) AS confidence FROM p
    WHERE (code + CASE WHEN d <= 0.6 THEN 1 - d / 0.3 ELSE -1.0 END) / 2 >= 0""")
def name_and_code_links(spark: SparkSession, d: str) -> DataFrame:
    cul = table(spark, d, "cul_foods").where("country_code is not null and food_name is not null")
    wik = table(spark, d, "wik_foods").where("label is not null").join(table(spark, d, "places"), F.col("origin") == F.col("place_name"))
    sets = lambda df, n, c: df.groupBy("uri").agg(F.collect_set(F.translate(F.lower(n), ACCENTED, PLAIN)).alias("name"), F.collect_set(c).alias("code"))
    rule = rules.Aggregation([rules.Comparison("code", "code", D.equality, 0.0, True), rules.Comparison("name", "name", D.levenshtein, 0.3)])
    out = rules.generate_links(rule, sets(cul, "food_name", "country_code"), sets(wik, "label", "country_code"), lambda: F.col("code"), lambda: F.col("code"))
    return out.select("source", "target", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {PLAIN_FOODS}, f AS (
    SELECT a.uri AS source, b.uri AS target, min(1 - jaro_winkler_similarity(x, y)) AS d FROM a, b
    WHERE abs(length(x) - length(y)) <= 0.5 * greatest(length(x), length(y)) GROUP BY 1, 2)
    SELECT source, target, round(1 - d / 0.04, 6) AS confidence FROM f WHERE d <= 0.04""")
def jaro_winkler_rule(spark: SparkSession, d: str) -> DataFrame:
    cul, wik = plain_labels(spark, d)
    sets = lambda df: df.where("label is not null").groupBy("uri").agg(F.collect_set("label").alias("name"))
    rule, a, b = rules.Comparison("name", "name", D.jaro_winkler_standard, 0.04, True), sets(cul), sets(wik)
    out = rules.generate_links(rule, a, b, candidates=rules.required_pairs(rule, a, b))
    return out.select("source", "target", F.round("confidence", 6).alias("confidence"))


STATS = """
    s AS (SELECT {keys} tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rc FROM c)
    SELECT {keys} tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(pr, 6) AS "precision", round(rc, 6) AS recall,
      round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END, 6) AS f1,
      round(CASE WHEN pr + rc > 0 THEN 3 * pr * rc / (2 * pr + rc) ELSE 0 END, 6) AS f2,
      round(CASE WHEN pr + rc > 0 THEN 1.5 * pr * rc / (0.5 * pr + rc) ELSE 0 END, 6) AS f05 FROM s"""


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"""WITH {MATCH}, k AS (SELECT DISTINCT least(e1, e2) AS a, greatest(e1, e2) AS b, p, found_by FROM m),
    g AS (SELECT DISTINCT a, b FROM k WHERE p <= 0.1), r AS (SELECT DISTINCT a, b FROM k WHERE found_by = 'manual'),
    j AS (SELECT g.a AS ga, r.a AS ra FROM g FULL JOIN r ON g.a = r.a AND g.b = r.b),
    c AS (SELECT count(*) FILTER (ga IS NOT NULL AND ra IS NOT NULL) AS tp, count(*) FILTER (ra IS NULL) AS fp, count(*) FILTER (ga IS NULL) AS fn FROM j),""" + STATS.format(keys=""))
def alignment_statistics(spark: SparkSession, d: str) -> DataFrame:
    m = matchings(spark, d)
    return rounded(alignment.statistics(m.where("p <= 0.1"), m.where("found_by = 'manual'")))


@query(f"""WITH {MATCH}, k AS (SELECT least(e1, e2) AS a, greatest(e1, e2) AS b, p, found_by FROM m),
    g AS (SELECT a, b, min(p) AS p FROM k GROUP BY a, b), r AS (SELECT DISTINCT a, b FROM k WHERE found_by = 'manual'),
    j AS (SELECT g.*, r.a IS NOT NULL AS hit FROM g LEFT JOIN r ON g.a = r.a AND g.b = r.b),
    ts AS (SELECT i / 1000 AS t FROM range(1, 1000, 10) x(i)),
    c AS (SELECT t, count(*) FILTER (p <= t AND hit) AS tp, count(*) FILTER (p <= t AND NOT hit) AS fp,
                 (SELECT count(*) FROM r) - count(*) FILTER (p <= t AND hit) AS fn FROM ts, j GROUP BY t),""" + STATS.format(keys="t,"))
def alignment_sweep(spark: SparkSession, d: str) -> DataFrame:
    m = matchings(spark, d)
    return rounded(alignment.sweep(m, m.where("found_by = 'manual'")))


@query(f"""WITH {MATCH}, x AS (SELECT DISTINCT e1, e2, p FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY e1 ORDER BY p, e2) AS k FROM x)
    SELECT e1, e2, p FROM r WHERE k = 1""")
def alignment_best(spark: SparkSession, d: str) -> DataFrame:
    return alignment.best(matchings(spark, d).select("e1", "e2", "p").distinct())


SETS = f"""WITH {MATCH}, x AS (SELECT DISTINCT e1, e2, p FROM m WHERE found_by = 'name'), y AS (SELECT DISTINCT e1, e2, p FROM m WHERE found_by = 'manual'),
    k AS (SELECT DISTINCT least(e1, e2) AS a, greatest(e1, e2) AS b FROM y)"""


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m = matchings(spark, d)
    return tuple(m.where(F.col("found_by") == k).select("e1", "e2", "p").distinct() for k in ("name", "manual"))


@query(SETS + " SELECT x.* FROM x SEMI JOIN k ON least(e1, e2) = a AND greatest(e1, e2) = b")
def alignment_intersect(spark: SparkSession, d: str) -> DataFrame:
    return alignment.intersect(*_two(spark, d))


@query(SETS + " SELECT x.* FROM x ANTI JOIN k ON least(e1, e2) = a AND greatest(e1, e2) = b")
def alignment_subtract(spark: SparkSession, d: str) -> DataFrame:
    return alignment.subtract(*_two(spark, d))


@query(SETS + " SELECT * FROM x UNION SELECT * FROM y")
def alignment_union(spark: SparkSession, d: str) -> DataFrame:
    return alignment.union(*_two(spark, d))


@query(SETS + " SELECT e1 AS e FROM x UNION SELECT e2 FROM x")
def alignment_entities(spark: SparkSession, d: str) -> DataFrame:
    return alignment.entities(_two(spark, d)[0])


@query(SETS + """, l AS (SELECT DISTINCT x.e1 AS k, x.e2 AS v FROM x), r AS (SELECT DISTINCT e1 AS k, e2 AS v FROM y)
    SELECT DISTINCT l.v AS e1, r.v AS e2 FROM l JOIN r USING (k)""")
def alignment_compose(spark: SparkSession, d: str) -> DataFrame:
    return alignment.compose(*_two(spark, d))


@query(f"""WITH {VECTORS}, w(m0, m1, m2) AS (VALUES (1.0, 1.0, 3.0)),
    x AS (SELECT from_idx AS e1, to_idx AS e2, d, w FROM v, w, LATERAL (VALUES (d0, m0), (d1, m1), (d2, m2)) u(d, w) WHERE d IS NOT NULL)
    SELECT e1, e2, round(min(d), 6) AS "min", round(max(d), 6) AS "max", round(sum(d * w)::DOUBLE / sum(w)::DOUBLE, 6) AS average,
      round(CASE WHEN min(d) <= 0 THEN 0 ELSE exp(sum(w::DOUBLE * ln(CASE WHEN d > 0 THEN d ELSE 1 END)) / sum(w)::DOUBLE) END, 6) AS "geoMean",
      round(sqrt(sum(w::DOUBLE * d * d) / sum(w)::DOUBLE), 6) AS "quadMean" FROM x GROUP BY e1, e2""")
def vector_aggregates(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).where(F.exists("dist", lambda x: x.isNotNull()))
    return v.select("e1", "e2", *[F.round(A.aggregate(k, F.col("dist"), [1.0, 1.0, 3.0]), 6).alias(k) for k in A.AGGREGATORS])


GRID_T = [0.1, 0.2, 0.3]


def _grid_sql() -> str:
    parts = []
    for ws in [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1) if a + b + c]:
        ds = [f"d{k}" for k, w in enumerate(ws) if w]
        listed = f"list_filter([{', '.join(ds)}], lambda x: x IS NOT NULL)"
        label = "+".join(n for n, w in zip(VECTOR_NAMES, ws) if w)
        parts += [f"SELECT '{name}' AS aggregator, '{label}' AS weighting, from_idx, to_idx, eq, {fn}({listed}) AS p FROM v" for name, fn in (("average", "list_avg"), ("min", "list_min"))]
    ts = ", ".join(f"({t})" for t in GRID_T)
    return f"""WITH {VECTORS}, x AS ({' UNION ALL '.join(parts)}), ts(t) AS (SELECT col0::DOUBLE FROM (VALUES {ts})),
        k AS (SELECT aggregator, weighting, least(from_idx, to_idx) AS a, greatest(from_idx, to_idx) AS b, min(p) AS p FROM x WHERE p IS NOT NULL GROUP BY ALL),
        r AS (SELECT DISTINCT least(from_idx, to_idx) AS a, greatest(from_idx, to_idx) AS b FROM v WHERE eq = 0),
        j AS (SELECT k.*, r.a IS NOT NULL AS hit FROM k LEFT JOIN r ON k.a = r.a AND k.b = r.b),
        c AS (SELECT aggregator, weighting, t, count(*) FILTER (p <= t AND hit) AS tp, count(*) FILTER (p <= t AND NOT hit) AS fp,
              (SELECT count(*) FROM r) - count(*) FILTER (p <= t AND hit) AS fn FROM ts, j GROUP BY ALL),""" + STATS.format(keys="aggregator, weighting, t,")


@query(_grid_sql())
def weight_grid_search(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    found = alignment.grid_search(v, v.where("eq = 0"), VECTOR_NAMES, ["min", "average"], GRID_T)
    return rounded(found)


@query(f"""WITH {VECTORS}, k AS (SELECT *, least(from_idx, to_idx) AS a, greatest(from_idx, to_idx) AS b FROM v),
    r AS (SELECT DISTINCT a, b FROM k WHERE eq = 0)
    SELECT from_idx AS e1, to_idx AS e2, (r.a IS NOT NULL)::INT::DOUBLE AS label FROM k LEFT JOIN r USING (a, b)
    WHERE (r.a IS NOT NULL AND NOT (coalesce(d0, 0) + coalesce(d1, 0) + coalesce(d2, 0) = 0 AND coalesce(d0, d1, d2) IS NOT NULL))
       OR (r.a IS NULL AND (coalesce(d0 <= 0.43, false) OR coalesce(d1 <= 0.144, false) OR coalesce(d2 <= 0.5, false)))""")
def training_selection(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return learning.training_data(v, v.where("eq = 0"), {0: 0.43, 1: 0.144, 2: 0.5}).select("e1", "e2", "label")


@query()
def decision_tree(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    data = learning.training_data(v, v.where("eq = 0"), {0: 0.43, 1: 0.144, 2: 0.5})
    model = learning.decision_tree(data, [0, 1, 2])
    return model.transform(learning.with_features(data, [0, 1, 2])).groupBy("label", "prediction").agg(F.count("*").alias("n"))


# ---- identifiers, labels, texts


@query(f"WITH {SHORT} SELECT x AS id, y AS short FROM short")
def curie_shorten(spark: SparkSession, d: str) -> DataFrame:
    names = prefix_list(table(spark, d, "prefixes"))
    t = table(spark, d, "triples")
    ids = t.select(F.col("s").alias("id")).unionAll(t.select("o")).where("id is not null").distinct()
    return ids.select("id", shorten(F.col("id"), names).alias("short"))


@query(f"WITH {SHORT}, {EDGES} SELECT src, dst, 1::BIGINT AS w FROM edges")
def taxonomy_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.from_triples(table(spark, d, "triples"), prefixes=prefix_list(table(spark, d, "prefixes")))


@query(f"""WITH {SHORT} SELECT s AS uri, count(DISTINCT o)::BIGINT AS n, min(o) AS "first" FROM t WHERE p = 'rdfs:label' AND o IS NOT NULL GROUP BY s""")
def label_map(spark: SparkSession, d: str) -> DataFrame:
    return G.labels(short_triples(spark, d)).select("uri", F.size("labels").cast("bigint").alias("n"), F.col("labels")[0].alias("first"))


@query("""SELECT uri, food_name, regexp_matches('category:' || replace(food_name, ' ', '_'),
    'category:\\d\\d\\d\\d_.+|category:.+?_\\d\\d\\d\\d|category:.+?_of_.+|category:.+?_in_.+|category:.+?_births|category:.+?_deaths|category:.+?_albums') AS gathers
    FROM (SELECT uri, label AS food_name FROM entity_labels WHERE label IS NOT NULL GROUP BY ALL)""")
def aggregate_categories(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entity_labels").where("label is not null").select("uri", F.col("label").alias("food_name")).distinct()
    return rows.select("uri", "food_name", G.is_aggregate(F.concat(F.lit("category:"), F.replace("food_name", F.lit(" "), F.lit("_")))).alias("gathers"))


@query("""WITH n AS (SELECT DISTINCT food_name AS x FROM cul_foods)
    SELECT x, nullif(trim(regexp_replace(lower(x), '[''()?.\\s_\\-]', '', 'g')), '') AS norm, replace(replace(replace(lower(x), '.', ''), '_', ''), ' ', '') AS isub FROM n""")
def normalized_names(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "cul_foods").select(F.col("food_name").alias("x")).distinct()
    return n.select("x", X.normalize_name(F.col("x")).alias("norm"), X.isub_normalize(F.col("x")).alias("isub"))


TOKENS = """
    w AS (SELECT DISTINCT doc, lower(u) AS token, count(*) AS tf FROM (SELECT uri AS doc, unnest(string_split_regex(food_name, '[\\s,.()''/]+')) AS u FROM docs)
          WHERE length(u) >= 2 AND regexp_matches(u, '[^0-9]') AND NOT regexp_matches(u, '^[–\\-.,]+$') GROUP BY ALL)"""
DOCS = "docs AS (SELECT uri, min(food_name) AS food_name FROM cul_foods GROUP BY uri)"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cul_foods").groupBy(F.col("uri").alias("id")).agg(F.min("food_name").alias("label"))


@query(f"""WITH {DOCS}, {TOKENS}, n AS (SELECT uri, coalesce(sum(tf), 0)::BIGINT AS k FROM docs LEFT JOIN w ON uri = doc GROUP BY uri)
    SELECT k::INT AS n_tokens, count(*) AS n FROM n GROUP BY k""")
def token_lengths(spark: SparkSession, d: str) -> DataFrame:
    return corpus.length_distribution(_docs(spark, d))


@query(f"WITH {DOCS}, {TOKENS} SELECT token, round(ln((SELECT count(*) FROM docs) / count(DISTINCT doc)), 6) AS idf FROM w GROUP BY token")
def token_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(corpus.idf(_docs(spark, d)))


@query(f"""WITH {DOCS}, {TOKENS}, i AS (SELECT token, ln((SELECT count(*) FROM docs) / count(DISTINCT doc)) AS idf FROM w GROUP BY token),
    u AS (SELECT doc, token, ln(tf + 1) * idf AS u FROM w JOIN i USING (token)),
    v AS (SELECT doc, token, u / sqrt(sum(u * u) OVER (PARTITION BY doc)) AS v FROM u),
    s AS (SELECT a.doc AS id1, b.doc AS id2, sum(a.v * b.v) AS sim FROM v a JOIN v b USING (token) WHERE a.doc < b.doc GROUP BY 1, 2)
    SELECT id1, id2, round(sim, 5) AS sim FROM s WHERE sim > 0.9""")
def tfidf_pairs(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    found = corpus.tfidf(docs, docs, corpus.idf(docs), 0.9)
    return found.where("id1 < id2").select("id1", "id2", F.round("sim", 5).alias("sim"))


@query()
def soft_tfidf_pairs(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    wik = table(spark, d, "wik_foods").groupBy(F.col("uri").alias("id")).agg(F.min("label").alias("label"))
    return corpus.soft_tfidf(docs, wik, corpus.idf(docs), lambda a, b: 1 - D.jaro_winkler_standard(a, b), 0.9, 0.8,
        # the bonus for equal first signs takes off at most four tenths
        candidates=lambda x, y: pairs.jaro_candidates(x, y, 0.1 / 0.6))


@query()
def phonetic_codes(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "cul_foods").select(F.col("food_name").alias("x")).distinct()
    return n.select("x", X.soundex(F.col("x")).alias("soundex"), X.nysiis(F.col("x")).alias("nysiis"), X.metaphone(F.col("x")).alias("metaphone"))


@query("""WITH b AS (SELECT s, o, list_position(['en', 'fr', 'es'], lang) AS r FROM triples WHERE p = 'rdfs:label' AND lang IN ('en', 'fr', 'es') AND trim(o) <> ''),
    k AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY r, o) AS n FROM b)
    SELECT s, o AS label FROM k WHERE n = 1""")
def minted_labels(spark: SparkSession, d: str) -> DataFrame:
    out = identity.mint(table(spark, d, "triples"), "")
    return out.select("s", F.replace(F.url_decode("minted"), F.lit("_"), F.lit(" ")).alias("label"))


@query(f"""WITH RECURSIVE {MATCH}, e AS (SELECT e1 AS a, e2 AS b FROM m UNION SELECT e2, e1 FROM m),
    r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
    SELECT a AS id, min(b) AS canonical FROM r GROUP BY a""")
def same_as_groups(spark: SparkSession, d: str) -> DataFrame:
    return identity.same_as_groups(matchings(spark, d))


@query(f"""WITH RECURSIVE {MATCH}, e AS (SELECT e1 AS a, e2 AS b FROM m UNION SELECT e2, e1 FROM m),
    r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a, min(b) AS k FROM r GROUP BY a)
    SELECT DISTINCT coalesce(x.k, s) AS s, p, coalesce(y.k, o) AS o FROM triples LEFT JOIN c x ON s = x.a LEFT JOIN c y ON o = y.a""")
def rewritten_statements(spark: SparkSession, d: str) -> DataFrame:
    return identity.rewrite(table(spark, d, "triples").select("s", "p", "o"), matchings(spark, d))


@query(f"""WITH {SHORT}, k AS (SELECT DISTINCT e1 AS id FROM matchings WHERE e1 IS NOT NULL), ty AS (SELECT DISTINCT s, o FROM t SEMI JOIN k ON s = id WHERE p = 'dcterms:subject' AND o IS NOT NULL)
    SELECT s, o FROM ty""")
def concept_types(spark: SparkSession, d: str) -> DataFrame:
    t = short_triples(spark, d)
    ids = table(spark, d, "matchings").select(F.col("e1").alias("id")).where("id is not null")
    return G.sub_dataset(t, ids).where("p = 'dcterms:subject'").select("s", "o")


@query(f"""WITH n AS (SELECT DISTINCT uri, lower(food_name) AS x FROM cul_foods WHERE food_name IS NOT NULL),
    g AS (SELECT DISTINCT x, substr('###' || x || '###', i, 4) AS g FROM (SELECT DISTINCT x FROM n), unnest(range(1, length(x) + 4)) r(i)),
    c AS (SELECT x, count(*) AS k FROM g GROUP BY x),
    h AS (SELECT a.x AS x, b.x AS y, count(*) AS k FROM g a JOIN g b USING (g) GROUP BY 1, 2),
    f AS (SELECT h.x, h.y, 1 - h.k / (p.k + q.k - h.k) AS d FROM h JOIN c p ON h.x = p.x JOIN c q ON h.y = q.x),
    e AS (SELECT a.uri AS e1, b.uri AS e2, min(d) AS p FROM f JOIN n a ON f.x = a.x JOIN n b ON f.y = b.x WHERE d <= 0.5 GROUP BY 1, 2)
    SELECT e1, e2, round(p, 6) AS p FROM e WHERE e1 < e2""")
def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return pairs.duplicates(food_labels(spark, d)[0], 0.5, 4).select("e1", "e2", F.round("p", 6).alias("p"))


# ---- taxonomy


@query(f"WITH RECURSIVE {STAR}, {REACH} SELECT s, node, min(depth)::BIGINT AS depth FROM reach GROUP BY s, node")
def taxonomy_closure(spark: SparkSession, d: str) -> DataFrame:
    e = star(spark, d)
    return G.reachable(e, e.select(F.col("src").alias("id")).distinct())


@query(f"""WITH RECURSIVE {SHORT}, {EDGES}, roots AS (SELECT DISTINCT dst AS root FROM edges WHERE dst NOT IN (SELECT src FROM edges)),
    r AS (SELECT root, root AS node FROM roots UNION SELECT r.root, src FROM r JOIN edges ON node = dst)
    SELECT root, count(*)::BIGINT AS nodes FROM r GROUP BY root""")
def root_subtrees(spark: SparkSession, d: str) -> DataFrame:
    e = G.from_triples(short_triples(spark, d))
    roots = G.leafs(G.reverse(e))
    return G.subtree_sizes(e, roots, roots.limit(0)).select("root", "nodes")


@query(f"WITH {SHORT}, {EDGES} SELECT DISTINCT src AS id FROM edges WHERE src NOT IN (SELECT dst FROM edges)")
def taxonomy_leafs(spark: SparkSession, d: str) -> DataFrame:
    return G.leafs(G.from_triples(short_triples(spark, d)))


@query(f"""WITH RECURSIVE {STAR}, {REACH} SELECT s AS i, node AS j, min(depth)::BIGINT AS d FROM reach GROUP BY s, node
    UNION SELECT 'root', 'root', 0""")
def all_distances(spark: SparkSession, d: str) -> DataFrame:
    return G.all_distances(star(spark, d))


@query("""WITH p AS (SELECT 'c' || c_custkey AS s, 's' || s_suppkey AS t, c_nationkey AS cn, s_nationkey AS sn
        FROM (SELECT DISTINCT o_custkey, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey) JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
    q AS (SELECT s, t, CASE WHEN cn = sn THEN 'n' || cn WHEN a.n_regionkey = b.n_regionkey THEN 'r' || a.n_regionkey ELSE 'root' END AS lcs
          FROM p JOIN nation a ON cn = a.n_nationkey JOIN nation b ON sn = b.n_nationkey)
    SELECT s, t, lcs, CASE lcs[1:1] WHEN 'n' THEN 2.0 WHEN 'r' THEN CASE WHEN lcs = 'root' THEN 6.0 ELSE 4.0 END END::DOUBLE AS cotopic, round(cotopic / 77, 6) AS cotopic_normalized,
      round(CASE WHEN lcs = 'root' THEN 0 WHEN lcs[1:1] = 'n' THEN 4 / 6 ELSE 2 / 6 END, 6) AS wu_palmer_sim FROM q""")
def taxonomy_similarity(spark: SparkSession, d: str) -> DataFrame:
    # all customers and suppliers that an order brought together
    sold = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_suppkey").distinct()
    sold = sold.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    two = sold.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("s"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("t"))
    return G.similarity(star(spark, d), two, "root").select("s", "t", "lcs", "cotopic", F.round("cotopic_normalized", 6).alias("cotopic_normalized"), F.round("wu_palmer_sim", 6).alias("wu_palmer_sim"))


LEAVES = """n AS (SELECT 'c' || c_custkey AS s, c_nationkey AS k FROM customer UNION SELECT 's' || s_suppkey, s_nationkey FROM supplier),
    w AS (SELECT s, 'n' || k AS a, 'r' || n_regionkey AS b FROM n JOIN nation ON k = n_nationkey)"""


def to_root(spark: SparkSession, d: str) -> DataFrame:
    c, s = (table(spark, d, t).select(F.concat(F.lit(t[0]), F.col(k).cast("string")).alias("s")) for t, k in (("customer", "c_custkey"), ("supplier", "s_suppkey")))
    return c.unionAll(s).distinct().withColumn("t", F.lit("root"))


@query(f"WITH {LEAVES} SELECT s, 'root' AS t, 3::BIGINT AS d, s || '>' || a || '>' || b AS path FROM w")
def shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    return G.shortest_paths(star(spark, d), to_root(spark, d)).select("s", "t", "d", F.array_join(F.transform("path", lambda x: x["node"]), ">").alias("path"))


@query(f"WITH {LEAVES} SELECT s, 'root' AS t, s || '>' || a || '>' || b || '>root' AS path FROM w")
def all_paths(spark: SparkSession, d: str) -> DataFrame:
    return G.all_paths(star(spark, d), to_root(spark, d)).select("s", "t", F.array_join("path", ">").alias("path"))


@query(f"""WITH {STAR}, c AS (SELECT 'c' || c_custkey AS s FROM customer)
    SELECT s, src, dst FROM c JOIN star ON src = s UNION SELECT c.s, y.src, y.dst FROM c JOIN star x ON x.src = s JOIN star y ON y.src = x.dst""")
def environments(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    return G.environment(star(spark, d), c, 2).select("s", "src", "dst")


@query("""WITH n AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation), p AS (SELECT CASE WHEN a.r = b.r THEN 2 ELSE 4 END AS len FROM n a JOIN n b ON a.k <> b.k)
    SELECT len::BIGINT AS len, count(*) AS n FROM p GROUP BY len""")
def path_length_histogram(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"))
    return G.path_length_histogram(star(spark, d), n)


@query(f"WITH {SHORT}, {EDGES}, n AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges) SELECT id, row_number() OVER (ORDER BY id) - 1 AS code FROM n")
def numeric_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.numeric(G.from_triples(short_triples(spark, d)))[1]


@query(f"""WITH RECURSIVE {SHORT}, {EDGES}, m AS (SELECT DISTINCT e1 AS e FROM matchings UNION SELECT e2 FROM matchings),
    roots AS (SELECT DISTINCT dst AS root FROM edges WHERE dst NOT IN (SELECT src FROM edges)),
    r AS (SELECT root, root AS node FROM roots UNION SELECT r.root, src FROM r JOIN edges ON node = dst)
    SELECT root, count(e)::BIGINT AS matched, count(*)::BIGINT AS nodes, round(count(e) / count(*), 6) AS ratio FROM r LEFT JOIN (SELECT e FROM m WHERE e IS NOT NULL) ON node = e GROUP BY root""")
def hierarchy_coverage(spark: SparkSession, d: str) -> DataFrame:
    e = G.from_triples(short_triples(spark, d))
    named = alignment.entities(table(spark, d, "matchings").select("e1", "e2")).where("e is not null").select(F.col("e").alias("id"))
    sizes = G.subtree_sizes(e, G.leafs(G.reverse(e)), named)
    return rounded(sizes.select("root", F.col("marked").alias("matched"), "nodes", (F.col("marked") / F.col("nodes")).alias("ratio")))


@query(f"WITH {STAR} SELECT src, dst FROM star WHERE src[1:1] IN ('c', 's')")
def cleaned_star(spark: SparkSession, d: str) -> DataFrame:
    # each round takes the edges into nodes without a parent: root, then regions
    return G.cleanup(star(spark, d), 2).select("src", "dst")


@query()
def similarity_flooding(spark: SparkSession, d: str) -> DataFrame:
    g = star(spark, d).where("src like 'n%' or src like 'r%'").select("src", "dst")
    ids = G.nodes(g)
    start = ids.select(F.col("id").alias("x"), F.col("id").alias("y"), F.lit(1.0).alias("s0"))
    return flooding.similarity_flooding(g, g, start).select("x", "y", F.round("sim", 6).alias("sim"))


# ---- graph patterns


@query(f"""WITH {SHORT} SELECT DISTINCT a.s AS b, a.o AS x, l.o AS label FROM t a JOIN t l ON a.s = l.s AND l.p = 'rdfs:label'
    WHERE a.p = 'dcterms:subject' AND a.o IS NOT NULL AND l.o IS NOT NULL""")
def pattern_join(spark: SparkSession, d: str) -> DataFrame:
    t = short_triples(spark, d).where("o is not null")
    return patterns.select(patterns.bgp(t, [("?b", "dcterms:subject", "?x"), ("?b", "rdfs:label", "?label")]), distinct=True)


@query(f"""WITH {SHORT}, b AS (SELECT DISTINCT s AS b FROM t WHERE p = 'rdf:type' AND o = 'agr:Foodstuff')
    SELECT DISTINCT b, e.o AS energy FROM b LEFT JOIN t e ON e.s = b AND e.p = 'agr:energy' AND e.o IS NOT NULL""")
def pattern_optional(spark: SparkSession, d: str) -> DataFrame:
    t = short_triples(spark, d).where("o is not null")
    typed = patterns.match(t, ("?b", "rdf:type", "agr:Foodstuff"))
    return patterns.select(patterns.join(typed, patterns.match(t, ("?b", "agr:energy", "?energy")), optional=True), distinct=True)


@query(f"""WITH RECURSIVE {SHORT}, e AS (SELECT DISTINCT s, o FROM t WHERE p = 'skos:broader' AND trim(o) <> ''),
    top AS (SELECT DISTINCT o AS root FROM e WHERE o NOT IN (SELECT s FROM e)),
    r AS (SELECT root, root AS x FROM top UNION SELECT root, e.s FROM r JOIN e ON e.o = x)
    SELECT root, x FROM r""")
def property_path(spark: SparkSession, d: str) -> DataFrame:
    t = short_triples(spark, d)
    e = G.from_triples(t, ["skos:broader"])
    return G.subsumed(e, G.leafs(G.reverse(e))).select("root", F.col("node").alias("x"))


@query(f"""WITH {SHORT} SELECT DISTINCT s, 'rdfs:label' AS p, o FROM t WHERE p IN ('rdfs:label', 'foaf:name') AND s IS NOT NULL AND o IS NOT NULL""")
def pattern_construct(spark: SparkSession, d: str) -> DataFrame:
    t = short_triples(spark, d)
    rows = patterns.union(patterns.match(t, ("?b", "rdfs:label", "?label")), patterns.match(t, ("?b", "foaf:name", "?label")))
    return patterns.construct(rows, [("?b", "rdfs:label", "?label")])


@query("""SELECT p AS path, round(count(DISTINCT s) / (SELECT count(DISTINCT s) FROM triples), 6) AS frequency FROM triples GROUP BY p""")
def path_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rules.path_frequencies(table(spark, d, "triples")))


# ---- service


@query("""SELECT uri, ((position('tea' IN lower(uri)) - 1) * length(uri))::INT AS rank FROM (SELECT DISTINCT uri FROM entity_list)
    WHERE contains(lower(uri), 'tea') ORDER BY rank, uri LIMIT 10""")
def entity_search(spark: SparkSession, d: str) -> DataFrame:
    return service.search(table(spark, d, "entity_list"), "tea")


@query("""WITH n AS (SELECT from_idx AS i, min(x.d) AS d FROM (SELECT from_idx, unnest(sim) AS x FROM sim_edges) GROUP BY 1)
    SELECT CASE WHEN d = 0 THEN 'exact' WHEN d <= 0.2 THEN 'approximate' ELSE 'none' END AS kind, count(*) AS n
    FROM (SELECT DISTINCT i FROM entity_list WHERE side = 'source') LEFT JOIN n USING (i) GROUP BY 1""")
def match_dashboard(spark: SparkSession, d: str) -> DataFrame:
    return service.dashboard(table(spark, d, "entity_list").where("side = 'source'"), table(spark, d, "sim_edges"), 0.2)


@query("""WITH x AS (SELECT to_idx, unnest(sim) AS x FROM sim_edges WHERE from_idx = 3), b AS (SELECT to_idx, x.d AS d, x.m AS m FROM x WHERE x.d IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY to_idx ORDER BY d, m) AS k FROM b)
    SELECT to_idx, d, m, CASE WHEN d = 0 THEN 'exact' ELSE 'approximate' END AS kind FROM r WHERE k = 1 AND d <= 0.2""")
def ranked_matches(spark: SparkSession, d: str) -> DataFrame:
    return service.matches(table(spark, d, "sim_edges"), 3, 0.2)


# ---- files and streams


@query("""SELECT DISTINCT s, p, o, CASE WHEN o_kind = 'uri' THEN 'uri' ELSE 'literal' END AS o_kind, CASE WHEN o_kind = 'literal' AND regexp_matches(lang, '^[A-Za-z]+$') THEN lang END AS lang
    FROM triples WHERE o IS NOT NULL AND trim(o) <> ''""")
def ntriples_round_trip(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "triples").where("o is not null and trim(o) <> ''").select(
        "s", "p", "o", F.when(F.col("o_kind") == "uri", "uri").otherwise("literal").alias("o_kind"),
        F.when((F.col("o_kind") == "literal") & F.col("lang").rlike("^[A-Za-z]+$"), F.col("lang")).alias("lang"), F.lit(None).cast("string").alias("dtype"),
    ).distinct()
    path = Workspace(spark, "nt").root + "/triples.nt"
    tables.ntriples_lines(t).write.text(path)
    return rdf.read_ntriples(spark, path).select("s", "p", "o", "o_kind", "lang").distinct()


@query(f"WITH {VECTORS} SELECT from_idx AS i, to_idx AS j, min(d0) AS d FROM v WHERE d0 < 0.3 GROUP BY 1, 2")
def sparse_round_trip(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).select(F.col("e1").alias("i"), F.col("e2").alias("j"), F.col("dist")[0].alias("d"))
    path = Workspace(spark, "sparse").root + "/lev.sparse"
    tables.sparse_lines(v, 0.3).write.text(path)
    return tables.read_sparse(spark, path)


@query("""SELECT time_bucket(INTERVAL 1 hour, ts) AS "start", event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    ws = Workspace(spark, "stream")
    rows = incremental.windowed_counts(spark.readStream.schema(schema).parquet(f"{d}/events.parquet*"), "ts", "event_type")
    def keep(batch: DataFrame, k: int) -> None:
        batch.select("start", "event_type", "n", F.lit(k).alias("k")).write.mode("overwrite").parquet(f"{ws.root}/out/batch={k}")

    rows.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", ws.root + "/state").trigger(availableNow=True).start().awaitTermination()
    # the last state of each window
    out = spark.read.schema("start timestamp, event_type string, n bigint, k bigint").parquet(ws.root + "/out")
    return out.groupBy("start", "event_type").agg(F.max_by("n", "k").alias("n"))


@query(QGRAM_SQL + "SELECT e1, e2, round(p, 6) AS p FROM best")
def stream_matches(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "cul_foods").schema
    ws = Workspace(spark, "stream")
    cul = spark.readStream.schema(schema).parquet(f"{d}/cul_foods.parquet*").select("uri", F.lower("food_name").alias("label"))
    incremental.match_stream(cul, food_labels(spark, d)[1], 0.3, ws.root + "/out", ws.root + "/state")
    return spark.read.parquet(ws.root + "/out").groupBy("e1", "e2").agg(F.round(F.min("p"), 6).alias("p"))


def _written(spark: SparkSession, lines: DataFrame, name: str) -> str:
    path = f"{Workspace(spark, 'lines').root}/{name}"
    lines.write.text(path)
    return path


@query(f"WITH {MATCH} SELECT DISTINCT e1, e2, p FROM m")
def lst_round_trip(spark: SparkSession, d: str) -> DataFrame:
    m = matchings(spark, d).select("e1", "e2", "p").distinct()
    return tables.read_lst(spark, _written(spark, tables.lst_lines(m), "a.lst"))


@query(f"WITH {MATCH} SELECT DISTINCT e1, e2, 1.0::DOUBLE AS p FROM m")
def md_round_trip(spark: SparkSession, d: str) -> DataFrame:
    m = matchings(spark, d).select("e1", "e2").distinct()
    return tables.read_md(spark, _written(spark, m.select(F.concat("e1", F.lit(" - "), "e2").alias("value")), "a.md"))


@query(f"WITH {VECTORS} SELECT from_idx::VARCHAR AS e1, to_idx::VARCHAR AS e2, d0, d1, d2 FROM v")
def distances_round_trip(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).select(F.col("e1").cast("string").alias("e1"), F.col("e2").cast("string").alias("e2"), F.lit(None).cast("string").alias("lcs"), "dist")
    path = Workspace(spark, "csv").root + "/d.csv"
    tables.write_distances(v, path)
    return tables.read_distances(spark, path, 3, True).select("e1", "e2", *[F.col("dist")[k].alias(f"d{k}") for k in range(3)])


@query(f"WITH {STAR} SELECT src, dst FROM star")
def dot_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return tables.read_dot(spark, _written(spark, tables.dot_lines(star(spark, d)), "g.dot"))


@query("SELECT DISTINCT i, uri FROM entity_list")
def entity_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return tables.read_entities(spark, _written(spark, tables.entity_lines(table(spark, d, "entity_list").select("i", "uri").distinct()), "e.lst"))


@query(f"WITH {VECTORS} SELECT from_idx::BIGINT AS \"row\", to_idx::BIGINT AS col, d0 AS val FROM v WHERE d0 IS NOT NULL")
def matrix_round_trip(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).select(F.col("e1").alias("row"), F.col("e2").alias("col"), F.col("dist")[0].alias("val")).where("val is not null")
    return tables.read_matrix_market(spark, _written(spark, tables.matrix_market_lines(v), "m.mm"))


@query(f"""WITH {VECTORS}, x AS (SELECT from_idx, to_idx, 0 AS m, d0 AS d FROM v WHERE d0 IS NOT NULL UNION ALL SELECT from_idx, to_idx, 1, d2 FROM v WHERE d2 IS NOT NULL)
    SELECT from_idx AS "from", to_idx AS "to", count(*)::INT AS n, min(m) AS first_m, arg_min(d, m) AS first_d FROM x GROUP BY 1, 2""")
def merged_tables(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    one = lambda k: v.select(F.col("e1").alias("i"), F.col("e2").alias("j"), F.col("dist")[k].alias("d")).where("d is not null")
    out = tables.merge_sparse([one(0), one(2)])
    return out.select("from", "to", F.size("sim").alias("n"), F.col("sim")[0]["m"].alias("first_m"), F.col("sim")[0]["d"].alias("first_d"))


@query(f"""WITH {STAR} SELECT src, dst, CASE WHEN src[1:1] = 'n' THEN 0 ELSE 1 END::BIGINT AS w FROM star""")
def joined_graphs(spark: SparkSession, d: str) -> DataFrame:
    g = star(spark, d)
    return G.join_graphs(g, g.where("src like 'n%'").withColumn("w", F.lit(0).cast("bigint")))


@query("""SELECT * FROM (""" + f"""WITH {MATCH}, k AS (SELECT least(e1, e2) AS a, greatest(e1, e2) AS b, p, found_by FROM m),
    g AS (SELECT a, b, min(p) AS p FROM k GROUP BY a, b), r AS (SELECT DISTINCT a, b FROM k WHERE found_by = 'manual'),
    j AS (SELECT g.*, r.a IS NOT NULL AS hit FROM g LEFT JOIN r ON g.a = r.a AND g.b = r.b), ts AS (SELECT round(i * 0.01::DOUBLE, 6) AS t FROM range(0, 101) x(i)),
    c AS (SELECT t, count(*) FILTER (p <= t AND hit) AS tp, count(*) FILTER (p <= t AND NOT hit) AS fp,
                 (SELECT count(*) FROM r) - count(*) FILTER (p <= t AND hit) AS fn FROM ts, j GROUP BY t),""" + STATS.format(keys="t,") + """)
    QUALIFY recall > coalesce(max(recall) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)""")
def progressive_recall(spark: SparkSession, d: str) -> DataFrame:
    m = matchings(spark, d)
    return rounded(alignment.progressive(m, m.where("found_by = 'manual'"), 0.01))


@query(SETS + " SELECT y.e1, y.e2, (SELECT count(*) FROM x WHERE least(x.e1, x.e2) = least(y.e1, y.e2) AND greatest(x.e1, x.e2) = greatest(y.e1, y.e2)) > 0 AS covered FROM (SELECT DISTINCT e1, e2 FROM y) y")
def covered_pairs(spark: SparkSession, d: str) -> DataFrame:
    x, y = _two(spark, d)
    return alignment.covers(x, y.select("e1", "e2").distinct()).select("e1", "e2", "covered")


@query(f"WITH {SHORT} SELECT DISTINCT s AS b, o AS label FROM t WHERE p = 'rdfs:label' AND o IS NOT NULL AND s IS NOT NULL ORDER BY b, label LIMIT 50 OFFSET 100")
def page_of_labels(spark: SparkSession, d: str) -> DataFrame:
    t = short_triples(spark, d).where("o is not null and s is not null")
    return patterns.select(patterns.match(t, ("?b", "rdfs:label", "?label")), distinct=True, order=("?b", "?label"), limit=50, offset=100)


@query(f"WITH {SHORT} SELECT DISTINCT s, p, o FROM t WHERE o = 'agr:Foodstuff' ORDER BY s, p, o LIMIT 5")
def reverse_usage(spark: SparkSession, d: str) -> DataFrame:
    return patterns.usage(short_triples(spark, d), "agr:Foodstuff", 5, True)


@query(f"""WITH {SHORT}, k AS (SELECT DISTINCT s FROM t WHERE p = 'rdf:type' AND o = 'agr:Foodstuff')
    SELECT k.s AS uri, count(DISTINCT o)::INT AS n_labels FROM k LEFT JOIN t ON k.s = t.s AND p = 'rdfs:label' AND o IS NOT NULL GROUP BY 1""")
def entities_by_type(spark: SparkSession, d: str) -> DataFrame:
    found = rules.entities(short_triples(spark, d), ["rdfs:label"], ("rdf:type", "agr:Foodstuff"))
    return found.select("uri", F.size("rdfs:label").alias("n_labels"))


@query(f"""WITH {SHORT}, n AS (SELECT s AS k, min(o) AS n FROM t WHERE p = 'rdfs:label' GROUP BY s),
    e AS (SELECT DISTINCT s, o FROM t WHERE p = 'rdfs:subClassOf' AND s IS NOT NULL AND trim(o) <> '')
    SELECT DISTINCT coalesce(a.n, s) AS src, coalesce(b.n, o) AS dst, 1::BIGINT AS w FROM e LEFT JOIN n a ON s = a.k LEFT JOIN n b ON o = b.k""")
def taxonomy_by_label(spark: SparkSession, d: str) -> DataFrame:
    return G.by_label(short_triples(spark, d))[0]
