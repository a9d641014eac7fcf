"""Queries pN_... of the training-data operators and the SQL to check them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.curie import prefix_list, shorten
from tessera.llm import bpe, entities, groups, lookalike, packing, spans, topn
from tessera.plans.runtime import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    names = prefix_list(table(spark, d, "prefixes"))
    pairs = table(spark, d, "matchings").select(shorten(F.col("e1"), names).alias("e1"), shorten(F.col("e2"), names).alias("e2"))
    return groups.groups(pairs)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_alikes(table(spark, d, "entity_labels"), "label", "label_id")


def p3_canonical(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "entity_labels").select("label_id", "label")
    return lookalike.canonical(labels, "label").select("label_id", "canonical")


def p4_matches(spark: SparkSession, d: str) -> DataFrame:
    a, b = entities.foods(table(spark, d, "cul_foods"), table(spark, d, "wik_foods"), table(spark, d, "places"))
    return entities.match(a, b)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_matches(spark, d).where("p >= 0.7").select("e1", "e2")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    scores = topn.pair_scores(table(spark, d, "sim_edges"))
    return topn.top_n(scores, "from_idx", "score", "to_idx", 5).select("from_idx", "to_idx")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_column(table(spark, d, "documents"), "doc_id", "text")


CAPACITY = 4096


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = bpe.count_column(table(spark, d, "documents"), "doc_id", "text")
    return packing.containers(sizes, "doc_id", "n_tokens", CAPACITY)


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(p7_containers(spark, d), CAPACITY)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_chars(table(spark, d, "documents"), "doc_id", "text")


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return spans.spans(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_canonical": p3_canonical,
    "p4_found": p4_found,
    "p4_matches": p4_matches,
    "p5_found": p5_found,
    "p6_ids": p6_ids,
    "p7_containers": p7_containers,
    "p7_report": p7_report,
    "p8_found": p8_found,
    "p8_spans": p8_spans,
}

#: Windows of 200 signs that two documents hold, by their places; texts are cut
#: into pieces first, as a substring is counted from the beginning.
WINDOWS = """
    WITH c AS (SELECT doc_id, k, substr(text, k * 1000 + 1, 1199) AS c FROM documents, unnest(range(0, (length(text) + 999) // 1000)) u(k)),
    w AS (SELECT doc_id, k * 1000 + i - 1 AS p, substr(c, i, 200) AS x FROM c, unnest(range(1, least(1000, length(c) - 199) + 1)) r(i)),
    h AS (SELECT doc_id, p, md5_number(x) AS h FROM w), s AS (SELECT h FROM h GROUP BY h HAVING min(doc_id) < max(doc_id)),
    m AS (SELECT DISTINCT doc_id, p FROM h SEMI JOIN s USING (h))"""



def _forms_sql() -> str:
    """The table of signs as SQL, by the rule of ``lookalike.visible``, for the
    scripts of the tables; combining marks are put together at the end."""
    spans = [(1, 0x600), (0x1E00, 0x2200), (0x3000, 0x3100), (0xFB00, 0xFB07), (0xFE00, 0xFE10), (0xFEFF, 0xFFF0)]
    quote = lambda x: x.replace("'", "''")
    made = {chr(o): lookalike.visible(chr(o)) for a, b in spans for o in range(a, b)}
    made = {c: v for c, v in made.items() if c != v}
    one = {c: v for c, v in made.items() if len(v) == 1}
    gone = "".join(c for c, v in made.items() if not v)
    out = f"translate(x, '{quote(''.join(one))}{quote(gone)}', '{quote(''.join(one.values()))}')"
    for c, v in made.items():
        if len(v) > 1:
            out = f"replace({out}, '{quote(c)}', '{quote(v)}')"
    return f"nfc_normalize({out})"


FORMS = f"WITH t AS (SELECT x, {_forms_sql()} AS form, count(*) AS n FROM (SELECT label AS x FROM entity_labels WHERE label IS NOT NULL) GROUP BY x)"

ORACLE = {
    "p3_found": FORMS + """
        SELECT DISTINCT a.label_id AS label_id_a, b.label_id AS label_id_b FROM entity_labels a JOIN t ta ON a.label = ta.x
        JOIN t tb ON ta.form = tb.form AND ta.x <> tb.x JOIN entity_labels b ON b.label = tb.x
        WHERE a.label_id < b.label_id AND ta.form <> '' AND a.label <> '' AND b.label <> ''""",
    "p3_canonical": FORMS + """,
        c AS (SELECT x, form, row_number() OVER (PARTITION BY form ORDER BY n DESC, x) AS k FROM t)
        SELECT label_id, CASE WHEN t.form = '' THEN '' ELSE c.x END AS canonical FROM entity_labels
        LEFT JOIN t ON label = t.x LEFT JOIN c ON t.form = c.form AND k = 1""",
    "p8_found": WINDOWS + """,
        g AS (SELECT doc_id, least(200, coalesce(lead(p) OVER (PARTITION BY doc_id ORDER BY p) - p, 200)) AS n FROM m)
        SELECT doc_id, sum(n)::BIGINT AS shared_chars FROM g GROUP BY doc_id""",
    "p8_spans": WINDOWS + """,
        f AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 1 ELSE 0 END AS new FROM m),
        g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM f)
        SELECT doc_id, min(p)::INT AS start, (max(p) + 200)::INT AS "end" FROM g GROUP BY doc_id, g""",
    "p2_found": """
        WITH RECURSIVE i AS (SELECT DISTINCT x FROM (SELECT e1 AS x FROM matchings UNION ALL SELECT e2 FROM matchings) WHERE x IS NOT NULL),
        n AS (SELECT x, coalesce(arg_max(prefix || ':' || substr(x, length(uri) + 1), length(uri)), x) AS y
              FROM i LEFT JOIN prefixes ON starts_with(x, uri) GROUP BY x),
        m AS (SELECT DISTINCT a.y AS a, b.y AS b FROM matchings JOIN n a ON e1 = a.x JOIN n b ON e2 = b.x),
        e AS (SELECT a, b FROM m UNION SELECT b, a FROM m),
        r AS (SELECT y AS a, y AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT a AS record, min(b) AS group_id FROM r GROUP BY a""",
    "p5_found": """
        WITH d AS (SELECT from_idx, to_idx, unnest(sim).d AS d FROM sim_edges),
        s AS (SELECT from_idx, to_idx, min(d) AS score FROM d
              WHERE d IS NOT NULL AND d <> 1.7976931348623157e308 AND from_idx IS NOT NULL AND to_idx IS NOT NULL
              GROUP BY from_idx, to_idx),
        r AS (SELECT *, row_number() OVER (PARTITION BY from_idx ORDER BY score, to_idx) AS k FROM s)
        SELECT from_idx, to_idx FROM r WHERE k <= 5""",
}
