"""Graph patterns over triples as joins: basic patterns, OPTIONAL, UNION,
property paths, filters, DISTINCT, LIMIT / OFFSET and CONSTRUCT."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import taxonomy

Pattern = tuple[str, str, str]


def _is_var(x: str) -> bool:
    return x.startswith("?")


def match(triples: DataFrame, pattern: Pattern) -> DataFrame:
    """Bindings of one pattern: a column for each variable.  ``p*`` and ``p+``
    as predicate are reflexive or plain transitive closures; a bound object
    starts the search there, so only its subtree is walked."""
    s, p, o = pattern
    if not _is_var(p) and p[-1] in "*+":
        edges = taxonomy.from_triples(triples, [p[:-1]])
        back = not _is_var(o)
        one = lambda x: triples.sparkSession.createDataFrame([(x,)], "id string")
        start = one(o) if back else one(s) if not _is_var(s) else taxonomy.nodes(edges)
        found = taxonomy.reachable(taxonomy.reverse(edges) if back else edges, start)
        if p[-1] == "+":
            # a cycle leads back to its nodes
            found = found.where("depth > 0")
        rows = found.select(*((F.col("node").alias("s"), F.col("s").alias("o")) if back else (F.col("s").alias("s"), F.col("node").alias("o"))))
    else:
        rows = triples.select("s", "p", "o")
    cond = F.lit(True)
    cols: dict[str, Column] = {}
    for name, x in zip("spo", pattern):
        if name not in rows.columns:
            continue
        if not _is_var(x):
            if not (name == "p" and x[-1] in "*+"):
                cond = cond & (F.col(name) == x)
        elif x[1:] in cols:
            cond = cond & (F.col(name) == cols[x[1:]])
        else:
            cols[x[1:]] = F.col(name)
    rows = rows.where(cond)
    return rows.select(*[c.alias(k) for k, c in cols.items()]) if cols else rows.select(F.lit(True).alias("_hit")).distinct()


def join(a: DataFrame, b: DataFrame, optional: bool = False) -> DataFrame:
    """Natural join on the shared variables; ``optional`` keeps rows of ``a``."""
    on = [c for c in a.columns if c in b.columns]
    if not on:
        raise ValueError("patterns without a shared variable")
    return a.join(b, on, "left" if optional else "inner")


def bgp(triples: DataFrame, patterns: Sequence[Pattern]) -> DataFrame:
    """Bindings of all patterns, joined in an order that always shares one."""
    todo = list(patterns)
    out = match(triples, todo.pop(0))
    while todo:
        k = next((i for i, p in enumerate(todo) if any(_is_var(x) and x[1:] in out.columns for x in p)), 0)
        out = join(out, match(triples, todo.pop(k)))
    return out


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def select(rows: DataFrame, variables: Sequence[str] | None = None, distinct: bool = False, order: Sequence[str] = (), limit: int | None = None, offset: int = 0) -> DataFrame:
    """Solution modifiers; pages need an ``order`` to be the same each time."""
    out = rows.select(*[v.lstrip("?") for v in variables]) if variables else rows
    out = out.distinct() if distinct else out
    out = out.orderBy(*[v.lstrip("?") for v in order]) if order else out
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit is not None else out


def construct(rows: DataFrame, template: Sequence[Pattern]) -> DataFrame:
    """Distinct statements ``s, p, o`` of a template; rows with an unbound part
    give none."""
    value = lambda x: F.col(x[1:]) if _is_var(x) else F.lit(x)
    stmts = F.array(*[F.struct(value(s).alias("s"), value(p).alias("p"), value(o).alias("o")) for s, p, o in template])
    return rows.select(F.inline(stmts)).dropna().distinct()


def labels_below(triples: DataFrame, roots: Sequence[str], member: str = "dcterms:subject", broader: str = "skos:broader", labels: Sequence[str] = tuple(taxonomy.LABEL)) -> DataFrame:
    """CONSTRUCT of ``?b rdfs:label ?label`` for members of the categories at or
    below the roots, whatever the label predicate."""
    cats = union(*[match(triples, ("?x", broader + "*", r)) for r in roots]).distinct()
    named = union(*[match(triples, ("?b", p, "?label")) for p in labels])
    return construct(join(join(match(triples, ("?b", member, "?x")), cats), named), [("?b", "rdfs:label", "?label")])


def usage(triples: DataFrame, entity: str, n: int = 5, incoming: bool = False) -> DataFrame:
    """At most ``n`` statements from (or to) an entity, in a fixed order."""
    return triples.where(F.col("o" if incoming else "s") == entity).select("s", "p", "o").distinct().orderBy("s", "p", "o").limit(n)
