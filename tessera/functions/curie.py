"""Identifiers as CURIEs: URI <-> prefix:name, longest prefix first."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most prefix declarations that become one expression; they are configuration.
MOST_PREFIXES = 1000

#: CURIE prefixes of the food harvests.
DBPEDIA_PREFIXES = [
    ("category", "http://dbpedia.org/resource/Category:"),
    ("dbpedia", "http://dbpedia.org/resource/"),
    ("skos", "http://www.w3.org/2004/02/skos/core#"),
    ("dcterms", "http://purl.org/dc/terms/"),
]


def prefix_list(prefixes: DataFrame) -> list[tuple[str, str]]:
    """Rows of a ``prefix, uri`` table; more than MOST_PREFIXES is an error."""
    rows = prefixes.select("prefix", "uri").dropna().limit(MOST_PREFIXES + 1).collect()
    if len(rows) > MOST_PREFIXES:
        raise ValueError(f"more than {MOST_PREFIXES} prefixes")
    return [(r[0], r[1]) for r in rows]


def _longest_first(prefixes: Iterable[tuple[str, str]], by: int) -> list[tuple[str, str]]:
    return sorted({(p, u) for p, u in prefixes if u}, key=lambda x: (-len(x[by]), x))


def shorten(col: Column, prefixes: Iterable[tuple[str, str]]) -> Column:
    """CURIE of a full URI; null stays null, anything else stays as it is."""
    out = col
    for name, uri in reversed(_longest_first(prefixes, 1)):
        out = F.when(
            F.startswith(col, F.lit(uri)),
            F.concat(F.lit(f"{name}:"), F.substring(col, len(uri) + 1, 1 << 30)),
        ).otherwise(out)
    return out


def expand(col: Column, prefixes: Iterable[tuple[str, str]]) -> Column:
    """Full URI of a CURIE whose prefix is declared; else the value itself."""
    out = col
    for name, uri in reversed(_longest_first(prefixes, 0)):
        out = F.when(
            F.startswith(col, F.lit(f"{name}:")),
            F.concat(F.lit(uri), F.substring(col, len(name) + 2, 1 << 30)),
        ).otherwise(out)
    return out
