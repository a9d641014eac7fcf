"""Visually identical text: one consistent form for labels that look the same.

``visible_form`` maps blanks, widths, encodings and look-alike letters to one
sign each and drops what prints nothing; the forms are keys only: they are grouped
under the accent- and case-sensitive Unicode collation, and a class's canonical text
is its most frequent original text, so no text is made that nobody wrote.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.runtime import Workspace

COLLATION = "UNICODE"

# Letters of other scripts in the shape of Latin letters.
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Һ": "h", "Ӏ": "I", "Ԁ": "d", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "һ": "h", "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w",
}
GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
}
HYPHENS = {"‐": "-", "‑": "-"}
#: Letters, marks and fillers without a glyph that are not format characters.
BLANK_LETTERS = "͏ᅟᅠ឴឵ㅤﾠ"


def _single(c: str) -> str | None:
    """What one code point becomes, or None if it stays."""
    o, cat = ord(c), unicodedata.category(c)
    if c in "\t\n\v\f\r\x85" or cat[0] == "Z":
        return " "
    if c in BLANK_LETTERS or cat in ("Cf", "Cc") or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or 0x180B <= o <= 0x180F:
        return ""
    kind = unicodedata.decomposition(c).partition(">")[0][1:] if unicodedata.decomposition(c).startswith("<") else ""
    if kind in ("wide", "narrow") or kind == "compat" and cat[0] in "LN":
        # the width, ligature or numeral is an encoding; raised or circled signs are not
        out = unicodedata.normalize("NFKD", c)
        return "".join(x if (y := _single(x)) is None else y for x in out)
    return CYRILLIC.get(c) or GREEK.get(c) or HYPHENS.get(c)


class _Table(dict):
    """Code point -> replacement by the rule above, filled as signs are met."""

    def __missing__(self, o: int):
        out = _single(chr(o))
        self[o] = o if out is None else out
        return self[o]


_TABLE = _Table()


def visible(text: str) -> str:
    """The consistent form of one text: canonical decomposition, the table of
    signs, and canonical order of what came out."""
    if text.isascii() and text.isprintable():
        return text
    out = unicodedata.normalize("NFD", text).translate(_TABLE)
    return unicodedata.normalize("NFC", out)


def _visible_batch(texts: pd.Series) -> pd.Series:
    return texts.map(visible, na_action="ignore")


def visible_form(text: Column | str) -> Column:
    """``visible`` of each text, in Arrow batches; null stays null."""
    return F.pandas_udf(_visible_batch, T.StringType())(text)


def classes(texts: DataFrame) -> DataFrame:
    """``raw, n`` (distinct texts and their counts) -> ``raw, canonical, n``: texts
    that look the same have one canonical text, the most frequent of them (ties by
    code point); what prints nothing has the empty text."""
    words = texts.withColumn("form", visible_form("raw")).withColumn("key", F.expr(f"form collate {COLLATION}"))
    best = words.groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("raw"))).alias("best"))
    named = words.join(best, "key")
    return named.select("raw", F.when(F.col("form") == "", "").otherwise(F.col("best.raw")).alias("canonical"), words["n"])


def canonical(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``canonical``: equal for texts that look the same, different
    for others, and always a text of the table that looks like the row's.

    Null stays null; an empty text and one that prints nothing become the empty
    text.  Columns of ``df`` keep their names; one called ``canonical`` is
    replaced.  Repeated rows stay repeated.
    """
    words = df.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("raw")).agg(F.count("*").alias("n"))
    named = classes(words).select(F.col("raw").alias("_raw"), F.col("canonical").alias("_canonical"))
    df = df.drop("canonical")
    return df.join(named, df[text] == named["_raw"], "left").drop("_raw").withColumnRenamed("_canonical", "canonical")


def look_alikes(df: DataFrame, text: str, key: str) -> DataFrame:
    """``<key>_a, <key>_b`` (a < b): pairs of rows whose texts look the same but
    differ in code points.  Null, empty and invisible texts make no pair.

    Classes are made and paired by their distinct texts; only texts that look like
    another one are joined to rows, so the joins yield just what is reported.
    """
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null and t is not null and t <> ''").distinct()
    ws = Workspace(df.sparkSession, "lookalike")
    rows = ws.cut(rows, "rows")
    texts = classes(rows.groupBy(F.col("t").alias("raw")).agg(F.count("*").alias("n"))).where("canonical <> ''")
    texts = ws.cut(texts.select("canonical", "raw"), "texts")
    mixed = texts.groupBy("canonical").count().where("count > 1").select("canonical")
    texts = texts.join(mixed, "canonical", "left_semi")
    a, b = (texts.select("canonical", F.col("raw").alias(f"t_{s}")) for s in "ab")
    pairs = a.join(b, "canonical").where("t_a <> t_b").select("t_a", "t_b")
    ra, rb = (rows.select(F.col("t").alias(f"t_{s}"), F.col("k").alias(f"{key}_{s}")) for s in "ab")
    return pairs.join(ra, "t_a").join(rb, "t_b").where(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b").distinct()
