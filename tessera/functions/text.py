"""Value transforms, tokenizer and phonetic codes as columns.

Everything but NYSIIS and Metaphone stays in JVM expressions; those two are
Arrow UDFs.  Null in, null out unless a function says otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Stop words of country names, long and short list.
STOP_WORDS_1 = ["republic", "of", "bailiwick", "the", "kingdom", "grand duchy", "territory", "and", "principality"]
STOP_WORDS_2 = ["republic", "of", "bailiwick"]


def lower_case(c: Column) -> Column:
    return F.lower(c)


def normalize_name(c: Column) -> Column:
    """Lower case without brackets, quotes, dots, blanks, ``_ - ?``; empty -> null."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(c), r"['()?.\s_\-]", "")), F.lit(""))


def isub_normalize(c: Column) -> Column:
    """Lower case without dots, underscores and blanks."""
    return F.translate(F.lower(c), "._ ", "")


def tokens(c: Column) -> Column:
    """Tokens of a label: split at white space and ``, . ( ) ' /``, lower case,
    at least two signs, not only digits, not only ``- – . ,``.  Null -> null;
    nothing left -> empty array.  No stemming."""
    parts = F.split(c, r"[\s,.()'/]+")
    return F.filter(
        F.transform(parts, lambda t: F.lower(t)),
        lambda t: (F.length(t) >= 2) & t.rlike(r"\P{Nd}") & ~t.rlike(r"^[–\-.,]+$"),
    )


def tokens_or_null(c: Column) -> Column:
    t = tokens(c)
    return F.when(F.size(t) > 0, t)


def is_punctuation(c: Column) -> Column:
    """Whether one sign is neither white space, letter nor digit."""
    return c.rlike(r"^[^\s\p{L}\p{Nd}]$")


def without_stop_words(words: Iterable[str] = STOP_WORDS_1) -> Callable[[Column], Column]:
    """Transform that drops stop words (split at blanks, compared in lower case).
    A phrase of several words is dropped where it stands as a whole."""
    single = sorted({w.lower() for w in words if " " not in w})
    phrases = sorted({w.lower() for w in words if " " in w}, key=lambda p: (-len(p), p))

    def run(c: Column) -> Column:
        for p in phrases:
            c = F.trim(F.regexp_replace(c, "(?i)(?<!\\S)" + re.escape(p) + "(?!\\S)", ""))
        bad = F.array(*[F.lit(w) for w in single]) if single else F.array().cast("array<string>")
        return F.array_join(F.filter(F.split(c, " "), lambda w: ~F.array_contains(bad, F.lower(w))), " ")

    return run


def shortest(values: Column) -> Column:
    """Set transform: the shortest value of an array alone (ties: the smallest);
    null or empty -> empty array."""
    best = F.array_min(F.transform(F.filter(values, lambda v: v.isNotNull()), lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))))
    return F.when(best.isNotNull(), F.array(best["v"])).otherwise(F.array().cast("array<string>"))


def each(fn: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Value transform -> set transform."""
    return lambda values: F.transform(values, fn)


def chain(*fns: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Transforms one after the other, the first one first."""

    def run(c: Column) -> Column:
        for f in fns:
            c = f(c)
        return c

    return run


def soundex(c: Column) -> Column:
    return F.soundex(c)


def nysiis_code(word: str) -> str:
    """New York State Identification and Intelligence System code, untruncated."""
    w = "".join(ch for ch in word.upper() if "A" <= ch <= "Z")
    if not w:
        return ""
    for a, b in (("MAC", "MCC"), ("KN", "NN"), ("K", "C"), ("PH", "FF"), ("PF", "FF"), ("SCH", "SSS")):
        if w.startswith(a):
            w = b + w[len(a):]
            break
    w = re.sub("(EE|IE)$", "Y", w)
    w = re.sub("(DT|RT|RD|NT|ND)$", "D", w)
    out, i = w[0], 1
    while i < len(w):
        two, three, c = w[i : i + 2], w[i : i + 3], w[i]
        if two == "EV":
            new, step = "AF", 2
        elif c in "AEIOU":
            new, step = "A", 1
        elif c == "Q":
            new, step = "G", 1
        elif c == "Z":
            new, step = "S", 1
        elif c == "M":
            new, step = "N", 1
        elif two == "KN":
            new, step = "NN", 2
        elif c == "K":
            new, step = "C", 1
        elif three == "SCH":
            new, step = "SSS", 3
        elif two == "PH":
            new, step = "FF", 2
        elif c == "H" and (w[i - 1] not in "AEIOU" or i + 1 >= len(w) or w[i + 1] not in "AEIOU"):
            new, step = ("A" if w[i - 1] in "AEIOU" else w[i - 1]), 1
        elif c == "W" and w[i - 1] in "AEIOU":
            new, step = "A", 1
        else:
            new, step = c, 1
        for ch in new:
            if ch != out[-1]:
                out += ch
        i += step
    if len(out) > 1 and out[-1] == "S":
        out = out[:-1]
    if out.endswith("AY"):
        out = out[:-2] + "Y"
    if len(out) > 1 and out[-1] == "A":
        out = out[:-1]
    return out


def metaphone_code(word: str) -> str:
    """Metaphone (the original rules), untruncated."""
    w = "".join(ch for ch in word.upper() if "A" <= ch <= "Z")
    if not w:
        return ""
    if w[:2] in ("AE", "GN", "KN", "PN", "WR"):
        w = w[1:]
    elif w[0] == "X":
        w = "S" + w[1:]
    elif w[:2] == "WH":
        w = "W" + w[2:]
    at = lambda i: w[i] if 0 <= i < len(w) else ""
    out = []
    for i, c in enumerate(w):
        if c == at(i - 1) and c != "C":
            continue
        n, soft = at(i + 1), at(i + 1) in tuple("EIY")
        if c in "AEIOU":
            if i == 0:
                out.append(c)
        elif c == "B":
            if not (at(i - 1) == "M" and i == len(w) - 1):
                out.append("B")
        elif c == "C":
            if at(i - 1) == "S" and soft:
                continue
            if n == "I" and at(i + 2) == "A":
                out.append("X")
            elif soft:
                out.append("S")
            elif n == "H":
                out.append("K" if at(i - 1) == "S" or i == 0 and at(2) not in tuple("AEIOU") else "X")
            else:
                out.append("K")
        elif c == "D":
            out.append("J" if n == "G" and at(i + 2) in tuple("EIY") else "T")
        elif c == "G":
            if n == "H" and not (i + 2 >= len(w) or at(i + 2) in tuple("AEIOU")):
                continue
            if n == "N" and (i + 2 == len(w) or w[i:] == "GNED"):
                continue
            if at(i - 1) == "D" and soft:
                continue
            out.append("J" if soft and at(i - 1) != "G" else "K")
        elif c == "H":
            if n in tuple("AEIOU") and at(i - 1) not in tuple("CSPTG"):
                out.append("H")
        elif c in "FJLMNR":
            out.append(c)
        elif c == "K":
            if at(i - 1) != "C":
                out.append("K")
        elif c == "P":
            out.append("F" if n == "H" else "P")
        elif c == "Q":
            out.append("K")
        elif c == "S":
            out.append("X" if n == "H" or n == "I" and at(i + 2) in ("O", "A") else "S")
        elif c == "T":
            if n == "I" and at(i + 2) in ("O", "A"):
                out.append("X")
            elif n == "H":
                out.append("0")
            elif not (n == "C" and at(i + 2) == "H"):
                out.append("T")
        elif c == "V":
            out.append("F")
        elif c in "WY":
            if n in tuple("AEIOU"):
                out.append(c)
        elif c == "X":
            out.append("KS")
        elif c == "Z":
            out.append("S")
    return "".join(out)


def _phonetic(code: Callable[[str], str], c: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        known = {v: code(v) for v in s.dropna().unique()}
        return pd.Series([known.get(v) if isinstance(v, str) else None for v in s], dtype=object)

    return F.pandas_udf(run, T.StringType())(c)


def nysiis(c: Column) -> Column:
    return _phonetic(nysiis_code, c)


def metaphone(c: Column) -> Column:
    return _phonetic(metaphone_code, c)


#: Set transforms by name, as link rules use them.
TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "": lambda v: v,
    "lc": each(lower_case),
    "lc-sw1": chain(each(lower_case), each(without_stop_words(STOP_WORDS_1))),
    "lc-sw2": chain(each(lower_case), each(without_stop_words(STOP_WORDS_2))),
    "lc-soundex": chain(each(lower_case), each(soundex)),
    "lc-ml": chain(each(lower_case), shortest),
    "lc-ml-sw1": chain(each(lower_case), each(without_stop_words(STOP_WORDS_1)), shortest),
    "lc-ml-sw2": chain(each(lower_case), each(without_stop_words(STOP_WORDS_2)), shortest),
}
#: Transforms of single values that run as Arrow UDFs, so not inside arrays.
VALUE_TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "lc-nysiis": chain(lower_case, nysiis),
    "lc-metaphone": chain(lower_case, metaphone),
}
