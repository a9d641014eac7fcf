"""Distances and scores of two strings, as columns.

Distances: 0 = equal.  Equality, relaxed equality, Levenshtein and q-grams are
JVM expressions; the others run over Arrow batches with the batch as the vector
axis (``_batched``), so cost per pair is a few array operations.  Null on either
side gives null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- JVM side


def equality(a: Column, b: Column) -> Column:
    return F.when(a == b, 0.0).when(a != b, 1.0)


def relaxed_equality(a: Column, b: Column) -> Column:
    """0 if the strings agree but for case and accents, else 1."""
    return F.when(F.collate(a, "UNICODE_CI_AI") == F.collate(b, "UNICODE_CI_AI"), 0.0).when(a.isNotNull() & b.isNotNull(), 1.0)


def levenshtein(a: Column, b: Column) -> Column:
    """Edit distance over the longer length; two empty strings: 0."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(F.levenshtein(a, b) / longest)


def levenshtein_score(a: Column, b: Column) -> Column:
    """Negative edit distance (higher is closer)."""
    return -F.levenshtein(a, b).cast("double")


def grams(c: Column, q: int) -> Column:
    """Set of q-grams of the string with ``q - 1`` signs ``#`` on both sides; an
    empty string has those of the padding alone."""
    pad = "#" * (q - 1)
    n = F.length(c) + (q - 1)
    # as an element the padded string is made once, not for each gram
    padded = F.array(F.concat(F.lit(pad), c, F.lit(pad)))
    made = F.transform(padded, lambda s: F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(s, i, F.lit(q))))
    return F.when(n > 0, F.array_distinct(F.get(made, F.lit(0)))).when(c.isNotNull(), F.array().cast("array<string>"))


def gram_set(x: str, q: int) -> set[str]:
    """``grams`` of one string outside of a plan."""
    s = "#" * (q - 1) + x + "#" * (q - 1)
    return {s[i : i + q] for i in range(len(s) - q + 1)}


def jaccard(x: Column, y: Column) -> Column:
    """1 - |x n y| / |x u y| of two sets; two empty ones: 0."""
    both = F.size(F.array_intersect(x, y))
    either = F.size(x) + F.size(y) - both
    return F.when(x.isNull() | y.isNull(), None).when(either == 0, 0.0).otherwise(1 - both / either)


def qgrams(a: Column, b: Column, q: int = 2) -> Column:
    return jaccard(grams(a, q), grams(b, q))


# ---- Arrow side


def _matrix(s: list[str], filler: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(x) for x in s], np.int32)
    out = np.full((len(s), max(1, int(n.max(initial=0)))), filler, np.int64)
    for i, x in enumerate(s):
        if x:
            out[i, : len(x)] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4")
    return out, n


def _batched(fn: Callable[[list[str], list[str]], np.ndarray], a: Column, b: Column) -> Column:
    """Double column of ``fn`` over lists of strings.  Each distinct pair of a
    batch is computed once, in groups of like length."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.full(len(x), np.nan)
        pairs: dict[tuple[str, str], list[int]] = {}
        for i, (p, q) in enumerate(zip(x.tolist(), y.tolist())):
            if isinstance(p, str) and isinstance(q, str):
                pairs.setdefault((p, q), []).append(i)
        keys = sorted(pairs, key=lambda k: (len(k[0]), len(k[1])))
        at = 0
        while at < len(keys):
            width = (len(keys[at][0]) + 8) * 2
            end, cells = at, 0
            while end < len(keys) and (end == at or len(keys[end][0]) <= width and cells < 4_000_000):
                cells += (len(keys[end][0]) + 1) * (len(keys[end][1]) + 1) // 8 + len(keys[end][1])
                end += 1
            part = keys[at:end]
            for k, v in zip(part, fn([p for p, _ in part], [q for _, q in part])):
                out[pairs[k]] = v
            at = end
        return pd.Series(out).where(pd.notna(out), None).astype("float64")

    return F.when(a.isNotNull() & b.isNotNull(), F.pandas_udf(run, T.DoubleType())(a, b))


def _matches(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each sign of ``x`` the first unused equal sign of ``y`` at most ``h``
    places away: which signs of either are matched."""
    used = np.zeros(y.shape, bool)
    got = np.zeros(x.shape, bool)
    j = np.arange(y.shape[1])
    for i in range(x.shape[1]):
        ok = (y == x[:, i : i + 1]) & ~used & (np.abs(j - i) <= h[:, None]) & (i < nx)[:, None]
        ok &= j < ny[:, None]
        first = ok.argmax(1)
        rows = np.flatnonzero(ok.any(1))
        used[rows, first[rows]] = True
        got[rows, i] = True
    return got, used


def _packed(x: np.ndarray, keep: np.ndarray, width: int) -> np.ndarray:
    order = np.argsort(~keep, axis=1, kind="stable")
    out = np.where(np.take_along_axis(keep, order, 1), np.take_along_axis(x, order, 1), -9)[:, :width]
    return np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-9)


def jaro_values(a: list[str], b: list[str], both_ways: bool = True) -> np.ndarray:
    """Jaro distances.  ``both_ways``: window of half the shorter length, rounded
    up, signs matched from either side on their own, and distance 1 if that
    gives different numbers; else the textbook window and one matching."""
    (x, nx), (y, ny) = _matrix(a, -1), _matrix(b, -2)
    if both_ways:
        h = -(-np.minimum(nx, ny) // 2)
        left, _ = _matches(x, y, nx, ny, h)
        right, _ = _matches(y, x, ny, nx, h)
    else:
        left, right = _matches(x, y, nx, ny, np.maximum(np.maximum(nx, ny) // 2 - 1, 0))
    c, d = left.sum(1), right.sum(1)
    width = max(x.shape[1], y.shape[1])
    apart = (_packed(x, left, width) != _packed(y, right, width)).sum(1)
    t = apart // 2
    safe = np.maximum(c, 1)
    sim = (c / np.maximum(nx, 1) + c / np.maximum(ny, 1) + (c - t) / safe) / 3
    out = np.where((c == 0) | (c != d), 1.0, 1 - sim)
    return np.where((nx == 0) & (ny == 0), 0.0, out)


def winkler_values(a: list[str], b: list[str], both_ways: bool = True) -> np.ndarray:
    """Jaro distance, less a tenth for each of up to four equal first signs."""
    prefix = np.zeros(len(a))
    for i, (p, q) in enumerate(zip(a, b)):
        n = 0
        while n < min(4, len(p), len(q)) and p[n] == q[n]:
            n += 1
        prefix[i] = n
    return jaro_values(a, b, both_ways) * (1 - 0.1 * prefix)


def jaro(a: Column, b: Column) -> Column:
    return _batched(jaro_values, a, b)


def jaro_winkler(a: Column, b: Column) -> Column:
    return _batched(winkler_values, a, b)


def jaro_standard(a: Column, b: Column) -> Column:
    return _batched(lambda x, y: jaro_values(x, y, False), a, b)


def jaro_winkler_standard(a: Column, b: Column) -> Column:
    return _batched(lambda x, y: winkler_values(x, y, False), a, b)


def isub_score(a: str, b: str, normalize: bool = True) -> float:
    """Similarity of Stoilos, Stamou and Kollias (ISWC 2005), about -1..1.

    The longest common substring is cut out of both again and again; those
    longer than two signs count as common.  Difference is the Hamacher product
    of what is left over; the start of the strings as given adds to it."""
    if not a and not b:
        return 1.0
    if not a or not b:
        return -1.0
    head = 0
    while head < min(4, len(a), len(b)) and a[head] == b[head]:
        head += 1
    if normalize:
        a, b = (x.lower().translate({46: None, 95: None, 32: None}) for x in (a, b))
        if not a and not b:
            return 1.0
        if not a or not b:
            return -1.0
    la, lb, common = len(a), len(b), 0
    while a and b:
        n, i, j = _common_run(a, b)
        if not n:
            break
        a, b = a[:i] + a[i + n :], b[:j] + b[j + n :]
        if n <= 2:
            break
        common += n
    comm = 2 * common / (la + lb)
    u, v = (la - common) / la, (lb - common) / lb
    rest = u + v - u * v
    diff = u * v / (0.6 + 0.4 * rest) if rest else 0.0
    return comm - diff + head * 0.1 * (1 - comm)


def _common_run(a: str, b: str) -> tuple[int, int, int]:
    """Length and places of the first longest common substring."""
    best, at, row = 0, (0, 0), [0] * (len(b) + 1)
    found: dict[int, tuple[int, int]] = {}
    for i, ch in enumerate(a):
        new = [0] * (len(b) + 1)
        for j, other in enumerate(b):
            if ch == other:
                n = row[j] + 1
                new[j + 1] = n
                if n >= best:
                    start = (i - n + 1, j - n + 1)
                    if n > best or start < found[n]:
                        best, found[n] = n, start
                        at = start
        row = new
    return best, *at


def isub(a: Column, b: Column, normalize: bool = True) -> Column:
    """ISub similarity (higher is closer)."""
    return _batched(lambda x, y: np.array([isub_score(p, q, normalize) for p, q in zip(x, y)]), a, b)


def substring(a: Column, b: Column) -> Column:
    """Distance 1 - ISub of the normalised strings, 0..2."""
    return 1 - isub(a, b, True)


def align_values(a: list[str], b: list[str], same: float, other: float, start: float, extend: float, local: bool, pairs: dict | None = None) -> np.ndarray:
    """Best alignment scores; a gap of n signs costs ``start + (n-1) * extend``.
    Rows of the dynamic programme are vectors over all pairs and all places of
    ``b``; gaps along ``b`` are running maxima."""
    (x, nx), (y, ny) = _matrix(a, -1), _matrix(b, -2)
    rows, w = y.shape
    j = np.arange(w + 1)
    low = -1e18
    edge = np.where(j == 0, 0.0, -(start + (j - 1) * extend))
    prev = np.zeros((rows, w + 1)) if local else np.tile(edge, (rows, 1))
    up = np.full((rows, w + 1), low)
    best = np.zeros(rows)
    final = np.where(nx == 0, prev[np.arange(rows), ny], 0.0)
    inside = j[None, 1:] <= ny[:, None]
    for i in range(x.shape[1]):
        score = np.where(y == x[:, i : i + 1], same, other)
        for (p, q), v in (pairs or {}).items():
            score = np.where((x[:, i : i + 1] == p) & (y == q), v, score)
        up = np.maximum(up - extend, prev - start)
        now = np.empty_like(prev)
        now[:, 0] = 0.0 if local else edge[min(i + 1, w)] if i + 1 <= w else -(start + i * extend)
        now[:, 1:] = np.maximum(prev[:, :-1] + score, up[:, 1:])
        if local:
            now = np.maximum(now, 0.0)
        # gap ending at j that starts after k: now[k] - start - (j-k-1)*extend
        run = np.maximum.accumulate(now + j * extend, axis=1)
        now[:, 1:] = np.maximum(now[:, 1:], run[:, :-1] - start - (j[1:] - 1) * extend)
        live = i < nx
        if local:
            best = np.maximum(best, np.where(live, np.where(inside, now[:, 1:], 0.0).max(1), 0.0))
        final = np.where(i + 1 == nx, now[np.arange(rows), ny], final)
        prev = now
    return best if local else final


def needleman_wunsch(a: Column, b: Column) -> Column:
    """Global alignment score: mismatch and gap -1 each, match 0; the negative
    edit distance, so it stays in the JVM."""
    return levenshtein_score(a, b)


def smith_waterman(a: Column, b: Column) -> Column:
    """Local alignment score: match 2, mismatch -1, gap -1 for each sign."""
    return _batched(lambda x, y: align_values(x, y, 2, -1, 1, 1, True), a, b)


def affine_gap(a: Column, b: Column) -> Column:
    """Local alignment score: match 2, mismatch -1, gap -2 and -1 for each further sign."""
    return _batched(lambda x, y: align_values(x, y, 2, -1, 2, 1, True), a, b)


# Groups of signs that count as near.
NEAR = ["dt", "gj", "lr", "mn", "bpv", "aeiou", ",."]


def monge_elkan_values(a: list[str], b: list[str]) -> np.ndarray:
    near = {(ord(p), ord(q)): 3.0 for g in NEAR for p in g for q in g if p != q}
    a, b = [x.lower() for x in a], [x.lower() for x in b]
    short = np.array([min(len(p), len(q)) for p, q in zip(a, b)])
    got = align_values(a, b, 5, -3, 5, 1, True, near) / np.maximum(5 * short, 1)
    return np.where(short > 0, got, [float(p == q) for p, q in zip(a, b)])


def monge_elkan(a: Column, b: Column) -> Column:
    """Distance 1 - similarity: affine-gap local alignment (match 5, near signs
    3, mismatch -3, gap -5 and -1) over the most the shorter string can reach."""
    return 1 - _batched(monge_elkan_values, a, b)


def best_of(measure: Callable[[Column, Column], Column], xs: Column, ys: Column) -> Column:
    """Smallest distance over all pairs of two value sets, for JVM measures
    (others: ``best_by_pair``); no values on a side: null."""
    every = F.array_min(F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: measure(x, y)))))
    return F.when((F.size(xs) == 1) & (F.size(ys) == 1), measure(F.get(xs, F.lit(0)), F.get(ys, F.lit(0)))).otherwise(every)


def best_by_pair(df: DataFrame, keys: list[str], measure: Callable[[Column, Column], Column], xs: Column, ys: Column, name: str) -> DataFrame:
    """``df`` with the smallest distance over all pairs of two value sets of each
    row as column ``name``, for any measure: each pair of values is compared once,
    as a plain column, and its distance joined back by ``keys`` (unique)."""
    values = df.select(*keys, F.explode(xs).alias("_x"), ys.alias("_ys")).select(*keys, "_x", F.explode("_ys").alias("_y"))
    made = values.select("_x", "_y").distinct().withColumn("_d", measure(F.col("_x"), F.col("_y")))
    best = values.join(made, ["_x", "_y"]).groupBy(*keys).agg(F.min("_d").alias(name))
    return df.join(best, keys, "left")


#: Measures that run over Arrow batches; they can't stand in a lambda.
ARROW = {jaro, jaro_winkler, jaro_standard, jaro_winkler_standard, isub, substring, needleman_wunsch, smith_waterman, affine_gap, monge_elkan}

#: Measures by name.  Scores (higher is closer) are listed apart.
DISTANCES: dict[str, Callable[[Column, Column], Column]] = {
    "equality": equality,
    "relaxed-equality": relaxed_equality,
    "levenshtein": levenshtein,
    "jaro": jaro,
    "jaro-winkler": jaro_winkler,
    "substring": substring,
    **{f"qgrams-{q}": (lambda a, b, q=q: qgrams(a, b, q)) for q in (2, 3, 4, 5, 6, 8, 10)},
}
SCORES: dict[str, Callable[[Column, Column], Column]] = {
    "needleman-wunsch": needleman_wunsch,
    "approx-needleman-wunsch": needleman_wunsch,
    "smith-waterman": smith_waterman,
    "levenshtein-score": levenshtein_score,
    "affine-gap": affine_gap,
}
#: The vector of thirteen, in order; the first five are scores.
VECTOR = ["nw", "anw", "sw", "lv", "ap", "slv", "me", "ja", "jw", "isub", "req", "sub", "qgr"]


def vector(a: Column, b: Column) -> dict[str, Column]:
    """All thirteen measures of a pair, by short name."""
    sub = substring(a, b)
    return {
        "nw": needleman_wunsch(a, b), "anw": needleman_wunsch(a, b), "sw": smith_waterman(a, b), "lv": levenshtein_score(a, b),
        "ap": affine_gap(a, b), "slv": levenshtein(a, b), "me": monge_elkan(a, b), "ja": jaro_standard(a, b),
        "jw": jaro_winkler_standard(a, b), "isub": sub, "req": relaxed_equality(a, b), "sub": sub,
        "qgr": qgrams(a, b, 2),
    }
