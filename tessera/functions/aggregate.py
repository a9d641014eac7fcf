"""Weighted aggregators of distance vectors, and rule confidences, as columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def weighted(dist: Column, weights: Sequence[float]) -> Column:
    """``array<struct(d, w)>`` of the places with a positive weight and a
    distance that isn't null."""
    ws = F.array(*[F.lit(float(w)) for w in weights])
    pairs = F.zip_with(dist, ws, lambda d, w: F.struct(d.alias("d"), w.alias("w")))
    return F.filter(pairs, lambda x: (x["w"] > 0) & x["d"].isNotNull())


def _sum(xs: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + of(x))


def minimum(xs: Column) -> Column:
    return F.array_min(F.transform(xs, lambda x: x["d"]))


def maximum(xs: Column) -> Column:
    return F.array_max(F.transform(xs, lambda x: x["d"]))


def average(xs: Column) -> Column:
    return F.when(F.size(xs) > 0, _sum(xs, lambda x: x["d"] * x["w"]) / _sum(xs, lambda x: x["w"]))


def geometric_mean(xs: Column) -> Column:
    """exp of the weighted mean logarithm; 0 if a value is 0."""
    zero = F.exists(xs, lambda x: x["d"] <= 0)
    logs = _sum(xs, lambda x: x["w"] * F.log(F.when(x["d"] > 0, x["d"]).otherwise(1.0)))
    return F.when(F.size(xs) == 0, None).when(zero, 0.0).otherwise(F.exp(logs / _sum(xs, lambda x: x["w"])))


def quadratic_mean(xs: Column) -> Column:
    return F.when(F.size(xs) > 0, F.sqrt(_sum(xs, lambda x: x["w"] * x["d"] * x["d"]) / _sum(xs, lambda x: x["w"])))


#: Aggregators by name: column of ``weighted`` -> column; nothing to aggregate: null.
AGGREGATORS: dict[str, Callable[[Column], Column]] = {
    "min": minimum,
    "max": maximum,
    "average": average,
    "geoMean": geometric_mean,
    "quadMean": quadratic_mean,
}


def aggregate(name: str, dist: Column, weights: Sequence[float]) -> Column:
    return AGGREGATORS[name](weighted(dist, weights))


def is_trivial(dist: Column, weights: Sequence[float]) -> Column:
    """Whether the weighted sum of the distances is 0."""
    return F.coalesce(_sum(weighted(dist, weights), lambda x: x["d"] * x["w"]), F.lit(0.0)) == 0


def weights_label(names: Sequence[str], weights: Sequence[float]) -> str:
    """Name of a weighting, like ``sub+3*lev``."""
    return "+".join(n if w == 1 else f"{w:g}*{n}" for n, w in zip(names, weights) if w > 0)


# ---- confidences: 1 = equal, -1 = different


def confidence(d: Column, t: float, required: bool = False) -> Column:
    """Confidence of a distance under a threshold: 1 at 0 if ``t`` is 0; falls
    from 1 to -1 between 0 and ``2t``; beyond -1, or null if ``required``."""
    miss = F.lit(None).cast("double") if required else F.lit(-1.0)
    if t == 0:
        return F.when(d == 0, 1.0).otherwise(miss)
    return F.when(d <= 2 * t, 1 - d / t).otherwise(miss)


def combined(name: str, parts: Sequence[tuple[Column, float, bool]]) -> Column:
    """Confidence of an aggregation of ``(confidence, weight, required)``: a
    required part that is null makes it null, others that are null are left out."""
    xs = F.array(*[F.struct(c.alias("d"), F.lit(float(w)).alias("w")) for c, w, _ in parts])
    xs = F.filter(xs, lambda x: x["d"].isNotNull() & (x["w"] > 0))
    if name in ("geoMean", "quadMean"):
        raise ValueError("confidences may be negative: min, max or average")
    out = AGGREGATORS[name](xs)
    for c, _, required in parts:
        if required:
            out = F.when(c.isNotNull(), out)
    return out
