"""Link rules: comparisons of property values, combined to a confidence.

A rule compiles to one column over entities paired by a blocking join, so
Catalyst plans it as a projection.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import distance as D
from tessera.functions import text as X
from tessera.functions.aggregate import combined, confidence
from tessera.operators import alignment

#: Tasks that share the rows of one blocking key.
SPREAD = 8


@dataclass
class Comparison:
    """Distance of the values of two paths under a threshold.

    ``transform`` works on value sets; the smallest distance over all value
    pairs counts.  No value on a side: null if required, else -1."""

    left: str
    right: str
    measure: Callable[[Column, Column], Column] = D.equality
    threshold: float = 0.0
    required: bool = False
    weight: float = 1.0
    transform: Callable[[Column], Column] = field(default=lambda v: v)
    #: Column with the distance, once it is made (see ``with_distances``).
    distance: str = ""

    def values(self) -> tuple[Column, Column]:
        return self.transform(F.col(f"a_{self.left}")), self.transform(F.col(f"b_{self.right}"))

    def column(self) -> Column:
        d = F.col(self.distance) if self.distance else D.best_of(self.measure, *self.values())
        c = confidence(d, self.threshold, self.required)
        return F.when(d.isNotNull(), c).otherwise(F.lit(None if self.required else -1.0).cast("double"))

    def paths(self) -> tuple[set[str], set[str]]:
        return {self.left}, {self.right}


@dataclass
class Structural:
    """Confidence of a distance column made beforehand (such as a taxonomy
    distance); a pair that lacks it gets -1, or null if required."""

    distance: str
    threshold: float
    required: bool = False
    weight: float = 1.0

    def column(self) -> Column:
        d = F.col(self.distance)
        return F.when(d.isNotNull(), confidence(d, self.threshold, self.required)).otherwise(F.lit(None if self.required else -1.0).cast("double"))

    def paths(self) -> tuple[set[str], set[str]]:
        return set(), set()


@dataclass
class Aggregation:
    parts: Sequence[Comparison | Structural | Aggregation]
    how: str = "average"
    weight: float = 1.0
    required: bool = False

    def column(self) -> Column:
        return combined(self.how, [(p.column(), p.weight, p.required) for p in self.parts])

    def paths(self) -> tuple[set[str], set[str]]:
        both = [p.paths() for p in self.parts]
        return reduce(set.union, (x for x, _ in both), set()), reduce(set.union, (y for _, y in both), set())


Rule = Comparison | Structural | Aggregation


def with_distances(rule: Rule, rows: DataFrame) -> tuple[Rule, DataFrame]:
    """The rule and the pairs ``source, target, ...`` with a column for each
    comparison whose measure can't stand in a lambda."""
    if isinstance(rule, Aggregation):
        parts = []
        for part in rule.parts:
            part, rows = with_distances(part, rows)
            parts.append(part)
        return replace(rule, parts=parts), rows
    if isinstance(rule, Comparison) and rule.measure in D.ARROW and not rule.distance:
        name = f"_d{sum(c.startswith('_d') for c in rows.columns)}"
        return replace(rule, distance=name), D.best_by_pair(rows, ["source", "target"], rule.measure, *rule.values(), name)
    return rule, rows


def entities(triples: DataFrame, paths: Sequence[str], restrict: tuple[str, str] | None = None) -> DataFrame:
    """``uri`` and a sorted value set for each property path (a predicate, or
    several joined by ``/``); ``restrict`` keeps subjects with ``(p, o)``."""
    t = triples.select("s", "p", "o").where("o is not null")
    subjects = t.where((F.col("p") == restrict[0]) & (F.col("o") == restrict[1])) if restrict else t
    out = subjects.select(F.col("s").alias("uri")).distinct()
    for path in paths:
        at = out.select("uri", F.col("uri").alias("v"))
        for p in path.split("/"):
            at = at.join(t.where(F.col("p") == p).select(F.col("s").alias("v"), F.col("o").alias("n")), "v").select("uri", F.col("n").alias("v"))
        out = out.join(at.groupBy("uri").agg(F.array_sort(F.collect_set("v")).alias(path)), "uri", "left")
    return out.select("uri", *[F.coalesce(F.col(f"`{p}`"), F.array().cast("array<string>")).alias(p) for p in paths])


def path_frequencies(triples: DataFrame, restrict: tuple[str, str] | None = None) -> DataFrame:
    """``path, frequency``: share of the entities that have the property."""
    t = triples.select("s", "p", "o")
    if restrict:
        own = t.where((F.col("p") == restrict[0]) & (F.col("o") == restrict[1])).select("s").distinct()
        t = t.join(own, "s", "left_semi")
    total = t.agg(F.countDistinct("s").alias("n"))
    return t.groupBy("p").agg(F.countDistinct("s").alias("k")).join(F.broadcast(total)).select(F.col("p").alias("path"), (F.col("k") / F.col("n")).alias("frequency"))


def generate_links(rule: Rule, a: DataFrame, b: DataFrame, keys_a: Callable[[], Column] | None = None, keys_b: Callable[[], Column] | None = None, block: tuple[str, str] | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """``source, target, confidence`` of pairs whose confidence isn't negative.

    ``candidates`` (``source, target``) gives the pairs to compare, such as those
    of ``required_pairs``; if it has the distances of all comparisons, under the
    names the rule gives them, values are not looked up again.  Without it, pairs share a blocking key: by default an equal lower-cased token or whole
    value of the properties ``block``; ``keys_a`` and ``keys_b`` give other
    arrays of keys."""
    if candidates is not None and (known := _distances(rule)) <= {*candidates.columns}:
        rows = candidates.select("source", "target", *sorted(known)).distinct()
        return rows.select("source", "target", rule.column().alias("confidence")).where("confidence >= 0")
    if candidates is None and (keys_a is None or keys_b is None):
        left, right = block or tuple(next(iter(sorted(s))) for s in rule.paths())
        make = lambda c: F.array_distinct(F.flatten(F.transform(c, lambda v: F.concat(F.split(F.lower(v), r"[^\p{L}\p{Nd}]+"), F.array(F.lower(v))))))
        keys_a, keys_b = (lambda: make(F.col(left))), (lambda: make(F.col(right)))
    keys = lambda made: [F.array_distinct(F.filter(made(), lambda k: k != "")).alias("_keys")] if candidates is None else []
    left = a.select(F.col("uri").alias("source"), *[F.col(f"`{c}`").alias(f"a_{c}") for c in a.columns if c != "uri"], *keys(keys_a))
    right = b.select(F.col("uri").alias("target"), *[F.col(f"`{c}`").alias(f"b_{c}") for c in b.columns if c != "uri"], *keys(keys_b))
    pairs = _sharing_a_key(left, right) if candidates is None else candidates.select("source", "target").distinct().join(left, "source").join(right, "target")
    rule, rows = with_distances(rule, pairs)
    return rows.select("source", "target", rule.column().alias("confidence")).where("confidence >= 0")


def _distances(rule: Rule) -> set[str]:
    """Names of the distance columns of a rule; "" if a comparison has none yet."""
    return set().union(*map(_distances, rule.parts)) if isinstance(rule, Aggregation) else {rule.distance}


def _sharing_a_key(left: DataFrame, right: DataFrame) -> DataFrame:
    """The pairs of rows with a common element of ``_keys``, each once: where they
    meet by their smallest common key.  Only the two sides are shuffled, not the
    pairs; rows of a frequent key are dealt to several tasks."""
    left = left.withColumn("_part", F.pmod(F.xxhash64("source"), F.lit(SPREAD))).select("*", F.explode("_keys").alias("_key"))
    right = right.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long")))).select("*", F.explode("_keys").alias("_key"))
    left, right = (df.withColumnRenamed("_keys", f"_keys_{k}").repartition(SPREAD * 8, "_key", "_part") for k, df in (("a", left), ("b", right)))
    met = left.join(right, ["_key", "_part"]).where(F.array_min(F.array_intersect("_keys_a", "_keys_b")) == F.col("_key"))
    return met.drop("_key", "_part", "_keys_a", "_keys_b")


def required_pairs(c: Comparison, a: DataFrame, b: DataFrame) -> DataFrame:
    """``source, target`` that may meet a required comparison: its threshold is a
    lossless similarity join of the transformed values.  Measures without one are
    an error."""
    from tessera.operators import pairs

    side = lambda df, at, p: df.select("uri", F.explode(c.transform(F.col(f"`{p}`"))).alias("label"))
    xs, ys = side(a, "a", c.left), side(b, "b", c.right)
    t, name = c.threshold, getattr(c.measure, "__name__", "")
    if name in ("jaro", "jaro_standard", "jaro_winkler", "jaro_winkler_standard"):
        # a common prefix of up to four signs takes off at most four tenths
        made = pairs.jaro_candidates(xs.select(F.col("label").alias("x")), ys.select(F.col("label").alias("y")), t / 0.6 if "winkler" in name else t)
        # most texts of the same signs are far apart: they go before anything is joined
        made = made.where(c.measure(F.col("x"), F.col("y")) <= t + 1e-9)
        made = made.join(xs.toDF("e1", "x"), "x").join(ys.toDF("e2", "y"), "y")
    elif name == "levenshtein":
        made = pairs.levenshtein_join(xs, ys, t)
    elif name == "equality":
        made = pairs.equality_join(xs, ys, lambda v: v)
    elif name == "relaxed_equality":
        made = pairs.relaxed_join(xs, ys)
    else:
        raise ValueError(f"no lossless join for {name or c.measure}")
    return made.select(F.col("e1").alias("source"), F.col("e2").alias("target")).distinct()


def evaluate(rule: Rule, a: DataFrame, b: DataFrame, reference: DataFrame, **how) -> DataFrame:
    """Links of a rule against a reference alignment: its ``statistics``."""
    found = generate_links(rule, a, b, **how).select(F.col("source").alias("e1"), F.col("target").alias("e2"), (1 - F.col("confidence")).alias("p"))
    return alignment.statistics(found, reference)


def evaluate_thresholds(pairs: DataFrame, reference: DataFrame, steps: int = 100) -> DataFrame:
    """``threshold`` (1 - t), ``precision``, ``recall`` for t = 0, 1/steps, ... 1
    in one pass over scored pairs."""
    df = alignment.sweep(pairs, reference, [i / steps for i in range(steps + 1)])
    return df.select((1 - F.col("t")).alias("threshold"), "precision", "recall")


#: Name evaluations: measure and transform names whose product is tried.
NAME_MEASURES = ["qgrams-2", "qgrams-3", "qgrams-4", "qgrams-5", "qgrams-6", "qgrams-8", "qgrams-10", "levenshtein"]


#: All name evaluations whose measures and transforms are JVM columns.
NAME_EVALUATIONS = [(m, x) for m in NAME_MEASURES for x in X.TRANSFORMS]


def name_pairs(a: DataFrame, b: DataFrame, measure: str, transform: str, t: float, q: int = 2) -> DataFrame:
    """``e1, e2, p`` of entities ``uri, label`` within ``t`` by a transform and a
    measure of ``NAME_EVALUATIONS``: candidates share a q-gram of the transformed
    label, or all grams if the measure is one of q-grams and lossless joins apply."""
    from tessera.operators import pairs

    def made(df: DataFrame) -> DataFrame:
        sets = df.groupBy("uri").agg(X.TRANSFORMS[transform](F.collect_set("label")).alias("v"))
        return sets.select("uri", F.explode("v").alias("label"))

    if measure.startswith("qgrams-") and t < 1:
        return pairs.qgram_join(made(a), made(b), t, int(measure.partition("-")[2]))
    if measure == "levenshtein" and t <= 0.5:
        return pairs.levenshtein_join(made(a), made(b), t)
    return pairs.blocked_join(made(a), made(b), lambda c: D.grams(c, q), D.DISTANCES[measure], t)


def code_rule(path: str = "code") -> Comparison:
    return Comparison(path, path, D.equality, 0.0, True, transform=X.TRANSFORMS["lc"])


def name_rule(measure: str, transform: str, threshold: float, path: str = "name") -> Comparison:
    return Comparison(path, path, D.DISTANCES[measure], threshold, transform=X.TRANSFORMS[transform])


def name_and_code_rule(measure: str = "qgrams-2", threshold: float = 0.3) -> Aggregation:
    return Aggregation([code_rule(), name_rule(measure, "lc", threshold)], "average")


def load_spec(text: str) -> dict:
    """Link specification XML -> prefixes, link type, restrictions, and the rule.

    Comparisons become JVM rules; measures without a JVM form are an error."""
    root = ET.fromstring(text)
    link = root.find(".//Interlink")
    known = {"levenshteinDistance": "levenshtein", "levenshtein": "levenshtein", "equality": "equality", "qGrams": "qgrams-2", "relaxedEquality": "relaxed-equality", "jaro": "jaro", "jaroWinkler": "jaro-winkler", "substring": "substring"}

    def path_of(e: ET.Element) -> tuple[str, list[str]]:
        fns, at = [], e
        while at.tag == "TransformInput":
            fns.append(at.get("function"))
            at = at[0]
        return at.get("path").partition("/")[2], fns

    def rule_of(e: ET.Element) -> dict:
        if e.tag == "Aggregate":
            return {"aggregate": e.get("type", "average"), "weight": float(e.get("weight", 1)), "parts": [rule_of(c) for c in e]}
        (left, fl), (right, fr) = (path_of(c) for c in list(e)[:2])
        return {
            "measure": known[e.get("metric")], "threshold": float(e.get("threshold", 0)), "required": e.get("required") == "true",
            "weight": float(e.get("weight", 1)), "left": left, "right": right, "transforms": (fl, fr),
        }

    return {
        "prefixes": {p.get("id"): p.get("namespace") for p in root.iter("Prefix")},
        "link_type": link.findtext("LinkType"),
        "restrict": tuple((d.findtext("RestrictTo") or "").strip() for d in (link.find("SourceDataset"), link.find("TargetDataset"))),
        "rule": rule_of(link.find("LinkageRule")[0]),
    }


#: Transforms of link specifications.
SPEC_TRANSFORMS = {"lowerCase": "lc"}


def compile_rule(node: dict) -> Rule:
    """Rule of a specification's tree (see ``load_spec``)."""
    if "aggregate" in node:
        return Aggregation([compile_rule(p) for p in node["parts"]], node["aggregate"], node["weight"])
    fns = node["transforms"][0]
    if fns != node["transforms"][1]:
        raise ValueError("transforms of the two sides differ")

    def transform(v: Column) -> Column:
        for fn in reversed(fns):
            v = X.TRANSFORMS[SPEC_TRANSFORMS[fn]](v)
        return v

    return Comparison(node["left"], node["right"], D.DISTANCES[node["measure"]], node["threshold"], node["required"], node["weight"], transform)


def run_spec(spec: dict, a: DataFrame, b: DataFrame, **how) -> DataFrame:
    """Links of a specification between two sets of triples ``s, p, o``: its
    restrictions choose the entities, its paths their values.  A single required
    comparison chooses the candidates; other rules take ``generate_links``'s."""
    rule = compile_rule(spec["rule"])
    left, right = rule.paths()

    def side(triples: DataFrame, paths: set[str], restrict: str) -> DataFrame:
        parts = restrict.rstrip(" .").split()
        return entities(triples, sorted(paths), tuple(parts[1:3]) if len(parts) == 3 else None)

    ea, eb = side(a, left, spec["restrict"][0]), side(b, right, spec["restrict"][1])
    if isinstance(rule, Comparison) and rule.required and not how:
        how = {"candidates": required_pairs(rule, ea, eb)}
    return generate_links(rule, ea, eb, **how)
