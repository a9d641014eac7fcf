"""Matching entities of two tables without a common key, by cross-table BM25.

A record becomes a set of terms over all its attributes: the words of its names
and texts, pairs of near words, its class words, maker words, place words and the
size class of its amount.  Words of names and makers that the other table doesn't
know (misspelt, split) are looked up by their 5-grams instead; as each letter lies
in five of them, a gram weighs a fifth.  Each table is an inverted index for the
other.

* Top-k.  Every record queries the other table's postings for the ``k`` records of
  largest score, among those that reach the share ``least`` of the query's own
  weight.  Its terms are ranked by the length of their postings; the sums of the
  first ``FIRST`` terms' scores give a bound that the true k-th score can't be
  below.  Terms whose largest possible scores together stay below that bound (or
  the share) can't bring a record into the result alone, so only the other terms'
  postings are joined; records whose score there plus all that was left out stays
  below are dropped, and the rest are scored over all terms.  The result is that of
  scoring everything (tested), whatever a posting's length.
* Confidence.  A logistic function of the score gap to the best other entity, of
  the told words the other lacks, and of the share of the name that agrees.  It is
  calibrated on an attribute that it doesn't see: whether the amounts agree, which
  holds for nearly all true pairs and for false ones by chance only.  The chance
  comes from the amounts' distributions.  A pair's own amounts then weigh in by
  Bayes' rule.
* Mutual nearest.  A pair stands if the record of the first table is the other's
  most confident and its own most confident partner points back, up to copies:
  records of the first table that tell the same ``entity`` are one.

Words of other languages are learnt from the tables: a word of alternative names
that nearly always comes with one word of the name is its translation.
Exact copies of a record are one record until the pairs are written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.runtime import Workspace

K1, B = 1.2, 0.3
#: Neighbours that are retrieved for each record of the second table.
K = 2
#: Share of a query's own weight that a record must score to be retrieved, for
#: queries of the second and of the first table (the first tells more).
LEAST, LEAST_BACK = 0.45, 0.6
#: Terms with the shortest postings that give the first bound on the k-th score.
FIRST = 6
#: Signs of a gram.
Q = 5
#: Pairs that the logistic function is fitted on, at most: those of lowest hash.
SAMPLE = 20_000
#: Rows from which a word counts as translated, and the share that must agree.
SEEN, SURE = 5, 0.8
TOLERANCE = 0.04
KJ = 4.184
#: Kinds of terms.
WORD, GRAM, PAIR, CLASS, MAKER, MAKER_GRAM, PLACE, SIZE = range(8)
#: Weights of kinds of terms; others weigh 1.
FIELDS = {GRAM: 1 / Q, MAKER_GRAM: 1 / Q, CLASS: 0.5, PLACE: 0.5, SIZE: 0.5}
#: Width of a size class, as a difference of logarithms.
STEP = 0.15
FEATURES = ["gap", "miss", "name", "lost", "got"]


def _words(c: Column) -> Column:
    """Lower-case words in order, plural s taken off."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(words, lambda w: F.regexp_replace(w, r"(?<=.{3})s$", ""))


def _grams(w: Column) -> Column:
    s = F.concat(F.lit("#"), w, F.lit("#"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(s) - Q + 1)), lambda i: F.substring(s, i, F.lit(Q))))


def _latest(df: DataFrame, key: str, cols: list[str], when: list[str]) -> DataFrame:
    """One row of each non-null ``key``: of every column the latest value that
    isn't null (ties: the largest value)."""
    pick = [
        F.max_by(F.col(c), F.struct(F.col(c).isNotNull().alias("a"), *[F.col(w) for w in when], F.col(c).cast("string").alias("z"))).alias(c)
        for c in cols
    ]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*pick)


def translations(names: DataFrame) -> DataFrame:
    """``word, means``: words of ``others`` (array of alternative names) that come
    with one word of ``name`` in at least ``SURE`` of at least ``SEEN`` rows."""
    alt = names.select(_words(F.col("name")).alias("own"), F.array_distinct(F.flatten(F.transform("others", _words))).alias("ts"))
    alt = alt.select("own", F.explode(F.array_except("ts", "own")).alias("word"))
    seen = alt.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= SEEN)
    both = alt.select("word", F.explode("own").alias("means")).groupBy("word", "means").agg(F.count("*").alias("k"))
    best = both.groupBy("word").agg(F.max(F.struct("k", "means")).alias("b"))
    return best.join(seen, "word").where(F.col("b.k") >= SURE * F.col("n")).select("word", "b.means")


TERMS = "array<struct<t:bigint,k:int,of:bigint>>"


def _tagged(xs: Column, space: str, kind: int) -> Column:
    """Terms of strings: their hashes within a name space, and a kind."""
    return F.transform(F.array_distinct(xs), lambda x: F.struct(F.xxhash64(F.lit(space), x).alias("t"), F.lit(kind).alias("k"), F.lit(0).cast("bigint").alias("of"))).cast(TERMS)


def _gram_terms(xs: Column, space: str, kind: int) -> Column:
    """Terms of the grams of words, with the hash of the word they come from."""
    of = lambda x: F.transform(_grams(x), lambda g: F.struct(F.xxhash64(F.lit(space + "#"), g).alias("t"), F.lit(kind).alias("k"), F.xxhash64(F.lit(space), x).alias("of")))
    return F.flatten(F.transform(F.array_distinct(xs), of)).cast(TERMS)


def _near(ws: Column) -> Column:
    """Unordered pairs of different words at most two places apart."""
    at = lambda w, i, j: F.when(F.get(ws, i + j) != w, F.concat_ws(" ", F.array_sort(F.array(w, F.get(ws, i + j)))))
    return F.flatten(F.transform(ws, lambda w, i: F.filter(F.array(at(w, i, 1), at(w, i, 2)), lambda x: x.isNotNull())))


def _terms(df: DataFrame, means: DataFrame, ws: Workspace, tag: str) -> DataFrame:
    """``uri, entity, amount, terms`` of records ``uri, entity, name, others, said,
    group, maker, place, amount``: terms are a hash, a kind, and for grams the hash
    of their word."""
    none = F.array().cast("array<string>")
    texts = F.concat(F.array("name"), F.coalesce("others", none), F.array("said"))
    size = F.when(F.col("amount") > 0, F.array(F.round(F.log("amount") / F.lit(STEP)).cast("string")))
    maker = _words(F.col("maker"))
    made = F.concat(
        _tagged(F.concat(_words(F.col("group")), _words(F.col("said"))), "g", CLASS), _tagged(maker, "b", MAKER), _gram_terms(maker, "b", MAKER_GRAM),
        _tagged(_words(F.col("place")), "o", PLACE), _tagged(F.coalesce(size, none), "e", SIZE),
    )
    base = ws.cut(
        df.select("uri", "entity", F.when(F.col("amount") > 0, F.col("amount")).alias("amount"), F.transform(texts, _words).alias("told"), F.size(F.coalesce("others", none)).alias("said_at"), made.alias("made")),
        f"base_{tag}",
    )
    # every text's words in their meaning, in order
    word = base.select("uri", F.posexplode("told").alias("text", "ws")).select("uri", "text", F.posexplode("ws").alias("i", "word")).join(means, "word", "left")
    lines = word.groupBy("uri", "text").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("means", "word").alias("w")))).alias("x")).select("uri", "text", F.col("x.w").alias("ws"))
    # neighbours may be one word that a blank splits
    joined = F.transform(F.filter(F.transform("ws", lambda w, i: F.when(F.get("ws", i + 1).isNotNull(), F.concat(w, F.get("ws", i + 1)))), lambda x: x.isNotNull()), lambda x: x)
    lines = lines.select("uri", "text", "ws", joined.alias("joined"), _near(F.col("ws")).alias("pairs"))
    said = lines.groupBy("uri").agg(*[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("ws", "joined", "pairs")])
    named = lines.join(base.select("uri", "said_at"), "uri").where(F.col("text") <= F.col("said_at")).groupBy("uri").agg(F.array_distinct(F.flatten(F.collect_list("ws"))).alias("own"))
    rows = base.join(said, "uri", "left").join(named, "uri", "left")
    of = lambda c: F.coalesce(F.col(c), none)
    words = of("ws") if tag == "a" else F.concat(of("ws"), of("joined"))
    terms = F.concat(_tagged(words, "w", WORD), _gram_terms(of("own"), "w", GRAM), _tagged(of("pairs"), "p", PAIR), "made")
    return rows.select("uri", "entity", "amount", F.array_sort(terms).alias("terms"))


def foods(cul: DataFrame, wik: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both vocabularies as records ``uri, entity, amount, terms``: attributes of
    the same meaning share terms, texts are taken as words."""
    cul = _latest(cul, "uri", ["food_name", "alt_names", "country_code", "energy_kcal", "category", "maker"], ["edited_at", "loaded_at"])
    wik = _latest(wik, "uri", ["label", "aliases", "origin", "energy_kj", "brand", "blurb"], ["edited_at", "loaded_at"])
    none = F.lit(None).cast("string")
    name = places.groupBy("country_code").agg(F.min("place_name").alias("place"))
    a = cul.join(name, "country_code", "left").select(
        "uri", F.col("food_name").alias("name"), F.coalesce("alt_names", F.array().cast("array<string>")).alias("others"), none.alias("said"),
        F.col("category").alias("group"), "maker", "place", F.nanvl("energy_kcal", F.lit(None).cast("double")).alias("amount"),
        F.xxhash64(F.array_sort(F.array_distinct(_words(F.col("food_name"))))).alias("entity"),
    )
    b = wik.select(
        "uri", F.col("label").alias("name"), F.split(F.coalesce("aliases", F.lit("")), ";").alias("others"), F.col("blurb").alias("said"),
        none.alias("group"), F.col("brand").alias("maker"), F.col("origin").alias("place"), (F.col("energy_kj") / KJ).alias("amount"),
        F.xxhash64("uri").alias("entity"),
    )
    ws = Workspace(cul.sparkSession, "words")
    means = ws.cut(translations(a.select("name", "others")), "means")
    return _terms(a, means, ws, "a"), _terms(b, means, ws, "b")


class Index:
    """A table of records ``id, terms`` with its postings ``d, t, f`` and its
    terms ``t, df, mf``; ``f`` is BM25's factor of a record's length, ``mf`` the
    largest one in a posting."""

    def __init__(self, recs: DataFrame, ws: Workspace, tag: str):
        size = F.size(F.filter("terms", lambda x: x["of"] == 0))
        n, mean = recs.agg(F.count("*"), F.avg(size)).first()
        self.n = n
        f = (K1 + 1) / (1 + K1 * (1 - B + B * size / F.lit(mean or 1.0)))
        self.recs = recs.withColumn("f", f)
        self.posts = ws.cut(self.recs.select(F.col("id").alias("d"), "f", F.explode(F.array_distinct("terms.t")).alias("t")), f"posts_{tag}")
        self.terms = ws.cut(self.posts.groupBy("t").agg(F.count("*").alias("df"), F.max("f").alias("mf")), f"terms_{tag}")

    def idf(self, df: Column) -> Column:
        return F.log(1 + (F.lit(self.n) - df + 0.5) / (df + 0.5))


def _scores(batches):
    """Score of each pair over all terms, its part from size classes, and the
    features, from the lists of both records."""
    for batch in batches:
        n = batch.num_rows
        lists = {c: batch.column(c) for c in ("qt", "qk", "qw", "qn", "dt")}
        flat = {c: v.flatten().to_numpy(zero_copy_only=False) for c, v in lists.items()}
        size = {c: np.diff(v.offsets.to_numpy()) for c, v in lists.items()}
        pq, pd = np.repeat(np.arange(n), size["qt"]), np.repeat(np.arange(n), size["dt"])
        codes, inv = np.unique(np.concatenate([flat["qt"], flat["dt"]]), return_inverse=True)
        m = len(codes)
        hit = np.isin(pq * m + inv[: len(pq)], pd * m + inv[len(pq) :])
        k, w, known = flat["qk"], flat["qw"], flat["qn"]
        f = batch.column("f").to_numpy()
        add = lambda mask: np.bincount(pq[mask], w[mask], n).astype(float)
        name = (k == WORD) | (k == GRAM)
        whole = add(name)
        cols = {
            "q": batch.column("q"), "d": batch.column("d"), "floor": batch.column("floor"), "s": f * add(hit), "size": f * add(hit & (k == SIZE)), "total": add((k != SIZE) & (known | (k == GRAM))),
            "miss": add((k == WORD) & ~hit), "name": add(hit & name) / np.where(whole > 0, whole, 1),
            "lost": add((k == GRAM) & ~hit), "got": add((k == GRAM) & hit),
        }
        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols.values()], names=list(cols))


def top_k(queries: Index, docs: Index, k: int, ws: Workspace, tag: str, least: float = LEAST, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """``q, d, s`` and the pair's features: for each record of ``queries`` the
    ``k`` records of ``docs`` with the largest score, more if the last ones tie,
    of those that score at least the share ``least`` of the query's own weight
    (that of its terms known to ``docs`` and of the grams of its unknown names); exact.  Also the queries' weighted terms."""
    own = queries.recs.select(F.col("id").alias("q"), F.inline("terms")).join(docs.terms, "t", "left")
    # grams stand for words that the other table doesn't know
    own = own.join(docs.terms.select(F.col("t").alias("of"), F.col("df").alias("of_df")), "of", "left").where("of = 0 or of_df is null")
    own = own.groupBy("q", "t").agg(F.min("k").alias("k"), F.first("df").alias("df"), F.first("mf").alias("mf"))
    # terms the other table lacks score nothing; unknown grams still count as part of the name
    gram = F.col("k").isin(GRAM, MAKER_GRAM)
    w = docs.idf(F.coalesce("df", F.lit(0))) * F.coalesce(*[F.when(F.col("k") == kind, x) for kind, x in FIELDS.items()], F.lit(1.0))
    own = own.select("q", "t", "k", "df", "mf", F.when(F.col("df").isNotNull() | gram, w).otherwise(0.0).alias("w"))
    own = ws.cut(own, f"own_{tag}")
    order = Window.partitionBy("q").orderBy("df", "t")
    known = own.where("df is not null").withColumn("ub", F.col("w") * F.col("mf"))
    known = known.select("q", "t", "w", "ub", F.row_number().over(order).alias("r"), F.sum("ub").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("rest"))
    known = known.withColumn("rest", F.coalesce("rest", F.lit(0.0)))

    def sums(terms: DataFrame) -> DataFrame:
        return terms.join(docs.posts, "t").groupBy("q", "d").agg(F.sum(F.col("w") * F.col("f")).alias("part"))

    # a record below the share would have to bring it with the terms left out
    mine = own.where((F.col("k") != SIZE) & (F.col("df").isNotNull() | (F.col("k") == GRAM))).groupBy("q").agg((F.sum("w") * least - 1e-9).alias("floor"))
    known = known.join(mine, "q").where(F.col("rest") + F.col("ub") >= F.col("floor"))
    known = ws.cut(known.select("q", "t", "w", "ub", "r", "rest", "floor"), f"known_{tag}")
    best = sums(known.where(F.col("r") <= first)).withColumn("i", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("part"), "d")))
    kth = best.where(F.col("i") == k).select("q", (F.col("part") - 1e-9).alias("kth"))
    need = known.join(kth, "q", "left").withColumn("floor", F.greatest("floor", "kth")).where(F.col("rest") + F.col("ub") >= F.col("floor"))
    need = ws.cut(need.select("q", "t", "w", "rest", "floor"), f"need_{tag}")
    spare = need.groupBy("q").agg(F.min("rest").alias("spare"), F.first("floor").alias("floor"))
    met = sums(need).join(spare, "q").where(F.col("part") + F.col("spare") >= F.col("floor")).select("q", "d", "floor")
    out = scored(met, own, docs).where("s >= floor").drop("floor")
    out = out.withColumn("i", F.rank().over(Window.partitionBy("q").orderBy(F.desc(F.round("s", 9))))).where(F.col("i") <= k)
    return ws.cut(out.drop("i"), f"top_{tag}"), own


def scored(pairs: DataFrame, own: DataFrame, docs: Index) -> DataFrame:
    """``q, d, floor`` with the score of each pair over all terms and its features."""
    asked = own.groupBy("q").agg(F.collect_list(F.struct("t", "k", "w", F.col("df").isNotNull().alias("n"))).alias("x"))
    asked = asked.select("q", *[F.col(f"x.{c}").alias(f"q{c}") for c in "tkwn"])
    full = pairs.join(asked, "q").join(docs.recs.select(F.col("id").alias("d"), "f", F.array_distinct("terms.t").alias("dt")), "d")
    kinds = {c: pairs.schema[c].dataType.simpleString() for c in ("q", "d")}
    return full.mapInArrow(_scores, ", ".join([*(f"{c} {t}" for c, t in kinds.items()), *(f"{c} double" for c in ("floor", "s", "size", "total", "miss", "name", "lost", "got"))]))


def _fit(x: np.ndarray, y: np.ndarray, chance: float) -> tuple[np.ndarray, float]:
    """Coefficients of ``1, x`` of a logistic function for what can't be seen,
    and the share ``r`` of true pairs that agree, from whether pairs agree
    (``y``): true ones with share ``r``, false ones by ``chance``.  Expectation
    and Newton steps with a small ridge in turn; without both outcomes a steep
    default on the gap."""
    if not len(y) or y.min() == y.max():
        return np.array([0.0, 8.0, *[0.0] * (len(FEATURES) - 1)]), max(0.95, 2 * chance)
    x = np.column_stack([np.ones(len(y)), x])
    beta, r = np.zeros(x.shape[1]), max(0.95, 2 * chance)
    logistic = lambda: 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
    for _ in range(100):
        p = logistic()
        like, unlike = np.where(y > 0, r, 1 - r), np.where(y > 0, chance, 1 - chance)
        true = p * like / (p * like + (1 - p) * unlike)
        before = beta
        for _ in range(3):
            p = logistic()
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(beta)), x.T @ (true - p) - 1e-2 * beta)
            beta = beta + np.clip(step, -3, 3)
        r = min(max(float((true * y).sum() / max(true.sum(), 1e-9)), 2 * chance), 0.999)
        if np.abs(beta - before).max() < 1e-4:
            break
    return beta, r


def _chance(a: DataFrame, b: DataFrame) -> float:
    """Share of all pairs of rows whose amounts agree, from the counts of their
    size classes: equal ones agree, neighbouring ones half the time."""
    hist = lambda df, c: df.where("amount is not null").groupBy(F.floor(F.log("amount") / F.lit(TOLERANCE)).alias("x")).agg(F.count("*").alias(c))
    ha, hb = hist(a, "na"), hist(b, "nb")
    near = hb.select(F.explode(F.array(*[F.struct((F.col("x") + i).alias("x"), (F.col("nb") * w).alias("nb")) for i, w in ((-1, 0.5), (0, 1.0), (1, 0.5))])).alias("y")).select("y.*")
    both = ha.join(near, "x").agg(F.sum(F.col("na") * F.col("nb"))).first()[0]
    n = (ha.agg(F.sum("na")).first()[0] or 0) * (hb.agg(F.sum("nb")).first()[0] or 0)
    return min(max((both or 0.0) / n if n else 0.05, 1e-4), 0.5)


def match(a: DataFrame, b: DataFrame, tolerance: float = TOLERANCE, sample: int = SAMPLE, k: int = K, least: float = LEAST) -> DataFrame:
    """``e1, e2, p``: pairs of records of ``a`` and ``b`` (``uri, entity, amount,
    terms``) that are mutual nearest, with the confidence ``p`` that they mean
    the same.

    Records without a term in common with the other table match nothing; null
    attributes have no terms; copies in either table match alike; empty tables
    give no rows.  Nothing is capped: ties beyond the ``k``-th neighbour stay.
    """
    ws = Workspace(a.sparkSession, "entities")
    recs, members = {}, {}
    for df, tag in ((a, "a"), (b, "b")):
        src = ws.cut(df, f"src_{tag}")
        one = src.groupBy(F.col("terms"), "amount").agg(F.min("uri").alias("id"), F.min("entity").alias("entity"), F.collect_list("uri").alias("uris"))
        one = ws.cut(one, f"rec_{tag}")
        recs[tag], members[tag] = one, one.select(F.col("id").alias("k"), F.explode("uris").alias("uri"))
    ia, ib = (Index(recs[x].select("id", "terms"), ws, x) for x in "ab")
    there, own = top_k(ib, ia, k, ws, "there", least)
    back, _ = top_k(ia, ib, 1, ws, "back", max(least, LEAST_BACK))
    # pairs that only the other direction found are scored from here, too
    only = back.select(F.col("d").alias("q"), F.col("q").alias("d")).join(there, ["q", "d"], "left_anti")
    rows = there.unionByName(scored(only.withColumn("floor", F.lit(0.0)), own, ia).drop("floor")).withColumn("core", F.col("s") - F.col("size"))
    amount = {x: recs[x].select(F.col("id").alias(c), F.col("amount").alias(f"amount_{x}"), *([F.col("entity")] if x == "a" else [])) for x, c in (("a", "d"), ("b", "q"))}
    rows = ws.cut(rows.join(amount["a"], "d").join(amount["b"], "q"), "scores")
    # the score gap to the best other entity found, or to the share below which none was sought
    per = rows.groupBy("q", "entity").agg(F.max("core").alias("top"), (F.first("total") * least).alias("low"))
    w = Window.partitionBy("q").orderBy(F.desc("top"), "entity").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("one", F.first("entity").over(w)).withColumn("best", F.first("top").over(w)).withColumn("second", F.nth_value("top", 2).over(w))
    rival = F.coalesce(F.when(F.col("entity") == F.col("one"), F.col("second")).otherwise(F.col("best")), "low")
    rows = rows.join(per.select("q", "entity", rival.alias("rival")), ["q", "entity"])
    agree = F.abs(F.col("amount_b") / F.col("amount_a") - 1) <= tolerance
    rows = rows.select(
        "q", "d", "entity", ((F.col("core") - F.col("rival")) / F.greatest("total", F.lit(1e-9))).alias("gap"), "name",
        *[(F.col(x) / 10).alias(x) for x in ("miss", "lost", "got")],
        agree.alias("agree"),
    )
    rows = ws.cut(rows, "rows")
    c = _chance(recs["a"], recs["b"])
    known = rows.where("agree is not null").select(F.col("agree").cast("double").alias("y"), *FEATURES)
    got = known.orderBy(F.xxhash64("y", *FEATURES)).limit(sample).toPandas()
    x, y = got[FEATURES].to_numpy(float), got["y"].to_numpy(float)
    beta, r = _fit(x.reshape(len(y), len(FEATURES)), y, c)
    z = F.lit(float(beta[0])) + sum((F.lit(float(v)) * F.col(f) for f, v in zip(FEATURES, beta[1:])), F.lit(0.0))
    odds = F.when(F.col("agree"), r / c).when(~F.col("agree"), (1 - r) / (1 - c)).otherwise(1.0)
    rows = rows.withColumn("sure", z + F.log(odds)).withColumn("p", 1 / (1 + F.exp(-F.col("sure"))))
    rows = rows.withColumn("mine", F.max_by("entity", F.struct("sure", "entity")).over(Window.partitionBy("q")))
    rows = rows.withColumn("points", F.max_by("mine", F.struct("sure", "q")).over(Window.partitionBy("d")))
    near = rows.where("entity = mine and entity = points")
    return (
        near.join(members["a"].toDF("d", "e1"), "d").join(members["b"].toDF("q", "e2"), "q").select("e1", "e2", "p")
    )
