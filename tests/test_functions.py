import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import aggregate as A
from tessera.functions import corpus
from tessera.functions import distance as D
from tessera.functions import text as X
from tessera.functions.curie import expand, shorten

PAIRS = [("Jack daniels", "Jack Daniel's"), ("Jack daniels", "Jack Daniel's Single Barrel"), ("Beurre manie", "Beurre monté"), ("Beurre manie", "Beurre manié")]
GOLDEN = {
    "jaro": [0.07905982905982911, 0.22530864197530864, 0.16666666666666663, 0.05555555555555569],
    "jaro-winkler": [0.04743589743589747, 0.13518518518518519, 0.09999999999999998, 0.03333333333333341],
    "levenshtein": [0.15384615384615385, 16 / 27, 0.25, 0.08333333333333333],
    "qgrams-2": [7 / 17, 0.7097, 0.5556, 0.2666666666666667],
    "substring": [0.09999999999999998, 0.3196428571428571, 0.3759727452035144, 0.0668911335578003],
    "relaxed-equality": [1.0, 1.0, 1.0, 0.0],
}


def column(spark, rows, schema, **cols):
    return spark.createDataFrame(rows, schema).select(*[c.alias(k) for k, c in cols.items()]).collect()


@pytest.mark.parametrize("name", GOLDEN)
def test_golden_distances(spark, name):
    got = column(spark, PAIRS, "a string, b string", d=D.DISTANCES[name](F.col("a"), F.col("b")))
    for r, want in zip(got, GOLDEN[name]):
        assert r.d == pytest.approx(want, abs=5e-5)


def test_edges_of_measures(spark):
    rows = [("", ""), ("", "a"), ("a", None), ("abc", "abc"), ("é", "é"), ("x" * 3000, "x" * 2999 + "y")]
    measures = {k.replace("-", "_"): f(F.col("a"), F.col("b")) for k, f in {**D.DISTANCES, **D.SCORES}.items()}
    got = column(spark, rows, "a string, b string", **measures, me=D.monge_elkan(F.col("a"), F.col("b")))
    for k in D.DISTANCES:
        k = k.replace("-", "_")
        assert got[0][k] == 0 and got[2][k] is None and got[3][k] == 0, k
        assert got[1][k] > 0
    assert got[3].smith_waterman == 6 and got[3].affine_gap == 6 and got[3].needleman_wunsch == 0 and got[3].me == 0
    assert got[5].levenshtein == pytest.approx(1 / 3000)


def naive_local(a, b, same, other, start, extend):
    best = 0.0
    h = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            v = max(0, h[i - 1][j - 1] + (same if a[i - 1] == b[j - 1] else other))
            for k in range(1, i + 1):
                v = max(v, h[i - k][j] - start - (k - 1) * extend)
            for k in range(1, j + 1):
                v = max(v, h[i][j - k] - start - (k - 1) * extend)
            h[i][j] = v
            best = max(best, v)
    return best


def test_alignment_scores_against_plain_programme():
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(0, 9)))
    a, b = [word() for _ in range(60)], [word() for _ in range(60)]
    for cost in ((2, -1, 1, 1), (2, -1, 2, 1), (5, -3, 5, 1)):
        got = D.align_values(a, b, *cost, True)
        assert list(got) == [naive_local(x, y, *cost) for x, y in zip(a, b)]


def test_symmetry_and_range(spark):
    words = ["oat", "oats", "rolled oat", "Grain", "", "ﬁg", "taot"]
    rows = [(a, b) for a in words for b in words]
    for f in (D.jaro_standard, D.levenshtein, D.qgrams, D.substring):
        both = column(spark, rows, "a string, b string", x=f(F.col("a"), F.col("b")), y=f(F.col("b"), F.col("a")))
        assert all(r.x == pytest.approx(r.y) and 0 <= r.x <= 2 for r in both)


def test_transforms(spark):
    r = column(
        spark, [(["Grand Duchy of Lux", "Lux"], "Foo_bar (x)", "A b's, 12 -- of/the")], "v array<string>, n string, t string",
        sw=X.TRANSFORMS["lc-sw1"](F.col("v")), ml=X.TRANSFORMS["lc-ml"](F.col("v")), n=X.normalize_name(F.col("n")), t=X.tokens(F.col("t")),
        empty=X.normalize_name(F.lit("(-)")), none=X.tokens_or_null(F.lit("a 1")), nothing=X.shortest(F.array().cast("array<string>")),
    )[0]
    assert r.sw == ["lux", "lux"] and r.ml == ["lux"] and r.n == "foobarx" and r.t == ["of", "the"]
    assert r.empty is None and r.none is None and r.nothing == []


def test_phonetic_codes(spark):
    got = column(spark, [("Robert",), ("Knight",), (None,), ("",)], "w string", n=X.nysiis(F.col("w")), m=X.metaphone(F.col("w")))
    assert got[0].m == "RBRT" and got[1].m == "NT" and (got[2].n, got[2].m) == (None, None) and (got[3].n, got[3].m) == ("", "")
    assert X.nysiis_code("Knight") == X.nysiis_code("Night") and X.metaphone_code("Thompson")[0] == "0"


def test_curies(spark):
    p = [("dbpedia", "http://d/"), ("category", "http://d/Category:")]
    r = column(spark, [("http://d/Category:Oat",), ("http://d/Oat",), ("x",), (None,)], "u string", s=shorten(F.col("u"), p))
    assert [x.s for x in r] == ["category:Oat", "dbpedia:Oat", "x", None]
    r = column(spark, [("category:Oat",), ("dbpedia:a:b",), ("y:z",)], "u string", s=expand(F.col("u"), p))
    assert [x.s for x in r] == ["http://d/Category:Oat", "http://d/a:b", "y:z"]


def test_aggregators(spark):
    r = column(
        spark, [([0.2, None, 0.8],), ([0.0, 0.5, 0.5],), ([None, None, None],)], "d array<double>",
        **{k: A.aggregate(k, F.col("d"), [1, 1, 3]) for k in A.AGGREGATORS}, t=A.is_trivial(F.col("d"), [1, 0, 0]),
    )
    assert r[0]["min"] == 0.2 and r[0]["max"] == 0.8 and r[0]["average"] == pytest.approx(0.65)
    assert r[0]["geoMean"] == pytest.approx(math.exp((math.log(0.2) + 3 * math.log(0.8)) / 4)) and r[1]["geoMean"] == 0
    assert r[0]["quadMean"] == pytest.approx(math.sqrt((0.04 + 3 * 0.64) / 4)) and all(r[2][k] is None for k in A.AGGREGATORS)
    assert [x.t for x in r] == [False, True, True]
    assert A.weights_label(["sub", "lev", "wup"], [1, 3, 0]) == "sub+3*lev"


@pytest.mark.parametrize("d,t,required,want", [(0, 0, False, 1), (0.1, 0, False, -1), (0.1, 0, True, None), (0.1, 0.2, False, 0.5), (0.4, 0.2, False, -1), (0.5, 0.2, True, None), (0.5, 0.2, False, -1)])
def test_confidence(spark, d, t, required, want):
    got = column(spark, [(float(d),)], "d double", c=A.confidence(F.col("d"), t, required))[0].c
    assert got == (pytest.approx(want) if want is not None else None)


def test_tfidf_by_hand(spark):
    docs = spark.createDataFrame([("a", "red oat"), ("b", "red rice"), ("c", "red oat flour"), ("d", None), ("e", "")], "id string, label string")
    idf = {r.token: r.idf for r in corpus.idf(docs).collect()}
    assert idf["red"] == pytest.approx(math.log(5 / 3)) and idf["oat"] == pytest.approx(math.log(5 / 2))
    sim = {(r.id1, r.id2): r.sim for r in corpus.tfidf(docs, docs, corpus.idf(docs)).collect()}
    assert sim["a", "a"] == pytest.approx(1) and sim["a", "c"] > sim["a", "b"] and ("d", "a") not in sim
    soft = corpus.soft_tfidf(docs, spark.createDataFrame([("x", "red oats")], "id string, label string"), corpus.idf(docs.union(spark.createDataFrame([("f", "oats")], docs.schema))), lambda a, b: 1 - D.jaro_winkler_standard(a, b), 0.9)
    assert {r.id1 for r in soft.collect()} == {"a", "b", "c"}
