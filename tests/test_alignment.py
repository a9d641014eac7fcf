import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.functions import corpus
from tessera.functions import distance as D
from tessera.operators import alignment as AL
from tessera.operators import learning, pairs, patterns, rules, service
from pyspark.sql import functions as F


def table(spark, rows):
    return spark.createDataFrame(rows, "e1 string, e2 string, p double")


def test_sets_and_statistics(spark):
    x = table(spark, [("a", "b", 0.1), ("b", "a", 0.2), ("c", "d", 0.3), ("e", "f", 0.9)])
    ref = table(spark, [("b", "a", 1.0), ("d", "c", 1.0), ("g", "h", 1.0)])
    r = AL.statistics(x, ref).first()
    assert (r.tp, r.fp, r.fn) == (2, 1, 1) and r.precision == pytest.approx(2 / 3) and r.f2 == pytest.approx(3 * r.precision * r.recall / (2 * r.precision + r.recall))
    assert AL.intersect(x, ref).count() == 3 and AL.subtract(x, ref).count() == 1 and AL.union(x, ref).count() == 7
    empty = x.limit(0)
    assert tuple(AL.statistics(empty, empty).first())[:5] == (0, 0, 0, 0.0, 0.0) and AL.statistics(empty, ref).first().fn == 3
    assert [r.e2 for r in AL.best(x).where("e1 = 'a'").collect()] == ["b"]
    assert AL.covers(x, ref).where("covered").count() == 2
    trivial, hard = AL.split_reference(ref, table(spark, [("a", "b", 0.0), ("c", "d", 0.7)]))
    assert trivial.count() == 1 and {r.e1 for r in hard.collect()} == {"g"}


def test_sweep_against_single_runs(spark):
    rng = random.Random(4)
    x = table(spark, [(f"a{rng.randrange(30)}", f"b{rng.randrange(30)}", rng.random()) for _ in range(200)] + [("a1", "b1", None)])
    ref = table(spark, [(f"b{rng.randrange(30)}", f"a{rng.randrange(30)}", 1.0) for _ in range(60)])
    ts = [0.0, 0.25, 0.5, 1.0]
    got = {r.t: (r.tp, r.fp, r.fn) for r in AL.sweep(x, ref, ts).collect()}
    for t in ts:
        r = AL.statistics(x.where(F.col("p") <= t), ref).first()
        assert got[t] == (r.tp, r.fp, r.fn)
    recalls = [r.recall for r in AL.progressive(x, ref, 0.01).orderBy("t").collect()]
    assert recalls == sorted(set(recalls))


def naive(xs, ys, t, measure):
    return {(a, b): measure(a, b) for a in xs for b in ys if measure(a, b) <= t + 1e-12}


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a):
        new = [i + 1]
        for j, d in enumerate(b):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1] / max(len(a), len(b)) if a or b else 0.0


def qgram(a, b):
    g = lambda s: {("#" + s + "#")[i : i + 2] for i in range(len(s) + 1)}
    return 1 - len(g(a) & g(b)) / len(g(a) | g(b))


def test_joins_lose_nothing(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 9)))
    xs, ys = sorted({word() for _ in range(60)}), sorted({word() for _ in range(60)})
    a = spark.createDataFrame([(x, x) for x in xs] + [("n", None)], "e string, label string")
    b = spark.createDataFrame([(y, y) for y in ys], "e string, label string")
    for t in (0.0, 0.2, 0.34, 0.5):
        got = {(r.e1, r.e2): r.p for r in pairs.levenshtein_join(a, b, t).collect()}
        want = naive(xs, ys, t, lev)
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    for t in (0.0, 0.3, 0.6):
        got = {(r.e1, r.e2): r.p for r in pairs.qgram_join(a, b, t).collect()}
        want = naive(xs, ys, t, qgram)
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_rules_and_links(spark):
    t = spark.createDataFrame(
        [("u", "name", "Oat"), ("u", "name", "Oats"), ("u", "code", "X"), ("v", "name", "oat"), ("v", "code", "x"), ("w", "name", "rice"), ("w", "rdf:type", "F")],
        "s string, p string, o string",
    )
    e = rules.entities(t, ["name", "code"])
    rule = rules.Aggregation([rules.code_rule(), rules.name_rule("levenshtein", "lc", 0.3)])
    got = {(r.source, r.target): r.confidence for r in rules.generate_links(rule, e, e, block=("code", "code")).collect()}
    assert got["u", "v"] == pytest.approx(1.0) and ("u", "w") not in got
    assert rules.entities(t, ["name"], ("rdf:type", "F")).collect()[0].name == ["rice"]
    spec = rules.load_spec(
        '<Links><Prefixes><Prefix id="gn" namespace="http://g#"/></Prefixes><Interlinks><Interlink id="C"><LinkType>owl:sameAs</LinkType>'
        '<SourceDataset var="a"><RestrictTo>?a rdf:type gn:F .</RestrictTo></SourceDataset><TargetDataset var="b"/>'
        '<LinkageRule><Compare metric="jaroWinkler" threshold="0.04" required="true"><TransformInput function="lowerCase"><Input path="?a/gn:name"/></TransformInput>'
        '<TransformInput function="lowerCase"><Input path="?b/gn:name"/></TransformInput></Compare></LinkageRule></Interlink></Interlinks></Links>'
    )
    assert spec["rule"]["measure"] == "jaro-winkler" and spec["rule"]["required"] and spec["rule"]["left"] == "gn:name"
    named = [(x, p, o) for x, n in (("u", "Beurre Manie"), ("v", "beurre manié"), ("w", "Rice")) for p, o in (("rdf:type", "gn:F"), ("gn:name", n))]
    t = spark.createDataFrame(named, "s string, p string, o string")
    links = {(r.source, r.target): r.confidence for r in rules.run_spec(spec, t, t).collect()}
    assert set(links) == {(x, x) for x in "uvw"} | {("u", "v"), ("v", "u")} and links["u", "u"] == 1.0


def test_grid_search_and_tree(spark):
    rng = random.Random(3)
    rows = []
    for k in range(120):
        same = k % 3 == 0
        rows.append((f"a{k}", f"b{k}", [0.1 * rng.random() if same else 0.5 + rng.random() / 2, rng.random()]))
    v = spark.createDataFrame(rows, "e1 string, e2 string, dist array<double>")
    ref = v.where("dist[0] < 0.2")
    best = AL.grid_search(v, ref, ["good", "noise"], ["min", "average"], [0.1, 0.3]).first()
    assert best.weighting == "good" and best.f05 == 1.0
    data = learning.training_data(v, ref, {0: 0.6, 1: 0.2})
    model = learning.decision_tree(data, [0, 1])
    assert model.transform(learning.with_features(data, [0, 1])).where("label <> prediction").count() == 0


def test_vectors_and_scan(spark):
    a = spark.createDataFrame([("x", "oat"), ("x", "oats")], "e string, label string")
    b = spark.createDataFrame([("y", "oats"), ("z", "rice")], "e string, label string")
    p = spark.createDataFrame([("x", "y"), ("x", "z")], "e1 string, e2 string")
    got = pairs.vectors(p, a, b, prefilter=0.4).collect()
    assert len(got) == 1 and got[0].slv == 0 and got[0].nw == 0 and len(got[0]) == 2 + len(D.VECTOR)
    assert pairs.one_against_all("oat", b, {"lev": D.levenshtein}).where("e2 = 'y'").first().lev == 0.25


def test_patterns(spark):
    t = spark.createDataFrame(
        [("b1", "dcterms:subject", "c1"), ("b2", "dcterms:subject", "c2"), ("c2", "skos:broader", "c1"), ("c1", "skos:broader", "c2"), ("b1", "rdfs:label", "one"), ("b2", "foaf:name", "two")],
        "s string, p string, o string",
    )
    assert {tuple(r) for r in patterns.labels_below(t, ["c1"]).collect()} == {("b1", "rdfs:label", "one"), ("b2", "rdfs:label", "two")}
    rows = patterns.join(patterns.match(t, ("?b", "dcterms:subject", "?x")), patterns.match(t, ("?b", "rdfs:label", "?l")), optional=True)
    assert {(r.b, r.l) for r in rows.collect()} == {("b1", "one"), ("b2", None)}
    assert [r.b for r in patterns.select(rows, ["?b"], distinct=True, order=["?b"], limit=1, offset=1).collect()] == ["b2"]
    assert patterns.usage(t, "c1", 5, incoming=True).count() == 2


def test_service(spark):
    s = "array<struct<d:double,m:int>>"
    e = spark.createDataFrame([(1, 5, [(0.0, 2)]), (1, 6, [(0.3, 1), (0.1, 3)]), (1, 7, None), (2, 5, [(None, 1)])], f"from_idx int, to_idx int, sim {s}")
    assert [(r.to_idx, r.kind) for r in service.matches(e, 1, 0.2).collect()] == [(5, "exact"), (6, "approximate")]
    links = service.Links(spark)
    links.accept(1, 9)
    links.accept(1, 9)
    assert [(r.to_idx, r.kind) for r in service.matches(e, 1, 0.2, links.table, skip_exact=True).collect()] == [(6, "approximate"), (9, "accepted")]
    links.reject(1, 9)
    assert links.table.count() == 0
    ids = spark.createDataFrame([(1,), (2,), (3,)], "i int")
    assert {r.kind: r.n for r in service.dashboard(ids, e, 0.2).collect()} == {"exact": 1, "none": 2}


def test_distance_vectors_of_all_pairs(spark, tmp_path):
    from tessera.plans import queries

    cul = ["Beurre manie", "early kofobazava barley", "Roasted oats", None]
    wik = ["Beurre monté", "barley, kofobazava, early", "tosated oats", "xyz", "12", None]
    spark.createDataFrame([(f"c{k}", x) for k, x in enumerate(cul)], "uri string, food_name string").write.parquet(f"{tmp_path}/cul_foods.parquet")
    spark.createDataFrame([(f"w{k}", x) for k, x in enumerate(wik)], "uri string, label string").write.parquet(f"{tmp_path}/wik_foods.parquet")
    got = {(r.e1, r.e2): r for r in queries.distance_vectors(spark, str(tmp_path)).collect()}
    names = [(f"c{i}", f"w{j}", x.lower(), y.lower()) for i, x in enumerate(cul) for j, y in enumerate(wik) if x and y]
    m = D.vector(F.col("x"), F.col("y"))
    rows = spark.createDataFrame(names, "e1 string, e2 string, x string, y string").select("e1", "e2", *[c.alias(k) for k, c in m.items()]).collect()
    assert set(got) == {(r.e1, r.e2) for r in rows if min(r[k] for k in D.VECTOR[5:]) <= 0.4}
    assert abs(got["c0", "w0"].slv - 0.25) < 1e-9 and got["c0", "w0"].qgr > 0.3 and ("c1", "w1") in got and ("c0", "w4") not in got


def test_jaro_candidates_and_soft_tfidf_lose_nothing(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(150)] + ["roasted", "toasted", "kofobazava", "mofobazava", ""]
    xs, ys = (spark.createDataFrame([(w,) for w in words], c) for c in ("x string", "y string"))
    for t in (0.1, 0.3):
        got = {(r.x, r.y) for r in pairs.jaro_candidates(xs, ys, t).collect()}
        both = [(p, q) for p in set(words) for q in set(words)]
        d = D.jaro_values([p for p, _ in both], [q for _, q in both], False)
        assert {k for k, v in zip(both, d) if v <= t} <= got
    docs = spark.createDataFrame([("c0", "roasted oats"), ("c1", "toasted bread")], "id string, label string")
    near = corpus.soft_tfidf(docs, docs, corpus.idf(docs), lambda a, b: 1 - D.jaro_winkler_standard(a, b), 0.9, others=lambda x, y: pairs.jaro_candidates(x, y, 0.1))
    assert ("c0", "c1") in {(r.id1, r.id2) for r in near.collect()}


def test_soft_tfidf_query_compares_other_first_letters(spark, tmp_path):
    from tessera.plans import queries

    spark.createDataFrame([("c0", "roasted"), ("c1", "toasted"), ("c2", "plain bread")], "uri string, food_name string").write.parquet(f"{tmp_path}/cul_foods.parquet")
    spark.createDataFrame([("w0", "toasted")], "uri string, label string").write.parquet(f"{tmp_path}/wik_foods.parquet")
    assert {(r.id1, r.id2) for r in queries.soft_tfidf_pairs(spark, str(tmp_path)).collect()} == {("c0", "w0"), ("c1", "w0")}


def foods(spark, path, n=150):
    """Food tables of which many names share kind and preparation; their pairs of names."""
    rng = random.Random(11)
    coined = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(5))
    cul = [f"{rng.choice(['golden', 'Roasted'])} {coined()} {rng.choice(['squash', 'tea'])}" for _ in range(n)]
    wik = [x.replace("a", "e", k % 4) if k % 2 else f"golden {coined()} squash" for k, x in enumerate(cul)]
    spark.createDataFrame([(f"c{k}", x) for k, x in enumerate(cul)] + [("c0", None)], "uri string, food_name string").write.parquet(f"{path}/cul_foods.parquet")
    spark.createDataFrame([(f"w{k}", x) for k, x in enumerate(wik)], "uri string, label string").write.parquet(f"{path}/wik_foods.parquet")
    return [(f"c{i}", f"w{j}", x.lower(), y.lower()) for i, x in enumerate(cul) for j, y in enumerate(wik)]


def by_sketches(df):
    """Whether the pairs come from sketches, not from a join on single grams or pieces."""
    return "FlatMapGroupsInArrow" in df._jdf.queryExecution().toString()


def test_name_alignment_by_sketches(spark, tmp_path):
    from tessera.plans import queries

    names = foods(spark, tmp_path)
    got = queries.name_alignment(spark, str(tmp_path))
    assert by_sketches(got) and {(r.e1, r.e2) for r in got.collect()} == {(a, b) for a, b, x, y in names if qgram(x, y) <= 0.3 + 1e-12}
    xs, ys = (spark.createDataFrame([(v,) for v in {r[k] for r in names}], c) for k, c in ((2, "x string"), (3, "y string")))
    most = lambda m, n: [(m + n) * 0.3 / 1.7]
    near = pairs.sketch_pairs(xs, ys, [lambda c: D.grams(c, 2)], most).count()
    # a common rare gram would pair the half that shares a kind
    assert near < 0.1 * xs.count() * ys.count()


def test_levenshtein_alignment_by_sketches(spark, tmp_path):
    from tessera.plans import queries

    names = foods(spark, tmp_path)
    got = queries.levenshtein_alignment(spark, str(tmp_path))
    assert by_sketches(got) and {(r.e1, r.e2) for r in got.collect()} == {(a, b) for a, b, x, y in names if abs(len(x) - len(y)) <= 5 and lev(x, y) <= 0.2 + 1e-12}


def test_buckets_by_sketches(spark, tmp_path):
    from tessera.plans import queries

    names = foods(spark, tmp_path)
    got = queries.threshold_buckets(spark, str(tmp_path))
    assert by_sketches(got) and {(r.e1, r.e2) for r in got.where("bucket <> 'loose'").collect()} == {(a, b) for a, b, x, y in names if qgram(x, y) <= 0.2 + 1e-12}


def test_rule_links_by_sketches(spark, tmp_path):
    from tessera.plans import queries

    names = foods(spark, tmp_path)
    got = queries.rule_links(spark, str(tmp_path))
    assert by_sketches(got) and {(r.source, r.target) for r in got.collect()} == {(a, b) for a, b, x, y in names if qgram(x, y) <= 0.25 + 1e-12}


def test_stream_matches_by_sketches(spark, tmp_path, monkeypatch):
    from tessera.plans import queries

    names, seen, join = foods(spark, tmp_path), [], pairs.qgram_join
    monkeypatch.setattr(pairs, "qgram_join", lambda *a: (seen.append(df := join(*a)), df)[1])
    got = queries.stream_matches(spark, str(tmp_path))
    assert {(r.e1, r.e2) for r in got.collect()} == {(a, b) for a, b, x, y in names if qgram(x, y) <= 0.3 + 1e-12} and all(map(by_sketches, seen))


def test_rare_tokens_find_all_pairs(spark):
    rng = random.Random(2)
    rows = [(f"d{k}", " ".join([rng.choice(["golden", "young"]), f"name{rng.randrange(25)}", rng.choice(["tea", "jam"])])) for k in range(90)] + [("e", "golden tea"), ("f", "tea golden")]
    docs = spark.createDataFrame(rows, "id string, label string")
    w = corpus.idf(docs)
    key = lambda df, t: {(r.id1, r.id2, round(r.sim, 6)) for r in df.where(F.col("sim") > t).collect()}
    every = corpus.tfidf(docs, docs, w)
    assert key(corpus.tfidf(docs, docs, w, 0.9), 0.9) == key(every, 0.9) and ("e", "f") in {r[:2] for r in key(every, 0.9)}
    assert corpus._leading(corpus._vectors(docs, w), F.col("v") ** 2, 0.81).where("id like 'd%' and token in ('tea', 'jam')").count() == 0
    inner = lambda a, b: 1 - D.jaro_winkler_standard(a, b)
    soft = corpus.soft_tfidf(docs, docs, w, inner, 0.9, candidates=lambda x, y: pairs.jaro_candidates(x, y, 0.1 / 0.6))
    found = corpus.soft_tfidf(docs, docs, w, inner, 0.9, 0.8, candidates=lambda x, y: pairs.jaro_candidates(x, y, 0.1 / 0.6))
    assert key(found, 0.8) == key(soft, 0.8)


def test_pairs_sharing_a_key_come_once_and_unshuffled(spark):
    a = spark.createDataFrame([("u", ["x", "y"], ["oat"]), ("v", ["z"], ["oats", "rye"])], "uri string, code array<string>, name array<string>")
    rule = rules.Aggregation([rules.Comparison("code", "code", D.equality, 0.0, True), rules.Comparison("name", "name", D.levenshtein, 0.3)])
    out = rules.generate_links(rule, a, a, lambda: F.col("code"), lambda: F.col("code"))
    assert sorted((r.source, r.target, r.confidence) for r in out.collect()) == [("u", "u", 1.0), ("v", "v", 1.0)]
    assert "HashAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_subtree_sizes(spark):
    from tessera.operators import taxonomy as G

    rng = random.Random(6)
    e = {(f"n{i}", f"n{rng.randrange(max(0, i - 30), i)}") for i in range(5, 200) for _ in range(rng.choice([1, 1, 2]))} | {("x", "y"), ("y", "x"), ("z", "y"), ("n7", "z")}
    up = {}
    for s, t in e:
        up.setdefault(s, set()).add(t)
    below = {}
    for v in {x for r in e for x in r}:
        seen, todo = {v}, [v]
        while todo:
            for t in up.get(todo.pop(), ()):
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        for t in seen:
            below.setdefault(t, set()).add(v)
    edges = spark.createDataFrame([(s, t, 1) for s, t in e], "src string, dst string, w bigint")
    roots = spark.createDataFrame([(f"n{k}",) for k in range(5)] + [("n50",)], "id string")
    marked = spark.createDataFrame([(f"n{k}",) for k in range(0, 200, 3)], "id string")
    got = {r.root: (r.marked, r.nodes) for r in G.subtree_sizes(edges, roots, marked).collect()}
    assert got == {r: (sum(int(v[1:]) % 3 == 0 for v in below[r] if v[0] == "n"), len(below[r])) for r in ("n0", "n1", "n2", "n3", "n4", "n50") if r in below}


def test_jaro_winkler_and_duplicates_by_sketches(spark, tmp_path):
    from tessera.plans import queries

    foods(spark, tmp_path, 40)
    assert by_sketches(queries.jaro_winkler_rule(spark, str(tmp_path))) and by_sketches(queries.near_duplicates(spark, str(tmp_path)))


def in_blocks(df):
    """Whether tiles get compressed blocks of sketches, not a row for each text."""
    return "MapInArrow" in df._jdf.queryExecution().toString()


def test_tiles_meet_once_in_blocks(spark, tmp_path, monkeypatch):
    from tessera.plans import queries

    monkeypatch.setattr(pairs, "TILE", 40)
    names = foods(spark, tmp_path)
    got = queries.threshold_buckets(spark, str(tmp_path))
    assert in_blocks(got) and {(r.e1, r.e2) for r in got.collect()} == {(a, b) for a, b, x, y in names if qgram(x, y) <= 0.3 + 1e-12}
    xs, ys = (spark.createDataFrame([(v,) for v in {r[k] for r in names}], c) for k, c in ((2, "x string"), (3, "y string")))
    every = pairs.sketch_pairs(xs, ys, [lambda c: D.grams(c, 2)], lambda m, n: [np.full(len(n), 99)])
    assert every.count() == every.distinct().count() == xs.count() * ys.count()
    for n in (1, 12, 49):
        dealt = spark.createDataFrame([(k,) for k in pairs._apart(spark, n)], "k int").repartition(n, "k")
        assert dealt.select(F.spark_partition_id().alias("p")).distinct().count() == n


def test_required_pairs_are_near_before_joins(spark, tmp_path, monkeypatch):
    from tessera.plans import queries

    rule = rules.Comparison("name", "name", D.jaro_winkler_standard, 0.04, True)
    # v has the signs of u in another order: equal sketches, but far apart
    a = spark.createDataFrame([("u", ["abcdefghijkl"])], "uri string, name array<string>")
    b = spark.createDataFrame([("v", ["lkjihgfedcba"]), ("w", ["abcdefghijlk"])], "uri string, name array<string>")
    assert {tuple(r) for r in rules.required_pairs(rule, a, b).collect()} == {("u", "w")}
    monkeypatch.setattr(pairs, "TILE", 20)
    names = foods(spark, tmp_path, 40)
    d = D.winkler_values([x for *_, x, _ in names], [y for *_, y in names], False)
    got = {(r.source, r.target) for r in queries.jaro_winkler_rule(spark, str(tmp_path)).collect()}
    assert got == {(r[0], r[1]) for r, v in zip(names, d) if v <= 0.04} and got


def test_rule_links_in_blocks(spark, tmp_path, monkeypatch):
    from tessera.plans import queries

    monkeypatch.setattr(pairs, "TILE", 40)
    names = foods(spark, tmp_path)
    got = queries.rule_links(spark, str(tmp_path))
    assert in_blocks(got) and {(r.source, r.target): r.confidence for r in got.collect()} == {(a, b): round(1 - d / 0.25, 6) for a, b, x, y in names if (d := qgram(x, y)) <= 0.25 + 1e-12}


def test_stream_matches_in_blocks(spark, tmp_path, monkeypatch):
    from tessera.plans import queries

    names, seen, join = foods(spark, tmp_path), [], pairs.qgram_join
    monkeypatch.setattr(pairs, "TILE", 40)
    monkeypatch.setattr(pairs, "qgram_join", lambda *a: (seen.append(df := join(*a)), df)[1])
    got = {(r.e1, r.e2): r.p for r in queries.stream_matches(spark, str(tmp_path)).collect()}
    assert all(map(in_blocks, seen)) and got == {(a, b): round(d, 6) for a, b, x, y in names if (d := qgram(x, y)) <= 0.3 + 1e-12}


def test_stream_matches_compares_few_pairs(spark, tmp_path, monkeypatch):
    from tessera.plans import queries

    rng = random.Random(8)
    coined = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(5))
    kinds = [(rng.choice(["early", "roasted", "golden", "summer"]), coined(), rng.choice(["barley", "milk", "soup", "sauce"])) for _ in range(1600)]
    x = [" ".join(k) for k in kinds] + ["", "a", "é中 tea"]
    y = [" ".join(k)[: rng.randrange(18, 30)] if rng.random() < 0.5 else f"{k[2]}, {k[1]}, {k[0]}" for k in kinds] + ["", "b", "é中 teas"]
    grams = lambda texts: pa.array([[zlib.crc32(g.encode()) % 256 - 128 for g in D.gram_set(t, 2)] for t in texts], pa.list_(pa.int8()))
    for t, least in ((0.3, 100), (0.1, 5)):
        most = lambda m, n, t=t: [np.where(np.abs(m - n) <= (k := np.floor((m + n) * t / (2 - t) + 1e-9)), k, -1)]
        a, b = grams(x), grams(y)
        (nx, sx), (ny, sy) = pairs._sketches(a), pairs._sketches(b)
        every = sum(np.bitwise_count(sx[:, None, k] ^ sy[None, :, k]).astype(int) for k in range(4))
        want = {(i, j) for i, n in enumerate(nx) for j in np.flatnonzero(every[i] <= most(int(n), ny)[0]).tolist()}
        seen, count = [], np.bitwise_count
        monkeypatch.setattr(np, "bitwise_count", lambda z, *r, **k: (seen.append(z.size), count(z, *r, **k))[1])
        got = [p for i, j in pairs._near([a], [b], most) for p in zip(i.tolist(), j.tolist())]
        monkeypatch.setattr(np, "bitwise_count", count)
        assert len(got) == len(want) >= least and set(got) == want
        assert sum(seen) < 0.4 * len(x) * len(y)
    # one value of a part at nearly all rows leaves every pair to be compared
    odd = pa.array([[-128 + k for k in range(24)] + [k % 90] for k in range(1100)], pa.list_(pa.int8()))
    both = [len(i) for i, _ in pairs._near([odd], [odd], lambda m, n: [np.full(len(n), 8)])]
    assert sum(both) == 1100 * 1100
    # distances are taken in the tiles, also of texts with odd signs
    spark.createDataFrame([(f"c{k}", v) for k, v in enumerate(x)], "uri string, food_name string").write.parquet(f"{tmp_path}/cul_foods.parquet")
    spark.createDataFrame([(f"w{k}", v) for k, v in enumerate(y)], "uri string, label string").write.parquet(f"{tmp_path}/wik_foods.parquet")
    plans, join = [], pairs.qgram_join
    monkeypatch.setattr(pairs, "qgram_join", lambda *a: (plans.append(df := join(*a)), df)[1])
    got = {(r.e1, r.e2): r.p for r in queries.stream_matches(spark, str(tmp_path)).collect()}
    sets = [[D.gram_set(v.lower(), 2) for v in z] for z in (x, y)]
    want = {(f"c{i}", f"w{j}"): round(d, 6) for i, g in enumerate(sets[0]) for j, h in enumerate(sets[1]) if (d := 1 - (n := len(g & h)) / (len(g) + len(h) - n)) <= 0.3}
    assert got == want and len(got) > 100
    assert all("array_intersect" not in df._jdf.queryExecution().toString() for df in plans)


def test_rule_links_by_the_distances_of_the_join(spark, tmp_path):
    from tessera.plans import queries

    cul = [("c1", "roasted oats"), ("c1", "mild barley soup"), ("c1", "mild barley soup"), ("c2", "Mild Barley soups"), ("c3", None)]
    wik = [("w1", "mild barley soup"), ("w1", "roasted oat"), ("w2", "roasted oats"), ("w2", None), ("w3", "xyz")]
    spark.createDataFrame(cul, "uri string, food_name string").write.parquet(f"{tmp_path}/cul_foods.parquet")
    spark.createDataFrame(wik, "uri string, label string").write.parquet(f"{tmp_path}/wik_foods.parquet")
    links = queries.rule_links(spark, str(tmp_path))
    best = {}
    for s, x in cul:
        for t, y in wik:
            if x and y and (d := qgram(x.lower(), y.lower())) <= 0.25 + 1e-12:
                best[s, t] = max(best.get((s, t), -1), round(1 - d / 0.25, 6))
    assert sorted(best) == [("c1", "w1"), ("c1", "w2"), ("c2", "w1")]
    assert {(r.source, r.target): r.confidence for r in links.collect()} == best and links.count() == 3
    # no distance is taken a second time, from sets of names
    plan = links._jdf.queryExecution().toString()
    assert "array_intersect" not in plan and "collect_set" not in plan
    # a rule with a comparison that isn't made yet still looks values up
    one, other = rules.Comparison("name", "name", D.equality, 0.0, True, distance="d"), rules.Comparison("code", "code", D.equality, 0.0)
    a = spark.createDataFrame([("u", ["x"], ["1"])], "uri string, name array<string>, code array<string>")
    near = spark.createDataFrame([("u", "u", 0.0), ("u", "u", 0.0)], "source string, target string, d double")
    assert [r.confidence for r in rules.generate_links(rules.Aggregation([other]), a, a, candidates=near).collect()] == [1.0]
    assert [tuple(r) for r in rules.generate_links(rules.Aggregation([one]), a, a, candidates=near).collect()] == [("u", "u", 1.0)]
