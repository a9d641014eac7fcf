import random

from tessera.operators import flooding, identity, service
from tessera.operators import taxonomy as G

G1 = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 7), (7, 8), (5, 6), (6, 4), (6, 1), (6, 8), (2, 8)]
G2 = [(1, 3), (1, 4), (2, 5), (2, 12), (3, 6), (4, 7), (5, 8), (6, 9), (7, 11), (8, 11), (9, 12), (10, 12), (11, 10)]
G4 = [(1, 3), (2, 4), (3, 4), (4, 5), (4, 6), (6, 7), (6, 8), (8, 9)]
G5 = G4 + [(1, 20)] + [(k, k + 1) for k in range(20, 30)] + [(30, 42), (42, 7), (42, 8), (42, 9)]


def edges(spark, rows):
    return spark.createDataFrame([(a, b, 1) for a, b in rows], "src int, dst int, w bigint")


def ids(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "id int")


def candidates(spark, g, s, t):
    p = spark.createDataFrame([(s, t)], "s int, t int")
    return sorted((r.w, r.v) for r in G.lcs_candidates(edges(spark, g), p).collect())


def test_common_subsumers(spark):
    one = candidates(spark, G1, 1, 5)
    assert one[0] == (2, 1) and [x for x in one if x[0] == 4] == [(4, 4), (4, 8)]
    assert [v for w, v in candidates(spark, G1, 5, 1) if w == 4] == [2, 3]
    assert candidates(spark, G2, 1, 2)[:2] == [(5, 12), (6, 11)]
    assert candidates(spark, G4, 1, 2)[0] == (3, 4) == candidates(spark, G5, 1, 2)[0]
    assert candidates(spark, G4, 1, 4)[:2] == [(4, 5), (4, 6)]
    assert candidates(spark, G4, 4, 1)[0] == (2, 4)


def test_distances_against_relaxation(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(14), rng.randrange(14), rng.randrange(0, 4)) for _ in range(30)]
    e = spark.createDataFrame(rows, "src int, dst int, w bigint")
    inf = float("inf")
    d = {(i, j): 0 if i == j else inf for i in range(14) for j in range(14)}
    for a, b, w in rows:
        d[a, b] = min(d[a, b], w)
    for k in range(14):
        for i in range(14):
            for j in range(14):
                d[i, j] = min(d[i, j], d[i, k] + d[k, j])
    known = {a for a, _, _ in rows} | {b for _, b, _ in rows}
    want = {(i, j): v for (i, j), v in d.items() if v < inf and i in known and j in known}
    assert {(r.i, r.j): r.d for r in G.all_distances(e).collect()} == want
    got = {(r.s, r.node): r.d for r in G.shortest_distances(e, ids(spark, known)).collect()}
    assert got == want
    pairs = spark.createDataFrame([(i, j) for i in known for j in known], "s int, t int")
    for r in G.shortest_paths(e, pairs).collect():
        assert sum(p.w for p in r.path) == want[r.s, r.t] == r.d
        stops = [p.node for p in r.path] + [r.t]
        assert all(any(a == x and b == y for a, b, _ in rows) for x, y in zip(stops, stops[1:])) and stops[0] == r.s


def test_closures_and_parts(spark):
    e = edges(spark, [*G4, (9, 4)])  # with a cycle
    up = {(r.s, r.node) for r in G.subsumers(e, ids(spark, [1, 8])).collect()}
    assert up == {(1, x) for x in (1, 3, 4, 5, 6, 7, 8, 9)} | {(8, x) for x in (8, 9, 4, 5, 6, 7)}
    assert {r.id for r in G.leafs(e).collect()} == {1, 2}
    assert {(r.root, r.node) for r in G.subsumed_leafs(e, ids(spark, [3, 5])).collect()} == {(3, 1), (5, 1), (5, 2)}
    assert {(r.src, r.dst) for r in G.environment(e, ids(spark, [4]), 2).collect()} == {(4, 5), (4, 6), (6, 7), (6, 8)}
    assert G.environment(e, ids(spark, [4]), 0).count() == 0
    assert {tuple(r.path) for r in G.all_paths(edges(spark, G2), spark.createDataFrame([(1, 12)], "s int, t int")).collect()} == {(1, 3, 6, 9, 12), (1, 4, 7, 11, 10, 12)}
    numbered, words = G.numeric(e)
    assert sorted(r.code for r in words.collect()) == list(range(9)) and numbered.count() == 9


def test_similarity_and_merge(spark):
    e = spark.createDataFrame([("a", "x", 1), ("b", "x", 1), ("x", "root", 1), ("c", "root", 1)], "src string, dst string, w bigint")
    p = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "zzz")], "s string, t string")
    got = {(r.s, r.t): (r.lcs, r.cotopic, r.wu_palmer_sim) for r in G.similarity(e, p, "root").collect()}
    assert got == {("a", "b"): ("x", 2.0, 0.5), ("a", "c"): ("root", 3.0, 0.0), ("a", "zzz"): (None, None, None)}
    both = G.join_graphs(e, G.merge(spark, "a", "c"))
    assert {r.v for r in G.lcs(both, spark.createDataFrame([("a", "c")], "s string, t string")).collect()} <= {"a", "c"}
    assert service.cotopic(e, "a", "zzz").first().cotopic == G.NO_PATH


def test_cleanup_and_closure_of_statements(spark):
    e = spark.createDataFrame([("category:A", "category:B", 1), ("category:B", "category:C", 1), ("category:1990_x", "category:A", 1)], "src string, dst string, w bigint")
    assert {(r.src, r.dst) for r in G.cleanup(e, 1).collect()} == {("category:A", "category:B")}
    t = spark.createDataFrame(
        [("d", "rdfs:subClassOf", "c"), ("c", "rdfs:subClassOf", "b"), ("x", "rdf:type", "d"), ("q", "rdfs:subPropertyOf", "p"), ("x", "q", "y"), ("p", "rdfs:domain", "z"), ("z", "p", None)],
        "s string, p string, o string",
    )
    got = {tuple(r) for r in G.rdfs_closure(t).collect()}
    assert {("d", "rdfs:subClassOf", "b"), ("x", "rdf:type", "b"), ("x", "p", "y"), ("x", "rdf:type", "z")} <= got


def test_flooding_example(spark):
    a = spark.createDataFrame([("Rolled oat", "Oat"), ("Oat", "Grain"), ("Grain", "Food")], "src string, dst string")
    b = spark.createDataFrame([("Oat", "Oats"), ("Rolled oat", "Oats"), ("Oats", "Grains"), ("Grains", "Foods")], "src string, dst string")
    start = G.nodes(a).withColumnRenamed("id", "x").crossJoin(G.nodes(b).withColumnRenamed("id", "y")).selectExpr("x", "y", "1D as s0")
    pcg = flooding.connectivity(a, b)
    assert pcg.count() == 12
    got = {(r.x, r.y): r.sim for r in flooding.flood(flooding.propagation(pcg), start, 20, 0).collect()}
    want = {("Oat", "Oats"): 1.0, ("Grain", "Grains"): 0.904838, ("Grain", "Oats"): 0.901167, ("Oat", "Grains"): 0.749175, ("Food", "Oats"): 0.650325}
    assert {k: round(got[k], 6) for k in want} == want and len(got) == 20


def test_same_as_and_minting(spark):
    links = spark.createDataFrame([("b", "a"), ("c", "b"), ("y", "x"), ("z", None), ("q", "q")], "e1 string, e2 string")
    assert {(r.id, r.canonical) for r in identity.same_as_groups(links).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x"), ("q", "q")}
    t = spark.createDataFrame([("c", "p", "y", "uri"), ("a", "p", "x", "uri")], "s string, p string, o string, o_kind string")
    assert [tuple(r) for r in identity.rewrite(t, links).collect()] == [("a", "p", "x", "uri")]
    t = spark.createDataFrame([("s", "rdfs:label", "Été x", "fr"), ("s", "rdfs:label", "Summer x", "en")], "s string, p string, o string, lang string")
    assert identity.mint(t, "n:").first().minted == "n:Summer_x"
