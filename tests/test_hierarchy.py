import random

from tessera.operators.hierarchy import hierarchy, paths, resolve, several_parents


def brute(links):
    par, nodes = {}, set()
    for c, p in links:
        if c is None or not c.strip():
            continue
        nodes.add(c)
        if p is not None and p.strip():
            nodes.add(p)
            par[c] = min(par.get(c, p), p)
    out = {}
    for n in nodes:
        walk, x = [n], n
        while x in par and par[x] not in walk:
            x = par[x]
            walk.append(x)
        if x not in par:
            out[n] = (x, len(walk) - 1)
        else:
            cyc = walk[walk.index(par[x]):]
            out[n] = (min(cyc), -1 if n in cyc else -2)
    return par, out


def forest(rng, n, cycles):
    links = [(f"n{i}", f"n{rng.randrange(max(0, i - rng.choice([1, 1, 1, 40])), i)}") for i in range(1, n) if rng.random() > 0.02]
    for k, size in enumerate(cycles):
        ring = [f"c{k}_{rng.randrange(10**6)}_{i}" for i in range(size)]
        links += [(a, b) for a, b in zip(ring, ring[1:] + ring[:1])]
        links += [(f"t{k}_{i}", ring[i % size] if i % 3 else f"t{k}_{i - 1}" if i else ring[0]) for i in range(7)]
        links += [(f"u{k}_{i + 1}", f"u{k}_{i}") for i in range(12)] + [(f"u{k}_0", ring[0])]
    return links


def test_against_walking_up(spark):
    rng = random.Random(3)
    for every in (4, 60):
        links = forest(rng, 300, [1, 1, 2, 3, 4, 5, 9, 40])
        links += links[:20] + [("n1", None), ("lone", None), ("lone2", "  "), (None, "x"), ("", "n3")]
        df = spark.createDataFrame([(c, p, "z") for c, p in links], "child string, parent string, node string")
        got = {r.node: (r.root_node, r.node_depth) for r in hierarchy(df, split_every=every).collect()}
        assert got == brute(links)[1]


def test_paths_and_descendants(spark):
    rng = random.Random(5)
    links = forest(rng, 200, [3])
    par, want = brute(links)
    df = spark.createDataFrame(links, "child string, parent string")
    rows = set()
    for n, (_, d) in want.items():
        x, k = n, 0
        while d >= 0:
            rows.add((n, x, k))
            if x not in par:
                break
            x, k = par[x], k + 1
    got = [(r.node, r.ancestor, r.distance) for r in paths(df, split_every=4).collect()]
    assert len(got) == len(set(got)) and set(got) == rows


def test_empty(spark):
    df = spark.createDataFrame([], "child string, parent string")
    assert hierarchy(df).count() == 0


def test_several_parents_are_listed(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "b"), ("d", "b"), ("e", None), ("e", " "), (None, "b")], "child string, parent string")
    assert [tuple(r) for r in several_parents(df).collect()] == [("a", ["b", "c"])]


def test_splitters_do_not_depend_on_partitions(spark):
    rows = [(f"n{k}", f"n{k // 3}") for k in range(1, 200)]
    seen = []
    for n in (1, 7):
        _, _, words, _ = resolve(spark.createDataFrame(rows, "child string, parent string").repartition(n))
        seen.append({r.id for r in words.where("code % 2 = 1").collect()})
    assert seen[0] == seen[1] and seen[0]
