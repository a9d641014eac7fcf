import random

from tessera.llm import groups, topn


def union_find(pairs):
    f = {}

    def find(x):
        while f[x] != x:
            x = f[x]
        return x

    for a, b in pairs:
        for x in (a, b):
            if x is not None:
                f.setdefault(x, x)
        if a is not None and b is not None:
            x, y = find(a), find(b)
            f[max(x, y)] = min(x, y)
    return {(x, find(x)) for x in f}


def test_groups(spark):
    rng = random.Random(1)
    pairs = [(f"r{rng.randrange(150)}", f"r{rng.randrange(150)}") for _ in range(80)]
    pairs += [(f"c{k:02}", f"c{k + 1:02}") for k in range(40)] + [("hub", f"h{k}") for k in range(60)] + pairs[:9]
    pairs += [("x", "x"), (None, "alone"), ("left", None), (None, None), ("", "e"), ("é", "z")]
    df = spark.createDataFrame([(a, b, None, "c") for a, b in pairs], "e1 string, e2 string, p double, record string")
    got = [tuple(r) for r in groups.groups(df).collect()]
    assert len(got) == len(set(got)) and set(got) == union_find(pairs)
    assert groups.groups(df.limit(0)).count() == 0


NP = 1.7976931348623157e308


def test_top_n(spark):
    rows = [(1, k, [(0.5, 1), (None, 2)]) for k in range(8, 0, -1)] + [(1, 9, [(0.1, 3), (NP, 1)]), (1, 9, [(0.05, 2)]), (1, 9, [(0.05, 2)])]
    rows += [(2, 1, None), (2, 2, []), (2, 3, [(NP, 1)]), (2, 4, [(None, 1)]), (3, 1, [(0.9, 1)]), (None, 1, [(0.1, 1)]), (3, None, [(0.1, 1)])]
    df = spark.createDataFrame(rows, "from_idx int, to_idx int, sim array<struct<d:double,m:int>>")
    scores = topn.pair_scores(df)
    got = topn.top_n(scores, "from_idx", "score", "to_idx", 5)
    assert sorted((r.from_idx, r["rank"], r.to_idx) for r in got.collect()) == [(1, 1, 9), (1, 2, 1), (1, 3, 2), (1, 4, 3), (1, 5, 4), (3, 1, 1)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
    assert topn.top_n(topn.pair_scores(df.limit(0)), "from_idx", "score", "to_idx", 5).count() == 0
