import random

import numpy as np

from tessera.llm import spans


def brute(rows, n):
    text = {}
    for k, t in rows:
        if k is not None and t is not None:
            text.setdefault(k, []).append(t)
    seen = {}
    for k, ts in text.items():
        for t in ts:
            for i in range(len(t) - n + 1):
                seen.setdefault(t[i : i + n], set()).add(k)
    out = {}
    for k, ts in text.items():
        hit = set()
        for t in ts:
            for i in range(len(t) - n + 1):
                if len(seen[t[i : i + n]]) > 1:
                    hit.update(range(i, i + n))
        if hit:
            out[k] = len(hit)
    return out


def made(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abé中 ") for _ in range(n))
    shared = [word(rng.randrange(15, 90)) for _ in range(6)]
    rows = []
    for k in range(60):
        t = ""
        for _ in range(rng.randrange(0, 4)):
            s = rng.choice(shared)
            a = rng.randrange(len(s) // 2)
            t += word(rng.randrange(0, 30)) + (s[a : a + rng.randrange(5, len(s))] if rng.random() < 0.7 else s)
        rows.append((k, t))
    return rows


def test_against_all_windows(spark):
    for seed, signs in ((1, 10**6), (2, 400), (3, 60), (5, 0)):
        rows = made(seed) + [(1000, None), (1001, ""), (1002, "-" * 900), (1003, "x" + "-" * 500), (1004, " " * 19), (None, "-" * 900)]
        rows += [(5, rows[5][1]), (2000, "ab" * 3000), (2001, "ba" * 40)]
        df = spark.createDataFrame([(k, t, "d") for k, t in rows], "doc_id bigint, text string, doc string")
        got = {r.doc_id: r.shared_chars for r in spans.shared_chars(df, "doc_id", "text", length=20, prefix=8, most_signs=signs).collect()}
        assert got == brute(rows, 20)


def test_spans_are_maximal(spark):
    core = "".join(random.Random(1).choice("abcdefg") for _ in range(60))
    df = spark.createDataFrame([("a", "1" + core + "2" + core[:30]), ("b", core + "3"), ("c", "no")], "doc_id string, text string")
    got = sorted(tuple(r) for r in spans.spans(df, "doc_id", "text", length=20, prefix=8).collect())
    assert got == [("a", 1, 61), ("a", 62, 92), ("b", 0, 60)]
    assert spans.shared_chars(df.limit(0), "doc_id", "text").count() == 0


def test_prefix_as_long_as_the_span(spark):
    rows = made(4)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.shared_chars for r in spans.shared_chars(df, "doc_id", "text", length=20, prefix=20).collect()}
    assert got == brute(rows, 20)


def test_nodes_are_told_by_signs():
    texts = ["abcabcabd", "xabcab", "bcabca"]
    who, at, node = spans._nodes(texts, np.array([0, 0, 0]), 5)
    cut = [texts[i][a : a + 5] for i, a in zip(who, at)]
    assert all((cut[i] == cut[j]) == (node[i] == node[j]) for i in range(len(cut)) for j in range(len(cut)))


def test_nodes_sort_few_times(monkeypatch):
    rng, rank, sorted_ = random.Random(9), spans._rank, []
    monkeypatch.setattr(spans, "_rank", lambda x: (sorted_.append(len(x)), rank(x))[1])
    latin, wide = [chr(k) for k in range(32, 127)], [chr(k) for k in range(0x4E00, 0x4E00 + 3000)] + ["\U0001f600", "\U0010ffff", "\0"]
    for signs, length in ((latin, 200), (wide, 200), (["a"], 200), (["a", "b"], 63), (["a", "b"], 64), (wide, 1), (latin, 9), (latin, 10)):
        core = [rng.choice(signs) for _ in range(260)]
        texts = ["".join(core[a:b]) for a, b in ((0, 260), (3, 260), (0, 230), (20, 240))] + ["".join(rng.choice(signs) for _ in range(265))]
        texts += [texts[0][:205] + rng.choice(signs) + texts[0][206:]]
        group = np.array([0, 1, 0, 0, 1, 0])
        sorted_.clear()
        who, at, node = spans._nodes(texts, group, length)
        assert len(who) == sum(len(t) - length + 1 for t in texts)
        cut = [(group[i], texts[i][a : a + length]) for i, a in zip(who, at)]
        assert len(set(zip(cut, node.tolist()))) == len(set(cut)) == len(set(node.tolist()))
        if signs is latin and length == 200:
            # five times all places, then those of the suffixes; three signs at first would be eight times
            assert sum(sorted_) <= 5.8 * sum(map(len, texts))
