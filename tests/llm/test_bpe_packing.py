import base64
import random
from pathlib import Path

import numpy as np
import pytest

from tessera.llm import bpe, packing

PATH = f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}"
pytestmark = pytest.mark.skipif(not Path(PATH).exists(), reason="no vocabulary")


@pytest.fixture(scope="module")
def known():
    import regex  # noqa: F401
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(PATH).open("rb"))}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_against_library(known):
    enc = bpe.Encoder(PATH)
    rng = random.Random(7)
    signs = " 's're'LL\n\t 12ab  é中文'tx'd\x1c　٣²-<|endoftext|>​😀"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 40))) for _ in range(3000)]
    texts += ["", None, "'", "'s", "x's", " 's", "a  b", "a \n", "<|endoftext|>", "-" * 70_000, "中" * 30_000, " " * 5000 + "x"]
    offsets, ids = enc.encode_batch(texts)
    for k, t in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == known.encode_ordinary(t or ""), repr(t)
    assert enc.count_batch(texts).tolist() == np.diff(offsets).tolist()
    enc.MOST_PIECES = 10  # the table starts anew and stays right
    assert enc.encode(texts[5]) == known.encode_ordinary(texts[5])


def test_collisions_are_told_apart(known):
    enc = bpe.Encoder(PATH)
    enc._weights = np.zeros_like(enc._weights)  # all pieces of a length share a hash
    for t in ("abc xyz abc", "xyz abd", "q w e r"):
        assert enc.encode(t) == known.encode_ordinary(t)


def test_prefix_table_edits():
    v = bpe.Vocabulary.load(PATH)
    rng = random.Random(2)
    for _ in range(100):
        data = "".join(rng.choice("abcdefghinorst é") for _ in range(rng.randrange(1, 500))).encode()
        t = bpe.PrefixTable(v, data[: len(data) // 2])
        t.append(data[len(data) // 2 :])
        a = rng.randrange(len(data) + 1)
        b = min(len(data), a + rng.randrange(4))
        t.replace(a, b, b"the")
        assert t.last == bpe.PrefixTable(v, data[:a] + b"the" + data[b:]).last
        assert all(v.tokens[x] for x in t.tokens()) and b"".join(v.tokens[x] for x in t.tokens()) == t.data
    t = bpe.PrefixTable(v, b"some words " * 200)
    assert t.replace(4, 5, b"X") < 1000


def test_columns(spark, known):
    rows = [(1, "a red fox"), (2, None), (3, ""), (None, "x"), (1, "a red fox"), (4, "é" * 100_000)]
    df = spark.createDataFrame([(k, t, 5) for k, t in rows], "doc_id bigint, text string, ids int")
    got = sorted(((r.doc_id or 0), r.ids) for r in bpe.encode_column(df, "doc_id", "text").collect())
    assert got == sorted((k or 0, known.encode_ordinary(t or "")) for k, t in rows)
    counts = {r.doc_id: r.n_tokens for r in bpe.count_column(df, "doc_id", "text").collect()}
    assert counts[2] == counts[3] == 0 and counts[1] == 3
    assert bpe.encode_column(df.limit(0), "doc_id", "text").count() == 0


def test_bound_never_exceeds_what_is_needed():
    rng = random.Random(5)
    for _ in range(200):
        c = rng.choice([10, 17, 100])
        sizes = [rng.randrange(1, c + 1) for _ in range(rng.randrange(1, 9))]
        best = [len(sizes)]

        def place(i, bins, sizes=sizes, c=c, best=best):
            if len(bins) >= best[0]:
                return
            if i == len(sizes):
                best[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + sizes[i] <= c:
                    bins[k] += sizes[i]
                    place(i + 1, bins)
                    bins[k] -= sizes[i]
            place(i + 1, [*bins, sizes[i]])

        place(0, [])
        bound = packing.lower_bound(np.bincount(sizes), c)
        used = packing.best_fit_decreasing(sizes, c)
        fill = np.bincount(used, weights=sizes)
        assert bound <= best[0] <= len(fill) and fill.max() <= c


def test_containers(spark):
    rng = random.Random(9)
    sizes = [rng.choice([0, 1, 5, 40, 60, 64, 100, 101, 200, 257, rng.randrange(1, 100)]) for _ in range(600)]
    rows = [(k, n) for k, n in enumerate(sizes)] + [(None, 7), (3, 7), (3, 7), (5, None)]
    df = spark.createDataFrame([(k, n, "c") for k, n in rows], "doc_id bigint, n bigint, container string")
    for part in (50, 10_000):
        got = packing.containers(df, "doc_id", "n", 100, part).collect()
        fill, tokens, places = {}, {}, {}
        for r in got:
            fill[r.container] = fill.get(r.container, 0) + r.n_tokens
            tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.n_tokens
            places.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
        want = {}
        for k, n in rows:
            if n:
                want[k] = want.get(k, 0) + n
        assert tokens == want and max(fill.values()) <= 100 and min(r.n_tokens for r in got) > 0
        for k, n in rows:
            if k is not None and n and k != 3:
                spots = sorted(places[k])
                assert [a for a, _ in spots] == [sum(b for _, b in spots[:i]) for i in range(len(spots))]
                assert len(spots) == -(-n // 100)
        least = packing.lower_bound(np.bincount([r.n_tokens for r in got]), 100)
        assert least <= len(fill) <= 1.02 * least + 2
    assert packing.containers(df.limit(0), "doc_id", "n", 100).count() == 0
    r = packing.report(packing.containers(df, "doc_id", "n", 100), 100).first()
    assert r.containers >= r.least and r.tokens == sum(want.values())
