import unicodedata
from collections import defaultdict

from tessera.llm import lookalike

SAME = [
    ["pâté", "pâté", "рâté", "p​âté", "ｐâté", "p­âté﻿"],
    ["sự mềm", "sự mềm", "sự mềm", "sự　mềm"],
    ["ﬂan Ⅳ", "flan IV", "flan ІV"],
    ["half-fat", "half‐fat", "half‑fat", "half－fat"],
    ["ガ", "ｶﾞ", "ガ"],
    ["Å", "Å", "Å", "Ａ̊"],
    ["ёж", "ëж", "ёж"],
]
DIFFERENT = ["pate", "Pâté", "m2", "m²", "m³", "flan", "half fat", "halffat", "ハ", "バ", "A", "a", "naive", "naïve"]


def test_forms(spark):
    forms = [lookalike.visible(t) for t in DIFFERENT]
    assert len(set(forms)) == len(forms)
    rows = [(k, t) for k, t in enumerate([x for g in SAME for x in g] + DIFFERENT)]
    rows += [(100, None), (101, ""), (102, "​"), (103, "pâté")]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "k bigint, t string, canonical string")
    got = {r.k: r.canonical for r in lookalike.canonical(df, "t").collect()}
    assert len(got) == len(rows) and got[100] is None and got[101] == "" == got[102]
    text = dict(rows)
    assert all(c is None or not c or c in text.values() and lookalike.visible(c) == lookalike.visible(text[k]) for k, c in got.items())
    classes = defaultdict(set)
    for k, c in got.items():
        if c:
            classes[c].add(text[k])
    assert sorted(map(sorted, (g for g in classes.values() if len(g) > 1))) == sorted(sorted(set(g)) for g in SAME)
    pairs = {(r.k_a, r.k_b) for r in lookalike.look_alikes(df, "t", "k").collect()}
    want = {(a, b) for a, x in rows for b, y in rows if a < b and x and y and x != y and any(x in g and y in g for g in SAME)}
    assert pairs == want


def test_order_of_marks():
    marks = "̛̣̂̀"
    for t in ("u" + marks, "ự", "Ǘ"):
        assert unicodedata.is_normalized("NFC", lookalike.visible(t))
    assert lookalike.visible("a\t b") == "a  b"


def test_empty_and_long(spark):
    df = spark.createDataFrame([], "k bigint, t string")
    assert lookalike.canonical(df, "t").count() == 0 and lookalike.look_alikes(df, "t", "k").count() == 0
    long = "é" * 200_000
    df = spark.createDataFrame([(1, long), (2, unicodedata.normalize("NFD", long)), (None, long)], "k bigint, t string")
    assert [tuple(r) for r in lookalike.look_alikes(df, "t", "k").collect()] == [(1, 2)]
