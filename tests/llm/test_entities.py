import random
from datetime import datetime

from pyspark.sql import functions as F

from tessera.llm import entities as E
from tessera.plans.runtime import Workspace

T = datetime(2024, 1, 1)
CUL = "uri string, food_name string, alt_names array<string>, country_code string, energy_kcal double, category string, maker string, edited_at timestamp, loaded_at timestamp, label string"
WIK = "uri string, label string, aliases string, origin string, energy_kj int, brand string, blurb string, edited_at timestamp, loaded_at timestamp, maker string"
KINDS = {"bean": "haricot", "rice": "riz", "soup": "soupe", "cake": "gâteau"}
PREPS = ["red", "green", "hot", "mild", "aged"]


def made(n, seed=1):
    rng = random.Random(seed)
    cul, wik, truth = [], [], set()
    taken = set()
    while len(cul) < n:
        name = "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(5))
        kind, prep = rng.choice(list(KINDS)), rng.choice(PREPS)
        if name in taken:
            continue
        taken.add(name)
        kcal = round(rng.uniform(40, 500), 1)
        k = len(cul)
        alts = rng.choice([None, [f"{name.title()} ({KINDS[kind]})"]])
        cul.append((f"cul:{k:05}", f"{prep.title()} {name} {kind}", alts, rng.choice(["QB", None]), kcal, rng.choice(["dairy", None]), "Acme Foods", T, T, None))
        if rng.random() < 0.7:
            bad = list(name)
            i = rng.randrange(1, len(bad) - 1)
            if rng.random() < 0.5:
                del bad[i]
            label = rng.choice([f"{''.join(bad)} {kind}s ({prep})", f"{prep} {''.join(bad).title()} {KINDS[kind]}", f"{''.join(bad)}, {kind}"]).upper()
            wik.append((f"wik:{k:05}", label, rng.choice([None, f"{name[:3].title()}. {kind}"]), "Fituteri", int(kcal * E.KJ * rng.uniform(0.98, 1.02)), None, None, T, T, None))
            truth.add((f"cul:{k:05}", f"wik:{k:05}"))
        other = rng.choice([p for p in PREPS if p != prep])
        if rng.random() < 0.3:  # the same name, another preparation
            wik.append((f"wik:x{k:04}", f"{other} {name} {kind}", None, None, int(kcal * 1.7 * E.KJ), None, None, T, T, None))
    return cul, wik, truth


def run(spark, cul, wik, **how):
    places = spark.createDataFrame([("QB", "Fituteri")], "country_code string, place_name string")
    a, b = E.foods(spark.createDataFrame(cul, CUL), spark.createDataFrame(wik, WIK), places)
    return {(r.e1, r.e2): r.p for r in E.match(a, b, **how).collect()}


def test_pairs(spark):
    cul, wik, truth = made(250)
    nothing = (None,) * 8
    cul += [("cul:99999", "Plain", *nothing), ("cul:99998", None, *nothing), ("cul:99997", "Red bean", *nothing), ("cul:99996", "", *nothing), (None, "Red x", *nothing), cul[3], ("cul:88888", cul[4][1].upper(), *cul[4][2:])]
    wik += [("wik:99999", None, *nothing), ("wik:99998", "", "", *nothing[1:]), ("wik:99997", "Item 12", *nothing), ("wik:99996", "z" * 50_000, *nothing), wik[2]]
    truth |= {("cul:88888", b) for a, b in truth if a == cul[4][0]}
    got = run(spark, cul, wik)
    found = {k for k, p in got.items() if p >= 0.5}
    assert all(0 <= p <= 1 for p in got.values())
    assert len(found & truth) >= 0.93 * len(truth) and len(found - truth) <= 0.03 * len(found)


def test_empty(spark):
    cul, wik, _ = made(5)
    assert run(spark, [], wik) == {} and run(spark, cul, []) == {}


def test_translations_are_learnt(spark):
    cul, _, _ = made(250)
    rows = E.translations(spark.createDataFrame([(c[1], c[2] or []) for c in cul], "name string, others array<string>")).collect()
    assert {r.word: r.means for r in rows} == {f: e for e, f in KINDS.items()}


def test_hot_name(spark):
    """A third of all records share a name, half of them misspelt."""
    cul, wik, truth = made(240)
    nothing = (None,) * 4
    for k in range(120):
        kind, prep = list(KINDS)[k % 4], PREPS[k // 4 % 5]
        kcal = round(40 * 1.05 ** (k % 60), 1)
        maker = "".join(random.Random(k).choice("bdfgk") + random.Random(k + 7).choice("aeiou") for _ in range(3)) + str(k)
        cul.append((f"cul:h{k:04}", f"{prep.title()} Kozimaduna {kind}", None, None, kcal, None, maker, None, None, None))
        wik.append((f"wik:h{k:04}", f"{prep} {'kozimaduna' if k % 2 else 'kozmaduna'} {kind}s", None, None, int(kcal * E.KJ), maker, *nothing))
        truth.add((f"cul:h{k:04}", f"wik:h{k:04}"))
    found = {k for k, p in run(spark, cul, wik).items() if p >= 0.5}
    hot = {x for x in truth if x[0].startswith("cul:h")}
    assert len(found & hot) >= 0.9 * len(hot)


def test_top_k_is_exact(spark):
    """Pruning loses nothing: the same as scoring all pairs."""
    cul, wik, _ = made(120)
    places = spark.createDataFrame([("QB", "Fituteri")], "country_code string, place_name string")
    a, b = E.foods(spark.createDataFrame(cul, CUL), spark.createDataFrame(wik, WIK), places)
    ws = Workspace(spark, "test")
    ia, ib = (E.Index(ws.cut(x.select(F.col("uri").alias("id"), "terms"), f"r{i}"), ws, str(i)) for i, x in enumerate((a, b)))
    for k in (1, 3):
        got, own = E.top_k(ib, ia, k, ws, f"k{k}", least=0.3, first=2)
        every = ib.recs.select(F.col("id").alias("q")).crossJoin(ia.recs.select(F.col("id").alias("d"))).withColumn("floor", F.lit(0.0))
        every = E.scored(every, own, ia).toPandas()
        weight = own.where((F.col("k") != E.SIZE) & (F.col("df").isNotNull() | (F.col("k") == E.GRAM))).groupBy("q").agg(F.sum("w").alias("w")).toPandas()
        every = every.merge(weight, on="q")
        every = every[every.s >= 0.3 * every.w - 1e-9]
        want = every[every.s.round(9).groupby(every.q).rank(method="min", ascending=False) <= k]
        assert {(r.q, r.d) for r in got.collect()} == set(zip(want.q, want.d)) and len(want)


def test_copies(spark):
    cul, wik, truth = made(60)
    again = [(f"{w[0]}c{i}", *w[1:]) for w in wik for i in range(3)]
    found = {k for k, p in run(spark, cul, wik + again).items() if p >= 0.5}
    once = {(a, b) for a, b in found if "c" not in b.partition(":")[2]}
    assert found == once | {(a, f"{b}c{i}") for a, b in once for i in range(3)} and len(once & truth) >= 0.85 * len(truth)
