"""Similarity joins of two label sets: lossless blocking, then verification.

A theta join ``d(a, b) <= t`` never compares texts with each other here.  Texts
are told apart by sketches of 256 bits (``sketch_pairs``): strings within ``t``
differ in few features, so their sketches differ in as few bits.

* q-grams (Jaccard): the sets of grams differ in at most ``t / (2 - t)`` of both
  sizes' sum.
* Levenshtein: ``k`` edits change at most ``2 k`` signs and ``4 k`` 2-grams.
* Jaro: the signs that don't match are bounded by the lengths.
* token or key blocking for measures without such a bound (documented loss).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.ipc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import distance as D
from tessera.functions.aggregate import confidence
from tessera.plans.runtime import Workspace


def _rows(df: DataFrame, e: str, label: str) -> DataFrame:
    return df.select(F.col(df.columns[0]).alias(e), F.col(df.columns[1]).alias(label)).dropna()


def sides(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(e, label)`` tables -> distinct ``(e1, x)`` and ``(e2, y)``, no nulls."""
    return _rows(a, "e1", "x").distinct(), _rows(b, "e2", "y").distinct()


def _texts(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Sides, whose rows may repeat, and their distinct texts: texts are joined,
    entities come back last."""
    a, b = _rows(a, "e1", "x"), _rows(b, "e2", "y")
    return a, b, a.select("x").distinct(), b.select("y").distinct()


def _back(a: DataFrame, b: DataFrame, found: DataFrame) -> DataFrame:
    """Texts with distance ``d`` -> entity pairs, smallest distance of each."""
    return found.join(a, "x").join(b, "y").groupBy("e1", "e2").agg(F.min("d").alias("p"))


#: Most texts of a side in one tile, and tiles of either side that a small table gets
#: too: copies cost disk, so there are no more tiles than keep the tasks busy.
TILE, SPREAD = 200_000, (4, 3)


def signs(c: Column) -> Column:
    """Signs of a text, each with how often it came before."""
    n = F.length(c)
    at = lambda i: F.substring(c, i, F.lit(1))
    nth = lambda i: i - F.length(F.replace(F.substring(c, F.lit(1), i), at(i), F.lit("")))
    made = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(at(i), nth(i).cast("string")))
    return F.when(n > 0, made).when(n == 0, F.array().cast("array<string>"))


def _sketches(bits: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Number of features of each row, and its sketch: 256 bits in four words, of
    which each feature flips one."""
    n = np.diff(bits.offsets.to_numpy())
    v = bits.flatten().to_numpy(zero_copy_only=False).view(np.uint8)
    out = np.zeros((len(n), 4), np.uint64)
    np.bitwise_xor.at(out, (np.repeat(np.arange(len(n)), n), v >> 6), np.uint64(1) << (v & 63).astype(np.uint64))
    return n, out


#: Pairs of rows from which a tile splits sketches into parts, and pairs of one part's
#: value from which rows meet as blocks.
SPLIT, BLOCK = 1_000_000, 2_000


def _part(w: np.ndarray, k: int, parts: int) -> np.ndarray:
    """Part ``k`` of each sketch: ``256 / parts`` neighbouring bits, 64 at most."""
    lo, hi = -(-256 * k // parts), -(-256 * (k + 1) // parts)
    out = w[:, lo >> 6] >> np.uint64(lo & 63)
    if (hi - 1) >> 6 != lo >> 6:
        out = out | w[:, (lo >> 6) + 1] << np.uint64(64 - (lo & 63))
    return out & np.uint64((1 << (hi - lo)) - 1)


def _less(v: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values ``v`` with one bit less, if they may be among ``other``, and their rows."""
    place = lambda z: (z * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)
    known = np.zeros(1 << 22, bool)
    known[place(other)] = True
    made, rows = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for bit in range(int(np.bitwise_or.reduce(v)).bit_length()):
        i = np.flatnonzero((v & np.uint64(1 << bit)).astype(bool))
        z = v[i] ^ np.uint64(1 << bit)
        ok = known[place(z)]
        made.append(z[ok])
        rows.append(i[ok])
    return np.concatenate(made), np.concatenate(rows)


def _equal(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Orders of ``a`` and ``b`` by value, and for each common value its beginning in
    either order and its number there."""
    p, q = np.argsort(a), np.argsort(b)
    u, i, n = np.unique(a[p], return_index=True, return_counts=True)
    sb = b[q]
    j = np.searchsorted(sb, u)
    m = np.searchsorted(sb, u, "right") - j
    keep = m > 0
    return p, q, i[keep], n[keep], j[keep], m[keep]


def _meet(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], fx: list[np.ndarray], fy: list[np.ndarray], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of values ``a`` and ``b`` (value, row) that are equal and whose folded
    sketches differ in at most ``most`` bits."""
    p, q, i, n, j, m = _equal(a[0], b[0])
    rx, ry = a[1][p], b[1][q]
    fx, fy = [f[rx] for f in fx], [f[ry] for f in fy]
    big = n * m >= BLOCK
    for i0, n0, j0, m0 in zip(*(z[big].tolist() for z in (i, n, j, m))):
        step = max(1, 200_000 // m0)
        for r in range(i0, i0 + n0, step):
            end = min(r + step, i0 + n0)
            for c in range(j0, j0 + m0, 200_000):
                last = min(c + 200_000, j0 + m0)
                ok = reduce(np.add, (np.bitwise_count(f[r:end, None] ^ g[None, c:last]) for f, g in zip(fx, fy))) <= most
                if ok.any():
                    hit = np.flatnonzero(ok)
                    yield rx[r + hit // (last - c)], ry[c + hit % (last - c)]
    i, n, j, m = (z[~big] for z in (i, n, j, m))
    ends = np.cumsum(n * m)
    cut = 0
    while cut < len(i):
        to = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + 500_000)))
        # each row of the one side, then those of the other that it meets
        left = np.repeat(i[cut:to] - np.cumsum(n[cut:to]) + n[cut:to], n[cut:to]) + np.arange(n[cut:to].sum())
        times, first = np.repeat(m[cut:to], n[cut:to]), np.repeat(j[cut:to], n[cut:to])
        x = np.repeat(left, times)
        y = np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())
        hit = np.flatnonzero(reduce(np.add, (np.bitwise_count(f[x] ^ g[y]) for f, g in zip(fx, fy))) <= most)
        if len(hit):
            yield rx[x[hit]], ry[y[hit]]
        cut = to


def _by_parts(wx: np.ndarray, wy: np.ndarray, fx: list[np.ndarray], fy: list[np.ndarray], parts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the pairs of sketches that may differ in at most ``2 * parts - 1``
    bits, each once: in one of the parts they differ in one bit at most, so that
    there they are equal or one is the other with a bit less."""
    before: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(parts):
        vx, vy = _part(wx, k, parts), _part(wy, k, parts)
        x, y = (vx, np.arange(len(vx))), (vy, np.arange(len(vy)))
        less = _less(vy, vx)
        both = np.concatenate([vy, less[0]]), np.concatenate([y[1], less[1]])
        for a, b in ((x, both), (_less(vx, vy), y)):
            for i, j in _meet(a, b, fx, fy, 2 * parts - 1):
                for p, q in before:
                    new = np.bitwise_count(p[i] ^ q[j]) > 1
                    i, j = i[new], j[new]
                if len(i):
                    yield i, j
        before.append((vx, vy))


def _selective(wx: np.ndarray, wy: np.ndarray, parts: int) -> bool:
    """Whether few enough pairs are near in a part; those of equal parts are about a
    tenth of them."""
    pairs = len(wx) * len(wy)
    if pairs < SPLIT or np.bitwise_count(wx).sum() < 4 * parts * len(wx):
        return False
    alike = 0
    for k in range(parts):
        *_, n, _, m = _equal(_part(wx, k, parts), _part(wy, k, parts))
        alike += int((n * m).sum())
    return 20 * alike < pairs


def _near(x: list[pa.ListArray], y: list[pa.ListArray], most: Callable[[int, np.ndarray], list[np.ndarray]], lead: int = 0, folds: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs whose sketches differ in at most ``most`` bits.

    Pairs of sizes with the same bound meet by parts of the sketches if that leaves
    few; the others are all compared."""
    (nx, _), (ny, _) = (made := [_sketches(c) for c in x])[0], (other := [_sketches(c) for c in y])[0]
    order = np.argsort(ny, kind="stable")
    ny, wx, wy = ny[order], [w for _, w in made], [w[order] for _, w in other]
    # folded to one word or two, a sketch still differs in no more bits
    fold = lambda w: [np.bitwise_xor.reduce(w[lead][:, k::folds], axis=1) for k in range(folds)]
    fx, fy = fold(wx), fold(wy)
    left, front = np.unique(nx, return_inverse=True)
    sizes, back = np.unique(ny, return_inverse=True)
    bounds = [np.array(h, np.int64) for h in zip(*(most(int(n), sizes.astype(np.int64)) for n in left))]
    open_ = bounds[0] >= 0
    parts = np.where(open_, np.maximum(bounds[lead] // 2 + 1, 4), 0)
    for n in np.unique(parts[open_]):
        own = parts == n
        rows, cols = np.flatnonzero(own.any(1)[front]), np.flatnonzero(own.any(0)[back])
        a, b = wx[lead][rows], wy[lead][cols]
        if not _selective(a, b, int(n)):
            continue
        open_ &= ~own
        for i, j in _by_parts(a, b, [f[rows] for f in fx], [f[cols] for f in fy], int(n)):
            i, j = rows[i], cols[j]
            keep = own[front[i], back[j]]
            i, j = i[keep], j[keep]
            for p, q, h in zip(wx, wy, bounds):
                keep = np.bitwise_count(p[i] ^ q[j]).sum(1, dtype=np.int64) <= h[front[i], back[j]]
                i, j = i[keep], j[keep]
            if len(i):
                yield i, order[j]
    high, wide = 8, 16_384
    xor, count, more, ok = (np.empty(high * wide, t) for t in (np.uint64, np.uint8, np.uint8, bool))
    for k in range(len(left)):
        rows, bound = np.flatnonzero(front == k), [h[k][back] for h in bounds]
        fits = np.flatnonzero(open_[k][back])
        if not len(fits):
            continue
        first = np.where(open_[k][back], np.minimum(bound[lead], 127), -1).astype(np.int8)
        for c in range(fits[0], fits[-1] + 1, wide):
            cols = min(wide, fits[-1] + 1 - c)
            for r in range(0, len(rows), high):
                part = rows[r : r + high]
                shape = (len(part), cols)
                a, b, m, o = (z[: len(part) * cols].reshape(shape) for z in (xor, count, more, ok))
                np.bitwise_xor(fx[0][part, None], fy[0][None, c : c + cols], out=a)
                np.bitwise_count(a, out=b)
                for p, q in zip(fx[1:], fy[1:]):
                    np.bitwise_xor(p[part, None], q[None, c : c + cols], out=a)
                    np.add(b, np.bitwise_count(a, out=m), out=b)
                np.less_equal(b.view(np.int8), first[None, c : c + cols], out=o)
                ok[o.size : -(-o.size // 8) * 8] = False
                # eight at once, as hits are rare
                eight = np.flatnonzero(ok[: -(-o.size // 8) * 8].view(np.uint64))
                at, nth = np.nonzero(ok.reshape(-1, 8)[eight])
                hit = eight[at] * 8 + nth
                if not len(hit):
                    continue
                i, j = part[hit // cols], c + hit % cols
                for p, q, h in zip(wx, wy, bound):
                    keep = np.bitwise_count(p[i] ^ q[j]).sum(1, dtype=np.int64) <= h[j]
                    i, j = i[keep], j[keep]
                if len(i):
                    yield i, order[j]


def _written(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(t.combine_chunks())
    return sink.getvalue().to_pybytes()


def _read(body: bytes) -> pa.Table:
    with pa.ipc.open_stream(body) as t:
        return t.read_all()


def _apart(spark: SparkSession, n: int) -> list[int]:
    """``n`` numbers that a shuffle to ``n`` partitions deals to one each."""
    dealt = spark.range(n * 40).select(F.col("id").cast("int").alias("k")).select("k", F.pmod(F.hash("k"), F.lit(n)).alias("p"))
    first = {r.p: r.k for r in dealt.groupBy("p").agg(F.min("k").alias("k")).collect()}
    return [first.get(p, -1 - p) for p in range(n)]


def sketch_pairs(
    xs: DataFrame, ys: DataFrame, features: Sequence[Callable[[Column], Column]], most: Callable[[int, np.ndarray], list[np.ndarray]], lead: int = 0, folds: int = 1,
    near: Callable[[str, str], float | None] | None = None,
) -> DataFrame:
    """``x, y``: the pairs of distinct texts ``x`` and ``y`` whose ``features``
    (arrays) may differ in at most ``most`` elements each.  Lossless; pairs with
    equal sketch bits by chance come too, so the caller verifies; with ``near``, which
    gives the distance of two texts or none, the pairs that have one come with it as ``d``.

    ``most`` takes a number of features of the first kind of ``x`` and those of many
    ``y`` and gives, for each kind, how many elements of both sides may be without
    partner; a negative first bound leaves the pair out.  All pairs are told apart by the kind
    ``lead``, folded to ``folds`` words; the rest by all.  Both sides are dealt to
    tiles, in each of which the sketches that are nearly equal in some part meet, or
    every sketch every other at about a nanosecond a pair; that takes a shuffle of each
    side, in compressed blocks, once a tile of the other."""
    ws, kinds = Workspace(xs.sparkSession, "sketches"), range(len(features))

    def made(df: DataFrame, key: str, spread: int) -> tuple[DataFrame, int]:
        bits = [F.transform(f(F.col(key)), lambda g: (F.xxhash64(g).bitwiseAND(F.lit(255)) - 128).cast("tinyint")).alias(f"b{k}") for k, f in enumerate(features)]
        df = ws.cut(df.select(F.col(key).alias("v"), *bits), key)
        n = df.count()
        return df, max(math.ceil(n / TILE), min(spread, math.ceil(n / 1000)), 1)

    def packed(df: DataFrame, k: int, left: bool) -> DataFrame:
        """Rows of each of ``k`` parts as compressed blocks, half the size of rows."""
        own = df.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(k)).cast("int"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []

            def blocks() -> pa.RecordBatch:
                t = pa.Table.from_batches(held)
                part = t.column("part").to_numpy()
                parts = np.unique(part)
                bodies = [_written(t.filter(pa.array(part == p)).drop_columns("part")) for p in parts]
                return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(bodies, pa.binary())], ["part", "body"])

            for batch in batches:
                held.append(batch)
                if sum(map(len, held)) >= 50_000:
                    yield blocks()
                    held.clear()
            if held:
                yield blocks()

        return own.mapInArrow(run, "part int, body binary").withColumn("left", F.lit(left))

    (x, kx), (y, ky) = made(xs, "x", SPREAD[0]), made(ys, "y", SPREAD[1])
    all_ = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    x = packed(x, kx, True).withColumnRenamed("part", "i").select("*", all_(ky).alias("j"))
    y = packed(y, ky, False).withColumnRenamed("part", "j").select("*", all_(kx).alias("i"))
    labels = F.array(*[F.lit(k) for k in _apart(xs.sparkSession, kx * ky)])
    rows = x.unionByName(y).withColumn("tile", F.get(labels, F.col("i") * ky + F.col("j"))).drop("i", "j").repartition(kx * ky, "tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        left = t.column("left").to_numpy()
        sides = [t.column("body").filter(pa.array(own)).to_pylist() for own in (left, ~left)]
        if not all(sides):
            return
        a, b = (pa.concat_tables(_read(body) for body in bodies).combine_chunks() for bodies in sides)
        one = lambda t, c: t.column(c).combine_chunks()

        def made(i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
            x, y = one(a, "v").take(pa.array(i)), one(b, "v").take(pa.array(j))
            if not near:
                return pa.RecordBatch.from_arrays([x, y], ["x", "y"])
            d = pa.array(map(near, x.to_pylist(), y.to_pylist()), pa.float64())
            return pa.RecordBatch.from_arrays([x, y, d], ["x", "y", "d"]).filter(d.is_valid())

        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for i, j in _near([one(a, f"b{k}") for k in kinds], [one(b, f"b{k}") for k in kinds], most, lead, folds):
            held.append((i, j))
            n += len(i)
            if n >= 50_000:
                yield made(*(np.concatenate(z) for z in zip(*held)))
                held, n = [], 0
        if held:
            yield made(*(np.concatenate(z) for z in zip(*held)))

    return rows.groupBy("tile").applyInArrow(run, "x string, y string" + ", d double" * bool(near))


def qgram_join(a: DataFrame, b: DataFrame, t: float, q: int = 2, inclusive: bool = True) -> DataFrame:
    """``e1, e2, p``: all pairs with a q-gram distance of at most ``t`` (0 <= t
    < 1), the smallest over their labels.  Lossless: sets of m and n grams within
    ``t`` differ in at most (m + n) t / (2 - t)."""
    if not 0 <= t < 1:
        raise ValueError("0 <= t < 1")
    a, b, xs, ys = _texts(a, b)

    def most(m: int, n: np.ndarray) -> list[np.ndarray]:
        apart = np.floor((m + n) * t / (2 - t) + 1e-9)
        return [np.where(np.abs(m - n) <= apart, apart, -1)]

    def near(x: str, y: str) -> float | None:
        x, y = D.gram_set(x, q), D.gram_set(y, q)
        both = len(x & y)
        d = 1 - both / either if (either := len(x) + len(y) - both) else 0.0
        return d if d < t or inclusive and d == t else None

    return _back(a, b, sketch_pairs(xs, ys, [lambda c: D.grams(c, q)], most, folds=1 if t < 0.4 else 2, near=near))


def levenshtein_join(a: DataFrame, b: DataFrame, t: float, inclusive: bool = True) -> DataFrame:
    """``e1, e2, p``: all pairs with a normalised edit distance of at most ``t``
    (0 <= t <= 0.5), the smallest over their labels.  Lossless: with m = longest
    length the pair has at most floor(t m) edits; the built-in stops there."""
    if not 0 <= t <= 0.5:
        raise ValueError("0 <= t <= 0.5")
    a, b, xs, ys = _texts(a, b)

    def most(m: int, n: np.ndarray) -> list[np.ndarray]:
        k = np.floor(np.maximum(m, n) * t + 1e-9)
        k = np.where(np.abs(m - n) <= k, k, -1)
        return [2 * k, 4 * k]

    cand = sketch_pairs(xs, ys, [signs, lambda c: D.grams(c, 2)], most, lead=1, folds=2)
    longest = F.greatest(F.length("x"), F.length("y"))
    cand = cand.withColumn("k", F.floor(longest * t + 1e-9).cast("int"))
    found = cand.withColumn("d", F.when(longest == 0, 0.0).otherwise(F.expr("levenshtein(x, y, k)") / longest)).where("d >= 0")
    return _back(a, b, found.where(F.col("d") <= t if inclusive else F.col("d") < t).select("x", "y", "d"))


def jaro_candidates(xs: DataFrame, ys: DataFrame, t: float) -> DataFrame:
    """``x, y``: the pairs of texts ``x`` and ``y`` whose textbook Jaro distance may
    be at most ``t`` (0 <= t < 2/3).  Lossless: texts of m and n signs within ``t``
    match c >= (2 - 3t) m n / (m + n) signs, so m + n - 2 c have no partner."""
    if not 0 <= t < 2 / 3:
        raise ValueError("0 <= t < 2/3")

    def most(m: int, n: np.ndarray) -> list[np.ndarray]:
        c = np.maximum(1, np.ceil((2 - 3 * t) * m * n / np.maximum(m + n, 1) - 1e-9))
        apart = np.where(c <= np.minimum(m, n), m + n - 2 * c, -1)
        return [np.where((m == 0) & (n == 0), 0, apart)]

    return sketch_pairs(xs.select("x").dropna().distinct(), ys.select("y").dropna().distinct(), [signs], most)


def equality_join(a: DataFrame, b: DataFrame, key: Callable[[Column], Column] = F.lower) -> DataFrame:
    """``e1, e2, p`` (p = 0) of entities with an equal key of some label."""
    a, b = sides(a, b)
    return a.withColumn("k", key(F.col("x"))).join(b.withColumn("k", key(F.col("y"))), "k").where("k is not null").select(
        "e1", "e2", F.lit(0.0).alias("p")
    ).distinct()


def relaxed_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """``equality_join`` that ignores case and accents."""
    return equality_join(a, b, lambda c: F.collate(c, "UNICODE_CI_AI"))


def blocked_join(a: DataFrame, b: DataFrame, keys: Callable[[Column], Column], measure: Callable[[Column, Column], Column], t: float, inclusive: bool = True) -> DataFrame:
    """``e1, e2, p`` of pairs that share a blocking key (``keys``: text -> array)
    and whose distance is at most ``t``.  Complete only for measures whose close
    pairs share a key; the caller chooses keys and so the recall."""
    a, b, xs, ys = _texts(a, b)
    left_ = xs.select("x", F.explode(F.array_distinct(keys(F.col("x")))).alias("k"))
    right_ = ys.select("y", F.explode(F.array_distinct(keys(F.col("y")))).alias("k"))
    cand = left_.join(right_, "k").select("x", "y").distinct()
    found = cand.withColumn("d", measure(F.col("x"), F.col("y")))
    return _back(a, b, found.where(F.col("d") <= t if inclusive else F.col("d") < t))


def one_against_all(label: str, b: DataFrame, measures: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """``e2`` and the distances of ``label`` to the entity's labels (the smallest
    of each measure): a scan, as the query is one value."""
    _, b = sides(b, b)
    rows = b.select("e2", *[m(F.lit(label), F.col("y")).alias(k) for k, m in measures.items()])
    return rows.groupBy("e2").agg(*[F.min(k).alias(k) for k in measures])


def vectors(pairs: DataFrame, a: DataFrame, b: DataFrame, measures: Sequence[str] = tuple(D.VECTOR), prefilter: float | None = None) -> DataFrame:
    """Distance vectors of candidate pairs ``e1, e2``: one column a measure, the
    best over all labels (scores: the largest).  ``prefilter`` keeps pairs with
    some distance of at most it.  Each pair of texts is compared once."""
    xs, ys = sides(a, b)
    rows = pairs.select("e1", "e2").distinct().join(xs, "e1").join(ys, "e2")
    made = D.vector(F.col("x"), F.col("y"))
    texts = rows.select("x", "y").distinct().select("x", "y", *[made[m].alias(m) for m in measures])
    return _best(rows.join(texts, ["x", "y"]), ["e1", "e2"], measures, prefilter)


def _best(rows: DataFrame, keys: Sequence[str], measures: Sequence[str], prefilter: float | None) -> DataFrame:
    scores = D.VECTOR[:5]
    out = rows.groupBy(*keys).agg(*[(F.max if m in scores else F.min)(m).alias(m) for m in measures]).select("e1", "e2", *measures)
    if prefilter is not None:
        near = [F.coalesce(F.col(m), F.lit(math.inf)) for m in measures if m not in scores]
        out = out.where(F.array_min(F.array(*near)) <= prefilter)
    return out


def all_vectors(a: DataFrame, b: DataFrame, measures: Sequence[str] = tuple(D.VECTOR), prefilter: float | None = None) -> DataFrame:
    """``vectors`` of all pairs of two sides, as Jaro, ISub and Monge-Elkan have no
    lossless join: their number is the product of both sides.  Entities meet in
    tiles, where their labels are compared too, so pairs are not shuffled."""
    xs, ys = sides(a, b)
    ws = Workspace(xs.sparkSession, "vectors")
    xs, ys = ws.cut(xs, "x"), ws.cut(ys, "y")
    kx, ky = (max(1, math.ceil(df.count() / 120)) for df in (xs, ys))
    own = lambda key, k: F.pmod(F.xxhash64(key), F.lit(k)).cast("int")
    all_ = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    # few tiles a side are enough for the tasks; more would only be copies
    kx, ky = min(kx, 28), min(ky, 28)
    xs, ys = xs.select("e1", "x", own("e1", kx).alias("i"), all_(ky).alias("j")), ys.select("e2", "y", all_(kx).alias("i"), own("e2", ky).alias("j"))
    tiled = lambda df: df.withColumn("tile", F.col("i") * ky + F.col("j")).drop("i", "j").repartition(kx * ky, "tile")
    met = tiled(xs).join(tiled(ys), "tile")
    made = D.vector(F.col("x"), F.col("y"))
    return _best(met.select("tile", "e1", "e2", *[made[m].alias(m) for m in measures]), ["tile", "e1", "e2"], measures, prefilter)


def buckets(matches: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """One alignment for several thresholds: ``bucket`` names the tightest
    threshold that the pair passes; pairs that pass none are left out."""
    col = F.lit(None).cast("string")
    for name, t in sorted(thresholds.items(), key=lambda x: -x[1]):
        col = F.when(F.col("p") <= t, F.lit(name)).otherwise(col)
    return matches.withColumn("bucket", col).where("bucket is not null")


def links(pairs: DataFrame, t: float) -> DataFrame:
    """``source, target, confidence`` of pairs whose confidence isn't negative."""
    out = pairs.select(F.col("e1").alias("source"), F.col("e2").alias("target"), confidence(F.col("p"), t).alias("confidence"))
    return out.where("confidence >= 0")


def duplicates(a: DataFrame, t: float, q: int = 2) -> DataFrame:
    """Pairs within one table, each once (``e1 < e2``)."""
    return qgram_join(a, a, t, q).where("e1 < e2")
