"""Long exact spans shared between records, by prefix-partitioned suffix trees.

A span of ``length`` signs that two texts share makes two suffixes meet at depth
``length`` of the common suffix tree.  The tree is never built as one:

* Suffixes are partitioned by a prefix of ``prefix`` signs.  As suffixes that
  begin next to each other share their text, they stay together: the prefix of the
  suffix at an anchor, the place in the first ``length`` signs whose prefix has the
  smallest hash, stands for all of them.  The choice depends on those signs alone,
  so equal suffixes are in one partition.  A partition's entry is a *context*, the
  text of neighbouring suffixes up to depth ``length``, about one for every
  ``(length - prefix) / 2`` signs.
* Prefixes that occur in one document only end here; that is nearly all of them.
  The others' contexts are cut from their documents and sent to their partition.
* Variable length: a partition with more text than ``most_signs`` gets longer
  prefixes.  Its equal contexts become one; the others are split in two by the
  half of the missing signs that follows or precedes the prefix, which is again a
  choice by the first ``length`` signs alone, and so on until partitions fit or the
  prefix is ``length`` signs long, where all that is left of a partition is one text.
* A partition's suffixes are sorted by their signs, by doubling their ranks.  Runs
  of equal ones at depth ``length`` are the subtree's deep internal nodes; those
  with leaves in two documents mark shared stretches.  Stretches that overlap or
  touch make the maximal repeats.

Hashes only choose partitions: text counts as equal if its signs are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.runtime import Workspace

LENGTH = 200
PREFIX = 64
#: Most signs of one prefix's contexts that a task gathers.
MOST_SIGNS = 2_000_000
CHUNK = 1 << 17

# Odd multipliers of the rolling and the mixing hash.
BASE, MIX = 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15


class _Powers:
    """Powers of BASE and of its inverse modulo 2**64, longer when needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, b in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                a = np.full(max(n, 2 * CHUNK), b, np.uint64)
                a[0] = 1
                setattr(cls, name, np.multiply.accumulate(a))
        return cls.up[:n], cls.down[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(MIX)
    return x ^ (x >> np.uint64(29))


def _sums(cp: np.ndarray) -> np.ndarray:
    """Prefix sums of the rolling hash."""
    up, _ = _Powers.of(len(cp) + 1)
    out = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(_mix(cp.astype(np.uint64) + np.uint64(MIX)) * up[: len(cp)], out=out[1:])
    return out


def _hashes(sums: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` neighbouring signs."""
    _, down = _Powers.of(len(sums))
    return _mix((sums[n:] - sums[:-n]) * down[: len(sums) - n])


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbouring values."""
    size = 1
    while size < w:
        step = min(size, w - size)
        h = np.minimum(h[:-step], h[step:])
        size += step
    return h


def contexts(texts: list[str | None], length: int, prefix: int):
    """For chunks of ``texts``: text number, prefix hash, first sign and end of each context; texts shorter than ``length`` have none."""
    a = 0
    while a < len(texts):
        b, n = a, 0
        while b < len(texts) and (b == a or n + len(texts[b] or "") <= CHUNK):
            n += len(texts[b] or "")
            b += 1
        sizes = np.array([len(t or "") for t in texts[a:b]], np.int64)
        if n >= length and (sizes >= length).any():
            cp = np.frombuffer("".join(t or "" for t in texts[a:b]).encode("utf-32-le", "surrogatepass"), "<u4")
            sums = _sums(cp)
            least = _least(_hashes(sums, prefix), length - prefix + 1)
            begins = np.cumsum(sizes) - sizes
            who = np.flatnonzero(sizes >= length)
            # windows must lie inside one text
            ok = np.zeros(len(least) + 1, np.int8)
            ok[begins[who]] += 1
            ok[begins[who] + sizes[who] - length + 1] -= 1
            ok = np.cumsum(ok[:-1], dtype=np.int8) > 0
            first = ok.copy()
            first[1:] &= (least[1:] != least[:-1]) | ~ok[:-1]
            first[begins[who]] = True
            s = np.flatnonzero(first)
            text = np.searchsorted(begins, s, "right") - 1
            # empty texts begin where the next one does
            end = np.append(s[1:], len(cp))
            end = np.minimum(end - 1 + length, (begins + sizes)[text])
            yield a + text, least[s].view(np.int64), (s - begins[text]).astype(np.int32), (end - begins[text]).astype(np.int32)
        a = b


def _scan(docs: DataFrame, length: int, prefix: int, places: bool) -> DataFrame:
    """Contexts of ``doc, text`` rows: ``kh, doc`` (each pair of a chunk once), or
    with ``places`` also ``th`` (the text's hash) and ``s, e``."""
    kind = docs.schema["doc"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            size, cuts = 0, [0]
            for i, n in enumerate(batch.column("text").to_pandas().str.len().fillna(0).tolist()):
                size += n
                if size > 1 << 21:
                    cuts.append(i + 1)
                    size = 0
            for x, y in zip(cuts, [*cuts[1:], batch.num_rows]):
                part = batch.slice(x, y - x)
                texts, keys = part.column("text").to_pylist(), part.column("doc")
                for who, kh, s, e in contexts(texts, length, prefix):
                    if places:
                        i = pa.array(who)
                        cols, names = [pa.array(kh), keys.take(i), part.column("th").take(i), pa.array(s), pa.array(e)], ["kh", "doc", "th", "s", "e"]
                    else:
                        one = _unique(kh, who)
                        cols, names = [pa.array(kh[one]), keys.take(pa.array(who[one]))], ["kh", "doc"]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, f"kh bigint, doc {kind}{', th bigint, s int, e int' if places else ''}")


def _cut(rows: DataFrame, kind: str) -> DataFrame:
    """``kh, doc, s, ctx`` of documents ``doc, text`` and their ``places``."""

    def run(batches):
        for batch in batches:
            lists = batch.column("places")
            at = lists.flatten()
            who = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            s, e = (at.field(c).to_numpy(zero_copy_only=False) for c in ("s", "e"))
            for x in range(0, len(who), 20_000):
                part = slice(x, x + 20_000)
                texts: dict[int, str] = {}
                cut = []
                for i, p, q in zip(who[part].tolist(), s[part].tolist(), e[part].tolist()):
                    if i not in texts:
                        texts = {i: batch.column("text")[i].as_py()}
                    cut.append(texts[i][p:q])
                n = len(cut)
                yield pa.RecordBatch.from_arrays(
                    [at.field("kh").slice(x, n), batch.column("doc").take(pa.array(who[part])), at.field("s").slice(x, n), pa.array(cut, pa.string())], names=["kh", "doc", "s", "ctx"]
                )

    return rows.select("doc", "text", "places").mapInArrow(run, f"kh bigint, doc {kind}, s int, ctx string")


def _unique(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the first of equal pairs."""
    o = np.lexsort((b, a))
    keep = np.ones(len(o), bool)
    keep[1:] = (a[o][1:] != a[o][:-1]) | (b[o][1:] != b[o][:-1])
    return o[keep]


def _rank(x: np.ndarray) -> np.ndarray:
    order = np.argsort(x)  # equal values get one rank, in whatever order they come
    y = x[order]
    new = np.empty(len(x), np.int64)
    new[order] = np.cumsum(np.concatenate([[0], (y[1:] != y[:-1]).astype(np.int64)]))
    return new


def _nodes(texts: list[str], group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all suffixes of the texts with at least ``length`` signs: text number,
    first sign, and the rank of their first ``length`` signs within their
    ``group``: equal ranks are equal signs of one group.

    Ranks of 2n signs come from those of n: sorting pairs of neighbours' ranks."""
    sizes = np.array([len(t) for t in texts], np.int64)
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    begins = np.cumsum(sizes) - sizes
    counts = sizes - length + 1
    who = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    # as many signs as fit a number, numbered by those that occur (three of 21 bits, nine
    # of an alphabet of 128); what runs over a text's end is not used
    signs = np.zeros(int(cp.max(initial=0)) + 1, np.int64)
    signs[cp] = 1
    bits = max(1, int(signs.sum() - 1).bit_length())
    cp = (np.cumsum(signs) - 1)[cp]
    n = min(length, 63 // bits)
    rank = cp.copy()
    for k in range(1, n):
        rank[:-k] = (rank[:-k] << bits) | cp[k:]
    rank = _rank(rank)
    while 2 * n < length:
        pair = rank * len(rank)
        pair[:-n] += rank[n:]
        rank, n = _rank(pair), 2 * n
    # the last pairs are those of the suffixes only
    begin = begins[who] + at
    first = rank[begin]
    if n < length:
        first = _rank(first * len(rank) + rank[begin + length - n])
    return who, at.astype(np.int32), _rank(first * (int(group.max(initial=0)) + 1) + group[who])


def _runs(who: np.ndarray, at: np.ndarray, length: int):
    """Runs of neighbouring windows, as (context number, first sign, end)."""
    if not len(who):
        return []
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (at[1:] != at[:-1] + 1)
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(who)) - 1
    return list(zip(who[a].tolist(), at[a].tolist(), (at[b] + length).tolist()))


def _subtree(group: np.ndarray, docs: np.ndarray, ctx: np.ndarray, texts: list[str], length: int):
    """Shared runs of whole partitions, from the partition, document and text
    number of each context, as (context number, first sign, end)."""
    if not len(group):
        return []
    # equal contexts are one path of the tree
    key = group.astype(np.int64) * len(texts) + ctx
    order = np.argsort(key, kind="stable")
    a = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    path = np.empty(len(key), np.int64)
    path[order] = np.repeat(np.arange(len(a)), np.diff(np.append(a, len(key))))
    lo, hi = np.minimum.reduceat(docs[order], a), np.maximum.reduceat(docs[order], a)
    g, c = group[order][a], ctx[order][a]
    whole = lo < hi
    # a partition with one path needs no sorting, nor one all of whose paths are shared
    several = np.bincount(g)[g] > 1
    open_ = np.bincount(g, weights=~whole)[g] > 0
    sort = np.flatnonzero(several & open_)
    runs: dict[int, list[tuple[int, int]]] = {int(p): [(0, len(texts[c[p]]))] for p in np.flatnonzero(whole)}
    if len(sort):
        who, at, node = _nodes([texts[i] for i in c[sort]], _rank(g[sort]), length)
        p = sort[who]
        order = np.argsort(node, kind="stable")
        a = np.flatnonzero(np.concatenate([[True], node[order][1:] != node[order][:-1]]))
        shared = np.minimum.reduceat(lo[p][order], a) < np.maximum.reduceat(hi[p][order], a)
        hit = np.zeros(len(order), bool)
        hit[order] = np.repeat(shared, np.diff(np.append(a, len(order))))
        hit &= ~whole[p]
        for i, x, y in _runs(p[hit], at[hit], length):
            runs.setdefault(i, []).append((x, y))
    return [(i, x, y) for i, q in enumerate(path.tolist()) for x, y in runs.get(q, ())]


def _trees(rows: DataFrame, length: int, kind: str, name: str = "doc") -> DataFrame:
    """``doc, a, b``: shared runs of contexts ``kh, doc, s, ctx``; ``name`` is the
    column that names a context in the result."""

    def flush(parts):
        t = pa.Table.from_batches(parts)
        if not t.num_rows:
            return
        kh, s = t.column("kh").to_numpy(), t.column("s").to_numpy()
        coded = t.column("ctx").combine_chunks().dictionary_encode()
        ctx, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        docs = t.column("doc").combine_chunks().dictionary_encode().indices.to_numpy()
        # whole prefixes, some MB of text at a time
        begins = [0, *(np.flatnonzero(kh[1:] != kh[:-1]) + 1).tolist(), len(kh)]
        sizes = np.array([len(w) for w in words], np.int64)
        signs = np.concatenate([[0], np.cumsum(sizes[ctx])])
        group = np.cumsum(np.concatenate([[0], (kh[1:] != kh[:-1]).astype(np.int64)]))
        runs, a = [], 0
        while a < len(begins) - 1:
            b = a + 1
            while b < len(begins) - 1 and signs[begins[b + 1]] - signs[begins[a]] <= MOST_SIGNS:
                b += 1
            x, y = begins[a], begins[b]
            some, inv = np.unique(ctx[x:y], return_inverse=True)
            runs += [(i + x, p, q) for i, p, q in _subtree(group[x:y] - group[x], docs[x:y], inv, [words[i] for i in some], length)]
            a = b
        if runs:
            i = np.array([r[0] for r in runs])
            yield pa.RecordBatch.from_arrays(
                [
                    t.column(name).combine_chunks().take(pa.array(i)),
                    pa.array((s[i] + np.array([r[1] for r in runs])).astype(np.int32)),
                    pa.array((s[i] + np.array([r[2] for r in runs])).astype(np.int32)),
                ],
                names=[name, "a", "b"],
            )

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # the last prefix may go on in the next batch
            kh = batch.column("kh").to_numpy()
            cut = int(np.flatnonzero(kh != kh[-1])[-1]) + 1 if kh[0] != kh[-1] else 0
            if held and (cut or kh[0] != held[-1].column("kh")[-1].as_py()):
                if cut:
                    held.append(batch.slice(0, cut))
                yield from flush(held)
                held = []
            elif cut:
                yield from flush([batch.slice(0, cut)])
            held.append(batch.slice(cut))
        if held:
            yield from flush(held)

    return rows.mapInArrow(run, f"{name} {rows.schema[name].dataType.simpleString()}, a int, b int")


def _split(rows: DataFrame, length: int, size: int, kind: str) -> DataFrame:
    """Contexts ``key`` (the prefix's text), ``at`` (its place), ``id, off`` (the
    original context and where this one begins in it), ``lo, hi, ctx`` of prefixes
    of ``size`` signs -> the same for prefixes that are longer by half of what is
    missing.  A suffix goes with the signs after the prefix if its first
    ``length`` signs hold them, else with those before."""
    more = -(-(length - size) // 2)

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for x in range(0, len(rows), 5000):
                out = []
                for r in rows[x : x + 5000]:
                    ctx, at = r["ctx"], r["at"]
                    last = len(ctx) - length  # the suffixes begin at 0..last
                    # from this suffix on the signs after the prefix are held
                    turn = max(0, at + size + more - length)
                    if turn <= last:
                        out.append({**r, "key": ctx[at : at + size + more], "at": at - turn, "off": r["off"] + turn, "ctx": ctx[turn:]})
                    if turn > 0:
                        end = min(turn - 1, last) + length
                        out.append({**r, "key": ctx[at - more : at + size], "at": at - more, "ctx": ctx[:end]})
                yield pa.RecordBatch.from_pylist(out, batch.schema)

    return rows.mapInArrow(run, rows.schema)


def _long_prefixes(rows: DataFrame, length: int, prefix: int, kind: str, most_signs: int, ws: Workspace) -> DataFrame:
    """``doc, a, b`` for contexts ``kh, doc, s, ctx`` of prefixes with too much
    text.  Equal contexts are one entry, whichever documents hold them; prefixes
    grow until a partition's entries fit."""
    once = rows.groupBy("kh", "ctx").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    once = ws.cut(once.withColumn("id", F.monotonically_increasing_id()), "once")
    open_ = once.select(F.lit("").alias("key"), F.lit(0).alias("at"), "id", F.lit(0).alias("off"), "lo", "hi", "ctx", "kh")

    def anchors(batches):
        # each suffix goes with the first place of the prefix from its beginning on
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                whole = x["ctx"]
                cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
                begin, last = 0, len(whole) - length
                for at in np.flatnonzero(_hashes(_sums(cp), prefix).view(np.int64) == x["kh"]).tolist():
                    end = min(at, last)
                    if begin <= end:
                        out.append({**x, "key": whole[at : at + prefix], "at": at - begin, "off": begin, "ctx": whole[begin : end + length]})
                        begin = end + 1
            for k in range(0, len(out), 5000):
                yield pa.RecordBatch.from_pylist(out[k : k + 5000], batch.schema)

    cur, size, k, found = open_.mapInArrow(anchors, open_.schema).drop("kh"), prefix, 0, []
    while True:
        # entries of one prefix that are equal become one at the next level, too
        cur = ws.cut(cur, f"level{k}")
        text = cur.select("key", "at", "ctx").distinct().groupBy("key").agg(F.sum(F.length("ctx")).alias("n"))
        big = ws.cut(text.where((F.col("n") > most_signs) & F.lit(size < length)).select("key"), f"big{k}")
        some = big.limit(1).count()
        found.append(_entry_trees(cur.join(big, "key", "left_anti") if some else cur, length, kind))
        if not some:
            break
        more = -(-(length - size) // 2)
        cur, size, k = _split(cur.join(big, "key", "left_semi"), length, size, kind), size + more, k + 1
    runs = found[0]
    for f in found[1:]:
        runs = runs.unionAll(f)
    named = rows.join(once.select("kh", "ctx", "id"), ["kh", "ctx"]).select("id", "doc", "s")
    return named.join(runs.groupBy("id", "x").agg(F.max("y").alias("y")), "id").select(
        "doc", (F.col("s") + F.col("x")).cast("int").alias("a"), (F.col("s") + F.col("y")).cast("int").alias("b")
    )


def _entry_trees(cur: DataFrame, length: int, kind: str) -> DataFrame:
    """``id, x, y``: shared runs of entries ``key, id, off, lo, hi, ctx``, in
    places of the original context."""
    alike = cur.groupBy("key", "ctx").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # an entry stands for its smallest and its largest document
    two = alike.select(F.xxhash64("key").alias("kh"), F.explode(F.array_distinct(F.array("lo", "hi"))).alias("doc"), F.lit(0).alias("s"), "ctx", "key")
    tagged = two.select("kh", F.struct("key", "ctx", "doc").alias("who"), "doc", "s", "ctx")
    runs = _trees(tagged.repartition("kh").sortWithinPartitions("kh"), length, kind, "who")
    runs = runs.select("who.key", "who.ctx", F.col("a").alias("x"), F.col("b").alias("y")).distinct()
    return cur.select("key", "ctx", "id", "off").join(runs, ["key", "ctx"]).select("id", (F.col("off") + F.col("x")).alias("x"), (F.col("off") + F.col("y")).alias("y"))


def shared_runs(docs: DataFrame, key: str, text: str, length: int = LENGTH, prefix: int = PREFIX, most_signs: int = MOST_SIGNS) -> DataFrame:
    """``doc, a, b``: stretches of signs ``a <= i < b`` of a record's text, each
    of at least ``length``, that lie in other records too; they may overlap."""
    if not 0 < prefix <= length:
        raise ValueError("0 < prefix <= length")
    ws = Workspace(docs.sparkSession, "spans")
    kind = docs.schema[key].dataType.simpleString()
    src = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull() & (F.length("text") >= length))
    src = src.withColumn("th", F.xxhash64("text"))
    seen = _scan(src, length, prefix, False).groupBy("kh").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    keys = ws.cut(seen.where("lo < hi").select("kh"), "prefixes")
    # places go to their prefix without text; those that stay go to their document
    places = _scan(src, length, prefix, True).join(keys, "kh")
    places = places.groupBy("doc", "th").agg(F.array_distinct(F.collect_list(F.struct("kh", "s", "e"))).alias("places"))
    rows = ws.cut(_cut(src.join(places, ["doc", "th"]), kind), "contexts")
    big = rows.groupBy("kh").agg(F.sum(F.length("ctx")).alias("n")).where(F.col("n") > most_signs).select("kh")
    big = ws.cut(big, "big")
    some = big.limit(1).count()
    usual = rows.join(big, "kh", "left_anti") if some else rows
    out = _trees(usual.repartition("kh").sortWithinPartitions("kh"), length, kind)
    if some:
        out = out.unionAll(_long_prefixes(rows.join(big, "kh", "left_semi"), length, prefix, kind, most_signs, ws))
    return out


def _once(runs: DataFrame) -> DataFrame:
    """One run for each beginning, so that a record holds at most as many as its
    text has signs, however often it is repeated; combined map-side."""
    return runs.groupBy("doc", "a").agg(F.max("b").alias("b"))


def shared_chars(docs: DataFrame, key: str, text: str, **how) -> DataFrame:
    """``<key>, shared_chars``: for each record with a stretch of at least
    ``length`` signs that also occurs in the text of a record with another key,
    how many of its signs lie in such stretches, each counted once.

    Texts are taken whole, signs are code points, equal means code point for
    code point.  Null, empty and short texts and null keys give no row; rows of
    one key count as one record (their places are laid over each other), so a
    repeated row changes nothing.  Other columns are not read.
    """
    w = Window.partitionBy("doc").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max("b").over(w), F.lit(0))
    fresh = _once(shared_runs(docs, key, text, **how)).withColumn("n", F.greatest(F.lit(0), F.col("b") - F.greatest("a", seen)))
    return fresh.groupBy(F.col("doc").alias(key)).agg(F.sum("n").cast("bigint").alias("shared_chars"))


def spans(docs: DataFrame, key: str, text: str, **how) -> DataFrame:
    """``<key>, start, end``: the same stretches, joined where they overlap or
    touch; places count from 0, ``end`` is exclusive."""
    w = Window.partitionBy("doc").orderBy("a")
    before = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = _once(shared_runs(docs, key, text, **how)).withColumn("new", (F.col("a") > F.coalesce(before, F.lit(-1))).cast("int"))
    runs = runs.withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(F.col("doc").alias(key), "g").agg(F.min("a").alias("start"), F.max("b").alias("end")).drop("g")
