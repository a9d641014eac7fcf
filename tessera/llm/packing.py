"""Filling fixed-capacity containers: best-fit decreasing with certified bounds.

Items are hashed to partitions of bounded size and packed there by best-fit
decreasing.  Dual feasible functions give a lower bound on the number of
containers each partition needs; a partition that meets its bound is certified
and done.  One that doesn't places the items of its containers with room again,
by subset sums.  Partitions that still have a gap keep their containers without unused space and
exchange the items of all others: these are hashed anew, over fewer partitions,
and packed again, until everything is certified or one partition holds what is
left.  A repacking that needs more containers than before is dropped.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.runtime import Workspace

#: Items a task packs at a time.
PART_ITEMS = 50_000
MOST_ROUNDS = 20


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Container number of each item (sizes 1..capacity), placed from the
    largest on into the fullest open container that holds it; equal sizes in the
    order given."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    free: dict[int, list[int]] = {}
    rooms = 0  # bit r: some container has exactly r free
    out, n = [0] * len(sizes), 0
    for i in order:
        s = sizes[i]
        fit = rooms >> s
        if fit:
            r = s + (fit & -fit).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                rooms &= ~(1 << r)
        else:
            r, b, n = capacity, n, n + 1
        out[i] = b
        if r - s:
            free.setdefault(r - s, []).append(b)
            rooms |= 1 << (r - s)
    return out


def refill(sizes: list[int], capacity: int, window: int = 1000) -> list[int]:
    """Container number of each item, filled one after the other: the largest
    item left, and those of the others whose sum comes closest to the room it
    leaves (a subset sum over at most about ``window`` items spread over all
    sizes, as bits of a number)."""
    left = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    out, n = [0] * len(sizes), 0
    while left:
        seed, rest = left[0], left[1:]
        room, taken = capacity - sizes[seed], set()
        step = max(1, len(rest) // window)
        near = [i for i in rest[n % step :: step] if sizes[i] <= room]
        mask, goal, reach = (1 << (room + 1)) - 1, 1 << room, [1]
        for i in near:
            if reach[-1] & goal:
                break
            reach.append(reach[-1] | (reach[-1] << sizes[i]) & mask)
        k, total = len(reach) - 1, reach[-1].bit_length() - 1
        while total:
            while reach[k - 1] >> total & 1:
                k -= 1
            taken.add(near[k - 1])
            total -= sizes[near[k - 1]]
            k -= 1
        for i in (seed, *taken):
            out[i] = n
        left = [i for i in rest if i not in taken]
        n += 1
    return out


def lower_bound(histogram: np.ndarray, capacity: int) -> int:
    """Containers that items need at least; ``histogram[s]`` items of size
    ``s``, 1..capacity.  The best of two families of dual feasible functions:
    sizes over ``capacity - k`` count whole and those under ``k`` nothing, and
    sizes rounded to multiples of ``capacity / (k + 1)``."""
    h = np.zeros(capacity + 1, np.int64)
    h[: len(histogram)] = histogram[: capacity + 1]
    s = np.arange(capacity + 1, dtype=np.int64)
    n, total = np.cumsum(h), np.cumsum(h * s)
    k = np.arange(0, capacity // 2 + 1)
    whole = n[-1] - n[capacity - k]
    middle = total[capacity - k] - np.where(k > 0, total[np.maximum(k - 1, 0)], 0)
    best = int(np.max(-(-(whole * capacity + middle) // capacity)))
    for k in range(1, min(100, capacity) + 1):
        exact = (s * (k + 1)) % capacity == 0
        # in units of 1 / (k * capacity)
        value = np.where(exact, s * k, (s * (k + 1)) // capacity * capacity)
        best = max(best, -(-int((value * h).sum()) // (k * capacity)))
    return best


def _pack(items: DataFrame, parts: int, seed: int, capacity: int) -> DataFrame:
    """Items with ``part``, ``bin``, ``fill`` of the bin and whether the
    partition's number of bins is ``certified``."""
    kind = items.schema["item"].dataType
    schema = T.StructType(
        [
            T.StructField("item", kind), T.StructField("row", T.LongType()), T.StructField("first", T.LongType()), T.StructField("size", T.IntegerType()),
            T.StructField("part", T.IntegerType()), T.StructField("bin", T.IntegerType()), T.StructField("fill", T.IntegerType()),
            T.StructField("certified", T.BooleanType()),
        ]
    )

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "row"], ascending=[False, True]).reset_index(drop=True)
        size = pdf["size"].to_numpy()
        bins = np.array(best_fit_decreasing(size.tolist(), capacity), np.int32)
        fill = np.bincount(bins, weights=size).astype(np.int32)
        need = lower_bound(np.bincount(size), capacity)
        if len(fill) > need:
            # a gap: the items of all containers with room are placed again
            loose = np.flatnonzero(fill[bins] < capacity)
            again = np.array(refill(size[loose].tolist(), capacity), np.int32)
            open_ = np.unique(bins[loose])
            if again.max(initial=-1) + 1 < len(open_):
                bins[loose] = open_[again]
                _, bins = np.unique(bins, return_inverse=True)
                bins = bins.astype(np.int32)
                fill = np.bincount(bins, weights=size).astype(np.int32)
        return pdf.assign(bin=bins, fill=fill[bins], certified=len(fill) == need)[[f.name for f in schema]]

    # by row, not by key: repeated keys must not meet in one partition
    spread = items.select("item", "row", "first", "size", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(parts)).cast("int").alias("part"))
    return spread.groupBy("part").applyInPandas(pack, schema)


def containers(items: DataFrame, key: str, size: str, capacity: int, part_items: int = PART_ITEMS) -> DataFrame:
    """``container`` (string), ``<key>``, ``first_token``, ``n_tokens``: every
    unit of every item in exactly one container of ``capacity`` units.

    An item is split only if it exceeds the capacity; then all its parts but the
    last fill a container each, and the last is packed with the others.  Items
    of size null or 0 have nothing to place and give no row.  Keys may be null
    or repeat; each row is an item.  Other columns are ignored.
    """
    ws = Workspace(items.sparkSession, "packing")
    src = items.select(F.col(key).alias("item"), F.col(size).cast("long").alias("n")).where("n > 0")
    src = ws.cut(src.withColumn("row", F.monotonically_increasing_id()), "items")
    whole = (
        src.where(F.col("n") >= capacity)
        .select("item", "row", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / capacity) - 1)).alias("k"))
        .select(
            F.concat_ws(".", F.lit("w"), "row", "k").alias("container"), "item",
            (F.col("k") * capacity).alias("first_token"), F.lit(capacity).alias("n_tokens"),
        )
    )
    pool = src.select(
        "item", "row", (F.floor(F.col("n") / capacity) * capacity).alias("first"), F.pmod("n", F.lit(capacity)).cast("int").alias("size")
    ).where("size > 0")
    out, old, n = [whole], None, pool.count()
    for k in range(MOST_ROUNDS):
        if not n:
            break
        parts = math.ceil(n / part_items)
        done = ws.cut(_pack(pool, parts, k, capacity), f"round{k}")
        named = done.withColumn("container", F.concat_ws(".", F.lit(f"r{k}"), "part", "bin"))
        used = named.select("container").distinct().count()
        if old is not None and used > old[1]:
            out.append(old[0])
            break
        keep = F.lit(True) if parts == 1 else F.col("certified") | (F.col("fill") == capacity)
        out.append(_placed(named.where(keep)))
        rest = named.where(~keep)
        before, n = n, rest.count()
        old = (_placed(rest), rest.select("container").distinct().count())
        pool = rest.select("item", "row", "first", "size")
        if n == before and parts == math.ceil(n / part_items) and k:
            out.append(old[0])
            break
    else:
        out.append(old[0])
    res = out[0]
    for o in out[1:]:
        res = res.unionAll(o)
    return res.withColumnRenamed("item", key)


def _placed(df: DataFrame) -> DataFrame:
    return df.select("container", "item", F.col("first").alias("first_token"), F.col("size").alias("n_tokens"))


def report(placed: DataFrame, capacity: int) -> DataFrame:
    """One row: ``containers``, ``tokens``, ``least`` (a lower bound on the
    containers of all items, from the histogram of their sizes) and ``unused``
    (share of the containers' space)."""
    hist = placed.groupBy("n_tokens").count().collect()  # at most ``capacity`` rows
    h = np.zeros(capacity + 1, np.int64)
    for r in hist:
        h[r["n_tokens"]] = r["count"]
    least = lower_bound(h, capacity)
    return placed.agg(F.countDistinct("container").alias("containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).select(
        "containers", "tokens", F.lit(least).cast("bigint").alias("least"),
        F.when(F.col("containers") > 0, 1 - F.col("tokens") / (F.col("containers") * capacity)).otherwise(0.0).alias("unused"),
    )
