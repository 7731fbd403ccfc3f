"""Centroids of a collection of vectors, fitted on a bounded sample; used by the vector operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialise


def distances2(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of the rows of ``x`` to those of ``c``, both centred on ``c`` for precision."""
    middle = c.mean(0)
    x, c = x - middle, c - middle
    d = (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * (x @ c.T)
    return np.maximum(d, 0, out=d)


def spread_out(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` rows of ``x``, each drawn with a chance in proportion to its squared distance from those before it.

    That distance counts as no more than three times the median, so that stray vectors don't take most draws.
    """
    picked = [int(rng.integers(len(x)))]
    near = distances2(x, x[picked])[:, 0]
    most = np.inf
    while len(picked) < k:
        if len(picked) % 16 == 1:
            most = 9 * np.median(near) or np.inf
        chance = np.cumsum(np.minimum(near, most), dtype=np.float64)
        if chance[-1] <= 0:
            break  # fewer than k distinct rows
        i = int(np.searchsorted(chance, rng.random() * chance[-1], side="right"))
        i = min(i, len(x) - 1)
        picked.append(i)
        near = np.minimum(near, ((x - x[i]) ** 2).sum(1))
    return x[picked]


def fit(x: np.ndarray, k: int, rounds: int = 5, seed: int = 7, largest: float | None = None) -> np.ndarray:
    """At most ``k`` k-means centroids of ``x``, begun from rows drawn apart from each other (beyond 512 at random); with ``largest``, groups of more than that share of ``x`` are then split in two until none is left."""
    rng = np.random.default_rng(seed)
    x = np.ascontiguousarray(x, np.float32)
    c = spread_out(x, min(k, len(x)), rng) if k <= 512 else x[rng.choice(len(x), min(k, len(x)), replace=False)]
    near = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        for a in range(0, len(x), 8192):
            near[a : a + 8192] = distances2(x[a : a + 8192], c).argmin(1)
        count = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])], 1)
        c = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], c).astype(np.float32)
    if largest is None:
        return c
    done, todo = [], [np.flatnonzero(near == i) for i in range(len(c))]
    while todo:
        rows = todo.pop()
        if not len(rows):
            continue
        two = fit(x[rows], 2, 4, seed) if len(rows) > max(8, largest * len(x)) else None
        side = distances2(x[rows], two).argmin(1) if two is not None and len(two) == 2 else None
        if side is None or not side.any() or side.all():
            done.append(x[rows].mean(0))
        else:
            todo += [rows[side == 0], rows[side == 1]]
    return np.array(done, np.float32)


def sample(df: DataFrame, vector: str, most: int, rows: int, seed: int = 7) -> np.ndarray:
    """About ``most`` vectors (never more than twice that) of a table with ``rows`` rows, the same ones at every run."""
    share = min(1.0, most / max(rows, 1))
    mark = F.pmod(F.xxhash64(vector, F.lit(seed)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)
    found = df.where(mark).select(vector).limit(2 * most).toPandas()[vector]
    return np.array(list(found), np.float32) if len(found) else np.zeros((0, 0), np.float32)


#: Tables of at most so many rows, which are counted first, are broadcast.
FEW = 500_000


def few(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has FEW rows or fewer."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def sound_vectors(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """``key`` and ``v`` (array<float>), one row per key: vectors of ``dim`` finite numbers; others and null keys are left out.

    Of several sound vectors of one key the first in the order of arrays is taken.  Only rows of keys
    that come more than once are shuffled with their vectors, as long as those keys are few.
    """
    v = F.col(vector).cast("array<float>")
    whole = F.col(key).isNotNull() & (F.size(vector) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.col(vector).isNotNull()).where(whole).select(key, v.alias("v"))
    twice = few(materialise(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(key), "twice"))
    first = rows.join(twice, key, "left_semi").groupBy(key).agg(F.min("v").alias("v"))
    return rows.join(twice, key, "left_anti").select(key, "v").unionByName(first)
