"""The k most similar vectors of every vector, by an index of balanced posting lists.

Centroids are fitted on a bounded sample and those of crowded regions split, so
that the lists around them are balanced.  A vector is posted in the list of its nearest
centroid and, if it lies near a boundary, in others too.  To find
centroids, all are compared, or where they are very many, a graph over them is searched in memory.  A query reads the lists of the
centroids that are not much farther than the nearest (distance-ratio pruning).

How many lists are read is not guessed.  With a radius, a vector is posted in every list whose boundary lies within
the radius, so that the nearest list of a query holds all it can find.  Without one, the nearest vectors of some queries are
searched for among all vectors, and the cheapest limits are taken that find the wanted share of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.centroids import distances2, few, fit, sample, sound_vectors
from tessera.session import discard, materialise
from tessera.sources.tables import table

#: Distinct vectors for each list, greatest number of lists (their centroids are broadcast; lists grow beyond), rows of the sample the centroids are fitted on and least number of them for a list.
LIST_ROWS, MOST_LISTS, SAMPLE, LIST_SAMPLE = 2000, 65_536, 50_000, 8
#: Without a radius, a vector is posted in at most COPIES lists whose centroids are at most POST times as far as the nearest one.
POST, COPIES = 1.1, 4
#: Queries that are answered exactly to find out how many lists must be read.
TRIED = 512
#: Lists that a query reads in any case: its nearest one may hold nothing but the query itself.
LEAST_READ = 2
#: Centroids that are looked at for every vector; where more are wanted, all are.
LOOKED_AT = 16
#: Up to so many centroids are all compared with a row, which costs less than the graph and misses none.
COMPARED = 8192
#: Largest part of a list that one task compares with as many queries; longer lists are cut into such parts.
BLOCK = 8192


class CentroidGraph:
    """A graph over centroids, searched from a few entry points by following the closest ones."""

    def __init__(self, centroids: np.ndarray, floor: float = 1e-9, degree: int = 16):
        self.c = np.ascontiguousarray(centroids, np.float32)
        self.floor = floor  # no vector counts as nearer to a centroid than this, so that one that is itself a centroid reads more than its own list
        k = len(self.c)
        self.whole = k <= COMPARED
        if self.whole:
            return
        rng = np.random.default_rng(1)
        near = min(degree, k - 1)
        links = []
        for a in range(0, k, 1024):
            d = distances2(self.c[a : a + 1024], self.c)
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
            links.append(np.argpartition(d, near - 1, 1)[:, :near] if near else np.zeros((len(d), 0), np.int64))
        far = rng.integers(0, k, (k, 2 if k > 2 else 0))  # long links keep the graph in one piece
        self.links = np.concatenate([np.concatenate(links), far], 1)
        self.entries = rng.choice(k, min(k, max(16, int(np.sqrt(k)) * 2)), replace=False)

    def search(self, x: np.ndarray, want: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and distances of about the ``want`` closest centroids of each row of ``x``, closest first."""
        if self.whole:
            ids = np.argpartition(distances2(x, self.c), want - 1, 1)[:, :want]
            d = np.sqrt(((self.c[ids] - x[:, None]) ** 2).sum(2))
            order = np.lexsort((ids, d), axis=1)
            return np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
        width = min(len(self.c), max(want, 16))
        d = distances2(x, self.c[self.entries])
        first = np.argpartition(d, min(width, d.shape[1]) - 1, 1)[:, : min(width, d.shape[1])]
        ids, dist = self.entries[first], np.take_along_axis(d, first, 1)
        done = np.zeros(ids.shape, bool)
        active = np.arange(len(x))
        out_ids = np.zeros((len(x), width), np.int64)
        out_d = np.full((len(x), width), np.inf, np.float32)
        while len(active):
            todo = np.where(done, np.inf, dist)
            pick = np.argsort(todo, 1)[:, :wide]
            fresh = np.take_along_axis(todo, pick, 1) < np.inf
            np.put_along_axis(done, pick, np.take_along_axis(done, pick, 1) | fresh, 1)
            new = self.links[np.take_along_axis(ids, pick, 1)].reshape(len(active), -1)
            diff = self.c[new]
            diff -= x[active][:, None, :]
            d_new = np.einsum("bmd,bmd->bm", diff, diff)
            d_new[np.repeat(~fresh, self.links.shape[1], 1)] = np.inf
            ids, dist = np.concatenate([ids, new], 1), np.concatenate([dist, d_new], 1)
            done = np.concatenate([done, np.zeros(new.shape, bool)], 1)
            order = np.lexsort((~done, ids), axis=1)  # of the same centroid, one already followed comes first
            ids, dist, done = (np.take_along_axis(z, order, 1) for z in (ids, dist, done))
            dist[:, 1:][ids[:, 1:] == ids[:, :-1]] = np.inf
            best = np.argsort(dist, 1)[:, :width]
            ids, dist, done = (np.take_along_axis(z, best, 1) for z in (ids, dist, done))
            more = (~done & (dist < np.inf)).any(1)
            ended = ~more
            out_ids[active[ended], : ids.shape[1]], out_d[active[ended], : ids.shape[1]] = ids[ended], dist[ended]
            active, ids, dist, done = active[more], ids[more], dist[more], done[more]
        return out_ids[:, :want], np.sqrt(out_d[:, :want])


def _reached(c: np.ndarray, x: np.ndarray, asks: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The flags of all centroids for each row: the row is posted wherever the plane midway to its nearest centroid lies within the radius."""
    d2 = distances2(x, c)
    first = d2.argmin(1)
    row = np.arange(len(x))
    some, of = np.unique(first, return_inverse=True)
    bound = np.sqrt(distances2(c[some], c)) * np.float32(2 * radius * (1 + 1e-4))
    middle = c.mean(0)
    rounding = 1e-5 * (((x - middle) ** 2).sum(1) + ((c - middle) ** 2).sum(1).max())  # more than single precision errs by
    flags = (d2 - (d2[row, first] + 1e-4 + rounding)[:, None].astype(np.float32) <= bound[of]).view(np.int8)
    flags[row, first] = 1 + 2 * asks
    return np.broadcast_to(np.arange(len(c)), d2.shape), flags


def _flags(graph: CentroidGraph, x: np.ndarray, asks: np.ndarray, limits: tuple[int, float], radius: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of centroids near each row of ``x``, and for each 1 if its list holds the row, 2 if it is read for it, 3 for both."""
    want = min(LOOKED_AT, len(graph.c))
    if radius is not None and graph.whole:
        return _reached(graph.c, x, asks, radius)
    ids, d = graph.search(x, want)
    if radius is None:
        probes, read = limits
        if probes > want:
            d = np.sqrt(distances2(x, graph.c))
            ids = np.argsort(d, 1, kind="stable")[:, :probes]
            d = np.take_along_axis(d, ids, 1)
        ratio = d / np.maximum(d[:, :1], graph.floor)
        ratio[:, 0] = 1
        rank = np.arange(ids.shape[1])[None]
        return ids, ((ratio <= POST) & (rank < COPIES)) + 2 * (((ratio <= read) | (rank < LEAST_READ)) & (rank < probes) & asks[:, None])

    def reached(ids: np.ndarray, d: np.ndarray, first: np.ndarray) -> np.ndarray:
        # How far beyond the plane midway between both centroids the row lies; what is within the radius of it may lie on the other side.
        apart = np.sqrt(((graph.c[ids] - graph.c[first][:, None]) ** 2).sum(2))
        return d**2 - d.min(1, keepdims=True) ** 2 <= 2 * radius * apart * (1 + 1e-4) + 1e-4

    flags = reached(ids, d, ids[:, 0]).astype(np.int64)
    more = np.flatnonzero(flags[:, -1]) if want < len(graph.c) else np.zeros(0, np.int64)
    if len(more):  # perhaps in more lists than were looked at
        d2 = np.sqrt(distances2(x[more], graph.c))
        everywhere = np.argsort(d2, 1, kind="stable")
        wide = reached(everywhere, np.take_along_axis(d2, everywhere, 1), everywhere[:, 0]).astype(np.int64)
        width = max(want, int(wide.sum(1).max()) + 1)
        grown_ids, grown = np.zeros((len(x), min(width, len(graph.c))), np.int64), np.zeros((len(x), min(width, len(graph.c))), np.int64)
        grown_ids[:, :want], grown[:, :want] = ids, flags
        order = np.argsort(-wide, 1, kind="stable")[:, : grown.shape[1]]
        grown_ids[more], grown[more] = np.take_along_axis(everywhere, order, 1), np.take_along_axis(wide, order, 1)
        ids, flags = grown_ids, grown
    flags[:, 0] = 1 + 2 * asks
    return ids, flags


def _posted(rows: DataFrame, centroids: np.ndarray, floor: float, limits: tuple[int, float], radius: float | None) -> DataFrame:
    """Rows (vid, v, asks) as (list, flags, vid, v), v being the vector's bytes: flag 1, the list holds the vector; flag 2, it is asked for its neighbours."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)  # at most MOST_LISTS vectors, before splits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = CentroidGraph(shared.value, floor)
        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                batch = whole.slice(a, 2048)
                n = batch.num_rows
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float32)
                asks = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
                ids, flags = _flags(graph, x, asks, limits, radius)
                r, k = np.nonzero(flags)
                ends = np.arange(len(r) + 1, dtype=np.int32) * (x.itemsize * x.shape[1])
                raw = pa.Array.from_buffers(pa.binary(), len(r), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x[r]))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[r, k].astype(np.int32)), pa.array(flags[r, k].astype(np.int8)), batch.column(0).take(pa.array(r)), raw], names=["list", "flags", "vid", "v"]
                )

    return rows.select("vid", "v", "asks").mapInArrow(run, "list int, flags tinyint, vid bigint, v binary")


def nearest_of_some(vectors: DataFrame, k: int, some: int = TRIED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of some queries, chosen by hash, and which of them the rows of a second array, their k nearest vectors, belong to; found in one pass over all vectors."""
    drawn = vectors.orderBy(F.xxhash64("v", F.lit(11)), "vid").limit(some).select("vid", "v").toPandas()
    q_id, q = drawn["vid"].to_numpy(np.int64), np.array(list(drawn["v"]), np.float32)
    shared = vectors.sparkSession.sparkContext.broadcast((q_id, q))  # `some` vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).to_numpy()
            y = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float32)
            d2 = distances2(x, y)
            d2[ids[:, None] == names[None]] = np.inf
            near = np.argpartition(d2, min(k, len(names)) - 1, 1)[:, : min(k, len(names))]
            r, c = np.nonzero(np.take_along_axis(d2, near, 1) < np.inf)
            c = near[r, c]
            yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), batch.column(1).take(pa.array(c)), pa.array(d2[r, c].astype(np.float64))], names=["q", "v", "d2"])

    first = Window.partitionBy("q").orderBy("d2", "v")
    found = vectors.select("vid", "v").mapInArrow(run, "q int, v array<float>, d2 double").withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).select("q", "v").toPandas()
    return q, found["q"].to_numpy(np.int64), np.array(list(found["v"]), np.float32)


def read_limits(centroids: np.ndarray, floor: float, q: np.ndarray, of: np.ndarray, near: np.ndarray, recall: float) -> tuple[int, float]:
    """How many lists and to which distance ratio a query must read to find the share ``recall`` of its nearest vectors, at the least cost."""
    graph = CentroidGraph(centroids, floor)
    d = np.sqrt(distances2(q, centroids))
    order = np.argsort(d, 1, kind="stable")
    rank_of = np.empty_like(order)
    np.put_along_axis(rank_of, order, np.arange(len(centroids))[None], 1)
    ratio = d / np.maximum(d.min(1, keepdims=True), floor)
    ratio[np.arange(len(q)), order[:, 0]] = 1
    ids, flags = _flags(graph, near, np.zeros(len(near), bool), (1, 1.0), None)
    rank = np.where(flags > 0, np.take_along_axis(rank_of[of], ids, 1), len(centroids))
    at = rank.argmin(1)
    rank, far = rank[np.arange(len(of)), at], ratio[of, ids[np.arange(len(of)), at]]
    best = None
    probes = min(LEAST_READ, len(centroids))
    while best is None or probes < 2 * len(centroids):
        probes = min(probes, len(centroids))
        inside = rank < probes
        if inside.mean() >= recall:
            read = float(np.sort(np.where(inside, far, np.inf))[min(len(far) - 1, int(np.ceil(recall * len(far))) - 1)]) * 1.001
            cost = float(((ratio <= read).sum(1).clip(LEAST_READ, probes)).mean())
            if best is None or cost < best[0]:
                best = (cost, probes, read)
        if probes == len(centroids):
            break
        probes = max(probes + 1, probes * 5 // 4)
    return best[1], best[2]


def _with_norm(x: np.ndarray, first: bool) -> np.ndarray:
    """Two more columns, so that the product of a row with one of the other kind is minus half their squared distance."""
    half, one = -0.5 * (x * x).sum(1, keepdims=True), np.ones((len(x), 1), x.dtype)
    return np.concatenate([x, half, one] if first else [x, one, half], 1)


def _of_pairs(q: np.ndarray, p: np.ndarray, q_id: np.ndarray, p_id: np.ndarray, r: np.ndarray, c: np.ndarray, k: int, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs (r, c) of a query and a vector within ``radius``, the k nearest of each query."""
    exact = np.sqrt(((q[r].astype(np.float64) - p[c]) ** 2).sum(1))
    keep = (exact <= radius) & (q_id[r] != p_id[c])
    r, n_id, exact = r[keep], p_id[c[keep]], exact[keep]
    order = np.lexsort((n_id, exact, r))
    r, n_id, exact = r[order], n_id[order], exact[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    first = place < k
    return q_id[r[first]], n_id[first], exact[first]


def _compare(k: int, radius: float | None):
    def run(group: pa.Table) -> pa.Table:
        vid = group.column("vid").to_numpy()
        flags = group.column("flags").to_numpy()
        x = np.frombuffer(b"".join(group.column("v").to_pylist()), np.float32).reshape(len(vid), -1)
        held, asked = np.flatnonzero(flags & 1), np.flatnonzero(flags & 2)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        p, p_id = x[held], vid[held]
        top = min(k + 4, len(held))  # the extra ones outweigh the rounding of single precision
        middle = p.mean(0) if top else 0
        p_ = _with_norm(p - middle, first=False) if top else p
        for a in range(0, len(asked) if top else 0, 1024):
            q, q_id = x[asked[a : a + 1024]], vid[asked[a : a + 1024]]
            q_ = _with_norm(q - middle, first=True)
            half = q_ @ p_.T  # minus half the squared distance
            if radius is not None:
                slack = 1e-6 - 4e-6 * float(q_[:, -2].min() + p_[:, -1].min())  # more than single precision errs by
                close = half >= -0.5 * radius * radius - slack
                if np.count_nonzero(close) <= 16 * len(q):
                    found.append(_of_pairs(q, p, q_id, p_id, *np.nonzero(close), k, radius))
                    continue
            half[q_id[:, None] == p_id[None]] = -np.inf
            near = np.argpartition(half, len(p) - top, 1)[:, len(p) - top :]
            exact = np.sqrt(((q[:, None].astype(np.float64) - p[near]) ** 2).sum(2))
            n_id = p_id[near]
            keep = n_id != q_id[:, None]
            if radius is not None:
                keep &= exact <= radius
            exact = np.where(keep, exact, np.inf)
            order = np.lexsort((n_id, exact), axis=1)[:, :k]
            exact, n_id = np.take_along_axis(exact, order, 1), np.take_along_axis(n_id, order, 1)
            r, c = np.nonzero(exact < np.inf)
            found.append((q_id[r], n_id[r, c], exact[r, c]))
        out = [np.concatenate(z) for z in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"vid": out[0].astype(np.int64), "nid": out[1].astype(np.int64), "d": out[2].astype(np.float64)})

    return run


def between_distinct(vectors: DataFrame, k: int, radius: float | None = None, recall: float = 0.97) -> DataFrame:
    """(vid, nid, d): the k nearest other vectors of every asked vector; ``vectors`` (vid, v, asks), a table, are distinct."""
    n = vectors.count()
    lists = max(1, min(n // LIST_ROWS, MOST_LISTS))
    seen = sample(vectors, "v", max(SAMPLE, LIST_SAMPLE * lists), n)
    if not len(seen):
        return vectors.select("vid", F.col("vid").alias("nid"), F.lit(0.0).alias("d")).limit(0)
    centroids = fit(seen, lists, rounds=4, largest=3 / lists if lists > 1 else None)
    some = seen[:: max(1, len(seen) // 4096)]
    limits, floor = (1, 1.0), max(float(np.sqrt(np.median(distances2(some, centroids).min(1)))), 1e-9)  # the usual distance to the nearest
    if radius is None and len(centroids) > 1:
        limits = read_limits(centroids, floor, *nearest_of_some(vectors, k), recall) if recall < 1 else (len(centroids), float("inf"))
    posted = materialise(_posted(vectors, centroids, floor, limits, radius), "lists")
    # One row a list, so its number is bounded: into how many parts the list and its queries are cut.
    size = posted.groupBy("list").agg(F.sum((F.col("flags").bitwiseAND(1) > 0).cast("long")).alias("held"), F.sum((F.col("flags").bitwiseAND(2) > 0).cast("long")).alias("asked"))
    cut = size.select("list", *[F.ceil(F.col(c) / BLOCK).cast("int").alias(f"{c}_parts") for c in ("held", "asked")])
    parts = posted.join(F.broadcast(cut), "list")
    some = lambda c: F.pmod(F.xxhash64("vid"), F.greatest(F.col(f"{c}_parts"), F.lit(1))).cast("int")
    every = lambda c: F.sequence(F.lit(0), F.greatest(F.col(f"{c}_parts"), F.lit(1)) - 1)
    single = (F.col("held_parts") <= 1) & (F.col("asked_parts") <= 1)
    whole = F.array(F.struct(F.col("flags"), F.lit(0).alias("h"), F.lit(0).alias("a")))
    as_held = F.transform(every("asked"), lambda a: F.struct(F.lit(1).cast("tinyint").alias("flags"), some("held").alias("h"), a.alias("a")))
    as_asked = F.transform(every("held"), lambda h: F.struct(F.lit(2).cast("tinyint").alias("flags"), h.alias("h"), some("asked").alias("a")))
    empty = F.slice(whole, 1, 0)
    cut_up = F.concat(F.when(F.col("flags").bitwiseAND(1) > 0, as_held).otherwise(empty), F.when(F.col("flags").bitwiseAND(2) > 0, as_asked).otherwise(empty))
    blocks = parts.withColumn("_b", F.explode(F.when(single, whole).otherwise(cut_up))).select("list", "_b.h", "_b.a", "_b.flags", "vid", "v")
    pairs = blocks.groupBy("list", "h", "a").applyInArrow(_compare(k, radius), "vid bigint, nid bigint, d double")
    first = Window.partitionBy("vid").orderBy("d", "nid")
    best = pairs.dropDuplicates(["vid", "nid"]).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).drop("_r")
    best = materialise(best, "nearest")
    discard(posted)
    return best


def _prints(v: str) -> list[Column]:
    """128 bits that stand for a vector in joins, in place of its numbers."""
    return [F.xxhash64(v).alias("_p1"), F.xxhash64(F.lit(1), v).alias("_p2")]


def distinct_vectors(rows: DataFrame) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """A table (vid, v, ...) of the distinct vectors of the table ``rows`` (cell, v, ...), and a function that gives the vid of every row in place of its vector."""
    rest = [c for c in rows.columns if c not in ("cell", "v")]
    same = ["_p1", "_p2"]
    marked = rows.select("cell", *rest, *_prints("v"))
    named = marked.groupBy(*same).agg(F.min("cell").alias("_vid"), F.count(F.lit(1)).alias("_n"), *[F.max(c).alias(c) for c in rest]).where(F.col("_n") > 1)
    copied = few(materialise(named, "copied"))
    printed = rows.select("cell", "v", *rest, *_prints("v"))
    alone = printed.join(copied.select(*same), same, "left_anti").select("v", F.col("cell").alias("vid"), *rest)
    first = printed.select("cell", "v", *same).join(copied, same).where(F.col("cell") == F.col("_vid")).select("v", F.col("cell").alias("vid"), *rest)
    groups = materialise(alone.unionByName(first), "distinct")

    def members() -> DataFrame:
        """A vector of very many copies is a hot key here; few that have copies are broadcast, else adaptive execution splits the hot partition."""
        own = copied.select(*same, "_vid")
        return marked.join(own, same, "left").select("cell", F.coalesce("_vid", "cell").alias("vid"), F.col("_vid").isNotNull().alias("copied"), *rest)

    return groups, members


def nearest(df: DataFrame, key: str, vector: str, k: int = 5, dim: int = 30, radius: float | None = None, asked: Column | None = None, recall: float = 0.97) -> DataFrame:
    """``key``, ``neighbour``, ``distance`` and ``rnk`` (1 to k) of the k rows with the nearest vectors, for every row.

    Distance is Euclidean, computed in double precision; of equal distances the
    smaller key is nearer.  With ``radius``, neighbours farther than it are
    left out.  With ``asked``, only rows for which it holds are given neighbours, which come from all rows.
    ``key`` is an integer.  Rows count that have a key and a vector of ``dim``
    finite numbers; each key counts once.  Identical vectors are indexed once, whatever their number, and
    find each other exactly.  Between different vectors nothing within a radius is missed, as far as the graph finds the nearest
    centroid; without one the share ``recall`` of the neighbours is found, as measured on TRIED queries against all
    vectors, and all of them with ``recall=1``, for which every list is read.  An empty table gives no rows;
    a single row has no neighbours.
    """
    asks = F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))
    rows = sound_vectors(df, key, vector, dim).select(F.col(key).alias("cell"), "v", asks.alias("asks"))
    rows = materialise(rows, "vectors")
    groups, members = distinct_vectors(rows)
    between = between_distinct(groups.select("vid", "v", "asks"), k, radius, recall)

    named = materialise(members(), "members")
    by_key = Window.partitionBy("vid").orderBy("cell")
    lowest = materialise(named.where("copied").withColumn("_r", F.row_number().over(by_key)).where(F.col("_r") <= k + 1).select("vid", "cell"), "lowest")
    of_group = lowest.groupBy(F.col("vid").alias("nid")).agg(F.collect_list("cell").alias("_ids"))  # k + 1 at most
    others = between.join(of_group, "nid", "left").select("vid", "d", F.explode(F.coalesce("_ids", F.array("nid"))).alias("id"))
    near = others.unionByName(lowest.select("vid", F.lit(0.0).alias("d"), F.col("cell").alias("id")))
    first = Window.partitionBy("vid").orderBy("d", "id")
    near = near.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1)
    near = materialise(near.groupBy("vid").agg(F.sort_array(F.collect_list(F.struct("d", "id"))).alias("_near")), "near")
    found = named.where("asks").join(near, "vid")
    own = F.slice(F.filter("_near", lambda x: x["id"] != F.col("cell")), 1, k)
    out = found.select("cell", F.posexplode(own).alias("_p", "_x"))
    return out.select(F.col("cell").alias(key), F.col("_x.id").alias("neighbour"), F.col("_x.d").alias("distance"), (F.col("_p") + 1).cast("int").alias("rnk"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of cells at a distance of at most 1, one of them among the five nearest of the other."""
    rows = table(spark, root, "reduceddims").select("cell_id", "iterativelsi")
    near = nearest(rows, "cell_id", "iterativelsi", 5, radius=1.0)
    return near.select(F.least("cell_id", "neighbour").alias("cell_id1"), F.greatest("cell_id", "neighbour").alias("cell_id2")).distinct()


def p3_neighbours(spark: SparkSession, root: str) -> DataFrame:
    """The five nearest of all cells for every cell whose id is divisible by 20."""
    rows = table(spark, root, "reduceddims").select("cell_id", "iterativelsi")
    return nearest(rows, "cell_id", "iterativelsi", 5, asked=F.col("cell_id") % 20 == 0)


QUERIES = {"p3_found": p3_found, "p3_neighbours": p3_neighbours}

SQL: dict[str, str] = {}
