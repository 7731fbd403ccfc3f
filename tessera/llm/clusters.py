"""Grouping vectors into populations by Markov clustering of a similarity graph of all records.

Records that lie close together are contracted first: all distinct vectors are dealt
to cells of space, and each cell is halved again and again until its leaves hold at most
LEAF rows, no row lies far from the middle of its leaf, and no leaf has a gap through it.
So every record is in a leaf, the number of leaves grows with the records, and two populations
that a gap parts are never in one leaf.  A leaf is linked to the leaves beside it (found by the
neighbour index) by its rows that are about as near to them.

On this sparse matrix expansion (squaring, as a join and a sum), inflation and pruning of small
entries alternate until the flow stands still; the attractor in which a leaf's flow ends is its
cluster.  Clusters that keep a good share of their links to each other are the nodes of a next, smaller matrix,
until no such links are left, so that large populations come out whole (but a thread-like one, whose leaves
follow each other in a row, in pieces).
A matrix of few entries, which any comes to in the end, goes through its rounds and levels in one task, since jobs for
its rounds would cost the driver far more than their work; the steps are the same.
The rows of the leaves of strongest flow represent a cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.centroids import distances2, fit, sample, sound_vectors
from tessera.llm.neighbours import between_distinct, distinct_vectors
from tessera.session import discard, materialise
from tessera.sources.tables import latest, table

#: Rows for each cell of space, rows of the sample that the cells' centroids are fitted on, and rows of a cell that one task halves; larger cells are cut by hash.
CELL_ROWS, SAMPLE, BLOCK = 4000, 50_000, 8192
#: Rows of a leaf, and leaves beside it that it may be linked to.
LEAF, BESIDE = 64, 8
#: A leaf is split if its halves lie further apart than GAP times the spread of both along the line between them; fewer than GAP_ROWS rows only if they lie APART times the radius of the wider half apart.
GAP, GAP_ROWS, APART = 1.0, 16, 1.8
#: A row is near a leaf if it is at most so many times as far from it as from its own.
NEAR = 1.5
#: A row farther from every leaf of a population than so many times the median distance of a row to its leaf belongs to none.
FAR = 3.0
#: Rows closer to each other than this share of their leaf's median are taken for copies; a population has LEAST_ROWS rows that aren't.
COPY, LEAST_ROWS = 0.1, 8
#: Inflation of the flow; entries below this share of the largest of their column are pruned.
INFLATION, PRUNE = 2.0, 0.05
#: Links between clusters count if they are this share of all links of either of them.
CUT = 0.02
#: The flow has stood still long before; if not, that is an error.
MOST_ROUNDS = 500
#: A graph of at most so many links is clustered in one task, unless a round of its flow has more than so many products; so many of them are listed at once.
LINKS, PRODUCTS, LISTED = 1 << 20, 1 << 25, 1 << 20


def _halves(x: np.ndarray, rounds: int = 8) -> np.ndarray | None:
    """Side of each row of ``x`` when it is cut in two around two means, begun from rows far apart; None if it can't be cut."""
    a = x[((x - x.mean(0)) ** 2).sum(1).argmax()]
    b = x[((x - a) ** 2).sum(1).argmax()]
    side = None
    for _ in range(rounds):
        new = x @ (b - a) > (a + b) @ (b - a) / 2
        if new.all() or not new.any():
            return side
        if side is not None and (new == side).all():
            break
        side = new
        b, a = x[side].mean(0), x[~side].mean(0)
    return side


def _parted(x: np.ndarray, side: np.ndarray) -> bool:
    """Whether a gap lies between the two sides of ``x``."""
    a, b = x[~side].mean(0), x[side].mean(0)
    between = np.sqrt(((b - a) ** 2).sum())
    along = x @ ((b - a) / max(between, 1e-12))
    low, high = along[~side], along[side]
    if high.min() - low.max() <= GAP * (low.std() + high.std()):
        return False
    if len(x) >= GAP_ROWS:
        return True
    wide = max(((x[side] - b) ** 2).sum(1).mean(), ((x[~side] - a) ** 2).sum(1).mean())
    return between > APART * np.sqrt(wide)


def without_copies(x: np.ndarray, radius: float) -> np.ndarray:
    """Rows of ``x`` in order, less those within ``radius`` of one before them."""
    d2 = distances2(x, x) if len(x) > 1 else np.zeros((len(x), len(x)))
    left, out = np.ones(len(x), bool), []
    for i in range(len(x)):
        if left[i]:
            out.append(i)
            left &= d2[i] > radius * radius
    return np.array(out, np.int64)


def leaves(x: np.ndarray) -> list[np.ndarray]:
    """The leaves of a cell, each the numbers of its rows of ``x``."""
    x = x.astype(np.float64)
    x = x - x.mean(0)
    todo, done = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        side = _halves(x[rows]) if len(rows) > LEAF else None
        if side is not None:
            todo += [rows[side], rows[~side]]
        else:
            done += [rows[a : a + LEAF] for a in range(0, len(rows), LEAF)]  # more than LEAF are equal but for rounding
    for _ in range(2):  # a row that was cut off from its like goes back to it
        c = np.stack([x[r].mean(0) for r in done])
        near = np.concatenate([distances2(x[a : a + 2048], c).argmin(1) for a in range(0, len(x), 2048)])
        order = near.argsort(kind="stable")
        ends = np.searchsorted(near[order], np.arange(len(c) + 1))
        done = [order[a:b] for a, b in zip(ends, ends[1:]) if b > a]
    todo, done = done, []
    median = np.median(np.concatenate([np.sqrt(((x[r] - x[r].mean(0)) ** 2).sum(1)) for r in todo]))
    while todo:
        rows = todo.pop()
        y = x[rows]
        d = np.sqrt(((y - y.mean(0)) ** 2).sum(1))
        wide = len(rows) > 1 and d.max() > (FAR if len(rows) >= GAP_ROWS else NEAR) * median
        some = np.arange(len(rows)) if wide else without_copies(y, COPY * np.median(d)) if len(rows) >= 4 else np.zeros(0, np.int64)
        side = _halves(y[some]) if wide or len(some) >= 4 else None
        if side is not None and (wide or _parted(y[some], side)):
            a, b = y[some][side].mean(0), y[some][~side].mean(0)
            of_a = ((y - a) ** 2).sum(1) < ((y - b) ** 2).sum(1)
            if of_a.any() and not of_a.all():
                todo += [rows[of_a], rows[~of_a]]
                continue
        done.append(rows)
    return done


def _in_cells(vectors: DataFrame, n: int, dim: int) -> DataFrame:
    """``vectors`` (vid, v) as (cell, vid, v), v being the vector's bytes: cells of space with about CELL_ROWS rows, those with more than BLOCK cut by hash."""
    seen = sample(vectors, "v", SAMPLE, n)
    cells = max(1, min(n // CELL_ROWS, len(seen) // 8))
    centroids = fit(seen, cells, rounds=4, largest=3 / cells if cells > 1 else None) if len(seen) else np.zeros((1, dim), np.float32)
    share = np.zeros(len(centroids))
    for a in range(0, len(seen), 8192):
        share += np.bincount(distances2(seen[a : a + 8192], centroids).argmin(1), minlength=len(centroids))
    parts = np.maximum(1, np.ceil(share / max(len(seen), 1) * n / BLOCK)).astype(np.int64)
    shared = vectors.sparkSession.sparkContext.broadcast((centroids, parts))  # a vector a cell, at most two for eight of the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, cut = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float32)
            near = np.concatenate([distances2(x[a : a + 2048], c).argmin(1) for a in range(0, len(x), 2048)])
            part = batch.column(1).to_numpy(zero_copy_only=False) % cut[near]
            ends = np.arange(len(x) + 1, dtype=np.int32) * (x.itemsize * x.shape[1])
            raw = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int64) * cut.max() + part), batch.column(0), raw], names=["cell", "vid", "v"])

    kind = vectors.schema["vid"].dataType.simpleString()
    return vectors.select("vid", F.pmod(F.xxhash64("v"), F.lit(1 << 30)).alias("h"), "v").mapInArrow(run, f"cell bigint, vid {kind}, v binary")


def _as_vectors(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(rows, -1)


def leaf_table(vectors: DataFrame, n: int, dim: int) -> DataFrame:
    """One row a leaf of the ``n`` distinct ``vectors`` (vid, v): node, centroid, median distance to it, and its rows (vids, distances, bytes of their vectors)."""
    kind = vectors.schema["vid"].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        vids, x = group.column("vid").combine_chunks(), _as_vectors(group.column("v"), group.num_rows)
        cell = group.column("cell")[0].as_py()
        order = np.lexsort(x.T[::-1])  # the same leaves in whatever order the rows arrive
        x, vids = x[order], vids.take(pa.array(order))
        found = leaves(x)
        c = np.stack([x[r].mean(0, dtype=np.float64) for r in found]).astype(np.float32)
        d = [np.sqrt(((x[r].astype(np.float64) - m) ** 2).sum(1)) for r, m in zip(found, c)]
        ends = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32))
        return pa.table(
            {
                "node": (np.int64(cell) << 20) + np.arange(len(found)),
                "centroid": pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * x.shape[1]), pa.array(c.ravel())),
                "median": np.array([np.median(z) for z in d]),
                "vids": pa.ListArray.from_arrays(ends, vids.take(pa.array(np.concatenate(found)))),
                "ds": pa.ListArray.from_arrays(ends, pa.array(np.concatenate(d))),
                "vs": pa.array([np.ascontiguousarray(x[r]).tobytes() for r in found], pa.binary()),
            }
        )

    cells = _in_cells(vectors, n, dim)
    schema = f"node bigint, centroid array<float>, median double, vids array<{kind}>, ds array<double>, vs binary"
    return materialise(cells.groupBy("cell").applyInArrow(run, schema), "leaves")


def linked(nodes: DataFrame, near: DataFrame, median: float) -> tuple[DataFrame, DataFrame]:
    """The rows that are not far from every leaf (vid, node: the leaf nearest to the row, d, fresh: whether it is no copy of another), and the graph of the leaves (i, j, x).

    ``near`` (vid, nid, d) holds the leaves beside each.  A row makes the leaf nearest to it similar to those that are less than
    NEAR times as far, the more the nearer.  No row counts as nearer to its leaf than is usual
    around there, so that a leaf of copies is linked like any other.
    """
    other = nodes.select(F.col("node").alias("nid"), "centroid", "median", F.size("vids").alias("n"))
    beside = near.join(other, "nid").groupBy(F.col("vid").alias("node")).agg(F.sort_array(F.collect_list(F.struct("d", "nid", "centroid", "median", "n"))).alias("beside"))  # BESIDE at most
    full = nodes.join(beside, "node", "left").select("node", "centroid", "vids", "ds", "vs", "beside")
    kind = nodes.schema["vids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vid_lists, homes, away, fresh, pairs = [], [], [], [], []
            for node, centroid, vids, ds, vs, beside in zip(*[batch.column(k) for k in range(6)]):
                x = np.frombuffer(vs.as_py(), np.float32).reshape(len(vids), -1).astype(np.float64)
                beside = beside.as_py() or []
                usual = [b["median"] for b in beside if b["n"] >= LEAST_ROWS]
                radius = max(min(max(np.median(ds.values.to_numpy()), np.median(usual) if usual else median), FAR * median), 1e-12)
                ids = np.array([node.as_py()] + [b["nid"] for b in beside])
                centers = np.array([centroid.as_py()] + [b["centroid"] for b in beside], np.float64)
                d = np.sqrt(((x[:, None] - centers[None]) ** 2).sum(2))
                home = d.argmin(1)
                nearest = d[np.arange(len(x)), home]
                kept = nearest <= FAR * median
                ratio = d / np.maximum(nearest, radius)[:, None]
                weight = np.where(kept[:, None], np.maximum(0, (NEAR - ratio) / (NEAR - 1)), 0)
                for h in np.unique(home[kept]):
                    sums = weight[home == h].sum(0)
                    pairs.append([(int(ids[h]), int(ids[o]), float(sums[o])) for o in np.flatnonzero(sums) if o != h])
                new = np.zeros(len(x), bool)
                new[np.flatnonzero(kept)[without_copies(x[kept], COPY * radius)]] = True
                vid_lists.append(vids.values.filter(pa.array(kept)))
                homes.append(ids[home[kept]])
                away.append(nearest[kept])
                fresh.append(new[kept])
            vids = pa.concat_arrays(vid_lists) if vid_lists else pa.array([], batch.schema.field(2).type.value_type)
            flat = [t for p in pairs for t in p]
            rows = len(vids)
            total = rows + len(flat)
            columns = [
                pa.concat_arrays([vids, pa.nulls(len(flat), vids.type)]),
                pa.array(np.concatenate([*homes, [t[0] for t in flat]]).astype(np.int64) if total else [], pa.int64()),
                pa.array([None] * rows + [t[1] for t in flat], pa.int64()),
                pa.array(np.concatenate([*away, [t[2] for t in flat]]) if total else [], pa.float64()),
                pa.array([bool(z) for f in fresh for z in f] + [None] * len(flat), pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vid", "node", "other", "x", "fresh"])

    both = materialise(full.mapInArrow(run, f"vid {kind}, node bigint, other bigint, x double, fresh boolean"), "linked")
    rows = both.where(F.col("other").isNull()).select("vid", "node", F.col("x").alias("d"), "fresh")
    one_way = both.where(F.col("other").isNotNull()).select(F.col("node").alias("i"), F.col("other").alias("j"), "x")
    graph = one_way.unionByName(one_way.select(F.col("j").alias("i"), F.col("i").alias("j"), "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    return rows, graph


def _normalise(m: DataFrame) -> DataFrame:
    """Entries as shares of their column."""
    return m.withColumn("x", F.col("x") / F.sum("x").over(Window.partitionBy("j")))


def markov_clusters(graph: DataFrame, inflation: float = INFLATION, prune: float = PRUNE) -> DataFrame:
    """``node``, ``attractor`` and ``flow`` of every node of a similarity graph (i, j, x).

    The graph must hold both directions of each similarity; nodes without a self-similarity get one as large as their largest.
    Flow column j of the matrix holds where the flow from j goes.  Each round is one join and sums over the entries that
    are left; every other round is written as a table.  The rounds end when the entries of every column are as good as equal, that is when
    squaring and inflation change nothing any more.
    """
    loops = graph.groupBy("j").agg(F.max("x").alias("_most"), F.max(F.when(F.col("i") == F.col("j"), F.col("x"))).alias("_own"))
    loops = loops.select(F.col("j").alias("i"), "j", F.greatest(F.coalesce("_own", "_most"), F.lit(1e-9)).alias("x"))
    both = graph.where(F.col("i") != F.col("j")).unionByName(loops).groupBy("i", "j").agg(F.sum("x").alias("x"))
    m = materialise(_normalise(both), "flow")
    column = Window.partitionBy("j")
    for _ in range(MOST_ROUNDS // 2):
        new = m
        for _ in range(2):  # rounds of one job
            left = new.select("i", F.col("j").alias("k"), F.col("x").alias("a"))
            right = new.select(F.col("i").alias("k"), "j", F.col("x").alias("b"))
            square = left.join(right, "k").groupBy("i", "j").agg(F.sum((F.col("a") * F.col("b")).cast("float")).alias("x"))  # shorter numbers travel lighter
            inflated = square.withColumn("x", F.pow("x", F.lit(inflation))).withColumn("_most", F.max("x").over(column))
            new = _normalise(inflated.where(F.col("x") >= prune * F.col("_most")).drop("_most"))
        # What a column lacks to having equal entries only, taken while the round is written.
        seen = Observation()
        lacks = F.max("x").over(column) - F.sum(F.col("x") * F.col("x")).over(column)
        new = new.withColumn("_lacks", lacks).observe(seen, F.max("_lacks").alias("unrest"))
        new = materialise(new.drop("_lacks"), "flow")
        discard(m)
        m = new
        unrest = seen.get["unrest"]
        if unrest is None or unrest < 1e-2:
            break
    else:
        raise RuntimeError(f"the flow has not stood still after {MOST_ROUNDS} rounds")
    # Where flow ends in several nodes alike they are one cluster, named by the smallest.
    ends = m.withColumn("_most", F.max("x").over(column)).where(F.col("x") >= 0.9 * F.col("_most")).groupBy("j").agg(F.min("i").alias("attractor"), F.max("x").alias("flow"))
    ends = materialise(ends.select(F.col("j").alias("node"), "attractor", "flow"), "ends")
    discard(m)
    return ends


def _summed(i: np.ndarray, j: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries with those of one place added up, in the order of columns and rows."""
    place = j * n + i
    order = place.argsort(kind="stable")
    place = place[order]
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])[: len(place)])
    return place[first] % n, place[first] // n, np.add.reduceat(x[order], first) if len(first) else np.zeros(0)


def _of_column(of: np.ufunc, j: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each entry, sum or greatest entry of its column; entries are in the order of columns."""
    first = np.flatnonzero(np.concatenate([[True], j[1:] != j[:-1]])[: len(j)])
    return np.repeat(of.reduceat(x, first), np.diff(np.append(first, len(j))))


def _still(i: np.ndarray, j: np.ndarray, x: np.ndarray, n: int, inflation: float, prune: float, products: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """:func:`markov_clusters` of a similarity graph of nodes below ``n``, as arrays; None if a round has more than ``products`` products."""
    order = np.lexsort((i, j))
    i, j, x = i[order], j[order], x[order]
    most = np.zeros(n)
    np.maximum.at(most, j, x)
    own, looped = np.zeros(n), i == j
    np.maximum.at(own, j[looped], x[looped])
    has_own = np.bincount(j[looped], minlength=n) > 0
    columns = np.unique(j)
    loops = np.maximum(np.where(has_own, own, most)[columns], 1e-9)
    i, j, x = _summed(np.concatenate([i[~looped], columns]), np.concatenate([j[~looped], columns]), np.concatenate([x[~looped], loops]), n)
    x = x / _of_column(np.add, j, x)
    for rounds in range(1, MOST_ROUNDS + 1):
        at = np.searchsorted(j, np.arange(n + 1))
        size = np.diff(at)[i]
        before = np.concatenate([[0], size.cumsum()])
        if before[-1] > products:
            return None
        edges = np.flatnonzero(np.diff(before[at[:-1]] // LISTED, prepend=-1))
        parts = []
        for a, b in zip(at[edges], np.append(at[edges[1:]], len(j))):  # whole columns
            if a == b:
                continue
            by = np.repeat(np.arange(a, b), size[a:b])
            of = at[i[by]] + np.arange(len(by)) - (before[by] - before[a])
            i2, j2, x2 = _summed(i[of], j[by], (x[of] * x[by]).astype(np.float32).astype(np.float64), n)
            x2 = x2**inflation
            kept = x2 >= prune * _of_column(np.maximum, j2, x2)
            parts.append((i2[kept], j2[kept], x2[kept]))
        i, j, x = (np.concatenate(z) for z in zip(*parts))
        x = x / _of_column(np.add, j, x)
        if rounds % 2 == 0 and (_of_column(np.maximum, j, x) - _of_column(np.add, j, x * x)).max() < 1e-2:
            break
    else:
        raise RuntimeError(f"the flow has not stood still after {MOST_ROUNDS} rounds")
    high = _of_column(np.maximum, j, x)
    kept = x >= 0.9 * high
    i, j, high = i[kept], j[kept], high[kept]
    first = np.flatnonzero(np.concatenate([[True], j[1:] != j[:-1]]))  # the smallest node of each column
    return j[first], i[first], high[first]


def _levels(i: np.ndarray, j: np.ndarray, x: np.ndarray, inner: np.ndarray, level: int, products: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The levels of :func:`clusters_of_clusters` from ``level`` on, as arrays; nodes are numbers, with ``inner`` for each. None as in :func:`_still`."""
    n = len(inner)
    nodes = np.unique(j)
    placed: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    while True:
        has = np.bincount(j, minlength=n) > 0
        volume = np.bincount(j, x, n) + inner
        strong = has[i] & (x >= CUT * np.minimum(volume[i], volume[j]))
        if not strong.any():
            break
        si, sj, sx = i[strong], j[strong], x[strong]
        if not level:
            own = np.unique(sj)
            si, sj, sx = np.concatenate([si, own]), np.concatenate([sj, own]), np.concatenate([sx, np.maximum(inner[own], 1e-9)])
        ends = _still(si, sj, sx, n, INFLATION, PRUNE, products)
        if ends is None:
            return None
        to, flow = np.arange(n), np.ones(n)
        to[ends[0]], flow[ends[0]] = ends[1], ends[2]
        placed = ends if placed is None else (placed[0], to[placed[1]], placed[2] * flow[placed[1]])
        if (ends[0] == ends[1]).all() and level:
            break
        level += 1
        i, j, x = _summed(to[i], to[j], x, n)
        inner = np.bincount(to[has], inner[has], n)
        looped = i == j
        inner[j[looped]] += x[looped]
        i, j, x = i[~looped], j[~looped], x[~looped]
    return placed if placed is not None else (nodes, nodes, np.ones(len(nodes)))


def _in_one_task(graph: DataFrame, inner: DataFrame, level: int, products: int) -> DataFrame:
    """``node``, ``attractor`` and ``flow`` of a graph of few links by :func:`_levels`; no row if a round has too many products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_rows = [b for b in batches if b.num_rows]
        if not all_rows:
            return
        rows = pa.Table.from_batches(all_rows)
        j, x = rows.column("j").to_numpy(), rows.column("x").to_numpy()
        linked_, i = rows.column("i").is_valid().to_numpy(), rows.column("i").fill_null(0).to_numpy()
        names = np.unique(np.concatenate([i[linked_], j[linked_]]))
        if not len(names):
            return
        k = np.minimum(np.searchsorted(names, j), len(names) - 1)
        own = ~linked_ & (names[k] == j)
        found = _levels(np.searchsorted(names, i[linked_]), k[linked_], x[linked_], np.bincount(k[own], x[own], len(names)), level, products)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array(names[found[0]]), pa.array(names[found[1]]), pa.array(found[2])], names=["node", "attractor", "flow"])

    both = graph.select("i", "j", "x").unionByName(inner.select(F.lit(None).cast("long").alias("i"), "j", F.col("x").cast("double").alias("x")))
    return materialise(both.coalesce(1).mapInArrow(run, "node bigint, attractor bigint, flow double"), "ends")


def _onward(placed: DataFrame, ends: DataFrame) -> DataFrame:
    """``placed`` with its attractors moved to those of ``ends``."""
    to = ends.select(F.col("node").alias("attractor"), F.col("attractor").alias("_to"), F.col("flow").alias("_f"))
    moved = placed.join(to, "attractor", "left").select("node", F.coalesce("_to", "attractor").alias("attractor"), (F.col("flow") * F.coalesce("_f", F.lit(1.0))).alias("flow"))
    out = materialise(moved, "placed")
    discard(placed)
    return out


def clusters_of_clusters(graph: DataFrame, rows: DataFrame, links: int = LINKS, products: int = PRODUCTS) -> DataFrame:
    """``node``, ``attractor`` and ``flow`` of the nodes with links, by Markov clustering of the graph (i, j, x), then of the clusters found, and so on.

    ``rows`` (j, x) is how much each node is like itself.  A link between two clusters counts if it is at least CUT of all
    that either of them is linked to, itself included.  The levels end when no link counts or no clusters merge.
    From the level on at which at most ``links`` links are left, one task does the rest, unless a round there has more than ``products`` products.
    """
    graph, inner = materialise(graph, "graph"), rows
    placed: DataFrame | None = None
    level = 0
    while True:
        if graph.limit(links + 1).count() <= links:
            ends = _in_one_task(graph, inner, level, products)
            if ends.limit(1).count():
                return ends if placed is None else _onward(placed, ends)
        outer = graph.groupBy("j").agg(F.sum("x").alias("_out"))
        volume = materialise(outer.join(inner, "j", "left").select("j", (F.col("_out") + F.coalesce("x", F.lit(0.0))).alias("_v"), F.coalesce("x", F.lit(0.0)).alias("_in")), "volume")
        sized = graph.join(volume.select("j", F.col("_v").alias("_vj")), "j").join(volume.select(F.col("j").alias("i"), F.col("_v").alias("_vi")), "i")
        strong = materialise(sized.where(F.col("x") >= CUT * F.least("_vi", "_vj")).select("i", "j", "x"), "strong")
        if not strong.limit(1).count():
            break
        if placed is None:  # the leaves' own rows; later levels are like themselves as much as like the nearest, so that they go on merging
            own = volume.join(strong.select("j").distinct(), "j", "left_semi").select(F.col("j").alias("i"), "j", F.greatest("_in", F.lit(1e-9)).alias("x"))
            ends = markov_clusters(strong.unionByName(own))
        else:
            ends = markov_clusters(strong)
        merged = ends.where(F.col("node") != F.col("attractor")).limit(1).count()
        if placed is None:
            placed = ends
        else:
            placed = _onward(placed, ends)
        if not merged and level:
            break
        level += 1
        to = ends.select("node", "attractor")
        moved = graph.join(to.select(F.col("node").alias("i"), F.col("attractor").alias("_i")), "i", "left").join(to.select(F.col("node").alias("j"), F.col("attractor").alias("_j")), "j", "left")
        moved = materialise(moved.groupBy(F.coalesce("_i", "i").alias("i"), F.coalesce("_j", "j").alias("j")).agg(F.sum("x").alias("x")), "graph")
        was = volume.join(to.select(F.col("node").alias("j"), F.col("attractor").alias("_j")), "j", "left").select(F.coalesce("_j", "j").alias("j"), F.col("_in").alias("x"))
        inner = was.unionByName(moved.where(F.col("i") == F.col("j")).select("j", "x")).groupBy("j").agg(F.sum("x").alias("x"))
        graph = moved.where(F.col("i") != F.col("j"))
        discard(strong)
    if placed is None:
        placed = graph.select(F.col("j").alias("node"), F.col("j").alias("attractor"), F.lit(1.0).alias("flow")).distinct()
    return placed


def populations(df: DataFrame, key: str, vector: str, dim: int = 30) -> DataFrame:
    """``key``, ``cluster``, ``flow`` and ``d`` of the rows that belong to a population.

    Left out: rows without a sound vector of ``dim`` numbers, rows far from every population (more than FAR times the
    distance that half of all rows have from the middle of their leaf), and clusters of fewer than LEAST_ROWS rows,
    near-identical ones counting as one; but a small cluster no farther than that from a population joins it.
    Repeated rows of a key count once; identical vectors are one record of the graph, whatever their
    number; ties of flow go to the smaller leaf; extra columns are ignored; an empty table gives no rows.
    ``flow`` is that of the leaf nearest to the row to the attractor of its cluster, ``d`` the row's distance to the middle of that leaf.
    """
    rows = materialise(sound_vectors(df, key, vector, dim).withColumnRenamed(key, "cell"), "vectors")
    vectors, members = distinct_vectors(rows)
    n = vectors.count()
    nodes = leaf_table(vectors.select("vid", "v"), n, dim)
    median = nodes.select(F.explode("ds").alias("d")).agg(F.percentile_approx("d", 0.5, 1000)).first()[0] or 0.0
    near = between_distinct(nodes.select(F.col("node").alias("vid"), F.col("centroid").alias("v"), F.lit(True).alias("asks")), BESIDE)
    members_of, graph = linked(nodes, near, median)
    discard(nodes)
    sizes = materialise(members_of.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("fresh"), 1)).alias("rows")), "sizes")
    placed = clusters_of_clusters(graph, sizes.select(F.col("node").alias("j"), F.col("n").cast("double").alias("x")))
    full = sizes.join(placed, "node", "left").select("node", "rows", F.coalesce("attractor", "node").alias("cluster"), F.coalesce("flow", F.lit(1.0)).alias("flow"))
    full = materialise(full, "clusters")
    big = full.groupBy("cluster").agg(F.sum("rows").alias("_rows")).where(F.col("_rows") >= LEAST_ROWS).select("cluster")
    whole = materialise(full.join(big, "cluster", "left_semi").select("node", "cluster", "flow"), "whole")
    small = full.select("node").join(whole.select("node"), "node", "left_anti")
    beside = near.where(F.col("d") <= FAR * median).select(F.col("vid").alias("node"), "nid", "d").join(small, "node").join(whole.select(F.col("node").alias("nid"), "cluster"), "nid")
    joined = beside.groupBy("node").agg(F.min_by("cluster", F.struct("d", "nid")).alias("cluster")).select("node", "cluster", F.lit(0.0).alias("flow"))
    of_vector = members_of.join(whole.unionByName(joined), "node").select("vid", "cluster", "flow", "d")
    out = members().join(materialise(of_vector, "placed"), "vid")
    return out.select(F.col("cell").alias(key), "cluster", "flow", "d")


def _labelled(spark: SparkSession, root: str) -> DataFrame:
    """Rows of populations with their current label, null where it is missing."""
    cells = table(spark, root, "cellcoldata").select("cell_id", "clusters", "loaded_at")
    label = F.when(~F.col("clusters").isin("", "NA"), F.col("clusters"))
    current = latest(cells, "cell_id", "loaded_at").select("cell_id", label.alias("label"))
    placed = populations(table(spark, root, "reduceddims").select("cell_id", "iterativelsi"), "cell_id", "iterativelsi")
    return materialise(placed.join(current, "cell_id"), "labelled")


def _commonest(labelled: DataFrame) -> DataFrame:
    """The commonest label of each cluster; of equally common ones the smallest. One row a cluster."""
    counts = labelled.where(F.col("label").isNotNull()).groupBy("cluster", "label").count()
    first = Window.partitionBy("cluster").orderBy(F.col("count").desc(), "label")
    return counts.withColumn("_r", F.row_number().over(first)).where(F.col("_r") == 1).select("cluster", F.col("label").alias("clusters"))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Cells of a population whose label is missing or not the population's commonest."""
    labelled = _labelled(spark, root)
    best = F.broadcast(_commonest(labelled))  # one row a cluster
    wrong = F.col("label").isNull() | (F.col("label") != F.col("clusters"))
    return labelled.join(best, "cluster").where(wrong).select("cell_id", "clusters")


def p1_populations(spark: SparkSession, root: str) -> DataFrame:
    """Every population with its size, commonest label and five most typical cells, those of strongest flow and closest to their centroid."""
    labelled = _labelled(spark, root)
    sizes = labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_cells"), F.count("label").alias("n_labelled"))
    first = Window.partitionBy("cluster").orderBy(F.col("flow").desc(), "d", "cell_id")
    typical = labelled.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= 5)
    typical = typical.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("_r", "cell_id"))).alias("_t"))  # five a cluster
    out = sizes.join(_commonest(labelled), "cluster", "left").join(typical, "cluster")
    return out.select("cluster", "n_cells", "n_labelled", "clusters", F.col("_t.cell_id").alias("typical_cells"))


QUERIES = {"p1_found": p1_found, "p1_populations": p1_populations}

SQL: dict[str, str] = {}
