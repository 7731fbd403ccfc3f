"""Neighbour graphs of vectors and what is computed on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import discard, materialise

#: Rows for each cell of space, greatest number of cells (their middles are broadcast), and rows of either side that one task compares.
CELL_ROWS, MOST_CELLS, BLOCK = 2000, 4096, 4096
#: Rows of a shared member that are paired under one key.
HUB_ROWS = 500


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    middle = y.mean(0)
    x, y = x - middle, y - middle
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0))


def _as_array(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _compared(data: DataFrame, asked: DataFrame, k: int, keep_self: bool, kind: str) -> DataFrame:
    """(query, neighbour, distance): the k nearest in each block of the rows (cell, key, v) for the queries (cell, q, qv, reach) that ask that cell, none beyond ``reach``.

    Cells with more than BLOCK rows on a side are cut by hash, and every part of one side meets every part of the other.
    """
    def parts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))

    cut = parts(data, "_dp").join(parts(asked, "_qp"), "cell")
    d = data.join(F.broadcast(cut), "cell")  # one row a cell
    d = d.select("cell", F.pmod(F.xxhash64("key"), F.col("_dp")).cast("int").alias("h"), F.explode(F.sequence(F.lit(0), F.col("_qp") - 1)).alias("a"), "key", "v")
    q = asked.join(F.broadcast(cut), "cell")
    q = q.select("cell", F.explode(F.sequence(F.lit(0), F.col("_dp") - 1)).alias("h"), F.pmod(F.xxhash64("q"), F.col("_qp")).cast("int").alias("a"), "q", "qv", "reach")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query": right.column("q").slice(0, 0), "neighbour": left.column("key").slice(0, 0), "distance": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        names, ids = left.column("key").combine_chunks(), right.column("q").combine_chunks()
        y, x = _as_array(left.column("v").combine_chunks()), _as_array(right.column("qv").combine_chunks())
        reach = right.column("reach").to_numpy()
        places = {z: i for i, z in enumerate(names.to_pylist())}
        own = np.array([places.get(z, -1) for z in ids.to_pylist()])
        rows, near, far = [], [], []
        for at in range(0, len(x), 1024):
            part = slice(at, at + 1024)
            dist = _distances(x[part], y)
            if not keep_self:
                mine = np.flatnonzero(own[part] >= 0)
                dist[mine, own[part][mine]] = np.inf
            top = min(k + 3, len(y))
            best = np.argpartition(dist, top - 1, 1)[:, :top]
            if len(y) > top:  # ties beyond the last one kept are decided by key, so all of them are kept
                edge = np.take_along_axis(dist, best, 1).max(1)
                tied = np.flatnonzero((dist <= edge[:, None] * (1 + 1e-9) + 1e-9).sum(1) > top)
            else:
                tied = np.zeros(0, np.int64)
            r, c = np.nonzero(np.isfinite(np.take_along_axis(dist, best, 1)))
            keep = ~np.isin(r, tied)
            r, c = r[keep], best[r[keep], c[keep]]
            if len(tied):
                edge = np.sort(np.take_along_axis(dist[tied], best[tied], 1), 1)[:, min(k, top) - 1]
                tr, tc = np.nonzero(dist[tied] <= edge[:, None] * (1 + 1e-9) + 1e-9)
                finite = np.isfinite(dist[tied][tr, tc])
                r, c = np.concatenate([r, tied[tr[finite]]]), np.concatenate([c, tc[finite]])
            exact = np.sqrt(((x[part][r] - y[c]) ** 2).sum(1))
            keep = exact <= reach[part][r] * (1 + 1e-9) + 1e-9
            rows.append(r[keep] + at)
            near.append(c[keep])
            far.append(exact[keep])
        r, c = np.concatenate(rows), np.concatenate(near)
        return pa.table({"query": ids.take(pa.array(r)), "neighbour": names.take(pa.array(c)), "distance": np.concatenate(far)})

    return d.groupBy("cell", "h", "a").cogroup(q.groupBy("cell", "h", "a")).applyInArrow(run, f"query {kind}, neighbour {kind}, distance double")


def exact_neighbours(data: DataFrame, queries: DataFrame, key: str, vector: str, k: int, keep_self: bool = False) -> DataFrame:
    """(query, neighbour, distance, rnk): the k nearest rows of ``data`` for each query, exactly; ties go to the smaller key.

    The data lie in cells around middles drawn by hash.  A query first asks the nearest cells that hold k rows between them; the k-th
    distance found bounds what can still be nearer, and only cells that reach within it are asked then.
    Nothing but the middles and one row a cell comes to the driver, and no pair is written out but k a block.
    Rows with a null key or vector are left out.
    """
    spark, kind = data.sparkSession, data.schema[key].dataType.simpleString()
    wide = F.transform(vector, lambda x: x.cast("double"))
    sound = F.col(key).isNotNull() & F.col(vector).isNotNull()
    d = materialise(data.where(sound).select(F.col(key).alias("key"), wide.alias("v")), "data")
    q = materialise(queries.where(sound).select(F.col(key).alias("q"), wide.alias("qv")), "queries")
    n = d.count()
    empty = spark.createDataFrame([], f"query {kind}, neighbour {kind}, distance double, rnk int")
    if not n or not q.limit(1).count():
        return empty
    cells = max(1, min(n // CELL_ROWS, MOST_CELLS))
    middles = np.array(list(d.orderBy(F.xxhash64("v"), "key").limit(cells).toPandas()["v"]), float)
    shared = spark.sparkContext.broadcast(middles)  # a vector a cell

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _as_array(batch.column(1))
                near = np.concatenate([_distances(x[a : a + 2048], shared.value).argmin(1) for a in range(0, len(x), 2048)])
                exact = np.sqrt(((x - shared.value[near]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), *batch.columns, pa.array(exact)], names=["cell", "key", "v", "d"])

    placed = materialise(d.mapInArrow(deal, f"cell int, key {kind}, v array<double>, d double"), "cells")
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("r")).toPandas()  # one row a cell
    held, reach_of = np.zeros(len(middles)), np.full(len(middles), -np.inf)
    held[sizes["cell"]], reach_of[sizes["cell"]] = sizes["n"], sizes["r"]
    about = spark.sparkContext.broadcast((held, reach_of))

    def ask(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, reach_of = about.value
            for batch in batches:
                for a in range(0, batch.num_rows, 512):
                    part = batch.slice(a, 512)
                    dist = _distances(_as_array(part.column(1)), shared.value)
                    order = dist.argsort(1, kind="stable")
                    before = np.cumsum(held[order], 1) - held[order]
                    asked = np.zeros(dist.shape, bool)
                    np.put_along_axis(asked, order, before < k + (not keep_self), 1)  # until they hold k rows besides the query itself
                    reach = np.full(len(dist), np.inf)
                    if not first:
                        bound = part.column(2).to_numpy(zero_copy_only=False).astype(float)
                        reach = np.where(np.isnan(bound), np.inf, bound)
                        asked = ~asked & (dist - reach_of[None] <= reach[:, None] * (1 + 1e-9) + 1e-6)
                    r, c = np.nonzero(asked & (held > 0)[None])
                    rows = pa.array(r)
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), part.column(0).take(rows), part.column(1).take(rows), pa.array(reach[r])], names=["cell", "q", "qv", "reach"])

        return run

    schema = f"cell int, q {kind}, qv array<double>, reach double"
    order = Window.partitionBy("query").orderBy("distance", "neighbour")
    first = lambda df: df.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= k)
    rows = placed.select("cell", "key", "v")
    found = first(_compared(rows, materialise(q.mapInArrow(ask(True), schema), "asked"), k, keep_self, kind))
    if len(middles) == 1:
        return found
    found = materialise(found, "found")
    bound = found.where(F.col("rnk") == k).select(F.col("query").alias("q"), F.col("distance").alias("bound"))
    more = materialise(q.join(bound, "q", "left").select("q", "qv", "bound").mapInArrow(ask(False), schema), "asked")
    return first(found.drop("rnk").unionByName(_compared(rows, more, k, keep_self, kind)))


def distinct_neighbours(data: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query, neighbour, distance, rnk): what :func:`exact_neighbours` gives for every row of ``data`` among all, for vectors that many rows share.

    Only distinct vectors are compared. A vector goes by its smallest key, and at most its ``k + 1`` smallest keys can be among the nearest of any row,
    since ties go to the smaller key; so the nearest ``k + 1`` vectors of each, ties decided by those names, hold its nearest ``k + 1`` rows, one of which may be the row itself.
    """
    sound = F.col(key).isNotNull() & F.col(vector).isNotNull()
    rows = materialise(data.where(sound).select(F.col(key).alias("key"), F.col(vector).alias("v")), "rows")
    one = materialise(rows.groupBy("v").agg(F.min("key").alias("name")), "distinct")
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy("key"))).where(F.col("_r") <= k + 1)  # Spark keeps k + 1 rows before its shuffle
    near = exact_neighbours(one, one, "name", "v", k + 1, keep_self=True)
    held = first.join(one, "v").select(F.col("name").alias("neighbour"), "key")
    order = Window.partitionBy("query").orderBy("distance", "key")
    best = near.select("query", "neighbour", "distance").join(held, "neighbour").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)
    lists = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("distance", "key"))).alias("near"))  # k + 1 of them
    lists = rows.withColumnRenamed("key", "query").join(one.join(lists.withColumnRenamed("query", "name"), "name").select("v", "near"), "v")
    others = F.slice(F.filter("near", lambda x: x["key"] != F.col("query")), 1, k)
    found = lists.select("query", F.posexplode(others).alias("rnk", "x"))
    return found.select("query", F.col("x.key").alias("neighbour"), F.col("x.distance").alias("distance"), (F.col("rnk") + 1).alias("rnk"))


def vote(neighbours: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """The commonest label among the neighbours of each query; ties go to the smaller label."""
    counts = neighbours.join(labels.select(F.col("id").alias("neighbour"), label), "neighbour").groupBy("query", label).agg(F.count(F.lit(1)).alias("votes"))
    first = Window.partitionBy("query").orderBy(F.col("votes").desc(), label)
    return counts.withColumn("_r", F.row_number().over(first)).where(F.col("_r") == 1).drop("_r")


def shared_neighbours(neighbours: DataFrame, prune: float = 1 / 15) -> DataFrame:
    """(a, b, weight): Jaccard index of the neighbour sets of rows that share a neighbour, if above ``prune``.

    Every pair of rows with a member in common is counted. A member that is shared by m rows gives m squared
    pairs, so its rows are dealt to salts of at most HUB_ROWS rows, and each pair of salts is a key of its own.
    """
    sets = neighbours.select(F.col("query").alias("a"), F.col("neighbour").alias("m"))
    own = sets.select("a", F.col("a").alias("m")).distinct()
    sets = materialise(sets.unionByName(own).distinct(), "sets")
    size = sets.groupBy("a").agg(F.count(F.lit(1)).alias("_n"))
    salts = sets.groupBy("m").agg(F.ceil(F.count(F.lit(1)) / HUB_ROWS).alias("_salts"))
    salted = sets.join(salts, "m").withColumn("_s", F.pmod(F.xxhash64("a"), F.col("_salts")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1))
    left = salted.withColumn("_t", every).select("m", "_s", "_t", "a")
    right = salted.withColumnRenamed("_s", "_t").withColumn("_s", every).select("m", "_s", "_t", F.col("a").alias("b"))
    common = left.join(right, ["m", "_s", "_t"]).where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("_c"))
    sized = common.join(size.withColumnRenamed("_n", "_na"), "a").join(size.select(F.col("a").alias("b"), F.col("_n").alias("_nb")), "b")
    weight = F.col("_c") / (F.col("_na") + F.col("_nb") - F.col("_c"))
    return sized.select("a", "b", weight.alias("weight")).where(F.col("weight") > prune)


def label_propagation(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(id, group): communities of a weighted graph (a, b, weight): every node takes the label of greatest weight around it.

    It ends when no label changes, or after ``rounds`` rounds (a parameter; nodes on the border of two communities may change for ever). Nodes are updated by halves, by the parity of their hash, so that two labels don't swap forever; ties go to the smaller label.
    """
    both = materialise(edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")), "edges")
    labels = materialise(both.select(F.col("a").alias("id")).distinct().withColumn("group", F.col("id")), "labels")
    for i in range(2 * rounds):
        around = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a", "group").agg(F.sum("weight").alias("_w"))
        first = Window.partitionBy("a").orderBy(F.col("_w").desc(), "group")
        best = around.withColumn("_r", F.row_number().over(first)).where(F.col("_r") == 1).select(F.col("a").alias("id"), F.col("group").alias("_best"))
        turn = F.pmod(F.xxhash64("id"), F.lit(2)) == i % 2
        new = labels.join(best, "id", "left").select("id", F.when(turn, F.coalesce("_best", "group")).otherwise(F.col("group")).alias("group"), (turn & (F.col("_best") != F.col("group"))).alias("_moved"))
        new = materialise(new, "labels")
        moved = new.where("_moved").count()
        discard(labels)
        labels = new.drop("_moved")
        labels.tessera_path = new.tessera_path
        if not moved and i % 2:
            break
    return labels


def merge_small(groups: DataFrame, neighbours: DataFrame, least: int) -> DataFrame:
    """Rows of groups of fewer than ``least`` rows join the group of most of their neighbours in larger ones."""
    size = groups.groupBy("group").agg(F.count(F.lit(1)).alias("_n"))
    big = groups.join(size.where(F.col("_n") >= least), "group").select("id", "group")
    voted = vote(neighbours, big, "group").select(F.col("query").alias("id"), F.col("group").alias("_to"))
    return groups.join(size, "group").join(voted, "id", "left").select("id", F.when(F.col("_n") < least, F.coalesce("_to", "group")).otherwise(F.col("group")).alias("group"))


def rank_labels(groups: DataFrame, prefix: str = "C") -> DataFrame:
    """Groups renamed by size: C1 is the largest; ties go to the smaller name."""
    size = groups.groupBy("group").agg(F.count(F.lit(1)).alias("_n"))
    named = size.withColumn("label", F.concat(F.lit(prefix), F.row_number().over(Window.orderBy(F.col("_n").desc(), "group"))))  # one row a group
    return groups.join(named.select("group", "label"), "group").select("id", F.col("label").alias("group"))


def knn_groups(neighbours: DataFrame, k: int, overlap: float = 0.8) -> DataFrame:
    """Groups (group, id) of a row with its k neighbours, taken in order of the row and dropped if too alike to one taken before.

    The pairs of groups that share more than ``overlap`` of their members are found by a join; what
    is left to do in order is a greedy pass over those pairs, which is done by rounds.
    """
    members = neighbours.select(F.col("query").alias("group"), F.col("neighbour").alias("id")).unionByName(neighbours.select(F.col("query").alias("group"), F.col("query").alias("id")).distinct())
    members = materialise(members.distinct(), "members")
    left, right = members.withColumnRenamed("group", "u"), members.withColumnRenamed("group", "v")
    alike = left.join(right, "id").where(F.col("u") > F.col("v")).groupBy("u", "v").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > overlap * (k + 1))
    links = materialise(alike.select("u", "v"), "alike")
    rest, kept = materialise(members.select(F.col("group").alias("g")).distinct(), "rest"), None
    while rest.limit(1).count():
        best = materialise(rest.join(links.select(F.col("u").alias("g")).distinct(), "g", "left_anti"), "best")
        kept = best if kept is None else kept.unionByName(best)
        gone = links.join(best.withColumnRenamed("g", "v"), "v", "left_semi").select(F.col("u").alias("g")).unionByName(best).distinct()
        gone = materialise(gone, "gone")
        rest = materialise(rest.join(gone, "g", "left_anti"), "rest")
        links = materialise(links.join(gone.withColumnRenamed("g", "u"), "u", "left_anti").join(gone.withColumnRenamed("g", "v"), "v", "left_anti"), "alike")
    return members.join(kept.withColumnRenamed("g", "group"), "group", "left_semi") if kept is not None else members


def impute_weights(df: DataFrame, key: str, vector: str, block_rows: int = 500, k: int = 15, ka: int = 4, t: int = 3, seed: int = 1, replicates: int = 2) -> DataFrame:
    """(replicate, block, a, b, weight): diffusion weights within random blocks, dealt anew in every replicate; the weights of a row sum to 1 over all replicates.

    Within a block: Gaussian of the distance in units of the ka-th neighbour's,
    symmetrised, normalised and multiplied with itself t times. Blocks have about ``block_rows`` rows.
    """
    n = df.count()
    blocks = max(1, round(n / block_rows))
    kind = df.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x = np.array(list(pdf[vector]), float)
        d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T, 0))
        near = np.argsort(d, 1, kind="stable")[:, : min(k, len(x))]
        w = np.zeros_like(d)
        rows = np.arange(len(x))[:, None]
        unit = np.maximum(np.take_along_axis(d, near, 1)[:, min(ka, near.shape[1] - 1)], 1e-12)
        w[rows, near] = np.exp(-((np.take_along_axis(d, near, 1) / unit[:, None]) ** 2))
        w = w + w.T
        w /= w.sum(1, keepdims=True)
        w = np.linalg.matrix_power(w, t)
        r, c = np.nonzero(w > 1e-9)
        names = pdf[key].to_numpy()
        return pd.DataFrame({"replicate": int(pdf["replicate"].iloc[0]), "block": int(pdf["block"].iloc[0]), "a": names[r], "b": names[c], "weight": w[r, c] / replicates})

    dealt = F.explode(F.array(*[F.struct(F.lit(r).alias("replicate"), F.pmod(F.xxhash64(F.col(key), F.lit(seed + r)), F.lit(blocks)).cast("int").alias("block")) for r in range(replicates)]))
    placed = df.select(key, vector, dealt.alias("_d")).select(key, vector, "_d.*")
    return placed.groupBy("replicate", "block").applyInPandas(run, f"replicate int, block int, a {kind}, b {kind}, weight double")


def impute(matrix: DataFrame, weights: DataFrame) -> DataFrame:
    """(feature, cell, value): values spread along the weights of their cells."""
    joined = matrix.join(weights.select(F.col("b").alias("cell"), "a", "weight"), "cell")
    return joined.groupBy("feature", F.col("a").alias("_a")).agg(F.sum(F.col("value") * F.col("weight")).alias("value")).withColumnRenamed("_a", "cell")


def module_score(matrix: DataFrame, features: DataFrame, totals: DataFrame, n_cells_of: DataFrame, bins: int = 25, background: int = 100, seed: int = 1) -> DataFrame:
    """(module, cell, score): mean of a module's features less that of random ones of like total.

    ``features`` (module, feature); ``totals`` (feature, total).  Features are
    binned by rank of their total in chunks of equal size; each feature of a
    module brings ``background`` others of its bin, chosen by a seeded hash.
    """
    n = totals.count()
    size = -(-n // bins)
    order = Window.orderBy("total", "feature")  # one row a feature
    binned = materialise(totals.withColumn("bin", F.ceil(F.row_number().over(order) / size)).select("feature", "bin"), "bins")
    mine = features.join(binned, "feature")
    wanted = mine.groupBy("module", "bin").agg((F.count(F.lit(1)) * background).alias("_want"))
    pool = wanted.join(binned, "bin").join(features, ["module", "feature"], "left_anti")
    pick = Window.partitionBy("module", "bin").orderBy(F.xxhash64(F.col("feature"), F.lit(seed)), "feature")
    chosen = pool.withColumn("_r", F.row_number().over(pick)).where(F.col("_r") <= F.col("_want")).select("module", "feature", F.lit(-1.0).alias("sign"))
    both = mine.select("module", "feature", F.lit(1.0).alias("sign")).unionByName(chosen)
    counts = both.groupBy("module", "sign").agg(F.count(F.lit(1)).alias("_n"))
    sums = matrix.join(both.join(counts, ["module", "sign"]), "feature").groupBy("module", "cell").agg(F.sum(F.col("value") * F.col("sign") / F.col("_n")).alias("score"))
    cells = n_cells_of.select("cell").distinct().crossJoin(F.broadcast(features.select("module").distinct()))  # a score for each cell and module
    return cells.join(sums, ["module", "cell"], "left").select("module", "cell", F.coalesce("score", F.lit(0.0)).alias("score"))


def merge_clusters(groups: DataFrame, vectors: DataFrame, dim: int, most: int) -> DataFrame:
    """(id, group) with at most ``most`` groups: those whose mean vectors are closest are merged, by complete linkage.

    Only the means come to the driver, one row per group. A merged group bears its smallest name.
    """
    means = vectors.join(groups, "id").groupBy("group").agg(*[F.avg(F.col("v")[j].cast("double")).alias(f"m{j}") for j in range(dim)]).orderBy("group").toPandas()
    x = means[[f"m{j}" for j in range(dim)]].to_numpy(float)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    sets = [[i] for i in range(len(x))]
    while len(sets) > max(most, 1):
        a, b = min(((a, b) for b in range(len(sets)) for a in range(b)), key=lambda ab: d[np.ix_(sets[ab[0]], sets[ab[1]])].max())
        sets[a] += sets.pop(b)
    names = means["group"].tolist()
    rows = [(names[i], min(names[j] for j in s)) for s in sets for i in s]
    kind = groups.schema["group"].dataType.simpleString()
    mapped = groups.sparkSession.createDataFrame(rows, f"group {kind}, _to {kind}")
    return groups.join(F.broadcast(mapped), "group").select("id", F.col("_to").alias("group"))  # one row a group
