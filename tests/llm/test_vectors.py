import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import clusters, neighbours
from tessera.llm.centroids import fit
from tessera.llm.clusters import markov_clusters, populations
from tessera.llm.neighbours import CentroidGraph, nearest

DIM = 6


def blobs(n, centers, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.normal(0, 12, (centers, DIM))
    which = rng.integers(0, centers, n)
    return which, (c[which] + rng.normal(0, 1, (n, DIM))).astype(np.float32)


def table(spark, x, extra=()):
    data = [(int(k), [float(v) for v in row], "x") for k, row in enumerate(x)] + list(extra)
    return spark.createDataFrame(data, "id long, v array<float>, cell string")


def brute(x, ids, k, radius=None):
    out = {}
    for a in range(len(x)):
        d = [(math.sqrt(((x[a].astype(float) - x[b].astype(float)) ** 2).sum()), ids[b]) for b in range(len(x)) if b != a]
        out[ids[a]] = [(i, round(e, 9)) for e, i in sorted(d)[:k] if radius is None or e <= radius]
    return out


def got(df):
    out = {}
    for r in df.orderBy("id", "rnk").collect():
        out.setdefault(r["id"], []).append((r["neighbour"], round(r["distance"], 9)))
    return out


def test_exact_within_few_lists_with_copies_and_dirt(spark):
    _, x = blobs(120, 3)
    x[40:70] = x[40]  # a third are copies of one vector
    x[80] = x[81] + np.float32(0.001)
    dirt = [(900, None, ""), (901, [1.0] * (DIM - 1), ""), (902, [float("nan")] * DIM, ""), (903, [float("inf")] * DIM, ""), (None, [0.0] * DIM, ""), (5, [float(v) for v in x[5]], "again")]
    want = brute(x, list(range(120)), 5)
    assert got(nearest(table(spark, x, dirt), "id", "v", 5, dim=DIM)) == want


def test_radius_and_asked(spark):
    _, x = blobs(150, 4, 3)
    want = brute(x, list(range(150)), 3, 1.5)
    found = got(nearest(table(spark, x), "id", "v", 3, dim=DIM, radius=1.5, asked=F.col("id") % 3 == 0))
    assert found == {k: v for k, v in want.items() if k % 3 == 0 and v}


def test_recall_over_many_lists_and_cut_lists(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST_ROWS", 60)
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    _, x = blobs(1500, 5, 8)
    want = brute(x, list(range(1500)), 5)
    found = got(nearest(table(spark, x), "id", "v", 5, dim=DIM))
    hit = sum(len({i for i, _ in want[k]} & {i for i, _ in found[k]}) for k in want)
    assert set(found) == set(want) and hit / (5 * 1500) >= 0.9


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    found = got(nearest(table(spark, np.arange(n * DIM, dtype=np.float32).reshape(n, DIM)), "id", "v", 5, dim=DIM))
    assert {k: [i for i, _ in v] for k, v in found.items()} == ({0: [1], 1: [0]} if n == 2 else {})


def test_graph_finds_nearest_centroids():
    _, x = blobs(4000, 40, 5)
    g = CentroidGraph(fit(x, 300))
    ids, d = g.search(x[:500], 4)
    true = np.sqrt(((x[:500, None].astype(float) - g.c[None]) ** 2).sum(2))
    assert (ids[:, 0] == true.argmin(1)).mean() > 0.9
    assert np.allclose(d[:, 0], true[np.arange(500), ids[:, 0]], atol=1e-2)


def test_populations_are_found_and_strays_left_out(spark):
    which, x = blobs(900, 4, 11)
    far = [[300.0 + 80 * k] + [0.0] * (DIM - 1) for k in range(5)]
    extra = [(2000 + k, v, "") for k, v in enumerate(far)] + [(3000, None, ""), (3001, [0.0], ""), (7, [float(v) for v in x[7]], "")]
    out = populations(table(spark, x, extra), "id", "v", DIM).collect()
    label = {r["id"]: r["cluster"] for r in out}
    assert len(out) == len(label) and not set(label) - set(range(900))
    assert len(label) >= 890
    pairs = {(which[i], c) for i, c in label.items()}
    assert len(pairs) == len({c for _, c in pairs}) == 4


def test_flow_of_two_triangles(spark):
    edges = [(a, b) for t in ((0, 1, 2), (3, 4, 5)) for a in t for b in t if a != b] + [(2, 3), (3, 2)]
    graph = spark.createDataFrame([(a, b, 0.05 if {a, b} == {2, 3} else 1.0) for a, b in edges], "i int, j int, x double")
    ends = {r["node"]: r["attractor"] for r in markov_clusters(graph, 2.0).collect()}
    assert len({ends[0], ends[1], ends[2]}) == 1 and len({ends[3], ends[4], ends[5]}) == 1 and ends[0] != ends[3]


def test_few_links_are_clustered_in_one_task_like_many(spark):
    rng = np.random.default_rng(3)
    at = rng.normal(size=(6, 2)) * 6
    x = np.concatenate([a + rng.normal(size=(40, 2)) for a in at])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    i, j = np.nonzero((d < 1.2) & (d > 0))
    links = [(int(a) * 3 + 1, int(b) * 3 + 1, float(1.3 - d[a, b])) for a, b in zip(i, j)]
    graph = spark.createDataFrame(links, "i bigint, j bigint, x double")
    own = spark.createDataFrame([(k * 3 + 1, 1.0 + k % 5) for k in range(len(x) + 3)], "j bigint, x double")
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    began = jobs()
    few = clusters.clusters_of_clusters(graph, own)
    one_task = jobs() - began
    many = clusters.clusters_of_clusters(graph, own, products=1)  # given up in one task, at every level
    later = clusters.clusters_of_clusters(graph, own, links=len(links) // 2)
    assert one_task < 20
    want = {r["node"]: (r["attractor"], round(r["flow"], 6)) for r in many.collect()}
    assert 1 < len({a for a, _ in want.values()}) < len(want)
    for found in (few, later):
        assert {r["node"]: (r["attractor"], round(r["flow"], 6)) for r in found.collect()} == want


@pytest.mark.parametrize("n", [0, 1, 3])
def test_too_few_for_a_population(spark, n):
    assert populations(table(spark, np.zeros((n, DIM), np.float32)), "id", "v", DIM).count() == 0


def test_copies_alone_are_no_population(spark):
    x = np.repeat(np.array([[random.random()] * DIM], np.float32), 50, 0)
    assert populations(table(spark, x), "id", "v", DIM).count() == 0


def test_labels(spark, root):
    assert clusters.p1_found(spark, root).columns == ["cell_id", "clusters"]


@pytest.mark.parametrize("pops, sizes, cell", [(10, (30, 301), 4000), (100, (30, 301), 700), (1000, (20, 40), 2500)])
def test_planted_populations_come_back_one_to_one(spark, monkeypatch, pops, sizes, cell):
    monkeypatch.setattr(clusters, "CELL_ROWS", cell)
    rng = np.random.default_rng(pops)
    size = rng.integers(*sizes, pops)
    which = np.repeat(np.arange(pops), size)
    c = rng.normal(0, 40, (pops, DIM))
    x = c[which] + rng.normal(0, 1, (len(which), DIM))
    strays = rng.uniform(-400, 400, (len(x) // 100, DIM))
    order = rng.permutation(len(x) + len(strays))
    x, which = np.concatenate([x, strays]).astype(np.float32)[order], np.concatenate([which, np.full(len(strays), -1)])[order]
    found = {r["id"]: r["cluster"] for r in populations(table(spark, x), "id", "v", DIM).collect()}
    owner, homes = {}, {}
    for k, cluster in found.items():
        owner.setdefault(cluster, set()).add(int(which[k]))
        homes.setdefault(int(which[k]), set()).add(cluster)
    assert all(len(v - {-1}) == 1 for v in owner.values())
    one = sum(len(homes.get(w, ())) == 1 for w in range(pops))
    assert one >= 0.99 * pops and len(owner) == pops
    assert sum(which[k] >= 0 for k in found) >= 0.998 * (which >= 0).sum() and sum(which[k] < 0 for k in found) <= 0.02 * len(strays)


def test_populations_that_no_row_of_the_sample_is_of(spark, monkeypatch):
    monkeypatch.setattr(clusters, "SAMPLE", 300)
    monkeypatch.setattr(clusters, "CELL_ROWS", 600)
    rng = np.random.default_rng(4)
    size = [900] * 4 + [10, 20, 40, 60] * 10
    which = np.repeat(np.arange(len(size)), size)
    c = rng.normal(0, 3, (len(size), 30))
    x = (c[which] + rng.normal(0, 1, (len(which), 30))).astype(np.float32)
    found = {r["id"]: r["cluster"] for r in populations(table(spark, x), "id", "v", dim=30).collect()}
    owner = {}
    for k in range(len(x)):
        owner.setdefault(found.get(k), set()).add(int(which[k]))
    whole = [w for w in range(len(size)) if len({found.get(k) for k in np.flatnonzero(which == w)}) == 1]
    assert None not in owner and all(len(v) == 1 for v in owner.values())
    assert set(range(4, len(size))) <= set(whole)


def test_a_long_population_and_a_hot_vector(spark):
    rng = np.random.default_rng(2)
    line = np.zeros((3000, DIM))
    line[:, 0] = rng.uniform(0, 300, 3000)
    line += rng.normal(0, 0.3, line.shape)
    long = rng.normal(0, 1, (3000, DIM)) * [25, 3, 2, 1, 1, 1] + np.array([0, -90] + [0] * (DIM - 2))
    other = rng.normal(0, 1, (1500, DIM)) + np.array([0, 60] + [0] * (DIM - 2))
    other[:700] = other[0]
    found = {r["id"]: r["cluster"] for r in populations(table(spark, np.concatenate([line, long, other]).astype(np.float32)), "id", "v", DIM).collect()}
    parts = [{found[k] for k in range(*ends) if k in found} for ends in ((0, 3000), (3000, 6000), (6000, 7500))]
    assert len(found) >= 7400 and not parts[0] & parts[1] and not parts[0] & parts[2] and not parts[1] & parts[2]
    assert len(parts[2]) == 1 and len(parts[1]) <= 2  # the thread-like one may come in pieces


@pytest.mark.parametrize("dim", [4, 16])
def test_many_lists_of_vectors_without_structure(spark, monkeypatch, dim):
    monkeypatch.setattr(neighbours, "LIST_ROWS", 30)
    n = 6000
    x = np.random.default_rng(dim).normal(0, 1, (n, dim)).astype(np.float32)
    d = np.sqrt(np.maximum((x.astype(float) ** 2).sum(1)[:, None] + (x.astype(float) ** 2).sum(1)[None] - 2 * x.astype(float) @ x.T.astype(float), 0))
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, 1)[:, :5]
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "id long, v array<float>").repartition(4)
    found = got(nearest(df, "id", "v", 5, dim=dim, asked=F.col("id") % 20 == 0))
    asked = range(0, n, 20)
    hit = sum(len(set(want[k].tolist()) & {i for i, _ in found[k]}) for k in asked)
    assert hit / (5 * len(asked)) >= 0.93
    radius = float(np.quantile(d.min(1), 0.5))
    within = {k: [j for j in want[k].tolist() if d[k, j] <= radius * 0.9999] for k in range(n)}
    found = got(nearest(df, "id", "v", 5, dim=dim, radius=radius))
    missed = sum(len(set(v) - {i for i, _ in found.get(k, ())}) for k, v in within.items())
    assert missed <= 0.001 * sum(map(len, within.values()))


def test_everything_is_found_if_every_list_is_read(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST_ROWS", 30)
    x = np.random.default_rng(9).normal(0, 1, (600, 12)).astype(np.float32)
    want = brute(x, list(range(600)), 4)
    assert got(nearest(table(spark, x), "id", "v", 4, dim=12, recall=1)) == want


def test_no_near_list_is_missed():
    rng = np.random.default_rng(2)
    c, x = rng.normal(size=(3000, 30)).astype(np.float32), rng.normal(size=(500, 30)).astype(np.float32)
    graph = neighbours.CentroidGraph(c)
    exact = np.sqrt(((x[:, None].astype(float) - c) ** 2).sum(2))
    ids, d = graph.search(x, 16)
    assert (ids == exact.argsort(1)[:, :16]).all() and np.allclose(d, np.sort(exact, 1)[:, :16], rtol=1e-5)
    ids, flags = neighbours._flags(graph, x, np.arange(500) % 2 == 0, (1, 1.0), 0.5)
    held, read = np.zeros(exact.shape, bool), np.zeros(exact.shape, bool)
    r, k = np.nonzero(flags)
    held[r, ids[r, k]], read[r, ids[r, k]] = flags[r, k] & 1 > 0, flags[r, k] & 2 > 0
    first = exact.argmin(1)
    apart = np.sqrt(((c[first][:, None].astype(float) - c) ** 2).sum(2))
    assert held[exact**2 - exact.min(1, keepdims=True) ** 2 <= 2 * 0.5 * apart].all()
    assert (read.nonzero()[0] == np.arange(0, 500, 2)).all() and (read.nonzero()[1] == first[::2]).all()
