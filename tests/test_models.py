"""Values of operators that SQL doesn't express, against plain numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import ingest
from tessera.functions import stats as S
from tessera.operators import clustering, displays, graph, groups, intervals, links, lsi, markers, matrix, motifs, qc
from tessera.operators.skew import salted_aggregate
from tessera.project import Project
from tessera.sources import files


def vectors(spark, x, ids=None):
    return spark.createDataFrame([(int(k), [float(v) for v in row]) for k, row in zip(range(len(x)) if ids is None else ids, x)], "id long, v array<double>")


def entries(spark, x, names=("feature", "cell")):
    return spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*x.nonzero())], f"{names[0]} long, {names[1]} long, value double")


@pytest.mark.parametrize("cell, block", [(40, 16), (2000, 50)])
def test_exact_neighbours_over_many_cells(spark, monkeypatch, cell, block):
    monkeypatch.setattr(graph, "CELL_ROWS", cell)
    monkeypatch.setattr(graph, "BLOCK", block)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (200, 3)), rng.normal(20, 0.1, (60, 3)), np.repeat(rng.normal(5, 1, (1, 3)), 40, 0), np.round(rng.normal(0, 1, (60, 3)))])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = {}
    for a in range(0, len(x), 3):
        order = sorted((round(d[a, b], 9), b) for b in range(len(x)) if b != a)
        want[a] = [b for _, b in order[:6]]
    df = vectors(spark, x)
    got = {}
    for r in graph.exact_neighbours(df, df.where("id % 3 = 0"), "id", "v", 6).orderBy("query", "rnk").collect():
        got.setdefault(r["query"], []).append(r["neighbour"])
    assert {a: [round(d[a, b], 9) for b in v] for a, v in got.items()} == {a: [round(d[a, b], 9) for b in v] for a, v in want.items()}
    apart = [a for a in want if a < 260]  # without exact ties
    assert all(got[a] == want[a] for a in apart)


def test_neighbours_of_nothing(spark):
    df = vectors(spark, np.zeros((0, 3)))
    assert graph.exact_neighbours(df, df, "id", "v", 3).count() == 0
    one = vectors(spark, np.zeros((1, 3)))
    assert graph.exact_neighbours(one, one, "id", "v", 3).count() == 0 and graph.exact_neighbours(one, one, "id", "v", 3, keep_self=True).count() == 1


def test_modularity_finds_planted_groups(spark):
    rng = np.random.default_rng(3)
    group = np.arange(60) // 15
    pairs = [(a, b, 1.0) for a in range(60) for b in range(a + 1, 60) if rng.random() < (0.6 if group[a] == group[b] else 0.03)]
    edges = spark.createDataFrame(pairs, "a long, b long, weight double")
    found = clustering.modularity_clusters(edges, 1.0)
    label = {r["id"]: r["group"] for r in found.collect()}
    assert len(label) == 60 and len(set(label.values())) == 4 and all(len({label[k] for k in range(60) if group[k] == g}) == 1 for g in range(4))
    m = sum(w for *_, w in pairs)
    k = np.zeros(60)
    for a, b, w in pairs:
        k[a] += w
        k[b] += w
    want = sum(w for a, b, w in pairs if label[a] == label[b]) / m - sum(k[[i for i in range(60) if label[i] == g]].sum() ** 2 for g in set(label.values())) / (4 * m * m)
    assert clustering.modularity(edges, found) == pytest.approx(want)
    finer = clustering.modularity_clusters(edges, 6.0).select("group").distinct().count()
    assert finer > 4


def test_bias_clusters_are_named_and_dissolved(spark):
    rng = np.random.default_rng(1)
    n = 3000
    group = np.where(np.arange(n) < 20, "deep", np.where(np.arange(n) < 40, "fine", np.where(np.arange(n) < 1500, "A", "B")))
    value = np.where(group == "deep", 1e5 + np.arange(n), rng.permutation(n))
    g = spark.createDataFrame([(int(i), str(z)) for i, z in enumerate(group)], "id long, group string")
    b = spark.createDataFrame([(int(i), float(z)) for i, z in enumerate(value)], "id long, value double")
    rows = {r["group"]: r for r in clustering.biased_clusters(g, b).collect()}
    assert set(rows) == {"deep", "fine"} and rows["deep"]["biased"] and not rows["fine"]["biased"] and rows["deep"]["proportion"] == 1
    x = np.where(np.isin(group, ["B"]), 5.0, 0.0)[:, None] + rng.normal(0, 0.1, (n, 2))
    left = clustering.without_bias(g, clustering.biased_clusters(g, b), vectors(spark, x)).groupBy("group").count().collect()
    assert {r["group"] for r in left} == {"A", "B", "fine"} and sum(r["count"] for r in left) == n


def test_labels_go_to_near_vectors(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(0, 1, (90, 3)) + 8 * np.repeat(np.arange(3), 30)[:, None], rng.normal(0, 1, (30, 3)) + 8 * np.repeat(np.arange(3), 10)[:, None]
    labels = spark.createDataFrame([(k, f"L{k // 30}") for k in range(90)], "id long, label string")
    got = {r["query"]: (r["label"], r["score"]) for r in clustering.transfer_labels(vectors(spark, x), vectors(spark, y), labels, 9).collect()}
    assert got == {k: (f"L{k // 10}", 1.0) for k in range(30)}


def test_lsi_model_projects_what_it_left_out(spark):
    rng = np.random.default_rng(7)
    x = (rng.random((80, 60)) < 0.3).astype(float)
    x[:, 0] = 1  # a cell of uncommon depth
    model = lsi.fit_lsi(entries(spark, x), 5, outliers=(0.02, 0.98))
    got = {r["cell"]: np.array(r["v"]) for r in model.scores.collect()}
    depth = x.sum(0)
    inside = np.flatnonzero((depth >= np.sort(depth)[1]) & (depth <= np.sort(depth)[-2]))
    assert set(got) == set(range(60)) and model.n in (len(inside), len(inside) - 1, len(inside) + 1)
    u = {r["feature"]: np.array(r["v"]) for r in model.loadings.collect()}
    df = {r["feature"]: r["df"] for r in model.df.collect()}
    weighted = np.log1p(x / depth * (model.n / np.array([df[i] for i in range(80)]))[:, None] * 1e4)
    weighted[x == 0] = 0
    want = np.array([u[i] for i in range(80)]).T @ weighted
    assert max(np.abs(got[j] - want[:, j]).max() for j in range(60)) < 1e-6
    assert model.depth_correlation == pytest.approx([np.corrcoef(want[k], np.log10(depth + 1))[0, 1] for k in range(5)], abs=1e-6)
    assert model.vectors(0.5).first()["v"] is not None and len(model.vectors(0.5).first()["v"]) == len(model.kept(0.5))


def test_bounded_sample(spark):
    df = spark.createDataFrame([(f"c{k}", float(k)) for k in range(1000)], "cell string, depth double")
    got = [r["depth"] for r in lsi.bounded_sample(df, "depth", 100, (0.1, 0.9)).collect()]
    assert len(got) == 100 and min(got) >= 45 and max(got) <= 955 and len(lsi.bounded_sample(df, "depth", 980, (0.1, 0.9)).collect()) == 980


def test_markers_against_cells_of_like_depth(spark):
    rng = np.random.default_rng(4)
    depth = np.concatenate([rng.permutation(120), rng.permutation(120) + 90])  # depths that hardly overlap
    group = np.repeat(["a", "b"], 120)
    x = rng.poisson(1.0, (15, 240)) + np.outer(np.arange(15) == 3, (group == "a") * 3)
    cells = spark.createDataFrame([(int(j), str(group[j]), float(depth[j]), 2.0) for j in range(240)], "cell long, grp string, depth double, norm double")
    matched = markers.matched_background(cells, "grp", ["depth"]).collect()
    assert sum(r["group"] == "a" for r in matched) == 120 == len({r["matched"] for r in matched if r["group"] == "a"})
    m = entries(spark, x.astype(float))
    got = {(r["group"], r["feature"]): r for r in markers.marker_features(m, cells, "grp", ["depth"]).collect()}
    for (g, f), r in got.items():
        fore, back = [int(z["cell"]) for z in matched if z["group"] == g], [int(z["matched"]) for z in matched if z["group"] == g]
        u, v = x[f, fore], x[f, back]
        assert r["auc"] == pytest.approx(np.mean([(p > q) + 0.5 * (p == q) for p in u for q in v]))
    assert len(got) == 30 and min((r for (g, _), r in got.items() if g == "a"), key=lambda r: r["fdr"])["feature"] == 3
    few = markers.matched_background(cells, "grp", ["depth"], max_cells=30, use=["a"]).collect()
    assert len(few) == 30 and {r["group"] for r in few} == {"a"}
    half = markers.matched_background(cells, "grp", ["depth"], buffer_ratio=0.5, use=["b"]).collect()
    assert len(half) == 60
    scaled = markers.scaled_by(m, cells, "norm", 10.0).agg(F.sum("value")).first()[0]
    assert scaled == pytest.approx(x.sum() * 5)


def test_deviations(spark):
    rng = np.random.default_rng(6)
    x = rng.poisson(0.5, (20, 12)).astype(float)
    x[:, 11] = 0
    sets = {"m": [0, 3, 5, 7], "n": [1, 2, 19]}
    background = {(p, i): int(rng.integers(20)) for p in range(20) for i in range(1, 7)}
    counts = entries(spark, x, ("peak_id", "cell"))
    annotation = spark.createDataFrame([(m, p) for m, v in sets.items() for p in v], "motif string, peak_id long")
    drawn = spark.createDataFrame([(p, i, b) for (p, i), b in background.items()], "peak_id long, iteration int, background long")
    got = {(r["motif"], r["cell"]): (r["deviation"], r["z"]) for r in motifs.deviations(counts, annotation, drawn).collect()}
    share, depth = x.sum(1) / x.sum(), x.sum(0)
    dev = lambda peaks, j: x[peaks, j].sum() / (share[peaks].sum() * depth[j]) - 1
    assert set(got) == {(m, j) for m in sets for j in range(11)}
    for (m, j), (d, z) in got.items():
        around = [dev([background[p, i] for p in sets[m]], j) for i in range(1, 7)]
        assert d == pytest.approx(dev(sets[m], j) - np.mean(around))
        assert z == pytest.approx(d / np.std(around, ddof=1)) if np.std(around) > 1e-9 else z is None


def test_module_score(spark):
    rng = np.random.default_rng(8)
    x = rng.poisson(2, (30, 8)).astype(float)
    totals = spark.createDataFrame([(i, float(x[i].sum())) for i in range(30)], "feature long, total double")
    sets = spark.createDataFrame([("m", 3), ("m", 11)], "module string, feature long")
    cells = spark.range(8).select(F.col("id").alias("cell"))
    got = {r["cell"]: r["score"] for r in graph.module_score(entries(spark, x), sets, totals, cells, bins=1, background=1000).collect()}
    rest = [i for i in range(30) if i not in (3, 11)]  # one bin: all others are background
    assert got == pytest.approx({j: x[[3, 11], j].mean() - x[rest, j].mean() for j in range(8)})


def test_knn_groups_in_order(spark):
    x = np.random.default_rng(9).normal(0, 1, (40, 2))
    df = vectors(spark, x)
    near = graph.exact_neighbours(df, df.where("id < 20"), "id", "v", 5)
    sets = {}
    for r in near.collect():
        sets.setdefault(r["query"], {r["query"]}).add(r["neighbour"])
    kept = []
    for g in sorted(sets):
        if all(len(sets[g] & sets[h]) <= 0.5 * 6 for h in kept):
            kept.append(g)
    got = {}
    for r in graph.knn_groups(near, 5, 0.5).collect():
        got.setdefault(r["group"], set()).add(r["id"])
    assert got == {g: sets[g] for g in kept}
    assert links.cell_aggregates(df.withColumnRenamed("id", "cell"), 5, 12).select("group").distinct().count() <= 12


def test_impute(spark):
    x = np.random.default_rng(10).normal(0, 1, (30, 3))
    w = graph.impute_weights(vectors(spark, x), "id", "v", 10, replicates=3)
    m = entries(spark, np.abs(np.random.default_rng(11).normal(0, 1, (4, 30))))
    weights, values = {}, {}
    for r in w.collect():
        weights[r["a"], r["b"]] = weights.get((r["a"], r["b"]), 0) + r["weight"]
    for r in m.collect():
        values[r["feature"], r["cell"]] = r["value"]
    got = {(r["feature"], r["cell"]): r["value"] for r in graph.impute(m, w).collect()}
    for f in range(4):
        for a in range(30):
            assert got[f, a] == pytest.approx(sum(weights.get((a, b), 0) * values[f, b] for b in range(30)))
    assert w.select("replicate").distinct().count() == 3


def test_peak_gene_links_and_null_pairs(spark):
    rng = np.random.default_rng(12)
    peaks = spark.createDataFrame([(k, f"c{k % 2}", 1000 * k + 1, 1000 * k + 501) for k in range(12)], "peak_id long, chr string, start_pos long, end_pos long")
    genes = spark.createDataFrame([(100 + k, f"c{k % 2}", 2500 * k + 1, 2500 * k + 900, "+-"[k % 2]) for k in range(5)], "gene_id long, chr string, start_pos long, end_pos long, strand string")
    p, g = rng.poisson(3, (12, 14)).astype(float), rng.poisson(3, (5, 14)).astype(float)
    pm = entries(spark, p, ("feature", "group"))
    gm = entries(spark, g, ("feature", "group")).withColumn("feature", F.col("feature") + 100)
    log = lambda z: np.log2(z * 1e4 / z.sum(0) + 1)
    want = {}
    for i in range(12):
        for k in range(5):
            at, middle = (2500 * k + 1) if k % 2 == 0 else (2500 * k + 900), 1000 * i + 251
            if i % 2 == k % 2 and abs(at - middle) - 1 <= 3000:
                want[i, 100 + k] = np.corrcoef(log(p)[i], log(g)[k])[0, 1]
    got = {(r["id1"], r["id2"]): r["correlation"] for r in links.peak_gene_links(pm, gm, peaks, genes, 14, 3000).collect()}
    assert abs(len(got) - len(want)) <= 2 and all(got[k] == pytest.approx(want[k]) for k in set(got) & set(want)) and len(set(got) & set(want)) >= len(want) - 2
    for r in links.null_correlations(peaks, genes, 3).collect():
        assert r["id1"] % 2 != (r["id2"] - 100) % 2


def test_background_and_stratified_choices(spark):
    v = list(np.random.default_rng(13).permutation(50))
    df = spark.createDataFrame([(k, int(x)) for k, x in enumerate(v)], "peak_id long, total long")
    got = {}
    for r in motifs.background_features(df, "peak_id", ["total"], 4).collect():
        got.setdefault(r["peak_id"], {})[r["iteration"]] = r["background"]
    for k, chosen in got.items():
        far = sorted(abs(v[k] - v[b]) for b in range(50) if b != k)[3]
        assert set(chosen) == {1, 2, 3, 4} and len(set(chosen.values())) == 4 and all(abs(v[k] - v[b]) <= far and b != k for b in chosen.values())
    cells = spark.createDataFrame([(f"s{int(k >= 900)}", f"c{k}") for k in range(1000)], "stratum string, cell string")
    n = {r["stratum"]: r["count"] for r in matrix.stratified_sample(cells, "stratum", "cell", 100).groupBy("stratum").count().collect()}
    assert n == {"s0": 90, "s1": 10}
    again = matrix.stratified_sample(cells.repartition(7), "stratum", "cell", 100)
    assert again.exceptAll(matrix.stratified_sample(cells, "stratum", "cell", 100)).count() == 0


def greedy(data):
    kept = []
    for x in sorted(data, key=lambda x: (-x[3], x[1], x[2], x[4])):
        if not any(x[0] == y[0] and x[1] <= y[2] and x[2] >= y[1] for y in kept):
            kept.append(x)
    return {x[4] for x in kept}


@pytest.mark.parametrize("run_rows, rounds", [(500_000, 20), (10, 20), (10, 1)])
def test_greedy_choice_of_long_and_short_runs(spark, run_rows, rounds):
    r = random.Random(3)
    falling = [("f", 10 * k, 10 * k + 12, 1000 - k, k) for k in range(200)]
    mixed = [(r.choice("xy"), s := r.randrange(1, 3000), s + r.randrange(60), r.randrange(40), 1000 + k) for k in range(400)]
    df = spark.createDataFrame(falling + mixed, "chr string, start_pos long, end_pos long, score long, id long")
    assert {x["id"] for x in intervals.non_overlapping(df, "score", ["id"], run_rows=run_rows, rounds=rounds).collect()} == greedy(falling + mixed)


def test_ten_thousand_chained_intervals(spark):
    data = [("c", 10 * k, 10 * k + 12, 20_000 - k, k) for k in range(10_000)]
    df = spark.createDataFrame(data, "chr string, start_pos long, end_pos long, score long, id long").repartition(5)
    assert sorted(x["id"] for x in intervals.non_overlapping(df, "score").collect()) == list(range(0, 10_000, 2))


def test_runs_over_slabs(spark):
    r = random.Random(4)
    data = [(r.choice("xy"), s := r.randrange(1, 2000), s + r.choice((3, 5, 300))) for _ in range(120)]
    df = spark.createDataFrame(data, "chr string, start_pos long, end_pos long")
    want = {}
    for c in "xy":
        reach, run = -1, None
        for x in sorted(d for d in data if d[0] == c):
            run = x[1] if run is None or x[1] > reach else run
            reach = max(reach, x[2])
            want[x] = run
    for slab in (16, 1 << 24):
        assert {(x["chr"], x["start_pos"], x["end_pos"]): x["_run"] for x in intervals.overlap_runs(df, slab).collect()} == want


def test_reproducible_peaks(spark):
    rng = random.Random(5)
    data = [("c", p := rng.randrange(300, 20_000), p, float(rng.randrange(1000)), f"r{k % 3}") for k in range(90)]
    summits = spark.createDataFrame(data, "chr string, start_pos long, end_pos long, score double, replicate string")
    black = spark.createDataFrame([("c", 5000, 6000)], "chr string, start_pos long, end_pos long")
    wide = [(c, s - 250, s + 250, x, rep) for c, s, _, x, rep in data if not 5000 <= s <= 6000 and s - 250 > 0]
    own = []
    for rep in ("r0", "r1", "r2"):
        rows = [w for w in wide if w[4] == rep]
        kept = [w for w in rows if w[1] in {z[1] for z in kept_by(rows)}]
        ranks = sorted(w[3] for w in kept)
        own += [(*w, math.floor((sum(z < w[3] for z in ranks) + sum(z <= w[3] for z in ranks) + 1) / 2) / len(ranks)) for w in kept]
    picked = []
    for w in sorted(own, key=lambda w: (-w[5], w[1], w[2], w[4])):
        if not any(w[1] <= z[2] and w[2] >= z[1] for z in picked):
            picked.append(w)
    want = {w[1] for w in picked if len({z[4] for z in own if z[1] <= w[2] and z[2] >= w[1]}) >= 2}
    assert {r["start_pos"] for r in groups.reproducible_peaks(summits, black).collect()} == want


def kept_by(rows):
    kept = []
    for w in sorted(rows, key=lambda w: (-w[3], w[1], w[2])):
        if not any(w[1] <= z[2] and w[2] >= z[1] for z in kept):
            kept.append(w)
    return kept


def test_tile_peaks(spark):
    data = [("c", t, f"x{k}", 1) for t, n in ((1, 30), (2, 3), (3, 4), (4, 2)) for k in range(n)]
    tiles = spark.createDataFrame(data, "chr string, tile long, cell string, value int")
    g = spark.createDataFrame([(f"x{k}", "g") for k in range(30)], "cell string, group string")
    found = groups.tile_peaks(tiles, g, 4).collect()
    mean = 39 / 4
    upper = lambda n: 1 - sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(n))
    assert [(r["tile"], r["n"]) for r in found] == [(1, 30)] and found[0]["p"] == pytest.approx(min(upper(30), upper(31)), rel=200) and found[0]["fdr"] <= 0.1


def test_quantiles_and_small_statistics(spark):
    rng = np.random.default_rng(14)
    data = [(str(g), None if rng.random() < 0.1 else float(rng.integers(0, 50))) for g in rng.integers(0, 3, 400)]
    df = spark.createDataFrame(data, "g string, x double")
    got = {r["g"]: r for r in S.quantiles(df, "x", {"a": 0.0, "b": 0.31, "c": 0.5, "d": 1.0}, ["g"]).collect()}
    for g in "012":
        v = [x for k, x in data if k == g and x is not None]
        assert [got[g][c] for c in "abcd"] == pytest.approx(list(np.quantile(v, [0, 0.31, 0.5, 1])))
    x = rng.poisson(1, (5, 9)).astype(float)
    for r in matrix.scale_rows(entries(spark, x), ["feature"], 9).collect():
        assert r["scaled"] == pytest.approx(r["value"] / math.sqrt((x[r["feature"]] ** 2).sum() / 8))
    for r in matrix.row_logs(entries(spark, x), ["feature"], 9).collect():
        y = np.log(x[r["feature"]] + 1)
        assert r["geometric_mean"] == pytest.approx(math.exp(y.mean()) - 1) and r["geometric_sd"] == pytest.approx(math.exp(y.std(ddof=1)))
    points = spark.createDataFrame([(float(a), float(b)) for a, b in rng.normal(0, 1, (500, 2))], "x double, y double")
    d = displays.density(points, "x", "y", 20).toPandas()
    area = (np.diff(np.sort(d.x.unique())).mean() * np.diff(np.sort(d.y.unique())).mean()) * d.density.sum()
    assert len(d) == 400 and 0.8 < area <= 1.01 and d.loc[d.density.idxmax(), ["x", "y"]].abs().max() < 0.8
    b = spark.createDataFrame([(k, [0, 2, 2, 3], [1, 4, 0], [7, 8, 9]) for k in range(2)] + [(2, [0], [], [])], "part int, indptr array<int>, indices array<int>, data array<int>")
    assert sorted(map(tuple, matrix.coordinates(b, ["part"]).collect())) == [(k, *e) for k in range(2) for e in ((0, 2, 9), (1, 0, 7), (4, 0, 8))]
    assert [r["n"] for r in salted_aggregate(spark.createDataFrame([("a",)] * 50, "k string"), ["k"], {"n": ("count", F.lit(1))}, 8, min_rows=5).collect()] == [50]


def test_cut_off_of_a_motif(spark):
    w = np.log2(np.array([[0.7, 0.1, 0.1, 0.85], [0.1, 0.1, 0.7, 0.05], [0.1, 0.7, 0.1, 0.05], [0.1, 0.1, 0.1, 0.05]]) / 0.25)
    scores = sorted((sum(w[c, j] for j, c in enumerate((a, b, c_, d))) for a in range(4) for b in range(4) for c_ in range(4) for d in range(4)), reverse=True)
    for p in (1 / 256, 5 / 256, 20 / 256):
        cut = motifs.score_cut_off(w, p)
        assert sum(s >= cut - 0.003 for s in scores) / 256 <= p + 4 / 256 and sum(s >= cut - 0.003 for s in scores) >= 1
    hits = motifs.scan_motifs(spark.createDataFrame([(1, "AGCATTTTT")], "id int, seq string"), "id", {"m": w}, p=1 / 200).collect()
    assert {(r["position"], r["strand"]) for r in hits} >= {(1, "+")} or len(hits) <= 2


def test_footprint_less_its_bias(spark):
    profile = spark.createDataFrame([("g", 0, 3.0), ("g", 1, 2.0), ("g", 2, 1.0)], "g string, offset long, value double")
    bias = spark.createDataFrame([("g", 0, 1.5), ("g", 1, 0.0)], "g string, offset long, expected double")
    less = {r["offset"]: r["normalised"] for r in motifs.normalise_footprint(profile, bias, "g").collect()}
    over = {r["offset"]: r["normalised"] for r in motifs.normalise_footprint(profile, bias, "g", "divide").collect()}
    assert less == {0: 1.5, 1: 2.0, 2: None} and over == {0: 2.0, 1: None, 2: None}


def test_gene_annotation(spark, tmp_path):
    (tmp_path / "a.gtf").write_text(
        '# c\nchr1\ts\tgene\t10\t90\t.\t+\t.\tgene_id "g1"; gene_name "ABC";\nchr1\ts\texon\t10\t20\t.\t+\t.\tgene_id "g1"; exon_number 1;\n'
        'chr1\ts\texon\t80\t95\t.\t+\t.\tgene_id "g1";\nchr2\ts\tgene\t5\t50\t.\t-\t.\tgene_id "g2";\nchr2\ts\tCDS\t5\t9\t.\t-\t.\tgene_id "g2";\n'
    )
    genes, exons, starts = files.gene_annotation(files.read_gtf(spark, str(tmp_path / "a.gtf")))
    assert [(r["gene_id"], r["symbol"], r["start_pos"], r["end_pos"]) for r in genes.orderBy("gene_id").collect()] == [(1, "ABC", 10, 95), (2, "g2", 5, 50)]
    assert exons.count() == 2 and {(r["chr"], r["pos"]) for r in starts.collect()} == {("chr1", 10), ("chr2", 50)}


def fragment_rows(n_cells, per_cell, seed=1):
    r = random.Random(seed)
    return [("chr1", s := r.randrange(1, 90_000), s + r.randrange(30, 400), f"b{c}") for c in range(n_cells) for _ in range(per_cell if c else 5)]


def test_ingest_in_one_call(spark, tmp_path):
    data = fragment_rows(8, 200)
    df = spark.createDataFrame(data, "chr string, start_pos long, end_pos long, barcode string")
    (tmp_path / "f.tsv").write_text("".join(f"{c}\t{s - 1}\t{e}\t{b}\t1\n" for c, s, e, b in data))
    genome = ingest.Genome(
        spark.createDataFrame([("chr1", 100_000)], "chr string, len long"),
        spark.createDataFrame([(k, f"G{k}", "chr1", 9000 * k + 3000, 9000 * k + 5000, "+-"[k % 2]) for k in range(9)], "gene_id long, symbol string, chr string, start_pos long, end_pos long, strand string"),
        spark.createDataFrame([("chr1", 1000, 1999)], "chr string, start_pos long, end_pos long"),
    )
    p = ingest.create_project(spark, str(tmp_path / "p"), {"s": df, "t": str(tmp_path / "f.tsv")}, genome, least_frags=100, least_tss=0.0)
    again = Project.load(spark, str(tmp_path / "p"))
    assert again.n_cells() == p.n_cells() == 14 and sorted(again.matrices()) == ["genes", "tiles"]
    assert {r["cell"]: r["n_frags"] for r in again.cells.collect()} == {f"{s}#b{c}": 200 for s in "st" for c in range(1, 8)}
    kept = again.tables["fragments"]
    assert kept.count() == 14 * 200
    tiles = again.matrix("tiles", cells=spark.createDataFrame([("s#b1",)], "cell string"), chroms=["chr1"])
    mine = {x // 500 + 1 for c, s, e, b in data if b == "b1" for x in (s, e)} - {3, 4}  # tiles that touch the blacklist
    assert {r["feature"] for r in tiles.collect()} == mine
    stats = {r["feature"]: r for r in again.tables["stats/tiles"].collect()}
    whole = again.matrix("tiles").groupBy("feature").agg(F.sum("value").alias("n")).collect()
    assert all(stats[r["feature"]]["total"] == r["n"] and stats[r["feature"]]["mean"] == pytest.approx(r["n"] / 14) for r in whole)
    wanted = spark.createDataFrame([("chr1", 1), ("chr1", 9999)], "chr string, feature long")
    assert again.matrix("tiles", features=wanted, pad=True).where("feature = 9999").collect()[0]["value"] == 0
    assert again.gene_starts().count() == 9


def test_saving_in_place(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "p")
    cells = spark.createDataFrame([("a#1", "a"), ("b#2", "b")], "cell string, sample string")
    p = Project(spark, root, cells)
    p.add_table("x", spark.range(3), {"k": 1})
    p = p.save()
    for k in range(2):
        p.set_cell_column("mark", k)
        p = p.save()
        assert {r["mark"] for r in p.cells.collect()} == {k} and p.tables["x"].count() == 3
    p.add_sample_column(spark.createDataFrame([("a", "kit1")], "sample string, kit string"), "kit")
    p = p.save()
    assert {r["sample"]: r["kit"] for r in p.sample_column("kit").collect()} == {"a": "kit1", "b": None}
    with pytest.raises(ValueError):
        p.add_sample_column(spark.createDataFrame([("z", "k")], "sample string, kit string"), "other")
    p.set_cell_column("mark", 9)
    p.tables["broken"] = spark.range(5).select(F.expr("raise_error('stop')").alias("x"))
    with pytest.raises(Exception):
        p.save()
    whole = Project.load(spark, root)
    assert {r["mark"] for r in whole.cells.collect()} == {1} and whole.tables["x"].count() == 3 and "broken" not in whole.tables
    whole.set_cell_column("mark", 2).save()
    assert {r["mark"] for r in Project.load(spark, root).cells.collect()} == {2}
    assert len([f for f in (tmp_path / "p").iterdir() if f.name.startswith("manifest-")]) == 1
    with pytest.raises(FileNotFoundError):
        Project.load(spark, str(tmp_path / "none"))


def test_no_nested_loops_over_large_sides(spark):
    """Plans hold no product of two tables but with one-row sides."""
    a = spark.createDataFrame([("c", 1, 5, 1)], "chr string, start_pos long, end_pos long, score int")
    for df in (intervals.overlap_pairs(a, a), intervals.overlap_join(a, a, "semi"), qc.feature_counts(spark.createDataFrame([("x", "c", 3)], "cell string, chr string, pos long"), a, "f")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
