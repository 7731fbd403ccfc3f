"""Operators whose work once grew with pairs that their result does not hold."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.operators import graph, links, matrix, motifs
from tessera.operators import intervals as I


def test_background_of_many_equal_features(spark, monkeypatch):
    v = [(3 * k) % 7 // 2 for k in range(300)] + [9]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(v)], "peak_id long, total int")
    compared, exact = [], graph.exact_neighbours
    monkeypatch.setattr(graph, "exact_neighbours", lambda data, *rest, **more: compared.append(data.count()) or exact(data, *rest, **more))
    found = motifs.background_features(df, "peak_id", ["total"], 5).toPandas()
    assert compared == [len(set(v))]
    order = {x: i for i, x in enumerate(sorted(set(v)))}
    rank = np.array([np.floor(np.mean([i + 1 for i, z in enumerate(sorted(v)) if z == x])) / len(v) for x in sorted(order)])[[order[x] for x in v]]
    for k, group in found.groupby("peak_id"):
        near = sorted((abs(rank[k] - rank[b]), b) for b in range(len(v)) if b != k)[:5]
        assert sorted(group["background"]) == sorted(b for _, b in near) and sorted(group["iteration"]) == [1, 2, 3, 4, 5]
    assert found["peak_id"].nunique() == len(v)


def test_deviations_of_points_without_a_matrix(spark):
    rng = np.random.default_rng(2)
    start = rng.integers(1, 400_000, 40)
    peaks = [(k, f"c{k % 2}", int(s), int(s) + [30_000, 200_000][k % 5 == 0]) for k, s in enumerate(start)]  # some reach over several slabs
    points = [(f"x{rng.integers(6)}", f"c{rng.integers(2)}", int(rng.integers(1, 500_000))) for _ in range(400)] * 2
    peaks, points = spark.createDataFrame(peaks, "peak_id long, chr string, start_pos long, end_pos long"), spark.createDataFrame(points, "cell string, chr string, pos long")
    annotation = spark.createDataFrame([(m, k) for k in range(40) for m in "mn" if rng.random() < 0.3], "motif string, peak_id long")
    background = spark.createDataFrame([(k, i, int(rng.integers(40))) for k in range(40) for i in range(1, 5)], "peak_id long, iteration int, background long")
    counts = matrix.feature_matrix(points, peaks, "peak_id", None)
    want = {(r["motif"], r["cell"]): r for r in motifs.deviations(counts, annotation, background).collect()}
    got = motifs.deviations_of_points(points, peaks, annotation, background, motifs.feature_totals(points, peaks, "peak_id")).collect()
    assert len(got) == len(want) == 12
    for r in got:
        assert r["deviation"] == pytest.approx(want[r["motif"], r["cell"]]["deviation"]) and r["z"] == pytest.approx(want[r["motif"], r["cell"]]["z"])


def test_query_of_deviations_makes_no_entry_of_the_matrix(spark, root, monkeypatch):
    monkeypatch.setattr(matrix, "feature_matrix", lambda *a, **k: pytest.fail("a row a peak and cell"))
    assert entry.queries()["deviations"](spark, root).count() > 0


def near_peaks(rng, n):
    at = np.concatenate([rng.integers(1, 200_000, n - 4), [65_534, 65_535, 65_536, 65_536]])  # over the borders of slabs
    return [(int(k), f"c{k % 2}", int(p), int(p) + 1) for k, p in zip(rng.permutation(n), at)]


def test_correlations_of_near_peaks_join_no_pair(spark):
    rng = np.random.default_rng(3)
    peaks, x = near_peaks(rng, 60), rng.poisson(1.5, (60, 14)).astype(float)
    x[7] = 0
    m = spark.createDataFrame([(k, f"g{g}", v) for k, row in enumerate(x.tolist()) for g, v in enumerate(row) if v], "feature long, group string, value double")
    logs = np.log2(x * 1e4 / x.sum(0) + 1)
    want = {(i, j): (abs(p - q), np.corrcoef(logs[i], logs[j])[0, 1], logs[i].var(ddof=1), logs[j].var(ddof=1)) for i, c, p, _ in peaks for j, d, q, _ in peaks if i < j and c == d and abs(p - q) <= 20_000 and 7 not in (i, j)}
    found = links.peak_correlations(m, spark.createDataFrame(peaks, "peak_id long, chr string, start_pos long, end_pos long"), 14, distance=20_000)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[0]
    got = {(r["id1"], r["id2"]): (r["distance"], r["correlation"], r["var1"], r["var2"]) for r in found.collect()}
    assert set(got) == set(want) and found.count() == len(want) and all(got[p] == pytest.approx(want[p]) for p in want)


def test_rounding_as_spark(spark):
    x = np.array([0.5, -0.5, 0.000005, -0.000005, 0.123455, -0.123455, 0.000015, 1.0, -1e-9, 0.1234549999999999])
    want = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "v double").select(F.round("v", 5) + 0.0).collect()]
    assert matrix.rounded(x, 5).tolist() == want and not np.signbit(matrix.rounded(x, 5)[8])


def test_query_of_aggregates_makes_no_entry_of_the_matrix(spark, root, monkeypatch):
    monkeypatch.setattr(matrix, "feature_matrix", lambda *a, **k: pytest.fail("a row a peak and cell"))
    assert entry.queries()["coaccessibility_of_cells"](spark, root).count() > 0


@pytest.mark.parametrize("cut", [0.3, -0.3, 0.6])
def test_tested_links_are_those_of_all_pairs(spark, monkeypatch, cut):
    monkeypatch.setattr(links, "ORDERED", 60)
    rng = np.random.default_rng(4)
    peaks = spark.createDataFrame([(k, c, p, q + 400) for k, c, p, q in near_peaks(rng, 80)], "peak_id long, chr string, start_pos long, end_pos long")
    genes = spark.createDataFrame([(100 + k, f"c{k % 2}", int(p), int(p) + 900, "+-"[k % 2]) for k, p in enumerate(rng.integers(1, 200_000, 30))], "gene_id long, chr string, start_pos long, end_pos long, strand string")
    m = [spark.createDataFrame([(f + k, f"g{g}", float(v)) for k in range(n) for g, v in enumerate(rng.poisson(2, 14)) if v], "feature long, group string, value double") for f, n in ((0, 80), (100, 30))]
    every = links.peak_gene_links(*m, peaks, genes, 14, 30_000)
    columns = ["chr", "id1", "id2", "distance", "correlation", "fdr", "var_quantile"]
    want = {(r["id1"], r["id2"]): r for r in links.filter_links(links.variance_quantiles(every, "var1", "id1", "var_quantile"), cut, 0.99).select(*columns).collect()}
    monkeypatch.setattr(links, "with_significance", lambda *a: pytest.fail("every pair is written and tested"))
    got = {(r["id1"], r["id2"]): r for r in links.tested_links(*m, peaks, genes, 14, 30_000, cut, 0.99).collect()}
    assert set(got) == set(want) and len(want) > 10
    for pair, r in got.items():
        assert all(r[c] == (pytest.approx(want[pair][c]) if isinstance(r[c], float) else want[pair][c]) for c in columns)


def test_overlap_inner_is_not_left_to_few_tasks(spark, root):
    found = entry.queries()["overlap_inner"](spark, root)
    assert found.rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("heavy_rows", [3, 20_000])
def test_many_overlap_pairs_are_all_pairs(spark, heavy_rows):
    rng = random.Random(5)

    def some(n):
        rows = [(k, f"chr{k % 2}", s, s + rng.choice([0, 1, 5, 40, 90, -1, -30])) for k, s in enumerate(rng.choice([7, 16, rng.randrange(-40, 300)]) for _ in range(n))]
        return rows + [rows[0], (n, None, 5, 9), (n + 1, "chr0", None, 9), (n + 2, "chr0", 5, None), (n + 3, "chr9", 1, 900)]

    left, right = some(120), some(90)
    schema = "id long, chr string, start_pos long, end_pos long"
    hits = I.many_overlap_pairs(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), bin_width=16, heavy_rows=heavy_rows, salts=3)
    found = sorted((r["a"]["id"], r["b"]["id"]) for r in hits.select("a", "b").collect())
    sound = lambda rows: [r for r in rows if None not in r]
    want = sorted((a[0], b[0]) for a in sound(left) for b in sound(right) if a[1] == b[1] and a[2] <= b[3] and a[3] >= b[2])
    assert found == want
