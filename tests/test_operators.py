import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import expressions as X
from tessera.functions import stats as S
from tessera.functions import tails
from tessera.operators import graph, groups, intervals, links, lsi, markers, matrix, motifs, qc


def ranges(spark, data, extra=""):
    return spark.createDataFrame(data, "chr string, start_pos long, end_pos long" + extra)


# intervals


def test_extend_and_resize_follow_the_strand(spark, rows):
    df = ranges(spark, [("c", 100, 200, "+"), ("c", 100, 200, "-"), ("c", 100, 200, "*")], ", strand string")
    assert rows(intervals.extend(df, 10, 1).select("start_pos", "end_pos")) == [(90, 201), (90, 201), (99, 210)]
    assert rows(intervals.resize(df, 11, "start", "strand").select("start_pos", "end_pos")) == [(100, 110), (100, 110), (190, 200)]
    assert rows(intervals.resize(df, 11).select("start_pos", "end_pos")) == [(145, 155)] * 3


def random_ranges(n, seed, long=30):
    r = random.Random(seed)
    return [(r.choice("xy"), s := r.randrange(1, 500), s + r.randrange(long), k, r.randrange(40)) for k in range(n)]


@pytest.mark.parametrize("width", [4, 64, 4096])
def test_overlap_joins(spark, width):
    a, b = random_ranges(120, 1), random_ranges(40, 2, 200)
    left, right = ranges(spark, a, ", id int, score int"), ranges(spark, b, ", id int, score int")
    hit = {(x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] <= y[2] and x[2] >= y[1]}
    pairs = [(r[0], r[1]) for r in intervals.overlap_pairs(left, right, width).select("a.id", "b.id").collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == hit
    assert {r["id"] for r in intervals.overlap_join(left, right, "semi", width).collect()} == {i for i, _ in hit}
    assert {r["id"] for r in intervals.overlap_join(left, right, "anti", width).collect()} == {x[3] for x in a} - {i for i, _ in hit}
    inside = {x[3] for x in a for y in b if x[0] == y[0] and x[1] >= y[1] and x[2] <= y[2]}
    assert {r["id"] for r in intervals.overlap_join(left, right, "semi", width, within=True).collect()} == inside


def test_greedy_choice(spark):
    data = random_ranges(150, 5)
    kept = []
    for x in sorted(data, key=lambda x: (-x[4], x[1], x[2], x[3])):
        if not any(x[0] == y[0] and x[1] <= y[2] and x[2] >= y[1] for y in kept):
            kept.append(x)
    got = intervals.non_overlapping(ranges(spark, data, ", id int, score int"), "score", ["id"])
    assert {r["id"] for r in got.collect()} == {x[3] for x in kept}


def test_nearest_point(spark, rows):
    q = ranges(spark, [("c", 1, 1, 1), ("c", 50, 50, 2), ("c", 15, 15, 3), ("d", 5, 5, 4)], ", id int")
    p = spark.createDataFrame([("c", 10, "a"), ("c", 20, "b"), ("c", 20, "A")], "chr string, pos long, name string")
    assert rows(intervals.nearest_point(q, p, "id", F.col("start_pos"), "name").select("id", "distance", "name")) == [(1, 9, "a"), (2, 30, "A"), (3, 5, "a"), (4, None, None)]


def test_tiles_of_whole_chromosomes(spark):
    """Known numbers of tiles from public chromosome lengths."""
    sizes = spark.createDataFrame([("chr5", 180915260), ("chr11", 135006516)], "chr string, len long")
    assert intervals.tile_genome(sizes, 10000).count() == 31593 and intervals.tile_genome(sizes, 25000).count() == 12638


# counts


def test_both_ends_count_also_within_one_tile(spark, rows):
    f = spark.createDataFrame([("s#a", "c", 600, 700), ("s#a", "c", 499, 500), ("s#b", "c", 600, 2000)], "cell string, chr string, start_pos long, end_pos long")
    got = rows(matrix.tile_matrix(qc.insertions(f), 500, binarize=False).select("tile", "cell", "value"))
    assert got == [(1, "s#a", 1), (2, "s#a", 3), (2, "s#b", 1), (5, "s#b", 1)]
    assert sum(v for _, _, v in got) == 2 * 3


def test_nucleosome_classes(spark):
    f = spark.createDataFrame([("a", 1, w) for w in (100, 147, 148, 293, 294, 500)], "cell string, start_pos long, end_pos long")
    r = qc.fragment_info(f).collect()[0]
    assert (r["n_mono"], r["n_di"], r["n_multi"]) == (1, 3, 2)  # width = end - start + 1 here


def test_moments_count_zeros(spark):
    x = np.array([[0, 1, 2, 0], [5, 0, 0, 0], [1, 1, 1, 1]])
    m = spark.createDataFrame([(int(i), int(j), int(x[i, j])) for i, j in zip(*x.nonzero())], "r int, c int, value int")
    for r in matrix.row_moments(m, ["r"], 4).collect():
        assert r["mean"] == pytest.approx(x[r["r"]].mean()) and r["variance"] == pytest.approx(x[r["r"]].var(ddof=1))


def test_compressed_columns(spark, rows):
    b = spark.createDataFrame([([0, 2, 2, 3], [1, 4, 0], [7, 8, 9])], "indptr array<int>, indices array<int>, data array<int>")
    assert rows(matrix.coordinates(b)) == [(0, 2, 9), (1, 0, 7), (4, 0, 8)]


# statistics


def test_ranks_and_quantiles(spark):
    v = [3.0, 1.0, 3.0, 2.0, 3.0]
    df = spark.createDataFrame(list(enumerate(v)), "id int, v double")
    want = pd.Series(v).rank()
    assert {r["id"]: r["rank"] for r in S.average_rank(df, "v").collect()} == dict(enumerate(want))
    assert {r["id"]: r["quantile"] for r in S.rank_quantile(df, "v").collect()} == {i: math.floor(w) / 5 for i, w in enumerate(want)}


def test_bh_is_step_up(spark):
    p = [random.Random(1).random() ** 3 for _ in range(50)]
    got = {r["id"]: r["fdr"] for r in S.adjust_bh(spark.createDataFrame(list(enumerate(p)), "id int, p double"), "p").collect()}
    order, best = sorted(range(50), key=lambda i: p[i]), 1.0
    for k in range(49, -1, -1):
        best = min(best, p[order[k]] * 50 / (k + 1))
        assert got[order[k]] == pytest.approx(best)


def test_rolling_mean_repeats_its_ends(spark):
    df = spark.createDataFrame([(k, float(k * k)) for k in range(7)], "k int, v double")
    got = [r["smooth"] for r in S.rolling_mean(df, "v", "k", 3).orderBy("k").collect()]
    mid = [(a * a + (a + 1) ** 2 + (a + 2) ** 2) / 3 for a in range(5)]
    assert got == pytest.approx([mid[0], *mid, mid[-1]])


def test_tails():
    assert tails.t_two_sided([2.228], [10])[0] == pytest.approx(0.05, abs=1e-4)
    assert tails.normal_two_sided([1.959964])[0] == pytest.approx(0.05, abs=1e-6)
    assert tails.binomial_upper([8], [10], [0.5])[0] == pytest.approx(56 / 1024)
    assert tails.gamma_lower(3, 2.0) == pytest.approx(1 - math.exp(-2) * (1 + 2 + 2))
    want = sum(math.comb(10, i) * math.comb(40, 12 - i) for i in range(5, 11)) / math.comb(50, 12)
    assert math.exp(tails.log_hypergeometric_upper(5, 10, 40, 12)) == pytest.approx(want)


def test_expressions(spark):
    df = spark.createDataFrame([(3.0, 100.0)], "FDR double, nFrags double")
    value = lambda t: df.select(X.expression(t, df.columns)).collect()[0][0]
    assert value("log10(nFrags) * 2") == 4 and value("FDR <= 3 & !(nFrags < 5)") is True and value("FDR^2") == 9 and value("(FDR+1)^2") == 16
    for bad in ("system('x')", "FDR; DROP", "other > 1", "__import__", "FDR `", "'a\\'"):
        with pytest.raises(ValueError):
            X.to_sql(bad, df.columns)
    assert X.threshold("(n+1)/2", 5) == 3 and X.threshold("2", 9) == 2
    with pytest.raises(ValueError):
        X.threshold("__import__", 1)


# tests of features, links, graphs


def dense(spark, x):
    return spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*x.nonzero())], "feature int, cell int, value double")


def test_two_sided_tests(spark):
    rng = np.random.default_rng(3)
    x = rng.poisson(0.8, (12, 30)) + np.outer(np.arange(12) == 4, np.r_[np.full(12, 3), np.zeros(18)]).astype(int)
    sides = spark.createDataFrame([(j, 1 if j < 12 else 2) for j in range(30)], "cell int, side int")
    a, b = x[:, :12], x[:, 12:]
    for r in markers.t_test(dense(spark, x), sides).collect():
        u, v = a[r["feature"]], b[r["feature"]]
        pooled = (11 * u.var(ddof=1) + 17 * v.var(ddof=1)) / 28
        assert r["var1"] == pytest.approx(u.var(ddof=1)) and r["t"] == pytest.approx((u.mean() - v.mean()) / math.sqrt(pooled * (1 / 12 + 1 / 18)))
    for r in markers.wilcoxon(dense(spark, x), sides).collect():
        u, v = a[r["feature"]], b[r["feature"]]
        assert r["auc"] == pytest.approx(np.mean([(p > q) + 0.5 * (p == q) for p in u for q in v]))
    assert min(markers.wilcoxon(dense(spark, x), sides).collect(), key=lambda r: r["p"])["feature"] == 4


def test_correlation_counts_zeros(spark):
    rng = np.random.default_rng(1)
    x = rng.poisson(1, (6, 15)).astype(float)
    m = dense(spark, x).withColumnRenamed("cell", "group").withColumnRenamed("value", "x")
    pairs = spark.createDataFrame([(a, b) for a in range(6) for b in range(a)], "id1 int, id2 int")
    for r in links.pair_correlation(pairs, m, m, 15).collect():
        assert r["correlation"] == pytest.approx(np.corrcoef(x[r["id1"]], x[r["id2"]])[0, 1])


def test_svd_reconstructs(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20, 3)) @ rng.normal(size=(3, 25))
    d, scores, loadings = lsi.svd(dense(spark, x), 3, 4, 2)
    assert d == pytest.approx(np.linalg.svd(x)[1][:3], rel=1e-6)
    v = {r["cell"]: np.array(r["v"]) for r in scores.collect()}
    u = {r["feature"]: np.array(r["v"]) for r in loadings.collect()}
    assert max(abs(u[i] @ v[j] - x[i, j]) for i in u for j in v) < 1e-6


def test_neighbours_and_votes(spark):
    x = np.random.default_rng(4).normal(size=(60, 5))
    df = spark.createDataFrame([(k, [float(v) for v in row], k % 3) for k, row in enumerate(x)], "id int, v array<double>, label int")
    near = graph.exact_neighbours(df, df, "id", "v", 4)
    got = {}
    for r in near.orderBy("query", "rnk").collect():
        got.setdefault(r["query"], []).append(r["neighbour"])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) + np.eye(60) * 1e9
    assert got == {k: list(d[k].argsort()[:4]) for k in range(60)}
    for r in graph.vote(near, df).collect():
        labels = [k % 3 for k in got[r["query"]]]
        assert r["votes"] == max(labels.count(z) for z in range(3))


def test_communities_of_two_cliques(spark):
    e = [(a, b, 1.0) for s in (0, 5) for a in range(s, s + 5) for b in range(a + 1, s + 5)] + [(4, 5, 0.2)]
    g = {r["id"]: r["group"] for r in graph.label_propagation(spark.createDataFrame(e, "a int, b int, weight double")).collect()}
    assert len({g[k] for k in range(5)}) == 1 and len({g[k] for k in range(5, 10)}) == 1 and g[0] != g[9]


def test_impute_weights_sum_to_one(spark):
    x = np.random.default_rng(6).normal(size=(80, 4))
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "id int, v array<double>")
    w = graph.impute_weights(df, "id", "v", 40).groupBy("a").agg(F.sum("weight").alias("s")).collect()
    assert len(w) == 80 and all(r["s"] == pytest.approx(1, abs=1e-5) for r in w)


def test_kmers_and_motifs(spark, rows):
    s = spark.createDataFrame([(1, "ACGTNAC"), (2, "A"), (3, None)], "id int, seq string")
    assert rows(motifs.kmer_positions(s, "id", 2)) == [(1, 1, "AC"), (1, 2, "CG"), (1, 3, "GT"), (1, 6, "AC")]
    w = np.where(np.array([[c == b for c in "AAC"] for b in "ACGT"]), 1.0, -1.0)
    hits = motifs.scan_motifs(spark.createDataFrame([(1, "AACGTTN")], "id int, seq string"), "id", {"m": w}, 3.0)
    assert rows(hits.select("position", "strand")) == [(1, "+"), (4, "-")]


def test_pseudobulk_replicates(spark):
    cells = spark.createDataFrame([(f"{g}{s}{k}", g, f"s{s}") for g, n in (("A", (60, 50, 3, 4)), ("B", (5, 6))) for s, m in enumerate(n) for k in range(m)], "cell string, cluster string, sample string")
    got = groups.pseudobulk(cells, "cluster", "sample", least=20, most=40).groupBy("group", "replicate").count().collect()
    n = {(r["group"], r["replicate"]): r["count"] for r in got}
    # B has too few cells for two halves of 20: two draws of four fifths, each cell in one at least
    assert n["A", "s0"] == n["A", "s1"] == 40 and n["A", "pooled"] == 7 and n["B", "half1"] == n["B", "half2"] == 9
    halves = groups.pseudobulk(cells, "cluster", "sample", least=5, most=40).where("`group` = 'A'").groupBy("replicate").count().collect()
    assert len(halves) >= 2


@pytest.mark.parametrize("n, draws, share", [(11, 2, 0.8), (10, 2, 0.5), (30, 3, 0.5)])
def test_draws_overlap_as_little_as_they_can(spark, n, draws, share):
    rows = spark.createDataFrame([(g, f"{g}{k}") for g in "ab" for k in range(n)], "group string, cell string")
    got = {}
    for r in groups.least_overlap(rows, ["group"], draws, share).collect():
        got.setdefault((r["group"], r["draw"]), set()).add(r["cell"])
    size = math.ceil(round(n * share, 6))
    assert len(got) == 2 * draws and all(len(v) == size for v in got.values())
    if draws == 2:
        assert len(got["a", 1] & got["a", 2]) == max(0, 2 * size - n)


def test_merging_clusters(spark):
    v = spark.createDataFrame([(k, [float(c), 0.0]) for k, c in enumerate((0, 0, 1, 10, 11, 30))], "id int, v array<double>")
    g = spark.createDataFrame([(k, f"C{c}") for k, c in enumerate((1, 1, 2, 3, 4, 5))], "id int, group string")
    assert {r["id"]: r["group"] for r in graph.merge_clusters(g, v, 2, 3).collect()} == {0: "C1", 1: "C1", 2: "C1", 3: "C3", 4: "C3", 5: "C5"}


def test_displays(spark, rows):
    from tessera.operators import displays

    v = spark.createDataFrame([(f, g, float(x)) for f, r in (("a", (1, 2, 9)), ("b", (9, 2, 1)), ("c", (2, 4, 18))) for g, x in zip("xyz", r)], "feature string, group string, value double")
    got = {r["feature"]: r["cluster"] for r in displays.row_clusters(v, 3, 2).collect()}
    assert got["a"] == got["c"] != got["b"]
    top = {r["feature"]: r["top_group"] for r in displays.marker_heatmap(v, v.where("feature <> 'c'")).collect()}
    assert top == {"a": "z", "b": "x"}
    loops = ranges(spark, [("c", 10, 20), ("c", 5, 15), ("d", 10, 20)])
    assert rows(displays.within_region(loops, "c", 8, 30)) == [("c", 10, 20)]
    assert rows(displays.clip_to_region(loops, "c", 8, 12)) == [("c", 10, 12), ("c", 8, 12)]


@pytest.mark.parametrize("slab", [256, 1 << 16])
def test_offset_counts_are_those_of_all_pairs(spark, slab):
    r = random.Random(3)
    for n, m, top in ((400, 200, 300), (60, 40, 100_000)):  # many pairs to a position, and few
        points = [(r.choice(["a", "b", None]), r.choice("xy"), r.randrange(-20, top)) for _ in range(n)]
        centers = [(r.choice("xyz"), r.randrange(-20, top), r.choice(["+", "-", None])) for _ in range(m)] * 2
        want = {}
        for by, chrom, pos in points:
            for on, at, strand in centers:
                if chrom == on and abs(pos - at) <= 40:
                    key = by, (pos - at) * (-1 if strand == "-" else 1)
                    want[key] = want.get(key, 0) + 1
        got = intervals.offset_counts(spark.createDataFrame(points, "s string, chr string, pos long"), spark.createDataFrame(centers, "chr string, pos long, strand string"), "s", 40, slab)
        assert {(x["s"], x["offset"]): x["n"] for x in got.collect()} == want


def test_footprint_of_crowded_places_joins_no_pairs(spark):
    """4e10 pairs of insertions and centres, which no join of pairs lists in the time of a test."""
    points = spark.range(200_000).select(F.lit("a").alias("s"), F.lit("c").alias("chr"), (F.col("id") % 2 * 10 + 100).alias("pos"))
    centers = spark.range(200_000).select(F.lit("c").alias("chr"), F.lit(100).cast("long").alias("pos"), F.lit("-").alias("strand"))
    assert {x["offset"]: x["n"] for x in motifs.footprint(points, centers, "s").collect()} == {0: 2 * 10**10, -10: 2 * 10**10}


def test_expected_profile_reads_written_counts(spark):
    """The normalised footprint uses the profile twice; insertions are counted once."""
    points = spark.createDataFrame([("a", "c", 101)], "s string, chr string, pos long")
    shape = motifs.footprint(points, spark.createDataFrame([("c", 100, "+")], "chr string, pos long, strand string"), "s")
    plan = motifs.normalise_footprint(shape, shape.select("s", "offset", F.lit(1.0).alias("expected")), "s")._jdf.queryExecution().optimizedPlan().toString()
    assert "Arrow" not in plan


def test_profile_of_crowded_gene_starts_joins_no_pairs(spark):
    points = spark.range(200_000).select(F.lit("a").alias("s"), F.lit("c").alias("chr"), F.lit(3000).alias("pos"))
    starts = spark.range(200_000).select(F.lit("c").alias("chr"), F.lit(1000).cast("long").alias("pos"), F.lit("+").alias("strand"))
    assert {x["offset"]: x["n"] for x in qc.tss_profile(points, starts, "s").collect()} == {2000: 4 * 10**10}


def test_depth_is_the_number_of_ranges_that_hold_a_point(spark):
    data = [*random_ranges(150, 8, 90), ("x", -30, 5, 0, 0), ("y", 40, 20, 0, 0), ("x", 64, 127, 0, 0), (None, 1, 9, 0, 0)]
    places = [(c, p, k) for c in ("x", "y", "z", None) for k, p in enumerate(range(-40, 700, 7))] + [("x", None, 0)]
    got = intervals.point_depth(spark.createDataFrame(places, "chr string, pos long, id int"), ranges(spark, data, ", id int, score int"), 64)
    want = {(c, p, k): sum(c == r[0] and c is not None and p is not None and r[1] <= p <= r[2] for r in data) for c, p, k in places}
    assert {(x["chr"], x["pos"], x["id"]): x["depth"] for x in got.collect()} == want


def test_feature_counts_of_crowded_features_join_no_pairs(spark):
    points = spark.range(200_000).select(F.lit("a").alias("cell"), F.lit("c").alias("chr"), (F.col("id") % 2 * 1000 + 5).alias("pos"))
    features = spark.range(200_000).select(F.lit("c").alias("chr"), F.lit(1).alias("start_pos"), F.lit(10).alias("end_pos"))
    assert [tuple(r) for r in qc.feature_counts(points, features, "f").collect()] == [("a", 2 * 10**10, 10**5)]


@pytest.mark.parametrize("slab", [64, 1 << 16])
def test_feature_groups_are_the_sums_of_the_matrix(spark, rows, slab, monkeypatch):
    monkeypatch.setattr(intervals.range_counts, "__defaults__", (slab,))
    r = random.Random(9)
    data = [*random_ranges(80, 4, 200), ("x", 40, 20, 900, 0), ("y", -9, 3, 901, 0), (None, 1, 9, 902, 0)]
    points = spark.createDataFrame([(r.choice(["a", "b", "e", None]), r.choice(["x", "y", None]), r.randrange(-20, 600)) for _ in range(500)], "cell string, chr string, pos long")
    groups = spark.createDataFrame([("a", "g"), ("a", "h"), ("b", "g"), ("b", "g"), ("e", None), ("z", "g")], "cell string, group string")
    features = ranges(spark, data, ", id long, score int")
    want = matrix.group_matrix(matrix.feature_matrix(points, features, "id", None), ["id"], groups).select("id", "group", "value")
    assert rows(matrix.feature_groups(points, features, "id", groups).select("id", "group", "value")) == rows(want)


def test_feature_groups_of_crowded_features_join_no_pairs(spark):
    points = spark.range(50_000).select(F.concat(F.lit("a"), F.col("id")).alias("cell"), F.lit("c").alias("chr"), F.lit(5).alias("pos"))
    features = spark.range(50_000).select(F.lit("c").alias("chr"), F.lit(1).alias("start_pos"), F.lit(10).alias("end_pos"), "id")
    got = matrix.feature_groups(points, features, "id", points.select("cell", F.lit("g").alias("group")))
    assert [tuple(r) for r in got.groupBy("group", "value").count().collect()] == [("g", 50_000, 50_000)]


@pytest.mark.parametrize("slab, reach, twice", [(64, 16, False), (64, 64, False), (1 << 16, 1 << 13, False), (64, 16, True)])
def test_feature_matrix_is_counted_without_a_shuffle_of_pairs(spark, rows, slab, reach, twice, monkeypatch):
    monkeypatch.setattr(intervals.held_counts, "__defaults__", (slab, reach))
    monkeypatch.setattr(intervals, "HELD", 50)
    r = random.Random(11)
    data = [*random_ranges(80, 4, 200), ("x", 40, 20, 900, 0), ("y", -9, 3, 901, 0), (None, 1, 9, 902, 0), ("x", 70, 90, 3 if twice else 903, 0)]
    spots = [(r.choice(["a", "b", "e", None]), r.choice(["x", "y", None]), r.randrange(-20, 600)) for _ in range(500)] * 2
    got = matrix.feature_matrix(spark.createDataFrame(spots, "cell string, chr string, pos long"), ranges(spark, data, ", id long, score int"), "id", 3)
    want = {}
    for chr_, start, end, key, _ in data:
        for cell, where, pos in spots:
            if chr_ is not None and chr_ == where and start <= pos <= end:
                want[key, cell] = want.get((key, cell), 0) + 1
    assert rows(got.select("id", "cell", "value")) == sorted(((*k, min(v, 3)) for k, v in want.items()), key=repr)
    if (slab, twice) == (1 << 16, False):
        assert "hashpartitioning(id" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("model", ["decay", "some are zero"])
@pytest.mark.parametrize("twice", [False, True])
def test_gene_scores_by_products_are_those_of_pairs(spark, rows, model, twice, monkeypatch):
    monkeypatch.setattr(matrix, "SLAB", 3000)
    r = random.Random(3)
    genes = [(i, r.choice(["x", "y"]), 0, r.randrange(9000), r.choice("+-")) for i in range(40)]
    genes = [(7 if twice and i == 8 else i, c, s, s + r.randrange(1500), strand) for i, c, _, s, strand in genes]
    windows = matrix.gene_windows(spark.createDataFrame(genes, "gene_id long, chr string, start_pos long, end_pos long, strand string"), 100, 0, 200, 3000)
    spots = [(r.choice(["a", "b", "e", None]), r.choice(["x", "y", "z"]), r.randrange(12_000)) for _ in range(400)]
    points = spark.createDataFrame(spots, "cell string, chr string, pos long")
    f = matrix.decay if model == "decay" else lambda d: F.when(F.abs(d) > 50, 0.0).otherwise(1.0)
    g = (lambda d: math.exp(-abs(d) / 5000) + math.exp(-1)) if model == "decay" else lambda d: float(abs(d) <= 50)
    tiles, want = {}, {}
    for cell, c, pos in spots:
        tiles[c, pos // 100 * 100, cell] = min(tiles.get((c, pos // 100 * 100, cell), 0) + 1, 4)
    for w in windows.collect():
        for (c, s, cell), n in tiles.items():
            if c == w.chr and s <= w.window_end and s + 99 >= w.window_start:
                gap = max(0, max(s - w.body_end, w.body_start - s - 99) - 1)
                want[w.gene_id, cell] = want.get((w.gene_id, cell), 0) + g(gap) * w.weight * n
    got = {(r.gene_id, r.cell): r.value for r in matrix.gene_scores(points, windows, 100, model=f, scale=None).collect()}
    assert got == pytest.approx(want)
    sums = {c: sum(v for (_, d), v in want.items() if d == c) for c in "abe"}
    shares = {k: v * 100 / sums[k[1]] for k, v in want.items() if k[1] is not None and sums[k[1]]}
    scaled = matrix.gene_scores(points, windows, 100, model=f, scale=100.0).where("cell IS NOT NULL")
    assert {(r.gene_id, r.cell): r.value for r in scaled.collect()} == pytest.approx({k: round(v, 3) for k, v in shares.items() if v >= 0.0005}, abs=1e-9)
    totals = matrix.gene_score_totals(points, windows, 100, model=f, scale=100.0).where("cell IS NOT NULL").collect()
    assert {r.cell: (r.n_genes, pytest.approx(r.total)) for r in totals} == {c: (sum(v >= 0.0005 for (_, d), v in shares.items() if d == c), sum(v for (_, d), v in shares.items() if d == c and v >= 0.0005)) for c in "abe"}
    if not twice:
        assert "hashpartitioning(gene_id" not in scaled._jdf.queryExecution().toString()


def test_rounding_of_scores_is_that_of_spark(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([[0.0005, 0.0015, 1.0005, 2.0005, 1.0015, 0.4995, 0.00049999999999, 1.00049999999999, 0.0], rng.integers(0, 10**5, 300) / 1e4 + 5e-5, rng.random(300)])
    want = [r[0] for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, v double").orderBy("i").select(F.round("v", 3)).collect()]
    assert matrix._three_places(x).tolist() == want
