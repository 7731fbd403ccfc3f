"""Queries that once shuffled or wrote more than the disk holds before their first pair."""

import numpy as np
import pytest

import __spark_entry__ as entry
from tessera.operators import intervals, links, matrix

RANGES = "id long, chr string, start_pos long, end_pos long"


def some_points(spark, rng, n):
    at = np.concatenate([rng.integers(-9_000, 200_000, n - 4), [65_535, 65_536, 57_344, 57_345]])  # about the borders of slabs
    rows = [(f"x{rng.integers(9)}", f"c{rng.integers(2)}", int(p)) for p in at] * 2
    return rows, spark.createDataFrame([*rows, ("x1", None, 5), ("x1", "c1", None)], "cell string, chr string, pos long")


def some_ranges(rng, n, longest=8_000):
    at = np.concatenate([rng.integers(-9_000, 200_000, n - 3), [65_534, 65_536, 60_000]])
    return [(int(k), f"c{k % 2}", int(s), int(s) + int(rng.integers(longest))) for k, s in zip(rng.permutation(n), at)]


@pytest.mark.parametrize("longest", [8_000, 90_000])
def test_points_and_ranges_are_shuffled_once_in_packs(spark, monkeypatch, longest):
    monkeypatch.setattr(intervals, "PACKED", 50)
    rng = np.random.default_rng(6)
    rows, points = some_points(spark, rng, 300)
    ranges = some_ranges(rng, 50, longest)
    found = matrix.feature_matrix(points, spark.createDataFrame([*ranges, (99, "c1", 9, 5), (98, None, 1, 9)], RANGES), "id", None)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and (longest > 8_192 or "Aggregate" not in plan)
    want = {}
    for k, chrom, s, e in ranges:
        for cell, c, p in rows:
            if c == chrom and s <= p <= e:
                want[k, cell] = want.get((k, cell), 0) + 1
    got = {(r["id"], r["cell"]): r["value"] for r in found.collect()}
    assert got == want and found.count() == len(want)


@pytest.mark.parametrize("longest", [600, 9_000])
def test_correlations_of_points_are_those_of_the_matrix(spark, monkeypatch, longest):
    monkeypatch.setattr(intervals, "PACKED", 50)
    rng = np.random.default_rng(7)
    _, points = some_points(spark, rng, 900)
    peaks = spark.createDataFrame([*some_ranges(rng, 150, longest), (999, "c1", 9, 5), (998, "c1", 900_000, 900_001)], RANGES)
    groups = spark.createDataFrame([(f"x{k % 9}", f"g{k % 7}") for k in range(14)] + [("x3", None)], "cell string, group string")
    sums = matrix.feature_groups(points, peaks, "id", groups.where("group IS NOT NULL")).withColumnRenamed("id", "feature")
    want = {(r["id1"], r["id2"]): r for r in links.peak_correlations(sums, peaks, 12, "id", 20_000).collect()}
    if longest < 8_192:
        monkeypatch.setattr(links, "feature_groups", lambda *a: pytest.fail("a row a peak and group"))
    found = links.peak_correlations_of_points(points, groups, peaks, 12, "id", 20_000)
    got = {(r["id1"], r["id2"]): r for r in found.collect()}
    assert set(got) == set(want) and found.count() == len(want) > 100
    for pair, r in got.items():
        assert r["chr"] == want[pair]["chr"] and r["distance"] == want[pair]["distance"]
        assert [r[c] for c in ("correlation", "var1", "var2")] == pytest.approx([want[pair][c] for c in ("correlation", "var1", "var2")])


def test_query_of_correlations_writes_no_matrix(spark, root, monkeypatch):
    for module in (matrix, links):
        monkeypatch.setattr(module, "feature_groups", lambda *a: pytest.fail("a row a peak and group"))
    assert entry.queries()["coaccessibility"](spark, root).count() > 0


def test_query_of_aggregates_writes_no_matrix(spark, root, monkeypatch):
    for module in (matrix, links):
        monkeypatch.setattr(module, "feature_groups", lambda *a: pytest.fail("a row a peak and group"))
    assert entry.queries()["coaccessibility_of_cells"](spark, root).count() > 0
