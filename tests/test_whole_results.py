"""Operators and queries that once left a part of their input out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.operators import graph, intervals, markers
from tessera.plans import catalog_models
from tessera.sources import adapters as A

def test_rows_that_share_a_neighbour_without_a_link(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB_ROWS", 3)
    rng = np.random.default_rng(1)
    pairs = {(q, int(n)) for q in range(30) for n in rng.choice(30, 3, replace=False) if n != q} | {(q, 0) for q in range(1, 30)}
    sets = {q: {n for a, n in pairs if a == q} | {q} for q in range(30)}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(30) for b in range(a + 1, 30)}
    found = graph.shared_neighbours(spark.createDataFrame(sorted(pairs), "query long, neighbour long"), 0.2).collect()
    assert {(r["a"], r["b"]): pytest.approx(r["weight"]) for r in found} == {p: w for p, w in want.items() if w > 0.2}

def test_every_cell_has_a_background_cell_while_there_are_any(spark):
    # The 40 cells of x have depths next to each other, so that their nearest cells are of their own group.
    data = [(f"x{i}", "x", 100 + i) for i in range(40)] + [(f"y{i}", "y", i) for i in range(50)]
    found = markers.matched_background(spark.createDataFrame(data, "cell string, group string, depth int"), "group", ["depth"]).toPandas()
    assert (found.cell.str[0] == found.group).all() and (found.matched.str[0] != found.group).all()
    assert not found.duplicated(["group", "matched"]).any() and not found.duplicated(["group", "cell"]).any()
    assert found.groupby("group").size().to_dict() == {"x": 40, "y": 40}

def test_long_chain_of_equal_scores(spark):
    data = [("chr1", 10 * i, 10 * i + 12, 1, i) for i in range(31)]
    df = spark.createDataFrame(data, "chr string, start_pos long, end_pos long, score int, id int")
    found = intervals.non_overlapping(df, "score", ["id"], rounds=2).collect()
    assert sorted(r["id"] for r in found) == list(range(0, 31, 2))

def test_trajectory_of_all_features(spark, root):
    found = entry.queries()["trajectory_matrix"](spark, root).select("feature").distinct()
    assert found.count() == catalog_models._tf(spark, root).select("feature").distinct().count()

def test_all_peaks_are_centres(spark, root):
    assert catalog_models._centers(spark, root).count() == A.peaks(spark, root).count()

def test_kmers_and_complements_of_whole_texts(spark, root):
    texts = {r["doc_id"]: r["seq"] for r in A.sequences(spark, root).collect()}
    found = entry.queries()["kmer_position"](spark, root).agg(F.sum("n")).first()[0]
    assert found == sum(max(len(s) - 3, 0) for s in texts.values())
    rc = {r["doc_id"]: r["rc"] for r in entry.queries()["gc_content"](spark, root).collect()}
    assert rc == {k: s[::-1].translate(str.maketrans("ACGT", "TGCA")) for k, s in texts.items()}
