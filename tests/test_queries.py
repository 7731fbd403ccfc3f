"""Every registered query that has SQL gives the same rows as DuckDB; the others give rows."""

import importlib.util
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tools_compare import canonical

QUERIES, SQL = entry.queries(), entry.oracle_sql()
between = lambda low, high: lambda c: c.between(low, high).all()


def once(*keys):
    return lambda d: not d.duplicated(list(keys)).any()


def apart(d):
    """No two rows of a chromosome overlap."""
    d = d.sort_values(["chr", "start_pos"])
    same = d["chr"].eq(d["chr"].shift())
    return bool((d["start_pos"] > d["end_pos"].shift())[same].all())


#: What holds of the rows of queries that have no SQL; their values are compared with numpy in test_operators, test_models and test_whole_results.
HOLDS = {
    "background_features": [once("feature", "iteration"), once("feature", "background"), lambda d: (d["feature"] != d["background"]).all() and set(d["iteration"]) == set(range(1, 11))],
    "biased_clusters": [once("group"), lambda d: between(0, 1)(d["proportion"]) and (d["p"] > 0).all()],
    "binomial_test": [once("feature"), lambda d: len(d) > 0 and between(0, 1)(d["p"])],
    "bulk_projection": [once("cell"), lambda d: len(d) > 0 and d["v"].map(len).eq(5).all()],
    "coaccessibility_of_cells": [once("id1", "id2"), lambda d: len(d) > 0 and (d["id1"] < d["id2"]).all() and between(-1.000001, 1.000001)(d["correlation"].dropna())],
    "density": [once("x", "y"), lambda d: len(d) == 2500 and (d["density"] >= 0).all() and d["density"].max() > 0],
    "deviations": [once("motif", "cell"), lambda d: len(d) == d["motif"].nunique() * d["cell"].nunique() > 0 and d["deviation"].notna().all()],
    "doublet_scores": [once("cell"), lambda d: len(d) > 0 and d["neighbours"].sum() > 0 and (d["score"] >= 0).all()],
    "enrichment_test": [once("motif"), lambda d: len(d) == 12 and (d["mlog10p"] >= d["mlog10padj"] - 1e-9).all()],
    "graph_clusters": [once("id"), lambda d: d["group"].str.match(r"C[0-9]+$").all() and d["group"].value_counts()["C1"] == d["group"].value_counts().max()],
    "hexagons": [once("x", "y"), lambda d: (d["n"] > 0).all()],
    "impute": [once("feature", "cell"), lambda d: len(d) > 0 and (d["value"] >= 0).all()],
    "knn_groups": [once("group", "id"), lambda d: d.groupby("group").size().eq(11).all()],
    "least_overlap": [once("group", "cell", "draw"), lambda d: set(d["draw"]) <= {1, 2}],
    "loadings_project": [once("cell"), lambda d: d["v"].map(len).eq(5).all()],
    "lsi_iterative": [once("cell"), lambda d: len(d) > 0 and d["v"].map(len).eq(8).all()],
    "lsi_model": [once("cell"), lambda d: len(d) > 0 and d["v"].map(len).nunique() == 1],
    "lsi_svd": [once("cell"), lambda d: len(d) > 0 and d["v"].map(len).eq(10).all()],
    "marker_features": [once("group", "rnk"), lambda d: len(d) > 0 and between(0, 1)(d["fdr"]) and (d["log2fc"] >= 0.1).all() and (d["rnk"] <= 50).all()],
    "modularity_clusters": [once("id"), lambda d: 1 < d["group"].nunique() < len(d)],
    "module_score": [once("module", "cell"), lambda d: len(d) == d["module"].nunique() * d["cell"].nunique() > 0],
    "motif_scan": [once("doc_id", "motif", "position", "strand"), lambda d: (d["score"] >= 4).all() and (d["position"] >= 1).all()],
    "motif_scan_p": [once("doc_id", "motif", "position", "strand"), lambda d: (d["position"] >= 1).all()],
    "non_overlapping": [apart, lambda d: len(d) > 0],
    "null_correlations": [lambda d: len(d) > 0 and between(-1.000001, 1.000001)(d["correlation"].dropna())],
    "peak_gene_links": [once("id1", "id2"), lambda d: (d["correlation"] >= 0.3).all() and between(0, 1)(d["var_quantile"])],
    "pseudobulk": [lambda d: len(d) > 0],
    "pseudotime": [once("cell"), lambda d: len(d) > 0 and between(0, 100)(d["pseudotime"])],
    "reproducible_peaks": [apart, lambda d: (d["end_pos"] - d["start_pos"]).eq(500).all()],
    "stratified_sample": [lambda d: len(d) > 0],
    "tile_peaks": [lambda d: len(d) >= 0 and between(0, 0.1)(d["fdr"]) if "fdr" in d else True],
    "trajectory_correlation": [lambda d: between(-1.000001, 1.000001)(d["correlation"].dropna()) and between(0, 1)(d["fdr"].dropna())],
    "trajectory_heatmap": [once("feature", "bin"), lambda d: between(-2, 2)(d["z"].dropna())],
    "trajectory_matrix": [once("feature", "bin"), lambda d: len(d) == d["feature"].nunique() * d["bin"].nunique() > 0],
    "wilcoxon_test": [once("feature"), lambda d: len(d) > 0 and between(0, 1)(d["fdr"].dropna()) and (d["fdr"] >= d["p"] - 1e-12).all()],
}


@pytest.fixture(scope="module")
def con(root):
    import duckdb

    c = duckdb.connect()
    for p in Path(root).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, root, con, name):
    got, want = QUERIES[name](spark, root).toPandas(), con.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got).equals(canonical(want))


OTHERS = {name for name, query in QUERIES.items() if name not in SQL and ".llm." not in query.__module__}


@pytest.mark.parametrize("name", sorted(OTHERS))
def test_what_holds_of_rows(spark, root, name):
    d = QUERIES[name](spark, root).toPandas()
    assert len(set(d.columns)) == len(d.columns)
    for k, holds in enumerate(HOLDS[name]):
        assert holds(d), (name, k)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_the_rest_does_not_import_the_llm_folder():
    top = Path(entry.__file__).parent / "tessera"
    for p in top.rglob("*.py"):
        if "llm" not in p.relative_to(top).parts:
            assert "tessera.llm" not in p.read_text(), p
    assert importlib.util.find_spec("tessera") and "tessera" in sys.modules
