"""Simulated cells: doublets made of two cells, and pseudo-cells drawn from bulk samples."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.tails import binomial_upper_p
from tessera.operators.graph import exact_neighbours
from tessera.operators.lsi import fit_idf, project, svd, weigh
from tessera.operators.skew import salted_rank
from tessera.session import materialise


def simulate_doublets(matrix: DataFrame, trials: int = 5, seed: int = 1) -> DataFrame:
    """(feature, cell, value) of ``trials`` doublets per cell, named by negative numbers.

    Cells are numbered in an order by seeded hash and each is paired with the one some places on; every
    entry of either cell is kept with chance one half.
    """
    cells = matrix.select("cell").distinct().withColumn("_h", F.xxhash64(F.col("cell"), F.lit(seed)))
    numbered = materialise(salted_rank(cells.withColumn("_one", F.lit(1)), ["_one"], "_h", ["cell"], "_k", width=1 << 48).select("cell", (F.col("_k") - 1).alias("_k")), "numbered")
    n = numbered.count()
    rounds = F.explode(F.sequence(F.lit(1), F.lit(trials)))
    one = numbered.select(F.col("cell").alias("a"), "_k", rounds.alias("_t"))
    other = one.withColumn("_k2", F.pmod(F.col("_k") + 1 + F.pmod(F.xxhash64("_t", F.lit(seed)), F.lit(max(n - 1, 1))), F.lit(max(n, 1))))
    pairs = other.join(numbered.select(F.col("cell").alias("b"), F.col("_k").alias("_k2")), "_k2").where(F.col("a") != F.col("b"))
    named = pairs.select((-(F.col("_k") * trials + F.col("_t"))).alias("doublet"), F.array("a", "b").alias("_m"))
    parts = named.select("doublet", F.explode("_m").alias("cell"))
    kept = matrix.join(parts, "cell").where(F.pmod(F.xxhash64("doublet", "cell", "feature", F.lit(seed)), F.lit(2)) == 0)
    return kept.groupBy("feature", F.col("doublet").alias("cell")).agg(F.sum("value").alias("value"))


def doublet_scores(matrix: DataFrame, k: int = 10, trials: int = 5, dims: int = 10, seed: int = 1) -> DataFrame:
    """(cell, neighbours, score, enrichment) of every cell: how many simulated doublets fall among its neighbours.

    Score is minus the decimal logarithm of the Bonferroni-corrected binomial tail; enrichment the count over its mean.
    """
    df, n = fit_idf(matrix)
    df = materialise(df, "df")
    _, scores, loadings = svd(weigh(matrix, df, n, 1), dims, 5, 2, seed)
    doublets = project(weigh(simulate_doublets(matrix, trials, seed), df, n, 1), loadings, dims).select(F.concat(F.lit("d"), F.col("cell")).alias("cell"), "v")
    named = scores.select(F.col("cell").cast("string").alias("cell"), "v")
    near = exact_neighbours(named, doublets, "cell", "v", k)
    counts = near.groupBy(F.col("neighbour").alias("cell")).agg(F.count(F.lit(1)).alias("neighbours"))
    total = near.agg(F.count(F.lit(1)).alias("_all"))
    out = named.select("cell").join(counts, "cell", "left").fillna(0, ["neighbours"]).crossJoin(F.broadcast(total))  # one row
    p = binomial_upper_p("neighbours", F.col("_all"), F.lit(1.0 / max(n, 1)))
    corrected = F.least(F.lit(1.0), F.greatest(p, F.lit(1e-300)) * n)
    return out.select("cell", "neighbours", (-F.log10(corrected)).alias("score"), (F.col("neighbours") * n / F.col("_all")).alias("enrichment"))


def pseudo_cells(bulk: DataFrame, n: int = 250, ratios: Sequence[float] = (2, 1.5, 1, 0.5, 0.25), depth: int = 5000, seed: int = 1) -> DataFrame:
    """(feature, cell, value) of ``n`` cells drawn from each bulk sample (sample, feature, value), at several depths.

    A sample has one row per feature, so it fits one task.
    """

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("feature")
        name = str(pdf["sample"].iloc[0])
        rng = np.random.default_rng([seed, *name.encode()])
        p = pdf["value"].to_numpy(float)
        p = p / p.sum()
        parts = []
        for i in range(n):
            x = rng.multinomial(int(depth * ratios[i % len(ratios)]), p)
            at = np.flatnonzero(x)
            parts.append(pd.DataFrame({"feature": pdf["feature"].to_numpy()[at], "cell": f"{name}#{i}", "value": x[at]}))
        return pd.concat(parts) if parts else pd.DataFrame({"feature": [], "cell": [], "value": []})

    kind = bulk.schema["feature"].dataType.simpleString()
    return bulk.where(F.col("value") > 0).groupBy("sample").applyInPandas(draw, f"feature {kind}, cell string, value long")


def project_bulk(matrix: DataFrame, bulk: DataFrame, dims: int = 10, **kw) -> DataFrame:
    """Vectors of pseudo-cells of bulk samples on the loadings of ``matrix``."""
    df, n = fit_idf(matrix)
    df = materialise(df, "df")
    _, _, loadings = svd(weigh(matrix, df, n), dims, 5, 2)
    return project(weigh(pseudo_cells(bulk, **kw), df, n), loadings, dims)
