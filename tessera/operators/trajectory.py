"""A pseudotime through groups in a given order, and features along it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.stats import rank_quantile, row_zscore
from tessera.operators.links import match_names, pair_correlation, with_significance
from tessera.session import materialise


def trajectory(cells: DataFrame, order: list[str], dim: int, trim: float = 0.95, knots: int = 100, near: int = 3) -> DataFrame:
    """(cell, pseudotime from 0 to 100) of the cells (cell, group, v) of the groups in ``order``.

    Cells far from their group's mean are left out of the fit.  A cell's first time is its group's
    place plus how near it is to the next group's mean; a curve is the mean vector along
    that time, smoothed over its knots; each cell takes the mean time of the nearest knots, ranked.
    Only group means and knots come to the driver.
    """
    mine = cells.where(F.col("group").isin(order)).select("cell", "group", F.transform("v", lambda x: x.cast("double")).alias("v"))
    mine = materialise(mine, "trajectory")
    rows = mine.groupBy("group").agg(*[F.avg(F.col("v")[j]).alias(f"m{j}") for j in range(dim)]).collect()  # one row a group
    means = {r["group"]: np.array([r[f"m{j}"] for j in range(dim)]) for r in rows}
    places = [g for g in order if g in means]

    def distance(to: dict[str, np.ndarray]):
        kind = F.lit(None).cast("double")
        for g, m in to.items():
            d = F.sqrt(F.aggregate(F.zip_with("v", F.array(*[F.lit(float(x)) for x in m]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
            kind = F.when(F.col("group") == g, d).otherwise(kind)
        return kind

    following = {g: means[places[min(i + 1, len(places) - 1)]] for i, g in enumerate(places)}
    measured = mine.withColumn("_own", distance(means)).withColumn("_next", distance(following))
    limit = measured.groupBy("group").agg(F.percentile_approx("_own", trim, 1000).alias("_far"))
    fit = measured.join(F.broadcast(limit), "group").where(F.col("_own") <= F.col("_far"))  # one row a group
    ranked = rank_quantile(fit, "_next", "_q", ["group"])
    place = F.element_at(F.create_map(*[x for i, g in enumerate(places) for x in (F.lit(g), F.lit(float(i)))]), F.col("group"))
    timed = ranked.withColumn("_t", (place + 1 - F.col("_q")) / len(places))
    bins = timed.groupBy(F.least(F.floor(F.col("_t") * knots), F.lit(knots - 1)).alias("_k")).agg(*[F.avg(F.col("v")[j]).alias(f"m{j}") for j in range(dim)]).toPandas()  # at most ``knots`` rows
    bins = bins.sort_values("_k")
    smooth = bins[[f"m{j}" for j in range(dim)]].rolling(7, center=True, min_periods=1).mean().to_numpy()
    at = bins["_k"].to_numpy(float)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.array(list(b["v"]))
                d = ((x[:, None] - smooth[None]) ** 2).sum(2)
                best = np.argsort(d, 1, kind="stable")[:, :near]
                yield pd.DataFrame({"cell": b["cell"], "_t": at[best].mean(1)})

    raw = mine.select("cell", "v").mapInPandas(nearest, f"cell {mine.schema['cell'].dataType.simpleString()}, _t double")
    return rank_quantile(raw, "_t", "_q").select("cell", (F.col("_q") * 100).alias("pseudotime"))


def heatmap(series: DataFrame, share: float = 0.9, clip: float = 2.0) -> DataFrame:
    """(feature, bin, z, peak_bin) of the features whose variance along the bins lies above the quantile ``share``, ordered by where they peak."""
    series = materialise(series, "series")
    variance = series.groupBy("feature").agg(F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("_v"))
    top = rank_quantile(variance, "_v", "_q").where(F.col("_q") >= share).select("feature")
    z = row_zscore(series.join(top, "feature", "left_semi"), "value", ["feature"], clip)
    peak = Window.partitionBy("feature").orderBy(F.col("value").desc(), "bin")
    return z.withColumn("peak_bin", F.first("bin").over(peak)).select("feature", "bin", "z", "peak_bin")


def correlate(a: DataFrame, b: DataFrame, n_bins: int, least: float = 0.5) -> DataFrame:
    """Pairs of features of two series (feature, bin, value) with one cleaned name, correlated along the bins."""
    names = match_names(a.select("feature").distinct(), b.select("feature").distinct(), "feature", "feature")
    series = [s.select("feature", F.col("bin").alias("group"), F.col("value").alias("x")) for s in (a, b)]
    out = pair_correlation(names.select("id1", "id2", "match_name"), *series, n_bins)
    return with_significance(out, n_bins).where(F.col("correlation") >= least)
