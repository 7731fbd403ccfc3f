"""The numbers behind the usual pictures; drawing itself is left to others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.stats import average_rank, quantiles, row_zscore


def clip_to_region(df: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Intervals that overlap a region, clipped to it."""
    hit = df.where((F.col("chr") == chrom) & (F.col("start_pos") <= end) & (F.col("end_pos") >= start))
    return hit.withColumns({"start_pos": F.greatest("start_pos", F.lit(start)), "end_pos": F.least("end_pos", F.lit(end))})


def within_region(df: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Intervals, such as loops, that lie inside a region."""
    return df.where((F.col("chr") == chrom) & (F.col("start_pos") >= start) & (F.col("end_pos") <= end))


def marker_heatmap(values: DataFrame, chosen: DataFrame, clip: float = 2.0) -> DataFrame:
    """(feature, group, z): standard scores of log2 values of the chosen features, with the group in which each is highest."""
    z = row_zscore(values.join(chosen.select("feature").distinct(), "feature", "left_semi").withColumn("_y", F.log2(F.col("value") + 1)), "_y", ["feature"], clip)
    best = Window.partitionBy("feature").orderBy(F.col("_y").desc(), "group")
    return z.withColumn("top_group", F.first("group").over(best)).select("feature", "group", "z", "top_group")


def enrichment_heatmap(scores: DataFrame, n: int = 10, cut_off: float = 20.0) -> DataFrame:
    """(motif, group, mlog10p, scaled) of the motifs that are among the ``n`` best of a group and above ``cut_off``; scaled to 100 per motif."""
    order = Window.partitionBy("group").orderBy(F.col("mlog10p").desc(), "motif")
    top = scores.where(F.col("mlog10p") >= cut_off).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).select("motif").distinct()
    most = F.max("mlog10p").over(Window.partitionBy("motif"))
    return scores.join(top, "motif", "left_semi").withColumn("scaled", F.col("mlog10p") * 100 / F.nullif(most, F.lit(0.0)))


def distributions(df: DataFrame, group: str, value: str, at: tuple[float, ...] = (0.025, 0.25, 0.5, 0.75, 0.975)) -> DataFrame:
    """Interpolated quantiles of a value per group."""
    found = quantiles(df, value, {f"q{p * 1000:g}": p for p in at}, [group]).withColumnRenamed(group, "_of")
    n = df.groupBy(group).agg(F.count(value).alias("n"))
    return n.join(found, F.col(group).eqNullSafe(F.col("_of")), "left").drop("_of")


def density(df: DataFrame, x: str, y: str, grid: int = 100, fine: int = 4) -> DataFrame:
    """(x, y, density) on a grid over the points: a Gaussian kernel in both directions, its widths four times the usual rule of spread and number.

    Points are counted on a grid ``fine`` times as fine; only those counts come to the driver, (grid * fine) squared at most.
    """
    import math

    import numpy as np

    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(~F.isnan("x") & ~F.isnan("y"))
    at = F.percentile_approx
    one = rows.agg(F.count(F.lit(1)), *[f(c) for c in ("x", "y") for f in (F.min, F.max, F.stddev_samp, lambda c: at(c, 0.25, 10_000), lambda c: at(c, 0.75, 10_000))]).first()
    n, cells = one[0], grid * fine
    schema = "x double, y double, density double"
    if n < 2:
        return df.sparkSession.createDataFrame([], schema)
    low, step, kernels = [], [], []
    for least, most, sd, q1, q3 in (one[1:6], one[6:11]):
        wide = 1.06 * min(z for z in (sd, (q3 - q1) / 1.34, 1e300) if z and z > 0) * n**-0.2 if sd else 1.0  # a fourth of the width is the kernel's sd
        low.append(least)
        step.append((most - least) / cells or 1.0)
        places = least + (np.arange(grid) + 0.5) * fine * step[-1]
        middles = least + (np.arange(cells) + 0.5) * step[-1]
        kernels.append(np.exp(-0.5 * ((places[:, None] - middles[None]) / wide) ** 2) / (wide * math.sqrt(2 * math.pi)))
    bin_ = lambda c, k: F.least(F.floor((F.col(c) - low[k]) / step[k]), F.lit(cells - 1)).cast("int")
    counts = rows.groupBy(bin_("x", 0).alias("i"), bin_("y", 1).alias("j")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    c = np.zeros((cells, cells))
    c[counts["i"], counts["j"]] = counts["n"]
    d = kernels[0] @ c @ kernels[1].T / n
    out = [(float(low[0] + (i + 0.5) * fine * step[0]), float(low[1] + (j + 0.5) * fine * step[1]), float(d[i, j])) for i in range(grid) for j in range(grid)]
    return df.sparkSession.createDataFrame(out, schema)


def hexagons(x: Column, y: Column, width: float) -> Column:
    """Centre of the hexagon of a given width that holds a point."""
    h = width * 3**0.5
    a = F.struct((F.round(x / width) * width).alias("x"), (F.round(y / h) * h).alias("y"))
    b = F.struct(((F.floor(x / width) + 0.5) * width).alias("x"), ((F.floor(y / h) + 0.5) * h).alias("y"))
    far = lambda c: (x - c["x"]) * (x - c["x"]) + (y - c["y"]) * (y - c["y"])
    return F.when(far(a) <= far(b), a).otherwise(b)


def agreement(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """One row: Pearson and Spearman correlation of two columns."""
    ranks = average_rank(average_rank(df.select(key, x, y).dropna(), x, "_rx"), y, "_ry")
    return ranks.agg(F.count(F.lit(1)).alias("n"), F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"))


def row_clusters(values: DataFrame, n_groups: int, k: int = 25, clip: float = 2.0, seed: int = 1) -> DataFrame:
    """(feature, cluster) of rows (feature, group, value) with like profiles: k-means of their clipped standard scores.

    Groups are numbered in their order; a row has one entry per group, so it stays small.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    z = row_zscore(values, "value", ["feature"], clip)
    row = z.groupBy("feature").agg(F.sort_array(F.collect_list(F.struct("group", F.coalesce("z", F.lit(0.0)).alias("z")))).alias("_r"))
    vectors = row.where(F.size("_r") == n_groups).select("feature", array_to_vector(F.transform("_r", lambda x: x["z"])).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=20).fit(vectors)
    return model.transform(vectors).select("feature", F.col("prediction").alias("cluster"))
