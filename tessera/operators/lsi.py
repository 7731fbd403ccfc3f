"""Latent semantic indexing of sparse matrices (feature, cell, value) and work on the resulting vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialise


def fit_idf(matrix: DataFrame) -> tuple[DataFrame, int]:
    """(feature, df) and the number of cells: what weighting needs to know of the cells it was fitted on."""
    ones = matrix.where(F.col("value") != 0).select("feature", "cell").distinct()
    return ones.groupBy("feature").agg(F.count(F.lit(1)).alias("df")), ones.select("cell").distinct().count()


def weigh(matrix: DataFrame, df: DataFrame, n: int, method: int = 2, scale: float = 1e4) -> DataFrame:
    """Weighted entries of the binarised matrix, by the document frequencies ``df`` (feature, df) of ``n`` cells.

    1: tf * log(1 + n / df); 2: log(1 + tf * n / df * scale); 3: log(1 + tf) * log(1 + n / df),
    with tf one share of the cell's features. Features without a df are left out.
    """
    ones = matrix.where(F.col("value") != 0).select("feature", "cell").distinct()
    depth = ones.groupBy("cell").agg(F.count(F.lit(1)).alias("_depth"))
    out = ones.join(depth, "cell").join(df, "feature")
    tf, ratio = 1.0 / F.col("_depth"), F.lit(float(n)) / F.col("df")
    value = {1: tf * F.log1p(ratio), 2: F.log1p(tf * ratio * scale), 3: F.log1p(tf) * F.log1p(ratio)}[method]
    return out.select("feature", "cell", value.alias("value"))


def tf_idf(matrix: DataFrame, method: int = 2, scale: float = 1e4) -> DataFrame:
    """Entries weighted by the frequencies of the matrix itself; see :func:`weigh`."""
    return weigh(matrix, *fit_idf(matrix), method, scale)


def svd(weighted: DataFrame, k: int = 30, oversample: int = 10, power: int = 3, seed: int = 1) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """Truncated SVD by randomised subspace iteration: singular values, cell scores (V D) and feature loadings (U).

    Every pass is two joins and sums over the entries, with dense rows of k +
    oversample numbers beside them; only Gram matrices of that size come to the driver.
    """
    width = k + oversample
    noise = F.array(*[F.randn(seed + j) for j in range(width)])
    entries = materialise(weighted.select("feature", "cell", "value"), "entries")

    def multiply(dense: DataFrame, by: str, to: str) -> DataFrame:
        joined = entries.join(dense, by)
        sums = [F.sum(F.col("value") * F.col("v")[j]) for j in range(width)]
        return joined.groupBy(to).agg(F.array(*sums).alias("v"))

    def gram(dense: DataFrame) -> np.ndarray:
        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            g = np.zeros((width, width))
            for batch in batches:
                if len(batch):
                    x = np.array(list(batch["v"]))
                    g += x.T @ x
            yield pd.DataFrame({"at": np.arange(width * width), "g": g.ravel()})

        sums = dense.select("v").mapInPandas(part, "at int, g double").groupBy("at").agg(F.sum("g").alias("g")).toPandas()  # width * width rows
        g = np.zeros(width * width)
        g[sums["at"]] = sums["g"]
        return g.reshape(width, width)

    def turn(dense: DataFrame, key: str, m: np.ndarray) -> DataFrame:
        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({key: batch[key], "v": list(np.array(list(batch["v"])) @ m)} if len(batch) else {key: batch[key], "v": []})

        return materialise(dense.select(key, "v").mapInPandas(part, f"`{key}` {dense.schema[key].dataType.simpleString()}, v array<double>"), "dense")

    def whiten(g: np.ndarray) -> np.ndarray:
        values, vectors = np.linalg.eigh(g)
        good = values > values.max() * 1e-12
        return vectors * np.where(good, 1 / np.sqrt(np.where(good, values, 1)), 0)

    q = materialise(entries.select("cell").distinct().select("cell", noise.alias("v")), "dense")
    for _ in range(power):
        y = materialise(multiply(q, "cell", "feature"), "dense")
        y = turn(y, "feature", whiten(gram(y)))
        q = materialise(multiply(y, "feature", "cell"), "dense")
        q = turn(q, "cell", whiten(gram(q)))
    y = materialise(multiply(q, "cell", "feature"), "dense")  # A Q
    values, vectors = np.linalg.eigh(gram(y))
    order = np.argsort(values)[::-1][:k]
    d = np.sqrt(np.maximum(values[order], 0))
    w = vectors[:, order]
    scores = turn(q, "cell", w * d)
    loadings = turn(y, "feature", w / np.where(d > 0, d, 1))
    return d, scores, loadings


def project(weighted: DataFrame, loadings: DataFrame, k: int) -> DataFrame:
    """Scores of cells on stored loadings: ``cell`` and ``v``."""
    joined = weighted.join(loadings, "feature")
    return joined.groupBy("cell").agg(F.array(*[F.sum(F.col("value") * F.col("v")[j]) for j in range(k)]).alias("v"))


def scale_dims(df: DataFrame, vector: str = "v") -> DataFrame:
    """Standard scores of each vector's numbers over its own dimensions."""
    n = F.size(vector)
    sums = F.aggregate(
        F.transform(vector, lambda x: x.cast("double")),
        F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")),
        lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")),
    )
    # An array of one element binds the sums, so that they are taken once a vector and not once a number.
    moments = F.transform(F.array(sums), lambda a: F.struct((a["s"] / n).alias("m"), F.sqrt(F.greatest(F.lit(0.0), a["q"] - a["s"] * a["s"] / n) / (n - 1)).alias("sd")))
    scaled = F.transform(moments, lambda a: F.transform(vector, lambda x: (x.cast("double") - a["m"]) / F.nullif(a["sd"], F.lit(0.0))))
    return df.withColumn(vector, scaled[0])


def dim_correlations(df: DataFrame, vector: str, depth: str, dim: int) -> DataFrame:
    """(dim, correlation) of each dimension with the depth."""
    row = df.agg(*[F.corr(F.col(vector)[j].cast("double"), F.col(depth)).alias(f"d{j}") for j in range(dim)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(j).alias("dim"), F.col(f"d{j}").alias("correlation")) for j in range(dim)])).alias("_c")).select("_c.*")


def combine_dims(a: DataFrame, b: DataFrame, key: str, dims: tuple[int, int], weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Vectors of both tables, each scaled by ``weight / sqrt(sum of variances)``, joined into one."""
    def scaled(df: DataFrame, dim: int, weight: float, name: str) -> DataFrame:
        total = df.agg(sum((F.var_samp(F.col("v")[j].cast("double")) for j in range(dim)), F.lit(0.0)).alias("_var"))
        return df.crossJoin(F.broadcast(total)).select(key, F.transform("v", lambda x: x.cast("double") * weight / F.sqrt("_var")).alias(name))

    return scaled(a, dims[0], weights[0], "_a").join(scaled(b, dims[1], weights[1], "_b"), key).select(key, F.concat("_a", "_b").alias("v"))


def variable_features(matrix: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """The ``n`` features of greatest variance of log2(CPM + 1) over groups, groups without the feature counting as 0."""
    sums = matrix.join(groups.select("cell", "group"), "cell").groupBy("feature", "group").agg(F.sum("value").alias("x"))
    totals = sums.groupBy("group").agg(F.sum("x").alias("_t"))
    logs = sums.join(totals, "group").withColumn("y", F.log2(F.col("x") * 1e6 / F.col("_t") + 1))
    count = totals.count()
    stats = logs.groupBy("feature").agg(F.sum("y").alias("_s"), F.sum(F.col("y") * F.col("y")).alias("_q"))
    variance = (F.col("_q") - F.col("_s") * F.col("_s") / count) / max(count - 1, 1)
    return stats.select("feature", variance.alias("variance")).orderBy(F.col("variance").desc(), "feature").limit(n)


def iterative_lsi(matrix: DataFrame, cluster, iterations: int = 2, n_features: int = 25_000, k: int = 30, method: int = 2) -> DataFrame:
    """LSI on the commonest features, then again on those most variable between ``cluster(scores)`` (cell, group)."""
    totals = matrix.groupBy("feature").agg(F.sum("value").alias("total"))
    skip = int(0.005 * totals.count())
    features = totals.orderBy(F.col("total").desc(), "feature").offset(skip).limit(n_features).select("feature")
    for i in range(iterations):
        chosen = materialise(features, "features")
        _, scores, _ = svd(tf_idf(matrix.join(chosen, "feature", "left_semi"), method), k)
        if i + 1 < iterations:
            features = variable_features(matrix, cluster(scores), n_features).select("feature")
    return scores



@dataclass
class LSI:
    """A fitted index: what later cells need to be projected, and the vectors of all cells."""

    scores: DataFrame  # cell, v
    loadings: DataFrame  # feature, v
    df: DataFrame  # feature, df
    n: int
    singular: np.ndarray
    depth_correlation: list[float]  # of each dimension with log10(depth + 1)
    method: int
    scale: float

    def kept(self, cut_off: float | None = 0.75) -> list[int]:
        """Dimensions whose correlation with depth stays within ``cut_off``."""
        return [j for j, r in enumerate(self.depth_correlation) if cut_off is None or abs(r) <= cut_off]

    def vectors(self, cut_off: float | None = 0.75, scaled: bool = False) -> DataFrame:
        out = self.scores.withColumn("v", F.array(*[F.col("v")[j] for j in self.kept(cut_off)]))
        return scale_dims(out) if scaled else out

    def project(self, matrix: DataFrame) -> DataFrame:
        """Scores of further cells, weighted by the frequencies of the fitted ones."""
        return project(weigh(matrix, self.df, self.n, self.method, self.scale), self.loadings, len(self.singular))


def depth_between(depth: DataFrame, quantiles: tuple[float, float]) -> DataFrame:
    """Cells (cell, depth) whose depth lies between two quantiles of all, both included."""
    low, high = depth.agg(F.percentile_approx("depth", [min(quantiles), max(quantiles)], 10_000)).first()[0] or (0, 0)
    return depth.where(F.col("depth").between(low, high))


def bounded_sample(cells: DataFrame, value: str, n: int, quantiles: tuple[float, float] | None = (0.02, 0.98), factor: float = 2.0, seed: int = 1) -> DataFrame:
    """``n`` cells, by a seeded hash, of those within quantiles of ``value`` that are ``factor`` times as far out; of all, if those are fewer than ``n``."""
    order = [F.xxhash64(F.col("cell"), F.lit(seed)), F.col("cell")]
    if quantiles is None:
        return cells.orderBy(*order).limit(n)
    ends = [min(quantiles) / factor, 1 - (1 - max(quantiles)) / factor]
    low, high = cells.agg(F.percentile_approx(value, ends, 10_000)).first()[0] or (0, 0)
    inside = cells.where(F.col(value).between(low, high))
    return (inside if inside.limit(n).count() >= n else cells).orderBy(*order).limit(n)


def fit_lsi(matrix: DataFrame, k: int = 30, method: int = 2, scale: float = 1e4, outliers: tuple[float, float] | None = (0.02, 0.98), sample_cells: int | None = None, seed: int = 1) -> LSI:
    """LSI fitted on the cells of common depth (and on ``sample_cells`` of them, a parameter); all cells are then projected.

    Depth is the number of features a cell has.  On the fitted cells the projection equals the decomposition.
    """
    matrix = materialise(matrix.where(F.col("value") != 0), "matrix")
    depth = materialise(matrix.groupBy("cell").agg(F.countDistinct("feature").alias("depth")), "depth")
    fitted = depth if outliers is None else depth_between(depth, outliers)
    if sample_cells is not None:
        fitted = bounded_sample(fitted, "depth", sample_cells, None, seed=seed)
    mine = materialise(matrix.join(fitted.select("cell"), "cell", "left_semi"), "fitted")
    df, n = fit_idf(mine)
    df = materialise(df, "df")
    d, _, loadings = svd(weigh(mine, df, n, method, scale), k, seed=seed)
    scores = materialise(project(weigh(matrix, df, n, method, scale), loadings, len(d)), "scores")
    logs = scores.join(depth, "cell").withColumn("depth", F.log10(F.col("depth") + 1.0))
    r = {x["dim"]: x["correlation"] for x in dim_correlations(logs, "v", "depth", len(d)).collect()}  # one row a dimension
    return LSI(scores, loadings, df, n, d, [r.get(j) or 0.0 for j in range(len(d))], method, scale)


def iterative_lsi_model(
    matrix: DataFrame, cluster, iterations: int = 2, n_features: int = 25_000, k: int = 30, method: int = 2, cut_off: float | None = 0.75, scaled: bool = True,
    outliers: tuple[float, float] | None = (0.02, 0.98), sample_before: int | None = None, sample_last: int | None = None,
) -> LSI:
    """LSI on the commonest features, then again on those most variable between ``cluster(vectors)`` (cell, group), which sees only dimensions that don't follow depth."""
    totals = matrix.groupBy("feature").agg(F.sum("value").alias("total"))
    skip = int(0.005 * totals.count())
    features = totals.orderBy(F.col("total").desc(), "feature").offset(skip).limit(n_features).select("feature")
    for i in range(iterations):
        last = i + 1 == iterations
        chosen = materialise(features, "features")
        model = fit_lsi(matrix.join(chosen, "feature", "left_semi"), k, method, outliers=outliers, sample_cells=sample_last if last else sample_before)
        if not last:
            features = variable_features(matrix, cluster(model.vectors(cut_off, scaled)), n_features).select("feature")
    return model
