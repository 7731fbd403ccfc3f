"""Tests of features between groups of cells, absent entries counting as zeros."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.stats import adjust_bh, rank_quantile
from tessera.functions.tails import binomial_upper_p, hypergeometric_mlog10p, normal_p, t_p
from tessera.operators.graph import exact_neighbours
from tessera.session import materialise

#: Background cells that a cell claims in the first search and at most in a later one, for each that it wants.
CLAIMS, MOST_CLAIMS = 25, 400


def _two_sides(matrix: DataFrame, sides: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Entries with their side (1 foreground, 2 background) in each test, and the sizes of both sides, one row a test; ``by`` names the tests."""
    entries = matrix.join(sides.select(*by, "cell", "side"), "cell")
    sizes = sides.groupBy(*by).agg(F.count(F.when(F.col("side") == 1, 1)).alias("n1"), F.count(F.when(F.col("side") == 2, 1)).alias("n2"))
    return entries, sizes


def _with_sizes(df: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    return df.join(F.broadcast(sizes), by) if by else df.crossJoin(F.broadcast(sizes))  # one row a test


def t_test(matrix: DataFrame, sides: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Pooled two-sample t per feature (and test, if ``sides`` holds several): means, variances, log2 fold change, t and p; p is null where no entry varies."""
    by = by or []
    entries, sizes = _two_sides(matrix, sides, by)
    x = F.col("value").cast("double")
    of = lambda k, e: F.sum(F.when(F.col("side") == k, e).otherwise(0.0))
    s = entries.groupBy(*by, "feature").agg(of(1, x).alias("s1"), of(2, x).alias("s2"), of(1, x * x).alias("q1"), of(2, x * x).alias("q2"))
    s = _with_sizes(s, sizes, by)
    s = s.withColumn("mean1", F.col("s1") / F.col("n1")).withColumn("mean2", F.col("s2") / F.col("n2"))
    for k in (1, 2):
        s = s.withColumn(f"var{k}", (F.col(f"q{k}") - F.col(f"n{k}") * F.col(f"mean{k}") * F.col(f"mean{k}")) / (F.col(f"n{k}") - 1))
    df = F.col("n1") + F.col("n2") - 2
    pooled = ((F.col("n1") - 1) * F.col("var1") + (F.col("n2") - 1) * F.col("var2")) / df
    error = F.sqrt(F.greatest(F.lit(0.0), pooled) * (1 / F.col("n1") + 1 / F.col("n2")))
    s = s.withColumn("t", (F.col("mean1") - F.col("mean2")) / F.nullif(error, F.lit(0.0)))
    s = s.withColumn("log2fc", F.log2((F.col("mean1") + 1) / (F.col("mean2") + 1))).withColumn("p", t_p("t", df.cast("double")))
    return s.select(*by, "feature", "mean1", "mean2", "var1", "var2", "log2fc", "t", "p")


def wilcoxon(matrix: DataFrame, sides: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rank-sum test per feature (and test): AUC, log2 fold change, z (with tie correction) and p.

    Only distinct nonzero values are ranked; all zeros are one tie of known size.  Values must not be negative.
    """
    by = by or []
    entries, sizes = _two_sides(matrix, sides, by)
    counts = entries.where(F.col("value") != 0).groupBy(*by, "feature", "value").agg(
        F.count(F.when(F.col("side") == 1, 1)).alias("c1"), F.count(F.when(F.col("side") == 2, 1)).alias("c2")
    )
    row = Window.partitionBy(*by, "feature")
    below = row.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = _with_sizes(counts.withColumn("k1", F.sum("c1").over(row)).withColumn("k2", F.sum("c2").over(row)), sizes, by)
    n = F.col("n1") + F.col("n2")
    zeros = n - F.col("k1") - F.col("k2")
    c = F.col("c1") + F.col("c2")
    rank = zeros + F.coalesce(F.sum(c).over(below), F.lit(0)) + (c + 1) / 2
    ranked = ranked.withColumn("_r1", F.col("c1") * rank).withColumn("_tie", F.pow(c.cast("double"), 3) - c).withColumn("_z", zeros.cast("double"))
    out = ranked.groupBy(*by, "feature").agg(
        F.sum("_r1").alias("_r"), F.sum("_tie").alias("_tie"), F.first("_z").alias("_z"), F.first("n1").alias("n1"), F.first("n2").alias("n2"), F.first("k1").alias("_k1"),
        F.sum(F.col("value") * F.col("c1")).alias("s1"), F.sum(F.col("value") * F.col("c2")).alias("s2"),
    )
    out = out.withColumn("_r", F.col("_r") + (F.col("n1") - F.col("_k1")) * (F.col("_z") + 1) / 2).withColumn("_tie", F.col("_tie") + F.pow("_z", F.lit(3)) - F.col("_z"))
    u = F.col("_r") - F.col("n1") * (F.col("n1") + 1) / 2
    both = (F.col("n1") * F.col("n2")).cast("double")
    all_ = n.cast("double")
    sigma = F.sqrt(both / 12 * ((all_ + 1) - F.col("_tie") / (all_ * (all_ - 1))))
    z = (u - both / 2 - F.signum(u - both / 2) * 0.5) / F.nullif(sigma, F.lit(0.0))
    out = out.withColumn("auc", u / both).withColumn("z", z)
    # Means, not sums, so that sides of different size compare; equal sizes give the same sign as sums.
    out = out.withColumn("log2fc", F.log2((F.col("s1") / F.col("n1") + 1) / (F.col("s2") / F.col("n2") + 1)))
    return out.select(*by, "feature", "auc", "log2fc", "z", normal_p("z").alias("p"))


def binomial_test(matrix: DataFrame, sides: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Cells with the feature in the foreground against the share of the background; two-sided by doubling the smaller tail."""
    by = by or []
    entries, sizes = _two_sides(matrix, sides, by)
    k = entries.where(F.col("value") != 0).groupBy(*by, "feature").agg(F.count(F.when(F.col("side") == 1, 1)).alias("k1"), F.count(F.when(F.col("side") == 2, 1)).alias("k2"))
    k = _with_sizes(k, sizes, by).withColumn("share", F.greatest(F.col("k2"), F.lit(1)) / F.col("n2"))
    k = k.withColumn("_up", binomial_upper_p("k1", "n1", "share")).withColumn("_above", binomial_upper_p(F.col("k1") + 1, "n1", "share"))
    mean1, mean2 = F.col("k1") / F.col("n1"), F.col("k2") / F.col("n2")
    return k.select(*by, "feature", "k1", "k2", F.log2((mean1 + 1) / (mean2 + 1)).alias("log2fc"), F.least(F.lit(1.0), 2 * F.least("_up", 1 - F.col("_above"))).alias("p"))


def _closest_first(claims: DataFrame) -> DataFrame:
    """(cell, matched) of the claims (query, neighbour, distance, _want) of one group, granted in order of distance; its cells are decided in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["distance", "query", "neighbour"])
        want = dict(zip(pdf["query"], pdf["_want"]))
        used, granted = set(), []
        for query, neighbour in zip(pdf["query"], pdf["neighbour"]):
            if want[query] and neighbour not in used:
                want[query] -= 1
                used.add(neighbour)
                granted.append((query, neighbour))
        return pd.DataFrame(granted, columns=["cell", "matched"])

    kind = claims.schema["query"].dataType.simpleString()
    return claims.groupBy(F.lit(1).alias("_all")).applyInPandas(run, f"cell {kind}, matched {kind}")


def matched_background(
    cells: DataFrame, group: str, bias: list[str], k: int = 1, max_cells: int | None = None, buffer_ratio: float = 1.0,
    use: list[str] | None = None, against: list[str] | None = None, seed: int = 1,
) -> DataFrame:
    """(cell, group, matched): for every cell of a group the nearest cells of other groups by rank quantiles of ``bias``.

    Each background cell serves a group at most once; of several claims the closest wins.  Only cells of
    other groups (or of those ``against``) are searched; cells that have lost a claim search again among those not yet claimed,
    until every cell has ``k`` or the background of its group is used up.  A group brings at most ``max_cells`` cells and at most
    ``buffer_ratio`` of the number of its background cells, chosen by a seeded hash; ``use`` names the groups that are matched (all).
    """
    ranked = cells.where(F.col(group).isNotNull())
    for i, b in enumerate(bias):
        ranked = rank_quantile(ranked, b, f"_q{i}")
    ranked = materialise(ranked.select("cell", F.col(group).alias("group"), F.array(*[F.col(f"_q{i}").cast("double") for i in range(len(bias))]).alias("v")), "ranked")
    sizes = {r["group"]: r["n"] for r in ranked.groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a group
    pool = set(sizes if against is None else against)
    out: DataFrame | None = None
    for g in sorted(sizes if use is None else set(use) & set(sizes)):
        mine, free = ranked.where(F.col("group") == g), ranked.where((F.col("group") != g) & F.col("group").isin(*pool))
        most = int(buffer_ratio * sum(sizes.get(p, 0) for p in pool - {g}) / k)
        most = min(most, sizes[g] if max_cells is None else max_cells)
        if most < sizes[g]:
            mine = mine.orderBy(F.xxhash64(F.col("cell"), F.lit(seed)), "cell").limit(most)
        todo, claims = mine.withColumn("_want", F.lit(k)), CLAIMS * k
        while todo.limit(1).count() and free.limit(1).count():
            near = exact_neighbours(free.select("cell", "v"), todo.select("cell", "v"), "cell", "v", claims)
            won = _closest_first(near.join(todo.select(F.col("cell").alias("query"), "_want"), "query"))
            won = materialise(won.select("cell", F.lit(g).alias("group"), "matched"), "won")
            claims = min(2 * claims, MOST_CLAIMS * k)
            out = won if out is None else out.unionByName(won)
            has = won.groupBy("cell").agg(F.count(F.lit(1)).alias("_has"))
            rest = todo.join(has, "cell", "left").withColumn("_want", (F.col("_want") - F.coalesce("_has", F.lit(0))).cast("int")).where(F.col("_want") > 0).drop("_has")
            todo = materialise(rest, "unmatched")
            free = materialise(free.join(won.select(F.col("matched").alias("cell")), "cell", "left_anti"), "free")
    if out is None:
        return ranked.select("cell", "group", F.col("cell").alias("matched")).limit(0)
    return out


def scaled_by(matrix: DataFrame, cells: DataFrame, norm_by: str, scale_to: float = 1e4) -> DataFrame:
    """``matrix`` with values divided by the cell's ``norm_by`` and multiplied by ``scale_to``; cells without a norm, or with 0, are left out."""
    factor = cells.where(F.col(norm_by) > 0).select("cell", (F.lit(float(scale_to)) / F.col(norm_by)).alias("_f"))
    return matrix.join(factor, "cell").withColumn("value", F.col("value") * F.col("_f")).drop("_f")


def marker_features(
    matrix: DataFrame, cells: DataFrame, group: str, bias: list[str], test: str = "wilcoxon", norm_by: str | None = None, scale_to: float = 1e4, binarize: bool = False, **background,
) -> DataFrame:
    """One-against-background tests of every group, with FDR per group; all groups in one pass over the matrix.

    ``norm_by`` and ``scale_to`` scale every cell, ``binarize`` counts presence; further arguments are those of :func:`matched_background`.
    """
    matched = materialise(matched_background(cells, group, bias, **background), "background")
    sides = matched.select("group", "cell", F.lit(1).alias("side")).distinct().unionByName(matched.select("group", F.col("matched").alias("cell"), F.lit(2).alias("side")))
    values = matrix if norm_by is None else scaled_by(matrix, cells, norm_by, scale_to)
    if binarize:
        values = values.where(F.col("value") != 0).withColumn("value", F.lit(1.0))
    run = {"wilcoxon": wilcoxon, "t": t_test, "binomial": binomial_test}[test]
    return adjust_bh(materialise(run(values, materialise(sides, "sides"), ["group"]), "tested"), "p", ["group"])


def pick_markers(results: DataFrame, cut_off: str | Column, n: int | None = None) -> DataFrame:
    """Rows for which ``cut_off`` holds, by group in order of FDR, at most ``n`` each."""
    from tessera.functions.expressions import predicate

    rows = results.where(predicate(cut_off, results.columns) if isinstance(cut_off, str) else cut_off)
    order = Window.partitionBy("group").orderBy(F.col("fdr").asc(), F.col("log2fc").desc(), "feature")
    rows = rows.withColumn("rnk", F.row_number().over(order))
    return rows if n is None else rows.where(F.col("rnk") <= n)


def volcano(results: DataFrame, cut_off: str) -> DataFrame:
    """A column ``class``: Up, Down or Not, by a predicate and the sign of the fold change."""
    from tessera.functions.expressions import predicate

    return results.withColumn("class", F.when(~predicate(cut_off, results.columns), "Not").when(F.col("log2fc") > 0, "Up").otherwise("Down"))


def enrichment(marked: DataFrame, annotation: DataFrame, universe: DataFrame, key: str = "peak_id", group: str = "motif") -> DataFrame:
    """Hypergeometric over-representation of each annotation among ``marked`` features of ``universe``."""
    n_all, n_drawn = universe.agg(F.countDistinct(key).alias("n_all")), marked.agg(F.countDistinct(key).alias("n_drawn"))
    rows = annotation.join(universe.select(key).distinct(), key, "left_semi").select(key, group).distinct()
    hit = rows.join(marked.select(key).distinct().withColumn("_m", F.lit(1)), key, "left")
    out = hit.groupBy(group).agg(F.count("_m").alias("compare_frequency"), F.count(F.lit(1)).alias("background_frequency"))
    out = out.crossJoin(F.broadcast(n_all)).crossJoin(F.broadcast(n_drawn))  # one row each
    out = out.withColumn("compare_share", F.col("compare_frequency") / F.col("n_drawn")).withColumn("background_share", F.col("background_frequency") / F.col("n_all"))
    out = out.withColumn("enrichment", F.col("compare_share") / F.col("background_share"))
    p = hypergeometric_mlog10p("compare_frequency", "background_frequency", F.col("n_all") - F.col("background_frequency"), "n_drawn")
    out = out.withColumn("mlog10p", F.round(p, 4))
    return out.withColumn("mlog10padj", F.greatest(F.lit(0.0), F.col("mlog10p") - F.log10(F.count(F.lit(1)).over(Window.partitionBy()))))
