"""Window statistics whose definitions differ from Spark's own: ranks, adjusted p-values, rolling means, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialise


#: Value buckets into which a running sum is cut, so that no order over all rows is one task.
BUCKETS = 64


def _bucketed(df: DataFrame, value: str) -> DataFrame:
    """``df`` with ``_b``, the number of the value bucket, increasing with ``value``; equal values share a bucket."""
    at = [k / BUCKETS for k in range(1, BUCKETS)]
    cuts = sorted(set(df.agg(F.percentile_approx(value, at, 1000)).first()[0] or []))
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(value))) if cuts else F.lit(0)
    return df.withColumn("_b", F.when(F.col(value).isNull(), -1).otherwise(bucket))


def running_sums(df: DataFrame, value: str, sums: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """Sums of columns over the rows of lower ``value`` in the group; ``sums`` maps an output to a column. Values must be distinct in a group.

    Partial sums per bucket become offsets of the sums within buckets.  ``df``
    is read three times, so it should be a table.
    """
    by = by or []
    rows = _bucketed(df, value)
    totals = rows.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows a group
    offsets = totals.select(*by, "_b", *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in sums])
    within = Window.partitionBy(*by, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"_w_{o}") for o, c in sums.items()])
    out = out.join(offsets if by else F.broadcast(offsets), [*by, "_b"])
    return out.select(*df.columns, *[(F.col(f"_w_{o}") + F.col(f"_o_{o}")).alias(o) for o in sums])


def average_rank(df: DataFrame, value: str, out: str = "rank", by: list[str] | None = None) -> DataFrame:
    """Rank from 1 with ties at their mean: distinct values are counted first, so windows run over values, not rows."""
    by = by or []
    counts = materialise(df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")), "counts")
    ranks = running_sums(counts, value, {"_below": "_n"}, by)
    ranks = ranks.select(*by, value, (F.col("_below") + (F.col("_n") + 1) / 2).alias(out))
    return df.join(ranks, [*by, value])


def rank_quantile(df: DataFrame, value: str, out: str = "quantile", by: list[str] | None = None) -> DataFrame:
    """Whole part of the average rank divided by the number of rows; not ``percent_rank`` and not ``cume_dist``."""
    by = by or []
    ranked = average_rank(df, value, "_r", by)
    n = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
    ranked = ranked.join(n, by) if by else ranked.crossJoin(F.broadcast(n))
    return ranked.withColumn(out, F.floor("_r") / F.col("_all")).drop("_r", "_all")


def quantiles(df: DataFrame, value: str, at: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Interpolated quantiles per group, exactly: one row a group, a column for each name of ``at``. Nulls are no values.

    Distinct values are counted and the counts summed up in buckets, so no group is held by one task.
    """
    by = by or []
    counts = materialise(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")), "counts")
    n = counts.groupBy(*by).agg(F.sum("_n").alias("_all"))
    ranked = running_sums(counts, value, {"_below": "_n"}, by)
    ranked = ranked.join(n, by) if by else ranked.crossJoin(F.broadcast(n))  # one row
    x = F.col(value).cast("double")
    sums = [F.max("_all").alias("_all")]
    for i, p in enumerate(at.values()):
        place = F.lit(p) * (F.col("_all") - 1)
        for end, f in (("lo", F.floor), ("hi", F.ceil)):
            sums.append(F.max(F.when(F.col("_below") <= f(place), x)).alias(f"_{end}{i}"))
    out = ranked.groupBy(*by).agg(*sums)
    part = lambda p: F.lit(p) * (F.col("_all") - 1) - F.floor(F.lit(p) * (F.col("_all") - 1))
    mixed = lambda i, p: F.when(F.col(f"_lo{i}") == F.col(f"_hi{i}"), F.col(f"_lo{i}")).otherwise(F.col(f"_lo{i}") * (1 - part(p)) + F.col(f"_hi{i}") * part(p))
    return out.select(*by, *[mixed(i, p).alias(name) for i, (name, p) in enumerate(at.items())])


def winsorise(df: DataFrame, value: str, low: float, high: float, by: list[str] | None = None) -> DataFrame:
    """Clip ``value`` at its interpolated quantiles; a high limit of 0 is replaced by the maximum."""
    by = by or []
    limits = quantiles(df, value, {"_lo": low, "_hi": high, "_max": 1.0}, by)
    limits = limits.withColumn("_hi", F.when(F.col("_hi") == 0, F.col("_max")).otherwise(F.col("_hi")))
    joined = df.join(limits, by) if by else df.crossJoin(F.broadcast(limits))  # one row
    return joined.withColumn(value, F.least("_hi", F.greatest("_lo", value))).drop("_lo", "_hi", "_max")


def adjust_bh(df: DataFrame, p: str, by: list[str] | None = None, out: str = "fdr") -> DataFrame:
    """Benjamini-Hochberg: the least of ``p * n / rank`` from the greatest p downwards, at most 1; equal p get one value.

    Works on distinct p by buckets: ranks are running sums, and the least of later buckets is carried to earlier ones.
    """
    by = by or []
    counts = materialise(df.groupBy(*by, p).agg(F.count(F.lit(1)).alias("_n")), "counts")
    n = counts.groupBy(*by).agg(F.sum("_n").alias("_all"))
    ranked = running_sums(counts, p, {"_below": "_n"}, by)
    ranked = ranked.join(n, by) if by else ranked.crossJoin(F.broadcast(n))  # one row
    ranked = materialise(ranked.withColumn("_q", F.col(p) * F.col("_all") / (F.col("_below") + F.col("_n"))), "ranked")
    ranked = _bucketed(ranked, p)
    later = Window.partitionBy(*by).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows a group
    least = ranked.groupBy(*by, "_b").agg(F.min("_q").alias("_l")).select(*by, "_b", F.min("_l").over(later).alias("_later"))
    down = Window.partitionBy(*by, "_b").orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0)
    done = ranked.withColumn("_m", F.min("_q").over(down)).join(least if by else F.broadcast(least), [*by, "_b"])
    return df.join(done.select(*by, p, F.least(F.lit(1.0), "_m", "_later").alias(out)), [*by, p])


def adjust_bonferroni(df: DataFrame, p: str, by: list[str] | None = None, out: str = "padj") -> DataFrame:
    return df.withColumn(out, F.least(F.lit(1.0), F.col(p) * F.count(F.lit(1)).over(Window.partitionBy(*(by or [])))))


def rolling_mean(df: DataFrame, value: str, order: str, k: int, by: list[str] | None = None, out: str = "smooth") -> DataFrame:
    """Centred mean of ``k`` (odd) rows; the ends repeat the first and last full window."""
    h = k // 2
    w = Window.partitionBy(*(by or [])).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mean = F.avg(value).over(w.rowsBetween(-h, h))
    full = F.when(F.count(value).over(w.rowsBetween(-h, h)) == k, mean)
    out_df = df.withColumn("_full", full)
    inner = F.coalesce("_full", F.when(F.row_number().over(w) <= h, F.first("_full", True).over(whole)).otherwise(F.last("_full", True).over(whole)))
    return out_df.withColumn(out, inner).drop("_full")


def row_zscore(df: DataFrame, value: str, row: list[str], clip: float | None = None, out: str = "z") -> DataFrame:
    w = Window.partitionBy(*row)
    z = (F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_samp(value).over(w), F.lit(0.0))
    return df.withColumn(out, F.greatest(F.lit(-clip), F.least(F.lit(clip), z)) if clip else z)


def row_scale(df: DataFrame, value: str, row: list[str], out: str = "scaled") -> DataFrame:
    """Each row's values from 0 (its least) to 1 (its greatest); a constant row gives null."""
    w = Window.partitionBy(*row)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(out, (F.col(value) - low) / F.nullif(high - low, F.lit(0)))


def normalise_columns(df: DataFrame, value: str, column: list[str], scale: float = 1e4, out: str = "norm") -> DataFrame:
    """Values as shares of their column's sum, times ``scale``. The sums are aggregated before they are joined, so a long column is no single task."""
    sums = df.groupBy(*column).agg(F.sum(value).alias("_sum"))
    return df.join(sums, column).withColumn(out, F.col(value) * F.lit(scale) / F.col("_sum")).drop("_sum")


def roc(df: DataFrame, score: str, label: str) -> DataFrame:
    """False and true positive rates down the distinct scores, with the area so far by trapezoids."""
    counts = df.groupBy(score).agg(F.sum(F.col(label).cast("int")).alias("_p"), F.sum(1 - F.col(label).cast("int")).alias("_n"))
    counts = materialise(counts, "counts")
    total = counts.agg(F.sum("_p").alias("_tp"), F.sum("_n").alias("_tn"))
    below = running_sums(counts, score, {"_pb": "_p", "_nb": "_n"}).crossJoin(F.broadcast(total))  # one row
    tpr, before = (F.col("_tp") - F.col("_pb")) / F.col("_tp"), (F.col("_tp") - F.col("_pb") - F.col("_p")) / F.col("_tp")
    rates = below.select(score, ((F.col("_tn") - F.col("_nb")) / F.col("_tn")).alias("fpr"), tpr.alias("tpr"), (F.col("_n") / F.col("_tn") * (tpr + before) / 2).alias("_step"))
    rates = materialise(rates, "rates")
    area = rates.agg(F.sum("_step").alias("_area"))
    out = running_sums(rates, score, {"_below": "_step"}).crossJoin(F.broadcast(area))
    return out.select(score, "fpr", "tpr", (F.col("_area") - F.col("_below")).alias("area"))


def ecdf_at(sample: DataFrame, value: str, at: DataFrame, x: str, out: str = "ecdf") -> DataFrame:
    """Share of ``sample`` not above each ``x``: both are ordered together and the count is carried along."""
    s = sample.groupBy(F.col(value).alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    points = at.select(F.col(x).alias("_x")).distinct().select("_x", F.lit(0).cast("long").alias("_n"))
    both = materialise(s.unionByName(points).groupBy("_x").agg(F.sum("_n").alias("_n")), "counts")
    total = both.agg(F.sum("_n").alias("_all"))
    seen = running_sums(both, "_x", {"_below": "_n"}).crossJoin(F.broadcast(total))  # one row
    return at.join(seen.select(F.col("_x").alias(x), ((F.col("_below") + F.col("_n")) / F.col("_all")).alias(out)), x)


def chunk_of(order: str, size: int, by: list[str] | None = None) -> Column:
    """Number of the chunk of ``size`` rows, from 1."""
    return F.ceil(F.row_number().over(Window.partitionBy(*(by or [])).orderBy(order)) / size)


def natural_key(label: str) -> list[Column]:
    """Sort keys that put C2 before C10: the text without its last number, then that number."""
    return [F.regexp_replace(label, "[0-9]+$", ""), F.coalesce(F.nullif(F.regexp_extract(label, "([0-9]+)$", 1), F.lit("")).cast("long"), F.lit(-1))]
