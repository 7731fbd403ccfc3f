"""The N highest-scoring items of every group, by descending score bands.

All rows are dealt to range-partitioned score bands, which are taken from the top; only a
band's own rows are shuffled.  Groups that already have their N items are anti-joined away before a band
is looked at, so a group of millions of rows is decided in its first band; the
band in which a group is completed is finished by exact ranking of its ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.skew import heavy_keys
from tessera.session import discard, materialise
from tessera.sources.tables import table, with_intervals

#: Quantiles of the score at which bands begin, from the top; what lies below the last is one more band.
BANDS = (0.95, 0.6, 0.3)


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, n: int = 5, bands: tuple[float, ...] = BANDS, scores: DataFrame | None = None) -> DataFrame:
    """Columns group, item, score and ``rnk`` (int, 1 to n) of the n best items of every group.

    Order: score downwards, then item upwards by bytes.  Items of a group that
    are equal count once, with their best score.  Rows count whose group, item
    and score are not null and whose score is neither NaN nor infinite; an
    empty table gives no rows.  Extra columns are ignored.  ``scores`` may name a table with the
    same column ``score`` that is cheaper to read, from which the bands' edges are taken; they bear only on speed.
    """
    finite = (F.abs(F.col(score)) < float("inf")) & ~F.isnan(F.col(score))
    sound = F.col(group).isNotNull() & F.col(item).isNotNull() & finite
    x = F.col(score).cast("double")
    cuts = (df if scores is None else scores).where(finite).agg(F.percentile_approx(x, [float(b) for b in bands], 1000)).first()[0] or []
    edges = sorted(set(cuts), reverse=True)
    band = F.lit(len(edges))
    for k in reversed(range(len(edges))):
        band = F.when(F.col("_x") >= edges[k], k).otherwise(band)
    rows = df.where(sound).select(F.col(group).alias("_g"), F.col(item).alias("_i"), x.alias("_x"))
    banded = materialise(rows.withColumn("_band", band.cast("int")), "bands", ["_band"])
    heavy = materialise(heavy_keys(banded, ["_g"]).select("_g"), "heavy")

    of_group = Window.partitionBy("_g")
    order = of_group.orderBy(F.col("_x").desc(), F.col("_i").asc())

    def best(candidates: DataFrame) -> DataFrame:
        """The first n of each group, equal items once; Spark keeps n of a group in every task before it shuffles by group."""
        once = candidates.groupBy("_g", "_i").agg(F.max("_x").alias("_x"))
        return once.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= n)

    found: list[DataFrame] = []  # of each band, the best so far of the groups that have rows in it or were open before it
    for k in range(len(edges) + 1):
        rows_k = banded.where(F.col("_band") == k).drop("_band")
        if not found:
            ranked = best(rows_k)
        else:
            filled = found[0].where(F.col("rnk") == n).select("_g")
            for t in found[1:]:
                filled = filled.unionByName(t.where(F.col("rnk") == n).select("_g"))
            open_ = found[-1].where(~F.col("_full")).select("_g", "_i", "_x")
            hot_filled = F.broadcast(filled.join(F.broadcast(heavy), "_g", "left_semi"))  # both bounded by the number of heavy groups
            hot = rows_k.join(F.broadcast(heavy), "_g", "left_semi").join(hot_filled, "_g", "left_anti").unionByName(open_.join(F.broadcast(heavy), "_g", "left_semi"))
            cold = rows_k.join(F.broadcast(heavy), "_g", "left_anti").join(filled, "_g", "left_anti").unionByName(open_.join(F.broadcast(heavy), "_g", "left_anti"))
            ranked = best(hot).unionByName(best(cold))
        found.append(materialise(ranked.withColumn("_full", F.max("rnk").over(of_group) == n), "best"))
    for t in (banded, heavy):
        discard(t)
    out = found[-1]
    for t in found[:-1]:
        out = out.unionByName(t.where("_full"))
    return out.select(F.col("_g").alias(group), F.col("_i").alias(item), F.col("_x").alias(score), F.col("rnk").cast("int").alias("rnk"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """The five peaks of highest mlog10p of every grp."""
    stored = table(spark, root, "grouppeaks").select("grp", "peaks", "mlog10p")
    return top_n_per_group(with_intervals(stored, "peaks"), "grp", "peaks", "mlog10p", 5, scores=stored).select("grp", "peaks", "rnk")


QUERIES = {"p2_found": p2_found}

SQL = {
    "p2_found": r"""
WITH ok AS (
  SELECT grp, peaks, max(mlog10p) AS x FROM (
    SELECT *, regexp_extract(peaks, p, 1) AS seqname, TRY_CAST(replace(regexp_extract(peaks, p, 2), ',', '') AS BIGINT) AS s,
           TRY_CAST(replace(regexp_extract(peaks, p, 3), ',', '') AS BIGINT) AS e
    FROM (SELECT *, '^\s*(\S.*?|\S)\s*[:_-]\s*([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)\s*(?:-|_|\.\.)\s*([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)\s*$' AS p FROM grouppeaks))
  WHERE grp IS NOT NULL AND seqname <> '' AND e >= s AND mlog10p IS NOT NULL AND NOT isnan(mlog10p) AND NOT isinf(mlog10p)
  GROUP BY grp, peaks)
SELECT grp, peaks, CAST(r AS INTEGER) AS rnk FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY x DESC, peaks) AS r FROM ok) WHERE r <= 5"""
}
