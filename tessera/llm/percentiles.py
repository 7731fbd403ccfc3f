"""Percentiles of very large columns from counts in logarithmic buckets.

A value falls into the bucket ``ceil(log_gamma |x|)`` of its sign, with ``gamma =
(1 + a) / (1 - a)``; zero has a bucket of its own.  Counts of matching buckets
add up, so sketches of partitions or days combine without loss, and any percentile is
returned with a relative error of at most ``a``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.skew import skew_join
from tessera.session import materialise
from tessera.sources.tables import latest, table

#: Greatest relative error of a percentile.
ACCURACY = 0.002

#: Added to a bucket's number so that numbers of either sign stay in order.
_SHIFT = 1 << 24


def sketch(df: DataFrame, keys: list[str], values: list[str], accuracy: float = ACCURACY) -> DataFrame:
    """Bucket counts: keys, ``field_name``, ``bucket`` (increasing with the value) and ``n``.

    Null and NaN are no values.  An infinite value counts, beyond every finite
    one.  A null key is a key.  Repeated rows count as often as they occur.  The number
    of rows per key is bounded by the range of doubles, not by the data:
    about ``700 / accuracy`` of either sign, in practice some thousands.
    """
    step = math.log((1 + accuracy) / (1 - accuracy))
    fields = F.explode(F.array(*[F.struct(F.lit(v).alias("field_name"), F.col(v).cast("double").alias("x")) for v in values]))
    long = df.select(*keys, fields.alias("_f")).select(*keys, "_f.field_name", "_f.x").where(F.col("x").isNotNull() & ~F.isnan("x"))
    size = F.abs("x")
    index = F.when(size == float("inf"), F.lit(_SHIFT - 1)).otherwise(F.ceil(F.log(size) / F.lit(step)))
    bucket = F.when(F.col("x") == 0, F.lit(0)).otherwise(F.signum("x").cast("long") * (index + F.lit(_SHIFT)))
    return long.withColumn("bucket", bucket.cast("long")).groupBy(*keys, "field_name", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """One sketch per ``keys`` from sketches of finer keys: counts of matching buckets are added."""
    return sketches.groupBy(*keys, "field_name", "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, keys: list[str], at: list[float], accuracy: float = ACCURACY) -> DataFrame:
    """keys, field_name, ``n`` and a column ``p<percent>`` for each of ``at``.

    The p-th percentile is the value of rank ``floor(p * (n - 1))`` from 0; what is
    returned lies within ``accuracy`` of it, relatively.
    """
    gamma = (1 + accuracy) / (1 - accuracy)
    by = [*keys, "field_name"]
    run = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    seen = sketches.withColumn("_upto", F.sum("n").over(run)).withColumn("_all", F.sum("n").over(Window.partitionBy(*by)))
    index = F.abs(F.col("bucket")) - F.lit(_SHIFT)
    size = F.when(index == _SHIFT - 1, F.lit(float("inf"))).otherwise(F.pow(F.lit(gamma), index) * F.lit(2 / (gamma + 1)))
    seen = seen.withColumn("_value", F.when(F.col("bucket") == 0, F.lit(0.0)).otherwise(F.signum(F.col("bucket").cast("double")) * size))
    out = [
        F.min_by("_value", F.when(F.col("_upto") > F.floor(F.lit(p) * (F.col("_all") - 1)), F.col("bucket"))).alias(f"p{p * 100:g}".replace(".", "_"))
        for p in at
    ]
    return seen.groupBy(*by).agg(F.first("_all").alias("n"), *out)


def _current_cells(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "cellcoldata").select("cell_id", "sample_name", "tssenrichment", "nfrags", "loaded_at")
    return materialise(latest(rows, "cell_id", "loaded_at"), "cells")


def _by_sample(cells: DataFrame, at: list[float]) -> DataFrame:
    daily = sketch(cells.withColumn("day", F.to_date("loaded_at")), ["sample_name", "day"], ["tssenrichment", "nfrags"])
    return percentiles(merge(daily, ["sample_name"]), ["sample_name"], at)


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Cells far beyond the outer percentiles of their sample."""
    cells = _current_cells(spark, root)
    limits = _by_sample(cells, [0.05, 0.95])
    limits = limits.groupBy("sample_name").agg(
        (4 * F.max(F.when(F.col("field_name") == "nfrags", F.col("p95")))).alias("_most"),
        (F.max(F.when(F.col("field_name") == "tssenrichment", F.col("p5"))) / 4).alias("_least"),
    )
    seen = skew_join(cells, materialise(limits, "limits"), ["sample_name"])
    tss = F.when(~F.isnan("tssenrichment"), F.col("tssenrichment"))
    names = F.array(F.when(F.col("nfrags") > F.col("_most"), F.lit("nfrags")), F.when(tss < F.col("_least"), F.lit("tssenrichment")))
    return seen.select("cell_id", F.explode(F.array_compact(names)).alias("field_name"))


def p5_percentiles(spark: SparkSession, root: str) -> DataFrame:
    """Median and outer percentiles per sample, merged from sketches of single load days."""
    return _by_sample(_current_cells(spark, root), [0.01, 0.05, 0.5, 0.95, 0.99])


QUERIES = {"p5_found": p5_found, "p5_percentiles": p5_percentiles}

_CURRENT = "cur AS (SELECT DISTINCT * FROM (SELECT *, max(loaded_at) OVER (PARTITION BY cell_id) AS m FROM cellcoldata) WHERE loaded_at = m)"
_STEP = repr(math.log((1 + ACCURACY) / (1 - ACCURACY)))
_GAMMA = repr((1 + ACCURACY) / (1 - ACCURACY))

SQL = {
    "p5_found": f"""
WITH {_CURRENT},
     lim AS (SELECT sample_name, 4 * quantile_disc(nfrags, 0.95) AS most,
                    quantile_disc(CASE WHEN NOT isnan(tssenrichment) THEN tssenrichment END, 0.05) / 4 AS least FROM cur GROUP BY sample_name)
SELECT cell_id, 'nfrags' AS field_name FROM cur JOIN lim USING (sample_name) WHERE nfrags > most
UNION ALL
SELECT cell_id, 'tssenrichment' FROM cur JOIN lim USING (sample_name) WHERE NOT isnan(tssenrichment) AND tssenrichment < least""",
    "p5_percentiles": f"""
WITH {_CURRENT},
     v AS (SELECT sample_name, 'tssenrichment' AS field_name, tssenrichment AS x FROM cur UNION ALL SELECT sample_name, 'nfrags', CAST(nfrags AS DOUBLE) FROM cur),
     ok AS (SELECT * FROM v WHERE x IS NOT NULL AND NOT isnan(x)),
     r AS (SELECT *, row_number() OVER (PARTITION BY sample_name, field_name ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY sample_name, field_name) AS n FROM ok),
     e AS (SELECT *, CASE WHEN x = 0 THEN 0.0 ELSE sign(x) * pow({_GAMMA}, ceil(ln(abs(x)) / {_STEP})) * 2 / ({_GAMMA} + 1) END AS y FROM r)
SELECT sample_name, field_name, max(n) AS n, max(CASE WHEN k = floor(0.01 * (n - 1)) THEN y END) AS p1, max(CASE WHEN k = floor(0.05 * (n - 1)) THEN y END) AS p5,
       max(CASE WHEN k = floor(0.5 * (n - 1)) THEN y END) AS p50, max(CASE WHEN k = floor(0.95 * (n - 1)) THEN y END) AS p95, max(CASE WHEN k = floor(0.99 * (n - 1)) THEN y END) AS p99
FROM e GROUP BY sample_name, field_name""",
}
