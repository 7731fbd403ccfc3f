"""Queries of the general data problems (4 and 7), each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.periods import periods_and_gaps, slab_width
from tessera.operators.skew import salted_aggregate, salted_rank
from tessera.sources.tables import latest, table, with_intervals

#: DuckDB's spelling of :func:`with_intervals`.
INTERVAL_SQL = r"""
  SELECT *, replace(regexp_extract(peaks, p, 2), ',', '') AS s_txt, replace(regexp_extract(peaks, p, 3), ',', '') AS e_txt,
         regexp_extract(peaks, p, 1) AS seqname
  FROM (SELECT *, '^\s*(\S.*?|\S)\s*[:_-]\s*([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)\s*(?:-|_|\.\.)\s*([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)\s*$' AS p FROM grouppeaks)
"""


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Current features whose stored idx is null or not their place in their seqnames."""
    rows = table(spark, root, "featuredf").select("feature_id", "matrix_name", "seqnames", "idx", "start_pos", "loaded_at")
    current = latest(rows, "feature_id", "loaded_at").where(F.col("seqnames").isNotNull()).withColumnRenamed("idx", "stored")
    ranked = salted_rank(current, ["matrix_name", "seqnames"], "start_pos", ["feature_id"], out="idx")
    return ranked.where(~F.col("stored").eqNullSafe(F.col("idx"))).select("feature_id", "idx")


def p4_sample_totals(spark: SparkSession, root: str) -> DataFrame:
    """Figures per sample over current cells, of which three samples hold most."""
    rows = latest(table(spark, root, "cellcoldata"), "cell_id", "loaded_at")
    tss = F.when(~F.isnan("tssenrichment"), F.floor(F.col("tssenrichment") * 1000 + 0.5))
    return salted_aggregate(
        rows.select("sample_name", "cell_id", "clusters", "nfrags", tss.alias("tss_milli")),
        ["sample_name"],
        {
            "n_cells": ("count", F.col("cell_id")),
            "n_clusters": ("distinct", F.col("clusters")),
            "nfrags_sum": ("sum", F.col("nfrags")),
            "nfrags_max": ("max", F.col("nfrags")),
            "nfrags_min": ("min", F.col("nfrags")),
            "tss_milli_sum": ("sum", F.col("tss_milli")),
            "nfrags_avg": ("avg", F.col("nfrags")),
        },
    )


def p4_seqname_totals(spark: SparkSession, root: str) -> DataFrame:
    """Figures per matrix and seqnames over current features."""
    rows = latest(table(spark, root, "featuredf"), "feature_id", "loaded_at").select("matrix_name", "seqnames", "start_pos", "end_pos", "strand")
    return salted_aggregate(
        rows,
        ["matrix_name", "seqnames"],
        {
            "n_features": ("count", F.lit(1)),
            "first_start": ("min", F.col("start_pos")),
            "last_end": ("max", F.col("end_pos")),
            "n_strands": ("distinct", F.col("strand")),
        },
    )


def _intervals(spark: SparkSession, root: str) -> DataFrame:
    peaks = table(spark, root, "peakset").select(
        F.lit("peakset").alias("src"), F.col("groupreplicate").alias("entity"), "seqnames", "start_pos", "end_pos"
    )
    named = with_intervals(table(spark, root, "grouppeaks").select("grp", "peaks"), "peaks")
    named = named.select(F.lit("grouppeaks").alias("src"), F.col("grp").alias("entity"), "seqnames", "start_pos", "end_pos")
    return peaks.unionByName(named)


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Covered periods and gaps of every groupreplicate of peakset and every grp of grouppeaks."""
    rows = table(spark, root, "peakset").count() + table(spark, root, "grouppeaks").count()  # from the files' own counts
    return periods_and_gaps(_intervals(spark, root), ["src", "entity", "seqnames"], slab=slab_width(rows))


QUERIES = {"p4_found": p4_found, "p4_sample_totals": p4_sample_totals, "p4_seqname_totals": p4_seqname_totals, "p7_found": p7_found}

SQL = {
    "p4_found": """
WITH cur AS (SELECT DISTINCT feature_id, matrix_name, seqnames, idx, start_pos FROM
       (SELECT *, max(loaded_at) OVER (PARTITION BY feature_id) AS m FROM featuredf) WHERE loaded_at = m AND seqnames IS NOT NULL),
     r AS (SELECT feature_id, idx AS stored, row_number() OVER (PARTITION BY matrix_name, seqnames ORDER BY start_pos, feature_id) AS idx FROM cur)
SELECT feature_id, CAST(idx AS BIGINT) AS idx FROM r WHERE stored IS DISTINCT FROM idx""",
    "p4_sample_totals": """
WITH cur AS (SELECT DISTINCT * FROM (SELECT *, max(loaded_at) OVER (PARTITION BY cell_id) AS m FROM cellcoldata) WHERE loaded_at = m)
SELECT sample_name, count(*) AS n_cells, count(DISTINCT clusters) AS n_clusters, CAST(sum(nfrags) AS BIGINT) AS nfrags_sum,
       max(nfrags) AS nfrags_max, min(nfrags) AS nfrags_min,
       CAST(sum(CASE WHEN NOT isnan(tssenrichment) THEN CAST(floor(tssenrichment * 1000 + 0.5) AS BIGINT) END) AS BIGINT) AS tss_milli_sum,
       CAST(sum(nfrags) AS DOUBLE) / count(nfrags) AS nfrags_avg
FROM cur GROUP BY sample_name""",
    "p4_seqname_totals": """
WITH cur AS (SELECT DISTINCT * FROM (SELECT *, max(loaded_at) OVER (PARTITION BY feature_id) AS m FROM featuredf) WHERE loaded_at = m)
SELECT matrix_name, seqnames, count(*) AS n_features, min(start_pos) AS first_start, max(end_pos) AS last_end, count(DISTINCT strand) AS n_strands
FROM cur GROUP BY matrix_name, seqnames""",
    "p7_found": f"""
WITH named AS ({INTERVAL_SQL}),
     rows AS (
       SELECT 'peakset' AS src, groupreplicate AS entity, seqnames, start_pos AS s, end_pos AS e FROM peakset
       UNION ALL
       SELECT 'grouppeaks', grp, seqname, TRY_CAST(s_txt AS BIGINT), TRY_CAST(e_txt AS BIGINT) FROM named WHERE seqname <> ''),
     ok AS (SELECT DISTINCT * FROM rows WHERE entity IS NOT NULL AND seqnames IS NOT NULL AND e >= s),
     seen AS (SELECT *, max(e) OVER (PARTITION BY src, entity, seqnames ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ok),
     isl AS (SELECT *, sum(CASE WHEN seen IS NULL OR s > seen + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY src, entity, seqnames ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM seen),
     per AS (SELECT src, entity, seqnames, g, min(s) AS start_pos, max(e) AS end_pos FROM isl GROUP BY src, entity, seqnames, g),
     nxt AS (SELECT *, lead(start_pos) OVER (PARTITION BY src, entity, seqnames ORDER BY g) AS n FROM per)
SELECT src, entity, seqnames, 'period' AS kind, start_pos, end_pos FROM per
UNION ALL
SELECT src, entity, seqnames, 'gap', end_pos + 1, n - 1 FROM nxt WHERE n IS NOT NULL""",
}
