"""Views that shape the star-schema tables as fragments, features and cells.

Only integer arithmetic is used, so any SQL engine gives the same rows.
``CTES`` holds the same views as SQL common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import table

#: Length of every chromosome of the adapter views.
CHROM_LENGTH = 1_000_000


def fragments(spark: SparkSession, root: str) -> DataFrame:
    """One sequenced fragment per line item: sample, barcode, cell, chr, start_pos, end_pos (1-based, closed)."""
    u = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729 + F.col("l_partkey") * 31) % 990000
    w = (F.col("l_orderkey") * 37 + F.col("l_linenumber") * 101 + F.col("l_suppkey") * 53) % 600
    sample, barcode = F.concat(F.lit("S"), F.col("l_suppkey") % 4), F.concat(F.lit("BC"), F.col("l_suppkey"))
    return table(spark, root, "lineitem").select(
        sample.alias("sample"),
        barcode.alias("barcode"),
        F.concat_ws("#", sample, barcode).alias("cell"),
        F.concat(F.lit("chr"), F.col("l_partkey") % 5 + 1).alias("chr"),
        (u + 1).alias("start_pos"),
        (u + 10 + w).alias("end_pos"),
    )


def genes(spark: SparkSession, root: str) -> DataFrame:
    start = (F.col("p_partkey") * 7919) % 980000
    return table(spark, root, "part").select(
        F.col("p_partkey").alias("gene_id"),
        F.concat(F.lit("G"), F.col("p_partkey")).alias("symbol"),
        F.concat(F.lit("chr"), F.col("p_partkey") % 5 + 1).alias("chr"),
        (start + 5001).alias("start_pos"),
        (start + 5000 + F.col("p_size") * 100).cast("long").alias("end_pos"),
        F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-").alias("strand"),
    )


def tss(spark: SparkSession, root: str) -> DataFrame:
    """Distinct starts of genes, on their own strand."""
    g = genes(spark, root)
    return g.select("chr", F.when(F.col("strand") == "+", F.col("start_pos")).otherwise(F.col("end_pos")).alias("pos")).distinct()


def peaks(spark: SparkSession, root: str) -> DataFrame:
    start = (F.col("o_orderkey") * 6007 + F.col("o_custkey") * 13) % 990000 + 1
    return table(spark, root, "orders").select(
        F.col("o_orderkey").alias("peak_id"),
        F.concat(F.lit("chr"), F.col("o_orderkey") % 5 + 1).alias("chr"),
        start.alias("start_pos"),
        (start + 500).alias("end_pos"),
        F.floor(F.col("o_totalprice") * 100).cast("long").alias("score"),
    )


def blacklist(spark: SparkSession, root: str) -> DataFrame:
    start = F.col("n_nationkey").cast("long") * 39000 + 1
    return table(spark, root, "nation").select(
        F.concat(F.lit("chr"), F.col("n_nationkey") % 5 + 1).alias("chr"), start.alias("start_pos"), (start + 1999).alias("end_pos")
    )


def cells(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey") % 4, F.lit("#BC"), F.col("s_suppkey")).alias("cell"),
        F.concat(F.lit("S"), F.col("s_suppkey") % 4).alias("sample"),
        F.concat(F.lit("C"), F.col("s_nationkey") % 6 + 1).alias("cluster"),
        F.col("s_acctbal").alias("depth"),
    )


def chrom_sizes(spark: SparkSession) -> DataFrame:
    return spark.range(1, 6).select(F.concat(F.lit("chr"), F.col("id")).alias("chr"), F.lit(CHROM_LENGTH).cast("long").alias("len"))


def annotation(spark: SparkSession, root: str) -> DataFrame:
    """Peaks that hold a motif: (peak_id, motif)."""
    p = peaks(spark, root).select("peak_id", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("k"))
    return p.where((F.col("peak_id") * 2654435 + F.col("k") * 40503) % 97 < 12).select("peak_id", F.concat(F.lit("M"), F.col("k")).alias("motif"))


def sequences(spark: SparkSession, root: str) -> DataFrame:
    """Letters A, C, G and T of each document."""
    text = F.regexp_replace(F.upper("text"), "[^ACGT]", "")
    return table(spark, root, "documents").where(F.col("text").isNotNull()).select("doc_id", text.alias("seq"))


CTES = {
    "fragments": """fragments AS (SELECT 'S' || (l_suppkey % 4) AS sample, 'BC' || l_suppkey AS barcode, 'S' || (l_suppkey % 4) || '#BC' || l_suppkey AS cell,
  'chr' || (l_partkey % 5 + 1) AS chr, (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 990000 + 1 AS start_pos,
  (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 990000 + 10 + (l_orderkey * 37 + l_linenumber * 101 + l_suppkey * 53) % 600 AS end_pos FROM lineitem)""",
    "insertions": "insertions AS (SELECT sample, cell, chr, start_pos AS pos FROM fragments UNION ALL SELECT sample, cell, chr, end_pos FROM fragments)",
    "genes": """genes AS (SELECT p_partkey AS gene_id, 'G' || p_partkey AS symbol, 'chr' || (p_partkey % 5 + 1) AS chr, (p_partkey * 7919) % 980000 + 5001 AS start_pos,
  (p_partkey * 7919) % 980000 + 5000 + p_size * 100 AS end_pos, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part)""",
    "tss": "tss AS (SELECT DISTINCT chr, CASE WHEN strand = '+' THEN start_pos ELSE end_pos END AS pos FROM genes)",
    "peaks": """peaks AS (SELECT o_orderkey AS peak_id, 'chr' || (o_orderkey % 5 + 1) AS chr, (o_orderkey * 6007 + o_custkey * 13) % 990000 + 1 AS start_pos,
  (o_orderkey * 6007 + o_custkey * 13) % 990000 + 501 AS end_pos, CAST(floor(o_totalprice * 100) AS BIGINT) AS score FROM orders)""",
    "blacklist": "blacklist AS (SELECT 'chr' || (n_nationkey % 5 + 1) AS chr, CAST(n_nationkey AS BIGINT) * 39000 + 1 AS start_pos, CAST(n_nationkey AS BIGINT) * 39000 + 2000 AS end_pos FROM nation)",
    "cells": "cells AS (SELECT 'S' || (s_suppkey % 4) || '#BC' || s_suppkey AS cell, 'S' || (s_suppkey % 4) AS sample, 'C' || (s_nationkey % 6 + 1) AS cluster, s_acctbal AS depth FROM supplier)",
    "annotation": "annotation AS (SELECT peak_id, 'M' || k AS motif FROM peaks, range(1, 13) AS t(k) WHERE (peak_id * 2654435 + k * 40503) % 97 < 12)",
    "sequences": "sequences AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents WHERE text IS NOT NULL)",
    "tiles": "tiles AS (SELECT chr, cell, CAST(pos // 500 + 1 AS BIGINT) AS tile, count(*) AS n FROM insertions GROUP BY ALL)",
}


def sql_with(names: str, body: str) -> str:
    """``body`` behind a WITH clause of the named views."""
    return "WITH " + ",\n".join(CTES[n] for n in names.split()) + "\n" + body
