"""Interval algebra, interval joins and peak sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import groups as G
from tessera.operators import intervals as I
from tessera.operators.qc import insertions
from tessera.plans.registry import Registry
from tessera.sources import adapters as A
from tessera.sources.adapters import sql_with
from tessera.sources.tables import table, with_intervals

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.query(sql_with("genes", """
SELECT gene_id, chr, CASE WHEN strand = '-' THEN start_pos - 300 ELSE start_pos - 2000 END AS start_pos, CASE WHEN strand = '-' THEN end_pos + 2000 ELSE end_pos + 300 END AS end_pos FROM genes"""))
def extend_ranges(spark: SparkSession, root: str) -> DataFrame:
    """Genes lengthened along their strand."""
    return I.extend(A.genes(spark, root), 2000, 300).select("gene_id", "chr", "start_pos", "end_pos")


@R.query(sql_with("genes", """
SELECT gene_id, chr, CAST(start_pos + floor((end_pos - start_pos + 1 - 501) / 2) AS BIGINT) AS start_pos, CAST(start_pos + floor((end_pos - start_pos + 1 - 501) / 2) + 500 AS BIGINT) AS end_pos FROM genes"""))
def resize_center(spark: SparkSession, root: str) -> DataFrame:
    """Genes as 501 positions around their centre."""
    return I.resize(A.genes(spark, root), 501).select("gene_id", "chr", "start_pos", "end_pos")


@R.query(sql_with("genes", """
SELECT gene_id, chr, CASE WHEN strand = '-' THEN end_pos - 99 ELSE start_pos END AS start_pos, CASE WHEN strand = '-' THEN end_pos ELSE start_pos + 99 END AS end_pos FROM genes"""))
def resize_start(spark: SparkSession, root: str) -> DataFrame:
    """The first 100 positions of genes, on their strand."""
    return I.resize(A.genes(spark, root), 100, "start", "strand").select("gene_id", "chr", "start_pos", "end_pos")


@R.query(sql_with("genes", """
, e AS (SELECT gene_id, chr, start_pos - 30000 AS s, end_pos + 30000 AS e FROM genes)
SELECT gene_id, chr, greatest(1, s) AS start_pos, least(1000000, e) AS end_pos FROM e WHERE greatest(1, s) <= least(1000000, e)"""))
def trim_ranges(spark: SparkSession, root: str) -> DataFrame:
    """Extended genes clipped to their chromosome."""
    return I.trim(I.extend(A.genes(spark, root), 30000, 30000), A.chrom_sizes(spark)).select("gene_id", "chr", "start_pos", "end_pos")


@R.query(sql_with("peaks", """
, d AS (SELECT DISTINCT chr, start_pos, end_pos FROM peaks),
s AS (SELECT *, max(end_pos) OVER (PARTITION BY chr ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM d),
g AS (SELECT *, sum(CASE WHEN seen IS NULL OR start_pos > seen THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS g FROM s)
SELECT chr, min(start_pos) AS start_pos, max(end_pos) AS end_pos FROM g GROUP BY chr, g"""))
def reduce_ranges(spark: SparkSession, root: str) -> DataFrame:
    """Overlapping peaks merged; touching ones stay apart."""
    return I.reduce_ranges(A.peaks(spark, root))


@R.query("SELECT 'chr' || c AS chr, k AS tile, (k - 1) * 10000 AS start_pos FROM range(1, 6) AS a(c), range(1, 102) AS b(k)")
def tile_genome(spark: SparkSession, root: str) -> DataFrame:
    """Tiles of all chromosomes."""
    return I.tile_genome(A.chrom_sizes(spark), 10000)


@R.query(sql_with("peaks genes", """
SELECT peak_id, gene_id, CAST(greatest(0, greatest(g.start_pos - p.end_pos, p.start_pos - g.end_pos) - 1) AS BIGINT) AS distance
FROM peaks p JOIN genes g ON p.chr = g.chr AND p.start_pos <= g.end_pos AND p.end_pos >= g.start_pos"""))
def overlap_inner(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of overlapping peaks and genes."""
    hits = I.many_overlap_pairs(A.peaks(spark, root), A.genes(spark, root))
    return hits.select("a.peak_id", "b.gene_id", I.gap_distance().alias("distance"))


@R.query(sql_with("peaks blacklist", """
SELECT peak_id FROM peaks p WHERE EXISTS (SELECT 1 FROM blacklist b WHERE p.chr = b.chr AND p.start_pos <= b.end_pos AND p.end_pos >= b.start_pos)"""))
def overlap_semi(spark: SparkSession, root: str) -> DataFrame:
    return I.overlap_join(A.peaks(spark, root), A.blacklist(spark, root), "semi").select("peak_id")


@R.query(sql_with("peaks blacklist", """
SELECT peak_id FROM peaks p WHERE NOT EXISTS (SELECT 1 FROM blacklist b WHERE p.chr = b.chr AND p.start_pos <= b.end_pos AND p.end_pos >= b.start_pos)"""))
def overlap_anti(spark: SparkSession, root: str) -> DataFrame:
    return I.overlap_join(A.peaks(spark, root), A.blacklist(spark, root), "anti").select("peak_id")


@R.query(sql_with("peaks genes", """
SELECT peak_id FROM peaks p WHERE EXISTS (SELECT 1 FROM genes g WHERE p.chr = g.chr AND p.start_pos >= g.start_pos AND p.end_pos <= g.end_pos)"""))
def overlap_within(spark: SparkSession, root: str) -> DataFrame:
    """Peaks that lie inside a gene."""
    return I.overlap_join(A.peaks(spark, root), A.genes(spark, root), "semi", within=True).select("peak_id")


@R.query(sql_with("peaks genes", """
, t AS (SELECT chr, CASE WHEN strand = '-' THEN end_pos ELSE start_pos END AS pos, min(symbol) AS symbol FROM genes GROUP BY ALL),
x AS (SELECT peak_id, abs(t.pos - CAST(floor((p.start_pos + p.end_pos) / 2) AS BIGINT)) AS distance, symbol,
      row_number() OVER (PARTITION BY peak_id ORDER BY abs(t.pos - CAST(floor((p.start_pos + p.end_pos) / 2) AS BIGINT)), t.pos) AS r FROM peaks p JOIN t ON p.chr = t.chr)
SELECT peak_id, distance, symbol FROM x WHERE r = 1"""))
def nearest_tss(spark: SparkSession, root: str) -> DataFrame:
    """Distance of every peak's centre to the nearest gene start, and its gene."""
    g = A.genes(spark, root)
    starts = g.select("chr", F.when(F.col("strand") == "-", F.col("end_pos")).otherwise(F.col("start_pos")).alias("pos"), "symbol")
    near = I.nearest_point(A.peaks(spark, root), starts, "peak_id", F.floor((F.col("start_pos") + F.col("end_pos")) / 2), "symbol")
    return near.select("peak_id", "distance", "symbol")


def _exons(spark: SparkSession, root: str) -> DataFrame:
    return A.genes(spark, root).withColumn("end_pos", F.col("start_pos") + F.floor((F.col("end_pos") - F.col("start_pos")) / 3))


@R.query(sql_with("peaks genes", """
, ex AS (SELECT chr, start_pos, CAST(start_pos + floor((end_pos - start_pos) / 3) AS BIGINT) AS end_pos FROM genes),
pr AS (SELECT chr, CASE WHEN strand = '-' THEN end_pos - 100 ELSE start_pos - 2000 END AS start_pos, CASE WHEN strand = '-' THEN end_pos + 2000 ELSE start_pos + 100 END AS end_pos FROM genes),
f AS (SELECT peak_id, EXISTS (SELECT 1 FROM pr g WHERE p.chr = g.chr AND p.start_pos <= g.end_pos AND p.end_pos >= g.start_pos) AS p,
             EXISTS (SELECT 1 FROM ex g WHERE p.chr = g.chr AND p.start_pos <= g.end_pos AND p.end_pos >= g.start_pos) AS e,
             EXISTS (SELECT 1 FROM genes g WHERE p.chr = g.chr AND p.start_pos <= g.end_pos AND p.end_pos >= g.start_pos) AS g FROM peaks p)
SELECT peak_id, CASE WHEN p THEN 'Promoter' WHEN g AND e THEN 'Exonic' WHEN g THEN 'Intronic' ELSE 'Distal' END AS peak_type FROM f"""))
def peak_annotation(spark: SparkSession, root: str) -> DataFrame:
    """Type of every peak by what it overlaps."""
    return I.annotate_peaks(A.peaks(spark, root), A.genes(spark, root), _exons(spark, root)).select("peak_id", "peak_type")


@R.query()
def non_overlapping(spark: SparkSession, root: str) -> DataFrame:
    """Peaks kept by greedy choice of the best score."""
    return I.non_overlapping(A.peaks(spark, root), "score", ["peak_id"]).select("peak_id", "chr", "start_pos", "end_pos", "score")


@R.query("""
WITH p AS (SELECT DISTINCT seqnames, idx, CAST(floor((start_pos + end_pos) / 2) AS BIGINT) AS c FROM peakset WHERE start_pos IS NOT NULL AND end_pos >= start_pos)
SELECT a.seqnames AS chr, a.idx AS id1, b.idx AS id2, abs(a.c - b.c) AS distance FROM p a JOIN p b ON a.seqnames = b.seqnames AND a.idx < b.idx AND abs(a.c - b.c) <= 20000""")
def peak_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of peaks at most 20,000 positions apart."""
    p = table(spark, root, "peakset").where(F.col("end_pos") >= F.col("start_pos"))
    p = p.select(F.col("seqnames").alias("chr"), "idx", F.floor((F.col("start_pos") + F.col("end_pos")) / 2).cast("long").alias("center")).distinct()
    return I.pairs_within(p, "idx", 20000)


@R.query("""
WITH p AS (SELECT DISTINCT seqnames, idx, CAST(floor((start_pos + end_pos) / 2) AS BIGINT) AS c FROM peakset WHERE start_pos IS NOT NULL AND end_pos >= start_pos),
l AS (SELECT c.seqnames AS chr, a.c // 1000 * 1000 + 500 AS x, b.c // 1000 * 1000 + 500 AS y, correlation FROM coaccessibility c
      JOIN p a ON c.seqnames = a.seqnames AND c.idx1 = a.idx JOIN p b ON c.seqnames = b.seqnames AND c.idx2 = b.idx WHERE correlation BETWEEN 0.5 AND 1 AND NOT isnan(correlation))
SELECT chr, CAST(least(x, y) AS BIGINT) AS start_pos, CAST(greatest(x, y) AS BIGINT) AS end_pos, max(correlation) AS correlation FROM l WHERE x <> y GROUP BY ALL""")
def coaccessibility_loops(spark: SparkSession, root: str) -> DataFrame:
    """Loops between the centres of correlated peaks, on a grid of 1,000."""
    p = table(spark, root, "peakset").where(F.col("end_pos") >= F.col("start_pos"))
    p = p.select(F.col("seqnames").alias("chr"), "idx", F.floor((F.col("start_pos") + F.col("end_pos")) / 2).cast("long").alias("c")).distinct()
    links = table(spark, root, "coaccessibility").where(F.col("correlation").between(0.5, 1.0)).withColumnRenamed("seqnames", "chr")
    at = links.join(p.select("chr", F.col("idx").alias("idx1"), F.col("c").alias("pos1")), ["chr", "idx1"]).join(p.select("chr", F.col("idx").alias("idx2"), F.col("c").alias("pos2")), ["chr", "idx2"])
    return I.loops(at, 1000, "correlation")


@R.query("SELECT DISTINCT seqnames AS chr, regexp_replace(seqnames, '^chr', '') AS bare FROM featuredf WHERE seqnames LIKE 'chr%' AND seqnames NOT LIKE '%\\_%' ESCAPE '\\' AND seqnames <> 'chrM'")
def standard_chromosomes(spark: SparkSession, root: str) -> DataFrame:
    """Standard chromosomes of the features, with and without their prefix."""
    rows = table(spark, root, "featuredf").select(F.col("seqnames").alias("chr")).distinct()
    return I.standard_chromosomes(rows, ["chrM"]).select("chr", I.convert_seqnames("chr", prefix=False).alias("bare"))


@R.query("""
WITH p AS (SELECT DISTINCT seqnames AS chr, start_pos, end_pos FROM peakset WHERE seqnames IS NOT NULL AND end_pos >= start_pos)
SELECT chr, start_pos, end_pos, row_number() OVER (PARTITION BY chr ORDER BY start_pos, end_pos) AS idx FROM p""")
def peak_index(spark: SparkSession, root: str) -> DataFrame:
    """Distinct intervals of the peak set with their number on each seqnames."""
    p = table(spark, root, "peakset").where(F.col("seqnames").isNotNull() & (F.col("end_pos") >= F.col("start_pos")))
    return G.index_peaks(p.select(F.col("seqnames").alias("chr"), "start_pos", "end_pos").distinct())


@R.query(sql_with("fragments insertions cells", """
SELECT cluster AS "group", chr, pos, count(*) AS n FROM insertions JOIN cells USING (cell) GROUP BY ALL"""))
def coverage(spark: SparkSession, root: str) -> DataFrame:
    """Insertions of each cluster per position."""
    groups = A.cells(spark, root).select("cell", F.col("cluster").alias("group"))
    return G.coverage(insertions(A.fragments(spark, root)), groups)


@R.query(sql_with("fragments insertions tiles cells", """
, f AS (SELECT cluster, sum(n) AS f FROM (SELECT cell, count(*) AS n FROM fragments GROUP BY cell) JOIN cells USING (cell) GROUP BY cluster),
s AS (SELECT cluster, chr, tile, sum(n) AS s FROM tiles JOIN cells USING (cell) WHERE chr = 'chr2' AND tile BETWEEN 200 AND 1000 GROUP BY ALL)
SELECT cluster AS "group", chr, tile, round(s * 10000.0 / f, 6) AS value FROM s JOIN f USING (cluster)"""))
def browser_track(spark: SparkSession, root: str) -> DataFrame:
    """Normalised signal of each cluster over the tiles of a region."""
    from tessera.operators.matrix import tile_matrix

    f = A.fragments(spark, root)
    groups = A.cells(spark, root).select("cell", F.col("cluster").alias("group"))
    depth = f.groupBy("cell").agg(F.count(F.lit(1)).alias("factor"))
    tiles = tile_matrix(insertions(f.where(F.col("chr") == "chr2")), 500, binarize=False).where(F.col("tile").between(200, 1000))
    return G.browser_track(tiles, groups, depth).withColumn("value", F.round("value", 6))


@R.query()
def tile_peaks(spark: SparkSession, root: str) -> DataFrame:
    """Tiles with more insertions than a Poisson of the cluster's mean allows."""
    from tessera.operators.matrix import tile_matrix

    groups = A.cells(spark, root).select("cell", F.col("cluster").alias("group"))
    tiles = tile_matrix(insertions(A.fragments(spark, root)), 500, binarize=False)
    return G.union_tile_peaks(G.tile_peaks(tiles, groups, 5 * 2000)).select("group", "chr", "tile", "n", "fdr")


@R.query()
def reproducible_peaks(spark: SparkSession, root: str) -> DataFrame:
    """Peaks found in at least two of three replicates of the adapter peaks."""
    p = A.peaks(spark, root)
    shift = F.col("peak_id") % 3 * 40
    summits = p.select("chr", (F.col("start_pos") + shift).alias("start_pos"), (F.col("start_pos") + shift).alias("end_pos"), F.col("score").cast("double").alias("score"), F.concat(F.lit("r"), F.col("peak_id") % 3).alias("replicate"))
    return G.reproducible_peaks(summits, A.blacklist(spark, root), "2").select("chr", "start_pos", "end_pos", "replicate", "reproducibility")


@R.query("""
WITH x AS (SELECT DISTINCT groupreplicate AS entity, seqnames, start_pos, end_pos FROM peakset WHERE groupreplicate IS NOT NULL AND seqnames IS NOT NULL AND end_pos >= start_pos)
SELECT entity, seqnames, count(*) AS n_intervals, min(start_pos) AS first_start, max(end_pos) AS last_end FROM x GROUP BY ALL""")
def distinct_ranges(spark: SparkSession, root: str) -> DataFrame:
    """Distinct intervals of each replicate and seqnames."""
    p = table(spark, root, "peakset").where(F.col("groupreplicate").isNotNull() & F.col("seqnames").isNotNull() & (F.col("end_pos") >= F.col("start_pos")))
    p = p.select(F.col("groupreplicate").alias("entity"), "seqnames", "start_pos", "end_pos").distinct()
    return p.groupBy("entity", "seqnames").agg(F.count(F.lit(1)).alias("n_intervals"), F.min("start_pos").alias("first_start"), F.max("end_pos").alias("last_end"))


@R.query(r"""
WITH t AS (SELECT regexp_extract(peaks, p, 1) AS seqnames, TRY_CAST(replace(regexp_extract(peaks, p, 2), ',', '') AS BIGINT) AS s, TRY_CAST(replace(regexp_extract(peaks, p, 3), ',', '') AS BIGINT) AS e
 FROM (SELECT *, '^\s*(\S.*?|\S)\s*[:_-]\s*([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)\s*(?:-|_|\.\.)\s*([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)\s*$' AS p FROM grouppeaks))
SELECT seqnames, count(*) AS n, CAST(sum(e - s + 1) AS BIGINT) AS covered FROM t WHERE seqnames <> '' AND e >= s GROUP BY seqnames""")
def text_intervals(spark: SparkSession, root: str) -> DataFrame:
    """Intervals written as text, read and counted by seqnames."""
    rows = with_intervals(table(spark, root, "grouppeaks").select("peaks"), "peaks")
    return rows.groupBy("seqnames").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_pos") - F.col("start_pos") + 1).alias("covered"))
