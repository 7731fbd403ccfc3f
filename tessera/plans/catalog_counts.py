"""Fragments, quality control and count matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import matrix as M
from tessera.operators import qc
from tessera.operators.intervals import extend, overlap_join
from tessera.plans.registry import Registry
from tessera.sources import adapters as A
from tessera.sources.adapters import sql_with
from tessera.sources.files import fragments_from_alignments, reformat_fragments
from tessera.sources.tables import table

R = Registry()
QUERIES, SQL = R.queries, R.sql

_CLASS = "least(CAST(floor((end_pos - start_pos + 1) / 147) AS BIGINT) + 1, 3)"


def _points(spark: SparkSession, root: str) -> DataFrame:
    return qc.insertions(A.fragments(spark, root))


def _promoters(spark: SparkSession, root: str) -> DataFrame:
    g = A.genes(spark, root)
    at = F.when(F.col("strand") == "-", F.col("end_pos")).otherwise(F.col("start_pos"))
    starts = g.select("gene_id", "chr", "strand", at.alias("start_pos"), at.alias("end_pos"))
    return extend(starts, 2000, 100)


_PROMOTERS = """promoters AS (SELECT gene_id, chr, CASE WHEN strand = '-' THEN end_pos - 100 ELSE start_pos - 2000 END AS start_pos,
  CASE WHEN strand = '-' THEN end_pos + 2000 ELSE start_pos + 100 END AS end_pos FROM genes)"""


@R.query(sql_with("fragments", f"""
SELECT cell, count(*) AS n_frags, count(*) FILTER (WHERE {_CLASS} = 1) AS n_mono, count(*) FILTER (WHERE {_CLASS} = 2) AS n_di,
       count(*) FILTER (WHERE {_CLASS} = 3) AS n_multi,
       count(*) FILTER (WHERE {_CLASS} > 1) / CAST(nullif(count(*) FILTER (WHERE {_CLASS} = 1), 0) AS DOUBLE) AS nucleosome_ratio
FROM fragments GROUP BY cell"""))
def frag_info(spark: SparkSession, root: str) -> DataFrame:
    """Fragments per cell by nucleosome class."""
    return qc.fragment_info(A.fragments(spark, root))


@R.query(sql_with("fragments", """
SELECT sample, width, n, round(n * 100.0 / sum(n) OVER (PARTITION BY sample), 6) AS percent
FROM (SELECT sample, end_pos - start_pos + 1 AS width, count(*) AS n FROM fragments GROUP BY ALL) WHERE width <= 1000"""))
def frag_size_hist(spark: SparkSession, root: str) -> DataFrame:
    """Fragment sizes per sample."""
    return qc.fragment_sizes(A.fragments(spark, root), ["sample"]).withColumn("percent", F.round("percent", 6))


@R.query(sql_with("fragments", """
, c AS (SELECT cell, count(*) AS n FROM fragments GROUP BY cell)
SELECT cell, count(*) AS n_kept FROM fragments WHERE cell IN (SELECT cell FROM c WHERE n BETWEEN 300 AND 100000)
AND end_pos - start_pos + 1 BETWEEN 50 AND 500 GROUP BY cell"""))
def barcode_depth_filter(spark: SparkSession, root: str) -> DataFrame:
    """Fragments kept per cell; depth is counted before sizes are filtered."""
    return qc.depth_filter(A.fragments(spark, root), 300, 100_000, 50, 500).groupBy("cell").agg(F.count(F.lit(1)).alias("n_kept"))


@R.query(sql_with("fragments insertions", """
SELECT chr, CAST(pos // 500 + 1 AS BIGINT) AS tile, cell, CAST(1 AS BIGINT) AS value FROM insertions WHERE pos BETWEEN 1 AND 1000000 GROUP BY ALL"""))
def tile_matrix(spark: SparkSession, root: str) -> DataFrame:
    return M.tile_matrix(_points(spark, root), 500, sizes=A.chrom_sizes(spark))


@R.query(sql_with("fragments insertions blacklist tiles", """
SELECT chr, tile, cell, n AS value FROM tiles t WHERE NOT EXISTS (
  SELECT 1 FROM blacklist b WHERE b.chr = t.chr AND t.tile BETWEEN b.start_pos // 500 + 1 AND b.end_pos // 500 + 1)"""))
def tile_matrix_blacklist(spark: SparkSession, root: str) -> DataFrame:
    """Tile counts without tiles that touch the blacklist."""
    return M.tile_matrix(_points(spark, root), 500, binarize=False, blacklist=A.blacklist(spark, root))


@R.query(sql_with("fragments insertions genes tss", """
, r AS (SELECT chr, 'w' AS kind, pos - 50 AS s, pos + 50 AS e FROM tss UNION ALL SELECT chr, 'f', pos - 2000, pos - 1901 FROM tss UNION ALL SELECT chr, 'f', pos + 1901, pos + 2000 FROM tss),
h AS (SELECT cell, count(*) FILTER (WHERE kind = 'w') AS n_window, count(*) FILTER (WHERE kind = 'f') AS n_flank
      FROM insertions i JOIN r ON i.chr = r.chr AND i.pos BETWEEN r.s AND r.e GROUP BY cell),
c AS (SELECT DISTINCT cell FROM insertions)
SELECT cell, coalesce(n_window, 0) AS n_window, coalesce(n_flank, 0) AS n_flank,
       round(2 * (coalesce(n_window, 0) / 101.0::DOUBLE) / greatest(coalesce(n_flank, 0) / 100.0::DOUBLE, 0.2), 3) AS tss_enrichment FROM c LEFT JOIN h USING (cell)"""))
def tss_enrichment(spark: SparkSession, root: str) -> DataFrame:
    """Enrichment of insertions at gene starts per cell."""
    return qc.tss_enrichment(_points(spark, root), A.tss(spark, root))


@R.query(sql_with("fragments insertions genes", """
, t AS (SELECT DISTINCT chr, CASE WHEN strand = '-' THEN end_pos ELSE start_pos END AS tss, strand FROM genes),
h AS (SELECT sample, (i.pos - t.tss) * CASE WHEN strand = '-' THEN -1 ELSE 1 END AS "offset", count(*) AS n
      FROM insertions i JOIN t ON i.chr = t.chr AND i.pos BETWEEN t.tss - 2000 AND t.tss + 2000 GROUP BY ALL)
SELECT sample, "offset", n, round(n / nullif(sum(CASE WHEN abs("offset") > 1900 THEN n END) OVER (PARTITION BY sample) / 200.0, 0), 6) AS enrichment FROM h"""))
def tss_profile(spark: SparkSession, root: str) -> DataFrame:
    """Insertions around gene starts by sample and offset."""
    g = A.genes(spark, root)
    starts = g.select("chr", F.when(F.col("strand") == "-", F.col("end_pos")).otherwise(F.col("start_pos")).alias("pos"), "strand").distinct()
    return qc.tss_profile(_points(spark, root), starts, "sample").withColumn("enrichment", F.round("enrichment", 6))


@R.query(sql_with("fragments insertions genes", f"""
, {_PROMOTERS}, h AS (SELECT cell, count(*) AS n FROM insertions i JOIN promoters p ON i.chr = p.chr AND i.pos BETWEEN p.start_pos AND p.end_pos GROUP BY cell),
a AS (SELECT cell, count(*) AS n_all FROM insertions GROUP BY cell)
SELECT cell, coalesce(n, 0) AS n_promoter, round(coalesce(n, 0) / CAST(n_all AS DOUBLE), 9) AS promoter_ratio FROM a LEFT JOIN h USING (cell)"""))
def feature_counts(spark: SparkSession, root: str) -> DataFrame:
    """Insertions in promoters per cell."""
    return qc.feature_counts(_points(spark, root), _promoters(spark, root), "promoter").withColumn("promoter_ratio", F.round("promoter_ratio", 9))


@R.query(sql_with("fragments insertions peaks", """
SELECT peak_id, cell, CAST(least(count(*), 4) AS BIGINT) AS value FROM insertions i JOIN peaks p ON i.chr = p.chr AND i.pos BETWEEN p.start_pos AND p.end_pos GROUP BY ALL"""))
def feature_matrix_ceiling(spark: SparkSession, root: str) -> DataFrame:
    """Peak counts with a ceiling of 4."""
    return M.feature_matrix(_points(spark, root), A.peaks(spark, root), "peak_id")


@R.query(sql_with("fragments insertions peaks", """
, h AS (SELECT cell, count(*) AS n FROM insertions i JOIN peaks p ON i.chr = p.chr AND i.pos BETWEEN p.start_pos AND p.end_pos GROUP BY cell),
a AS (SELECT cell, count(*) AS n_all FROM insertions WHERE chr IN (SELECT chr FROM peaks) GROUP BY cell)
SELECT cell, coalesce(n, 0) AS reads_in_peaks, round(coalesce(n, 0) / CAST(n_all AS DOUBLE), 9) AS frip FROM a LEFT JOIN h USING (cell)"""))
def frip(spark: SparkSession, root: str) -> DataFrame:
    """Share of insertions in peaks, before the ceiling."""
    return M.reads_in_peaks(_points(spark, root), A.peaks(spark, root)).withColumn("frip", F.round("frip", 9))


@R.query(sql_with("fragments insertions genes tss", """
, r AS (SELECT chr, 'w' AS kind, pos - 50 AS s, pos + 50 AS e FROM tss UNION ALL SELECT chr, 'f', pos - 2000, pos - 1901 FROM tss UNION ALL SELECT chr, 'f', pos + 1901, pos + 2000 FROM tss),
h AS (SELECT cell, count(*) FILTER (WHERE kind = 'w') AS w, count(*) FILTER (WHERE kind = 'f') AS f
      FROM insertions i JOIN r ON i.chr = r.chr AND i.pos BETWEEN r.s AND r.e GROUP BY cell),
c AS (SELECT cell, count(*) AS n_frags FROM fragments GROUP BY cell)
SELECT cell, n_frags, round(2 * (coalesce(w, 0) / 101.0::DOUBLE) / greatest(coalesce(f, 0) / 100.0::DOUBLE, 0.2), 3) AS tss_enrichment,
       CAST(n_frags >= 500 AND round(2 * (coalesce(w, 0) / 101.0::DOUBLE) / greatest(coalesce(f, 0) / 100.0::DOUBLE, 0.2), 3) >= 0.9 AS INTEGER) AS keep FROM c LEFT JOIN h USING (cell)"""))
def qc_filter(spark: SparkSession, root: str) -> DataFrame:
    """Depth and enrichment per cell and whether the cell passes both."""
    f = A.fragments(spark, root)
    both = qc.fragment_info(f).select("cell", "n_frags").join(qc.tss_enrichment(qc.insertions(f), A.tss(spark, root)).select("cell", "tss_enrichment"), "cell")
    return qc.keep_cells(both, 500, 0.9)


@R.query(sql_with("fragments blacklist", """
SELECT cell, chr, start_pos, end_pos FROM fragments f WHERE chr IN ('chr1', 'chr3') AND EXISTS (
  SELECT 1 FROM blacklist b WHERE b.chr = f.chr AND f.start_pos <= b.end_pos AND f.end_pos >= b.start_pos)"""))
def fragments_in_regions(spark: SparkSession, root: str) -> DataFrame:
    """Fragments of two chromosomes that overlap given regions."""
    f = A.fragments(spark, root).where(F.col("chr").isin("chr1", "chr3"))
    return overlap_join(f, A.blacklist(spark, root), "semi").select("cell", "chr", "start_pos", "end_pos")


@R.query("""
SELECT 'S' AS sample, 'chr' || (l_partkey % 5 + 1) AS chr, l_orderkey % 900000 + 4 AS start_pos, l_orderkey % 900000 + l_suppkey % 500 - 6 AS end_pos,
       'BC' || l_suppkey AS barcode, 'S#BC' || l_suppkey AS cell
FROM lineitem WHERE (l_linenumber % 2 = 0) AND l_suppkey % 500 - 10 >= 10""")
def alignment_fragments(spark: SparkSession, root: str) -> DataFrame:
    """Fragments from decoded alignments: properly paired, plus strand, shifted ends, not too short."""
    rows = table(spark, root, "lineitem").select(
        F.concat(F.lit("chr"), F.col("l_partkey") % 5 + 1).alias("chr"),
        (F.col("l_orderkey") % 900000).alias("pos"),
        (F.col("l_suppkey") % 500 + 0).alias("isize"),
        F.when(F.col("l_linenumber") % 2 == 0, 3).otherwise(19).alias("flag"),
        F.concat(F.lit("BC"), F.col("l_suppkey")).alias("barcode"),
    )
    return fragments_from_alignments(rows, "S")


@R.query(sql_with("fragments", "SELECT sample, chr, start_pos, end_pos, replace(replace(barcode || ' #1', ' ', '.'), '#', '.') AS barcode, cell FROM fragments"))
def reformatted_fragments(spark: SparkSession, root: str) -> DataFrame:
    """Fragments in order, with clean barcodes."""
    return reformat_fragments(A.fragments(spark, root).withColumn("barcode", F.concat("barcode", F.lit(" #1"))))


@R.query(sql_with("fragments insertions tiles", """
, s AS (SELECT cell, sum(n) AS t FROM tiles GROUP BY cell)
SELECT chr, tile, cell, round(n * 10000.0 / t, 6) AS norm FROM tiles JOIN s USING (cell)"""))
def col_normalise(spark: SparkSession, root: str) -> DataFrame:
    """Tile counts in shares of the cell's sum."""
    from tessera.functions.stats import normalise_columns

    m = M.tile_matrix(_points(spark, root), 500, binarize=False)
    return normalise_columns(m, "value", ["cell"]).select("chr", "tile", "cell", F.round("norm", 6).alias("norm"))


_WINDOWS = """, b AS (SELECT *, CASE WHEN strand = '-' THEN start_pos ELSE start_pos - 5000 END AS body_start, CASE WHEN strand = '-' THEN end_pos + 5000 ELSE end_pos END AS body_end,
    CASE WHEN strand = '-' THEN end_pos ELSE start_pos END AS tss FROM genes),
m AS (SELECT *, 1.0::DOUBLE / (body_end - body_start + 1) AS m FROM b),
w0 AS (SELECT *, 1 + m * 4.0 / nullif(max(m) OVER () - min(m) OVER (), 0) AS weight,
   lag(end_pos) OVER (PARTITION BY chr ORDER BY start_pos, end_pos, gene_id) + 1 AS lo, lead(start_pos) OVER (PARTITION BY chr ORDER BY start_pos, end_pos, gene_id) - 1 AS hi FROM m),
w AS (SELECT gene_id, chr, strand, tss, body_start, body_end, weight,
   greatest(1, least(greatest(body_start - 100000, coalesce(lo, body_start - 100000)), body_start - 1000)) AS ws,
   greatest(least(body_end + 100000, coalesce(hi, body_end + 100000)), body_end + 1000) AS we FROM w0)"""


@R.query(sql_with("genes", _WINDOWS + """
SELECT gene_id, CAST(ws AS BIGINT) AS window_start, CAST(we AS BIGINT) AS window_end, round(weight, 9) AS weight FROM w"""))
def gene_windows(spark: SparkSession, root: str) -> DataFrame:
    """Window and weight of every gene, bounded by its neighbours."""
    return M.gene_windows(A.genes(spark, root)).select("gene_id", "window_start", "window_end", F.round("weight", 9).alias("weight"))


@R.query(sql_with("fragments insertions genes", _WINDOWS + """
, t AS (SELECT chr, cell, CAST(pos // 500 * 500 AS BIGINT) AS s, least(count(*), 4) AS n FROM insertions GROUP BY ALL),
p AS (SELECT DISTINCT chr, s FROM t),
x AS (SELECT gene_id, p.chr, s, weight, greatest(0, greatest(s - body_end, body_start - (s + 499)) - 1) AS gap FROM w JOIN p ON w.chr = p.chr AND p.s <= w.we AND p.s + 499 >= w.ws),
g AS (SELECT gene_id, cell, sum((exp(-gap / 5000.0) + exp(-1.0)) * weight * n) AS v FROM x JOIN t USING (chr, s) GROUP BY ALL),
z AS (SELECT cell, sum(v) AS t FROM g GROUP BY cell)
SELECT cell, count(*) AS n_genes, round(sum(v * 10000.0 / t), 3) AS total FROM g JOIN z USING (cell) WHERE round(v * 10000.0 / t, 3) > 0 GROUP BY cell"""))
def gene_score(spark: SparkSession, root: str) -> DataFrame:
    """Gene activity per cell: genes with signal and the sum of their scores."""
    scores = M.gene_score_totals(_points(spark, root), M.gene_windows(A.genes(spark, root)))
    return scores.select("cell", "n_genes", F.round("total", 3).alias("total"))


_COUNTS = """c AS (SELECT CASE WHEN l_partkey % 50 = 0 THEN 'MT-' WHEN l_partkey % 30 = 0 THEN 'RPL' ELSE 'G' END || (l_partkey % 400) AS gene,
   'S' || (l_suppkey % 4) || '#BC' || l_suppkey AS cell, l_partkey AS feature_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS value FROM lineitem GROUP BY ALL)"""


def _expression(spark: SparkSession, root: str) -> DataFrame:
    k = F.col("l_partkey")
    gene = F.concat(F.when(k % 50 == 0, "MT-").when(k % 30 == 0, "RPL").otherwise("G"), k % 400)
    cell = F.concat(F.lit("S"), F.col("l_suppkey") % 4, F.lit("#BC"), F.col("l_suppkey"))
    rows = table(spark, root, "lineitem").select(gene.alias("gene"), cell.alias("cell"), k.alias("feature_id"), F.col("l_quantity").cast("long").alias("value"))
    return rows.groupBy("gene", "cell", "feature_id").agg(F.sum("value").alias("value"))


@R.query(f"""WITH {_COUNTS}
SELECT cell, CAST(sum(value) AS BIGINT) AS n_umi, count(*) FILTER (WHERE value > 0) AS n_genes, round(coalesce(sum(value) FILTER (WHERE gene LIKE 'MT%'), 0) / CAST(sum(value) AS DOUBLE), 9) AS mito_ratio,
  round(coalesce(sum(value) FILTER (WHERE gene LIKE 'RP%'), 0) / CAST(sum(value) AS DOUBLE), 9) AS ribo_ratio FROM c GROUP BY cell""")
def gex_qc(spark: SparkSession, root: str) -> DataFrame:
    """Molecules, genes and ratios of a paired expression matrix."""
    out = qc.gene_expression_qc(_expression(spark, root))
    return out.withColumn("mito_ratio", F.round("mito_ratio", 9)).withColumn("ribo_ratio", F.round("ribo_ratio", 9))


@R.query(f"""WITH {_COUNTS}, s AS (SELECT gene, feature_id, sum(value) AS t FROM c GROUP BY ALL),
b AS (SELECT feature_id FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY t DESC, feature_id) AS r FROM s) WHERE r = 1)
SELECT gene, feature_id, cell, value FROM c WHERE feature_id IN (SELECT feature_id FROM b)""")
def unique_genes(spark: SparkSession, root: str) -> DataFrame:
    """Entries of the strongest feature of each gene name."""
    return M.unique_genes(_expression(spark, root)).select("gene", "feature_id", "cell", "value")


@R.query("""WITH p AS (SELECT l_suppkey % 4 AS part, 'G' || (l_partkey % 700) AS gene, l_suppkey AS cell, count(*) AS value FROM lineitem WHERE l_orderkey % 10 < l_suppkey % 4 + 3 GROUP BY ALL),
g AS (SELECT gene FROM p GROUP BY gene HAVING count(DISTINCT part) = 4) SELECT part, gene, cell, value FROM p WHERE gene IN (SELECT gene FROM g)""")
def merge_matrices(spark: SparkSession, root: str) -> DataFrame:
    """Several matrices as one, with the genes all of them have."""
    rows = table(spark, root, "lineitem").where(F.col("l_orderkey") % 10 < F.col("l_suppkey") % 4 + 3)
    parts = rows.groupBy((F.col("l_suppkey") % 4).alias("part"), F.concat(F.lit("G"), F.col("l_partkey") % 700).alias("gene"), F.col("l_suppkey").alias("cell")).agg(F.count(F.lit(1)).alias("value"))
    return M.merge_matrices(parts, 4).select("part", "gene", "cell", "value")


@R.query("SELECT CAST(l_linenumber AS BIGINT) AS \"row\", l_orderkey AS \"column\", l_quantity AS value FROM lineitem")
def csc_to_coordinates(spark: SparkSession, root: str) -> DataFrame:
    """Compressed columns, one block of arrays per order, back as coordinates."""
    rows = table(spark, root, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("e"))  # an order has few lines
    blocks = rows.select("l_orderkey", F.array(F.lit(0), F.size("e")).alias("indptr"), F.col("e.l_linenumber").alias("indices"), F.col("e.l_quantity").alias("data"))
    return M.coordinates(blocks, keep=["l_orderkey"]).select(F.col("row").cast("long").alias("row"), F.col("l_orderkey").alias("column"), "value")
