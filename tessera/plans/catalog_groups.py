"""Window statistics, row statistics, groups of cells, and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import stats as S
from tessera.operators import groups as G
from tessera.operators import matrix as M
from tessera.operators import qc
from tessera.plans.registry import Registry
from tessera.sources import adapters as A
from tessera.sources.adapters import sql_with
from tessera.sources.tables import latest, table

R = Registry()
QUERIES, SQL = R.queries, R.sql


def _tiles(spark: SparkSession, root: str) -> DataFrame:
    return M.tile_matrix(qc.insertions(A.fragments(spark, root)), 500, binarize=False)


def _groups(spark: SparkSession, root: str) -> DataFrame:
    return A.cells(spark, root).select("cell", F.col("cluster").alias("group"))


_CUR = "cur AS (SELECT DISTINCT * FROM (SELECT *, max(loaded_at) OVER (PARTITION BY cell_id) AS m FROM cellcoldata) WHERE loaded_at = m)"


def _cells(spark: SparkSession, root: str) -> DataFrame:
    return latest(table(spark, root, "cellcoldata"), "cell_id", "loaded_at")


@R.query(f"""WITH {_CUR}, r AS (SELECT cell_id, rank() OVER (ORDER BY nfrags) + (count(*) OVER (PARTITION BY nfrags) - 1) / 2.0 AS r, count(*) OVER () AS n FROM cur WHERE nfrags IS NOT NULL)
SELECT cell_id, round(floor(r) / n, 9) AS quantile FROM r""")
def avg_rank_quantile(spark: SparkSession, root: str) -> DataFrame:
    """Quantile of depth by average rank."""
    rows = _cells(spark, root).where(F.col("nfrags").isNotNull()).select("cell_id", "nfrags")
    return S.rank_quantile(rows, "nfrags").select("cell_id", F.round("quantile", 9).alias("quantile"))


@R.query("""WITH d AS (SELECT DISTINCT seqnames, idx1, idx2, fdr AS p FROM coaccessibility WHERE fdr IS NOT NULL AND NOT isnan(fdr) AND idx1 < idx2),
o AS (SELECT seqnames, idx1, idx2, min(p) AS p FROM d GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY seqnames ORDER BY p) AS k, count(*) OVER (PARTITION BY seqnames) AS n FROM o)
SELECT seqnames, idx1, idx2, round(least(1.0, min(p * n / k) OVER (PARTITION BY seqnames ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 9) AS fdr FROM r""")
def bh_adjust(spark: SparkSession, root: str) -> DataFrame:
    """Benjamini-Hochberg per seqnames."""
    rows = table(spark, root, "coaccessibility").where(F.col("fdr").isNotNull() & ~F.isnan("fdr") & (F.col("idx1") < F.col("idx2")))
    p = rows.groupBy("seqnames", "idx1", "idx2").agg(F.min("fdr").alias("p"))
    return S.adjust_bh(p, "p", ["seqnames"]).select("seqnames", "idx1", "idx2", F.round("fdr", 9).alias("fdr"))


@R.query(f"""WITH {_CUR}, q AS (SELECT sample_name, quantile_cont(nfrags, 0.02) AS lo, quantile_cont(nfrags, 0.98) AS hi, max(nfrags) AS mx FROM cur GROUP BY sample_name)
SELECT cell_id, round(CAST(least(CASE WHEN hi = 0 THEN mx ELSE hi END, greatest(lo, nfrags)) AS DOUBLE), 6) AS nfrags FROM cur JOIN q USING (sample_name) WHERE nfrags IS NOT NULL""")
def winsorise(spark: SparkSession, root: str) -> DataFrame:
    """Depth clipped at outer quantiles of its sample."""
    rows = _cells(spark, root).where(F.col("nfrags").isNotNull()).select("cell_id", "sample_name", F.col("nfrags").cast("double").alias("nfrags"))
    return S.winsorise(rows, "nfrags", 0.02, 0.98, ["sample_name"]).select("cell_id", F.round("nfrags", 6).alias("nfrags"))


@R.query(sql_with("fragments", """
, n AS (SELECT chr, CAST(end_pos - start_pos + 1 AS BIGINT) AS width, count(*) AS n FROM fragments GROUP BY ALL),
m AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY chr) AS a, CASE WHEN count(*) OVER (w ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) = 11 THEN avg(n) OVER (w ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) END AS f FROM n WINDOW w AS (PARTITION BY chr ORDER BY width))
SELECT chr, width, round(coalesce(f, CASE WHEN k <= 5 THEN max(CASE WHEN k = 6 THEN f END) OVER (PARTITION BY chr) ELSE max(CASE WHEN k = a - 5 THEN f END) OVER (PARTITION BY chr) END), 6) AS smooth FROM m"""))
def rolling_mean(spark: SparkSession, root: str) -> DataFrame:
    """Fragment sizes smoothed along the width."""
    sizes = A.fragments(spark, root).groupBy("chr", qc.width().alias("width")).agg(F.count(F.lit(1)).alias("n"))
    return S.rolling_mean(sizes, "n", "width", 11, ["chr"]).select("chr", "width", F.round("smooth", 6).alias("smooth"))


@R.query(sql_with("fragments insertions tiles cells", """
, g AS (SELECT chr, tile, cluster, sum(n) AS v FROM tiles JOIN cells USING (cell) GROUP BY ALL)
SELECT chr, tile, cluster AS "group", round(greatest(-2.0, least(2.0, (v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0))), 6) AS z FROM g WINDOW w AS (PARTITION BY chr, tile)"""))
def row_zscore(spark: SparkSession, root: str) -> DataFrame:
    """Tiles of clusters as standard scores of their row, clipped at 2."""
    g = M.group_matrix(_tiles(spark, root), ["chr", "tile"], _groups(spark, root))
    return S.row_zscore(g, "value", ["chr", "tile"], 2.0).select("chr", "tile", "group", F.round("z", 6).alias("z"))


@R.query(sql_with("fragments insertions tiles cells", """
, g AS (SELECT chr, tile, cluster, sum(n) AS v FROM tiles JOIN cells USING (cell) GROUP BY ALL)
SELECT chr, tile, cluster AS "group", round(CAST((v - min(v) OVER w) AS DOUBLE) / nullif(max(v) OVER w - min(v) OVER w, 0), 6) AS scaled FROM g WINDOW w AS (PARTITION BY chr, tile)"""))
def row_scale(spark: SparkSession, root: str) -> DataFrame:
    g = M.group_matrix(_tiles(spark, root), ["chr", "tile"], _groups(spark, root))
    return S.row_scale(g, "value", ["chr", "tile"]).select("chr", "tile", "group", F.round("scaled", 6).alias("scaled"))


@R.query(sql_with("fragments insertions tiles", """
, c AS (SELECT count(DISTINCT cell) AS k FROM tiles), s AS (SELECT chr, tile, sum(n) AS s, sum(n * n) AS q, count(*) AS nz FROM tiles GROUP BY ALL)
SELECT chr, tile, CAST(s AS DOUBLE) AS total, nz AS n_nonzero, round(s / CAST(k AS DOUBLE), 9) AS mean, round((q - k * (s / CAST(k AS DOUBLE)) * (s / CAST(k AS DOUBLE))) / (k - 1), 9) AS variance FROM s, c"""))
def row_moments_with_zeros(spark: SparkSession, root: str) -> DataFrame:
    """Sum, mean and variance of tiles over all cells, zeros included."""
    t = _tiles(spark, root)
    n = t.select("cell").distinct().count()
    out = M.row_moments(t, ["chr", "tile"], n)
    return out.withColumn("mean", F.round("mean", 9)).withColumn("variance", F.round("variance", 9))


@R.query(f"""WITH {_CUR}, ok AS (SELECT * FROM cur WHERE nfrags IS NOT NULL AND clusters IS NOT NULL)
SELECT clusters, count(*) AS n, round(avg(nfrags), 4) AS mean, round(var_samp(nfrags), 2) AS variance FROM ok GROUP BY clusters HAVING count(*) > 1 AND min(sample_name) IS NOT NULL""")
def combine_variances(spark: SparkSession, root: str) -> DataFrame:
    """Mean and variance of clusters from those of their samples."""
    rows = _cells(spark, root).where(F.col("nfrags").isNotNull() & F.col("clusters").isNotNull())
    parts = rows.groupBy("clusters", "sample_name").agg(F.avg("nfrags").alias("mean"), F.coalesce(F.var_samp("nfrags"), F.lit(0.0)).alias("variance"), F.count(F.lit(1)).alias("n"))
    return M.combine_variances(parts, ["clusters"]).where("n > 1").select("clusters", "n", F.round("mean", 4).alias("mean"), F.round("variance", 2).alias("variance"))


@R.query(f"""WITH {_CUR}, s AS (SELECT nfrags AS score, sum(CAST(passqc = 1 AS INTEGER)) AS p, sum(CAST(passqc <> 1 AS INTEGER)) AS n FROM cur WHERE nfrags IS NOT NULL AND passqc IS NOT NULL GROUP BY nfrags),
r AS (SELECT score, sum(p) OVER (ORDER BY score DESC) / CAST(sum(p) OVER () AS DOUBLE) AS tpr, sum(n) OVER (ORDER BY score DESC) / CAST(sum(n) OVER () AS DOUBLE) AS fpr FROM s)
SELECT score, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr, round(sum(st) OVER (ORDER BY score DESC), 9) AS area FROM
 (SELECT *, (fpr - coalesce(lag(fpr) OVER (ORDER BY score DESC), 0)) * (tpr + coalesce(lag(tpr) OVER (ORDER BY score DESC), 0)) / 2 AS st FROM r)""")
def roc_curve(spark: SparkSession, root: str) -> DataFrame:
    """How well depth tells passing cells."""
    rows = _cells(spark, root).where(F.col("nfrags").isNotNull() & F.col("passqc").isNotNull()).select(F.col("nfrags").alias("score"), (F.col("passqc") == 1).alias("ok"))
    out = S.roc(rows, "score", "ok")
    return out.select("score", *[F.round(c, 9).alias(c) for c in ("fpr", "tpr", "area")])


@R.query("""WITH s AS (SELECT score AS v FROM peakset WHERE score IS NOT NULL), x AS (SELECT DISTINCT CAST(floor(mlog10p) AS DOUBLE) AS x FROM grouppeaks WHERE mlog10p IS NOT NULL AND NOT isnan(mlog10p) AND NOT isinf(mlog10p))
SELECT x, round((SELECT count(*) FROM s WHERE v <= x) / CAST((SELECT count(*) FROM s) AS DOUBLE), 9) AS ecdf FROM x""")
def ecdf(spark: SparkSession, root: str) -> DataFrame:
    """Share of peak scores not above given values."""
    s = table(spark, root, "peakset").where(F.col("score").isNotNull()).select("score")
    x = table(spark, root, "grouppeaks").where(F.abs("mlog10p") < float("inf")).where(~F.isnan("mlog10p")).select(F.floor("mlog10p").cast("double").alias("x")).distinct()
    return S.ecdf_at(s, "score", x, "x").select("x", F.round("ecdf", 9).alias("ecdf"))


@R.query("SELECT p_partkey AS id, CAST(ceil(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) / 7.0) AS BIGINT) AS chunk FROM part")
def chunks(spark: SparkSession, root: str) -> DataFrame:
    """Rows in chunks of seven."""
    return table(spark, root, "part").select(F.col("p_partkey").alias("id"), S.chunk_of("p_partkey", 7, ["p_brand"]).alias("chunk"))


@R.query(sql_with("fragments cells", """
, d AS (SELECT cell, count(*) AS n_frags FROM fragments GROUP BY cell),
s AS (SELECT cluster, cell, sum(n_frags) OVER (PARTITION BY cluster ORDER BY n_frags, cell ROWS UNBOUNDED PRECEDING) AS t FROM d JOIN cells USING (cell))
SELECT cluster AS "group", cell FROM s WHERE t <= 5000"""))
def fragment_cap(spark: SparkSession, root: str) -> DataFrame:
    """Cells of clusters while their fragments stay within a cap."""
    depth = A.fragments(spark, root).groupBy("cell").agg(F.count(F.lit(1)).alias("n_frags"))
    return G.cap_fragments(_groups(spark, root), depth, 5000).select("group", "cell")


@R.query(f"""WITH {_CUR} SELECT sample_name, round(quantile_cont(nfrags, 0.5), 6) AS nfrags, count(*) AS n_cells FROM cur GROUP BY sample_name""")
def group_summary(spark: SparkSession, root: str) -> DataFrame:
    """Median depth per sample."""
    rows = _cells(spark, root).select("sample_name", F.col("nfrags").cast("double").alias("nfrags"))
    return M.group_summary(rows, "sample_name", "nfrags").withColumn("nfrags", F.round("nfrags", 6))


@R.query(sql_with("fragments insertions tiles cells", """
SELECT chr, tile, cluster AS "group", CAST(sum(n) AS BIGINT) AS value FROM tiles JOIN cells USING (cell) GROUP BY ALL"""))
def group_matrix(spark: SparkSession, root: str) -> DataFrame:
    return M.group_matrix(_tiles(spark, root), ["chr", "tile"], _groups(spark, root))


@R.query(sql_with("fragments insertions tiles cells", """
, z AS (SELECT cluster, count(*) AS k FROM cells GROUP BY cluster), s AS (SELECT chr, tile, cluster, sum(n) AS s, sum(n * n) AS q, count(*) AS nz FROM tiles JOIN cells USING (cell) GROUP BY ALL)
SELECT chr, tile, cluster AS "group", round(s / CAST(k AS DOUBLE), 9) AS mean, round(sqrt(greatest(0.0, (q - k * (s / CAST(k AS DOUBLE)) * (s / CAST(k AS DOUBLE))) / (k - 1))), 6) AS sd, round(nz / CAST(k AS DOUBLE), 9) AS share FROM s JOIN z USING (cluster)"""))
def group_means(spark: SparkSession, root: str) -> DataFrame:
    """Mean, sd and share of cells per tile and cluster."""
    out = M.group_means(_tiles(spark, root), ["chr", "tile"], _groups(spark, root))
    return out.select("chr", "tile", "group", F.round("mean", 9).alias("mean"), F.round("sd", 6).alias("sd"), F.round("share", 9).alias("share"))


@R.query(sql_with("fragments insertions tiles cells", """
, z AS (SELECT cluster, count(*) AS k FROM cells GROUP BY cluster), s AS (SELECT chr, tile, cluster, sum(n) / CAST(any_value(k) AS DOUBLE) AS v FROM tiles JOIN cells USING (cell) JOIN z USING (cluster) GROUP BY ALL),
t AS (SELECT cluster, sum(v) AS t FROM s GROUP BY cluster)
SELECT chr, tile, cluster AS "group", round(v * 10000 / t, 6) AS value FROM s JOIN t USING (cluster)"""))
def group_se(spark: SparkSession, root: str) -> DataFrame:
    """Group matrix per cell, scaled to one sum."""
    return M.group_experiment(_tiles(spark, root), ["chr", "tile"], _groups(spark, root), scale=1e4).withColumn("value", F.round("value", 6))


@R.query(f"WITH {_CUR} SELECT sample_name, clusters, count(*) AS n FROM cur GROUP BY ALL")
def confusion_matrix(spark: SparkSession, root: str) -> DataFrame:
    return M.confusion(_cells(spark, root), "sample_name", "clusters")


@R.query("SELECT l_linenumber AS x, CAST(l_quantity AS INTEGER) AS y, count(*) AS n FROM lineitem WHERE l_linenumber BETWEEN 2 AND 5 AND CAST(l_quantity AS INTEGER) BETWEEN 10 AND 40 GROUP BY ALL")
def tabulate2d(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "lineitem").select(F.col("l_linenumber").alias("x"), F.col("l_quantity").cast("int").alias("y"))
    return M.tabulate2d(rows, "x", "y", (2, 5), (10, 40))


@R.query(sql_with("fragments insertions tiles", """
, s AS (SELECT chr || ':' || lpad(CAST(tile AS VARCHAR), 6, '0') AS feature, sum(n) AS total FROM tiles GROUP BY ALL),
k AS (SELECT CAST(floor(0.005 * count(*)) AS BIGINT) AS k FROM s)
SELECT feature, CAST(total AS BIGINT) AS total FROM (SELECT *, row_number() OVER (ORDER BY total DESC, feature) AS r FROM s), k WHERE r > k AND r <= k + 500"""))
def top_features(spark: SparkSession, root: str) -> DataFrame:
    """The 500 strongest tiles after the top half percent."""
    name = F.concat_ws(":", "chr", F.lpad(F.col("tile").cast("string"), 6, "0"))
    totals = _tiles(spark, root).groupBy(name.alias("feature")).agg(F.sum("value").alias("total"))
    return M.top_features(totals, "feature", "total", 500)


@R.query()
def stratified_sample(spark: SparkSession, root: str) -> DataFrame:
    """A thousand cells, each sample in proportion, by a seeded order."""
    return M.stratified_sample(_cells(spark, root).select("cell_id", "sample_name"), "sample_name", "cell_id", 1000)


@R.query(f"""WITH {_CUR}, c AS (SELECT cell_id, sample_name, CAST(nucleosomeratio AS DOUBLE) AS e, CAST(readsintss AS DOUBLE) AS s FROM cur WHERE sample_name IS NOT NULL),
q AS (SELECT sample_name, floor(20.0 * count(*) * count(*) / 100000) AS quota FROM c GROUP BY sample_name),
d AS (SELECT cell_id, sample_name, row_number() OVER (PARTITION BY sample_name ORDER BY e DESC, cell_id) AS r FROM c WHERE e >= 0.5 AND s >= 100)
SELECT cell_id FROM c WHERE cell_id NOT IN (SELECT cell_id FROM d JOIN q USING (sample_name) WHERE r <= quota)""")
def filter_doublets(spark: SparkSession, root: str) -> DataFrame:
    """Cells without the likely doublets of their sample."""
    cells = _cells(spark, root).where(F.col("sample_name").isNotNull()).select("cell_id", "sample_name", F.col("nucleosomeratio").cast("double").alias("e"), F.col("readsintss").cast("double").alias("s"))
    return qc.filter_doublets(cells, "cell_id", "sample_name", "e", "s", 0.5, 100, 20.0).select("cell_id")


@R.query(f"""WITH {_CUR}, l AS (SELECT DISTINCT clusters FROM cur WHERE clusters IS NOT NULL)
SELECT clusters, row_number() OVER (ORDER BY regexp_replace(clusters, '[0-9]+$', ''), coalesce(TRY_CAST(regexp_extract(clusters, '([0-9]+)$', 1) AS BIGINT), -1)) AS place FROM l""")
def natural_order(spark: SparkSession, root: str) -> DataFrame:
    """Labels in natural order: C2 before C10."""
    labels = _cells(spark, root).where(F.col("clusters").isNotNull()).select("clusters").distinct()
    return labels.withColumn("place", F.row_number().over(Window.orderBy(*S.natural_key("clusters"))).cast("long"))  # one row a label


@R.query("""WITH c AS (SELECT s_suppkey, 'BC' || s_suppkey AS barcode FROM supplier), b AS (SELECT 'BC' || s_suppkey AS barcode, CASE s_suppkey % 3 WHEN 0 THEN 'SNG' WHEN 1 THEN 'DBL' ELSE 'AMB' END AS k, 'd' || (s_nationkey % 5) AS d FROM supplier WHERE s_suppkey % 4 <> 0)
SELECT barcode, coalesce(k, 'NotClassified') AS demux_class, coalesce(d, 'NotClassified') AS demux_sample FROM c LEFT JOIN b USING (barcode)""")
def demux_labels(spark: SparkSession, root: str) -> DataFrame:
    """Calls joined to cells by barcode."""
    s = table(spark, root, "supplier").withColumn("barcode", F.concat(F.lit("BC"), F.col("s_suppkey")))
    kind = F.element_at(F.array(F.lit("SNG"), F.lit("DBL"), F.lit("AMB")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    calls = s.where(F.col("s_suppkey") % 4 != 0).select("barcode", F.concat_ws("-", kind, F.concat(F.lit("d"), F.col("s_nationkey") % 5)).alias("best"))
    return qc.demultiplex(s.select("barcode"), calls)


@R.query("""WITH f AS (SELECT DISTINCT seqnames FROM featuredf WHERE seqnames IS NOT NULL), p AS (SELECT DISTINCT seqnames FROM peakset WHERE seqnames IS NOT NULL)
SELECT seqnames, 'both' AS side FROM (SELECT * FROM f INTERSECT SELECT * FROM p) UNION ALL SELECT seqnames, 'features' FROM (SELECT * FROM f EXCEPT SELECT * FROM p) UNION ALL SELECT seqnames, 'peaks' FROM (SELECT * FROM p EXCEPT SELECT * FROM f)""")
def seqname_sets(spark: SparkSession, root: str) -> DataFrame:
    """Seqnames of features and peaks: intersection and both differences."""
    f, p = (table(spark, root, t).select("seqnames").where(F.col("seqnames").isNotNull()).distinct() for t in ("featuredf", "peakset"))
    side = lambda df, s: df.select("seqnames", F.lit(s).alias("side"))
    return side(f.intersect(p), "both").unionByName(side(f.subtract(p), "features")).unionByName(side(p.subtract(f), "peaks"))


@R.query(f"""WITH {_CUR} SELECT cell_id, cell, split_part(cell, '#', 1) AS sample, split_part(cell, '#', 2) AS barcode, round(log10(nfrags + 1), 9) AS depth, round(sqrt(abs(nucleosomeratio)), 9) AS root,
 CAST(nfrags >= 1000 AND passqc = 1 AS BOOLEAN) AS good FROM cur""")
def cell_expressions(spark: SparkSession, root: str) -> DataFrame:
    """Parts of cell names, and user expressions over cell columns."""
    from tessera.functions.expressions import expression, predicate

    c = _cells(spark, root)
    of = lambda t: F.round(expression(t, c.columns), 9)
    parts = F.split("cell", "#")
    return c.select("cell_id", "cell", parts[0].alias("sample"), parts[1].alias("barcode"), of("log10(nfrags + 1)").alias("depth"), of("sqrt(abs(nucleosomeratio))").alias("root"), predicate("nfrags >= 1000 & passqc == 1", c.columns).alias("good"))


@R.query()
def pseudobulk(spark: SparkSession, root: str) -> DataFrame:
    """Replicates of clusters by sample, with their cells."""
    cells = _cells(spark, root).where(F.col("clusters").startswith("C")).select(F.col("cell_id").alias("cell"), "clusters", "sample_name")
    return G.pseudobulk(cells, "clusters", "sample_name", least=20)


@R.query("""WITH d AS (SELECT doc_id, lower(coalesce(lang, 'none')) AS lang, source FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS k FROM d)
SELECT source, lang, doc_id FROM r WHERE k = 1""")
def distinct_first(spark: SparkSession, root: str) -> DataFrame:
    """The first document of every source and language."""
    d = table(spark, root, "documents").select("doc_id", F.lower(F.coalesce("lang", F.lit("none"))).alias("lang"), "source")
    return d.groupBy("source", "lang").agg(F.min("doc_id").alias("doc_id"))
