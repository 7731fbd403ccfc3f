"""Ingest, project tables, clusters and further matrix statistics."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import ingest
from tessera.operators import clustering as C
from tessera.operators import displays as D
from tessera.operators import graph as N
from tessera.operators import groups as G
from tessera.operators import links as L
from tessera.operators import lsi
from tessera.operators import matrix as M
from tessera.operators import motifs as X
from tessera.operators import qc
from tessera.operators.intervals import annotate_peaks
from tessera.plans.catalog_models import _TF, _centers, _groups, _tf
from tessera.plans.registry import Registry
from tessera.project import Project
from tessera.session import scratch_root
from tessera.sources import adapters as A
from tessera.sources.adapters import sql_with
from tessera.sources.tables import latest, table

R = Registry()
QUERIES, SQL = R.queries, R.sql


def _genome(spark: SparkSession, root: str) -> ingest.Genome:
    return ingest.Genome(A.chrom_sizes(spark), A.genes(spark, root), A.blacklist(spark, root))


_QUALITY = """, c AS (SELECT cell, count(*) AS n_frags FROM fragments GROUP BY cell HAVING count(*) BETWEEN 100 AND 1000000),
f AS (SELECT * FROM fragments WHERE cell IN (SELECT cell FROM c) AND end_pos - start_pos + 1 BETWEEN 10 AND 500),
i AS (SELECT cell, chr, start_pos AS pos FROM f UNION ALL SELECT cell, chr, end_pos FROM f),
n AS (SELECT cell, count(*) AS n_frags FROM f GROUP BY cell),
r AS (SELECT chr, 'w' AS kind, pos - 50 AS s, pos + 50 AS e FROM tss UNION ALL SELECT chr, 'f', pos - 2000, pos - 1901 FROM tss UNION ALL SELECT chr, 'f', pos + 1901, pos + 2000 FROM tss),
h AS (SELECT cell, count(*) FILTER (WHERE kind = 'w') AS w, count(*) FILTER (WHERE kind = 'f') AS k FROM i JOIN r ON i.chr = r.chr AND i.pos BETWEEN r.s AND r.e GROUP BY cell),
b AS (SELECT cell, count(*) AS n_blacklist FROM i JOIN blacklist x ON i.chr = x.chr AND i.pos BETWEEN x.start_pos AND x.end_pos GROUP BY cell),
q AS (SELECT cell, n_frags, round(2 * (coalesce(w, 0) / 101.0::DOUBLE) / greatest(coalesce(k, 0) / 100.0::DOUBLE, 0.2), 3) AS tss_enrichment, coalesce(n_blacklist, 0) AS n_blacklist
      FROM n LEFT JOIN h USING (cell) LEFT JOIN b USING (cell))
"""


def _project(spark: SparkSession, root: str) -> Project:
    """The test fragments as one project per run below the scratch folder; sample names come with the fragments."""
    rows = A.fragments(spark, root)
    samples = {s: rows.where(F.col("sample") == s) for s in ("S0", "S1", "S2", "S3")}
    return ingest.create_project(spark, f"{scratch_root(spark)}/projects/{uuid.uuid4().hex}", samples, _genome(spark, root), None, 100, 1_000_000, 0.4, 10, 500)


@R.query(sql_with("fragments insertions genes tss blacklist", _QUALITY + "SELECT cell, n_frags, tss_enrichment, n_blacklist FROM q WHERE n_frags >= 100 AND tss_enrichment >= 0.4"))
def ingest_cells(spark: SparkSession, root: str) -> DataFrame:
    """Fragments to a saved project in one call; the cells that it keeps."""
    return _project(spark, root).cells.select("cell", "n_frags", "tss_enrichment", "n_blacklist")


@R.query(sql_with("fragments insertions genes tss blacklist", _QUALITY + """
, kept AS (SELECT cell FROM q WHERE n_frags >= 100 AND tss_enrichment >= 0.4),
t AS (SELECT chr, CAST(pos // 500 + 1 AS BIGINT) AS feature, cell FROM i WHERE cell IN (SELECT cell FROM kept) AND pos BETWEEN 1 AND 1000000 GROUP BY ALL),
m AS (SELECT * FROM t WHERE chr = 'chr2' AND NOT EXISTS (SELECT 1 FROM blacklist b WHERE b.chr = t.chr AND t.feature BETWEEN b.start_pos // 500 + 1 AND b.end_pos // 500 + 1))
SELECT chr, feature, count(*) AS n_cells FROM m GROUP BY chr, feature"""))
def stored_matrix(spark: SparkSession, root: str) -> DataFrame:
    """Entries of one chromosome of a stored matrix, read with push-down."""
    return _project(spark, root).matrix("tiles", chroms=["chr2"]).groupBy("chr", "feature").agg(F.count(F.lit(1)).alias("n_cells"))


@R.query("""WITH cur AS (SELECT DISTINCT sample_name FROM (SELECT *, max(loaded_at) OVER (PARTITION BY cell_id) AS m FROM cellcoldata) WHERE loaded_at = m AND sample_name IS NOT NULL)
SELECT c.sample_name AS sample, s.kit FROM cur c LEFT JOIN samplecoldata s ON s.sample_name = c.sample_name""")
def sample_table(spark: SparkSession, root: str) -> DataFrame:
    """The sample table of a project."""
    rows = latest(table(spark, root, "cellcoldata").select("cell_id", "cell", "sample_name", "loaded_at"), "cell_id", "loaded_at").where(F.col("sample_name").isNotNull())
    project = Project(spark, "", rows.select("cell", F.col("sample_name").alias("sample")))
    kits = table(spark, root, "samplecoldata").select(F.col("sample_name").alias("sample"), "kit")
    return project.add_sample_column(kits.join(project.samples(), "sample", "left_semi"), "kit").sample_column("kit")


@R.query(sql_with("fragments insertions cells", _TF + """, n AS (SELECT count(*) AS n FROM cells), l AS (SELECT feature, sum(log2(value + 1)) AS s, sum(log2(value + 1) * log2(value + 1)) AS q FROM t GROUP BY feature),
m AS (SELECT feature, s / n AS mean, (q - s * s / n) / (n - 1) AS v FROM l, n)
SELECT feature, round(mean, 8) AS mean, round(pow(2, mean) - 1, 8) AS geometric_mean, round(exp(sqrt(greatest(0, v * ln(2) * ln(2)))), 8) AS geometric_sd FROM m"""))
def row_logs(spark: SparkSession, root: str) -> DataFrame:
    """Means of logarithms and geometric moments of features, zeros included."""
    out = M.row_logs(_tf(spark, root), ["feature"], A.cells(spark, root).count())
    return out.select("feature", *[F.round(c, 8).alias(c) for c in ("mean", "geometric_mean", "geometric_sd")])


@R.query(sql_with("fragments insertions cells", _TF + """, n AS (SELECT count(*) AS n FROM cells), s AS (SELECT feature, sqrt(sum(value * value) / any_value(n - 1.0::DOUBLE)) AS r FROM t, n GROUP BY feature)
SELECT feature, cell, round(value / r, 8) AS scaled FROM t JOIN s USING (feature)"""))
def scaled_rows(spark: SparkSession, root: str) -> DataFrame:
    """Entries over the root mean square of their row."""
    out = M.scale_rows(_tf(spark, root), ["feature"], A.cells(spark, root).count())
    return out.select("feature", "cell", F.round("scaled", 8).alias("scaled"))


@R.query("""WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
d AS (SELECT a.vec_id AS query, b.vec_id AS nid, b.label, list_distance(a.v, b.v) AS d FROM q a JOIN q b ON b.vec_id % 20 <> 0 WHERE a.vec_id % 20 = 0),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, nid) AS r FROM d) WHERE r <= 15),
v AS (SELECT query, label, count(*) AS votes FROM k GROUP BY ALL)
SELECT query, label, votes / 15.0::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY votes DESC, label) AS r FROM v) WHERE r = 1""")
def label_transfer(spark: SparkSession, root: str) -> DataFrame:
    """Labels of one set of vectors for those of another."""
    e = table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    reference = e.where(F.col("id") % 20 != 0)
    return C.transfer_labels(reference.select("id", "v"), e.where(F.col("id") % 20 == 0).select("id", "v"), reference.select("id", "label"), 15)


@R.query()
def modularity_clusters(spark: SparkSession, root: str) -> DataFrame:
    """Communities of the neighbour graph by modularity."""
    e = table(spark, root, "embeddings")
    near = N.exact_neighbours(e, e, "vec_id", "embedding", 10)
    return C.modularity_clusters(N.shared_neighbours(near), 0.8)


@R.query()
def biased_clusters(spark: SparkSession, root: str) -> DataFrame:
    """Small clusters that only follow depth."""
    rows = latest(table(spark, root, "cellcoldata").select("cell_id", "clusters", "nfrags", "loaded_at"), "cell_id", "loaded_at").where(F.col("nfrags").isNotNull() & F.col("clusters").isNotNull())
    return C.biased_clusters(rows.select(F.col("cell_id").alias("id"), F.col("clusters").alias("group")), rows.select(F.col("cell_id").alias("id"), F.col("nfrags").alias("value")), share=0.2)


@R.query()
def lsi_model(spark: SparkSession, root: str) -> DataFrame:
    """Vectors of all cells by an index fitted on cells of common depth, without dimensions that follow depth."""
    return lsi.fit_lsi(_tf(spark, root), 8).vectors(0.75)


@R.query()
def coaccessibility_of_cells(spark: SparkSession, root: str) -> DataFrame:
    """Correlation of near peaks over aggregates of cells that lie near each other."""
    vectors = lsi.fit_lsi(_tf(spark, root), 5, outliers=None).scores
    return L.peak_correlations_of_cells(qc.insertions(A.fragments(spark, root)), vectors, A.peaks(spark, root), 5, 60, 0.8, distance=3000, also=[])


@R.query(sql_with("peaks genes", """
, c AS (SELECT peak_id, chr, start_pos, end_pos FROM peaks), t AS (SELECT chr, CASE WHEN strand = '-' THEN end_pos ELSE start_pos END AS pos, strand FROM genes),
p AS (SELECT chr, CASE WHEN strand = '-' THEN pos - 100 ELSE pos - 2000 END AS s, CASE WHEN strand = '-' THEN pos + 2000 ELSE pos + 100 END AS e FROM t),
k AS (SELECT peak_id, chr, CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.chr = c.chr AND c.start_pos <= p.e AND c.end_pos >= p.s) THEN 'Promoter'
      WHEN EXISTS (SELECT 1 FROM genes g WHERE g.chr = c.chr AND c.start_pos <= g.end_pos AND c.end_pos >= g.start_pos) THEN 'Exonic' ELSE 'Distal' END AS peak_type FROM c)
SELECT chr, peak_type, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY chr) AS DOUBLE), 9) AS share FROM k GROUP BY chr, peak_type"""))
def peak_summary(spark: SparkSession, root: str) -> DataFrame:
    """Peaks by type and chromosome, gene bodies taken for exons."""
    g = A.genes(spark, root)
    named = annotate_peaks(A.peaks(spark, root), g, g)
    return G.peak_summary(named, ["chr"]).withColumn("share", F.round("share", 9))


@R.query(sql_with("fragments cells", """
, p AS (SELECT f.cell, c.cluster AS "group", unnest([start_pos, end_pos]) AS pos FROM fragments f JOIN cells c USING (cell) WHERE chr = 'chr3' AND end_pos >= 400000 AND start_pos <= 420000)
SELECT cell, "group", CAST((pos - 400000) // 100 AS BIGINT) AS tile, count(*) AS value FROM p WHERE pos BETWEEN 400000 AND 420000 GROUP BY ALL"""))
def cell_tracks(spark: SparkSession, root: str) -> DataFrame:
    """Tiles of a region by single cells."""
    return G.cell_tracks(A.fragments(spark, root), _groups(spark, root), "chr3", 400_000, 420_000)


@R.query()
def least_overlap(spark: SparkSession, root: str) -> DataFrame:
    """Two draws of four fifths of each cluster that overlap as little as they can."""
    return G.least_overlap(_groups(spark, root), ["group"])


@R.query()
def motif_scan_p(spark: SparkSession, root: str) -> DataFrame:
    """Places of a motif by the chance of their score."""
    motif = np.log2(np.array([[0.8, 0.1, 0.1, 0.8, 0.1, 0.1], [0.1, 0.7, 0.1, 0.1, 0.7, 0.1], [0.05, 0.1, 0.7, 0.05, 0.1, 0.7], [0.05, 0.1, 0.1, 0.05, 0.1, 0.1]]) / 0.25)
    return X.scan_motifs(A.sequences(spark, root), "doc_id", {"ACGACG": motif}, p=1e-3)


@R.query(sql_with("fragments insertions peaks", """
, c AS (SELECT chr, CAST(floor((start_pos + end_pos) / 2) AS BIGINT) AS c, CASE WHEN peak_id % 2 = 0 THEN 1 ELSE -1 END AS s FROM peaks),
h AS (SELECT sample, (i.pos - c.c) * s AS "offset", count(*) AS n FROM insertions i JOIN c ON i.chr = c.chr AND i.pos BETWEEN c.c - 250 AND c.c + 250 GROUP BY ALL),
v AS (SELECT sample, "offset", n / nullif(sum(CASE WHEN abs("offset") > 200 THEN n END) OVER (PARTITION BY sample) / 100.0, 0) AS value FROM h)
SELECT sample, "offset", round(value - (1 + abs("offset") / 1000.0), 6) AS normalised FROM v"""))
def normalised_footprint(spark: SparkSession, root: str) -> DataFrame:
    """Insertions around motif centres less an expected profile."""
    out = X.footprint(qc.insertions(A.fragments(spark, root)), _centers(spark, root), "sample")
    expected = out.select("sample", "offset", (1 + F.abs("offset") / 1000.0).alias("expected"))
    return X.normalise_footprint(out, expected, "sample").select("sample", "offset", F.round("normalised", 6).alias("normalised"))


@R.query()
def density(spark: SparkSession, root: str) -> DataFrame:
    """Cells by depth and enrichment as a smooth surface."""
    rows = latest(table(spark, root, "cellcoldata").select("cell_id", "nfrags", "tssenrichment", "loaded_at"), "cell_id", "loaded_at").where(F.col("nfrags") > 0)
    return D.density(rows.select(F.log10("nfrags").alias("x"), F.col("tssenrichment").alias("y")).where(F.col("y").isNotNull()), "x", "y", 50)

