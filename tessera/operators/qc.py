"""Quality control of fragments and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.intervals import offset_counts, point_depth, point_join
from tessera.operators.skew import skew_join
from tessera.session import materialise

#: Positions wrapped by one nucleosome.
NUCLEOSOME = 147


def insertions(fragments: DataFrame) -> DataFrame:
    """The two ends of every fragment as points: a fragment counts twice, also within one feature."""
    rest = [c for c in fragments.columns if c not in ("start_pos", "end_pos")]
    return fragments.select(*rest, F.explode(F.array("start_pos", "end_pos")).alias("pos"))


def width() -> Column:
    return F.col("end_pos") - F.col("start_pos") + 1


def fragment_info(fragments: DataFrame, nucleosome: int = NUCLEOSOME) -> DataFrame:
    """Fragments per cell, in all and by nucleosome class ``min(width div 147 + 1, 3)``, and the nucleosome ratio."""
    kind = F.least(F.floor(width() / nucleosome) + 1, F.lit(3))
    out = fragments.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n_frags"),
        *[F.count(F.when(kind == k, 1)).alias(name) for k, name in ((1, "n_mono"), (2, "n_di"), (3, "n_multi"))],
    )
    return out.withColumn("nucleosome_ratio", (F.col("n_di") + F.col("n_multi")) / F.nullif(F.col("n_mono"), F.lit(0)))


def fragment_sizes(fragments: DataFrame, by: list[str] | None = None, longest: int = 1000) -> DataFrame:
    """Number and percentage of fragments of each width up to ``longest``, per group."""
    by = by or []
    counts = fragments.select(*by, width().alias("width")).where(F.col("width") <= longest).groupBy(*by, "width").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(*by)))


def depth_filter(fragments: DataFrame, least: int, most: int, shortest: int = 10, longest: int = 2000) -> DataFrame:
    """Fragments of barcodes with ``least`` to ``most`` fragments, counted before those of unfit width are dropped."""
    counts = fragments.groupBy("cell").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n").between(least, most))
    return fragments.join(counts.select("cell"), "cell", "left_semi").where(width().between(shortest, longest)).select(*fragments.columns)


def tss_enrichment(points: DataFrame, tss: DataFrame, window: int = 101, flank: int = 2000, norm: int = 100, floor: float = 0.2) -> DataFrame:
    """Insertions per cell around gene starts against the far flanks: ``2 (nWindow / window) / max(nFlank / norm, floor)``."""
    h = window // 2
    parts = F.array(
        F.struct(F.lit("window").alias("kind"), (F.col("pos") - h).alias("start_pos"), (F.col("pos") + h).alias("end_pos")),
        F.struct(F.lit("flank").alias("kind"), (F.col("pos") - flank).alias("start_pos"), (F.col("pos") - flank + norm - 1).alias("end_pos")),
        F.struct(F.lit("flank").alias("kind"), (F.col("pos") + flank - norm + 1).alias("start_pos"), (F.col("pos") + flank).alias("end_pos")),
    )
    ranges = tss.select("chr", "pos").distinct().select("chr", F.explode(parts).alias("_r")).select("chr", "_r.*")
    hits = point_join(points.select("cell", "chr", "pos"), ranges)
    counts = hits.groupBy("cell").agg(F.count(F.when(F.col("kind") == "window", 1)).alias("n_window"), F.count(F.when(F.col("kind") == "flank", 1)).alias("n_flank"))
    cells = points.select("cell").distinct().join(counts, "cell", "left").fillna(0, ["n_window", "n_flank"])
    score = 2 * (F.col("n_window") / window) / F.greatest(F.col("n_flank") / norm, F.lit(floor))
    return cells.withColumn("tss_enrichment", F.round(score, 3))


def tss_profile(points: DataFrame, tss: DataFrame, by: str, flank: int = 2000, norm: int = 100) -> DataFrame:
    """Insertions by offset from gene starts, turned to the strand and divided by the mean of both outer ends."""
    hits = offset_counts(points, tss, by, flank)
    ends = F.sum(F.when(F.abs("offset") > flank - norm, F.col("n"))).over(Window.partitionBy(by)) / (2 * norm)
    return hits.withColumn("enrichment", F.col("n") / F.nullif(ends, F.lit(0.0)))


def feature_counts(points: DataFrame, features: DataFrame, name: str) -> DataFrame:
    """Insertions per cell within a set of features, with their share of all; overlapping features count each."""
    deep = point_depth(points.select("cell", "chr", "pos"), features)
    out = deep.groupBy("cell").agg(F.sum(F.when(F.col("cell").isNotNull(), F.col("depth")).otherwise(0)).alias(f"n_{name}"), F.count(F.lit(1)).alias("_all"))
    return out.withColumn(f"{name}_ratio", F.col(f"n_{name}") / F.col("_all")).drop("_all")


def keep_cells(qc: DataFrame, least_frags: int = 1000, least_tss: float = 4.0) -> DataFrame:
    """A column ``keep``: 1 where a cell has enough fragments and enrichment."""
    return qc.withColumn("keep", ((F.col("n_frags") >= least_frags) & (F.col("tss_enrichment") >= least_tss)).cast("int"))


def filter_doublets(cells: DataFrame, cell: str, sample: str, enrichment: str, score: str, cut_enrichment: float = 1.0, cut_score: float = -1e300, ratio: float = 1.0) -> DataFrame:
    """Cells less the likely doublets: per sample at most ``ratio * n * n / 100000`` of highest enrichment that pass both cut-offs."""
    quota = cells.groupBy(sample).agg(F.floor(ratio * F.count(F.lit(1)) * F.count(F.lit(1)) / 100000).alias("_quota"))
    passing = cells.where((F.col(enrichment) >= cut_enrichment) & (F.col(score) >= cut_score)).select(cell, sample, enrichment)
    order = Window.partitionBy(sample).orderBy(F.col(enrichment).desc(), cell)
    drop = skew_join(materialise(passing.withColumn("_r", F.row_number().over(order)), "doublets"), quota, [sample]).where(F.col("_r") <= F.col("_quota"))
    return cells.join(drop.select(cell), cell, "left_anti").select(*cells.columns)


def demultiplex(cells: DataFrame, calls: DataFrame, barcode: str = "barcode", best: str = "best") -> DataFrame:
    """Left-join calls such as ``SNG-donor1``: class and donor, NotClassified where there is no call."""
    parts = F.split(best, "-", 2)
    known = calls.select(barcode, parts[0].alias("demux_class"), F.get(parts, F.lit(1)).alias("demux_sample")).dropDuplicates([barcode])
    return cells.join(known, barcode, "left").fillna("NotClassified", ["demux_class", "demux_sample"])


def gene_expression_qc(counts: DataFrame, mito: str = "^MT", ribo: str = "^RP") -> DataFrame:
    """Per cell of (cell, gene, value): molecules, genes, and the shares of mitochondrial and ribosomal genes."""
    of = lambda p: F.sum(F.when(F.col("gene").rlike(p), F.col("value")).otherwise(0))
    out = counts.groupBy("cell").agg(F.sum("value").alias("n_umi"), F.count(F.when(F.col("value") > 0, 1)).alias("n_genes"), of(mito).alias("_m"), of(ribo).alias("_r"))
    return out.withColumn("mito_ratio", F.col("_m") / F.col("n_umi")).withColumn("ribo_ratio", F.col("_r") / F.col("n_umi")).drop("_m", "_r")
