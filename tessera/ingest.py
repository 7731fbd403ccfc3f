"""From fragments to a project in one call: barcodes, depth, quality, a filtered store, and count matrices."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import matrix as M
from tessera.operators import qc
from tessera.operators.intervals import extend
from tessera.project import Project
from tessera.session import materialise
from tessera.sources.files import read_fragments


@dataclass
class Genome:
    """Chromosome sizes (chr, len), genes (gene_id, symbol, chr, start_pos, end_pos, strand) and the blacklist (chr, start_pos, end_pos)."""

    sizes: DataFrame
    genes: DataFrame
    blacklist: DataFrame | None = None
    exons: DataFrame | None = None

    def starts(self) -> DataFrame:
        """Distinct gene starts (chr, pos, strand)."""
        at = F.when(F.col("strand") == "-", F.col("end_pos")).otherwise(F.col("start_pos"))
        return self.genes.select("chr", at.alias("pos"), "strand").distinct()


def cell_quality(fragments: DataFrame, genome: Genome) -> DataFrame:
    """One row a cell: sample, depth by nucleosome class, enrichment at gene starts, insertions and shares in promoters and the blacklist."""
    points = qc.insertions(fragments)
    starts = genome.starts()
    out = fragments.groupBy("cell").agg(F.first("sample").alias("sample")).join(qc.fragment_info(fragments), "cell")
    out = out.join(qc.tss_enrichment(points, starts.select("chr", "pos")).select("cell", "tss_enrichment", F.col("n_window").alias("reads_in_tss")), "cell")
    promoters = extend(starts.select("chr", F.col("pos").alias("start_pos"), F.col("pos").alias("end_pos"), "strand"), 2000, 100)
    regions = {"promoter": promoters} | ({"blacklist": genome.blacklist} if genome.blacklist is not None else {})
    return reduce(lambda a, r: a.join(qc.feature_counts(points, r[1], r[0]), "cell", "left"), regions.items(), out)


def create_project(
    spark: SparkSession, root: str, samples: dict[str, DataFrame | str | list[str]], genome: Genome, barcodes: dict[str, DataFrame] | None = None,
    least_frags: int = 1000, most_frags: int = 100_000, least_tss: float = 4.0, shortest: int = 10, longest: int = 2000, tile: int = 500, gene_scores: bool = True,
) -> Project:
    """Read every sample (a table of fragments or paths of fragment files), keep sound cells, and save a project with their fragments and matrices.

    Barcodes outside ``barcodes`` and cells outside ``least_frags`` to ``most_frags`` (counted before fragments of unfit width go)
    are dropped, then cells of too little enrichment; what was measured of every remaining cell is in the project's cells.
    Matrices are ``tiles`` (binary) and, with ``gene_scores``, ``genes``; their rows' statistics lie with their features.
    """
    parts = []
    for name, source in samples.items():
        allowed = (barcodes or {}).get(name)
        if isinstance(source, DataFrame):
            rows = source.select(F.lit(name).alias("sample"), "chr", "start_pos", "end_pos", "barcode", F.concat_ws("#", F.lit(name), "barcode").alias("cell"))
            parts.append(rows if allowed is None else rows.join(allowed.select("barcode"), "barcode", "left_semi").select(*rows.columns))
        else:
            parts.append(read_fragments(spark, source, name, allowed))
    fragments = materialise(qc.depth_filter(reduce(DataFrame.unionByName, parts), least_frags, most_frags, shortest, longest), "fragments")
    quality = cell_quality(fragments, genome)
    cells = materialise(quality.where((F.col("n_frags") >= least_frags) & (F.col("tss_enrichment") >= least_tss)), "cells")
    kept = materialise(fragments.join(cells.select("cell"), "cell", "left_semi").select(*fragments.columns), "kept")
    project = Project(spark, root, cells)
    project.set_genome(sizes=genome.sizes, genes=genome.genes, blacklist=genome.blacklist, exons=genome.exons)
    project.add_table("fragments", kept, {"least_frags": least_frags, "most_frags": most_frags, "least_tss": least_tss})
    points = qc.insertions(kept)
    tiles = M.tile_matrix(points, tile, sizes=genome.sizes, blacklist=genome.blacklist)
    project.add_matrix("tiles", tiles.select("chr", F.col("tile").alias("feature"), "cell", "value"), params={"tile": tile, "units": "binary"})
    if gene_scores:
        scores = M.gene_scores(points, M.gene_windows(genome.genes), tile, blacklist=genome.blacklist)
        named = scores.join(genome.genes.select("gene_id", "chr"), "gene_id")
        project.add_matrix("genes", named.select("chr", F.col("gene_id").alias("feature"), "cell", "value"), params={"units": "scaled"})
    return project.save()
