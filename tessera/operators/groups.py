"""Pseudobulk groups, their coverage, and peak sets from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.expressions import threshold
from tessera.functions.stats import adjust_bh, rank_quantile
from tessera.functions.tails import poisson_upper_p
from tessera.operators.intervals import non_overlapping, overlap_join, resize
from tessera.session import materialise


def least_overlap(rows: DataFrame, by: list[str], draws: int = 2, share: float = 0.8, seed: int = 1) -> DataFrame:
    """``rows`` (by, cell) in ``draws`` draws (1, 2, ...) of ``share`` of each group that overlap as little as such draws can.

    The cells of a group stand in a circle in the order of a seeded hash, and each draw takes a stretch of it, the draws beginning at equal distances.
    """
    order = Window.partitionBy(*by).orderBy(F.xxhash64(F.col("cell"), F.lit(seed)), "cell")
    placed = rows.withColumn("_at", F.row_number().over(order) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    begin = lambda k: F.floor(F.col("_n") * (k - 1) / draws)
    inside = [F.when(F.pmod(F.col("_at") - begin(k), F.col("_n")) < F.ceil(F.round(F.col("_n") * share, 6)), F.lit(k)) for k in range(1, draws + 1)]
    return placed.select(*[c for c in placed.columns if c not in ("_at", "_n")], F.explode(F.array_compact(F.array(*inside))).alias("draw"))


def pseudobulk(cells: DataFrame, group: str, sample: str, cell: str = "cell", least: int = 40, most: int = 500, replicates: int = 5, seed: int = 1, share: float = 0.8) -> DataFrame:
    """(group, replicate, cell): a replicate per sample with ``least`` cells, the smaller samples pooled in one more.

    A replicate keeps at most ``most`` cells, chosen by a seeded hash; at most
    ``replicates`` of a group are kept, the largest first, ties by sample.
    A group that has less than two replicates gets two draws of its cells: halves, or if these would be smaller
    than ``least``, draws of ``share`` of the cells that overlap as little as they can.
    """
    rows = materialise(cells.select(F.col(cell).alias("cell"), F.col(group).alias("group"), F.col(sample).alias("sample")), "cells")
    size = rows.groupBy("group", "sample").agg(F.count(F.lit(1)).alias("_n"))
    named = rows.join(size, ["group", "sample"]).withColumn("replicate", F.when(F.col("_n") >= least, F.col("sample")).otherwise("pooled"))
    kept = named.groupBy("group", "replicate").agg(F.count(F.lit(1)).alias("_size"))
    order = Window.partitionBy("group").orderBy(F.col("_size").desc(), "replicate")
    kept = kept.withColumn("_k", F.row_number().over(order)).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy("group"))).where(F.col("_k") <= replicates)
    out = materialise(named.join(kept, ["group", "replicate"]).select("group", "replicate", "cell", "_all", "_size"), "placed")
    two = out.where(F.col("_all") < 2).select("group", "cell", "_size")
    halves = least_overlap(two.where(F.col("_size") >= 2 * least).select("group", "cell"), ["group"], 2, 0.5, seed)
    shared = least_overlap(two.where(F.col("_size") < 2 * least).select("group", "cell"), ["group"], 2, share, seed)
    drawn = halves.unionByName(shared).select("group", F.concat(F.lit("half"), "draw").alias("replicate"), "cell")
    out = out.where(F.col("_all") >= 2).select("group", "replicate", "cell").unionByName(drawn)
    pick = Window.partitionBy("group", "replicate").orderBy(F.xxhash64(F.col("cell"), F.lit(seed)), "cell")
    return out.withColumn("_r", F.row_number().over(pick)).where(F.col("_r") <= most).select("group", "replicate", "cell")


def peak_summary(called: DataFrame, by: list[str]) -> DataFrame:
    """Number and share of called peaks by type: ``called`` (by, peak_type)."""
    out = called.groupBy(*by, "peak_type").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))  # one row a type


def cell_tracks(fragments: DataFrame, cells: DataFrame, chrom: str, start: int, end: int, tile: int = 100) -> DataFrame:
    """(cell, group, tile, value): tiles of a region that single cells touch, for tracks with a line a cell; ``cells`` (cell, group)."""
    inside = fragments.where((F.col("chr") == chrom) & (F.col("end_pos") >= start) & (F.col("start_pos") <= end)).join(cells.select("cell", "group"), "cell")
    points = inside.select("cell", "group", F.explode(F.array("start_pos", "end_pos")).alias("pos")).where(F.col("pos").between(start, end))
    return points.groupBy("cell", "group", F.floor((F.col("pos") - start) / tile).alias("tile")).agg(F.count(F.lit(1)).alias("value"))


def cap_fragments(groups: DataFrame, depth: DataFrame, most: int) -> DataFrame:
    """Cells of each group in order of ascending depth while the sum of fragments stays within ``most``."""
    run = Window.partitionBy("group").orderBy("n_frags", "cell").rowsBetween(Window.unboundedPreceding, 0)
    return groups.join(depth, "cell").withColumn("_sum", F.sum("n_frags").over(run)).where(F.col("_sum") <= most).drop("_sum", "n_frags")


def coverage(points: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, chr, pos, n): insertions per position; a cell that is in a group twice counts twice."""
    return points.select("cell", "chr", "pos").join(groups.select("cell", "group"), "cell").groupBy("group", "chr", "pos").agg(F.count(F.lit(1)).alias("n"))


def browser_track(tiles: DataFrame, groups: DataFrame, factor: DataFrame) -> DataFrame:
    """(group, chr, tile, value): tiles of a region summed per group and divided by the group's normalisation, in 1e4 units."""
    norm = groups.join(factor, "cell").groupBy("group").agg(F.sum("factor").alias("_f"))
    sums = tiles.join(groups.select("cell", "group"), "cell").groupBy("group", "chr", "tile").agg(F.sum("value").alias("_s"))
    return sums.join(norm, "group").select("group", "chr", "tile", (F.col("_s") * 1e4 / F.col("_f")).alias("value"))


def tile_peaks(tiles: DataFrame, groups: DataFrame, n_tiles: int, cut_off: float = 0.1, most: int = 500_000) -> DataFrame:
    """Tiles of each group whose count is too high for a Poisson of the group's mean, with FDR, best first up to ``most``."""
    sums = tiles.join(groups.select("cell", "group"), "cell").groupBy("group", "chr", "tile").agg(F.sum("value").alias("n"))
    mean = sums.groupBy("group").agg((F.sum("n") / n_tiles).alias("_mean"), F.sum("n").alias("_all"))
    p = sums.join(mean, "group").withColumn("p", poisson_upper_p(F.col("n").cast("double"), "_mean"))
    out = adjust_bh(p, "p", ["group"]).where(F.col("fdr") <= cut_off).withColumn("score", F.col("n") * 1e6 / F.col("_all"))
    order = Window.partitionBy("group").orderBy(F.col("score").desc(), "chr", "tile")
    return out.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= most).drop("_mean", "_all")


def union_tile_peaks(found: DataFrame) -> DataFrame:
    """One row per tile: that of the group with the highest score."""
    best = Window.partitionBy("chr", "tile").orderBy(F.col("score").desc(), "group")
    return found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") == 1).drop("_r")


def reproducible_peaks(summits: DataFrame, blacklist: DataFrame, rule: str = "2", width: int = 501) -> DataFrame:
    """Peaks of one group from the summits (chr, start_pos, end_pos, score, replicate) of its replicates.

    Summits off the blacklist are widened, thinned out per replicate by score, their
    scores turned to rank quantiles, thinned out over replicates, and kept if found in as many
    replicates as ``rule`` (an expression in n, their number) demands.
    """
    n = summits.select("replicate").distinct().count()
    wide = resize(overlap_join(summits, blacklist, "anti"), width).where(F.col("start_pos") > 0)
    wide = materialise(wide.withColumn("chr", F.concat_ws("\t", "replicate", "chr")), "wide")  # thinned out within each replicate
    own = non_overlapping(wide, "score").withColumn("chr", F.element_at(F.split("chr", "\t"), 2))
    own = materialise(rank_quantile(own, "score", "score_quantile", ["replicate"]), "own")
    picked = non_overlapping(own, "score_quantile", ["replicate"])
    hits = overlap_join(picked.select("chr", "start_pos", "end_pos").distinct(), own.select("chr", "start_pos", "end_pos", "replicate"))
    votes = hits.groupBy("a.chr", "a.start_pos", "a.end_pos").agg(F.countDistinct("b.replicate").alias("reproducibility"))
    return picked.join(votes, ["chr", "start_pos", "end_pos"]).where(F.col("reproducibility") >= threshold(rule, n))


def index_peaks(peaks: DataFrame) -> DataFrame:
    """Peaks with their number on each chromosome in ``idx``, without one task per chromosome."""
    from tessera.operators.skew import salted_rank

    return salted_rank(peaks, ["chr"], "start_pos", ["end_pos"], out="idx")
