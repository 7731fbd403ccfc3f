"""Sparse matrices in coordinate form (row, column, value): counting, normalising, row statistics, grouping.

Absent entries are zeros and count in every mean, variance and rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.stats import quantiles
from tessera.operators.intervals import held_counts, overlap_pairs, point_join, range_counts
from tessera.session import materialise

#: Positions of a chromosome whose genes are scored in one task.
SLAB = 1 << 16

def tile_matrix(points: DataFrame, tile: int = 500, binarize: bool = True, sizes: DataFrame | None = None, blacklist: DataFrame | None = None) -> DataFrame:
    """(chr, tile, cell, value): insertions by tile ``pos div tile + 1``; points outside the chromosome and tiles that touch the blacklist are left out."""
    if sizes is not None:
        points = points.join(F.broadcast(sizes.select("chr", "len")), "chr").where(F.col("pos").between(1, F.col("len"))).drop("len")  # one row a chromosome
    counts = points.groupBy("chr", (F.floor(F.col("pos") / tile) + 1).alias("tile"), "cell").agg(F.count(F.lit(1)).alias("value"))
    if blacklist is not None:
        first, last = F.floor(F.col("start_pos") / tile) + 1, F.floor(F.col("end_pos") / tile) + 1
        bad = blacklist.select("chr", F.explode(F.sequence(first, last)).alias("tile")).distinct()
        counts = counts.join(bad, ["chr", "tile"], "left_anti")
    return counts.withColumn("value", F.lit(1).cast("long")) if binarize else counts


def feature_matrix(points: DataFrame, features: DataFrame, key: str, ceiling: int | None = 4, binarize: bool = False) -> DataFrame:
    """(key, cell, value): insertions of a cell within a feature, at most ``ceiling``."""
    value = F.col("n") if ceiling is None else F.least(F.col("n"), F.lit(ceiling).cast("long"))
    return held_counts(points, features, key, "cell").select(key, "cell", (F.lit(1).cast("long") if binarize else value).alias("value"))


def feature_groups(points: DataFrame, features: DataFrame, key: str, groups: DataFrame) -> DataFrame:
    """(key, group, value): insertions of all cells of a group within a feature, without a ceiling; ``groups`` (cell, group) may hold a cell several times.

    The same as the group sums of :func:`feature_matrix` without a ceiling, whose entries for single cells are never made.
    """
    grouped = points.select("cell", "chr", "pos").join(groups.select("cell", "group"), "cell")
    return range_counts(grouped, features, key, "group").withColumnRenamed("n", "value")


def reads_in_peaks(points: DataFrame, features: DataFrame) -> DataFrame:
    """Per cell: insertions in peaks before any ceiling, and their share of those on chromosomes that have peaks."""
    chroms = features.select("chr").distinct()
    seen = points.select("cell", "chr", "pos").join(chroms, "chr", "left_semi")
    total = seen.groupBy("cell").agg(F.count(F.lit(1)).alias("_all"))
    hits = point_join(seen, features.select("chr", "start_pos", "end_pos")).groupBy("cell").agg(F.count(F.lit(1)).alias("reads_in_peaks"))
    out = total.join(hits, "cell", "left").fillna(0, ["reads_in_peaks"])
    return out.select("cell", "reads_in_peaks", (F.col("reads_in_peaks") / F.col("_all")).alias("frip"))


def gene_windows(genes: DataFrame, upstream: int = 5000, downstream: int = 0, least: int = 1000, most: int = 100_000, boundary: bool = True, scale: float = 5.0) -> DataFrame:
    """Genes with their extended body, its weight by width, and the window from which they gather signal.

    The window reaches ``most`` positions beyond the body, but (with ``boundary``) not
    beyond the body of a neighbouring gene, and at least ``least``.
    """
    back = F.col("strand") == "-"
    body = genes.withColumns(
        {
            "body_start": (F.col("start_pos") - F.when(back, downstream).otherwise(upstream)).cast("long"),
            "body_end": (F.col("end_pos") + F.when(back, upstream).otherwise(downstream)).cast("long"),
            "tss": F.when(back, F.col("end_pos")).otherwise(F.col("start_pos")),
        }
    ).withColumn("_m", 1.0 / (F.col("body_end") - F.col("body_start") + 1))
    spread = body.agg(F.min("_m").alias("_lo"), F.max("_m").alias("_hi"))
    weight = 1 + F.col("_m") * (scale - 1) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    body = body.crossJoin(F.broadcast(spread)).withColumn("weight", F.coalesce(weight, F.lit(1.0))).drop("_m", "_lo", "_hi")
    low, high = F.col("body_start") - most, F.col("body_end") + most
    if boundary:
        order = Window.partitionBy("chr").orderBy("start_pos", "end_pos", "gene_id")
        before = F.lag("end_pos").over(order)
        after = F.lead("start_pos").over(order)
        low = F.least(F.greatest(low, F.coalesce(before + 1, low)), F.col("body_start") - least)
        high = F.greatest(F.least(high, F.coalesce(after - 1, high)), F.col("body_end") + least)
    return body.withColumn("window_start", F.greatest(F.lit(1), low).cast("long")).withColumn("window_end", high.cast("long"))


def decay(distance: Column, length: float = 5000.0) -> Column:
    """Weight of a tile at a signed distance from the gene body."""
    return F.exp(-F.abs(distance) / length) + F.exp(F.lit(-1.0))


def _gene_weights(points: DataFrame, windows: DataFrame, tile: int, ceiling: int, model, blacklist: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Written tables: tiles (chr, start_pos, cell, n), and the weights (gene_id, chr, start_pos, _slab, w) of tiles for each gene near them."""
    start = (F.floor(F.col("pos") / tile) * tile).cast("long")
    tiles = points.groupBy("chr", start.alias("start_pos"), "cell").agg(F.least(F.count(F.lit(1)), F.lit(ceiling)).alias("n"))
    tiles = materialise(tiles, "tiles")
    places = tiles.select("chr", "start_pos").distinct().withColumn("end_pos", F.col("start_pos") + tile - 1)
    if blacklist is not None:
        bad = overlap_pairs(places, blacklist).select("a.chr", "a.start_pos").distinct()
        places = places.join(bad, ["chr", "start_pos"], "left_anti")
    ranges = windows.select("chr", F.col("window_start").alias("start_pos"), F.col("window_end").alias("end_pos"), "gene_id", "body_start", "body_end", "tss", "strand", "weight")
    near = overlap_pairs(ranges, places, bin_width=1 << 16)
    gap = F.greatest(F.lit(0), F.greatest(F.col("b.start_pos") - F.col("a.body_end"), F.col("a.body_start") - F.col("b.end_pos")) - 1)
    side = F.signum((F.col("b.start_pos") - F.col("a.tss")).cast("double")) * F.when(F.col("a.strand") == "-", -1).otherwise(1)
    weights = near.select(F.col("a.gene_id").alias("gene_id"), F.col("b.chr").alias("chr"), F.col("b.start_pos").alias("start_pos"), F.floor(F.col("a.start_pos") / SLAB).alias("_slab"), (model(gap * side) * F.col("a.weight")).alias("w"))
    return tiles, materialise(weights, "weights")


def rounded(x: np.ndarray, places: int) -> np.ndarray:
    """Rounded as Spark's ``round``: half away from zero by the shortest decimal of each number; no negative zero."""
    scaled = np.abs(x) * 10**places
    whole = np.floor(scaled + 0.5)
    out = np.copysign(whole, x) / 10**places + 0.0
    for i in zip(*np.nonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6)):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))
    return out


def _scored(tiles: DataFrame, weights: DataFrame, scale: float | None, totals: bool) -> DataFrame:
    """(gene_id, cell, value), with ``scale`` those that are not 0 when rounded to three places, or with ``totals`` (cell, n_genes, total) of these before rounding: products of weights and tiles, worked out where all tiles of a gene meet.

    What a cell's values sum up to over all genes follows from its tiles and their weights over all genes, so no value is needed for it.
    ``weights`` hold every gene under one (chr, _slab).
    """
    if scale is None:
        tiles = tiles.withColumn("_sum", F.lit(1.0))
    else:
        everywhere = weights.groupBy("chr", "start_pos").agg(F.sum("w").alias("_w"))
        sums = tiles.join(everywhere, ["chr", "start_pos"]).groupBy("cell").agg(F.sum(F.col("_w") * F.col("n")).alias("_sum"))
        tiles = tiles.join(sums, "cell")
    kind, name = weights.schema["gene_id"].dataType, tiles.schema["cell"].dataType
    reached = weights.select("chr", "_slab", "start_pos").distinct()
    nothing = lambda k: F.lit(None).cast(k)
    t = tiles.join(reached, ["chr", "start_pos"]).select("chr", "_slab", "start_pos", nothing(kind).alias("gene_id"), "cell", F.col("n").cast("double").alias("x"), "_sum", F.lit(True).alias("_tile"))
    w = weights.select("chr", "_slab", "start_pos", "gene_id", nothing(name).alias("cell"), F.col("w").alias("x"), nothing("double").alias("_sum"), F.lit(False).alias("_tile"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        of_tile = rows.column("_tile").to_numpy()
        left, right = np.flatnonzero(of_tile), np.flatnonzero(~of_tile)
        if not len(left) or not len(right):
            return
        coded = lambda c, at: pc.dictionary_encode(pa.concat_arrays(rows.column(c).chunks).take(pa.array(at)), null_encoding="encode")
        cells, genes = coded("cell", left), coded("gene_id", right)
        places, at = np.unique(rows.column("start_pos").to_numpy(), return_inverse=True)
        cell, gene, x = cells.indices.to_numpy(), genes.indices.to_numpy(), rows.column("x").to_numpy()
        scaled = np.zeros(len(cells.dictionary))
        scaled[cell] = rows.column("_sum").to_numpy()[left]
        n_genes, known = len(genes.dictionary), np.isfinite(x[right]).all() and x[right].min() > 0  # else a value may be there and zero
        lo, hi = np.full(n_genes, len(places)), np.zeros(n_genes, np.int64)
        np.minimum.at(lo, gene, at[right])
        np.maximum.at(hi, gene, at[right] + 1)
        order = lo.argsort(kind="stable")  # genes near each other share most tiles
        place_of = np.empty(n_genes, np.int64)
        place_of[order] = np.arange(n_genes)
        by_gene = place_of[gene].argsort(kind="stable")
        sorted_, their = place_of[gene][by_gene], right[by_gene]
        by_cell = cell.argsort(kind="stable")
        for a in range(0, len(scaled), 4096):
            b = min(a + 4096, len(scaled))
            some = by_cell[np.searchsorted(cell[by_cell], a) : np.searchsorted(cell[by_cell], b)]
            signal = np.zeros((len(places), b - a))
            signal[at[left[some]], cell[some] - a] = x[left[some]]
            number, total = np.zeros(b - a, np.int64), np.zeros(b - a)
            for g in range(0, n_genes, 128):
                h = min(g + 128, n_genes)
                first, last = lo[order[g:h]].min(), hi[order[g:h]].max()
                part = slice(*np.searchsorted(sorted_, [g, h]))
                weight = np.zeros((h - g, last - first))
                np.add.at(weight, (sorted_[part] - g, at[their[part]] - first), np.nan_to_num(x[their[part]]))
                value = weight @ signal[first:last]
                if scale is not None:
                    value *= scale / scaled[a:b]
                if totals:
                    enough = value >= 0.0005
                    number += enough.sum(0)
                    total += np.where(enough, value, 0).sum(0)
                    continue
                there = value
                if not known and scale is None:
                    there = np.zeros(weight.shape)
                    there[sorted_[part] - g, at[their[part]] - first] = 1
                    there = there @ (signal[first:last] > 0)
                if scale is not None:
                    value = there = rounded(value, 3)
                r, c = np.nonzero(there if scale is None else there > 0)
                yield pa.RecordBatch.from_arrays([genes.dictionary.take(pa.array(order[g + r])), cells.dictionary.take(pa.array(a + c)), pa.array(value[r, c])], names=["gene_id", "cell", "value"])
            if totals:
                yield pa.RecordBatch.from_arrays([cells.dictionary.slice(a, b - a), pa.array(number), pa.array(total)], names=["cell", "n_genes", "total"])

    met = t.unionByName(w).groupBy("chr", "_slab")
    if not totals:
        return met.applyInArrow(run, f"gene_id {kind.simpleString()}, cell {name.simpleString()}, value double")
    parts = met.applyInArrow(run, f"cell {name.simpleString()}, n_genes bigint, total double")
    return parts.groupBy("cell").agg(F.sum("n_genes").alias("n_genes"), F.sum("total").alias("total")).where(F.col("n_genes") > 0)


def _single(windows: DataFrame) -> bool:
    """Whether every gene has one window."""
    return (windows.groupBy("gene_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) <= 1


def gene_scores(points: DataFrame, windows: DataFrame, tile: int = 500, ceiling: int = 4, model=decay, scale: float | None = 10_000.0, blacklist: DataFrame | None = None) -> DataFrame:
    """(gene_id, cell, value): distance-weighted insertions around every gene, in shares of the cell's sum over all genes times ``scale``."""
    tiles, weights = _gene_weights(points, windows, tile, ceiling, model, blacklist)
    if _single(windows):
        return _scored(tiles, weights, scale, False)
    scores = tiles.join(weights, ["chr", "start_pos"]).groupBy("gene_id", "cell").agg(F.sum(F.col("w") * F.col("n")).alias("value"))
    if scale is None:
        return scores
    scores = materialise(scores, "scores")  # read twice
    sums = scores.groupBy("cell").agg(F.sum("value").alias("_sum"))
    out = scores.join(sums, "cell").select("gene_id", "cell", F.round(F.col("value") * scale / F.col("_sum"), 3).alias("value"))
    return out.where(F.col("value") > 0)


def gene_score_totals(points: DataFrame, windows: DataFrame, tile: int = 500, ceiling: int = 4, model=decay, scale: float = 10_000.0, blacklist: DataFrame | None = None) -> DataFrame:
    """(cell, n_genes, total): how many genes of a cell have a score that is not 0 when rounded to three places, and the sum of those scores before rounding."""
    if _single(windows):
        return _scored(*_gene_weights(points, windows, tile, ceiling, model, blacklist), scale, True)
    scores = materialise(gene_scores(points, windows, tile, ceiling, model, None, blacklist), "scores")
    sums = scores.groupBy("cell").agg(F.sum("value").alias("_t"))
    shares = scores.join(sums, "cell").withColumn("v", F.col("value") * scale / F.col("_t")).where(F.round("v", 3) > 0)
    return shares.groupBy("cell").agg(F.count(F.lit(1)).alias("n_genes"), F.sum("v").alias("total"))


def row_moments(matrix: DataFrame, row: list[str], n_columns: int | Column, value: Column | None = None) -> DataFrame:
    """Sum, mean and sample variance of each row over all ``n_columns`` columns, absent entries being zeros."""
    x = value if value is not None else F.col("value").cast("double")
    n = F.lit(n_columns) if isinstance(n_columns, int) else n_columns
    out = matrix.groupBy(*row).agg(F.sum(x).alias("total"), F.sum(x * x).alias("_sq"), F.count(F.when(x != 0, 1)).alias("n_nonzero"))
    out = out.withColumn("mean", F.col("total") / n)
    return out.withColumn("variance", (F.col("_sq") - n * F.col("mean") * F.col("mean")) / (n - 1)).drop("_sq")


def combine_variances(parts: DataFrame, row: list[str], mean: str = "mean", variance: str = "variance", n: str = "n") -> DataFrame:
    """Mean and variance of the whole from those of its parts."""
    total = F.sum(F.col(n))
    middle = F.sum(F.col(mean) * F.col(n)) / total
    squares = F.sum(F.col(variance) * (F.col(n) - 1) + F.col(mean) * F.col(mean) * F.col(n))
    return parts.groupBy(*row).agg(total.alias("n"), middle.alias("mean"), ((squares - total * middle * middle) / (total - 1)).alias("variance"))


def standardised_variance(matrix: DataFrame, row: list[str], n_columns: int, expected_sd: DataFrame, clip: float) -> DataFrame:
    """Variance of clipped standard scores, zeros included; ``expected_sd`` has the rows' mean and sd."""
    z = F.least(F.lit(clip), (F.col("value") - F.col("mean")) / F.col("sd"))
    at_zero = F.pow(F.col("mean") / F.col("sd"), 2)
    out = matrix.join(expected_sd, row).groupBy(*row).agg(F.sum(z * z).alias("_sq"), F.count(F.lit(1)).alias("_n"), F.first(at_zero).alias("_z"))
    return out.select(*row, ((F.col("_sq") + (n_columns - F.col("_n")) * F.col("_z")) / (n_columns - 1)).alias("variance"))


def group_matrix(matrix: DataFrame, row: list[str], groups: DataFrame) -> DataFrame:
    """(row, group, value): sums over the cells of each group; ``groups`` (cell, group) may hold a cell several times."""
    return matrix.join(groups.select("cell", "group"), "cell").groupBy(*row, "group").agg(F.sum("value").alias("value"))


def group_means(matrix: DataFrame, row: list[str], groups: DataFrame) -> DataFrame:
    """Mean, sd and share of nonzero entries of each row in each group, over all cells of the group."""
    sizes = groups.groupBy("group").agg(F.count(F.lit(1)).alias("_n"))
    x = F.col("value").cast("double")
    sums = matrix.join(groups.select("cell", "group"), "cell").groupBy(*row, "group").agg(F.sum(x).alias("_s"), F.sum(x * x).alias("_q"), F.count(F.when(x != 0, 1)).alias("_k"))
    out = sums.join(sizes, "group").withColumn("mean", F.col("_s") / F.col("_n"))
    sd = F.sqrt(F.greatest(F.lit(0.0), (F.col("_q") - F.col("_n") * F.col("mean") * F.col("mean")) / (F.col("_n") - 1)))
    return out.select(*row, "group", "mean", sd.alias("sd"), (F.col("_k") / F.col("_n")).alias("share"))


def group_summary(cells: DataFrame, group: str, value: str, how: str = "median") -> DataFrame:
    if how == "median":
        middle = quantiles(cells, value, {value: 0.5}, [group]).withColumnRenamed(group, "_of")
        n = cells.groupBy(group).agg(F.count(F.lit(1)).alias("n_cells"))
        return n.join(middle, F.col(group).eqNullSafe(F.col("_of")), "left").select(group, value, "n_cells")
    f = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[how]
    return cells.groupBy(group).agg(f(value).alias(value), F.count(F.lit(1)).alias("n_cells"))


def group_experiment(matrix: DataFrame, row: list[str], groups: DataFrame, divide: bool = True, scale: float | None = None) -> DataFrame:
    """Group sums, divided by the number of cells and scaled to one column sum, as wanted."""
    out = group_matrix(matrix, row, groups)
    if divide:
        sizes = groups.groupBy("group").agg(F.count(F.lit(1)).alias("_n"))
        out = out.join(sizes, "group").withColumn("value", F.col("value") / F.col("_n")).drop("_n")
    if scale is not None:
        sums = out.groupBy("group").agg(F.sum("value").alias("_s"))
        out = out.join(sums, "group").withColumn("value", F.col("value") * scale / F.col("_s")).drop("_s")
    return out.select(*row, "group", "value")


def confusion(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def tabulate2d(df: DataFrame, x: str, y: str, x_range: tuple[int, int], y_range: tuple[int, int]) -> DataFrame:
    return confusion(df.where(F.col(x).between(*x_range) & F.col(y).between(*y_range)), x, y)


def coordinates(blocks: DataFrame, keep: list[str] | None = None, indptr: str = "indptr", indices: str = "indices", data: str = "data") -> DataFrame:
    """Matrices in compressed columns (a block of arrays per row) as (keep, row, column, value).

    A column's entries are cut out of the arrays while columns are told apart, so that each entry is copied once and no array is repeated.
    """
    keep = keep or []
    column = F.sequence(F.lit(0), F.size(indptr) - 2)
    at = lambda c: F.element_at(F.col(indptr), c + 1)
    entries = lambda c: F.arrays_zip(F.slice(indices, at(c) + 1, at(c + 1) - at(c)).alias("row"), F.slice(data, at(c) + 1, at(c + 1) - at(c)).alias("value"))
    cut = F.transform(column, lambda c: F.struct(c.alias("column"), entries(c).alias("entries")))
    columns = blocks.where(F.size(indptr) > 1).select(*keep, F.explode(cut).alias("_c"))
    return columns.select(*keep, "_c.column", F.explode("_c.entries").alias("_e")).select(*keep, F.col("_e")["row"].alias("row"), "column", F.col("_e")["value"].alias("value"))


def merge_matrices(parts: DataFrame, n_parts: int, strict: bool = True) -> DataFrame:
    """Rows (part, gene, cell, value) of several matrices; with ``strict`` only genes that all parts have."""
    if not strict:
        return parts
    common = parts.select("part", "gene").distinct().groupBy("gene").count().where(F.col("count") == n_parts)
    return parts.join(common.select("gene"), "gene", "left_semi")


def unique_genes(matrix: DataFrame) -> DataFrame:
    """Entries of the features (feature_id, gene) that have the highest sum of their gene name; ties go to the smaller id."""
    sums = matrix.groupBy("gene", "feature_id").agg(F.sum("value").alias("_s"))
    best = sums.withColumn("_r", F.row_number().over(Window.partitionBy("gene").orderBy(F.col("_s").desc(), "feature_id"))).where(F.col("_r") == 1)
    return matrix.join(best.select("feature_id"), "feature_id", "left_semi")


def top_features(totals: DataFrame, feature: str, total: str, n: int, skip_share: float = 0.005) -> DataFrame:
    """The ``n`` features of highest total after the top ``skip_share`` of all; ties go to the smaller feature."""
    skip = int(skip_share * totals.count())
    return totals.orderBy(F.col(total).desc(), feature).offset(skip).limit(n)


def stratified_sample(cells: DataFrame, stratum: str, cell: str, n: int, seed: int = 1) -> DataFrame:
    """About ``n`` cells, each stratum in proportion to its size and at least one; the order is a seeded hash.

    The hash tells beforehand about which cells will be among the quota; only twice as many (and a few more) are ranked, so a large stratum is no single sort.
    """
    sizes = cells.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_all"))
    quota = sizes.crossJoin(F.broadcast(total)).withColumn("_quota", F.ceil(F.col("_n") * n / F.col("_all"))).select(stratum, "_quota", "_n")  # one row
    h = F.xxhash64(F.col(cell), F.lit(seed))
    share = (F.shiftrightunsigned(h, 1).cast("double")) / float(1 << 63)  # even between 0 and 1, whatever the sign
    rows = cells.join(quota, stratum).withColumn("_h", F.shiftrightunsigned(h, 1)).where(share < (2 * F.col("_quota") + 50) / F.col("_n"))
    order = Window.partitionBy(stratum).orderBy("_h", cell)
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= F.col("_quota")).select(*cells.columns)


def scale_rows(matrix: DataFrame, row: list[str], n_columns: int, out: str = "scaled") -> DataFrame:
    """Values divided by the root mean square of their row, ``sqrt(sum of squares / (n - 1))``, absent entries being zeros, which stay absent."""
    x = F.col("value").cast("double")
    norm = matrix.groupBy(*row).agg(F.sqrt(F.sum(x * x) / (n_columns - 1)).alias("_rms"))
    return matrix.join(norm, row).withColumn(out, x / F.nullif(F.col("_rms"), F.lit(0.0))).drop("_rms")


def row_logs(matrix: DataFrame, row: list[str], n_columns: int) -> DataFrame:
    """Mean and variance of log2(value + 1) of each row, and the geometric mean, variance and dispersion that follow, zeros included."""
    m = row_moments(matrix, row, n_columns, F.log2(F.col("value") + 1.0))
    ln2 = math.log(2)
    spread = F.col("variance") * ln2 * ln2
    out = m.withColumn("geometric_mean", F.pow(F.lit(2.0), F.col("mean")) - 1).withColumn("geometric_sd", F.exp(F.sqrt(F.greatest(F.lit(0.0), spread))))
    return out.withColumn("geometric_dispersion", F.sqrt(F.exp(F.greatest(F.lit(0.0), spread)) - 1))


def pad(matrix: DataFrame, rows: DataFrame, row: str, column: str) -> DataFrame:
    """The requested rows; those the matrix lacks come with a null column and value 0."""
    return rows.select(row).distinct().join(matrix, row, "left").select(row, column, F.coalesce("value", F.lit(0)).alias("value"))
