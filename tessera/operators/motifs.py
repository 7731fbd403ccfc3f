"""Sequences: k-mers, motif scans, footprints, and deviations of accessibility."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.stats import rank_quantile, rolling_mean
from tessera.operators.graph import distinct_neighbours
from tessera.operators.intervals import offset_counts, range_counts
from tessera.session import materialise


def all_kmers(k: int) -> list[str]:
    return ["".join(x) for x in itertools.product("ACGT", repeat=k)]


def kmer_positions(sequences: DataFrame, key: str, k: int, seq: str = "seq") -> DataFrame:
    """(key, position, kmer) of every k letters that are A, C, G or T, positions from 1."""
    last = F.length(seq) - k + 1
    at = sequences.where(last > 0).select(key, seq, F.explode(F.sequence(F.lit(1), last)).alias("position"))
    return at.select(key, F.col("position").cast("long").alias("position"), F.substring(F.col(seq), F.col("position"), F.lit(k)).alias("kmer")).where(F.col("kmer").rlike(f"^[ACGT]{{{k}}}$"))


def kmer_counts(sequences: DataFrame, key: str, k: int, by: str = "position") -> DataFrame:
    """Number of each k-mer by position (or, with ``by`` the key, by sequence)."""
    return kmer_positions(sequences, key, k).groupBy("kmer", by).agg(F.count(F.lit(1)).alias("n"))


def kmer_bias(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """(kmer, bias): share among insertion sites over share in the genome; both tables (kmer, n)."""
    def share(df: DataFrame, name: str) -> DataFrame:
        sums = df.groupBy("kmer").agg(F.sum("n").alias("n"))
        return sums.crossJoin(F.broadcast(sums.agg(F.sum("n").alias("_t")))).select("kmer", (F.col("n") / F.col("_t")).alias(name))

    return share(expected, "_e").join(share(observed, "_o"), "kmer", "left").select("kmer", (F.coalesce("_o", F.lit(0.0)) / F.col("_e")).alias("bias"))


def reverse_complement(column: str) -> Column:
    return F.reverse(F.translate(column, "ACGT", "TGCA"))


def gc_content(column: str = "seq") -> tuple[Column, Column]:
    """Shares of G or C and of N among the letters."""
    n = F.nullif(F.length(column), F.lit(0))
    return (F.length(F.regexp_replace(column, "[^GC]", "")) / n).alias("gc"), (F.length(F.regexp_replace(column, "[^N]", "")) / n).alias("n_share")


def score_cut_off(motif: np.ndarray, p: float, letters: tuple[float, float, float, float] = (0.25, 0.25, 0.25, 0.25), step: float = 0.001) -> float:
    """The least score that random letters reach with a chance of at most ``p``: the distribution of the sum over positions, on a grid of ``step``."""
    grid = np.round(np.asarray(motif, float) / step).astype(np.int64)
    low = grid.min(0)
    chance = np.ones(1)
    for j in range(grid.shape[1]):
        shift = grid[:, j] - low[j]
        new = np.zeros(len(chance) + shift.max())
        for s, q in zip(shift, letters):
            new[s : s + len(chance)] += q * chance
        chance = new
    tail = np.cumsum(chance[::-1])[::-1]
    reached = np.flatnonzero((tail <= p * (1 + 1e-9)) & (chance > 0))  # the least score there is, not one in the gap below it
    return float((reached[0] if len(reached) else len(chance)) + low.sum()) * step


def scan_motifs(sequences: DataFrame, key: str, motifs: dict[str, np.ndarray], cut_off: float | None = None, seq: str = "seq", p: float | None = None, letters: tuple[float, float, float, float] = (0.25, 0.25, 0.25, 0.25)) -> DataFrame:
    """(key, motif, position, strand, score) of places where a log-odds matrix (letters x width) scores at least ``cut_off``.

    With ``p`` in its place, each motif's cut-off is the score that random letters reach with that chance.
    """
    kind = sequences.schema[key].dataType.simpleString()
    turned = {m: np.asarray(w, float)[::-1, ::-1] for m, w in motifs.items()}  # complement of A C G T is its reversal
    least = {m: cut_off if p is None else score_cut_off(w, p, letters) - 1e-3 * np.asarray(w).shape[1] / 2 for m, w in motifs.items()}  # less what the grid may round

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = np.full(256, 4)
        code[[65, 67, 71, 84]] = range(4)
        for batch in batches:
            rows, names, places, strands, scores = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                x = code[np.frombuffer((text or "").encode("latin-1", "replace"), np.uint8)]
                for motif, w in motifs.items():
                    for strand, m in (("+", np.asarray(w, float)), ("-", turned[motif])):
                        width = m.shape[1]
                        if len(x) < width:
                            continue
                        padded = np.vstack([m, np.full(width, -1e9)])
                        score = sum(padded[x[j : len(x) - width + 1 + j], j] for j in range(width))
                        at = np.flatnonzero(score >= least[motif])
                        rows.append(np.full(len(at), i))
                        names += [motif] * len(at)
                        strands += [strand] * len(at)
                        places.append(at + 1)
                        scores.append(score[at])
            flat = lambda parts, t: np.concatenate(parts).astype(t) if parts else np.zeros(0, t)
            columns = [batch.column(0).take(pa.array(flat(rows, np.int64))), pa.array(names, pa.string()), pa.array(flat(places, np.int64)), pa.array(strands, pa.string()), pa.array(flat(scores, np.float64))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "motif", "position", "strand", "score"])

    return sequences.select(key, seq).mapInArrow(run, f"`{key}` {kind}, motif string, position long, strand string, score double")


def normalise_footprint(profile: DataFrame, bias: DataFrame, by: str, how: str = "subtract", value: str = "value") -> DataFrame:
    """Profile (by, offset, value) less, or divided by, the expected one (by, offset, expected); where nothing is expected, null."""
    joined = profile.join(bias.select(by, "offset", "expected"), [by, "offset"], "left")
    new = {"subtract": F.col(value) - F.col("expected"), "divide": F.col(value) / F.nullif(F.col("expected"), F.lit(0.0)), "none": F.col(value)}[how]
    return joined.withColumn("normalised", new).drop("expected")


def footprint(points: DataFrame, centers: DataFrame, by: str, flank: int = 250, norm: int = 50, smooth: int = 5) -> DataFrame:
    """Insertions by stranded offset from motif centres, per group, divided by the mean of the flanks and smoothed."""
    counts = materialise(offset_counts(points, centers, by, flank), "offsets")  # a row an offset and group, which an expected profile may read again
    ends = F.sum(F.when(F.abs("offset") > flank - norm, F.col("n"))).over(Window.partitionBy(by)) / (2 * norm)
    shaped = counts.withColumn("value", F.col("n") / F.nullif(ends, F.lit(0.0)))
    return rolling_mean(shaped, "value", "offset", smooth, [by], "smooth")


def footprint_bias(positions: DataFrame, bias: DataFrame, by: str) -> DataFrame:
    """Expected profile from (by, offset, kmer, n) and k-mer bias, with mean 1 over the offsets."""
    sums = positions.join(bias, "kmer").groupBy(by, "offset").agg((F.sum(F.col("n") * F.col("bias")) / F.sum("n")).alias("_b"))
    return sums.withColumn("expected", F.col("_b") / F.avg("_b").over(Window.partitionBy(by))).drop("_b")


def background_features(features: DataFrame, key: str, columns: list[str], k: int = 50, seed: int = 1) -> DataFrame:
    """(key, iteration, background): for each feature its k nearest others in rank quantiles of ``columns``, in a seeded random order."""
    ranked = features
    for i, c in enumerate(columns):
        ranked = rank_quantile(ranked, c, f"_q{i}")
    v = ranked.select(key, F.array(*[F.col(f"_q{i}").cast("double") for i in range(len(columns))]).alias("v"))
    near = distinct_neighbours(v, key, "v", k)  # many features have one rank in all columns
    order = Window.partitionBy("query").orderBy(F.xxhash64(F.col("query"), F.col("neighbour"), F.lit(seed)), "neighbour")
    return near.select(F.col("query").alias(key), F.row_number().over(order).alias("iteration"), F.col("neighbour").alias("background"))


def deviations(counts: DataFrame, annotation: DataFrame, background: DataFrame, key: str = "peak_id", group: str = "motif") -> DataFrame:
    """(motif, cell, deviation, z): accessibility of a motif's peaks against expectation, less that of background peaks.

    ``counts`` (key, cell, value), ``annotation`` (motif, key), ``background`` (key, iteration, background).
    Null where nothing is expected.  Of the background only the entries that are there are joined: with observed o and expected e
    in an iteration, the deviation is o / e - 1, so its sum and sum of squares over the iterations
    follow from those of o / e, to which absent entries add nothing.
    """
    sets, drawn = _drawn(annotation, background, key, group)
    of_cell = counts.groupBy("cell").agg(F.sum("value").alias("_c"))
    of_peak = counts.groupBy(key).agg(F.sum("value").alias("_p"))
    observed = counts.join(drawn, key).groupBy(group, "iteration", "cell").agg(F.sum(F.col("value") * F.col("_m")).alias("_o"))
    mine = counts.join(sets, key).groupBy(group, "cell").agg(F.sum("value").alias("_o"))
    return _deviations(sets, drawn, of_cell, of_peak, mine, observed, key, group)


def deviations_of_points(points: DataFrame, features: DataFrame, annotation: DataFrame, background: DataFrame, totals: DataFrame, key: str = "peak_id", group: str = "motif") -> DataFrame:
    """What :func:`deviations` gives for the counts of ``points`` (cell, chr, pos) in ``features`` (chr, start_pos, end_pos, key) without a ceiling.

    ``totals`` (key, total) are the points in each feature, as :func:`feature_totals` gives them.
    A set's count in a cell is the sum over the cell's points of how many of the set's features hold each, so that no entry of the matrix is made.
    """
    sets, drawn = _drawn(annotation, background, key, group)
    ranges = features.select(key, "chr", "start_pos", "end_pos")
    none = lambda c: F.lit(None).cast(drawn.schema[c].dataType).alias(c)
    every = ranges.select("*", none(group), none("iteration"), F.lit(1).cast("long").alias("_m"), F.lit(0).alias("kind"))
    own = ranges.join(sets, key).select(*ranges.columns, group, none("iteration"), "_m", F.lit(1).alias("kind"))
    of_draw = ranges.join(drawn, key).select(*ranges.columns, group, "iteration", "_m", F.lit(2).alias("kind"))
    sums = materialise(_set_depths(points, every.unionByName(own).unionByName(of_draw), group), "observed")
    of_cell = sums.where("kind = 0").select("cell", F.col("_o").alias("_c"))
    mine = sums.where("kind = 1").select(group, "cell", "_o")
    observed = sums.where("kind = 2").select(group, "iteration", "cell", "_o")
    return _deviations(sets, drawn, of_cell, totals.select(key, F.col("total").alias("_p")), mine, observed, key, group)


def feature_totals(points: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """(key, total): points in each feature that holds any; a written table."""
    found = range_counts(points.select("chr", "pos", F.lit(1).alias("one")), features, key, "one")
    return materialise(found.select(key, F.col("n").alias("total")), "totals")


def _set_depths(points: DataFrame, ranges: DataFrame, group: str, slab: int = 1 << 17, columns: int = 64) -> DataFrame:
    """(cell, kind, group, iteration, _o): for every cell and set (kind, group, iteration) the sum of ``_m`` over pairs of a point and a range of the set that holds it, where it is not 0.

    In a slab the depths of ``columns`` sets at a time are worked out at all positions, and the points of a cell add up theirs.
    """
    of = lambda c: F.floor(c / F.lit(slab))
    kinds = {"cell": points.schema["cell"].dataType.simpleString(), "group": ranges.schema[group].dataType.simpleString()}
    none = lambda k, c: F.lit(None).cast(k).alias(c)
    p = points.where(F.col("chr").isNotNull() & F.col("pos").isNotNull()).groupBy("cell", "chr", F.col("pos").cast("long").alias("a")).agg(F.count(F.lit(1)).alias("m"))
    p = p.select("chr", of(F.col("a")).alias("_slab"), "cell", none(kinds["group"], "group"), none("int", "iteration"), F.lit(-1).alias("kind"), "a", F.col("a").alias("b"), "m")
    r = ranges.where(F.col("chr").isNotNull() & (F.col("end_pos") >= F.col("start_pos")))
    r = r.select("chr", F.explode(F.sequence(of(F.col("start_pos")), of(F.col("end_pos")))).alias("_slab"), none(kinds["cell"], "cell"), F.col(group).alias("group"), F.col("iteration").cast("int").alias("iteration"), "kind", F.col("start_pos").cast("long").alias("a"), F.col("end_pos").cast("long").alias("b"), F.col("_m").alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        kind, a, b, m = (rows.column(c).to_numpy() for c in ("kind", "a", "b", "m"))
        left, right = np.flatnonzero(kind < 0), np.flatnonzero(kind >= 0)
        if not len(left) or not len(right):
            return
        coded = lambda c, at: pc.dictionary_encode(pa.concat_arrays(rows.column(c).chunks).take(pa.array(at)), null_encoding="encode")
        cells, groups, iterations = coded("cell", left), coded("group", right), coded("iteration", right)
        size = len(groups.dictionary), len(iterations.dictionary)
        names, of_set = np.unique(np.ravel_multi_index((kind[right], groups.indices.to_numpy(), iterations.indices.to_numpy()), (3, *size)), return_inverse=True)
        by_cell = cells.indices.to_numpy().argsort(kind="stable")
        code, left = cells.indices.to_numpy()[by_cell], left[by_cell]
        base = a[left[0]] // slab * slab
        place, times = a[left] - base, m[left].astype(float)[:, None]
        first, last = np.maximum(a[right] - base, 0), np.minimum(b[right] - base + 1, slab)
        edges = np.append(np.flatnonzero(np.diff(code, prepend=-1)), len(code))  # where cells begin
        for low in range(0, len(names), columns):
            here = np.flatnonzero((of_set >= low) & (of_set < low + columns))
            width = min(columns, len(names) - low)
            at, step = np.concatenate([first[here], last[here]]) * width + np.tile(of_set[here] - low, 2), m[right[here]].astype(float)
            depth = np.bincount(at, np.concatenate([step, -step]), (slab + 1) * width).reshape(-1, width)
            np.cumsum(depth, 0, out=depth)
            c = 0
            while c < len(edges) - 1:  # some cells at a time
                d = max(c + 1, int(np.searchsorted(edges, edges[c] + (1 << 15), "right")) - 1)
                part = slice(edges[c], edges[d])
                sums = np.rint(np.add.reduceat(depth[place[part]] * times[part], edges[c:d] - edges[c], 0)).astype(np.int64)
                x, y = np.nonzero(sums)
                k, g, i = np.unravel_index(names[low + y], (3, *size))
                yield pa.RecordBatch.from_arrays([cells.dictionary.take(pa.array(code[edges[c:d]][x])), pa.array(k.astype(np.int32)), groups.dictionary.take(pa.array(g)), iterations.dictionary.take(pa.array(i)), pa.array(sums[x, y])], names=["cell", "kind", "group", "iteration", "_o"])
                c = d

    met = p.unionByName(r).groupBy("chr", "_slab").applyInArrow(run, f"cell {kinds['cell']}, kind int, group {kinds['group']}, iteration int, _o bigint")
    return met.groupBy("cell", "kind", F.col("group").alias(group), "iteration").agg(F.sum("_o").alias("_o"))


def _drawn(annotation: DataFrame, background: DataFrame, key: str, group: str) -> tuple[DataFrame, DataFrame]:
    """Sets of features and, written, those drawn for them in each iteration, with how often each was drawn in ``_m``."""
    sets = annotation.select(group, key).distinct().withColumn("_m", F.lit(1).cast("long"))
    drawn = sets.join(background, key).groupBy(group, "iteration", F.col("background").alias(key)).agg(F.count(F.lit(1)).alias("_m"))  # a peak may be drawn twice
    return sets, materialise(drawn, "drawn")


def _deviations(sets: DataFrame, drawn: DataFrame, of_cell: DataFrame, of_peak: DataFrame, mine: DataFrame, observed: DataFrame, key: str, group: str) -> DataFrame:
    """Deviations from the counts of cells ``_c``, of peaks ``_p``, and of sets ``_o`` in cells."""
    total = of_peak.agg(F.sum("_p").cast("double").alias("_t"))

    def shares(sets: DataFrame, by: list[str]) -> DataFrame:
        """What part of all counts lies in each set; one row a set."""
        sums = sets.join(of_peak, key).groupBy(*by).agg(F.sum(F.col("_p") * F.col("_m")).alias("_s"))
        return sums.crossJoin(F.broadcast(total)).select(*by, (F.col("_s") / F.col("_t")).alias("_share"))  # one row

    share = shares(drawn, [group, "iteration"]).where(F.col("_share") > 0)
    rounds = share.groupBy(group).agg(F.count(F.lit(1)).alias("_k"))
    ratio = F.col("_o") / F.col("_share")
    sums = observed.join(share, [group, "iteration"]).groupBy(group, "cell").agg(F.sum(ratio).alias("_r"), F.sum(ratio * ratio).alias("_rr"))
    grid = shares(sets, [group]).join(rounds, group, "left").crossJoin(of_cell)  # the result has a row for every motif and cell
    full = grid.join(mine, [group, "cell"], "left").join(sums, [group, "cell"], "left")
    c, k = F.nullif(F.col("_c").cast("double"), F.lit(0.0)), F.col("_k")
    own = F.coalesce("_o", F.lit(0)) / (c * F.nullif(F.col("_share"), F.lit(0.0))) - 1
    mean_ratio = F.coalesce("_r", F.lit(0.0)) / c / k
    variance = (F.coalesce("_rr", F.lit(0.0)) / (c * c) - k * mean_ratio * mean_ratio) / F.nullif(k - 1, F.lit(0))
    deviation = own - (mean_ratio - 1)
    sd = F.sqrt(F.when(variance > 1e-12 * mean_ratio * mean_ratio, variance))  # null where all iterations agree
    return full.select(group, "cell", deviation.alias("deviation"), (deviation / sd).alias("z"))


def variable_deviations(z: DataFrame, group: str = "motif") -> DataFrame:
    out = z.groupBy(group).agg(F.var_samp("z").alias("variance"))
    return out.withColumn("rnk", F.row_number().over(Window.orderBy(F.col("variance").desc(), group)))  # one row a motif
