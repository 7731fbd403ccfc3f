"""Interval algebra and interval joins. Coordinates are 1-based and closed: width = end - start + 1.

Overlap joins are binned equi-joins on (chr, bin), which Catalyst hashes and
AQE splits; no plan holds a nested loop, and no side is assumed to be small.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.periods import periods_and_gaps
from tessera.operators.skew import heavy_keys
from tessera.session import discard, materialise


def extend(df: DataFrame, upstream: int, downstream: int, strand: str = "strand") -> DataFrame:
    """Lengthen intervals along their strand; unstranded ones count as forward."""
    back = F.col(strand) == "-"
    start = F.col("start_pos") - F.when(back, downstream).otherwise(upstream)
    end = F.col("end_pos") + F.when(back, upstream).otherwise(downstream)
    return df.withColumns({"start_pos": start.cast("long"), "end_pos": end.cast("long")})


def resize(df: DataFrame, width: int, fix: str = "center", strand: str | None = None) -> DataFrame:
    """Give all intervals one width, keeping their start, end or centre (start and end along ``strand``)."""
    s, e = F.col("start_pos"), F.col("end_pos")
    back = F.col(strand) == "-" if strand else F.lit(False)
    if fix == "center":
        start = s + F.floor((e - s + 1 - width) / 2)
    else:
        at_start = ~back if fix == "start" else back
        start = F.when(at_start, s).otherwise(e - width + 1)
    return df.withColumn("_start", start.cast("long")).withColumns({"start_pos": F.col("_start"), "end_pos": F.col("_start") + width - 1}).drop("_start")


def trim(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """Clip intervals to their chromosome; those outside it, or on unknown ones, are dropped."""
    out = df.join(sizes.select("chr", "len"), "chr")
    out = out.withColumns({"start_pos": F.greatest(F.lit(1), "start_pos"), "end_pos": F.least("len", "end_pos")}).drop("len")
    return out.where(F.col("start_pos") <= F.col("end_pos"))


def tile_genome(sizes: DataFrame, width: int) -> DataFrame:
    """All tiles: tile k holds the positions p with ``p div width + 1 = k`` and is listed from ``(k - 1) * width``."""
    tiles = sizes.select("chr", F.explode(F.sequence(F.lit(1).cast("long"), F.floor(F.col("len") / width) + 1)).alias("tile"))
    return tiles.withColumn("start_pos", (F.col("tile") - 1) * width)


def gap_distance(a: str = "a", b: str = "b") -> Column:
    """Positions between two intervals of one chromosome; 0 if they overlap or touch."""
    between = F.greatest(F.col(f"{b}.start_pos") - F.col(f"{a}.end_pos"), F.col(f"{a}.start_pos") - F.col(f"{b}.end_pos")) - 1
    return F.greatest(F.lit(0), between).cast("long")


def reduce_ranges(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Merge overlapping intervals of a chromosome; intervals that only touch stay apart."""
    merged = periods_and_gaps(df, keys or ["chr"], touching=False)
    return merged.where(F.col("kind") == "period").drop("kind")


def _bins(df: DataFrame, width: int, slack: int = 0) -> DataFrame:
    first, last = F.floor((F.col("start_pos") - slack) / width), F.floor((F.col("end_pos") + slack) / width)
    return df.withColumn("_first", first).withColumn("_bin", F.explode(F.sequence(first, last)))


def overlap_pairs(left: DataFrame, right: DataFrame, bin_width: int = 4096, within: bool = False, slack: int = 0) -> DataFrame:
    """Rows (a, b) of two interval tables whose intervals share a position (or lie within ``slack`` of each other).

    Both sides are exploded into bins and joined on (chr, bin); a pair found in
    several bins is kept in the first bin they share.  With ``within``, a must lie inside b.
    """
    a = _bins(left.select("chr", "start_pos", "end_pos", F.struct(*left.columns).alias("a")), bin_width, slack)
    b = _bins(right.select("chr", "start_pos", "end_pos", F.struct(*right.columns).alias("b")), bin_width)
    a = a.select("chr", "_bin", "a", F.col("_first").alias("_fa"))
    b = b.select("chr", "_bin", "b", F.col("_first").alias("_fb"))
    if within:
        test = (F.col("a.start_pos") >= F.col("b.start_pos")) & (F.col("a.end_pos") <= F.col("b.end_pos"))
    else:
        test = (F.col("a.start_pos") - slack <= F.col("b.end_pos")) & (F.col("a.end_pos") + slack >= F.col("b.start_pos"))
    return a.join(b, ["chr", "_bin"]).where(test & (F.col("_bin") == F.greatest("_fa", "_fb"))).select("a", "b")


def many_overlap_pairs(left: DataFrame, right: DataFrame, bin_width: int = 512, heavy_rows: int = 20_000, salts: int = 16) -> DataFrame:
    """The rows (a, b) of :func:`overlap_pairs`, for results that are far larger than both tables.

    Of two intervals that overlap either a begins in b, or b begins in a and behind its start.  So each pair is found
    once, in the bin of that start, and few others are looked at if bins are not wider than the intervals usually are.
    Columns travel one by one, so that those nobody asks for don't; the number of tasks goes by the cores and not by the
    bytes shuffled, which are few for the pairs that come of them.  Bins that hold many rows of a side are cut by hash.
    """
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    key = ["_chr", "_bin"]

    def named(df: DataFrame, side: str) -> DataFrame:
        return df.select(F.col("chr").alias("_chr"), *[F.col(c).alias(f"_{side}_{c}") for c in df.columns])

    def at(df: DataFrame, side: str) -> DataFrame:
        return df.withColumn("_bin", F.floor(F.col(f"_{side}_start_pos") / bin_width))

    def over(df: DataFrame, side: str) -> DataFrame:
        start, end = F.col(f"_{side}_start_pos"), F.col(f"_{side}_end_pos")
        return df.where(start <= end).withColumn("_bin", F.explode(F.sequence(F.floor(start / bin_width), F.floor(end / bin_width))))

    def met(a: DataFrame, b: DataFrame, test: Column) -> DataFrame:
        heavy = {side: F.broadcast(heavy_keys(df, key, heavy_rows).select(*key, F.lit(True).alias(f"_heavy_{side}"))) for side, df in (("a", a), ("b", b))}

        def cut(df: DataFrame, own: str, other: str) -> DataFrame:
            row = [c for c in df.columns if c not in key]
            marked = df.join(heavy[own], key, "left").join(heavy[other], key, "left")
            marked = marked.withColumn(f"_part_{own}", F.when(F.col(f"_heavy_{own}"), F.pmod(F.xxhash64(*row), F.lit(salts))).otherwise(0).cast("int"))
            every = F.when(F.col(f"_heavy_{other}"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
            return marked.withColumn(f"_part_{other}", F.explode(every)).select(*key, "_part_a", "_part_b", *row).repartition(tasks, *key, "_part_a", "_part_b")

        return cut(a, "a", "b").join(cut(b, "b", "a").hint("merge"), [*key, "_part_a", "_part_b"]).where(test)

    a, b = named(left, "a"), named(right, "b")
    test = (F.col("_a_start_pos") <= F.col("_b_end_pos")) & (F.col("_a_end_pos") >= F.col("_b_start_pos"))
    behind = F.col("_b_start_pos") > F.col("_a_start_pos")
    a_in_b, b_in_a = met(at(a, "a"), over(b, "b"), test & ~behind), met(over(a, "a"), at(b, "b"), test & behind)
    return a_in_b.unionByName(b_in_a).select(*[F.struct(*[F.col(f"_{side}_{c}").alias(c) for c in df.columns]).alias(side) for side, df in (("a", left), ("b", right))])


def overlap_join(left: DataFrame, right: DataFrame, how: str = "inner", bin_width: int = 4096, within: bool = False) -> DataFrame:
    """Interval join: ``inner`` gives structs a and b, ``semi`` and ``anti`` the rows of ``left`` with or without a partner.

    Semi and anti join decide per distinct interval of ``left``, not per bin, so
    repeated rows are kept and an interval that crosses bins is reported once.
    """
    if how == "inner":
        return overlap_pairs(left, right, bin_width, within)
    merged = right.select("chr", "start_pos", "end_pos").distinct() if within else reduce_ranges(right)
    hits = overlap_pairs(left.select("chr", "start_pos", "end_pos").distinct(), merged, bin_width, within)
    keys = hits.select("a.chr", "a.start_pos", "a.end_pos").distinct()
    return left.join(keys, ["chr", "start_pos", "end_pos"], f"left_{how}").select(*left.columns)


def point_join(points: DataFrame, ranges: DataFrame, bin_width: int = 512, pos: str = "pos") -> DataFrame:
    """Points (chr, pos, ...) with every interval that holds them; columns of both sides, of intervals those without chr.

    ``bin_width`` should be near the usual width of the intervals: a point meets all intervals of its bin.
    """
    rest = [c for c in ranges.columns if c != "chr"]
    r = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start_pos") / bin_width), F.floor(F.col("end_pos") / bin_width))))
    p = points.withColumn("_bin", F.floor(F.col(pos) / bin_width))
    return p.join(r.select("chr", "_bin", *rest), ["chr", "_bin"]).where(F.col(pos).between(F.col("start_pos"), F.col("end_pos"))).drop("_bin")


#: Pairs that are listed at once where points and centres are few, and centres of a row of the product where they are many.
LISTED, ROW = 1 << 22, 256
#: Pairs of a point and a range that a task counts at once.
HELD = 1 << 20


def _pairs_by_offset(centers: np.ndarray, m: np.ndarray, pos: np.ndarray, n: np.ndarray, flank: int, slab: int) -> np.ndarray:
    """Sum of m * n over the pairs of a centre and a point at each offset from -flank to flank; both sorted, the centres from a slab of positions."""
    sums = np.zeros(2 * flank + 1)
    lo, hi = np.searchsorted(pos, centers - flank), np.searchsorted(pos, centers + flank, "right")
    upto = np.cumsum(hi - lo)
    if upto[-1] < slab * flank / 64:  # few pairs are listed
        a = 0
        while a < len(centers):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + LISTED, "right")))
            size = (hi - lo)[a:b]
            c = np.repeat(np.arange(a, b), size)
            at = np.arange(len(c)) - np.repeat(np.cumsum(size) - size, size) + lo[c]
            sums += np.bincount(pos[at] - centers[c] + flank, (m[c] * n[at]).astype(float), 2 * flank + 1)
            a = b
        return sums
    # Many pairs are never listed: the lines of positions are multiplied row by row; whole numbers below 2^53 are exact.
    start = centers[0] // slab * slab
    line, points = np.zeros(slab), np.zeros(slab + 2 * flank)
    line[centers - start] = m
    inside = (pos >= start - flank) & (pos < start + slab + flank)
    points[pos[inside] - (start - flank)] = n[inside]
    rows = np.lib.stride_tricks.sliding_window_view(points, ROW + 2 * flank)[::ROW]
    product = np.ascontiguousarray(line.reshape(-1, ROW).T @ rows)
    step = product.strides
    return np.lib.stride_tricks.as_strided(product, (ROW, 2 * flank + 1), (step[0] + step[1], step[1])).sum(0)


def offset_counts(points: DataFrame, centers: DataFrame, by: str, flank: int, slab: int = 1 << 16) -> DataFrame:
    """(by, offset, n): pairs of a point (by, chr, pos) and a centre (chr, pos, strand) at most ``flank`` apart, by offset turned to the strand.

    Equal points and equal centres are counted first, so that a slab holds at most one row a position (and value of ``by``), however many there are;
    no pair is joined: a slab's points and centres meet as two lines of counts.
    """
    kind = points.schema[by].dataType.simpleString()
    whole = lambda df: df.where(F.col("chr").isNotNull() & F.col("pos").isNotNull())
    of = lambda c: F.floor(c / F.lit(slab))
    p = whole(points.select(F.col(by).alias("by"), "chr", F.col("pos").cast("long").alias("pos"))).groupBy("by", "chr", "pos").agg(F.count(F.lit(1)).alias("n"))
    p = p.withColumn("_slab", F.explode(F.sequence(of(F.col("pos") - flank), of(F.col("pos") + flank))))
    side = F.when(F.col("strand") == "-", -1).otherwise(1)
    c = whole(centers.select("chr", F.col("pos").cast("long").alias("pos"), side.alias("side"))).groupBy("chr", "pos", "side").agg(F.count(F.lit(1)).alias("m"))
    c = c.withColumn("_slab", of(F.col("pos")))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            names = pc.dictionary_encode(left.column("by").combine_chunks(), null_encoding="encode")
            code, pos, n = names.indices.to_numpy(zero_copy_only=False), left.column("pos").to_numpy(), left.column("n").to_numpy()
            at, side, m = (right.column(x).to_numpy() for x in ("pos", "side", "m"))
            order = np.lexsort((pos, code))
            code, pos, n = code[order], pos[order], n[order]
            edges = np.searchsorted(code, np.arange(len(names.dictionary) + 1))
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                sums = np.zeros(2 * flank + 1)
                for s in (1, -1):
                    here = np.flatnonzero(side == s)
                    if len(here):
                        here = here[at[here].argsort()]
                        sums += _pairs_by_offset(at[here], m[here], pos[a:b], n[a:b], flank, slab)[::s]
                some = np.flatnonzero(sums)
                found.append((names.dictionary.take(pa.array(np.full(len(some), k))), some - flank, np.rint(sums[some]).astype(np.int64)))
        columns = [pa.concat_arrays([x[0] for x in found]), *[pa.array(np.concatenate([x[i] for x in found]).astype(np.int64)) for i in (1, 2)]] if found else [left.column("by").slice(0, 0), pa.array([], pa.int64()), pa.array([], pa.int64())]
        return pa.table(columns, names=["by", "offset", "n"])

    met = p.groupBy("chr", "_slab").cogroup(c.groupBy("chr", "_slab")).applyInArrow(run, f"by {kind}, offset bigint, n bigint")
    return met.groupBy(F.col("by").alias(by), "offset").agg(F.sum("n").alias("n"))


def point_depth(points: DataFrame, ranges: DataFrame, width: int = 512) -> DataFrame:
    """``points`` (chr, pos, ...) with ``depth``, how many of ``ranges`` hold each of them, 0 where none does.

    The depth is worked out once for every position of a bin that a range reaches, so that a point meets one row, however many ranges hold it.
    """
    of = lambda c: F.floor(F.col(c) / F.lit(width))
    r = ranges.where(F.col("end_pos") >= F.col("start_pos")).select("chr", "start_pos", "end_pos", F.explode(F.sequence(of("start_pos"), of("end_pos"))).alias("_bin"))
    first = F.col("_bin") * width
    steps = F.array(F.struct(F.greatest(F.col("start_pos") - first, F.lit(0)).alias("at"), F.lit(1).alias("d")), F.struct((F.col("end_pos") + 1 - first).alias("at"), F.lit(-1).alias("d")))
    r = r.select("chr", "_bin", F.explode(steps).alias("_s")).groupBy("chr", "_bin", F.col("_s.at").alias("_at")).agg(F.sum("_s.d").alias("_d")).where(F.col("_at") < width)
    order = Window.partitionBy("chr", "_bin").orderBy("_at")
    r = r.select("chr", "_bin", "_at", (F.lead("_at", 1, width).over(order) - F.col("_at")).cast("int").alias("_n"), F.sum("_d").over(order).alias("_depth"))
    r = r.groupBy("chr", "_bin").agg(F.sort_array(F.collect_list(F.struct("_at", "_n", "_depth"))).alias("_s"))  # a bin has at most `width` of them
    r = r.select("chr", "_bin", F.col("_s")[0]["_at"].alias("_from"), F.flatten(F.transform("_s", lambda x: F.array_repeat(x["_depth"], x["_n"]))).alias("_depths"))
    p = points.withColumn("_bin", of("pos")).join(r.hint("shuffle_hash"), ["chr", "_bin"], "left")
    at = (F.col("pos") - F.col("_bin") * width - F.col("_from")).cast("int")
    return p.select(*[F.col(c) for c in points.columns], F.coalesce(F.get("_depths", at), F.lit(0).cast("long")).alias("depth"))


def range_counts(points: DataFrame, ranges: DataFrame, key: str, by: str, slab: int = 1 << 16) -> DataFrame:
    """(key, by, n): how many points (by, chr, pos) each range (chr, start_pos, end_pos, key) holds, where it holds any.

    Equal points are counted first; a range takes the difference of two running counts, so that no pair is joined. A range over several slabs adds their counts.
    """
    kinds = f"key {ranges.schema[key].dataType.simpleString()}, by {points.schema[by].dataType.simpleString()}, n bigint"
    of = lambda c: F.floor(F.col(c) / F.lit(slab))
    p = points.where(F.col("chr").isNotNull() & F.col("pos").isNotNull()).select(F.col(by).alias("by"), "chr", F.col("pos").cast("long").alias("pos"))
    p = p.groupBy("by", "chr", "pos").agg(F.count(F.lit(1)).alias("n")).withColumn("_slab", of("pos"))
    r = ranges.where(F.col("chr").isNotNull() & (F.col("end_pos") >= F.col("start_pos"))).select("chr", *[F.col(c).cast("long").alias(c) for c in ("start_pos", "end_pos")], F.col(key).alias("key"))
    r = r.withColumn("_slab", F.explode(F.sequence(of("start_pos"), of("end_pos"))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = pc.dictionary_encode(left.column("by").combine_chunks(), null_encoding="encode")
        code, pos, n = names.indices.to_numpy(zero_copy_only=False), left.column("pos").to_numpy(), left.column("n").to_numpy()
        start, end = right.column("start_pos").to_numpy(), right.column("end_pos").to_numpy()
        order = np.lexsort((pos, code))
        code, pos, upto = code[order], pos[order], np.concatenate([[0], np.cumsum(n[order])])
        edges = np.searchsorted(code, np.arange(len(names.dictionary) + 1))
        rows, of_by, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            inside = upto[a + np.searchsorted(pos[a:b], end, "right")] - upto[a + np.searchsorted(pos[a:b], start)]
            some = np.flatnonzero(inside)
            rows.append(some)
            of_by.append(np.full(len(some), k))
            sums.append(inside[some])
        columns = [right.column("key").combine_chunks().take(pa.array(np.concatenate(rows))), names.dictionary.take(pa.array(np.concatenate(of_by))), pa.array(np.concatenate(sums).astype(np.int64))]
        return pa.table(columns, names=["key", "by", "n"])

    met = p.groupBy("chr", "_slab").cogroup(r.groupBy("chr", "_slab")).applyInArrow(run, kinds)
    return met.groupBy(F.col("key").alias(key), F.col("by").alias(by)).agg(F.sum("n").alias("n"))


#: Rows that a task packs at once.
PACKED = 1 << 20


def pack_rows(rows: pa.Table, chroms: pa.Array, code: np.ndarray, slab: np.ndarray) -> pa.RecordBatch:
    """(chr, _slab, pack): ``rows``, sorted by (code, slab), as one compressed Arrow stream for each of these; ``code`` is the place of their chromosome in ``chroms``."""
    head = np.flatnonzero((code != np.roll(code, 1)) | (slab != np.roll(slab, 1)) | (np.arange(len(code)) == 0))
    packs, options = [], pa.ipc.IpcWriteOptions(compression="zstd")
    for a, b in zip(head, [*head[1:], len(code)]):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
            out.write_table(rows.slice(a, b - a))
        packs.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([chroms.take(pa.array(code[head])).cast(pa.string()), pa.array(slab[head].astype(np.int64)), pa.array(packs, pa.binary())], names=["chr", "_slab", "pack"])


def unpacked(packs: pa.ChunkedArray) -> pa.Table:
    """The rows of some packs."""
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in packs]).combine_chunks()


def packed(df: DataFrame, slab: int, before: int = 0, counted: str | None = None) -> DataFrame:
    """(chr, _slab, pack): the rows of ``df`` (chr, pos, ...) by the slabs of a chromosome's positions, many in a row, so that they are shuffled at a few bytes each; none may have a null chr or pos.

    Rows within ``before`` of a slab's start also go to the slabs before. With ``counted`` a task's equal rows (chr, pos, counted) come once, with their number ``n``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in _and_none(batches):
            if batch is not None:
                held.append(batch)
            if not held or batch is not None and sum(x.num_rows for x in held) < PACKED:
                continue
            rows, held = pa.Table.from_batches(held).combine_chunks(), []
            if not rows.num_rows:
                continue
            chroms = pc.dictionary_encode(rows.column("chr").combine_chunks())
            rows = rows.drop_columns(["chr"])
            code, pos, rank = chroms.indices.to_numpy(), rows.column("pos").to_numpy(), np.zeros(rows.num_rows, np.int64)
            if counted is not None:
                names = pc.dictionary_encode(rows.column(counted).combine_chunks(), null_encoding="encode")
                place = np.empty(len(names.dictionary), np.int64)
                place[pc.sort_indices(names.dictionary).to_numpy()] = np.arange(len(place))
                rank = place[names.indices.to_numpy()]
                order = np.lexsort((pos, rank, code))
                code, pos, rank = code[order], pos[order], rank[order]
                head = np.flatnonzero((code != np.roll(code, 1)) | (pos != np.roll(pos, 1)) | (rank != np.roll(rank, 1)) | (np.arange(len(pos)) == 0))
                rows = rows.take(pa.array(order[head])).append_column("n", pa.array(np.diff(head, append=len(pos)).astype(np.int64)))
                code, pos, rank = code[head], pos[head], rank[head]
            first = (pos - before) // slab
            size = pos // slab - first + 1
            row = np.repeat(np.arange(len(pos)), size)
            at = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            order = np.lexsort((pos[row], rank[row], at, code[row]))
            yield pack_rows(rows.take(pa.array(row[order])), chroms.dictionary, code[row[order]], at[order])

    return df.mapInArrow(run, "chr string, _slab bigint, pack binary")


def _and_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def by_slab(df: DataFrame) -> DataFrame:
    """``df`` (chr, _slab, ...) dealt to tasks by slab; their number goes by the cores and not by the bytes, which are few for what comes of packs."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism), "chr", "_slab")


def several_or_long(ranges: DataFrame, key: str, reach: int) -> tuple[bool, bool]:
    """Whether a key has several of ``ranges``, and whether one is longer than ``reach``."""
    long = (F.col("end_pos") - F.col("start_pos") >= reach).cast("int")
    count = ranges.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(long).alias("long")).agg(F.max("n").alias("n"), F.max("long").alias("long")).first()
    return (count["n"] or 0) > 1, bool(count["long"])


def held_counts(points: DataFrame, ranges: DataFrame, key: str, by: str, slab: int = 1 << 16, reach: int = 1 << 13) -> DataFrame:
    """(key, by, n): the same as :func:`range_counts`, for many values of ``by``: rows come out whole where a range and its points meet, and are not shuffled.

    Points and ranges are shuffled once, in packs. Points within ``reach`` of a slab's start also go to the slab before, so that ranges of at most that length are whole in one.
    Longer ranges are joined point by point and counted in a shuffle, as are all where a key has several ranges.
    """
    points = points.where(F.col("chr").isNotNull() & F.col("pos").isNotNull()).select(F.col(by).alias("by"), "chr", F.col("pos").cast("long").alias("pos"))
    ranges = ranges.where(F.col("chr").isNotNull() & (F.col("end_pos") >= F.col("start_pos"))).select("chr", *[F.col(c).cast("long").alias(c) for c in ("start_pos", "end_pos")], F.col(key).alias("key"))
    short = F.col("end_pos") - F.col("start_pos") < reach
    several, long = several_or_long(ranges, "key", reach)
    joined = lambda r: point_join(points, r).groupBy("key", "by").agg(F.count(F.lit(1)).alias("n"))
    named = lambda df: df.select(F.col("key").alias(key), F.col("by").alias(by), "n")
    if several:
        return named(joined(ranges))
    kinds = {"key": ranges.schema["key"].dataType.simpleString(), "by": points.schema["by"].dataType.simpleString()}
    p = packed(points, slab, reach, "by").withColumn("point", F.lit(True))
    r = packed(ranges.where(short).select("chr", F.col("start_pos").alias("pos"), "end_pos", "key"), slab).withColumn("point", F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        packs, point = rows.column("pack"), rows.column("point")
        if not pc.any(point).as_py() or pc.all(point).as_py():
            return
        left, right = unpacked(packs.filter(point)), unpacked(packs.filter(pc.invert(point)))
        names = pc.dictionary_encode(left.column("by").combine_chunks(), null_encoding="encode")
        pos = left.column("pos").to_numpy()
        order = pos.argsort()
        code, pos, n = names.indices.to_numpy()[order].astype(np.int64), pos[order], left.column("n").to_numpy()[order]
        start, end = right.column("pos").to_numpy(), right.column("end_pos").to_numpy()
        keys, at = right.column("key").combine_chunks(), start.argsort()
        lo, hi = np.searchsorted(pos, start[at]), np.searchsorted(pos, end[at], "right")
        at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
        size, upto, of_by, once = hi - lo, np.cumsum(hi - lo), len(names.dictionary), n.max() == 1
        first = 0
        while first < len(at):  # some ranges at a time, so that what is held at once does not grow with the slab
            last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + HELD, "right")))
            some = size[first:last]
            row = np.repeat(np.arange(last - first), some)
            place = np.arange(len(row)) - np.repeat(np.cumsum(some) - some, some) + lo[first + row]
            pair = row * of_by + code[place]
            if once:
                pair.sort()
            else:
                by_pair = pair.argsort()
                pair, place = pair[by_pair], place[by_pair]
            head = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            sums = np.diff(head, append=len(pair)) if once else np.add.reduceat(n[place], head)
            row, value = np.divmod(pair[head], of_by)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(at[first + row])), names.dictionary.take(pa.array(value)), pa.array(sums.astype(np.int64))], names=["key", "by", "n"])
            first = last

    whole = by_slab(p.unionByName(r)).groupBy("chr", "_slab").applyInArrow(run, f"key {kinds['key']}, by {kinds['by']}, n bigint")
    return named(whole.unionByName(joined(ranges.where(~short))) if long else whole)


def nearest_point(df: DataFrame, points: DataFrame, key: str, at: Column, name: str, slab: int = 1 << 18) -> DataFrame:
    """``df`` with ``distance`` to the nearest of ``points`` (chr, pos, ``name``) from ``at``, and its name; ties go to the smaller position, then name.

    An as-of join in both directions: within slabs of each chromosome points and queries are ordered
    together and the last and next point are carried by a window; the last point before and the first
    after a slab come from one summary row per slab.  No pair is ever enumerated, and
    both windows run from their start, which Spark does in one pass.
    """
    lowest = points.groupBy("chr", "pos").agg(F.min(name).alias("_name"))
    p = lowest.select("chr", F.col("pos").alias("_at"), F.lit(0).alias("_q"), F.struct("pos", "_name").alias("_p"), F.lit(None).cast(df.schema[key].dataType).alias(key))
    q = df.select("chr", at.cast("long").alias("_at"), F.lit(1).alias("_q"), F.lit(None).cast(p.schema["_p"].dataType).alias("_p"), key)
    both = p.unionByName(q).withColumn("_slab", F.floor(F.col("_at") / slab))
    slabs = both.groupBy("chr", "_slab").agg(F.min("_p").alias("_lo"), F.max("_p").alias("_hi"))
    up, down = Window.partitionBy("chr").orderBy("_slab"), Window.partitionBy("chr").orderBy(F.col("_slab").desc())
    slabs = slabs.select(
        "chr", "_slab",
        F.last("_hi", True).over(up.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.last("_lo", True).over(down.rowsBetween(Window.unboundedPreceding, -1)).alias("_after"),
    )
    upward = Window.partitionBy("chr", "_slab").orderBy("_at", "_q").rowsBetween(Window.unboundedPreceding, 0)
    downward = Window.partitionBy("chr", "_slab").orderBy(F.col("_at").desc(), "_q").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_l", F.last("_p", True).over(upward)).withColumn("_r", F.last("_p", True).over(downward))
    both = both.where("_q = 1").join(slabs, ["chr", "_slab"])
    both = both.withColumn("_left", F.coalesce("_l", "_before")).withColumn("_right", F.coalesce("_r", "_after"))
    dl, dr = F.col("_at") - F.col("_left.pos"), F.col("_right.pos") - F.col("_at")
    use_left = F.col("_right").isNull() | (dl <= dr)
    near = both.select(key, F.when(use_left, dl).otherwise(dr).cast("long").alias("distance"), F.when(use_left, F.col("_left._name")).otherwise(F.col("_right._name")).alias(name))
    return df.join(near, key, "left")


def overlap_runs(df: DataFrame, slab: int = 1 << 24) -> DataFrame:
    """``df`` with ``_run``: the first position of the run of overlapping intervals that a row is in.

    The line of a chromosome is cut into slabs, so that no chromosome is one task; how far the slabs before
    reach, and which run was the last to begin there, comes from one summary row a slab.
    """
    rows = df.withColumn("_slab", F.floor(F.col("start_pos") / F.lit(slab)))
    earlier = Window.partitionBy("chr").orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
    reach = rows.groupBy("chr", "_slab").agg(F.max("end_pos").alias("_reach")).withColumn("_reach", F.max("_reach").over(earlier))
    inside = Window.partitionBy("chr", "_slab").orderBy("start_pos", "end_pos")
    seen = F.max("end_pos").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_seen", seen).join(reach, ["chr", "_slab"])
    head = F.greatest("_seen", "_reach")  # greatest skips nulls
    rows = rows.withColumn("_head", F.when(head.isNull() | (F.col("start_pos") > head), F.col("start_pos"))).drop("_seen", "_reach")
    rows = materialise(rows, "heads")
    begun = rows.groupBy("chr", "_slab").agg(F.max("_head").alias("_begun")).withColumn("_begun", F.max("_begun").over(earlier))
    run = F.coalesce(F.max("_head").over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("_begun"))
    return rows.join(begun, ["chr", "_slab"]).withColumn("_run", run).drop("_head", "_begun", "_slab")


def _first_come(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``_id`` of the intervals of each run that are taken when its rows come in ``order`` and those that overlap one taken are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, starts, ends = None, [], []
        for batch in batches:
            kept = []
            for key, start, end, number in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), *[batch.column(k).to_pylist() for k in (2, 3, 4)]):
                if key != at:
                    at, starts, ends = key, [], []
                k = bisect_right(starts, end)  # the last one taken that begins before this one ends
                if k == 0 or ends[k - 1] < start:
                    starts.insert(k, start)
                    ends.insert(k, end)
                    kept.append(number)
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64())], names=["_id"])

    sorted_ = rows.repartition("chr", "_run").sortWithinPartitions("chr", "_run", *order)
    return sorted_.select("chr", "_run", "start_pos", "end_pos", "_id").mapInArrow(run, "_id bigint")


def non_overlapping(df: DataFrame, score: str = "score", ties: list[str] | None = None, run_rows: int = 500_000, rounds: int = 20) -> DataFrame:
    """The intervals kept by taking the best score again and again and dropping what overlaps it.

    Equal scores are decided by position, then ``ties``; null scores come last.  The intervals are cut into runs of overlapping
    ones, which don't touch each other, and each run is gone through once in order of score; intervals that are a run by themselves are kept at once.
    A run of more than ``run_rows`` intervals is thinned out first: those that beat everything they overlap
    are taken, all at once, and what they overlap goes, which breaks the run up; after ``rounds`` rounds what is left of it is
    gone through whatever its length, in one task, which holds only the intervals taken.
    """
    rows = materialise(df.withColumn("_id", F.monotonically_increasing_id()), "overlap")  # written, so the numbers stay
    names = ["start_pos", "end_pos", *(ties or [])]
    rest = rows.select("chr", F.col(score).alias("_score"), *dict.fromkeys(names), "_id").where(F.col("chr").isNotNull() & (F.col("end_pos") >= F.col("start_pos")))
    order = [F.col("_score").desc_nulls_last(), *[F.col(c).asc_nulls_first() for c in [*names, "_id"]]]
    kept: DataFrame | None = None
    add = lambda found: found if kept is None else kept.unionByName(found)
    for k in range(rounds + 1):
        placed = materialise(overlap_runs(rest), "runs")
        size = materialise(placed.groupBy("chr", "_run").agg(F.count(F.lit(1)).alias("_n")), "sizes")
        alone = placed.join(size.where(F.col("_n") == 1), ["chr", "_run"], "left_semi").select("_id")
        some = placed.join(size.where((F.col("_n") > 1) & ((F.col("_n") <= run_rows) | F.lit(k == rounds))), ["chr", "_run"], "left_semi")
        kept = add(materialise(alone.unionByName(_first_come(some, order)), "kept"))
        long = size.where(F.col("_n") > run_rows)
        if k == rounds or not long.limit(1).count():
            break
        side = placed.join(long, ["chr", "_run"], "left_semi").drop("_run")
        rank = F.struct((-F.col("_score")).isNull().alias("n"), (-F.col("_score")).alias("s"), *[F.col(c).alias(f"t{i}") for i, c in enumerate([*names, "_id"])])
        side = materialise(side.withColumn("_rank", rank), "long")
        pairs = overlap_pairs(side.select("chr", "start_pos", "end_pos", "_rank", "_id"), side.select("chr", "start_pos", "end_pos", "_rank", "_id"))
        beaten = pairs.where(F.col("b._rank") < F.col("a._rank")).select(F.col("a._id").alias("_id")).distinct()
        best = materialise(side.join(beaten, "_id", "left_anti").select("chr", "start_pos", "end_pos", "_id"), "best")
        kept = add(best.select("_id"))
        gone = overlap_pairs(side.select("chr", "start_pos", "end_pos", "_id"), best).select("a._id").distinct()
        rest = materialise(side.join(gone, "_id", "left_anti").drop("_rank"), "rest")
        for t in (side, placed, size):
            discard(t)
    return rows.join(kept, "_id", "left_semi").select(*df.columns)


def pairs_within(df: DataFrame, key: str, distance: int, at: str = "center") -> DataFrame:
    """Pairs (id1 < id2) of one chromosome whose ``at`` positions differ by at most ``distance``."""
    left = df.select("chr", F.col(key).alias("id1"), F.col(at).alias("_p1"), F.floor(F.col(at) / distance).alias("_bin"))
    right = df.select("chr", F.col(key).alias("id2"), F.col(at).alias("_p2"), F.explode(F.array(*[F.floor(F.col(at) / distance) + k for k in (-1, 0, 1)])).alias("_bin"))
    return left.join(right, ["chr", "_bin"]).where((F.abs(F.col("_p1") - F.col("_p2")) <= distance) & (F.col("id1") < F.col("id2"))).select(
        "chr", "id1", "id2", F.abs(F.col("_p1") - F.col("_p2")).cast("long").alias("distance")
    )


def loops(df: DataFrame, resolution: int, value: str) -> DataFrame:
    """Intervals from one anchor to another on a grid of ``resolution``, keeping the greatest value; empty ones are dropped."""
    snap = lambda c: (F.floor(F.col(c) / resolution) * resolution + resolution // 2).cast("long")
    out = df.select("chr", F.least(snap("pos1"), snap("pos2")).alias("start_pos"), F.greatest(snap("pos1"), snap("pos2")).alias("end_pos"), value)
    return out.where(F.col("start_pos") < F.col("end_pos")).groupBy("chr", "start_pos", "end_pos").agg(F.max(value).alias(value))


def standard_chromosomes(df: DataFrame, remove: list[str] | None = None, column: str = "chr") -> DataFrame:
    """Rows of chromosomes whose name begins with chr and holds no underscore, less those of ``remove``."""
    keep = F.col(column).startswith("chr") & ~F.col(column).contains("_")
    return df.where(keep & ~F.col(column).isin(remove) if remove else keep)


def convert_seqnames(column: str, prefix: bool) -> Column:
    """The name with or without the prefix chr."""
    bare = F.regexp_replace(column, "^chr", "")
    return F.concat(F.lit("chr"), bare) if prefix else bare


def annotate_peaks(peaks: DataFrame, genes: DataFrame, exons: DataFrame, key: str = "peak_id", promoter: tuple[int, int] = (2000, 100)) -> DataFrame:
    """Peaks with the nearest gene start and type: Promoter before Exonic before Intronic before Distal."""
    starts = genes.select("chr", F.when(F.col("strand") == "-", F.col("end_pos")).otherwise(F.col("start_pos")).alias("pos"), "symbol", "strand")
    center = F.floor((F.col("start_pos") + F.col("end_pos")) / 2)
    near = nearest_point(peaks, starts.select("chr", "pos", "symbol"), key, center, "symbol")
    promoters = extend(starts.select("chr", F.col("pos").alias("start_pos"), F.col("pos").alias("end_pos"), "strand"), *promoter)
    marks = {}
    for name, regions in (("_p", promoters), ("_e", exons), ("_g", genes)):
        marks[name] = overlap_join(peaks, regions, "semi").select(key).distinct().withColumn(name, F.lit(True))
    out = reduce(lambda a, m: a.join(m, key, "left"), marks.values(), near)
    kind = F.when(F.col("_p"), "Promoter").when(F.col("_g") & F.col("_e"), "Exonic").when(F.col("_g"), "Intronic").otherwise("Distal")
    return out.withColumn("peak_type", kind).drop(*marks)
