"""Merging overlapping and touching intervals of an entity into periods, and the gaps between them.

Spark's ``session_window`` does the merging: a position becomes a second, an
interval a session whose gap duration is the interval's own length.  The line
of positions of an entity is cut into slabs, so that a hot entity is merged by
many tasks; periods that cross slabs are joined from one summary row per slab.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialise


#: Widest and narrowest slab, the extent of positions that is reckoned with, and the rows that a slab of one entity should hold if it held all rows of the table.
WIDEST, NARROWEST, EXTENT, SLAB_ROWS = 1 << 24, 1 << 12, 1 << 28, 1_000_000


def slab_width(rows: int) -> int:
    """The slab of a table of ``rows`` rows: narrower for more, so that an entity with a third of them is still cut small."""
    return max(NARROWEST, min(WIDEST, EXTENT * SLAB_ROWS // max(rows, 1)))


def periods_and_gaps(df: DataFrame, keys: list[str], start: str = "start_pos", end: str = "end_pos", slab: int = WIDEST, touching: bool = True) -> DataFrame:
    """Covered periods and the gaps between successive ones, per combination of ``keys``.

    Intervals include both ends.  Those that share a position, or follow each
    other with no position between, make one ``period``; a ``gap`` holds the
    positions between two successive periods.  Result: keys, kind, start, end.
    ``slab`` bears only on how the work is cut up; see :func:`slab_width`.
    With ``touching`` false, intervals must share a position to be merged, and
    periods that only touch have no gap between them.

    Rows with a null end or key, or with the end before the start, are left
    out.  Repeated and nested rows change nothing.  Extra columns are ignored;
    an empty table gives no rows.  Positions are integers of at most 10**11.
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    rows = df.where(known & (F.col(end) >= F.col(start))).select(
        *keys, F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e")
    )
    rows = rows.withColumn("_slab", F.floor(F.col("_s") / F.lit(slab)))
    # Two seconds a position, so that a session can end between the last position and the one after it.
    length = F.expr(f"make_interval(0, 0, 0, 0, 0, 0, 2 * (_e - _s) + {2 if touching else 1})")
    session = F.session_window(F.timestamp_seconds(2 * F.col("_s")), length)
    merged = rows.groupBy(*keys, "_slab", session.alias("_w")).agg(F.min("_s").alias("_s"), F.max("_e").alias("_e")).drop("_w")
    merged = materialise(merged, "periods")

    # One row per slab: how far the slabs before it reach.
    slabs = merged.groupBy(*keys, "_slab").agg(F.max("_e").alias("_reach"))
    earlier = Window.partitionBy(*keys).orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    slabs = slabs.withColumn("_carry", F.max("_reach").over(earlier)).withColumn("_last", F.max("_reach").over(whole)).drop("_reach")

    in_slab = Window.partitionBy(*keys, "_slab").orderBy("_s")
    seen = F.max("_e").over(in_slab.rowsBetween(Window.unboundedPreceding, -1))
    heads = (
        merged.withColumn("_seen", seen)
        .join(slabs, [*keys, "_slab"])
        .withColumn("_seen", F.greatest("_seen", "_carry"))  # greatest skips nulls
        .where(F.col("_seen").isNull() | (F.col("_s") > F.col("_seen") + int(touching)))
    )
    # A period ends where its successor found the reach before it; across slabs by the first head of the next slab that has one.
    firsts = heads.groupBy(*keys, "_slab").agg(F.min_by("_seen", "_s").alias("_next_seen"))
    nexts = firsts.withColumn("_next_seen", F.lead("_next_seen").over(Window.partitionBy(*keys).orderBy("_slab")))
    out = (
        heads.withColumn("_end", F.lead("_seen").over(in_slab))
        .join(nexts, [*keys, "_slab"])
        .withColumn("_end", F.coalesce("_end", "_next_seen", "_last"))
    )
    kinds = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("_s").alias(start), F.col("_end").alias(end)),
        F.struct(F.lit("gap").alias("kind"), (F.col("_seen") + 1).alias(start), (F.col("_s") - 1).alias(end)),
    )
    return (
        out.select(*keys, F.explode(kinds).alias("_k"))
        .select(*keys, "_k.kind", f"_k.{start}", f"_k.{end}")
        .where(F.col(start) <= F.col(end))
    )
