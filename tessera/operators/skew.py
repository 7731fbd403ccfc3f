"""Results per key when a few keys hold most rows: two-stage salted aggregation.

Heavy keys are found by one map-side-combined count.  They get a salt, so that
their rows spread over many tasks; partial results are computed per (key, salt)
and merged by the original key.  Light keys keep salt 0 and cost nothing more.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: No more than this many keys can be called heavy, which bounds what is broadcast.
MAX_HEAVY = 1000


def heavy_keys(df: DataFrame, keys: list[str], min_rows: int = 20_000, max_heavy: int = MAX_HEAVY) -> DataFrame:
    """The keys with more than ``max(min_rows, rows / max_heavy)`` rows, with their count in ``_heavy``.

    By that threshold there can be at most ``max_heavy`` of them, whatever the
    data, so the result may be broadcast.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_heavy"))
    total = counts.agg(F.sum("_heavy").alias("_total"))
    return (
        counts.where(F.col("_heavy") > min_rows)
        .crossJoin(F.broadcast(total))  # one row
        .where(F.col("_heavy") * max_heavy > F.col("_total"))
        .drop("_total")
    )


def with_salt(df: DataFrame, keys: list[str], salt: Column, **kw) -> DataFrame:
    """``df`` with a column ``_salt``: ``salt`` for rows of heavy keys, 0 for the others. Null keys are keys."""
    heavy = heavy_keys(df, keys, **kw).select(*[F.col(k).alias(f"_h_{k}") for k in keys], "_heavy")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys])
    return (
        df.join(F.broadcast(heavy), same, "left")
        .withColumn("_salt", F.when(F.col("_heavy").isNotNull(), salt).otherwise(F.lit(0)).cast("long"))
        .drop("_heavy", *[f"_h_{k}" for k in keys])
    )


def salted_aggregate(df: DataFrame, keys: list[str], measures: dict[str, tuple[str, Column]], salts: int = 64, **kw) -> DataFrame:
    """Aggregate ``measures`` per key in two stages.

    ``measures`` maps an output name to ``(kind, column)`` with kind one of
    ``count sum min max avg distinct``.  All kinds but ``distinct`` merge from one number
    (``avg``: two) per salt; ``distinct`` salts by the value itself, so that the
    salts hold disjoint values and their counts add up.

    Nulls in a measure are skipped; a key whose values are all null gets count 0
    and null for the rest.  A null key is a group of its own.  An empty table
    gives no rows.  Repeated rows count as often as they occur.
    """
    plain = {n: m for n, m in measures.items() if m[0] != "distinct"}
    pieces: list[DataFrame] = []
    if plain or not measures:
        # Equal rows of a partition are combined before the shuffle; those of different partitions get different salts. A task that is
        # run again gives its rows the same salts in whatever order they come, which random numbers would not.
        row_salt = F.pmod(F.xxhash64(F.spark_partition_id(), *[F.col(c) for c in df.columns if c not in keys]), F.lit(salts))
        spread = with_salt(df, keys, row_salt, **kw)
        first, second = [], []
        for name, (kind, column) in plain.items():
            if kind == "avg":
                first += [F.sum(column).alias(f"_s_{name}"), F.count(column).alias(f"_n_{name}")]
                second.append((F.sum(f"_s_{name}") / F.sum(f"_n_{name}")).alias(name))
            elif kind in ("count", "sum"):
                first.append((F.count(column) if kind == "count" else F.sum(column)).alias(f"_p_{name}"))
                second.append(F.sum(f"_p_{name}").alias(name))
            elif kind in ("min", "max"):
                f = getattr(F, kind)
                first.append(f(column).alias(f"_p_{name}"))
                second.append(f(f"_p_{name}").alias(name))
            else:
                raise ValueError(f"unknown kind of measure: {kind}")
        pieces.append(spread.groupBy(*keys, "_salt").agg(*first).groupBy(*keys).agg(*second))
    for name, (kind, column) in measures.items():
        if kind == "distinct":
            values = df.select(*keys, column.alias("_value")).distinct()
            by_value = with_salt(values, keys, F.pmod(F.xxhash64("_value"), F.lit(salts)), **kw)
            pieces.append(by_value.groupBy(*keys, "_salt").agg(F.count("_value").alias("_p")).groupBy(*keys).agg(F.sum("_p").alias(name)))

    def merge(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in b.columns if c not in keys])
        on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
        return a.join(b, on, "inner").drop(*[f"_r_{k}" for k in keys])

    return reduce(merge, pieces).select(*keys, *measures)


def salted_rank(df: DataFrame, keys: list[str], order: str, ties: list[str] | None = None, out: str = "rank", width: int = 1 << 16, **kw) -> DataFrame:
    """The place of each row, from 1, within its key by ``order`` (then ``ties``), without a task per key.

    The salt of a heavy key keeps the order: it is ``order`` divided by
    ``width``, so a salt holds at most ``width`` distinct values.  Stage one counts the rows
    per (key, salt) and ranks within them; stage two turns the counts of a key
    into running offsets, which are added.

    ``order`` must be an integer column.  Null orders come first and tie;
    ties beyond ``ties`` get distinct places in an undefined order.  Null keys
    form groups of their own.  An existing column named ``out`` is replaced.
    """
    salt = F.coalesce(F.floor(F.col(order) / F.lit(width)), F.lit(-(1 << 62)))
    rows = with_salt(df.drop(out), keys, salt, **kw)
    counts = rows.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.sum("_n").over(before)).where(F.col("_before") > 0)
    offsets = offsets.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col("_salt").alias("_o_salt"), "_before")
    within = Window.partitionBy(*keys, "_salt").orderBy(F.col(order).asc_nulls_first(), *[F.col(t) for t in ties or []])
    ranked = rows.withColumn("_place", F.row_number().over(within))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys] + [F.col("_salt") == F.col("_o_salt")])
    return (
        ranked.join(offsets, same, "left")
        .withColumn(out, (F.col("_place") + F.coalesce(F.col("_before"), F.lit(0))).cast("long"))
        .drop("_salt", "_place", "_before", "_o_salt", *[f"_o_{k}" for k in keys])
    )


def skew_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", **kw) -> DataFrame:
    """Join ``big`` with ``small`` (unique in ``keys``) where few keys may hold most rows of ``big``.

    The rows of heavy keys meet their partners by a broadcast of at most
    ``max_heavy`` rows of ``small``; all others by an ordinary shuffled join.
    ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``.  Rows with a
    null key have no partner.  ``big`` is read twice, so it should be a table.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(how)
    heavy = heavy_keys(big.select(*keys).dropna(), keys, **kw).select(*keys)
    hot = big.join(F.broadcast(heavy), keys, "left_semi").join(F.broadcast(small.join(F.broadcast(heavy), keys, "left_semi")), keys, how)
    cold = big.join(F.broadcast(heavy), keys, "left_anti").join(small, keys, how)
    return hot.unionByName(cold)
