"""Reading the table families from a folder of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def latest(df: DataFrame, key: str, version: str) -> DataFrame:
    """The current row of each ``key``: the one with the greatest ``version``.

    Rows of one key with equal versions are taken to be identical, so any of
    them stands for all.  A null version is older than every other.  The group
    is reduced map-side before it is shuffled; rows with a null key are dropped.
    """
    rest = [c for c in df.columns if c not in (key, version)]
    packed = F.max_by(F.struct(*rest), F.coalesce(F.col(version), F.lit("0001-01-01").cast(df.schema[version].dataType)))
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(packed.alias("_row"), F.max(version).alias(version))
    return out.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest], version).select(*df.columns)


#: An interval as text: seqname, start, end. Greedy from the left, so it is decided from the right end.
_INTERVAL = (
    r"^\s*(.*[^\s:_-])\s*[:_-]\s*([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)\s*(?:-|_|\.\.)\s*([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)\s*$"
)


def with_intervals(df: DataFrame, text: str) -> DataFrame:
    """``df`` with seqnames, start_pos and end_pos read from the column ``text``; unreadable rows are left out.

    Accepted spellings: ``chr1:10-20``, ``chr1:10..20``, ``chr1-10-20``,
    ``chr1_10_20``, thousands commas in the numbers, and blanks around the
    parts.  The seqname may itself hold an underscore.  Rows whose text is null or
    unreadable, or whose end lies before the start, are left out.  Existing
    columns of the three names are replaced.

    The pattern is matched once a row: the generator keeps Catalyst from
    copying the match into every expression that uses a part of it.
    """
    parts = F.split(F.regexp_replace(F.col(text), _INTERVAL, "$1\t$2\t$3"), "\t")
    rows = df.drop("seqnames", "start_pos", "end_pos").where(F.col(text).isNotNull())
    rows = rows.select("*", F.explode(F.array(parts)).alias("_parts")).where(F.size("_parts") == 3)
    number = lambda i: F.replace(F.col("_parts")[i], F.lit(",")).try_cast("long")
    rows = rows.select(*[c for c in rows.columns if c != "_parts"], F.col("_parts")[0].alias("seqnames"), number(1).alias("start_pos"), number(2).alias("end_pos"))
    return rows.where(F.col("end_pos") >= F.col("start_pos"))
