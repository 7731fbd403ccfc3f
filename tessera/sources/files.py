"""Readers and writers of the text formats in which fragments, regions and calls are exchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.skew import heavy_keys

_FRAGMENT_LINES = T.StructType([T.StructField(n, t) for n, t in (("chr", T.StringType()), ("start", T.LongType()), ("end", T.LongType()), ("barcode", T.StringType()), ("reads", T.LongType()))])


def _tsv(spark: SparkSession, path: str | list[str], schema: T.StructType, header: bool = False) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schema, header=header, comment="#", mode="PERMISSIVE")


def read_fragments(spark: SparkSession, path: str | list[str], sample: str, barcodes: DataFrame | None = None, pattern: str | None = None, partitions: int | None = None) -> DataFrame:
    """Fragments from BED-like text (start from 0, end exclusive): sample, chr, start_pos (from 1), end_pos, barcode, cell.

    Lines without coordinates are dropped; ``pattern`` is removed from barcodes;
    ``barcodes`` keeps those it lists.  A gzip file is read by one task, so
    ``partitions`` spreads its rows before anything else happens.
    """
    rows = _tsv(spark, path, _FRAGMENT_LINES)
    if partitions:
        rows = rows.repartition(partitions)
    rows = rows.dropna(subset=["chr", "start", "end", "barcode"])
    if pattern:
        rows = rows.withColumn("barcode", F.regexp_replace("barcode", pattern, ""))
    if barcodes is not None:
        rows = rows.join(barcodes.select("barcode"), "barcode", "left_semi")
    return rows.select(
        F.lit(sample).alias("sample"), "chr", (F.col("start") + 1).alias("start_pos"), F.col("end").alias("end_pos"), "barcode", F.concat_ws("#", F.lit(sample), "barcode").alias("cell")
    )


def fragments_from_alignments(alignments: DataFrame, sample: str, plus: int = 4, minus: int = -5, shortest: int = 10, barcode: str = "barcode") -> DataFrame:
    """Fragments from decoded pairs (chr, pos, isize, flag, barcode): properly paired mates on the plus strand, shifted by the cut offsets."""
    proper = F.col("flag").bitwiseAND(2) > 0
    forward = F.col("flag").bitwiseAND(16) == 0
    start, end = F.col("pos") + plus, F.col("pos") + F.abs("isize") - 1 + minus
    rows = alignments.where(proper & forward & F.col(barcode).isNotNull()).select(
        F.lit(sample).alias("sample"), "chr", start.cast("long").alias("start_pos"), end.cast("long").alias("end_pos"), F.col(barcode).alias("barcode"), F.concat_ws("#", F.lit(sample), barcode).alias("cell")
    )
    return rows.where(F.col("end_pos") - F.col("start_pos") >= shortest)


def read_valid_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """Barcodes a cell caller took for cells: ``cell_id`` is not None, or ``is__cell_barcode`` is 1."""
    rows = spark.read.csv(path, header=True)
    if "cell_id" in rows.columns:
        rows = rows.where(F.col("cell_id") != "None")
    elif "is__cell_barcode" in rows.columns:
        rows = rows.where(F.col("is__cell_barcode") == "1")
    else:
        raise ValueError("the file has neither cell_id nor is__cell_barcode")
    return rows.where(F.col("barcode") != "NO_BARCODE").select("barcode").distinct()


def read_demultiplexed(spark: SparkSession, path: str) -> DataFrame:
    """Columns barcode and best of a tab-separated table of calls."""
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows.select(F.col("BARCODE").alias("barcode"), F.col("BEST").alias("best"))


def read_bed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Regions from BED (start from 0): chr, start_pos (from 1), end_pos."""
    schema = T.StructType([T.StructField("chr", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    rows = _tsv(spark, path, schema).dropna()
    return rows.select("chr", (F.col("start") + 1).alias("start_pos"), F.col("end").alias("end_pos"))


def read_summits(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Peak summits of a caller: chr, position (from 1) as start_pos and end_pos, score in the fifth column."""
    schema = T.StructType([T.StructField(n, t) for n, t in (("chr", T.StringType()), ("s", T.LongType()), ("e", T.LongType()), ("name", T.StringType()), ("score", T.DoubleType()))])
    return _tsv(spark, path, schema).select("chr", (F.col("s") + 1).alias("start_pos"), (F.col("s") + 1).alias("end_pos"), "score")


def write_fragment_store(fragments: DataFrame, path: str, files: int = 16) -> None:
    """Fragments as Parquet by sample and chromosome, sorted by barcode and start within files.

    A large (sample, chr) is written by ``files`` tasks, by barcode; the runs of
    equal barcodes and chromosomes are dictionary- and run-length-encoded by Parquet.
    """
    heavy = heavy_keys(fragments, ["sample", "chr"]).select("sample", "chr", F.lit(files).alias("_files"))
    rows = fragments.join(F.broadcast(heavy), ["sample", "chr"], "left")
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("barcode"), F.coalesce("_files", F.lit(1))))
    rows = rows.repartition("sample", "chr", "_part").sortWithinPartitions("sample", "chr", "barcode", "start_pos").drop("_files", "_part")
    rows.write.mode("overwrite").partitionBy("sample", "chr").parquet(path)


def read_fragment_store(spark: SparkSession, path: str, chroms: list[str] | None = None, cells: DataFrame | None = None, longest: int | None = None) -> DataFrame:
    """Fragments of a store; chromosomes prune partitions, cells are a semi join."""
    rows = spark.read.parquet(path)
    if chroms is not None:
        known = {r[0] for r in rows.select("chr").distinct().collect()}  # one row a chromosome, from partition names
        if unknown := set(chroms) - known:
            raise ValueError(f"no such chromosomes: {sorted(unknown)}")
        rows = rows.where(F.col("chr").isin(chroms))
    if longest is not None:
        rows = rows.where(F.col("end_pos") - F.col("start_pos") + 1 <= longest)
    return rows.join(cells.select("cell"), "cell", "left_semi") if cells is not None else rows


def write_bed_fragments(fragments: DataFrame, groups: DataFrame, path: str) -> None:
    """Fragments of each group as gzipped BED text (start from 0), a folder per group."""
    rows = fragments.join(groups.select("cell", "group"), "cell").select("group", "chr", (F.col("start_pos") - 1).alias("start"), F.col("end_pos").alias("end"), "cell")
    rows.write.mode("overwrite").partitionBy("group").csv(path, sep="\t", compression="gzip")


def write_coverage_bed(coverage: DataFrame, path: str) -> None:
    """Coverage (chr, pos, n) as one BED line per insertion."""
    lines = coverage.select("chr", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"), F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))).alias("_x"))
    lines.drop("_x").write.mode("overwrite").csv(path, sep="\t", compression="gzip")


def write_bedgraph(track: DataFrame, path: str, tile: int) -> None:
    """Tiles (group, chr, tile, value) as bedGraph text, a folder per group, in order of position within files."""
    rows = track.select("group", "chr", ((F.col("tile") - 1) * tile).alias("start"), (F.col("tile") * tile).alias("end"), "value")
    rows.repartition("group", "chr").sortWithinPartitions("group", "chr", "start").write.mode("overwrite").partitionBy("group").csv(path, sep="\t")


def write_matrix_tables(matrix: DataFrame, peaks: DataFrame, cells: DataFrame, path: str) -> None:
    """Coordinate counts, regions and cells as three gzipped tables."""
    for name, df in (("counts", matrix), ("regions", peaks), ("cells", cells)):
        df.write.mode("overwrite").csv(f"{path}/{name}", sep="\t", compression="gzip")


def reformat_fragments(fragments: DataFrame) -> DataFrame:
    """Rows of standard chromosomes with whole coordinates, and barcodes without blanks and hashes; :func:`write_fragments` writes them in order."""
    ok = fragments.where(F.col("chr").startswith("chr") & F.col("start_pos").isNotNull() & F.col("end_pos").isNotNull())
    return ok.withColumn("barcode", F.regexp_replace("barcode", " |#", "."))


def read_gtf(spark: SparkSession, path: str | list[str], feature_names: tuple[str, ...] = ("gene", "exon")) -> DataFrame:
    """Features of a gene annotation in GTF: feature, chr, start_pos, end_pos, strand, gene, symbol. Lines that are no features, or lack coordinates, are left out."""
    names = ("chr", "source", "feature", "start", "end", "score", "strand", "frame", "attributes")
    schema = T.StructType([T.StructField(n, T.LongType() if n in ("start", "end") else T.StringType()) for n in names])
    rows = spark.read.csv(path, sep="\t", schema=schema, comment="#", quote="", mode="PERMISSIVE").where(F.col("feature").isin(*feature_names)).dropna(subset=["chr", "start", "end"])
    of = lambda name: F.nullif(F.regexp_extract("attributes", rf'(?:^|[;\s]){name} "?([^";]*)"?', 1), F.lit(""))
    return rows.select("feature", "chr", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "strand", of("gene_id").alias("gene"), F.coalesce(of("gene_name"), of("gene_id")).alias("symbol"))


def gene_annotation(gtf: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Genes (one row a gene and chromosome, its whole extent, with a number by position), exons and distinct gene starts of a read GTF."""
    of_gene = gtf.where(F.col("gene").isNotNull()).groupBy("chr", "gene").agg(
        F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.min("strand").alias("strand"), F.min("symbol").alias("symbol")
    )
    genes = of_gene.withColumn("gene_id", F.row_number().over(Window.orderBy("chr", "start_pos", "end_pos", "gene")).cast("long"))  # one row a gene
    exons = gtf.where(F.col("feature") == "exon").select("chr", "start_pos", "end_pos", "strand", "gene").distinct()
    starts = genes.select("chr", F.when(F.col("strand") == "-", F.col("end_pos")).otherwise(F.col("start_pos")).alias("pos"), "strand").distinct()
    return genes, exons, starts


def write_fragments(fragments: DataFrame, path: str) -> None:
    """Fragments as gzipped BED-like text (start from 0), in order of position over the files and within them."""
    rows = fragments.select("chr", (F.col("start_pos") - 1).alias("start"), F.col("end_pos").alias("end"), "barcode")
    rows.repartitionByRange("chr", "start", "end").sortWithinPartitions("chr", "start", "end", "barcode").write.mode("overwrite").csv(path, sep="\t", compression="gzip")
