"""A project: a manifest of named tables (cells, fragments, matrices, vectors) under one folder."""

from __future__ import annotations

import json
import os
import re
import uuid
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.expressions import expression

#: Cell columns that can't be replaced.
PROTECTED = ("cell", "sample", "n_frags")


@dataclass
class Manifest:
    tables: dict[str, str] = field(default_factory=dict)  # name -> path below the root
    params: dict[str, dict] = field(default_factory=dict)
    summary: list[list[str]] = field(default_factory=list)


class Project:
    """Tables of one analysis. Methods return DataFrames or change the project's tables; nothing runs before it is read."""

    def __init__(self, spark: SparkSession, root: str, cells: DataFrame, manifest: Manifest | None = None):
        if not {"cell", "sample"} <= set(cells.columns):
            raise ValueError("cells need the columns cell and sample")
        self.spark, self.root, self.cells = spark, root, cells
        self.manifest = manifest or Manifest()
        self.tables: dict[str, DataFrame] = {}
        self._stored: dict[str, tuple[DataFrame, str]] = {}  # tables as they were loaded, and where from
        self._statistics: dict[str, tuple] = {}  # of matrices added: the table, the entries, and how it follows from them

    @classmethod
    def from_samples(cls, spark: SparkSession, root: str, parts: list[DataFrame]) -> Project:
        """Union of per-sample cell tables; columns a sample lacks are null. Samples must be distinct."""
        cells = parts[0]
        for p in parts[1:]:
            cells = cells.unionByName(p, allowMissingColumns=True)
        names = [r[0] for p in parts for r in p.select("sample").distinct().collect()]  # one row a sample
        if len(names) != len(set(names)):
            raise ValueError("a sample occurs in more than one table")
        return cls(spark, root, cells)

    # cells

    def cell_column(self, *names: str) -> DataFrame:
        """Columns or expressions such as ``log10(n_frags)`` of every cell."""
        known = self.cells.columns
        return self.cells.select("cell", *[F.col(n) if n in known else expression(n, known).alias(n) for n in names])

    def add_cell_column(self, values: DataFrame, name: str, force: bool = False) -> Project:
        """Left-join a column (cell, name); cells without a value get null."""
        if name in PROTECTED:
            raise ValueError(f"{name} is protected")
        if name in self.cells.columns and not force:
            raise ValueError(f"{name} exists; use force")
        if values.groupBy("cell").count().where("count > 1").limit(1).count():
            raise ValueError("a cell has more than one value")
        self.cells = self.cells.drop(name).join(values.select("cell", name), "cell", "left")
        return self

    def set_cell_column(self, name: str, value: Column | str | int | float) -> Project:
        """Replace or add a column by an expression or a constant."""
        if name in PROTECTED:
            raise ValueError(f"{name} is protected")
        self.cells = self.cells.withColumn(name, value if isinstance(value, Column) else F.lit(value))
        return self

    def samples(self) -> DataFrame:
        return self.cells.select("sample").distinct()

    def n_cells(self) -> int:
        return self.cells.count()

    def summarise(self) -> DataFrame:
        """One row: samples, cells and, where present, medians of enrichment and fragments."""
        medians = [F.percentile(c, F.lit(0.5)).alias(f"median_{c}") for c in ("tss_enrichment", "n_frags") if c in self.cells.columns]
        return self.cells.agg(F.countDistinct("sample").alias("samples"), F.count(F.lit(1)).alias("cells"), *medians)

    def subset(self, cells: DataFrame) -> Project:
        """The project with only the given cells, in every table that has a column cell; all must exist."""
        wanted = cells.select("cell").distinct()
        missing = wanted.join(self.cells, "cell", "left_anti").limit(1).count()
        if missing:
            raise ValueError("a cell of the subset is not in the project")
        out = Project(self.spark, self.root, self.cells.join(wanted, "cell", "left_semi"), Manifest(params=dict(self.manifest.params), summary=list(self.manifest.summary)))
        for name, df in self.tables.items():
            if name != "impute_weights":  # no longer those of the remaining cells
                out.tables[name] = df.join(wanted, "cell", "left_semi") if "cell" in df.columns else df
        return out

    # tables

    def add_table(self, name: str, df: DataFrame, params: dict | None = None, force: bool = False) -> Project:
        if name in self.tables and not force:
            raise ValueError(f"{name} exists; use force")
        self.tables[name] = df
        self.manifest.params[name] = params or {}
        self.note(f"add_table {name}")
        return self

    def drop_table(self, name: str) -> Project:
        self.tables.pop(name)
        self.manifest.params.pop(name, None)
        return self

    def matrices(self, prefix: str = "matrix/") -> list[str]:
        return sorted(n[len(prefix) :] for n in self.tables if n.startswith(prefix))

    def features(self, matrix: str, select: str | None = None) -> DataFrame:
        """Feature names of a matrix, those that match a pattern without case if given; repeated names come as seqname:name."""
        df = self.tables[f"features/{matrix}"]
        twice = df.groupBy("name").agg((F.count(F.lit(1)) > 1).alias("_twice"))
        named = df.join(twice, "name").select(F.when(F.col("_twice"), F.concat_ws(":", "chr", "name")).otherwise(F.col("name")).alias("name"))
        return named if select is None else named.where(F.col("name").rlike(f"(?i){select}"))

    def reduced_dims(self, name: str, cut_off: float | None = None, scale: bool = False) -> DataFrame:
        """(cell, v) of current cells; with ``cut_off``, only dimensions whose correlation with depth (in the params) stays within it."""
        from tessera.operators.lsi import scale_dims

        df = self.tables[f"vectors/{name}"].join(self.cells.select("cell"), "cell", "left_semi").select("cell", "v")
        if cut_off is not None:
            keep = [j for j, r in enumerate(self.manifest.params[f"vectors/{name}"]["depth_correlation"]) if abs(r) <= cut_off]
            df = df.withColumn("v", F.array(*[F.col("v")[j] for j in keep]))
        return scale_dims(df) if scale else df

    # samples and genome, each a table of its own

    def sample_column(self, *names: str) -> DataFrame:
        """Columns of the sample table, one row a sample; samples that were given nothing have nulls."""
        known = self.samples()
        table = self.tables.get("samples")
        return known if table is None else known.join(table, "sample", "left").select("sample", *(names or [c for c in table.columns if c != "sample"]))

    def add_sample_column(self, values: DataFrame, name: str, force: bool = False) -> Project:
        """Add a column (sample, name) to the sample table; the samples must be those of the project."""
        table = self.tables.get("samples")
        if table is not None and name in table.columns and not force:
            raise ValueError(f"{name} exists; use force")
        if values.join(self.samples(), "sample", "left_anti").limit(1).count():
            raise ValueError("a sample is not in the project")
        if values.groupBy("sample").count().where("count > 1").limit(1).count():
            raise ValueError("a sample has more than one value")
        base = self.samples() if table is None else table.drop(name)
        self.tables["samples"] = base.join(values.select("sample", name), "sample", "left")
        return self

    def set_genome(self, **tables: DataFrame | None) -> Project:
        """Store the genome's tables: sizes (chr, len), genes, exons, blacklist, or others by their name."""
        for name, df in tables.items():
            if df is not None:
                self.tables[f"genome/{name}"] = df
        return self

    def genome(self, name: str) -> DataFrame:
        return self.tables[f"genome/{name}"]

    def gene_starts(self) -> DataFrame:
        """Distinct gene starts (chr, pos, strand)."""
        at = F.when(F.col("strand") == "-", F.col("end_pos")).otherwise(F.col("start_pos"))
        return self.genome("genes").select("chr", at.alias("pos"), "strand").distinct()

    # matrices: entries (chr, feature, cell, value) with the statistics of their rows beside them

    def add_matrix(self, name: str, entries: DataFrame, features: DataFrame | None = None, params: dict | None = None, force: bool = False) -> Project:
        """Add a matrix and ``stats/name``: per feature the sum, mean and variance over all cells of the project and the number of nonzero entries."""
        from tessera.operators.matrix import row_moments

        row = [c for c in ("chr", "feature") if c in entries.columns]
        self.add_table(f"matrix/{name}", entries, params, force)
        n = self.n_cells()
        self.tables[f"stats/{name}"] = row_moments(entries, row, n)
        self._statistics[f"stats/{name}"] = self.tables[f"stats/{name}"], entries, lambda written: row_moments(written, row, n)
        if features is not None:
            self.tables[f"features/{name}"] = features
        return self

    def matrix(self, name: str, cells: DataFrame | None = None, features: DataFrame | None = None, chroms: list[str] | None = None, pad: bool = False) -> DataFrame:
        """Entries of a matrix, only of the wanted chromosomes (pushed to the files), features and cells; with ``pad``, wanted features it lacks come with value 0 and no cell."""
        df = self.tables[f"matrix/{name}"]
        if chroms is not None:
            df = df.where(F.col("chr").isin(*chroms))
        keys = [c for c in ("chr", "feature") if features is not None and c in features.columns and c in df.columns]
        if features is not None:
            df = df.join(features.select(*keys).distinct(), keys, "left_semi")
        if cells is not None:
            df = df.join(cells.select("cell"), "cell", "left_semi")
        if features is not None and pad:
            df = features.select(*keys).distinct().join(df, keys, "left").withColumn("value", F.coalesce("value", F.lit(0).cast(df.schema["value"].dataType)))
        return df

    def embedding(self, name: str) -> DataFrame:
        """Positions of the current cells in a stored embedding."""
        return self.tables[f"embeddings/{name}"].join(self.cells.select("cell"), "cell", "left_semi")

    def note(self, what: str) -> None:
        self.manifest.summary.append([datetime.now(timezone.utc).isoformat(timespec="seconds"), what])

    # storage; the manifest is small and holds paths relative to the root

    def save(self, root: str | None = None) -> Project:
        """Write the project below ``root``, in place by default, and return it as saved.

        Tables that have changed since they were loaded go to a new folder; the others stay where they are.
        The new manifest, written under a temporary name and then renamed, completes the save; only
        then are files deleted that it doesn't name.  A save that is broken off leaves the project as it was.
        Projects opened before a save must be opened again.
        """
        root = root or self.root
        files = _Files(self.spark, root)
        version = max(files.versions(), default=0) + 1
        folder, paths = f"tables-{version:06d}-{uuid.uuid4().hex[:8]}", {}
        for name, df in {"cells": self.cells, **self.tables}.items():
            stored = self._stored.get(name)
            if stored is not None and stored[0] is df and root == self.root:
                paths[name] = stored[1]
                continue
            paths[name] = f"{folder}/" + re.sub(r"[^A-Za-z0-9._/-]", "_", name)
            counted, entries, moments = self._statistics.get(name, (None, None, None))
            matrix = name.replace("stats/", "matrix/", 1)
            if counted is df and self.tables.get(matrix) is entries and matrix in paths:  # from the entries as they were written just now, which are not worked out again
                df = moments(self.spark.read.parquet(f"{root}/{paths[matrix]}"))
            df.write.mode("errorifexists").parquet(f"{root}/{paths[name]}")
        manifest = Manifest(paths, self.manifest.params, self.manifest.summary)
        files.put(f"manifest-{version:06d}.json", json.dumps(asdict(manifest)))
        files.keep_only(version, {p.split("/")[0] for p in paths.values()})
        return Project.load(self.spark, root)

    @classmethod
    def load(cls, spark: SparkSession, root: str, force: bool = False) -> Project:
        """Open a saved project wherever it lies; with ``force``, tables that are gone are left out."""
        files = _Files(spark, root)
        versions = files.versions()
        if not versions:
            raise FileNotFoundError(f"no project at {root}")
        manifest = Manifest(**json.loads(files.get(f"manifest-{max(versions):06d}.json")))
        out = cls(spark, root, spark.read.option("mergeSchema", "true").parquet(f"{root}/{manifest.tables['cells']}"), manifest)
        out._stored["cells"] = (out.cells, manifest.tables["cells"])
        for name, path in manifest.tables.items():
            if name == "cells" or force and not files.exists(path):
                continue
            out.tables[name] = spark.read.parquet(os.path.join(root, path))
            out._stored[name] = (out.tables[name], path)
        return out


class _Files:
    """Small files of a project's folder on whatever file system it lies."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self) -> list[str]:
        return [f.getPath().getName() for f in self.fs.listStatus(self.path(""))] if self.exists("") else []

    def versions(self) -> list[int]:
        return [int(m.group(1)) for n in self.names() if (m := re.fullmatch(r"manifest-(\d+)\.json", n))]

    def put(self, name: str, text: str) -> None:
        temporary = self.path(f"_{name}.{uuid.uuid4().hex}")
        out = self.fs.create(temporary, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.fs.rename(temporary, self.path(name)):
            raise OSError(f"{name} was written by someone else")

    def get(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def keep_only(self, version: int, folders: set[str]) -> None:
        """Delete manifests of other versions and table folders not in use."""
        for name in self.names():
            if (name.startswith("manifest-") and name != f"manifest-{version:06d}.json") or (name.startswith("tables-") and name not in folders):
                self.fs.delete(self.path(name), True)
