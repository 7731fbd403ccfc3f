"""Session settings and the shared scratch folder in which lineage is cut.

Iterative operators write each round as a Parquet table below the folder the
session names in ``spark.checkpoint.dir``.  That folder is shared by all
executors, so a lost executor costs nothing but the tasks it was running.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None, memory: str = "12g", **conf: str) -> SparkSession:
    """A session on one machine, for tests and the benchmark."""
    partitions = shuffle_partitions or (cores if isinstance(cores, int) else os.cpu_count() or 8)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``, or else the one set with ``setCheckpointDir``.

    Only on a single machine, and where neither is set, it is a folder of this machine that goes when the program
    ends; on a cluster that is an error, since executors would not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        if given.isDefined():
            root = given.get()
        elif spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        else:
            folder = tempfile.mkdtemp(prefix="tessera-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            root = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialise(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the scratch folder and return the written table.

    The result has no lineage but the files, carries exact size statistics for
    the optimizer, and remembers its place in ``tessera_path`` for :func:`discard`.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tessera/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tessera_path = path  # type: ignore[attr-defined]
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table written by :func:`materialise`; anything else is left alone."""
    path = getattr(df, "tessera_path", None)
    if df is None or path is None:
        return
    jvm = df.sparkSession._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
