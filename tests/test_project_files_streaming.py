import pytest
from pyspark.sql import functions as F

from tessera.project import Project
from tessera.session import discard, materialise, scratch_root
from tessera.sources import files
from tessera.streaming import ingest


def cells(spark, sample, n, **extra):
    df = spark.range(n).select(F.concat_ws("#", F.lit(sample), F.col("id")).alias("cell"), F.lit(sample).alias("sample"))
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def test_project_round_trip(spark, tmp_path):
    p = Project.from_samples(spark, str(tmp_path / "p"), [cells(spark, "a", 3, tss_enrichment=5.0), cells(spark, "b", 2, n_frags=100)])
    assert p.n_cells() == 5 and p.cells.where("n_frags IS NULL").count() == 3
    p.add_cell_column(spark.createDataFrame([("a#0", "x")], "cell string, mark string"), "mark")
    p.add_table("matrix/tiles", spark.createDataFrame([(1, "a#0", 2.0), (1, "b#1", 1.0)], "feature int, cell string, value double"), {"tile": 500})
    q = p.save()
    moved = tmp_path / "elsewhere"
    (tmp_path / "p").rename(moved)
    q = Project.load(spark, str(moved))
    assert q.matrices() == ["tiles"] and q.manifest.params["matrix/tiles"] == {"tile": 500} and q.cells.where("mark = 'x'").count() == 1
    sub = q.subset(spark.createDataFrame([("b#1",)], "cell string"))
    assert sub.n_cells() == 1 and sub.tables["matrix/tiles"].count() == 1
    assert q.cell_column("log10(n_frags)").where("cell = 'b#1'").collect()[0][1] == 2
    with pytest.raises(ValueError):
        q.subset(spark.createDataFrame([("none",)], "cell string"))
    with pytest.raises(ValueError):
        q.set_cell_column("sample", "z")
    with pytest.raises(ValueError):
        Project.from_samples(spark, "x", [cells(spark, "a", 1), cells(spark, "a", 1)])


def test_fragment_files(spark, tmp_path, rows):
    (tmp_path / "f.tsv").write_text("# c\nchr1\t9\t30\tAA\t1\nchr1\t99\t130\tBB-1\t2\nchr2\tx\t3\tAA\t1\n")
    f = files.read_fragments(spark, str(tmp_path / "f.tsv"), "s", pattern="-1$")
    assert rows(f.select("chr", "start_pos", "end_pos", "cell")) == [("chr1", 10, 30, "s#AA"), ("chr1", 100, 130, "s#BB")]
    files.write_fragment_store(f, str(tmp_path / "store"))
    again = files.read_fragment_store(spark, str(tmp_path / "store"), ["chr1"])
    assert rows(again.select("chr", "start_pos", "end_pos", "cell")) == rows(f.select("chr", "start_pos", "end_pos", "cell"))
    with pytest.raises(ValueError):
        files.read_fragment_store(spark, str(tmp_path / "store"), ["chr9"])
    files.write_bed_fragments(f, spark.createDataFrame([("s#AA", "g")], "cell string, group string"), str(tmp_path / "bed"))
    assert rows(files.read_bed(spark, str(tmp_path / "bed" / "group=g"))) == [("chr1", 10, 30)]
    (tmp_path / "b.csv").write_text("barcode,cell_id\nAA,_cell_0\nBB,None\nNO_BARCODE,x\n")
    assert rows(files.read_valid_barcodes(spark, str(tmp_path / "b.csv"))) == [("AA",)]


def test_stream_appends_once(spark, tmp_path):
    def put(n):
        spark.createDataFrame([("s", "chr1", 1, 50, f"b{k % 3}") for k in range(n)], "sample string, chr string, start_pos long, end_pos long, barcode string").write.mode("append").parquet(str(tmp_path / "in"))

    put(6)
    for extra in (0, 3):
        if extra:
            put(extra)
        q = ingest.append_fragments(ingest.stream_fragments(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
    assert {r["n_frags"] for r in ingest.barcode_totals(spark, str(tmp_path / "out")).collect()} == {3}
    assert spark.read.parquet(str(tmp_path / "out/fragments")).count() == 9


def test_scratch_is_that_of_the_session(spark):
    df = materialise(spark.range(3), "t")
    assert df.tessera_path.startswith(scratch_root(spark)) and df.count() == 3
    discard(df)
    discard(spark.range(1))


def test_entries_of_a_matrix_are_worked_out_once(spark, rows, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    cells = spark.createDataFrame([("a", "s"), ("b", "s"), ("d", "s")], "cell string, sample string")
    entries = spark.createDataFrame([("c", 1, "a", 2), ("c", 1, "b", 4), ("c", 2, "a", 1)], "chr string, feature long, cell string, value long")
    once = entries.withColumn("value", F.udf(count, "long").asNondeterministic()("value"))
    project = Project(spark, f"file://{tmp_path}/p", cells).add_matrix("m", once).save()
    assert seen.value == 3
    stats = Project(spark, "", cells).add_matrix("m", entries).tables["stats/m"]
    assert rows(project.tables["stats/m"].select(*stats.columns)) == rows(stats)
