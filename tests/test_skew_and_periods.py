import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.periods import periods_and_gaps
from tessera.operators.skew import heavy_keys, salted_aggregate, salted_rank, skew_join
from tessera.sources.tables import latest, with_intervals


def skewed(n=3000, seed=0):
    r = random.Random(seed)
    data = []
    for k in range(n):
        key = "hot" if r.random() < 0.5 else r.choice([None, "a", "b", f"k{r.randrange(40)}"])
        data.append((k, key, r.choice([None, r.randrange(100_000)]), "x"))
    return data


def test_heavy_keys_are_few(spark):
    df = spark.createDataFrame(skewed(), "id long, k string, v long, _salt string")
    heavy = heavy_keys(df, ["k"], min_rows=100, max_heavy=5)
    assert {r["k"] for r in heavy.collect()} == {"hot"}
    assert heavy_keys(df.limit(0), ["k"]).count() == 0


def test_salted_aggregate(spark):
    data = skewed()
    df = spark.createDataFrame(data, "id long, k string, v long, other string").repartition(7)
    c = F.col("v")
    out = salted_aggregate(df, ["k"], {"n": ("count", c), "s": ("sum", c), "lo": ("min", c), "hi": ("max", c), "m": ("avg", c), "d": ("distinct", c)}, 8, min_rows=50)
    got = {r["k"]: tuple(r)[1:] for r in out.collect()}
    want = {}
    for key in {k for _, k, _, _ in data}:
        v = [x for _, k, x, _ in data if k == key and x is not None]
        want[key] = (len(v), sum(v) if v else None, min(v, default=None), max(v, default=None), sum(v) / len(v) if v else None, len(set(v)))
    assert got == want
    assert salted_aggregate(df.limit(0), ["k"], {"n": ("count", c)}).count() == 0


def test_salted_rank(spark):
    data = skewed(seed=4)
    df = spark.createDataFrame([(i, k, v, "old") for i, k, v, _ in data], "id long, k string, v long, place string")
    got = {r["id"]: r["place"] for r in salted_rank(df, ["k"], "v", ["id"], "place", width=1000, min_rows=50).collect()}
    want = {}
    for key in {k for _, k, _, _ in data}:
        rows = sorted(((v is not None, v or 0, i) for i, k, v, _ in data if k == key))
        want |= {i: p for p, (_, _, i) in enumerate(rows, 1)}
    assert got == want
    assert salted_rank(df.limit(0), ["k"], "v").count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join(spark, how, rows):
    big = spark.createDataFrame(skewed(800, 2), "id long, k string, v long, x string")
    small = spark.createDataFrame([("hot", 1), ("a", 2), ("zz", 3)], "k string, w int")
    assert rows(skew_join(big, small, ["k"], how, min_rows=50).select("id")) == rows(big.join(small, "k", how).select("id"))


def test_latest(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "b", 2), (2, "c", None), (2, "d", 5), (3, None, None), (None, "e", 1)], "id int, x string, t int").withColumn("t", F.timestamp_seconds("t"))
    assert sorted((r["id"], r["x"]) for r in latest(df, "id", "t").collect()) == [(1, "b"), (2, "d"), (3, None)]


def test_interval_texts(spark):
    good = {"chr1:10-20": ("chr1", 10, 20), " chr1_10_20 ": ("chr1", 10, 20), "ctg_000123-1,000-22,000": ("ctg_000123", 1000, 22000), "chrX:5..5": ("chrX", 5, 5), "ctg_1_2_3": ("ctg_1", 2, 3)}
    bad = [None, "", "NA", "chr1", "chr1:10", ":10-20", "chr1:start-20", "chr1:20-10", "f77", "ctg_600003", "chr1:1,00-2,000", "chr1:10-99999999999999999999"]
    df = spark.createDataFrame([(t, "old") for t in [*good, *bad]], "t string, seqnames string")
    assert {r["t"]: (r["seqnames"], r["start_pos"], r["end_pos"]) for r in with_intervals(df, "t").collect()} == good


def brute_periods(intervals):
    out, gaps = [], []
    for s, e in sorted(intervals):
        if out and s <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], e)
        else:
            if out:
                gaps.append((out[-1][1] + 1, s - 1))
            out.append([s, e])
    return [("period", s, e) for s, e in out] + [("gap", s, e) for s, e in gaps]


@pytest.mark.parametrize("slab", [7, 100, 1 << 24])
def test_periods(spark, slab):
    r = random.Random(slab)
    data = [("hot", r.randrange(3000)) for _ in range(400)] + [(f"e{r.randrange(30)}", r.randrange(300)) for _ in range(200)] + [("long", 10)]
    rows = [(k, s, s + (2000 if k == "long" else r.choice([0, 1, 5, 9, 40])), "z") for k, s in data]
    rows += [("long", 500, 501, ""), ("long", 2011, 2011, ""), ("long", 2013, 2020, "")]
    dirt = [(None, 1, 2, ""), ("a", None, 2, ""), ("a", 1, None, ""), ("a", 9, 3, "")]
    df = spark.createDataFrame(rows + dirt + rows[:50], "k string, start_pos long, end_pos long, _s string")
    got = sorted((x["k"], x["kind"], x["start_pos"], x["end_pos"]) for x in periods_and_gaps(df, ["k"], slab=slab).collect())
    want = sorted((k, *p) for k in {x[0] for x in rows} for p in brute_periods({(s, e) for q, s, e, _ in rows if q == k}))
    assert got == want


def test_no_periods(spark):
    assert periods_and_gaps(spark.createDataFrame([], "k string, start_pos long, end_pos long"), ["k"]).count() == 0
