import math
import random

from pyspark.sql import functions as F

from tessera.llm.percentiles import ACCURACY, merge, percentiles, sketch


def test_bounded_error_and_merging(spark):
    random.seed(5)
    data = [(f"s{k % 2}", f"d{random.randrange(7)}", random.choice([1, -1]) * math.exp(random.gauss(0, 3))) for k in range(4000)]
    df = spark.createDataFrame(data, "s string, d string, x double")
    at = [0.0, 0.05, 0.5, 0.95, 1.0]
    merged = percentiles(merge(sketch(df, ["s", "d"], ["x"]), ["s"]), ["s"], at).collect()
    direct = percentiles(sketch(df, ["s"], ["x"]), ["s"], at).collect()
    assert sorted(map(tuple, merged)) == sorted(map(tuple, direct))
    for r in merged:
        values = sorted(x for s, _, x in data if s == r["s"])
        assert r["n"] == len(values)
        for p, name in zip(at, ("p0", "p5", "p50", "p95", "p100")):
            want = values[math.floor(p * (len(values) - 1))]
            assert abs(r[name] - want) <= ACCURACY * abs(want) * (1 + 1e-9)


def test_dirt(spark):
    df = spark.createDataFrame([(None, 1.0), (None, float("nan")), ("a", None), ("b", 0.0), ("b", float("inf")), ("b", -2.0), ("b", -2.0)], "s string, x double")
    got = {r["s"]: r for r in percentiles(sketch(df, ["s"], ["x"]), ["s"], [0.0, 0.5, 1.0]).collect()}
    assert set(got) == {None, "b"}
    assert got[None]["n"] == 1 and got["b"]["n"] == 4
    assert abs(got["b"]["p0"] + 2) < 0.01 and got["b"]["p100"] == float("inf")
    assert percentiles(sketch(df.where(F.lit(False)), ["s"], ["x"]), ["s"], [0.5]).count() == 0
