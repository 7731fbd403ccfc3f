import math
import random

import pytest

from tessera.llm.topn import top_n_per_group

SCHEMA = "g string, i string, x double, rnk string"


def brute(data, n):
    best = {}
    for g, i, x, _ in data:
        if g is None or i is None or x is None or math.isnan(x) or math.isinf(x):
            continue
        best[g, i] = max(x, best.get((g, i), -math.inf))
    out = []
    for g in {k[0] for k in best}:
        items = sorted(((-x, i.encode(), i) for (h, i), x in best.items() if h == g))[:n]
        out += [(g, i, -x, k) for k, (x, _, i) in enumerate(items, 1)]
    return sorted(out, key=repr)


def run(spark, data, n=5, **kw):
    df = spark.createDataFrame(data, SCHEMA)
    return sorted((tuple(r) for r in top_n_per_group(df, "g", "i", "x", n, **kw).collect()), key=repr)


def test_hot_group_ties_and_dirt(spark):
    random.seed(3)
    data = [("hot", f"i{random.randrange(400)}", float(random.randrange(6)), "z") for _ in range(3000)]
    data += [(f"g{random.randrange(300)}", f"i{random.randrange(50)}", random.choice([1.0, 2.5, random.random() * 9]), None) for _ in range(2500)]
    data += [("hot", "bad", float("nan"), ""), ("hot", "bad2", float("inf"), ""), (None, "i", 1.0, ""), ("g1", None, 1.0, ""), ("g1", "i", None, ""), ("g1", "é", 9.9, ""), ("g1", "z", 9.9, "")]
    assert run(spark, data) == brute(data, 5)


def test_all_scores_equal(spark):
    data = [("a", f"i{k:03}", 1.0, "") for k in range(200)] * 2
    assert run(spark, data, 3) == [("a", "i000", 1.0, 1), ("a", "i001", 1.0, 2), ("a", "i002", 1.0, 3)]


def test_low_band_fills_up_from_above(spark):
    """A group with few items in the top bands takes the rest from lower ones, in order."""
    data = [("a", "top", 100.0, ""), ("a", "low1", 1.0, ""), ("a", "low2", 2.0, "")] + [("b", f"i{k}", 50.0 + k, "") for k in range(300)]
    got = [r for r in run(spark, data) if r[0] == "a"]
    assert got == [("a", "low1", 1.0, 3), ("a", "low2", 2.0, 2), ("a", "top", 100.0, 1)]


@pytest.mark.parametrize("data", [[], [(None, None, None, None)]])
def test_empty(spark, data):
    assert run(spark, data) == []
