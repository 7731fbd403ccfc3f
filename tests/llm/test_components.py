import random

from tessera.llm.components import components

SCHEMA = "s string, a long, b long, node string"


def brute(data):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for s, a, b, _ in data:
        if None not in (s, a, b) and a != b:
            x, y = find((s, a)), find((s, b))
            parent[max(x, y)] = min(x, y)
    return sorted((s, n, find((s, n))[1]) for s, n in parent)


def run(spark, data):
    return sorted(tuple(r) for r in components(spark.createDataFrame(data, SCHEMA), ["s"], "a", "b", "g").collect())


def test_chains_hubs_and_dirt(spark):
    random.seed(1)
    chain = [("c", k, k + 1, "") for k in random.sample(range(200), 200)]
    down = [("d", 1000 - k, 999 - k, None) for k in range(100)]
    hub = [("h", 500, k, "") for k in range(300) if k != 137]
    noise = [("r", random.randrange(300), random.randrange(300), "") for _ in range(200)]
    dirt = [(None, 1, 2, ""), ("c", None, 2, ""), ("c", 900, None, ""), ("q", 5, 5, ""), ("c", 7, 7, "")]
    data = chain + down + hub + noise + dirt + hub[:50] + [(s, b, a, x) for s, a, b, x in noise[:80]]
    random.shuffle(data)
    assert run(spark, data) == brute(data)


def test_same_node_in_two_scopes(spark):
    assert run(spark, [("x", 1, 2, ""), ("y", 2, 3, "")]) == [("x", 1, 1), ("x", 2, 1), ("y", 2, 2), ("y", 3, 2)]


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [("x", 1, 1, ""), ("x", None, 1, "")]) == []
