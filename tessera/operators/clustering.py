"""Clusters of a neighbour graph by modularity, the test for clusters that only follow a bias, and transfer of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.stats import rank_quantile
from tessera.functions.tails import binomial_upper_p
from tessera.operators.graph import exact_neighbours, vote
from tessera.session import discard, materialise


def _move(edges: DataFrame, degree: DataFrame, total: float, resolution: float, rounds: int) -> DataFrame:
    """(id, group): nodes moved, a half of them at a time, to the neighbouring group that gains most modularity, until none moves."""
    labels = materialise(degree.select("id", F.col("id").alias("group"), "k"), "labels")
    for i in range(2 * rounds):
        sums = labels.groupBy("group").agg(F.sum("k").alias("_s"))
        around = edges.where(F.col("a") != F.col("b")).join(labels.select(F.col("id").alias("b"), "group"), "b").groupBy("a", "group").agg(F.sum("weight").alias("_w"))
        stay = labels.select(F.col("id").alias("a"), "group", F.lit(0.0).alias("_w"))
        options = around.unionByName(stay).groupBy("a", "group").agg(F.sum("_w").alias("_w")).join(sums, "group")
        options = options.join(labels.select(F.col("id").alias("a"), F.col("group").alias("_own"), "k"), "a")
        others = F.col("_s") - F.when(F.col("group") == F.col("_own"), F.col("k")).otherwise(0.0)
        options = options.withColumn("_gain", F.col("_w") - resolution * F.col("k") * others / total)
        best = F.max(F.struct(F.round("_gain", 9).alias("g"), (F.col("group") == F.col("_own")).cast("int").alias("s"), (-F.col("group")).alias("n"))).alias("_b")
        new = options.groupBy(F.col("a").alias("id")).agg(best, F.first("_own").alias("_own"), F.first("k").alias("k"))
        turn = F.pmod(F.xxhash64("id"), F.lit(2)) == i % 2
        new = new.select("id", F.when(turn, -F.col("_b.n")).otherwise(F.col("_own")).alias("group"), "k", (turn & (-F.col("_b.n") != F.col("_own"))).alias("_moved"))
        new = materialise(new, "labels")
        moved = new.where("_moved").limit(1).count()
        discard(labels)
        labels = new.drop("_moved")
        labels.tessera_path = new.tessera_path
        if not moved and i % 2:
            break
    return labels.select("id", "group")


def modularity_clusters(edges: DataFrame, resolution: float = 0.8, levels: int = 10, rounds: int = 4) -> DataFrame:
    """(id, group): groups of a weighted graph (a, b, weight; ids are integers, each edge once) of high modularity at ``resolution``.

    Nodes move to the neighbouring group of greatest gain; groups then become the nodes of a smaller graph, until none merge.
    Every step is joins and sums; ties stay, then go to the smaller group.  The number of rounds of a level is bounded, which
    bears on how good the groups are, not on which nodes have one.
    """
    both = edges.select("a", "b", "weight").unionByName(edges.where(F.col("a") != F.col("b")).select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    graph = materialise(both.groupBy("a", "b").agg(F.sum("weight").cast("double").alias("weight")), "edges")
    placed: DataFrame | None = None
    for _ in range(levels):
        degree = materialise(graph.groupBy(F.col("a").alias("id")).agg(F.sum("weight").alias("k")), "degree")
        total = degree.agg(F.sum("k")).first()[0]
        if not total:
            break
        labels = _move(graph, degree, total, resolution, rounds)
        merged = labels.where(F.col("id") != F.col("group")).limit(1).count()
        step = labels.select(F.col("id").alias("group"), F.col("group").alias("_to"))
        placed = labels if placed is None else materialise(placed.join(step, "group").select("id", F.col("_to").alias("group")), "placed")
        if not merged:
            break
        x, y = labels.select(F.col("id").alias("a"), F.col("group").alias("_a")), labels.select(F.col("id").alias("b"), F.col("group").alias("_b"))
        smaller = graph.join(x, "a").join(y, "b").groupBy(F.col("_a").alias("a"), F.col("_b").alias("b")).agg(F.sum("weight").alias("weight"))
        old, graph = graph, materialise(smaller, "edges")
        discard(old)
    return placed if placed is not None else graph.select(F.col("a").alias("id"), F.col("a").alias("group"))


def modularity(edges: DataFrame, groups: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of (id, group) in a graph (a, b, weight) in which each edge stands once."""
    both = edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    placed = both.join(groups.select(F.col("id").alias("a"), F.col("group").alias("_a")), "a").join(groups.select(F.col("id").alias("b"), F.col("group").alias("_b")), "b")
    sums = placed.groupBy("_a").agg(F.sum("weight").alias("k"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("weight")).otherwise(0.0)).alias("inside"))
    total = F.sum("k")
    return sums.agg(F.sum("inside") / total - resolution * F.sum(F.col("k") * F.col("k")) / (total * total)).first()[0]


def biased_clusters(
    groups: DataFrame, bias: DataFrame, quantiles: tuple[float, float] = (0.05, 0.95), share: float = 0.01, enrich: float = 10.0, proportion: float = 0.5, p: float = 0.05, draws: int = 500,
) -> DataFrame:
    """One row for each group (id, group) of less than ``share`` of all: whether it is but an extreme of ``bias`` (id, value).

    Values become rank quantiles.  At either end, the members beyond the quantile are compared with as many rows drawn from the other
    groups: ``enrichment`` is their number over the median of such draws, ``p`` twice the chance of more, at least 1 / ``draws``.  The chance
    is that of the binomial distribution, which repeated drawing only estimates.
    """
    ranked = materialise(rank_quantile(groups.join(bias.select("id", "value"), "id"), "value", "_q"), "ranked")
    high, low = F.count(F.when(F.col("_q") >= max(quantiles), 1)), F.count(F.when(F.col("_q") <= min(quantiles), 1))
    counts = ranked.groupBy("group").agg(F.count(F.lit(1)).alias("n"), high.alias("_high"), low.alias("_low"))
    totals = counts.agg(F.sum("n").alias("_n"), F.sum("_high").alias("_h"), F.sum("_low").alias("_l"))
    out = counts.crossJoin(F.broadcast(totals)).where(F.col("n") < share * F.col("_n"))  # one row
    for name, mine, all_ in (("_1", "_high", "_h"), ("_2", "_low", "_l")):
        rest = (F.col(all_) - F.col(mine)) / (F.col("_n") - F.col("n"))
        out = out.withColumn(f"e{name}", F.col(mine) / F.greatest(F.round(F.col("n") * rest), F.lit(1.0)))
        out = out.withColumn(f"p{name}", F.least(F.lit(1.0), F.greatest(F.lit(1.0 / draws), 2 * binomial_upper_p(F.col(mine) + 1, "n", rest))))
    first = F.col("e_1") > F.col("e_2")
    out = out.select("group", "n", F.when(first, F.col("e_1")).otherwise(F.col("e_2")).alias("enrichment"), F.when(first, F.col("p_1")).otherwise(F.col("p_2")).alias("p"), (F.when(first, F.col("_high")).otherwise(F.col("_low")) / F.col("n")).alias("proportion"))
    return out.withColumn("biased", (F.col("enrichment") > enrich) & (F.col("proportion") > proportion) & (F.col("p") <= p))


def without_bias(groups: DataFrame, biased: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """(id, group) with the members of biased groups given to the group of most of their ``k`` nearest (id, v) in other groups."""
    bad = groups.join(F.broadcast(biased.where("biased").select("group")), "group", "left_semi")  # groups under a share of all
    good = groups.join(F.broadcast(biased.where("biased").select("group")), "group", "left_anti")
    near = exact_neighbours(vectors.join(good.select("id"), "id", "left_semi"), vectors.join(bad.select("id"), "id", "left_semi"), "id", "v", k)
    moved = vote(near, good, "group").select(F.col("query").alias("id"), "group")
    return good.select("id", "group").unionByName(moved.select("id", "group"))


def transfer_labels(reference: DataFrame, query: DataFrame, labels: DataFrame, k: int = 30) -> DataFrame:
    """(query, label, score): for vectors (id, v) of one table the commonest label (id, label) of the ``k`` nearest in another, with its share of them; ties go to the smaller label."""
    marked = reference.join(labels.select("id"), "id", "left_semi")
    near = materialise(exact_neighbours(marked, query, "id", "v", k, keep_self=True), "near")
    voted = vote(near, labels, "label")
    n = near.groupBy("query").agg(F.count(F.lit(1)).alias("_n"))
    return voted.join(n, "query").select("query", "label", (F.col("votes") / F.col("_n")).alias("score"))
