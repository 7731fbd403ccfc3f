"""One group identifier for all records linked directly or over others.

Minimum labels are propagated across the links and the resulting pointers are
jumped until they reach a root; then every link is carried over to the roots of
its ends, and what remains (far fewer, distinct links) goes into the next round.  Each round
is a written table, and the rounds end when no link between two roots is left,
that is when no label changes any more.

A root to which very many nodes point is a hot key of the joins; adaptive execution splits
its partition, which it finds by its size after the shuffle, so that nothing is counted for it beforehand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import discard, materialise
from tessera.sources.tables import table


def _jump(parents: DataFrame, scope: list[str]) -> DataFrame:
    """Let every pointer (u -> p, p < u) point to its root; each step follows two pointers one after the other."""
    while True:
        up = parents.select(*scope, F.col("u").alias("p"), F.col("p").alias("pp"))
        up2 = parents.select(*scope, F.col("u").alias("pp"), F.col("p").alias("ppp"))
        stepped = parents.join(up.join(up2, [*scope, "pp"], "left"), [*scope, "p"], "left")
        stepped = stepped.select(*scope, "u", F.coalesce("ppp", "pp", "p").alias("p"), F.col("ppp").isNotNull().alias("_moved"))
        new = materialise(stepped, "pointers")
        moved = new.where("_moved").limit(1).count()
        discard(parents)
        parents = new.drop("_moved")
        parents.tessera_path = new.tessera_path
        if not moved:
            return parents


def components(links: DataFrame, scope: list[str], a: str, b: str, out: str = "group_id") -> DataFrame:
    """Columns scope, ``node`` and ``out``, one row for every node with a link to another node.

    A node is named by ``scope`` and an integer; links join nodes of one scope in both
    directions.  ``out`` is the smallest node of the group.  Links with a null
    in ``scope``, ``a`` or ``b``, and links of a node with itself, are no links.
    Repeats and both directions of a pair change nothing; extra columns are ignored; no links give no rows.
    """
    low, high = F.least(a, b).cast("long"), F.greatest(a, b).cast("long")
    sound = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    for s in scope:
        sound = sound & F.col(s).isNotNull()
    edges = materialise(links.where(sound).select(*scope, low.alias("v"), high.alias("u")).distinct(), "links")
    both = edges.select(*scope, F.col("u").alias("node")).unionByName(edges.select(*scope, F.col("v").alias("node")))
    labels = materialise(both.distinct().withColumn("root", F.col("node")), "labels")
    while edges.limit(1).count():
        parents = materialise(edges.groupBy(*scope, "u").agg(F.min("v").alias("p")), "parents")
        parents = _jump(parents, scope)
        at_u = parents.select(*scope, "u", F.col("p").alias("_pu"))
        at_v = parents.select(*scope, F.col("u").alias("v"), F.col("p").alias("_pv"))
        moved2 = edges.join(at_u, [*scope, "u"], "left").join(at_v, [*scope, "v"], "left")
        x, y = F.coalesce("_pu", "u"), F.coalesce("_pv", "v")
        rest = moved2.where(x != y).select(*scope, F.least(x, y).alias("v"), F.greatest(x, y).alias("u")).distinct()
        old_edges, edges = edges, materialise(rest, "links")
        at_root = parents.select(*scope, F.col("u").alias("root"), F.col("p").alias("_p"))
        relabelled = labels.join(at_root, [*scope, "root"], "left")
        old_labels, labels = labels, materialise(relabelled.select(*scope, "node", F.coalesce("_p", "root").alias("root")), "labels")
        for t in (old_edges, old_labels, parents):
            discard(t)
    discard(edges)
    return labels.select(*scope, "node", F.col("root").alias(out))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Peaks linked by a correlation of 0.5 to 1, with the smallest idx of their group."""
    rows = table(spark, root, "coaccessibility").select("seqnames", "idx1", "idx2", "correlation")
    links = rows.where(F.col("correlation").between(0.5, 1.0))  # false for null; NaN is above 1
    out = components(links, ["seqnames"], "idx1", "idx2", "group_idx")
    return out.select("seqnames", F.col("node").alias("idx"), "group_idx")


QUERIES = {"p6_found": p6_found}

SQL = {
    "p6_found": """
WITH RECURSIVE e AS (
       SELECT DISTINCT seqnames, idx1 AS a, idx2 AS b FROM coaccessibility
       WHERE correlation >= 0.5 AND correlation <= 1.0 AND NOT isnan(correlation) AND idx1 <> idx2 AND seqnames IS NOT NULL),
     d AS (SELECT seqnames, a, b FROM e UNION SELECT seqnames, b, a FROM e),
     r AS (SELECT seqnames, a AS idx, a AS g FROM d UNION SELECT r.seqnames, d.b, r.g FROM r JOIN d ON r.seqnames = d.seqnames AND r.idx = d.a WHERE r.g < d.b)
SELECT seqnames, idx, min(g) AS group_idx FROM r GROUP BY seqnames, idx"""
}
