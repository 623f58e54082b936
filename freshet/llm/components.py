"""Connected components by alternating star contractions, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import spread_join, written


def _least(edges: DataFrame, total: int) -> DataFrame:
    """u, v and m, the least of u and all its neighbours.

    The least neighbour is pre-aggregated where the edges lie, and comes back to a node of many edges on salted keys.
    """
    least = written(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "least")
    return spread_join(edges, least.drop("n"), "u", "v", counts=least.select("u", "n"), total=total)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both, 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _least(down, total)
    return found.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(found.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and label, the least node of its component, for every node of an edge; edges has long columns u and v.

    Each round moves every edge towards the least node that it can see, until all components are stars: a logarithmic number of
    rounds. Every round is written to the shared folder, so the lineage stays short; one count tells whether all are stars.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while total := now.count():
        now = written(_small_star(_large_star(now, total).where("u <> v"), total), "edges")
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if seen.where("up > 1 OR up > 0 AND down > 0").limit(1).count() == 0:
            break
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))


def joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (node, label) after further links (u, v): only the components that they join are looked at again.

    label must be a written table, links too.
    """
    end = lambda k: label.select(F.col("node").alias(k), F.col("label").alias(f"l{k}"))
    named = spread_join(spread_join(links, end("u"), "u", "v", "left"), end("v"), "v", "u", "left", links.groupBy("v").agg(F.count("*").alias("n")), links.count())
    over = written(components(named.select(F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v"))).select(F.col("node").alias("label"), F.col("label").alias("least")), "joined")
    # A label that is no node so far is a node of its own component.
    new = over.join(label.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), F.col("least").alias("label"))
    return spread_join(label, over, "label", "node", "left").select("node", F.coalesce("least", "label").alias("label")).unionByName(new)
