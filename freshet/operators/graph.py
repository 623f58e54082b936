"""Functional graphs (one receiver per node) and components, in a logarithmic number of joins.

Where the nodes have a tile (a bounded set of near nodes), paths and components are first contracted inside each tile in numpy. Only
the nodes that another tile points to take part in the joins then, and the path length that the joins halve counts tiles, not nodes.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.sources.store import landed, written

ROUNDS = 60


def tile_of(r: Column, c: Column, size: int = 256) -> Column:
    """One number per tile of size x size cells."""
    return (F.floor(r / F.lit(size)) * F.lit(1 << 31) + F.floor(c / F.lit(size))).cast("long")


def _settled(df: DataFrame, condition: str) -> bool:
    return df.where(condition).limit(1).count() == 0


def _local_pointers(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of each row's receiver in the part (-1 if it leaves the part or ends), the receivers, and whether a row ends its path."""
    node, to, ends = (part[k].to_numpy() for k in ("node", "next", "ends"))
    order = np.argsort(node)
    at = np.minimum(np.searchsorted(node[order], to), len(node) - 1)
    return np.where((node[order][at] == to) & ~ends, order[at], -1), to, ends


def local_paths(part: pd.DataFrame) -> pd.DataFrame:
    """node, out, done, cost and amount: where a node's path leaves its tile (or ends, if done), and the cost of getting there.

    amount is the weight that leaves the tile at the row itself. Rows on a cycle keep their receiver, so that the joins meet it.
    """
    p, to, ends = _local_pointers(part)
    node, step, weight = (part[k].to_numpy() for k in ("node", "step", "weight"))
    me = np.arange(len(node))
    stop = p < 0
    far, cost = np.where(stop, me, p), np.where(stop, 0.0, step)
    for _ in range(len(node).bit_length() + 1):
        cost, far = cost + cost[far], far[far]
    round_ = ~stop[far]
    done = ends[far] & ~round_
    out = np.where(round_, to, np.where(done, node[far], to[far]))
    cost = np.where(round_, step, cost + np.where(done, 0.0, step[far]))
    amount = np.where(stop & ~ends, np.bincount(far[~round_], weight[~round_], len(node)), 0.0)
    return pd.DataFrame({"node": node, "out": out, "done": done, "cost": cost, "amount": amount})


def local_sums(part: pd.DataFrame) -> pd.DataFrame:
    """node and total, over the paths inside the tile."""
    p, _, _ = _local_pointers(part)
    total = part["weight"].to_numpy().copy()
    while (go := p >= 0).any():
        total = total + np.bincount(p[go], total[go], len(p))
        p = np.where(go, p[p], -1)
    return pd.DataFrame({"node": part["node"].to_numpy(), "total": total})


def _tiled(edges: DataFrame, step: Column, weight: Column, tile: str) -> DataFrame:
    return edges.select("node", F.coalesce("next", "node").alias("next"), F.col("next").isNull().alias("ends"), step.cast("double").alias("step"), weight.cast("double").alias("weight"), F.col(tile).alias("tile"))


def _contracted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths inside tiles, and those of them that begin where another tile's path goes on."""
    paths = landed(rows.groupBy("tile").applyInPandas(local_paths, "node long, out long, done boolean, cost double, amount double"), "paths")
    entries = paths.where("NOT done").select(F.col("out").alias("node")).distinct()
    return paths, paths.join(entries, "node", "left_semi")


def _doubled(state: DataFrame) -> DataFrame:
    """node, root, cost from (node, at, cost, done): pointers double each round."""
    state = landed(state, "pointers")
    for _ in range(ROUNDS):
        if _settled(state, "NOT done"):
            return state.select("node", F.col("at").alias("root"), "cost")
        target = state.select(F.col("node").alias("at"), F.col("at").alias("far"), F.col("cost").alias("more"), F.col("done").alias("end"))
        joined = state.where("NOT done").join(target, "at")
        moved = joined.select("node", F.col("far").alias("at"), (F.col("cost") + F.col("more")).alias("cost"), F.col("end").alias("done"))
        state = landed(state.where("done").unionByName(moved), "pointers")
    raise ValueError("the receivers hold a cycle")


def resolve(edges: DataFrame, cost: str | None = None, tile: str | None = None) -> DataFrame:
    """node, root and cost of every node of edges (node, next[, cost][, tile]): the last node of its path and the path's summed cost.

    next is null at a root. Pointers double each round, so a path of length n takes log2(n) joins on the node; with tile (a column of
    edges), n counts the tiles on the path. A pointer that is still not settled after all rounds lies on a cycle, which is an error.
    """
    step = F.when(F.col("next").isNull(), F.lit(0.0)).otherwise(F.col(cost) if cost else F.lit(1.0)).cast("double")
    if tile is None:
        return _doubled(edges.select("node", F.coalesce("next", "node").alias("at"), step.alias("cost"), F.col("next").isNull().alias("done")))
    paths, entries = _contracted(_tiled(edges, step, F.lit(0.0), tile))
    ways = _doubled(entries.select("node", F.col("out").alias("at"), "cost", "done")).select(F.col("node").alias("out"), "root", F.col("cost").alias("more"))
    rest = paths.where("NOT done").join(ways, "out").select("node", "root", (F.col("cost") + F.col("more")).alias("cost"))
    return paths.where("done").select("node", F.col("out").alias("root"), "cost").unionByName(rest)


def doubled_sums(state: DataFrame) -> DataFrame:
    """node and total from (node, at, total): what has reached a node doubles its distance each round."""
    state = landed(state, "sums")
    for _ in range(ROUNDS):
        if _settled(state, "at IS NOT NULL"):
            return state.select("node", "total")
        gained = state.where("at IS NOT NULL").groupBy(F.col("at").alias("node")).agg(F.sum("total").alias("gain"))
        far = state.select(F.col("node").alias("at"), F.col("at").alias("far"))
        state = landed(state.join(far, "at", "left").join(gained, "node", "left").select("node", F.col("far").alias("at"), (F.col("total") + F.coalesce("gain", F.lit(0.0))).alias("total")), "sums")
    raise ValueError("the receivers hold a cycle")


def subtree_sums(edges: DataFrame, weight: str, tile: str | None = None) -> DataFrame:
    """node and total: the weights of a node and of all nodes whose paths lead through it. edges: node, next (null at a root)[, tile].

    With tile, the joins carry only what enters a tile from others; a second pass over the tiles spreads it along the paths inside.
    """
    if tile is None:
        return doubled_sums(edges.select("node", F.col("next").alias("at"), F.col(weight).cast("double").alias("total")))
    rows = _tiled(edges, F.lit(1.0), F.col(weight), tile)
    paths, entries = _contracted(rows)
    given = paths.where("amount <> 0").groupBy(F.col("out").alias("node")).agg(F.sum("amount").alias("total"))
    start = entries.join(given, "node", "left").select("node", F.when(~F.col("done"), F.col("out")).alias("at"), F.coalesce("total", F.lit(0.0)).alias("total"))
    entered = doubled_sums(start)
    full = rows.join(entered, "node", "left").withColumn("weight", F.col("weight") + F.coalesce("total", F.lit(0.0))).drop("total")
    return full.groupBy("tile").applyInPandas(local_sums, "node long, total double")


def local_components(part: pd.DataFrame) -> pd.DataFrame:
    """node and label (the least node) of the components of the edges inside a tile."""
    nodes, at = np.unique(part[["u", "v"]].to_numpy().T.ravel(), return_inverse=True)
    u, v = at[: len(part)], at[len(part) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], least)
        np.minimum.at(new, label[v], least)
        while (far := new[new]).tobytes() != new.tobytes():
            new = far
        if (new == label).all():
            return pd.DataFrame({"node": nodes, "label": nodes[label]})
        label = new


def spread_join(rows: DataFrame, facts: DataFrame, key: str, by: str, how: str = "inner", counts: DataFrame | None = None, total: int | None = None, parts: int = 2000, tasks: int | None = None) -> DataFrame:
    """rows joined with facts on key, such that no task gets a key whole that holds more than 1/parts of all rows (or 64).

    There are fewer than `parts` such keys, which bounds what the driver learns: they go into the plan as values, in tiers of 4, 16,
    64, ... salts. Their rows are dealt over the salts by a hash of the column `by`, and their facts are repeated for every salt.
    Without such a key it is a plain join. counts (key and n, its rows; better a written table) and total (all rows) save counting
    where they are known; else rows should be a written table. how: inner or left. tasks: over how many both sides are dealt, where
    few bytes stand for much work, as Spark sizes its tasks by bytes.
    """
    dealt = lambda df, *keys: df.repartition(tasks, *keys) if tasks else df
    if counts is None:
        counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    share = max(64.0, (rows.count() if total is None else total) / parts)
    tiers: dict[int, list] = {}
    for r in counts.where(F.col("n") > share).select(key, "n").collect():  # fewer than parts
        tiers.setdefault(4 ** math.ceil(math.log(r["n"] / share, 4)), []).append(r[key])
    if not tiers:
        return dealt(rows, key).join(dealt(facts, key), key, how)
    salts = F.lit(1)
    for n, keys in sorted(tiers.items()):
        salts = F.when(F.col(key).isin(keys), n).otherwise(salts)
    left = rows.withColumn("salt_", F.pmod(F.xxhash64(by), salts).cast("int"))
    right = facts.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.coalesce(salts, F.lit(1)) - 1)))
    return dealt(left, key, "salt_").join(dealt(right, key, "salt_"), [key, "salt_"], how).drop("salt_")


def _stars(edges: DataFrame) -> DataFrame:
    """node and label by alternating large and small stars, until a round changes nothing."""

    def least(e: DataFrame, total: int) -> DataFrame:
        found = written(e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "least")
        return spread_join(e, found.drop("n"), "u", "v", counts=found.select("u", "n"), total=total)

    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen, total = None, now.count()
    while total:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least(both, 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = least(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), total)
        now = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            break
        seen, total = state, state["n"]
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))


def components(edges: DataFrame, tile: Callable[[Column], Column] | None = None) -> DataFrame:
    """node and label (the least node connected to it) for all nodes of edges (u, v).

    tile gives a node's tile; edges inside tiles are contracted there, and the stars join the tiles' components only.
    """
    if tile is None:
        return _stars(edges)
    placed = landed(edges.where("u <> v").select("u", "v", tile(F.col("u")).alias("tile"), (tile(F.col("u")) == tile(F.col("v"))).alias("inside")), "edges")
    local = landed(placed.where("inside").select("u", "v", "tile").groupBy("tile").applyInPandas(local_components, "node long, label long"), "labels")
    name = lambda k: local.select(F.col("node").alias(k), F.col("label").alias(f"l{k}"))
    between = placed.where("NOT inside").join(name("u"), "u", "left").join(name("v"), "v", "left").select(F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v"))
    whole = landed(_stars(between), "labels")
    alone = whole.join(local, "node", "left_anti").select("node", F.col("node").alias("label"))
    final = whole.select(F.col("node").alias("label"), F.col("label").alias("least"))
    return local.unionByName(alone).join(final, "label", "left").select("node", F.coalesce("least", "label").alias("label"))
