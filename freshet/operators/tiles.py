"""Cells in tiles: direction codes, rims, and small graphs between tiles that are solved at once or, beyond a size, in rounds of joins."""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.operators.graph import components
from freshet.sources.store import landed

# Direction codes and their row and column steps, in the order that breaks ties.
DIRECTIONS = [(1, 0, 1), (2, 1, 1), (4, 1, 0), (8, 1, -1), (16, 0, -1), (32, -1, -1), (64, -1, 0), (128, -1, 1)]
NODATA, OUTLET, FLAT = 0, -1, -2
STEPS = [(a, b) for _, a, b in DIRECTIONS]
#: Side of a tile where nothing else is said.
SIZE = 256
#: Edges of a graph between tiles that one task solves (24 bytes each); larger ones take rounds of joins.
SOLVED_AT_ONCE = 1_000_000
#: The node that stands for what lies outside the domain.
OUTSIDE = -1


def neighbour_messages(cells: DataFrame, values: list[str], four: bool = False) -> DataFrame:
    """r, c of a neighbour, the code of the direction from it back to the sender, the distance, and the sender's values."""
    steps = [d for d in DIRECTIONS if not four or d[1] == 0 or d[2] == 0]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("code"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(math.hypot(dr, dc)).alias("far")) for k, dr, dc in steps]))
    sent = cells.select("r", "c", *[F.col(v).alias(f"n_{v}") for v in values], each.alias("d"))
    return sent.select((F.col("r") - F.col("d.dr")).alias("r"), (F.col("c") - F.col("d.dc")).alias("c"), F.col("d.code").alias("code"), F.col("d.far").alias("far"), *[f"n_{v}" for v in values])


def place(size: int) -> tuple[Column, Column]:
    """Row and column of the tile of a cell (r, c)."""
    return tuple(F.floor(F.col(k) / F.lit(float(size))).cast("int") for k in ("r", "c"))


def rim(cells: DataFrame, size: int) -> DataFrame:
    """cells with (tr, tc, own): once in the own tile, and once in each tile that the cell touches; only cells on a tile's border are copied."""
    tr, tc = place(size)
    here = F.struct(tr.alias("tr"), tc.alias("tc"))
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    at = lambda x, d: F.floor((F.col(x) + d) / F.lit(float(size))).cast("int")
    copies = F.array_distinct(F.transform(steps, lambda s: F.struct(at("r", s["a"]).alias("tr"), at("c", s["b"]).alias("tc"))))
    inside = F.pmod("r", F.lit(size)).between(1, size - 2) & F.pmod("c", F.lit(size)).between(1, size - 2)
    spread = cells.withColumn("t", F.explode(F.when(inside, F.array(here)).otherwise(copies)))
    return spread.select(*cells.columns, F.col("t.tr").alias("tr"), F.col("t.tc").alias("tc"), ((F.col("t.tr") == tr) & (F.col("t.tc") == tc)).alias("own"))


def around(part: pd.DataFrame, steps: list[tuple[int, int]], rim: bool = False) -> np.ndarray:
    """For each step, the place in part of each row's neighbour if that is an own cell of the tile (or of its rim, if rim), else -1."""
    r, c = part["r"].to_numpy() - part["r"].min() + 1, part["c"].to_numpy() - part["c"].min() + 1
    at = np.full((r.max() + 2, c.max() + 2), -1)
    own = np.arange(len(part)) if rim or "own" not in part else np.flatnonzero(part["own"].to_numpy())
    at[r[own], c[own]] = own
    return np.stack([at[r + a, c + b] for a, b in steps])


def relax(cells: DataFrame, kernel, size: int) -> DataFrame:
    """Apply kernel to tiles and their rims until no row says `moved`; kernel returns the tile's own rows, same columns.

    After the first round only the tiles beside one that moved are given to the kernel again; the others keep their rows. What the
    kernel changes only falls, so the rounds come to an end, however many a large grid needs.
    """
    state = landed(cells.withColumn("moved", F.lit(True)), "tiles")
    schema, names = state.schema, cells.columns
    tr, tc = place(size)
    beside = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("d")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return kernel(part)[[*names, "moved"]]

    state = landed(rim(state.select(*names), size).groupBy("tr", "tc").applyInPandas(run, schema), "tiles")
    while state.where("moved").limit(1).count():
        near = state.where("moved").select(tr.alias("tr"), tc.alias("tc")).distinct().select("tr", "tc", beside)
        active = landed(near.select((F.col("tr") + F.col("d.a")).alias("tr"), (F.col("tc") + F.col("d.b")).alias("tc")).distinct(), "active")
        again = rim(state.select(*names), size).join(active, ["tr", "tc"], "left_semi").groupBy("tr", "tc").applyInPandas(run, schema)
        rest = state.withColumns({"tr": tr, "tc": tc}).join(active, ["tr", "tc"], "left_anti").select(*names, F.lit(False).alias("moved"))
        state = landed(again.unionByName(rest), "tiles")
    return state.select(*names)


def spill_levels(edges: DataFrame, at_once: int = SOLVED_AT_ONCE) -> DataFrame:
    """node and level: the least level over which water at a node reaches OUTSIDE, along edges (u, v, w); minimax over paths.

    The level of a set of nodes without OUTSIDE is at least its least edge to another set, and it need not be more before it is joined
    there. So each round every set takes its least edge and joins, until the edges that are left are few enough for one task.
    """
    pair = lambda e: e.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w").groupBy("u", "v").agg(F.min("w").alias("w"))
    now = landed(pair(edges), "spills")
    state = None  # node, its set, and its level so far
    while now.count() > at_once:
        if state is None:
            nodes = now.select("u").union(now.select("v")).distinct().where(F.col("u") != OUTSIDE)
            state = landed(nodes.select(F.col("u").alias("node"), F.col("u").alias("set"), F.lit(-math.inf).alias("level")), "spills")
        both = now.select("u", "v", "w", F.struct("w", "u", "v").alias("k")).unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"), "w", F.struct("w", "u", "v").alias("k")))
        least = landed(both.where(F.col("u") != OUTSIDE).groupBy("u").agg(F.min_by("v", "k").alias("v"), F.min("w").alias("w")), "spills")
        sets = landed(components(least.select("u", "v")), "spills")
        moved = state.join(least.select(F.col("u").alias("set"), "w"), "set", "left").join(sets.select(F.col("node").alias("set"), "label"), "set", "left")
        state = landed(moved.select("node", F.coalesce("label", "set").alias("set"), F.greatest("level", F.coalesce("w", F.lit(-math.inf))).alias("level")), "spills")
        name = lambda k: sets.select(F.col("node").alias(k), F.col("label").alias(f"l{k}"))
        now = landed(pair(now.join(name("u"), "u", "left").join(name("v"), "v", "left").select(F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v"), "w")), "spills")

    def minimax(part: pd.DataFrame) -> pd.DataFrame:
        ways = defaultdict(list)
        for u, v, w in zip(part["u"].tolist(), part["v"].tolist(), part["w"].tolist(), strict=True):
            ways[u].append((v, w))
            ways[v].append((u, w))
        found, heap = {}, [(-math.inf, OUTSIDE)]
        while heap:
            level, u = heapq.heappop(heap)
            if u not in found:
                found[u] = level
                for v, w in ways[u]:
                    if v not in found:
                        heapq.heappush(heap, (max(level, w), v))
        return pd.DataFrame({"node": list(found), "level": list(found.values())})

    last = now.groupBy(F.lit(0).alias("all")).applyInPandas(lambda part: minimax(part), "node long, level double")  # at most `at_once` edges
    if state is None:
        return last
    rest = last.select(F.col("node").alias("set"), F.col("level").alias("more"))
    return state.join(rest, "set", "left").select("node", F.greatest("level", F.coalesce("more", F.lit(-math.inf))).alias("level"))


def least_steps(nodes: DataFrame, edges: DataFrame, names: list[str], at_once: int = SOLVED_AT_ONCE) -> DataFrame:
    """node and, for each of names, the least number of steps: a node's own (a column of nodes, long) or another's plus the edges (u, v, d)."""
    both = landed(edges.select("u", "v", "d").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "d")).groupBy("u", "v").agg(F.min("d").alias("d")), "steps")
    now = landed(nodes.select("node", *names), "steps")
    if both.count() <= 2 * at_once and now.count() <= at_once:

        def shortest(part: pd.DataFrame) -> pd.DataFrame:
            ways = defaultdict(list)
            start = part[part["v"].isna()]
            for u, v, d in part.loc[part["v"].notna(), ["u", "v", "d"]].astype("int64").itertuples(index=False):
                ways[u].append((v, d))
            out = {"node": start["u"].to_numpy()}
            for name in names:
                best = dict(zip(start["u"].tolist(), start[name].astype("int64").tolist(), strict=True))
                heap = [(d, u) for u, d in best.items()]
                heapq.heapify(heap)
                while heap:
                    d, u = heapq.heappop(heap)
                    if d == best[u]:
                        for v, more in ways[u]:
                            if d + more < best[v]:
                                best[v] = d + more
                                heapq.heappush(heap, (d + more, v))
                out[name] = [best[u] for u in start["u"].tolist()]
            return pd.DataFrame(out)

        none = [F.lit(None).cast("long").alias(k) for k in names]
        rows = both.select("u", "v", "d", *none).unionByName(now.select(F.col("node").alias("u"), F.lit(None).cast("long").alias("v"), F.lit(None).cast("long").alias("d"), *names))
        return rows.groupBy(F.lit(0).alias("all")).applyInPandas(lambda part: shortest(part), f"node long, {', '.join(f'{k} long' for k in names)}")
    while True:
        sent = both.join(now.select(F.col("node").alias("u"), *names), "u").groupBy(F.col("v").alias("node")).agg(*[F.min(F.col(k) + F.col("d")).alias(f"n_{k}") for k in names])
        lower = F.lit(False)
        for k in names:
            lower = lower | (F.coalesce(F.col(f"n_{k}"), F.col(k)) < F.col(k))
        step = landed(now.join(sent, "node", "left").select("node", *[F.least(F.col(k), F.coalesce(f"n_{k}", k)).alias(k) for k in names], lower.alias("moved")), "steps")
        if step.where("moved").limit(1).count() == 0:
            return step.select("node", *names)
        now = step.select("node", *names)
