"""Depression filling, undrained cells and flats, on two levels: inside tiles in numpy, between tiles on a graph of their borders.

Filling and flats pass over the cells a fixed number of times, however many tiles there are. What lies between is a graph of the
borders: watersheds of a tile's border cells with the levels at which they spill, or border cells of a flat with the steps between them.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.operators.packed import NULL, over_tiles, packed, unpacked
from freshet.operators.tiles import DIRECTIONS, FLAT, OUTSIDE, SIZE, SOLVED_AT_ONCE, STEPS, around, least_steps, relax, spill_levels
from freshet.sources.store import landed

FAR = 1 << 30


def fill_depressions(cells: DataFrame, epsilon: float = 0.0, size: int = SIZE, four: bool = False, at_once: int = SOLVED_AT_ONCE) -> DataFrame:
    """cells with w: the least level at which water at a cell reaches the domain's edge (minimax over paths, plus epsilon a step).

    Without epsilon, tiles are flooded from their borders, which parts them into the watersheds of border cells; where two of them
    touch is the level at which one spills into the other, inside a tile or across its border. A watershed's way out is the minimax
    over that graph, and a cell's level the larger of that and its own inside the tile. With epsilon a level depends on the number of
    steps, so tiles are relaxed until none moves.
    """
    if epsilon < 0:
        raise ValueError("an epsilon is not negative")
    if epsilon:
        return _fill_sloping(cells, epsilon, size, four)
    tiles = fill_tiles(landed(packed(cells, size, ["cell", "r", "c", "z"]), "packed"), size, four, at_once)
    return unpacked(tiles, ["cell", "r", "c", "raw", "z"], {"z": "w"}).select("cell", "r", "c", F.col("raw").cast(cells.schema["z"].dataType).alias("z"), "w")


def _forest(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Places of a least spanning forest of edges: over it, minimax levels are those over all edges."""
    order = np.lexsort((v, u, w))
    over = {}

    def top(x: int) -> int:
        while (y := over.get(x, x)) != x:
            over[x] = x = over.get(y, y)
        return x

    kept = []
    for i, a, b in zip(order.tolist(), u[order].tolist(), v[order].tolist(), strict=True):
        a, b = top(a), top(b)
        if a != b:
            over[a] = b
            kept.append(i)
    return np.array(kept, "i8")


def fill_tiles(tiles: DataFrame, size: int, four: bool = False, at_once: int = SOLVED_AT_ONCE) -> DataFrame:
    """Packed tiles (cell, r, c, z and rims) with z filled and raw as it was."""
    steps = [(a, b) for k, a, b in DIRECTIONS if not four or a == 0 or b == 0]

    def flood(part: pd.DataFrame) -> dict:
        own, cell = part["own"].to_numpy(), part["cell"].to_numpy()
        near, every = around(part, steps), around(part, STEPS, True)
        edge = own & (every < 0).any(axis=0)
        border = own & ((every >= 0) & ~own[every]).any(axis=0)
        z, at = part["z"].tolist(), near.T.tolist()
        w, label = list(z), [None] * len(part)
        queued = edge | border
        heap = [(z[i], i) for i in np.flatnonzero(queued).tolist()]
        heapq.heapify(heap)
        for i in np.flatnonzero(edge).tolist():
            label[i] = OUTSIDE
        queued, names, spills = queued.tolist(), cell.tolist(), {}
        while heap:
            level, i = heapq.heappop(heap)
            if label[i] is None:
                label[i] = names[i]  # a border cell that no lower one has reached begins a watershed
            mine = label[i]
            for j in at[i]:
                if j < 0:
                    continue
                if (other := label[j]) is None:
                    label[j] = mine
                    if not queued[j]:
                        queued[j] = True
                        w[j] = max(z[j], level)
                        heapq.heappush(heap, (w[j], j))
                elif other != mine:
                    pair = (mine, other) if mine < other else (other, mine)
                    over = max(level, w[j])
                    if over < spills.get(pair, math.inf):
                        spills[pair] = over
        n = int(own.sum())  # own cells come first
        known = np.array([NULL if x is None else x for x in label[:n]], "i8")
        return {**{k: part[k].to_numpy()[:n] for k in ("cell", "r", "c", "z")}, "raw": w[:n], "label": known, "named": np.unique(known[known >= 0]), "u": [a for a, _ in spills], "v": [b for _, b in spills], "w": list(spills.values())}

    def meet(part: pd.DataFrame, spills: dict) -> dict:
        own, z, label = (part[k].to_numpy() for k in ("own", "z", "label"))
        at = around(part, steps, True)
        k, i = np.nonzero((at >= 0) & own & ~own[at])
        j = at[k, i]
        good = (label[i] < label[j]) & (label[i] != NULL)
        i, j = i[good], j[good]
        u, v = np.concatenate([spills["u"], label[i]]), np.concatenate([spills["v"], label[j]])
        w = np.concatenate([spills["w"], np.maximum(z[i], z[j])])
        kept = _forest(u, v, w)
        return {"u": u[kept], "v": v[kept], "w": w[kept]}

    names = ["cell", "r", "c", "z", "raw", "label", "named", "u", "v", "w"]
    local = landed(over_tiles(tiles, flood, size, ["cell", "r", "c", "z"], names, ["r", "c", "z", "label"]), "watersheds")
    edges = unpacked(over_tiles(local, meet, size, ["r", "c", "z", "label"], ["u", "v", "w"], apart=["u", "v", "w"]), ["u", "v", "w"])
    # A watershed bears the id of a border cell of its tile, so the tile that needs its level is the one that names it.
    named = unpacked(local, ["named"], {"named": "label"}, placed=True)
    level = spill_levels(edges, at_once).where(F.col("node") != OUTSIDE)
    levels = named.join(level.withColumnRenamed("node", "label").hint("merge"), "label")

    def fill(part: pd.DataFrame, levels: dict) -> dict:
        label, w = part["label"].to_numpy(), part["raw"].to_numpy()  # raw: the levels inside the tile
        if len(keys := levels["label"]):
            order = np.argsort(keys)
            keys, values = keys[order], levels["level"][order]
            at = np.minimum(np.searchsorted(keys, label), len(keys) - 1)
            w = np.where(keys[at] == label, np.maximum(w, values[at]), w)
        return {"cell": part["cell"].to_numpy(), "r": part["r"].to_numpy(), "c": part["c"].to_numpy(), "z": w, "raw": part["z"].to_numpy()}

    return landed(over_tiles(local, fill, size, ["cell", "r", "c", "z", "raw", "label"], ["cell", "r", "c", "z", "raw"], ["cell", "r", "c", "z"], given=levels, rim=False), "filled")


def _fill_sloping(cells: DataFrame, epsilon: float, size: int, four: bool) -> DataFrame:
    if (top := cells.agg(F.max(F.abs("z")).alias("top")).first()["top"]) is not None and np.float32(top) + np.float32(epsilon) == np.float32(top):
        raise ValueError(f"an epsilon of {epsilon} vanishes beside levels of {top} in single precision")
    steps = [(a, b) for k, a, b in DIRECTIONS if not four or a == 0 or b == 0]
    start = cells.select("cell", "r", "c", "z", F.lit(None).cast("double").alias("w"))

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        z, before = part["z"].to_numpy(), part["w"].to_numpy()
        near = around(part, steps)
        if fresh := np.isnan(before).any():  # the first round: water is level with the ground at the domain's edge
            before = np.where(part["own"] & (around(part, STEPS, True) < 0).any(axis=0), z, math.inf)
        # The last place stands for no neighbour and cannot be lowered.
        can = np.maximum(np.append(z, 0.0)[near], before + epsilon) < np.append(before, -math.inf)[near]
        start = np.flatnonzero(can.any(axis=0))
        if not len(start):
            return part.assign(w=before, moved=fresh)[part["own"]]
        w, ground, at = before.tolist(), z.tolist(), near.T.tolist()
        heap = [(w[i], i) for i in start.tolist()]
        heapq.heapify(heap)
        while heap:
            level, i = heapq.heappop(heap)
            if level > w[i]:
                continue
            for j in at[i]:
                if j >= 0 and (new := max(ground[j], level + epsilon)) < w[j]:
                    w[j] = new
                    heapq.heappush(heap, (new, j))
        return part.assign(w=w, moved=fresh | (np.array(w) != before))[part["own"]]

    return relax(start, kernel, size)


def undrained(cells: DataFrame, size: int = SIZE) -> DataFrame:
    """cells with undrained: whether no path to the domain's edge exists that never rises."""
    start = cells.select("cell", "r", "c", "z", F.lit(-1).alias("dry"))

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        z, known = part["z"].to_numpy(), part["dry"].to_numpy()
        near = around(part, STEPS)
        fresh = (known < 0).any()  # the first round: cells at the domain's edge drain
        before = part["own"].to_numpy() & (around(part, STEPS, True) < 0).any(axis=0) if fresh else known > 0
        open_ = (near >= 0) & (np.append(z, 0.0)[near] >= z)
        dry, todo = before.copy(), before.copy()
        while todo.any():
            reached = np.zeros(len(z), bool)
            reached[near[:, todo][open_[:, todo]]] = True
            todo = reached & ~dry
            dry |= todo
        return part.assign(dry=dry.astype("int32"), moved=fresh | (dry != before))[part["own"]]

    return relax(start, kernel, size).select("cell", "r", "c", "z", (F.col("dry") == 0).alias("undrained"))


def _spread(d: np.ndarray, near: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Least steps from the cells that have some, over neighbours of the same flat."""
    d = d.copy()
    todo = d < FAR
    while todo.any():
        ways = same[:, todo]
        to, new = near[:, todo][ways], np.broadcast_to(d[todo] + 1, ways.shape)[ways]
        was = d.copy()
        np.minimum.at(d, to, new)
        todo = d < was
    return d


def resolve_flats(directed: DataFrame, cellsize: float = 1.0, size: int = SIZE, at_once: int = SOLVED_AT_ONCE) -> DataFrame:
    """directed with flats drained: flowdir replaced, flat (was one) and resolved.

    On a flat, a cell's rank is (peak - steps from higher ground) + 2 * steps to a place that drains, where peak is the largest
    such step count of all; cells that no draining place reaches stay flat. Steps are counted inside tiles first; where a flat reaches a
    tile's border, its border cells and the steps between them form a graph, over which both counts are made whole, and a second pass
    takes them from the border into the tile. A third pass chooses directions.
    """
    names = ["cell", "r", "c", "z", "flowdir"]
    found = flat_tiles(landed(packed(directed, size, names), "packed"), size, cellsize, at_once)
    return unpacked(found, [*names, "flat", "resolved"]).select("cell", "r", "c", F.col("z").cast(directed.schema["z"].dataType).alias("z"), "flowdir", "flat", "resolved")


def flat_tiles(tiles: DataFrame, size: int, cellsize: float = 1.0, at_once: int = SOLVED_AT_ONCE) -> DataFrame:
    """Packed tiles (cell, r, c, z, flowdir and rims) with flats drained: flowdir replaced, flat, resolved and next, the cell drained to."""

    def ways(part: pd.DataFrame, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The flat cells, their neighbours among them and which of these are of the same flat."""
        at, z = np.flatnonzero(mine), part["z"].to_numpy()
        order = np.full(len(part), -1)
        order[at] = np.arange(len(at))
        every = around(part, STEPS)[:, at]
        near = np.where(every >= 0, order[every], -1)
        return at, near, (near >= 0) & (z[every] == z[at])

    def count(part: pd.DataFrame) -> dict:
        own, z, code, cell = (part[k].to_numpy() for k in ("own", "z", "flowdir", "cell"))
        n = int(own.sum())
        at, near, same = ways(part, own & (code == FLAT))
        every = around(part, STEPS, True)[:, at]
        there, lying = every >= 0, (code == FLAT)[every]
        high = np.where((there & (z[every] > z[at])).any(axis=0), 1, FAR)
        low = np.where((there & ~lying & (z[every] <= z[at])).any(axis=0), 1, FAR)
        high, low = _spread(high, near, same), _spread(low, near, same)
        across = there & ~own[every] & lying & (z[every] == z[at])
        gates = np.flatnonzero(across.any(axis=0))
        k, i = np.nonzero(across & (cell[at] < cell[every]))
        u, v, d = [cell[at[i]]], [cell[every[k, i]]], [np.ones(len(i), "i8")]
        for g in gates.tolist():
            far = np.full(len(at), FAR)
            far[g] = 0
            far = _spread(far, near, same)
            other = gates[(gates > g) & (far[gates] < FAR)]
            u, v, d = [*u, np.full(len(other), cell[at[g]])], [*v, cell[at[other]]], [*d, far[other]]
        whole = {k: np.full(n, FAR, "i8") for k in ("high", "low")}
        whole["high"][at], whole["low"][at] = high, low
        some = {"node": cell[at[gates]], "g_high": high[gates], "g_low": low[gates], "u": np.concatenate(u), "v": np.concatenate(v), "d": np.concatenate(d)}
        return {**{k: part[k].to_numpy()[:n] for k in names}, **whole, **some}

    names = ["cell", "r", "c", "z", "flowdir"]
    local = landed(over_tiles(tiles, count, size, names, [*names, "high", "low", "node", "g_high", "g_low", "u", "v", "d"]), "flats")
    gates = landed(unpacked(local, ["node", "g_high", "g_low"], {"g_high": "high", "g_low": "low"}, placed=True), "gates")
    known = gates.select("node", "tr", "tc").join(least_steps(gates, unpacked(local, ["u", "v", "d"]), ["high", "low"], at_once), "node")

    def enter(part: pd.DataFrame, gated: dict) -> dict:
        at, near, same = ways(part, part["flowdir"].to_numpy() == FLAT)
        out, order = {k: part[k].to_numpy() for k in names}, np.argsort(out_cell := part["cell"].to_numpy())
        where = order[np.searchsorted(out_cell[order], gated["node"])]
        for k in ("high", "low"):
            whole = part[k].to_numpy().copy()
            whole[where] = np.minimum(whole[where], gated[k])
            whole[at] = _spread(whole[at], near, same)
            out[k] = whole
        inside = out["high"][out["high"] < FAR]
        return {**out, "peak": [inside.max(initial=0)]}

    ranks = ["high", "low"]
    steps = landed(over_tiles(local, enter, size, [*names, *ranks], [*names, *ranks, "peak"], [*names, *ranks], given=known, rim=False), "flats")
    peak = unpacked(steps, ["peak"]).agg(F.coalesce(F.max("peak"), F.lit(0)).alias("peak")).first()["peak"]
    codes = np.array([k for k, _, _ in DIRECTIONS])
    far = np.array([math.hypot(a, b) * cellsize for a, b in STEPS])[:, None]

    def choose(part: pd.DataFrame) -> dict:
        n = int(part["own"].sum())
        z, code, high, low, cell = (part[k].to_numpy() for k in ("z", "flowdir", "high", "low", "cell"))
        was = code == FLAT
        can = was & (low < FAR)
        rank = np.where(can, np.where(high < FAR, peak - high, peak) + 2 * low, 0)
        every = around(part, STEPS, True)
        there = (every >= 0) & (z[every] <= z) & (can[every] & (z[every] == z) | ~was[every])
        drop = np.where(there & can, (rank - np.where(can[every], rank[every], 0)) / far, 0.0)
        best = drop.argmax(axis=0)  # the first of equal drops has the lowest code
        good = drop.max(axis=0) > 0
        code = np.where(good, codes[best], code)
        way = np.full(256, -1)
        way[codes] = np.arange(8)
        way = np.where(code > 0, way[np.maximum(code, 0)], -1)
        to = np.where(way >= 0, every[way, np.arange(len(part))], -1)
        out = {"flowdir": code, "flat": was, "resolved": good, "next": np.where(to >= 0, cell[to], NULL)}
        return {**{k: part[k].to_numpy()[:n] for k in ("cell", "r", "c", "z")}, **{k: x[:n] for k, x in out.items()}}

    return over_tiles(steps, choose, size, [*names, *ranks], [*names, "flat", "resolved", "next"])
