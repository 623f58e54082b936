"""Terrain operators over cell tables (cell, r, c, z): conditioning, D8 routing, accumulation, streams, height above drainage.

A row is a valid cell; cells outside the domain are absent, so that no sentinel takes part in a comparison. Neighbour work is one
message per neighbour, joined by cell; paths are pointer doubling; depression filling and flats work on tiles in numpy and on a graph of
their borders, so no grid is ever whole in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.operators.conditioning import fill_depressions, fill_tiles, flat_tiles, resolve_flats, undrained  # noqa: F401
from freshet.operators.graph import components, doubled_sums, local_components, local_paths, local_sums, resolve, spread_join, subtree_sums, tile_of
from freshet.operators.packed import NULL, over_tiles, packed, unpacked
from freshet.operators.tiles import DIRECTIONS, FLAT, NODATA, OUTLET, SIZE, STEPS, around, neighbour_messages
from freshet.sources.store import landed


def valid_cells(raw: DataFrame, nodata: float | None = None) -> DataFrame:
    """Rows whose z is finite and not nodata."""
    good = F.col("z").isNotNull() & ~F.isnan("z") & (F.abs("z") != float("inf"))
    return raw.where(good if nodata is None else good & (F.col("z") != nodata))


def cell_id(r: Column, c: Column, cols: int) -> Column:
    return (r * F.lit(cols) + c).cast("long")


def receivers(directed: DataFrame, cols: int) -> DataFrame:
    """directed with next: the cell that a cell drains to, null for outlets, flats and what leaves the domain."""
    dr, dc = F.lit(None).cast("int"), F.lit(None).cast("int")
    for code, a, b in DIRECTIONS:
        dr, dc = F.when(F.col("flowdir") == code, a).otherwise(dr), F.when(F.col("flowdir") == code, b).otherwise(dc)
    to = directed.withColumn("next", cell_id(F.col("r") + dr, F.col("c") + dc, cols))
    known = directed.select(F.col("cell").alias("next"), F.lit(True).alias("known"))
    return to.join(known, "next", "left").select(*directed.columns, F.when(F.col("known"), F.col("next")).alias("next"))


def _edges(routed: DataFrame, size: int, *more: Column) -> DataFrame:
    """node, next and tile (by r and c) of routed."""
    return routed.select(F.col("cell").alias("node"), "next", tile_of(F.col("r"), F.col("c"), size).alias("tile"), *more)


def steps_to_outlet(routed: DataFrame, size: int = SIZE) -> DataFrame:
    """cell, steps (cells of the path, the cell itself included) and outlet (its last cell); routed: cell, r, c, next."""
    found = resolve(_edges(routed, size), tile="tile")
    return found.select(F.col("node").alias("cell"), (F.col("cost") + 1).cast("long").alias("steps"), F.col("root").alias("outlet"))


def flow_accumulation(routed: DataFrame, weight: Column | None = None, size: int = SIZE) -> DataFrame:
    """cell and accumulation: the weights (1 each by default) of all cells that drain through a cell (cell, r, c, next), itself included."""
    found = subtree_sums(_edges(routed, size, (weight if weight is not None else F.lit(1.0)).alias("weight")), "weight", "tile")
    return found.select(F.col("node").alias("cell"), F.col("total").alias("accumulation"))


def flow_direction(cells: DataFrame, cellsize: float = 1.0, size: int = SIZE) -> DataFrame:
    """Steepest descent: direction code, or OUTLET where none is lower beside the domain's edge, or FLAT; ties to the lowest code.

    Tiles see their rims, so that a cell is shuffled about once and not once per neighbour.
    """
    found = direction_tiles(landed(packed(cells, size, ["cell", "r", "c", "z"]), "packed"), size, cellsize)
    return unpacked(found, ["cell", "r", "c", "z", "flowdir"]).select("cell", "r", "c", F.col("z").cast(cells.schema["z"].dataType).alias("z"), "flowdir")


def direction_tiles(tiles: DataFrame, size: int, cellsize: float = 1.0) -> DataFrame:
    """Packed tiles (cell, r, c, z and rims) with flowdir."""
    codes = np.array([k for k, _, _ in DIRECTIONS])
    far = np.array([math.hypot(a, b) * cellsize for a, b in STEPS])[:, None]
    names = ["cell", "r", "c", "z", "flowdir"]

    def kernel(part: pd.DataFrame) -> dict:
        n = int(part["own"].sum())
        near, z = around(part, STEPS, True), part["z"].to_numpy().astype("float32")
        slope = np.where(near >= 0, (z - z[near]).astype("float64") / far, 0.0)
        best = slope.argmax(axis=0)  # the first of equal slopes has the lowest code
        code = np.where(slope.max(axis=0) > 0, codes[best], np.where((near < 0).any(axis=0), OUTLET, FLAT))
        return {**{k: part[k].to_numpy()[:n] for k in ("cell", "r", "c", "z")}, "flowdir": code[:n]}

    return landed(over_tiles(tiles, kernel, size, ["cell", "r", "c", "z"], names, names), "directions")


def routed_tiles(flats: DataFrame, size: int) -> DataFrame:
    """Packed tiles (flats with next) with accumulation: what flows inside tiles is summed there, the joins carry what passes from tile to tile."""
    names = ["cell", "r", "c", "z", "flowdir", "flat", "resolved", "next"]

    def edges(part: pd.DataFrame) -> pd.DataFrame:
        cell, to = part["cell"].to_numpy(), part["next"].to_numpy()
        return pd.DataFrame({"node": cell, "next": np.where(to == NULL, cell, to), "ends": to == NULL, "step": 0.0, "weight": 1.0})

    def contract(part: pd.DataFrame) -> dict:
        paths = local_paths(edges(part))
        gone = paths[paths["amount"] != 0].groupby("out")["amount"].sum()
        r, c = part["r"].to_numpy() % size, part["c"].to_numpy() % size
        border = (r == 0) | (r == size - 1) | (c == 0) | (c == size - 1)  # only these are entered from other tiles
        at = np.where(paths["done"], NULL, paths["out"])
        return {**{k: part[k].to_numpy() for k in names}, "node": paths["node"].to_numpy()[border], "at": at[border], "out": gone.index.to_numpy(), "amount": gone.to_numpy()}

    local = landed(over_tiles(flats, contract, size, names, [*names, "node", "at", "out", "amount"], rim=False), "paths")
    given = unpacked(local, ["out", "amount"], {"out": "node", "amount": "total"}).groupBy("node").agg(F.sum("total").alias("total"))
    start = landed(unpacked(local, ["node", "at"], placed=True).join(given.hint("merge"), "node"), "entries")
    entered = start.select("node", "tr", "tc").join(doubled_sums(start.select("node", "at", "total")), "node")

    def spread(part: pd.DataFrame, entered: dict) -> dict:
        rows = edges(part)
        weight, order = rows["weight"].to_numpy().copy(), np.argsort(rows["node"].to_numpy())
        weight[order[np.searchsorted(rows["node"].to_numpy()[order], entered["node"])]] += entered["total"]
        return {**{k: part[k].to_numpy() for k in names}, "accumulation": local_sums(rows.assign(weight=weight))["total"].to_numpy()}

    return over_tiles(local, spread, size, names, [*names, "accumulation"], given=entered, rim=False)


# Streams.


def stream_mask(accumulated: DataFrame, threshold: float) -> DataFrame:
    """Cells whose accumulation reaches the threshold."""
    return accumulated.where((F.col("accumulation") >= threshold) & (F.col("flowdir") != NODATA))


def prune_streams(streams: DataFrame, min_length: int = 5, passes: int = 20) -> DataFrame:
    """Remove head branches (cell, next) that end or meet a junction in fewer than min_length cells; again until none is left."""
    now = streams
    if min_length <= 1:
        return now
    for _ in range(passes):
        ups = now.where("next IS NOT NULL").groupBy(F.col("next").alias("cell")).agg(F.count("*").alias("ups"))
        state = landed(now.join(ups, "cell", "left").select("cell", "next", F.coalesce("ups", F.lit(0)).alias("ups")), "branches")
        walk = state.where("ups = 0").select("cell", F.array("cell").alias("path"), F.col("next").alias("at"), F.lit(False).alias("ended"))
        there = state.select(F.col("cell").alias("at"), F.col("next").alias("far"), F.col("ups").alias("n"))
        for _ in range(min_length - 1):
            stop = F.col("n").isNull() | (F.col("n") > 1)
            walk = walk.join(there, "at", "left").select("cell", F.when(F.col("ended") | stop, F.col("path")).otherwise(F.concat("path", F.array("at"))).alias("path"), F.when(F.col("ended") | stop, F.lit(None).cast("long")).otherwise(F.col("far")).alias("at"), (F.col("ended") | stop).alias("ended"))
        gone = landed(walk.where(F.size("path") < min_length).select(F.explode("path").alias("cell")).distinct(), "pruned")
        if gone.limit(1).count() == 0:
            return state.select("cell", "next")
        left = state.join(gone, "cell", "left_anti").select("cell", "next")
        now = landed(left.join(left.select(F.col("cell").alias("next"), F.lit(1).alias("in")), "next", "left").select("cell", F.when(F.col("in") == 1, F.col("next")).alias("next")), "branches")
    return now


def stream_links(streams: DataFrame, cols: int, size: int = SIZE) -> DataFrame:
    """cell, start (first cell of its link), seq (place in the link) and link (rank of the start among all starts).

    A link begins at a stream cell with no or several stream cells above it. The rank is counted over range partitions, not in one.
    """
    ups = streams.where("next IS NOT NULL").groupBy(F.col("next").alias("cell")).agg(F.count("*").alias("n"), F.max("cell").alias("up"))
    back = streams.join(ups, "cell", "left").select(F.col("cell").alias("node"), F.when(F.col("n") == 1, F.col("up")).alias("next"), tile_of(F.floor(F.col("cell") / cols), F.col("cell") % cols, size).alias("tile"))
    found = landed(resolve(back, tile="tile").select(F.col("node").alias("cell"), F.col("root").alias("start"), F.col("cost").cast("long").alias("seq")), "links")
    ranks = dense_rank(found.select("start").distinct(), "start").select("start", F.col("rank").alias("link"))
    return found.join(ranks, "start").select("cell", "start", "seq", "link")


def dense_rank(keys: DataFrame, key: str) -> DataFrame:
    """Distinct keys with rank 0, 1, ... in order: ranks inside range partitions plus the partitions' starts."""
    from pyspark.sql import Window

    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = landed(keys.repartitionByRange(parts, key).withColumn("part", F.spark_partition_id()), "ranks")
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row per partition
    start, at = {}, 0
    for part, n in sizes:
        start[part], at = at, at + n
    offset = F.lit(0)
    if start:
        offset = F.element_at(F.create_map(*[x for p, s in start.items() for x in (F.lit(p), F.lit(s))]), F.col("part"))
    return placed.withColumn("rank", (F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1 + offset).cast("long")).drop("part")


def link_tree(streams: DataFrame, links: DataFrame) -> DataFrame:
    """link, down (the link below, null at an outlet) and cells."""
    last = links.groupBy("link").agg(F.max_by("cell", "seq").alias("cell"), F.count("*").alias("cells"))
    below = last.join(streams.select("cell", "next"), "cell").join(links.select(F.col("cell").alias("next"), F.col("link").alias("down")), "next", "left")
    return below.select("link", "down", "cells")


def strahler(tree: DataFrame) -> DataFrame:
    """link and strahler order of a link tree (link, down).

    A link is of order k + 1 or more exactly if it, or a link above it, has two tributaries of order k or more. So each round counts
    tributaries and marks what lies below: sums along the paths. Rounds are as many as the highest order, at most the logarithm of
    the links, and each works on half of the links at most; no basin is one task.
    """
    level = landed(tree.select("link", "down"), "order")
    found = level.select("link")
    while True:
        joined = level.where("down IS NOT NULL").groupBy(F.col("down").alias("link")).agg(F.count("*").alias("n")).where("n > 1").select("link", F.lit(1.0).alias("seed"))
        if joined.limit(1).count() == 0:
            return found.groupBy("link").agg(F.count("*").cast("int").alias("strahler"))
        seeded = landed(level.join(joined, "link", "left").select(F.col("link").alias("node"), F.col("down").alias("next"), F.coalesce("seed", F.lit(0.0)).alias("seed")), "order")
        above = subtree_sums(seeded, "seed").where("total > 0").select(F.col("node").alias("link"))
        level = landed(level.join(above, "link", "left_semi"), "order")
        found = found.unionByName(level.select("link"))


def stream_network(streams: DataFrame, links: DataFrame, accumulated: DataFrame, cols: int, cellsize: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """One row per link of two or more points: its line through cell centres and on to the next link, length, accumulation, order."""
    centre = lambda cell: F.struct((F.lit(x0) + (cell % cols + 0.5) * cellsize).alias("x"), (F.lit(y0) - (F.floor(cell / cols) + 0.5) * cellsize).alias("y"))
    tree = link_tree(streams, links)
    own = links.join(accumulated.select("cell", "accumulation"), "cell").select("link", "seq", centre(F.col("cell")).alias("p"), "accumulation")
    heads = links.where("seq = 0").select(F.col("link").alias("down"), centre(F.col("start")).alias("p"))
    ends = tree.join(heads, "down").select("link", F.col("cells").alias("seq"), "p", F.lit(None).cast("double").alias("accumulation"))
    line = own.unionByName(ends).groupBy("link").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "p"))), lambda s: s["p"]).alias("line"), F.min_by("accumulation", "seq").alias("acc_head"), F.max("accumulation").alias("acc_outflow"))
    pairs = F.zip_with(F.slice("line", 1, F.size("line") - 1), F.slice("line", 2, F.size("line") - 1), lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"]))
    length = F.aggregate(pairs, F.lit(0.0), lambda s, d: s + d)
    return line.where(F.size("line") >= 2).select("link", "line", length.alias("length_m"), "acc_head", "acc_outflow").join(tree, "link").join(strahler(tree), "link").withColumn("terminates", F.col("down").isNull())


def hand(filled: DataFrame, streams: DataFrame, size: int = SIZE) -> DataFrame:
    """cell, drainage (the first stream cell on its path) and hand (height above it); null where no stream is met."""
    mark = streams.select("cell", F.lit(True).alias("stream"))
    edges = filled.join(mark, "cell", "left").select("cell", "r", "c", F.when(F.col("stream"), F.lit(None).cast("long")).otherwise(F.col("next")).alias("next"))
    roots = resolve(_edges(edges, size), tile="tile").select(F.col("node").alias("cell"), "root")
    level = filled.select("cell", F.col("z").cast("double").alias("z"))
    low = streams.select(F.col("cell").alias("root")).join(level.select(F.col("cell").alias("root"), F.col("z").alias("z0")), "root")
    return level.join(roots, "cell").join(low, "root", "left").select("cell", F.when(F.col("z0").isNotNull(), F.col("root")).alias("drainage"), (F.col("z") - F.col("z0")).alias("hand"))


def reach_catchments(drained: DataFrame, links: DataFrame) -> DataFrame:
    """drained with the link (reach) of each cell's drainage cell."""
    return drained.join(links.select(F.col("cell").alias("drainage"), F.col("link").alias("reach")), "drainage", "left").select("cell", "drainage", "hand", "reach")


# Channel geometry (regional regressions on drainage area in km2).

# Coefficient and exponent of bankfull depth and width over drainage area (km2, m), and the greatest depth.
DEPTH, WIDTH, DEEPEST = (0.381, 0.246), (4.774, 0.321), 8.0


def channel_depth(area_km2: Column, law: tuple[float, float] = DEPTH, most: float = DEEPEST) -> Column:
    return F.when(area_km2 > 0, F.least(F.lit(law[0]) * F.pow(area_km2, F.lit(law[1])), F.lit(most))).otherwise(F.lit(0.0))


def channel_width(area_km2: Column, law: tuple[float, float] = WIDTH) -> Column:
    return F.when(area_km2 > 0, F.lit(law[0]) * F.pow(area_km2, F.lit(law[1]))).otherwise(F.lit(0.0))


def burn_channel(cells: DataFrame, streams: DataFrame, cellsize: float, depth: tuple[float, float] = DEPTH, width: tuple[float, float] = WIDTH) -> DataFrame:
    """cells with burned: z lowered by the channel's depth, also beside stream cells whose channel is wider than a cell.

    streams: cell, accumulation (cells). As many rings as the widest channel reaches beyond its cell are grown over the four neighbours;
    in each, a cell takes the greatest depth around it if one of its neighbours is a stream cell with a channel wider than a cell (its
    own width, which rings do not hand on). Nothing wraps around the grid's edge.
    """
    area = F.col("accumulation") * (cellsize * cellsize / 1e6)
    channel = landed(streams.select("cell", channel_depth(area, depth).alias("depth"), channel_width(area, width).alias("width")), "channel")
    now = cells.join(channel, "cell", "left").select("cell", "r", "c", "z", F.coalesce("depth", F.lit(0.0)).alias("depth"), F.coalesce("width", F.lit(0.0)).alias("width"))
    widest = channel.agg(F.max("width").alias("w")).first()["w"] or 0.0
    rings = max(0, math.floor((widest / cellsize - 1) / 2))
    if rings:
        wide = neighbour_messages(now.where(F.col("width") > cellsize), ["width"], four=True).select("r", "c").distinct()
        now = landed(now.join(wide.withColumn("wide", F.lit(True)), ["r", "c"], "left").select("cell", "r", "c", "z", "depth", F.coalesce("wide", F.lit(False)).alias("wide")), "burn")
    for _ in range(rings):
        sent = neighbour_messages(now.where("depth > 0"), ["depth"], four=True).groupBy("r", "c").agg(F.max("n_depth").alias("d"))
        now = landed(now.join(sent, ["r", "c"], "left").select("cell", "r", "c", "z", F.when(F.col("wide"), F.greatest("depth", F.coalesce("d", F.lit(0.0)))).otherwise(F.col("depth")).alias("depth"), "wide"), "burn")
    return now.select("cell", "r", "c", "z", (F.col("z") - F.col("depth")).alias("burned"))


def connected_to(wet: DataFrame, seeds: DataFrame, cols: int, four: bool = False, size: int = SIZE) -> DataFrame:
    """Of wet (cell, r, c; a written table), the cells whose connected component holds a seed (cell); one pool may hold most of them."""
    steps = [(a, b) for _, a, b in DIRECTIONS if not four or a == 0 or b == 0]
    names = ["cell", "r", "c", "label"]

    def label(part: pd.DataFrame) -> dict:
        cell, near = part["cell"].to_numpy(), around(part, steps)
        k, i = np.nonzero(near >= 0)
        found = local_components(pd.DataFrame({"u": cell[i], "v": cell[near[k, i]]}))
        nodes, labels = found["node"].to_numpy(), found["label"].to_numpy()
        whole = cell.copy()
        if len(nodes):
            at = np.minimum(np.searchsorted(nodes, cell), len(nodes) - 1)
            whole = np.where(nodes[at] == cell, labels[at], cell)
        return {**{k: part[k].to_numpy() for k in ("cell", "r", "c")}, "label": whole, "named": np.unique(whole), "node": np.unique(whole[part["seed"].to_numpy()])}

    def meet(part: pd.DataFrame) -> dict:
        own, mine, near = part["own"].to_numpy(), part["label"].to_numpy(), around(part, steps, True)
        k, i = np.nonzero((near >= 0) & own & ~own[near])
        pairs = np.unique(np.stack([mine[i], mine[near[k, i]]]), axis=1)
        return {"u": pairs[0], "v": pairs[1]}

    def keep(part: pd.DataFrame, good: dict) -> dict:
        kept = np.isin(part["label"].to_numpy(), good["label"])
        return {k: part[k].to_numpy()[kept] for k in ("cell", "r", "c")}

    marked = wet.select("cell", "r", "c").join(seeds.select("cell", F.lit(True).alias("in")).distinct(), "cell", "left").select("cell", "r", "c", F.coalesce("in", F.lit(False)).alias("seed"))
    tiles = packed(marked, size, ["cell", "r", "c", "seed"])
    local = landed(over_tiles(tiles, label, size, ["cell", "r", "c", "seed"], [*names, "named", "node"], ["r", "c", "label"], rim=False), "named")
    whole = landed(components(unpacked(over_tiles(local, meet, size, ["r", "c", "label"], ["u", "v"]), ["u", "v"]).where("u < v")), "labels").withColumnRenamed("label", "whole")
    known = lambda k: unpacked(local, [k], {k: "node"}, placed=True).join(whole, "node", "left").select("tr", "tc", "node", F.coalesce("whole", "node").alias("whole"))
    good = spread_join(landed(known("named"), "named"), known("node").select("whole").distinct(), "whole", "node").select("tr", "tc", F.col("node").alias("label"))
    return unpacked(over_tiles(local, keep, size, names, ["cell", "r", "c"], given=good, rim=False), ["cell", "r", "c"])
