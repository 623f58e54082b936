"""Operators along the channel network: reach graph, signed distances to gauges, stages carried between observed gauges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.operators import graph
from freshet.operators.graph import tile_of
from freshet.operators.tiles import DIRECTIONS, SIZE
from freshet.sources.store import landed


def step_length(flowdir: Column, cellsize: float) -> Column:
    """Metres from a cell to its receiver."""
    straight = [k for k, a, b in DIRECTIONS if a == 0 or b == 0]
    return F.when(flowdir.isin(straight), cellsize).otherwise(cellsize * math.sqrt(2))


def network_distance(routed: DataFrame, gauges: DataFrame, cellsize: float, size: int = SIZE) -> DataFrame:
    """gauge, cell, distance_m for gauges (gauge, cell) and routed (cell, r, c, flowdir, next): positive upstream, negative downstream.

    A cell whose path meets the gauge's path has a distance, and the two meet at their common outlet at the latest. So the distance is
    the difference of the two ways to the outlet, and one pass over the paths serves every gauge. Cells of other outlets have no row.
    """
    edges = routed.select(F.col("cell").alias("node"), "next", step_length(F.col("flowdir"), cellsize).alias("step"), tile_of(F.col("r"), F.col("c"), size).alias("tile"))
    ways = landed(graph.resolve(edges, "step", "tile"), "ways")
    own = gauges.join(ways.select(F.col("node").alias("cell"), "root", F.col("cost").alias("at")), "cell").select("gauge", "root", "at")
    return ways.join(own, "root").select("gauge", F.col("node").alias("cell"), (F.col("cost") - F.col("at")).alias("distance_m"))


def reach_graph(links: DataFrame, streams: DataFrame, cols: int, cellsize: float) -> DataFrame:
    """reach, down (the reach below, null at an outlet) and length_m, the step into the reach below included."""
    here = links.select("cell", F.col("link").alias("reach"))
    there = links.select(F.col("cell").alias("next"), F.col("link").alias("there"))
    gap = F.abs(F.col("next") - F.col("cell"))
    step = F.when(gap.isin(1, cols), cellsize).otherwise(cellsize * math.sqrt(2))
    rows = here.join(streams.select("cell", "next"), "cell").join(there, "next", "left")
    crossing = F.col("there") != F.col("reach")
    return rows.groupBy("reach").agg(F.min_by(F.when(crossing, F.col("there")), F.when(crossing, F.col("cell"))).alias("down"), F.sum(F.when(F.col("there").isNotNull(), step).otherwise(0.0)).alias("length_m"))


def nearest_above(edges: DataFrame, marked: DataFrame) -> DataFrame:
    """node, mark, distance: the marked node nearest above each node of edges (node, next, cost), itself included; ties to the least.

    As with sums, what has reached a node doubles its distance each round.
    """
    start = edges.join(marked.select("node", F.lit(True).alias("m")), "node", "left")
    state = landed(start.select("node", F.col("next").alias("at"), "cost", F.when(F.col("m"), F.struct(F.lit(0.0).alias("distance"), F.col("node").alias("mark"))).alias("best")), "nearest")
    for _ in range(graph.ROUNDS):
        live = state.where("at IS NOT NULL")
        if live.limit(1).count() == 0:
            return state.where("best IS NOT NULL").select("node", "best.mark", "best.distance")
        came = live.where("best IS NOT NULL").groupBy(F.col("at").alias("node")).agg(F.min(F.struct((F.col("best.distance") + F.col("cost")).alias("distance"), F.col("best.mark").alias("mark"))).alias("came"))
        far = state.select(F.col("node").alias("at"), F.col("at").alias("far"), F.col("cost").alias("more"))
        state = landed(state.join(far, "at", "left").join(came, "node", "left").select("node", F.col("far").alias("at"), (F.col("cost") + F.coalesce("more", F.lit(0.0))).alias("cost"), F.least("best", "came").alias("best")), "nearest")
    raise ValueError("the receivers hold a cycle")


def interpolate_stage(reaches: DataFrame, gauges: DataFrame) -> DataFrame:
    """reach, kind, stage_m, wse_m from observed levels: reaches (reach, down, length_m, bed_m), gauges (reach, wse_m, gauge_bed_m).

    A gauged reach takes its level. Between a gauge above and one below, depth is linear in channel distance; with a gauge on one
    side only, its depth is carried. Reaches without a bed, or without any gauge on their path, have no row. Depths below 0 become 0.
    """
    depth = gauges.select("reach", "wse_m", (F.col("wse_m") - F.col("gauge_bed_m")).alias("depth"))
    edges = landed(reaches.join(depth.select("reach", F.lit(True).alias("gauged")), "reach", "left").select(F.col("reach").alias("node"), F.col("down").alias("next"), F.col("length_m").alias("cost"), "gauged"), "reaches")
    below = graph.resolve(edges.select("node", F.when(F.col("gauged").isNull(), F.col("next")).alias("next"), "cost"), "cost")
    above = nearest_above(edges, depth.select(F.col("reach").alias("node")))
    low = below.join(depth.select(F.col("reach").alias("root"), F.col("depth").alias("depth_low")), "root").select(F.col("node").alias("reach"), F.col("cost").alias("d_low"), "depth_low")
    up = above.join(depth.select(F.col("reach").alias("mark"), F.col("depth").alias("depth_up")), "mark").select(F.col("node").alias("reach"), F.col("distance").alias("d_up"), "depth_up")
    rows = reaches.where("bed_m IS NOT NULL").join(depth.select("reach", "wse_m"), "reach", "left").join(low, "reach", "left").join(up, "reach", "left")
    weight = F.coalesce(F.try_divide("d_up", F.col("d_up") + F.col("d_low")), F.lit(0.0))
    both = F.col("depth_up").isNotNull() & F.col("depth_low").isNotNull()
    carried = F.when(both, F.col("depth_up") + (F.col("depth_low") - F.col("depth_up")) * weight).otherwise(F.coalesce("depth_low", "depth_up"))
    kind = F.when(F.col("wse_m").isNotNull(), "gauged").when(both, "interpolated").when(carried.isNotNull(), "extrapolated")
    found = rows.select("reach", kind.alias("kind"), F.coalesce("wse_m", F.col("bed_m") + carried).alias("wse_m"), "bed_m").where("kind IS NOT NULL")
    return found.select("reach", "kind", F.greatest(F.col("wse_m") - F.col("bed_m"), F.lit(0.0)).alias("stage_m"), "wse_m")
