"""Exposure and damage: buildings on a grid, built-in curves, values, the ladder of discharges, intervals of draws."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions.scalar import clip, generic_class, interp
from freshet.operators.scan import touched_cells
from freshet.operators.spatial import area, centroid

NO_WATER, NO_WATER_BELOW = -1e6, -1e3

# Depths in metres of the built-in curves, and the damaged share at each, by family and class.
DEPTHS = (0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 5.0, 6.0)
CURVES = {
    "HAZUS": {
        "residential": (0.00, 0.21, 0.30, 0.37, 0.43, 0.53, 0.60, 0.65, 0.68),
        "commercial": (0.00, 0.15, 0.24, 0.31, 0.38, 0.49, 0.57, 0.62, 0.66),
        "industrial": (0.00, 0.12, 0.20, 0.27, 0.33, 0.44, 0.52, 0.58, 0.62),
        "other": (0.00, 0.16, 0.25, 0.32, 0.38, 0.49, 0.57, 0.62, 0.66),
    },
    "JRC_OCEANIA": {
        "residential": (0.00, 0.48, 0.68, 0.82, 0.90, 0.98, 1.00, 1.00, 1.00),
        "commercial": (0.00, 0.38, 0.57, 0.71, 0.81, 0.94, 0.99, 1.00, 1.00),
        "industrial": (0.00, 0.31, 0.49, 0.63, 0.74, 0.90, 0.97, 1.00, 1.00),
        "other": (0.00, 0.39, 0.58, 0.72, 0.82, 0.94, 0.99, 1.00, 1.00),
    },
    "JRC_GLOBAL": {
        "residential": (0.00, 0.25, 0.40, 0.50, 0.60, 0.75, 0.85, 0.95, 1.00),
        "commercial": (0.00, 0.22, 0.35, 0.45, 0.55, 0.70, 0.82, 0.91, 1.00),
        "industrial": (0.00, 0.15, 0.27, 0.40, 0.52, 0.70, 0.84, 0.93, 1.00),
        "other": (0.00, 0.21, 0.34, 0.45, 0.55, 0.71, 0.84, 0.93, 1.00),
    },
}
# Replacement cost of a square metre, by class.
RATES = {"residential": 2000.0, "commercial": 2500.0, "industrial": 1500.0, "other": 1800.0}


def curve_class(name: Column, known: list[str] = list(RATES), default: str = "residential") -> Column:
    """The curve's class of a building class: exact, else by prefix, else the default."""
    generic = generic_class(name)
    return F.when(name.isin(known), name).when(generic.isin(known), generic).otherwise(F.lit(default))


def damage_fraction(depth: Column, family: str, name: Column, cap: float = 6.0, shift: Column | None = None) -> Column:
    """Damaged share at a depth: capped, interpolated, the first value held below, within [0, 1]; 0 without water."""
    out = F.lit(None).cast("double")
    xs = F.array(*[F.lit(d) for d in DEPTHS])
    for k, values in CURVES[family].items():
        out = F.when(curve_class(name) == k, interp(F.least(depth, F.lit(cap)), xs, F.array(*[F.lit(v) for v in values]))).otherwise(out)
    if shift is not None:
        out = out + shift
    return F.when(depth <= NO_WATER_BELOW, 0.0).otherwise(clip(out, 0.0, 1.0))


def storeys(num_floors: Column, height: Column, storey: float = 3.0) -> Column:
    """Floors if given and positive, else height over storey rounded half to even, at least 1, else 1."""
    return F.when(num_floors > 0, num_floors).when(height > 0, F.greatest(F.bround(height / storey), F.lit(1.0))).otherwise(1.0)


def storey_exposure(depth: Column, count: Column, storey: float = 3.0) -> Column:
    """Share of the storeys that the water reaches; the ground floor always counts."""
    n = F.greatest(count, F.lit(1.0))
    return F.least(F.greatest(F.ceil(F.greatest(depth, F.lit(0.0)) / storey).cast("double"), F.lit(1.0)), n) / n


def exposed_value(area: Column, name: Column, scale: float = 1.0) -> Column:
    rate = F.lit(None).cast("double")
    for k, v in RATES.items():
        rate = F.when(curve_class(name) == k, F.lit(v)).otherwise(rate)
    return area * rate * scale


def derive_structures(raw: DataFrame) -> DataFrame:
    """Metric columns and keys of a structure inventory; missing figures count 0, missing texts ''."""
    number = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    fips = F.lpad(text("cbfips"), 15, "0")
    return raw.withColumns({"footprint_m2": number("ftprntsqft") * 0.092903, "floor_area_m2": number("sqft") * 0.092903, "found_ht_m": number("found_ht") * 0.3048, "pop_night": number("pop2amu65") + number("pop2amo65"), "pop_day": number("pop2pmu65") + number("pop2pmo65"), "num_story": F.greatest(F.coalesce("num_story", F.lit(1.0)), F.lit(1.0)), "occtype": text("occtype"), "cbfips": fips, "tract_fips": F.substring(fips, 1, 11)})


def footprints(points: DataFrame, least_side: float = 4.0) -> DataFrame:
    """xmin, ymin, xmax, ymax: a square of the footprint's area around the point (x, y)."""
    half = F.greatest(F.sqrt(F.greatest("footprint_m2", F.lit(0.0))), F.lit(least_side)) / 2
    return points.withColumns({"xmin": F.col("x") - half, "ymin": F.col("y") - half, "xmax": F.col("x") + half, "ymax": F.col("y") + half})


def zonal(units: DataFrame, cells: DataFrame, cellsize: float, least_area: float = 10.0, shape: tuple[int, int] | None = None) -> DataFrame:
    """Zonal figures of units (building_id and xmin, ymin, xmax, ymax, or rings; origin at the top left) over every cell that one touches.

    cells: r, c, depth_m, hand, reach, and unclamped (depth that may be negative) if known; a raster of `shape` has cells without a row too.
    Max, mean and 90th percentile of depth, where an undefined depth is 0; of unclamped depth (margin_*), where it is -inf; 10th
    percentile of the heights that are defined, most usual reach (least on a tie), and the figures of the centroid's own cell (centre_*).
    """
    at = lambda x: F.floor(F.col(x) / cellsize).cast("int")
    if "rings" in units.columns:
        sized = units.select("building_id", "rings", F.aggregate("rings", F.lit(0.0), lambda s, ring: s - area(ring)).alias("holes"), centroid(F.get("rings", F.lit(0))).alias("p"), (2 * area(F.get("rings", F.lit(0)))).alias("outer"))
        big = sized.where(F.col("holes") + F.col("outer") >= least_area)
        middle = big.select("building_id", at("p.x").alias("mc"), F.floor(-F.col("p.y") / cellsize).cast("int").alias("mr"))
        spread = touched_cells(big.select(F.col("building_id").alias("unit"), "rings"), cellsize).withColumnRenamed("unit", "building_id").join(middle.hint("merge"), "building_id")
    else:
        rows = F.explode(F.sequence(-F.ceil(F.col("ymax") / cellsize).cast("int"), -F.ceil(F.col("ymin") / cellsize).cast("int"))).alias("r")
        big = units.where((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")) >= least_area)
        middle = F.floor((F.col("xmin") + F.col("xmax")) / 2 / cellsize).cast("int").alias("mc"), F.floor(-((F.col("ymin") + F.col("ymax")) / 2) / cellsize).cast("int").alias("mr")
        spread = big.select("building_id", "xmin", "xmax", *middle, rows).select("building_id", "mc", "mr", "r", F.explode(F.sequence(at("xmin"), at("xmax"))).alias("c"))
    centre = (F.col("r") == F.col("mr")) & (F.col("c") == F.col("mc"))
    if shape:
        spread = spread.where((F.col("r") >= 0) & (F.col("r") < shape[0]) & (F.col("c") >= 0) & (F.col("c") < shape[1]))
    known = [c for c in ("depth_m", "hand", "reach", "unclamped") if c in cells.columns]
    found = spread.join(cells.select("r", "c", *known), ["r", "c"], "left" if shape else "inner")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    found = found.withColumn("depth_m", F.when(finite("depth_m"), F.col("depth_m")).otherwise(0.0))
    figures = {"depth": "depth_m"}
    if "unclamped" in known:
        found, figures = found.withColumn("unclamped", F.when(finite("unclamped"), F.col("unclamped")).otherwise(F.lit(-math.inf))), figures | {"margin": "unclamped"}
    out = [f for k, c in figures.items() for f in (F.max(c).alias(f"{k}_max"), F.avg(c).alias(f"{k}_mean"), F.percentile(c, F.lit(0.9)).alias(f"{k}_p90"), F.max(F.when(centre, F.col(c))).alias(f"{k}_centroid"))]
    own = [F.max(F.when(centre, F.col(c))).alias(f"centre_{c}") for c in ("hand", "reach") if c in known]
    heights = F.percentile(F.when(finite("hand"), F.col("hand")), F.lit(0.1)).alias("hand_p10")
    # A unit's cells are dealt to it as they are: sums of percentiles before the shuffle would be wider, as each cell comes from another key.
    found = found.repartition("building_id").groupBy("building_id").agg(*out, heights, F.mode("reach", True).alias("reach"), F.count("*").alias("n_cells"), *own)
    return big.select("building_id").join(found, "building_id", "left")


def regrid_sum(boxes: DataFrame, cellsize: float) -> DataFrame:
    """r, c, pop: people of source squares (xmin, xmax, ymin, ymax, pop) shared out over target cells by area, so that the sum stays.

    People that are null, negative or not a number, and squares without area, count as none.
    """
    size = F.lit(cellsize)
    good = boxes.where((F.col("pop") > 0) & ~F.isnan("pop") & (F.col("xmax") > F.col("xmin")) & (F.col("ymax") > F.col("ymin")))
    span = lambda low, high: F.explode(F.sequence(F.floor(low / size).cast("int"), F.ceil(high / size).cast("int") - 1))
    spread = good.withColumn("c", span(F.col("xmin"), F.col("xmax"))).withColumn("r", span(-F.col("ymax"), -F.col("ymin")))
    wide = F.least("xmax", (F.col("c") + 1) * size) - F.greatest("xmin", F.col("c") * size)
    tall = F.least(-F.col("ymin"), (F.col("r") + 1) * size) - F.greatest(-F.col("ymax"), F.col("r") * size)
    share = wide * tall / ((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")))
    return spread.groupBy("r", "c").agg(F.sum(F.col("pop") * share).alias("pop"))


def floor_margin(stage: Column, hand: Column, floor: Column) -> Column:
    """Water above the floor, negative while below it; NO_WATER where the water does not reach the building."""
    return F.when(stage - hand > 0, stage - hand - floor).otherwise(F.lit(NO_WATER))


def population_affected(cells: DataFrame, threshold: float = 0.3) -> DataFrame:
    """total, affected and share of people (column pop) on cells with depth of at least threshold."""
    people = F.when(F.col("pop") > 0, F.col("pop")).otherwise(0.0)
    return cells.agg(F.sum(people).alias("total"), F.sum(F.when(F.col("depth_m") >= threshold, people).otherwise(0.0)).alias("affected")).withColumn("share", F.coalesce(F.try_divide("affected", "total"), F.lit(0.0)))


def estimate(buildings: DataFrame, family: str = "HAZUS") -> DataFrame:
    """buildings (margin_m, building_class, floor_area_m2, storeys) with fraction, value and damage."""
    fraction = damage_fraction(F.col("margin_m"), family, F.col("building_class")) * storey_exposure(F.col("margin_m"), F.col("storeys"))
    valued = buildings.withColumn("fraction", fraction).withColumn("exposed", exposed_value(F.col("floor_area_m2"), F.col("building_class")))
    return valued.withColumn("damage", F.col("fraction") * F.col("exposed"))


def damage_by_class(damaged: DataFrame) -> DataFrame:
    """Totals by class and in all (class null), in one pass."""
    return damaged.rollup("building_class").agg(F.sum("damage").alias("damage"), F.sum("exposed").alias("exposed"), F.count_if(F.col("damage") > 0).alias("hit"), F.count("*").alias("n"))


def rung_arrays(stages: DataFrame) -> DataFrame:
    """reach, multipliers and levels: a reach's stage table (reach, multiplier, stage_m) as two arrays in order of the rungs."""
    rows = F.array_sort(F.collect_list(F.struct("multiplier", "stage_m")))
    return stages.groupBy("reach").agg(rows.alias("x")).select("reach", F.col("x.multiplier").alias("multipliers"), F.col("x.stage_m").alias("levels"))


def damage_ladder(buildings: DataFrame, stages: DataFrame, family: str = "HAZUS", cap: float = 6.0, storey: float = 3.0) -> DataFrame:
    """multiplier, damage, wet buildings, residents and share in the channel (height at or below 0), per rung of the stage table.

    A building meets its reach's rungs as one array, and a batch of buildings is priced at all rungs at once; what leaves a task is a
    sum a rung. The rungs are those of the stage table, the same for every reach.
    """
    rows = buildings.where("reach IS NOT NULL AND hand IS NOT NULL").join(rung_arrays(stages), "reach")
    known = list(RATES)
    kept = rows.select("multipliers", "levels", F.col("hand").cast("double").alias("hand"), F.col("found_ht_m").cast("double").alias("floor"), F.col("storeys").cast("double").alias("storeys"), F.col("floor_area_m2").cast("double").alias("area"), F.col("pop").cast("double").alias("pop"), F.array_position(F.array(*[F.lit(k) for k in known]), curve_class(F.col("building_class"))).cast("int").alias("k"))
    curves = {k: np.array(CURVES[family][name]) for k, name in enumerate(known, 1)}
    names = ["damage", "wet", "residents", "in_channel"]

    def price(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[float, np.ndarray] = {}
        for batch in batches:
            for rungs, part in batch.groupby(batch["multipliers"].map(len)):
                levels = np.stack(part["levels"].to_numpy())
                hand, floor, n = (part[c].to_numpy()[:, None] for c in ("hand", "floor", "storeys"))
                margin = np.where(levels - hand > 0, levels - hand - floor, NO_WATER)
                share = np.zeros(margin.shape)
                for k in np.unique(part["k"]):
                    own = part["k"].to_numpy() == k
                    share[own] = np.interp(np.minimum(margin[own], cap), DEPTHS, curves[k])
                n = np.maximum(n, 1.0)
                reach = np.minimum(np.maximum(np.ceil(np.maximum(margin, 0.0) / storey), 1.0), n) / n
                rate = np.array([RATES[known[k - 1]] for k in part["k"]])
                damage = np.where(margin <= NO_WATER_BELOW, 0.0, np.clip(share, 0.0, 1.0)) * reach * (part["area"].to_numpy() * rate)[:, None]
                wet = margin > 0
                each = np.stack([damage.sum(0), wet.sum(0), np.where(wet, part["pop"].to_numpy()[:, None], 0.0).sum(0), np.where(hand <= 0, damage, 0.0).sum(0)], axis=1)
                for m, row in zip(part["multipliers"].iloc[0], each, strict=True):
                    sums[m] = sums.get(m, 0.0) + row
        yield pd.DataFrame([(m, *row) for m, row in sums.items()], columns=["multiplier", *names])

    parts = kept.mapInPandas(price, "multiplier double, damage double, wet double, residents double, in_channel double")
    out = parts.groupBy("multiplier").agg(F.sum("damage").alias("damage"), F.sum("wet").cast("long").alias("wet"), F.sum("residents").alias("residents"), F.sum("in_channel").alias("in_channel"))
    return out.withColumn("share", F.coalesce(F.try_divide("in_channel", "damage"), F.lit(0.0)))


def withheld(rungs: DataFrame, most: float = 0.5) -> DataFrame:
    """The damage is null where too much of it lies in the channel."""
    return rungs.withColumn("damage", F.when(F.col("share") <= most, F.col("damage")))


def ladder_at(rungs: DataFrame, multipliers: list[float], columns: tuple[str, ...] = ("damage", "wet", "residents", "in_channel", "share"), most: float | None = None) -> DataFrame:
    """The ladder's columns at any multiplier, linear between rungs and held at the ends; rungs are a fixed, small number.

    With most, the damage is withheld (null) where the share in the channel, between the rungs too, exceeds it.
    """
    rows = F.array_sort(F.collect_list(F.struct("multiplier", *[F.col(c).cast("double").alias(c) for c in columns])))
    packed = rungs.agg(rows.alias("x")).select("x", F.explode(F.array(*[F.lit(float(m)) for m in multipliers])).alias("multiplier"))
    found = packed.select("multiplier", *[interp(F.col("multiplier"), F.col("x.multiplier"), F.col(f"x.{c}")).alias(c) for c in columns])
    return found if most is None else withheld(found, most)


def building_depths(boxes: DataFrame, cells: DataFrame, cellsize: float, rows: int, cols: int, least_area: float = 10.0, statistic: str = "max") -> DataFrame:
    """depth_m, floor_depth_m, floor_margin_m, hand_m, reach_id and off_raster of every box (building_id, corners, found_ht_m) of the least area.

    statistic: max, mean, p90 or centroid (then the heights and reach are those of the centroid's cell too). Undefined depths count 0.
    With a column unclamped in cells the margin is that depth less the floor's height, also for water that stops short; without one it is
    known only where the ground is wet, else -inf. A box beyond the raster has depth 0, a margin of -inf, a height of +inf and reach -1.
    """
    inf = float("inf")
    found = zonal(boxes, cells, cellsize, least_area, (rows, cols))
    kept = boxes.where((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")) >= least_area)
    outside = (F.col("xmax") < 0) | (F.col("xmin") >= cols * cellsize) | (F.col("ymin") > 0) | (F.col("ymax") <= -rows * cellsize)
    both = kept.join(found, "building_id", "left")
    depth = F.when(outside, 0.0).otherwise(F.coalesce(F.col(f"depth_{statistic}"), F.lit(0.0)))
    signed = F.coalesce(F.col(f"margin_{statistic}"), F.lit(-inf)) if "unclamped" in cells.columns else F.when(depth > 0, depth).otherwise(F.lit(-inf))
    margin = F.when(outside, F.lit(-inf)).otherwise(signed - F.col("found_ht_m"))
    height, reach = ("centre_hand", "centre_reach") if statistic == "centroid" else ("hand_p10", "reach")
    return both.select("building_id", depth.alias("depth_m"), F.greatest(depth - F.col("found_ht_m"), F.lit(0.0)).alias("floor_depth_m"), margin.alias("floor_margin_m"), F.when(outside, F.lit(inf)).otherwise(F.coalesce(height, F.lit(inf))).alias("hand_m"), F.when(outside, F.lit(-1).cast("long")).otherwise(F.coalesce(F.col(reach).cast("long"), F.lit(-1))).alias("reach_id"), outside.alias("off_raster"))


def exposure_counts(depths: DataFrame, n_boxes: int) -> DataFrame:
    """n, n_inundated (floor wet), n_wet_ground, n_off_raster and n_too_small, of n_boxes boxes in all."""
    return depths.agg(F.count("*").alias("n"), F.count_if(F.col("floor_depth_m") > 0).alias("n_inundated"), F.count_if(F.col("depth_m") > 0).alias("n_wet_ground"), F.count_if("off_raster").alias("n_off_raster"), (F.lit(n_boxes) - F.count("*")).alias("n_too_small"))


def reference_damage(buildings: DataFrame, stages: DataFrame, references: list[float], family: str = "HAZUS") -> DataFrame:
    """building_id and one column of damage for each reference multiplier (d0, d1, ...), which must be rungs of the stage table."""
    rows = buildings.where("reach IS NOT NULL AND hand IS NOT NULL").join(stages.where(F.col("multiplier").isin(references)), "reach").withColumn("margin_m", floor_margin(F.col("stage_m"), F.col("hand"), F.col("found_ht_m")))
    hit = estimate(rows, family)
    return hit.groupBy("building_id").agg(*[F.sum(F.when(F.col("multiplier") == m, F.col("damage")).otherwise(0.0)).alias(f"d{i}") for i, m in enumerate(references)])


def interval(draws: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Low, median and high of the draws' totals and counts."""
    q = lambda c, p: F.percentile(c, F.lit(p))
    return draws.agg(q("total", low).alias("low"), q("total", 0.5).alias("median"), q("total", high).alias("high"), q("wet", low).cast("int").alias("wet_low"), q("wet", high).cast("int").alias("wet_high"))
