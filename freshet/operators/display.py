"""Display grids and report rows: warps, overviews, ramps, quantised stage tables read at any multiplier, damage channels, caveats."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions.scalar import clip, hand_byte, log_scale
from freshet.operators.spatial import from_web_mercator, to_utm

WET_ABOVE = 0.5  # decimetres


def warped(cells: DataFrame, targets: DataFrame, how: str = "nearest", by: list[str] | None = None) -> DataFrame:
    """cell and v of targets (cell, row, col: fractional places in the source grid) from cells (r, c, v); null outside.

    nearest takes the source cell that holds the place; bilinear weighs the four nearest centres, those without a value left out.
    by: columns of both that tell several source grids apart; they come back beside cell and v.
    """
    by = by or []
    if how == "nearest":
        at = targets.select("cell", *by, F.floor("row").cast("int").alias("r"), F.floor("col").cast("int").alias("c"))
        return at.join(cells.select(*by, "r", "c", "v"), [*by, "r", "c"], "left").select("cell", *by, "v")
    row, col = F.col("row") - 0.5, F.col("col") - 0.5
    corners = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    base = targets.select("cell", *by, F.floor(row).cast("int").alias("r0"), F.floor(col).cast("int").alias("c0"), (row - F.floor(row)).alias("fr"), (col - F.floor(col)).alias("fc"), corners.alias("k"))
    weight = F.when(F.col("k.a") == 1, F.col("fr")).otherwise(1 - F.col("fr")) * F.when(F.col("k.b") == 1, F.col("fc")).otherwise(1 - F.col("fc"))
    near = base.select("cell", *by, (F.col("r0") + F.col("k.a")).alias("r"), (F.col("c0") + F.col("k.b")).alias("c"), weight.alias("w")).join(cells.select(*by, "r", "c", "v"), [*by, "r", "c"], "left")
    known = F.when(F.col("v").isNotNull(), F.col("w"))
    return near.groupBy("cell", *by).agg(F.try_divide(F.sum(F.col("w") * F.col("v")), F.sum(known)).alias("v"))


def mercator_targets(rows: int, cols: int, west: float, north: float, step: float, cellsize: float, left: float, top: float, zone: int, spark) -> DataFrame:
    """The cells of a Web Mercator grid with their fractional places in a UTM grid whose upper left corner is (left, top)."""
    grid = spark.range(rows * cols).select(F.col("id").alias("cell"), (west + (F.col("id") % cols + 0.5) * step).alias("mx"), (north - (F.floor(F.col("id") / cols) + 0.5) * step).alias("my"))
    placed = grid.withColumn("g", from_web_mercator(F.col("mx"), F.col("my"))).withColumn("p", to_utm(F.col("g.lon"), F.col("g.lat"), zone))
    return placed.select("cell", ((top - F.col("p.y")) / cellsize).alias("row"), ((F.col("p.x") - left) / cellsize).alias("col"))


def overviews(cells: DataFrame, value: str = "z", factors: tuple[int, ...] = (2, 4, 8, 16)) -> DataFrame:
    """level, r, c and v: means of blocks of 2, 4, 8 and 16 cells a side, missing cells left out; each level from the one before.

    Sums and counts are carried from level to level, so the cells are read once and every level is the exact mean.
    """
    known = F.col(value).isNotNull() & ~F.isnan(value)
    level = cells.where(known).select("r", "c", F.col(value).alias("s"), F.lit(1).cast("long").alias("n"))
    out, last = None, 1
    for f in factors:
        half = lambda k, d=f // last: F.floor(F.col(k) / d).cast("int").alias(k)
        level, last = level.groupBy(half("r"), half("c")).agg(F.sum("s").alias("s"), F.sum("n").alias("n")), f
        one = level.select(F.lit(f).alias("level"), "r", "c", (F.col("s") / F.col("n")).alias("v"))
        out = one if out is None else out.unionByName(one)
    return out


def layer_ranges(cells: DataFrame, cols: int, target: int, means: list[str], masks: list[str]) -> DataFrame:
    """layer, low, high and n of each layer on the display grid: one factor for all, means of figures, maxima of masks."""
    factor = max(1, math.ceil(cols / target))
    half = lambda k: F.floor(F.col(k) / factor).alias(k)
    blocks = cells.groupBy(half("r"), half("c")).agg(*[F.avg(m).alias(m) for m in means], *[F.max(F.col(m).cast("double")).alias(m) for m in masks])
    sums = blocks.agg(*[f(c).alias(f"{c}_{n}") for c in means + masks for n, f in (("low", F.min), ("high", F.max), ("n", F.count))])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("layer"), F.col(f"{c}_low").alias("low"), F.col(f"{c}_high").alias("high"), F.col(f"{c}_n").alias("n")) for c in means + masks])).alias("x")).select("x.*")


def depth_ramp(depth: Column, most: float = 8.0) -> Column:
    """Share of the colour ramp of a depth, by the square root; 0 where it is dry or unknown."""
    return F.coalesce(F.sqrt(clip(depth / most, 0.0, 1.0)), F.lit(0.0))


def stage_bytes(stages: DataFrame, multipliers: list[float]) -> DataFrame:
    """reach and lut: its stages in whole decimetres, held to 0 to 255 and truncated, in order of the multipliers; 0 where there is none."""
    byte = F.floor(clip(F.col("stage_m") * 10, 0.0, 255.0)).cast("int")
    picked = [F.coalesce(F.max(F.when(F.col("multiplier") == m, byte)), F.lit(0)) for m in multipliers]
    return stages.groupBy("reach").agg(F.array(*picked).alias("lut"))


def stage_read(table: DataFrame, multipliers: list[float], at: float) -> DataFrame:
    """reach and stage_dm at any multiplier of an evenly spaced stage table, between its columns."""
    n, first, last = len(multipliers), multipliers[0], multipliers[-1]
    x = min(n - 1.001, max(0.0, (at - first) / ((last - first) or 1.0) * (n - 1)))
    low = math.floor(x)
    a, b = F.get("lut", F.lit(low)), F.get("lut", F.lit(min(low + 1, n - 1)))
    return table.select("reach", (a + (b - a) * (x - low)).alias("stage_dm"))


def pixel_depths(cells: DataFrame, read: DataFrame) -> DataFrame:
    """cell and depth_m of quantised cells (cell, hand, reach) under a stage read; null where it is dry by less than half a decimetre."""
    byte = hand_byte(F.col("hand"))
    both = cells.select("cell", byte.alias("h"), "reach").join(read, "reach", "left")
    depth = F.col("stage_dm") - F.col("h")
    return both.select("cell", F.when((F.col("h") != 255) & (depth > WET_ABOVE), depth / 10).alias("depth_m"))


def damage_channels(points: DataFrame, references: list[float], cellsize: float, reduction: int) -> DataFrame:
    """r, c, n and a byte channel for each of at most four reference multipliers, from points (x, y, multiplier, damage).

    One pass: sums by display cell, pivoted over the references, on the logarithmic scale.
    """
    size = cellsize * reduction
    at = lambda x: F.floor(x / size).cast("int")
    kept = references[:4]
    sums = [F.sum(F.when(F.col("multiplier") == m, F.col("damage")).otherwise(0.0)).alias(f"s{i}") for i, m in enumerate(kept)]
    grid = points.groupBy(at(-F.col("y")).alias("r"), at(F.col("x")).alias("c")).agg(*sums, F.count_if(F.col("multiplier") == kept[0]).alias("n"))
    return grid.select("r", "c", "n", *[log_scale(F.col(f"s{i}")).alias(f"channel{i}") for i in range(len(kept))])


def blended(channels: DataFrame, references: list[float], at: float) -> DataFrame:
    """r, c and shade at any multiplier: between the channels of the references around it, fading to 0 below the first."""
    refs = references[:4]
    if at <= refs[0]:
        value = F.col("channel0") * max(0.0, at / refs[0])
    elif at >= refs[-1]:
        value = F.col(f"channel{len(refs) - 1}").cast("double")
    else:
        i = max(k for k, m in enumerate(refs) if m < at)
        a, b = F.col(f"channel{i}"), F.col(f"channel{i + 1}")
        value = a + (b - a) * ((at - refs[i]) / (refs[i + 1] - refs[i]))
    return channels.select("r", "c", F.when(value >= 1, value).alias("shade"))


#: Caveats of a run, in the order in which they count: what must hold for each (on a row's flags), and its code.
LIMITS = (("TRUE", "parallel_surface"), ("NOT gauged", "scenario"), ("has_interval AND NOT curves_verified", "unverified_curves"), ("inventory = 'nsi'", "no_vehicles"), ("inventory = 'nsi'", "modelled_values"), ("has_interval AND count_conditional", "conditional_counts"), ("TRUE", "lower_bound"), ("fit_saturated", "saturated_fit"), ("marks IS NULL", "not_validated"))


def caveats(runs: DataFrame) -> DataFrame:
    """run and the codes of the caveats that apply to it, then its gaps."""
    codes = F.filter(F.array(*[F.when(F.expr(rule), F.lit(code)) for rule, code in LIMITS]), lambda x: x.isNotNull())
    return runs.select("run", F.concat(codes, F.transform(F.coalesce("gaps", F.array()), lambda g: F.concat(F.lit("gap: "), g))).alias("caveats"))
