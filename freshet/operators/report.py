"""What an assessment is asked and gives back: catalogue lookups, plans before a run, a gauge's history, totals and the report's figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.functions.scalar import water_year
from freshet.operators import gauging as G
from freshet.operators import hydraulics as H
from freshet.operators.tiles import FLAT, OUTLET

# Elevation products by nominal resolution in metres.
PRODUCTS = {
    1: "Digital Elevation Model (DEM) 1 meter",
    3: "National Elevation Dataset (NED) 1/9 arc-second",
    10: "National Elevation Dataset (NED) 1/3 arc-second",
    30: "National Elevation Dataset (NED) 1 arc-second",
}
MOST_TILES = 200


def tiles_found(catalogue: DataFrame, resolution: int, box: tuple[float, float, float, float], most: int = MOST_TILES) -> DataFrame:
    """The tiles (dataset, path, xmin, ymin, xmax, ymax) of a resolution's product that overlap a box (w, s, e, n), the first `most` by path.

    A resolution without a product, and a box without a tile, are errors: nothing would be computed without anyone noticing.
    """
    if resolution not in PRODUCTS:
        raise ValueError(f"no elevation product for {resolution} m; known: {sorted(PRODUCTS)}")
    west, south, east, north = box
    near = (F.col("xmin") < east) & (F.col("xmax") > west) & (F.col("ymin") < north) & (F.col("ymax") > south)
    found = catalogue.where((F.col("dataset") == PRODUCTS[resolution]) & near).orderBy("path").limit(most)
    if found.isEmpty():
        raise ValueError(f"no tile of {resolution} m in {box}; widen the box or take another resolution")
    return found


def planned(tiles: DataFrame, resolution: float, most_cells: int) -> DataFrame:
    """What a run over tiles would read, without reading it: tiles, cells at the resolution, and whether they exceed the limit."""
    span = lambda a, b: F.greatest(F.bround((F.max(b) - F.min(a)) / resolution).cast("long"), F.lit(1))
    cells = span("xmin", "xmax") * span("ymin", "ymax")
    return tiles.agg(F.count("*").alias("tiles"), cells.alias("cells"), (cells > most_cells).alias("too_many"))


def unit_by_code(units: DataFrame, code: str) -> DataFrame:
    """The unit (huc, level, ...) of a code, whose number of digits is its level: an even one from 2 to 16."""
    if not code.isdigit() or len(code) % 2 or not 2 <= len(code) <= 16:
        raise ValueError(f"{code!r} is no code: an even number of digits from 2 to 16 selects the level")
    found = units.where((F.col("level") == len(code)) & (F.col("huc") == code)).limit(1)
    if found.isEmpty():
        raise ValueError(f"no unit of level {len(code)} with the code {code}")
    return found


def gauge_history(peaks: DataFrame, events: DataFrame, most: int = 5) -> DataFrame:
    """Where an event (site, discharge_cms) stands in its gauge's record (site, date, cms): one row a site.

    rank and n_years, whether it exceeds the record, empirical and fitted return period (rounded as reports show them), what limits
    the fit, and the largest floods above it with their water years, at most `most`.
    """
    context = H.event_context(peaks, events, H.frequency_fit(peaks, ["site"]))
    above = G.larger_floods(peaks, events, most)
    floods = F.transform(F.coalesce("floods", F.array().cast("array<struct<cms: double, date: string>>")), lambda x: F.struct(water_year(x["date"]).alias("water_year"), x["cms"].cast("long").alias("cms"), x["date"].alias("date")))
    both = context.join(above.select("site", F.col("floods").cast("array<struct<cms: double, date: string>>").alias("floods")), "site", "left")
    return both.select("site", "discharge_cms", "rank", F.col("n").alias("n_years"), (F.col("rank") == 1).alias("exceeds_record"), F.round("empirical", 1).alias("empirical_years"), F.round("fitted").cast("long").alias("fitted_years"), "extrapolated", F.col("saturated").alias("fit_saturated"), floods.alias("larger_floods"))


def drainage_totals(routed: DataFrame) -> DataFrame:
    """One row: cells (flowdir, accumulation), what leaves by outlets, and what ends in flats that nothing drains; the two make the whole."""
    total = lambda code: F.coalesce(F.sum(F.when(F.col("flowdir") == code, F.col("accumulation"))), F.lit(0.0))
    return routed.agg(F.count("*").alias("cells"), total(OUTLET).alias("by_outlets"), total(FLAT).alias("in_flats"))


def removed_cells(catchments: DataFrame, stages: DataFrame, extent: DataFrame, min_depth: float = 0.05) -> DataFrame:
    """One row: cells that are deep enough but not connected to a wet stream cell, which an extent leaves out."""
    depth = F.coalesce("stage_m", F.lit(0.0)) - F.col("hand")
    deep = catchments.join(stages.select("reach", "stage_m"), "reach", "left").where((depth >= min_depth) & (depth > 0)).select("cell")
    return deep.join(extent.where("connected").select("cell"), "cell", "left_anti").agg(F.count("*").alias("removed"))


def payload(unit: str, discharge: float, resolution: float, extent: DataFrame, depths: DataFrame, totals: DataFrame, classes: DataFrame, removed: DataFrame, top: int = 8) -> DataFrame:
    """An assessment as one row: area and depth of the extent (cell, depth_m), flooded buildings (floor_depth_m), damage totals, the `top` classes.

    Every table is summed before it gets here or is summed by Spark here; what meets are single rows.
    """
    wet = F.col("depth_m") > 0
    flood = extent.agg((F.count_if(wet) * resolution * resolution / 1e6).alias("flooded_km2"), F.max("depth_m").alias("max_depth_m"))
    hit = depths.agg(F.count("*").alias("buildings"), F.count_if(F.col("floor_depth_m") > 0).alias("inundated"))
    worst = classes.orderBy(F.desc("damage"), "building_class").limit(top).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("damage")).alias("k"), "building_class"))), lambda x: x["building_class"]).alias("top_classes"))
    out = flood.select(F.lit(unit).alias("unit"), F.lit(float(discharge)).alias("discharge_cms"), F.lit(float(resolution)).alias("resolution_m"), "flooded_km2", "max_depth_m")
    for one in (hit, totals, worst, removed):
        out = out.crossJoin(F.broadcast(one))  # one row each
    return out
