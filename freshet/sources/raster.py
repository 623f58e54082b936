"""Rasters as cell tables: window reads, tilings, synthetic catchments, ingest of tiles, guarded writes, merges and cached results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.operators.display import warped
from freshet.operators.scan import covered_cells
from freshet.operators.spatial import from_utm
from freshet.sources.store import content_hash, exists


def read_window(cells: DataFrame, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, nodata: float | None = None, srid: int | None = None, expected: int | None = None) -> DataFrame:
    """The cells (r, c, z) of a half-open window with missing values as null; a raster of no or another system is refused.

    The window is a range of r and c, which Parquet prunes by row group where the cells are stored in order.
    """
    if expected is not None and srid != expected:
        raise ValueError(f"the raster is in system {srid}, not {expected}")
    for name, span in (("r", rows), ("c", cols)):
        if span:
            cells = cells.where((F.col(name) >= span[0]) & (F.col(name) < span[1]))
    missing = F.isnan("z") | (F.col("z") == nodata if nodata is not None else F.lit(False))
    return cells.withColumn("z", F.when(~missing, F.col("z")))


def windows(spark: SparkSession, rows: int, cols: int, block: int) -> DataFrame:
    """window, r0, c0, height and width of a tiling in rows of square blocks; those at the edges are smaller."""
    across, down = -(-cols // block), -(-rows // block)
    at = spark.range(across * down).select(F.col("id").alias("window"), (F.floor(F.col("id") / across) * block).alias("r0"), (F.col("id") % across * block).alias("c0"))
    return at.select("window", "r0", "c0", F.least(F.lit(block), rows - F.col("r0")).alias("height"), F.least(F.lit(block), cols - F.col("c0")).alias("width"))


def window_figures(cells: DataFrame, rows: int, cols: int, block: int) -> DataFrame:
    """windows with n_valid, low, high and mean of the valid cells (r, c, z) that each covers: one pass, a row a window leaves a task."""
    across = -(-cols // block)
    at = (F.floor(F.col("r") / block) * across + F.floor(F.col("c") / block)).alias("window")
    found = cells.where("z IS NOT NULL AND NOT isnan(z)").groupBy(at).agg(F.count("*").alias("n"), F.min("z").alias("low"), F.max("z").alias("high"), F.avg("z").alias("mean"))
    return windows(cells.sparkSession, rows, cols, block).join(found, "window", "left").withColumn("n_valid", F.coalesce("n", F.lit(0))).drop("n")


def ingested(tiles: DataFrame, order: DataFrame, units: DataFrame, cellsize: float) -> DataFrame:
    """The mosaic of the chosen tiles' cells (path, cell, r, c, z) inside the units: unit, cell and z.

    order: path and ord of the chosen tiles; the first valid value of a cell wins. Only cells inside a unit reach the mosaic.
    The units' cells are shuffled, never broadcast: Spark takes them for as few bytes as their rings.
    """
    inside = covered_cells(units, cellsize).hint("merge")
    kept = tiles.join(order.select("path", "ord"), "path").join(inside.select("r", "c").distinct().hint("merge"), ["r", "c"], "left_semi")
    good = F.col("z").isNotNull() & ~F.isnan("z")
    whole = kept.groupBy("cell", "r", "c").agg(F.min_by(F.when(good, F.col("z")), F.when(good, F.col("ord"))).alias("z"))
    return inside.join(whole, ["r", "c"]).select("unit", "cell", "z")


def warped_ingest(tiles: DataFrame, frames: DataFrame, grid: DataFrame, units: DataFrame, cellsize: float, zone: int, left: float, top: float, block: float = 0.05) -> DataFrame:
    """unit, cell and z of a projected grid, from tiles in degrees: mask, warp, then the first valid value in the tiles' order.

    tiles: path, r, c, z; frames: path, ord, west, north, step, rows, cols of each chosen tile; grid: cell, r, c with the upper left
    corner (left, top) in a UTM zone; units: unit, ring(s) in metres from that corner, y upwards. Only cells inside a unit are mapped back,
    each meets the tiles of its block of degrees, and a tile is read bilinearly from the centres around a place. The
    units' cells are shuffled, never broadcast, and so is what is read for them.
    """
    inside = covered_cells(units, cellsize).hint("merge")
    kept = grid.join(inside.select("r", "c").distinct().hint("merge"), ["r", "c"], "left_semi")
    at = from_utm(F.lit(left) + (F.col("c") + 0.5) * cellsize, F.lit(top) - (F.col("r") + 0.5) * cellsize, zone)
    block_of = lambda x: F.floor(x / block).cast("int")
    places = kept.withColumn("g", at).select("cell", F.col("g.lon").alias("lon"), F.col("g.lat").alias("lat")).withColumns({"bx": block_of(F.col("lon")), "by": block_of(F.col("lat"))})
    east, south = F.col("west") + F.col("cols") * F.col("step"), F.col("north") - F.col("rows") * F.col("step")
    spread = frames.withColumn("bx", F.explode(F.sequence(block_of(F.col("west")), block_of(east)))).withColumn("by", F.explode(F.sequence(block_of(south), block_of(F.col("north")))))
    met = places.join(spread, ["bx", "by"]).select("cell", "path", "ord", "rows", "cols", ((F.col("north") - F.col("lat")) / F.col("step")).alias("row"), ((F.col("lon") - F.col("west")) / F.col("step")).alias("col"))
    found = met.where("row >= 0 AND row < rows AND col >= 0 AND col < cols")
    good = F.col("z").isNotNull() & ~F.isnan("z")
    read = warped(tiles.where(good).select("path", "r", "c", F.col("z").alias("v")), found.select("cell", "path", "row", "col"), "bilinear", ["path"])
    whole = read.where("v IS NOT NULL").join(frames.select("path", "ord"), "path").groupBy("cell").agg(F.min_by("v", "ord").alias("z"))
    return inside.join(kept.select("cell", "r", "c").join(whole.hint("merge"), "cell", "left"), ["r", "c"]).select("unit", "cell", "z")


def synthetic_catchment(spark: SparkSession, rows: int, cols: int, cellsize: float = 10.0, pits: int = 5, seed: int = 0, border: int = 0, noise: float = 0.0) -> DataFrame:
    """cell, r, c and z of a tilted plane with a meandering valley and closed pits; cells of the border have no value.

    The plane falls southwards, the valley is a Gaussian trough around a sine, a pit a Gaussian hollow. Everything is a column
    expression of the cell's number, so the catchment may have any size and depends on no partition.
    """
    n = F.col("id")
    r, c = F.floor(n / cols).cast("int"), (n % cols).cast("int")
    draw = lambda k, i: ((seed * 7919 + k * 104729 + i * 15485863) % 10007) / 10007
    centre = cols / 2 + cols / 6 * F.sin(2 * 3.141592653589793 * r / rows * 1.5)
    z = 100.0 + (rows - r) * 0.02 * cellsize - 6.0 * F.exp(-F.pow((c - centre) / (cols / 10), F.lit(2.0)))
    for i in range(pits):  # a few literals
        at_r, at_c, width = 4 + draw(1, i) * (rows - 8), 4 + draw(2, i) * (cols - 8), 1.5 + 2.5 * draw(3, i)
        z = z - (4.0 + 3.0 * draw(4, i) + 0.03 * width * cellsize) * F.exp(-(F.pow(r - at_r, F.lit(2.0)) + F.pow(c - at_c, F.lit(2.0))) / (2 * width**2))
    if noise:
        z = z + noise * ((F.pmod(F.xxhash64(F.lit(seed), n), F.lit(1 << 20)) / float(1 << 20)) - 0.5)
    inside = (r >= border) & (r < rows - border) & (c >= border) & (c < cols - border)
    return spark.range(rows * cols).select(n.alias("cell"), r.alias("r"), c.alias("c"), F.when(inside, F.round(z, 4)).alias("z"))


def write_once(df: DataFrame, path: str, srid: int | None, expected: int, overwrite: bool = False) -> None:
    """Write a table as Parquet; another system is refused, and so is an existing target unless overwrite is given."""
    if srid != expected:
        raise ValueError(f"the table is in system {srid}, not {expected}")
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def merged_results(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """old with the rows of new in place of those of the same key; a row of new without a value (a failed target) changes nothing."""
    good = new.where("value IS NOT NULL")
    return old.join(good.select(key), key, "left_anti").unionByName(good)


def stored_structures(store: DataFrame | None, incoming: DataFrame, unit: str) -> DataFrame:
    """The unit's structures after a load: what is stored stays if its rows are the same, else the unit's rows are replaced."""
    if store is None:
        return incoming
    mine, columns = store.where(F.col("unit") == unit), [c for c in incoming.columns if c != "unit"]
    return store if content_hash(mine, columns) == content_hash(incoming, columns) else store.where(F.col("unit") != unit).unionByName(incoming)


def fresh_results(results: DataFrame, schema: int) -> DataFrame:
    """The cached results of the current schema version; stale ones are a miss."""
    return results.where(F.col("schema") == schema)


def cache_health(results: DataFrame, schema: int) -> DataFrame:
    """n, fresh and stale cached results."""
    fresh = F.col("schema") == schema
    return results.agg(F.count("*").alias("n"), F.count_if(fresh).alias("fresh"), F.count_if(~fresh | F.col("schema").isNull()).alias("stale"))


def manifest(spark: SparkSession, artifacts: list[tuple[str, str, str | None]]) -> DataFrame:
    """name, path, error and status of fetched artifacts, failures included; a path that is not there is missing."""
    rows = [(n, p, e, "failed" if e else "stored" if exists(spark, p) else "missing") for n, p, e in artifacts]
    return spark.createDataFrame(rows, "name string, path string, error string, status string")
