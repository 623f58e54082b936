"""Geometry on tables: polygons as rings, bucketed point-in-polygon joins, masks, extents, tiles, map projections, GeoJSON."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions.scalar import _bound, point_in_ring
from freshet.operators.scan import covered_cells, points_in_units, rings_of  # noqa: F401

RING = "array<struct<x: double, y: double>>"
#: Coordinates stay text here, as their nesting depends on the type.
_COLLECTION = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"

# The ellipsoid of NAD83 and WGS84 (to the millimetre the same), and the scale of a UTM zone.
AXIS, FLATTENING, UTM_SCALE, UTM_EAST = 6378137.0, 1 / 298.257222101, 0.9996, 500000.0


def bounds(ring: Column) -> Column:
    """Least and greatest coordinates of a ring, as a struct xmin, ymin, xmax, ymax."""
    side = lambda f, k: f(F.transform(ring, lambda p: p[k]))
    return F.struct(side(F.array_min, "x").alias("xmin"), side(F.array_min, "y").alias("ymin"), side(F.array_max, "x").alias("xmax"), side(F.array_max, "y").alias("ymax"))


def _edges(ring: Column) -> Column:
    n = F.size(ring)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, (i + 1) % n).alias("b")))


def area(ring: Column) -> Column:
    """Area of a simple ring."""
    return F.abs(F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def perimeter(ring: Column) -> Column:
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + F.hypot(e["a"]["x"] - e["b"]["x"], e["a"]["y"] - e["b"]["y"]))


def centroid(ring: Column) -> Column:
    """Centre of mass of a simple ring with area."""
    cross = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("w"))
    add = lambda s, e: F.struct((s["x"] + (e["a"]["x"] + e["b"]["x"]) * cross(e)).alias("x"), (s["y"] + (e["a"]["y"] + e["b"]["y"]) * cross(e)).alias("y"), (s["w"] + cross(e)).alias("w"))
    return F.aggregate(_edges(ring), zero, add, lambda s: F.struct((s["x"] / (3 * s["w"])).alias("x"), (s["y"] / (3 * s["w"])).alias("y")))


def geometry_mask(cells: DataFrame, units: DataFrame, cellsize: float) -> DataFrame:
    """unit and cell of every cell (r, c) whose centre lies inside the unit (origin at the top left, y downwards negative).

    Both sides are shuffled: Spark takes the cells of the units for as few bytes as their rings, and would broadcast them.
    """
    return covered_cells(units, cellsize).hint("merge").join(cells.select("r", "c", "cell"), ["r", "c"]).select("unit", "cell")


def extent(rows: DataFrame) -> DataFrame:
    """The common extent of rows with xmin, ymin, xmax, ymax."""
    return rows.agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


def estimated_cells(rows: DataFrame, resolution: float) -> DataFrame:
    """rows with cols and rows of their extent at a resolution, 1 at least, halves to the even number."""
    if resolution <= 0:
        raise ValueError("a resolution is positive")
    span = lambda a, b: F.greatest(F.bround((F.col(b) - F.col(a)) / resolution).cast("long"), F.lit(1))
    return rows.withColumns({"cols": span("xmin", "xmax"), "rows": span("ymin", "ymax")})


def selected_tiles(tiles: DataFrame, event: str | None = None) -> DataFrame:
    """Of the tiles (path, xmin, ymin, xmax, ymax) of one footprint, the one surveyed nearest to the event, or the newest without one.

    The date is the eight digits in the path's last part; undated tiles are taken only where no tile of the footprint has a date, the
    first by name. rejected counts the others.
    """
    name = F.element_at(F.split("path", "/"), -1)
    day = F.try_to_date(F.regexp_extract(F.regexp_replace(name, r"\.[^.]*$", ""), r"(?<!\d)(\d{8})(?!\d)", 1), "yyyyMMdd")
    rank = F.struct(F.col("day").isNull(), F.abs(F.datediff("day", F.lit(event))) if event else -F.unix_date("day"), "path")
    keys = [F.round(c, 4).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")]
    return tiles.withColumn("day", day).groupBy(*keys).agg(F.min_by(F.struct("path", "day"), rank).alias("t"), (F.count("*") - 1).alias("rejected")).select("xmin", "ymin", "xmax", "ymax", F.col("t.path").alias("path"), F.col("t.day").alias("day"), "rejected")


def overlapping(rows: DataFrame, west: float, south: float, east: float, north: float, box: str = "bbox") -> DataFrame:
    """Rows whose box (a struct xmin, xmax, ymin, ymax) overlaps the window; the filters reach the scan of a Parquet source."""
    b = lambda k: F.col(f"{box}.{k}")
    return rows.where((b("xmin") < east) & (b("xmax") > west) & (b("ymin") < north) & (b("ymax") > south))


# Building subtypes and the class of each.
SUBTYPES = {"residential": "residential", "commercial": "commercial", "entertainment": "commercial", "service": "commercial", "education": "commercial", "medical": "commercial", "industrial": "industrial", "agricultural": "industrial", "transportation": "industrial", "civic": "other", "religious": "other", "military": "other"}


def subtype_class(subtype: Column, default: str = "residential") -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SUBTYPES.items() for x in kv]), subtype), F.lit(default))


def units_of(texts: DataFrame, column: str = "json") -> DataFrame:
    """properties, parts, rings, ring and area of the polygons of GeoJSON collections (a text a row), largest first.

    parts holds each polygon's rings, the outer one first and then its holes; rings is all of them, ring the outer one of the first
    part. Polygons and multipolygons are kept, other geometries have no area and are left out.
    """
    one = texts.select(F.explode(F.from_json(column, _COLLECTION)["features"]).alias("f")).where("f.geometry.type IN ('Polygon', 'MultiPolygon')")
    polygon = "array<array<array<double>>>"
    found = F.when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json("f.geometry.coordinates", polygon))).otherwise(F.from_json("f.geometry.coordinates", f"array<{polygon}>"))
    opened = lambda ring: F.transform(F.slice(ring, F.lit(1), F.size(ring) - 1), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    rows = one.select(F.col("f.properties").alias("properties"), F.transform(found, lambda part: F.transform(part, opened)).alias("parts"))
    sized = F.aggregate("parts", F.lit(0.0), lambda s, part: s + F.aggregate(part, F.lit(0.0), lambda t, ring: t - area(ring)) + 2 * area(F.get(part, F.lit(0))))
    return rows.select("properties", "parts", F.flatten("parts").alias("rings"), F.get(F.get("parts", F.lit(0)), F.lit(0)).alias("ring"), sized.alias("area")).orderBy(F.desc("area"))


def as_geojson(units: DataFrame, properties: list[str]) -> DataFrame:
    """feature: a GeoJSON text of each unit, with the named columns as properties; a multipolygon where units have parts, else their ring."""
    closed = lambda ring: F.transform(F.concat(ring, F.slice(ring, 1, 1)), lambda p: F.array(p["x"], p["y"]))
    if "parts" in units.columns:
        shape = F.struct(F.lit("MultiPolygon").alias("type"), F.transform("parts", lambda part: F.transform(part, closed)).alias("coordinates"))
    else:
        shape = F.struct(F.lit("Polygon").alias("type"), F.array(closed(F.col("ring"))).alias("coordinates"))
    return units.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), shape.alias("geometry"))).alias("feature"))


def unit_of_point(units: DataFrame, x: float, y: float) -> DataFrame:
    """The unit that holds a point, or else the first by name among those whose box does."""
    rings = rings_of(units)
    b = bounds(F.flatten(rings))
    near = units.where((b["xmin"] <= x) & (b["xmax"] >= x) & (b["ymin"] <= y) & (b["ymax"] >= y))
    inside = F.size(F.filter(rings, lambda ring: point_in_ring(F.lit(x), F.lit(y), ring))) % 2 == 1
    return near.withColumn("inside", inside).orderBy(F.desc("inside"), "unit").limit(1).drop("inside")


# Projections: the transverse Mercator by Krueger's series to the fourth order, Albers' equal area, the inverse Web Mercator.

_N = FLATTENING / (2 - FLATTENING)
_RADIUS = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_FORWARD = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280]
_BACK = [_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280]
_ECC = math.sqrt(FLATTENING * (2 - FLATTENING))


def to_utm(lon: Column, lat: Column, zone: int) -> Column:
    """A struct x, y of a place in degrees in a northern UTM zone."""
    middle = math.radians(zone * 6 - 183)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - _ECC * F.atanh(_ECC * s))

    def body(p: Column) -> Column:
        xi, eta = F.atan2(p["t"], F.cos(p["d"])), F.atanh(F.sin(p["d"]) / F.sqrt(1 + p["t"] * p["t"]))
        north, east = xi, eta
        for k, a in enumerate(_FORWARD, 1):
            north, east = north + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta), east + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        return F.struct((UTM_EAST + UTM_SCALE * _RADIUS * east).alias("x"), (UTM_SCALE * _RADIUS * north).alias("y"))

    return _bound(F.struct(t.alias("t"), (F.radians(lon) - middle).alias("d")), body)


def from_utm(x: Column, y: Column, zone: int) -> Column:
    """A struct lon, lat in degrees of a place in a northern UTM zone."""

    def body(p: Column) -> Column:
        xi, eta = p["y"], p["x"]
        north, east = xi, eta
        for k, b in enumerate(_BACK, 1):
            north, east = north - b * F.sin(2 * k * xi) * F.cosh(2 * k * eta), east - b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        return _bound(F.struct(F.asin(F.sin(north) / F.cosh(east)).alias("chi"), F.atan2(F.sinh(east), F.cos(north)).alias("d")), latitude)

    def latitude(p: Column) -> Column:
        flat = F.atanh(F.sin(p["chi"]))
        lat = F.aggregate(F.array(*[F.lit(0)] * 6), p["chi"], lambda phi, _: F.asin(F.tanh(flat + _ECC * F.atanh(_ECC * F.sin(phi)))))
        return F.struct((F.degrees(p["d"]) + (zone * 6 - 183)).alias("lon"), F.degrees(lat).alias("lat"))

    return _bound(F.struct(((x - UTM_EAST) / (UTM_SCALE * _RADIUS)).alias("x"), (y / (UTM_SCALE * _RADIUS)).alias("y")), body)


def to_albers(lon: Column, lat: Column, south: float = 29.5, north: float = 45.5, lat0: float = 23.0, lon0: float = -96.0) -> Column:
    """A struct x, y in Albers' equal-area conic projection; the defaults are those of the contiguous United States."""
    e = _ECC

    def q_of(s: float) -> float:
        return (1 - e**2) * (s / (1 - e**2 * s**2) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    m = lambda d: math.cos(math.radians(d)) / math.sqrt(1 - (e * math.sin(math.radians(d))) ** 2)
    q1, q2, q0 = (q_of(math.sin(math.radians(d))) for d in (south, north, lat0))
    n = (m(south) ** 2 - m(north) ** 2) / (q2 - q1)
    c = m(south) ** 2 + n * q1
    rho0 = AXIS * math.sqrt(c - n * q0) / n
    s = F.sin(F.radians(lat))
    q = (1 - e**2) * (s / (1 - e**2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    rho, theta = AXIS * F.sqrt(c - n * q) / n, n * (F.radians(lon) - math.radians(lon0))
    return F.struct((rho * F.sin(theta)).alias("x"), (rho0 - rho * F.cos(theta)).alias("y"))


def from_web_mercator(x: Column, y: Column) -> Column:
    """A struct lon, lat in degrees."""
    return F.struct(F.degrees(x / 6378137.0).alias("lon"), F.degrees(2 * F.atan(F.exp(y / 6378137.0)) - math.pi / 2).alias("lat"))
