"""Registered queries of stored and landed tables, warps, polygons of many rings, the whole ladder, SQL functions and streamed extents, with their oracles."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from freshet.functions.scalar import log_scale, register
from freshet.operators import display as D
from freshet.operators import exposure as E
from freshet.operators import hydraulics as H
from freshet.operators import spatial as S
from freshet.operators import validation as V
from freshet.plans.exposure_queries import _BIG, _DEPTHS
from freshet.plans.queries import _AT, _DEM, _MARKS, _STAGE, _WET, RUNGS, _hit, _placed, _stages, _wet, _with, query, r6
from freshet.plans.site_queries import _ELL, _ells, _in_ell
from freshet.plans.terrain import terrain
from freshet.sources import raster as R
from freshet.sources import tiled as L
from freshet.sources.adapters import CELLSIZE, COLS, sql_text, view
from freshet.sources.store import shared_dir, table
from freshet.streaming import gauges as G


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/freshet/{name}-{uuid.uuid4().hex}"


def _values(rungs: list[float]) -> str:
    return ", ".join(f"({x})" for x in rungs)


# Stored and landed tables.


@query(f"WITH dem AS ({sql_text('dem')}) SELECT cell, r, c, z FROM dem WHERE r >= 10 AND r < 90 AND c >= 20 AND c < 100")
def stored_window(spark, sf_dir):
    path = _folder(spark, "cells")
    L.store_cells(view(spark, sf_dir, "dem"), path, 32)
    return L.stored_window(spark, path, (10, 90), (20, 100), 32).select("cell", "r", "c", "z")


_FEATURE = "SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR(20)) AS fd_id, CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE CAST(c_custkey * 7919 AS VARCHAR(20)) END AS cbfips, c_mktsegment AS occtype, c_acctbal + 1000 AS val_struct, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal + 2000 END AS sqft, CAST(c_custkey % 500 AS DOUBLE) AS ftprntsqft, CAST(c_custkey % 4 AS DOUBLE) AS num_story, (c_custkey % 100) * 12.0 AS x, -(c_custkey % 90) * 7.0 AS y FROM {customer}"


@query(
    f"""WITH f AS ({_FEATURE.replace("{customer}", "customer")}), ell AS ({_ELL.replace("{supplier}", "supplier")})
    SELECT fd_id, ell.unit, substr(lpad(coalesce(cbfips, ''), 15, '0'), 1, 11) AS tract_fips, round(CAST(val_struct AS DOUBLE), 4) AS val_struct, round(coalesce(sqft, 0) * 0.092903, 4) AS floor_area_m2, round(ftprntsqft * 0.092903, 4) AS footprint_m2, greatest(num_story, 1) AS num_story, coalesce(occtype, '') AS occtype FROM f JOIN ell ON {_in_ell("x", "y", True)}"""
)
def landed_inventory(spark, sf_dir):
    """Structures as pages of 500 features, landed as text, read with their fields and placed in units."""
    rows = spark.sql(_FEATURE, customer=table(spark, sf_dir, "customer"))
    fields = [F.col(k) for k in ("fd_id", "cbfips", "occtype", "val_struct", "sqft", "ftprntsqft", "num_story")]
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*fields).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(F.col("x").cast("double"), F.col("y").cast("double")).alias("coordinates")).alias("geometry"))
    pages = rows.groupBy(F.floor(F.col("k") / 500)).agg(F.collect_list(feature).alias("f")).select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.col("f").alias("features"))).alias("value"))
    path = _folder(spark, "pages")
    pages.write.text(path)
    four = lambda c: F.round(c, 4).alias(c)
    found = L.landed_inventory(spark, path, _ells(spark, sf_dir), 200.0, wholetext=False, columns=["fd_id", "tract_fips", four("val_struct"), four("floor_area_m2"), four("footprint_m2"), "num_story", "occtype"])
    return found.select("fd_id", "unit", "tract_fips", "val_struct", "floor_area_m2", "footprint_m2", "num_story", "occtype")


@query("SELECT s_suppkey AS id, 'u' || s_nationkey AS unit, CASE WHEN s_nationkey = 3 THEN s_acctbal + 1 ELSE s_acctbal END AS v, s_nationkey = 3 AS replaced FROM supplier")
def replaced_units(spark, sf_dir):
    """Two units are loaded again with as many rows each: one has other values and is replaced, one the same and is not written."""
    store = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("u"), F.col("s_nationkey")).alias("unit"), F.col("s_acctbal").alias("v"))
    path = _folder(spark, "units")
    store.write.partitionBy("unit").parquet(path)
    done = {u: L.replace_unit(spark, path, store.where(F.col("unit") == u).select("id", (F.col("v") + more).alias("v")), u) for u, more in (("u3", 1), ("u5", 0))}
    return spark.read.parquet(path).select("id", "unit", "v", F.col("unit").isin([u for u, new in done.items() if new]).alias("replaced"))


# Warps.

_TILES = [("a", 0, 0, 80), ("b", 1, 60, COLS)]
_WEST, _NORTH, _STEP = -95.0, 30.0, 0.0001
_ZONE, _LEFT, _TOP, _PIXEL = 15, 307000.0, 3320400.0, 12.0


def _latitudes() -> str:
    """Six rounds of the latitude's fixed point, each a column over the one before."""
    body = "p0"
    for k in range(6):
        body = f"SELECT *, asin(tanh(flat + {S._ECC!r} * atanh({S._ECC!r} * sin(p{k})))) AS p{k + 1} FROM ({body if k else 'SELECT *, chi AS p0 FROM l2'})"
    return body


_XI, _ETA = f"(({_TOP} - (r + 0.5) * {_PIXEL}) / {S.UTM_SCALE * S._RADIUS!r})", f"(({_LEFT} + (c + 0.5) * {_PIXEL} - {S.UTM_EAST}) / {S.UTM_SCALE * S._RADIUS!r})"
_GRID = f"""size AS (SELECT CAST(ceil((SELECT max(r) + 1 FROM dem) * 11.1 / {_PIXEL}) AS BIGINT) AS rows), grid AS (SELECT r * 100 + c AS cell, r, c FROM (SELECT unnest(range(0, (SELECT rows FROM size))) AS r), (SELECT unnest(range(0, 100)) AS c))"""
_BACK_SQL = f"""l1 AS (SELECT cell, r, c, {_XI}{"".join(f" - {b!r} * sin({2 * k} * {_XI}) * cosh({2 * k} * {_ETA})" for k, b in enumerate(S._BACK, 1))} AS n, {_ETA}{"".join(f" - {b!r} * cos({2 * k} * {_XI}) * sinh({2 * k} * {_ETA})" for k, b in enumerate(S._BACK, 1))} AS e FROM inside),
l2 AS (SELECT cell, asin(sin(n) / cosh(e)) AS chi, degrees(atan2(sinh(e), cos(n))) + {_ZONE * 6 - 183} AS lon, atanh(sin(n) / cosh(e)) AS flat FROM l1), l3 AS ({_latitudes()}),
pl AS MATERIALIZED (SELECT cell, ({_NORTH} - degrees(p6)) / {_STEP} AS row, (lon - {_WEST}) / {_STEP} AS col FROM l3)"""


@query(
    f"""WITH dem AS ({sql_text('dem')}), ell AS ({_ELL.replace('{supplier}', 'supplier')}), {_GRID}, meet AS (SELECT unit, cell, r, c FROM grid JOIN ell ON {_in_ell(f'((c + 0.5) * {_PIXEL})', f'(-(r + 0.5) * {_PIXEL})')}), inside AS (SELECT DISTINCT cell, r, c FROM meet), {_BACK_SQL},
    tl AS MATERIALIZED ({" UNION ALL ".join(f"SELECT '{p}' AS path, {o} AS ord, {lo} AS c0, {hi - lo} AS w, r, c - {lo} AS c, z + {o} AS z FROM dem WHERE c >= {lo} AND c < {hi} AND NOT (c % 7 = 3 AND {o} = 0)" for p, o, lo, hi in _TILES)}),
    fr AS (SELECT path, ord, c0, w, (SELECT max(r) + 1 FROM dem) AS rows FROM tl GROUP BY ALL),
    spot AS (SELECT cell, path, ord, row, col - c0 AS col FROM pl JOIN fr ON row >= 0 AND row < rows AND col - c0 >= 0 AND col - c0 < w),
    co AS (SELECT cell, path, ord, CAST(floor(row - 0.5) AS INT) + a AS r, CAST(floor(col - 0.5) AS INT) + b AS c, CASE WHEN a = 1 THEN row - 0.5 - floor(row - 0.5) ELSE 1 - (row - 0.5 - floor(row - 0.5)) END * CASE WHEN b = 1 THEN col - 0.5 - floor(col - 0.5) ELSE 1 - (col - 0.5 - floor(col - 0.5)) END AS w FROM spot, (VALUES (0), (1)) x(a), (VALUES (0), (1)) y(b)),
    rd AS (SELECT cell, co.path, co.ord, sum(co.w * z) / sum(co.w) AS z FROM co JOIN tl ON tl.path = co.path AND tl.r = co.r AND tl.c = co.c GROUP BY ALL), wh AS (SELECT cell, arg_min(z, ord) AS z FROM rd GROUP BY cell)
    SELECT unit, meet.cell, round(z, 3) AS z FROM meet LEFT JOIN wh ON wh.cell = meet.cell"""
)
def warped_ingest(spark, sf_dir):
    """Two tiles in degrees, one beside the other with a strip of both, mapped to cells of 12 m in UTM zone 15."""
    dem = view(spark, sf_dir, "dem")
    rows = dem.agg(F.max("r").alias("r")).first()["r"] + 1
    tiles, frames = None, []
    for path, k, low, high in _TILES:
        own = dem.where((F.col("c") >= low) & (F.col("c") < high)).select(F.lit(path).alias("path"), "r", (F.col("c") - low).alias("c"), F.when((F.col("c") % 7 == 3) & F.lit(k == 0), float("nan")).otherwise(F.col("z") + k).alias("z"))
        tiles = own if tiles is None else tiles.unionByName(own)
        frames.append((path, k, _WEST + low * _STEP, _NORTH, _STEP, rows, high - low))
    frame = spark.createDataFrame(frames, "path string, ord int, west double, north double, step double, rows int, cols int")
    across = 100
    grid = spark.range(math.ceil(rows * 11.1 / _PIXEL) * across).select(F.col("id").alias("cell"), F.floor(F.col("id") / across).cast("int").alias("r"), (F.col("id") % across).cast("int").alias("c"))
    return R.warped_ingest(tiles, frame, grid, _ells(spark, sf_dir), _PIXEL, _ZONE, _LEFT, _TOP).select("unit", "cell", F.round("z", 3).alias("z"))


#: A corner of UTM zone 15 and the same place in Web Mercator.
_CORNER, _MERCATOR = (300000.0, 3300000.0), (-10583098.358, 3479696.337)
_T = f"sinh(atanh(sin(radians(lat))) - {S._ECC!r} * atanh({S._ECC!r} * sin(radians(lat))))"
_D = f"(radians(lon) - {math.radians(_ZONE * 6 - 183)!r})"
_FWD = f"""g2 AS (SELECT cell, atan2({_T}, cos({_D})) AS xi, atanh(sin({_D}) / sqrt(1 + {_T} * {_T})) AS eta FROM g1),
g3 AS (SELECT cell, {S.UTM_SCALE * S._RADIUS!r} * (xi{"".join(f" + {a!r} * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, a in enumerate(S._FORWARD, 1))}) AS y, {S.UTM_EAST} + {S.UTM_SCALE * S._RADIUS!r} * (eta{"".join(f" + {a!r} * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, a in enumerate(S._FORWARD, 1))}) AS x FROM g2)"""


@query(
    f"""WITH b AS ({sql_text("buildings")}), d AS (SELECT CAST(floor(cell / {COLS} / 2) AS INT) AS r, CAST(floor(cell % {COLS} / 2) AS INT) AS c, sum(value) AS damage FROM b GROUP BY ALL), n AS (SELECT (max(r) + 1) * 64 AS n FROM d),
    g1 AS (SELECT cell, degrees(mx / 6378137.0) AS lon, degrees(2 * atan(exp(my / 6378137.0)) - pi() / 2) AS lat FROM (SELECT k AS cell, {_MERCATOR[0]} + (k % 64 + 0.5) * 24.0 AS mx, {_MERCATOR[1]} - (k // 64 + 0.5) * 24.0 AS my FROM (SELECT unnest(range(0, (SELECT n FROM n))) AS k))), {_FWD}
    SELECT cell, round(coalesce(damage, 0), 2) AS damage, CASE WHEN damage >= 1000 THEN CAST(round_even(1 + (log10(least(damage, 1e8)) - 3) / 5 * 254, 0) AS INT) ELSE 0 END AS shade
    FROM g3 LEFT JOIN d ON d.r = CAST(floor(({_CORNER[1]} - y) / 20.0) AS INT) AND d.c = CAST(floor((x - {_CORNER[0]}) / 20.0) AS INT)"""
)
def damage_mercator(spark, sf_dir):
    """Damage summed on UTM cells of 20 m, shown on a Web Mercator grid of 24 units, then scaled."""
    b = view(spark, sf_dir, "buildings")
    points = b.select((F.col("cell") % COLS + 0.5).alias("x"), (-F.floor(F.col("cell") / COLS) - 0.5).alias("y"), F.col("value").alias("damage"))
    sums = V.rasterise_damage(points, 2.0)
    rows = sums.agg(F.max("r").alias("r")).first()["r"] + 1
    targets = D.mercator_targets(rows, 64, _MERCATOR[0], _MERCATOR[1], 24.0, 20.0, *_CORNER, _ZONE, spark)
    shown = D.warped(sums.select("r", "c", F.col("damage").alias("v")), targets)
    return shown.select("cell", F.round(F.coalesce("v", F.lit(0.0)), 2).alias("damage"), log_scale(F.coalesce("v", F.lit(0.0))).cast("int").alias("shade"))


# Polygons of many rings.

_MULTI = "SELECT s_suppkey AS unit, (s_suppkey * 97 % 900) + 0.25 AS x0, -(s_suppkey * 61 % 900) - 0.75 AS y0, 90.0 + s_suppkey % 50 AS w FROM {supplier}"


def _multis(spark, sf_dir):
    """A square with a square hole and a smaller square beside it, through GeoJSON, for every supplier."""
    rows = spark.sql(_MULTI, supplier=table(spark, sf_dir, "supplier"))
    at = lambda a, b: F.struct((F.col("x0") + a * F.col("w")).cast("double").alias("x"), (F.col("y0") - b * F.col("w")).cast("double").alias("y"))
    square = lambda a, b, s: F.array(at(a, b), at(a + s, b), at(a + s, b + s), at(a, b + s))
    parts = F.array(F.array(square(0, 0, 1), square(0.25, 0.25, 0.5)), F.array(square(1.25, 0, 0.5)))
    features = S.as_geojson(rows.select(F.col("unit").cast("string").alias("huc"), parts.alias("parts")), ["huc"])
    return S.units_of(features.select(F.concat(F.lit('{"features": ['), "feature", F.lit("]}")).alias("json"))).select(F.col("properties.huc").cast("int").alias("unit"), "rings", "parts", "area")


def _in_multi(x: str, y: str) -> str:
    u, v = f"(({x} - x0) / w)", f"((y0 - {y}) / w)"
    return f"({u} > 0 AND {u} < 1 AND {v} > 0 AND {v} < 1 AND NOT ({u} >= 0.25 AND {u} <= 0.75 AND {v} >= 0.25 AND {v} <= 0.75) OR {u} > 1.25 AND {u} < 1.75 AND {v} > 0 AND {v} < 0.5)"


@query(f"WITH m AS ({_MULTI.replace('{supplier}', 'supplier')}) SELECT unit, round(w * w, 6) AS area, 3 AS rings, 2 AS parts FROM m")
def multipolygon_units(spark, sf_dir):
    return _multis(spark, sf_dir).select("unit", r6("area"), F.size("rings").alias("rings"), F.size("parts").alias("parts"))


@query(f"WITH dem AS ({sql_text('dem')}), m AS ({_MULTI.replace('{supplier}', 'supplier')}) SELECT unit, cell FROM dem JOIN m ON {_in_multi('((c + 0.5) * 10)', '(-(r + 0.5) * 10)')}")
def multipolygon_mask(spark, sf_dir):
    return S.geometry_mask(view(spark, sf_dir, "dem"), _multis(spark, sf_dir), CELLSIZE)


_DOTS = "SELECT c_custkey AS id, (c_custkey * 37 % 1100) * 1.0 AS x, -(c_custkey * 53 % 1050) * 1.0 AS y FROM {customer}"


@query(f"WITH d AS ({_DOTS.replace('{customer}', 'customer')}), m AS ({_MULTI.replace('{supplier}', 'supplier')}) SELECT id, unit FROM d JOIN m ON {_in_multi('x', 'y')}")
def points_in_multipolygons(spark, sf_dir):
    dots = spark.sql(_DOTS, customer=table(spark, sf_dir, "customer")).select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return S.points_in_units(dots, _multis(spark, sf_dir).select("unit", "rings"), 64.0).select("id", "unit")


_TRI = "SELECT p_partkey AS building_id, (p_partkey * 7) % 1200 + 1.3 AS x, -((p_partkey * 5) % 1100) - 2.7 AS y, 20.1 + p_size % 31 AS w, 15.7 + p_size % 23 AS h FROM {part}"


@query(
    _with(
        _WET + f""", tri AS ({_TRI.replace("{part}", "part")}), touch AS (SELECT building_id, coalesce(wet.depth_m, 0) AS d, hd.hand FROM tri JOIN dem ON (dem.c + 1) * 10 > x AND dem.c * 10 <= x + w AND (dem.r + 1) * 10 > -y AND dem.r * 10 <= -y + h AND greatest(dem.c * 10 - x, 0) / w + greatest(dem.r * 10 + y, 0) / h <= 1 JOIN wet ON wet.cell = dem.cell JOIN hd ON hd.cell = dem.cell)""",
        "SELECT tri.building_id, round(max(d), 6) AS depth_max, round(avg(d), 6) AS depth_mean, round(quantile_cont(hand, 0.1), 6) AS hand_p10, count(d) AS n_cells FROM tri LEFT JOIN touch ON touch.building_id = tri.building_id GROUP BY tri.building_id",
    )
)
def zonal_polygons(spark, sf_dir):
    """Right-angled triangles, over every cell that they touch."""
    t, _, wet = _wet(spark, sf_dir)
    cells = t.raw.select("cell", "r", "c").join(wet.select("cell", "depth_m"), "cell").join(t.hand.select("cell", "hand", "reach"), "cell").select("r", "c", "depth_m", "hand", "reach")
    rows = spark.sql(_TRI, part=table(spark, sf_dir, "part"))
    at = lambda a, b: F.struct((F.col("x") + a * F.col("w")).cast("double").alias("x"), (F.col("y") - b * F.col("h")).cast("double").alias("y"))
    found = E.zonal(rows.select("building_id", F.array(F.array(at(0, 0), at(1, 0), at(0, 1))).alias("rings")), cells, CELLSIZE)
    return found.select("building_id", r6("depth_max"), r6("depth_mean"), r6("hand_p10"), F.coalesce("n_cells", F.lit(0)).alias("n_cells"))


# Margins from unclamped depths, the whole ladder, the discharge that marks imply.


@query(
    _with(
        _DEPTHS + ", un AS (SELECT grid.building_id, max(CASE WHEN hd.hand IS NULL THEN CAST('-inf' AS DOUBLE) ELSE coalesce(s.stage_m, 0) - hd.hand END) AS m, max(coalesce(wet.depth_m, 0)) AS d FROM grid LEFT JOIN dem ON dem.r = grid.r AND dem.c = grid.c LEFT JOIN hd ON hd.cell = dem.cell LEFT JOIN wet ON wet.cell = dem.cell LEFT JOIN stage s ON s.reach = hd.reach AND s.multiplier = 1.0 GROUP BY grid.building_id)",
        "SELECT kept.building_id, CASE WHEN outside THEN 0.0 ELSE round(coalesce(un.d, 0), 6) END AS depth_m, CASE WHEN outside OR m IS NULL THEN CAST('-inf' AS DOUBLE) ELSE round(m - found_ht_m, 6) END AS floor_margin_m FROM kept LEFT JOIN un ON un.building_id = kept.building_id",
    )
)
def unclamped_margins(spark, sf_dir):
    """How far water stops below a floor, also where it does not reach the ground."""
    t, stages, wet = _wet(spark, sf_dir)
    level = t.hand.join(stages.where("multiplier = 1.0").select("reach", "stage_m"), "reach", "left").select("cell", "hand", "reach", (F.coalesce("stage_m", F.lit(0.0)) - F.col("hand")).alias("unclamped"))
    cells = t.raw.select("cell", "r", "c").join(wet.select("cell", "depth_m"), "cell").join(level, "cell").drop("cell")
    boxes = spark.sql(_BIG, part=table(spark, sf_dir, "part")).withColumn("found_ht_m", F.col("found_ht_m").cast("double"))
    rows = t.raw.agg(F.max("r").alias("r")).first()["r"] + 1
    return E.building_depths(boxes, cells, CELLSIZE, rows, COLS).select("building_id", r6("depth_m"), r6("floor_margin_m"))


_WHOLE = H.ladder()


@query(
    _with(
        _AT.replace(_values(RUNGS), _values(_WHOLE)) + ", " + _hit("placed"),
        "SELECT CAST(multiplier AS DOUBLE) AS multiplier, round(sum(fraction * exposed), 2) AS damage, count(*) FILTER (margin_m > 0) AS wet, sum(CASE WHEN margin_m > 0 THEN pop ELSE 0 END) AS residents, round(sum(CASE WHEN hand <= 0 THEN fraction * exposed ELSE 0 END), 2) AS in_channel FROM hit GROUP BY multiplier",
    )
)
def whole_ladder(spark, sf_dir):
    """All 65 rungs of the discharge."""
    t, stages = _stages(spark, sf_dir, _WHOLE)
    return E.damage_ladder(_placed(spark, sf_dir, t), stages).select("multiplier", F.round("damage", 2).alias("damage"), "wet", "residents", F.round("in_channel", 2).alias("in_channel"))


@query(
    _with(
        _STAGE.replace(_values(RUNGS), _values(_WHOLE)) + f""", {_MARKS}, mk AS (SELECT dem.z AS ground, dem.z + marks.depth_m AS observed, hd.hand, hd.reach FROM marks JOIN dem ON dem.cell = marks.cell JOIN hd ON hd.cell = dem.cell WHERE quality IN (1, 2) AND coalesce(lower(environment), '') <> 'coastal' AND marks.depth_m IS NOT NULL),
    er AS (SELECT m.multiplier, greatest(coalesce(stage_m - hand, 0), 0) AS d, ground + greatest(coalesce(stage_m - hand, 0), 0) - observed AS e FROM mk CROSS JOIN m LEFT JOIN stage ON stage.reach = mk.reach AND stage.multiplier = m.multiplier),
    ft AS (SELECT CAST(multiplier AS DOUBLE) AS multiplier, count(*) AS n, sqrt(avg(e * e)) AS rmse, avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END) AS wet FROM er GROUP BY multiplier)""",
        "SELECT multiplier, n, round(rmse, 6) AS rmse, round(wet, 6) AS wet, coalesce(multiplier = (SELECT multiplier FROM ft WHERE wet >= 0.3 ORDER BY rmse, multiplier LIMIT 1), false) AS chosen FROM ft",
    )
)
def implied_discharge(spark, sf_dir):
    """The multiple of the discharge that fits the marks best, of those that wet 30 % of them: marks of made data lie anywhere."""
    t, stages = _stages(spark, sf_dir, _WHOLE)
    marks = V.scorable_marks(view(spark, sf_dir, "marks")).join(t.raw.select("cell", "z"), "cell").join(t.hand.select("cell", "hand", "reach"), "cell")
    rows = marks.select("reach", "hand", F.col("z").alias("ground_m"), (F.col("z") + F.col("depth_m")).alias("observed_m"))
    return V.implied_discharge(rows, stages, 0.3).select("multiplier", "n", r6("rmse"), r6("wet"), "chosen")


# SQL texts and streams.


@query(_with(_DEM, f"SELECT cell, count(*) AS lower, min(code) AS first_code, round(max((z - n_z) / far), 6) AS steepest, CAST(year(DATE '2000-01-01' + CAST(cell % 700 AS INT)) + CASE WHEN month(DATE '2000-01-01' + CAST(cell % 700 AS INT)) >= 10 THEN 1 ELSE 0 END AS INT) AS wy FROM nb WHERE n_z < z GROUP BY cell"))
def sql_neighbours(spark, sf_dir):
    register(spark)
    text = """SELECT d.cell, count(*) AS lower, CAST(min(n.code) AS INT) AS first_code, round(max((d.z - e.z) / n.far), 6) AS steepest, max(water_year(date_add(DATE '2000-01-01', CAST(d.cell % 700 AS INT)))) AS wy
        FROM {dem} d, LATERAL d8_neighbours(d.r, d.c) n JOIN {dem} e ON e.r = n.r AND e.c = n.c WHERE e.z < d.z GROUP BY d.cell"""
    return spark.sql(text, dem=view(spark, sf_dir, "dem"))


_BOXES = "SELECT p_partkey AS id, (p_partkey * 7) % 1200 + 0.5 AS x, -((p_partkey * 5) % 1100) - 0.5 AS y, 5.0 + p_size AS w FROM {part}"


@query(f"WITH b AS ({_BOXES.replace('{part}', 'part')}) SELECT id, CAST((floor((x + w) / 10) - floor(x / 10) + 1) * (floor((w - y) / 10) - floor(-y / 10) + 1) AS BIGINT) AS n FROM b")
def sql_boxes(spark, sf_dir):
    register(spark)
    text = """SELECT b.id, count(*) AS n FROM {boxes} b, LATERAL cells_of_box(CAST(b.x AS DOUBLE), CAST(b.y - b.w AS DOUBLE), CAST(b.x + b.w AS DOUBLE), CAST(b.y AS DOUBLE), 10.0D) k GROUP BY b.id"""
    return spark.sql(text, boxes=spark.sql(_BOXES, part=table(spark, sf_dir, "part")))


_STEPS = [0.5, 1.0, 2.0]


@query(
    _with(
        _STAGE + f""", dp AS MATERIALIZED (SELECT hd.cell, m.multiplier, CASE WHEN hd.hand IS NOT NULL THEN greatest(coalesce(s.stage_m, 0.0) - hd.hand, 0.0) END AS depth_m FROM hd CROSS JOIN m LEFT JOIN stage s ON s.reach = hd.reach AND s.multiplier = m.multiplier WHERE m.multiplier IN ({", ".join(map(str, _STEPS))})),
    pl AS MATERIALIZED (SELECT cell, multiplier FROM dp WHERE depth_m >= 0.05), cn(cell, multiplier) AS (SELECT st.cell, pl.multiplier FROM st JOIN pl ON pl.cell = st.cell UNION SELECT nb.n_cell, cn.multiplier FROM cn JOIN nb ON nb.cell = cn.cell JOIN pl ON pl.cell = nb.n_cell AND pl.multiplier = cn.multiplier)""",
        "SELECT CAST(dp.multiplier AS DOUBLE) AS step, dp.cell, round(dp.depth_m, 6) AS depth_m FROM dp JOIN cn ON cn.cell = dp.cell AND cn.multiplier = dp.multiplier",
    )
)
def streamed_extents(spark, sf_dir):
    """The wet cells of every micro-batch of stages, connectivity decided within the batch."""
    t, stages = _stages(spark, sf_dir)
    source, out = _folder(spark, "readings"), _folder(spark, "extents")
    rows = stages.where(F.col("multiplier").isin(_STEPS)).select("reach", F.col("multiplier").alias("step"), "stage_m")
    log = _folder(spark, "checkpoint")
    for step in _STEPS:
        rows.where(F.col("step") == step).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        G.extents(stream, lambda s: H.inundate(t.hand, t.raw, s, t.streams, COLS, size=t.size), out, log).awaitTermination()
    return spark.read.parquet(out).where("connected").select("step", "cell", r6("depth_m"))
