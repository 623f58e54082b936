"""Registered queries of places, gauges, marks, tiles, polygons, projections, raster windows and result tables, with their oracles."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from freshet.operators import exposure as E
from freshet.operators import gauging as G
from freshet.operators import hydraulics as H
from freshet.operators import network as N
from freshet.operators import overlay as O
from freshet.operators import spatial as S
from freshet.operators import terrain as T
from freshet.operators import validation as V
from freshet.plans.queries import _ACC, _DEM, _FLATS, _STAGE, _STREAMS, _WAY, _curves, _with, query, r6
from freshet.plans.terrain import THRESHOLD, terrain
from freshet.sources import raster as R
from freshet.sources.adapters import CELLSIZE, COLS, sql_text, view
from freshet.sources.store import shared_dir, table
from freshet.streaming.gauges import stages as stage_stream
from freshet.streaming.gauges import token_bucket

# Gauge tables as text: one table a site, with comments, a line of formats, and lines that are cut off.

_PEAK = "SELECT o_custkey AS site, CAST(o_orderdate AS DATE) AS day, o_totalprice AS q, o_orderkey AS k FROM {orders}"


def _rdb(spark, sf_dir):
    rows = spark.sql(_PEAK, orders=table(spark, sf_dir, "orders"))
    line = F.when(F.col("k") % 9 == 0, F.concat_ws("\t", F.lit("USGS"), F.col("site").cast("string"))).otherwise(
        F.concat_ws("\t", F.lit("USGS"), F.col("site").cast("string"), F.col("day").cast("string"), F.when(F.col("k") % 11 == 0, F.lit("  ")).otherwise(F.col("q").cast("string")), F.when(F.col("k") % 4 == 0, F.lit("")).otherwise((F.col("k") % 300 / 10).cast("string")))
    )
    head = "# a comment\n\nagency_cd\tsite_no\tpeak_dt\tpeak_va\tgage_ht\n5s\t15s\t10d\t8s\t8s\n"
    return rows.groupBy("site").agg(F.concat(F.lit(head), F.array_join(F.collect_list(line), "\n")).alias("text"))


_GOOD = f"p AS ({_PEAK.replace('{orders}', 'orders')}), g AS (SELECT site, CAST(day AS VARCHAR) AS date, q * 0.0283168 AS cms, CASE WHEN month(day) >= 10 THEN year(day) + 1 ELSE year(day) END AS water_year, k FROM p WHERE k % 9 <> 0 AND k % 11 <> 0)"


def _series(spark, sf_dir):
    return G.peak_series(G.parsed_rdb(_rdb(spark, sf_dir), "site"), "site")


@query(f"WITH {_GOOD} SELECT site, date, round(cms, 6) AS cms, water_year FROM g")
def gauge_peaks(spark, sf_dir):
    return _series(spark, sf_dir).select("site", "date", r6("cms"), "water_year")


@query(f"WITH {_GOOD} SELECT site, round(max(cms), 6) AS discharge_cms, arg_max(date, cms) AS date, count(*) AS n_years FROM g GROUP BY site")
def peak_of_record(spark, sf_dir):
    return G.peak_of_record(_series(spark, sf_dir), "site").select("site", r6("discharge_cms"), "date", "n_years")


@query(
    f"""WITH {_GOOD}, e AS (SELECT site, quantile_cont(cms, 0.9) AS q FROM g GROUP BY site), r AS (SELECT g.site, cms, date, row_number() OVER (PARTITION BY g.site ORDER BY cms DESC, date) AS i FROM g JOIN e ON e.site = g.site WHERE cms > q)
    SELECT site, string_agg(CAST(CAST(round(cms) AS BIGINT) AS VARCHAR) || ' ' || date, '; ' ORDER BY i) AS floods FROM r WHERE i <= 5 GROUP BY site"""
)
def larger_floods(spark, sf_dir):
    peaks = _series(spark, sf_dir)
    events = peaks.groupBy("site").agg(F.percentile("cms", F.lit(0.9)).alias("discharge_cms"))
    return G.larger_floods(peaks, events).select("site", F.array_join(F.transform("floods", lambda x: F.concat_ws(" ", x["cms"].cast("long").cast("string"), x["date"])), "; ").alias("floods"))


_LEVEL = "SELECT c_custkey AS site, CASE WHEN c_custkey % 6 = 0 THEN ' ' ELSE CAST(c_acctbal AS {t}) END AS alt_va, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'n/a' ELSE CAST(c_custkey % 90 / 4.0 AS {t}) END AS gage_ht FROM {customer}"


@query("SELECT c_custkey AS site, CASE WHEN c_custkey % 6 <> 0 AND c_custkey % 5 > 1 THEN round((c_acctbal + c_custkey % 90 / 4.0) * 0.3048, 6) END AS wse_m FROM customer")
def peak_surfaces(spark, sf_dir):
    sites = spark.sql(_LEVEL.replace("{t}", "STRING"), customer=table(spark, sf_dir, "customer"))
    return G.peak_surface(sites).select("site", r6("wse_m"))


_CHOICE = "SELECT c_nationkey AS unit, c_custkey AS site, CASE WHEN c_custkey % 13 = 0 THEN CAST('nan' AS DOUBLE) ELSE c_acctbal % 27 END AS wse_m, 1.5 AS bed_m, CASE c_custkey % 5 WHEN 0 THEN 'NGVD29' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'NAVD88' END AS datum FROM {customer}"


@query(
    f"""WITH g AS ({_CHOICE.replace("{customer}", "customer")}), p AS (SELECT *, NOT isnan(wse_m) AND wse_m - bed_m BETWEEN 0 AND 20 AS ok FROM g),
    n AS (SELECT unit, datum, count(*) AS n FROM p WHERE ok AND coalesce(datum, '') <> '' GROUP BY unit, datum QUALIFY row_number() OVER (PARTITION BY unit ORDER BY count(*) DESC, datum) = 1)
    SELECT p.unit, site, CASE WHEN NOT ok THEN 'implausible depth' WHEN coalesce(p.datum, '') <> '' AND p.datum <> n.datum THEN 'another datum' END AS reason FROM p LEFT JOIN n ON n.unit = p.unit"""
)
def chosen_gauges(spark, sf_dir):
    gauges = spark.sql(_CHOICE, customer=table(spark, sf_dir, "customer")).withColumns({"wse_m": F.col("wse_m").cast("double"), "bed_m": F.col("bed_m").cast("double")})
    return G.chosen_gauges(gauges, "unit").select("unit", "site", "reason")


@query(_with(_DEM.replace("dem AS", "dem AS", 1), "SELECT s_suppkey AS site, round((s_acctbal + 5000) * 0.3048 + 2.5, 6) AS datum_m, CASE WHEN z IS NULL THEN 'no ground' WHEN (s_acctbal + 5000) * 0.3048 + 2.5 < z THEN 'below the bed' END AS problem, CASE WHEN (s_acctbal + 5000) * 0.3048 + 2.5 >= z THEN round((s_acctbal + 5000) * 0.3048 + 2.5 - z, 6) END AS depth_m FROM supplier LEFT JOIN dem ON dem.cell = s_suppkey * 211"))
def resolved_gauges(spark, sf_dir):
    readings = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site"), (F.col("s_suppkey") * 211).alias("cell"), (F.col("s_acctbal") + 5000).alias("reading"))
    return G.resolved_gauges(readings, view(spark, sf_dir, "dem"), "ft", 2.5).select("site", r6("datum_m"), "problem", r6("depth_m"))


@query(_with(_WAY.replace("JOIN supplier ON s_suppkey = link WHERE seq = 0", "WHERE cell = (SELECT max(cell) FROM links WHERE seq = 0)"), "SELECT t.cell, round(coalesce(greatest(4.0 - 0.01 * d.m, 0), 4.0), 6) AS stage_m FROM routed t LEFT JOIN (SELECT w.src AS cell, arg_min(w.d + p.base, w.d) AS m FROM way2 w JOIN path p ON p.node = w.node GROUP BY w.src) d ON d.cell = t.cell"))
def slope_stage(spark, sf_dir):
    t = terrain(spark, sf_dir)
    gauge = t.links.where("seq = 0").agg(F.max("cell").alias("cell")).select(F.lit(1).alias("gauge"), "cell")
    far = N.network_distance(t.routed, gauge, CELLSIZE, t.size).select("cell", "distance_m")
    return G.stage_field(t.routed.select("cell").join(far, "cell", "left"), "slope", 4.0, 0.01).select("cell", r6("stage_m"))


@query(_with(_ACC, "SELECT s_nationkey AS unit, arg_max(s_suppkey, accumulation * 1e6 - s_suppkey) AS site, round(max(accumulation) * 100 / 1e6, 1) AS area_km2 FROM supplier JOIN acc ON acc.cell = s_suppkey * 149 GROUP BY s_nationkey"))
def best_gauge(spark, sf_dir):
    at = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("unit"), F.col("s_suppkey").alias("site"), (F.col("s_suppkey") * 149).alias("cell"))
    return G.best_gauge(at.join(terrain(spark, sf_dir).routed.select("cell", "accumulation"), "cell"), "unit", CELLSIZE**2)


# Surveyed marks.

_HWM = "SELECT c_custkey AS mark_id, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE (c_custkey * 37 % 1400) - 40.0 END AS longitude_dd, -CAST(c_custkey * 53 % 1300 AS DOUBLE) AS latitude_dd, CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE c_acctbal END AS elev_ft, c_nationkey AS event_id, c_custkey % 11 AS unit FROM {customer}"
_EVENT = "SELECT n_nationkey AS event_id, n_name AS name, CAST(2000 + n_nationkey % 4 AS {t}) || '-08-24' AS date FROM {nation} WHERE n_nationkey % 6 > 0"
_MARKS = f"hwm AS ({_HWM.replace('{customer}', 'customer')}), ev AS ({_EVENT.replace('{nation}', 'nation').replace('{t}', 'VARCHAR')}), lm AS (SELECT hwm.*, coalesce(name, '') AS event_name, coalesce(date, '') AS event_date FROM hwm LEFT JOIN ev ON ev.event_id = hwm.event_id WHERE longitude_dd IS NOT NULL AND elev_ft IS NOT NULL)"


def _located(spark, sf_dir):
    marks = spark.sql(_HWM, customer=table(spark, sf_dir, "customer"))
    events = spark.sql(_EVENT.replace("{t}", "STRING"), nation=table(spark, sf_dir, "nation"))
    return G.located_marks(marks, events)


@query(f"WITH {_MARKS} SELECT mark_id, event_name, event_date FROM lm")
def located_marks(spark, sf_dir):
    return _located(spark, sf_dir).select("mark_id", "event_name", "event_date")


@query(f"WITH dem AS ({sql_text('dem')}), {_MARKS} SELECT mark_id, r, c, round(z, 2) AS ground_m FROM lm JOIN dem ON dem.r = CAST(trunc(-latitude_dd / 10) AS INT) AND dem.c = CAST(trunc(longitude_dd / 10) AS INT) WHERE c < {COLS}")
def placed_marks(spark, sf_dir):
    marks = _located(spark, sf_dir).select("mark_id", F.col("longitude_dd").cast("double").alias("x"), F.col("latitude_dd").alias("y"))
    ground = view(spark, sf_dir, "dem")
    rows = ground.agg(F.max("r").alias("r")).first()["r"] + 1
    return G.placed_marks(marks, ground, CELLSIZE, rows, COLS).select("mark_id", "r", "c", "ground_m")


@query(
    f"""WITH {_MARKS}, {_GOOD}, y AS (SELECT unit, substr(event_date, 1, 4) AS y, count(*) AS n, min(mark_id) AS seen FROM lm WHERE event_date <> '' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY unit ORDER BY count(*) DESC, min(mark_id)) = 1),
    s AS (SELECT DISTINCT site % 11 AS unit, site FROM g), t AS (SELECT site, CAST(CAST(substr(date, 1, 4) AS INT) + 3 AS VARCHAR) AS y, max(cms) AS cms FROM g GROUP BY 1, 2)
    SELECT s.unit, s.site, CASE WHEN t.cms IS NOT NULL THEN y.y END AS event_year, round(t.cms, 6) AS event_discharge_cms, CASE WHEN t.cms IS NOT NULL THEN n END AS matched_marks FROM s LEFT JOIN y ON y.unit = s.unit LEFT JOIN t ON t.site = s.site AND t.y = y.y"""
)
def event_gauge(spark, sf_dir):
    """Peaks are dated three years later, so that some share a year with the marks."""
    peaks = _series(spark, sf_dir).withColumn("date", F.concat((F.substring("date", 1, 4).cast("int") + 3).cast("string"), F.substring("date", 5, 6)))
    gauges = peaks.select((F.col("site") % 11).alias("unit"), "site").distinct()
    return G.event_matched(gauges, _located(spark, sf_dir).select("unit", "event_date", "mark_id"), peaks).select("unit", "site", "event_year", r6("event_discharge_cms"), "matched_marks")


# Polygons: an L of two rectangles for every supplier.

_ELL = "SELECT s_suppkey AS unit, (s_suppkey * 97 % 900) * 1.0 AS x0, -(s_suppkey * 61 % 1000) * 1.0 AS y0, 120.0 + s_suppkey % 50 AS w FROM {supplier}"


def _ells(spark, sf_dir):
    e = spark.sql(_ELL, supplier=table(spark, sf_dir, "supplier"))
    at = lambda a, b: F.struct((F.col("x0") + a * F.col("w")).cast("double").alias("x"), (F.col("y0") - b * F.col("w")).cast("double").alias("y"))
    return e.select("unit", F.array(at(0, 0), at(2, 0), at(2, 1), at(1, 1), at(1, 2), at(0, 2)).alias("ring"))


def _in_ell(x: str, y: str, closed: bool = False) -> str:
    lt = "<=" if closed else "<"
    return f"(({x} - x0) / w {lt} 2 AND (y0 - {y}) / w {lt} 1 OR ({x} - x0) / w {lt} 1 AND (y0 - {y}) / w {lt} 2) AND {x} {'>=' if closed else '>'} x0 AND {y} {'<=' if closed else '<'} y0"


@query(f"WITH ell AS ({_ELL.replace('{supplier}', 'supplier')}), {_MARKS} SELECT mark_id, ell.unit FROM lm JOIN ell ON {_in_ell('longitude_dd', 'latitude_dd')}")
def marks_in_units(spark, sf_dir):
    points = _located(spark, sf_dir).select("mark_id", F.col("longitude_dd").cast("double").alias("x"), F.col("latitude_dd").alias("y"))
    return S.points_in_units(points, _ells(spark, sf_dir), 200.0).select("mark_id", "unit")


@query(f"WITH ell AS ({_ELL.replace('{supplier}', 'supplier')}), {_MARKS} SELECT mark_id, ell.unit FROM lm JOIN ell ON {_in_ell('longitude_dd', 'latitude_dd', True)}")
def structures_in_units(spark, sf_dir):
    """As marks_in_units, but points on an edge count."""
    points = _located(spark, sf_dir).select("mark_id", F.col("longitude_dd").cast("double").alias("x"), F.col("latitude_dd").alias("y"))
    return S.points_in_units(points, _ells(spark, sf_dir), 200.0, True).select("mark_id", "unit")


@query(f"WITH dem AS ({sql_text('dem')}), ell AS ({_ELL.replace('{supplier}', 'supplier')}) SELECT unit, cell FROM dem JOIN ell ON {_in_ell('((c + 0.5) * 10)', '(-(r + 0.5) * 10)')}")
def geometry_mask(spark, sf_dir):
    return S.geometry_mask(view(spark, sf_dir, "dem"), _ells(spark, sf_dir), CELLSIZE)


@query(f"WITH dem AS ({sql_text('dem')}), ell AS ({_ELL.replace('{supplier}', 'supplier')}) SELECT unit, cell, CASE WHEN cell % 3 > 0 THEN z ELSE z + 1 END AS z FROM dem JOIN ell ON {_in_ell('((c + 0.5) * 10)', '(-(r + 0.5) * 10)')}")
def ingested(spark, sf_dir):
    """Two tiles over one ground: the first lacks every third cell, the second lies a metre higher."""
    dem = view(spark, sf_dir, "dem")
    tiles = dem.select(F.lit("a").alias("path"), "cell", "r", "c", F.when(F.col("cell") % 3 > 0, F.col("z")).otherwise(float("nan")).alias("z")).unionByName(dem.select(F.lit("b").alias("path"), "cell", "r", "c", (F.col("z") + 1).alias("z")))
    order = dem.sparkSession.createDataFrame([("a", 0), ("b", 1)], "path string, ord int")
    return R.ingested(tiles, order, _ells(spark, sf_dir), CELLSIZE)


@query(f"WITH ell AS ({_ELL.replace('{supplier}', 'supplier')}) SELECT unit, round(3 * w * w, 6) AS area, round(8 * w, 6) AS perimeter, round(x0 + 5 * w / 6, 6) AS cx, round(y0 - 5 * w / 6, 6) AS cy FROM ell")
def unit_geometry(spark, sf_dir):
    ring = F.col("ring")
    return _ells(spark, sf_dir).select("unit", F.round(S.area(ring), 6).alias("area"), F.round(S.perimeter(ring), 6).alias("perimeter"), F.round(S.centroid(ring)["x"], 6).alias("cx"), F.round(S.centroid(ring)["y"], 6).alias("cy"))


@query(f"WITH ell AS ({_ELL.replace('{supplier}', 'supplier')}) SELECT CAST(unit AS VARCHAR) AS huc, round(3 * w * w, 6) AS area, 6 AS points FROM ell")
def watersheds(spark, sf_dir):
    """Units through GeoJSON and back, largest first; a collection holds twenty of them."""
    features = S.as_geojson(_ells(spark, sf_dir).withColumn("huc", F.col("unit").cast("string")), ["huc"])
    page = F.floor(F.get_json_object("feature", "$.properties.huc").cast("long") / 20)
    whole = features.groupBy(page).agg(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join(F.collect_list("feature"), ","), F.lit("]}")).alias("json"))
    return S.units_of(whole).select(F.col("properties.huc").alias("huc"), r6("area"), F.size("ring").alias("points"))


@query(f"WITH ell AS ({_ELL.replace('{supplier}', 'supplier')}), b AS (SELECT *, {_in_ell('451.5', '-333.5')} AS inside FROM ell WHERE x0 <= 451.5 AND x0 + 2 * w >= 451.5 AND y0 >= -333.5 AND y0 - 2 * w <= -333.5) SELECT unit FROM b ORDER BY inside DESC, unit LIMIT 1")
def unit_of_point(spark, sf_dir):
    return S.unit_of_point(_ells(spark, sf_dir), 451.5, -333.5).select("unit")


# Tiles and extents.

_TILE = "SELECT 'd/USGS_' || CAST(o_orderkey AS {t}) || CASE WHEN o_custkey % 4 > 0 THEN '_' || replace(CAST(CAST(o_orderdate AS DATE) AS {t}), '-', '') ELSE '' END || '.tif' AS path, (o_custkey % 9) * 0.5 + o_orderkey % 3 * 0.000001 AS xmin, (o_custkey % 7) * 1.0 AS ymin, (o_custkey % 9) * 0.5 + 0.5 AS xmax, (o_custkey % 7) * 1.0 + 1 AS ymax FROM {orders}"


def _tiles(spark, sf_dir):
    rows = spark.sql(_TILE.replace("{t}", "STRING"), orders=table(spark, sf_dir, "orders"))
    return rows.select("path", *[F.col(c).cast("double").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


@query(
    f"""WITH t AS (SELECT path, round(xmin, 4)::DOUBLE AS xmin, round(ymin, 4)::DOUBLE AS ymin, TRY_CAST(strptime(nullif(regexp_extract(path, '_(\\d{{8}})\\.tif$', 1), ''), '%Y%m%d') AS DATE) AS day FROM ({_TILE.replace("{orders}", "orders").replace("{t}", "VARCHAR")}))
    SELECT xmin, ymin, path, CAST(day AS VARCHAR) AS day, count(*) OVER (PARTITION BY xmin, ymin) - 1 AS rejected FROM t QUALIFY row_number() OVER (PARTITION BY xmin, ymin ORDER BY day IS NULL, abs(day - DATE '1995-08-24'), path) = 1"""
)
def selected_tiles(spark, sf_dir):
    return S.selected_tiles(_tiles(spark, sf_dir), "1995-08-24").select("xmin", "ymin", "path", F.col("day").cast("string").alias("day"), "rejected")


@query(f"WITH t AS ({_TILE.replace('{orders}', 'orders').replace('{t}', 'VARCHAR')}) SELECT CAST(min(xmin) AS DOUBLE) AS xmin, CAST(max(ymax) AS DOUBLE) AS ymax, CAST(round_even((max(xmax) - min(xmin)) / 0.3, 0) AS BIGINT) AS cols, CAST(round_even((max(ymax) - min(ymin)) / 0.3, 0) AS BIGINT) AS rows FROM t")
def tile_extent(spark, sf_dir):
    return S.estimated_cells(S.extent(_tiles(spark, sf_dir)), 0.3).select("xmin", "ymax", "cols", "rows")


_BLDG = "SELECT p_partkey AS id, (p_partkey * 7 % 1000) * 1.0 AS x, (p_partkey * 11 % 900) * 1.0 AS y, p_size AS s, CASE p_partkey % 6 WHEN 0 THEN 'medical' WHEN 1 THEN 'civic' WHEN 2 THEN 'agricultural' WHEN 3 THEN 'residential' WHEN 4 THEN 'unheard' ELSE NULL END AS subtype FROM {part}"


@query(f"WITH b AS ({_BLDG.replace('{part}', 'part')}) SELECT id, CASE subtype WHEN 'medical' THEN 'commercial' WHEN 'civic' THEN 'other' WHEN 'agricultural' THEN 'industrial' ELSE 'residential' END AS building_class FROM b WHERE x < 400 AND x + s > 150 AND y < 700 AND y + s > 200")
def buildings_in_window(spark, sf_dir):
    rows = spark.sql(_BLDG, part=table(spark, sf_dir, "part"))
    boxed = rows.select("id", "subtype", F.struct(F.col("x").alias("xmin"), (F.col("x") + F.col("s")).alias("xmax"), F.col("y").alias("ymin"), (F.col("y") + F.col("s")).alias("ymax")).alias("bbox"))
    return S.overlapping(boxed, 150.0, 200.0, 400.0, 700.0).select("id", S.subtype_class(F.col("subtype")).alias("building_class"))


# Projections.

_PLACE = "SELECT p_partkey AS id, -96.9 + p_partkey % 1999 * 0.001 AS lon, 25.0 + p_partkey % 1777 * 0.01 AS lat FROM {part}"


def _places(spark, sf_dir):
    return spark.sql(_PLACE, part=table(spark, sf_dir, "part")).select("id", F.col("lon").cast("double"), F.col("lat").cast("double"))


@query(f"WITH p AS ({_PLACE.replace('{part}', 'part')}) SELECT id, round(lon, 6) AS lon, round(lat, 6) AS lat, true AS northern FROM p")
def utm_and_back(spark, sf_dir):
    """Forward and inverse must cancel; a test holds both against known places."""
    there = _places(spark, sf_dir).withColumn("p", S.to_utm(F.col("lon"), F.col("lat"), 15))
    back = S.from_utm(F.col("p.x"), F.col("p.y"), 15)
    return there.select("id", F.round(back["lon"], 6).alias("lon"), F.round(back["lat"], 6).alias("lat"), (F.col("p.y") > 0).alias("northern"))


_E = math.sqrt((1 / 298.257222101) * (2 - 1 / 298.257222101))


def _q(s: str) -> str:
    return f"((1 - {_E}*{_E}) * (({s}) / (1 - {_E}*{_E} * ({s}) * ({s})) - ln((1 - {_E} * ({s})) / (1 + {_E} * ({s}))) / (2 * {_E})))"


def _m(d: str) -> str:
    return f"(cos(radians({d})) / sqrt(1 - pow({_E} * sin(radians({d})), 2)))"


@query(
    f"""WITH p AS ({_PLACE.replace("{part}", "part")}), k AS (SELECT (pow({_m("29.5")}, 2) - pow({_m("45.5")}, 2)) / ({_q("sin(radians(45.5))")} - {_q("sin(radians(29.5))")}) AS n),
    j AS (SELECT n, pow({_m("29.5")}, 2) + n * {_q("sin(radians(29.5))")} AS c FROM k), h AS (SELECT p.id, n, 6378137.0 * sqrt(c - n * {_q("sin(radians(lat))")}) / n AS rho, 6378137.0 * sqrt(c - n * {_q("sin(radians(23.0))")}) / n AS rho0, n * radians(lon + 96.0) AS th FROM p, j)
    SELECT id, round(rho * sin(th), 2) AS x, round(rho0 - rho * cos(th), 2) AS y FROM h"""
)
def equal_area(spark, sf_dir):
    a = S.to_albers(F.col("lon"), F.col("lat"))
    return _places(spark, sf_dir).select("id", F.round(a["x"], 2).alias("x"), F.round(a["y"], 2).alias("y"))


@query(f"WITH p AS ({_PLACE.replace('{part}', 'part')}) SELECT id, round(radians(lon) * 6378137, 3) AS mx, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137, 3) AS my, round(lon, 6) AS lon, round(lat, 6) AS lat FROM p")
def web_mercator(spark, sf_dir):
    from freshet.functions.scalar import to_web_mercator

    x, y = to_web_mercator(F.col("lon"), F.col("lat"))
    rows = _places(spark, sf_dir).select("id", x.alias("mx"), y.alias("my"))
    back = S.from_web_mercator(F.col("mx"), F.col("my"))
    return rows.select("id", F.round("mx", 3).alias("mx"), F.round("my", 3).alias("my"), F.round(back["lon"], 6).alias("lon"), F.round(back["lat"], 6).alias("lat"))


@query(f"WITH p AS ({_PLACE.replace('{part}', 'part')}) SELECT id, 26900 + CAST(floor((lon + 180) / 6) AS INTEGER) + 1 AS srid FROM p")
def utm_zones(spark, sf_dir):
    from freshet.functions.scalar import utm_zone_srid

    return _places(spark, sf_dir).select("id", utm_zone_srid(F.col("lon"), F.col("lat")).alias("srid"))


# Rasters.


@query(f"WITH dem AS ({sql_text('dem')}) SELECT cell, CASE WHEN z <> 3900 THEN z END AS z FROM dem WHERE r >= 10 AND r < 60 AND c >= 20 AND c < 100")
def raster_window(spark, sf_dir):
    return R.read_window(view(spark, sf_dir, "dem"), (10, 60), (20, 100), 3900.0).select("cell", "z")


@query(f"WITH dem AS ({sql_text('dem')}), g AS (SELECT r // 48 * 3 + c // 48 AS w, count(*) AS n, min(z) AS low, max(z) AS high, round(avg(z), 6) AS mean FROM dem WHERE z <> 3900 GROUP BY 1), s AS (SELECT max(r) + 1 AS h FROM dem), k AS (SELECT unnest(range(0, (SELECT CAST(ceil(h / 48) AS BIGINT) * CAST(ceil({COLS} / 48) AS BIGINT) FROM s))) AS k) SELECT k AS window, k // 3 * 48 AS r0, k % 3 * 48 AS c0, least(48, h - k // 3 * 48) AS height, least(48, {COLS} - k % 3 * 48) AS width, coalesce(n, 0) AS n_valid, low, high, mean FROM k CROSS JOIN s LEFT JOIN g ON g.w = k")
def raster_windows(spark, sf_dir):
    """What every window of the grid holds, windows without a valid cell included."""
    cells = R.read_window(view(spark, sf_dir, "dem"), nodata=3900.0)
    rows = cells.agg(F.max("r").alias("r")).first()["r"] + 1
    return R.window_figures(cells, rows, COLS, 48).withColumn("mean", r6("mean"))


@query(_with(_FLATS, "SELECT count(*) AS cells, count(*) FILTER (flowdir = -1) AS outlets, count(*) FILTER (flowdir = -2) AS stuck FROM routed"))
def routing_counts(spark, sf_dir):
    code = F.col("flowdir")
    return terrain(spark, sf_dir).routed.agg(F.count("*").alias("cells"), F.count_if(code == T.OUTLET).alias("outlets"), F.count_if(code == T.FLAT).alias("stuck"))


#: A law of width that makes channels of several cells out of the grid's small basins.
_WIDE = (200.0, 0.321)


def _ring(k: int) -> str:
    """CTE of one more ring of burning: from b{k} to b{k + 1}, unchanged once all rings are grown."""
    return f""", b{k + 1} AS MATERIALIZED (SELECT b.cell, CASE WHEN {k} < (SELECT rings FROM n) AND wd.cell IS NOT NULL THEN greatest(b.dep, coalesce((SELECT max(o.dep) FROM n4 JOIN b{k} o ON o.cell = n4.n_cell WHERE n4.cell = b.cell), 0)) ELSE b.dep END AS dep FROM b{k} b LEFT JOIN wd ON wd.cell = b.cell)"""


@query(
    _with(
        _STREAMS + f""", ch AS (SELECT st.cell, least(0.381 * pow(accumulation * {CELLSIZE**2} / 1e6, 0.246), 8) AS dep, {_WIDE[0]} * pow(accumulation * {CELLSIZE**2} / 1e6, {_WIDE[1]}) AS wid FROM st JOIN acc ON acc.cell = st.cell),
    n AS (SELECT greatest(0, floor((max(wid) / {CELLSIZE} - 1) / 2)) AS rings FROM ch), n4 AS MATERIALIZED (SELECT cell, n_cell FROM nb WHERE code IN (1, 4, 16, 64)),
    wd AS MATERIALIZED (SELECT DISTINCT n4.n_cell AS cell FROM n4 JOIN ch ON ch.cell = n4.cell WHERE wid > {CELLSIZE}), b0 AS MATERIALIZED (SELECT d.cell, coalesce(dep, 0) AS dep FROM dem d LEFT JOIN ch ON ch.cell = d.cell)"""
        + "".join(_ring(k) for k in range(8)),
        "SELECT d.cell, round(d.z - b8.dep, 6) AS burned FROM dem d JOIN b8 ON b8.cell = d.cell WHERE (SELECT rings FROM n) BETWEEN 1 AND 8",
    )
)
def burned_channel(spark, sf_dir):
    t = terrain(spark, sf_dir)
    streams = t.streams.select("cell").join(t.routed.select("cell", "accumulation"), "cell")
    return T.burn_channel(t.raw.select("cell", "r", "c", "z"), streams, CELLSIZE, width=_WIDE).select("cell", r6("burned"))


@query(f"WITH dem AS ({sql_text('dem')}), a AS (SELECT cell FROM dem WHERE z % 2 = 0), b AS (SELECT cell FROM dem WHERE c % 3 = 0) SELECT 'both' AS kind, count(*) AS n FROM (SELECT cell FROM a INTERSECT SELECT cell FROM b) UNION ALL SELECT 'first only', count(*) FROM (SELECT cell FROM a EXCEPT SELECT cell FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT cell FROM a UNION SELECT cell FROM b)")
def cell_sets(spark, sf_dir):
    dem = view(spark, sf_dir, "dem")
    a, b = dem.where("z % 2 = 0").select("cell"), dem.where("c % 3 = 0").select("cell")
    sets = {"both": a.intersect(b), "first only": a.exceptAll(b), "either": a.union(b).distinct()}
    out = None
    for kind, cells in sets.items():
        one = cells.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# Structures, claims, results.

_NSI = "SELECT c_custkey AS fd_id, CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE CAST(c_custkey * 7919 AS {t}) END AS cbfips, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_mktsegment END AS occtype, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal + 1000 END AS sqft, CAST(c_custkey % 500 AS DOUBLE) AS ftprntsqft, CAST(c_custkey % 4 AS DOUBLE) AS num_story, 1.5 AS found_ht, 2.0 AS pop2amu65, 1.0 AS pop2amo65, CAST(c_custkey % 3 AS DOUBLE) AS pop2pmu65, 0.0 AS pop2pmo65, (c_custkey % 100) * 12.0 AS x, (c_custkey % 90) * 7.0 AS y FROM {customer}"


@query(
    f"""WITH s AS ({_NSI.replace("{customer}", "customer").replace("{t}", "VARCHAR")}), k AS (SELECT *, lpad(coalesce(cbfips, ''), 15, '0') AS f, greatest(sqrt(ftprntsqft * 0.092903), 4.0) AS side FROM s)
    SELECT fd_id, round(ftprntsqft * 0.092903, 6) AS footprint_m2, round(coalesce(sqft, 0) * 0.092903, 6) AS floor_area_m2, round(found_ht * 0.3048, 6) AS found_ht_m, 3.0 AS pop_night, pop2pmu65 AS pop_day, greatest(num_story, 1) AS num_story, coalesce(occtype, '') AS occtype, substr(f, 1, 11) AS tract_fips, round(x - side / 2, 6) AS xmin, round(y + side / 2, 6) AS ymax FROM k"""
)
def derived_structures(spark, sf_dir):
    raw = spark.sql(_NSI.replace("{t}", "STRING"), customer=table(spark, sf_dir, "customer"))
    for c in ("found_ht", "pop2amu65", "pop2amo65", "pop2pmo65", "x", "y"):
        raw = raw.withColumn(c, F.col(c).cast("double"))
    rows = E.footprints(E.derive_structures(raw))
    return rows.select("fd_id", r6("footprint_m2"), r6("floor_area_m2"), r6("found_ht_m"), "pop_night", "pop_day", "num_story", "occtype", "tract_fips", r6("xmin"), r6("ymax"))


_CLAIM = """ws AS (SELECT s_suppkey AS huc, (s_suppkey % 7) * 6000.0 AS x0, (s_suppkey % 5) * 2100.0 AS y0, 9000.0 AS w FROM supplier), sq AS (SELECT c_custkey AS grp, (c_custkey % 60) * 700.0 AS x, (c_custkey // 60) * 500.0 AS y, 900.0 AS w FROM customer),
cl AS (SELECT o_custkey AS grp, count(*) AS n, sum(o_totalprice) AS paid FROM orders GROUP BY o_custkey),
s AS (SELECT huc, grp, greatest(least(x + sq.w, x0 + ws.w) - greatest(x, x0), 0) * greatest(least(y + sq.w, y0 + ws.w) - greatest(y, y0), 0) / (sq.w * sq.w) AS share FROM sq, ws),
m AS (SELECT huc, round(sum(n * share)) AS claims, sum(paid * share) AS paid FROM s JOIN cl ON cl.grp = s.grp WHERE share > 0 GROUP BY huc),
iv AS (SELECT s_suppkey AS huc, floor(abs(s_acctbal) / 60) AS low, floor(abs(s_acctbal) / 30) AS modelled, floor(abs(s_acctbal) / 12) AS high, abs(s_acctbal) * 500 AS damage FROM supplier)"""


@query(f"""WITH {_CLAIM}, j AS (SELECT ws.huc, CAST(coalesce(claims, 0) AS BIGINT) AS claims, coalesce(paid, 0) AS paid, low, modelled, high, damage FROM ws JOIN iv ON iv.huc = ws.huc LEFT JOIN m ON m.huc = ws.huc)
    SELECT huc, claims, round(paid, 2) AS paid, round(CASE WHEN claims > 0 THEN modelled / claims END, 6) AS ratio, round(CASE WHEN paid > 0 THEN damage / paid END, 6) AS damage_ratio, claims BETWEEN low AND high AS inside, high < claims AS model_below_claims FROM j""")
def claims_against_interval(spark, sf_dir):
    def ring(x, y, w):
        at = lambda a, b: F.struct((F.col(x) + a * F.col(w)).alias("x"), (F.col(y) + b * F.col(w)).alias("y"))
        return F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1)).cast(O.POINT)

    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    groups = customer.select(F.col("c_custkey").alias("group"), (F.col("c_custkey") % 60 * 700.0).alias("x"), (F.floor(F.col("c_custkey") / 60) * 500.0).alias("y"), F.lit(900.0).alias("w"))
    units = supplier.select(F.col("s_suppkey").alias("huc"), (F.col("s_suppkey") % 7 * 6000.0).alias("x"), (F.col("s_suppkey") % 5 * 2100.0).alias("y"), F.lit(9000.0).alias("w"))
    claims = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("group")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("paid"))
    weighed = O.weigh_claims(groups.select("group", ring("x", "y", "w").alias("ring")), claims, units.select("huc", ring("x", "y", "w").alias("ring")))
    figure = F.abs("s_acctbal")
    intervals = supplier.select(F.col("s_suppkey").alias("huc"), F.floor(figure / 60).alias("low"), F.floor(figure / 30).alias("modelled"), F.floor(figure / 12).alias("high"), (figure * 500).alias("damage"))
    return V.against_interval(weighed, intervals, "huc").select("huc", "claims", F.round("paid", 2).alias("paid"), r6("ratio"), r6("damage_ratio"), "inside", "model_below_claims")


_RECT = "greatest(least({a} + {w}, x1 + 300) - greatest({a}, x1), 0) * greatest(least({b}, y1) - greatest({b} - {h}, y1 - 300), 0)"


@query(
    f"""WITH ell AS ({_ELL.replace('{supplier}', 'supplier')}), sq AS (SELECT n_nationkey AS huc, CAST(n_nationkey * 137 % 900 AS DOUBLE) AS x1, -CAST(n_nationkey * 211 % 1000 AS DOUBLE) AS y1 FROM nation),
    s AS (SELECT huc, unit, ({_RECT.format(a='x0', b='y0', w='2 * w', h='w')} + {_RECT.format(a='x0', b='(y0 - w)', w='w', h='w')}) / (3 * w * w) AS share FROM ell, sq),
    m AS (SELECT huc, round(sum((s_nationkey + 1) * share)) AS claims, sum(abs(s_acctbal) * share) AS paid, count(*) AS matched FROM s JOIN supplier ON s_suppkey = unit WHERE share > 1e-9 GROUP BY huc)
    SELECT sq.huc, CAST(coalesce(claims, 0) AS BIGINT) AS claims, round(coalesce(paid, 0), 2) AS paid, coalesce(matched, 0) AS matched FROM sq LEFT JOIN m ON m.huc = sq.huc"""
)
def overlay_of_bent_groups(spark, sf_dir):
    """Groups that are not convex."""
    at = lambda a, b: F.struct((F.col("x") + a).alias("x"), (F.col("y") - b).alias("y"))
    squares = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("huc"), (F.col("n_nationkey") * 137 % 900).cast("double").alias("x"), (-(F.col("n_nationkey") * 211 % 1000)).cast("double").alias("y"))
    units = squares.select("huc", F.array(at(0, 0), at(300, 0), at(300, 300), at(0, 300)).cast(O.POINT).alias("ring"))
    claims = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("group"), (F.col("s_nationkey") + 1).alias("n"), F.abs("s_acctbal").alias("paid"))
    groups = _ells(spark, sf_dir).select(F.col("unit").alias("group"), F.col("ring").cast(O.POINT).alias("ring"))
    return O.weigh_claims(groups, claims, units).select("huc", "claims", F.round("paid", 2).alias("paid"), "matched")


_FEMA = """t AS (SELECT c_nationkey AS tract, sum(o_totalprice) AS modelled, count(*) AS wet FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey),
cl AS (SELECT c_nationkey AS tract, sum(abs(c_acctbal)) AS paid, count(*) AS claims FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY c_nationkey), ai AS (SELECT s_nationkey AS tract, sum(abs(s_acctbal)) AS aid FROM supplier GROUP BY s_nationkey),
j AS (SELECT t.tract, modelled, wet, coalesce(paid, 0) AS paid, coalesce(claims, 0) AS claims, coalesce(aid, 0) AS aid FROM t LEFT JOIN cl ON cl.tract = t.tract LEFT JOIN ai ON ai.tract = t.tract WHERE modelled > 0)"""


def _ranked(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}"


@query(
    f"""WITH {_FEMA}, b AS (SELECT * FROM j WHERE paid > 0 AND aid > 0), r AS (SELECT *, {", ".join(_ranked(c) for c in ("modelled", "paid", "aid"))} FROM b),
    half AS (SELECT CAST(floor(count(*) / 2) AS INT) + 1 AS k FROM b)
    SELECT (SELECT count(*) FROM j) AS n_modelled, count(*) AS n_both, round(corr(r_paid, r_aid), 6) AS rho_paid_aid, round(corr(r_modelled, r_paid), 6) AS rho_paid, round(corr(r_modelled, r_aid), 6) AS rho_aid,
        round(list_sort(list(modelled / paid))[(SELECT k FROM half)], 6) AS ratio_paid, round(list_sort(list(modelled / aid))[(SELECT k FROM half)], 6) AS ratio_aid,
        (SELECT round(sum(paid), 2) FROM cl) AS paid_total, (SELECT CAST(sum(claims) AS BIGINT) FROM cl) AS claims_total, (SELECT round(sum(aid), 2) FROM ai) AS aid_total FROM r"""
)
def aid_comparison(spark, sf_dir):
    orders, customer, supplier = (table(spark, sf_dir, n) for n in ("orders", "customer", "supplier"))
    model = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("tract")).agg(F.sum("o_totalprice").alias("modelled"), F.count("*").alias("wet"))
    claims = customer.where("c_mktsegment <> 'BUILDING'").groupBy(F.col("c_nationkey").alias("tract")).agg(F.sum(F.abs("c_acctbal")).alias("paid"), F.count("*").alias("claims"))
    aid = supplier.groupBy(F.col("s_nationkey").alias("tract")).agg(F.sum(F.abs("s_acctbal")).alias("aid"))
    scores = V.tract_scores(V.compare_tracts(model, claims, aid), claims, aid)
    return scores.select("n_modelled", "n_both", r6("rho_paid_aid"), r6("rho_paid"), r6("rho_aid"), r6("ratio_paid"), r6("ratio_aid"), F.round("paid_total", 2).alias("paid_total"), "claims_total", F.round("aid_total", 2).alias("aid_total"))


@query("SELECT count(*) FILTER (o_totalprice BETWEEN 50000 AND 150000) AS inside, count(*) AS n FROM orders")
def count_within(spark, sf_dir):
    return V.count_within(table(spark, sf_dir, "orders"), "o_totalprice", 50000, 150000)


_RESULT = "SELECT c_custkey AS key, c_acctbal AS value FROM {customer}"


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 > 0 THEN c_acctbal * 1.001 ELSE c_acctbal END AS value, c_custkey % 3 = 0 AND c_custkey % 5 > 0 AND abs(c_acctbal) * 0.001 / greatest(abs(c_acctbal), 1e-12) > 0.0005 AS drifted FROM customer UNION ALL SELECT -c_custkey, c_acctbal, false FROM customer WHERE c_custkey % 100 = 0 AND c_custkey > 0")
def reproduced(spark, sf_dir):
    """Every third figure is computed anew a little off, every fifth of these fails; some are new; then the drift against the old ones."""
    old = spark.sql(_RESULT, customer=table(spark, sf_dir, "customer"))
    new = old.where("key % 3 = 0").select("key", F.when(F.col("key") % 5 > 0, F.col("value") * 1.001).alias("value")).unionByName(old.where("key % 100 = 0").select((-F.col("key")).alias("key"), "value"))
    merged = R.merged_results(old, new)
    golden = old.unionByName(new.where("key < 0")).withColumnRenamed("value", "expected")
    return V.drift(merged, golden, 0.0005).select("key", "value", "drifted")


@query("SELECT count(*) AS n, count(*) FILTER (o_custkey % 4 = 2) AS fresh, count(*) FILTER (o_custkey % 4 <> 2) AS stale FROM orders")
def cache_health(spark, sf_dir):
    return R.cache_health(table(spark, sf_dir, "orders").withColumn("schema", F.col("o_custkey") % 4), 2)


@query("SELECT o_orderkey AS key FROM orders WHERE o_custkey % 4 = 2")
def fresh_results(spark, sf_dir):
    return R.fresh_results(table(spark, sf_dir, "orders").withColumn("schema", F.col("o_custkey") % 4), 2).select(F.col("o_orderkey").alias("key"))


@query("SELECT s_suppkey AS id, 'u' || s_nationkey AS unit, CASE WHEN s_nationkey = 3 THEN s_acctbal + 1 ELSE s_acctbal END AS v FROM supplier WHERE s_nationkey <> 3 OR s_suppkey % 2 = 0")
def stored_structures(spark, sf_dir):
    """A unit's structures are loaded again with another count and replaced; the others stay."""
    store = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("u"), F.col("s_nationkey")).alias("unit"), F.col("s_acctbal").alias("v"))
    incoming = store.where("unit = 'u3' AND id % 2 = 0").withColumn("v", F.col("v") + 1)
    return R.stored_structures(store, incoming, "u3")


# Streams.


@query(
    """WITH RECURSIVE e AS (SELECT user_id AS client, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    w(client, i, ts, last, tokens, admitted) AS (SELECT client, i, ts, epoch_us(ts), CAST(2 AS DOUBLE), true FROM e WHERE i = 1
        UNION ALL SELECT e.client, e.i, e.ts, epoch_us(e.ts), least(3.0, w.tokens + (epoch_us(e.ts) - w.last) / 1e6 * 0.0005) - CASE WHEN least(3.0, w.tokens + (epoch_us(e.ts) - w.last) / 1e6 * 0.0005) >= 1 THEN 1 ELSE 0 END, least(3.0, w.tokens + (epoch_us(e.ts) - w.last) / 1e6 * 0.0005) >= 1
        FROM w JOIN e ON e.client = w.client AND e.i = w.i + 1)
    SELECT client, count(*) AS n, count(*) FILTER (admitted) AS admitted FROM w GROUP BY client"""
)
def admitted_requests(spark, sf_dir):
    """A stream over the table's files through the token bucket, to the end of its data."""
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    requests = source.select(F.col("user_id").cast("long").alias("client"), F.col("ts").cast("timestamp").alias("ts"))
    out = f"{shared_dir(spark)}/freshet/admitted-{uuid.uuid4().hex}"
    token_bucket(requests, 0.03, 3, "3650 days").writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/log").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/data").groupBy("client").agg(F.count("*").alias("n"), F.count_if("admitted").alias("admitted"))


@query(
    _with(
        _STAGE + """, rd AS (SELECT event_id, CAST(user_id % 100 AS BIGINT) AS reach, abs(value) * 3 AS q FROM events), lo3 AS (SELECT rd.event_id, rd.reach, rd.q, max(rate.rung) AS rung FROM rd JOIN rate ON rate.reach = rd.reach AND rate.discharge_cms <= rd.q GROUP BY ALL)""",
        "SELECT lo3.event_id, lo3.reach, round(CASE WHEN b.rung IS NULL THEN a.stage_m ELSE a.stage_m + (lo3.q - a.discharge_cms) / (b.discharge_cms - a.discharge_cms) * (b.stage_m - a.stage_m) END, 6) AS stage_m FROM lo3 JOIN rate a ON a.reach = lo3.reach AND a.rung = lo3.rung LEFT JOIN rate b ON b.reach = lo3.reach AND b.rung = lo3.rung + 1",
    )
)
def streamed_stages(spark, sf_dir):
    """A stream of discharges, each turned into the stage of its reach on curves that stand still."""
    curves = H.curve_arrays(_curves(spark, sf_dir)[2])
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    readings = source.select((F.col("user_id") % 100).cast("long").alias("reach"), "ts", (F.abs("value") * 3).alias("discharge_cms"), "event_id")
    out = f"{shared_dir(spark)}/freshet/stages-{uuid.uuid4().hex}"
    stage_stream(readings, curves).writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/log").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/data").select("event_id", "reach", r6("stage_m"))
