"""Registered queries of catalogue lookups, gauges' histories, drainage totals and report figures, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.operators import exposure as E
from freshet.operators import report as P
from freshet.operators import spatial as S
from freshet.plans.exposure_queries import _DEPTHS, _depths
from freshet.plans.queries import _ACC, _AT, _FIT, _PEAKS, _PHI, _STAGE, _hit, _placed, _stages, _wet, _with, query, r6
from freshet.plans.site_queries import _ELL, _ells
from freshet.plans.terrain import terrain
from freshet.sources.adapters import CELLSIZE
from freshet.sources.store import table

_CATALOGUE = "SELECT CASE o_orderkey % 3 WHEN 0 THEN 'Digital Elevation Model (DEM) 1 meter' WHEN 1 THEN 'National Elevation Dataset (NED) 1/3 arc-second' ELSE 'National Elevation Dataset (NED) 1 arc-second' END AS dataset, 'tile_' || lpad(CAST(o_orderkey AS {t}), 9, '0') AS path, (o_orderkey * 37 % 1000) * 1.0 AS xmin, (o_orderkey * 61 % 900) * 1.0 AS ymin, (o_orderkey * 37 % 1000) + 25.0 AS xmax, (o_orderkey * 61 % 900) + 25.0 AS ymax FROM {orders}"
_BOX = (200.0, 150.0, 500.0, 420.0)
_OVER = f"xmin < {_BOX[2]} AND xmax > {_BOX[0]} AND ymin < {_BOX[3]} AND ymax > {_BOX[1]}"


def _catalogue(spark, sf_dir):
    rows = spark.sql(_CATALOGUE.replace("{t}", "STRING"), orders=table(spark, sf_dir, "orders"))
    return rows.select("dataset", "path", *[F.col(c).cast("double").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


@query(f"WITH c AS ({_CATALOGUE.replace('{t}', 'VARCHAR').replace('{orders}', 'orders')}) SELECT path, CAST(xmin AS DOUBLE) AS xmin, CAST(ymin AS DOUBLE) AS ymin FROM c WHERE dataset = 'National Elevation Dataset (NED) 1/3 arc-second' AND {_OVER} ORDER BY path LIMIT 200")
def tiles_found(spark, sf_dir):
    return P.tiles_found(_catalogue(spark, sf_dir), 10, _BOX).select("path", "xmin", "ymin")


@query(f"WITH c AS ({_CATALOGUE.replace('{t}', 'VARCHAR').replace('{orders}', 'orders')}) SELECT count(*) AS tiles, CAST(round_even((max(xmax) - min(xmin)) / 10, 0) * round_even((max(ymax) - min(ymin)) / 10, 0) AS BIGINT) AS cells, round_even((max(xmax) - min(xmin)) / 10, 0) * round_even((max(ymax) - min(ymin)) / 10, 0) > 1000 AS too_many FROM c")
def planned_run(spark, sf_dir):
    """A run over the whole catalogue, planned and not read."""
    return P.planned(_catalogue(spark, sf_dir), 10.0, 1000)


@query(f"WITH ell AS ({_ELL.replace('{supplier}', 'supplier')}) SELECT lpad(CAST(unit AS VARCHAR), 8, '0') AS huc, CAST(8 AS INTEGER) AS level, round(3 * w * w, 6) AS area FROM ell WHERE unit = 7")
def unit_by_code(spark, sf_dir):
    units = _ells(spark, sf_dir).select(F.lpad(F.col("unit").cast("string"), 8, "0").alias("huc"), F.lit(8).alias("level"), F.round(S.area(F.col("ring")), 6).alias("area"))
    return P.unit_by_code(units, "00000007")


_RECORD = "SELECT o_custkey % 97 AS site, CAST(CAST(o_orderdate AS DATE) AS {t}) AS date, o_totalprice / 1000 AS cms FROM {orders}"
_MINE = f"peaks AS ({_RECORD.replace('{t}', 'VARCHAR').replace('{orders}', 'orders')})"


@query(
    f"""WITH {_FIT.replace(_PEAKS, _MINE)}, e AS (SELECT site, quantile_cont(cms, 0.97) AS discharge_cms FROM peaks GROUP BY site),
    c AS (SELECT e.site, discharge_cms, count(*) FILTER (cms > discharge_cms) + 1 AS rank, count(*) AS n FROM e JOIN peaks ON peaks.site = e.site WHERE cms > 0 GROUP BY e.site, discharge_cms),
    zz AS (SELECT c.*, (cbrt((log10(discharge_cms) - m) / sd * g / 2 + 1) - 1) / (g / 6) + g / 6 AS z FROM c JOIN fit ON fit.site = c.site),
    t AS (SELECT *, least(greatest(1 / greatest(1 - ({_PHI}), 1e-12), 1.0001), 1000) AS period FROM zz),
    b AS (SELECT peaks.site, cms, date, row_number() OVER (PARTITION BY peaks.site ORDER BY cms DESC, date) AS i FROM peaks JOIN e ON e.site = peaks.site WHERE cms > discharge_cms),
    f AS (SELECT site, string_agg((CAST(substr(date, 1, 4) AS INT) + CASE WHEN CAST(substr(date, 6, 2) AS INT) >= 10 THEN 1 ELSE 0 END) || ' ' || CAST(round(cms) AS BIGINT) || ' ' || date, '; ' ORDER BY i) AS floods FROM b WHERE i <= 5 GROUP BY site)
    SELECT t.site, rank, n AS n_years, rank = 1 AS exceeds_record, round((n + 1) / rank, 1) AS empirical_years, CASE WHEN n >= 10 AND period < 1000 THEN CAST(round(period) AS BIGINT) END AS fitted_years, n >= 10 AND period < 1000 AND period > 2 * n AS extrapolated, n >= 10 AND period >= 1000 AS fit_saturated, coalesce(floods, '') AS floods FROM t LEFT JOIN f ON f.site = t.site"""
)
def gauge_history(spark, sf_dir):
    peaks = spark.sql(_RECORD.replace("{t}", "STRING"), orders=table(spark, sf_dir, "orders"))
    events = peaks.groupBy("site").agg(F.percentile("cms", F.lit(0.97)).alias("discharge_cms"))
    found = P.gauge_history(peaks, events).drop("discharge_cms")
    listed = F.array_join(F.transform("larger_floods", lambda x: F.concat_ws(" ", x["water_year"].cast("string"), x["cms"].cast("string"), x["date"])), "; ")
    return found.select(*[c for c in found.columns if c != "larger_floods"], listed.alias("floods"))


@query(_with(_ACC, "SELECT count(*) AS cells, coalesce(sum(accumulation) FILTER (flowdir = -1), 0) AS by_outlets, CAST(coalesce(sum(accumulation) FILTER (flowdir = -2), 0) AS DOUBLE) AS in_flats FROM routed JOIN acc ON acc.cell = routed.cell"))
def drainage_totals(spark, sf_dir):
    return P.drainage_totals(terrain(spark, sf_dir).routed)


@query(
    _with(
        _DEPTHS + _AT[len(_STAGE) :] + ", " + _hit("placed")
        + f""", one AS (SELECT count(*) FILTER (depth_m > 0) * {CELLSIZE**2} / 1e6 AS flooded_km2, max(depth_m) AS max_depth_m FROM wet), bl AS (SELECT count(*) AS buildings, count(*) FILTER (depth_m > found_ht_m) AS inundated FROM bd),
    dm AS (SELECT building_class, sum(fraction * exposed) AS damage FROM hit WHERE multiplier = 1.0 GROUP BY building_class), tp AS (SELECT string_agg(building_class, ',' ORDER BY damage DESC, building_class) AS top_classes FROM (SELECT * FROM dm ORDER BY damage DESC, building_class LIMIT 8)),
    rm AS (SELECT count(*) AS removed FROM dep LEFT JOIN con ON con.cell = dep.cell WHERE dep.depth_m >= 0.05 AND con.cell IS NULL)""",
        "SELECT '00' AS unit, 400.0::DOUBLE AS discharge_cms, 10.0::DOUBLE AS resolution_m, round(flooded_km2, 6) AS flooded_km2, round(max_depth_m, 6) AS max_depth_m, buildings, inundated, (SELECT round(sum(damage), 2) FROM dm) AS damage, top_classes, removed FROM one, bl, tp, rm",
    )
)
def assessment_payload(spark, sf_dir):
    t, stages, wet = _wet(spark, sf_dir)
    _, depths = _depths(spark, sf_dir)
    at = stages.where("multiplier = 1.0")
    rows = _placed(spark, sf_dir, t).where("hand IS NOT NULL").join(at, "reach")
    damaged = E.estimate(rows.withColumn("margin_m", E.floor_margin(F.col("stage_m"), F.col("hand"), F.col("found_ht_m"))))
    classes = damaged.groupBy("building_class").agg(F.sum("damage").alias("damage"))
    totals = classes.agg(F.sum("damage").alias("damage"))
    found = P.payload("00", 400.0, CELLSIZE, wet, depths, totals, classes, P.removed_cells(t.hand, at, wet))
    return found.select("unit", "discharge_cms", "resolution_m", r6("flooded_km2"), r6("max_depth_m"), "buildings", "inundated", F.round("damage", 2).alias("damage"), F.array_join("top_classes", ",").alias("top_classes"), "removed")
