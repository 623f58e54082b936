"""Registered queries of curve tables, contents, draws, exposure, the display layers and report rows, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.operators import curves as C
from freshet.operators import display as D
from freshet.operators import exposure as E
from freshet.operators import hydraulics as H
from freshet.plans.queries import _AT, _STAGE, _WET, _curves, _hit, _placed, _stages, _wet, _with, query, r6
from freshet.sources.adapters import CELLSIZE, COLS, sql_text, view
from freshet.sources.store import table, written

# A curve library as published files hold it: one JSON text, made from the parts' types. Depths in feet, figures in percent.

_LIB = "SELECT upper(substr(p_type, 1, 3)) AS k, count(*) % 7 AS a, 1 + sum(p_size) % 5 AS b FROM {part} GROUP BY upper(substr(p_type, 1, 3))"
_LIB_SQL = f"""lib AS ({_LIB.replace("{part}", "part")}),
raw AS (SELECT k, a, 'structure' AS component, i, i * 0.3048 AS d, greatest(CASE WHEN i < 0 THEN 0 ELSE least(b * 4 + i * (a + 1), 100) - (CASE WHEN i = 8 THEN a * 9 ELSE 0 END) END, 0) / 100 AS y, abs(i) / 4 / 100 AS s FROM lib, (SELECT unnest([-2, -1, 0, 1, 2, 4, 8, 12]) AS i)
    UNION ALL SELECT k, a, 'contents', i, i * 0.3048, CASE i WHEN 0 THEN 0 WHEN 2 THEN a + 10 ELSE a * 3 + 20 END / 100, i / 50 FROM lib, (SELECT unnest([0, 2, 4]) AS i) WHERE a % 2 = 0),
occ AS MATERIALIZED (SELECT k, component, i, d, max(y) OVER (PARTITION BY k, component ORDER BY i) AS f, s FROM raw)"""


def _library(spark, sf_dir):
    """The curves of one JSON text in the layout of published libraries: structure for every type, contents for every second one."""
    feet = [-2, -1, 0, 1, 2, 4, 8, 12]
    points = F.array(*[F.lit(float(i)) for i in feet])
    mean = lambda i: F.greatest(F.when(i < 0, 0.0).otherwise(F.least(F.col("b") * 4 + i * (F.col("a") + 1), F.lit(100.0))) - F.when(i == 8, F.col("a") * 9).otherwise(0), F.lit(0.0))
    spread = F.transform(points, lambda i: F.struct(F.lit("NormalDistribution").alias("type"), F.struct(mean(i).alias("mean"), (F.abs(i) / 4).alias("standarddeviation")).alias("parameters")))
    fixed = F.array(*[F.struct(F.lit("NormalDistribution").alias("type"), F.struct(v.cast("double").alias("mean"), F.lit(2.0 * i).alias("standarddeviation")).alias("parameters")) for i, v in ((0, F.lit(0)), (2, F.col("a") + 10), (4, F.col("a") * 3 + 20))])
    function = lambda name, xs, ys: F.struct(F.struct(F.struct(F.lit("s").alias("source"), F.struct(xs.alias("xvalues"), ys.alias("ydistributions")).alias("damagefunction")).alias(name)).alias("damagefunctions"))
    inside = F.when(F.col("a") % 2 == 0, function("default", F.array(*[F.lit(float(i)) for i in (0, 2, 4)]), fixed))
    entry = F.struct(F.struct(function("depth", points, spread).alias("structure"), inside.alias("contents")).alias("componentdamagefunctions"))
    lib = spark.sql(_LIB, part=table(spark, sf_dir, "part"))
    return C.occupancy_curves(lib.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("k", entry))).alias("occupancytypes"))).alias("json")))


def _points(curves):
    return curves.select("class", "component", F.posexplode(F.arrays_zip("depths", "fractions", "sigmas")).alias("i", "p")).select("class", "component", "i", r6("p.depths", "depth_m"), r6("p.fractions", "fraction"), r6("p.sigmas", "sigma"))


@query(f"WITH {_LIB_SQL} SELECT k AS class, component, CAST(row_number() OVER (PARTITION BY k, component ORDER BY i) - 1 AS INTEGER) AS i, round(CAST(d AS DOUBLE), 6) AS depth_m, round(CAST(f AS DOUBLE), 6) AS fraction, round(CAST(s AS DOUBLE), 6) AS sigma FROM occ")
def occupancy_curves(spark, sf_dir):
    return _points(C.checked(_library(spark, sf_dir)))


def _families(spark, sf_dir):
    """The curves of one JSON text that maps a family to classes to points."""
    lib = spark.sql(_LIB, part=table(spark, sf_dir, "part"))
    points = F.struct(F.array(*[F.lit(x) for x in (0.0, 0.5, 2.5)]).alias("depths_m"), F.array(F.lit(0.0), F.col("b") / 20, F.least(F.col("a") / 4, F.lit(1.0))).alias("fractions"))
    entry = F.struct(F.lit(True).alias("verified"), F.map_from_entries(F.collect_list(F.struct("k", points))).alias("classes"))
    return C.family_curves(lib.agg(F.to_json(F.create_map(F.lit("OWN"), entry)).alias("json")))


@query(f"WITH {_LIB_SQL} SELECT k AS class, 'structure' AS component, i::INTEGER AS i, CAST([0, 0.5, 2.5][i + 1] AS DOUBLE) AS depth_m, round(CAST([0, b / 20, least(a / 4, 1)][i + 1] AS DOUBLE), 6) AS fraction, 0.0::DOUBLE AS sigma FROM lib, (SELECT unnest(range(3)) AS i)")
def family_curves(spark, sf_dir):
    return _points(_families(spark, sf_dir))


@query(f"WITH {_LIB_SQL} SELECT 'OWN' AS family, k AS class, 'structure' AS component, 'fractions decrease' AS problem FROM lib WHERE least(a / 4, 1) < b / 20 UNION ALL SELECT 'OWN', 'residential', 'structure', 'no default class'")
def curve_problems(spark, sf_dir):
    return C.problems(_families(spark, sf_dir), "residential")


@query(f"WITH {_LIB_SQL} SELECT DISTINCT 'USACE' AS family, round(CAST(d AS DOUBLE), 6) AS depth_m FROM occ WHERE component = 'structure' AND d <= 3.5 UNION SELECT 'USACE', 3.5")
def curve_breakpoints(spark, sf_dir):
    return C.breakpoints(_library(spark, sf_dir), 3.5).select("family", r6("depth_m"))


# Damage with contents and a published spread.

_DEFAULT = "STA"
_OWN = "CASE building_class WHEN 'residential' THEN 'STA' WHEN 'commercial' THEN 'PRO' WHEN 'industrial' THEN 'LAR' WHEN 'shed' THEN 'ECO' ELSE building_class END"
_USED = f"""ub AS (SELECT mar.*, {_OWN} AS own FROM mar),
code AS (SELECT ub.*, CASE WHEN own IN (SELECT k FROM lib) THEN own ELSE '{_DEFAULT}' END AS ks, CASE WHEN own IN (SELECT k FROM occ WHERE component = 'contents') THEN own ELSE '{_DEFAULT}' END AS kc FROM ub)"""


_REACH = "least(greatest(ceil(greatest(margin_m, 0) / 3), 1), greatest(storeys, 1)) / greatest(storeys, 1)"
_MAR = f"mar AS MATERIALIZED (SELECT *, CASE WHEN stage_m - hand > 0 THEN stage_m - hand - found_ht_m ELSE -1e6 END AS margin_m FROM placed WHERE multiplier = 1.0)"
_PRICED = f"""{_AT}, {_LIB_SQL}, {_MAR}, {_USED},
bend AS MATERIALIZED (SELECT component, k, d AS d0, coalesce(lead(d) OVER w, 1e9) AS d1, f AS f0, coalesce(lead(f) OVER w, f) AS f1, s AS s0, coalesce(lead(s) OVER w, s) AS s1, min(d) OVER (PARTITION BY component, k) AS first FROM occ WINDOW w AS (PARTITION BY component, k ORDER BY i)),
cv AS (SELECT code.*, (SELECT min(first) FROM bend WHERE component = 'structure' AND k = ks) AS ls, (SELECT min(first) FROM bend WHERE component = 'contents' AND k = kc) AS lc, {_REACH} AS reach_share FROM code),
priced AS MATERIALIZED (SELECT building_id, value * 100 AS exposed,
    CASE WHEN margin_m <= -1000 THEN 0 ELSE least(greatest(a.f0 + (greatest(least(margin_m, 6.0), ls) - a.d0) / (a.d1 - a.d0) * (a.f1 - a.f0) + 0.5 * (a.s0 + (greatest(least(margin_m, 6.0), ls) - a.d0) / (a.d1 - a.d0) * (a.s1 - a.s0)), 0), 1) END * reach_share * value * 100 AS structure,
    CASE WHEN margin_m <= -1000 THEN 0 ELSE least(greatest(b.f0 + (greatest(least(margin_m, 6.0), lc) - b.d0) / (b.d1 - b.d0) * (b.f1 - b.f0) + 0.5 * (b.s0 + (greatest(least(margin_m, 6.0), lc) - b.d0) / (b.d1 - b.d0) * (b.s1 - b.s0)), 0), 1) END * reach_share * value * 40 AS contents
    FROM cv JOIN bend a ON a.component = 'structure' AND a.k = ks AND a.d0 <= greatest(least(margin_m, 6.0), ls) AND a.d1 > greatest(least(margin_m, 6.0), ls)
    JOIN bend b ON b.component = 'contents' AND b.k = kc AND b.d0 <= greatest(least(margin_m, 6.0), lc) AND b.d1 > greatest(least(margin_m, 6.0), lc))"""


def _valued(spark, sf_dir):
    """Buildings in the flood with values of structure and contents, classes as the library names them."""
    t, stages = _stages(spark, sf_dir)
    rows = _placed(spark, sf_dir, t).where("hand IS NOT NULL").join(stages.where("multiplier = 1.0"), "reach")
    rows = rows.withColumn("margin_m", E.floor_margin(F.col("stage_m"), F.col("hand"), F.col("found_ht_m")))
    return rows.withColumns({"building_class": F.expr(_OWN), "structure_value": F.col("value") * 100, "contents_value": F.col("value") * 40})


@query(_with(_PRICED, "SELECT building_id, round(structure, 4) AS structure, round(contents, 4) AS contents FROM priced"))
def contents_damage(spark, sf_dir):
    rows = C.priced(_valued(spark, sf_dir), _library(spark, sf_dir), "USACE", _DEFAULT, contents=True, z=0.5)
    return rows.select("building_id", F.round("structure", 4).alias("structure"), F.round("contents", 4).alias("contents"))


@query(_with(_PRICED, "SELECT round(sum(structure + contents), 2) AS damage, round(sum(contents), 2) AS contents, round(sum(exposed), 2) AS exposed, count(*) AS n, count(*) FILTER (structure + contents > 0) AS n_damaged, round(sum(structure + contents) / sum(exposed), 6) AS loss_ratio FROM priced"))
def damage_totals(spark, sf_dir):
    rows = C.priced(_valued(spark, sf_dir), _library(spark, sf_dir), "USACE", _DEFAULT, contents=True, z=0.5)
    return C.totals(rows).select(F.round("damage", 2).alias("damage"), F.round("contents", 2).alias("contents"), F.round("exposed", 2).alias("exposed"), "n", "n_damaged", r6("loss_ratio"))


@query(_with(_AT + ", " + _hit("placed"), "SELECT building_class, round(sum(fraction * exposed), 2) AS damage FROM hit WHERE multiplier = 1.0 GROUP BY building_class ORDER BY sum(fraction * exposed) DESC, building_class LIMIT 8"))
def top_classes(spark, sf_dir):
    t, stages = _stages(spark, sf_dir)
    rows = _placed(spark, sf_dir, t).where("hand IS NOT NULL").join(stages.where("multiplier = 1.0"), "reach")
    return C.top_classes(E.estimate(rows.withColumn("margin_m", E.floor_margin(F.col("stage_m"), F.col("hand"), F.col("found_ht_m"))))).select("building_class", F.round("damage", 2).alias("damage"))


_LADDER = _PRICED.replace("FROM placed WHERE multiplier = 1.0", "FROM placed").replace("priced AS MATERIALIZED (SELECT building_id,", "priced AS MATERIALIZED (SELECT building_id, multiplier, hand, margin_m,").replace(" + 0.5 * (a.s0", " + 0.0 * (a.s0").replace(" + 0.5 * (b.s0", " + 0.0 * (b.s0")


@query(_with(_LADDER, "SELECT multiplier, round(sum(structure + contents), 2) AS damage, round(sum(structure), 2) AS structure, round(sum(contents), 2) AS contents, count(*) FILTER (margin_m > 0) AS wet, round(sum(CASE WHEN hand <= 0 THEN structure + contents ELSE 0 END), 2) AS in_channel FROM priced GROUP BY multiplier"))
def priced_ladder(spark, sf_dir):
    t, stages = _stages(spark, sf_dir)
    rows = _placed(spark, sf_dir, t).withColumns({"building_class": F.expr(_OWN), "structure_value": F.col("value") * 100, "contents_value": F.col("value") * 40})
    two = lambda c: F.round(c, 2).alias(c)
    return C.priced_ladder(rows, stages, _library(spark, sf_dir), "USACE", _DEFAULT, contents=True).select("multiplier", two("damage"), two("structure"), two("contents"), "wet", two("in_channel"))


_REFERENCES = [0.5, 1.0, 2.0, 3.0]


@query(_with(_AT + ", " + _hit("placed"), "SELECT building_id, " + ", ".join(f"round(sum(CASE WHEN multiplier = {m} THEN fraction * exposed ELSE 0 END), 4) AS d{i}" for i, m in enumerate(_REFERENCES)) + " FROM hit GROUP BY building_id"))
def reference_damage(spark, sf_dir):
    t, stages = _stages(spark, sf_dir)
    return E.reference_damage(_placed(spark, sf_dir, t), stages, _REFERENCES).select("building_id", *[F.round(f"d{i}", 4).alias(f"d{i}") for i in range(4)])


@query(_with(_AT + ", " + _hit("placed") + ", l AS (SELECT multiplier, sum(fraction * exposed) AS damage, sum(CASE WHEN hand <= 0 THEN fraction * exposed ELSE 0 END) AS c FROM hit GROUP BY multiplier)", "SELECT multiplier, round(coalesce(CASE WHEN damage <> 0 THEN c / damage END, 0), 6) AS share, CASE WHEN coalesce(CASE WHEN damage <> 0 THEN c / damage END, 0) <= 0.3 THEN round(damage, 2) END AS damage FROM l"))
def withheld_damage(spark, sf_dir):
    t, stages = _stages(spark, sf_dir)
    return E.withheld(E.damage_ladder(_placed(spark, sf_dir, t), stages), 0.3).select("multiplier", r6("share"), F.round("damage", 2).alias("damage"))


# Draws: the same mixed integers in SQL.

_DRAWS, _SEED = 1000, 20220228
_WEIGHTS = {"HAZUS": 0.6, "JRC_GLOBAL": 0.4}


def _mixed_cte(name: str, source: str, keep: str, value: str, out: str) -> str:
    """CTE out: the columns keep of source, and x, the mixed value; each round is a common table expression of its own."""
    steps, last = [], source
    x = f"(({value}) % {1 << 30})"
    for k in range(3):
        steps.append(f"{name}{k}a AS (SELECT {keep}, ({x} * (2 * {x} + 1) + {2654435 * (k + 1)}) % {1 << 30} AS x FROM {last}), {name}{k} AS (SELECT {keep}, (x >> 15) + (x % 32768) * 32768 AS x FROM {name}{k}a)")
        last, x = f"{name}{k}", "x"
    return ", ".join(steps) + f", {out} AS MATERIALIZED (SELECT {keep}, x FROM {last})"


def _draw_sql(draws: int) -> str:
    """CTEs dr (draw, fam, stage, cost) and dem (building_id, draw, e) of standard normal figures."""
    first = _mixed_cte("fk", "kinds", "kind", f"7919 * kind + {_SEED}", "fkk")
    keys = _mixed_cte("ud", "(SELECT kind, draw, fkk.x AS x0 FROM fkk, draws)", "kind, draw", "x0 + draw * 104729", "udd")
    building = _mixed_cte("fb", "(SELECT building_id, kind FROM bk, (SELECT unnest([8, 9]) AS kind))", "building_id, kind", f"building_id + 7919 * kind + {_SEED}", "fbb")
    noise = _mixed_cte("ub", "(SELECT building_id, kind, draw, fbb.x AS x0 FROM fbb, draws)", "building_id, kind, draw", "x0 + draw * 104729", "ubb")
    return f"""kinds AS (SELECT unnest(range(0, 8)) AS kind), draws AS (SELECT unnest(range(0, {draws})) AS draw), {first}, {keys},
u AS (SELECT kind, draw, (x + 0.5) / {1 << 30} AS u FROM udd),
nn AS (SELECT a.draw, CAST(a.kind // 2 AS INT) AS k, sqrt(-2 * ln(a.u)) * cos(2 * pi() * b.u) AS z FROM u a JOIN u b ON b.draw = a.draw AND b.kind = a.kind + 1 WHERE a.kind IN (2, 4)),
dr AS MATERIALIZED (SELECT f.draw, CASE WHEN f.u < 0.6 THEN 'HAZUS' ELSE 'JRC_GLOBAL' END AS fam, s.z * 0.15 AS stage, exp(c.z * 0.25) AS cost FROM u f JOIN nn s ON s.draw = f.draw AND s.k = 1 JOIN nn c ON c.draw = f.draw AND c.k = 2 WHERE f.kind = 0),
{building}, {noise},
dmr AS MATERIALIZED (SELECT a.building_id, a.draw, sqrt(-2 * ln((a.x + 0.5) / {1 << 30})) * cos(2 * pi() * ((b.x + 0.5) / {1 << 30})) * 0.15 AS e FROM ubb a JOIN ubb b ON b.building_id = a.building_id AND b.draw = a.draw AND b.kind = 9 WHERE a.kind = 8)"""


_MC = (
    _AT
    + ", "
    + _hit("placed")
    + f""", bk AS MATERIALIZED (SELECT building_id, k, storeys, exposed, margin_m FROM hit WHERE multiplier = 1.0), {_draw_sql(_DRAWS)},
pd AS (SELECT bk.*, dr.draw, dr.fam, dr.cost, margin_m + dr.stage + dmr.e AS depth FROM bk JOIN dmr ON dmr.building_id = bk.building_id JOIN dr ON dr.draw = dmr.draw),
seg2 AS (SELECT family, k, d AS d0, coalesce(lead(d) OVER w, 1e9) AS d1, v AS v0, coalesce(lead(v) OVER w, v) AS v1 FROM crv WINDOW w AS (PARTITION BY family, k ORDER BY i)),
sim AS MATERIALIZED (SELECT pd.draw, pd.building_id, CASE WHEN pd.margin_m > -1000 AND pd.depth > 0 THEN 1 ELSE 0 END AS wet,
    CASE WHEN pd.margin_m <= -1000 THEN 0 ELSE (s.v0 + (least(greatest(pd.depth, 0), 6.0) - s.d0) / (s.d1 - s.d0) * (s.v1 - s.v0)) * least(greatest(ceil(greatest(pd.depth, 0) / 3), 1), greatest(pd.storeys, 1)) / greatest(pd.storeys, 1) * pd.exposed * pd.cost END AS dmg
    FROM pd JOIN seg2 s ON s.family = pd.fam AND s.k = pd.k AND s.d0 <= least(greatest(pd.depth, 0), 6.0) AND s.d1 > least(greatest(pd.depth, 0), 6.0)),
tot AS MATERIALIZED (SELECT draw, sum(dmg) AS total, sum(wet) AS wet FROM sim GROUP BY draw)"""
)


def _in_flood(spark, sf_dir):
    t, stages = _stages(spark, sf_dir)
    rows = _placed(spark, sf_dir, t).where("hand IS NOT NULL").join(stages.where("multiplier = 1.0"), "reach")
    return rows.withColumn("margin_m", E.floor_margin(F.col("stage_m"), F.col("hand"), F.col("found_ht_m")))


def _figures(spark, sf_dir):
    return C.monte_carlo(_in_flood(spark, sf_dir), C.bundled(spark), _WEIGHTS, _DRAWS, _SEED)


@query(_with(_MC, "SELECT CAST(draw AS INTEGER) AS draw, round(total, 0) AS total, CAST(wet AS BIGINT) AS wet FROM tot"))
def damage_draws(spark, sf_dir):
    return C.draw_totals(_figures(spark, sf_dir)).select("draw", F.round("total", 0).alias("total"), "wet")


@query(_with(_MC, "SELECT round(quantile_cont(total, 0.05), 0) AS low, round(quantile_cont(total, 0.5), 0) AS median, round(quantile_cont(total, 0.95), 0) AS high, CAST(floor(quantile_cont(wet, 0.05)) AS INTEGER) AS wet_low, CAST(floor(quantile_cont(wet, 0.95)) AS INTEGER) AS wet_high FROM tot"))
def damage_interval(spark, sf_dir):
    return E.interval(C.draw_totals(_figures(spark, sf_dir))).select(*[F.round(c, 0).alias(c) for c in ("low", "median", "high")], "wet_low", "wet_high")


@query(_with(_MC, "SELECT building_id, round(avg(dmg), 3) AS expected FROM sim GROUP BY building_id"))
def expected_damage(spark, sf_dir):
    return C.expected_damage(_figures(spark, sf_dir)).select("building_id", F.round("expected", 3).alias("expected"))


_BUDGET = (
    _AT
    + ", "
    + _hit("placed")
    + f""", bk AS MATERIALIZED (SELECT building_id, k, storeys, exposed, margin_m, fraction FROM hit WHERE multiplier = 1.0), {_draw_sql(_DRAWS)},
terms(term, mix, s, d, c) AS (VALUES ('all', 1, 1, 1, 1), ('stage', 0, 1, 0, 0), ('dem', 0, 0, 1, 0), ('cost', 0, 0, 0, 1), ('curve', 1, 0, 0, 0)),
pd AS (SELECT bk.*, term, dr.draw, CASE mix WHEN 1 THEN dr.fam ELSE 'HAZUS' END AS fam, CASE c WHEN 1 THEN dr.cost ELSE 1 END AS cost, margin_m + s * dr.stage + d * dmr.e AS depth FROM bk JOIN dmr ON dmr.building_id = bk.building_id JOIN dr ON dr.draw = dmr.draw CROSS JOIN terms WHERE margin_m > -1000),
seg2 AS (SELECT family, k, d AS d0, coalesce(lead(d) OVER w, 1e9) AS d1, v AS v0, coalesce(lead(v) OVER w, v) AS v1 FROM crv WINDOW w AS (PARTITION BY family, k ORDER BY i)),
tot AS MATERIALIZED (SELECT term, draw, sum((s.v0 + (least(greatest(pd.depth, 0), 6.0) - s.d0) / (s.d1 - s.d0) * (s.v1 - s.v0)) * least(greatest(ceil(greatest(pd.depth, 0) / 3), 1), greatest(pd.storeys, 1)) / greatest(pd.storeys, 1) * pd.exposed * pd.cost) AS total
    FROM pd JOIN seg2 s ON s.family = pd.fam AND s.k = pd.k AND s.d0 <= least(greatest(pd.depth, 0), 6.0) AND s.d1 > least(greatest(pd.depth, 0), 6.0) GROUP BY term, draw)"""
)


@query(_with(_BUDGET, "SELECT term, round(100 * (quantile_cont(total, 0.95) - quantile_cont(total, 0.05)) / (SELECT sum(fraction * exposed) FROM bk), 4) AS width_pct FROM tot GROUP BY term"))
def uncertainty_budget(spark, sf_dir):
    rows = written(_in_flood(spark, sf_dir).select("building_id", "margin_m", "building_class", "storeys", "floor_area_m2"), "flooded")
    point = E.estimate(rows).agg(F.sum("damage").alias("d")).first()["d"] or 1.0
    return C.uncertainty_budget(rows, C.bundled(spark), _WEIGHTS, "HAZUS", point, _DRAWS, seed=_SEED).select("term", F.round("width_pct", 4).alias("width_pct"))


# Exposure of boxes, with those off the raster.

_BIG = "SELECT p_partkey AS building_id, CAST((p_partkey * 7) % 1400 - 40 AS DOUBLE) AS xmin, CAST((p_partkey * 7) % 1400 - 35 + p_size % 13 AS DOUBLE) AS xmax, -CAST((p_partkey * 5) % 1300 + 6 + p_size % 11 AS DOUBLE) AS ymin, -CAST((p_partkey * 5) % 1300 AS DOUBLE) AS ymax, 0.1 * (p_size % 7) AS found_ht_m FROM {part}"
_DEPTHS = (
    _WET
    + f""", box AS ({_BIG.replace("{part}", "part")}), size AS (SELECT max(r) + 1 AS rows FROM dem),
kept AS (SELECT *, xmax < 0 OR xmin >= {COLS * CELLSIZE} OR ymin > 0 OR ymax <= -(SELECT rows FROM size) * {CELLSIZE} AS outside FROM box WHERE (xmax - xmin) * (ymax - ymin) >= 10),
grid AS (SELECT building_id, r, unnest(range(greatest(0, CAST(floor(xmin / 10) AS INT)), least({COLS} - 1, CAST(floor(xmax / 10) AS INT)) + 1)) AS c FROM (SELECT building_id, xmin, xmax, unnest(range(greatest(0, CAST(-ceil(ymax / 10) AS INT)), least((SELECT rows FROM size) - 1, CAST(-ceil(ymin / 10) AS INT)) + 1)) AS r FROM kept)),
touch AS (SELECT building_id, coalesce(wet.depth_m, 0) AS depth_m, hd.hand, hd.reach FROM grid LEFT JOIN dem ON dem.r = grid.r AND dem.c = grid.c LEFT JOIN wet ON wet.cell = dem.cell LEFT JOIN hd ON hd.cell = dem.cell),
md AS (SELECT building_id, reach FROM touch WHERE reach IS NOT NULL GROUP BY building_id, reach QUALIFY row_number() OVER (PARTITION BY building_id ORDER BY count(*) DESC, reach) = 1),
agg AS (SELECT building_id, quantile_cont(depth_m, 0.9) AS d, quantile_cont(hand, 0.1) AS h FROM touch GROUP BY building_id),
bd AS MATERIALIZED (SELECT kept.building_id, CASE WHEN outside THEN 0.0 ELSE coalesce(d, 0.0) END AS depth_m, found_ht_m, CASE WHEN outside OR h IS NULL THEN CAST('inf' AS DOUBLE) ELSE h END AS hand_m, CASE WHEN outside THEN -1 ELSE coalesce(md.reach, -1) END AS reach_id, outside AS off_raster
    FROM kept LEFT JOIN agg ON agg.building_id = kept.building_id LEFT JOIN md ON md.building_id = kept.building_id)"""
)


def _depths(spark, sf_dir):
    t, _, wet = _wet(spark, sf_dir)
    cells = t.raw.select("cell", "r", "c").join(wet.select("cell", "depth_m"), "cell").join(t.hand.select("cell", "hand", "reach"), "cell").select("r", "c", "depth_m", "hand", "reach")
    boxes = spark.sql(_BIG, part=table(spark, sf_dir, "part")).withColumn("found_ht_m", F.col("found_ht_m").cast("double"))
    rows = t.raw.agg(F.max("r").alias("r")).first()["r"] + 1
    return boxes, E.building_depths(boxes, cells, CELLSIZE, rows, COLS, statistic="p90")


@query(_with(_DEPTHS, "SELECT building_id, round(depth_m, 6) AS depth_m, round(greatest(depth_m - found_ht_m, 0), 6) AS floor_depth_m, CASE WHEN depth_m > 0 THEN round(depth_m - found_ht_m, 6) ELSE CAST('-inf' AS DOUBLE) END AS floor_margin_m, round(hand_m, 6) AS hand_m, reach_id, off_raster FROM bd"))
def building_depths(spark, sf_dir):
    return _depths(spark, sf_dir)[1].select("building_id", r6("depth_m"), r6("floor_depth_m"), r6("floor_margin_m"), r6("hand_m"), "reach_id", "off_raster")


@query(_with(_DEPTHS, "SELECT count(*) AS n, count(*) FILTER (depth_m > found_ht_m) AS n_inundated, count(*) FILTER (depth_m > 0) AS n_wet_ground, count(*) FILTER (off_raster) AS n_off_raster, (SELECT count(*) FROM box) - count(*) AS n_too_small FROM bd"))
def exposure_counts(spark, sf_dir):
    boxes, depths = _depths(spark, sf_dir)
    return E.exposure_counts(depths, boxes.count())


# Display.


@query(_with(_STAGE, f"SELECT reach, list(CAST(floor(least(greatest(stage_m * 10, 0), 255)) AS INTEGER) ORDER BY multiplier) AS lut FROM stage WHERE multiplier IN (0, 1, 2, 3) GROUP BY reach"))
def stage_bytes(spark, sf_dir):
    return D.stage_bytes(_stages(spark, sf_dir)[1], [0.0, 1.0, 2.0, 3.0])


@query(
    _with(
        _STAGE + ", b AS (SELECT reach, multiplier, floor(least(greatest(stage_m * 10, 0), 255)) AS s FROM stage), rd AS (SELECT a.reach, a.s + (c.s - a.s) * 0.4 AS s FROM b a JOIN b c ON c.reach = a.reach AND c.multiplier = 2 WHERE a.multiplier = 1), px AS (SELECT hd.cell, CASE WHEN hand IS NULL THEN 255 ELSE floor(least(greatest(hand * 10, 0), 254)) END AS h, rd.s FROM hd LEFT JOIN rd ON rd.reach = hd.reach)",
        "SELECT cell, round(CASE WHEN h <> 255 AND s - h > 0.5 THEN (s - h) / 10 END, 6) AS depth_m FROM px",
    )
)
def slider_depths(spark, sf_dir):
    t, stages = _stages(spark, sf_dir)
    rungs = [0.0, 1.0, 2.0, 3.0]
    return D.pixel_depths(t.hand, D.stage_read(D.stage_bytes(stages, rungs), rungs, 1.4)).select("cell", r6("depth_m"))


_CHANNELS = _AT + ", " + _hit("placed") + f""", pt AS (SELECT floor(cell // {COLS} / 4) AS r, floor(cell % {COLS} / 4) AS c, multiplier, fraction * exposed AS dmg FROM hit),
sm AS (SELECT r, c, count(*) FILTER (multiplier = 0.5) AS n, """ + ", ".join(f"sum(CASE WHEN multiplier = {m} THEN dmg ELSE 0 END) AS s{i}" for i, m in enumerate(_REFERENCES)) + """ FROM pt GROUP BY r, c),
ch AS MATERIALIZED (SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, n, """ + ", ".join(f"CASE WHEN s{i} >= 1000 THEN CAST(round_even(1 + (log10(least(s{i}, 1e8)) - 3) / 5 * 254, 0) AS INTEGER) ELSE 0 END AS channel{i}" for i in range(4)) + " FROM sm)"


def _channels(spark, sf_dir):
    t, stages = _stages(spark, sf_dir)
    rows = _placed(spark, sf_dir, t).where("hand IS NOT NULL").join(stages, "reach").withColumn("margin_m", E.floor_margin(F.col("stage_m"), F.col("hand"), F.col("found_ht_m")))
    points = E.estimate(rows).select(((F.col("cell") % COLS) + 0.5).alias("x"), (-F.floor(F.col("cell") / COLS) - 0.5).alias("y"), "multiplier", "damage")
    return D.damage_channels(points, _REFERENCES, 1.0, 4)


@query(_with(_CHANNELS, "SELECT r, c, n, channel0, channel1, channel2, channel3 FROM ch"))
def damage_channels(spark, sf_dir):
    return _channels(spark, sf_dir)


@query(_with(_CHANNELS, "SELECT r, c, CASE WHEN channel1 + (channel2 - channel1) * 0.7 >= 1 THEN round(channel1 + (channel2 - channel1) * 0.7, 6) END AS shade FROM ch"))
def damage_blend(spark, sf_dir):
    return D.blended(_channels(spark, sf_dir), _REFERENCES, 1.7).select("r", "c", r6("shade"))


_LEVEL = "SELECT {f} AS level, CAST(floor(r / {f}) AS INTEGER) AS r, CAST(floor(c / {f}) AS INTEGER) AS c, round(avg(z), 6) AS v FROM dem GROUP BY ALL"


@query(f"WITH dem AS ({sql_text('dem')}) " + " UNION ALL ".join(_LEVEL.format(f=f) for f in (2, 4, 8, 16)))
def overviews(spark, sf_dir):
    return D.overviews(view(spark, sf_dir, "dem")).select("level", "r", "c", r6("v"))


@query(
    _with(
        _WET + ", b AS (SELECT floor(dem.r / 4) AS r, floor(dem.c / 4) AS c, avg(z) AS z, avg(depth_m) AS depth_m, max(CAST(connected AS INT)) AS connected FROM dem JOIN wet ON wet.cell = dem.cell GROUP BY 1, 2)",
        "SELECT 'z' AS layer, round(min(z), 6) AS low, round(max(z), 6) AS high, count(z) AS n FROM b UNION ALL SELECT 'depth_m', round(min(depth_m), 6), round(max(depth_m), 6), count(depth_m) FROM b UNION ALL SELECT 'connected', CAST(min(connected) AS DOUBLE), CAST(max(connected) AS DOUBLE), count(connected) FROM b",
    )
)
def layer_ranges(spark, sf_dir):
    t, _, wet = _wet(spark, sf_dir)
    cells = t.raw.select("cell", "r", "c", "z").join(wet.select("cell", "depth_m", "connected"), "cell")
    return D.layer_ranges(cells, COLS, 40, ["z", "depth_m"], ["connected"]).select("layer", r6("low"), r6("high"), "n")


@query(_with(_WET, "SELECT cell, round(coalesce(sqrt(least(greatest(depth_m / 8, 0), 1)), 0), 6) AS ramp FROM wet"))
def depth_ramp(spark, sf_dir):
    return _wet(spark, sf_dir)[2].select("cell", F.round(D.depth_ramp(F.col("depth_m")), 6).alias("ramp"))


_TARGETS = "SELECT CAST(p_partkey AS BIGINT) AS cell, (p_partkey * 13 % 997) / 8.0 AS row, (p_partkey * 29 % 1051) / 8.0 AS col FROM {part}"


def _warp(spark, sf_dir, how):
    cells = view(spark, sf_dir, "dem").select("r", "c", F.col("z").alias("v"))
    targets = spark.sql(_TARGETS, part=table(spark, sf_dir, "part")).select("cell", F.col("row").cast("double"), F.col("col").cast("double"))
    return D.warped(cells, targets, how).select("cell", r6("v"))


_WARP = f"WITH dem AS ({sql_text('dem')}), t AS ({_TARGETS.replace('{part}', 'part')})"


@query(f"{_WARP} SELECT t.cell, round(dem.z, 6) AS v FROM t LEFT JOIN dem ON dem.r = floor(t.row) AND dem.c = floor(t.col)")
def warp_nearest(spark, sf_dir):
    return _warp(spark, sf_dir, "nearest")


@query(
    f"""{_WARP}, k AS (SELECT t.cell, floor(row - 0.5) + a AS r, floor(col - 0.5) + b AS c, CASE a WHEN 1 THEN row - 0.5 - floor(row - 0.5) ELSE 1 - (row - 0.5 - floor(row - 0.5)) END * CASE b WHEN 1 THEN col - 0.5 - floor(col - 0.5) ELSE 1 - (col - 0.5 - floor(col - 0.5)) END AS w FROM t, (SELECT unnest([0, 0, 1, 1]) AS a, unnest([0, 1, 0, 1]) AS b))
    SELECT k.cell, round(CASE WHEN sum(CASE WHEN z IS NOT NULL THEN w END) <> 0 THEN sum(w * z) / sum(CASE WHEN z IS NOT NULL THEN w END) END, 6) AS v FROM k LEFT JOIN dem ON dem.r = k.r AND dem.c = k.c GROUP BY k.cell"""
)
def warp_bilinear(spark, sf_dir):
    return _warp(spark, sf_dir, "bilinear")


_RUNS = "SELECT o_orderkey AS run, o_custkey % 2 = 0 AS gauged, o_custkey % 3 > 0 AS has_interval, o_orderstatus = 'F' AS curves_verified, CASE WHEN o_orderkey % 5 < 3 THEN 'nsi' ELSE 'overture' END AS inventory, o_custkey % 7 = 0 AS count_conditional, o_orderkey % 11 = 0 AS fit_saturated, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END AS marks, o_orderpriority AS gap FROM {orders}"


@query(
    f"""WITH r AS ({_RUNS.replace("{orders}", "orders")}) SELECT run, array_to_string(list_filter(['parallel_surface', CASE WHEN NOT gauged THEN 'scenario' END, CASE WHEN has_interval AND NOT curves_verified THEN 'unverified_curves' END, CASE WHEN inventory = 'nsi' THEN 'no_vehicles' END, CASE WHEN inventory = 'nsi' THEN 'modelled_values' END,
    CASE WHEN has_interval AND count_conditional THEN 'conditional_counts' END, 'lower_bound', CASE WHEN fit_saturated THEN 'saturated_fit' END, CASE WHEN marks IS NULL THEN 'not_validated' END, 'gap: ' || gap], lambda x: x IS NOT NULL), '; ') AS caveats FROM r"""
)
def caveats(spark, sf_dir):
    runs = spark.sql(_RUNS, orders=table(spark, sf_dir, "orders")).withColumn("gaps", F.array("gap"))
    return D.caveats(runs).select("run", F.array_join("caveats", "; ").alias("caveats"))


# Hydraulics that other queries only use.


@query(_with(_STAGE + ", top AS (SELECT reach, max(discharge_cms) AS q, arg_max(stage_m, rung) AS s FROM rate GROUP BY reach)", "SELECT q.reach, top.reach IS NULL AS missing, coalesce(q.q > top.q, false) AS capped FROM q LEFT JOIN top ON top.reach = q.reach"))
def stage_gaps(spark, sf_dir):
    t, geometry, curves = _curves(spark, sf_dir)
    return H.stage_gaps(curves, H.reach_discharge(geometry, t.routed, 400.0))
