"""Registered queries of the flood operators, and the DuckDB SQL of each that SQL can express.

The oracles are built from common table expressions that follow the rules directly (recursive walks, one row per rung and cell), not
the way the operators compute them. Figures are rounded to six places on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.operators import exposure as E
from freshet.operators import hydraulics as H
from freshet.operators import network as N
from freshet.operators import overlay as O
from freshet.operators import terrain as T
from freshet.operators import validation as V
from freshet.plans.terrain import MIN_BRANCH, THRESHOLD, TILE, Terrain, scenario, terrain
from freshet.sources.adapters import CELLSIZE, COLS, sql_text, view
from freshet.sources.store import shared_dir, table
from freshet.streaming import gauges as G

GAUGE_CMS = 400.0
RUNGS = [0.0, 0.5, 1.0, 2.0, 3.0]
STAGE_MAX, STAGE_STEP = 25.0, 0.25

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return add


def r6(c: str, name: str | None = None):
    return F.round(c, 6).alias(name or c)


# Common table expressions of the terrain chain; each list entry needs those before it.

_OFF = ", ".join(f"({k}, {a}, {b}, {'1.0' if a == 0 or b == 0 else 'sqrt(2.0)'})" for k, a, b in T.DIRECTIONS)
_DEM = f"""dem AS MATERIALIZED ({sql_text("dem")}),
off(code, dr, dc, far) AS (VALUES {_OFF}),
nb AS MATERIALIZED (SELECT d.cell, d.z, o.code, o.far, n.cell AS n_cell, n.z AS n_z FROM dem d CROSS JOIN off o JOIN dem n ON n.r = d.r + o.dr AND n.c = d.c + o.dc),
edge AS (SELECT d.cell, d.z FROM dem d LEFT JOIN nb ON nb.cell = d.cell GROUP BY d.cell, d.z HAVING count(nb.code) < 8)"""
_FILL = (
    _DEM
    + """,
lev(cell, w) AS (SELECT cell, z FROM edge UNION
    SELECT n.n_cell, greatest(n.n_z, l.w) FROM lev l JOIN nb n ON n.cell = l.cell WHERE greatest(n.n_z, l.w) <= n.n_z + 40),
filled AS MATERIALIZED (SELECT cell, min(w) AS z FROM lev GROUP BY cell)"""
)
_D8 = (
    _FILL
    + """,
nf AS MATERIALIZED (SELECT nb.cell, code, far, n_cell, f.z, g.z AS n_z FROM nb JOIN filled f ON f.cell = nb.cell JOIN filled g ON g.cell = nb.n_cell),
best AS (SELECT cell, code FROM nf WHERE z > n_z QUALIFY row_number() OVER (PARTITION BY cell ORDER BY (z - n_z) / far DESC, code) = 1),
d8 AS MATERIALIZED (SELECT f.cell, f.z, coalesce(b.code, CASE WHEN coalesce(k.n, 0) < 8 THEN -1 ELSE -2 END) AS flowdir
    FROM filled f LEFT JOIN (SELECT cell, count(*) AS n FROM nf GROUP BY cell) k ON k.cell = f.cell LEFT JOIN best b ON b.cell = f.cell)"""
)
_FLATS = (
    _D8
    + """,
fn AS MATERIALIZED (SELECT nf.*, a.flowdir AS fd, b.flowdir AS n_fd FROM nf JOIN d8 a ON a.cell = nf.cell JOIN d8 b ON b.cell = nf.n_cell),
hi(cell, d) AS (SELECT DISTINCT cell, 1 FROM fn WHERE fd = -2 AND n_z > z UNION
    SELECT n.n_cell, hi.d + 1 FROM hi JOIN fn n ON n.cell = hi.cell WHERE n.n_fd = -2 AND n.n_z = n.z AND hi.d < 80),
lo(cell, d) AS (SELECT DISTINCT cell, 1 FROM fn WHERE fd = -2 AND n_fd <> -2 AND n_z <= z UNION
    SELECT n.n_cell, lo.d + 1 FROM lo JOIN fn n ON n.cell = lo.cell WHERE n.n_fd = -2 AND n.n_z = n.z AND lo.d < 80),
dh AS (SELECT cell, min(d) AS d FROM hi GROUP BY cell), dl AS (SELECT cell, min(d) AS d FROM lo GROUP BY cell),
rk AS MATERIALIZED (SELECT dl.cell, coalesce((SELECT max(d) FROM dh) - dh.d, (SELECT max(d) FROM dh), 0) + 2 * dl.d AS k FROM dl LEFT JOIN dh ON dh.cell = dl.cell),
way AS (SELECT fn.cell, fn.code FROM fn JOIN rk ON rk.cell = fn.cell LEFT JOIN rk q ON q.cell = fn.n_cell
    WHERE fn.n_z <= fn.z AND (q.cell IS NOT NULL AND fn.n_z = fn.z OR fn.n_fd <> -2) AND rk.k > coalesce(q.k, 0)
    QUALIFY row_number() OVER (PARTITION BY fn.cell ORDER BY (rk.k - coalesce(q.k, 0)) / fn.far DESC, fn.code) = 1),
routed AS MATERIALIZED (SELECT d8.cell, d8.z, coalesce(way.code, d8.flowdir) AS flowdir, d8.flowdir = -2 AS flat, way.code IS NOT NULL AS resolved, nb.n_cell AS next
    FROM d8 LEFT JOIN way ON way.cell = d8.cell LEFT JOIN nb ON nb.cell = d8.cell AND nb.code = coalesce(way.code, d8.flowdir))"""
)
_ACC = (
    _FLATS
    + """,
walk(src, node, n) AS (SELECT cell, cell, 1 FROM routed UNION ALL SELECT w.src, t.next, w.n + 1 FROM walk w JOIN routed t ON t.cell = w.node WHERE t.next IS NOT NULL),
acc AS MATERIALIZED (SELECT node AS cell, CAST(count(*) AS DOUBLE) AS accumulation FROM walk GROUP BY node)"""
)
def _pass(k: int, least: int = 5) -> str:
    """CTEs of one round of pruning: from p{k} to p{k + 1}."""
    return f""", u{k} AS (SELECT next AS cell, count(*) AS n FROM p{k} WHERE next IS NOT NULL GROUP BY next),
w{k}(head, cell, n) AS (SELECT p{k}.cell, p{k}.cell, 1 FROM p{k} WHERE cell NOT IN (SELECT cell FROM u{k}) UNION ALL SELECT w.head, p.next, w.n + 1 FROM w{k} w JOIN p{k} p ON p.cell = w.cell JOIN u{k} u ON u.cell = p.next WHERE u.n = 1 AND w.n < {least}),
g{k} AS (SELECT DISTINCT cell FROM w{k} WHERE head IN (SELECT head FROM w{k} GROUP BY head HAVING max(n) < {least})),
p{k + 1} AS MATERIALIZED (SELECT p.cell, CASE WHEN q.cell IS NULL THEN p.next END AS next FROM p{k} p LEFT JOIN g{k} q ON q.cell = p.next WHERE p.cell NOT IN (SELECT cell FROM g{k}))"""


_STREAMS = (
    _ACC
    + f""",
p0 AS MATERIALIZED (SELECT a.cell, CASE WHEN b.cell IS NOT NULL THEN t.next END AS next FROM acc a JOIN routed t ON t.cell = a.cell
    LEFT JOIN acc b ON b.cell = t.next AND b.accumulation >= {THRESHOLD} WHERE a.accumulation >= {THRESHOLD}){"".join(_pass(k, MIN_BRANCH) for k in range(8))},
st AS MATERIALIZED (SELECT cell, next FROM p8),
ups AS MATERIALIZED (SELECT next AS cell, count(*) AS n FROM st WHERE next IS NOT NULL GROUP BY next),
lk(start, cell, seq) AS (SELECT st.cell, st.cell, 0 FROM st LEFT JOIN ups ON ups.cell = st.cell WHERE coalesce(ups.n, 0) <> 1 UNION ALL
    SELECT lk.start, st.next, lk.seq + 1 FROM lk JOIN st ON st.cell = lk.cell JOIN ups ON ups.cell = st.next WHERE ups.n = 1),
links AS MATERIALIZED (SELECT cell, start, seq, dense_rank() OVER (ORDER BY start) - 1 AS link FROM lk)"""
)
_HAND = (
    _STREAMS
    + """,
dn(src, node) AS (SELECT cell, cell FROM routed UNION ALL SELECT dn.src, t.next FROM dn JOIN routed t ON t.cell = dn.node
    WHERE t.next IS NOT NULL AND dn.node NOT IN (SELECT cell FROM st)),
hd AS MATERIALIZED (SELECT t.cell, s.cell AS drainage, t.z - u.z AS hand, links.link AS reach FROM routed t
    LEFT JOIN (SELECT dn.src, st.cell FROM dn JOIN st ON st.cell = dn.node) s ON s.src = t.cell
    LEFT JOIN routed u ON u.cell = s.cell LEFT JOIN links ON links.cell = s.cell)"""
)
_RATING = (
    _HAND
    + f""",
seg AS (SELECT link, cell, seq, lag(cell) OVER (PARTITION BY link ORDER BY seq) AS b FROM links),
geo AS MATERIALIZED (SELECT seg.link AS reach, sum(CASE WHEN b IS NULL THEN 0.0 WHEN abs(seg.cell - b) IN (1, {COLS}) THEN {CELLSIZE} ELSE {CELLSIZE} * sqrt(2.0) END) AS length_m,
    arg_min(t.z, seq) - arg_max(t.z, seq) AS fall, arg_max(seg.cell, seq) AS last_cell FROM seg JOIN routed t ON t.cell = seg.cell GROUP BY seg.link),
rung AS (SELECT unnest(range(0, {int(STAGE_MAX / STAGE_STEP) + 1})) AS rung),
vol AS (SELECT g.reach, rung.rung, rung.rung * {STAGE_STEP} AS h, g.length_m, greatest(g.fall / g.length_m, 0.0001) AS s,
    sum(greatest(rung.rung * {STAGE_STEP} - hd.hand, 0)) * {CELLSIZE**2} AS v, count(*) FILTER (rung.rung * {STAGE_STEP} > hd.hand) * {CELLSIZE**2} AS sa
    FROM geo g JOIN hd ON hd.reach = g.reach AND hd.hand IS NOT NULL CROSS JOIN rung WHERE g.length_m >= 30 GROUP BY ALL),
rate AS MATERIALIZED (SELECT reach, rung, h AS stage_m, v / length_m AS area_m2, CASE WHEN sa > 0 THEN v / sa ELSE 0 END AS radius_m,
    max(CASE WHEN sa > 0 AND v > 0 THEN (1 / 0.035) * (v / length_m) * pow(v / sa, 2.0 / 3) * sqrt(s) ELSE 0 END) OVER (PARTITION BY reach ORDER BY rung) AS discharge_cms FROM vol)"""
)
_STAGE = (
    _RATING
    + f""",
q AS (SELECT geo.reach, {GAUGE_CMS} * acc.accumulation / (SELECT max(accumulation) FROM acc) AS q FROM geo JOIN acc ON acc.cell = geo.last_cell),
m(multiplier) AS (VALUES {", ".join(f"({x})" for x in RUNGS)}),
low AS (SELECT q.reach, m.multiplier, q.q * m.multiplier AS q, max(rate.rung) AS rung FROM q CROSS JOIN m JOIN rate ON rate.reach = q.reach AND rate.discharge_cms <= q.q * m.multiplier GROUP BY ALL),
stage AS MATERIALIZED (SELECT q.reach, m.multiplier, coalesce(CASE WHEN b.rung IS NULL THEN a.stage_m ELSE a.stage_m + (low.q - a.discharge_cms) / (b.discharge_cms - a.discharge_cms) * (b.stage_m - a.stage_m) END, 0.0) AS stage_m
    FROM q CROSS JOIN m LEFT JOIN low ON low.reach = q.reach AND low.multiplier = m.multiplier
    LEFT JOIN rate a ON a.reach = q.reach AND a.rung = low.rung LEFT JOIN rate b ON b.reach = q.reach AND b.rung = low.rung + 1)"""
)
_WET = (
    _STAGE
    + """,
dep AS MATERIALIZED (SELECT hd.cell, CASE WHEN hd.hand IS NOT NULL THEN greatest(coalesce(s.stage_m, 0.0) - hd.hand, 0.0) END AS depth_m FROM hd LEFT JOIN stage s ON s.reach = hd.reach AND s.multiplier = 1.0),
pool AS MATERIALIZED (SELECT cell FROM dep WHERE depth_m >= 0.05),
con(cell) AS (SELECT st.cell FROM st JOIN pool ON pool.cell = st.cell UNION SELECT nb.n_cell FROM con JOIN nb ON nb.cell = con.cell JOIN pool ON pool.cell = nb.n_cell),
wet AS MATERIALIZED (SELECT dep.cell, CASE WHEN dep.depth_m IS NOT NULL THEN CASE WHEN con.cell IS NOT NULL THEN dep.depth_m ELSE 0.0 END END AS depth_m, con.cell IS NOT NULL AS connected FROM dep LEFT JOIN con ON con.cell = dep.cell)"""
)


def _with(chain: str, select: str) -> str:
    return f"WITH RECURSIVE {chain}\n{select}"


# Terrain.


@query(_with(_FILL, "SELECT dem.cell, dem.z, filled.z AS filled, filled.z > dem.z AS raised FROM dem JOIN filled ON filled.cell = dem.cell"))
def terrain_fill(spark, sf_dir):
    return terrain(spark, sf_dir).filled.select("cell", F.col("raw").alias("z"), F.col("z").alias("filled"), (F.col("z") > F.col("raw")).alias("raised"))


@query(_with(_DEM + ", ok(cell) AS (SELECT cell FROM edge UNION SELECT nb.n_cell FROM ok JOIN nb ON nb.cell = ok.cell WHERE nb.n_z >= nb.z)", "SELECT cell, cell NOT IN (SELECT cell FROM ok) AS undrained FROM dem"))
def terrain_undrained(spark, sf_dir):
    return T.undrained(terrain(spark, sf_dir).raw, TILE).select("cell", "undrained")


@query(_with(_D8, "SELECT cell, flowdir FROM d8"))
def terrain_d8(spark, sf_dir):
    return terrain(spark, sf_dir).first.select("cell", F.col("flowdir").cast("int").alias("flowdir"))


@query(_with(_FLATS, "SELECT cell, flowdir, flat, resolved, next FROM routed"))
def terrain_flats(spark, sf_dir):
    return terrain(spark, sf_dir).routed.select("cell", F.col("flowdir").cast("int").alias("flowdir"), "flat", "resolved", "next")


@query(_with(_ACC, "SELECT src AS cell, max(n) AS steps, arg_max(node, n) AS outlet FROM walk GROUP BY src"))
def terrain_steps(spark, sf_dir):
    return T.steps_to_outlet(terrain(spark, sf_dir).routed, TILE)


@query(_with(_ACC, "SELECT cell, accumulation FROM acc"))
def terrain_accumulation(spark, sf_dir):
    return T.flow_accumulation(terrain(spark, sf_dir).routed, size=TILE)


@query(_with(_STREAMS, "SELECT cell, start, seq, link FROM links"))
def terrain_links(spark, sf_dir):
    return terrain(spark, sf_dir).links.select("cell", "start", "seq", "link")


@query(_with(_HAND, "SELECT cell, drainage, hand, reach FROM hd"))
def terrain_hand(spark, sf_dir):
    return terrain(spark, sf_dir).hand.select("cell", "drainage", "hand", "reach")


@query(_with(_STREAMS, "SELECT cell, next FROM st"))
def terrain_prune(spark, sf_dir):
    return T.prune_streams(terrain(spark, sf_dir).mask, MIN_BRANCH)


_ORDERS = "".join(f", o{k} AS (SELECT DISTINCT node AS link FROM anc WHERE link IN (SELECT down FROM lt JOIN o{k - 1} ON o{k - 1}.link = lt.link WHERE down IS NOT NULL GROUP BY down HAVING count(*) > 1))" for k in range(2, 9))


@query(
    _with(
        _STREAMS
        + f""", nx AS (SELECT links.link, links.cell, links.seq, st.next, b.link AS there, CASE WHEN st.next IS NULL THEN 0.0 WHEN abs(st.next - links.cell) IN (1, {COLS}) THEN {CELLSIZE} ELSE {CELLSIZE} * sqrt(2.0) END AS step
    FROM links JOIN st ON st.cell = links.cell LEFT JOIN links b ON b.cell = st.next),
lt AS MATERIALIZED (SELECT link, CASE WHEN arg_max(coalesce(there, -1), seq) >= 0 THEN arg_max(coalesce(there, -1), seq) END AS down, count(*) AS cells, sum(step) AS length_m FROM nx GROUP BY link),
anc(link, node) AS (SELECT link, link FROM lt UNION ALL SELECT a.link, lt.down FROM anc a JOIN lt ON lt.link = a.node WHERE lt.down IS NOT NULL),
o1 AS (SELECT link FROM lt){_ORDERS}, od AS (SELECT link, count(*) AS strahler FROM ({" UNION ALL ".join(f"SELECT link FROM o{k}" for k in range(1, 9))}) GROUP BY link),
hd2 AS (SELECT link, arg_min(accumulation, seq) AS acc_head, max(accumulation) AS acc_outflow FROM links JOIN acc ON acc.cell = links.cell GROUP BY link)""",
        "SELECT lt.link, down, cells, CAST(strahler AS INTEGER) AS strahler, down IS NULL AS terminates, round(length_m, 6) AS length_m, acc_head, acc_outflow, CAST(cells + CASE WHEN down IS NULL THEN 0 ELSE 1 END AS INTEGER) AS points FROM lt JOIN od ON od.link = lt.link JOIN hd2 ON hd2.link = lt.link WHERE cells + CASE WHEN down IS NULL THEN 0 ELSE 1 END >= 2",
    )
)
def terrain_network(spark, sf_dir):
    t = terrain(spark, sf_dir)
    return T.stream_network(t.streams, t.links, t.routed, COLS, CELLSIZE).select("link", "down", "cells", "strahler", "terminates", r6("length_m"), "acc_head", "acc_outflow", F.size("line").alias("points"))


@query(
    _with(
        _STREAMS + f", area AS (SELECT st.cell, accumulation * {CELLSIZE**2} / 1e6 AS a FROM st JOIN acc ON acc.cell = st.cell)",
        "SELECT cell, round(least(0.381 * pow(a, 0.246), 8.0), 6) AS depth_m, round(4.774 * pow(a, 0.321), 6) AS width_m FROM area",
    )
)
def terrain_channel(spark, sf_dir):
    t = terrain(spark, sf_dir)
    area = F.col("accumulation") * (CELLSIZE**2 / 1e6)
    return t.streams.select("cell").join(t.routed.select("cell", "accumulation"), "cell").select("cell", F.round(T.channel_depth(area), 6).alias("depth_m"), F.round(T.channel_width(area), 6).alias("width_m"))


# Hydraulics.


def _curves(spark, sf_dir) -> tuple[Terrain, DataFrame, DataFrame]:
    t = terrain(spark, sf_dir)
    geometry = H.reach_geometry(t.links, t.routed, COLS, CELLSIZE)
    return t, geometry, H.rating_curves(t.hand, geometry, CELLSIZE, max_stage=STAGE_MAX, step=STAGE_STEP)


def _stages(spark, sf_dir, rungs: list[float] = RUNGS) -> tuple[Terrain, DataFrame]:
    """Terrain and stage table, which is written once for all scenarios of the same rungs."""

    def build() -> DataFrame:
        t, geometry, curves = _curves(spark, sf_dir)
        return H.stage_table(curves, H.reach_discharge(geometry, t.routed, GAUGE_CMS), rungs)

    return terrain(spark, sf_dir), scenario(spark, sf_dir, "stages", {"cms": GAUGE_CMS, "rungs": rungs, "max": STAGE_MAX, "step": STAGE_STEP}, build)


@query(_with(_RATING, "SELECT reach, rung, stage_m, round(discharge_cms, 6) AS discharge_cms, round(area_m2, 6) AS area_m2, round(radius_m, 6) AS radius_m FROM rate"))
def rating_curves(spark, sf_dir):
    return _curves(spark, sf_dir)[2].select("reach", "rung", "stage_m", r6("discharge_cms"), r6("area_m2"), r6("radius_m"))


@query(_with(_STAGE, "SELECT reach, multiplier, round(stage_m, 6) AS stage_m FROM stage"))
def stage_table(spark, sf_dir):
    return _stages(spark, sf_dir)[1].select("reach", "multiplier", r6("stage_m"))


def _wet(spark, sf_dir) -> tuple[Terrain, DataFrame, DataFrame]:
    t, stages = _stages(spark, sf_dir)
    build = lambda: H.inundate(t.hand, t.raw, stages.where("multiplier = 1.0"), t.streams, COLS, size=t.size)
    return t, stages, scenario(spark, sf_dir, "extent", {"cms": GAUGE_CMS, "multiplier": 1.0, "max": STAGE_MAX, "step": STAGE_STEP}, build)


@query(_with(_WET, "SELECT cell, round(depth_m, 6) AS depth_m, connected FROM wet"))
def inundation(spark, sf_dir):
    return _wet(spark, sf_dir)[2].select("cell", r6("depth_m"), "connected")


@query(_with(_WET, f"SELECT count(*) FILTER (depth_m > 0) AS wet_cells, count(*) FILTER (depth_m > 0) * {CELLSIZE**2} AS area_m2, round(max(depth_m), 6) AS max_depth_m, count(*) FILTER (depth_m IS NULL) AS unknown FROM wet"))
def flood_summary(spark, sf_dir):
    wet = _wet(spark, sf_dir)[2]
    n = F.count_if(F.col("depth_m") > 0)
    return wet.agg(n.alias("wet_cells"), (n * CELLSIZE**2).alias("area_m2"), F.round(F.max("depth_m"), 6).alias("max_depth_m"), F.count_if(F.col("depth_m").isNull()).alias("unknown"))


# Along the network.

_STEP = f"CASE WHEN t.flowdir IN (1, 4, 16, 64) THEN {CELLSIZE} ELSE {CELLSIZE} * sqrt(2.0) END"
_WAY = (
    _STREAMS
    + f""",
way2(src, node, d) AS (SELECT cell, cell, 0.0::DOUBLE FROM routed UNION ALL SELECT w.src, t.next, w.d + {_STEP} FROM way2 w JOIN routed t ON t.cell = w.node WHERE t.next IS NOT NULL),
gauge AS MATERIALIZED (SELECT link AS gauge, cell FROM links JOIN supplier ON s_suppkey = link WHERE seq = 0),
path AS MATERIALIZED (SELECT g.gauge, w.node, -w.d AS base FROM gauge g JOIN way2 w ON w.src = g.cell)"""
)


def _gauged(spark, sf_dir) -> DataFrame:
    """Links with a gauge: every supplier stands at the head of the link of its number, where there is one."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("link"))


@query(_with(_WAY, "SELECT p.gauge, w.src AS cell, round(arg_min(w.d + p.base, w.d), 6) AS distance_m FROM way2 w JOIN path p ON p.node = w.node GROUP BY p.gauge, w.src"))
def network_distance(spark, sf_dir):
    t = terrain(spark, sf_dir)
    gauges = t.links.where("seq = 0").join(_gauged(spark, sf_dir), "link").select(F.col("link").alias("gauge"), "cell")
    return N.network_distance(t.routed, gauges, CELLSIZE, t.size).select("gauge", "cell", r6("distance_m"))


_REACHES = (
    _STREAMS
    + f""",
rs AS (SELECT a.link AS reach, a.cell, b.link AS there, CASE WHEN abs(st.next - a.cell) IN (1, {COLS}) THEN {CELLSIZE} ELSE {CELLSIZE} * sqrt(2.0) END AS step
    FROM links a JOIN st ON st.cell = a.cell LEFT JOIN links b ON b.cell = st.next),
rg AS MATERIALIZED (SELECT reach, arg_min(there, cell) FILTER (there <> reach) AS down, coalesce(sum(step) FILTER (there IS NOT NULL), 0) AS length_m FROM rs GROUP BY reach)"""
)


@query(_with(_REACHES, "SELECT reach, down, round(length_m, 6) AS length_m FROM rg"))
def reach_graph(spark, sf_dir):
    t = terrain(spark, sf_dir)
    return N.reach_graph(t.links, t.streams, COLS, CELLSIZE).select("reach", "down", r6("length_m"))


@query(
    _with(
        _REACHES
        + """,
bed AS MATERIALIZED (SELECT l.link AS reach, r.z AS bed FROM links l JOIN routed r ON r.cell = l.cell WHERE l.seq = 0),
ga AS MATERIALIZED (SELECT reach, 1.0 + reach % 3 AS depth FROM bed JOIN supplier ON s_suppkey = reach),
rw(src, node, d) AS (SELECT reach, down, length_m FROM rg WHERE down IS NOT NULL UNION ALL SELECT w.src, g.down, w.d + g.length_m FROM rw w JOIN rg g ON g.reach = w.node WHERE g.down IS NOT NULL),
lo2 AS (SELECT rw.src AS reach, min(d) AS d, arg_min(depth, d) AS depth FROM rw JOIN ga ON ga.reach = rw.node GROUP BY rw.src),
up2 AS (SELECT node AS reach, d, depth FROM rw JOIN ga ON ga.reach = rw.src QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(d, 6), src) = 1),
al AS (SELECT bed.reach, bed, CASE WHEN ga.depth IS NOT NULL THEN 'gauged' WHEN lo2.d IS NOT NULL AND up2.d IS NOT NULL THEN 'interpolated' WHEN lo2.d IS NOT NULL OR up2.d IS NOT NULL THEN 'extrapolated' END AS kind,
    CASE WHEN ga.depth IS NOT NULL THEN ga.depth WHEN lo2.d IS NOT NULL AND up2.d IS NOT NULL THEN up2.depth + (lo2.depth - up2.depth) * (up2.d / (up2.d + lo2.d)) ELSE coalesce(lo2.depth, up2.depth) END AS depth
    FROM bed LEFT JOIN ga ON ga.reach = bed.reach LEFT JOIN lo2 ON lo2.reach = bed.reach LEFT JOIN up2 ON up2.reach = bed.reach)""",
        "SELECT reach, kind, round(depth, 6) AS stage_m, round(bed + depth, 6) AS wse_m FROM al WHERE kind IS NOT NULL",
    )
)
def observed_stage(spark, sf_dir):
    t = terrain(spark, sf_dir)
    bed = t.links.where("seq = 0").join(t.routed.select("cell", "z"), "cell").select(F.col("link").alias("reach"), F.col("z").alias("bed_m"))
    gauges = bed.join(_gauged(spark, sf_dir).withColumnRenamed("link", "reach"), "reach").select("reach", (F.col("bed_m") + 1.0 + F.col("reach") % 3).alias("wse_m"), F.col("bed_m").alias("gauge_bed_m"))
    rows = N.interpolate_stage(N.reach_graph(t.links, t.streams, COLS, CELLSIZE).join(bed, "reach", "left"), gauges)
    return rows.select("reach", "kind", r6("stage_m"), r6("wse_m"))


_SQUARES = """sq AS (SELECT c_custkey AS grp, (c_custkey % 60) * 700.0 AS x, (c_custkey // 60) * 500.0 AS y, 900.0 AS w FROM customer),
ws AS (SELECT s_suppkey AS huc, (s_suppkey % 7) * 6000.0 AS x0, (s_suppkey % 5) * 2100.0 AS y0, 9000.0 AS w FROM supplier),
cl AS (SELECT o_custkey AS grp, count(*) AS n, sum(o_totalprice) AS paid FROM orders GROUP BY o_custkey)"""


@query(
    f"""WITH {_SQUARES}, s AS (SELECT huc, grp, greatest(least(x + sq.w, x0 + ws.w) - greatest(x, x0), 0) * greatest(least(y + sq.w, y0 + ws.w) - greatest(y, y0), 0) / (sq.w * sq.w) AS share FROM sq, ws),
m AS (SELECT huc, round(sum(n * share)) AS claims, sum(paid * share) AS paid, count(*) AS matched FROM s JOIN cl ON cl.grp = s.grp WHERE share > 0 GROUP BY huc)
SELECT ws.huc, CAST(coalesce(claims, 0) AS BIGINT) AS claims, round(coalesce(paid, 0), 2) AS paid, coalesce(matched, 0) AS matched FROM ws LEFT JOIN m ON m.huc = ws.huc"""
)
def overlay_claims(spark, sf_dir):
    def ring(x, y, w):
        at = lambda a, b: F.struct((F.col(x) + a * F.col(w)).alias("x"), (F.col(y) + b * F.col(w)).alias("y"))
        return F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1)).cast(O.POINT)

    groups = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("group"), (F.col("c_custkey") % 60 * 700.0).alias("x"), (F.floor(F.col("c_custkey") / 60) * 500.0).alias("y"), F.lit(900.0).alias("w"))
    units = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("huc"), (F.col("s_suppkey") % 7 * 6000.0).alias("x"), (F.col("s_suppkey") % 5 * 2100.0).alias("y"), F.lit(9000.0).alias("w"))
    claims = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("group")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("paid"))
    got = O.weigh_claims(groups.select("group", ring("x", "y", "w").alias("ring")), claims, units.select("huc", ring("x", "y", "w").alias("ring")))
    return got.select("huc", "claims", F.round("paid", 2).alias("paid"), "matched")


_PEAKS = f"peaks AS ({sql_text('peaks')})"


@query(
    f"""WITH {_PEAKS}, x AS (SELECT site, log10(cms) AS x FROM peaks WHERE cms > 0),
    mu AS (SELECT site, avg(x) AS mu FROM x GROUP BY site),
    s AS (SELECT x.site, count(*) AS n, avg(x) AS log_mean, stddev_samp(x) AS log_sd, sum(pow(x - mu.mu, 3)) AS m3 FROM x JOIN mu ON mu.site = x.site GROUP BY x.site)
    SELECT site, n, round(log_mean, 6) AS log_mean, round(log_sd, 6) AS log_sd, round(n * m3 / ((n - 1) * (n - 2) * pow(log_sd, 3)), 6) AS log_skew, n >= 10 AS can_fit FROM s"""
)
def frequency_fit(spark, sf_dir):
    return H.frequency_fit(view(spark, sf_dir, "peaks"), ["site"]).select("site", "n", r6("log_mean"), r6("log_sd"), r6("log_skew"), "can_fit")


# Standard normal quantiles of the periods, to sixteen digits; the integral is the alternating-free series of the error function.
_QUANTILE = ", ".join(f"({p}, {NormalDist().inv_cdf(1 - 1 / p)!r})" for p in (2.0, 10.0, 50.0, 100.0, 500.0))
_FIT = f"""{_PEAKS}, x AS (SELECT site, log10(cms) AS x FROM peaks WHERE cms > 0), mu AS (SELECT site, avg(x) AS mu FROM x GROUP BY site),
s AS (SELECT x.site, count(*) AS n, avg(x) AS m, stddev_samp(x) AS sd, sum(pow(x - mu.mu, 3)) AS m3 FROM x JOIN mu ON mu.site = x.site GROUP BY x.site),
fit AS (SELECT site, n, m, sd, n * m3 / ((n - 1) * (n - 2) * pow(sd, 3)) AS g FROM s)"""
_PHI = "CASE WHEN z < 0 THEN 0.5 - {0} ELSE 0.5 + {0} END".format("exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 120), lambda k: exp((2 * k + 1) * ln(greatest(abs(z), 1e-300)) - lgamma(2 * k + 2) + lgamma(k + 1) + k * ln(2.0))))")


@query(
    f"""WITH {_FIT}, q(period, z) AS (VALUES {_QUANTILE}), f AS (SELECT site, CAST(period AS DOUBLE) AS period, m + (2 / g) * (pow((z - g / 6) * (g / 6) + 1, 3) - 1) * sd AS lq FROM fit, q WHERE n >= 10)
    SELECT site, period, round(pow(10, lq), 6) AS cms, round(period, 4) AS back FROM f"""
)
def frequency_quantiles(spark, sf_dir):
    fit = H.frequency_fit(view(spark, sf_dir, "peaks"), ["site"]).withColumn("period", F.explode(F.array(*[F.lit(float(x)) for x in (2, 10, 50, 100, 500)])))
    flow = H.pearson_discharge(F.col("period"))
    return fit.withColumn("cms", flow).select("site", "period", r6("cms"), F.round(H.pearson_period(F.col("cms")), 4).alias("back"))


@query(
    f"""WITH {_FIT}, e AS (SELECT site, quantile_cont(cms, 0.8) AS discharge_cms FROM peaks GROUP BY site),
    c AS (SELECT e.site, discharge_cms, count(*) FILTER (cms > discharge_cms) + 1 AS rank, count(*) AS n, max(cms) FILTER (cms <= discharge_cms) AS nearest_below FROM e JOIN peaks ON peaks.site = e.site WHERE cms > 0 GROUP BY e.site, discharge_cms),
    zz AS (SELECT c.*, (cbrt((log10(discharge_cms) - m) / sd * g / 2 + 1) - 1) / (g / 6) + g / 6 AS z FROM c JOIN fit ON fit.site = c.site),
    t AS (SELECT *, least(greatest(1 / greatest(1 - ({_PHI}), 1e-12), 1.0001), 1000) AS period FROM zz)
    SELECT site, round(discharge_cms, 6) AS discharge_cms, rank, n, round((n + 1) / rank, 6) AS empirical, CASE WHEN period < 1000 THEN round(period, 4) END AS fitted, period >= 1000 AS saturated, period < 1000 AND period > 2 * n AS extrapolated, round(nearest_below, 6) AS nearest_below FROM t"""
)
def frequency_context(spark, sf_dir):
    peaks = view(spark, sf_dir, "peaks")
    events = peaks.groupBy("site").agg(F.percentile("cms", F.lit(0.8)).alias("discharge_cms"))
    return H.event_context(peaks, events, H.frequency_fit(peaks, ["site"])).select("site", r6("discharge_cms"), "rank", "n", r6("empirical"), F.round("fitted", 4).alias("fitted"), "saturated", "extrapolated", r6("nearest_below"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE 0 END AS INTEGER) AS water_year FROM orders")
def water_years(spark, sf_dir):
    from freshet.functions.scalar import water_year

    return table(spark, sf_dir, "orders").select("o_orderkey", water_year(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("water_year"))


@query(
    _with(
        _STREAMS + f", p AS (SELECT s_suppkey AS point, CAST((s_suppkey * 3) % 100 AS INT) AS r, CAST((s_suppkey * 11) % {COLS} AS INT) AS c FROM supplier), sc AS MATERIALIZED (SELECT st.cell, st.cell // {COLS} AS r, st.cell % {COLS} AS c FROM st)",
        "SELECT point, sc.cell FROM p JOIN sc ON greatest(abs(p.r - sc.r), abs(p.c - sc.c)) <= 40 QUALIFY row_number() OVER (PARTITION BY point ORDER BY greatest(abs(p.r - sc.r), abs(p.c - sc.c)), (p.r - sc.r) ** 2 + (p.c - sc.c) ** 2, sc.r, sc.c) = 1",
    )
)
def gauge_snap(spark, sf_dir):
    t = terrain(spark, sf_dir)
    points = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("point"), (F.col("s_suppkey") * 3 % 100).cast("int").alias("r"), (F.col("s_suppkey") * 11 % COLS).cast("int").alias("c"))
    return H.snap_to_stream(points, t.streams.select("cell", F.floor(F.col("cell") / COLS).cast("int").alias("r"), (F.col("cell") % COLS).cast("int").alias("c")))


# Exposure and damage.

_CURVE = ", ".join(f"('{f}', '{k}', {i}, {d}, {v[i]})" for f, classes in E.CURVES.items() for k, v in classes.items() for i, d in enumerate(E.DEPTHS))
_CLASS = "CASE WHEN building_class IN ('residential', 'commercial', 'industrial', 'other') THEN building_class WHEN building_class LIKE 'RES%' THEN 'residential' WHEN building_class LIKE 'COM%' THEN 'commercial' ELSE 'residential' END"
_BLD = f"""bld AS (SELECT *, {_CLASS} AS k, CASE WHEN num_floors > 0 THEN num_floors ELSE greatest(round_even(height / 3, 0), 1) END AS storeys FROM ({sql_text("buildings")}))"""
_RATE = "CASE k WHEN 'residential' THEN 2000.0 WHEN 'commercial' THEN 2500.0 WHEN 'industrial' THEN 1500.0 ELSE 1800.0 END"


def _hit(source: str, family: str = "HAZUS") -> str:
    """CTEs crv, hit: damage of source (bld columns, reach, hand, stage_m, multiplier)."""
    return f"""crv(family, k, i, d, v) AS (VALUES {_CURVE}),
mar AS (SELECT *, CASE WHEN stage_m - hand > 0 THEN stage_m - hand - found_ht_m ELSE -1e6 END AS margin_m FROM {source}),
low2 AS (SELECT mar.*, least(margin_m, 6.0) AS x, coalesce((SELECT max(i) FROM crv c WHERE c.family = '{family}' AND c.k = mar.k AND c.d <= least(margin_m, 6.0)), -1) AS i FROM mar),
hit AS (SELECT low2.*, area_m2 * storeys * {_RATE.replace('CASE k', 'CASE low2.k')} AS exposed,
    CASE WHEN margin_m <= -1000 THEN 0 ELSE CASE WHEN low2.i = -1 THEN f.v WHEN b.i IS NULL THEN a.v ELSE a.v + (x - a.d) / (b.d - a.d) * (b.v - a.v) END END
      * least(greatest(ceil(greatest(margin_m, 0) / 3), 1), greatest(storeys, 1)) / greatest(storeys, 1) AS fraction
    FROM low2 JOIN crv f ON f.family = '{family}' AND f.k = low2.k AND f.i = 0 LEFT JOIN crv a ON a.family = '{family}' AND a.k = low2.k AND a.i = low2.i LEFT JOIN crv b ON b.family = '{family}' AND b.k = low2.k AND b.i = low2.i + 1)"""


def _buildings(spark, sf_dir) -> DataFrame:
    b = view(spark, sf_dir, "buildings")
    b = b.withColumn("storeys", E.storeys(F.col("num_floors"), F.col("height")))
    return b.withColumn("floor_area_m2", F.col("area_m2") * F.col("storeys"))


def _placed(spark, sf_dir, t: Terrain) -> DataFrame:
    return _buildings(spark, sf_dir).join(t.hand.select("cell", "hand", "reach"), "cell")


_AT = _STAGE + ", " + _BLD + ", placed AS (SELECT bld.*, hd.hand, hd.reach, stage.stage_m, stage.multiplier FROM bld JOIN hd ON hd.cell = bld.cell JOIN stage ON stage.reach = hd.reach WHERE hd.hand IS NOT NULL)"


@query(f"WITH {_BLD} SELECT building_id, storeys, round(area_m2 * storeys * {_RATE}, 6) AS exposed FROM bld")
def building_values(spark, sf_dir):
    return _buildings(spark, sf_dir).select("building_id", "storeys", F.round(E.exposed_value(F.col("floor_area_m2"), F.col("building_class")), 6).alias("exposed"))


@query(_with(_AT + ", " + _hit("placed"), "SELECT building_id, round(margin_m, 6) AS margin_m, round(fraction, 6) AS fraction, round(fraction * exposed, 4) AS damage FROM hit WHERE multiplier = 1.0"))
def building_damage(spark, sf_dir):
    t, stages = _stages(spark, sf_dir)
    rows = _placed(spark, sf_dir, t).where("hand IS NOT NULL").join(stages.where("multiplier = 1.0"), "reach")
    rows = rows.withColumn("margin_m", E.floor_margin(F.col("stage_m"), F.col("hand"), F.col("found_ht_m")))
    return E.estimate(rows).select("building_id", r6("margin_m"), r6("fraction"), F.round("damage", 4).alias("damage"))


@query(_with(_AT + ", " + _hit("placed"), "SELECT building_class, round(sum(fraction * exposed), 2) AS damage, round(sum(exposed), 2) AS exposed, count(*) FILTER (fraction * exposed > 0) AS hit, count(*) AS n FROM hit WHERE multiplier = 1.0 GROUP BY ROLLUP (building_class)"))
def damage_by_class(spark, sf_dir):
    t, stages = _stages(spark, sf_dir)
    rows = _placed(spark, sf_dir, t).where("hand IS NOT NULL").join(stages.where("multiplier = 1.0"), "reach")
    rows = rows.withColumn("margin_m", E.floor_margin(F.col("stage_m"), F.col("hand"), F.col("found_ht_m")))
    return E.damage_by_class(E.estimate(rows)).select("building_class", F.round("damage", 2).alias("damage"), F.round("exposed", 2).alias("exposed"), "hit", "n")


@query(_with(_AT + ", " + _hit("placed"), "SELECT multiplier, round(sum(fraction * exposed), 2) AS damage, count(*) FILTER (margin_m > 0) AS wet, sum(CASE WHEN margin_m > 0 THEN pop ELSE 0 END) AS residents, round(sum(CASE WHEN hand <= 0 THEN fraction * exposed ELSE 0 END), 2) AS in_channel FROM hit GROUP BY multiplier"))
def damage_ladder(spark, sf_dir):
    t, stages = _stages(spark, sf_dir)
    return E.damage_ladder(_placed(spark, sf_dir, t), stages).select("multiplier", F.round("damage", 2).alias("damage"), "wet", "residents", F.round("in_channel", 2).alias("in_channel"))


_PEOPLE = "SELECT (p_partkey % 50) * 23.0 AS xmin, (p_partkey % 50) * 23.0 + 23.0 AS xmax, -(p_partkey % 41) * 17.0 - 17.0 AS ymin, -(p_partkey % 41) * 17.0 AS ymax, CAST(p_size - 3 AS DOUBLE) AS pop FROM {part}"


@query(
    f"""WITH b AS ({_PEOPLE.format(part="part")}), s AS (SELECT *, unnest(range(0, 71)) AS r FROM b WHERE pop > 0),
k AS (SELECT *, unnest(range(0, 116)) AS c FROM s WHERE r * {CELLSIZE} < -ymin AND (r + 1) * {CELLSIZE} > -ymax)
SELECT CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, round(sum(pop * (least(xmax, (c + 1) * {CELLSIZE}) - greatest(xmin, c * {CELLSIZE})) * (least(-ymin, (r + 1) * {CELLSIZE}) - greatest(-ymax, r * {CELLSIZE})) / (23.0 * 17.0)), 6) AS pop
FROM k WHERE c * {CELLSIZE} < xmax AND (c + 1) * {CELLSIZE} > xmin GROUP BY ALL"""
)
def population_regrid(spark, sf_dir):
    boxes = spark.sql(_PEOPLE, part=table(spark, sf_dir, "part")).select(*[F.col(k).cast("double").alias(k) for k in ("xmin", "xmax", "ymin", "ymax", "pop")])
    return E.regrid_sum(boxes, CELLSIZE).select("r", "c", r6("pop"))


_RUNGS_AT = [0.25, 0.8, 1.7, 9.0]


@query(
    _with(
        _AT + ", " + _hit("placed") + f""", lad AS MATERIALIZED (SELECT multiplier, sum(fraction * exposed) AS damage, CAST(count(*) FILTER (margin_m > 0) AS DOUBLE) AS wet FROM hit GROUP BY multiplier),
    want(m) AS (VALUES {", ".join(f"({x})" for x in _RUNGS_AT)}), two AS (SELECT m, (SELECT max(multiplier) FROM lad WHERE multiplier <= m) AS a, (SELECT min(multiplier) FROM lad WHERE multiplier > m) AS b FROM want)""",
        "SELECT CAST(m AS DOUBLE) AS multiplier, round(coalesce(x.damage + (m - a) / (b - a) * (y.damage - x.damage), x.damage), 2) AS damage, round(coalesce(x.wet + (m - a) / (b - a) * (y.wet - x.wet), x.wet), 6) AS wet FROM two JOIN lad x ON x.multiplier = a LEFT JOIN lad y ON y.multiplier = b",
    )
)
def ladder_at(spark, sf_dir):
    t, stages = _stages(spark, sf_dir)
    rungs = E.damage_ladder(_placed(spark, sf_dir, t), stages)
    return E.ladder_at(rungs, _RUNGS_AT, ("damage", "wet")).select("multiplier", F.round("damage", 2).alias("damage"), r6("wet"))


_BOX = "SELECT p_partkey AS building_id, CAST((p_partkey * 7) % 1270 AS DOUBLE) AS xmin, CAST((p_partkey * 7) % 1270 + 5 + p_size % 13 AS DOUBLE) AS xmax, -CAST((p_partkey * 5) % 1100 + 6 + p_size % 11 AS DOUBLE) AS ymin, -CAST((p_partkey * 5) % 1100 AS DOUBLE) AS ymax FROM {part}"


@query(
    _with(
        _WET + f""", box AS ({_BOX.replace("{part}", "part")}),
    touch AS (SELECT building_id, coalesce(wet.depth_m, 0) AS depth_m, hd.hand, hd.reach FROM box JOIN dem ON dem.c BETWEEN floor(xmin / 10) AND floor(xmax / 10) AND dem.r BETWEEN -ceil(ymax / 10) AND -ceil(ymin / 10) JOIN wet ON wet.cell = dem.cell JOIN hd ON hd.cell = dem.cell WHERE (xmax - xmin) * (ymax - ymin) >= 10),
    md AS (SELECT building_id, reach FROM touch WHERE reach IS NOT NULL GROUP BY building_id, reach QUALIFY row_number() OVER (PARTITION BY building_id ORDER BY count(*) DESC, reach) = 1),
    agg AS (SELECT building_id, max(depth_m) AS a, avg(depth_m) AS b, quantile_cont(depth_m, 0.9) AS c, quantile_cont(hand, 0.1) AS d, count(*) AS n FROM touch GROUP BY building_id)""",
        "SELECT box.building_id, round(a, 6) AS depth_max, round(b, 6) AS depth_mean, round(c, 6) AS depth_p90, round(d, 6) AS hand_p10, md.reach, n AS n_cells FROM box LEFT JOIN agg ON agg.building_id = box.building_id LEFT JOIN md ON md.building_id = box.building_id WHERE (xmax - xmin) * (ymax - ymin) >= 10",
    )
)
def zonal_depth(spark, sf_dir):
    t, _, wet = _wet(spark, sf_dir)
    cells = t.raw.select("cell", "r", "c").join(wet.select("cell", "depth_m"), "cell").join(t.hand.select("cell", "hand", "reach"), "cell").select("r", "c", "depth_m", "hand", "reach")
    boxes = spark.sql(_BOX, part=table(spark, sf_dir, "part"))
    return E.zonal(boxes, cells, CELLSIZE).select("building_id", r6("depth_max"), r6("depth_mean"), r6("depth_p90"), r6("hand_p10"), "reach", "n_cells")


@query(_with(_WET + ", p AS (SELECT wet.cell, wet.depth_m, wet.cell % 5 AS pop FROM wet)", "SELECT CAST(sum(pop) AS DOUBLE) AS total, CAST(sum(CASE WHEN depth_m >= 0.3 THEN pop ELSE 0 END) AS DOUBLE) AS affected, round(sum(CASE WHEN depth_m >= 0.3 THEN pop ELSE 0 END) / sum(pop), 6) AS share FROM p"))
def population_affected(spark, sf_dir):
    wet = _wet(spark, sf_dir)[2]
    return E.population_affected(wet.withColumn("pop", (F.col("cell") % 5).cast("double"))).select("total", "affected", r6("share"))


# Validation and display.


@query(
    _with(
        _WET + ", p AS (SELECT coalesce(wet.depth_m, 0) > 0.05 AS m, dem.cell % 3 = 0 AS t FROM dem JOIN wet ON wet.cell = dem.cell)",
        """SELECT count(*) FILTER (m AND t) AS hits, count(*) FILTER (NOT m AND t) AS misses, count(*) FILTER (m AND NOT t) AS false_alarms, count(*) FILTER (NOT m AND NOT t) AS correct_negatives,
    round(count(*) FILTER (m AND t) / nullif(count(*) FILTER (m OR t), 0), 6) AS csi, round(count(*) FILTER (m AND t) / nullif(count(*) FILTER (t), 0), 6) AS hit_rate,
    round(count(*) FILTER (m AND NOT t) / nullif(count(*) FILTER (m), 0), 6) AS far, round(count(*) FILTER (m) / nullif(count(*) FILTER (t), 0), 6) AS bias FROM p""",
    )
)
def extent_scores(spark, sf_dir):
    wet = _wet(spark, sf_dir)[2]
    pairs = wet.select((F.coalesce("depth_m", F.lit(0.0)) > 0.05).alias("model"), (F.col("cell") % 3 == 0).alias("reference"))
    return V.extent_metrics(pairs).select("hits", "misses", "false_alarms", "correct_negatives", r6("csi"), r6("hit_rate"), r6("far"), r6("bias"))


_MARKS = f"marks AS ({sql_text('marks')})"


@query(
    _with(
        _WET + f", {_MARKS}, s AS (SELECT marks.mark_id, dem.z AS ground, CASE WHEN wet.depth_m > 0 THEN dem.z + wet.depth_m END AS surface, dem.z + marks.depth_m AS observed FROM marks JOIN dem ON dem.cell = marks.cell JOIN wet ON wet.cell = dem.cell WHERE quality IN (1, 2) AND coalesce(lower(environment), '') <> 'coastal'), e AS (SELECT *, coalesce(surface, ground) - observed AS e FROM s)",
        "SELECT count(*) AS n, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS bias, round(median(abs(e)), 6) AS median_abs, round(avg(CASE WHEN surface IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS recall FROM e",
    )
)
def mark_scores(spark, sf_dir):
    t, _, wet = _wet(spark, sf_dir)
    marks = V.scorable_marks(view(spark, sf_dir, "marks")).join(t.raw.select("cell", "z"), "cell").join(wet.select("cell", F.col("depth_m").alias("water")), "cell")
    scored = marks.select(F.when(F.col("water") > 0, F.col("z") + F.col("water")).alias("surface_m"), F.col("z").alias("ground_m"), (F.col("z") + F.col("depth_m")).alias("observed_m"))
    return V.mark_metrics(scored).select("n", r6("rmse"), r6("bias"), r6("median_abs"), r6("recall"))


_RANKS = "SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM p"


@query(f"WITH p AS (SELECT CAST(l_quantity AS DOUBLE) AS x, round(l_extendedprice / 1000) AS y FROM lineitem), r AS ({_RANKS}) SELECT round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r")
def rank_correlation(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.round(F.col("l_extendedprice") / 1000).alias("y"))
    return V.spearman(pairs, "x", "y").select(r6("rho"), "n")


_TRACTS = """model AS (SELECT c_nationkey AS tract, sum(o_totalprice) AS modelled, count(*) FILTER (o_orderstatus = 'F') AS wet FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey),
claims AS (SELECT c_nationkey AS tract, sum(c_acctbal) AS paid, count(*) AS claims FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_acctbal > 0 GROUP BY c_nationkey),
aid AS (SELECT s_nationkey AS tract, sum(s_acctbal) AS aid FROM supplier WHERE s_acctbal > 0 GROUP BY s_nationkey)"""


@query(f"WITH {_TRACTS} SELECT model.tract, round(modelled, 2) AS modelled, wet, round(coalesce(paid, 0), 2) AS paid, coalesce(claims, 0) AS claims, round(coalesce(aid, 0), 2) AS aid FROM model LEFT JOIN claims ON claims.tract = model.tract LEFT JOIN aid ON aid.tract = model.tract WHERE modelled > 0")
def tract_comparison(spark, sf_dir):
    orders, customer, supplier = (table(spark, sf_dir, n) for n in ("orders", "customer", "supplier"))
    model = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("tract")).agg(F.sum("o_totalprice").alias("modelled"), F.count_if(F.col("o_orderstatus") == "F").alias("wet"))
    claims = customer.where("c_mktsegment <> 'BUILDING' AND c_acctbal > 0").groupBy(F.col("c_nationkey").alias("tract")).agg(F.sum("c_acctbal").alias("paid"), F.count("*").alias("claims"))
    aid = supplier.where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("tract")).agg(F.sum("s_acctbal").alias("aid"))
    two = lambda c: F.round(c, 2).alias(c)
    return V.compare_tracts(model, claims, aid).select("tract", two("modelled"), "wet", two("paid"), "claims", two("aid"))


@query("SELECT round(list_sort(list(l_extendedprice / l_quantity))[CAST(floor(count(*) / 2) AS INT) + 1], 6) AS median, count(*) AS n FROM lineitem WHERE l_quantity > 0")
def ratio_median(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_quantity > 0")
    return V.upper_median(rows, F.col("l_extendedprice") / F.col("l_quantity")).select(r6("median"), "n")


@query(f"WITH {_DEM} SELECT CAST(floor(r / 4) AS INT) AS r, CAST(floor(c / 4) AS INT) AS c, round(avg(z), 6) AS v FROM dem WHERE r < (SELECT max(r) + 1 FROM dem) // 4 * 4 AND c < 128 GROUP BY ALL".replace("WITH dem AS MATERIALIZED", "WITH RECURSIVE dem AS MATERIALIZED"))
def block_mean(spark, sf_dir):
    cells = view(spark, sf_dir, "dem").withColumn("value", F.col("z"))
    rows = cells.agg(F.max("r").alias("r")).first()["r"] + 1
    return V.block_reduce(cells, 4, "mean", rows, COLS).select("r", "c", r6("v"))


@query(f"WITH {_DEM} SELECT CAST(floor(r / 5) AS INT) AS r, CAST(floor(c / 5) AS INT) AS c, max(z) AS highest, round(sum(z), 6) AS total FROM dem WHERE r < (SELECT max(r) + 1 FROM dem) // 5 * 5 AND c < 125 GROUP BY ALL".replace("WITH dem AS MATERIALIZED", "WITH RECURSIVE dem AS MATERIALIZED"))
def block_extremes(spark, sf_dir):
    cells = view(spark, sf_dir, "dem").withColumn("value", F.col("z"))
    rows = cells.agg(F.max("r").alias("r")).first()["r"] + 1
    high, total = (V.block_reduce(cells, 5, how, rows, COLS) for how in ("max", "sum"))
    return high.withColumnRenamed("v", "highest").join(total, ["r", "c"]).select("r", "c", "highest", r6("v").alias("total"))


@query(f"""WITH b AS ({sql_text("buildings")}), g AS (SELECT CAST(floor(cell / {COLS} / 8) AS INT) AS r, CAST(floor(cell % {COLS} / 8) AS INT) AS c, sum(value) AS damage, count(*) AS n FROM b GROUP BY ALL)
    SELECT r, c, round(damage, 2) AS damage, n, CASE WHEN damage >= 1000 THEN CAST(round_even(1 + (log10(least(damage, 1e8)) - 3) / 5 * 254, 0) AS INT) ELSE 0 END AS shade FROM g""")
def damage_raster(spark, sf_dir):
    b = view(spark, sf_dir, "buildings")
    points = b.select((F.col("cell") % COLS + 0.5).alias("x"), (-F.floor(F.col("cell") / COLS) - 0.5).alias("y"), F.col("value").alias("damage"))
    return V.damage_layer(V.rasterise_damage(points, 8.0)).select("r", "c", F.round("damage", 2).alias("damage"), "n", "shade")


@query(_with(_HAND, "SELECT cell, CASE WHEN hand IS NULL THEN 255 ELSE CAST(floor(least(greatest(hand * 10, 0), 254)) AS INT) END AS hand_byte, coalesce(reach, 65535) // 256 AS high, coalesce(reach, 65535) % 256 AS low FROM hd"))
def display_layers(spark, sf_dir):
    from freshet.functions.scalar import hand_byte, pack_u16

    high, low = pack_u16(F.col("reach"))
    return terrain(spark, sf_dir).hand.select("cell", hand_byte(F.col("hand")).alias("hand_byte"), high.cast("long").alias("high"), low.cast("long").alias("low"))


@query(
    """SELECT CAST(l_orderkey AS BIGINT) AS cell, arg_min(CASE WHEN l_quantity > 10 THEN CAST(l_quantity AS DOUBLE) END, CASE WHEN l_quantity > 10 THEN l_linenumber * 1000 + l_quantity END) AS z
    FROM lineitem GROUP BY l_orderkey"""
)
def mosaic(spark, sf_dir):
    tiles = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("cell"), (F.col("l_linenumber") * 1000 + F.col("l_quantity")).alias("ord"), F.when(F.col("l_quantity") > 10, F.col("l_quantity").cast("double")).otherwise(float("nan")).alias("z"))
    return V.first_valid(tiles)


@query(
    """WITH f AS (SELECT o_orderkey AS path, o_orderdate AS mtime, CAST(o_totalprice AS BIGINT) AS size, o_orderpriority AS unit FROM orders)
    SELECT path, unit FROM f QUALIFY sum(size) OVER (PARTITION BY unit ORDER BY mtime DESC, path ROWS UNBOUNDED PRECEDING) > 5000000"""
)
def cache_eviction(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("mtime"), F.round("o_totalprice").cast("long").alias("size"), F.col("o_orderpriority").alias("unit"))
    return V.evict_to_budget(files, 5_000_000).select("path", "unit")


@query("SELECT user_id AS site, date_trunc('hour', ts) AS start, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS peak FROM events GROUP BY ALL")
def gauge_windows(spark, sf_dir):
    return G.windowed(view(spark, sf_dir, "gauge")).select("site", "start", "n", r6("mean"), "peak")


_LATE = "INTERVAL 10 MINUTE"


@query(
    f"""WITH span AS (SELECT min(epoch_us(ts)) AS low, max(epoch_us(ts)) AS high FROM events),
    e AS (SELECT least(2, (epoch_us(ts) - low) * 3 // (high - low + 1) + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END) AS part, user_id AS site, ts, value, date_trunc('hour', ts) AS start FROM events, span), w AS (SELECT max(ts) FILTER (part = 0) - {_LATE} AS one, max(ts) FILTER (part < 2) - {_LATE} AS two, max(ts) - {_LATE} AS three FROM e)
    SELECT site, start, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS peak FROM e, w WHERE (part = 0 OR start + INTERVAL 1 HOUR > CASE part WHEN 1 THEN one ELSE two END) AND start + INTERVAL 1 HOUR <= three GROUP BY site, start"""
)
def gauge_windows_streamed(spark, sf_dir):
    """Windows that a stream closes. The readings land in three parts of the time, a tenth of them a part too late, and the stream is resumed
    after each: the watermark of the parts before says what of the next is late."""
    events = table(spark, sf_dir, "events")
    out = f"{shared_dir(spark)}/freshet/gauges-{uuid.uuid4().hex}"
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(us), F.max(us)).first()
    part = F.least(F.lit(2), F.floor((us - low) * 3 / (high - low + 1)) + (F.col("event_id") % 10 == 0).cast("int"))
    for k in range(3):
        events.where(part == k).write.mode("append").parquet(f"{out}/in")
        source = spark.readStream.schema(events.schema).parquet(f"{out}/in")
        rows = source.select(F.col("user_id").cast("long").alias("site"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
        writer = G.windowed(rows).writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/log")
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/data").select("site", "start", "n", r6("mean"), "peak")
