"""Two-level filling and flats beyond the size that one task solves, polygons of many rings, stored tables, rules of comparison."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from freshet.operators import curves as C
from freshet.operators import exposure as E
from freshet.operators import scan
from freshet.operators import spatial as S
from freshet.operators import terrain as T
from freshet.operators import validation as V
from freshet.operators.tiles import OUTSIDE, least_steps, spill_levels
from freshet.sources import raster as R
from freshet.sources import tiled as L
from tests.test_terrain import filled, frame, grid


@pytest.mark.parametrize("at_once", [0, 6])
def test_fill_by_rounds_equals_the_minimax_level(spark, at_once):
    cells = grid(4, rows=12, cols=13)
    got = {(x.r, x.c): x.w for x in T.fill_depressions(frame(spark, cells, 13), size=4, at_once=at_once).collect()}
    assert got == filled(cells)


def test_spill_levels_of_a_chain_and_of_equal_edges(spark):
    rows = [(OUTSIDE, 1, 5.0), (1, 2, 3.0), (2, 3, 9.0), (3, 4, 1.0), (4, 1, 9.0), (7, 8, 2.0)]
    df = spark.createDataFrame(rows, "u long, v long, w double")
    for at_once in (0, 2, 100):
        got = {x.node: x.level for x in spill_levels(df, at_once).collect() if x.node in (1, 2, 3, 4)}
        assert got == {1: 5.0, 2: 5.0, 3: 9.0, 4: 9.0}


def test_steps_between_borders_at_once_and_in_rounds(spark):
    nodes = spark.createDataFrame([(k, 100 if k else 1, 50) for k in range(12)], "node long, high long, low long")
    edges = spark.createDataFrame([(k, k + 1, 2) for k in range(11)] + [(0, 11, 5)], "u long, v long, d long")
    want = {k: (min(1 + 2 * k, 6 + 2 * (11 - k)), 50) for k in range(12)}
    for at_once in (0, 1000):
        assert {x.node: (x.high, x.low) for x in least_steps(nodes, edges, ["high", "low"], at_once).collect()} == want


@pytest.mark.parametrize(("size", "at_once"), [(6, 10**6), (6, 0), (64, 10**6)])
def test_a_flat_over_four_tiles_drains_alike(spark, size, at_once):
    cells = {(r, c): 30.0 if r in (0, 12) or c in (0, 12) else 20.0 for r in range(13) for c in range(13)} | {(0, 6): 19.0}
    directed = T.flow_direction(frame(spark, cells, 13), size=size)
    got = {(x.r, x.c): (x.flowdir, x.flat, x.resolved) for x in T.resolve_flats(directed, size=size, at_once=at_once).collect()}
    whole = {(x.r, x.c): (x.flowdir, x.flat, x.resolved) for x in T.resolve_flats(T.flow_direction(frame(spark, cells, 13)), size=64).collect()}
    assert got == whole and all(done for _, flat, done in got.values() if flat) and sum(flat for _, flat, _ in got.values()) > 100
    steps = T.steps_to_outlet(T.receivers(T.resolve_flats(directed, size=size, at_once=at_once), 13)).agg(F.max("steps")).first()[0]
    assert steps < 40  # no cycles, and everything drains


def test_burned_channel_widens_beside_wide_cells_only(spark):
    cells = {(r, c): 10.0 for r in range(7) for c in range(5)}
    streams = spark.createDataFrame([(3 * 5 + c, 1e6) for c in range(5)], "cell long, accumulation double")
    got = T.burn_channel(frame(spark, cells, 5), streams, 1.0, depth=(1.0, 0.0), width=(6.8, 0.0)).collect()
    assert {x.r for x in got if x.burned < 10} == {2, 3, 4} and all(x.burned == 9.0 for x in got if x.r in (2, 3, 4))


def square(x, y, s):
    return f"[[{x},{y}],[{x + s},{y}],[{x + s},{y + s}],[{x},{y + s}],[{x},{y}]]"


def test_multipolygons_and_holes_are_kept(spark):
    text = f"""{{"features": [
        {{"type": "Feature", "properties": {{"huc": "a"}}, "geometry": {{"type": "MultiPolygon", "coordinates": [[{square(0, 0, 2)}], [{square(5, 0, 1)}]]}}}},
        {{"type": "Feature", "properties": {{"huc": "b"}}, "geometry": {{"type": "Polygon", "coordinates": [{square(0, 0, 2)}, {square(0.5, 0.5, 1)}]}}}},
        {{"type": "Feature", "properties": {{"huc": "c"}}, "geometry": {{"type": "Point", "coordinates": [1, 2]}}}}]}}"""
    units = S.units_of(spark.createDataFrame([(text,)], "json string"))
    assert [(r.properties["huc"], r.area, len(r.rings)) for r in units.collect()] == [("a", 5.0, 2), ("b", 3.0, 2)]
    named = units.select(F.col("properties.huc").alias("unit"), "rings", "parts")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.5, 0.5), (3, 0.25, 1.0), (4, 3.0, 0.5), (5, 2.0, 1.0), (6, 0.5, 1.0)], "id int, x double, y double")
    for block in (0.7, 3.0, 100.0):
        inside = sorted((r.id, r.unit) for r in S.points_in_units(points, named, block).collect())
        assert inside == [(1, "a"), (2, "a"), (3, "a"), (3, "b"), (6, "a")]
        edges = {(r.id, r.unit) for r in S.points_in_units(points, named, block, True).collect()} - set(inside)
        assert edges == {(5, "a"), (5, "b"), (6, "b")}
    back = S.units_of(S.as_geojson(named, ["unit"]).select(F.concat(F.lit('{"features": ['), "feature", F.lit("]}")).alias("json")))
    assert sorted(r.area for r in back.collect()) == [3.0, 5.0]
    assert S.unit_of_point(named, 0.25, 1.9).first().unit == "a" and S.unit_of_point(named, 1.0, 1.0).first().unit == "a"


def test_spans_equal_points_for_any_polygon(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(12):
        at, n = rng.uniform(0, 200, 2), int(rng.integers(3, 9))
        turn = np.sort(rng.uniform(0, 2 * math.pi, n))
        far = rng.uniform(20, 90, n)
        rows.append((k, [[(float(at[0] + f * math.cos(a)), -float(at[1] + f * math.sin(a))) for a, f in zip(turn, far, strict=True)]]))
    units = spark.createDataFrame(rows, "unit int, rings array<array<struct<x: double, y: double>>>")
    cells = spark.range(30 * 30).select(F.col("id").alias("cell"), F.floor(F.col("id") / 30).cast("int").alias("r"), (F.col("id") % 30).cast("int").alias("c"))
    centres = cells.select("cell", ((F.col("c") + 0.5) * 10).alias("x"), (-(F.col("r") + 0.5) * 10).alias("y"))
    spans = {(r.unit, r.cell) for r in S.geometry_mask(cells, units, 10.0).collect()}
    plain = {(r.unit, r.cell) for r in S.points_in_units(centres, units, 35.0).collect()}

    def holds(ring, x, y):
        return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) % 2 == 1

    want = {(k, r * 30 + c) for k, (ring,) in rows for r in range(30) for c in range(30) if holds(ring, (c + 0.5) * 10, -(r + 0.5) * 10)}
    assert spans == want == plain and len(want) > 200


def test_undefined_depths_count_nothing_and_centres_keep_their_cell(spark):
    cells = spark.createDataFrame([(0, 0, 2.0, 1.0, 5), (0, 1, None, None, None), (1, 0, math.nan, 3.0, 6)], "r int, c int, depth_m double, hand double, reach int")
    box = spark.createDataFrame([(1, 2.0, -18.0, 18.0, -2.0, 0.5)], "building_id int, xmin double, ymin double, xmax double, ymax double, found_ht_m double")
    z = E.zonal(box, cells, 10.0, shape=(2, 2)).first()
    assert (z.depth_max, z.depth_mean, z.depth_p90, z.n_cells) == (2.0, 0.5, pytest.approx(1.4), 4)
    d = E.building_depths(box, cells, 10.0, 2, 2, statistic="centroid").first()
    assert (d.depth_m, d.hand_m, d.reach_id) == (0.0, math.inf, -1)
    d = E.building_depths(box, cells.withColumn("unclamped", F.col("hand") * -1), 10.0, 2, 2).first()
    assert d.floor_margin_m == pytest.approx(-1.5)


def test_tract_scores_take_tracts_of_both_series(spark):
    rows = [("a", 10.0, 1, 5.0, 1, 1.0), ("b", 20.0, 1, 4.0, 1, 2.0), ("c", 30.0, 1, 6.0, 1, 3.0), ("d", 5.0, 1, 0.0, 0, 9.0), ("e", 50.0, 1, 7.0, 2, 0.0)]
    tracts = spark.createDataFrame(rows, "tract string, modelled double, wet long, paid double, claims long, aid double")
    s = V.tract_scores(tracts, tracts.select("tract", "paid", "claims"), tracts.select("tract", "aid")).first()
    assert (s.n_modelled, s.n_both, s.rho_paid_aid, s.rho_paid, s.rho_aid) == (5, 3, pytest.approx(0.5), pytest.approx(0.5), pytest.approx(1.0))
    assert (s.ratio_paid, s.ratio_aid, s.paid_total, s.claims_total, s.aid_total) == (5.0, 10.0, 22.0, 5, 15.0)


def test_claims_are_held_against_numbers_of_buildings(spark):
    claims = spark.createDataFrame([(1, 100, 5e6), (2, 10, 1e6)], "huc int, claims long, paid double")
    intervals = spark.createDataFrame([(1, 40, 60, 90, 2e7), (2, 5, 20, 40, 3e6), (3, 1, 2, 3, 1.0)], "huc int, low int, modelled int, high int, damage double")
    got = {r.huc: (r.claims, r.ratio, r.damage_ratio, r.inside, r.model_below_claims) for r in V.against_interval(claims, intervals, "huc").collect()}
    assert got == {1: (100, 0.6, 4.0, False, True), 2: (10, 2.0, 3.0, True, False), 3: (0, None, None, False, False)}


def test_ladder_equals_the_damage_of_each_building(spark):
    rng = np.random.default_rng(6)
    classes = ["residential", "COM4", "RES1-1SNB", "industrial", "barn"]
    rows = [(i, int(rng.integers(0, 4)), float(rng.uniform(-1, 4)), 0.3, float(rng.integers(1, 5)), 100.0 + i, float(i % 3), classes[i % 5]) for i in range(60)] + [(99, None, 1.0, 0.0, 1.0, 5.0, 1.0, "x")]
    b = spark.createDataFrame(rows, "building_id int, reach int, hand double, found_ht_m double, storeys double, floor_area_m2 double, pop double, building_class string")
    stages = spark.createDataFrame([(k, m, m * (k + 1)) for k in range(4) for m in (0.0, 0.5, 1.0, 2.5)], "reach int, multiplier double, stage_m double")
    one = E.estimate(b.where("reach IS NOT NULL").join(stages, "reach").withColumn("margin_m", E.floor_margin(F.col("stage_m"), F.col("hand"), F.col("found_ht_m"))))
    want = {r.multiplier: (r.d, r.w) for r in one.groupBy("multiplier").agg(F.sum("damage").alias("d"), F.count_if(F.col("margin_m") > 0).alias("w")).collect()}
    got = {r.multiplier: (pytest.approx(r.damage), r.wet) for r in E.damage_ladder(b, stages).collect()}
    assert got == want


def test_clamped_depths_are_refused_where_damage_is_priced(spark):
    curve = spark.createDataFrame([("F", "residential", "structure", [-0.6, 0.0, 3.0], [0.0, 0.1, 0.6], [0.0] * 3, True)], C.SCHEMA)
    rows = spark.createDataFrame([(1, 0.0, "residential", 1.0, 50.0), (2, 1.0, "residential", 1.0, 50.0)], "building_id int, margin_m double, building_class string, storeys double, floor_area_m2 double")
    with pytest.raises(ValueError, match="signed margins"):
        C.priced(rows, curve, "F")


def test_implied_discharge_is_the_best_rung_that_wets_enough(spark):
    marks = spark.createDataFrame([(1, 0.0, 10.0, 12.0), (1, 1.0, 11.0, 12.0), (None, None, 5.0, 5.0)], "reach int, hand double, ground_m double, observed_m double")
    stages = spark.createDataFrame([(1, m, m) for m in (0.0, 1.0, 2.0, 3.0)], "reach int, multiplier double, stage_m double")
    got = {r.multiplier: (r.n, round(r.rmse, 6), round(r.wet, 3), r.chosen) for r in V.implied_discharge(marks, stages, 0.6).collect()}
    assert got[2.0] == (3, 0.0, 0.667, True) and [m for m, r in got.items() if r[3]] == [2.0]
    assert not any(r.chosen for r in V.implied_discharge(marks, stages, 0.9).collect())


def test_windows_read_the_files_of_their_tiles_only(spark, tmp_path):
    path = f"file://{tmp_path}/cells"
    cells = spark.range(64 * 64).select(F.col("id").alias("cell"), F.floor(F.col("id") / 64).cast("int").alias("r"), (F.col("id") % 64).cast("int").alias("c"))
    L.store_cells(cells, path, 16)
    window = L.stored_window(spark, path, (5, 20), (17, 30), 16)
    assert sorted(r.cell for r in window.collect()) == [r * 64 + c for r in range(5, 20) for c in range(17, 30)]
    files = {r.f for r in window.select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(files) == 2 and all("/tc=1/" in f for f in files) and len(L.files_under(spark, path, 2)) == 16
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tr" in plan and "PushedFilters: [IsNotNull(r)" in plan


def test_a_unit_is_replaced_by_content_and_others_stay(spark, tmp_path):
    path = f"file://{tmp_path}/units"
    for unit in ("a", "b"):
        assert L.replace_unit(spark, path, spark.createDataFrame([(1, 2.0), (2, 3.0)], "id int, v double"), unit)
    before = L.files_under(spark, path)
    assert not L.replace_unit(spark, path, spark.createDataFrame([(2, 3.0), (1, 2.0)], "id int, v double"), "a")
    assert L.files_under(spark, path) == before
    assert L.replace_unit(spark, path, spark.createDataFrame([(1, 2.0), (2, 4.0)], "id int, v double"), "a")
    after = L.files_under(spark, path)
    assert {f: t for f, t in before.items() if "unit=b" in f}.items() <= after.items()
    assert sorted((r.unit, r.v) for r in spark.read.parquet(path).collect()) == [("a", 2.0), ("a", 4.0), ("b", 2.0), ("b", 3.0)]


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    from freshet.streaming.gauges import extents

    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for step in (1.0, 2.0):
        spark.createDataFrame([(k, step, step + k) for k in range(3)], "reach int, step double, stage_m double").coalesce(1).write.mode("append").parquet(source)
    extent = lambda s: s.select(F.col("reach").alias("cell"), F.col("stage_m").alias("depth_m"), F.lit(True).alias("connected"))

    def run(checkpoint):
        stream = spark.readStream.schema("reach int, step double, stage_m double").option("maxFilesPerTrigger", 1).parquet(source)
        extents(stream, extent, out, f"file://{tmp_path}/{checkpoint}").awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(out).select("step", "cell", "depth_m").collect())

    first = run("one")
    assert first == [(s, k, s + k) for s in (1.0, 2.0) for k in range(3)] and run("two") == first


def test_functions_in_sql_texts(spark):
    from freshet.functions.sql import register

    register(spark)
    assert spark.sql("SELECT water_year(DATE '1994-10-18') AS y, utm_srid(-95.4, 29.8) AS s").first() == (1995, 26915)
    assert [(r.code, r.r, r.c) for r in spark.sql("SELECT code, r, c FROM d8_neighbours(5, 7) ORDER BY code").collect()][:3] == [(1, 5, 8), (2, 6, 8), (4, 6, 7)]
    assert spark.sql("SELECT count(*) AS n FROM cells_of_box(2.1D, -18.9D, 12.9D, -8.1D, 10.0D)").first().n == 4


def test_landed_pages_keep_the_fields(spark):
    page = '{"features": [{"properties": {"fd_id": "7", "sqft": 2000, "ftprntsqft": 1200, "cbfips": "10010201001", "val_struct": 300000, "found_ht": 1, "other": 1}, "geometry": {"coordinates": [-95.4, 29.8]}}, {"properties": {}, "geometry": null}]}'
    (row,) = L.inventory(spark.createDataFrame([(page,)], "value string")).collect()
    assert (row.fd_id, row.lon, row.lat, row.val_struct) == ("7", -95.4, 29.8, 300000.0)
    assert row.footprint_m2 == pytest.approx(1200 * 0.092903) and row.found_ht_m == pytest.approx(0.3048) and row.tract_fips == "00001001020" and row.num_story == 1.0


def test_lookups_refuse_what_would_find_nothing(spark):
    from freshet.operators import report as P

    catalogue = spark.createDataFrame([(P.PRODUCTS[10], f"t{k}", float(k), 0.0, k + 1.0, 1.0) for k in range(5)], "dataset string, path string, xmin double, ymin double, xmax double, ymax double")
    assert [r.path for r in P.tiles_found(catalogue, 10, (0.5, 0.2, 2.5, 0.8)).collect()] == ["t0", "t1", "t2"]
    for resolution, box in ((7, (0.0, 0.0, 1.0, 1.0)), (10, (90.0, 0.0, 91.0, 1.0)), (1, (0.0, 0.0, 1.0, 1.0))):
        with pytest.raises(ValueError, match="m"):
            P.tiles_found(catalogue, resolution, box)
    assert P.planned(catalogue, 0.5, 10).first() == (5, 20, True)
    units = spark.createDataFrame([("0101", 4), ("01", 2)], "huc string, level int")
    assert P.unit_by_code(units, "0101").first().level == 4
    for code in ("010", "x1", "99", ""):
        with pytest.raises(ValueError, match="code"):
            P.unit_by_code(units, code)


def test_history_says_where_an_event_stands(spark):
    from freshet.operators import report as P

    peaks = spark.createDataFrame([(1, f"{1930 + i}-05-15", 100 * math.exp(0.35 * math.sin(i) + 0.02 * i)) for i in range(60)], "site int, date string, cms double")
    events = spark.createDataFrame([(1, 1000.0), (1, 200.0)], "site int, discharge_cms double")
    above = {r.discharge_cms: r for r in P.gauge_history(peaks, events.where("discharge_cms = 1000")).collect() + P.gauge_history(peaks, events.where("discharge_cms = 200")).collect()}
    assert above[1000.0].exceeds_record and above[1000.0].rank == 1 and above[1000.0].empirical_years == 61.0 and above[1000.0].larger_floods == []
    low = above[200.0]
    top = sorted((r.cms, r.date) for r in peaks.collect())[::-1]
    assert not low.exceeds_record and len(low.larger_floods) == 5 and [(f.cms, f.date) for f in low.larger_floods] == [(round(c), d) for c, d in top[:5]] and low.larger_floods[0].water_year == int(top[0][1][:4])


def test_payload_is_one_row_and_counts_what_was_removed(spark):
    from freshet.operators import report as P

    extent = spark.createDataFrame([(1, 2.0, True), (2, 0.0, False), (3, None, False)], "cell long, depth_m double, connected boolean")
    catchments = spark.createDataFrame([(1, 1.0, 5), (2, 1.5, 5), (3, None, None)], "cell long, hand double, reach int")
    removed = P.removed_cells(catchments, spark.createDataFrame([(5, 3.0)], "reach int, stage_m double"), extent)
    depths = spark.createDataFrame([(0.0,), (1.0,)], "floor_depth_m double")
    classes = spark.createDataFrame([(f"k{i}", float(i)) for i in range(12)], "building_class string, damage double")
    (row,) = P.payload("00", 400.0, 10.0, extent, depths, classes.agg(F.sum("damage").alias("damage")), classes, removed).collect()
    assert (row.flooded_km2, row.max_depth_m, row.buildings, row.inundated, row.damage, row.removed) == (1e-4, 2.0, 2, 1, 66.0, 1)
    assert row.top_classes == [f"k{i}" for i in range(11, 3, -1)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def squares(spark, n):
    ring = lambda k: [(0.0 + k, -1.0), (30.0 + k, -1.0), (30.0 + k, -31.0), (0.0 + k, -31.0)]
    return spark.createDataFrame([(k, ring(7 * (k % 3))) for k in range(n)], "unit int, ring array<struct<x: double, y: double>>")


def test_cells_of_units_are_never_broadcast(spark, tmp_path):
    squares(spark, 9).write.parquet(f"{tmp_path}/units")
    units = spark.read.parquet(f"{tmp_path}/units")
    cells = spark.range(36).select(F.col("id").alias("cell"), F.floor(F.col("id") / 6).cast("int").alias("r"), (F.col("id") % 6).cast("int").alias("c"))
    mask = S.geometry_mask(cells, units, 10.0)
    assert mask.count() == 9 * 9
    assert "BroadcastHashJoin" not in plan_of(mask)


def test_ingest_never_broadcasts_cells_of_units(spark, tmp_path):
    squares(spark, 9).write.parquet(f"{tmp_path}/units")
    units = spark.read.parquet(f"{tmp_path}/units")
    tiles = spark.range(36).select(F.lit("a").alias("path"), F.col("id").alias("cell"), F.floor(F.col("id") / 6).cast("int").alias("r"), (F.col("id") % 6).cast("int").alias("c"), F.lit(1.0).alias("z"))
    got = R.ingested(tiles, spark.createDataFrame([("a", 0)], "path string, ord int"), units, 10.0)
    assert got.count() == 9 * 9
    assert "BroadcastHashJoin" not in plan_of(got)


def test_warped_ingest_never_broadcasts_cells_of_units(spark, tmp_path):
    squares(spark, 9).write.parquet(f"{tmp_path}/units")
    units = spark.read.parquet(f"{tmp_path}/units")
    grid = spark.range(36).select(F.col("id").alias("cell"), F.floor(F.col("id") / 6).cast("int").alias("r"), (F.col("id") % 6).cast("int").alias("c"))
    tiles = spark.range(10000).select(F.lit("a").alias("path"), F.floor(F.col("id") / 100).cast("int").alias("r"), (F.col("id") % 100).cast("int").alias("c"), F.lit(1.0).alias("z"))
    frames = spark.createDataFrame([("a", 0, -95.0, 30.0, 0.0001, 100, 100)], "path string, ord int, west double, north double, step double, rows int, cols int")
    got = R.warped_ingest(tiles, frames, grid, units, 10.0, 15, 307000.0, 3320400.0)
    assert got.count() == 9 * 9
    assert not re.search(r"BroadcastHashJoin \[r#\d+, c#\d+\], \[r#\d+, c#\d+\], (Inner|LeftSemi)", plan_of(got))  # the tiles read may be small


def test_points_meet_blocks_without_broadcast_and_copies_are_listed_in_full(spark, tmp_path):
    squares(spark, 9).write.parquet(f"{tmp_path}/units")
    units = spark.read.parquet(f"{tmp_path}/units")
    points = spark.createDataFrame([(k, None if k == 11 else 0.5 + k % 4 * 10.0, -5.0) for k in range(12)], "id int, x double, y double")
    for boundary in (False, True):
        got = S.points_in_units(points, units, 16.0, boundary)
        want = sorted((k, u) for k in range(11) for u in range(9) if 7 * (u % 3) < 0.5 + k % 4 * 10 < 30 + 7 * (u % 3))
        assert sorted((x.id, x.unit) for x in got.select("id", "unit").collect()) == want
        assert "BroadcastHashJoin" not in plan_of(got)


def test_pieces_of_lists_that_meet_are_bounded_and_none_is_lost(spark, tmp_path, monkeypatch):
    kept = {}
    monkeypatch.setattr(scan, "written", lambda df, name, write=scan.written: kept.setdefault(name, write(df, name)))
    copies, alike = 600, 300
    units = squares(spark, 1).select(F.explode(F.sequence(F.lit(0), F.lit(alike - 1))).alias("unit"), "ring")
    points = spark.range(copies).select("id", F.lit(9.5).alias("x"), F.lit(-5.0).alias("y"))
    got = S.points_in_units(points, units, 16.0)
    longest = lambda df, c: df.agg(F.max(F.size(c))).first()[0]
    assert longest(kept["places"], "copies_") <= 256 and kept["places"].agg(F.sum(F.size("copies_"))).first()[0] == copies
    assert got.count() == got.distinct().count() == copies * alike
    assert {(x.x, x.y) for x in got.select("x", "y").distinct().collect()} == {(9.5, -5.0)}


def test_only_places_and_shapes_of_very_many_rows_have_several_lists(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(scan, "written", lambda df, name, write=scan.written: kept.setdefault(name, write(df, name)))
    monkeypatch.setattr(scan, "COPIES", 8)
    units = squares(spark, 1).select(F.explode(F.sequence(F.lit(0), F.lit(19))).alias("unit"), "ring").unionByName(squares(spark, 2).where("unit = 1").withColumn("unit", F.lit(20)))
    points = spark.range(48).select("id", F.when(F.col("id") < 40, 9.5).otherwise(F.col("id") - 29.5).alias("x"), F.lit(-5.0).alias("y"))
    got = S.points_in_units(points, units, 16.0).select("id", "unit")
    assert sorted(map(tuple, got.collect())) == [(k, u) for k in range(48) for u in range(21)]
    lists = {r.x: r.n for r in kept["places"].groupBy("x").agg(F.count("*").alias("n")).collect()}
    assert 1 < lists.pop(9.5) <= 5 and set(lists.values()) == {1} and len(lists) == 8
    sizes = sorted(r.n for r in kept["shapes"].select(F.size("units_").alias("n")).collect())
    assert sum(sizes) == 21 and 1 < len(sizes) - 1 <= 3 and sizes.count(1) >= 1


def test_points_meet_units_in_as_many_tasks_as_rows_may_come_out(spark, monkeypatch):
    monkeypatch.setattr(scan, "PAIRS", 20)
    points = spark.createDataFrame([(k, 0.5 + k % 4 * 10.0, -5.0) for k in range(16)], "id int, x double, y double")
    got = S.points_in_units(points, squares(spark, 9), 16.0).select("id", "unit")
    assert got.rdd.getNumPartitions() == math.ceil(16 * 9 / 20)
    assert sorted(map(tuple, got.collect())) == sorted((k, u) for k in range(16) for u in range(9) if 7 * (u % 3) < 0.5 + k % 4 * 10 < 30 + 7 * (u % 3))


def test_a_structure_is_worked_out_once_however_many_units_hold_it(spark, sf_dir):
    got = queries()["landed_inventory"](spark, sf_dir)
    plan = plan_of(got)
    assert "round(" not in plan and "from_json" not in plan and "inline(copies_" in plan
    assert got.count() > 0
