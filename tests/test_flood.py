"""Functions, hydraulics, damage and validation against hand-computed answers; registered queries against DuckDB."""

import json
import math
from statistics import NormalDist

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.functions import scalar as S
from freshet.operators import curves as C
from freshet.operators import exposure as E
from freshet.operators import gauging as GA
from freshet.operators import hydraulics as H
from freshet.operators import network as N
from freshet.operators import overlay as O
from freshet.operators import spatial as SP
from freshet.operators import validation as V
from freshet.sources import raster as R
from freshet.sources.store import TerrainStore, fingerprint, params_hash
from freshet.streaming.gauges import admit, token_bucket


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_interpolation_holds_the_ends_and_takes_the_last_of_equal_places(spark):
    xs, ys = [0.0, 1.0, 1.0, 3.0], [0.0, 5.0, 7.0, 9.0]
    for x in (-1.0, 0.0, 0.5, 1.0, 2.0, 3.0, 8.0):
        got = one(spark, S.interp(F.lit(x), F.array(*map(F.lit, xs)), F.array(*map(F.lit, ys))))
        assert got == pytest.approx(float(np.interp(x, xs, ys)))


def test_normal_quantile_and_integral(spark):
    for p in (1e-9, 0.001, 0.2, 0.5, 0.77, 0.999, 1 - 1e-9):
        z = one(spark, S.norm_ppf(F.lit(p)))
        assert z == pytest.approx(NormalDist().inv_cdf(p), abs=1e-9)
        assert one(spark, S.norm_cdf(F.lit(z))) == pytest.approx(p, abs=1e-9)
    assert one(spark, S.norm_ppf(F.lit(1.0))) is None


def test_water_year_and_zone(spark):
    assert one(spark, S.water_year(F.lit("1994-10-18"))) == 1995
    assert one(spark, S.water_year(F.lit("1994-09-30"))) == 1994
    assert one(spark, S.water_year(F.lit("nonsense"))) == 0
    assert one(spark, S.utm_zone_srid(F.lit(-95.4), F.lit(29.8))) == 26915
    assert one(spark, S.utm_zone_srid(F.lit(-60.0), F.lit(-3.0))) is None


def test_point_in_ring_and_its_boundary(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]])
    at = lambda x, y, edge=False: one(spark, S.point_in_ring(F.lit(x), F.lit(y), ring, edge))
    assert at(1.0, 1.0) and not at(5.0, 1.0) and not at(4.0, 2.0) and at(4.0, 2.0, True)


def test_rating_of_a_v_shaped_reach(spark):
    rows = [(i * 21 + j, abs(j - 10) * 0.4, 0) for i in range(9) for j in range(21)]
    cells = spark.createDataFrame(rows, "cell long, hand double, reach long")
    geometry = spark.createDataFrame([(0, 90.0, 0.001)], "reach long, length_m double, slope double")
    curve = {x.stage_m: x for x in H.rating_curves(cells, geometry, 10.0, manning=0.03, max_stage=3, step=0.5).collect()}
    depth = [2 - abs(j - 10) * 0.4 for j in range(21) if abs(j - 10) * 0.4 < 2]
    area = sum(depth) * 9 * 100 / 90
    radius = area / (len(depth) * 9 * 100 / 90)
    assert curve[2.0].area_m2 == pytest.approx(area) and curve[2.0].radius_m == pytest.approx(radius)
    assert curve[2.0].discharge_cms == pytest.approx(area * radius ** (2 / 3) * math.sqrt(0.001) / 0.03)
    assert curve[0.0].discharge_cms == 0


def test_frequency_fit_and_its_inverse(spark):
    peaks = spark.createDataFrame([("a", 100 * math.exp(0.35 * math.sin(i) + 0.02 * i)) for i in range(60)], "site string, cms double")
    fit = H.frequency_fit(peaks, ["site"])
    rows = fit.withColumn("t", F.explode(F.array(F.lit(2.0), F.lit(50.0)))).withColumn("q", H.pearson_discharge(F.col("t"))).withColumn("back", H.pearson_period(F.col("q"))).collect()
    for row in rows:
        assert row.back == pytest.approx(row.t, rel=1e-6)
    short = H.frequency_fit(peaks.limit(5), ["site"]).withColumn("q", H.pearson_discharge(F.lit(10.0))).first()
    assert not short.can_fit and short.q is None


def test_units_are_mandatory():
    with pytest.raises(ValueError):
        H.gauge_to_datum(F.lit(1.0), "fathom", 0.0)


def test_damage_curve_edges(spark):
    at = lambda d, c="residential": one(spark, E.damage_fraction(F.lit(d), "HAZUS", F.lit(c)))
    assert at(0.25) == pytest.approx(0.105) and at(50.0) == 0.68 and at(-0.5) == 0.0 and at(E.NO_WATER) == 0.0
    assert at(1.0, "COM4") == 0.24 and at(1.0, "shed") == 0.30
    assert one(spark, E.storey_exposure(F.lit(0.8), F.lit(2.0))) == 0.5
    assert one(spark, E.storeys(F.lit(0.0), F.lit(7.5))) == 2.0 and one(spark, E.storeys(F.lit(None).cast("double"), F.lit(None).cast("double"))) == 1.0


def _plain_estimate(margin, name, area, floors, family):
    xs, ys = np.array(E.DEPTHS), np.array(E.CURVES[family][name])
    share = np.interp(np.minimum(margin, 6.0), xs, ys)
    n = max(floors, 1.0)
    return share * np.clip(np.ceil(np.maximum(margin, 0) / 3.0), 1, n) / n * area * E.RATES[name]


def test_monte_carlo_equals_a_plain_loop_whatever_the_partitions(spark):
    rows = [(i, float(i % 3) - 0.5, ["residential", "commercial"][i % 2], 100.0, 1.0 + i % 3) for i in range(30)] + [(99, E.NO_WATER, "residential", 50.0, 1.0)]
    b = spark.createDataFrame(rows, "building_id long, margin_m double, building_class string, floor_area_m2 double, storeys double")
    weights, draws, seed = {"HAZUS": 0.6, "JRC_GLOBAL": 0.4}, 50, 7
    each = np.arange(draws)
    stage, cost = C.normal(seed, 1, each) * 0.15, np.exp(C.normal(seed, 2, each) * 0.25)
    family = np.where(C.uniform(seed, 0, each) < 0.6, "HAZUS", "JRC_GLOBAL")
    want, mean = np.zeros(draws), {}
    for i, margin, name, area, floors in rows:
        drawn = margin + stage + C.normal(seed, 4, each, i) * 0.15
        mine = np.array([_plain_estimate(m, name, area, floors, f) * c for m, f, c in zip(drawn, family, cost, strict=True)]) if margin > -1000 else np.zeros(draws)
        want, mean[i] = want + mine, mine.mean()
    for n in (1, 7):
        found = C.monte_carlo(b.repartition(n), C.bundled(spark), weights, draws, seed, block=8)
        got = {x.draw: x for x in C.draw_totals(found).collect()}
        assert [got[i].total for i in range(draws)] == [pytest.approx(w) for w in want] and all(x.wet <= 30 for x in got.values())
        assert {x.building_id: x.expected for x in C.expected_damage(found).collect()} == {i: pytest.approx(m) for i, m in mean.items()}
    assert abs(np.log(cost).mean()) < 0.15  # the multiplier's median is 1


def test_mixed_numbers_are_uniform_and_normal():
    u = C.uniform(3, 1, np.arange(200_000))
    assert abs(u.mean() - 0.5) < 0.005 and abs(u.var() - 1 / 12) < 0.002 and 0 < u.min() < u.max() < 1
    z = C.normal(3, 4, np.arange(400)[None, :], np.arange(400)[:, None])
    assert abs(z.mean()) < 0.02 and abs(z.std() - 1) < 0.02 and abs(np.corrcoef(z[0], z[1])[0, 1]) < 0.2


def test_curves_from_files_and_their_checks(spark):
    point = lambda m, s: {"type": "NormalDistribution", "parameters": {"mean": m, "standarddeviation": s}}
    entry = {"damagefunction": {"xvalues": [-2, -1, 0, 1], "ydistributions": [point(0, 0.3), point(2.5, 1.2), point(13.4, 1.6), point(12.0, 1.6)]}, "source": "x"}
    text = json.dumps({"occupancytypes": {"RES1-1SNB": {"componentdamagefunctions": {"structure": {"damagefunctions": {"depth": entry}}, "contents": {"damagefunctions": {"duration": entry}}}}}})
    (curve,) = C.checked(C.occupancy_curves(spark.createDataFrame([(text,)], "json string"))).collect()
    assert curve.component == "structure" and curve.verified and curve.depths == [pytest.approx(0.3048 * x) for x in (-2, -1, 0, 1)]
    assert curve.fractions == [pytest.approx(x) for x in (0, 0.025, 0.134, 0.134)] and curve.sigmas[1] == pytest.approx(0.012)
    bad = spark.createDataFrame([("f", "a", "structure", [0.0, 0.0], [0.0, 1.0], [0.0, 0.0], False), ("f", "b", "structure", [0.0, 1.0], [0.5, 0.1], [0.0, 0.0], False), ("f", "c", "structure", [0.0], [0.5], [0.0], False), ("f", "d", "structure", [0.0, 1.0], [0.5, 1.5], [0.0, 0.0], False), ("f", "e", "structure", [0.0, 1.0], [0.5], [0.0], False)], C.SCHEMA)
    assert {x["class"]: x.problem for x in C.problems(bad).collect()} == {"a": "depths do not ascend", "b": "fractions decrease", "c": "fewer than two points", "d": "fractions outside of 0 to 1", "e": "lengths differ"}
    with pytest.raises(ValueError, match="do not ascend"):
        C.checked(bad)
    low = C.occupancy_curves(spark.createDataFrame([(text,)], "json string"))
    flat = spark.createDataFrame([(0.0,), (1.0,)], "margin_m double")
    with pytest.raises(ValueError, match="signed margins"):
        C.refuse_clamped(flat, low)
    C.refuse_clamped(flat, C.bundled(spark))
    C.refuse_clamped(flat.union(spark.createDataFrame([(-1.0,)], "margin_m double")), low)


def test_contents_and_spread(spark):
    curves = spark.createDataFrame([("U", "residential", p, [0.0, 2.0], [0.1, 0.5], [0.0, 0.1], True) for p in ("structure", "contents")], C.SCHEMA)
    b = spark.createDataFrame([(1, 1.0, "x", 1.0, 1000.0, 300.0), (2, E.NO_WATER, "x", 1.0, 1000.0, 300.0)], "building_id long, margin_m double, building_class string, storeys double, structure_value double, contents_value double")
    one_, dry = C.priced(b, curves, "U", contents=True, z=1.0).orderBy("building_id").collect()
    assert one_.structure == pytest.approx(350) and one_.contents == pytest.approx(105) and dry.damage == 0
    assert C.totals(C.priced(b, curves, "U")).first().loss_ratio == pytest.approx(300 / 2000)


def test_gauge_tables_as_text(spark):
    text = "# note\n#\nagency_cd\tsite_no\tpeak_dt\tpeak_va\tgage_ht\n5s\t15s\t10d\t8s\t8s\nUSGS\t1\t2017-08-27\t1000\t20.5\nUSGS\t1\t1994-10-18\t\t\nbroken\tline\nUSGS\t1\t1994-10-18\t900\t\n"
    rows = spark.createDataFrame([("1", text), ("2", "# nothing\na\tb\n")], "site string, text string")
    peaks = GA.peak_series(GA.parsed_rdb(rows, "site"), "site")
    assert sorted((x.date, x.water_year, round(x.cms, 4)) for x in peaks.collect()) == [("1994-10-18", 1995, 25.4851), ("2017-08-27", 2017, 28.3168)]
    top = GA.peak_of_record(peaks, "site").first()
    assert (top.date, top.n_years) == ("2017-08-27", 2)


def test_projections_against_known_places_and_their_own_laws(spark):
    p = one(spark, SP.to_utm(F.lit(-93.0), F.lit(30.0), 15))
    assert p.x == pytest.approx(500000, abs=1e-6) and p.y == pytest.approx(3318785.35, abs=0.01)  # the meridian's arc to 30 degrees, scaled

    def shift(f, lon, lat, d=1e-6):
        a, b, c = (one(spark, f(F.lit(x), F.lit(y))) for x, y in ((lon, lat), (lon + d, lat), (lon, lat + d)))
        return np.array([b.x - a.x, b.y - a.y]) / d, np.array([c.x - a.x, c.y - a.y]) / d

    lon, lat, e2 = -95.4, 29.8, SP.FLATTENING * (2 - SP.FLATTENING)
    w = 1 - e2 * math.sin(math.radians(lat)) ** 2
    east, north = (math.radians(1) * SP.AXIS * x for x in (math.cos(math.radians(lat)) / math.sqrt(w), (1 - e2) / w**1.5))
    de, dn = shift(lambda x, y: SP.to_utm(x, y, 15), lon, lat)
    assert abs(de @ dn) / (np.linalg.norm(de) * np.linalg.norm(dn)) < 1e-4 and np.linalg.norm(de) / east == pytest.approx(np.linalg.norm(dn) / north, rel=1e-4)  # angles stay
    de, dn = shift(SP.to_albers, lon, lat)
    assert abs(de[0] * dn[1] - de[1] * dn[0]) == pytest.approx(east * north, rel=1e-4)  # areas stay


def test_points_masks_and_units(spark):
    ring = "array(named_struct('x', 0D, 'y', 0D), named_struct('x', 4D, 'y', 0D), named_struct('x', 4D, 'y', -4D), named_struct('x', 2D, 'y', -2D), named_struct('x', 0D, 'y', -4D))"
    units = spark.sql(f"SELECT 'u' AS unit, {ring} AS ring")
    points = spark.createDataFrame([(1, 1.0, -1.0), (2, 2.0, -3.5), (3, 4.0, -2.0), (4, 9.0, 9.0)], "id long, x double, y double")
    assert [x.id for x in SP.points_in_units(points, units, 3.0).collect()] == [1]
    assert sorted(x.id for x in SP.points_in_units(points, units, 3.0, True).collect()) == [1, 3]
    row = units.select(SP.area(F.col("ring")).alias("a"), SP.bounds(F.col("ring")).alias("b")).first()
    assert row.a == pytest.approx(12) and row.b.ymin == -4
    back = SP.units_of(spark.createDataFrame([('{"features": [' + SP.as_geojson(units, ["unit"]).first().feature + "]}",)], "json string")).first()
    assert back.area == pytest.approx(12) and back.properties == {"unit": "u"}


def test_windows_writes_and_merges(spark, tmp_path):
    assert [(x.r0, x.c0, x.height, x.width) for x in R.windows(spark, 5, 7, 4).orderBy("window").collect()] == [(0, 0, 4, 4), (0, 4, 4, 3), (4, 0, 1, 4), (4, 4, 1, 3)]
    rows = spark.createDataFrame([(1, 2.0), (2, 3.0)], "key long, value double")
    R.write_once(rows, f"file://{tmp_path}/a", 26915, 26915)
    for call in (lambda: R.write_once(rows, f"file://{tmp_path}/b", 4326, 26915), lambda: R.write_once(rows, f"file://{tmp_path}/a", 26915, 26915), lambda: R.read_window(rows, srid=None, expected=26915)):
        with pytest.raises(Exception):  # noqa: B017  (a refusal of ours or of the writer)
            call()
    new = spark.createDataFrame([(2, None), (3, 9.0), (1, 5.0)], "key long, value double")
    assert sorted(tuple(x) for x in R.merged_results(rows, new).collect()) == [(1, 5.0), (2, 3.0), (3, 9.0)]
    assert sorted(x.status for x in R.manifest(spark, [("a", f"file://{tmp_path}/a", None), ("b", f"file://{tmp_path}/b", None), ("c", "", "404")]).collect()) == ["failed", "missing", "stored"]


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from freshet.sources.store import shared_dir

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: None), sparkContext=SimpleNamespace(master="spark://somewhere:7077"))
    with pytest.raises(ValueError, match="shared|share"):
        shared_dir(session)


def test_hot_keys_are_spread_and_nothing_is_lost(spark):
    from freshet.operators.graph import spread_join

    rows = spark.createDataFrame([(7, i) for i in range(900)] + [(i, i) for i in range(300)] + [(None, 5)], "k long, v long")
    facts = spark.createDataFrame([(i, i * 10) for i in range(200)], "k long, f long")
    for how in ("inner", "left"):
        plain = sorted(map(str, rows.join(facts, "k", how).select("k", "v", "f").collect()))
        assert plain == sorted(map(str, spread_join(rows, facts, "k", "v", how).select("k", "v", "f").collect()))


def test_changed_files_are_seen(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(5).write.parquet(path)
    first = fingerprint(spark.read.parquet(path))
    assert first == fingerprint(spark.read.parquet(path))
    spark.range(9).write.mode("overwrite").parquet(path)
    assert first != fingerprint(spark.read.parquet(path))


def test_sql_function_interpolates(spark):
    S.register(spark)
    assert spark.sql("SELECT interp(1.5D, array(0D, 1D, 2D), array(0D, 10D, 30D)) AS x").first().x == 20


def test_scores(spark):
    pairs = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False), (True, True)], "model boolean, reference boolean")
    got = V.extent_metrics(pairs).first()
    assert (got.hits, got.misses, got.false_alarms, got.correct_negatives, got.csi) == (2, 1, 1, 1, 0.5)
    assert V.extent_metrics(pairs.where("NOT model AND NOT reference")).first().csi is None
    ranks = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (2.0, 5.0), (4.0, 7.0)], "x double, y double")
    assert V.spearman(ranks, "x", "y").first().rho == pytest.approx(0.63245553)
    assert V.upper_median(spark.createDataFrame([(float(i),) for i in (4, 1, 3, 2)], "v double"), F.col("v")).first().median == 3.0


def test_structures_and_footprints(spark):
    raw = spark.createDataFrame([("48201", 1200.0, 2000.0, 1.0, 3.0, None, 1.0, 0.0, None, None)], "cbfips string, ftprntsqft double, sqft double, found_ht double, pop2amu65 double, pop2amo65 double, pop2pmu65 double, pop2pmo65 double, num_story double, occtype string")
    row = E.derive_structures(raw).first()
    assert row.cbfips == "000000000048201" and row.tract_fips == "00000000004" and row.found_ht_m == 0.3048 and row.pop_night == 3 and row.num_story == 1 and row.occtype == ""


def test_store_and_hash(spark, tmp_path):
    key = params_hash({"b": 1, "a": [1.5, None]})
    assert key == params_hash({"a": [1.5, None], "b": 1}) and len(key) == 16
    with pytest.raises(ValueError):
        params_hash({"a": math.nan})
    store = TerrainStore(spark, f"file://{tmp_path}")
    assert not store.exists("1204", key)
    store.put("1204", key, spark.range(3))
    assert store.exists("1204", key) and store.get("1204", key).count() == 3
    store.put("1204", key, spark.range(4))  # put in place when whole
    assert store.get("1204", key).count() == 4 and [tuple(x) for x in store.find().collect()] == [("1204", key)]
    with pytest.raises(ValueError):
        store.exists("123", key)


def test_token_bucket_orders_requests_across_pieces(spark, tmp_path):
    rows = [(1, 1000 + k * 7919 % 60 * 30) for k in range(60)]
    spark.createDataFrame(rows, "client long, s int").select("client", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/in")
    tokens, last, want = 3.0, 1000, 0
    for now in sorted(s for _, s in rows):
        good, tokens = admit(tokens, last, now, 0.01, 3)
        last, want = now, want + good
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        stream = token_bucket(spark.readStream.schema("client long, ts timestamp").parquet(f"{tmp_path}/in"), per_minute=0.6, burst=3)
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    found = spark.read.parquet(f"{tmp_path}/out")
    assert (found.count(), found.where("admitted").count()) == (60, want)


def test_token_bucket_streams(spark, tmp_path):
    assert admit(10, 0, 0, 0.5, 10) == (True, 9) and admit(0.2, 0, 1, 0.5, 10) == (False, 0.7)
    rows = spark.sql("SELECT CAST(1 AS BIGINT) AS client, timestamp_seconds(id) AS ts FROM range(20)")
    rows.write.parquet(f"{tmp_path}/in")
    stream = token_bucket(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), per_minute=6, burst=5)
    run = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").where("admitted").count() == 6


def test_stage_between_observed_gauges(spark):
    """Reaches 0 -> 1 -> 2 -> 3 of 30 m; reach 9 stands alone."""
    reaches = spark.createDataFrame([(i, i + 1 if i < 3 else None, 30.0, 10.0 - i) for i in range(4)] + [(9, None, 30.0, 1.0)], "reach long, down long, length_m double, bed_m double")
    at = lambda *rows: {x.reach: (x.kind, x.stage_m) for x in N.interpolate_stage(reaches, spark.createDataFrame(rows, "reach long, wse_m double, gauge_bed_m double")).collect()}
    both = at((0, 15.0, 10.0), (3, 9.0, 7.0))
    assert both == {0: ("gauged", 5.0), 1: ("interpolated", pytest.approx(4.0)), 2: ("interpolated", pytest.approx(3.0)), 3: ("gauged", 2.0)}
    assert at((1, 12.0, 9.0)) == {0: ("extrapolated", 3.0), 1: ("gauged", 3.0), 2: ("extrapolated", 3.0), 3: ("extrapolated", 3.0)}
    assert at((1, 5.0, 9.0))[1] == ("gauged", 0.0)


def test_overlay_of_bent_and_turned_rings(spark):
    ring = lambda *p: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p])
    bent = ring((0, 0), (4, 0), (4, 4), (3, 4), (3, 1), (1, 1), (1, 4), (0, 4))  # a U of area 10
    share = lambda w: one(spark, O.inside_share(bent, w))
    assert share(ring((0, 0), (4, 0), (4, 4), (0, 4))) == pytest.approx(10 / 16)
    assert share(ring((0, 2), (0, 4), (4, 4), (4, 2))) == pytest.approx(4 / 8)
    assert share(ring((1, 1), (3, 1), (3, 4), (1, 4))) == pytest.approx(0)
    assert share(ring((8, 8), (9, 8), (9, 9))) == 0 and share(ring((0, 0), (1, 0), (2, 0))) == 0
    assert share(ring((0, 0), (1, 0), (0, 1))) == pytest.approx(1)


def test_contents_need_values_and_curves(spark):
    rows = spark.createDataFrame([(1, 0.5, "residential", 1.0, 100.0)], "building_id long, margin_m double, building_class string, storeys double, structure_value double")
    curves = C.bundled(spark)
    with pytest.raises(ValueError, match="contents_value"):
        C.priced(rows, curves, "HAZUS", contents=True)
    with pytest.raises(ValueError, match="contents curves"):
        C.priced(rows.withColumn("contents_value", F.lit(5.0)), curves, "HAZUS", contents=True)


def test_windows_tell_what_they_cover(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 0, None), (2, 2, float("nan")), (4, 4, 7.0)], "r int, c int, z double")
    got = {(w.r0, w.c0): (w.height, w.width, w.n_valid, w.low, w.high, w["mean"]) for w in R.window_figures(cells, 5, 5, 3).collect()}
    assert got == {(0, 0): (3, 3, 2, 1.0, 3.0, 2.0), (0, 3): (3, 2, 0, None, None, None), (3, 0): (2, 3, 0, None, None, None), (3, 3): (2, 2, 1, 7.0, 7.0, 7.0)}


def test_regridded_people_stay_as_many(spark):
    rows = [(0.0, 25.0, -15.0, 0.0, 30.0), (5.0, 5.0, -1.0, 0.0, 9.0), (0.0, 10.0, -10.0, 0.0, -4.0), (0.0, 10.0, -10.0, 0.0, None), (0.0, 10.0, -10.0, 0.0, float("nan"))]
    got = {(x.r, x.c): x["pop"] for x in E.regrid_sum(spark.createDataFrame(rows, "xmin double, xmax double, ymin double, ymax double, pop double"), 10.0).collect()}
    assert got == {k: pytest.approx(v) for k, v in {(0, 0): 8, (0, 1): 8, (0, 2): 4, (1, 0): 4, (1, 1): 4, (1, 2): 2}.items()}


NAMES = ["terrain_fill", "terrain_hand", "terrain_accumulation", "rating_curves", "inundation", "damage_ladder", "frequency_fit", "rank_correlation", "gauge_windows_streamed", "network_distance", "reach_graph", "observed_stage", "overlay_claims", "ladder_at", "population_regrid", "damage_draws", "expected_damage", "contents_damage", "occupancy_curves", "building_depths", "damage_channels", "slider_depths", "warp_bilinear", "gauge_peaks", "event_gauge", "chosen_gauges", "marks_in_units", "geometry_mask", "selected_tiles", "utm_and_back", "equal_area", "aid_comparison", "reproduced", "mark_scores", "ratio_median", "cache_eviction", "terrain_prune", "terrain_network", "frequency_context", "streamed_stages", "burned_channel", "whole_ladder", "implied_discharge", "zonal_polygons", "unclamped_margins", "multipolygon_mask", "points_in_multipolygons", "warped_ingest", "damage_mercator", "stored_window", "landed_inventory", "replaced_units", "sql_neighbours", "sql_boxes", "gauge_history", "drainage_totals", "assessment_payload", "claims_against_interval", "tiles_found", "block_extremes", "uncertainty_budget", "raster_windows", "watersheds", "larger_floods", "streamed_extents"]


@pytest.mark.parametrize("name", NAMES)
def test_registered_queries_match_duckdb(spark, sf_dir, name):
    from freshet.plans import exposure_queries, report_queries, site_queries, store_queries  # noqa: F401  (they register their queries)
    from freshet.plans import queries as Q

    got = Q.QUERIES[name](spark, sf_dir).toPandas()
    db = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "events", "nation"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = db.execute(Q.ORACLE[name]).df()
    assert sorted(got) == sorted(want)

    key = lambda d: sorted(tuple(map(str, r)) for r in _rows(d))
    assert key(got) == key(want)


def _rows(d):
    for row in d[sorted(d)].astype(object).itertuples(index=False):
        yield [None if pd.isna(v) else round(float(v), 4) + 0.0 if hasattr(v, "__float__") and not isinstance(v, (bool, np.bool_)) else v for v in row]
