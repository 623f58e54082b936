"""What must not grow: jobs over whole tables for figures of files, views joined anew, broadcasts of grids."""

from __future__ import annotations

import numpy as np

from __spark_entry__ import queries
from freshet.operators import hydraulics as H
from freshet.operators import terrain as T
from freshet.operators.graph import components
from freshet.operators.packed import NULL, over_tiles, packed, unpacked
from freshet.plans.terrain import forget, terrain
from freshet.sources import store
from freshet.sources.store import fingerprint


def test_a_fingerprint_reads_no_rows(spark, tmp_path):
    path = f"file://{tmp_path}/a table"
    spark.range(1000).write.parquet(path)
    spark.sparkContext.setJobGroup("fingerprint", "fingerprint")
    try:
        table = spark.read.schema("id long").parquet(path)
        first = fingerprint(table)
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("fingerprint")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    spark.range(5).write.mode("append").parquet(path)
    assert fingerprint(spark.read.schema("id long").parquet(path)) != first


def stored(df, folder, name):
    df.write.parquet(f"file://{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"file://{folder}/{name}")


def reads(df, name: str) -> bool:
    return any(f"/{name}/" in f for f in df.inputFiles())


def test_an_extent_joins_the_grid_once(spark, tmp_path):
    rows = [(r * 8 + c, r, c, 0.1 * (c % 4), 7) for r in range(8) for c in range(8)]
    cells = stored(spark.createDataFrame(rows, "cell long, r int, c int, hand double, reach long"), tmp_path, "catchments")
    stages = spark.createDataFrame([(7, 0.3)], "reach long, stage_m double")
    streams = spark.createDataFrame([(r * 8,) for r in range(8)], "cell long")
    got = H.inundate(cells.select("cell", "hand", "reach"), cells.select("cell", "r", "c"), stages, streams, 8, size=4)
    assert not reads(got, "catchments")
    assert {x.cell: (round(x.depth_m, 6), x.connected) for x in got.collect()} == {k: (round(0.3 - hand, 6), True) if c < 3 else (0.0, False) for k, _, c, hand, _ in rows}


def test_a_stage_table_bins_the_grid_once(spark, tmp_path):
    cells = stored(spark.createDataFrame([(k, 0.5 * k, 7) for k in range(6)], "cell long, hand double, reach long"), tmp_path, "catchments")
    links = stored(spark.createDataFrame([(k, 0, k, 7) for k in range(4)], "cell long, start long, seq long, link long"), tmp_path, "links")
    geometry = H.reach_geometry(links, stored(spark.createDataFrame([(k, 9.0 - k) for k in range(6)], "cell long, z double"), tmp_path, "routed"), 100, 10.0)
    curves = H.rating_curves(cells, geometry, 10.0, max_stage=1.0, step=0.5)
    assert not reads(geometry, "routed") and not reads(curves, "catchments")
    assert [(x.rung, round(x.area_m2, 6)) for x in curves.orderBy("rung").collect()] == [(0, 0.0), (1, round(0.5 * 100 / 30, 6)), (2, round(1.5 * 100 / 30, 6))]


def test_grid_tables_are_not_broadcast(spark):
    rows = store.landed(spark.range(64).selectExpr("id AS cell", "CAST(id / 8 AS INT) AS r", "CAST(id % 8 AS INT) AS c", "CAST(4 AS SMALLINT) AS flowdir"), "routed")
    to = T.receivers(rows, 8)
    assert {x.cell: x.next for x in to.collect()} == {k: k + 8 if k < 56 else None for k in range(64)}
    assert "Broadcast" not in to._jdf.queryExecution().executedPlan().toString()


def test_a_query_pays_for_its_own_steps(spark, sf_dir):
    forget()
    assert queries()["terrain_d8"](spark, sf_dir).count() > 0
    done = vars(terrain(spark, sf_dir))
    assert "first" in done and not {"routed_tiles", "routed", "streams", "links", "hand"} & set(done)
    assert queries()["drainage_totals"](spark, sf_dir).first()["cells"] > 0
    assert "routed" in done and not {"streams", "links", "hand"} & set(done)


def test_cells_travel_as_tiles(spark):
    rows = [(r * 10 + c, r, c, float(r * c)) for r in range(10) for c in range(10) if (r, c) != (4, 4)]
    tiles = store.landed(packed(spark.createDataFrame(rows, "cell long, r int, c int, z double"), 5, ["cell", "r", "c", "z"]), "tiles")
    strips = tiles.where("NOT own").selectExpr("tr BETWEEN 0 AND 1 AND tc BETWEEN 0 AND 1 AS inside").where("inside").count()
    assert tiles.where("own").count() == 4 and strips == 12 - 1  # the corner (4, 4) is missing
    assert {tuple(x) for x in unpacked(tiles, ["cell", "r", "c", "z"]).collect()} == set(rows)
    down = over_tiles(tiles, lambda part: {"next": np.where(part["own"], part["cell"], NULL)[part["own"]], "cell": part["cell"][part["own"]].to_numpy()}, 5, ["cell"], ["cell", "next"])
    assert {tuple(x) for x in unpacked(down, ["cell", "next"]).collect()} == {(x[0], x[0]) for x in rows}
    gone = over_tiles(tiles, lambda part: {"next": np.full(len(part), NULL)}, 5, ["cell"], ["next"], rim=False)
    assert unpacked(gone, ["next"]).where("next IS NULL").count() == len(rows)


def test_points_on_one_place_are_snapped_once(spark):
    points = spark.createDataFrame([(k, 3, 3 + k % 2) for k in range(40)], "point long, r int, c int")
    streams = spark.createDataFrame([(1, 3, 1), (2, 3, 6)], "cell long, r int, c int")
    got = H.snap_to_stream(points, streams)
    assert {x.point: x.cell for x in got.collect()} == {k: 1 + k % 2 for k in range(40)}
    assert "Aggregate [point" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_pool_is_joined_by_tile_not_by_cell(spark, monkeypatch):
    rows = [(r * 20 + c, r, c) for r in range(12) for c in range(20) if r % 4 < 2 or c == 19 and r < 6]
    wet = store.landed(spark.createDataFrame(rows, "cell long, r int, c int"), "pool")
    given = []
    monkeypatch.setattr(T, "components", lambda edges: given.append(edges.count()) or components(edges))
    got = {x.cell for x in T.connected_to(wet, spark.createDataFrame([(4 * 20,)], "cell long"), 20, size=5).collect()}
    assert got == {k for k, r, _ in rows if r < 8} and given[0] < len(rows) / 4
