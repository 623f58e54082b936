"""Terrain operators against plain numpy versions on random grids, for several tile sizes."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.operators import terrain as T
from freshet.operators.graph import components, resolve, subtree_sums


def grid(seed, rows=11, cols=13, holes=True):
    rng = np.random.default_rng(seed)
    z = rng.integers(0, 9, (rows, cols)).astype(float)
    return {(r, c): float(z[r, c]) for r in range(rows) for c in range(cols) if not holes or rng.random() > 0.06}


def frame(spark, cells, cols):
    return spark.createDataFrame([(r * cols + c, r, c, z) for (r, c), z in cells.items()], "cell long, r int, c int, z double")


def near(r, c):
    return [(k, r + a, c + b, math.hypot(a, b)) for k, a, b in T.DIRECTIONS]


def filled(cells):
    w = {p: z for p, z in cells.items() if any((r, c) not in cells for _, r, c, _ in near(*p))}
    heap = [(z, p) for p, z in w.items()]
    heapq.heapify(heap)
    while heap:
        x, p = heapq.heappop(heap)
        for _, r, c, _ in near(*p):
            if (r, c) in cells and max(x, cells[r, c]) < w.get((r, c), math.inf):
                w[r, c] = max(x, cells[r, c])
                heapq.heappush(heap, (w[r, c], (r, c)))
    return w


@pytest.mark.parametrize("size", [4, 64])
def test_fill_is_the_minimax_level_for_any_tile_size(spark, size):
    cells = grid(1)
    got = {(x.r, x.c): x.w for x in T.fill_depressions(frame(spark, cells, 13), size=size).collect()}
    assert got == filled(cells)


def test_fill_with_epsilon_never_lies_below_the_plain_fill(spark):
    cells = grid(2)
    plain = filled(cells)
    got = {(x.r, x.c): x.w for x in T.fill_depressions(frame(spark, cells, 13), epsilon=0.01, size=5).collect()}
    assert all(got[p] >= plain[p] for p in plain)
    for (r, c), w in got.items():
        around = [got.get((a, b)) for _, a, b, _ in near(r, c)]
        assert None in around or any(x < w for x in around)


def test_undrained_differs_from_raised(spark):
    cells = {(0, c): z for c, z in enumerate([5.0, 3.0, 4.0, 1.0])} | {(r, c): 9.0 for r in (-1, 1) for c in range(-1, 5)} | {(0, -1): 9.0, (0, 4): 0.0}
    got = {(x.r, x.c): x.undrained for x in T.undrained(frame(spark, cells, 100), size=3).collect()}
    assert got[0, 1] and got[0, 0] and not got[0, 2] and not got[0, 4]


def test_direction_ties_go_to_the_lowest_code(spark):
    cells = {(r, c): 1.0 for r in range(3) for c in range(3)}
    cells[1, 1] = 5.0
    codes = {(x.r, x.c): x.flowdir for x in T.flow_direction(frame(spark, cells, 3)).collect()}
    assert codes[1, 1] == 1 and codes[0, 0] == T.OUTLET


def test_flats_resolve_and_everything_drains(spark):
    z = {(r, c): 30.0 for r in range(13) for c in range(13)}
    z |= {(r, c): 10.0 for r in range(3, 10) for c in range(3, 10)} | {(r, 6): 20.0 for r in range(3)}
    cells = frame(spark, {p: w for p, w in filled(z).items()}, 13)
    first = T.flow_direction(cells)
    for size in (5, 64):
        flats = T.resolve_flats(first, size=size)
        assert flats.where("flat").count() > 0 and flats.where("flat AND NOT resolved").count() == 0
        routed = T.receivers(flats, 13)
        total = T.flow_accumulation(routed).join(routed.where("next IS NULL"), "cell").agg(F.sum("accumulation")).first()[0]
        assert total == 169


def test_cycles_are_errors(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0)], "node long, next long, w double")
    from freshet.operators import graph

    graph.ROUNDS, old = 4, graph.ROUNDS
    try:
        with pytest.raises(ValueError, match="cycle"):
            subtree_sums(edges, "w")
    finally:
        graph.ROUNDS = old


def test_paths_and_sums_on_a_random_forest(spark):
    rng = np.random.default_rng(3)
    nxt = {i: int(rng.integers(0, i)) if i and rng.random() > 0.05 else None for i in range(120)}
    edges = spark.createDataFrame(list(nxt.items()), "node long, next long").withColumn("w", F.col("node") % 3 + 1.0)
    roots = {x.node: (x.root, x.cost) for x in resolve(edges).collect()}
    sums = {x.node: x.total for x in subtree_sums(edges, "w").collect()}
    want = dict.fromkeys(nxt, 0.0)
    for i in nxt:
        at, steps = i, 0
        want[i] += i % 3 + 1.0
        while nxt[at] is not None:
            at, steps = nxt[at], steps + 1
            want[at] += i % 3 + 1.0
        assert roots[i] == (at, steps)
    assert sums == want
    tiled = edges.withColumn("tile", F.col("node") % 7)
    assert {x.node: (x.root, x.cost) for x in resolve(tiled, tile="tile").collect()} == roots
    assert {x.node: x.total for x in subtree_sums(tiled, "w", "tile").collect()} == want


def test_cycles_are_errors_inside_and_across_tiles(spark):
    from freshet.operators import graph

    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "node long, next long")
    graph.ROUNDS, old = 4, graph.ROUNDS
    try:
        for tiles in (1, 2):
            with pytest.raises(ValueError, match="cycle"):
                resolve(edges.withColumn("tile", F.col("node") % tiles), tile="tile").count()
    finally:
        graph.ROUNDS = old


@pytest.mark.parametrize("tiles", [1, 4, 1000])
def test_components_in_tiles_equal_those_without(spark, tiles):
    rng = np.random.default_rng(tiles)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 300, (190, 2))], "u long, v long")
    got = {x.node: x.label for x in components(edges, tile=lambda k: k % tiles).collect()}
    assert got == {x.node: x.label for x in components(edges).collect()}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30))


def test_short_branches_are_pruned(spark):
    main = [(i, i + 1 if i < 11 else None) for i in range(12)]
    streams = spark.createDataFrame([*main, (50, 51), (51, 6)], "cell long, next long")
    left = {x.cell for x in T.prune_streams(streams, 5).collect()}
    assert left == set(range(12))


def test_links_start_at_heads_and_junctions(spark):
    streams = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, None), (10, 2)], "cell long, next long")
    got = {x.cell: (x.start, x.seq, x.link) for x in T.stream_links(streams, 100).collect()}
    assert got == {0: (0, 0, 0), 1: (0, 1, 0), 2: (2, 0, 1), 3: (2, 1, 1), 10: (10, 0, 2)}
    tree = T.link_tree(streams, T.stream_links(streams, 100))
    assert {x.link: x.strahler for x in T.strahler(tree).collect()} == {0: 1, 1: 2, 2: 1}


@pytest.mark.parametrize("size", [32, 256])
def test_wide_catchment_drains_whatever_the_tiles(spark, size):
    """A catchment wider than a tile: plain levels, directions without cycles, sums that account for every cell."""
    from freshet.operators.terrain import valid_cells
    from freshet.plans.terrain import route_terrain
    from freshet.sources.raster import synthetic_catchment

    cells = synthetic_catchment(spark, 40, 300, 5.0, pits=6, seed=3, border=1)
    t = route_terrain(valid_cells(cells), 300, 5.0, 60, 1, size)
    got = {(x.r, x.c): x.z for x in t.filled.collect()}
    plain = {(x.r, x.c): x.z for x in cells.where("z IS NOT NULL").collect()}
    assert got == filled(plain) and sum(got[p] > plain[p] for p in plain) > 10
    routed = t.routed.collect()
    ends = [x for x in routed if x.next is None]
    assert sum(x.accumulation for x in ends) == len(plain) and all(x.flowdir == T.OUTLET for x in ends)
    assert t.hand.where("hand < 0").count() == 0 and t.links.count() > 30


def test_epsilon_that_vanishes_is_refused(spark):
    cells = frame(spark, {(r, c): 1e6 for r in range(3) for c in range(3)}, 3)
    with pytest.raises(ValueError, match="vanishes"):
        T.fill_depressions(cells, epsilon=1e-4)


def test_strahler_counts_equal_tributaries(spark):
    tree = spark.createDataFrame([(1, 3), (2, 3), (3, 7), (4, 6), (5, 6), (6, 7), (7, 9), (8, 9), (9, None), (20, None)], "link long, down long")
    assert {x.link: x.strahler for x in T.strahler(tree).collect()} == {1: 1, 2: 1, 3: 2, 4: 1, 5: 1, 6: 2, 7: 3, 8: 1, 9: 3, 20: 1}
