"""The terrain half of an assessment: everything that does not depend on a discharge, written once per unit and parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.operators import terrain as T
from freshet.operators.packed import packed, unpacked
from freshet.sources.adapters import COLS, view
from freshet.sources.store import TerrainStore, fingerprint, landed, params_hash, shared_dir, table

#: Cells; small grids have small streams. Shorter head branches are pruned.
THRESHOLD, MIN_BRANCH = 30, 5
#: Cells a side of a tile: small beside the usual 256, so that the data set's narrow grid has several tiles each way.
TILE = 64
#: The unit that the data set's grid stands for in the terrain store.
UNIT = "00"


class Terrain:
    """raw, filled, first (directions), routed (cell, r, c, z, flowdir, next, accumulation, flat, resolved), mask (all stream cells), streams (pruned; cell, next), links and hand.

    A table is written when it is first read, so that a query pays for the steps that it needs; later ones find it. Up to routed the
    steps pass packed tiles on.
    """

    def __init__(self, cells: DataFrame, cols: int, cellsize: float = 1.0, threshold: float = THRESHOLD, min_branch: int = MIN_BRANCH, size: int = 256):
        self.cols, self.cellsize, self.threshold, self.min_branch, self.size = cols, cellsize, threshold, min_branch, size
        self._cells = cells

    @cached_property
    def raw_tiles(self) -> DataFrame:
        return landed(packed(self._cells, self.size, ["cell", "r", "c", "z"]), "raw_tiles")

    @cached_property
    def filled_tiles(self) -> DataFrame:
        return T.fill_tiles(self.raw_tiles, self.size)

    @cached_property
    def first_tiles(self) -> DataFrame:
        return T.direction_tiles(self.filled_tiles, self.size, self.cellsize)

    @cached_property
    def routed_tiles(self) -> DataFrame:
        return landed(T.routed_tiles(T.flat_tiles(self.first_tiles, self.size, self.cellsize), self.size), "routed_tiles")

    @cached_property
    def raw(self) -> DataFrame:
        return landed(unpacked(self.raw_tiles, ["cell", "r", "c", "z"]), "raw")

    @cached_property
    def filled(self) -> DataFrame:
        return landed(unpacked(self.filled_tiles, ["cell", "r", "c", "z", "raw"]), "filled")

    @cached_property
    def first(self) -> DataFrame:
        return landed(unpacked(self.first_tiles, ["cell", "r", "c", "z", "flowdir"]), "directions")

    @cached_property
    def routed(self) -> DataFrame:
        return landed(unpacked(self.routed_tiles, ["cell", "r", "c", "z", "flowdir", "flat", "resolved", "next", "accumulation"]), "routed")

    @cached_property
    def mask(self) -> DataFrame:
        mask = T.stream_mask(self.routed, self.threshold).select("cell", "next")
        kept = mask.join(mask.select(F.col("cell").alias("next"), F.lit(1).alias("in")), "next", "left")
        return landed(kept.select("cell", F.when(F.col("in") == 1, F.col("next")).alias("next")), "mask")

    @cached_property
    def streams(self) -> DataFrame:
        return landed(T.prune_streams(self.mask, self.min_branch), "streams")

    @cached_property
    def links(self) -> DataFrame:
        return landed(T.stream_links(self.streams, self.cols, self.size), "links")

    @cached_property
    def hand(self) -> DataFrame:
        return landed(T.reach_catchments(T.hand(self.routed, self.streams, self.size), self.links), "hand")


def route_terrain(cells: DataFrame, cols: int, cellsize: float = 1.0, threshold: float = THRESHOLD, min_branch: int = MIN_BRANCH, size: int = 256) -> Terrain:
    """Fill, directions, flats, accumulation, streams, links, height above drainage."""
    return Terrain(cells, cols, cellsize, threshold, min_branch, size)


_DONE: dict[tuple[str, str, str], Terrain] = {}


def terrain(spark: SparkSession, sf_dir: str) -> Terrain:
    """The terrain of the data set's grid, which all scenarios share; computed once per application and state of the table's files."""
    key = (spark.sparkContext.applicationId, sf_dir, fingerprint(table(spark, sf_dir, "lineitem")))
    if key not in _DONE:
        _DONE[key] = route_terrain(T.valid_cells(view(spark, sf_dir, "dem")), COLS, size=TILE)
    return _DONE[key]


def forget() -> None:
    """Compute the terrain anew at the next call."""
    _DONE.clear()


def scenario(spark: SparkSession, sf_dir: str, what: str, params: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """A table of the terrain store, built by its first reader: keyed by what it is, its parameters and the state of the grid's files."""
    store = TerrainStore(spark, f"{shared_dir(spark)}/freshet/scenarios")
    key = params_hash({"what": what, "application": spark.sparkContext.applicationId, "data": sf_dir, "files": fingerprint(table(spark, sf_dir, "lineitem")), **params})
    if not store.exists(UNIT, key):
        store.put(UNIT, key, build())
    return store.get(UNIT, key).hint("merge")  # as landed
