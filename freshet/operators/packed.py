"""Tiles as rows: a tile's columns are packed arrays, so that passes over a grid shuffle and convert tiles and the strips along their borders, not cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.operators.tiles import STEPS, place

#: What a packed column holds; any other name holds longs.
KINDS = {"r": "i4", "c": "i4", "z": "f8", "raw": "f8", "w": "f8", "seed": "?", "flowdir": "i2", "flat": "?", "resolved": "?", "amount": "f8", "accumulation": "f8", "hand": "f8"}
TYPES = {"i8": "long", "i4": "int", "i2": "smallint", "f8": "double", "?": "boolean"}
#: Stands for null among longs.
NULL = int(np.iinfo(np.int64).min)


def kind(name: str) -> str:
    return KINDS.get(name, "i8")


def _bytes(name: str, values) -> bytes:
    return np.ascontiguousarray(values, kind(name)).tobytes()


def _batch(tr: int, tc: int, out: dict, names: list[str], share: list[str], size: int) -> pa.RecordBatch:
    """A tile's row and, with share, a row for each tile beside it: the cells along that border with the columns shared."""
    keys, rows = [(tr, tc, True)], [{k: _bytes(k, out[k]) for k in names}]
    if share:
        r, c = out["r"] - tr * size, out["c"] - tc * size
        for a, b in STEPS:
            at = np.flatnonzero(((r == (size - 1 if a > 0 else 0)) | (a == 0)) & ((c == (size - 1 if b > 0 else 0)) | (b == 0)))
            if len(at):
                keys.append((tr + a, tc + b, False))
                rows.append({k: _bytes(k, np.asarray(out[k])[at]) for k in share})
    where = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.bool_()))]
    return pa.RecordBatch.from_arrays([*where, *(pa.array([x.get(k) for x in rows], pa.binary()) for k in names)], names=["tr", "tc", "own", *names])


def _schema(names: list[str]) -> str:
    return ", ".join(["tr int", "tc int", "own boolean", *(f"{k} binary" for k in names)])


def packed(cells: DataFrame, size: int, names: list[str]) -> DataFrame:
    """tr, tc, own and the packed columns of cells (r and c among them): each tile with its own cells and the strips of the tiles beside it."""
    tr, tc = place(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        whole = lambda: _batch(*key, {k: np.concatenate([x[k] for x in held]) for k in names}, names, names, size)
        for batch in batches:
            data = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("tr", "tc", *names)}
            turns = np.flatnonzero((np.diff(data["tr"]) != 0) | (np.diff(data["tc"]) != 0)) + 1
            for a, b in zip([0, *turns], [*turns, batch.num_rows], strict=True):
                if a < b:
                    here = (int(data["tr"][a]), int(data["tc"][a]))
                    if held and here != key:
                        yield whole()
                        held = []
                    key = here
                    held.append({k: data[k][a:b] for k in names})
        if held:
            yield whole()

    rows = cells.select(*[F.col(k).cast(TYPES[kind(k)]).alias(k) for k in names], tr.alias("tr"), tc.alias("tc"))
    return rows.repartition("tr", "tc").sortWithinPartitions("tr", "tc").mapInArrow(run, _schema(names))


def over_tiles(tiles: DataFrame, kernel: Callable, size: int, reads: list[str], names: list[str], share: list[str] | None = None, given: DataFrame | None = None, apart: list[str] | None = None, rim: bool = True) -> DataFrame:
    """Packed tiles whose columns (names) kernel returns as arrays, from a tile's cells (reads, own): its own first, then its rim's, if rim.

    share: columns that the tiles beside it see. Kernel gets a second frame or dict with given, rows (tr, tc, ...) of the tile, or with
    apart, the tile's columns that are not one value a cell.
    """
    more, columns = apart or [], [k for k in (given.columns if given is not None else []) if k not in ("tr", "tc")]
    rows = tiles.select("tr", "tc", "own", *reads, *more)
    if not rim:
        rows = rows.where("own")
    if given is not None:
        listed = given.groupBy("tr", "tc").agg(F.collect_list(F.struct(*columns)).alias("given"))  # of one tile
        rows = rows.where("own").join(listed.hint("merge"), ["tr", "tc"], "left")
    elif rim:
        rows = rows.repartition("tr", "tc").sortWithinPartitions("tr", "tc", F.desc("own"))

    def whole(key: tuple, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if held[0][0]:  # strips beside a tile that has no cells are of no use
            part = {k: np.concatenate([np.frombuffer(x[1 + i], kind(k)) for x in held]) for i, k in enumerate(reads)}
            counts = [len(x[1]) // np.dtype(kind(reads[0])).itemsize for x in held]
            frame, second = pd.DataFrame({**part, "own": np.repeat([x[0] for x in held], counts)}), []
            if more:
                second = [{k: np.frombuffer(held[0][1 + len(reads) + i], kind(k)) for i, k in enumerate(more)}]
            elif columns:
                second = [held[0][-1]]
            yield _batch(*key, kernel(frame, *second), names, share or [], size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                here = (batch.column("tr")[i].as_py(), batch.column("tc")[i].as_py())
                if held and here != key:
                    yield from whole(key, held)
                    held = []
                key, row = here, [batch.column("own")[i].as_py(), *(batch.column(k)[i].as_py() for k in [*reads, *more])]
                if columns:
                    found = batch.column("given")[i].values
                    row.append({k: found.field(k).to_numpy(zero_copy_only=False) if found is not None else np.array([], "i8") for k in columns})
                held.append(tuple(row))
        if held:
            yield from whole(key, held)

    return rows.mapInArrow(run, _schema(names))


def unpacked(tiles: DataFrame, names: list[str], rename: dict[str, str] | None = None, placed: bool = False) -> DataFrame:
    """One row per place of the packed columns (of one length) of tiles, NULL as null; with tr and tc, if placed."""
    types = [kind(k) for k in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = [np.frombuffer(batch.column(k)[i].as_py(), t) for k, t in zip(names, types, strict=True)]
                if len(row[0]):
                    cols = [pa.array(x, mask=x == NULL) if t == "i8" else pa.array(x) for x, t in zip(row, types, strict=True)]
                    where = [pa.array(np.full(len(row[0]), batch.column(k)[i].as_py(), "i4")) for k in ("tr", "tc")] if placed else []
                    yield pa.RecordBatch.from_arrays([*cols, *where], names=[*named, *(["tr", "tc"] if placed else [])])

    named = [(rename or {}).get(k, k) for k in names]
    schema = ", ".join([*(f"{n} {TYPES[t]}" for n, t in zip(named, types, strict=True)), *(["tr int", "tc int"] if placed else [])])
    return tiles.where("own").select("tr", "tc", *names).mapInArrow(run, schema)
