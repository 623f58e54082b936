"""Near-duplicates among embeddings: PCA-ordered tiles, compared leading dimensions first.

1. Equal vectors of one label form a class; its least vec_id stands for it and its size counts as links.
2. A rotation from principal components (fitted on a bounded sample; any rotation gives the same result, only the speed differs)
   moves most of the variance into the leading dimensions. Rows are range-partitioned by label and by the interleaved bits of the
   leading coordinates, and cut into blocks of at most `block_bytes`, and these into tiles of at most `rows` vectors, each with the
   box of its leading coordinates.
3. Two blocks of a label meet only if their boxes are near enough for the threshold, and so do two tiles of theirs. A label's blocks
   are few (a block holds thousands of vectors) and meet on salted keys, so one label that all vectors carry is spread too.
4. In a pair of tiles, products are accumulated over blocks of dimensions; what the rest can add is bounded by the product of the
   suffix norms. Once no pair can reach the threshold the tiles are done; once few can, only those go on. Survivors are confirmed by
   the cosine of the unrotated vectors in double precision.
5. Links are counted per block pair, and only a spanning forest of them goes to the components.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows without a label, link with nothing
(n_links 0, their own component, kept); vectors of different length never link; labels of any simple type are compared as they
are; an empty table gives an empty one; other columns are ignored; vec_id is a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import written
from freshet.llm.components import components

LEADING = 8


def principal_axes(sample: list[np.ndarray]) -> dict[int, np.ndarray]:
    """By vector length, an orthonormal basis with the axes of most variance first."""
    out = {}
    for n in {len(v) for v in sample}:
        x = np.array([v for v in sample if len(v) == n])
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        x = x - x.mean(axis=0)
        _, axes = np.linalg.eigh(x.T @ x)
        out[n] = np.ascontiguousarray(axes[:, ::-1])
    return out


def _units(raw: np.ndarray) -> np.ndarray:
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def interleaved(lead: np.ndarray, bits: int = 10) -> np.ndarray:
    """Z-order code of the first three coordinates, which lie in [-1, 1]."""
    q = np.clip(((lead[:, :3] + 1) * (1 << (bits - 1))).astype(np.int64), 0, (1 << bits) - 1)
    code = np.zeros(len(lead), np.int64)
    for b in range(bits):
        for d in range(q.shape[1]):
            code |= ((q[:, d] >> b) & 1) << (b * 3 + d)
    return code


def tile_links(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float, blocks: tuple[int, ...] = (8, 16, 32), slack: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of x and j of y whose cosine reaches the threshold."""
    ux, uy = _units(x), _units(y)
    a, b = ux @ axes, uy @ axes
    n = a.shape[1]
    edges = [0, *[e for e in blocks if e < n], n]
    rest = lambda m, e: np.sqrt(np.maximum(0.0, (m[:, e:] ** 2).sum(axis=1)))
    total = np.zeros((len(a), len(b)))
    for lo, hi in zip(edges, edges[1:], strict=False):
        total += a[:, lo:hi] @ b[:, lo:hi].T
        i, j = np.nonzero(total + np.outer(rest(a, hi), rest(b, hi)) >= threshold - slack)
        if not len(i) or len(i) < 0.05 * total.size or hi == n:
            break
    sums = total[i, j]
    for lo, hi in zip(edges[edges.index(hi) :], edges[edges.index(hi) + 1 :], strict=False):
        sums = sums + np.einsum("ij,ij->i", a[i, lo:hi], b[j, lo:hi])
        may = sums + rest(a, hi)[i] * rest(b, hi)[j] >= threshold - slack
        i, j, sums = i[may], j[may], sums[may]
    p, q = x[i], y[j]
    cosine = np.einsum("ij,ij->i", p, q) / (np.linalg.norm(p, axis=1) * np.linalg.norm(q, axis=1)) if len(i) else np.zeros(0)
    good = cosine >= threshold
    return i[good], j[good]


def _forest(u: list[int], v: list[int]) -> list[tuple[int, int]]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    out = []
    for a, b in zip(u, v, strict=True):
        if (r := root(a)) != (s := root(b)):
            up[max(r, s)] = min(r, s)
            out.append((a, b))
    return out


_BLOCK = "label string, dim int, block long, lo array<double>, hi array<double>, ids binary, copies binary, rows binary"
_BLOCK_ARROW = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("block", pa.int64()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("ids", pa.binary()), ("copies", pa.binary()), ("rows", pa.binary())])


def _leading(raw: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    return _units(raw) @ axes.get(raw.shape[1], np.eye(raw.shape[1]))[:, :LEADING]


def _blocks(reps: DataFrame, axes: dict[int, np.ndarray], block_bytes: int) -> DataFrame:
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.array(v.as_py(), np.float64) for v in batch.column(3)]
            dims = np.array([len(v) for v in vectors])
            code = np.zeros(len(vectors), np.int64)
            for n in set(dims.tolist()):
                code[dims == n] = interleaved(_leading(np.array([v for v in vectors if len(v) == n]), axes))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(dims, pa.int32()), pa.array(code), pa.array([v.tobytes() for v in vectors], pa.binary())], ["label", "rep", "copies", "dim", "code", "vector"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def whole() -> pa.RecordBatch:
            nonlocal block
            raw = np.frombuffer(b"".join(r[4] for r in held), np.float64).reshape(len(held), -1)
            at = _leading(raw, axes)
            block += 1
            row = {"label": held[0][0], "dim": held[0][1], "block": block, "lo": at.min(axis=0), "hi": at.max(axis=0), "ids": np.array([r[2] for r in held], np.int64).tobytes(), "copies": np.array([r[3] for r in held], np.int64).tobytes(), "rows": raw.tobytes()}
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK_ARROW)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and ((len(held) + 1) * row[1] * 8 > block_bytes or row[:2] != held[0][:2]):
                    yield whole()
                held.append(row)
        if held:
            yield whole()

    parts = max(1, int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = reps.select("label", "rep", "copies", "embedding").mapInArrow(coded, "label string, rep long, copies long, dim int, code long, vector binary")
    order = ["label", "dim", "code", "rep"]
    return keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("label", "dim", "rep", "copies", "vector").mapInArrow(cut, _BLOCK)


def block_links(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float, rows: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of x and j of y that link (i < j if both are one block), tile by tile; tiles whose boxes lie too far apart are skipped."""
    def boxes(m: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        at = _units(m) @ axes[:, :LEADING]
        return [(k, m[k : k + rows], at[k : k + rows].min(axis=0), at[k : k + rows].max(axis=0)) for k in range(0, len(m), rows)]

    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    right = boxes(y)
    for k, a, lo, hi in boxes(x):
        for m, b, low, high in right:
            gap = np.maximum(0.0, np.maximum(lo - high, low - hi))
            if same and m < k or gap @ gap > 2 - 2 * threshold + 1e-9:
                continue
            i, j = tile_links(a, b, axes, threshold)
            i, j = i + k, j + m
            found.append((i[i < j], j[i < j]) if same else (i, j))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _links(blocks: DataFrame, axes: dict[int, np.ndarray], threshold: float, rows: int, salts: int = 32) -> DataFrame:
    """rep and n (copies linked), or u and v of a forest edge, for every pair of near blocks."""
    side = lambda k, *names: blocks.select("label", "dim", *[F.col(c).alias(c + k) for c in names])
    apart = F.zip_with(F.zip_with("lo1", "hi2", lambda a, b: a - b), F.zip_with("lo2", "hi1", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    near = F.aggregate(apart, F.lit(0.0), lambda s, d: s + d * d) <= 2 - 2 * threshold + 1e-9
    one = side("1", "block", "lo", "hi").withColumn("salt", F.pmod(F.xxhash64("block1"), F.lit(salts)))
    two = side("2", "block", "lo", "hi").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    pairs = one.join(two, ["label", "dim", "salt"]).where((F.col("block1") <= F.col("block2")) & near).select("block1", "block2")
    body = lambda k: blocks.select(F.col("block").alias(f"block{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("ids", "copies", "rows")])
    full = pairs.join(body(1), "block1").join(body(2), "block2")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        """The links of one pair of blocks, which is all that a task holds at a time."""
        b1, b2, i1, c1, r1, i2, c2, r2 = (c[0].as_py() for c in table.columns)
        ids1, ids2 = np.frombuffer(i1, np.int64), np.frombuffer(i2, np.int64)
        x, y = (np.frombuffer(r, np.float64).reshape(len(k), -1) for r, k in ((r1, ids1), (r2, ids2)))
        i, j = block_links(x, y, axes.get(x.shape[1], np.eye(x.shape[1])), threshold, rows, b1 == b2)
        n1 = np.bincount(i, np.frombuffer(c2, np.int64)[j], len(ids1)).astype(np.int64)
        n2 = np.bincount(j, np.frombuffer(c1, np.int64)[i], len(ids2)).astype(np.int64)
        rep, n = np.concatenate([ids1[n1 > 0], ids2[n2 > 0]]).tolist(), np.concatenate([n1[n1 > 0], n2[n2 > 0]]).tolist()
        edges = _forest(ids1[i].tolist(), ids2[j].tolist())
        none, more = [None] * len(rep), [None] * len(edges)
        columns = {"rep": rep + more, "n": n + more, "u": none + [e[0] for e in edges], "v": none + [e[1] for e in edges]}
        return pa.table({k: pa.array(v, pa.int64()) for k, v in columns.items()})

    # A pair of blocks is one row and one group, so batches hold two blocks without any session setting.
    chosen = full.select("block1", "block2", "ids1", "copies1", "rows1", "ids2", "copies2", "rows2")
    return chosen.groupBy("block1", "block2").applyInArrow(compare, "rep long, n long, u long, v long")


def embedding_near_duplicates(vectors: DataFrame, threshold: float = 0.93, rows: int = 256, fit_rows: int = 10_000, block_bytes: int = 1 << 20) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector; fit_rows bounds the sample that the rotation is fitted on."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.col("label") + 0.0 if vectors.schema["label"].dataType.typeName() in ("float", "double") else F.col("label")  # -0.0 is 0.0
    fine = F.coalesce(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    keys = written(vectors.select(F.col("vec_id").cast("long"), label.cast("string").alias("label"), "embedding", fine.alias("fine")).select("vec_id", "label", "embedding", "fine", F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2")), "vectors")
    same = ["label", "k1", "k2"]
    reps = written(keys.where("fine").groupBy(*same).agg(F.min(F.struct("vec_id", "embedding")).alias("x"), F.count("*").alias("copies")).select(*same, F.col("x.vec_id").alias("rep"), F.col("x.embedding").alias("embedding"), "copies"), "representatives")
    share = fit_rows / max(1, reps.count())
    sample = reps.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < share * (1 << 20)).select("embedding").toArrow()
    axes = principal_axes([np.array(v.as_py(), np.float64) for v in sample.column("embedding")])
    blocks = written(_blocks(reps, axes, block_bytes), "blocks")
    found = written(_links(blocks, axes, threshold, rows), "links")
    counts = found.where("rep IS NOT NULL").groupBy("rep").agg(F.sum("n").alias("n"))
    label = components(found.where("u IS NOT NULL").select("u", "v"))
    named = reps.select(*same, "rep", "copies").join(counts, "rep", "left").join(label.select(F.col("node").alias("rep"), F.col("label").alias("class")), "rep", "left")
    named = named.select(*same, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("class", "rep").alias("class"), F.lit(True).alias("fine"))
    out = keys.drop("embedding").join(named, [*same, "fine"], "left").select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("class", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
