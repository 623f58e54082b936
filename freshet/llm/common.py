"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.operators.graph import spread_join  # noqa: F401  (the corpus operators take it from here)
from freshet.sources.store import shared_dir, table  # noqa: F401

#: White space that separates words in every contract: blank, and tab to carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD_BYTES = rb"[^\x20\x09-\x0D]+"


_SCOPE: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """On leaving, delete what `written` put into the shared folder meanwhile; what is still needed must be written elsewhere by then."""
    _SCOPE.append(f"scratch-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        remove(spark, f"{shared_dir(spark)}/freshet/{_SCOPE.pop()}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back.

    Later stages survive the loss of executors, as the files belong to none of them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/freshet/{_SCOPE[-1] + '/' if _SCOPE else ''}{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a batch that a kernel works on at once.
PIECE = 4 << 20


def released() -> None:
    """Give free memory of this process back to the system, as a worker stays for later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def lean(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """kernel for mapInArrow on pieces of bounded bytes (a row at least), whatever the rows of a batch; memory is given back at a task's end.

    Spark bounds batches in rows alone, so ten thousand long texts would otherwise be Python objects at once.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * PIECE // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(pieces(batches))
        finally:
            released()

    return run


def crc_fold(doc_id, folds: int):
    """crc32 of the id's decimal text, modulo folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def learning_sample(docs: DataFrame, labels: DataFrame, target: str, fold, folds: int, held: int, per_class: int) -> DataFrame:
    """(doc_id, text, label) of at most about per_class labelled rows of each class outside the held-out fold.

    The sample is drawn by a hash of doc_id, so that it does not depend on partitioning. It is bounded by per_class, which
    makes the broadcast of its ids safe at any input size; the texts are never shuffled. Rows of one doc_id share its label.
    """
    known = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held)).groupBy("doc_id").agg(F.max(target).alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for label in (0, 1):
        share = F.when(F.col("label") == label, min(1.0, per_class / max(1, sizes.get(label, 0)))).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    picked = known.where(draw < share)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label")


def logistic_curve(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of P(label = 1 | margin), by Newton steps with a small ridge."""
    x = np.column_stack([margin, np.ones(len(margin))])
    b = np.array([1.0, 0.0])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (weight * (p - label)) + 1e-3 * b
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        b -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(b[0], 1e-6)), float(b[1])
