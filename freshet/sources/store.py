"""Tables on shared storage: reading the data set, cutting lineage, and the terrain store keyed by parameters."""

from __future__ import annotations

import hashlib
import json
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; only a session in one process may do without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="freshet-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _file(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the store that the path names holds it."""
    found, store = _file(spark, path)
    return store.exists(found)


def fingerprint(*tables: DataFrame) -> str:
    """A hash of the names, sizes and times of the files behind tables: changed files give another one. The store is asked, no row is read."""
    rows = []
    for t in tables:
        jvm, conf = t.sparkSession.sparkContext._jvm, t.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for name in t.inputFiles():
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
            state = path.getFileSystem(conf).getFileStatus(path)
            rows.append((name, state.getLen(), state.getModificationTime()))
    return hashlib.sha256(repr(sorted(rows)).encode()).hexdigest()[:16]


def content_hash(rows: DataFrame, columns: list[str]) -> tuple[int, int]:
    """Number of rows and a sum over their hashes: equal for equal rows in any order, repeated ones counted."""
    got = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*sorted(columns)).cast("decimal(38,0)")).alias("h")).first()
    return got["n"], int(got["h"] or 0)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/freshet/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def landed(df: DataFrame, name: str) -> DataFrame:
    """written, for what grows with a grid: joins shuffle it, and never broadcast it through the driver.

    Spark takes such a table for its compressed bytes, which are few beside its rows (ids in order, flags), so millions of rows would
    pass for a small table.
    """
    return written(df, name).hint("merge")


def params_hash(params: dict) -> str:
    """16 hex digits of the SHA-256 of the canonical JSON of params; values that JSON cannot hold exactly are refused."""

    def check(x):
        if isinstance(x, dict):
            for k, v in x.items():
                if not isinstance(k, str):
                    raise TypeError(f"key {k!r} is not a string")
                check(v)
        elif isinstance(x, (list, tuple)):
            for v in x:
                check(v)
        elif isinstance(x, float) and not math.isfinite(x):
            raise ValueError("a parameter is not finite")
        elif not isinstance(x, (str, int, float, bool, type(None))):
            raise TypeError(f"{type(x).__name__} has no canonical form")

    check(params)
    return hashlib.sha256(json.dumps(params, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


class TerrainStore:
    """Terrain artifacts as one Parquet data set per (unit, parameters); the committer's _SUCCESS makes an artifact whole."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, unit: str, key: str) -> str:
        if not unit.isdigit() or len(unit) % 2 or not 2 <= len(unit) <= 16:
            raise ValueError(f"{unit!r} is not a unit code of 2 to 16 digits, an even number")
        if not key or any(c not in "0123456789abcdef" for c in key):
            raise ValueError(f"{key!r} is not a parameter hash")
        return f"{self.root}/huc={unit}/params={key}"

    def exists(self, unit: str, key: str) -> bool:
        return exists(self.spark, f"{self._path(unit, key)}/_SUCCESS")

    def put(self, unit: str, key: str, cells: DataFrame) -> None:
        """Write beside the artifact and put it in its place when it is whole, so that a failed job leaves the old one."""
        final = self._path(unit, key)
        part = f"{self.root}/.part-{uuid.uuid4().hex}"
        cells.write.parquet(part)
        target, store = _file(self.spark, final)
        store.delete(target, True)
        store.mkdirs(target.getParent())
        if not store.rename(_file(self.spark, part)[0], target):
            raise OSError(f"{part} could not become {final}")

    def find(self, unit: str | None = None) -> DataFrame:
        """huc and params of the artifacts in the store, of one unit or all."""
        pattern = f"{self.root}/huc={unit or '*'}/params=*/_SUCCESS"
        found, store = _file(self.spark, pattern)
        names = [str(f.getPath().getParent()) for f in (store.globStatus(found) or [])]
        rows = [(n.split("/huc=")[1].split("/")[0], n.rsplit("/params=", 1)[1]) for n in names]
        return self.spark.createDataFrame(rows, "huc string, params string")

    def get(self, unit: str, key: str) -> DataFrame:
        return self.spark.read.parquet(self._path(unit, key))
