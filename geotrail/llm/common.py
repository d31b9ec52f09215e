"""Helpers shared by the operators: reading, written intermediates, hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input. Python gets it in batches of few rows, as one row may be a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, df: DataFrame) -> str:
    """A name that no column has, in whatever letter case, with as many underscores in front as it takes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder of the cluster. Where none is set, local mode gets a temporary one; a cluster must set it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str | None = None, **options: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts lineage, computes once, survives lost executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that materialize() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark deletes the files of a query's shuffles when the query ends, not when the driver happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


_HELD: dict[str, Any] = {}


def held(key: tuple, make: Callable[[], Any]) -> Any:
    """A large helper of this Python worker. Only the last one asked for is kept, as workers serve one stage after another."""
    if _HELD.get("key") != key:
        if _HELD:
            _HELD.clear()
            gc.collect()
            try:
                ctypes.CDLL(None).malloc_trim(0)  # give freed memory back to the system
            except (OSError, AttributeError):
                pass
        value = make()
        _HELD.update(key=key, value=value)
    return _HELD["value"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (finalizer with two multiplications)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class RollingHash:
    """Polynomial hashes of all substrings of a byte string, by prefix sums modulo 2**64.

    Every byte gets a random 64-bit value, so equal substrings have equal hashes wherever they stand.
    Two instances with different seeds make a 128-bit hash.
    """

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 2**64, 256, dtype=np.uint64)
        self.base = int(rng.integers(0, 2**63)) * 2 + 1
        self.inverse = pow(self.base, -1, 2**64)
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps, dtype=np.uint64))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], dtype=np.uint64, out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of data[start:stop]."""
        return mix64((prefix[stop] - prefix[start]) * self.down[start])

    def sliding(self, prefix: np.ndarray, width: int) -> np.ndarray:
        """Hashes of data[i:i+width] for every i."""
        n = len(prefix) - width
        return mix64((prefix[width:] - prefix[:-width]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)
