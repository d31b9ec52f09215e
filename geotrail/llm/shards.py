"""Sharding with size-tiered compaction and a versioned manifest.

Arrivals are appended as runs, folders of small immutable files. When enough runs of similar size have gathered they are
merged into one run of target-sized files, without a shuffle. Every change is one new manifest version, published by an
atomic rename that fails if another writer was first; that writer's change is then read and the own one is made anew on
top of it. Readers see a version whole or not at all, and old versions can be read until vacuum().
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, shared_dir


class ShardStore:
    """A table of shards below path. fanout runs, none over ratio times the smallest, are merged into files of target_bytes."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 4, ratio: float = 2.0, target_bytes: int = 128_000_000) -> None:
        self.spark, self.path = spark, path or shared_dir(spark)
        self.fanout, self.ratio, self.target = fanout, ratio, target_bytes
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _path(self, *names: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    @property
    def _fs(self):
        return self._path().getFileSystem(self.conf)

    def versions(self) -> list[int]:
        """All published versions, ascending."""
        at = self._path("manifest")
        if not self._fs.exists(at):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(at)]
        return sorted(int(n[1:]) for n in names if n.startswith("v"))

    def latest(self) -> int:
        """The latest version; 0 where nothing has been published."""
        return (self.versions() or [0])[-1]

    def manifest(self, version: int | None = None) -> list[dict]:
        """The runs of a version, the latest by default: name, bytes, rows, files, level. One entry for each run, not each file."""
        version = self.latest() if version is None else version
        if version == 0:
            return []
        stream = self._fs.open(self._path("manifest", f"v{version:012d}"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, runs: list[dict], after: int) -> int:
        """Publish runs as the version that follows after; raises FileExistsError if another writer was first."""
        draft, final = self._path("manifest", f".{uuid.uuid4().hex}"), self._path("manifest", f"v{after + 1:012d}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(runs).encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self.conf)
        kinds = self.spark.sparkContext._gateway.new_array(getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(draft, final, kinds)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if self._fs.exists(final):
                raise FileExistsError(f"version {after + 1} exists") from e
            raise
        return after + 1

    def change(self, edit: Callable[[list[dict]], list[dict] | None]) -> int:
        """Publish edit(runs of the latest version). Where another writer was first, edit gets that writer's runs; None leaves all as it is."""
        while True:
            version = self.latest()
            runs = edit(self.manifest(version))
            if runs is None:
                return version
            try:
                return self.commit(runs, version)
            except FileExistsError:
                continue

    def _run(self, name: str, level: int) -> dict:
        content = self._fs.getContentSummary(self._path("runs", name))
        files = [f for f in self._fs.listStatus(self._path("runs", name)) if f.getPath().getName().startswith("part-")]
        rows = self.spark.read.parquet(f"{self.path}/runs/{name}").count()
        return {"name": name, "bytes": content.getLength(), "rows": rows, "files": len(files), "level": level}

    def append(self, rows: DataFrame) -> int:
        """One arrival as one new run; then merges what has become due. Returns the version."""
        name = uuid.uuid4().hex
        rows.write.option("compression", "zstd").parquet(f"{self.path}/runs/{name}")
        return self._add(name)

    def append_all(self, rows: DataFrame, arrival: str) -> int:
        """Every value of a column with few values as an arrival of its own, in order, written by one job."""
        batch = uuid.uuid4().hex
        rows.write.partitionBy(arrival).option("compression", "zstd").parquet(f"{self.path}/runs/{batch}")
        names = sorted((f.getPath().getName() for f in self._fs.listStatus(self._path("runs", batch)) if f.isDirectory()), key=lambda n: (len(n), n))
        version = self.latest()
        for name in names:
            version = self._add(f"{batch}/{name}")
        return version

    def _add(self, name: str) -> int:
        new = self._run(name, 0)
        version = self.change(lambda runs: [*runs, new])
        while due := self.due(self.manifest(version)):
            version = self.merge(due)
        return version

    def due(self, runs: list[dict]) -> list[dict]:
        """The smallest similarly sized runs, if there are fanout of them and they are not full files already."""
        runs = sorted(runs, key=lambda r: (r["bytes"], r["name"]))
        for k in range(len(runs) - self.fanout + 1):
            group = [r for r in runs[k:] if r["bytes"] <= self.ratio * max(1, runs[k]["bytes"])]
            if len(group) >= self.fanout and (sum(r["files"] for r in group) > self.files_for(sum(r["bytes"] for r in group))):
                return group
        return []

    def files_for(self, size: int) -> int:
        return max(1, math.ceil(size / self.target))

    def merge(self, runs: list[dict]) -> int:
        """Runs as one run of target-sized files. Where another writer has merged one of them meanwhile, that merge stands."""
        name = uuid.uuid4().hex
        rows = self.read_runs(runs)
        rows.coalesce(self.files_for(sum(r["bytes"] for r in runs))).write.option("compression", "zstd").parquet(f"{self.path}/runs/{name}")
        gone, new = {r["name"] for r in runs}, self._run(name, 1 + max(r["level"] for r in runs))

        def replaced(now: list[dict]) -> list[dict] | None:
            rest = [r for r in now if r["name"] not in gone]
            return [*rest, new] if len(rest) + len(gone) == len(now) else None

        return self.change(replaced)

    def read_runs(self, runs: list[dict]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/runs/{r['name']}" for r in runs])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        return self.read_runs(self.manifest(version))

    def vacuum(self) -> None:
        """Delete what the latest version does not need; older versions can't be read any more. No writer may be at work."""
        version = self.latest()
        keep = {r["name"].split("/")[0] for r in self.manifest(version)}
        for f in self._fs.listStatus(self._path("runs")):
            if f.getPath().getName() not in keep:
                self._fs.delete(f.getPath(), True)
        for v in [v for v in self.versions() if v < version]:
            self._fs.delete(self._path("manifest", f"v{v:012d}"), False)


def compacted(docs: DataFrame, arrivals: int = 8, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The table after its rows came in as arrivals, dealt by the id, and were compacted: all rows and columns, and arrival.

    Rows are never changed or merged: nulls, repeated rows and other columns come back as they are; a null id belongs to
    arrival 0. An empty table is one empty run. Where a column is named arrival already, the added one is _arrival.
    """
    store = ShardStore(docs.sparkSession, **options)
    arrival = F.coalesce(F.pmod(F.col(id_col), F.lit(arrivals)), F.lit(0)).cast("int")
    name, batch = free_name("arrival", docs), free_name("batch", docs)
    rows = docs.withColumn(name, arrival).withColumn(batch, arrival)
    if rows.limit(1).collect():
        store.append_all(rows, batch)
    else:
        store.append(rows.drop(batch))
    return store.read().select(*docs.columns, name)


