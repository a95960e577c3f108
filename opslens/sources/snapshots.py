"""Tables replaced as a whole: readers see the state before a write or after it, never a part.

A table is a folder with one folder of Parquet files for each written bucket and version, and ``_versions``, a log of
manifests named by version. A manifest lists the folder of every bucket and the epoch of the write. A write puts its
files in folders no manifest knows yet and then creates the next manifest by a rename, which is what makes it count; a
writer that stops before leaves folders that nobody reads. Two writers that start from one version both try to create
the same manifest: one of them fails and nothing of its write is seen. A write whose epoch the table has is a replay and
changes nothing. Older versions stay readable until ``vacuum``. The file system's rename must not replace a file that
is there (as in HDFS); a local one is safe with one writer.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.session import cut_lineage
from opslens.sources.tables import BUCKET, DEFAULT_BUCKETS

LOG = "_versions"


class ConcurrentWrite(RuntimeError):
    """Another write came first; the caller reads the new state and tries again."""


class Snapshot:
    """A table of one row per key, hashed into buckets."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = DEFAULT_BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def versions(self) -> list[int]:
        fs, at = self._fs(f"{self.path}/{LOG}")
        if not fs.exists(at):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(at))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict | None:
        """{"version", "epoch", "buckets", "folders": {bucket: folder}} of a version, the newest if none is named."""
        if version is None:
            known = self.versions()
            if not known:
                return None
            version = known[-1]
        fs, at = self._fs(f"{self.path}/{LOG}/{version:020d}.json")
        file = fs.open(at)
        try:
            body = bytes(file.readAllBytes())
        finally:
            file.close()
        return json.loads(body)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version; None if nothing was ever written."""
        m = self.manifest(version)
        return None if m is None else self._rows(m, m["folders"])

    def _rows(self, m: dict, buckets) -> DataFrame:
        folders = sorted({m["folders"][b] for b in buckets})
        schema = m["schema"]
        if not folders:
            return self.spark.createDataFrame([], schema)
        # files by name: the folders of a version lie under several writes
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*(f"{self.path}/{f}" for f in folders))

    def upsert(self, batch: DataFrame, merge: Callable[[DataFrame | None, DataFrame], DataFrame], epoch: int | None = None,
               before_swap: Callable[[], None] | None = None) -> bool:
        """Merge ``batch`` (one row per key) into the table; False if ``epoch`` was written before.

        Only buckets that the batch touches are read and written anew. ``before_swap`` runs between the two steps.
        """
        m = self.manifest() or {"version": -1, "epoch": None, "buckets": self.buckets, "folders": {}, "schema": None}
        if m["buckets"] != self.buckets:
            raise ValueError(f"{self.path} has {m['buckets']} buckets, not {self.buckets}")
        if epoch is not None and m["epoch"] is not None and epoch <= m["epoch"]:
            return False
        at = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        batch = cut_lineage(batch)
        touched = [str(r[0]) for r in batch.select(at).distinct().collect()]  # at most ``buckets`` numbers
        kept = [b for b in touched if b in m["folders"]]
        merged = merge(self._rows(m, kept) if kept else None, batch)
        folder = f"data-{uuid.uuid4().hex}"
        merged.withColumn(BUCKET, at).repartition(max(1, len(touched)), BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        if before_swap:
            before_swap()
        fs, root = self._fs(f"{self.path}/{folder}")
        made = {x.getPath().getName().partition("=")[2] for x in fs.listStatus(root) if x.isDirectory()}
        folders = {b: f for b, f in m["folders"].items() if b not in touched} | {b: f"{folder}/{BUCKET}={b}" for b in made if b.isdigit()}
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in merged.schema)
        self._swap({"version": m["version"] + 1, "epoch": m["epoch"] if epoch is None else epoch, "buckets": self.buckets,
                    "schema": schema, "folders": folders})
        return True

    def _swap(self, m: dict) -> None:
        """Create the manifest of the next version; it appears whole or not at all."""
        fs, log = self._fs(f"{self.path}/{LOG}")
        fs.mkdirs(log)
        _, target = self._fs(f"{self.path}/{LOG}/{m['version']:020d}.json")
        _, draft = self._fs(f"{self.path}/{LOG}/.{uuid.uuid4().hex}.draft")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(m).encode()))
        finally:
            out.close()
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise ConcurrentWrite(f"{self.path}: version {m['version']} was written by another")

    def vacuum(self, keep: int = 1) -> int:
        """Delete what the newest ``keep`` versions do not use, leftovers of stopped writes included; the number of folders gone.

        Not to be run beside a writer: its folders are known to no manifest yet.
        """
        known = self.versions()
        used = {f.split("/")[0] for v in known[-keep:] for f in self.manifest(v)["folders"].values()}
        fs, root = self._fs(self.path)
        gone = 0
        for s in fs.listStatus(root) if fs.exists(root) else []:
            name = s.getPath().getName()
            if name.startswith("data-") and name not in used:
                fs.delete(s.getPath(), True)
                gone += 1
        for v in known[:-keep]:
            fs.delete(self._fs(f"{self.path}/{LOG}/{v:020d}.json")[1], False)
        return gone

