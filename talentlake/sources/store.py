"""Versioned tables of Parquet parts: a version is a manifest that names its parts, and is made by creating one file.

Readers take the newest manifest and see its version to the end, whatever is written meanwhile. Writers put their parts
under new names and then create the next manifest; if another writer was first, they look at that version and try again.
Appends of a stream carry the stream's name and batch number, which the manifest remembers, so that a batch that is
replayed is known. Erasure rewrites only the parts that hold a key. What no kept version names is deleted by vacuum().

A manifest is a small JSON text, as parts are large and few (compact() merges them); all rows stay in Spark.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Times that a writer tries again after another was first.
TRIES = 20
PART = "store_part"
#: Keys up to which a join sends them to every task through the driver.
FEW = 10_000


def keyed(keys: DataFrame) -> DataFrame:
    """Keys as the right side of a join: broadcast if a count finds few, else shuffled, so that the driver gets none."""
    return F.broadcast(keys) if keys.limit(FEW + 1).count() <= FEW else keys.hint("merge")


class Store:
    """A table at a path that driver and executors share, with columns of a given schema."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/versions"))

    # -- versions

    def versions(self) -> list[int]:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.root}/versions"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """{version, parts: [{path, rows}], batches: {stream: last batch}}; an empty table before the first version."""
        found = self.versions()
        if version is None and not found:
            return {"version": 0, "parts": [], "batches": {}}
        version = found[-1] if version is None else version
        stream = self._fs.open(self._path(f"{self.root}/versions/{version:012d}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> bool:
        """Create a manifest whole or not at all; False if another writer has its number."""
        target = self._path(f"{self.root}/versions/{manifest['version']:012d}.json")
        draft = self._path(f"{self.root}/drafts/{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            return False
        return True

    def _change(self, step: Callable[[dict], dict | None]) -> dict:
        """Apply a step to the newest version until it is published; a step that returns None changes nothing."""
        for _ in range(TRIES):
            now = self.manifest()
            changed = step(now)
            if changed is None:
                return now
            changed = {**changed, "version": now["version"] + 1}
            if self._publish(changed):
                return changed
        raise RuntimeError(f"{self.root}: other writers were first {TRIES} times")

    def _written(self, rows: DataFrame) -> list[dict]:
        """A new part of rows; none if there are no rows."""
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        names = self.spark.createDataFrame([], self.schema).columns
        rows.select(*names).write.option("compression", "zstd").parquet(path)
        n = self.spark.read.schema(self.schema).parquet(path).count()  # from the files' footers
        if n:
            return [{"path": path, "rows": n}]
        self._fs.delete(self._path(path), True)
        return []

    # -- reading and writing

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default. Its parts are named now: later versions don't change them."""
        return self._rows(self.manifest(version)["parts"])

    def _rows(self, parts: list[dict]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[p["path"] for p in parts])

    def append(self, rows: DataFrame, stream: str | None = None, batch: int | None = None) -> dict:
        """Add rows. With a stream's name and batch number, once: batches up to the last one known are left out."""

        def done(now: dict) -> bool:
            return stream is not None and now["batches"].get(stream, -1) >= batch

        now = self.manifest()
        if done(now):
            return now
        parts = self._written(rows)

        def step(now: dict) -> dict | None:
            if done(now) or (stream is None and not parts):
                return None
            return {"parts": now["parts"] + parts, "batches": now["batches"] | ({} if stream is None else {stream: batch})}

        return self._change(step)

    def erase(self, keys: DataFrame, column: str, stream: str | None = None, batch: int | None = None) -> dict:
        """Take out the rows whose column is among keys' first column. Only the parts that have some are written anew."""
        gone = keys.select(F.col(keys.columns[0]).alias(column)).where(F.col(column).isNotNull()).distinct()
        gone = keyed(gone)

        def step(now: dict) -> dict | None:
            if stream is not None and now["batches"].get(stream, -1) >= batch:
                return None
            parts = now["parts"]
            hit = set()
            if parts:
                marked = self._rows(parts).select(column, F.regexp_extract(F.input_file_name(), "/data/([0-9a-f]{32})/", 1).alias(PART))
                hit = {r[0] for r in marked.join(gone, column, "left_semi").select(PART).distinct().collect()}  # names of parts
            if not hit and stream is None:
                return None
            old = [p for p in parts if p["path"].rsplit("/", 1)[1] in hit]
            new = self._written(self._rows(old).join(gone, column, "left_anti")) if old else []
            return {"parts": [p for p in parts if p not in old] + new, "batches": now["batches"] | ({} if stream is None else {stream: batch})}

        return self._change(step)

    def compact(self, rows: int = 1_000_000) -> dict:
        """Merge the parts of fewer rows into one."""

        def step(now: dict) -> dict | None:
            small = [p for p in now["parts"] if p["rows"] < rows]
            if len(small) < 2:
                return None
            return {"parts": [p for p in now["parts"] if p not in small] + self._written(self._rows(small)), "batches": now["batches"]}

        return self._change(step)

    def vacuum(self, keep: int = 1) -> None:
        """Delete all versions but the last `keep`, and the parts that only they name. Run it when no reader of theirs and no
        writer is at work: what was erased is gone for good after it."""
        found = self.versions()
        kept = found[-keep:]
        named = {p["path"].rsplit("/", 1)[1] for v in kept for p in self.manifest(v)["parts"]}
        for v in found[: len(found) - len(kept)]:
            self._fs.delete(self._path(f"{self.root}/versions/{v:012d}.json"), False)
        data = self._path(f"{self.root}/data")
        for f in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if f.getPath().getName() not in named:
                self._fs.delete(f.getPath(), True)
