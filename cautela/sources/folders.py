"""Folders that jobs share: small documents on any Hadoop file system, and which folders of a table count.

A table here is a set of batch folders. Many small ones are merged by ``compact``: the merged rows go to a folder of their own,
then one new snapshot document names that folder and the batches that it replaces. Readers take the newest snapshot and
all batches that it does not replace, so they see the old folders or the merged one, never both and never neither. A failure
before the snapshot leaves a folder that nobody reads.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Files:
    """The few file operations that a driver needs, on whatever file system a path lies."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._utf8 = lambda raw: spark.sparkContext._jvm.java.lang.String(raw, "UTF-8")

    def at(self, name: str):
        return self._path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def match(self, pattern: str) -> list[str]:
        """Paths below the root, relative to it, that fit a glob pattern."""
        found = self.fs.globStatus(self.at(pattern)) or []
        depth = pattern.count("/") + 1
        return sorted("/".join(s.getPath().toString().split("/")[-depth:]) for s in found)

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self.at(name)).getLength()

    def modified(self, name: str) -> int:
        return self.fs.getFileStatus(self.at(name)).getModificationTime()

    def read(self, name: str) -> dict:
        stream = self.fs.open(self.at(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def create(self, name: str, document: dict) -> bool:
        """Write a document that is not there yet, whole or not at all; False if another writer was first."""
        draft = f".{uuid.uuid4().hex}"
        stream = self.fs.create(self.at(draft), True)
        try:
            stream.write(json.dumps(document, sort_keys=True).encode())
        finally:
            stream.close()
        self.fs.mkdirs(self.at(name).getParent())
        if not self.fs.exists(self.at(name)) and self.fs.rename(self.at(draft), self.at(name)):
            return True
        self.fs.delete(self.at(draft), False)
        return False

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


BATCHES, SMALL_BYTES = "run=*/batch=*", 128 << 20


def _snapshot(files: Files) -> tuple[int, dict]:
    names = files.match("snapshot-*.json")
    if not names:
        return 0, {"merged": [], "replaced": []}
    return int(names[-1][9:-5]), files.read(names[-1])


def _state(spark: SparkSession, path: str) -> tuple[int, dict, list[str]]:
    """Newest snapshot and the batches that count beside its merged folders."""
    number, snapshot = _snapshot(Files(spark, f"{path}-compacted"))
    gone = set(snapshot["replaced"])
    # Listed after the snapshot was read: what it replaces is still there or not, both are left out.
    return number, snapshot, [b for b in Files(spark, path).match(BATCHES) if b not in gone]


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of a table of batch folders, each once."""
    _, snapshot, batches = _state(spark, path)
    folders = [f"{path}-compacted/{m}" for m in snapshot["merged"]] + [f"{path}/{b}" for b in batches]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def compact(spark: SparkSession, path: str, schema: str, small: int = SMALL_BYTES) -> int:
    """Merge the small batches that count into files of about ``small`` bytes; returns how many were merged.

    Merged folders that are themselves small are merged again, so their number stays low.
    """
    number, snapshot, batches = _state(spark, path)
    table, merged = Files(spark, path), Files(spark, f"{path}-compacted")
    sizes = {f"{path}/{b}": table.size(b) for b in batches} | {f"{path}-compacted/{m}": merged.size(m) for m in snapshot["merged"]}
    chosen = [f for f, size in sizes.items() if size < small]
    if len(chosen) < 2:
        return 0
    name = f"merged={uuid.uuid4().hex}"
    parts = max(1, -(-sum(sizes[f] for f in chosen) // small))
    rows = spark.read.schema(schema).parquet(*chosen)
    rows.repartition(parts).write.parquet(f"{path}-compacted/{name}")
    taken = {f.removeprefix(f"{path}/") for f in chosen}
    following = {
        "merged": [m for m in snapshot["merged"] if f"{path}-compacted/{m}" not in chosen] + [name],
        "replaced": sorted({*snapshot["replaced"], *(b for b in batches if b in taken)}),
    }
    if not merged.create(f"snapshot-{number + 1:012}.json", following):
        merged.delete(name)  # another compaction was first
        return 0
    return len(chosen)


def vacuum(spark: SparkSession, path: str, keep_millis: int) -> list[str]:
    """Delete what the newest snapshot does not need and that was replaced longer ago than any reader takes."""
    merged, table = Files(spark, f"{path}-compacted"), Files(spark, path)
    number, snapshot = _snapshot(merged)
    if not number:
        return []
    import time

    if time.time() * 1000 - merged.modified(f"snapshot-{number:012}.json") < keep_millis:
        return []
    unused = [b for b in table.match(BATCHES) if b in set(snapshot["replaced"])]
    stale = [m for m in merged.match("merged=*") if m not in snapshot["merged"]]
    for name in unused:
        table.delete(name)
    for name in stale:
        merged.delete(name)
    return [*unused, *stale]
