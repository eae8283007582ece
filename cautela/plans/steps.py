"""Jobs in steps that go on where an earlier run stopped.

A step's output counts if its marker is there and carries the fingerprint of all that went into it. The marker is taken
away before the output is written and put back after, so half an output is never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cautela.sources.folders import Files
from cautela.sources.sinks import write_dataset, write_document


def content_fingerprint(rows: DataFrame) -> str:
    """Of the columns and the rows in whatever order: one pass without a shuffle."""
    mark = F.sum(F.xxhash64(*(F.col(c) for c in rows.columns)).cast("decimal(38,0)"))
    count, total = rows.agg(F.count("*"), mark).first()
    return digest(rows.schema.simpleString(), count, total)


def digest(*parts) -> str:
    return hashlib.sha256("\x1f".join(map(str, parts)).encode()).hexdigest()


class Steps:
    """The finished steps of one job in its folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.markers = Files(spark, f"{self.folder}/_steps")
        self.built: list[str] = []

    def run(self, name: str, fingerprint: str, build: Callable[[], DataFrame], document: bool = False) -> DataFrame:
        """The step's output, from an earlier run if nothing that it depends on has changed; a document is one row of JSON."""
        marker, path = f"{name}.json", f"{self.folder}/{name}"
        reader = self.spark.read
        if self.markers.exists(marker):
            found = self.markers.read(marker)
            if found["fingerprint"] == fingerprint:
                schema = T._parse_datatype_json_string(found["schema"])
                return reader.schema(schema).json(path) if document else reader.schema(schema).parquet(path)
            self.markers.delete(marker)
        rows = build()
        (write_document if document else write_dataset)(rows, path)
        self.markers.create(marker, {"fingerprint": fingerprint, "schema": rows.schema.json()})
        self.built.append(name)
        return reader.schema(rows.schema).json(path) if document else reader.schema(rows.schema).parquet(path)
