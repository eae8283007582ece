"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_dataset(dataset: DataFrame, path: str, file_format: str = "parquet") -> None:
    writer = dataset.write.mode("overwrite")
    if file_format == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(file_format).save(path)


def write_document(one_row: DataFrame, path: str) -> None:
    """A one-row frame (manifest, metadata, evaluation) as JSON."""
    one_row.write.mode("overwrite").json(path)
