"""Reading parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_texts(spark: SparkSession, path: str, spread: int | None = None) -> DataFrame:
    """A table whose rows are expensive to process.

    Its tasks follow the files' row groups. ``spread`` deals the rows over so many tasks first; it is for callers who
    know that their table is a single row group, as the local bench does, and it never looks at sizes.
    """
    df = spark.read.parquet(path)
    return df if spread is None else df.repartition(spread)
