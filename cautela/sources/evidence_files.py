"""Evidence tables kept as CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cautela.operators.validation import require_rows
from cautela.sources.delimited import FileRows, read_delimited
from cautela.sources.schemas import EVIDENCE_SCHEMAS


def read_evidence_csv(spark: SparkSession, path: str, table: str) -> FileRows:
    """Rows that fit the table's schema, and the others as they stand. A byte order mark is ignored."""
    return read_delimited(spark, path, EVIDENCE_SCHEMAS[table], what="Evidence file")


def read_required_evidence(spark: SparkSession, path: str, table: str) -> DataFrame:
    good = read_evidence_csv(spark, path, table).rows
    require_rows(good, f"Evidence file {path}")
    return good
