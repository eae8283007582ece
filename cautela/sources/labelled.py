"""Labelled message files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cautela.functions.identifiers import name_uuid
from cautela.sources.delimited import FileRows, is_missing, missing_input, no_rejects, read_delimited
from cautela.sources.schemas import HAM_SPAM_TSV, LABELLED_COLUMNS, LABELLED_CSV

HAM_SPAM_LABELS = {"ham": 0, "spam": 1}


def read_labelled_csv(spark: SparkSession, path: str | Sequence[str]) -> FileRows:
    """UTF-8 CSV with a header, checked by name; quoted texts may hold line breaks, large files are read by many tasks."""
    return read_delimited(spark, path, LABELLED_CSV, what="Labelled file")


def read_existing(spark: SparkSession, paths: Sequence[str]) -> tuple[list[tuple[str, DataFrame]], DataFrame]:
    """(path, frame) of the inputs that exist, in order, and what was set aside, missing inputs included; fails if there is none."""
    found, rejected = [], no_rejects(spark)
    for path in paths:
        try:
            one = read_labelled_csv(spark, path)
        except AnalysisException as exc:
            if not is_missing(exc):
                raise
            rejected = rejected.union(missing_input(spark, path))
        else:
            found.append((path, one.rows))
            rejected = rejected.union(one.rejected)
    if not found:
        raise FileNotFoundError("No source dataset exists. Generate or fetch data first.")
    return found, rejected


def read_ham_spam(spark: SparkSession, path: str) -> FileRows:
    """Raw tab-separated corpus: label word and text, no header. A text in double quotes may hold tabs and line breaks."""
    return read_delimited(spark, path, HAM_SPAM_TSV, header=False, sep="\t")


def label_number(raw_label: Column) -> Column:
    """Null for a label word that is not known."""
    word = F.lower(raw_label)
    mapping = F.create_map(*[F.lit(x) for kv in HAM_SPAM_LABELS.items() for x in kv])
    return F.try_element_at(mapping, word)


def unknown_labels(raw: DataFrame) -> DataFrame:
    """The label words that are not in the map, with their rows."""
    return (
        raw.filter(label_number(F.col("raw_label")).isNull())
        .groupBy(F.lower(F.col("raw_label")).alias("raw_label"))
        .agg(F.count("*").alias("rows"))
    )


def ham_spam_records(raw: DataFrame, created_at: Column, position: Column, strict: bool = True) -> DataFrame:
    """The corpus in the labelled schema.

    ``position`` identifies the row within the corpus (a line number or a key); it enters the
    record id. With ``strict`` an unknown label word fails the job.
    """
    label = label_number(F.col("raw_label"))
    if strict:
        message = F.concat(F.lit("Unexpected label: "), F.coalesce("raw_label", F.lit("null")))
        label = F.when(label.isNull(), F.raise_error(message).cast("int")).otherwise(label)
    name = F.concat(F.lit("uci-228:"), position.cast("string"), F.lit(":"), F.col("text"))
    return raw.select(
        name_uuid(name).alias("record_id"),
        "text",
        label.alias("label"),
        F.lit("uci_sms_spam_collection_228").alias("source"),
        F.lit("public").alias("source_type"),
        F.lit("en").alias("language"),
        F.lit("source_documented").alias("review_status"),
        F.lit(False).alias("is_synthetic"),
        F.lit("review_source_terms_before_redistribution").alias("license"),
        created_at.cast("date").alias("created_at"),
    ).select(*LABELLED_COLUMNS)
