"""Training-set preparation: union, validate, resolve copies and conflicts, fingerprint, count."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cautela.functions.text import dedupe_key, normalise
from cautela.operators.ranking import random_key, with_position
from cautela.operators.validation import binary_label, require_columns
from cautela.sources.schemas import LABELLED_COLUMNS

TEXT_MIN = 3


def combine_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL; ``source_rank`` remembers the input order, which is the order of precedence."""
    if not frames:
        raise FileNotFoundError("No source dataset exists. Generate or fetch data first.")
    for i, frame in enumerate(frames):
        require_columns(frame, LABELLED_COLUMNS, f"Source {i}")
    ranked = [
        f.select(F.lit(i).alias("source_rank"), *LABELLED_COLUMNS) for i, f in enumerate(frames)
    ]
    return reduce(lambda a, b: a.unionByName(b), ranked)


def validate_records(records: DataFrame, strict: bool = True) -> DataFrame:
    """Normalise the text, read the label as 0 or 1 and name what is wrong with a row.

    With ``strict`` a label other than 0 and 1 fails the job when that row is read; otherwise the
    row is rejected like one without usable text.
    """
    label = binary_label(F.col("label"))
    if strict:
        problem = F.concat(
            F.lit("Labels must contain only 0 and 1, found: "), F.coalesce(F.col("label").cast("string"), F.lit("null"))
        )
        label = F.when(label.isNull(), F.raise_error(problem)).otherwise(label).cast("int")
    checked = records.withColumns(
        {"dedupe_key": dedupe_key(F.col("text")), "text": normalise(F.col("text"), filtered_on=True), "label": label}
    )
    reason = (
        F.when(F.col("text").isNull(), "missing_text")
        .when(F.col("label").isNull(), "bad_label")
        .when(F.char_length("text") < TEXT_MIN, "too_short")
    )
    return checked.withColumn("reject_reason", reason)


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def _digest() -> Column:
    return F.unhex(F.sha2(F.col("dedupe_key"), 256))


def conflicting_texts(records: DataFrame) -> DataFrame:
    """Texts that carry both labels, with the rows each label has."""
    return (
        records.groupBy(_digest().alias("digest"))
        .agg(
            F.min("label").alias("low"),
            F.max("label").alias("high"),
            F.count("*").alias("rows"),
            F.count_if(F.col("label") == 1).alias("suspicious_rows"),
        )
        .filter(F.col("low") < F.col("high"))
        .select(F.lower(F.hex("digest")).alias("text_digest"), "rows", "suspicious_rows")
    )


def resolve_texts(records: DataFrame) -> DataFrame:
    """One row per distinct text: the first record of it, its copies, and whether labels conflict.

    Conflict check and keep-first are one aggregation on the digest of the text. Copies collapse
    before the shuffle, so a text that makes up a third of all rows reaches its reducer as one row
    per map task, and the text itself is moved once.
    """
    others = [c for c in records.columns if c not in ("source_rank", "record_id", "label", "dedupe_key")]
    record = F.struct("source_rank", "record_id", *others)
    return (
        records.groupBy(_digest().alias("digest"))
        .agg(
            F.min("label").alias("label"),
            F.max("label").alias("highest_label"),
            F.count("*").alias("copies"),
            F.min(record).alias("first"),
        )
        .select(
            F.lower(F.hex("digest")).alias("text_digest"),
            (F.col("label") < F.col("highest_label")).alias("is_conflict"),
            "copies",
            "label",
            "first.*",
        )
    )


def kept_records(resolved: DataFrame) -> DataFrame:
    return resolved.filter(~F.col("is_conflict")).select(*LABELLED_COLUMNS)


def shuffle_key(seed: int = 42) -> Column:
    return random_key(seed, F.col("record_id"))


def shuffled(dataset: DataFrame, seed: int = 42) -> DataFrame:
    """Rows in seeded random order over all partitions (a range shuffle on a uniform key)."""
    return dataset.orderBy(shuffle_key(seed), "record_id")


def shuffle_positions(dataset: DataFrame, seed: int = 42) -> DataFrame:
    """The place of each row in that order, for readers that need a number and not an order."""
    keyed = dataset.withColumn("shuffle_key", shuffle_key(seed))
    return with_position(keyed, "shuffle_key", "shuffle_position")


def record_hash(columns: Sequence[str] = LABELLED_COLUMNS) -> Column:
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *fields), 256)


def dataset_fingerprint(dataset: DataFrame, columns: Sequence[str] = LABELLED_COLUMNS) -> DataFrame:
    """One row: row_count, sha256, dataset_version. Independent of row order and partitioning.

    The row hashes are summed as four 64-bit lanes, which needs no sort and no group larger than a
    handful of numbers, and the sums are hashed.
    """
    hashed = dataset.select(record_hash(columns).alias("h"))
    lanes = [
        F.sum(F.conv(F.substring("h", 1 + 16 * i, 16), 16, 10).cast("decimal(28,0)")).alias(f"lane{i}")
        for i in range(4)
    ]
    sums = hashed.agg(F.count("*").alias("row_count"), *lanes)
    parts = [F.coalesce(F.col(f"lane{i}"), F.lit(0)).cast("decimal(38,0)").cast("string") for i in range(4)]
    digest = F.sha2(F.concat_ws(":", F.col("row_count").cast("string"), *parts), 256)
    return sums.select("row_count", digest.alias("sha256")).withColumn(
        "dataset_version", F.concat(F.lit("sha256:"), F.substring("sha256", 1, 16))
    )


def manifest_counts(resolved: DataFrame) -> DataFrame:
    """Long form (metric, key, value): rows, per label, source and source type, plus what was removed."""
    level = F.grouping_id("label", "source", "source_type")
    kept = ~F.col("is_conflict")
    counts = resolved.groupingSets(
        [[], [F.col("label")], [F.col("source")], [F.col("source_type")]],
        F.col("label"),
        F.col("source"),
        F.col("source_type"),
    ).agg(
        level.alias("level"),
        F.count_if(kept).alias("rows"),
        F.count_if("is_conflict").alias("conflicts"),
        F.coalesce(F.sum(F.when(kept, F.col("copies") - 1)), F.lit(0)).alias("duplicates"),
    )
    # The grouping id tells which column a row counts; the total has no key, and null is not one.
    key = (
        F.when(F.col("level") == 7, F.lit(""))
        .when(F.col("level") == 3, F.col("label").cast("string"))
        .when(F.col("level") == 5, F.col("source"))
        .otherwise(F.col("source_type"))
    )

    def entry(metric: str, value: str):
        return F.struct(F.lit(metric).alias("metric"), key.alias("key"), F.col(value).alias("value"))

    totals = F.array(
        entry("row_count", "rows"),
        entry("conflicting_texts_removed", "conflicts"),
        entry("duplicates_removed", "duplicates"),
    )
    entries = (
        F.when(F.col("level") == 7, totals)
        .when(F.col("level") == 3, F.array(entry("class_counts", "rows")))
        .when(F.col("level") == 5, F.array(entry("source_counts", "rows")))
        .otherwise(F.array(entry("source_type_counts", "rows")))
    )
    # A label or source seen only in conflicting texts has no kept row and no entry.
    seen = counts.filter((F.col("level") == 7) | (F.col("rows") > 0))
    return seen.select(F.inline(entries)).filter(F.col("key").isNotNull())


def manifest_row(
    counts: DataFrame, fingerprint: DataFrame, input_files: Sequence[str], seed: int
) -> DataFrame:
    """The manifest as one row. The maps hold one entry per label, source and source type."""

    def single(metric: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("metric") == metric, F.col("value"))), F.lit(0)).alias(metric)

    def as_map(metric: str) -> Column:
        entries = F.collect_list(F.when(F.col("metric") == metric, F.struct("key", "value")))
        return F.map_from_entries(F.array_sort(entries)).alias(metric)

    totals = counts.agg(
        single("row_count"),
        as_map("class_counts"),
        as_map("source_counts"),
        as_map("source_type_counts"),
        single("conflicting_texts_removed"),
        single("duplicates_removed"),
    )
    version = fingerprint.select(F.struct("dataset_version", "sha256")).scalar()
    return (
        totals.withColumn("v", version)
        .select(
            F.col("v.dataset_version"),
            F.col("v.sha256"),
            *totals.columns,
            F.array(*[F.lit(f) for f in input_files]).cast("array<string>").alias("input_files"),
            F.lit(seed).alias("random_seed"),
        )
    )
