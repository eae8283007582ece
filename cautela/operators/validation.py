"""Row validity as a column: a bad row is explained and set aside, never thrown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cautela.functions.text import strip_white_space

MESSAGE_MIN, MESSAGE_MAX = 3, 10_000
REPORT_MAX, CATEGORY_MAX = 10_000, 50


def message_reject_reason(text: Column) -> Column:
    """Null for a message that may be assessed. Looks at the raw text, before normalisation."""
    clean = strip_white_space(text)
    return (
        F.when(text.isNull(), "missing_text")
        .when(F.char_length(clean) < MESSAGE_MIN, "too_short")
        .when(F.char_length(clean) > MESSAGE_MAX, "too_long")
        .when(~clean.rlike(r"[\p{L}\p{N}]"), "no_letter_or_number")
    )


def report_reject_reason(text: Column, category: Column) -> Column:
    """Null for a report that may be sanitised; a missing category is not an error."""
    name = F.coalesce(category, F.lit("unspecified"))
    return (
        F.when(text.isNull() | (F.char_length(text) < 1), "empty_text")
        .when(F.char_length(text) > REPORT_MAX, "too_long")
        .when(F.char_length(name) < 1, "empty_category")
        .when(F.char_length(name) > CATEGORY_MAX, "category_too_long")
    )


def require_columns(df: DataFrame, required, what: str = "The table") -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing columns: {missing}")


def require_rows(df: DataFrame, what: str = "The table") -> None:
    if df.isEmpty():
        raise ValueError(f"{what} contains no records")


def binary_label(raw: Column) -> Column:
    """0 or 1, else null. Text such as '1.0' counts; 0.9 does not become 0."""
    number = raw.try_cast("double")
    return F.when(number == 0, F.lit(0)).when(number == 1, F.lit(1))


def check_training_size(df: DataFrame, label: str = "label", minimum: int = 40) -> dict[int, int]:
    """Rows per class; fails below the minimum or unless the labels are 0 and 1, both. One aggregation to one row."""
    row = training_size(df, label, minimum).first()
    if row["rows"] < minimum:
        raise ValueError(f"At least {minimum} rows are required for a training run.")
    if row["verdict"] != "usable":
        raise ValueError("Training data must contain both legitimate and suspicious labels.")
    return {0: row["legitimate_rows"], 1: row["suspicious_rows"]}


def training_size(df: DataFrame, label: str = "label", minimum: int = 40, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows, rows per class and the verdict on them, in all or per group."""
    counts = df.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col(label) == 0).alias("legitimate_rows"),
        F.count_if(F.col(label) == 1).alias("suspicious_rows"),
    )
    odd = F.col("rows") != F.col("legitimate_rows") + F.col("suspicious_rows")
    single = (F.col("legitimate_rows") == 0) | (F.col("suspicious_rows") == 0)
    verdict = F.when(F.col("rows") < minimum, "too_few_rows").when(odd | single, "not_both_classes").otherwise("usable")
    return counts.withColumn("verdict", verdict)
