"""Community reports: sanitise, stamp as unverified, append, and refresh the source's properties."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cautela.functions.identifiers import report_id, report_key
from cautela.functions.masking import sanitise
from cautela.functions.text import category_name, strip_spaces
from cautela.operators.validation import report_reject_reason
from cautela.sources.folders import SMALL_BYTES, Files, compact, read_batches
from cautela.sources.schemas import REPORT_COLUMNS

# Fixed value: the sentence that result rows carry.
EXPLANATION = (
    "The report was sanitised and stored as unverified community context. It is not permitted to "
    "influence trusted risk decisions until reviewed."
)
COMMUNITY_PROPERTIES = {
    "source_classification": "community",
    "review_status": "unverified",
    "freshness_status": "current",
    "reliability_level": "low",
    "allowed_for_decision": "false",
    "evidence_role": "excluded_until_reviewed",
    "synthetic": "mixed_demo_and_user_submitted",
    "contains_personal_data": "sanitised",
    "jurisdiction": "Malaysia prototype",
    "file_format": "CSV",
    "prototype_status": "not_production_ready",
}


def reject_reason(text: Column, category: Column) -> Column:
    """Null for a report that is stored. Told from the raw text, so that masks run on stored reports only."""
    # Masks never leave less than they find, so only blank text is empty after them.
    return F.coalesce(report_reject_reason(text, category), F.when(strip_spaces(text) == "", F.lit("nothing_left")))


def judged_reports(
    submissions: DataFrame, text: str = "text", category: str = "category", submitted_at: str = "submitted_at"
) -> DataFrame:
    """The submissions with ``report_key`` and ``reject_reason``, nothing masked yet."""
    key = report_key(F.col(submitted_at), F.col(category), F.col(text))
    return submissions.withColumns({"report_key": key, "reject_reason": reject_reason(F.col(text), F.col(category))})


def prepare_reports(
    submissions: DataFrame, text: str = "text", category: str = "category", submitted_at: str = "submitted_at"
) -> DataFrame:
    """Report columns plus ``reject_reason``; only masked text leaves this function."""
    named = submissions.drop("report_key", "reject_reason").withColumn("_category", category_name(F.col(category)))
    return named.select(
        report_id(F.col(submitted_at), F.col(category), F.col(text)).alias("report_id"),
        report_key(F.col(submitted_at), F.col(category), F.col(text)).alias("report_key"),
        F.col("_category").alias("category"),
        sanitise(F.col(text)).alias("sanitised_text"),
        F.lit("unverified").alias("review_status"),
        F.lit(False).alias("allowed_for_decision"),
        F.col(submitted_at).alias("submitted_at"),
        reject_reason(F.col(text), F.col(category)).alias("reject_reason"),
        *[c for c in named.columns if c not in (text, category, submitted_at, "_category")],
    )


def accepted_reports(prepared: DataFrame) -> DataFrame:
    return prepared.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected_reports(prepared: DataFrame) -> DataFrame:
    """What is set aside, with its reason; masked like everything else."""
    return prepared.filter(F.col("reject_reason").isNotNull()).select("report_key", "category", "submitted_at", "reject_reason")


def report_totals(reports: DataFrame, *by: str) -> DataFrame:
    """Stored reports, and the last one: latest time, then highest id."""
    last = F.max(F.struct("submitted_at", "report_id"))
    return reports.groupBy(*by).agg(F.count("*").alias("record_count"), last.alias("last")).select(
        *by,
        "record_count",
        F.col("last.report_id").alias("last_report_id"),
        F.col("last.submitted_at").alias("last_report_submitted_at"),
    )


def merged_totals(totals: DataFrame) -> DataFrame:
    """Totals of several batches as one row: counts add up, the last report is the latest one."""
    last = F.max(F.struct("last_report_submitted_at", "last_report_id"))
    return totals.agg(F.sum("record_count").alias("record_count"), last.alias("last")).select(
        "record_count",
        F.col("last.last_report_id").alias("last_report_id"),
        F.col("last.last_report_submitted_at").alias("last_report_submitted_at"),
    )


def community_properties(reports: DataFrame) -> DataFrame:
    """The refreshed property map of the community source, one row, counted from the reports."""
    return properties_of(report_totals(reports))


def properties_of(totals: DataFrame) -> DataFrame:
    """The property map for one row of totals."""
    fixed = [F.lit(x) for kv in COMMUNITY_PROPERTIES.items() for x in kv]
    return totals.select(
        F.map_concat(
            F.create_map(*fixed),
            F.create_map(
                F.lit("record_count"),
                F.col("record_count").cast("string"),
                F.lit("last_report_id"),
                F.col("last_report_id"),
                F.lit("last_report_submitted_at"),
                F.date_format(
                    F.to_utc_timestamp("last_report_submitted_at", F.current_timezone()),
                    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'",
                ),
            ),
        ).alias("custom_properties")
    )


STORED_COLUMNS = (*REPORT_COLUMNS, "report_key", "submitted_at")
STORED_SCHEMA = (
    "report_id string, category string, sanitised_text string, review_status string, allowed_for_decision boolean, "
    "report_key string, submitted_at timestamp"
)
KEY_SCHEMA = "report_key string, day int, run string, batch string"


def day_of(submitted_at: Column) -> Column:
    """Days since 1970, the partition of the key index that a report's time lies in."""
    return F.floor(F.unix_seconds(submitted_at) / 86_400).cast("int")


def write_keys(stored: DataFrame, path: str, run: str, batch: str) -> None:
    """Keys of a batch in ``<path>-keys/day=/run=/batch=``, with Bloom filters; a repeated batch replaces its folders."""
    keys = stored.select("report_key", day_of(F.col("submitted_at")).alias("day"), F.lit(run).alias("run"), F.lit(batch).alias("batch"))
    writer = keys.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "run", "batch")
    writer.option("parquet.bloom.filter.enabled#report_key", "true").parquet(f"{path}-keys")


def stored_keys(spark: SparkSession, path: str, days: Sequence[int]) -> DataFrame | None:
    """The index's rows of some days, whose folders are all that is listed and read; None if there are none."""
    files = Files(spark, f"{path}-keys")
    folders = [f"{path}-keys/day={d}" for d in days if files.exists(f"day={d}")]
    return spark.read.option("basePath", f"{path}-keys").schema(KEY_SCHEMA).parquet(*folders) if folders else None


def find_report(spark: SparkSession, path: str, key: str, submitted_at: Column) -> DataFrame:
    """(report_key, day, run, batch) of a stored report: one day's folder, in which the Bloom filters skip files."""
    day = spark.range(1).select(day_of(submitted_at)).first()[0]
    found = stored_keys(spark, path, [day])
    return spark.createDataFrame([], KEY_SCHEMA) if found is None else found.filter(F.col("report_key") == key)


def stored_reports(spark: SparkSession, path: str) -> DataFrame:
    """All stored reports, from batches and from what compaction has merged."""
    return read_batches(spark, path, STORED_SCHEMA)


def compact_reports(spark: SparkSession, path: str, small: int = SMALL_BYTES) -> int:
    """Merge small batches; totals and keys stay as they are, since they speak of the batches as they were sent."""
    return compact(spark, path, STORED_SCHEMA, small)


def store_batch(ready: DataFrame, path: str, run: str, batch: str) -> DataFrame:
    """Write one batch of reports and, beside it, its totals and keys; a repeated call replaces them. Returns what was stored.

    The same layout serves batch jobs and streams: ``<path>/run=<run>/batch=<batch>`` and ``<path>-totals`` alike. A
    run is one job or one stream checkpoint, so that two of them on one path never write into each other's folders.
    """
    spark, place = ready.sparkSession, f"run={run}/batch={batch}"
    ready = ready.select(*STORED_COLUMNS)
    ready.write.mode("overwrite").parquet(f"{path}/{place}")
    stored = spark.read.schema(ready.schema).parquet(f"{path}/{place}")
    report_totals(stored).write.mode("overwrite").parquet(f"{path}-totals/{place}")
    write_keys(stored, path, run, batch)
    return stored


def refreshed_properties(spark, path: str) -> DataFrame:
    """The property map from the batches' totals, one small row each; no stored report is read again."""
    return properties_of(merged_totals(spark.read.parquet(f"{path}-totals")))


def submit_reports(
    submissions: DataFrame,
    path: str,
    refresh_metadata: Callable[[DataFrame], None] | None = None,
    batch: str | None = None,
) -> DataFrame:
    """Store the usable reports, then try to refresh the metadata; returns the result rows.

    A call with a ``batch`` that was stored before replaces it, so a retried job does not store a report twice; without
    one the call is a batch of its own. A failing refresh only sets the warning.
    """
    batch = uuid.uuid4().hex if batch is None else batch
    stored = store_batch(accepted_reports(prepare_reports(submissions)), path, "submitted", batch)
    warning = None
    if refresh_metadata is not None:
        try:
            refresh_metadata(refreshed_properties(submissions.sparkSession, path))
        except Exception as exc:  # noqa: BLE001 - reports are stored, whatever the catalogue does
            warning = f"Stored, but the source's properties were not refreshed: {exc}"
    return stored.select(
        "*",
        F.lit(True).alias("saved_locally"),
        F.lit(warning is None).alias("writeback_available"),
        F.lit(warning).cast("string").alias("writeback_warning"),
        F.lit(EXPLANATION).alias("explanation"),
    )
