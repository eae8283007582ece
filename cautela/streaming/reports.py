"""Taking in a stream of reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cautela.functions.text import category_name
from cautela.operators.reports import (
    accepted_reports,
    day_of,
    judged_reports,
    prepare_reports,
    refreshed_properties,
    store_batch,
    stored_keys,
)

QUERY_ID = "sql.streaming.queryId"


def not_stored_yet(ready: DataFrame, path: str, run: str, batch: str) -> DataFrame:
    """Reports of a batch, each once, without those that an earlier batch of any run has stored, however late they are.

    A report's key includes its time, so only the key index of the days that the batch's reports are from is read. The
    batch's own folders do not count: a repeated batch replaces them.
    """
    single = ready.dropDuplicates(["report_key"])
    days = [r.day for r in ready.select(day_of(F.col("submitted_at")).alias("day")).distinct().collect()]  # calendar days
    stored = stored_keys(ready.sparkSession, path, sorted(d for d in days if d is not None))
    if stored is None:
        return single
    earlier = stored.filter((F.col("run") != run) | (F.col("batch") != batch))
    return single.join(earlier.select("report_key"), "report_key", "left_anti")


def append_reports(
    submissions: DataFrame,
    path: str,
    checkpoint: str,
    refresh_metadata: Callable[[DataFrame], None] | None = None,
    on_warning: Callable[[str], None] = print,
    **trigger,
) -> StreamingQuery:
    """Store every report once; a late one is stored like any other, a report sent again is left out.

    Each micro-batch replaces its own folder, named by the query's id - which lives in the checkpoint - and its number.
    Copies are found by key before any text is masked. Rejected rows go to ``<path>-rejected`` with their reasons.
    ``refresh_metadata`` gets the properties from the batches' totals.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = spark.sparkContext.getLocalProperty(QUERY_ID)
        judged = judged_reports(batch).persist()
        try:
            aside = judged.filter(F.col("reject_reason").isNotNull())
            aside = aside.select("report_key", category_name(F.col("category")).alias("category"), "submitted_at", "reject_reason")
            aside.write.mode("overwrite").parquet(f"{path}-rejected/run={run}/batch={batch_id}")
            fresh = not_stored_yet(judged.filter(F.col("reject_reason").isNull()), path, run, str(batch_id))
            store_batch(accepted_reports(prepare_reports(fresh)), path, run, str(batch_id))
        finally:
            judged.unpersist()
        if refresh_metadata is None:
            return
        try:
            refresh_metadata(refreshed_properties(spark, path))
        except Exception as exc:  # noqa: BLE001 - reports are stored, whatever the catalogue does
            on_warning(f"Properties were not refreshed after batch {batch_id}: {exc}")

    writer = submissions.writeStream.foreachBatch(store)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def running_totals(reports: DataFrame) -> DataFrame:
    """Reports per category and the last submission; emitted in update mode."""
    return reports.groupBy("category").agg(
        F.count("*").alias("record_count"), F.max("submitted_at").alias("last_report_submitted_at")
    )
