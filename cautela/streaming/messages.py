"""Scoring a stream of messages: the batch functions, nothing kept between micro-batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from cautela.operators.rules import TEXT_RULES, TextRule
from cautela.plans.assess import assess_messages, split_messages


def assess_stream(
    messages: DataFrame,
    text: str = "text",
    rules: tuple[TextRule, ...] = TEXT_RULES,
    machine_learning: Column | None = None,
) -> DataFrame:
    """Assessments of the messages that may be assessed; see ``append_assessments`` for the others."""
    accepted, _ = split_messages(messages, text)
    return assess_messages(accepted, text, rules, machine_learning)


def write_assessments(assessments: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append to files; the file sink's log makes each micro-batch count once."""
    writer = assessments.writeStream.outputMode("append").format("parquet").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def append_assessments(
    messages: DataFrame,
    path: str,
    checkpoint: str,
    columns: Sequence[str],
    text: str = "text",
    message_id: str = "message_id",
    rules: tuple[TextRule, ...] = TEXT_RULES,
    machine_learning: Column | None = None,
    **trigger,
) -> StreamingQuery:
    """Two outputs: assessments (``columns`` of them) to ``path``, rejected messages with their reasons to ``<path>-rejected``.

    A micro-batch replaces its own folders ``run=<query>/batch=<number>`` in both, so one that is repeated after a
    failure between the two writes leaves each message in exactly one output, once.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        place = f"run={run}/batch={batch_id}"
        batch.persist()
        try:
            accepted, rejected = split_messages(batch, text)
            rejected.select(message_id, "reject_reason").write.mode("overwrite").parquet(f"{path}-rejected/{place}")
            assessed = assess_messages(accepted, text, rules, machine_learning)
            assessed.select(*columns).write.mode("overwrite").parquet(f"{path}/{place}")
        finally:
            batch.unpersist()

    writer = messages.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
