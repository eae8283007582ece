"""Sample messages by expected risk band."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cautela.sources.delimited import FileRows

BANDS = ("low_risk", "medium_risk", "high_risk")


def read_sample_messages(spark: SparkSession, path: str) -> FileRows:
    """(risk_band, message_pos, text) from JSON documents of band -> list of texts, one document a file.

    A file that is no such document is set aside, and so is a null in a list.
    """
    schema = ", ".join(f"{b} array<string>" for b in BANDS) + ", _bad string"
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), "value")
    parsed = F.from_json("value", schema, {"columnNameOfCorruptRecord": "_bad"})
    document = files.select("source_file", parsed.alias("d")).withColumn("_bad", F.col("d._bad"))
    bands = F.explode(F.create_map(*[x for b in BANDS for x in (F.lit(b), F.col(f"d.{b}"))])).alias("risk_band", "texts")
    good = document.filter(F.col("_bad").isNull()).select("source_file", bands)
    texts = good.select("source_file", "risk_band", F.posexplode("texts").alias("message_pos", "text"))
    unread = document.filter(F.col("_bad").isNotNull()).select("source_file", F.col("_bad").alias("raw"), F.lit("not_a_message_document").alias("reason"))
    empty = texts.filter(F.col("text").isNull())
    empty = empty.select("source_file", F.col("risk_band").alias("raw"), F.lit("missing_text").alias("reason"))
    return FileRows(texts.filter(F.col("text").isNotNull()).drop("source_file"), unread.union(empty))
