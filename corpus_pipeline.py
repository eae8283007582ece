"""The corpus pipeline: language ID, line dedup, near-dedup, masking of personal data, packing.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of documents; ``lang`` is rewritten
nowhere, and ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cautela.llm.common import Scratch, table
from cautela.llm.language_id import UNKNOWN, identify, learn_languages
from cautela.llm.line_dedup import dedup_lines
from cautela.llm.near_dedup import near_duplicates
from cautela.llm.packing import pack_documents
from cautela.llm.personal_data import mask_personal_data
from cautela.llm.queries import BYTE_BPE

#: Documents whose best language scores less have no language that was learned; texts of the learned ones score above 0.2.
LEAST_SCORE = 0.05

ORACLE_SQL = None


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letters, or unlike everything learned) go."""
    told = identify(docs, learn_languages(docs))
    known = (F.col("language_id.language") != UNKNOWN) & (F.col("language_id.score") >= LEAST_SCORE)
    return told.filter(known).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document of which nothing is left stays as an empty text."""
    return _recounted(dedup_lines(docs).select(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    dropped = near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(Scratch(spark, "dropped").save(dropped), "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are masked; no document goes."""
    return _recounted(mask_personal_data(docs).select(*docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, BYTE_BPE)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
