"""What a classifier adds to an assessment, and what stands in when there is none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cautela.operators.scoring import ml_points

# The sentences that assessments carry.
SUPPORTING_ONLY = (
    "The text model provides supporting evidence only. Its contribution is capped "
    "at 30 points and cannot reduce warnings found by deterministic rules."
)
NOT_CONFIGURED = "No ML classifier was configured; explainable rules were used only."
NOT_LOADED = "The trained model is unavailable, so this result uses explainable rules only."


def predicted_label(probability: Column) -> Column:
    return F.when(probability >= 0.5, F.lit("suspicious")).otherwise(F.lit("legitimate"))


def confidence(probability: Column) -> Column:
    return F.greatest(probability, F.lit(1.0) - probability)


def model_assessment(
    probability: Column,
    model_version: str | None = None,
    trained_at: str | None = None,
    dataset_version: str | None = None,
) -> Column:
    return F.struct(
        F.lit(True).alias("available"),
        predicted_label(probability).alias("predicted_label"),
        F.bround(probability, 4).alias("suspicious_probability"),
        F.bround(confidence(probability), 4).alias("confidence"),
        ml_points(probability).alias("score_contribution"),
        F.lit(model_version).cast("string").alias("model_version"),
        F.lit(trained_at).cast("string").alias("trained_at"),
        F.lit(dataset_version).cast("string").alias("dataset_version"),
        F.lit(SUPPORTING_ONLY).alias("explanation"),
    )


def model_unavailable(explanation: str = NOT_CONFIGURED) -> Column:
    return F.struct(
        F.lit(False).alias("available"),
        F.lit("unavailable").alias("predicted_label"),
        F.lit(None).cast("double").alias("suspicious_probability"),
        F.lit(None).cast("double").alias("confidence"),
        F.lit(0).alias("score_contribution"),
        F.lit(None).cast("string").alias("model_version"),
        F.lit(None).cast("string").alias("trained_at"),
        F.lit(None).cast("string").alias("dataset_version"),
        F.lit(explanation).alias("explanation"),
    )
