"""Training-set build and classifier training as restartable jobs: steps hand over by tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cautela.operators.classifier import TrainingResult, publish_classifier, save_classifier, train_classifier
from cautela.operators.dataset import (
    accepted,
    combine_sources,
    dataset_fingerprint,
    kept_records,
    manifest_counts,
    manifest_row,
    resolve_texts,
    shuffled,
    validate_records,
)
from cautela.plans.steps import Steps, content_fingerprint, digest
from cautela.sources.labelled import read_existing
from cautela.sources.schemas import LABELLED_COLUMNS


@dataclass(frozen=True)
class PreparedDataset:
    dataset: DataFrame
    manifest: DataFrame
    built: tuple[str, ...] = ()  # steps that this call did not find finished


def build_training_dataset(
    sources: Sequence[tuple[str, DataFrame]], folder: str, seed: int = 42, strict: bool = True
) -> PreparedDataset:
    """Union, validate, resolve, shuffle and count; ``sources`` are (name, frame) in precedence order.

    The resolved texts are written once. The dataset and every number of the manifest are read from
    that table, with only the columns they need, so a lost executor never repeats the big shuffle. A run that failed is
    repeated with the same call: steps that are finished, for the same sources and parameters, are read and not built again.
    """
    if not sources:
        raise ValueError("No source dataset exists. Generate or fetch data first.")
    spark = sources[0][1].sparkSession
    steps = Steps(spark, folder)
    given = digest(strict, *(x for name, frame in sources for x in (name, content_fingerprint(frame))))

    def resolve() -> DataFrame:
        combined = combine_sources([frame for _, frame in sources])
        return resolve_texts(accepted(validate_records(combined, strict)))

    resolved = steps.run("resolved", given, resolve)

    def shuffle() -> DataFrame:
        kept = kept_records(resolved)
        if kept.agg(F.count_distinct("label")).first()[0] != 2:
            raise ValueError("Training data must contain both legitimate and suspicious labels.")
        return shuffled(kept, seed)

    dataset = steps.run("dataset", digest(given, seed), shuffle)
    counted = lambda: manifest_row(
        manifest_counts(resolved), dataset_fingerprint(dataset), [name for name, _ in sources], seed
    )
    manifest = steps.run("manifest", digest(given, seed), counted, document=True)
    return PreparedDataset(dataset, manifest, tuple(steps.built))


def build_training_dataset_from_files(
    spark: SparkSession, paths: Sequence[str], folder: str, seed: int = 42
) -> PreparedDataset:
    sources, rejected = read_existing(spark, paths)
    rejected.write.mode("overwrite").parquet(f"{folder}/rejected")
    return build_training_dataset(sources, folder, seed)


def train_and_save(
    prepared: PreparedDataset, folder: str, test_size: float = 0.2, seed: int = 42
) -> TrainingResult:
    version = prepared.manifest.select("dataset_version").first()[0]
    dataset = prepared.dataset.select(*LABELLED_COLUMNS).withColumn("label", F.col("label").cast("int"))
    result = train_classifier(dataset, version, test_size, seed)
    save_classifier(result, folder)
    return result


def train_and_publish(prepared: PreparedDataset, root: str, test_size: float = 0.2, seed: int = 42) -> TrainingResult:
    """As ``train_and_save``, into the next version of ``root``."""
    version = prepared.manifest.select("dataset_version").first()[0]
    dataset = prepared.dataset.select(*LABELLED_COLUMNS).withColumn("label", F.col("label").cast("int"))
    result = train_classifier(dataset, version, test_size, seed)
    publish_classifier(result, root)
    return result
