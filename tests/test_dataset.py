import hashlib

import pytest
from pyspark.sql import functions as F

from cautela.operators import dataset, metrics
from cautela.operators.split import holdout_sizes, stratified_split
from cautela.operators.validation import check_training_size, require_columns
from cautela.plans import steps, training
from cautela.plans.training import build_training_dataset, build_training_dataset_from_files
from cautela.sources import labelled
from cautela.sources.curated import curated_messages
from cautela.sources.synthetic import synthetic_messages


def test_generator_is_balanced_and_seeded(spark):
    rows = synthetic_messages(spark, 25)
    assert {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()} == {0: 25, 1: 25}
    assert sorted(rows.repartition(5).collect()) == sorted(synthetic_messages(spark, 25).collect())
    assert rows.filter(~F.col("is_synthetic")).isEmpty() and rows.filter(F.contains("text", F.lit("{"))).isEmpty()
    with pytest.raises(ValueError):
        synthetic_messages(spark, 19)


def test_files_to_manifest(spark, tmp_path):
    rows = synthetic_messages(spark, 20)
    duplicated = rows.unionByName(rows.limit(1))
    duplicated.write.option("header", True).option("escape", '"').csv(str(tmp_path / "raw"))
    prepared = build_training_dataset_from_files(spark, [str(tmp_path / "none"), str(tmp_path / "raw")], str(tmp_path / "out"), 1)
    manifest = prepared.manifest.first()
    assert prepared.dataset.count() == manifest["row_count"] == 40
    assert manifest["duplicates_removed"] == 1 and manifest["dataset_version"].startswith("sha256:")
    assert manifest["class_counts"] == {"0": 20, "1": 20} and manifest["input_files"] == [str(tmp_path / "raw")]
    aside = spark.read.parquet(str(tmp_path / "out" / "rejected")).collect()
    assert [tuple(r) for r in aside] == [(str(tmp_path / "none"), None, "missing_input")]
    with pytest.raises(FileNotFoundError):
        labelled.read_existing(spark, [str(tmp_path / "none")])


def labelled_rows(spark, triples):
    base = curated_messages(spark).limit(1)
    rows = spark.createDataFrame(triples, "record_id string, text string, label int")
    return rows.crossJoin(base.drop("record_id", "text", "label"))


def test_conflicts_duplicates_and_precedence(spark):
    first = labelled_rows(spark, [("b", "Same  text", 1), ("c", "conflict", 1), ("x", "no", 1), ("n", None, 0), ("z", "other", 0)])
    second = labelled_rows(spark, [("a", "same TEXT", 1), ("d", "CONFLICT", 0), ("e", "conflict ", 0)])
    checked = dataset.validate_records(dataset.combine_sources([first, second]))
    assert {r["record_id"]: r["reject_reason"] for r in checked.collect() if r["reject_reason"]} == {"x": "too_short", "n": "missing_text"}
    resolved = dataset.resolve_texts(dataset.accepted(checked))
    assert sorted(r["record_id"] for r in dataset.kept_records(resolved).collect()) == ["b", "z"]
    counts = {(r["metric"], r["key"]): r["value"] for r in dataset.manifest_counts(resolved).collect()}
    assert counts[("conflicting_texts_removed", "")] == 1 and counts[("duplicates_removed", "")] == 1
    assert counts[("row_count", "")] == 2 and counts[("class_counts", "1")] == 1
    bad = labelled_rows(spark, [("q", "text", 2)])
    with pytest.raises(Exception, match="only 0 and 1"):
        dataset.validate_records(bad).collect()


def test_hot_text_is_combined_before_the_shuffle(spark):
    rows = spark.range(30_000).select(
        F.col("id").cast("string").alias("record_id"),
        F.when(F.col("id") % 3 == 0, F.lit("the hot text")).otherwise(F.concat(F.lit("text "), "id")).alias("text"),
        F.lit(1).alias("label"),
    )
    rows = rows.crossJoin(curated_messages(spark).limit(1).drop("record_id", "text", "label"))
    resolved = dataset.resolve_texts(dataset.accepted(dataset.validate_records(dataset.combine_sources([rows]))))
    assert resolved.count() == 20_001 and resolved.agg(F.max("copies")).first()[0] == 10_000
    plan = resolved._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_min" in plan


def test_fingerprint_ignores_order_and_sees_changes(spark):
    rows = synthetic_messages(spark, 30)
    one = dataset.dataset_fingerprint(rows).first()["sha256"]
    assert one == dataset.dataset_fingerprint(rows.orderBy("text").repartition(7)).first()["sha256"]
    assert one != dataset.dataset_fingerprint(rows.withColumn("license", F.lit("x"))).first()["sha256"]


def test_shuffle_positions(spark):
    rows = synthetic_messages(spark, 50)
    got = {r["shuffle_position"]: r["record_id"] for r in dataset.shuffle_positions(rows, 7).collect()}
    ids = sorted((r["record_id"] for r in rows.collect()), key=lambda i: hashlib.sha256(f"7:{i}".encode()).hexdigest())
    assert [got[i + 1] for i in range(100)] == ids
    assert [r["record_id"] for r in dataset.shuffled(rows, 7).collect()] == ids


def test_stratified_split_is_exact(spark):
    rows = spark.range(1003).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"))
    sizes = {r["label"]: (r["test_rows"], r["train_rows"]) for r in holdout_sizes(rows, "label", 0.2).collect()}
    assert sum(t for t, _ in sizes.values()) == 201
    split = stratified_split(rows, "label", "id")
    got = {(r["label"], r["split"]): r["count"] for r in split.groupBy("label", "split").count().collect()}
    assert all((got[(k, "test")], got[(k, "train")]) == v for k, v in sizes.items())
    assert sorted(split.collect()) == sorted(stratified_split(rows.repartition(9), "label", "id").collect())


def test_auc_against_all_pairs(spark):
    scored = [(i % 3 == 0, (i * 37 % 11) / 10) for i in range(200)]
    pos, neg = [s for y, s in scored if y], [s for y, s in scored if not y]
    expected = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    rows = spark.createDataFrame([(int(y), s) for y, s in scored], "label int, score double")
    assert metrics.roc_auc(rows).first()[0] == pytest.approx(expected)
    assert metrics.roc_auc(rows.filter("label = 1")).first()[0] is None


def test_metrics_without_positives(spark):
    rows = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "label int, predicted int")
    row = metrics.binary_metrics(rows).first()
    assert row["precision_suspicious"] == 0 and row["recall_suspicious"] == 0 and row["f1_suspicious"] == 0
    report = {r["class_name"]: r for r in metrics.classification_report(rows).collect()}
    assert report["legitimate"]["recall"] == 1 and report["weighted avg"]["support"] == 3


def test_preconditions(spark, tmp_path):
    with pytest.raises(ValueError, match="missing columns"):
        require_columns(spark.range(1), ["text"])
    with pytest.raises(ValueError, match="At least 40"):
        check_training_size(synthetic_messages(spark, 20).limit(30))
    with pytest.raises(ValueError, match="both"):
        check_training_size(synthetic_messages(spark, 50).filter("label = 1"))
    with pytest.raises(ValueError, match="both"):
        build_training_dataset([("one", synthetic_messages(spark, 20).filter("label = 1"))], str(tmp_path / "out"))


def test_ham_spam_file(spark, tmp_path):
    path = tmp_path / "corpus.tsv"
    path.write_text('HAM\tsee you soon\nspam\t"win, now"\nodd\tx\nspam\n')
    found = labelled.read_ham_spam(spark, str(path))
    assert [tuple(r)[1:] for r in found.rejected.collect()] == [("spam", "number_of_fields")]
    raw = found.rows
    assert [(r["raw_label"], r["rows"]) for r in labelled.unknown_labels(raw).collect()] == [("odd", 1)]
    good = raw.filter("lower(raw_label) <> 'odd'")
    rows = labelled.ham_spam_records(good, F.lit("2026-01-01"), F.col("raw_label")).collect()
    assert [(r["label"], r["text"]) for r in rows] == [(0, "see you soon"), (1, "win, now")]
    with pytest.raises(Exception, match="Unexpected label"):
        labelled.ham_spam_records(raw, F.lit("2026-01-01"), F.lit(1)).collect()


def test_a_failed_build_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    sources = [("synthetic", synthetic_messages(spark, 30, 3))]
    folder, whole = str(tmp_path / "job"), build_training_dataset(sources, str(tmp_path / "whole"), 3)

    def broken(*_):
        raise OSError("lost between two steps")

    with monkeypatch.context() as patch:
        patch.setattr(training, "shuffled", broken)
        with pytest.raises(OSError):
            build_training_dataset(sources, folder, 3)
    with monkeypatch.context() as patch:
        patch.setattr(training, "resolve_texts", broken)  # finished before, not to be done again
        second = build_training_dataset(sources, folder, 3)
    assert second.built == ("dataset", "manifest") and whole.built == ("resolved", "dataset", "manifest")
    assert second.manifest.first() == whole.manifest.first()
    assert sorted(second.dataset.collect()) == sorted(whole.dataset.collect())
    assert build_training_dataset(sources, folder, 3).built == ()
    assert build_training_dataset(sources, folder, 4).built == ("dataset", "manifest")
    other = [("synthetic", synthetic_messages(spark, 31, 3))]
    assert build_training_dataset(other, folder, 4).built == ("resolved", "dataset", "manifest")
    with pytest.raises(ValueError, match="No source"):
        build_training_dataset([], folder)


def test_half_an_output_does_not_count(spark, tmp_path):
    job = steps.Steps(spark, str(tmp_path))
    with pytest.raises(Exception, match="halfway"):
        job.run("one", "a", lambda: spark.range(10).select(F.raise_error(F.lit("halfway")).alias("x")))
    assert job.run("one", "a", lambda: spark.range(10)).count() == 10 and job.built == ["one"]
    assert job.run("one", "a", lambda: spark.range(99)).count() == 10
    assert job.run("one", "b", lambda: spark.range(5)).count() == 5
    frame = spark.range(100).selectExpr("id", "id % 7 AS x")
    assert steps.content_fingerprint(frame) == steps.content_fingerprint(frame.repartition(7).orderBy("x"))
    assert steps.content_fingerprint(frame) != steps.content_fingerprint(frame.withColumnRenamed("x", "y"))
