import pytest
from pyspark.sql import functions as F

from cautela.operators import reports as stored
from cautela.plans import assess
from cautela.sources import folders
from cautela.streaming import messages, reports
from workload import views
from workload.queries import QUERIES


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).parquet(folder)


def test_stream_equals_batch_and_restart_adds_nothing(spark, sf, tmp_path):
    source = views.document_messages(views.read(spark, sf, "documents"))
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    source.write.parquet(folder)
    for _ in range(2):
        scored = messages.assess_stream(stream(spark, folder, source.schema)).select("message_id", "risk_score", "summary")
        messages.write_assessments(scored, out, check).awaitTermination()
    batch, _ = assess.split_messages(source)
    expected = assess.assess_messages(batch).select("message_id", "risk_score", "summary")
    assert sorted(spark.read.parquet(out).collect()) == sorted(expected.collect())


def test_reports_are_stored_once(spark, tmp_path):
    rows = spark.range(40).select(
        F.concat(F.lit("call +60 12-345 67"), (F.col("id") % 20 + 10).cast("string")).alias("text"),
        F.lit("Bank").alias("category"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") % 20).alias("submitted_at"),
    )
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows.write.parquet(folder)
    warnings = []

    def broken(_):
        raise ConnectionError("offline")

    for _ in range(2):
        query = reports.append_reports(
            stream(spark, folder, rows.schema), out, check, refresh_metadata=broken, on_warning=warnings.append
        )
        query.awaitTermination()
    stored = spark.read.parquet(out)
    assert stored.count() == stored.select("report_key").distinct().count() == 20
    assert warnings and "offline" in warnings[0]


def reports_at(spark, first, n, label):
    return spark.range(n).select(
        F.concat(F.lit(f"{label} call +60 12-345 67"), (F.col("id") + 10).cast("string")).alias("text"),
        F.lit("Bank").alias("category"),
        F.timestamp_seconds(F.lit(first) + F.col("id")).alias("submitted_at"),
    )


def test_late_reports_and_other_streams_are_kept(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    day, properties = 86_400, []

    def run(check):
        schema = reports_at(spark, 0, 1, "x").schema
        query = reports.append_reports(
            stream(spark, folder, schema), out, str(tmp_path / check), refresh_metadata=lambda p: properties.append(p.first()[0])
        )
        query.awaitTermination()
        return spark.read.parquet(out)

    reports_at(spark, 1_704_067_200, 5, "new").write.mode("append").parquet(folder)
    assert run("a").count() == 5
    reports_at(spark, 1_704_067_200 - day, 5, "late").write.mode("append").parquet(folder)
    assert run("a").count() == 10
    # A second job, or one that lost its checkpoint, reads all again into its own folders: nothing is lost or doubled.
    reports_at(spark, 1_704_067_200 - 9 * day, 4, "later").write.mode("append").parquet(folder)
    stored = run("b")
    assert stored.count() == stored.select("report_key").distinct().count() == 14
    assert len({r["run"] for r in stored.select("run").distinct().collect()}) == 2
    assert properties[-1]["record_count"] == "14"


def test_reports_of_one_second_are_told_apart(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows = spark.range(20_000).select(
        F.concat(F.lit("report "), F.col("id").cast("string")).alias("text"),
        F.lit("Bank").alias("category"),
        F.timestamp_seconds(F.lit(1_704_067_200)).alias("submitted_at"),
    )
    rows.union(rows.limit(10)).write.parquet(folder)
    reports.append_reports(stream(spark, folder, rows.schema), out, check).awaitTermination()
    assert spark.read.parquet(out).count() == 20_000


def test_running_totals(spark, sf):
    rows = {r["category"]: r["record_count"] for r in QUERIES["stream_report_totals"](spark, sf).collect()}
    accepted = QUERIES["report_counts"](spark, sf).agg(F.sum("record_count")).first()[0]
    assert sum(rows.values()) == accepted


def test_only_the_days_of_a_batch_are_looked_up(spark, tmp_path):
    out, day = str(tmp_path / "out"), 86_400
    for n in range(5):
        stored.submit_reports(reports_at(spark, 1_704_067_200 + n * day, 4, f"d{n}"), out, batch=str(n))
    ready = stored.judged_reports(reports_at(spark, 1_704_067_200 + 2 * day, 6, "d2").unionByName(reports_at(spark, 0, 2, "years late")))
    fresh = reports.not_stored_yet(ready, out, "stream", "0")
    assert fresh.count() == 4  # of six reports of that day four are stored already
    read = {f.split("/day=")[1].split("/")[0] for f in stored.stored_keys(spark, out, [0, 19_725]).inputFiles()}
    assert read == {"19725"} and stored.stored_keys(spark, out, [7]) is None
    assert reports.not_stored_yet(ready, out, "submitted", "2").count() == 8  # a repeated batch does not see itself
    key = ready.orderBy("submitted_at", ascending=False).first().report_key
    assert stored.find_report(spark, out, key, F.timestamp_seconds(F.lit(1_704_067_200 + 2 * day))).count() == 0
    key = ready.filter("text = 'd2 call +60 12-345 6710'").first().report_key
    assert stored.find_report(spark, out, key, F.timestamp_seconds(F.lit(1_704_067_200 + 2 * day))).first().batch == "2"


def test_compaction_never_shows_a_report_twice_or_not_at_all(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    for n in range(4):
        stored.submit_reports(reports_at(spark, 1_704_067_200 + 100 * n, 5, f"b{n}"), out, batch=str(n))
    keys = lambda: sorted(r.report_key for r in stored.stored_reports(spark, out).collect())
    before, reader = keys(), stored.stored_reports(spark, out)
    assert len(before) == 20

    def broken(*_):
        raise OSError("lost before the snapshot")

    with monkeypatch.context() as patch:
        patch.setattr(folders.Files, "create", broken)
        with pytest.raises(OSError):
            stored.compact_reports(spark, out)
    assert keys() == before  # the merged folder is there, nobody reads it
    assert stored.compact_reports(spark, out) == 4 and keys() == before
    assert sorted(r.report_key for r in reader.collect()) == before  # a reader from before still has its folders
    assert len(stored.stored_reports(spark, out).inputFiles()) < len(reader.inputFiles())
    stored.submit_reports(reports_at(spark, 1_704_070_000, 3, "more"), out, batch="9")
    assert len(keys()) == 23 and stored.compact_reports(spark, out) == 2 and len(keys()) == 23
    assert folders.vacuum(spark, out, 3_600_000) == [] and len(folders.vacuum(spark, out, 0)) == 7  # five batches, two merged
    assert len(keys()) == 23 and folders.Files(spark, out).match(folders.BATCHES) == []
    totals = stored.refreshed_properties(spark, out).first()[0]
    assert totals["record_count"] == "23" and stored.compact_reports(spark, out) == 0


def test_of_two_compactions_one_counts(spark, tmp_path):
    files = folders.Files(spark, str(tmp_path))
    assert files.create("snapshot-1.json", {"a": 1}) and not files.create("snapshot-1.json", {"a": 2})
    assert files.read("snapshot-1.json") == {"a": 1} and files.match("snapshot-*.json") == ["snapshot-1.json"]


def test_rejected_messages_are_kept_once_after_a_failure(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("a", "Pay now!"), ("b", "!!"), ("c", None), ("d", "x" * 10_001), ("e", "Hello there")], "message_id string, text string")
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows.repartition(2).write.parquet(folder)
    columns = ("message_id", "risk_level")

    def broken(*_):
        raise OSError("lost between the two outputs")

    with monkeypatch.context() as patch:
        patch.setattr(messages, "assess_messages", broken)
        with pytest.raises(Exception, match="between"):
            messages.append_assessments(stream(spark, folder, rows.schema), out, check, columns).awaitTermination()
    for _ in range(2):
        messages.append_assessments(stream(spark, folder, rows.schema), out, check, columns).awaitTermination()
    assert sorted(r.message_id for r in spark.read.parquet(out).collect()) == ["a", "e"]
    aside = {r.message_id: r.reject_reason for r in spark.read.parquet(f"{out}-rejected").collect()}
    assert aside == {"b": "too_short", "c": "missing_text", "d": "too_long"}
