import datetime

import pytest
from pyspark.sql import functions as F

from cautela.operators import catalog, evidence, reports
from cautela.plans import assess
from cautela.sources.evidence_files import read_evidence_csv, read_required_evidence
from cautela.sources.evidence_registry import evidence_registry, required_urns


def decide(spark, **properties):
    rows = spark.createDataFrame([("u", "n", "d", {k: str(v) for k, v in properties.items()})], evidence.SOURCE_SCHEMA)
    return evidence.decide_sources(rows).first()


TRUSTED = {"review_status": "reviewed", "freshness_status": "current", "allowed_for_decision": "true"}


@pytest.mark.parametrize(
    ("changes", "decision", "role", "words"),
    [
        ({"source_classification": "official_style_guidance"}, "selected", "primary", "primary guidance"),
        ({"source_classification": " Synthetic "}, "selected", "supporting_only", "cannot independently confirm"),
        ({"source_classification": "official", "allowed_for_decision": "supporting_only"}, "selected", "supporting_only", "pattern"),
        ({"source_classification": "public"}, "selected", "supporting", "only as supporting"),
        ({"source_classification": "official", "allowed_for_decision": "NO"}, "excluded", "excluded", "explicitly not approved"),
        ({"source_classification": "official", "review_status": "unverified"}, "excluded", "excluded", "not been reviewed"),
        ({"source_classification": "official", "freshness_status": "stale"}, "excluded", "excluded", "stale"),
        ({"source_classification": "mystery"}, "excluded", "excluded", "unknown or unsupported"),
    ],
)
def test_policy_branches(spark, changes, decision, role, words):
    row = decide(spark, **{**TRUSTED, **changes})
    assert (row["decision"], row["role"]) == (decision, role) and words in row["reason"]
    assert row["reliability"] == "unknown"


def test_a_column_wins_over_the_map(spark):
    rows = spark.createDataFrame([("u", "n", "d", {"review_status": "reviewed"})], evidence.SOURCE_SCHEMA)
    assert evidence.decide_sources(rows.withColumn("review_status", F.lit("x"))).first()["review_status"] == "x"


def bundle(spark, primary, fallback=None):
    return evidence.resolve_context(spark, required_urns(), primary, fallback).first()


def test_bundle_and_its_fallbacks(spark):
    registry = evidence_registry(spark)
    first = bundle(spark, lambda: registry)
    assert first["available"] and first["integration_mode"] == "agent_context_kit" and first["warning"] is None
    assert [d["role"] for d in first["selected_evidence"]] == ["primary", "supporting", "supporting_only"]
    assert len(first["excluded_evidence"]) == 1 and "Selected 3 evidence source(s)" in first["provenance_summary"]

    bare = registry.withColumn("custom_properties", F.map_filter("custom_properties", lambda k, _: k != "evidence_role"))
    second = bundle(spark, lambda: bare, lambda: registry)
    assert second["integration_mode"] == "python_sdk_fallback" and "trust properties: evidence_role" in second["warning"]

    def broken():
        raise RuntimeError("Unexpected test error")

    third = bundle(spark, broken, lambda: registry.limit(3))
    assert not third["available"] and third["selected_evidence"] == [] and "Unexpected test error" in third["warning"]
    assert third["provenance_summary"] == evidence.COULD_NOT_CHECK

    rows = spark.createDataFrame([("Please pay RM5 now.",)], "text string")
    plain = assess.assess_messages(rows)
    for attached in (
        evidence.attach_context(plain, evidence.resolve_context(spark, required_urns(), broken)),
        evidence.attach_context(plain, None),
    ):
        row = attached.first()
        assert row["risk_score"] == plain.first()["risk_score"] > 0 and not row["context_available"]


def test_property_layouts(spark):
    texts = [
        '{"urn": " u ", "customProperties": {"a": "1", "b": true}}',
        '{"urn": "u", "customProperties": [], "custom_properties": [{"key": "a", "value": "1"}, 7, {"value": "x"}, {"key": "a", "value": "2"}]}',
        '{"urn": "u", "customProperties": {}, "properties": {"customProperties": {"a": "9"}}}',
        '{"urn": "u", "properties": {"name": "N", "description": " D "}}',
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, entity string")
    got = evidence.read_entities(rows).orderBy("i").collect()
    assert [r["custom_properties"] for r in got] == [{"a": "1", "b": "true"}, {"a": "2"}, {}, {}]
    assert (got[3]["name"], got[3]["description"], got[0]["name"]) == ("N", "D", "u")


def test_evidence_file_with_mark_and_glued_line(spark, tmp_path):
    path = tmp_path / "community.csv"
    header = "report_id,category,sanitised_text,review_status,allowed_for_decision"
    glued = "C2,b,text,unverified,falseCOM-1,b,other text,unverified,false"
    path.write_text(f"﻿{header}\nC1,a,hello,unverified,false\n{glued}\n", encoding="utf-8")
    found = read_evidence_csv(spark, str(path), "community_reports")
    assert [(r["report_id"], r["allowed_for_decision"]) for r in found.rows.collect()] == [("C1", False)]
    assert [(r["raw"], r["reason"], r["source_file"][-8:]) for r in found.rejected.collect()] == [(glued, "number_of_fields", path.name[-8:])]
    empty = tmp_path / "empty.csv"
    empty.write_text(f"{header}\n")
    with pytest.raises(ValueError, match="no records"):
        read_required_evidence(spark, str(empty), "community_reports")


def submissions(spark, *texts):
    at = datetime.datetime(2024, 5, 1, 12, 0, 0)
    rows = [(t, "Online Banking", at + datetime.timedelta(seconds=i)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "text string, category string, submitted_at timestamp")


def test_reports_are_stored_unverified(spark, tmp_path):
    calls = []
    path = str(tmp_path / "reports")
    sent = submissions(spark, "Hubungi +60 12-345 6789 melalui http://fake.example.", " \t ", "")
    rows = reports.submit_reports(sent, path, lambda p: calls.append(p.first()[0]), batch="1").collect()
    stored = spark.read.parquet(path)
    assert stored.count() == len(rows) == 1
    row = stored.first()
    assert row["sanitised_text"] == "Hubungi [PHONE_OR_ACCOUNT] melalui [URL]"
    assert row["review_status"] == "unverified" and not row["allowed_for_decision"] and row["category"] == "online_banking"
    assert row["report_id"].startswith("COM-20240501120000-")
    assert rows[0]["saved_locally"] and rows[0]["writeback_available"] and calls[0]["record_count"] == "1"

    def broken(_):
        raise ConnectionError("offline")

    again = reports.submit_reports(sent, path, broken, batch="1").first()
    assert spark.read.parquet(path).count() == 1
    assert again["saved_locally"] and not again["writeback_available"] and "offline" in again["writeback_warning"]


def test_masks_run_once_per_row(spark, sf):
    from workload.queries import QUERIES

    plan = QUERIES["report_rows"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    totals = QUERIES["report_counts"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    # Two tables, each with a branch for texts with an @ and one for texts without.
    assert plan.count("[PHONE_OR_ACCOUNT]") == 4 and "[PHONE_OR_ACCOUNT]" not in totals


def test_catalogue_tables(spark):
    datasets, tags = catalog.dataset_table(spark), catalog.tag_table(spark)
    found = {(r["dataset"], r["tag"]) for r in catalog.tag_rows(datasets, tags, "dataset").collect()}
    assert found == {(d, t) for d, names in catalog.DATASET_TAGS.items() for t in names} and len(found) == 13
    assert all(d.count(".") == 1 for d in catalog.DATASET_TAGS)
    raw = [d for d in catalog.DATASET_TAGS if d.startswith("raw.")]
    registered = datasets.filter("dataset <> 'raw.manual_messages'")
    edges = catalog.lineage_edges(registered, raw, catalog.PROCESSED_DATASET)
    assert sorted(r["upstream"] for r in edges.collect()) == ["raw.synthetic_messages", "raw.uci_sms_spam_collection"]


def test_profile_of_files(spark, sf):
    nation = spark.read.parquet(f"{sf}/nation.parquet")
    row = catalog.dataset_profile(nation, "nation").first()
    assert row["row_count"] == 25 and row["column_count"] == 3
    assert catalog.last_modified(nation).first()[0] is not None
