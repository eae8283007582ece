import ipaddress
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from cautela.functions import urls
from cautela.operators import model_signal, scoring
from cautela.operators.rules import TEXT_RULES, TextRule, rule_catalogue
from cautela.operators.validation import message_reject_reason
from cautela.plans import assess
from cautela.sources.message_files import read_sample_messages


def assessed(spark, *texts, **options):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return assess.assess_messages(rows, **options).orderBy("i").collect()


def codes(row):
    return [s["code"] for s in row["warning_signs"]]


CASES = [
    (
        "URGENT! Your seller account will be suspended. Pay RM75 today and send your OTP at http://198.51.100.7/check immediately.",
        "High",
        {"urgent_pressure", "threatened_consequence", "payment_request", "credential_request", "ip_address_link"},
    ),
    ("Kindly pay RM8 at https://shop.example.org", "Medium", {"payment_request", "contains_link"}),
    (
        "See http://bit.ly/abc or https://sample.xyz or https://xn--bcher-kva.com",
        "High",
        {"shortened_link", "non_https_link", "watchlist_tld", "punycode_link"},
    ),
    (
        "Balas sekarang juga! Jika lewat, akaun anda akan dibekukan. Sahkan OTP dahulu.",
        "High",
        {"urgent_pressure", "threatened_consequence", "credential_request"},
    ),
    (
        "Bungkusan itu: pakej anda ditahan. Buat pemindahan RM9 hari ini.",
        "Medium",
        {"threatened_consequence", "payment_request"},
    ),
    ("The reading club meets on the second floor on Friday at six.", "Low", set()),
    ("Latihan badminton diadakan di dewan sebelah pada hari Khamis.", "Low", set()),
    (
        "Pengumuman perpustakaan: pada bulan Ogos kami dibuka dari jam 9 pagi. Lihat papan kenyataan untuk butiran.",
        "Low",
        set(),
    ),
]


def test_known_messages(spark):
    rows = assessed(spark, *[c[0] for c in CASES])
    for row, (_, level, expected) in zip(rows, CASES, strict=True):
        assert row["risk_level"] == level
        assert expected <= set(codes(row))
        if not expected:
            assert row["rule_score"] == 0 and row["extracted_urls"] == [] and row["summary"] == scoring.NOTHING_FOUND
    assert rows[0]["rule_score"] == rows[0]["risk_score"] == 100
    assert not rows[0]["machine_learning"]["available"]
    points = [(-s["severity_points"], s["code"]) for s in rows[0]["warning_signs"]]
    assert points == sorted(points)


def test_same_url_once_and_equal_fingerprints(spark):
    rows = assessed(
        spark, "Check https://example.com, then check HTTPS://EXAMPLE.com again.", "Pay   RM 10 now", "Pay RM 10 now"
    )
    assert [u["original"] for u in rows[0]["extracted_urls"]] == ["https://example.com"]
    assert rows[1]["metadata"]["input_fingerprint"] == rows[2]["metadata"]["input_fingerprint"]


def test_second_scheme_in_query(spark):
    row = assessed(spark, "see www.a.com/?u=http://b")[0]
    url = row["extracted_urls"][0]
    assert url["hostname"] is None and not url["uses_https"]
    assert "non_https_link" in codes(row)


AWKWARD_URLS = [
    "http://h.example:8080/p",
    "https://user:pw@h.example/x",
    "http://a@b@c.example/",
    "http://256.1.1.1",
    "http://01.2.3.4",
    "http://1.2.3",
    "http://1.2.3.4:80/a",
    "http://::1/a",
    "http://h.example./x",
    "https:///path",
    "http://Foo_bar.COM?q=a@b",
    "https://xn--a.zip#f",
    "http://bücher.example/ä",
    "http://a\\b.example",
    "http://h.example?x",
]


def test_hosts_as_in_the_standard_library(spark):
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(AWKWARD_URLS)], "i int, u string")
    flags = urls.url_flags(F.col("u"), F.col("u"), urls.hostname(F.col("u")))
    got = [r["f"] for r in rows.select("i", flags.alias("f")).orderBy("i").collect()]
    for url, flag in zip(AWKWARD_URLS, got, strict=True):
        host = urlparse(url).hostname
        assert flag["hostname"] == (host.lower() if host else None), url
        try:
            ipaddress.ip_address(host or "")
            is_ip = True
        except ValueError:
            is_ip = False
        assert flag["is_ip_address"] == is_ip, url


def test_many_urls_keep_first_and_order(spark):
    text = " ".join(f"http://h{i % 300}.example/{'A' if i % 2 else 'a'}" for i in range(1200))
    row = assessed(spark, text)[0]
    assert [u["original"] for u in row["extracted_urls"]] == [f"http://h{i}.example/{'A' if i % 2 else 'a'}" for i in range(300)]


def test_custom_rules_first_of_a_code_wins(spark):
    rules = (
        TextRule("c", "First", "pressure", 5, "e", ("alpha",)),
        TextRule("c", "Second", "pressure", 50, "e", ("beta",)),
        TextRule("contains_link", "Mine", "link", 1, "e", ("alpha",)),
    )
    both, second = assessed(spark, "alpha beta http://x.example", "beta https://x.example", rules=rules)
    assert [s["title"] for s in both["warning_signs"] if s["code"] == "c"] == ["First"]
    assert [s["title"] for s in both["warning_signs"] if s["code"] == "contains_link"] == ["Mine"]
    assert second["rule_score"] == 56


def test_unicode_word_boundaries(spark):
    hits = assessed(spark, "éotp", "otp²", "otp_", "OTP!", "within 2 hours")
    assert [len(codes(h)) for h in hits] == [0, 0, 0, 1, 1]


def test_ml_only_adds(spark):
    texts = ["hello there"] * 5
    rows = spark.createDataFrame(list(enumerate([0.49, 0.55, 0.75, 0.90, 0.8999])), "i int, p double")
    rows = rows.withColumn("text", F.lit(texts[0]))
    got = assess.assess_messages(rows, machine_learning=model_signal.model_assessment(F.col("p"))).orderBy("i").collect()
    assert [r["risk_score"] for r in got] == [0, 10, 20, 30, 20]
    assert "supporting ML evidence" in got[1]["summary"] and got[0]["summary"] == scoring.NOTHING_FOUND
    assert all(r["risk_score"] >= r["rule_score"] for r in got)


def test_validation(spark):
    texts = ["!!!", "Hi", "  Hey  ", None, "x" * 10_001, "①②③"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select("i", message_reject_reason(F.col("t")).alias("r")).orderBy("i").collect()
    assert [r["r"] for r in got] == ["no_letter_or_number", "too_short", None, "missing_text", "too_long", None]


def test_sample_file_bands(spark, tmp_path):
    path = tmp_path / "samples.json"
    path.write_text(
        '{"low_risk": ["Your library book is due next Friday."],\n'
        ' "medium_risk": ["Please pay the RM5 delivery fee at http://parcel-payment.example."],\n'
        ' "high_risk": ["Police notice: install AnyDesk immediately and do not tell anyone."]}'
    )
    (tmp_path / "odd.json").write_text('{"low_risk": "no list"}')
    (tmp_path / "null.json").write_text('{"high_risk": [null]}')
    found = read_sample_messages(spark, str(tmp_path / "*.json"))
    assert sorted((r["reason"], r["raw"]) for r in found.rejected.collect()) == [
        ("missing_text", "high_risk"), ("not_a_message_document", '{"low_risk": "no list"}'),
    ]
    rows = assess.assess_messages(found.rows).collect()
    assert {r["risk_band"].split("_")[0].title(): r["risk_level"] for r in rows} == {k: k for k in ("Low", "Medium", "High")}


@pytest.mark.parametrize("partitions", [1, 7])
def test_every_rule_fires_whatever_the_partitioning(spark, sf, partitions):
    from workload import views

    matched = assess.match_messages(views.messages(spark, sf).repartition(partitions))
    counts = {r["code"]: r["messages"] for r in assess.signal_counts(matched).collect()}
    assert len(counts) == 14 and all(n > 0 for n in counts.values())
    assert sum(counts.values()) == 4052


def test_patterns_are_not_repeated_in_the_plan(spark, sf):
    from workload import views

    rows = assess.signal_rows(assess.assess_messages(views.messages(spark, sf)), "message_id")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    # Three tables, each: one search for all rules and one for this rule.
    assert plan.count("waran tangkap") <= 6


def test_catalogue_hides_patterns(spark):
    rows = rule_catalogue(spark)
    assert rows.count() == len(TEXT_RULES) and "alternatives" not in rows.columns
