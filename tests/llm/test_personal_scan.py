import random
import re

from pyspark.sql import functions as F

from cautela.llm import personal_data
from cautela.llm.personal_data import NUMERIC_SCREEN, WIDE_SCREEN, candidates, mask_personal_data, vote_counts

TEXTS = ["call +44 20 7946 0958 or 4111 1111 1111 1111", "password = abc12345def678", None, "", "jane (at) mail (dot) example.com", "plain"]


def test_patterns_run_once_for_the_vote_counts(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    counts = vote_counts(candidates(rows))
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == len(personal_data.BASE_PATTERNS) + 1
    wide = [w.span.kind for r in candidates(rows).collect() for w in r.wide or []]
    assert sum(r.n for r in counts.collect()) == len(wide) > 0


def test_candidates_are_found_once_for_masking(spark, monkeypatch):
    calls, found = [], candidates
    monkeypatch.setattr(personal_data, "candidates", lambda df: calls.append(1) or found(df))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    masked = mask_personal_data(rows)
    texts = {r.doc_id: r.text for r in masked.collect()}
    assert masked.columns == ["doc_id", "text"] and len(calls) == 1
    assert texts[2] is None and texts[5] == "plain" and texts[0].startswith("call <phone> or <card>") and "abc12345" not in texts[1]
    alone = mask_personal_data(rows.select("text"))
    assert sorted(r.text or "" for r in alone.collect()) == sorted(t or "" for t in texts.values())


def test_screens_let_through_what_the_plain_ones_do(spark):
    pick = random.Random(5)
    texts = ["".join(pick.choice("0123 .-=:)([]atAKIx9999") for _ in range(pick.randint(0, 22))) for _ in range(2_000)]
    numeric = "[0-9]{2}|[0-9][\\x20.-][0-9]"
    wide = r"[0-9]{13}|[0-9]{4}[\x20-][0-9]{4}[\x20-]|\)[\x20.-]?[0-9]{3}|[=:]|AKIA|[\[(]at[\])]"
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = rows.select(F.col("text").rlike(NUMERIC_SCREEN).alias("n"), F.col("text").rlike(WIDE_SCREEN).alias("w"), "text").collect()
    assert [(r.n, r.w) for r in got] == [(bool(re.search(numeric, r.text)), bool(re.search(wide, r.text))) for r in got]
