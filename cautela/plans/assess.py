"""From raw messages to full assessments: no shuffle from the scan to the last column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cautela.functions.text import normalise
from cautela.operators import scoring
from cautela.operators.model_signal import model_unavailable
from cautela.operators.rules import TEXT_RULES, TextRule
from cautela.operators.validation import message_reject_reason


def validate_messages(messages: DataFrame, text: str = "text") -> DataFrame:
    return messages.withColumn("reject_reason", message_reject_reason(F.col(text)))


def split_messages(messages: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with their reason)"""
    checked = validate_messages(messages, text)
    accepted = checked.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return accepted, checked.filter(F.col("reject_reason").isNotNull())


def with_normalised_text(messages: DataFrame, text: str = "text") -> DataFrame:
    return messages.withColumn("normalised_text", normalise(F.col(text)))


def match_messages(
    messages: DataFrame, text: str = "text", rules: tuple[TextRule, ...] = TEXT_RULES
) -> DataFrame:
    """Normalised text, URLs and per-rule matches of every message."""
    return scoring.with_matches(with_normalised_text(messages, text), rules=rules)


def assess_messages(
    messages: DataFrame,
    text: str = "text",
    rules: tuple[TextRule, ...] = TEXT_RULES,
    machine_learning: Column | None = None,
) -> DataFrame:
    """One assessment per message; the input columns are kept.

    ``machine_learning`` is a struct column over the messages (see ``operators.model_signal``);
    without it rules alone decide.
    """
    matched = match_messages(messages, text, rules).withColumn(
        "machine_learning", model_unavailable() if machine_learning is None else machine_learning
    )
    model_points = F.col("machine_learning.score_contribution")
    scored = matched.withColumns(
        {"warning_signs": scoring.signals(rules), "rule_score": scoring.rule_score(rules)}
    )
    scored = scoring.drop_matches(scored, rules)
    scored = scored.withColumn("risk_score", scoring.risk_score(F.col("rule_score"), model_points))
    scored = scored.withColumn("risk_level", scoring.risk_level(F.col("risk_score")))
    return scored.withColumns(
        {
            "summary": scoring.summary(
                F.col("risk_level"), F.col("warning_signs"), F.col("extracted_urls"), model_points
            ),
            "recommended_actions": scoring.recommended_actions(
                F.col("risk_level"), F.size("extracted_urls") > 0
            ),
            "metadata": scoring.analysis_metadata(F.col("normalised_text"), rules),
            "disclaimer": F.lit(scoring.DISCLAIMER),
        }
    )


def _exploded(df: DataFrame, array: str, pos: str, keep: tuple[str, ...]) -> DataFrame:
    # The outer form on purpose: for the inner one the optimizer adds a filter on the array below
    # the projections that build it, and every pattern would run again for that filter.
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, "e"))
    return rows.filter(F.col(pos).isNotNull())


def signal_rows(assessments: DataFrame, *keep: str) -> DataFrame:
    """Long form: one row per message and signal, numbered in their order."""
    return _exploded(assessments, "warning_signs", "signal_pos", keep).select(*keep, "signal_pos", "e.*")


def url_rows(with_urls: DataFrame, *keep: str) -> DataFrame:
    return _exploded(with_urls, "extracted_urls", "url_pos", keep).select(*keep, "url_pos", "e.*")


def action_rows(assessments: DataFrame, *keep: str) -> DataFrame:
    rows = _exploded(assessments, "recommended_actions", "action_pos", keep)
    return rows.withColumnRenamed("e", "action")


def level_counts(assessments: DataFrame) -> DataFrame:
    return assessments.groupBy("risk_level").agg(
        F.count("*").alias("messages"), F.sum(F.col("rule_score").cast("bigint")).alias("total_rule_score")
    )


def signal_counts(matched: DataFrame, rules: tuple[TextRule, ...] = TEXT_RULES) -> DataFrame:
    """Messages per signal code: one pass with a counter per rule, then one row per code.

    Codes that never fired are listed with zero.
    """
    conditions: dict[str, Column] = {}
    points: dict[str, int] = {}
    for rule, counts, _ in scoring.fired(rules):
        conditions[rule.code] = conditions[rule.code] | counts if rule.code in conditions else counts
        points.setdefault(rule.code, rule.points)
    totals = matched.agg(*[F.count_if(c).alias(code) for code, c in conditions.items()])
    entries = [
        F.struct(
            F.lit(code).alias("code"),
            F.lit(points[code]).alias("severity_points"),
            F.col(code).alias("messages"),
        )
        for code in conditions
    ]
    return totals.select(F.inline(F.array(*entries)))
