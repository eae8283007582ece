"""Signals, scores, levels and the wording of an assessment.

All of it is one chain of projections over the message row. The order of signals depends only on
points and code, both known when the plan is built, so the signal array is laid out in sorted
order and never sorted at run time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cautela.functions.text import excerpt, fingerprint
from cautela.functions.urls import extract_urls
from cautela.operators.rules import LINK_RULES, TEXT_RULES, LinkRule, Rule, TextRule, may_match

ANALYSIS_VERSION = "hybrid-0.2.0"
# Output sentences, thresholds and their order.
DISCLAIMER = (
    "This is an automated risk indication, not proof that a message is legitimate or fraudulent. "
    "Verify important requests through official channels."
)
MAX_SCORE = 100
HIGH_FROM, MEDIUM_FROM = 45, 20

NOTHING_FOUND = (
    "No warning signs in the current rule set or ML scoring bands were detected. "
    "This does not prove the message is safe."
)
UNIVERSAL_ACTIONS = (
    "Verify the request using the organisation's official app, website, or published number.",
    "Do not share passwords, OTP/TAC codes, PINs, or banking credentials.",
)
LEVEL_ACTIONS = {
    "High": (
        "Do not reply, transfer money, or provide personal information.",
        "Contact the claimed organisation through a separately verified channel.",
    ),
    "Medium": ("Pause before acting and independently verify the sender and request.",),
    "Low": ("Remain cautious if the sender is unfamiliar or the request is unexpected.",),
}
LINK_ACTION = "Do not open the submitted link until its domain is independently verified."

SIGNAL_TYPE = (
    "struct<code:string,title:string,category:string,severity_points:int,"
    "explanation:string,matched_excerpt:string>"
)


def all_rules(rules: tuple[TextRule, ...] = TEXT_RULES) -> list[Rule]:
    return [*rules, *LINK_RULES]


def with_matches(
    df: DataFrame, text: str = "normalised_text", rules: tuple[TextRule, ...] = TEXT_RULES
) -> DataFrame:
    """Add the URLs and, per rule, the first match (empty or null when the rule does not fire).

    One column per rule: every pattern runs once per row at most, and what nobody reads is pruned. A
    search for the plain text that a rule needs finds out first whether its pattern has to run.
    """
    found = extract_urls(df, text).withColumn("_may_match", may_match(F.col(text), rules))
    columns = {}
    for i, rule in enumerate(all_rules(rules)):
        if isinstance(rule, TextRule):
            columns[_match_name(i)] = F.when(F.col("_may_match")[i], rule.first_match(F.col(text)))
        else:
            columns[_match_name(i)] = rule.first_match(F.col("extracted_urls"))
    return found.withColumns(columns).drop("_may_match")


def _match_name(i: int) -> str:
    return f"_match_{i}"


def drop_matches(df: DataFrame, rules: tuple[TextRule, ...] = TEXT_RULES) -> DataFrame:
    return df.drop(*[_match_name(i) for i in range(len(all_rules(rules)))])


def fired(rules: tuple[TextRule, ...] = TEXT_RULES) -> list[tuple[Rule, Column, Column]]:
    """(rule, whether its signal counts, the raw match) in rule order.

    Of several rules with one code the first that matches counts and the later ones are silent.
    """
    result, earlier = [], {}
    for i, rule in enumerate(all_rules(rules)):
        match = F.col(_match_name(i))
        hit = F.coalesce(F.octet_length(match) > 0, F.lit(False))
        counts = reduce(lambda a, b: a & ~b, earlier.get(rule.code, []), hit)
        earlier.setdefault(rule.code, []).append(hit)
        result.append((rule, counts, match))
    return result


def signal(rule: Rule, match: Column) -> Column:
    shown = match if isinstance(rule, LinkRule) else excerpt(match)
    return F.struct(
        F.lit(rule.code).alias("code"),
        F.lit(rule.title).alias("title"),
        F.lit(rule.category).alias("category"),
        F.lit(rule.points).alias("severity_points"),
        F.lit(rule.explanation).alias("explanation"),
        shown.alias("matched_excerpt"),
    )


def signals(rules: tuple[TextRule, ...] = TEXT_RULES) -> Column:
    """Signals of the row, most points first, then by code."""
    ordered = sorted(fired(rules), key=lambda f: (-f[0].points, f[0].code))
    slots = [F.when(counts, signal(rule, match)) for rule, counts, match in ordered]
    return F.array_compact(F.array(*slots)).cast(f"array<{SIGNAL_TYPE}>")


def rule_score(rules: tuple[TextRule, ...] = TEXT_RULES) -> Column:
    points = [F.when(counts, F.lit(rule.points)).otherwise(F.lit(0)) for rule, counts, _ in fired(rules)]
    return F.least(reduce(lambda a, b: a + b, points), F.lit(MAX_SCORE))


def ml_points(probability: Column) -> Column:
    """Bands over the unrounded probability; no probability, no points."""
    return (
        F.when(probability >= 0.90, F.lit(30))
        .when(probability >= 0.75, F.lit(20))
        .when(probability >= 0.55, F.lit(10))
        .otherwise(F.lit(0))
    )


def risk_score(rule_points: Column, model_points: Column) -> Column:
    return F.least(rule_points + model_points, F.lit(MAX_SCORE))


def risk_level(score: Column) -> Column:
    return (
        F.when(score >= HIGH_FROM, F.lit("High"))
        .when(score >= MEDIUM_FROM, F.lit("Medium"))
        .otherwise(F.lit("Low"))
    )


def summary(level: Column, found: Column, urls: Column, model_points: Column) -> Column:
    strongest = F.array_join(F.transform(F.slice(found, 1, 3), lambda s: F.lower(s["title"])), ", ")
    link_note = F.when(
        F.size(urls) > 0,
        F.concat(F.lit(" "), F.size(urls).cast("string"), F.lit(" link(s) were extracted for inspection.")),
    ).otherwise(F.lit(""))
    model_note = F.when(
        model_points > 0,
        F.concat(F.lit(" The ML model added "), model_points.cast("string"), F.lit(" supporting point(s).")),
    ).otherwise(F.lit(""))
    from_model_only = F.concat(
        level,
        F.lit(
            " risk based on supporting ML evidence. "
            "No deterministic warning rule matched, so independent verification is important."
        ),
    )
    from_signals = F.concat(
        level,
        F.lit(" risk: detected "),
        F.size(found).cast("string"),
        F.lit(" warning sign(s), including "),
        strongest,
        F.lit("."),
        link_note,
        model_note,
    )
    return (
        F.when((F.size(found) == 0) & (model_points == 0), F.lit(NOTHING_FOUND))
        .when(F.size(found) == 0, from_model_only)
        .otherwise(from_signals)
    )


def recommended_actions(level: Column, has_url: Column) -> Column:
    def texts(values) -> Column:
        return F.array(*[F.lit(v) for v in values])

    by_level = (
        F.when(level == "High", texts(LEVEL_ACTIONS["High"]))
        .when(level == "Medium", texts(LEVEL_ACTIONS["Medium"]))
        .otherwise(texts(LEVEL_ACTIONS["Low"]))
    )
    for_link = F.when(has_url, texts((LINK_ACTION,))).otherwise(F.array().cast("array<string>"))
    return F.concat(by_level, for_link, texts(UNIVERSAL_ACTIONS))


def analysis_metadata(text: Column, rules: tuple[TextRule, ...] = TEXT_RULES) -> Column:
    return F.struct(
        F.lit(ANALYSIS_VERSION).alias("analysis_version"),
        F.lit(len(rules)).alias("rules_evaluated"),
        fingerprint(text).alias("input_fingerprint"),
    )
