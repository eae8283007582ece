"""Which evidence sources may be used, and why; and how that is attached to assessments."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cautela.functions.text import first_non_blank, metadata_value

TRUST_PROPERTIES = (
    "source_classification",
    "review_status",
    "freshness_status",
    "reliability_level",
    "allowed_for_decision",
    "evidence_role",
)
BLOCKED_VALUES = ("false", "no", "0", "blocked")
OFFICIAL_CLASSES = ("official", "official_style_guidance")
SUPPORTING_CLASSES = ("public", "demonstration", "community")

# Fixed wording of the decisions, in the order in which they are tried.
REASONS = {
    "blocked": "The source is explicitly not approved for decision-making.",
    "unreviewed": "The source has not been reviewed and cannot be used as trusted evidence.",
    "stale": "The source is marked as stale and may no longer be reliable.",
    "synthetic": (
        "The source is reviewed synthetic evidence. It may support pattern recognition but cannot "
        "independently confirm a real scam."
    ),
    "official": "The source is reviewed, current, and approved as primary guidance.",
    "supporting": "The source is reviewed and current, but is used only as supporting evidence.",
    "unknown": "The source classification is unknown or unsupported by the evidence policy.",
}
DECISION_COLUMNS = (
    "name",
    "urn",
    "source_classification",
    "review_status",
    "freshness_status",
    "reliability",
    "configured_evidence_role",
    "decision",
    "role",
    "reason",
)
SOURCE_SCHEMA = "urn string, name string, description string, custom_properties map<string,string>"
DECISION_TYPE = "struct<" + ",".join(f"{c}:string" for c in DECISION_COLUMNS) + ">"

NOT_CHECKED = "Evidence provenance was not checked."
COULD_NOT_CHECK = "Evidence provenance could not be checked."
BUNDLE_SCHEMA = (
    f"available boolean, integration_mode string, selected_evidence array<{DECISION_TYPE}>, "
    f"excluded_evidence array<{DECISION_TYPE}>, provenance_summary string, warning string"
)


def property_value(df: DataFrame, key: str) -> Column:
    """A column of the source wins over its property map; the second spelling of the map is last."""
    places = [F.col(key).cast("string")] if key in df.columns else []
    for name in ("custom_properties", "customProperties"):
        if name in df.columns:
            places.append(F.try_element_at(F.col(name), F.lit(key)))
            break
    return metadata_value(F.coalesce(*places, F.lit("")))


def decide_sources(sources: DataFrame, *keep: str) -> DataFrame:
    """One decision per source; the first rule of the policy that applies decides."""
    known = {key: property_value(sources, key) for key in TRUST_PROPERTIES}
    name = F.coalesce(
        *[F.col(c) for c in ("name", "display_name") if c in sources.columns], F.lit("Unnamed evidence source")
    )
    urn = F.col("urn") if "urn" in sources.columns else F.lit(None).cast("string")
    read = sources.select(*keep, name.alias("name"), urn.alias("urn"), *[v.alias(k) for k, v in known.items()])
    branch = (
        F.when(F.col("allowed_for_decision").isin(*BLOCKED_VALUES), "blocked")
        .when(F.col("review_status") != "reviewed", "unreviewed")
        .when(F.col("freshness_status") == "stale", "stale")
        .when(
            (F.col("allowed_for_decision") == "supporting_only") | (F.col("source_classification") == "synthetic"),
            "synthetic",
        )
        .when(F.col("source_classification").isin(*OFFICIAL_CLASSES), "official")
        .when(F.col("source_classification").isin(*SUPPORTING_CLASSES), "supporting")
        .otherwise("unknown")
    )
    role = (
        F.when(F.col("branch") == "official", "primary")
        .when(F.col("branch") == "synthetic", "supporting_only")
        .when(F.col("branch") == "supporting", "supporting")
        .otherwise("excluded")
    )
    reason = F.element_at(F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv]), F.col("branch"))

    def or_unknown(c: str) -> Column:
        return F.when(F.col(c) == "", F.lit("unknown")).otherwise(F.col(c))

    return read.withColumn("branch", branch).select(
        *keep,
        "name",
        "urn",
        "source_classification",
        "review_status",
        "freshness_status",
        or_unknown("reliability_level").alias("reliability"),
        or_unknown("evidence_role").alias("configured_evidence_role"),
        F.when(role == "excluded", F.lit("excluded")).otherwise(F.lit("selected")).alias("decision"),
        role.alias("role"),
        reason.alias("reason"),
    )


def evidence_counts(decisions: DataFrame, *by: str) -> DataFrame:
    """Selected, primary, supporting and excluded sources, with the provenance sentence."""
    counts = decisions.groupBy(*by).agg(
        F.count_if(F.col("decision") == "selected").alias("selected_sources"),
        F.count_if(F.col("role") == "primary").alias("primary_sources"),
        F.count_if(F.col("role").isin("supporting", "supporting_only")).alias("supporting_sources"),
        F.count_if(F.col("decision") != "selected").alias("excluded_sources"),
    )
    return counts.withColumn(
        "provenance_summary",
        provenance_summary(*[F.col(f"{k}_sources") for k in ("selected", "primary", "supporting", "excluded")]),
    )


def provenance_summary(selected: Column, primary: Column, supporting: Column, excluded: Column) -> Column:
    return F.format_string(
        "Selected %d evidence source(s): %d primary and %d supporting. "
        "Excluded %d source(s) because they did not satisfy the trust policy.",
        selected,
        primary,
        supporting,
        excluded,
    )


def parse_properties(*candidates: Column) -> Column:
    """Property map from JSON texts, tried in order.

    A candidate is an object, or a list of {key, value} objects. The first object ends the search,
    even an empty one; a list only if it names at least one key.
    """

    def from_list(text: Column) -> Column:
        items = F.from_json(text, "array<string>")
        pairs = F.filter(
            F.transform(
                items,
                lambda i: F.struct(
                    F.get_json_object(i, "$.key").alias("key"), F.get_json_object(i, "$.value").alias("value")
                ),
            ),
            lambda p: p["key"].isNotNull(),
        )
        # Of equal keys the last one counts.
        last = F.aggregate(
            pairs,
            F.create_map().cast("map<string,string>"),
            lambda acc, p: F.map_concat(
                F.map_filter(acc, lambda k, _: k != p["key"]), F.create_map(p["key"], p["value"])
            ),
        )
        return F.when(F.size(pairs) > 0, last)

    def one(text: Column) -> Column:
        shape = F.substring(F.ltrim(text), 1, 1)
        return F.when(shape == "{", F.from_json(text, "map<string,string>")).when(shape == "[", from_list(text))

    return F.coalesce(*[one(c) for c in candidates], F.create_map().cast("map<string,string>"))


def read_entities(entities: DataFrame, entity: str = "entity") -> DataFrame:
    """Sources from catalogue entities in JSON, whichever of the known layouts they use."""
    base = ("", "properties.", "aspects.datasetProperties.")

    def at(path: str) -> Column:
        return F.get_json_object(F.col(entity), f"$.{path}")

    maps = [at(f"{b}{k}") for b in base for k in ("customProperties", "custom_properties")]
    urn = first_non_blank(at("urn"))
    return entities.select(
        *[c for c in entities.columns if c != entity],
        urn.alias("urn"),
        first_non_blank(*[at(f"{b}name") for b in base], at("urn")).alias("name"),
        first_non_blank(*[at(f"{b}description") for b in base]).alias("description"),
        parse_properties(*maps).alias("custom_properties"),
    )


def missing_properties(properties: Column, required: Sequence[str] = TRUST_PROPERTIES) -> Column:
    return F.array_sort(F.array_except(F.array(*[F.lit(p) for p in required]), F.map_keys(properties)))


def required_assets(sources: DataFrame, required: Sequence[str]) -> DataFrame:
    """One row per required urn, in its order; the columns of an absent source are null.

    The catalogue is filtered to the required urns first: the join has as many rows as the list.
    """
    wanted = sources.sparkSession.createDataFrame(list(enumerate(required)), "ordinal int, urn string")
    rest = [c for c in sources.columns if c != "urn"]
    # Of several entries for one urn a fixed one is taken: the last by content.
    entry = F.struct(*rest)
    present = sources.filter(F.col("urn").isin(*required)).groupBy("urn").agg(F.max_by(entry, F.to_json(entry)).alias("s"))
    marked = present.select("urn", F.lit(True).alias("found"), "s.*")
    return wanted.join(marked, "urn", "left").select(
        "ordinal", "urn", F.coalesce("found", F.lit(False)).alias("found"), *rest
    )


def missing_assets(sources: DataFrame, required: Sequence[str]) -> DataFrame:
    return required_assets(sources, required).filter(~F.col("found")).select("ordinal", "urn")


def evidence_bundle(required_sources: DataFrame, mode: str, warning: str | None = None) -> DataFrame:
    """Decisions of the required sources as one row. ``required_sources`` comes from ``required_assets``."""
    decisions = decide_sources(required_sources.filter("found"), "ordinal")
    decision = F.struct("ordinal", *DECISION_COLUMNS)

    def of(kind: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("decision") == kind, decision)))
        return F.transform(rows, lambda d: F.struct(*[d[c].alias(c) for c in DECISION_COLUMNS]))

    def number(condition: Column) -> Column:
        return F.count_if(condition)

    role = F.col("role")
    return decisions.agg(
        F.lit(True).alias("available"),
        F.lit(mode).alias("integration_mode"),
        of("selected").alias("selected_evidence"),
        of("excluded").alias("excluded_evidence"),
        provenance_summary(
            number(F.col("decision") == "selected"),
            number(role == "primary"),
            number(role.isin("supporting", "supporting_only")),
            number(F.col("decision") == "excluded"),
        ).alias("provenance_summary"),
        F.lit(warning).cast("string").alias("warning"),
    )


class EvidenceUnavailable(RuntimeError):
    """A provider cannot supply the required sources."""


def _checked(spark: SparkSession, sources: DataFrame, required: Sequence[str], need_properties: bool) -> DataFrame:
    """The required sources of one provider; at most one row per required urn is looked at."""
    found = required_assets(sources, required)
    rows = found.select(
        "urn", "found", missing_properties(F.col("custom_properties")).alias("missing"), "custom_properties", "name",
        "description", "ordinal",
    ).orderBy("ordinal").collect()
    absent = [r["urn"] for r in rows if not r["found"]]
    if need_properties:
        for r in rows:
            if r["found"] and r["missing"]:
                raise EvidenceUnavailable(f"Entity {r['urn']} is missing trust properties: {', '.join(r['missing'])}")
    if absent:
        raise EvidenceUnavailable(f"Required evidence assets were not returned: {absent}")
    kept = [(r["ordinal"], r["urn"], True, r["name"], r["description"], r["custom_properties"]) for r in rows]
    return spark.createDataFrame(kept, f"ordinal int, {SOURCE_SCHEMA.replace('urn string,', 'urn string, found boolean,')}")


def resolve_context(
    spark: SparkSession,
    required: Sequence[str],
    primary: Callable[[], DataFrame],
    fallback: Callable[[], DataFrame] | None = None,
    primary_mode: str = "agent_context_kit",
    fallback_mode: str = "python_sdk_fallback",
) -> DataFrame:
    """The one-row evidence bundle: first provider, else the second with a warning, else empty.

    Providers return sources (``SOURCE_SCHEMA``) and may fail in any way; scoring never does.
    """
    try:
        return evidence_bundle(_checked(spark, primary(), required, True), primary_mode)
    except Exception as first_error:  # noqa: BLE001 - a provider may raise anything
        problem = str(first_error)
    if fallback is not None:
        try:
            sources = _checked(spark, fallback(), required, False)
            warning = f"The first evidence provider failed, so the fallback was used: {problem}"
            return evidence_bundle(sources, fallback_mode, warning)
        except Exception:  # noqa: BLE001
            problem = f"Both evidence providers failed: {problem}"
    else:
        problem = f"The evidence provider failed: {problem}"
    return spark.createDataFrame([(False, "unavailable", [], [], COULD_NOT_CHECK, problem)], BUNDLE_SCHEMA)


def attach_context(assessments: DataFrame, bundle: DataFrame | None) -> DataFrame:
    """Every assessment with the one bundle. A scalar subquery: no join, and no score is touched."""
    if bundle is None:
        bundle = assessments.sparkSession.createDataFrame(
            [(False, "unavailable", [], [], NOT_CHECKED, None)], BUNDLE_SCHEMA
        )
    one = bundle.select(F.struct(*bundle.columns).alias("b")).scalar()
    with_bundle = assessments.withColumn("_bundle", one)
    names = {
        "context_available": "available",
        "integration_mode": "integration_mode",
        "selected_evidence": "selected_evidence",
        "excluded_evidence": "excluded_evidence",
        "provenance_summary": "provenance_summary",
        "context_warning": "warning",
    }
    return with_bundle.withColumns({out: F.col(f"_bundle.{c}") for out, c in names.items()}).drop("_bundle")
