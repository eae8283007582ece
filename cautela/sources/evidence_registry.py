"""The registered evidence sources and their trust properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cautela.operators.evidence import SOURCE_SCHEMA, TRUST_PROPERTIES

PLATFORM = "cautela"

# Fixed values: (asset, name, description, then the trust properties in their order, synthetic, jurisdiction).
REGISTERED = (
    (
        "official_scam_guidance",
        "Checked advice on tricks",
        "Advice on typical tricks, checked by a person.",
        ("official_style_guidance", "reviewed", "current", "high", "true", "primary"),
        "false",
        "Malaysia prototype",
    ),
    (
        "verified_domains",
        "Sender domains for demonstration",
        "Made-up sender domains for trying out the domain check.",
        ("demonstration", "reviewed", "current", "medium", "true", "domain_demo"),
        "true",
        "Demonstration only",
    ),
    (
        "synthetic_scam_patterns",
        "Invented message patterns",
        "Invented examples in two languages; they support, but do not decide.",
        ("synthetic", "reviewed", "current", "medium", "supporting_only", "pattern_support"),
        "true",
        "Malaysia prototype",
    ),
    (
        "community_reports",
        "Reports from users, unchecked",
        "What users sent in, masked and not yet checked.",
        ("community", "unverified", "current", "low", "false", "excluded_until_reviewed"),
        "true",
        "Malaysia prototype",
    ),
)


def asset_urn(asset: str, platform: str = PLATFORM) -> str:
    return f"urn:li:dataset:(urn:li:dataPlatform:{platform},{platform}.evidence.{asset},PROD)"


def required_urns(platform: str = PLATFORM) -> list[str]:
    return [asset_urn(asset, platform) for asset, *_ in REGISTERED]


def evidence_registry(spark: SparkSession, platform: str = PLATFORM) -> DataFrame:
    rows = []
    for asset, name, description, trust, synthetic, jurisdiction in REGISTERED:
        properties = dict(zip(TRUST_PROPERTIES, trust, strict=True))
        properties.update(synthetic=synthetic, contains_personal_data="false", jurisdiction=jurisdiction)
        rows.append((asset_urn(asset, platform), name, description, properties))
    return spark.createDataFrame(rows, SOURCE_SCHEMA)


def with_profile(registry: DataFrame, profiles: DataFrame) -> DataFrame:
    """Add the profile of each asset to its properties. ``profiles``: urn plus profile columns."""
    facts = [c for c in profiles.columns if c != "urn"]
    entries = F.create_map(*[x for c in facts for x in (F.lit(c), F.col(c).cast("string"))])
    merged = F.coalesce(F.map_concat("custom_properties", "facts"), F.col("custom_properties"))
    return registry.join(profiles.select("urn", entries.alias("facts")), "urn", "left").select(
        "urn", "name", "description", merged.alias("custom_properties")
    )
