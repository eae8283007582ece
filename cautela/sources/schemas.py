"""Explicit schemas of everything the package reads."""

from __future__ import annotations

LABELLED_COLUMNS = (
    "record_id",
    "text",
    "label",
    "source",
    "source_type",
    "language",
    "review_status",
    "is_synthetic",
    "license",
    "created_at",
)
# The label is read as text: a value that is no label must be reported, not silently become null.
LABELLED_CSV = (
    "record_id string, text string, label string, source string, source_type string, language string, "
    "review_status string, is_synthetic boolean, license string, created_at date"
)
HAM_SPAM_TSV = "raw_label string, text string"

EVIDENCE_SCHEMAS = {
    "official_scam_guidance": (
        "guidance_id string, category string, warning_sign string, recommended_action string, source_name string"
    ),
    "verified_domains": (
        "domain_id string, organisation string, official_domain string, category string, "
        "verification_status string"
    ),
    "synthetic_scam_patterns": (
        "pattern_id string, category string, language string, pattern_text string, synthetic boolean"
    ),
    "community_reports": (
        "report_id string, category string, sanitised_text string, review_status string, "
        "allowed_for_decision boolean"
    ),
}
REPORT_COLUMNS = ("report_id", "category", "sanitised_text", "review_status", "allowed_for_decision")
