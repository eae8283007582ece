"""DuckDB SQL for the registered queries, stated independently of the Spark code.

Only the fixed values (messages, rules, property values) are shared. RE2 has no lookaround, so word
boundaries are consuming groups; Unicode compatibility forms are left out because no table holds
text that they change.
"""

from __future__ import annotations

from cautela.operators import catalog
from cautela.operators import classifier as cl
from cautela.operators import evidence as ev
from cautela.operators import reports as rp
from cautela.operators import scoring as sc
from cautela.operators.catalog import DATASET_TAGS, TAGS
from cautela.operators.model_signal import NOT_LOADED
from cautela.operators.rules import LINK_RULES, TEXT_RULES
from cautela.sources import curated, evidence_registry, synthetic
from cautela.sources.schemas import LABELLED_COLUMNS
from workload import views

ORACLES: dict[str, str] = {}


def lit(value) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def listing(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# The message view


def opener(number: str) -> str:
    picked = f"({listing(t for _, t in views.OPENERS)})[({number}) % {len(views.OPENERS)} + 1]"
    return f"replace({picked}, '{{n}}', CAST(({number}) % 250 AS VARCHAR))"


def opener_label(number: str) -> str:
    return f"([{', '.join(str(s) for s, _ in views.OPENERS)}])[({number}) % {len(views.OPENERS)} + 1]"


DOCUMENT_MESSAGES = (
    f"SELECT 'D' || doc_id AS message_id, {opener('doc_id')} || ' ' || text AS text, "
    f"{opener_label('doc_id')} AS label FROM documents"
)
CONVERSATION_MESSAGES = (
    f"SELECT 'C' || conv_id || '-' || turn AS message_id, {opener('conv_id + turn')} || ' ' || text AS text, "
    f"{opener_label('conv_id + turn')} AS label FROM conversations"
)
ORDER_MESSAGES = (
    f"SELECT 'O' || o_orderkey AS message_id, "
    f"{opener('o_orderkey')} || ' Ref ' || o_orderkey || ' ' || o_orderpriority AS text, "
    f"{opener_label('o_orderkey')} AS label FROM orders"
)
MESSAGES = f"messages AS ({DOCUMENT_MESSAGES} UNION ALL {CONVERSATION_MESSAGES} UNION ALL {ORDER_MESSAGES})"


def squeezed(text: str) -> str:
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


def normed(source: str = "messages") -> str:
    return f"normed AS (SELECT message_id, label, {squeezed('text')} AS t FROM {source})"


# Rules and links


def rule_pattern(rule) -> str:
    return rf"(^|[^\pL\pN_])({'|'.join(rule.alternatives)})($|[^\pL\pN_])"


def text_hits(rows: str = "normed") -> str:
    parts = []
    for rule in TEXT_RULES:
        match = f"regexp_extract(t, {lit(rule_pattern(rule))}, 2, 'i')"
        parts.append(
            f"SELECT message_id, {lit(rule.code)} AS code, {rule.points} AS points, {match} AS m FROM {rows} WHERE {match} <> ''"
        )
    shown = "CASE WHEN length(m) > 80 THEN substr(m, 1, 79) || '…' ELSE m END"
    return f"text_hits AS (SELECT message_id, code, points, {shown} AS excerpt FROM ({' UNION ALL '.join(parts)}))"


OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def url_ctes(rows: str, key: str, text: str) -> list[str]:
    pattern = r"""(?:https?://|www\.)[^\s<>\[\]{}"']+"""
    shorteners = ", ".join(
        lit(h)
        for h in ("bit.ly", "tinyurl.com", "t.co", "goo.gl", "is.gd", "ow.ly", "buff.ly", "cutt.ly", "rebrand.ly")
    )
    tlds = ", ".join(lit(t) for t in ("zip", "top", "xyz", "click", "link", "work", "support"))
    return [
        f"found AS (SELECT {key} AS k, regexp_extract_all({text}, {lit(pattern)}, 0, 'i') AS l FROM {rows})",
        "raw_urls AS (SELECT k, unnest(l) AS raw, generate_subscripts(l, 1) AS p FROM found)",
        "clean_urls AS (SELECT k, p, rtrim(raw, '.,;:!?)]}') AS original FROM raw_urls)",
        "full_urls AS (SELECT k, p, original, CASE WHEN contains(original, '://') THEN original "
        "ELSE 'https://' || original END AS normalised FROM clean_urls)",
        "first_urls AS (SELECT *, row_number() OVER (PARTITION BY k, lower(normalised) ORDER BY p) AS nth FROM full_urls)",
        "hosts AS (SELECT k, p, original, normalised, nullif(lower(regexp_extract(regexp_replace(regexp_extract("
        "normalised, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), '^([^:]*)', 1)), '') AS hostname "
        "FROM first_urls WHERE nth = 1)",
        "urls AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY p) - 1 AS url_pos, original, normalised, hostname, "
        "lower(normalised) LIKE 'https://%' AS uses_https, "
        f"coalesce(regexp_matches(hostname, '^{OCTET}(\\.{OCTET}){{3}}$'), false) AS is_ip_address, "
        "coalesce(contains(hostname, 'xn--'), false) AS uses_punycode, "
        f"coalesce(hostname IN ({shorteners}), false) AS is_known_shortener, "
        "coalesce(contains(hostname, '.') AND regexp_extract(hostname, '([^.]*)$', 1) "
        f"IN ({tlds}), false) AS has_suspicious_tld FROM hosts)",
    ]


def link_hits() -> str:
    parts = []
    for rule in LINK_RULES:
        condition = "true" if rule.flag is None else (rule.flag if rule.flag_value else f"NOT {rule.flag}")
        parts.append(
            f"SELECT k AS message_id, {lit(rule.code)} AS code, {rule.points} AS points, "
            f"arg_min(original, url_pos) AS excerpt FROM urls WHERE {condition} GROUP BY k"
        )
    return f"link_hits AS ({' UNION ALL '.join(parts)})"


ALL_RULES = [*TEXT_RULES, *LINK_RULES]


def rule_values() -> str:
    rows = ", ".join(
        f"({lit(r.code)}, {lit(r.title)}, {lit(r.category)}, {r.points}, {lit(r.explanation)})" for r in ALL_RULES
    )
    return f"rules(code, title, category, points, explanation) AS (VALUES {rows})"


def scoring_ctes(source: str = "messages") -> list[str]:
    """Down to ``scored``: every message with its score, level, signals and URLs."""
    return [
        MESSAGES,
        normed(source),
        text_hits(),
        *url_ctes("normed", "message_id", "t"),
        link_hits(),
        "hits AS (SELECT * FROM text_hits UNION ALL SELECT * FROM link_hits)",
        rule_values(),
        "ordered AS (SELECT h.*, r.title, r.category, r.explanation, "
        "row_number() OVER (PARTITION BY message_id ORDER BY h.points DESC, h.code) - 1 AS pos "
        "FROM hits h JOIN rules r USING (code))",
        "totals AS (SELECT message_id, CAST(least(sum(points), 100) AS INTEGER) AS rule_score, count(*) AS n, "
        "string_agg(lower(title), ', ' ORDER BY pos) FILTER (pos < 3) AS strongest FROM ordered GROUP BY message_id)",
        "url_totals AS (SELECT k AS message_id, count(*) AS n_urls FROM urls GROUP BY k)",
        "scored AS (SELECT message_id, label, t, coalesce(rule_score, 0) AS rule_score, coalesce(n, 0) AS n, strongest, "
        "coalesce(n_urls, 0) AS n_urls FROM normed LEFT JOIN totals USING (message_id) "
        "LEFT JOIN url_totals USING (message_id))",
    ]


def level(score: str) -> str:
    return f"CASE WHEN {score} >= 45 THEN 'High' WHEN {score} >= 20 THEN 'Medium' ELSE 'Low' END"


def summary(score: str, ml: str = "0") -> str:
    return (
        f"CASE WHEN n = 0 AND {ml} = 0 THEN {lit(sc.NOTHING_FOUND)} "
        f"WHEN n = 0 THEN {level(score)} || ' risk based on supporting ML evidence. No deterministic warning rule matched, "
        f"so independent verification is important.' "
        f"ELSE {level(score)} || ' risk: detected ' || n || ' warning sign(s), including ' || strongest || '.' || "
        f"CASE WHEN n_urls > 0 THEN ' ' || n_urls || ' link(s) were extracted for inspection.' ELSE '' END || "
        f"CASE WHEN {ml} > 0 THEN ' The ML model added ' || {ml} || ' supporting point(s).' ELSE '' END END"
    )


SCORED = with_(*scoring_ctes())

ORACLES["rule_hits"] = (
    with_(MESSAGES, normed(), text_hits())
    + "SELECT message_id, code, points AS severity_points, excerpt AS matched_excerpt FROM text_hits"
)
ORACLES["link_signals"] = (
    with_(MESSAGES, normed(), *url_ctes("normed", "message_id", "t"), link_hits())
    + "SELECT message_id, code, points AS severity_points, excerpt AS matched_excerpt FROM link_hits"
)
ORACLES["signal_order"] = (
    SCORED + "SELECT message_id, pos AS signal_pos, code, title, category, explanation FROM ordered"
)
ORACLES["signal_counts"] = (
    SCORED
    + "SELECT code, points AS severity_points, count(message_id) AS messages "
    "FROM rules r LEFT JOIN (SELECT code, message_id FROM hits) h USING (code) GROUP BY code, points"
)
ORACLES["rule_coverage"] = (
    SCORED
    + "SELECT code, title, category, points AS severity_points, explanation, count(message_id) AS messages "
    "FROM rules r LEFT JOIN (SELECT code, message_id FROM hits) h USING (code) WHERE category <> 'link' "
    "GROUP BY code, title, category, points, explanation"
)
ORACLES["risk_scores"] = (
    SCORED + f"SELECT message_id, rule_score, rule_score AS risk_score, {level('rule_score')} AS risk_level FROM scored"
)
ORACLES["risk_level_counts"] = (
    SCORED
    + f"SELECT {level('rule_score')} AS risk_level, count(*) AS messages, "
    "CAST(sum(rule_score) AS BIGINT) AS total_rule_score FROM scored GROUP BY 1"
)
ORACLES["assessment_summary"] = SCORED + f"SELECT message_id, {summary('rule_score')} AS summary FROM scored"


def actions(score: str) -> str:
    link = f"CASE WHEN n_urls > 0 THEN {listing([sc.LINK_ACTION])} ELSE [] END"
    by_level = (
        f"CASE WHEN {score} >= 45 THEN {listing(sc.LEVEL_ACTIONS['High'])} "
        f"WHEN {score} >= 20 THEN {listing(sc.LEVEL_ACTIONS['Medium'])} ELSE {listing(sc.LEVEL_ACTIONS['Low'])} END"
    )
    return f"list_concat({by_level}, {link}, {listing(sc.UNIVERSAL_ACTIONS)})"


ORACLES["recommended_actions"] = (
    SCORED
    + "SELECT message_id, generate_subscripts(a, 1) - 1 AS action_pos, unnest(a) AS action "
    f"FROM (SELECT message_id, {actions('rule_score')} AS a FROM scored)"
)

REJECT_MESSAGE = (
    "CASE WHEN text IS NULL THEN 'missing_text' WHEN length(c) < 3 THEN 'too_short' WHEN length(c) > 10000 THEN 'too_long' "
    r"WHEN NOT regexp_matches(c, '[\pL\pN]') THEN 'no_letter_or_number' END"
)
STRIPPED = "trim(text, ' ' || chr(9) || chr(10) || chr(13))"
ORACLES["message_validation"] = (
    with_(MESSAGES)
    + f"SELECT message_id, {REJECT_MESSAGE} AS reject_reason FROM (SELECT message_id, text, {STRIPPED} AS c FROM ("
    "SELECT message_id, text FROM messages UNION ALL SELECT 'S' || o_orderkey, o_orderstatus FROM orders "
    "UNION ALL SELECT 'M' || p_partkey, regexp_replace(p_name, '[a-z]', '!', 'g') FROM part))"
)


def full_assessment(messages: str) -> str:
    accepted = (
        f"accepted AS (SELECT * FROM (SELECT *, {STRIPPED} AS c FROM ({messages})) WHERE ({REJECT_MESSAGE}) IS NULL)"
    )
    ctes = scoring_ctes("accepted")
    return with_(ctes[0], accepted, *ctes[1:])


ORACLES["full_assessment"] = full_assessment("SELECT * FROM messages") + (
    f"SELECT message_id, {level('rule_score')} AS risk_level, rule_score AS risk_score, rule_score, "
    f"{summary('rule_score')} AS summary, n AS signals, n_urls AS urls, "
    f"CAST(len({actions('rule_score')}) AS BIGINT) AS actions, false AS model_available, 'unavailable' AS model_label, "
    f"{lit(sc.ANALYSIS_VERSION)} AS analysis_version, {len(TEXT_RULES)} AS rules_evaluated, "
    f"substr(sha256(t), 1, 16) AS input_fingerprint, {lit(sc.DISCLAIMER)} AS disclaimer FROM scored"
)
ORACLES["stream_assessments"] = full_assessment(f"{DOCUMENT_MESSAGES} UNION ALL {CONVERSATION_MESSAGES} UNION ALL {ORDER_MESSAGES}") + (
    f"SELECT message_id, {level('rule_score')} AS risk_level, rule_score AS risk_score, {summary('rule_score')} AS summary FROM scored"
)
ORACLES["fingerprints"] = (
    f"SELECT item, substr(sha256(t), 1, 16) AS fingerprint, length(t) AS n_chars FROM (SELECT item, {squeezed('text')} AS t "
    "FROM (SELECT 'D' || doc_id AS item, text FROM documents UNION ALL SELECT 'P' || page_id, html FROM pages))"
)

URL_COLUMNS = (
    "url_pos, original, normalised, hostname, uses_https, is_ip_address, uses_punycode, is_known_shortener, "
    "has_suspicious_tld"
)
ORACLES["url_flags"] = (
    with_(MESSAGES, normed(), *url_ctes("normed", "message_id", "t")) + f"SELECT k AS message_id, {URL_COLUMNS} FROM urls"
)
ORACLES["url_flags_pages"] = (
    with_(f"p AS (SELECT page_id, {squeezed('html')} AS t FROM pages)", *url_ctes("p", "page_id", "t"))
    + f"SELECT k AS page_id, {URL_COLUMNS} FROM urls"
)
ORACLES["page_url_hosts"] = (
    "SELECT page_id, h AS hostname, CASE WHEN contains(h, '.') THEN regexp_extract(h, '([^.]*)$', 1) ELSE '' END AS tld, "
    "lower(url) LIKE 'https://%' AS uses_https FROM (SELECT page_id, url, "
    "lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS h FROM pages)"
)

# Reports

MASK_URL = r"""'(^|[^\pL\pN_])(https?://|www\.)[^\s<>"]+', '\1[URL]', 'gi'"""
MASK_EMAIL = r"'\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b', '[EMAIL]', 'gi'"
MASK_NUMBER = r"'(^|[^\pL\pN_])\+?\d[\d\s().-]{6,}\d($|[^\pL\pN_])', '\1[PHONE_OR_ACCOUNT]\2', 'g'"


def masked(text: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({text}, {MASK_URL}), {MASK_EMAIL}), {MASK_NUMBER})"


def guarded(text: str) -> str:
    return f"CASE WHEN {text}[1:1] IN ('=', '+', '-', '@') THEN '''' || {text} ELSE {text} END"


def sanitised(key: str, text: str, table: str) -> str:
    return f"SELECT {key}, {guarded('s')} AS sanitised_text FROM (SELECT {key}, {squeezed(masked(text))} AS s FROM {table})"


ORACLES["sanitised_documents"] = sanitised("doc_id", "text", "documents")
ORACLES["sanitised_pages"] = sanitised("page_id", "html", "pages")
ORACLES["formula_guard"] = (
    f"SELECT doc_id, {guarded('s')} AS guarded_text FROM (SELECT doc_id, "
    + squeezed("(['=', '+', '-', '@', ''])[doc_id % 5 + 1] || text")
    + " AS s FROM documents)"
)
SUBMISSIONS = (
    f"submissions AS (SELECT 'D' || doc_id AS message_id, {opener('doc_id')} || ' ' || text AS text, "
    "' Lang ' || lang || ' ' AS category, 1704067200 + 60 * doc_id AS seconds FROM documents UNION ALL "
    f"SELECT 'O' || o_orderkey, {opener('o_orderkey')} || ' call +60 12-' || (o_orderkey + 1000000) || ' or a@b.example', "
    "o_orderpriority, 1704067200 + o_orderkey FROM orders)"
)
ORACLES["mask_steps"] = with_(SUBMISSIONS) + (
    "SELECT message_id, md5(text) AS text_md5, md5(u) AS no_urls_md5, md5(e) AS no_emails_md5, "
    f"md5(regexp_replace(e, {MASK_NUMBER})) AS no_numbers_md5 FROM (SELECT *, regexp_replace(u, {MASK_EMAIL}) AS e "
    f"FROM (SELECT *, regexp_replace(text, {MASK_URL}) AS u FROM submissions))"
)


def report_key(text: str, category: str) -> str:
    return f"sha256((seconds * 1000000) || chr(31) || {category} || chr(31) || {text})"


def report_id(text: str, category: str) -> str:
    return f"'COM-' || strftime(to_timestamp(seconds) AT TIME ZONE 'UTC', '%Y%m%d%H%M%S') || '-' || upper(substr({report_key(text, category)}, 1, 6))"


def category(name: str) -> str:
    return f"coalesce(nullif(replace(lower(trim(coalesce({name}, ''))), ' ', '_'), ''), 'unspecified')"


PREPARED = (
    f"prepared AS (SELECT message_id, {report_id('text', 'category')} AS report_id, {report_key('text', 'category')} AS report_key, {category('category')} AS category, "
    f"{guarded('s')} AS sanitised_text, seconds, CASE WHEN length(text) < 1 THEN 'empty_text' "
    "WHEN length(text) > 10000 THEN 'too_long' WHEN s = '' THEN 'nothing_left' END AS reject_reason "
    f"FROM (SELECT *, {squeezed(masked('text'))} AS s FROM submissions))"
)
ORACLES["report_rows"] = with_(SUBMISSIONS, PREPARED) + (
    "SELECT message_id, report_id, category, sanitised_text, 'unverified' AS review_status, false AS allowed_for_decision, "
    "reject_reason FROM prepared"
)
LAST = "SELECT {by} count(*) AS record_count, max((seconds, report_id)) AS last FROM prepared WHERE reject_reason IS NULL"
ORACLES["report_counts"] = with_(SUBMISSIONS, PREPARED) + (
    "SELECT category, record_count, last[2] AS last_report_id, last[1] * 1000000 AS last_micros "
    f"FROM ({LAST.format(by='category,')} GROUP BY category)"
)
ORACLES["community_properties"] = with_(
    SUBMISSIONS,
    PREPARED,
    f"t AS ({LAST.format(by='')})",
    "fixed(property, value) AS (VALUES "
    + ", ".join(f"({lit(k)}, {lit(v)})" for k, v in rp.COMMUNITY_PROPERTIES.items())
    + ")",
) + (
    "SELECT property, value FROM fixed UNION ALL SELECT 'record_count', CAST(record_count AS VARCHAR) FROM t "
    "UNION ALL SELECT 'last_report_id', last[2] FROM t UNION ALL SELECT 'last_report_submitted_at', "
    "strftime(to_timestamp(last[1]) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%f+00:00') FROM t"
)
ORACLES["report_validation"] = (
    "SELECT doc_id, CASE WHEN text IS NULL OR length(text) < 1 THEN 'empty_text' WHEN length(text) > 10000 THEN 'too_long' "
    "WHEN length(coalesce(c, 'unspecified')) < 1 THEN 'empty_category' "
    "WHEN length(coalesce(c, 'unspecified')) > 50 THEN 'category_too_long' END AS reject_reason, "
    f"{category('c')} AS category FROM (SELECT doc_id, text, CASE WHEN doc_id % 9 = 4 THEN '' WHEN doc_id % 3 = 0 "
    "THEN repeat(source, 12) WHEN doc_id % 3 = 1 THEN source END AS c FROM documents)"
)
STREAMED = SUBMISSIONS.replace("submissions AS", "sent AS", 1) + (
    ", submissions AS (SELECT message_id, text, category, 1704067200 + (seconds - 1704067200) % 50 "
    "- CASE WHEN category = ' Lang fr ' THEN 94608000 ELSE 0 END AS seconds FROM sent)"
)
STORED = (
    f"SELECT DISTINCT report_key, report_id, category, sanitised_text, 'unverified' AS review_status{{more}} FROM prepared "
    "WHERE reject_reason IS NULL"
)
ORACLES["stream_rejected_messages"] = with_(MESSAGES) + (
    "SELECT message_id, CASE WHEN length(trim(text)) < 3 THEN 'too_short' ELSE 'too_long' END AS reject_reason FROM messages "
    "WHERE length(trim(text)) < 3 OR length(trim(text)) > 10000"
)
ORACLES["stream_reports"] = with_(STREAMED, PREPARED) + STORED.format(more="")
ORACLES["stream_rejected_reports"] = with_(STREAMED, PREPARED) + (
    "SELECT report_key, category, reject_reason FROM prepared WHERE reject_reason IS NOT NULL"
)
ORACLES["compacted_reports"] = with_(STREAMED, PREPARED) + (
    "SELECT DISTINCT report_key, report_id, category, sanitised_text, seconds * 1000000 AS micros, true AS fewer_files, "
    "(SELECT count(DISTINCT report_key) FROM prepared WHERE reject_reason IS NULL) AS total FROM prepared WHERE reject_reason IS NULL"
)
ORACLES["submitted_reports"] = with_(SUBMISSIONS, PREPARED) + STORED.replace("DISTINCT ", "").format(
    more=", false AS allowed_for_decision, true AS saved_locally, false AS writeback_available, "
    f"'Stored, but the source''s properties were not refreshed: offline' AS writeback_warning, {lit(rp.EXPLANATION)} AS explanation"
)
ORACLES["stored_report_properties"] = ORACLES["community_properties"]
ORACLES["stream_report_totals"] = with_(STREAMED, PREPARED) + (
    "SELECT category, count(*) AS record_count, max(seconds) * 1000000 AS last_micros FROM prepared "
    "WHERE reject_reason IS NULL GROUP BY category"
)

# Training sets


def uuid5(name: str) -> str:
    h = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({name}))"
    return (
        f"(SELECT substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' || "
        "substr('89ab', (strpos('0123456789abcdef', substr(h,17,1)) - 1) % 4 + 1, 1) || substr(h,18,3) || '-' || "
        f"substr(h,21,12) FROM (SELECT {h} AS h))"
    )


def labelled(kind: str, rank: int) -> str:
    return (
        f"SELECT {rank} AS source_rank, '{kind}-' || doc_id AS record_id, text, {kind} AS label, source, '{kind}' AS source_type, "
        "lang AS language, 'unreviewed' AS review_status, false AS is_synthetic, 'unknown' AS license, "
        "DATE '2026-07-10' AS created_at FROM documents JOIN labels USING (doc_id)"
    )


CURATED = (
    "SELECT 2, "
    + uuid5(f"'{curated.SOURCE_NAME}:' || i || ':' || label || ':' || text")
    + f", text, label, '{curated.SOURCE_NAME}', 'manually_curated_synthetic', 'ms', 'personally_reviewed', true, 'Apache-2.0', "
    f"DATE '{curated.CREATED_AT}' FROM (VALUES "
    + ", ".join(f"({i}, {label}, {lit(t)})" for i, (label, t) in enumerate(curated.MESSAGES))
    + ") v(i, label, text)"
)
COMBINED = [
    f"combined AS ({labelled('quality', 0)} UNION ALL {labelled('toxic', 1)} UNION ALL {CURATED})",
    f"checked AS (SELECT * EXCLUDE (text), {squeezed('text')} AS text, "
    f"replace(lower({squeezed('text')}), 'ß', 'ss') AS key FROM combined)",
    "valid AS (SELECT * FROM checked WHERE length(text) >= 3)",
]
KEPT = [
    *COMBINED,
    "conflicts AS (SELECT key, count(*) AS rows, sum(label) AS suspicious FROM valid GROUP BY key HAVING count(DISTINCT label) > 1)",
    "clean AS (SELECT * FROM valid WHERE key NOT IN (SELECT key FROM conflicts))",
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY key, label ORDER BY source_rank, record_id) AS nth FROM clean)",
    "kept AS (SELECT * FROM ranked WHERE nth = 1)",
]
ORACLES["union_labelled"] = (
    with_(*COMBINED) + "SELECT source_rank, record_id, label, source_type, md5(text) AS text_md5, md5(key) AS key_md5 FROM checked"
)
ORACLES["rejected_records"] = (
    "SELECT record_id, label, CASE WHEN label IS NULL THEN 'bad_label' WHEN length(text) < 3 THEN 'too_short' END AS reject_reason "
    "FROM (SELECT CAST(p_partkey AS VARCHAR) AS record_id, CASE WHEN p_size < 10 THEN CAST(p_size AS VARCHAR) ELSE p_name END AS text, "
    "CASE TRY_CAST((['1', '0', '1.0', '0.9', 'spam', '2', ''])[p_partkey % 7 + 1] AS DOUBLE) WHEN 0 THEN 0 WHEN 1 THEN 1 END AS label "
    "FROM part)"
)
ORACLES["conflicting_texts"] = (
    with_(*KEPT)
    + "SELECT sha256(key) AS text_digest, rows, CAST(suspicious AS BIGINT) AS suspicious_rows FROM conflicts"
)
ORACLES["dedup_documents"] = (
    f"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY replace(lower({squeezed('text')}), 'ß', 'ss')"
)
ORACLES["training_set"] = (
    with_(*KEPT) + "SELECT record_id, label, source, source_type, language, md5(text) AS text_md5 FROM kept"
)
ORACLES["shuffle_positions"] = (
    with_(*KEPT) + "SELECT record_id, row_number() OVER (ORDER BY sha256('42:' || record_id)) AS shuffle_position FROM kept"
)
RECORD = " || chr(31) || ".join(f"coalesce(CAST({c} AS VARCHAR), '\\N')" for c in LABELLED_COLUMNS)
LANES = [f"CAST(sum(CAST(('0x' || substr(h, {1 + 16 * i}, 16)) AS UBIGINT)::HUGEINT) AS VARCHAR)" for i in range(4)]
FINGERPRINT = (
    "fingerprint AS (SELECT n AS row_count, sha256(n || ':' || a || ':' || b || ':' || c || ':' || d) AS sha256 FROM ("
    f"SELECT count(*) AS n, {LANES[0]} AS a, {LANES[1]} AS b, {LANES[2]} AS c, {LANES[3]} AS d "
    f"FROM (SELECT sha256({RECORD}) AS h FROM kept)))"
)
ORACLES["dataset_fingerprint"] = (
    with_(*KEPT, FINGERPRINT)
    + "SELECT row_count, sha256, 'sha256:' || substr(sha256, 1, 16) AS dataset_version FROM fingerprint"
)
ORACLES["manifest_counts"] = with_(*KEPT) + (
    "SELECT 'row_count' AS metric, '' AS key, count(*) AS value FROM kept "
    "UNION ALL SELECT 'class_counts', CAST(label AS VARCHAR), count(*) FROM kept GROUP BY label "
    "UNION ALL SELECT 'source_counts', source, count(*) FROM kept GROUP BY source "
    "UNION ALL SELECT 'source_type_counts', source_type, count(*) FROM kept GROUP BY source_type "
    "UNION ALL SELECT 'conflicting_texts_removed', '', count(*) FROM conflicts "
    "UNION ALL SELECT 'duplicates_removed', '', (SELECT count(*) FROM clean) - (SELECT count(*) FROM kept)"
)


def json_counts(column: str) -> str:
    return (
        f"(SELECT '{{' || string_agg('\"' || k || '\":' || n, ',' ORDER BY k) || '}}' FROM "
        f"(SELECT CAST({column} AS VARCHAR) AS k, count(*) AS n FROM kept GROUP BY 1))"
    )


ORACLES["manifest"] = with_(*KEPT, FINGERPRINT) + (
    "SELECT 'sha256:' || substr(sha256, 1, 16) AS dataset_version, row_count, "
    f"{json_counts('label')} AS class_counts, {json_counts('source_type')} AS source_type_counts, "
    "(SELECT string_agg(source, ',' ORDER BY source) FROM (SELECT DISTINCT source FROM kept)) AS source_names, "
    "(SELECT count(*) FROM conflicts) AS conflicting_texts_removed, "
    "(SELECT count(*) FROM clean) - row_count AS duplicates_removed, 42 AS random_seed FROM fingerprint"
)

ORACLES["prepared_dataset"] = with_(*KEPT, FINGERPRINT) + (
    "SELECT 'sha256:' || substr(sha256, 1, 16) AS dataset_version, sha256, row_count, "
    f"{json_counts('label')} AS class_counts, {json_counts('source')} AS source_counts, {json_counts('source_type')} AS source_type_counts, "
    "(SELECT count(*) FROM conflicts) AS conflicting_texts_removed, (SELECT count(*) FROM clean) - row_count AS duplicates_removed, "
    "'quality,toxic,manual' AS input_files, 42 AS random_seed, '' AS built_again, row_count AS rows_written FROM fingerprint"
)
ORACLES["table_columns"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS rows, (SELECT CASE WHEN count(*) = 0 THEN 'complete' ELSE '{t} is missing columns: [' || "
    "string_agg(chr(39) || c || chr(39), ', ' ORDER BY c) || ']' END FROM (VALUES ('text'), ('lang'), ('role')) w(c) "
    f"WHERE c NOT IN (SELECT column_name FROM information_schema.columns WHERE table_name = '{t}')) AS verdict FROM {t}"
    for t in views.TEXT_TABLES
)
ORACLES["required_evidence"] = (
    "SELECT name, count(item_id) AS records, coalesce(sum(length(text)), 0)::BIGINT AS characters FROM (VALUES ('short'), ('long'), ('none')) k(name) "
    "LEFT JOIN benchmark ON (name = 'short' AND length(text) < 300) OR (name = 'long' AND length(text) >= 300) GROUP BY name"
)


def synthetic_messages() -> str:
    def pick(slot: str, size: int) -> str:
        return f"(CAST(('0x' || substr(md5('42:' || label || ':' || i || ':{slot}'), 1, 8)) AS BIGINT) % {size})"

    filled = "CASE WHEN label = 1 THEN " + " ELSE ".join(
        f"({listing(t for _, t in templates)})[i % 10 + 1]"
        for templates in (synthetic.SUSPICIOUS_TEMPLATES, synthetic.LEGITIMATE_TEMPLATES)
    ) + " END"
    language = "CASE WHEN label = 1 THEN " + " ELSE ".join(
        f"({listing(x for x, _ in templates)})[i % 10 + 1]"
        for templates in (synthetic.SUSPICIOUS_TEMPLATES, synthetic.LEGITIMATE_TEMPLATES)
    ) + " END"
    for slot, values in synthetic.SLOTS.items():
        filled = f"replace({filled}, '{{{slot}}}', ({listing(values)})[{pick(slot, len(values))} + 1])"
    return (
        with_(
            "rows AS (SELECT o_orderkey AS i, unnest([0, 1]) AS label FROM orders)",
            f"filled AS (SELECT i, label, {filled} AS f, {language} AS language FROM rows)",
            f"texts AS (SELECT i, label, language, CASE i % 3 WHEN 0 THEN f || ' Ref ' || ({pick('reference', 9000)} + 1000) "
            "WHEN 1 THEN replace(f, '.', '!') ELSE f END AS text FROM filled)",
        )
        + "SELECT "
        + uuid5("'42:' || label || ':' || i || ':' || text")
        + " AS record_id, text, label, language FROM texts"
    )


ORACLES["synthetic_messages"] = synthetic_messages()
ORACLES["ham_spam_records"] = (
    "SELECT " + uuid5("'uci-228:' || doc_id || ':' || text") + " AS record_id, 1 - quality AS label, "
    "'uci_sms_spam_collection_228' AS source, 'source_documented' AS review_status, "
    "'review_source_terms_before_redistribution' AS license, md5(text) AS text_md5 FROM documents JOIN labels USING (doc_id)"
)
ORACLES["unknown_labels"] = "SELECT role AS raw_label, count(*) AS rows FROM conversations GROUP BY role"
ORACLES["name_uuids"] = "SELECT p_partkey, " + uuid5("'part:' || p_partkey || ':' || p_name") + " AS record_id FROM part"
BLANK = "CASE WHEN s_suppkey % 2 = 0 THEN '   ' ELSE '  ' || s_name || ' ' END"
ORACLES["blank_values"] = (
    "SELECT s_suppkey, coalesce(nullif(trim(b), ''), s_name) AS first_value, lower(trim(b)) AS metadata_value, "
    f"replace(lower(trim(b || ' Level One')), ' ', '_') AS category FROM (SELECT s_suppkey, s_name, {BLANK} AS b FROM supplier)"
)

# Files

ORACLES["labelled_csv_rows"] = (
    "SELECT CAST(doc_id AS VARCHAR) AS record_id, md5(text) AS text_md5, CAST(doc_id % 2 AS VARCHAR) AS label, source, "
    "doc_id % 3 = 0 AS is_synthetic, 'free, with \"quotes\"' AS license, '2026-07-10' AS created_at FROM documents"
)
QUOTED = "'\"' || replace({0}, '\"', '\"\"') || '\"'"
ORACLES["labelled_csv_rejects"] = (
    "WITH lines AS (SELECT lang, doc_id || ',' || " + QUOTED.format("text") + " || ',' || doc_id % 2 || ',' || source || ',prose,' || lang "
    "|| ',unreviewed,' || CASE lang WHEN 'de' THEN 'perhaps' ELSE 'false' END || ',\"free, with \"\"quotes\"\"\",' "
    "|| CASE lang WHEN 'fr' THEN 'soon' ELSE '2026-07-10' END || CASE lang WHEN 'es' THEN ',more' ELSE '' END AS line FROM documents), "
    "told AS (SELECT CASE lang WHEN 'de' THEN 'bad_is_synthetic' WHEN 'fr' THEN 'bad_created_at' WHEN 'es' THEN 'number_of_fields' "
    "ELSE 'kept' END AS reason, false AS missing, CASE WHEN lang IN ('de', 'fr', 'es') THEN md5(line) ELSE '' END AS raw_md5 FROM lines "
    "UNION ALL SELECT 'missing_input', true, NULL) SELECT reason, missing, raw_md5, count(*) AS rows FROM told GROUP BY ALL"
)
ORACLES["evidence_csv_rows"] = (
    "SELECT CASE WHEN page_id % 3 < 2 THEN CAST(page_id AS VARCHAR) ELSE '' END AS report_id, md5(CASE WHEN page_id % 3 < 2 THEN html "
    "ELSE page_id || ',page,' || " + QUOTED.format("html") + " || ',unverified,ask' END) AS md5, page_id % 3 = 0 AS allowed_for_decision, "
    "CASE WHEN page_id % 3 < 2 THEN 'kept' ELSE 'bad_allowed_for_decision' END AS reason FROM pages"
)
ORACLES["ham_spam_file"] = (
    "WITH raw AS (SELECT doc_id % 2 AS label, text FROM documents UNION ALL SELECT 0, 'first' || chr(9) || 'line') SELECT "
    + uuid5("'uci-228:' || md5(text) || ':' || text")
    + " AS record_id, CAST(label AS INTEGER) AS label, md5(text) AS text_md5 FROM raw"
)
ORACLES["sample_message_files"] = (
    "SELECT CASE role WHEN 'user' THEN 'low_risk' WHEN 'assistant' THEN 'medium_risk' ELSE 'high_risk' END AS risk_band, "
    "CASE role WHEN 'system' THEN 'missing_text' ELSE md5(text) END AS text_md5, count(*) AS rows FROM conversations GROUP BY ALL"
)

# Classifier

ORACLES["char_tfidf"] = with_(
    f"turns AS ({CONVERSATION_MESSAGES})",
    f"padded AS (SELECT message_id, ' ' || {squeezed('lower(text)')} || ' ' AS p FROM turns)",
    "sizes(k) AS (VALUES (3), (4), (5))",
    "windows AS (SELECT message_id, k, p, unnest(range(1, length(p) - k + 2)) AS i FROM padded, sizes WHERE length(p) >= k)",
    "grams AS (SELECT message_id, substr(p, i, k) AS gram FROM windows WHERE NOT contains(substr(p, i + 1, k - 2), ' '))",
    "tf AS (SELECT message_id, gram, count(*) AS tf FROM grams GROUP BY ALL)",
    "n AS (SELECT count(*) AS n FROM turns)",
    "terms AS (SELECT gram, count(*) AS df, sum(tf) AS total FROM tf GROUP BY gram ORDER BY total DESC, gram LIMIT 60000)",
    "weights AS (SELECT message_id, gram, (1 + ln(tf)) * (ln((n + 1.0::DOUBLE) / (df + 1)) + 1) AS w FROM tf JOIN terms USING (gram), n)",
) + (
    "SELECT message_id, gram, round(w / sqrt(sum(w * w) OVER (PARTITION BY message_id)), 6) AS weight FROM weights"
)
ORACLES["training_sizes"] = with_(*KEPT) + (
    "SELECT source, count(*) AS rows, count(*) FILTER (label = 0) AS legitimate_rows, count(*) FILTER (label = 1) AS suspicious_rows, "
    "CASE WHEN count(*) < 40 THEN 'too_few_rows' WHEN count(DISTINCT label) < 2 THEN 'not_both_classes' ELSE 'usable' END AS verdict "
    "FROM kept GROUP BY source"
)
ORACLES["word_tfidf"] = with_(
    f"turns AS ({CONVERSATION_MESSAGES})",
    r"tokens AS (SELECT message_id, regexp_extract_all(strip_accents(lower(text)), '[\pL\pN_]{2,}') AS w FROM turns)",
    "pairs AS (SELECT message_id, unnest(w[:len(w)-1]) AS a, unnest(w[2:]) AS b FROM tokens)",
    "grams AS (SELECT message_id, unnest(w) AS gram FROM tokens UNION ALL SELECT message_id, a || ' ' || b FROM pairs)",
    "tf AS (SELECT message_id, gram, count(*) AS tf FROM grams GROUP BY ALL)",
    "n AS (SELECT count(*) AS n FROM turns)",
    "terms AS (SELECT gram, count(*) AS df, sum(tf) AS total FROM tf GROUP BY gram HAVING count(*) <= (SELECT n FROM n) * 0.995 "
    "ORDER BY total DESC, gram LIMIT 50000)",
    "weights AS (SELECT message_id, gram, (1 + ln(tf)) * (ln((n + 1.0::DOUBLE) / (df + 1)) + 1) AS w FROM tf JOIN terms USING (gram), n)",
) + (
    "SELECT message_id, gram, round(w / sqrt(sum(w * w) OVER (PARTITION BY message_id)), 6) AS weight FROM weights"
)


def feature_ctes(words: int, characters: int) -> list[str]:
    """Both blocks of TF-IDF weights over all messages, in long form."""

    def top(block: str, most: int, most_df: str) -> str:
        return (
            f"SELECT block, gram, df, ln((n + 1.0::DOUBLE) / (df + 1)) + 1 AS idf FROM counted, n WHERE block = '{block}' AND df <= {most_df} "
            f"QUALIFY row_number() OVER (ORDER BY total DESC, gram) <= {most}"
        )

    return [
        MESSAGES,
        r"tokens AS (SELECT message_id, regexp_extract_all(strip_accents(lower(text)), '[\pL\pN_]{2,}') AS w FROM messages)",
        "pairs AS (SELECT message_id, unnest(w[:len(w)-1]) AS a, unnest(w[2:]) AS b FROM tokens)",
        r"spaced AS (SELECT message_id, w, count(*) AS c FROM (SELECT message_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS w "
        "FROM messages) WHERE w <> '' GROUP BY ALL)",
        "sized AS (SELECT w, ' ' || w || ' ' AS p, unnest([3, 4, 5]) AS k FROM (SELECT DISTINCT w FROM spaced))",
        "windows AS (SELECT w, substr(p, CAST(unnest(range(1, length(p) - k + 2)) AS BIGINT), k) AS gram FROM sized WHERE length(p) >= k)",
        "grams AS (SELECT message_id, 'word' AS block, unnest(w) AS gram, 1 AS c FROM tokens "
        "UNION ALL SELECT message_id, 'word', a || ' ' || b, 1 FROM pairs "
        "UNION ALL SELECT message_id, 'char', gram, c FROM spaced JOIN windows USING (w))",
        "tf AS (SELECT message_id, block, gram, sum(c) AS tf FROM grams GROUP BY ALL)",
        "n AS (SELECT count(*) AS n FROM messages)",
        "counted AS (SELECT block, gram, count(*) AS df, sum(tf) AS total FROM tf GROUP BY ALL)",
        f"known AS ({top('word', words, 'n * 0.995::DOUBLE')} UNION ALL {top('char', characters, 'n')})",
        "raw AS (SELECT message_id, block, gram, (1 + ln(tf)) * idf AS w FROM tf JOIN known USING (block, gram))",
        "weights AS (SELECT message_id, block, gram, w / sqrt(sum(w * w) OVER (PARTITION BY message_id, block)) AS weight FROM raw)",
    ]


ORACLES["feature_vocabulary"] = with_(*feature_ctes(50_000, 60_000)) + "SELECT block, gram, df, round(idf, 6) AS idf FROM known"
GIVEN = "(CAST('0x' || substr(md5(gram), 1, 4) AS BIGINT) % 2001 - 1000) / 500.0::DOUBLE"
ORACLES["feature_vectors"] = with_(*feature_ctes(50_000, 60_000)) + (
    "SELECT message_id, block, count(*) AS entries, round(sum(weight), 6) AS weight, "
    f"round(sum(weight * {GIVEN}), 6) AS by_gram FROM weights WHERE weight <> 0 GROUP BY ALL"
)
ORACLES["linear_scores"] = with_(
    *feature_ctes(50_000, 60_000),
    f"given AS (SELECT block, gram, {GIVEN} AS c FROM known)",
    "sums AS (SELECT message_id, 0.25::DOUBLE + coalesce(sum(weight * c), 0) AS z FROM messages LEFT JOIN weights USING (message_id) "
    "LEFT JOIN given USING (block, gram) GROUP BY message_id)",
    "scored AS (SELECT message_id, 1 / (1 + exp(-z)) AS p FROM sums)",
) + (
    "SELECT message_id, CASE WHEN p >= 0.5 THEN 'suspicious' ELSE 'legitimate' END AS predicted_label, "
    "round(p, 4) AS suspicious_probability, round(greatest(p, 1 - p), 4) AS confidence, "
    "CASE WHEN p >= 0.9 THEN 30 WHEN p >= 0.75 THEN 20 WHEN p >= 0.55 THEN 10 ELSE 0 END AS score_contribution FROM scored"
)


def logistic_weights(words: int, characters: int) -> str:
    """The minimum of the objective by accelerated gradient steps: one step per level of the recursion."""
    size = words + characters + 1
    ones = ", ".join(["0.0::DOUBLE"] * size)
    slopes = ", ".join(f"sum(share * (1 / (1 + exp(-list_dot_product(z, x))) - label) * x[{i}])" for i in range(1, size + 1))
    return "WITH RECURSIVE " + ",\n".join(
        [
            *feature_ctes(words, characters),
            f"numbered AS (SELECT *, row_number() OVER (ORDER BY block DESC, gram) AS j FROM known)",
            "classes AS (SELECT label, n / (2.0::DOUBLE * count(*)) AS class_weight FROM messages, n GROUP BY label, n)",
            "entries AS (SELECT message_id, j, weight FROM weights JOIN numbered USING (block, gram))",
            f"maps AS (SELECT message_id, map_from_entries(list((j, weight))) AS m FROM entries GROUP BY message_id)",
            f"vectors AS (SELECT label, list_transform(range(1, {size + 1}), lambda j: CASE WHEN j = {size} THEN 1.0::DOUBLE "
            "ELSE coalesce(m[j], 0.0::DOUBLE) END) AS x FROM messages LEFT JOIN maps USING (message_id))",
            "groups AS MATERIALIZED (SELECT label, x, count(*) * any_value(class_weight) / any_value(n) AS share FROM vectors JOIN classes USING (label), n "
            "GROUP BY label, x)",
            "rates AS MATERIALIZED (SELECT 1 / (2.0::DOUBLE * n) AS penalty, 1 / (0.75 + 1 / (2.0::DOUBLE * n)) AS step, "
            "sqrt((1 / (2.0::DOUBLE * n)) / (0.75 + 1 / (2.0::DOUBLE * n))) AS root FROM n)",
            f"fit AS (SELECT 0 AS k, [{ones}] AS w, [{ones}] AS z UNION ALL "
            "SELECT k + 1, after, list_transform(list_zip(after, w), lambda e: e[1] + (1 - root) / (1 + root) * (e[1] - e[2])) FROM ("
            f"SELECT k, w, root, list_transform(range(1, {size + 1}), lambda j: z[j] - step * (g[j] + CASE WHEN j < {size} THEN penalty * z[j] ELSE 0 END)) AS after "
            f"FROM (SELECT k, any_value(w) AS w, any_value(z) AS z, [{slopes}] AS g FROM fit, groups WHERE k < 4000 GROUP BY k), rates))",
            "last AS (SELECT w FROM fit ORDER BY k DESC LIMIT 1)",
        ]
    ) + (
        "\nSELECT block, gram, round(w[j], 3) AS coefficient FROM numbered, last "
        f"UNION ALL SELECT 'intercept', '', round(w[{size}], 3) FROM last"
    )


ORACLES["logistic_weights"] = logistic_weights(6, 4)
ORACLES["char_grams"] = with_(
    MESSAGES,
    "items AS (SELECT text FROM benchmark UNION ALL SELECT text FROM messages)",
    r"words AS (SELECT ' ' || w || ' ' AS w FROM (SELECT unnest(regexp_split_to_array(lower(text), '\s+')) AS w FROM items) WHERE w <> '')",
    "counted AS (SELECT w, count(*) AS c FROM words GROUP BY w)",
    "sized AS (SELECT w, c, unnest([3, 4, 5]) AS k FROM counted)",
    "windows AS (SELECT substr(w, CAST(unnest(range(1, length(w) - k + 2)) AS BIGINT), k) AS gram, c FROM sized WHERE length(w) >= k)",
) + "SELECT gram, CAST(sum(c) AS BIGINT) AS occurrences FROM windows GROUP BY gram"

SPLIT = [
    MESSAGES,
    "sizes AS (SELECT label, count(*) AS c, sum(count(*)) OVER () AS n FROM messages GROUP BY label)",
    "shares AS (SELECT label, c, n - ceil(n * 0.2::DOUBLE) AS tr, c * (n - ceil(n * 0.2::DOUBLE)) / n AS s FROM sizes)",
    "quotas AS (SELECT label, c - floor(s) - CASE WHEN row_number() OVER (ORDER BY s - floor(s) DESC, label) "
    "<= tr - sum(floor(s)) OVER () THEN 1 ELSE 0 END AS test_rows FROM shares)",
]
ORACLES["stratified_split_rows"] = with_(*SPLIT) + (
    "SELECT message_id, label, CASE WHEN nth <= test_rows THEN 'test' ELSE 'train' END AS split FROM (SELECT *, "
    "row_number() OVER (PARTITION BY label ORDER BY sha256('42:' || message_id)) AS nth FROM messages) JOIN quotas USING (label)"
)
PREDICTIONS = [
    *scoring_ctes(),
    "predictions AS (SELECT label, rule_score, CASE WHEN rule_score >= 20 THEN 1 ELSE 0 END AS predicted FROM scored)",
    "c AS (SELECT count(*) FILTER (label = 0 AND predicted = 0) AS tn, count(*) FILTER (label = 0 AND predicted = 1) AS fp, "
    "count(*) FILTER (label = 1 AND predicted = 0) AS fn, count(*) FILTER (label = 1 AND predicted = 1) AS tp FROM predictions)",
    "m AS (SELECT *, tn + fp + fn + tp AS n, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS p1, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS r1, "
    "coalesce(tn / nullif(tn + fn, 0)::DOUBLE, 0) AS p0, coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0) AS r0 FROM c)",
    "f AS (SELECT *, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS f1, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS f0, "
    "tn + fp AS s0, tp + fn AS s1 FROM m)",
]
HOLD_OUT = [
    MESSAGES,
    "sizes AS (SELECT count(*) AS n, ceil(count(*) * 0.2::DOUBLE)::BIGINT AS test_rows FROM messages)",
]
ORACLES["model_status"] = with_(*HOLD_OUT) + (
    f"SELECT case_name, good AS available, CASE WHEN good THEN {lit(cl.MODEL_VERSION)} END AS model_version, "
    "CASE WHEN good THEN 'all-messages' END AS dataset_version, CASE WHEN good THEN n - test_rows END AS training_rows, good AS dated, "
    "case_name = 'unreadable' AS unable, CASE WHEN good THEN n ELSE 0 END AS alike FROM sizes, "
    "(VALUES ('available', true), ('fallback', true), ('missing', false), ('unreadable', false)) k(case_name, good)"
)
CARD = catalog.CardTexts()
ORACLES["model_metadata"] = with_(*HOLD_OUT) + (
    f"SELECT {lit(CARD.name)} AS name, {lit(CARD.task)} AS task, {lit(CARD.input_type)} AS input_type, {lit(CARD.lifecycle)} AS lifecycle, "
    f"{lit(cl.MODEL_VERSION)} AS model_version, 'all-messages' AS dataset_version, n - test_rows AS training_rows, test_rows, "
    "1 AS positive_label, 'suspicious' AS positive_label_name, 'C=2.0;character_ngram_range=3-5;class_weight=balanced;"
    "classifier=LogisticRegression;max_iter=2000;random_seed=42;test_size=0.2;word_ngram_range=1-2' AS hyper_params, "
    "'accuracy,f1_suspicious,precision_suspicious,recall_suspicious,roc_auc' AS metrics, "
    f"{lit('|'.join(CARD.primary_uses))} AS primary_uses, {lit('|'.join(CARD.out_of_scope_uses))} AS out_of_scope_uses, "
    f"{lit(' | '.join(cl.LIMITATIONS))} AS limitations, test_rows AS confusion_total FROM sizes"
)
ORACLES["confusion_matrix"] = with_(*PREDICTIONS) + (
    "SELECT 0 AS actual, 0 AS predicted, tn AS messages FROM c UNION ALL SELECT 0, 1, fp FROM c "
    "UNION ALL SELECT 1, 0, fn FROM c UNION ALL SELECT 1, 1, tp FROM c"
)
ORACLES["binary_metrics"] = with_(*PREDICTIONS) + (
    "SELECT n AS test_rows, round((tp + tn) / n::DOUBLE, 6) AS accuracy, round(p1, 6) AS precision_suspicious, "
    "round(r1, 6) AS recall_suspicious, round(f1, 6) AS f1_suspicious FROM f"
)
ORACLES["metric_strings"] = with_(*PREDICTIONS) + (
    "SELECT metric, printf('%.6f', value) AS value FROM (SELECT unnest(['accuracy', 'precision_suspicious', "
    "'recall_suspicious', 'f1_suspicious']) AS metric, unnest([(tp + tn) / n::DOUBLE, p1, r1, f1]) AS value FROM f)"
)
ORACLES["classification_report"] = with_(*PREDICTIONS) + (
    "SELECT 'legitimate' AS class_name, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1_score, s0 AS support FROM f "
    "UNION ALL SELECT 'suspicious', round(p1, 6), round(r1, 6), round(f1, 6), s1 FROM f "
    "UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), n FROM f "
    "UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / n, 6), round((r0 * s0 + r1 * s1) / n, 6), "
    "round((f0 * s0 + f1 * s1) / n, 6), n FROM f"
)
ORACLES["roc_auc"] = with_(
    *PREDICTIONS,
    "ranks AS (SELECT label, rank() OVER (ORDER BY rule_score) + (count(*) OVER (PARTITION BY rule_score) - 1) / 2.0::DOUBLE AS r FROM predictions)",
) + (
    "SELECT round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0::DOUBLE) / "
    "(count(*) FILTER (label = 1) * count(*) FILTER (label = 0))::DOUBLE, 6) AS roc_auc FROM ranks"
)
ML_CTES = scoring_ctes("order_messages")
ORACLES["ml_bands"] = with_(
    f"order_messages AS ({ORDER_MESSAGES})",
    *ML_CTES[1:],
    "probabilities AS (SELECT 'O' || o_orderkey AS message_id, (o_orderkey * 7919 % 10007) / 10007.0::DOUBLE AS p FROM orders)",
    "ml AS (SELECT *, CASE WHEN p >= 0.9 THEN 30 WHEN p >= 0.75 THEN 20 WHEN p >= 0.55 THEN 10 ELSE 0 END AS ml FROM scored JOIN probabilities USING (message_id))",
    "risk AS (SELECT *, least(rule_score + ml, 100) AS risk FROM ml)",
) + (
    "SELECT message_id, CASE WHEN p >= 0.5 THEN 'suspicious' ELSE 'legitimate' END AS predicted_label, "
    "round(p, 4) AS suspicious_probability, round(greatest(p, 1 - p), 4) AS confidence, ml AS score_contribution, rule_score, "
    f"risk AS risk_score, {level('risk')} AS risk_level, {summary('risk', 'ml')} AS summary FROM risk"
)
ORACLES["model_unavailable"] = with_(MESSAGES) + (
    "SELECT message_id, false AS available, 'unavailable' AS predicted_label, 0 AS score_contribution, "
    f"{lit(NOT_LOADED)} AS explanation FROM messages"
)

# Evidence and catalogue


def choice(name: str) -> str:
    divisor, values = views.PROPERTY_VALUES[name]
    return f"lower(trim(({listing(values)})[(c_custkey // {divisor}) % {len(values)} + 1]))"


def decisions() -> list[str]:
    r = {k: lit(v) for k, v in ev.REASONS.items()}
    properties = ", ".join(f"{choice(k)} AS {k}" for k in views.PROPERTY_VALUES)
    return [
        f"sources AS (SELECT 'urn:source:' || c_custkey AS urn, c_name AS name, c_nationkey AS nation_key, {properties} FROM customer)",
        "branches AS (SELECT *, CASE WHEN allowed_for_decision IN ('false', 'no', '0', 'blocked') THEN 1 "
        "WHEN review_status <> 'reviewed' THEN 2 WHEN freshness_status = 'stale' THEN 3 "
        "WHEN allowed_for_decision = 'supporting_only' OR source_classification = 'synthetic' THEN 4 "
        "WHEN source_classification IN ('official', 'official_style_guidance') THEN 5 "
        "WHEN source_classification IN ('public', 'demonstration', 'community') THEN 6 ELSE 7 END AS b FROM sources)",
        "decisions AS (SELECT nation_key, name, urn, source_classification, review_status, freshness_status, "
        "coalesce(nullif(reliability_level, ''), 'unknown') AS reliability, "
        "coalesce(nullif(evidence_role, ''), 'unknown') AS configured_evidence_role, "
        "CASE WHEN b IN (4, 5, 6) THEN 'selected' ELSE 'excluded' END AS decision, "
        "CASE b WHEN 4 THEN 'supporting_only' WHEN 5 THEN 'primary' WHEN 6 THEN 'supporting' ELSE 'excluded' END AS role, "
        f"CASE b WHEN 1 THEN {r['blocked']} WHEN 2 THEN {r['unreviewed']} WHEN 3 THEN {r['stale']} WHEN 4 THEN {r['synthetic']} "
        f"WHEN 5 THEN {r['official']} WHEN 6 THEN {r['supporting']} ELSE {r['unknown']} END AS reason FROM branches)",
    ]


ORACLES["evidence_decisions"] = with_(*decisions()) + "SELECT * EXCLUDE (nation_key) FROM decisions"
OWN = "lower(trim(CASE c_nationkey % 3 WHEN 0 THEN upper(c_mktsegment) WHEN 1 THEN ' ' ELSE NULL END))"
ORACLES["property_lookup"] = (
    "SELECT case_name, 'urn:source:' || c_custkey AS urn, CASE case_name WHEN 'map' THEN {0} WHEN 'second_spelling' THEN {0} "
    "WHEN 'own_column' THEN coalesce({1}, {0}) ELSE '' END AS value FROM customer, "
    "(VALUES ('map'), ('second_spelling'), ('own_column'), ('missing'), ('nowhere')) k(case_name)"
).format(choice("review_status"), OWN)
ORACLES["evidence_summary"] = with_(*decisions()) + (
    "SELECT *, 'Selected ' || selected_sources || ' evidence source(s): ' || primary_sources || ' primary and ' || "
    "supporting_sources || ' supporting. Excluded ' || excluded_sources || ' source(s) because they did not satisfy the trust policy.' "
    "AS provenance_summary FROM (SELECT nation_key, count(*) FILTER (decision = 'selected') AS selected_sources, "
    "count(*) FILTER (role = 'primary') AS primary_sources, count(*) FILTER (role IN ('supporting', 'supporting_only')) AS supporting_sources, "
    "count(*) FILTER (decision = 'excluded') AS excluded_sources FROM decisions GROUP BY nation_key)"
)
PAIR = "'review_status=' || event_type || ';value=' || CAST(trunc(value) AS BIGINT)"
ORACLES["entity_sources"] = (
    "SELECT event_id, 'e' || event_id AS urn, CASE event_id % 4 WHEN 1 THEN 'inner' ELSE 'e' || event_id END AS name, "
    "CASE event_id % 4 WHEN 2 THEN 'd' ELSE '' END AS description, "
    f"CASE event_id % 4 WHEN 0 THEN {PAIR} WHEN 1 THEN 'evidence_role=r;review_status=' || event_type WHEN 2 THEN {PAIR} ELSE '' END "
    "AS properties FROM events"
)
ORACLES["missing_trust_keys"] = (
    "SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'allowed_for_decision, freshness_status, reliability_level, source_classification' "
    "WHEN 3 THEN 'allowed_for_decision, evidence_role, freshness_status, reliability_level, review_status, source_classification' "
    "ELSE 'allowed_for_decision, evidence_role, freshness_status, reliability_level, source_classification' END AS missing FROM events"
)
ORACLES["missing_assets"] = (
    "SELECT CAST(ordinal AS INTEGER) AS ordinal, 'urn:source:' || k AS urn FROM (VALUES (0, 0), (1, 7), (2, 10000000), (3, 3), (4, 99999999)) "
    "r(ordinal, k) WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = k)"
)


def registry() -> str:
    tables = {"benchmark": 2, "pages": 3, "conversations": 4, "documents": 5}
    parts = []
    for (asset, name, _, trust, is_synthetic, place), (table, columns) in zip(
        evidence_registry.REGISTERED, tables.items(), strict=True
    ):
        properties = dict(zip(ev.TRUST_PROPERTIES, trust, strict=True))
        properties |= {
            "synthetic": is_synthetic,
            "contains_personal_data": "false",
            "jurisdiction": place,
            "column_count": str(columns),
        }
        urn = lit(evidence_registry.asset_urn(asset))
        values = ", ".join(f"({lit(k)}, {lit(v)})" for k, v in properties.items())
        parts.append(f"SELECT {urn} AS urn, {lit(name)} AS name, property, value FROM (VALUES {values}) v(property, value)")
        parts.append(f"SELECT {urn}, {lit(name)}, 'record_count', CAST(count(*) AS VARCHAR) FROM {table}")
    return " UNION ALL ".join(parts)


ORACLES["registered_sources"] = registry()
# Decisions on the registered sources, from their trust values: approved ones of a known role are used.
EVIDENCE = ", ".join(
    f"({i}, {lit(name)}, {lit(trust[1])}, {lit(trust[2])}, {lit(trust[4])}, {lit(trust[5])})"
    for i, (_, name, _, trust, _, _) in enumerate(evidence_registry.REGISTERED)
)
BUNDLE = (
    f", sources(i, name, review, freshness, allowed, role) AS (VALUES {EVIDENCE}), judged AS (SELECT *, review = 'reviewed' AND "
    "freshness = 'current' AND allowed IN ('true', 'supporting_only') AS good FROM sources), bundle AS (SELECT count(*) FILTER (good) "
    "AS selected, count(*) FILTER (good AND role = 'primary') AS main, count(*) FILTER (NOT good) AS excluded, "
    "min_by(name, i) FILTER (NOT good) AS first_excluded FROM judged), told AS (SELECT *, 'Selected ' || selected || "
    "' evidence source(s): ' || main || ' primary and ' || (selected - main) || ' supporting. Excluded ' || excluded || "
    "' source(s) because they did not satisfy the trust policy.' AS sentence FROM bundle)"
)
ORACLES["assessment_with_context"] = SCORED + BUNDLE + (
    " SELECT message_id, rule_score AS risk_score, true AS context_available, 'agent_context_kit' AS integration_mode, selected, "
    "first_excluded, sentence AS provenance_summary, CAST(NULL AS VARCHAR) AS context_warning FROM scored, told"
)
ORACLES["context_resolution"] = SCORED + BUNDLE + (
    " SELECT case_name, message_id, rule_score AS risk_score, case_name <> 'neither' AS context_available, mode AS integration_mode, "
    "CASE WHEN case_name = 'neither' THEN 0 ELSE selected END AS selected, CASE WHEN case_name = 'neither' THEN "
    f"{lit(ev.COULD_NOT_CHECK)} ELSE sentence END AS provenance_summary, warning AS context_warning FROM scored, told, (VALUES "
    "('first', 'agent_context_kit', NULL), ('fallback', 'python_sdk_fallback', 'The first evidence provider failed, so the fallback "
    f"was used: Entity ' || {lit(evidence_registry.required_urns()[0])} || ' is missing trust properties: evidence_role'), "
    "('neither', 'unavailable', 'Both evidence providers failed: offline')) c(case_name, mode, warning)"
)
ORACLES["catalog_search"] = (
    "SELECT name, description FROM (SELECT p_name || ' ' || lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS name, "
    "p_brand || ' ' || p_type AS description FROM part) WHERE contains(lower(name || ' ' || description), 'brand#1') "
    "ORDER BY name LIMIT 20"
)
PROFILES = {
    "customer": "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment",
    "documents": "doc_id, text, lang, source, n_chars",
    "events": "event_id, ts, user_id, event_type, value, props",
    "labels": "doc_id, quality, toxic",
    "lineitem": "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, "
    "l_linestatus, l_shipdate",
    "orders": "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority",
    "pages": "page_id, url, html",
    "part": "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice",
}
ORACLES["dataset_profiles"] = " UNION ALL ".join(
    f"SELECT '{t}' AS name, count(*) AS row_count, {len(c.split(','))}::BIGINT AS column_count, '{c}' AS columns, "
    f"'PARQUET' AS file_format FROM {t}"
    for t, c in PROFILES.items()
)
ORACLES["written_profiles"] = " UNION ALL ".join(
    f"SELECT {lit(t)} AS name, count(*) AS row_count, {PROFILES[t].count(',') + 1}::BIGINT AS column_count, {lit(PROFILES[t])} AS columns, "
    f"true AS modified_in_run FROM {t}"
    for t in ("customer", "documents", "labels", "orders")
)
ORACLES["dataset_tags"] = (
    with_("tags(tag, display_name, description) AS (VALUES " + ", ".join(f"({lit(k)}, {lit(a)}, {lit(b)})" for k, (a, b) in TAGS.items()) + ")")
    + "SELECT dataset, tag, display_name, description FROM (SELECT 'part.' || p_partkey AS dataset, unnest(["
    "CASE WHEN p_size < 25 THEN 'synthetic' ELSE 'public-data' END, "
    "CASE WHEN p_type = 'ECONOMY' THEN 'training-input' ELSE lower(p_type) END]) AS tag FROM part UNION ALL "
    "SELECT d, unnest(t) FROM (VALUES "
    + ", ".join(f"({lit(name)}, {listing(tags)})" for name, tags in DATASET_TAGS.items())
    + ") seed(d, t)) JOIN tags USING (tag)"
)
ORACLES["lineage_edges"] = (
    "SELECT DISTINCT 'raw.' || source AS upstream, 'processed.training_dataset' AS downstream FROM documents "
    "WHERE source IN (SELECT source FROM documents JOIN labels USING (doc_id))"
)
