"""The warning rules: fixed wording, points and patterns, and the catalogue built from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cautela.functions.regexes import OTHER_CASES, required_literals, whole_words


@dataclass(frozen=True)
class Rule:
    code: str
    title: str
    category: str
    points: int
    explanation: str


@dataclass(frozen=True)
class TextRule(Rule):
    """Fires on the first whole-word match of one of the alternatives, in any letter case."""

    alternatives: tuple[str, ...]

    def first_match(self, text: Column) -> Column:
        return F.regexp_extract(text, whole_words(self.alternatives), 0)

    def needed(self) -> str | None:
        """A pattern without look-around that finds the plain parts of one alternative at least in every text that matches."""
        parts = [required_literals(a) for a in self.alternatives]
        if not all(parts):
            return None
        spelt = ["(?s:.*)".join(literals).replace("i", f"[i{OTHER_CASES['i']}]") for literals in parts]
        return "(?i)" + ("|".join(dict.fromkeys(spelt)) or "[^\\s\\S]")


@dataclass(frozen=True)
class LinkRule(Rule):
    """Fires on the first URL that has (or lacks) a flag; without a flag on any URL."""

    flag: str | None = None
    flag_value: bool = True

    def first_match(self, urls: Column) -> Column:
        if self.flag is None:
            hits = urls
        elif self.flag_value:
            hits = F.filter(urls, lambda u: u[self.flag])
        else:
            hits = F.filter(urls, lambda u: ~u[self.flag])
        return F.get(hits, 0)["original"]


# Results are only comparable if codes, points and patterns stay as they are.
TEXT_RULES: tuple[TextRule, ...] = (
    TextRule(
        "urgent_pressure",
        "Urgent pressure",
        "pressure",
        12,
        "The message pressures the recipient to act quickly before verifying it.",
        (
            "urgent",
            "immediately",
            "act now",
            "right now",
            "final warning",
            "last chance",
            r"within\s+\d+\s*(?:minutes?|hours?)",
            "before it is too late",
            "bertindak segera",
            "tindakan segera",
            "sahkan segera",
            "sekarang juga",
        ),
    ),
    TextRule(
        "threatened_consequence",
        "Threatened consequence",
        "pressure",
        16,
        "The message threatens account, service, legal, or delivery consequences.",
        (
            "account (?:will be )?(?:blocked|closed|suspended|frozen)",
            "service (?:will be )?(?:terminated|disconnected)",
            "legal action",
            "delivery (?:will be )?(?:cancelled|canceled)",
            "police action",
            "akaun(?: anda)? (?:akan )?(?:dibekukan|disekat)",
            "pakej(?: anda)? (?:akan )?ditahan",
            "tindakan undang-undang",
            "waran tangkap",
        ),
    ),
    TextRule(
        "payment_request",
        "Payment or transfer request",
        "financial",
        18,
        "The message requests money, a fee, a deposit, or a bank transfer.",
        (
            "pay(?:ment)?",
            "transfer",
            "bank in",
            "deposit",
            "processing fee",
            "release fee",
            "delivery fee",
            "admin fee",
            "send money",
            "duitnow",
            "bayar sekarang",
            "buat pemindahan",
            "pindahkan wang",
            "yuran pelepasan",
            r"rm\s?\d+(?:[.,]\d{1,2})?",
        ),
    ),
    TextRule(
        "credential_request",
        "Sensitive credential request",
        "credentials",
        28,
        "The message asks for credentials or security codes that should not be shared.",
        (
            "otp",
            "tac",
            "one[- ]time password",
            "password",
            "passcode",
            "pin number",
            "verification code",
            "login details",
            "security answer",
        ),
    ),
    TextRule(
        "impersonation_claim",
        "Organisation or authority impersonation",
        "impersonation",
        10,
        "The sender claims to represent a bank, authority, courier, or platform.",
        (
            "bank negara",
            "lhdn",
            "polis",
            "police",
            "court",
            "customs",
            "immigration",
            "bank officer",
            "customer service",
            "courier",
            "parcel service",
            "shopee",
            "lazada",
        ),
    ),
    TextRule(
        "unexpected_reward",
        "Unexpected reward or refund",
        "reward",
        14,
        "Unexpected rewards and refunds can be used to attract clicks or payments.",
        (
            "you (?:have )?won",
            "winner",
            "claim (?:your )?(?:prize|reward)",
            "cash prize",
            "free gift",
            "unexpected refund",
            "rebate approved",
        ),
    ),
    TextRule(
        "secrecy_request",
        "Request for secrecy",
        "secrecy",
        14,
        "The sender discourages the recipient from checking with other people.",
        (
            "do not tell",
            "don't tell",
            "keep this secret",
            "confidential transaction",
            "do not contact the bank",
            "do not inform anyone",
        ),
    ),
    TextRule(
        "remote_access_request",
        "Remote-access software request",
        "remote_access",
        30,
        "The message asks the recipient to install or use remote-access software.",
        (
            "anydesk",
            "teamviewer",
            "remote desktop",
            "screen sharing",
            "install this app to assist",
            "remote access",
        ),
    ),
)

LINK_RULES: tuple[LinkRule, ...] = (
    LinkRule(
        "contains_link",
        "Message contains a link",
        "link",
        6,
        "Unsolicited links should be verified before opening.",
    ),
    LinkRule(
        "ip_address_link",
        "Link uses an IP address",
        "link",
        20,
        "A raw IP address hides the normal website name and requires extra caution.",
        "is_ip_address",
    ),
    LinkRule(
        "punycode_link",
        "Link uses an internationalised punycode domain",
        "link",
        18,
        "Punycode can be legitimate but may also disguise a look-alike domain.",
        "uses_punycode",
    ),
    LinkRule(
        "shortened_link",
        "Shortened link",
        "link",
        12,
        "A link shortener hides the final destination until the link is resolved.",
        "is_known_shortener",
    ),
    LinkRule(
        "non_https_link",
        "Link does not use HTTPS",
        "link",
        7,
        "The link uses unencrypted HTTP and should not be used for sensitive actions.",
        "uses_https",
        False,
    ),
    LinkRule(
        "watchlist_tld",
        "Link uses a domain ending that needs closer verification",
        "link",
        6,
        "The domain ending is not proof of fraud, but deserves closer inspection.",
        "has_suspicious_tld",
    ),
)


def may_match(text: Column, rules: tuple[TextRule, ...] = TEXT_RULES) -> Column:
    """For each rule whether its pattern has to run: Arrow's linear-time search for plain parts, batch by batch."""
    patterns = [rule.needed() for rule in rules]

    @F.arrow_udf("array<boolean>")
    def found(texts):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        hits = np.ones((len(texts), len(patterns)), bool)
        for i, pattern in enumerate(patterns):
            if pattern is not None:
                hits[:, i] = pc.fill_null(pc.match_substring_regex(texts, pattern), False).to_numpy(zero_copy_only=False)
        starts = np.arange(len(texts) + 1, dtype=np.int32) * len(patterns)
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(hits.ravel()))

    return found(text)


def rule_catalogue(spark: SparkSession, rules: tuple[TextRule, ...] = TEXT_RULES) -> DataFrame:
    """What a reader may know about each text rule; the patterns stay private."""
    return spark.createDataFrame(
        [(r.code, r.title, r.category, r.points, r.explanation) for r in rules],
        "code string, title string, category string, severity_points int, explanation string",
    )
