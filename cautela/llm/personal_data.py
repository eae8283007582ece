"""Personal data by weak supervision (operator 4), in DataFrame operations only.

Base spans come from four fixed patterns with their checks. Further candidates - numbers that run into others, spelled-out
addresses, secrets - come from one wider pattern. Four labelers vote on every candidate: the strict check (``regex``),
word and prefix lists (``gazetteer``), what stands around it (``context``) and its form (``shape``). The votes of the whole
corpus are counted by pattern - a table whose size depends on the number of labelers, not of documents -, expectation-
maximisation estimates each labeler's reliability from the counts, and a logistic span classifier is trained on the
posteriors. Candidates that it accepts are added to the base spans, which always stay.

A null text is empty and has no spans (masking leaves it null); a text without matches has none. Repeated rows are treated
each on its own, equal spans of one kind count once; extra columns are passed through. An empty table gives no rows, and
without any candidate the classifier falls back to the sum of votes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cautela.llm.common import Scratch

KINDS = ("email", "ip", "card", "phone", "secret")
EMAIL, IP, CARD, PHONE, SECRET = range(5)
LABELERS = ("regex", "gazetteer", "context", "shape")
FEATURES = (*LABELERS, "long", "bias")
SPAN = "struct<start:int,kind:int,end:int>"

# The contract's patterns. Runs are possessive and begin only where the leftmost match of the plain pattern would (at the
# run's start or where the last match ended), so that a long run is read once and not from each of its characters.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE_PATTERNS = {
    EMAIL: rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    IP: r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    CARD: r"[0-9](?:[\x20-]?[0-9])++",
    PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
}
SCREENS = {EMAIL: "@", PHONE: "+"}
_OCTET = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?"
IP_RANGE = rf"^(?=[0-9])(?:{_OCTET}\.){{3}}{_OCTET}$"

WIDE_PHONE = r"\+?[0-9]{0,3}[\x20.-]?\([0-9]{2,4}\)[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])"
WIDE_CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])"
WIDE_EMAIL = (
    rf"(?<!{_LOCAL}){_LOCAL}++\x20?(?:\[at\]|\(at\))\x20?{_LABEL}++(?:(?:\.|\x20?(?:\[dot\]|\(dot\))\x20?){_LABEL}++)++"
)
KEY_NAMES = ("password", "passwd", "pwd", "passphrase", "token", "secret", "api_key", "apikey", "api-key", "access_key")
WIDE_SECRET = (
    rf"(?:(?<![A-Za-z0-9])(?:{'|'.join(KEY_NAMES)})[\x20]{{0,2}}[=:][\x20]{{0,2}}[\"']?[A-Za-z0-9+/_.-]{{8,}}+[\"']?"
    r"|(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![0-9A-Za-z]))"
)
WIDE = f"{WIDE_PHONE}|{WIDE_CARD}|{WIDE_EMAIL}|(?i:{WIDE_SECRET})"
#: One cheap look at a text decides whether the wide pattern runs at all; most characters can begin none of its parts.
WIDE_SCREEN = r"(?=[0-9)=:A\[(])(?:[0-9]{13}|[0-9]{4}[\x20-][0-9]{4}[\x20-]|\)[\x20.-]?[0-9]{3}|[=:]|AKIA|[\[(]at[\])])"
#: The same for addresses of machines and card numbers.
NUMERIC_SCREEN = r"[0-9](?:[0-9]|[\x20.-][0-9])"

CALLING_CODES = ("+1", "+33", "+34", "+44", "+49")
CARD_PREFIX = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"
PUBLIC_SUFFIX = r"(?i)(?:\.|dot\W{0,2})(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu)$"
CUES = {
    EMAIL: r"(?i)(?:e-?mail|contact|write|correo|courriel|schreib)\W{0,12}$",
    CARD: r"(?i)(?:card|visa|carte|karte|tarjeta|payment|iban)\W{0,12}$|\b[0-9]{3}-[0-9]{4}\s$",
    PHONE: r"(?i)(?:tel|phone|call|mobile|fax|appel|anruf|llam)\w{0,6}\W{0,12}$",
    SECRET: r"(?i)(?:key|login|credential|config|export)\W{0,12}$",
}
CONTEXT_CHARS = 32


def running(values: Column, plus, block: int = 128) -> Column:
    """Running totals of an array under ``plus``, block by block: appending stays cheap for long arrays."""
    empty = F.array().cast("array<int>")

    def inside(part: Column) -> Column:
        return F.aggregate(
            part, empty, lambda done, x: F.array_append(done, F.coalesce(plus(F.try_element_at(done, F.lit(-1)), x), x).cast("int"))
        )

    def blocked(array: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(array) - 1) / block).cast("int"))
        parts = F.transform(F.transform(numbers, lambda b: F.slice(array, b * block + 1, F.lit(block))), inside)
        tails = inside(F.transform(parts, lambda p: F.try_element_at(p, F.lit(-1))))
        pairs = F.arrays_zip(parts.alias("part"), F.concat(F.array(F.lit(None).cast("int")), tails).alias("before"))
        filled = F.filter(pairs, lambda p: p["part"].isNotNull())
        return F.flatten(
            F.transform(filled, lambda p: F.transform(p["part"], lambda x: F.coalesce(plus(p["before"], x), x).cast("int")))
        )

    return F.when(F.size(values) == 0, empty).when(F.size(values) <= block, inside(values)).otherwise(blocked(values))


def _add(x: Column, y: Column) -> Column:
    return x + y


def luhn(digits: Column) -> Column:
    """Check digit of a string of digits."""
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    doubled = F.transform(numbers, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def passes(kind: int, match: Column) -> Column:
    """The check that a match of the kind's pattern has to pass."""
    digits = _digits(match)
    if kind == IP:
        return match.rlike(IP_RANGE)
    if kind == CARD:
        return F.char_length(digits).between(12, 19) & luhn(digits)
    if kind == PHONE:
        return F.char_length(digits).between(9, 15)
    return F.lit(True)


def _matches(df: DataFrame, name: str, pattern: str, screen: Column) -> DataFrame:
    """Adds the array ``name`` of (start, end, match, before, after), positions in code points."""
    none = F.array().cast("array<string>")
    df = df.withColumn("_found", F.when(screen, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn("_gaps", F.when(F.size("_found") > 0, F.split("text", pattern, -1)).otherwise(none))
    df = df.withColumn("_steps", F.transform("_found", lambda m, i: F.char_length(m) + F.char_length(F.get(F.col("_gaps"), i))))
    df = df.withColumn("_ends", running(F.col("_steps"), _add))
    built = F.transform(
        F.arrays_zip("_found", "_ends"),
        lambda z, i: F.struct(
            (z["_ends"] - F.char_length(z["_found"])).alias("start"),
            z["_ends"].alias("end"),
            z["_found"].alias("match"),
            F.right(F.get(F.col("_gaps"), i), F.lit(CONTEXT_CHARS)).alias("before"),
            F.left(F.get(F.col("_gaps"), i + 1), F.lit(2)).alias("after"),
        ),
    )
    return df.withColumn(name, built).drop("_found", "_gaps", "_steps", "_ends")


def _span(kind: int, m: Column) -> Column:
    return F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"))


def _wide_kind(match: Column) -> Column:
    lower = F.lower(match)
    secret = reduce(lambda a, b: a | b, (lower.startswith(k) for k in KEY_NAMES)) | match.startswith("AKIA")
    return (
        F.when(secret, SECRET)
        .when(lower.rlike(r"[\[(]at[\])]"), EMAIL)
        .when(match.contains("("), PHONE)
        .otherwise(CARD)
    )


def _votes(kind: Column, m: Column) -> Column:
    """One vote (1, -1 or 0: no opinion) of each labeler, and whether the match is long."""
    match, digits = m["match"], _digits(m["match"])
    value = F.regexp_replace(match, r"^[^=:]*[=:][\s\"']*", "")
    strict = (
        F.when(kind == CARD, F.when(F.char_length(digits).between(12, 19) & luhn(digits), 1).otherwise(-1))
        .when(kind == PHONE, F.when(F.char_length(digits).between(9, 15), 1).otherwise(-1))
        .when(kind == SECRET, F.when(value.rlike(r"[0-9]") & value.rlike("[A-Za-z]"), 1).otherwise(-1))
        .otherwise(0)
    )
    calling = reduce(lambda a, b: a | b, (match.startswith(c) for c in CALLING_CODES))
    listed = (
        F.when(kind == CARD, F.when(digits.rlike(CARD_PREFIX), 1).otherwise(-1))
        .when(kind == PHONE, F.when(calling, 1).otherwise(0))
        .when(kind == SECRET, 1)
        .otherwise(F.when(match.rlike(PUBLIC_SUFFIX), 1).otherwise(0))
    )
    cue = reduce(lambda a, b: a | b, ((kind == k) & m["before"].rlike(p) for k, p in CUES.items()))
    stuck = m["before"].rlike(r"[0-9][.,]?$") | m["after"].rlike(r"^[.,]?[0-9]")
    around = F.when(cue, 1).when(stuck, -1).otherwise(0)
    shape = (
        F.when(kind == SECRET, F.when(F.char_length(value) >= 12, 1).otherwise(-1))
        .when(kind == CARD, F.when(F.char_length(digits) == 16, 1).otherwise(0))
        .when(kind == PHONE, F.when(match.rlike(r"[0-9]{3}[\x20.-]?[0-9]{4}$"), 1).otherwise(-1))
        .otherwise(1)
    )
    opinions = zip(LABELERS, (strict, listed, around, shape), strict=True)
    return F.struct(*(v.cast("int").alias(n) for n, v in opinions), (F.char_length(match) > 16).cast("int").alias("long"))


def candidates(df: DataFrame) -> DataFrame:
    """Adds ``base`` (spans) and ``wide`` (spans with votes) to rows that have a column ``text``."""
    kept = df.columns
    text = F.col("text")
    df = df.withColumn("_numeric", text.rlike(NUMERIC_SCREEN))
    for kind, pattern in BASE_PATTERNS.items():
        screen = text.contains(SCREENS[kind]) if kind in SCREENS else F.col("_numeric")
        df = _matches(df, f"_m{kind}", pattern, screen)
    base = [_base_spans(kind) for kind in BASE_PATTERNS]
    df = df.withColumn("base", F.array_sort(F.concat(*base))).select(*kept, "base")
    df = _matches(df, "_wide", WIDE, text.rlike(WIDE_SCREEN))
    df = df.withColumn("_wide", F.transform("_wide", lambda m: F.struct(_wide_kind(m["match"]).alias("kind"), m.alias("m"))))
    fresh = F.filter(
        "_wide",
        lambda w: ~F.exists(
            "base", lambda b: (b["kind"] == w["kind"]) & (b["start"] < w["m"]["end"]) & (w["m"]["start"] < b["end"])
        ),
    )
    voted = F.transform(
        fresh,
        lambda w: F.struct(
            F.struct(w["m"]["start"].alias("start"), w["kind"].alias("kind"), w["m"]["end"].alias("end")).alias("span"),
            _votes(w["kind"], w["m"]).alias("votes"),
        ),
    )
    return df.withColumn("wide", voted).select(*kept, "base", "wide")


def _base_spans(kind: int) -> Column:
    valid = F.filter(f"_m{kind}", lambda m: passes(kind, m["match"]))
    return F.transform(valid, lambda m: _span(kind, m))


@dataclass(frozen=True)
class SpanModel:
    """Weights of the span classifier by kind; ``reliability`` is P(vote = label | the labeler has an opinion)."""

    weights: dict[int, tuple[float, ...]]
    reliability: dict[str, float]

    def accepts(self, kind: Column, votes: Column) -> Column:
        names = FEATURES[:-1]
        score = F.lit(None).cast("double")
        for k, w in self.weights.items():
            terms = [votes[n] * F.lit(x) for n, x in zip(names, w[:-1], strict=True)]
            score = F.when(kind == k, reduce(_add, terms) + F.lit(w[-1])).otherwise(score)
        fallback = reduce(_add, (votes[n] for n in LABELERS)).cast("double")
        return F.coalesce(score, fallback) > 0


def vote_counts(found: DataFrame) -> DataFrame:
    """Candidates per kind and vote pattern: at most 5 kinds x 3^4 votes x 2 rows, whatever the corpus.

    The outer explode, because for the inner one the optimizer repeats all patterns in an inferred filter.
    """
    rows = found.select(F.explode_outer("wide").alias("w")).filter(F.col("w").isNotNull()).select("w.span.kind", "w.votes.*")
    return rows.groupBy("kind", *LABELERS, "long").agg(F.count("*").alias("n"))


def fit_spans(counts: list, rounds: int = 60, steps: int = 400, rate: float = 0.5) -> SpanModel:
    """Expectation-maximisation over the counted patterns, then the classifier on its posteriors (both deterministic)."""
    patterns = [(r["kind"], tuple(r[n] for n in LABELERS), r["long"], r["n"]) for r in counts]
    if not patterns:
        return SpanModel({}, {})
    right = {name: 0.8 for name in LABELERS}
    prior = dict.fromkeys({p[0] for p in patterns}, 0.5)
    posterior: list[float] = []
    for _ in range(rounds):
        posterior = []
        for kind, votes, _, _ in patterns:
            odds = math.log(prior[kind] / (1 - prior[kind]))
            odds += sum(v * math.log(right[n] / (1 - right[n])) for n, v in zip(LABELERS, votes, strict=True))
            posterior.append(1 / (1 + math.exp(-max(-50.0, min(50.0, odds)))))
        for kind in prior:
            mine = [(p, x[3]) for p, x in zip(posterior, patterns, strict=True) if x[0] == kind]
            total = sum(n for _, n in mine)
            prior[kind] = (sum(p * n for p, n in mine) + 1) / (total + 2)
        for i, name in enumerate(LABELERS):
            agreed = given = 0.0
            for p, (_, votes, _, n) in zip(posterior, patterns, strict=True):
                if votes[i]:
                    given += n
                    agreed += n * (p if votes[i] > 0 else 1 - p)
            # Smoothed, and never worse than chance: a labeler that seems so would turn the labels over.
            right[name] = min(0.99, max(0.55, (agreed + 8) / (given + 10)))
    weights = {}
    for kind in sorted(prior):
        rows = [
            ((*(float(v) for v in votes), float(long), 1.0), p, n)
            for p, (k, votes, long, n) in zip(posterior, patterns, strict=True)
            if k == kind
        ]
        total = sum(n for *_, n in rows)
        w = [1.0] * len(LABELERS) + [0.0, 0.0]
        for _ in range(steps):
            slope = [0.01 * x for x in w]
            for x, p, n in rows:
                z = sum(a * b for a, b in zip(w, x, strict=True))
                error = 1 / (1 + math.exp(-max(-50.0, min(50.0, z)))) - p
                for i, v in enumerate(x):
                    slope[i] += error * v * n / total
            w = [a - rate * s for a, s in zip(w, slope, strict=True)]
        weights[kind] = tuple(w)
    return SpanModel(weights, right)


def all_spans(model: SpanModel) -> Column:
    """Base spans and accepted candidates of a row, by start, then kind."""
    accepted = F.filter("wide", lambda w: model.accepts(w["span"]["kind"], w["votes"]))
    added = F.transform(accepted, lambda w: w["span"])
    return F.array_sort(F.array_distinct(F.concat(F.col("base"), added)))


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def _packed(df: DataFrame, text: str) -> tuple[list[str], DataFrame]:
    """The names of the other columns, and the rows as ``text`` and a struct ``row`` of the others."""
    others = [c for c in df.columns if c != text]
    row = F.struct(*(F.col(c) for c in others)) if others else F.struct(F.lit(None).alias("none"))
    return others, df.select(row.alias("row"), F.col(text).alias("text"))


def find_personal_data(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``df`` but the text, and a struct ``personal_data``: base (spans), spans, both as arrays."""
    others, packed = _packed(df, text)
    packed = packed.withColumn("text", F.coalesce("text", F.lit("")))
    scratch = Scratch(df.sparkSession, "personal-data")
    found = scratch.save(candidates(packed).drop("text"))
    model = fit_spans(vote_counts(found).collect())
    return found.select(
        *(F.col("row")[c].alias(c) for c in others), F.struct("base", all_spans(model).alias("spans")).alias("personal_data")
    )


def mask_personal_data(df: DataFrame, text: str = "text") -> DataFrame:
    """The same columns with every span of ``text`` replaced by its kind in angle brackets; overlapping spans become one."""
    _, packed = _packed(df, text)
    # Written once: finding the candidates costs many times what the text costs to write and read.
    found = Scratch(df.sparkSession, "personal-data").save(candidates(packed))
    model = fit_spans(vote_counts(found).collect())
    spans = found.withColumn("spans", all_spans(model)).select("row", "text", "spans")
    spans = spans.withColumn("reach", running(F.transform("spans", lambda s: s["end"]), F.greatest))
    names = F.array(*(F.lit(f"<{k}>") for k in KINDS))
    parts = F.transform(
        F.arrays_zip("spans", F.concat(F.array(F.lit(0)), F.col("reach")).alias("from")),
        lambda z: F.when(z["spans"].isNull(), F.substr(F.col("text"), z["from"] + 1)).otherwise(
            F.concat(
                F.substr(F.col("text"), z["from"] + 1, F.greatest(z["spans"]["start"] - z["from"], F.lit(0))),
                F.when(z["spans"]["start"] >= z["from"], F.get(names, z["spans"]["kind"])).otherwise(""),
            )
        ),
    )
    masked = F.when(F.size("spans") > 0, F.array_join(parts, "")).otherwise(F.col("text"))
    return spans.select(*(masked.alias(c) if c == text else F.col("row")[c].alias(c) for c in df.columns))
