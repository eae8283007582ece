"""URL extraction and flags. Everything stays inside the row: no explode, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cautela.functions.regexes import SPACE_SET

# Link shorteners and domain endings that earn a signal.
KNOWN_SHORTENERS = (
    "bit.ly",
    "tinyurl.com",
    "t.co",
    "goo.gl",
    "is.gd",
    "ow.ly",
    "buff.ly",
    "cutt.ly",
    "rebrand.ly",
)
WATCHLIST_TLDS = ("zip", "top", "xyz", "click", "link", "work", "support")

# One look at the character tells where no URL can begin; neither letter has other cases than its capital.
_URL = rf"""(?=[hHwW])(?iu)(?:https?://|www\.)[^{SPACE_SET}<>\[\]{{}}"']+"""
_TRAILING_PUNCTUATION = ".,;:!?)]}"
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:@]*)"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def find_urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_URL), F.lit(0))


def clean_url(raw: Column) -> Column:
    return F.rtrim(raw, F.lit(_TRAILING_PUNCTUATION))


def with_scheme(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("https://"), url))


def hostname(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, _HOST, 1))
    return F.when(host != "", host)


def top_level_domain(host: Column) -> Column:
    return F.when(F.contains(host, F.lit(".")), F.substring_index(host, ".", -1)).otherwise(F.lit(""))


def url_flags(original: Column, normalised: Column, host: Column) -> Column:
    known = F.coalesce(host, F.lit(""))
    return F.struct(
        original.alias("original"),
        normalised.alias("normalised"),
        host.alias("hostname"),
        F.startswith(F.lower(normalised), F.lit("https://")).alias("uses_https"),
        known.rlike(_IPV4).alias("is_ip_address"),
        F.contains(known, F.lit("xn--")).alias("uses_punycode"),
        known.isin(*KNOWN_SHORTENERS).alias("is_known_shortener"),
        top_level_domain(known).isin(*WATCHLIST_TLDS).alias("has_suspicious_tld"),
    )


def extract_urls(df: DataFrame, text: str = "normalised_text", out: str = "extracted_urls") -> DataFrame:
    """Add the array of assessed URLs, first occurrence of each kept, in order of appearance.

    Copies are found by sorting the row's URLs by (key, position) and keeping the first of each
    run, so a page with very many links costs n log n and not n squared.
    """
    by_key, cut = f"_{out}_by_key", f"_{out}_cut"
    sorted_urls = F.array_sort(
        F.transform(
            F.transform(find_urls(F.col(text)), clean_url),
            lambda u, i: F.struct(F.lower(with_scheme(u)).alias("key"), i.alias("pos"), u.alias("original")),
        )
    )
    first_of_run = F.filter(
        F.col(by_key),
        lambda u, i: (i == 0) | (u["key"] != F.get(F.col(by_key), i - 1)["key"]),
    )
    in_order = F.array_sort(
        F.transform(first_of_run, lambda u: F.struct(u["pos"].alias("pos"), u["original"].alias("original")))
    )
    parsed = F.transform(
        F.transform(
            in_order,
            lambda u: F.struct(u["original"].alias("original"), with_scheme(u["original"]).alias("normalised")),
        ),
        lambda u: F.struct(u["original"], u["normalised"], hostname(u["normalised"]).alias("hostname")),
    )
    flagged = F.transform(parsed, lambda u: url_flags(u["original"], u["normalised"], u["hostname"]))
    return df.withColumn(by_key, sorted_urls).withColumn(out, flagged).drop(by_key)
