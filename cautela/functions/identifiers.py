"""Identifiers computed from content, equal on every retry and at every partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# RFC 4122 namespace for URLs.
URL_NAMESPACE_HEX = "6ba7b8119dad11d180b400c04fd430c8"


def name_uuid(name: Column) -> Column:
    """UUID version 5 of a name in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE_HEX)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8),
        F.lit("-"),
        F.substring(digest, 9, 4),
        F.lit("-5"),
        F.substring(digest, 14, 3),
        F.lit("-"),
        variant,
        F.substring(digest, 18, 3),
        F.lit("-"),
        F.substring(digest, 21, 12),
    )


def report_key(submitted_at: Column, *identity: Column) -> Column:
    """Full SHA-256 of what was sent and when: equal for a replayed report, different for any other."""
    return F.sha2(F.concat_ws("\x1f", F.unix_micros(submitted_at).cast("string"), *identity), 256)


def report_id(submitted_at: Column, *identity: Column) -> Column:
    """``COM-<time>-<6 hex>``, for display; ``report_key`` tells reports of one second apart."""
    return F.concat(
        F.lit("COM-"),
        F.date_format(F.to_utc_timestamp(submitted_at, F.current_timezone()), "yyyyMMddHHmmss"),
        F.lit("-"),
        F.upper(F.substring(report_key(submitted_at, *identity), 1, 6)),
    )


def hash_pick(parts: list[Column], size: int) -> Column:
    """A number in [0, size) from the hash of the parts: a random pick without a sequence."""
    word = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8)
    return F.conv(word, 16, 10).cast("bigint") % F.lit(size)
