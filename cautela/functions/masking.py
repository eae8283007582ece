"""Masks for personal data in submitted reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cautela.functions.regexes import BOUNDARY, NOT_AFTER_WORD, NOT_BEFORE_WORD, SPACE_SET
from cautela.functions.text import squeeze_once

URL_MASK = "[URL]"
EMAIL_MASK = "[EMAIL]"
PHONE_OR_ACCOUNT_MASK = "[PHONE_OR_ACCOUNT]"

_URL = rf'(?iu){NOT_AFTER_WORD}(?:https?://|www\.)[^{SPACE_SET}<>"]+'
# A word boundary, then address characters up to an @. Whether an address follows does not depend on where in a run of
# such characters it starts, so only the first boundary of a run (or after the last match) is tried: what stands before it
# is put back. The plain form tries every boundary and takes time with the square of the run.
_ADDRESS = "[A-Z0-9._%+-]"
_EMAIL = (
    rf"(?iu)(?:\G|(?<!{_ADDRESS}))((?:(?!{BOUNDARY}){_ADDRESS})*+){BOUNDARY}{_ADDRESS}++"
    rf"@[A-Z0-9.-]+\.[A-Z]{{2,}}{NOT_BEFORE_WORD}"
)
_PHONE_OR_ACCOUNT = (
    rf"{NOT_AFTER_WORD}\+?\p{{Nd}}[\p{{Nd}}{SPACE_SET}().-]{{6,}}\p{{Nd}}{NOT_BEFORE_WORD}"
)


def mask_urls(text: Column) -> Column:
    return F.regexp_replace(text, _URL, URL_MASK)


def mask_emails(text: Column) -> Column:
    return F.regexp_replace(text, _EMAIL, f"$1{EMAIL_MASK}")


def mask_phones_and_accounts(text: Column) -> Column:
    return F.regexp_replace(text, _PHONE_OR_ACCOUNT, PHONE_OR_ACCOUNT_MASK)


def guard_formula(text: Column) -> Column:
    """A quote before a leading sign, so a spreadsheet reads text and not a formula."""
    return F.regexp_replace(text, r"^([=+\-@])", "'$1")


def sanitise(text: Column) -> Column:
    """All masks in their order, then single spaces, then the formula guard.

    Text without an @ cannot hold an address and skips that mask.
    """

    def finish(masked: Column) -> Column:
        return guard_formula(squeeze_once(mask_phones_and_accounts(masked)))

    no_urls = mask_urls(text)
    return F.when(F.contains(text, F.lit("@")), finish(mask_emails(no_urls))).otherwise(finish(no_urls))
