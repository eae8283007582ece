"""Text normalisation as columns.

Spark has no built-in for Unicode compatibility forms or full case folding. Both run in Arrow
functions, but only for rows that can change: a row made of characters known to be stable is
handled by JVM expressions, and the Arrow function receives a null in its place, so its text is
never sent to a Python worker.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cautela.functions.regexes import ASCII_SPACE, SPACE, SPACE_CHARS, WHITE_SPACE_CHARS

# Blocks of starters that are their own compatibility form and never join the character before
# them (tests check every code point).
_STABLE_RANGES = (
    (0x0000, 0x007F),  # ASCII
    (0x00C0, 0x0131),  # Latin, without the compatibility letters in between
    (0x0134, 0x013E),
    (0x0141, 0x0148),
    (0x014A, 0x017E),
    (0x0400, 0x0482),  # Cyrillic
    (0x048A, 0x052F),
    (0x2012, 0x2015),  # dashes, quotes, bullet
    (0x2018, 0x2022),
    (0x20AC, 0x20AC),  # euro sign
    (0x3001, 0x3002),  # CJK stops
    (0x3041, 0x3096),  # kana
    (0x30A1, 0x30FA),
    (0x4E00, 0x9FA5),  # unified ideographs
    (0xAC00, 0xD7A3),  # Hangul syllables
)
# Stable characters whose full case folding is not their lower case; sharp s is written out below.
_FOLD_EXCEPTIONS = chr(0x130)
# Letters of Latin-1 with an accent (lower case), and the letter left without it.
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def _char_class(ranges) -> str:
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


_BEYOND_LATIN = f"[^{_char_class(_STABLE_RANGES[:2])}]|[{_FOLD_EXCEPTIONS}]"
_MAY_CHANGE = f"[^{_char_class(_STABLE_RANGES)}]"
_MAY_FOLD_OTHERWISE = f"[^{_char_class(_STABLE_RANGES)}]|[{_FOLD_EXCEPTIONS}]"
_MAY_LOSE_OTHER_ACCENT = f"[^\\x00-\\x7f{_ACCENTED}ß]"


def stable_characters() -> str:
    """Every character on the JVM-only path."""
    return "".join(chr(i) for a, b in _STABLE_RANGES for i in range(a, b + 1))


def _nfkc():
    @F.arrow_udf(StringType())
    def nfkc(texts):
        import unicodedata

        import pyarrow as pa

        # Not Arrow's own utf8_normalize: it leaves some letters decomposed.
        return pa.array(
            [None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string()
        )

    return nfkc


def _nfkc_fold():
    @F.arrow_udf(StringType())
    def nfkc_fold(texts):
        import unicodedata

        import pyarrow as pa

        return pa.array(
            [
                None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()).casefold()
                for t in texts.to_pylist()
            ],
            pa.string(),
        )

    return nfkc_fold


def _drop_accents():
    marks = {i: None for i in range(0x110000) if unicodedata.combining(chr(i))}

    @F.arrow_udf(StringType())
    def drop_accents(texts):
        import unicodedata

        import pyarrow as pa

        return pa.array(
            [
                None if t is None else unicodedata.normalize("NFKD", t).translate(marks)
                for t in texts.to_pylist()
            ],
            pa.string(),
        )

    return drop_accents


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def _needs(text: Column, pattern: str) -> Column:
    # Cheapest test first: bytes against characters, then the Latin blocks alone, then all of them.
    return ~is_ascii(text) & text.rlike(_BEYOND_LATIN) & text.rlike(pattern)


def _runs(text: Column, one: str) -> Column:
    return F.regexp_replace(text, f"{one}(?:{one}+|(?<!\\x20))", " ")


def squeeze(text: Column) -> Column:
    """Each run of whitespace becomes one space; none is left at the ends.

    Single spaces are what they shall become, so the pattern passes them by: most texts have nothing to replace.
    """

    return F.trim(F.when(is_ascii(text), _runs(text, ASCII_SPACE)).otherwise(_runs(text, SPACE)))


def squeeze_once(text: Column) -> Column:
    """``squeeze`` of a text that is costly to make: it stands in the plan once, where ``squeeze`` names it four times."""
    return F.trim(_runs(text, SPACE))


def strip_spaces(text: Column) -> Column:
    """``str.strip`` of Python."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def strip_white_space(text: Column) -> Column:
    """Strip the Unicode White_Space property, the rule of the request model."""
    return F.btrim(text, F.lit(WHITE_SPACE_CHARS))


def normalise(text: Column, filtered_on: bool = False) -> Column:
    """Compatibility form, single spaces, no space at the ends.

    Say ``filtered_on`` when rows are dropped by the result: filters then stay above the Arrow
    function, where the optimizer would otherwise run it once for the filter and once for the rows.
    """
    nfkc = _nfkc().asNondeterministic() if filtered_on else _nfkc()
    hard = F.when(_needs(text, _MAY_CHANGE), text)
    return squeeze(F.coalesce(nfkc(hard), text))


def dedupe_key(text: Column) -> Column:
    """Case-folded normal form of raw text: two texts with one key are copies."""
    hard = F.when(_needs(text, _MAY_FOLD_OTHERWISE), text)
    easy = F.replace(F.lower(squeeze(text)), F.lit("ß"), F.lit("ss"))
    return F.coalesce(_nfkc_fold()(hard), easy)


def without_accents(lowered: Column) -> Column:
    """Letters without their accents, for text that is in lower case already."""
    hard = F.when(~is_ascii(lowered) & lowered.rlike(_MAY_LOSE_OTHER_ACCENT), lowered)
    # The translation looks every character up; most texts have none to change.
    easy = F.when(is_ascii(lowered), lowered).otherwise(F.translate(lowered, _ACCENTED, _PLAIN))
    return F.coalesce(_drop_accents()(hard), easy)


def fingerprint(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def excerpt(match: Column, limit: int = 80) -> Column:
    clean = strip_spaces(match)
    return F.when(
        F.char_length(clean) > limit, F.concat(F.substring(clean, 1, limit - 1), F.lit("…"))
    ).otherwise(clean)


def metadata_value(value: Column) -> Column:
    return F.lower(strip_spaces(F.coalesce(value.cast("string"), F.lit(""))))


def category_name(value: Column) -> Column:
    name = F.replace(metadata_value(value), F.lit(" "), F.lit("_"))
    return F.when(name == "", F.lit("unspecified")).otherwise(name)


def first_non_blank(*values: Column) -> Column:
    stripped = [strip_spaces(v.cast("string")) for v in values]
    return F.coalesce(*[F.when(s != "", s) for s in stripped], F.lit(""))


def six_decimals(value: Column) -> Column:
    return F.format_string("%.6f", value.cast("double"))
