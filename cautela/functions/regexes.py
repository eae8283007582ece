r"""Java regex pieces that behave like Python's ``re`` on Unicode text.

Java's ``\s`` and ``\w`` cover other characters than Python's, and its ``\b`` follows yet another
table, so every pattern of this package spells its classes out.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

# Code points for which str.isspace() is true.
_SPACE_POINTS = (
    *range(0x09, 0x0E),
    *range(0x1C, 0x21),
    0x85,
    0xA0,
    0x1680,
    *range(0x2000, 0x200B),
    0x2028,
    0x2029,
    0x202F,
    0x205F,
    0x3000,
)
SPACE_CHARS = "".join(map(chr, _SPACE_POINTS))
# The Unicode White_Space property: as above without the four information separators.
WHITE_SPACE_CHARS = "".join(chr(i) for i in _SPACE_POINTS if not 0x1C <= i <= 0x1F)

SPACE_SET = r"\t-\r\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD_SET = r"\p{L}\p{N}_"

# The cheap range first: for a character outside it none of the set's members is tried.
SPACE = rf"[\x09-\x20\x85-\x{{3000}}&&[{SPACE_SET}]]"
NOT_AFTER_WORD = f"(?<![{WORD_SET}])"
NOT_BEFORE_WORD = f"(?![{WORD_SET}])"
# A word boundary for a spot where either side may be the word character.
BOUNDARY = (
    f"(?:(?<![{WORD_SET}])(?=[{WORD_SET}])|(?<=[{WORD_SET}])(?![{WORD_SET}]))"
)


# One by one: Java looks characters of Latin-1 up in one step and tries ranges in turn.
ASCII_SPACE = r"[\x09\x0A\x0B\x0C\x0D\x1C\x1D\x1E\x1F\x20]"
_ASCII_WORD = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_"
# What folds to an ASCII letter beside its capital.
OTHER_CASES = {"i": "\u0130\u0131", "k": "\u212a", "s": "\u017f"}


def required_literals(alternative: str) -> list[str]:
    """Pieces of plain text, in lower case, that every match has; none if that cannot be told."""
    rest, before = re.sub(r"\\.|\[[^\]]*\]", "\0", alternative), None
    while rest != before:
        before, rest = rest, re.sub(r"\([^()]*\)", "\0", rest)
    if re.search(r"[|()\[\]\\]", rest):
        return []
    return re.findall(r"[a-z0-9 '-]{2,}(?![?*{])", re.sub(r"\{[^}]*\}", "?", rest).lower())


def first_characters(alternative: str) -> str | None:
    """The characters, in any letter case, that a match can begin with; None unless it is one ASCII letter or digit."""
    literals, first = required_literals(alternative), alternative[:1].lower()
    if not re.match("[a-z0-9]", first) or not literals or not alternative.lower().startswith(literals[0]):
        return None
    return first + first.upper().replace(first, "") + OTHER_CASES.get(first, "")


def whole_words(alternatives: Sequence[str]) -> str:
    """Case-insensitive search for whole words or phrases.

    Where no alternative can begin, one look at the character tells, and within a word one at the character before it.
    """
    body = "|".join(alternatives).replace(r"\s", SPACE).replace(r"\d", r"\p{Nd}")
    firsts = [first_characters(a) for a in alternatives]
    head = "" if None in firsts else f"(?=[{''.join(dict.fromkeys(firsts))}])(?<![{_ASCII_WORD}])"
    return f"{head}(?iu){NOT_AFTER_WORD}(?:{body}){NOT_BEFORE_WORD}"
