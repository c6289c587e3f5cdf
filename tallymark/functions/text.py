"""Program and answer text: Column -> Column helpers built from SQL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python's strip() takes as white space.
WHITE_SPACE = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)

# A quoted string (kept), a block comment or a line comment; `d` makes only \n
# a line end. Fixed value: an empty literal "" is not taken as a string.
_COMMENT_OR_STRING = r"""(?smd)(".*?[^\\]"|'.*?[^\\]')|/\*.*?\*/|//.*?$"""


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def strip_value(text: Column) -> Column:
    """White space first, then double quotes, as answer cells are cleaned."""
    return F.btrim(strip(text), F.lit('"'))


def remove_comments(code: Column) -> Column:
    """Drop JavaScript comments; quoted strings stay as they are."""
    return F.regexp_replace(code, _COMMENT_OR_STRING, "$1")


def sanitize_code(code: Column, remove: Column) -> Column:
    """Comments go only where the run asks for it."""
    return F.when(F.coalesce(remove, F.lit(False)), remove_comments(code)).otherwise(code)


def is_blank(code: Column) -> Column:
    """True when nothing but white space is left of a program."""
    return F.coalesce(strip(code), F.lit("")) == ""


def sanitize_evidence(evidence: Column) -> Column:
    """One line, single back-ticks, and "Lines a, b, c" as "Lines a-c" (fixed pattern)."""
    one_line = F.replace(F.replace(evidence, F.lit("\n"), F.lit(" ")), F.lit("```"), F.lit("`"))
    return F.regexp_replace(one_line, r"Lines? (\d+), \d*, (\d+)", "Lines $1-$2")


def starts_alphanumeric(text: Column) -> Column:
    return text.rlike(r"^[\p{L}\p{N}]")
