"""Text functions used by the log parser. All stay JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Unicode white space, and the three literal patterns in the order applied.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHOLE_NUMBER = r"(?<![0-9A-Za-z_])[0-9]+(?![0-9A-Za-z_])"
SINGLE_QUOTED = r"'[^']*'"
DOUBLE_QUOTED = r'"[^"]*"'

WHITE_SPACE_RUN = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
ASCII_SPACE_RUN = "[\t-\r ]+"
INT_TEXT = r"^[+-]?[0-9]+\z"
FLOAT_TEXT = (
    r"^(?:[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:[+-]?inf(?:inity)?|nan))\z"
)


def mask_literals(c: Column) -> Column:
    """Replace whole-word digits, then '…' and "…" strings, by ``?``.

    The word boundary is ASCII, so the digits of ``café5`` are masked while
    those of ``a1`` and ``0xFF`` are not.
    """
    for pattern in (WHOLE_NUMBER, SINGLE_QUOTED, DOUBLE_QUOTED):
        c = F.regexp_replace(c, pattern, "?")
    return c


def trim_ws(c: Column) -> Column:
    """Strip Unicode white space from both ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def strip_semicolons(c: Column) -> Column:
    """Delete every ``;``, inside string literals too."""
    return F.replace(c, F.lit(";"), F.lit(""))


def ascii_spaces(c: Column) -> Column:
    """Every white space beyond ASCII as a space; ASCII text is passed through."""
    wide = "".join(ch for ch in WHITE_SPACE if ord(ch) > 127)
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(
        F.translate(c, wide, " " * len(wide))
    )


def tokens(c: Column) -> Column:
    """White-space separated words, without empty ones."""
    return F.filter(F.split(c, WHITE_SPACE_RUN), lambda t: t != "")


def to_number(c: Column, kind: str) -> Column:
    """Text to ``float`` (double) or ``int`` (64 bit); NULL when it is neither.

    Decimal text beyond the range of a double is NULL, not infinity.
    """
    if kind == "int":
        # The pattern spares the cast most of what it would fail on, which is slow.
        return F.when(c.rlike(INT_TEXT), c.try_cast("bigint"))
    if kind != "float":
        raise ValueError(f"unknown number kind: {kind}")
    value = c.try_cast("double")
    overflow = (F.abs(value) == float("inf")) & c.rlike("[0-9]")
    return F.when(c.rlike(FLOAT_TEXT) & ~overflow, value)


def is_gzip(c: Column) -> Column:
    """Whether binary content starts with the gzip magic bytes."""
    return F.hex(F.substring(c, 1, 2)) == "1F8B"


def json_text(*cols: Column | str) -> Column:
    """Columns as one JSON object, NULL fields kept."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
