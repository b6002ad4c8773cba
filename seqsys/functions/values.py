"""Missing values written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that only say that there is no value, compared in lower case.
STAND_INS = [
    "", "-", "--", ".", "..", "?", "*", "na", "n/a", "n.a.", "#n/a", "nan", "nil", "none", "null",
    "unknown", "missing", "undefined", "not available", "not applicable", "<na>",
]

# Full-width forms of the printable ASCII characters, and blanks other than the space.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
_BLANKS = "".join(map(chr, [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def plain_width(c: Column) -> Column:
    """Full-width ASCII as ASCII, every blank as a space, invisible format characters removed."""
    wide = F.translate(c, _WIDE + _BLANKS, _PLAIN + " " * len(_BLANKS))
    return F.regexp_replace(wide, r"\p{Cf}", "")


def present_text(c: Column) -> Column:
    """True where a text says something: not null, blank or a stand-in."""
    return F.coalesce(~F.lower(F.trim(plain_width(c))).isin(STAND_INS), F.lit(False))


def fraction(x: str, *whole_row: str) -> Column:
    """A value above 1, or one in a row where another of ``whole_row`` is above 1, is a percentage; NaN is missing."""
    v = F.nanvl(F.col(x), F.lit(None))
    percent = v > 1
    for o in whole_row:
        percent = percent | (F.nanvl(F.col(o), F.lit(0.0)) > 1)
    return F.when(F.coalesce(percent, F.lit(False)), v / 100).otherwise(v)


def rounded(x: str, digits: int) -> Column:
    """``x`` rounded half away from zero in doubles, as DuckDB does; `F.round` makes a decimal of every value, which takes far longer."""
    y = F.col(x) * 10.0**digits
    near = F.rint(y)
    return F.when(F.abs(y - near) == 0.5, y + 0.5 * F.signum(y)).otherwise(near) / 10.0**digits
