"""Column expressions shared by the operators.

All of them are built-in Spark SQL expressions, so they stay inside
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "col_", "is_blank", "strip", "year_from_text", "has_valid_code", "code_prefix",
    "combine_text", "clip", "round_to", "hex15_to_number",
    "dot", "major_group", "MAJOR_GROUPS", "LOG_FLOOR",
]

LOG_FLOOR = 1e-9


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_blank(c) -> Column:
    """True when the text is empty or only whitespace (Unicode-aware, like
    Python's ``str.strip() == ''``)."""
    return col_(c).rlike(r"(?U)^\s*$")


def strip(c) -> Column:
    """Remove leading and trailing whitespace of any kind (``trim`` removes
    spaces only)."""
    return F.regexp_replace(col_(c), r"(?U)^\s+|\s+$", "")


def year_from_text(c) -> Column:
    """First run of four digits in the text form of the value, as int; null
    when there is none."""
    digits = F.regexp_extract(col_(c).cast("string"), r"([0-9]{4})", 1)
    return F.nullif(digits, F.lit("")).try_cast("int")


def has_valid_code(c) -> Column:
    """A code is valid when it is present, not blank and not 'unknown' in any
    case. Never null."""
    c = col_(c)
    return F.coalesce(c.isNotNull() & ~is_blank(c) & (F.lower(c) != F.lit("unknown")),
                      F.lit(False))


def code_prefix(c, n: int) -> Column:
    """Text before the first dot, first ``n`` characters ('3343.1' -> '334')."""
    return F.substring(F.substring_index(col_(c), ".", 1), 1, n)


def combine_text(title, desc) -> Column:
    """``title [SEP] description`` with a missing/'nan'/'None'/empty
    description left out, stripped."""
    d = col_(desc)
    d = F.when(d.isNull() | d.isin("nan", "None", ""), F.lit("")).otherwise(d)
    return strip(F.concat(F.coalesce(col_(title), F.lit("None")), F.lit(" [SEP] "), d))


def clip(c, lo=None, hi=None) -> Column:
    c = col_(c)
    if lo is not None:
        c = F.greatest(c, F.lit(lo))
    if hi is not None:
        c = F.least(c, F.lit(hi))
    return c


def round_to(c, digits: int) -> Column:
    """Half-up rounding written so that Spark and DuckDB agree on doubles."""
    s = float(10 ** digits)
    return (F.floor(col_(c).cast("double") * s + 0.5) / s).cast("double")


def hex15_to_number(c) -> Column:
    """First 15 hex digits of an md5 as a non-negative bigint."""
    return F.conv(F.substring(F.md5(col_(c)), 1, 15), 16, 10).cast("bigint")


def dot(a, b) -> Column:
    """Dot product of two equal-length numeric arrays."""
    return F.aggregate(F.zip_with(col_(a), col_(b), lambda x, y: x * y),
                       F.lit(0.0).cast("double"), lambda acc, v: acc + v)


# Major occupation group by first digit of a code; any other
# first character maps to 'Other'.
MAJOR_GROUPS = {
    "0": "Armed Forces",
    "1": "Managers",
    "2": "Professionals",
    "3": "Technicians & Associate Professionals",
    "4": "Clerical Support",
    "5": "Service & Sales",
    "6": "Skilled Agriculture",
    "7": "Craft & Related Trades",
    "8": "Plant & Machine Operators",
    "9": "Elementary Occupations",
}


def major_group(code) -> Column:
    m = F.create_map(*[F.lit(x) for kv in MAJOR_GROUPS.items() for x in kv])
    return F.coalesce(F.element_at(m, F.substring(col_(code), 1, 1)), F.lit("Other"))
