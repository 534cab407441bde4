"""Numbers and names out of text columns.

Patterns use Unicode classes, so Persian digits and blanks count as such; Persian digits are turned into ASCII ones
before a cast.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERSIAN_DIGITS, DIGITS = "۰۱۲۳۴۵۶۷۸۹", "0123456789"


def ascii_digits(text: Column) -> Column:
    return F.translate(text, PERSIAN_DIGITS, DIGITS)


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def share(text: Column) -> Column:
    """``4 %`` -> 0.04; what is no number gives null."""
    return F.regexp_replace(ascii_digits(text), r"(?U)[%\s]", "").try_cast("double") / 100


def thousands(text: Column) -> Column:
    """``2,124`` -> 2124; what is no number gives null."""
    return F.replace(ascii_digits(text), F.lit(","), F.lit("")).try_cast("bigint")


def number(text: Column) -> Column:
    """``2,124.5`` -> 2124.5; what is no number gives null."""
    return F.replace(ascii_digits(text), F.lit(","), F.lit("")).try_cast("double")


def price(text: Column) -> Column:
    """``12,500-`` -> 12500.0; an empty text gives null, other text that is no number raises an error."""
    bare = F.translate(ascii_digits(text), ",-", "")
    return F.when(bare != "", bare).cast("double")


def contains_any_case(text: Column, part: str) -> Column:
    """False for null, so that its negation keeps null rows."""
    return F.coalesce(F.contains(F.lower(text), F.lit(part.lower())), F.lit(False))


def first_integer(text: Column, strict: bool = False) -> Column:
    """The first run of digits; ``strict``: none raises an error, else gives null."""
    digits = F.regexp_extract(ascii_digits(text), r"(\d+)", 1)
    none = F.raise_error(F.lit("no number in the name")).cast("bigint") if strict else F.lit(None).cast("bigint")
    return F.when(digits != "", digits.cast("bigint")).otherwise(none)


def unit_dose(text: Column) -> Column:
    """The number before ``[iU]``, else null."""
    digits = F.regexp_extract(ascii_digits(text), r"(?U)(\d+)\s*\[iU\]", 1)
    return F.when(digits != "", digits).cast("bigint")


def brand_prefix(text: Column) -> Column:
    """Leading capitals and blanks up to the first run of two blanks or more, stripped; else null."""
    lead = stripped(F.regexp_extract(text, r"(?U)^([A-Z\s]+?)\s{2,}", 1))
    return F.when(lead != "", lead)
