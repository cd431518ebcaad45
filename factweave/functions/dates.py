"""Dates written in many notations, as ``YYYY-MM-DD`` strings (whose order is the order of the days)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stand for no value, beside null and blank.
ABSENT = ("", "n/a", "unknown", "none", "null")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
_TIME = r"(?:[t ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:z|[+-]\d{2}:?\d{2})?)?$"
#: Notations, each rewritten to year-month-day; the first that fits leaves a text that no later one fits.
_NOTATIONS = (
    (r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})" + _TIME, "$1-$3-$4"),
    (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", "$3-$2-$1"),
    (r"^(\d{1,2})(?:st|nd|rd|th)?[\s\-./]*(?:of )?" + _MONTH + r"[\s\-.,/]*(\d{4})$", "$3-$2-$1"),
    (r"^" + _MONTH + r"[\s\-.]*(\d{1,2})(?:st|nd|rd|th)?[\s,\-]+(\d{4})$", "$3-$1-$2"),
    (r"^(\d{4})[\s\-./]*" + _MONTH + r"[\s\-./]*(\d{1,2})$", "$1-$2-$3"),
    (r"^0?(\d{1,2})[/-]0?\1[/-](\d{4})$", "$2-$1-$1"),
    (r"^(1[3-9]|2\d|3[01])[/-](\d{1,2})[/-](\d{4})$", "$3-$2-$1"),
    (r"^(\d{1,2})[/-](1[3-9]|2\d|3[01])[/-](\d{4})$", "$3-$1-$2"),
)


def stripped(c: Column) -> Column:
    """Without white space of any kind at either end, no-break spaces included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_absent(c: Column) -> Column:
    return c.isNull() | F.lower(stripped(c)).isin(*ABSENT)


def parse_day(c: Column) -> Column:
    """The day a string names, or null.

    Read: ISO days and times, ``YYYY/MM/DD``, ``YYYY.MM.DD``, ``YYYYMMDD``, ``DD.MM.YYYY``, days with a
    month's name in either order, and ``DD/MM/YYYY`` or ``MM/DD/YYYY`` (dashes too) where one reading only
    is a real day or both are the same. Anything else, such as ``FY19``, ``mid-2018`` or 30 February, is null.
    The notations are rewritten one after another, each text once, so the expression grows with their number.
    """
    s = F.lower(stripped(c))
    for pattern, to in _NOTATIONS:
        s = F.regexp_replace(s, pattern, to)
    for i, m in enumerate(MONTHS, 1):
        s = F.replace(s, F.lit(f"-{m}-"), F.lit(f"-{i}-"))
    plain = F.regexp_extract(s, r"^0*([1-9]\d{0,3}-\d{1,2}-\d{1,2})$", 1)
    return F.date_format(F.try_to_timestamp(plain, F.lit("y-M-d")), "yyyy-MM-dd")
