"""Text helpers, reading-window scores and the grounding of quotes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The signals that a passage states something checkable, and their weights.
MIN_SCORED_CHARS = 120
CURRENCY = r"(?iu)[₹$€£]|(?U:\b)(?:rs\.?|inr|usd|eur)(?U:\b)"
MAGNITUDE = r"(?i)\b(?:crore|lakh|million|billion|trillion|mn|bn|cr)\b"
PERCENT = r"(?i)%|\bper\s?cent\b|\bpercent\b|\bbps\b"
PERIOD = r"(?i)\b(?:FY\s?\d{2,4}|Q[1-4]\b|fiscal\s+\d{4}|20\d{2}-\d{2}|20\d{2}/\d{2}|as\s+(?:of|at))\b"
MONTH_DATE = r"(?i)\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b"
STATE_VERB = r"(?i)\b(?:resigned|appointed|ceased|retired|acquired|merged|approved|increased|decreased|grew|declined|stood at|amounted to|reported|projected|estimated|revised)\b"
CLAIM = (
    r"(?i)(?:estimated|projected|expected|forecast|revised|reported|recorded|stood|amounted|grew|rose|fell|declined|increased|decreased|moderated|accelerated|is|was|at)\s+"
    r"(?:to\s+be\s+|to\s+|by\s+|at\s+)?(?:around\s+|about\s+|nearly\s+|approximately\s+)?"
    r"[₹$€£]?\s?\d[\d,.]*\s?(?:per\s?cent|percent|%|crore|lakh|million|billion|bn|mn|cr\b)"
)


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def norm(c: Column) -> Column:
    """Stripped, lower case; null is the empty string."""
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def stated(c: Column) -> Column:
    """Whether a qualifier holds any text; null and the empty string do not."""
    return F.coalesce(F.length(c) > 0, F.lit(False))


def fact_density(text: Column) -> Column:
    """How fact-bearing a passage looks; texts under 120 characters and null score nought."""
    n = F.length(text)
    ratio = F.regexp_count(text, F.lit(r"\d")) / F.greatest(n, F.lit(1))
    flag = lambda p, w: F.when(text.rlike(p), F.lit(w)).otherwise(F.lit(0.0))
    score = F.least(ratio * 40, F.lit(4.0)) + flag(CURRENCY, 2.0) + flag(MAGNITUDE, 2.0) + flag(PERCENT, 1.5) + flag(PERIOD, 2.0) + flag(MONTH_DATE, 1.5) + flag(STATE_VERB, 1.5)
    score = score + F.least(F.regexp_count(text, F.lit(CLAIM)) * 1.6, F.lit(4.8))
    return F.when((n >= MIN_SCORED_CHARS) & n.isNotNull(), F.round(score * F.when(ratio > 0.35, 0.5).otherwise(1.0) + 1e-9, 3)).otherwise(F.lit(0.0))


def locate(text: Column, quote: Column) -> Column:
    """STRUCT<start, stop> of a quote in a text (0-based, half-open) or null.

    First verbatim, then with any run of white space standing for any other. Empty and blank quotes are not found.
    """
    exact = F.position(quote, text)
    words = F.filter(F.split(quote, r"(?U)\s+"), lambda w: w != "")
    pattern = F.concat(F.lit(r"(?U)\Q"), F.array_join(F.transform(words, lambda w: F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q"))), r"\E\s+\Q"), F.lit(r"\E"))
    loose = F.regexp_instr(text, pattern)
    span = lambda a, n: F.struct((a - 1).cast("int").alias("start"), (a - 1 + n).cast("int").alias("stop"))
    return F.when(F.length(strip(quote)) > 0, F.when(exact > 0, span(exact, F.length(quote))).when(loose > 0, span(loose, F.length(F.regexp_substr(text, pattern)))))


def grounding_quality(raw: Column, quote: Column) -> Column:
    """STRUCT<factor, note>: how surely a quote supports one value among the numbers it holds."""
    value = strip(raw)
    numbers = F.regexp_extract_all(quote, F.lit(r"\d[\d,]*(?:\.\d+)?"), F.lit(0))
    distinct = F.size(F.array_distinct(numbers))
    times = F.size(F.filter(numbers, lambda x: x == value))
    answer = lambda f, note: F.struct(f.cast("double").alias("factor"), note.cast("string").alias("note"))
    nothing = F.lit(None)
    return (
        F.when(~stated(raw), answer(F.lit(1.0), nothing))
        .when(~F.contains(quote, value), answer(F.lit(0.4), F.concat(F.lit("value '"), value, F.lit("' is not in its own quote"))))
        .when(distinct <= 2, answer(F.lit(1.0), nothing))
        .when(times > 1, answer(F.lit(0.5), F.format_string("value '%s' stands %d times in its quote", value, times)))
        .otherwise(answer(F.greatest(F.lit(0.45), 1.0 - 0.12 * (distinct - 2)), F.format_string("quote holds %d numbers; which column it is was inferred", distinct)))
    )
