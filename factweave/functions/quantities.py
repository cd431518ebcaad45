"""Numbers, scales and units as printed in financial prose, as column expressions.

These keep the semantics of the stored facts' own normalisation; ``operators.units`` reads more notations.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factweave.functions.text import strip

# Scale words and their factors; words that the phrase pattern finds.
SCALES = {
    "thousand": 1e3, "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "million": 1e6, "mn": 1e6, "mm": 1e6,
    "crore": 1e7, "crores": 1e7, "cr": 1e7, "billion": 1e9, "bn": 1e9, "trillion": 1e12, "tn": 1e12,
}
SCALE_NAMES = {"lakhs": "lakh", "lac": "lakh", "crores": "crore", "cr": "crore", "mn": "million", "mm": "million", "bn": "billion", "tn": "trillion"}
SCALE_PHRASE = r"(?iu)\b(thousand|lakhs?|lacs?|crores?|cr|million|mn|billion|bn|trillion|tn)\b"
UNIT_PATTERNS = (
    ("INR", r"(?iu)₹|\brs\b|\brs\.|\binr\b|\brupee"),
    ("USD", r"(?iu)\$|\busd\b|\bus\s*dollar|\bdollar"),
    ("EUR", r"(?iu)€|\beur\b|\beuro"),
    ("GBP", r"(?iu)£|\bgbp\b|\bpound"),
)
PERCENT = r"(?iu)%|\bper\s?cent\b|\bpercent\b|\bpct\b"
BPS = r"(?iu)\bbps\b|\bbasis\s+points?\b"
DIMENSIONED = ("INR", "USD", "EUR", "GBP", "percent", "bps", "days", "years", "months")
REL_TOLERANCE, ABS_TOLERANCE = 0.005, 1e-9


def parse_number(text: Column) -> Column:
    """The number of a printed value, or null: brackets round all or a leading minus negate, commas fall out, two points refuse."""
    s = strip(text)
    bracketed = s.rlike(r"(?s)^\(.*\)$")
    inner = strip(F.regexp_replace(s, r"(?s)^\((.*)\)$", "$1"))
    minus = inner.rlike("^[-−]")
    kept = F.regexp_replace(inner, r"[^\d.]", "")
    value = F.when(kept.rlike(r"\d") & ~kept.rlike(r"\..*\."), kept.try_cast("double"))
    return F.when(bracketed | minus, -value).otherwise(value)


def scale(token: Column) -> Column:
    """STRUCT<name, factor> of a scale word; an unknown or absent one is (null, 1)."""
    key = F.regexp_replace(F.lower(strip(token)), r"\.+$", "")
    names = F.create_map(*[x for k in SCALES for x in (F.lit(k), F.struct(F.lit(SCALE_NAMES.get(k, k)).alias("name"), F.lit(SCALES[k]).alias("factor")))])
    none = F.struct(F.lit(None).cast("string").alias("name"), F.lit(1.0).alias("factor"))
    return F.coalesce(F.try_element_at(names, F.coalesce(key, F.lit(""))), none)


def _currency(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for code, p in reversed(UNIT_PATTERNS):
        out = F.when(text.rlike(p), F.lit(code)).otherwise(out)
    return out


def unit_phrase(token: Column) -> Column:
    """STRUCT<unit, magnitude> of a free-text unit: basis points before percent before currencies before any other words."""
    text = strip(token)
    found = F.lower(F.regexp_extract(text, SCALE_PHRASE, 1))
    rest = F.regexp_replace(F.regexp_replace(text, SCALE_PHRASE, ""), r"^[ .,\-–—/()]+|[ .,\-–—/()]+$", "")
    unit = F.when(text.rlike(BPS), F.lit("bps")).when(text.rlike(PERCENT), F.lit("percent")).otherwise(F.coalesce(_currency(text), F.when(F.length(rest) >= 2, F.lower(rest))))
    return F.struct(F.when(F.length(text) > 0, unit).alias("unit"), F.when(F.length(found) > 0, found).alias("magnitude"))


def infer_unit(text: Column) -> Column:
    """The unit that a quote shows: basis points, then currencies, then percent."""
    return F.when(F.length(text) > 0, F.when(text.rlike(BPS), F.lit("bps")).otherwise(F.coalesce(_currency(text), F.when(text.rlike(PERCENT), F.lit("percent")))))


def normalize_quantity(raw: Column, value: Column, magnitude: Column, unit: Column) -> Column:
    """STRUCT<value, unit>: money and counts in single units, basis points as percent; both null if there is no number."""
    v = F.coalesce(F.when(~F.isnan(value), value), parse_number(raw))
    phrase = unit_phrase(unit)
    u = phrase["unit"]
    factor = scale(F.coalesce(F.when(F.length(magnitude) > 0, magnitude), phrase["magnitude"]))["factor"]
    out = F.when(u == "bps", v / 100).when(u == "percent", v).otherwise(v * factor)
    name = F.when(u.isin("bps", "percent"), F.lit("percent")).otherwise(F.coalesce(u, F.lit("count")))
    return F.struct(out.alias("value"), F.when(v.isNotNull(), name).alias("unit"))


def relative_gap(a: Column, b: Column) -> Column:
    """Difference over the larger magnitude; nought if both are nought."""
    top = F.greatest(F.abs(a), F.abs(b))
    return F.when(top == 0, F.lit(0.0)).otherwise(F.try_divide(F.abs(a - b), top))


def values_agree(a: Column, b: Column, rel: float = REL_TOLERANCE) -> Column:
    """Equal within a relative tolerance; false where a value is absent."""
    return F.coalesce((a == b) | (relative_gap(a, b) <= rel), F.lit(False))


def comparable(au: Column, av: Column, aq: Column, bu: Column, bv: Column, bq: Column) -> Column:
    """Whether two facts' quantities measure the same kind of thing (unit, value, is-a-quantity of either side).

    Facts without quantities compare with each other; quantities need both parts; a dimensioned unit only its like; the
    others are all counts.
    """
    whole = au.isNotNull() & av.isNotNull() & bu.isNotNull() & bv.isNotNull()
    alike = (au == bu) | ~(au.isin(*DIMENSIONED) | bu.isin(*DIMENSIONED))
    return F.when(~aq & ~bq, F.lit(True)).when(aq != bq, F.lit(False)).otherwise(F.coalesce(whole & alike, F.lit(False)))
