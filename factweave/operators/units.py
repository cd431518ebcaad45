"""Quantities in common units.

Conversions are edges of a graph: an affine function (scale, offset) from one unit to another. The driver
composes them along shortest paths from every unit to every common unit it can reach, checks that all cycles
agree, and the result is a small fixed table. On the data a quantity's parts are read with built-in
expressions, its unit's spelling brings the source unit and the canonical target that this unit is stated in, and
an equi-join on (source unit, canonical target) brings scale and offset. Both tables are built from the constants below,
never from data, so their size is fixed.
"""

from __future__ import annotations

import re
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: source unit -> target unit, value_target = scale * value_source + offset.
CONVERSIONS: tuple[tuple[str, str, float, float], ...] = (
    ("basis_point", "percent", 0.01, 0.0),
    ("per_mille", "percent", 0.1, 0.0),
    ("basis_point", "per_mille", 0.1, 0.0),
    ("gram", "kilogram", 0.001, 0.0),
    ("kilogram", "tonne", 0.001, 0.0),
    ("kilogram", "quintal", 0.01, 0.0),
    ("quintal", "tonne", 0.1, 0.0),
    ("kilotonne", "tonne", 1000.0, 0.0),
    ("watt_hour", "kWh", 0.001, 0.0),
    ("MWh", "kWh", 1000.0, 0.0),
    ("GWh", "MWh", 1000.0, 0.0),
    ("TWh", "GWh", 1000.0, 0.0),
    ("centimetre", "metre", 0.01, 0.0),
    ("metre", "km", 0.001, 0.0),
    ("foot", "metre", 0.3048, 0.0),
    ("mile", "foot", 5280.0, 0.0),
    ("mile", "km", 1.609344, 0.0),
    ("second", "minute", 1 / 60, 0.0),
    ("minute", "hour", 1 / 60, 0.0),
    ("hour", "day", 1 / 24, 0.0),
    ("week", "day", 7.0, 0.0),
    ("fahrenheit", "celsius", 5 / 9, -160 / 9),
    ("celsius", "kelvin", 1.0, 273.15),
)

#: Spellings of each unit, lower case, without dots.
ALIASES: dict[str, tuple[str, ...]] = {
    "INR": ("₹", "rs", "inr", "indian rupees", "indian rupee", "rupees", "rupee"),
    "USD": ("us$", "$", "usd", "us dollars", "us dollar", "dollars", "dollar"),
    "EUR": ("€", "eur", "euros", "euro"),
    "GBP": ("£", "gbp", "pounds sterling", "pound sterling", "pounds"),
    "percent": ("%", "percent", "per cent", "pct", "percentage", "percentage points"),
    "basis_point": ("basis points", "basis point", "bps", "bp"),
    "per_mille": ("‰", "per mille"),
    "tonne": ("tonnes", "tonne", "metric tonnes", "metric tons"),
    "kilogram": ("kilograms", "kilogram", "kgs", "kg"),
    "gram": ("grams", "gram"),
    "quintal": ("quintals", "quintal"),
    "kilotonne": ("kilotonnes", "kilotonne", "kt"),
    "kWh": ("kwh", "kilowatt hours", "kilowatt-hours", "kilowatt hour", "kilowatt-hour"),
    "watt_hour": ("watt hours", "watt-hours", "wh"),
    "MWh": ("mwh", "megawatt hours", "megawatt-hours"),
    "GWh": ("gwh", "gigawatt hours", "gigawatt-hours"),
    "TWh": ("twh", "terawatt hours", "terawatt-hours"),
    "km": ("km", "kms", "kilometres", "kilometre", "kilometers", "kilometer"),
    "metre": ("metres", "metre", "meters", "meter"),
    "centimetre": ("centimetres", "cm"),
    "mile": ("miles", "mile"),
    "foot": ("feet", "foot"),
    "day": ("days", "day(s)", "day"),
    "hour": ("hours", "hour", "hrs", "hr"),
    "minute": ("minutes", "minute", "mins"),
    "week": ("weeks", "week"),
    "celsius": ("degrees celsius", "celsius", "°c"),
    "fahrenheit": ("degrees fahrenheit", "fahrenheit", "°f"),
    "kelvin": ("kelvin",),
    "count": ("count", "number", "nos", "units"),
}

#: Words of scale and their factors.
MAGNITUDES: dict[str, float] = {
    "thousands": 1e3, "thousand": 1e3, "'000": 1e3, "000s": 1e3,
    "lakhs": 1e5, "lakh": 1e5, "lacs": 1e5, "lac": 1e5,
    "millions": 1e6, "million": 1e6, "mn": 1e6, "mio": 1e6,
    "crores": 1e7, "crore": 1e7, "cr": 1e7,
    "billions": 1e9, "billion": 1e9, "bn": 1e9,
    "trillions": 1e12, "trillion": 1e12, "tn": 1e12,
}


class InconsistentUnits(ValueError):
    """Two ways round the conversion graph state different factors."""


def compositions(edges=CONVERSIONS, targets: tuple[str, ...] | None = None, tolerance: float = 1e-9) -> list[tuple[str, str, float, float, int]]:
    """(source, target, scale, offset, steps) of the shortest composition between any two linked units.

    Edges are used in both directions. Every edge is then held against the composition found between its
    ends; a difference beyond ``tolerance`` raises ``InconsistentUnits``, and so does a scale of nought.
    """
    graph: dict[str, list[tuple[str, float, float]]] = {}
    for s, t, a, b in edges:
        if a == 0:
            raise InconsistentUnits(f"{s} -> {t} has no inverse")
        graph.setdefault(s, []).append((t, a, b))
        graph.setdefault(t, []).append((s, 1 / a, -b / a))
    for t in targets or ():
        graph.setdefault(t, [])
    out, found = [], {}
    for source in graph:
        reach = {source: (1.0, 0.0, 0)}
        queue = deque([source])
        while queue:
            u = queue.popleft()
            a, b, n = reach[u]
            for v, c, d in graph[u]:
                if v not in reach:
                    reach[v] = (c * a, c * b + d, n + 1)
                    queue.append(v)
        found[source] = reach
    for source, reach in found.items():
        for u, (a, b, _) in reach.items():
            for v, c, d in graph[u]:
                x, y, _ = reach[v]
                if abs(c * a - x) > tolerance * abs(x) or abs(c * b + d - y) > tolerance * max(1.0, abs(y)):
                    raise InconsistentUnits(f"{source} -> {u} -> {v} differs from the shortest composition")
        out += [(source, t, a, b, n) for t, (a, b, n) in reach.items() if targets is None or t in targets]
    return out


def _alternatives(words) -> str:
    """The words as a pattern, longest first; a letter may not follow or precede a word that ends in one.

    Words of one first letter stand together: at any place only those can match, and the others cost one look.
    """
    by_first: dict[str, list[str]] = {}
    for w in sorted(words, key=len, reverse=True):
        by_first.setdefault(w[0], []).append(re.escape(w[1:]).replace(r"\ ", r"\s+") + (r"(?![a-z])" if w[-1].isalpha() else ""))
    parts = [re.escape(c) + "(?:" + "|".join(rest) + ")" for c, rest in by_first.items()]
    letters = [p for c, p in zip(by_first, parts) if c.isalpha()]
    others = [p for c, p in zip(by_first, parts) if not c.isalpha()]
    return "|".join([r"(?<![a-z])(?:" + "|".join(letters) + ")", *others])


_UNITS = [a for names in ALIASES.values() for a in names]
_MAG = _alternatives(MAGNITUDES)
_UNIT = _alternatives(_UNITS)
_MONEY = _alternatives(a for u in ("INR", "USD", "EUR", "GBP") for a in ALIASES[u])
#: What a unit before a value can take up: the longest spelling, a dot, a sign, two blanks, and the letter that may not stand before it.
_REACH = max(map(len, _UNITS)) + 5
#: Stand for the value, for the measure's words and for the place of the value, in a quote whose own text never holds them.
_VALUE, _MEASURE, _HERE = "\x01", "\x02", "\x03"
_AFTER = _VALUE + rf"(?![\d{_VALUE}]|[.,][\d{_VALUE}])"


def _lookup(key: Column, table: dict[str, float]) -> Column:
    return F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in table.items()])


def _some(c: Column) -> Column:
    return F.when(c != "", c)


def _tidy(c: Column) -> Column:
    """Lower case, one plain space for any run of white space and control characters; null stays null."""
    odd = r"[\x00-\x1f\x7f-\xa0     ]|  "
    return F.lower(F.trim(F.when(c.rlike(odd), F.regexp_replace(c, r"[\s\x00-\x1f\x7f-\xa0     ]+", " ")).otherwise(c)))


def _number_text(raw: Column) -> Column:
    """A printed value without group marks that are spaces and without ``'000``."""
    return F.regexp_replace(F.regexp_replace(raw, r"(?<!\d)['’]000s?", ""), r"(?<=\d)[    '’](?=\d{3}(?!\d))", "")


_NUMBERS, _NEGATIVE = r"(\d[\d.,]*)", r"[(][^)]*\d[^)]*[)]|(?:^|[^\d\w])[-−–]\s*[^\d\w]{0,3}\s*\d|^[^\d]*[-−–][^\d]*\d"


def _only(numbers: Column) -> Column:
    """The one number found, without group marks; null if there are several or none."""
    return F.when(F.size(numbers) == 1, F.regexp_replace(F.regexp_replace(numbers[0], r"[.,]+$", ""), ",", ""))


def _signed(one: Column, t: Column) -> Column:
    return F.when(~one.rlike(r"\..*\."), one.try_cast("double")) * F.when(t.rlike(_NEGATIVE), -1.0).otherwise(1.0)


def read_number(raw: Column) -> Column:
    """The one number of a printed value, signed, or null.

    Groups may be set off by commas, thin or no-break spaces or plain ones; brackets round the number or a leading minus of either
    kind make it negative. More than one number, more than one decimal point, or none is null.
    """
    t = _number_text(raw)
    return _signed(_only(F.regexp_extract_all(t, F.lit(_NUMBERS), F.lit(1))), t)


def _placed(quote: Column, raw: Column, measure: Column | None) -> Column:
    """The quote with ``_HERE`` in place of the value, or without it where it does not hold the value.

    The value must stand by itself: no longer number, no fiscal year or quarter of the same digits. Where the measure's own words come
    right before a value ("... of ₹ 5"), that is the place. The value is put in as one character first, so that the patterns are
    the same for all rows and are made ready once.
    """
    valued = F.replace(quote, raw, F.lit(_VALUE))
    if measure is not None:
        lead = rf"(?s)^(.*?{_MEASURE} of [^\d\s{_VALUE}]{{0,4}} ?[^\d\s{_VALUE}]{{0,2}}){_AFTER}(.*)$"
        led = F.regexp_replace(F.replace(F.replace(quote, measure, F.lit(_MEASURE)), raw, F.lit(_VALUE)), lead, f"$1{_HERE}$2")
        leads = F.contains(quote, F.concat(measure, F.lit(" of "))) & (F.length(measure) > 0)
        valued = F.when(leads, F.replace(led, F.lit(_MEASURE), measure)).otherwise(valued)
    first = rf"(?s)^([^{_HERE}]*?)(?={_VALUE})(?<![\d{_VALUE}])(?<![\d{_VALUE}][.,])(?<!\b(?:fy|q|h)){_AFTER}([^{_HERE}]*)$"
    whole = F.replace(F.regexp_replace(valued, first, f"$1{_HERE}$2"), F.lit(_VALUE), raw)
    return F.when((F.length(raw) > 0) & F.contains(quote, raw), whole).otherwise(F.lit(""))


def read_quantity(df: DataFrame, raw: str, magnitude: str, unit: str, quote: str, measure: str | None = None) -> DataFrame:
    """Adds ``__q_number``, ``__q_factor`` and ``__q_alias`` (a spelling in ``ALIASES``, or "").

    What stands closest to the value counts first: its own fields, then the printed value itself, then the
    quote right before and after the value, then a note in the quote such as ``(₹ in crores)`` or
    ``amounts in millions of INR:``.
    Nouns that are no unit of measure (``gateways``) are things counted. The quote is read as a whole. The steps are columns of
    their own, so that none is worked out once for each use.
    """
    col, kept = F.col, df.columns
    df = df.withColumns({"__raw": _tidy(col(raw)), "__mag": F.regexp_replace(_tidy(col(magnitude)), r"\.$", ""), "__unit": _tidy(col(unit)), "__quote": _tidy(col(quote)), "__measure": _tidy(col(measure)) if measure is not None else F.lit("")})
    note = r"(?:[(\[]|amounts )([^()\[\]:\d]*(?:" + _MAG + "|" + _MONEY + r")[^()\[\]:\d]*)[)\]:]"
    df = df.withColumns(
        {
            "__t": _number_text(col("__raw")),
            "__in": F.split(_placed(col("__quote"), col("__raw"), col("__measure") if measure is not None else None), _HERE),
            "__head": F.when(col("__quote").rlike(r"[(\[]|amounts "), F.regexp_extract(F.replace(col("__quote"), F.lit("'000"), F.lit("thousand")), note, 1)).otherwise(F.lit("")),
        }
    )
    df = df.withColumns({"__numbers": F.regexp_extract_all("__t", F.lit(_NUMBERS), F.lit(1)), "__after": F.try_element_at("__in", F.lit(2)), "__before": F.when(F.size("__in") > 1, col("__in")[0])})
    # the unit right before the value, and scale and unit right after it
    lead = r"(" + _UNIT + r")\.?\s*[(−–-]?\s*$"
    tail = r"(?s)^[\s)]*(?:(" + _MAG + r")\.?)?\s*(" + _UNIT + r")?.*$"
    word = lambda c, p: F.regexp_extract(col(c), "(" + p + ")", 1)
    df = df.withColumns(
        {
            "__one": _only(col("__numbers")),
            "__tail": F.split(F.regexp_replace("__after", tail, f"$1{_HERE}$2"), _HERE),
            "__m_unit": word("__unit", _MAG),
            "__m_raw": word("__raw", _MAG),
            "__m_head": word("__head", _MAG),
            "__u_unit": F.when(~col("__unit").isin("count", "units", "number", "nos"), word("__unit", _UNIT)),
            "__u_raw": word("__raw", _UNIT),
            "__u_before": F.regexp_extract(F.substring(col("__before"), -_REACH, _REACH), lead, 1),
            "__u_head": word("__head", _UNIT),
        }
    )
    noun = F.when(F.length(F.regexp_replace(F.regexp_replace(col("__unit"), "(" + _MAG + r")\.?|\bin\b|[().]", ""), r"\s+", "")) > 1, F.lit("count"))
    thing = F.when(col("__after").rlike(r"^[\s)]*(?:(?:" + _MAG + r")\.?)?\s*[a-z]"), F.lit("count"))
    df = df.withColumns(
        {
            "__q_number": _signed(col("__one"), col("__t")),
            "__scale": F.coalesce(*[_some(c) for c in (col("__mag"), col("__m_unit"), col("__m_raw"), col("__tail")[0], col("__m_head"))]),
            "__word": F.coalesce(_some(col("__u_unit")), _some(col("__u_raw")), noun, _some(col("__u_before")), _some(F.try_element_at("__tail", F.lit(2))), _some(col("__u_head")), thing, F.lit("")),
        }
    )
    return df.select(*kept, "__q_number", F.coalesce(_lookup(col("__scale"), MAGNITUDES), F.lit(1.0)).alias("__q_factor"), F.regexp_replace("__word", r"\s+", " ").alias("__q_alias"))


def canonical_targets(wanted: list[str], edges=CONVERSIONS) -> list[tuple[str, str, str]]:
    """(alias, source unit, canonical target) of every spelling whose unit reaches one of the wanted units.

    Units that convert into each other are one dimension and are all stated in one unit; where several of a dimension are wanted it is
    the first of them by name.
    """
    target: dict[str, str] = {}
    for s, t, _, _, _ in compositions(edges, tuple(ALIASES)):
        if t in wanted:
            target[s] = min(t, target.get(s, t))
    return [(alias, s, t) for s, t in target.items() for alias in ALIASES.get(s, ())]


def wanted_units(targets: DataFrame, edges=CONVERSIONS) -> list[str]:
    """The units named by a table of common units, those that the graph knows (a bounded list whatever the table)."""
    known = {t for e in compositions(edges, tuple(ALIASES)) for t in e[:2]}
    return [r["common_unit"] for r in targets.where(F.col("common_unit").isin(*sorted(known))).select("common_unit").distinct().collect()]


def conversion_table(spark, wanted: list[str], edges=CONVERSIONS) -> DataFrame:
    """(source_unit, common_unit, scale, offset): the shortest composition from every unit to each wanted unit that it reaches."""
    rows = [(s, t, a, b) for s, t, a, b, _ in compositions(edges, tuple(ALIASES)) if t in wanted]
    return spark.createDataFrame(rows, "source_unit string, common_unit string, scale double, offset double")


def to_common_units(df: DataFrame, targets: DataFrame, raw: str, magnitude: str, unit: str, quote: str, measure: str | None = None, edges=CONVERSIONS) -> DataFrame:
    """``df`` with ``common_value`` and ``common_unit``; both null where the value or its unit can't be read.

    The unit's spelling brings source unit and canonical target, an equi-join on both brings the conversion, so a row comes out once whatever the
    targets. Both tables have a few hundred rows at most (the constants above), which is why they may be broadcast.
    A null in any part counts as absent, repeated rows stay, extra columns are kept whatever their
    names (but former ``common_value`` and ``common_unit`` are replaced), an empty table stays empty.
    """
    spark, wanted = df.sparkSession, wanted_units(targets, edges)
    kept = [c for c in df.columns if c not in ("common_value", "common_unit")]
    read = read_quantity(df.select(*kept), raw, magnitude, unit, quote, measure)
    named = spark.createDataFrame(canonical_targets(wanted, edges), "__alias string, __unit string, __to string")
    conversions = conversion_table(spark, wanted, edges).toDF("__source", "__target", "__scale", "__offset")
    placed = read.join(F.broadcast(named), F.col("__q_alias") == F.col("__alias"), "left")
    joined = placed.join(F.broadcast(conversions), (F.col("__unit") == F.col("__source")) & (F.col("__to") == F.col("__target")), "left")
    value = F.col("__q_number") * F.col("__q_factor") * F.col("__scale") + F.col("__offset")
    return joined.select(*kept, value.alias("common_value"), F.when(value.isNotNull(), F.col("__to")).alias("common_unit"))


def misstated(value: str, unit: str, tolerance: float = 0.005) -> Column:
    """True where a readable quantity's stored pair is absent, in another unit, or off by more than ``tolerance``."""
    v, u = F.col(value), F.col(unit)
    t = F.col("common_value")
    off = F.abs(v - t) > F.abs(t) * F.lit(tolerance) * F.lit(1 + 1e-9)
    return F.col("common_unit").isNotNull() & (v.isNull() | F.isnan(v) | u.isNull() | (F.trim(u) != F.col("common_unit")) | off)
