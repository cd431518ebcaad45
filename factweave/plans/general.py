"""Queries of the general data problems: skewed keys (1), intervals (2), units (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators.intervals import periods_and_gaps
from factweave.operators.skew import heavy_keys, key_profile
from factweave.operators.units import ALIASES, CONVERSIONS, conversion_table, misstated, to_common_units, wanted_units
from factweave.plans.registry import Registry
from factweave.session import table

general = Registry()

P1_FOUND_SQL = """
SELECT metric_key, coalesce(canonical_unit, '') AS canonical_unit
FROM facts GROUP BY metric_key, coalesce(canonical_unit, '')
HAVING count(*) >= 0.05 * (SELECT count(*) FROM facts)
"""


@general.query("p1_found", P1_FOUND_SQL)
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of metric_key and canonical_unit holding at least 5 % of all rows; a null unit is the empty string."""
    facts = table(spark, sf, "facts").select("metric_key", F.coalesce("canonical_unit", F.lit("")).alias("canonical_unit"), "fact_id")
    return heavy_keys(facts, ["metric_key", "canonical_unit"], "fact_id", 0.05).select("metric_key", "canonical_unit")


P1_PROFILE_SQL = """
SELECT metric_key, canonical_unit, count(*) AS n, count(canonical_value) AS n_values,
       round(median(canonical_value), 4) AS median_value,
       max({'t': ingested_at, 'i': fact_id}).i AS latest_id
FROM facts GROUP BY metric_key, canonical_unit
"""


@general.query("p1_key_profile", P1_PROFILE_SQL)
def p1_key_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, exact median and latest fact of every (metric_key, canonical_unit)."""
    facts = table(spark, sf, "facts").select("metric_key", "canonical_unit", "canonical_value", "ingested_at", "fact_id")
    out = key_profile(facts, ["metric_key", "canonical_unit"], "canonical_value", "ingested_at", "fact_id")
    return out.withColumn("median_value", F.round("median_value", 4))


def _duck_day(c: str) -> str:
    t = f"lower(regexp_replace({c}, '^[\\s\\x{{00A0}}\\x{{202F}}]+|[\\s\\x{{00A0}}\\x{{202F}}]+$', '', 'g'))"
    iso = r"^(\d{4})([-/.])(\d{1,2})([-/.])(\d{1,2})([t ]\d{2}:\d{2}.*)?$"
    named, mon = r"^(\d{1,2})[\s\-./]*([a-z]{3})[a-z]*[\s\-.,/]*(\d{4})$", r"^([a-z]{3})[a-z]*[\s\-.]*(\d{1,2})[\s,\-]+(\d{4})$"
    either = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$"
    g = lambda p, i: f"regexp_extract({t}, '{p}', {i})"
    day = lambda y, m, d: f"strftime(try_strptime({y} || '-' || {m} || '-' || {d}, '%Y-%m-%d'), '%Y-%m-%d')"
    number = lambda m: f"(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], {m})::VARCHAR)"
    a, b = day(g(either, 3), g(either, 2), g(either, 1)), day(g(either, 3), g(either, 1), g(either, 2))
    dotted = r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$"
    return f"""CASE WHEN regexp_matches({t}, '{iso}') THEN {day(g(iso, 1), g(iso, 3), g(iso, 5))}
      WHEN regexp_matches({t}, '^\\d{{8}}$') THEN {day(f"{t}[1:4]", f"{t}[5:6]", f"{t}[7:8]")}
      WHEN regexp_matches({t}, '{dotted}') THEN {day(g(dotted, 3), g(dotted, 2), g(dotted, 1))}
      WHEN regexp_matches({t}, '{named}') THEN {day(g(named, 3), number(g(named, 2)), g(named, 1))}
      WHEN regexp_matches({t}, '{mon}') THEN {day(g(mon, 3), number(g(mon, 1)), g(mon, 2))}
      WHEN regexp_matches({t}, '{either}') THEN CASE WHEN {a} IS NULL OR {b} IS NULL OR {a} = {b} THEN coalesce({a}, {b}) END END"""


def _duck_absent(c: str) -> str:
    return f"({c} IS NULL OR lower(trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) IN ('', 'n/a', 'unknown', 'none', 'null'))"


P2_FOUND_SQL = f"""
WITH d AS (SELECT subject_key, {_duck_absent("valid_from")} AS fa, {_duck_absent("valid_to")} AS ta,
                  {_duck_day("valid_from")} AS f, {_duck_day("valid_to")} AS t FROM facts),
i AS (SELECT subject_key, CASE WHEN fa THEN '0001-01-01' ELSE f END AS a, CASE WHEN ta THEN '9999-12-31' ELSE t END AS b
      FROM d WHERE NOT (fa AND ta)),
v AS (SELECT DISTINCT subject_key, a, b FROM i WHERE a IS NOT NULL AND b IS NOT NULL AND b > a),
m AS (SELECT *, max(b) OVER (PARTITION BY subject_key ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY subject_key ORDER BY a, b) AS grp FROM m),
p AS (SELECT subject_key, grp, min(a) AS a, max(b) AS b FROM g GROUP BY subject_key, grp)
SELECT subject_key, 'period' AS span_kind, a AS span_from, b AS span_to FROM p
UNION ALL
SELECT subject_key, 'gap', b, nxt FROM (SELECT subject_key, b, lead(a) OVER (PARTITION BY subject_key ORDER BY grp) AS nxt FROM p) WHERE nxt IS NOT NULL
"""


@general.query("p2_found", P2_FOUND_SQL)
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Continuous periods of each subject_key and the gaps between neighbouring ones."""
    return periods_and_gaps(table(spark, sf, "facts"), "subject_key", "valid_from", "valid_to")


def _quantities(spark: SparkSession, sf: str) -> DataFrame:
    facts = table(spark, sf, "facts").where("quantity IS NOT NULL")
    parts = facts.select("fact_id", "metric", F.col("quantity.raw").alias("raw"), F.col("quantity.magnitude").alias("magnitude"), F.col("quantity.unit").alias("unit"), F.col("evidence.quote").alias("quote"), "canonical_value", "canonical_unit")
    return to_common_units(parts, table(spark, sf, "common_units"), "raw", "magnitude", "unit", "quote", "metric")


@general.query("p5_found")
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Facts whose readable quantity has an absent or wrong stored canonical pair."""
    return _quantities(spark, sf).where(misstated("canonical_value", "canonical_unit")).select("fact_id").distinct()


@general.query("p5_values")
def p5_values(spark: SparkSession, sf: str) -> DataFrame:
    """Every readable quantity in its common unit."""
    return _quantities(spark, sf).where("common_unit IS NOT NULL").select("fact_id", "common_value", "common_unit").distinct()


P5_CONVERSIONS_SQL = f"""
WITH RECURSIVE edges(s, t, a, b) AS (VALUES {", ".join(f"('{s}', '{t}', {a!r}::DOUBLE, {b!r}::DOUBLE)" for s, t, a, b in CONVERSIONS)}),
steps AS (SELECT * FROM edges UNION ALL SELECT t, s, 1 / a, -b / a FROM edges),
units AS (SELECT s AS u FROM steps UNION SELECT unnest([{", ".join(f"'{u}'" for u in ALIASES)}])),
walk(s, t, a, b, n) AS (SELECT u, u, 1.0::DOUBLE, 0.0::DOUBLE, 0 FROM units
  UNION SELECT w.s, e.t, e.a * w.a, e.a * w.b + e.b, w.n + 1 FROM walk w JOIN steps e ON e.s = w.t WHERE w.n < 6 AND e.t <> w.s)
SELECT s AS source_unit, t AS common_unit, round(arg_min(a, n), 12) AS scale, round(arg_min(b, n), 9) AS "offset"
FROM walk JOIN (SELECT DISTINCT common_unit FROM common_units) ON common_unit = t GROUP BY s, t
"""


@general.query("p5_conversions", P5_CONVERSIONS_SQL)
def p5_conversions(spark: SparkSession, sf: str) -> DataFrame:
    """The shortest compositions from every unit to the common units that it reaches."""
    out = conversion_table(spark, wanted_units(table(spark, sf, "common_units")))
    return out.select("source_unit", "common_unit", F.round("scale", 12).alias("scale"), F.round("offset", 9).alias("offset"))
