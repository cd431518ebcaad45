import pytest
from pyspark.sql import functions as F

from factweave.operators.units import CONVERSIONS, InconsistentUnits, canonical_targets, compositions, misstated, read_number, to_common_units

COLS = "i int, raw string, magnitude string, unit string, quote string, canonical_value double, canonical_unit string, scale string"
TARGETS = ["INR", "USD", "EUR", "GBP", "percent", "count", "tonne", "kWh", "km", "day"]
CASES = [
    ("47.68", "lakhs", None, "revenue of INR 47.68 lakhs for 2021", 4768000.0, "INR"),
    ("687", None, None, "growth of 687 bp for FY2022", 6.87, "percent"),
    ("20,435.0", "cr.", "Indian Rupees", "total .... 20,435.0", 204350000000.0, "INR"),
    ("₹−52204.35 lakhs", None, None, "was ₹−52204.35 lakhs", -5220435000.0, "INR"),
    ("(17.7)", None, "%", "growth (17.7)%", -17.7, "percent"),
    ("1 438.2", None, None, "came to Rs.1 438.2 cr.; other", 14382000000.0, "INR"),
    ("16.9", None, "hours", "period was 16.9 hours", 16.9 / 24, "day"),
    ("11,156", None, "US dollars '000", "revenue 11,156 6,049.5", 11156000.0, "USD"),
    ("35", None, None, "profit (all figures in Rs. lakhs) 35 269.3", 3500000.0, "INR"),
    ("645.3", None, None, "Amounts in million of US$: rev. 645.3, other 2", 645300000.0, "USD"),
    ("19,723", None, "gateways", "gateways 19,723 15.4", 19723.0, "count"),
    ("2.68", "Lakhs", "MWh", "2.68 Lakhs MWh", 268000000.0, "kWh"),
    ("10,777", None, "quintals", "procurement 10,777", 1077.7, "tonne"),
    ("135.8", None, None, "length of 135.8 km for 2020", 135.8, "km"),
    ("1.234.567", None, "INR", "x 1.234.567", None, None),
    ("see notes", "Mn", "EUR", "see notes", None, None),
    (None, None, None, None, None, None),
    ("", "mn", "Rs", "", None, None),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, COLS), spark.createDataFrame([(t,) for t in TARGETS], "common_unit string")


def test_cases(spark):
    facts, targets = frame(spark, [(i, *c[:4], c[4], c[5], "keep") for i, c in enumerate(CASES)])
    got = {r.i: r for r in to_common_units(facts.withColumns({"alias": F.lit("a"), "offset": F.lit(9.0), "common_unit": F.lit("old"), "source_unit": F.lit("s")}), targets, "raw", "magnitude", "unit", "quote").withColumn("bad", misstated("canonical_value", "canonical_unit")).collect()}
    assert len(got) == len(CASES)
    for i, c in enumerate(CASES):
        assert got[i].common_unit == c[5], c
        assert got[i].common_value == (pytest.approx(c[4]) if c[4] is not None else None), c
        assert not got[i].bad, c
        assert (got[i].alias, got[i].offset, got[i].scale) == ("a", 9.0, "keep")


def test_misstated(spark):
    rows = [(0, "5", "mn", "Rs", "Rs 5 mn", None, "INR"), (1, "5", "mn", "Rs", "Rs 5 mn", 5e6, None), (2, "5", "mn", "Rs", "Rs 5 mn", 5e6, "USD"), (3, "5", "mn", "Rs", "Rs 5 mn", 5.024e6, "INR"), (4, "5", "mn", "Rs", "Rs 5 mn", 5.03e6, "INR"), (5, "0", None, "Rs", "Rs 0", 0.0, "INR"), (6, "n.m.", None, "Rs", "", None, None), (7, "5", "mn", "Rs", "Rs 5 mn", float("nan"), "INR")]
    facts, targets = frame(spark, [(*r, None) for r in rows])
    bad = {r.i for r in to_common_units(facts.drop("scale"), targets, "raw", "magnitude", "unit", "quote").where(misstated("canonical_value", "canonical_unit")).collect()}
    assert bad == {0, 1, 2, 4, 7}


def test_numbers(spark):
    cases = [("1,23,456.78", 123456.78), ("-5", -5.0), ("− 5", -5.0), ("Rs.3 747.11", 3747.11), ("3 days, 4 weeks", None), ("**", None), ("2.1.", 2.1), ("7'000", 7000.0), ("12 '000", 12.0)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    assert [r.v for r in df.select("i", read_number(F.col("t")).alias("v")).orderBy("i").collect()] == [c[1] for c in cases]


def test_graph():
    found = {(s, t): (a, b, n) for s, t, a, b, n in compositions()}
    assert found["mile", "km"][0] == pytest.approx(1.609344) and found["gram", "tonne"][0] == pytest.approx(1e-6)
    assert ("mile", "tonne") not in found
    a, b, _ = {(s, t): (x, y, n) for s, t, x, y, n in compositions((("F", "C", 5 / 9, -160 / 9), ("C", "K", 1.0, 273.15)))}["F", "K"]
    assert a * 212 + b == pytest.approx(373.15)
    with pytest.raises(InconsistentUnits):
        compositions((*CONVERSIONS, ("kilotonne", "kilogram", 1000.0, 0.0)))
    with pytest.raises(InconsistentUnits):
        compositions((("a", "b", 0.0, 1.0),))


def test_empty(spark):
    facts, targets = frame(spark, [])
    assert to_common_units(facts.drop("scale"), targets, "raw", "magnitude", "unit", "quote").count() == 0


def test_one_row_whatever_the_targets(spark):
    facts, _ = frame(spark, [(1, "5", None, "bps", "5 bps", None, None, None), (2, "5", None, "kelvin", "5 kelvin", None, None, None)])
    targets = spark.createDataFrame([("per_mille",), ("percent",), ("percent",), (None,), ("furlong",)], "common_unit string")
    got = to_common_units(facts.drop("scale"), targets, "raw", "magnitude", "unit", "quote").collect()
    assert sorted((r.i, r.common_value, r.common_unit) for r in got if r.common_unit) == [(1, pytest.approx(0.5), "per_mille")] and len(got) == 2
    assert {t for _, _, t in canonical_targets(["percent", "per_mille"])} == {"per_mille"}


def test_an_offset(spark):
    facts, _ = frame(spark, [(1, "212", None, "°F", "212 °F", None, None, None), (2, "−40", None, "degrees Fahrenheit", "", None, None, None), (3, "100", None, None, "at 100 °C today", None, None, None)])
    targets = spark.createDataFrame([("kelvin",)], "common_unit string")
    got = {r.i: r.common_value for r in to_common_units(facts.drop("scale"), targets, "raw", "magnitude", "unit", "quote").collect()}
    assert got == {1: pytest.approx(373.15), 2: pytest.approx(233.15), 3: pytest.approx(373.15)}


def test_the_place_of_the_value(spark):
    far = " and so on" * 40
    rows = [("5", "FY25 15 5.5 0.5 5,000 (5 lakh tonnes)" + far, 5e5, "tonne"), ("5", "FY5 Q5", 5.0, None), ("5", "55 5 km", 5.0, "km"), ("2.5", "ticket size 2.5 hours; ticket size of Rs 2.5 crore", 2.5e7, "INR"), ("2.5", "2.5 hours; ticket size of ₹ 2.5 cr", 2.5e7, "INR"), ("5", far + " ₹ ( 5" + far, 5.0, "INR"), ("a\\E", "a\\E km", None, None), ("$1", "$1 \x01 \x03 mn", 1e6, "USD")]
    facts = spark.createDataFrame([(i, r, None, None, q, "Ticket size") for i, (r, q, _, _) in enumerate(rows)], "i int, raw string, magnitude string, unit string, quote string, m string")
    got = {r.i: (r.common_value, r.common_unit) for r in to_common_units(facts, spark.createDataFrame([(t,) for t in TARGETS], "common_unit string"), "raw", "magnitude", "unit", "quote", "m").collect()}
    for i, (_, q, v, u) in enumerate(rows):
        assert got[i] == ((pytest.approx(v), u) if u else (None, None)), q
