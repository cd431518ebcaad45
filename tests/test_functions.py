import pytest
from pyspark.sql import functions as F

from factweave.functions import identity, periods, quantities, text, tokens


def apply(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_parse_number(spark):
    cases = {"1,679.68": 1679.68, "(1,679.68)": -1679.68, "−12": -12.0, "-3.5": -3.5, "1,23,456": 123456.0, "1.2.3": None, "n/a": None, "": None, "Rs. 5": 0.5, "Rs. 127.5": None, "₹ 8,142": 8142.0, "12%": 12.0}
    assert apply(spark, list(cases), quantities.parse_number) == list(cases.values())
    assert apply(spark, [None], quantities.parse_number) == [None]


def test_unit_phrase(spark):
    cases = {"Indian Rupees in million": ("INR", "million"), "₹ Cr": ("INR", "cr"), "million": (None, "million"), "bps": ("bps", None), "per cent": ("percent", None), "turbines": ("turbines", None), "I": (None, None), "US$ bn": ("USD", "bn"), "": (None, None)}
    got = apply(spark, list(cases), quantities.unit_phrase)
    assert [(g.unit, g.magnitude) for g in got] == list(cases.values())


def test_infer_unit(spark):
    cases = {"grew 50 bps to 6%": "bps", "₹ 5 at 6%": "INR", "6 per cent": "percent", "84 turbines": None, "": None}
    assert apply(spark, list(cases), quantities.infer_unit) == list(cases.values())


def test_normalize_and_agree(spark):
    df = spark.createDataFrame([(0, "8,142", "crore", "INR"), (1, "81,415.38", None, "Rs. in million"), (2, "50", None, "bps"), (3, "84", None, "turbines"), (4, None, "mn", "INR"), (5, "3", "zillion", "INR million")], "i int, r string, m string, u string")
    got = [(r.q.value, r.q.unit) for r in df.select("i", quantities.normalize_quantity(F.col("r"), F.lit(None).cast("double"), F.col("m"), F.col("u")).alias("q")).orderBy("i").collect()]
    assert got[0] == (pytest.approx(8.142e10), "INR") and got[1][0] == pytest.approx(8.141538e10) and got[2] == (0.5, "percent") and got[3] == (84.0, "turbines") and got[4] == (None, None) and got[5] == (3.0, "INR")
    pairs = spark.createDataFrame([(8.142e10, 8.141538e10), (6.4, 7.8), (0.0, 0.0), (None, 1.0)], "a double, b double")
    assert [r.x for r in pairs.select(quantities.values_agree(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, True, False]


def test_tokens(spark):
    assert apply(spark, ["The Total Revenue from Operations (Net) 2", None, "ÉTÉ x"], tokens.tokenize) == [["operations", "revenue"], [], []]


def test_fiscal_years_and_periods(spark):
    years = {"FY24": 2024, "FY2023-24": 2024, "2023-24": 2024, "financial year 2024": 2024, "the year ended March 31, 2024": 2024, "FY2023/24": 2024, "Q4 FY23": 2023, "2024-12-31": 2012, "soon": None}
    assert apply(spark, list(years), periods.fiscal_year) == list(years.values())
    pairs = [("FY24", "FY2023-24", True), ("FY24", "Q4 FY24", False), ("Q1 FY24", "Q2 FY24", False), ("as of March 31, 2024", "FY24", False), ("", "", False), ("H1", "h1 ", True), ("soon", "later", False)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string").withColumns({"x": periods.period_parts(F.col("a")), "y": periods.period_parts(F.col("b"))})
    assert [r.z for r in df.select("i", periods.periods_equivalent(F.col("x"), F.col("y")).alias("z")).orderBy("i").collect()] == [p[2] for p in pairs]


def test_vintage_and_signature(spark):
    assert apply(spark, ["First advance estimate", "second advance estimate", "provisional", "n/a", None, "Revised estimate"], periods.vintage_rank) == [1, 2, 3, None, None, 4]
    got = apply(spark, ["Cash & equivalents (A+B)", "Cash (B)", "Total assets", None], identity.signature)
    assert [(g.total, g.components) for g in got] == [(True, "AB"), (False, "B"), (True, ""), (False, "")]


def test_locate(spark):
    cases = [("a b  c", "b  c", (2, 6)), ("a b\n c", "b c", (2, 6)), ("abc", "x", None), ("abc", "", None), ("abc", "  ", None), ("12.5%", "12.6%", None), (r"a \E b", r"\E  b", (2, 6)), (None, "a", None), ("a.c", "a c", None)]
    df = spark.createDataFrame([(i, t, q) for i, (t, q, _) in enumerate(cases)], "i int, t string, q string")
    got = [r.x and tuple(r.x) for r in df.select("i", text.locate(F.col("t"), F.col("q")).alias("x")).orderBy("i").collect()]
    assert got == [c[2] for c in cases]


def test_density(spark):
    rich = "Revenue of ₹ 8,142 crore was reported for FY24, and growth is estimated to be 6.4 per cent as of March 31, 2024, up from 5.2 per cent in 2023."
    plain = "The quick brown fox jumps over the lazy dog while nobody in particular looks on, and then it does so again, and again, and once more."
    scores = apply(spark, [rich, plain, "₹ 5 crore", None, "1" * 200], text.fact_density)
    assert scores[0] > 10 and scores[1] == 0 and scores[2] == 0 and scores[3] == 0 and scores[4] == 2.0


def test_grounding_quality(spark):
    cases = [("5", "it is 5", 1.0), ("7", "it is 5", 0.4), ("5", "5 5 6 7", 0.5), ("5", "5 6 7 8", 0.76), (None, "x", 1.0), ("1", "1 2 3 4 5 6 7 8 9", 0.45)]
    df = spark.createDataFrame([(i, r, q) for i, (r, q, _) in enumerate(cases)], "i int, r string, q string")
    got = [r.x.factor for r in df.select("i", text.grounding_quality(F.col("r"), F.col("q")).alias("x")).orderBy("i").collect()]
    assert got == pytest.approx([c[2] for c in cases])


def test_shown_numbers(spark):
    from factweave.operators.browse import display_value, general_number

    values = [0.0, 5.0, -5.0, 1234.0, 1234.6, 12345.6, 9999.6, 99996.0, 8.142e10, 0.5, 0.012346, 0.00001234, 123.4, -1e6, 999.96, 1e-4, 7e15, 0.1]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    assert [r.s for r in df.orderBy("i").select(general_number(F.col("v")).alias("s")).collect()] == [f"{v:,.4g}" for v in values]
    cases = [
        (8.142e10, "INR", None, "₹81,420.00 Mn"), (-2.5e6, "USD", None, "$-2.50 Mn"), (1234.5, "EUR", None, "€1,234.5"), (6.4, "percent", None, "6.4%"), (1200.0, "count", None, "1,200"),
        (135.806, "km", None, "135.81 km"), (-0.001, "km", None, "0 km"), (5.0, None, None, "5"), (None, "INR", "said", "said"), (None, None, "", "—"), (None, None, None, "—"), (float("nan"), "km", None, "—"), (1e300, "km", None, "1e+300"),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, v double, u string, t string")
    assert [r.s for r in df.orderBy("i").select(display_value(F.col("v"), F.col("u"), F.col("t")).alias("s")).collect()] == [c[3] for c in cases]
