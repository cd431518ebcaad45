import random

import pytest
from pyspark.sql import functions as F

from factweave.functions.dates import parse_day
from factweave.operators.intervals import periods_and_gaps

DAYS = [
    ("2019-03-07", "2019-03-07"), (" 2019-03-07 ", "2019-03-07"), ("2019-03-07T00:00:00", "2019-03-07"), ("2019/03/07", "2019-03-07"),
    ("20190307", "2019-03-07"), ("07.03.2019", "2019-03-07"), ("7 Mar 2019", "2019-03-07"), ("07-Mar-2019", "2019-03-07"),
    ("March 7, 2019", "2019-03-07"), ("Sept 7, 2019", "2019-09-07"), ("25/12/2019", "2019-12-25"), ("12/25/2019", "2019-12-25"), ("05/05/2019", "2019-05-05"),
    ("03/04/2019", None), ("2019-02-30", None), ("2020-02-29", "2020-02-29"), ("2019-02-29", None), ("mid-2018", None), ("FY19", None),
    ("TBC", None), ("00-00-0000", None), ("0000-01-01", None), ("0001-01-01", "0001-01-01"), ("9999-12-31", "9999-12-31"), ("", None), (None, None), ("x" * 5000, None),
]


@pytest.mark.parametrize("i", range(1))
def test_parse_day(spark, i):
    df = spark.createDataFrame(list(enumerate(d for d, _ in DAYS)), "i int, d string")
    got = [r.x for r in df.select("i", parse_day(F.col("d")).alias("x")).orderBy("i").collect()]
    assert list(zip((d for d, _ in DAYS), got)) == DAYS


def spans(spark, rows):
    df = spark.createDataFrame(rows, "subject_key string, valid_from string, valid_to string, span_kind string")
    return sorted(tuple(r) for r in periods_and_gaps(df, "subject_key", "valid_from", "valid_to").collect())


def test_merge_touch_nest_and_gap(spark):
    rows = [("a", "2020-01-01", "2020-02-01", "x"), ("a", "2020-02-01", "2020-03-01", "x"), ("a", "2020-01-10", "2020-01-12", None), ("a", "2020-05-01", "2020-06-01", "x"), ("a", "2020-05-01", "2020-06-01", "x")]
    assert spans(spark, rows) == [("a", "gap", "2020-03-01", "2020-05-01"), ("a", "period", "2020-01-01", "2020-03-01"), ("a", "period", "2020-05-01", "2020-06-01")]


def test_absent_ends_and_bad_rows(spark):
    rows = [("a", None, "2020-01-01", "x"), ("a", "2021-01-01", "n/a", "x"), ("b", "unknown", "None", "x"), ("b", "FY19", "2020-01-01", "x"), ("b", "2020-01-02", "2020-01-02", "x"), ("", "2020-01-01", "2020-01-03", "x"), (None, "2020-01-01", "2020-01-02", "x")]
    got = spans(spark, [r for r in rows if r[0] is not None])
    assert got == [("", "period", "2020-01-01", "2020-01-03"), ("a", "gap", "2020-01-01", "2021-01-01"), ("a", "period", "0001-01-01", "2020-01-01"), ("a", "period", "2021-01-01", "9999-12-31")]
    df = spark.createDataFrame(rows, "subject_key string, valid_from string, valid_to string, span_kind string")
    assert periods_and_gaps(df, "subject_key", "valid_from", "valid_to").where("subject_key IS NULL").count() == 1


def test_against_day_sets(spark):
    random.seed(5)
    rows, cover = [], {}
    for _ in range(300):
        k, a = random.choice("xyz"), random.randint(1, 300)
        b = a + random.randint(1, 6)
        rows.append((k, f"{1000 + a:04d}-01-01", f"{1000 + b:04d}-01-01", None))
        cover.setdefault(k, set()).update(range(a, b))
    want = []
    for k, days in cover.items():
        ordered = sorted(days)
        starts = [d for d in ordered if d - 1 not in days]
        ends = [d + 1 for d in ordered if d + 1 not in days]
        y = lambda d: f"{1000 + d:04d}-01-01"
        want += [(k, "period", y(s), y(e)) for s, e in zip(starts, ends)] + [(k, "gap", y(e), y(s)) for e, s in zip(ends, starts[1:])]
    assert spans(spark, rows) == sorted(want)


def test_empty(spark):
    assert spans(spark, []) == []
