from datetime import datetime

import pytest

from factweave.operators.dedupe import latest_facts
from factweave.operators.pairs import candidate_ids, candidate_pairs, features
from factweave.operators.verdicts import judge
from factweave.schema import FACT

T0 = datetime(2024, 1, 1)


def fact(i, subject="Acme Widgets", metric="revenue from operations", value=8.1e10, unit="INR", context=None, vf=None, vt=None, conf=1.0, doc=None, start=0, text=None):
    q = None if value is None else ("x", value, None, unit, value, unit)
    doc = doc or f"doc-{i}"
    return (f"f{i:03d}", doc, subject, metric, subject.lower() if subject else "", metric.lower(), "quantity", q, text, value, unit, context or {}, vf, vt, (doc, "n.pdf", 1, start, start + 10, "q", []), conf, None, T0)


PAIRS = [
    ("scale only", dict(), dict(value=8.1001e10), "CORROBORATES", [], []),
    ("spelling of period", dict(context={"period": "FY24"}), dict(context={"period": "FY2023-24"}), "CORROBORATES", [], []),
    ("basis", dict(context={"basis": "standalone"}), dict(context={"basis": "Consolidated"}, value=9e10), "RECONCILED", ["basis"], []),
    ("two keys", dict(context={"segment": "a", "basis": "x"}), dict(context={"basis": "y", "segment": "b"}), "RECONCILED", ["basis", "segment"], []),
    ("tenure", dict(vf="2019-06-01"), dict(vt="2025-03-01"), "RECONCILED", ["valid_time"], []),
    ("ended before", dict(vf="2019-01-01", vt="2020-01-01"), dict(vf="2020-01-01"), "RECONCILED", ["valid_time"], []),
    ("values differ", dict(), dict(value=9e10), "CONTRADICTS", [], []),
    ("one side silent", dict(context={"basis": "standalone"}), dict(value=9e10), "LIKELY_CONTRADICTS", [], ["basis"]),
    ("quarter and year", dict(context={"period": "Q4 FY24"}), dict(context={"period": "FY24"}), "RECONCILED", ["period"], []),
    ("other metric", dict(metric="cash from operating activities"), dict(metric="cash from investing activities", value=1e10), "UNRELATED", ["metric"], []),
    ("other words, same value", dict(), dict(metric="revenue from services"), "CORROBORATES", [], []),
    ("contained name", dict(metric="turbines operated", unit="count", value=84.0), dict(metric="turbines operated offshore", unit="count", value=91.0), "LIKELY_CONTRADICTS", [], ["metric_identity"]),
    ("qualifier", dict(metric="operating margin", unit="percent", value=11.0), dict(metric="adjusted operating margin", unit="percent", value=14.0), "UNRELATED", ["metric"], []),
    ("negation", dict(metric="current lease liabilities"), dict(metric="non-current lease liabilities", value=1e10), "UNRELATED", ["metric"], []),
    ("synonym", dict(metric="profit for year"), dict(metric="earnings for year", value=9e10), "CONTRADICTS", [], []),
    ("component", dict(metric="cash equivalents (B)"), dict(metric="cash equivalents (A+B)", value=9e10), "LIKELY_CONTRADICTS", [], ["metric_identity"]),
    ("subjects differ", dict(subject="interest paid banks"), dict(subject="interest paid others", value=9e10), "UNRELATED", ["metric"], []),
    ("no values", dict(value=None, text="a"), dict(value=None, text="b"), "UNRELATED", [], []),
]


@pytest.fixture(scope="module")
def judged(spark):
    rows, place = [], {}
    for k, (name, a, b, *_rest) in enumerate(PAIRS):
        # the case's own word keeps cases apart in blocking and is shared by its two subjects
        for side, x in ((0, a), (1, b)):
            x = dict(x)
            x["subject"] = f"{x.get('subject', 'Acme Widgets')} case{k:02d}x"
            rows.append(fact(2 * k + side, **x))
    df = spark.createDataFrame(rows, FACT)
    got = {(r.left_id, r.right_id): r for r in judge(candidate_pairs(features(df))).collect()}
    place.update(got)
    return place


@pytest.mark.parametrize("k", range(len(PAIRS)))
def test_rule(judged, k):
    name, _, _, verdict, differing, unstated = PAIRS[k]
    r = judged[f"f{2 * k:03d}", f"f{2 * k + 1:03d}"]
    assert (r.verdict, r.differing_keys, r.unstated_keys) == (verdict, differing, unstated), (name, r)
    assert r.reasoning and 0 <= r.confidence <= 1


def test_confidence_factors(spark):
    rows = [fact(0, conf=0.8, context={"basis": "a", "measure": "real"}), fact(1, conf=0.9, value=9e10)]
    r = judge(candidate_pairs(features(spark.createDataFrame(rows, FACT)))).first()
    assert r.verdict == "LIKELY_CONTRADICTS" and r.unstated_keys == ["basis", "measure"] and r.confidence == pytest.approx(0.8 * 0.36, abs=1e-3)


def test_cap_threshold_and_new_ids(spark):
    rows = [fact(i, subject=f"firm{i % 3}", start=i) for i in range(12)]
    feats = features(spark.createDataFrame(rows, FACT))
    assert candidate_pairs(feats).count() == 66
    assert candidate_pairs(feats, cap=11).count() == 18  # only the subjects' tokens are rare enough
    assert candidate_pairs(feats, max_pairs=5).count() == 5
    new = spark.createDataFrame([("f000",)], "fact_id string")
    assert candidate_pairs(feats, new_ids=new).count() == 11
    same_doc = features(spark.createDataFrame([fact(0, doc="d"), fact(1, doc="d", start=3)], FACT))
    assert candidate_pairs(same_doc).count() == 1 and candidate_pairs(same_doc, cross_document_only=True).count() == 0


def test_units_must_meet(spark):
    rows = [fact(0, unit="INR"), fact(1, unit="percent"), fact(2, unit="turbines"), fact(3, unit="count"), fact(4, value=None)]
    got = {(r.left_id, r.right_id) for r in candidate_pairs(features(spark.createDataFrame(rows, FACT))).collect()}
    assert got == {("f002", "f003")}


def test_empty_and_repeats(spark):
    none = spark.createDataFrame([], FACT)
    assert judge(candidate_pairs(features(none))).count() == 0
    twice = spark.createDataFrame([fact(0), fact(0), fact(1)], FACT)
    assert judge(candidate_pairs(features(latest_facts(twice)))).count() == 1


def test_pairs_on_hot_tokens_without_a_cap(spark):
    rows = [fact(i, subject=f"firm{i % 3}", start=i) for i in range(12)] + [fact(20 + i, metric="revenue", subject=None, unit="percent" if i else "INR") for i in range(3)]
    feats = features(spark.createDataFrame(rows, FACT))
    key = lambda df: sorted((r.left_id, r.right_id, round(r.score, 9)) for r in df.collect())
    whole = key(candidate_pairs(feats, cap=1000))
    assert len(key(candidate_pairs(feats, cap=3))) < len(whole) == 66 + 12 + 1
    assert key(candidate_pairs(feats, cap=None)) == whole
    assert key(candidate_pairs(feats, threshold=0.2, cap=None)) == key(candidate_pairs(feats, threshold=0.2, cap=1000))
    assert {tuple(r) for r in candidate_ids(feats, cap=None).collect()} == {tuple(r) for r in candidate_ids(feats, cap=1000).collect()}
    new = spark.createDataFrame([("f000",)], "fact_id string")
    assert key(candidate_pairs(feats, cap=None, new_ids=new)) == key(candidate_pairs(feats, cap=1000, new_ids=new))
