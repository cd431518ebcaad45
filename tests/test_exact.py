"""Whole results where tokens are frequent."""

from factweave.operators import pairs
from factweave.operators.pairs import candidate_ids, candidate_pairs, exact_links, features
from factweave.operators.verdicts import interesting, judge, ranked
from factweave.plans.knowledge import rebuild_counts
from factweave.schema import FACT
from factweave.session import saved
from tests.test_verdicts import fact


def test_rebuild_counts_has_no_cap(spark, tmp_path):
    n = 402  # facts that meet on tokens of more facts than the cap of the capped pairs
    spark.createDataFrame([fact(i, value=8.1e10 if i else 9e10, start=i) for i in range(n)], FACT).write.parquet(f"{tmp_path}/facts.parquet")
    got = {r.verdict: r.n for r in rebuild_counts(spark, str(tmp_path)).collect()}
    assert got == {"CORROBORATES": (n - 1) * (n - 2) // 2, "CONTRADICTS": n - 1}


def test_capped_pairs_are_not_shuffled(spark):
    feats, _ = saved(features(spark.createDataFrame([fact(i, subject=f"firm{i % 3} seat{i % 2}", start=i) for i in range(12)], FACT)))
    judged = judge(candidate_pairs(feats, cap=11))
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.count("Exchange") <= 2  # where facts meet, nothing after it
    ids = [tuple(r) for r in judged.select("left_id", "right_id").collect()]
    assert len(ids) == len(set(ids)) == 42  # all of one firm or of one seat, each once
    assert set(ids) == {tuple(r) for r in candidate_ids(feats, cap=11).collect()}


def test_links_need_no_pairs_of_classes(spark, monkeypatch):
    names = [(f"firm{i % 3} {'north' * (i % 2)} seat{i % 5}", ("revenue", "revenue services", "profit tax", "revenue services export")[i % 4]) for i in range(30)] + [(None, "revenue"), (None, "revenue export"), ("firm1", "")]
    units = ("INR", "count", "turbines", "percent")
    feats, _ = saved(features(spark.createDataFrame([fact(i, subject=s, metric=m, unit=units[i // 4 % 4], value=None if i % 7 == 6 else 1.0) for i, (s, m) in enumerate(names)], FACT)))
    row = lambda df: sorted(map(tuple, df.collect()))
    want = {t: row(pairs._links_by_class(feats, t)) for t in (0.5, 0.8)}
    assert sum(n for _, _, n in want[0.5]) == 2 * candidate_pairs(feats, cap=None).count() > 0
    monkeypatch.setattr(pairs, "class_pairs", None)
    assert {t: row(exact_links(feats, t)) for t in want} == want


def test_ranked_limit_shuffles_no_pairs(spark):
    feats, _ = saved(features(spark.createDataFrame([fact(i, value=1.0 + i, start=i) for i in range(6)], FACT)))
    first = ranked(interesting(judge(candidate_pairs(feats)))).limit(3)
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and plan.count("Exchange") <= 2
    assert [(r.left_id, r.right_id, r.verdict) for r in first.collect()] == [("f000", f"f00{k}", "CONTRADICTS") for k in (1, 2, 3)]
