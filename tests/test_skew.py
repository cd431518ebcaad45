import statistics
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from factweave.operators.skew import heavy_keys, key_counts, key_profile, range_split

SCHEMA = "k string, u string, v double, ts timestamp, id string, n int"


def rows():
    t0 = datetime(2024, 1, 1)
    out = [("hot", None, float(i % 97), t0 + timedelta(seconds=i), f"h{i:05d}", i) for i in range(3000)]
    out += [(f"k{i % 40}", "x" if i % 3 else None, float(i), t0, f"c{i:05d}", i) for i in range(400)]
    out += [(None, "", None, None, "z1", 0), (None, "", None, None, "z1", 0), ("only nulls", "x", None, t0, None, 1)]
    return out


def test_profile_matches_brute_force(spark):
    got = {(r.k, r.u): (r.n, r.n_values, r.median_value, r.latest_id) for r in key_profile(spark.createDataFrame(rows(), SCHEMA), ["k", "u"], "v", "ts", "id", 7).collect()}
    groups = defaultdict(list)
    for r in rows():
        groups[r[0], r[1]].append(r)
    assert len(got) == len(groups)
    for key, rs in groups.items():
        values = [r[2] for r in rs if r[2] is not None]
        latest = max((r[3] or datetime.min, r[4] or "") for r in rs)[1]
        assert got[key] == (len(rs), len(values), statistics.median(values) if values else None, latest), key


def test_a_hot_key_is_split(spark):
    df = range_split(spark.createDataFrame(rows(), SCHEMA), ["k", "u"], ["id"], 8)
    assert df.where("k = 'hot'").select("__pid").distinct().count() >= 5


def test_counts_and_heavy_keys(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    counts = {(r.k, r.u): r.n for r in key_counts(df, ["k", "u"], "id", 5).collect()}
    assert counts["hot", None] == 3000 and counts[None, ""] == 2 and sum(counts.values()) == len(rows())
    assert [(r.k, r.n) for r in heavy_keys(df, ["k", "u"], "id", 0.05, 5).collect()] == [("hot", 3000)]


@pytest.mark.parametrize("partitions", [2, 3, 16])
def test_counts_are_stitched_at_the_borders(spark, partitions):
    want = Counter((r[0], r[1]) for r in rows())
    got = key_counts(spark.createDataFrame(rows(), SCHEMA), ["k", "u"], "id", partitions)
    assert {(r.k, r.u): r.n for r in got.collect()} == want and got.count() == len(want)
    numbers = spark.createDataFrame([(i % 7 if i % 5 else None, str(i)) for i in range(200)], "i int, id string")
    assert {r.i: r.n for r in key_counts(numbers, ["i"], "id", partitions).collect()} == Counter(i % 7 if i % 5 else None for i in range(200))


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert key_counts(df, ["k", "u"], "id").count() == 0
    assert heavy_keys(df, ["k", "u"], "id").count() == 0
    assert key_profile(df, ["k", "u"], "v", "ts", "id").count() == 0
