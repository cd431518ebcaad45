import random
from datetime import datetime, timedelta

import pytest

from factweave.llm.components import connected_groups, latest_links, peel

T0 = datetime(2024, 1, 1)
SCHEMA = "left_id string, right_id string, verdict string, judged_at timestamp, method string"


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def groups(spark, edges, **kw):
    df = spark.createDataFrame(edges, "a string, b string")
    return {r.id: r.group_id for r in connected_groups(df, **kw).collect()}


@pytest.mark.parametrize("rounds", [1, 2, 8])
def test_stars_chains_and_cycles(spark, rounds):
    random.seed(4)
    edges = [("hub", f"s{i:03d}") for i in range(120)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)]
    edges += [("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("p", "q"), ("q", "p"), ("p", "q")] + [(f"s{i:03d}", f"t{i:03d}") for i in range(0, 120, 7)]
    edges += [(f"r{random.randrange(60)}", f"r{random.randrange(60)}") for _ in range(45)]
    random.shuffle(edges)
    assert groups(spark, edges, max_peel_rounds=rounds) == brute([e for e in edges if e[0] != e[1]])


def test_an_unfinished_peel_of_a_chain_is_exact(spark):
    edges = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(30)]
    assert set(groups(spark, edges, max_peel_rounds=2).values()) == {"c000"}


def test_peel_takes_the_component_of_most_links(spark):
    seen, rest, hub = peel(spark.createDataFrame([("a", "b"), ("m", "n"), ("m", "o"), ("m", "p")], "a string, b string"), 5)
    assert {r.id for r in seen.collect()} == {"m", "n", "o", "p"} and hub is None and rest.count() == 1


def test_nulls_loops_and_empty(spark):
    assert groups(spark, [("a", "a"), (None, "b"), ("c", None)]) == {}
    assert groups(spark, []) == {}


def test_latest_verdict_counts(spark):
    later = T0 + timedelta(days=1)
    rows = [
        ("a", "b", " corroborates ", T0, None), ("b", "a", "CONTRADICTS", later, None),
        ("c", "d", "CONTRADICTS", T0, "x"), ("d", "c", "Corroborates", later, "x"),
        ("e", "e", "CORROBORATES", T0, None), (None, "f", "CORROBORATES", T0, None), ("g", "h", None, later, None), ("g", "h", "CORROBORATES", T0, None),
        ("m", "n", "CORROBORATES", T0, None), ("n", "m", "CONTRADICTS", T0, None), ("o", "p", "CORROBORATES", T0, None), ("o", "p", "RECONCILED", T0, None),
        ("q", "r", "CORROBORATES", None, None), ("q", "r", "UNRELATED", None, None), ("s", "t", "CORROBORATES", None, None), ("s", "t", "CONTRADICTS", None, None),
        ("u", "v", "CORROBORATES", None, None), ("u", "v", "CONTRADICTS", T0, None), ("w", "x", "CORROBORATES", T0, None), ("w", "x", None, T0, None),
        ("i", "j", "CORROBORATES", None, None), ("k", "l", "CORROBORATES", T0, None), ("k", "l", "CORROBORATES", T0, None),
    ]
    got = {(r.a, r.b) for r in latest_links(spark.createDataFrame(rows, SCHEMA), "left_id", "right_id", "verdict", "judged_at", "CORROBORATES").collect()}
    assert got == {("c", "d"), ("i", "j"), ("k", "l"), ("m", "n"), ("s", "t"), ("w", "x")}
