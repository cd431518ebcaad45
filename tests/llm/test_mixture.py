import random

import pytest

from factweave.llm.mixture import count_tokens, draw, encoding, mixture_plan, pieces, source_sizes, vocabulary_path, water_fill

TARGETS = [("annual_report", 0.5, 1), ("news wire", 0.3, 4), ("rating_note", 0.2, 2), ("none here", 0.0, 3)]


def frames(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string, source string, uses string"), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def test_water_fill_against_small_steps():
    random.seed(9)
    for _ in range(30):
        t = [(f"s{i}", random.random(), random.randint(0, 4), random.choice([0, 10, 200, 5000])) for i in range(6)]
        total = sum(x[3] for x in t)
        plan = water_fill(t, total)
        supply = sum(p["supply"] for p in plan.values())
        assert sum(p["given"] for p in plan.values()) == pytest.approx(min(total, supply))
        assert all(p["given"] <= p["supply"] + 1e-6 for p in plan.values())
        free = [(p["given"] / s) for (k, s, _, _), p in zip(t, plan.values()) if p["given"] < p["supply"] - 1e-6]
        assert not free or max(free) == pytest.approx(min(free))  # what isn't clamped is in proportion


def test_degenerate_plans():
    assert water_fill([], 10) == {}
    assert water_fill([("a", 0.0, 1, 10)], 10)["a"]["given"] == 0
    assert water_fill([("a", 1.0, 3, 0)], 10)["a"]["short"] == 1.0
    assert water_fill([("a", None, None, None)], 0)["a"]["repeats"] == 0


def test_tokens_cover_whole_texts(spark):
    enc = encoding(vocabulary_path())
    texts = ["Revenue was ₹ 8,142 crore.", "", None, "über " * 9000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.n_tokens for r in count_tokens(df, "t").orderBy("i").collect()]
    assert got[:3] == [len(enc.encode_ordinary(texts[0])), 0, 0]
    assert got[3] == len(enc.encode_ordinary(texts[3]))


def test_tokens_of_long_texts_are_those_of_the_uncut_text():
    enc = encoding(vocabulary_path())
    random.seed(3)
    odd = ["don't", "we'll", "1,234.50", "naïve", "漢字かな", "a\u00a0b", "x\t\ty", "\r\n", "...", "  ", "\n\n\n", "''s", "🙂", "e\u0301", "q" * 30]
    text = "".join(random.choice(odd) + random.choice(["", " ", "  ", "\n", " \n "]) for _ in range(14_000))
    assert len(text) > 50_000
    for least in (1, 7, 1000, 20_000):
        cut = list(pieces(text, least))
        assert "".join(cut) == text and sum(len(enc.encode_ordinary(x)) for x in cut) == len(enc.encode_ordinary(text))
    assert len(list(pieces("漢" * 50_000))) == 1 and list(pieces("")) == [""]


def test_plan_and_draw(spark):
    docs = [(i, "one two three four " * 10, random.choice(["Annual-Report", " annual_report "]), "c") for i in range(300)]
    docs += [(1000 + i, "one two three four " * 10, "NEWS_WIRE", "c") for i in range(60)] + [(2000 + i, "word " * 20, "rating-note", "c") for i in range(20)]
    docs += [(5000, "no source " * 50, None, "c"), (5001, "blank", "  ", "c"), (5002, None, "annual report", "c"), (6000, "other " * 40, "archive", "c")]
    d, t = frames(spark, docs)
    sizes = {r.source_key: r.n_docs for r in source_sizes(d).collect()}
    assert sizes == {"annual_report": 301, "news_wire": 60, "rating_note": 20, "archive": 1}
    plan = mixture_plan(d, t)
    p = {r.source_key: r for r in plan.collect()}
    assert p["rating_note"].short and p["rating_note"].repeats == 2 and not p["news_wire"].short and not p["none_here"].short
    assert sum(r.actual_share for r in p.values()) == pytest.approx(1)
    uses = draw(d, plan, seed=1).collect()
    assert uses == draw(d.repartition(7), plan, seed=1).collect() or sorted(uses) == sorted(draw(d.repartition(7), plan, seed=1).collect())
    for key, r in p.items():
        mine = [u.uses for u in uses if u.source_key == key]
        assert all(u <= r.max_repeats for u in mine)
        if r.n_docs:
            assert sum(mine) / r.n_docs == pytest.approx(r.repeats, abs=0.15)


def test_actual_share_is_of_drawn_documents(spark):
    docs = [(i, "word " * (4000 if i == 0 else 10), "annual report", "c") for i in range(40)] + [(100 + i, "word " * (3000 if i == 0 else 10), "news wire", "c") for i in range(40)]
    d, _ = frames(spark, docs)
    t = spark.createDataFrame([("annual report", 0.2, 1), ("news wire", 0.8, 4)], "source string, target_share double, max_repeats int")
    apart = []
    for seed in (1, 7):
        plan = mixture_plan(d, t, seed=seed)
        uses = {r.doc_id: r.uses for r in draw(d, plan, seed=seed).collect()}
        sizes = {r.doc_id: (r.source, r.n_tokens * uses.get(r.doc_id, 0)) for r in count_tokens(d, "text").collect()}
        total = sum(n for _, n in sizes.values())
        for r in plan.where("n_docs > 0").collect():
            assert r.drawn == sum(n for s, n in sizes.values() if s.replace(" ", "_") == r.source_key)
            assert r.actual_share == pytest.approx(r.drawn / total) and r.planned_share == pytest.approx(r.given / sum(x.given for x in plan.collect()))
        apart += [abs(r.actual_share - r.planned_share) for r in plan.collect()]
    assert max(apart) > 0.05


def test_empty(spark):
    d, t = frames(spark, [])
    plan = mixture_plan(d, t)
    assert plan.count() == 4 and draw(d, plan).count() == 0
    assert mixture_plan(d, t.limit(0)).count() == 0
