import random
from itertools import product

import pytest

from factweave.llm.names import Reader, _abbreviates, firm_entities, learn, measure_entities, name_entities, person_entities, variants
from factweave.llm.readings import ALWAYS, AS_IT_STANDS, STOOD_IN, assign, fitting, written_out
from factweave.llm.trie import bound, build, edits, neighbours, trie_join


def distance(a, b):
    d = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def words(n, letters, seed):
    random.seed(seed)
    out = set()
    while len(out) < n:
        w = [random.choice(letters) for _ in range(random.randint(4, 11))]
        out.add("".join(w))
        for _ in range(random.randint(0, 2)):
            p = random.randrange(len(w) - 1)
            w[p], w[p + 1] = w[p + 1], w[p]
            w.pop(random.randrange(len(w)))
            if len(w) > 3:
                out.add("".join(w))
    return sorted(out)


def test_automaton_matches_brute_force():
    ws = words(150, "abc", 1)
    root = build(ws)
    for w in ws[:60]:
        for k in (0, 1, 2):
            assert dict(neighbours(root, w, k)) == {v: d for v in ws if (d := distance(w, v)) <= k}
    assert edits("abcd", "abdc", 2) == 1 and edits("abcd", "wxyz", 2) == 3


def test_trie_join_is_complete(spark):
    ws = words(300, "abcdefgh", 2)
    df = spark.createDataFrame([(w,) for w in ws] + [(ws[0],), (None,)], "w string")
    got = {(r.a, r.b): r.d for r in trie_join(df, "w").collect()}
    want = {(a, b): d for a in ws for b in ws if a != b and len(a) >= 4 and len(b) >= 4 and (d := distance(a, b)) <= bound(len(a))}
    assert got == want
    assert trie_join(df.limit(0), "w").count() == 0


@pytest.mark.parametrize("ends", [2, 3, 4, 5])
def test_trie_join_is_the_same_for_all_shards(spark, ends):
    ws = set(words(120, "abcdefgh", 3)) | {"cash", "csah", "horse", "hosre", "hoxse", "planet", "plaent", "marbles", "marlbes", "xarketsy", "marketsz", "abcdefghijk", "xbcdefghijy", "bacdefghikj"}
    ws |= {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for w in list(ws)[:60] for i in range(len(w) - 1)}
    got = {(r.a, r.b): r.d for r in trie_join(spark.createDataFrame([(w,) for w in ws], "w string"), "w", ends).collect()}
    want = {(a, b): d for a in ws for b in ws if a != b and min(len(a), len(b)) >= 4 and abs(len(a) - len(b)) <= 2 and (d := distance(a, b)) <= bound(len(a))}
    assert got == want and ("cash", "csah") in got


NAMES = [
    ["bashahezom logistics industries private limited", "basha-hezom logistics industties private limited", "private limited, bashahezom logistics indstries", "bashahezom logstcs inds. pvt ltd", "m/s basahhezomlogistics industries", "logistics bashahezom", "bashahezomlog. inds. limited"],
    ["gutrodurit electronics carriers corporation", "the gutrodurit electrncs carr. corp", "gutrodurit (ce) carriers corpn", "gutro durit electronics carriers corporation"],
    ["gutrodurit textiles carriers corporation", "gütrodurit textiles carriers corpn"],
    ["rikrodrefox pharma limited", "the rikrodrefox pharmaceuticals"],
    ["rikrodrefox mining ventures limited", "rikrodrefox mining vemtures"],
    ["daniela l. guparatrut", "guparatrut, daniela l", "d. l. guparatrut", "shri dani guparatrut"],
    ["benjamin guparatrut", "guparatrut, ben", "benjmain guparatrut"],
]


#: What a table large enough would teach.
READER = Reader(
    ("logistics", "industries", "electronics", "carriers", "textiles", "pharma", "mining", "ventures", "steel", "power"),
    {"pharmaceuticals": "pharma"}, {"daniela": "dani", "benjamin": "ben"},
)


def test_firms_and_people(spark):
    rows = [(n, 50 if k == 0 else 3) for group in NAMES for k, n in enumerate(group)]
    got = {}
    for r in name_entities(spark.createDataFrame(rows, "name string, n int"), "name", "n", READER).collect():
        got.setdefault(r.entity, set()).add(r.name)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, NAMES))


def test_order_of_own_words(spark):
    groups = [
        ["larsen toubro limited", "toubro larsen ltd", "limited, toubro larsn", "larsentoubro pvt ltd"],
        ["alpine zebrano korund limited", "korund alpine zebrano ltd", "zebrano korund alpine ltd"],
        ["kiran desai", "desai, kiran", "desai kiran", "desay kiran"], ["anil desai", "desai anil"], ["gutro durit limited", "gutrodurit ltd", "durit gutro ltd"],
    ]
    rows = [(n, 9 if k == 0 else 2) for group in groups for k, n in enumerate(group)]
    got = {}
    for r in name_entities(spark.createDataFrame(rows, "name string, n int"), "name", "n", READER).collect():
        got.setdefault(r.entity, set()).add(r.name)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups))


def made_up(rng, n):
    return ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)) + rng.choice("lnrst") for _ in range(n)]


def test_learning(spark):
    rng = random.Random(8)
    trades, given = ["power", "holdings", "shipping", "chemicals"], {"margaret": "peggy", "theodore": "ted", "victoria": "vicky"}
    rows = []
    for i, stem in enumerate(made_up(rng, 40)):
        pair = [trades[i % 4], trades[(i + 1 + i // 4 % 3) % 4]]
        rows += [(f"{stem} {' '.join(pair)} limited", 90), (f"{' '.join(pair)} {stem} ltd", 4)]
        if "holdings" in pair and i % 3 == 0:
            rows.append((f"{stem} {' '.join('hldgs' if t == 'holdings' else t for t in pair)} limited", 3))
    for i, family in enumerate(made_up(rng, 36)):
        g = sorted(given)[i % 3]
        rows += [(f"{g} {family}", 80), (f"{family}, {g}", 5)]
        if i % 4 == 0:
            rows.append((f"{given[g]} {family}", 3))
        if i % 9 == 0:  # a relative
            rows.append((f"{sorted(given)[(i + 1) % 3]} {family}", 60))
    reader = learn(spark.createDataFrame(rows, "name string, n long"))
    assert sorted(reader.trades) == sorted(trades) and reader.aliases == {"hldgs": "holdings"}
    assert reader.given == {g: g for g in given} | {n: g for g, n in given.items()}
    got = {tuple(r) for r in variants(spark.createDataFrame([(a, None) for a, n in rows for _ in range(n)], "subject_key string, metric_key string")).collect()}
    entities = {}
    for a, _ in rows:
        words = a.replace(",", "").replace("limited", "").replace("ltd", "").split()
        back = {n: g for g, n in given.items()} | {"hldgs": "holdings"}
        entities.setdefault(frozenset(back.get(w, w) for w in words), set()).add(a)
    assert got == {("subject", a, b) for names in entities.values() for a in names for b in names if a < b}
    empty = learn(spark.createDataFrame([], "name string, n long"))
    assert not empty.trades and not empty.given and not empty.aliases


def test_forms():
    d = lambda *x, h="": "d:" + ",".join(x) + "|h:" + h
    got = firm_entities([d("a", "b"), d("a"), d("a", "c"), d("b"), d("a", h="ab")])
    assert got[d("a")] is None and got[d("b")] == "a,b" and got[d("a", "c")] == "a,c" and got[d("a", h="ab")] == "a,b"
    p = lambda g, i, m: f"g:{g}|i:{i}|m:{m}"
    got = person_entities([p("ann", "a", "k"), p("ann", "a", ""), p("abe", "a", ""), p("", "a", ""), p("", "a", "k")])
    assert got[p("ann", "a", "")] == "ann k" and got[p("", "a", "")] is None and got[p("abe", "a", "")] == "abe "
    assert Reader().read("- . ,") is None


MEASURES = [
    (["revenue from operations", "operations revenue", "rev. from ops", "revenues from ops", "revenue from operatns"], 900),
    (["revenue from services", "services revenue", "revenuefrom services"], 80),
    (["non-current assets", "no-current assets", "non-curent assets"], 70),
    (["current assets", "assets current", "current assts"], 75),
    (["operating margin", "op. mgn", "oper. margin"], 60),
    (["adjusted operating margin", "adjustd operating margin"], 40),
    (["wind turbines installed", "wind wtgs installed", "wind wtgs instd"], 500),
    (["tudasibrat plant output value"], 20),
    (["motrofutrer plant output value", "motrofuter plant output value"], 20),
]


def test_measures(spark):
    rows = [(n, w if k == 0 else 3) for group, w in MEASURES for k, n in enumerate(group)]
    got = {}
    for r in measure_entities(spark.createDataFrame(rows, "name string, n int"), "name", "n").collect():
        got.setdefault(r.entity, set()).add(r.name)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g, _ in MEASURES)


def test_all_words_and_readings_of_measures(spark):
    rng = random.Random(4)
    # the seventh most used word that begins with `pr`
    sevenths = ["pressure gauge", "process steps", "product lines", "profit margin", "promise kept", "property rents", "provision booked"]
    groups = [[(n, 90 - 10 * k)] for k, n in enumerate(sevenths)]
    groups[6].append(("pr. booked", 10))
    # four tokens that each may be one of five words: 1296 ways, the right one is the last
    short = {c: [c + "".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(4)) + "z" for _ in range(5)] for c in "bdfg"}
    groups += [[(w, 90 - 10 * k)] for ws in short.values() for k, w in enumerate(ws)]
    groups.append([(" ".join(ws[-1] for ws in short.values()), 20), ("bz. dz. fz. gz.", 10)])
    # a stand-in in a name of thirteen words
    twelve = " ".join(made_up(rng, 12))
    groups.append([(f"{twelve} wind turbines", 100), (f"{twelve} xqk", 3)])
    got = {}
    for r in measure_entities(spark.createDataFrame([r for g in groups for r in g], "name string, n int"), "name", "n").collect():
        got.setdefault(r.entity, set()).add(r.name)
    assert sorted(map(sorted, got.values())) == sorted(sorted(n for n, _ in g) for g in groups)


def test_assignment_matches_all_readings():
    rng = random.Random(5)
    for _ in range(400):
        options = [[(k, tuple(rng.choice("abcd") for _ in range(rng.choice((1, 1, 1, 2))))) for k in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 5))]
        readings = {}
        for c in product(*options):
            readings.setdefault(tuple(sorted(w for _, ws in c for w in ws)), [k for k, _ in c])
        for target in {*readings, tuple(sorted(rng.choice("abcd") for _ in range(rng.randint(1, 6))))}:
            assert assign(options, list(target)) == readings.get(target)
    assert assign([], []) is None
    many = [[(k, (w,)) for k, w in enumerate("abcdefghij")] for _ in range(11)] + [[(k, (w,)) for k, w in enumerate("abcdefghijklmnopqrstu")] for _ in range(10)]
    assert assign(many, list("abcdefghijklmnopqrstu")) is None and assign(many[1:], list("abcdefghijklmnopqrst")) == [*range(20)]


def test_words_and_readings_are_all_met(spark):
    rng = random.Random(6)
    used = {"".join(rng.choice("abcs") for _ in range(rng.randint(1, 9))): rng.randint(1, 30) for _ in range(300)}
    tokens = {(w + d, w, used[w]) for w in rng.sample(sorted(used), 120) for d in ("", ".")}
    got = sorted(map(tuple, written_out(spark.createDataFrame(sorted(tokens), "token string, word string, n long"), spark.createDataFrame(sorted(used.items()), "word string, n long")).collect()))
    want = sorted((t, v, m) for t, w, n in tokens for v, m in used.items() if len(w) <= 7 + (t != w) and m > n and len(v) > len(w) + (t == w and len(w) > 2) and _abbreviates(w, v))
    assert got == want and len({t for t, _, _ in want}) > 20

    options = {}
    for t in "stuvwxyz":
        options[t] = [(k, rng.choice((ALWAYS, ALWAYS, AS_IT_STANDS, STOOD_IN)) if k else ALWAYS, [rng.choice("abcde") for _ in range(rng.choice((1, 1, 2)) if k else 1)]) for k in range(rng.randint(1, 4))]
    options["r"] = [(0, ALWAYS, ["e"])]
    names = {f"n{i}": [rng.choice("rrrstuvwxyz") for _ in range(rng.randint(1, 4))] for i in range(60)}
    targets = {" ".join(sorted(rng.choice("abcde") for _ in range(rng.randint(1, 5)))) for _ in range(120)}
    want = {}
    for name, ts in names.items():
        for side, aside in ((AS_IT_STANDS, False), (STOOD_IN, True)):
            for c in product(*([o for o in options[t] if o[1] in (ALWAYS, side)] for t in ts)):
                said = " ".join(sorted(w for _, _, ws in c for w in ws))
                if said in targets:
                    want.setdefault((name, said), (aside, [k for k, _, _ in c]))
    items = spark.createDataFrame([(a, 0, p, t) for a, ts in names.items() for p, t in enumerate(ts)], "name string, k int, pos int, token string")
    opts = spark.createDataFrame([(t, *o) for t, os in options.items() for o in os], "token string, idx int, side int, words array<string>")
    got = fitting(items, opts, spark.createDataFrame([(t,) for t in sorted(targets)] * 2, "target string")).collect()
    assert len(got) == len(want) and {(r.name, r.target): (r.aside, r["rank"]) for r in got} == want and any(a for a, _ in want.values())


def test_long_names_teach(spark):
    rng = random.Random(9)
    rows = []
    for k, stem in enumerate(made_up(rng, 30)):
        rows.append((" ".join([stem, "shipping" if k % 2 else "chemicals", *made_up(rng, 11), "limited"]), 5))
    assert {"chemicals", "shipping"} <= set(learn(spark.createDataFrame(rows, "name string, n long")).trades)


def test_variants_of_a_table(spark):
    rows = [(n, m, "x") for n in [*NAMES[3], None, "", "z" * 3000] for m in [*MEASURES[1][0], None, "", "-"] for _ in range(2)]
    got = {tuple(r) for r in variants(spark.createDataFrame(rows, "subject_key string, metric_key string, name string"), reader=READER).collect()}
    assert ("subject", "rikrodrefox pharma limited", "the rikrodrefox pharmaceuticals") in got
    assert ("metric", "revenue from services", "services revenue") in got and len(got) == 4
    assert variants(spark.createDataFrame([], "subject_key string, metric_key string, name string")).count() == 0
