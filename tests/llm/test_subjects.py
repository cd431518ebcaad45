import random

from factweave.llm.subjects import Rules, calibrate, folded, mine, prune, score_documents, sentences, subject_areas

TERMS = {
    "sport": ["referee", "penalty shoot-out", "league table", "stadium", "marathon"],
    "energy": ["gas pipeline", "power station", "wind farm", "turbine", "reactor"],
    "law": ["power of attorney", "court", "injunction", "statute", "penalty order"],
    "software": ["data pipeline", "compiler", "source code", "bug tracker", "server"],
}
FRAMES = ["Questions about the {} took up most of the meeting.", "The {} was reviewed twice, once together with the {}.", "Staff handle the {} by hand on some days.", "Without the {}, the {} would have cost more."]


def document(areas, n, passing=None):
    out = []
    for a in areas:
        out += [random.choice(FRAMES).format(*(random.choice(TERMS[a]) for _ in range(2))) for _ in range(n)]
    if passing:
        out.append(FRAMES[2].format(random.choice(TERMS[passing])))
    out += ["The chair thanked those present, J. Smith among them.", "Totals may not add up because of rounding."]
    random.shuffle(out)
    return " ".join(out)


def corpus(n=240):
    random.seed(11)
    docs, truth, labels = [], {}, []
    for i in range(n):
        areas = random.sample(sorted(TERMS), random.choice([1, 1, 2]))
        other = random.choice([a for a in sorted(TERMS) if a not in areas])
        docs.append((i, document(areas, 5, other), "x"))
        truth[i] = set(areas)
        if i % 2 == 0:
            said = [random.choice(sorted(TERMS))] if random.random() < 0.1 else areas
            labels += [(i, random.choice([a, a.upper(), f" {a} "]), "r1") for a in said]
    return docs, truth, labels


def frames(spark, docs, labels):
    areas = spark.createDataFrame([(a, a) for a in TERMS], "subject_code string, subject_name string")
    return spark.createDataFrame(docs, "doc_id long, text string, subject_code string"), spark.createDataFrame(labels, "doc_id long, subject_code string, rater string"), areas


def test_held_out_documents(spark):
    docs, truth, labels = corpus()
    got = {}
    for r in subject_areas(*frames(spark, docs, labels)).collect():
        got.setdefault(r.doc_id, set()).add(r.subject_code)
    held = [i for i in truth if i % 2]
    hit = sum(len(truth[i] & got.get(i, set())) for i in held)
    assert hit / sum(len(truth[i]) for i in held) > 0.95 and hit / sum(len(got.get(i, ())) for i in held) > 0.95


def test_typos_and_odd_inputs(spark):
    docs, _, labels = corpus()
    d, l, a = frames(spark, docs, [*labels, (99999, "sport", "r"), (1, None, "r"), (1, "no such", "r"), (None, "law", "r"), labels[0]])
    rules = mine(d, l, a)
    odd = [(1, None, ""), (2, "", ""), (3, "12 13.4 15", ""), (4, "Questions about the referre. The stadum, the stadium. Staff handle the marathons.", ""), (5, "The compiler. " * 4000, ""), (5, "<p>COURT</p>", "")]
    got = {(r.doc_id, r.subject_code): r.n_sentences for r in score_documents(frames(spark, odd, labels)[0], rules).collect()}
    assert got == {(4, "sport"): 3, (5, "software"): 4000, (5, "law"): 1}


def test_without_labels_or_documents(spark):
    docs, _, labels = corpus(20)
    assert subject_areas(*frames(spark, docs, [])).count() == 0
    assert subject_areas(*frames(spark, [], labels)).count() == 0


def test_sentences():
    assert sentences(folded("One two. J. Smith of Acme Ltd. said Über!  Next\n\nlast")) == [["one", "two"], ["j", "smith", "of", "acme", "ltd", "said", "uber"], ["next"], ["last"]]


def test_rules():
    prior = {"x": 0.3, "y": 0.3}
    rules = prune({("a",): ("x", 0.9, 90), ("b",): ("x", 0.5, 50), ("a", "b"): ("x", 0.92, 46), ("c",): ("y", 0.4, 9)}, prior, 1.5)
    assert [(p, c) for p, c, _, _ in rules] == [(("a",), "x"), (("b",), "x")]
    evidence = {p: e for p, _, e in calibrate(rules, {}, prior)}
    assert evidence["a",] == 1.0 and 0.5 < evidence["b",] < 0.6
    held = {p: e for p, _, e in calibrate(rules, {("a", "x"): (90, 120), ("b", "x"): (3, 50)}, prior)}
    assert held["a",] == 1.0 and 0.6 < held["b",] < 0.7  # sure rules reach three in four in held-out documents
    r = Rules([(("pipeline",), "energy", 0.6), (("data", "pipeline"), "software", 0.9), (("gas",), "energy", 0.9)], set())
    assert r.area(["data", "pipelines"], 0.5) == "software" and r.area(["gas", "pipeline"], 0.5) == "energy" and r.area(["x"], 0.5) is None


def test_any_number_of_words_matches():
    random.seed(2)
    ws = [f"w{i:02d}" for i in range(40)]
    rules = [(tuple(sorted(random.sample(ws, random.choice([1, 1, 2, 3])))), random.choice("xyz"), random.random()) for _ in range(300)]
    r = Rules(rules, set())
    for n in (1, 5, 14, 30, 40):
        found = set(random.sample(ws, n))
        matched = {p for p, _, _ in rules if set(p) <= found}
        left = {p for p in matched if not any(set(p) < set(q) for q in matched)}
        want = {}
        for p, a, e in rules:
            if p in left:
                want[a] = max(want.get(a, 0), e)
        assert r.score(found) == want
    assert folded("a <b " + "x" * 500 + ">c") == "a  c"
