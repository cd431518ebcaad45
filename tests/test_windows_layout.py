import random

from pyspark.sql import functions as F

from factweave.operators.layout import boxes_for, flatten_spans, has_text_layer, overlaps, page_blocks, page_texts
from factweave.operators.windows import build_windows, score_windows, select_windows, text_blocks


def greedy(blocks, most):
    out = []
    for s, e, i in blocks:
        if out and e - out[-1][0] <= most:
            out[-1] = (out[-1][0], e, out[-1][2], i)
        else:
            out.append((s, e, i, i))
    return out


def test_windows_match_the_greedy_loop(spark):
    random.seed(3)
    rows, want = [], []
    for d in range(6):
        at, blocks = 0, []
        for i in range(random.randint(0, 25)):
            n = random.choice([5, 20, 60, 300])
            blocks.append((at, at + n, i))
            at += n + 2
        rows += [(f"d{d}", 1, i, s, e, "x") for s, e, i in blocks]
        want += [(f"d{d}", *w) for w in greedy(blocks, 100)]
    df = spark.createDataFrame(rows, "doc_id string, page int, idx int, start int, stop int, text string")
    got = sorted((r.doc_id, r.start, r.stop, r.first_idx, r.last_idx) for r in build_windows(df, 100).collect())
    assert got == sorted(want)


def test_selection_and_text(spark):
    dense = "Revenue of ₹ 8,142 crore was reported for FY24, and growth is estimated to be 6.4 per cent as of March 31, 2024, up from 5.2 per cent."
    docs = spark.createDataFrame([("a", dense + "\n\n" + "plain words " * 12 + "9\n" + dense + " 7 7 7"), ("b", None), ("c", ""), ("d", " \n ")], "doc_id string, text string")
    blocks = text_blocks(docs)
    assert blocks.where("doc_id <> 'a'").count() == 0
    pages = docs.select("doc_id", F.lit(1).alias("page"), "text")
    scored = score_windows(build_windows(blocks, 50), pages)
    assert all(r.text == docs.where(f"doc_id = '{r.doc_id}'").first().text[r.start : r.stop] for r in scored.collect())
    assert scored.count() == 3 and select_windows(scored, 2).count() == 2 and select_windows(scored, 0).count() == 3
    assert scored.orderBy(F.desc("score")).first().window_key.startswith("a:1:")


SPANS = [
    ("d", 1, 0, 0, 0, 0, "Hello ", (0.0, 0.0, 5.0, 1.0)),
    ("d", 1, 0, 0, 1, 0, "world", (5.0, 0.0, 9.0, 1.0)),
    ("d", 1, 0, 1, 0, 0, "again", (0.0, 1.0, 5.0, 2.0)),
    ("d", 1, 1, 0, 0, 1, "picture", (0.0, 0.0, 1.0, 1.0)),
    ("d", 1, 2, 0, 0, 0, "", (0.0, 0.0, 1.0, 1.0)),
    ("d", 1, 3, 0, 0, 0, "last", (0.0, 5.0, 4.0, 6.0)),
]


def test_layout_offsets(spark):
    df = spark.createDataFrame(SPANS, "doc_id string, page int, block int, line int, span int, kind int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    placed = flatten_spans(df)
    blocks = page_blocks(placed)
    text = page_texts(blocks).first().text
    assert text == "Hello world\nagain\n\nlast\n\n"
    for r in placed.collect():
        assert text[r.start : r.stop] == r.text
    got = blocks.orderBy("idx").collect()
    assert [(b.idx, text[b.start : b.stop] == b.text) for b in got] == [(0, True), (1, True)]
    assert tuple(got[0].bbox) == (0.0, 0.0, 9.0, 2.0)
    spans = placed.groupBy("page").agg(F.collect_list(F.struct("start", "stop", "bbox")).alias("s"))
    assert len(spans.select(boxes_for(F.col("s"), F.lit(3), F.lit(7)).alias("b")).first().b) == 2
    assert spans.select(boxes_for(F.col("s"), F.lit(11), F.lit(12)).alias("b")).first().b == []


def test_text_layer(spark):
    df = spark.createDataFrame([("a", i, "x" * 60 if i == 8 else "") for i in range(10)] + [("b", 1, " " * 90), ("c", 1, "y" * 51)], "doc_id string, page int, text string")
    assert {r.doc_id: r.has_text for r in has_text_layer(df).collect()} == {"a": True, "b": False, "c": True}


def test_overlaps_match_brute_force(spark):
    random.seed(6)
    rows = [(i, random.choice(["a", "b"]), (s := random.randrange(3000)), s + random.choice([1, 5, 40, 700, 2500])) for i in range(80)]
    rows += [(100, "a", 5, 5), (101, "a", 9, 4), (102, None, 0, 3000), (103, "a", None, 10), (104, "a", 0, None)]
    df = spark.createDataFrame(rows, "i int, k string, start int, stop int")
    good = [r for r in rows if None not in r and r[3] > r[2]]
    want = sorted((a[0], b[0]) for a in good for b in good if a[1] == b[1] and a[2] < b[3] and b[2] < a[3])
    for width in (64, 512):
        assert sorted((r.left.i, r.right.i) for r in overlaps(df, df, ["k"], width).collect()) == want
    assert overlaps(df.limit(0), df, ["k"]).count() == 0
