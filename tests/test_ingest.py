import json
import os

import pytest
from pyspark.sql import functions as F

from factweave.operators import browse
from factweave.operators.extract import extraction_stats, failed_calls, ground, proposals, stats_line, to_facts
from factweave.plans.pipeline import ingest, load_facts, relate, relate_ranked
from factweave.schema import EXTRACTION, FACT
from factweave.sources.connect import ExtractorError, IngestError, chain, prompt
from factweave.sources.files import accept_uploads, read_binaries, read_facts_json, write_facts_json
from factweave.sources.store import Store
from factweave.streaming.ingest import fact_stream, ingest_stream

PAGE = {
    b"one": "Acme Widgets Limited annual report for the year ended March 31, 2024. Revenue from operations was ₹ 8,142 crore in FY24, and headcount is 1,200 people.",
    b"two": "Acme Widgets quarterly note for investors, published in May 2024. Revenue from operations was ₹ 81,415.38 million in FY2023-24; the rest is unchanged.",
    b"scan": "",
    b"thin": "A note of few words but of more than fifty letters, without anything in it to read.",
}


def parser(content):
    yield 1, 0, 0, 0, 0, PAGE[content], (0.0, 0.0, 10.0, 10.0)


def extractor(passage):
    raw, mag = ("8,142", "crore") if "8,142" in passage else ("81,415.38", "million")
    base = {"subject": "Acme Widgets ", "metric": "Revenue from operations", "fact_type": "quantity", "value_raw": raw, "magnitude": mag, "unit": "INR", "period": "FY24", "basis": "n/a", "confidence": 0.9}
    quote = f"Revenue from  operations was ₹ {raw} {mag}"
    return json.dumps({"facts": [base | {"quote": quote}, base | {"quote": "never said"}, base | {"quote": quote, "value_raw": "", "value_text": " "}]})


def binaries(spark, *names):
    return spark.createDataFrame([(n, f"{n}.pdf", n.encode()) for n in names], "doc_id string, filename string, content binary")


def test_ingest_end_to_end(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    stats = ingest(store, binaries(spark, "one", "two"), parser, extractor).collect()
    assert {(r.doc_id, r.proposed, r.kept, r.dropped_ungrounded, r.dropped_empty_value) for r in stats} == {("one", 3, 1, 1, 1), ("two", 3, 1, 1, 1)}
    facts = store.read("facts").collect()
    assert len(facts) == 2 and all(f.evidence.quote in PAGE[f.doc_id.encode()] for f in facts) and all(f.context == {"period": "FY24"} for f in facts)
    assert all(len(f.evidence.bboxes) == 1 for f in facts)
    rel = store.read("relations").collect()
    assert [(r.verdict, r.method) for r in rel] == [("CORROBORATES", "arithmetic")]
    # the same again changes nothing, and costs no call
    ingest(store, binaries(spark, "one", "two"), parser, lambda p: 1 / 0)
    assert store.read("facts").count() == 2 and store.read("relations").count() == 1 and store.read("extractions").count() == 2
    with pytest.raises(IngestError):
        ingest(store, binaries(spark, "scan"), parser, extractor)
    assert store.delete_document("one") and not store.delete_document("one")
    assert store.read("facts").count() == 1 and store.read("relations").count() == 0 and store.read("filings").count() == 1


def test_a_mixed_batch_has_an_outcome_for_each(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    asked = spark.sparkContext.accumulator(0)

    def counted(text):
        asked.add(1)
        assert text == prompt(text.split("Passage:\n", 1)[1])
        return extractor(text)

    report = ingest(store, binaries(spark, "one", "scan", "thin"), parser, counted)
    assert {r.doc_id: (r.outcome, r.kept) for r in report.collect()} == {"one": ("ingested", 1), "scan": ("no text layer", 0), "thin": ("no passage", 0)}
    assert asked.value == 1 and store.read("filings").count() == 1
    # a raised prompt version asks again and loses nothing
    report = ingest(store, binaries(spark, "one", "two"), parser, counted, version="v2")
    assert {r.doc_id: (r.outcome, r.kept) for r in report.collect()} == {"two": ("ingested", 1)}
    assert store.read("facts").count() == 2 and store.read("extractions").count() == 2 and asked.value == 2


def test_text_layer_of_blank_pages(spark, tmp_path):
    def scanned(content):  # ten pages, text on two that are not sampled
        for n in range(1, 11):
            yield n, 0, 0, 0, 0, "printed words " * 9 if n in (2, 4) else "", (0.0, 0.0, 1.0, 1.0)

    with pytest.raises(IngestError, match="no text layer"):
        ingest(Store(spark, str(tmp_path / "s")), binaries(spark, "x"), scanned, extractor)


def test_writes_touch_their_buckets_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=8)
    store.save("filings", spark.createDataFrame([(f"d{i}", f"{i}.pdf") for i in range(40)], "doc_id string, filename string"))
    before = store._manifest()[1]["filings"]
    old = store.read("filings")
    store.save("filings", spark.createDataFrame([("d7", "new.pdf")], "doc_id string, filename string"))
    after = store._manifest()[1]["filings"]
    assert len(before) > 4 and sum(before[b] != after[b] for b in before) == 1
    assert old.count() == 40 and store.get("filings", doc_id="d7").first().filename == "new.pdf" and store.read("filings").count() == 40
    store.delete("filings", spark.createDataFrame([("d7",), ("no",)], "doc_id string"))
    assert store.read("filings").count() == 39 and len(store._versions()) == 2
    version, manifest = store._manifest()
    store.clear("filings")
    with pytest.raises(RuntimeError):
        store._commit(version + 1, manifest)


def test_structured_answers_and_providers():
    from factweave.sources.connect import get_provider, register_provider, structured

    good = '{"facts": [{"quote": "q", "confidence": 0.5}]}'
    bad = ['{"facts": 3}', '{"facts": ["x"]}', "no json", '{"facts": [{"quote": 1}]}', '{"facts": [{"quote": "q", "subject": {}}]}']
    assert structured(lambda p: good)("p") == good and chain([*[structured(lambda p, b=b: b) for b in bad], structured(lambda p: good)])("p") == good
    with pytest.raises(ExtractorError):
        get_provider("none")
    register_provider("stub", extractor)
    assert get_provider() is extractor and get_provider("stub") is extractor


def test_store_upsert_clear_get(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.read("filings").count() == 0 and not store.has("filings", doc_id="a")
    rows = lambda *x: spark.createDataFrame(x, "doc_id string, filename string, page_count int")
    store.save("filings", rows(("a", "x", 1), ("b", "y", 2), ("b", "y", 2)))
    store.save("filings", rows(("b", "z", 3)))
    assert {(r.doc_id, r.filename) for r in store.read("filings").collect()} == {("a", "x"), ("b", "z")}
    assert store.get("filings", doc_id="b").first().page_count == 3
    store.clear("filings")
    assert store.read("filings").count() == 0


def test_payloads(spark):
    good = json.dumps({"facts": [{"subject": "a", "metric": "m", "value_raw": "5", "quote": "it is 5", "confidence": 0.5}]})
    rows = [("k1", "d", 1, "m", good, None), ("k2", "d", 1, "m", f"```json\n{good}\n```", None), ("k3", "d", 2, "m", good[:-9], None), ("k4", "e", 1, "m", "", None), ("k5", "e", 1, "m", None, None), ("k6", "e", 1, "m", '{"facts": []}', None), ("k1", "d", 1, "m", good, None)]
    df = spark.createDataFrame(rows, EXTRACTION)
    p = proposals(df)
    assert sorted(r.cache_key for r in p.collect()) == ["k1", "k2"]
    assert sorted(r.cache_key for r in failed_calls(df).collect()) == ["k3", "k4", "k5"]
    g = ground(p.withColumn("window_text", F.lit("so it is  5 now")).withColumn("window_start", F.lit(100)))
    facts = to_facts(g).collect()
    assert len(facts) == 1 and facts[0].evidence.span_start == 103 and facts[0].evidence.quote == "it is  5"
    lines = {r.doc_id: r.summary for r in stats_line(extraction_stats(g, failed_calls(df))).collect()}
    assert lines["d"] == "2 proposed, 2 kept (100%), 0 ungrounded, 0 empty, 1 failed" and lines["e"].endswith("2 failed")


def test_json_files_and_bulk_load(spark, tmp_path):
    fact = lambda i, c: {"fact_id": i, "doc_id": "d1", "subject": "s", "metric": "m", "context": {}, "confidence": c}
    for name, facts in (("a", [fact("1", 0.1), fact("2", 0.2)]), ("b", [fact("1", 0.9)])):
        (tmp_path / f"{name}.json").write_text(json.dumps(facts))
    got = read_facts_json(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json"))
    assert {(r.fact_id, r.confidence) for r in got.collect()} == {("1", 0.9), ("2", 0.2)}
    write_facts_json(got, str(tmp_path / "out"))
    assert spark.read.schema(FACT).json(str(tmp_path / "out")).count() == 2
    store = Store(spark, str(tmp_path / "s"))
    load_facts(store, got, spark.createDataFrame([("d1", "d1.pdf"), ("d9", "none.pdf")], "doc_id string, filename string"))
    filing = store.read("filings").first()
    assert filing.stats.kept == 2 and store.read("facts").count() == 2
    assert relate_ranked(store.read("facts")).count() == 0


def test_binary_scan(spark, tmp_path):
    for n, c in (("a.pdf", b"x"), ("b.pdf", b"x"), ("c.pdf", b"y"), ("d.txt", b"z")):
        (tmp_path / n).write_bytes(c)
    rows = read_binaries(spark, str(tmp_path)).collect()
    assert sorted(r.filename for r in rows) == ["a.pdf", "c.pdf"] and all(len(r.doc_id) == 16 for r in rows) and {bytes(r.content) for r in rows} == {b"x", b"y"}


def test_uploads(spark):
    up = spark.createDataFrame([("a", "../../x/A b.PDF", b"1"), ("b", "c:\\t\\k.pdf", b"2"), ("c", "n.txt", b"3")], "doc_id string, filename string, content binary")
    held = spark.createDataFrame([("b",)], "doc_id string")
    assert [(r.doc_id, r.filename) for r in accept_uploads(up, held).collect()] == [("a", "A b.PDF")]
    assert {r.filename for r in accept_uploads(up, held.limit(0)).collect()} == {"A b.PDF", "k.pdf"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_stream_is_idempotent(spark, tmp_path):
    facts = spark.read.parquet("/root/testdata/sf0.001/facts.parquet").limit(60)
    facts.repartition(3).write.parquet(str(tmp_path / "in"))
    facts.repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "s"))
    q = ingest_stream(fact_stream(spark, str(tmp_path / "in"), 2), store, str(tmp_path / "cp"), relate=True)
    q.awaitTermination(300)
    judged = {(r.left_id, r.right_id) for r in store.read("relations").collect()}
    assert judged == {(r.left_id, r.right_id) for r in relate(facts).collect()} and judged
    assert store.read("facts").count() == facts.select("fact_id").distinct().count()


def test_fallback_chain():
    waits, calls = [], []

    def busy(p):
        calls.append("busy")
        raise RuntimeError("503 overloaded")

    def broken(p):
        calls.append("broken")
        raise ValueError("bad key")

    assert chain([busy, broken, str.upper], sleep=waits.append)("x") == "X"
    assert calls == ["busy"] * 3 + ["broken"] and waits == [2.0, 4.0]
    with pytest.raises(ExtractorError):
        chain([broken])("x")
    assert "Passage" in prompt("text")


def test_browse(spark):
    from tests.test_verdicts import fact

    facts = spark.createDataFrame([fact(0, subject="A_b energy", conf=0.9), fact(1, context={"basis": "Energy"}, conf=0.5), fact(2, conf=0.7)], FACT)
    assert [r.fact_id for r in browse.find_facts(facts, search="energy").collect()] == ["f000", "f001"]
    assert browse.find_facts(facts, search="a_b").count() == 1 and browse.find_facts(facts, search="axb").count() == 0
    assert [r.fact_id for r in browse.find_facts(facts, limit=1, offset=1).collect()] == ["f002"]
    rel = spark.createDataFrame([("f000", "f001", "RECONCILED", ["basis"], [], "", "rule", 0.9, None), ("f000", "f009", "CONTRADICTS", [], [], "", "rule", 0.9, None)], "left_id string, right_id string, verdict string, differing_keys array<string>, unstated_keys array<string>, reasoning string, method string, confidence double, judged_at timestamp")
    assert browse.find_relations(rel, facts).count() == 1
    assert browse.find_relations(rel, facts, key="basis", fact_id="f001", search="energy", cross_document=True, verdict="reconciled").count() == 1
    assert browse.find_relations(rel, facts, key="period").count() == 0
    shown = browse.render(browse.with_facts(rel, facts)).first().text
    assert shown.startswith("[RECONCILED] 0.900") and "n.pdf p1: q" in shown
    assert browse.key_chips(rel).where("size(keys) = 1").count() == 1
    stats = browse.corpus_stats(spark.createDataFrame([], "doc_id string, page_count int"), facts, rel).first()
    assert (stats.documents, stats.pages, stats.facts) == (0, 0, 3)
