"""Ingest and relate: the driver functions over the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators.browse import verdict_counts
from factweave.operators.dedupe import latest_facts
from factweave.operators.extract import extraction_stats, ground, payload, to_facts
from factweave.operators.layout import boxes_for, flatten_spans, has_text_layer, page_blocks, page_texts
from factweave.operators.pairs import POSTING_CAP, THRESHOLD, candidate_pairs, features
from factweave.operators.verdicts import interesting, judge, ranked
from factweave.operators.windows import WINDOW_CHARS, build_windows, score_windows, select_windows
from factweave.session import cut, saved
from factweave.sources.connect import PROMPT_VERSION, Extractor, IngestError, Parser, call_extractor, parse_documents
from factweave.sources.files import facts_per_document
from factweave.sources.store import Store


def relate(facts: DataFrame, threshold: float = THRESHOLD, cap: int | None = POSTING_CAP, min_confidence: float = 0.0, cross_document_only: bool = False, max_pairs: int | None = None, new_ids: DataFrame | None = None) -> DataFrame:
    """Interesting relations among facts (each fact_id taken once, its latest row)."""
    feats, _ = saved(features(latest_facts(facts)))
    pairs = candidate_pairs(feats, threshold, cap, cross_document_only, new_ids, max_pairs)
    return interesting(judge(pairs), min_confidence)


def relate_ranked(facts: DataFrame, max_pairs: int | None = 20_000, **options) -> DataFrame:
    """``relate`` over at most ``max_pairs`` best pairs, in the order a reader wants them."""
    return ranked(relate(facts, max_pairs=max_pairs, **options))


def rebuild_relations(store: Store, **options) -> DataFrame:
    """Judges all facts afresh and replaces the stored relations; gives the counts of verdicts."""
    found = cut(relate(store.read("facts"), **options).withColumn("judged_at", F.current_timestamp()))
    store.replace("relations", found)
    return verdict_counts(found)


def relate_new(store: Store, new_ids: DataFrame, **options) -> DataFrame:
    """Judges the pairs with at least one new fact and adds them; pairs judged before from the other side are replaced."""
    found = cut(relate(store.read("facts"), new_ids=new_ids, **options).withColumn("judged_at", F.current_timestamp()))
    swapped = found.select(F.col("left_id").alias("right_id"), F.col("right_id").alias("left_id"))
    store.delete("relations", swapped)
    store.save("relations", found)
    return verdict_counts(found)


def ingest(store: Store, binaries: DataFrame, parser: Parser, extractor: Extractor, model: str = "stub", window_limit: int | None = None, max_chars: int = WINDOW_CHARS, version: str = PROMPT_VERSION) -> DataFrame:
    """Takes in documents (doc_id, filename, content) that the store does not hold; gives (doc_id, outcome, counters) of each.

    Parsed spans become pages and blocks, blocks reading windows, windows payloads (cached ones first), payloads grounded facts. The outcome is ``ingested``,
    ``no text layer`` or ``no passage``; only where no document of a call can be taken in an error is raised.
    """
    new = binaries.join(store.read("filings").select("doc_id"), "doc_id", "left_anti")
    names = new.select("doc_id", "filename")
    spans, _ = saved(parse_documents(new, parser))
    placed, _ = saved(flatten_spans(spans))
    blocks, _ = saved(page_blocks(placed))
    texts = page_texts(blocks)
    numbers = spans.groupBy("doc_id").agg(F.explode(F.sequence(F.lit(1), F.max("page"))).alias("page"))
    layered, _ = saved(has_text_layer(numbers.join(texts, ["doc_id", "page"], "left")).where("has_text").select("doc_id"))
    pages, _ = saved(texts.join(layered, "doc_id", "left_semi"))
    windows, _ = saved(select_windows(score_windows(build_windows(blocks, max_chars), pages), window_limit))
    answers, _ = saved(call_extractor(windows, store.read("extractions"), extractor, model, version))
    fresh = answers.where("NOT hit AND payload IS NOT NULL").select("cache_key", "doc_id", "page", "model", "payload", F.current_timestamp().alias("created_at"))
    read = answers.withColumn("facts", payload(F.col("payload"))["facts"])
    rows = read.where("facts IS NOT NULL").select("cache_key", "doc_id", "page", F.col("start").alias("window_start"), F.col("text").alias("window_text"), F.posexplode("facts").alias("ordinal", "raw")).join(names, "doc_id")
    grounded, _ = saved(ground(rows))
    boxes = placed.groupBy("doc_id", "page").agg(F.collect_list(F.struct("start", "stop", "bbox")).alias("spans"))
    boxed = grounded.join(boxes, ["doc_id", "page"], "left").withColumn("bboxes", boxes_for(F.col("spans"), F.col("span.start"), F.col("span.stop"))).drop("spans")
    facts, _ = saved(to_facts(boxed).withColumn("ingested_at", F.current_timestamp()))
    stats = extraction_stats(grounded, read.where("facts IS NULL"))
    read_windows = answers.groupBy("doc_id").agg(F.count(F.lit(1)).alias("windows_read"), F.count_if("hit").alias("cache_hits"))
    counters = ("windows_read", "proposed", "kept", "dropped_ungrounded", "dropped_empty_value", "failed_windows", "cache_hits")
    counted = names.select("doc_id").join(layered.withColumn("layer", F.lit(True)), "doc_id", "left").join(read_windows, "doc_id", "left").join(stats, "doc_id", "left")
    outcome = F.when(F.col("layer").isNull(), "no text layer").when(F.col("windows_read").isNull(), "no passage").otherwise("ingested")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c)
    report, _ = saved(counted.select("doc_id", outcome.alias("outcome"), *[zero(c) for c in counters], F.coalesce("grounding_rate", F.lit(0.0)).alias("grounding_rate")))
    said = {r["outcome"] for r in report.select("outcome").distinct().collect()}
    if said and "ingested" not in said:
        raise IngestError("nothing taken in: " + ", ".join(sorted(said)))
    if said:
        store.save("extractions", fresh)
        per_doc = pages.groupBy("doc_id").agg(F.sum(F.length("text")).alias("char_count")).join(numbers.groupBy("doc_id").agg(F.max("page").cast("int").alias("page_count")), "doc_id")
        taken = report.where("outcome = 'ingested'").join(names, "doc_id").join(per_doc, "doc_id")
        store.save("filings", taken.select("doc_id", "filename", "page_count", "char_count", F.current_timestamp().alias("ingested_at"), F.struct(*counters).alias("stats")))
        store.save("facts", facts)
        relate_new(store, facts.select("fact_id"))
    return report


def load_facts(store: Store, facts: DataFrame, names: DataFrame) -> DataFrame:
    """Bulk load: facts (each id once) with their documents, named by ``names`` (doc_id, filename), then all relations afresh."""
    counts = facts_per_document(facts)
    known = names.join(counts, "doc_id", "inner").select("doc_id", "filename", F.current_timestamp().alias("ingested_at"), F.struct(*[F.when(F.lit(c in ("proposed", "kept")), F.col(f"stats.{c}") if c in ("proposed", "kept") else F.lit(0)).otherwise(0).cast("int").alias(c) for c in ("windows_read", "proposed", "kept", "dropped_ungrounded", "dropped_empty_value", "failed_windows", "cache_hits")]).alias("stats"))
    store.save("filings", known)
    store.save("facts", facts.join(names.select("doc_id"), "doc_id", "left_semi"))
    return rebuild_relations(store)
