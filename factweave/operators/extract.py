"""From extractor payloads to grounded facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factweave.functions.quantities import infer_unit, parse_number, scale, unit_phrase
from factweave.functions.text import grounding_quality, locate, strip
from factweave.operators.dedupe import best_by
from factweave.schema import CONTEXT_KEYS, NULL_LIKE, PAYLOAD
from factweave.session import pin


def payload(c: Column) -> Column:
    """A payload as STRUCT<facts>, or null where it is cut off, empty or no JSON; a fenced one is unwrapped."""
    bare = F.regexp_replace(F.regexp_replace(strip(c), r"^```[a-z]*\s*", ""), r"\s*```$", "")
    whole = bare.rlike(r"(?s)^\{.*\}$")
    return F.when(whole, F.from_json(bare, PAYLOAD, {"mode": "PERMISSIVE"}))


def proposals(extractions: DataFrame) -> DataFrame:
    """(cache_key, doc_id, page, ordinal, raw): the proposals of the latest payload of each call; unreadable payloads give none."""
    latest = best_by(extractions, ["cache_key"], "created_at", "payload")
    read = latest.select("cache_key", "doc_id", "page", payload(F.col("payload"))["facts"].alias("facts"))
    return read.select("cache_key", "doc_id", "page", F.posexplode("facts").alias("ordinal", "raw"))


def failed_calls(extractions: DataFrame) -> DataFrame:
    """(cache_key, doc_id, page): calls whose latest payload can't be read."""
    latest = best_by(extractions, ["cache_key"], "created_at", "payload")
    return latest.where(payload(F.col("payload"))["facts"].isNull()).select("cache_key", "doc_id", "page")


def context_of(raw: Column) -> Column:
    """MAP of the qualifiers that a proposal states, trimmed; words that state nothing are left out."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), strip(raw[k]).alias("value")) for k in CONTEXT_KEYS])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull() & ~F.lower(e["value"]).isin(*NULL_LIKE)))


def context_signature(context: Column) -> Column:
    """Sorted (key, normalised value) of the stated qualifiers."""
    kept = F.filter(F.map_entries(context), lambda e: F.length(e["value"]) > 0)
    return F.array_sort(F.transform(kept, lambda e: F.struct(e["key"].alias("key"), F.lower(strip(e["value"])).alias("value"))))


def fact_id(doc_id: Column, page: Column, start: Column, subject: Column, subject_key: Column, metric: Column, metric_key: Column, raw: Column, value_text: Column, has_quantity: Column) -> Column:
    """Sixteen hex digits over where a fact stands and what it says; its qualifiers are not part of it."""
    some = lambda a, b: F.when(F.length(a) > 0, a).otherwise(F.coalesce(b, F.lit("")))
    said = F.coalesce(F.when(has_quantity, raw).otherwise(value_text), F.lit("None"))
    parts = [F.coalesce(doc_id, F.lit("")), F.coalesce(page.cast("string"), F.lit("None")), F.coalesce(start.cast("string"), F.lit("None")), some(subject_key, subject), some(metric_key, metric), said]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def cache_key(prompt_version: str, model: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(prompt_version), F.char(F.lit(0)), F.lit(model), F.char(F.lit(0)), text), 256)


def with_canonical(df: DataFrame, raw: Column, magnitude: Column, unit: Column, quote: Column) -> DataFrame:
    """Adds ``__value``, ``__name`` and ``__unit``: a quantity in its canonical unit, the quote's unit where its own says nothing."""
    phrase = unit_phrase(unit)
    own = F.when(F.length(magnitude) > 0, magnitude)
    parts = {"__v": parse_number(raw), "__seen": infer_unit(quote), "__u": phrase["unit"], "__k": scale(F.coalesce(own, phrase["magnitude"]))["factor"], "__plain": scale(own)["factor"]}
    df = pin(df, parts)
    again = (F.col("__v").isNull() | F.col("__u").isNull() | (F.col("__u") == "count")) & F.col("__seen").isNotNull()
    df = pin(df, {"__unit": F.when(again, F.col("__seen")).otherwise(unit), "__u2": F.when(again, F.col("__seen")).otherwise(F.col("__u")), "__k2": F.when(again, F.col("__plain")).otherwise(F.col("__k"))})
    u, v = F.col("__u2"), F.col("__v")
    value = F.when(u == "bps", v / 100).when(u == "percent", v).otherwise(v * F.col("__k2"))
    name = F.when(u.isin("bps", "percent"), F.lit("percent")).otherwise(F.coalesce(u, F.lit("count")))
    return pin(df, {"__value": value, "__name": F.when(v.isNotNull(), name)}).drop(*parts, "__u2", "__k2")


def ground(rows: DataFrame) -> DataFrame:
    """Proposals with ``outcome`` (``kept``, ``ungrounded`` or ``empty``), ``span``, ``found`` quote, ``quantity``, ``context`` and ``confidence``.

    ``rows`` has ``raw`` (a proposal), ``window_text`` and ``window_start``. A quote must stand in its window, up to white space.
    """
    raw = F.col("raw")
    at = pin(rows, {"__at": locate(F.col("window_text"), raw["quote"])})
    at = pin(at, {"found": F.expr("substring(window_text, __at.start + 1, __at.stop - __at.start)")})
    at = with_canonical(at, raw["value_raw"], raw["magnitude"], raw["unit"], F.col("found"))
    at = pin(at, {"__quality": grounding_quality(raw["value_raw"], F.col("found")), "__text": F.nullif(strip(F.coalesce(raw["value_text"], F.lit(""))), F.lit("")), "__has": F.coalesce(F.length(strip(raw["value_raw"])) > 0, F.lit(False))})
    quantity = F.struct(strip(raw["value_raw"]).alias("raw"), parse_number(raw["value_raw"]).alias("value"), raw["magnitude"].alias("magnitude"), F.col("__unit").alias("unit"), F.col("__value").alias("canonical_value"), F.col("__name").alias("canonical_unit"))
    out = pin(
        at,
        {
            "outcome": F.when(F.col("__at").isNull(), F.lit("ungrounded")).when(~F.col("__has") & F.col("__text").isNull(), F.lit("empty")).otherwise(F.lit("kept")),
            "span": F.when(F.col("__at").isNotNull(), F.struct((F.col("__at.start") + F.col("window_start")).alias("start"), (F.col("__at.stop") + F.col("window_start")).alias("stop"))),
            "quantity": F.when(F.col("__has"), quantity),
            "value_text": F.col("__text"),
            "context": context_of(raw),
            "confidence": F.round(raw["confidence"] * F.col("__quality.factor") + 1e-9, 3),
            "notes": F.col("__quality.note"),
        },
    )
    return out.drop("__at", "__value", "__name", "__quality", "__unit", "__text", "__has")


def to_facts(grounded: DataFrame) -> DataFrame:
    """Kept proposals as fact rows, each fact_id once: the surest, then the first found."""
    raw = F.col("raw")
    subject, metric = strip(raw["subject"]), strip(raw["metric"])
    page, start = F.col("page"), F.col("span.start")
    subject_key, metric_key = F.lower(subject), F.lower(metric)
    boxes = F.col("bboxes") if "bboxes" in grounded.columns else F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    name = F.col("filename") if "filename" in grounded.columns else F.lit(None).cast("string")
    facts = grounded.where("outcome = 'kept'").select(
        fact_id(F.col("doc_id"), page, start, subject, subject_key, metric, metric_key, F.col("quantity.raw"), F.col("value_text"), F.col("quantity").isNotNull()).alias("fact_id"),
        "doc_id",
        subject.alias("subject"),
        metric.alias("metric"),
        subject_key.alias("subject_key"),
        metric_key.alias("metric_key"),
        raw["fact_type"].alias("fact_type"),
        "quantity",
        "value_text",
        F.col("quantity.canonical_value").alias("canonical_value"),
        F.col("quantity.canonical_unit").alias("canonical_unit"),
        "context",
        raw["valid_from"].alias("valid_from"),
        raw["valid_to"].alias("valid_to"),
        F.struct(F.col("doc_id"), name.alias("filename"), page.alias("page"), start.alias("span_start"), F.col("span.stop").alias("span_end"), F.col("found").alias("quote"), boxes.alias("bboxes")).alias("evidence"),
        "confidence",
        "notes",
        F.col("ordinal").alias("__ordinal"),
        F.col("cache_key").alias("__call"),
    )
    return best_by(facts, ["fact_id"], F.col("confidence"), -F.col("__ordinal"), F.col("__call")).drop("__ordinal", "__call")


def in_reading_order(facts: DataFrame) -> DataFrame:
    """Facts with ``place``, their number (from one) in their document by page and offset; ties by id, unplaced ones first."""
    by_place = W.partitionBy("doc_id").orderBy(F.col("evidence.page"), F.col("evidence.span_start"), F.col("fact_id"))
    return facts.withColumn("place", F.row_number().over(by_place))


def extraction_stats(grounded: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Counters of each document: proposed, kept, dropped_ungrounded, dropped_empty_value, failed_windows, grounding_rate."""
    is_ = lambda o: F.sum(F.when(F.col("outcome") == o, 1).otherwise(0))
    out = grounded.groupBy("doc_id").agg(F.count(F.lit(1)).alias("proposed"), is_("kept").alias("kept"), is_("ungrounded").alias("dropped_ungrounded"), is_("empty").alias("dropped_empty_value"))
    if failed is not None:
        out = out.join(failed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("failed_windows")), "doc_id", "full")
    else:
        out = out.withColumn("failed_windows", F.lit(0).cast("long"))
    counts = ("proposed", "kept", "dropped_ungrounded", "dropped_empty_value", "failed_windows")
    out = out.select("doc_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts])
    return out.withColumn("grounding_rate", F.coalesce(F.try_divide("kept", "proposed"), F.lit(0.0)))


def stats_line(stats: DataFrame) -> DataFrame:
    """(doc_id, summary): the counters as one line."""
    return stats.select("doc_id", F.format_string("%d proposed, %d kept (%d%%), %d ungrounded, %d empty, %d failed", "proposed", "kept", F.expr("(kept * 100 + proposed div 2) div greatest(proposed, 1)"), "dropped_ungrounded", "dropped_empty_value", "failed_windows").alias("summary"))
