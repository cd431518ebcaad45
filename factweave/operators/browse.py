"""Filters, joins, counts and paging over the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACT_PAGE, FACT_PAGE_MAX = 100, 1000
RELATION_PAGE, RELATION_PAGE_MAX = 50, 500


def _holds(c: Column, text: str) -> Column:
    return F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(text.lower()))


def page(df: DataFrame, order: list, limit: int | None, offset: int, most: int) -> DataFrame:
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(max(0, min(limit, most)))


def find_facts(facts: DataFrame, doc_id: str | None = None, search: str | None = None, min_confidence: float = 0.0, limit: int | None = FACT_PAGE, offset: int = 0) -> DataFrame:
    """Facts of a document, with a text in subject, metric or qualifiers (case aside, taken literally), the surest first."""
    out = facts.where(F.col("confidence") >= min_confidence)
    if doc_id is not None:
        out = out.where(F.col("doc_id") == doc_id)
    if search:
        out = out.where(_holds(F.col("subject"), search) | _holds(F.col("metric"), search) | _holds(F.to_json("context"), search))
    return page(out, [F.desc("confidence"), "fact_id"], limit, offset, FACT_PAGE_MAX)


def with_facts(relations: DataFrame, facts: DataFrame) -> DataFrame:
    """Relations with both facts inlined as structs ``left`` and ``right``; relations to unknown facts fall out."""
    side = lambda s: facts.select(F.col("fact_id").alias(f"{s}_id"), F.struct(*facts.columns).alias(s))
    return relations.join(side("left"), "left_id").join(side("right"), "right_id")


def find_relations(relations: DataFrame, facts: DataFrame, verdict: str | None = None, fact_id: str | None = None, key: str | None = None, search: str | None = None, cross_document: bool = False, min_confidence: float = 0.0, limit: int | None = RELATION_PAGE, offset: int = 0) -> DataFrame:
    """Relations by verdict, fact, qualifier, text on either side, or between documents, the surest first.

    What concerns the relation alone is filtered before the facts are joined.
    """
    out = relations.where(F.col("confidence") >= min_confidence)
    if verdict:
        out = out.where(F.col("verdict") == verdict.upper())
    if fact_id is not None:
        out = out.where((F.col("left_id") == fact_id) | (F.col("right_id") == fact_id))
    if key:
        out = out.where(F.array_contains("differing_keys", key) | F.array_contains("unstated_keys", key))
    out = with_facts(out, facts)
    if search:
        out = out.where(_holds(F.col("left.subject"), search) | _holds(F.col("left.metric"), search) | _holds(F.col("right.subject"), search) | _holds(F.col("right.metric"), search))
    if cross_document:
        out = out.where("left.doc_id <> right.doc_id")
    return page(out, [F.desc("confidence"), "left_id", "right_id"], limit, offset, RELATION_PAGE_MAX)


def documents_with_counts(filings: DataFrame, facts: DataFrame) -> DataFrame:
    """Documents with ``fact_count``, the last ingested first."""
    counts = facts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("fact_count"))
    return filings.join(counts, "doc_id", "left").withColumn("fact_count", F.coalesce("fact_count", F.lit(0).cast("long"))).orderBy(F.desc("ingested_at"), "doc_id")


def verdict_counts(relations: DataFrame) -> DataFrame:
    return relations.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def corpus_stats(filings: DataFrame, facts: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: documents, facts, pages and a map of verdicts."""
    docs = filings.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("page_count"), F.lit(0).cast("long")).alias("pages"))
    n = facts.agg(F.count(F.lit(1)).alias("facts"))
    said = verdict_counts(relations).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("verdict", "n")))).alias("verdicts"))
    return docs.join(F.broadcast(n)).join(F.broadcast(said))  # each side is one row


def cache_stats(extractions: DataFrame) -> DataFrame:
    return extractions.agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("doc_id").alias("documents"))


def flagged(facts: DataFrame) -> DataFrame:
    """Facts with a note, by document."""
    return facts.groupBy("doc_id").agg(F.count_if(F.length("notes") > 0).alias("flagged"), F.count(F.lit(1)).alias("facts"))


def without_document(doc_id: str, filings: DataFrame, facts: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without a document, its facts, and the relations that touch one of them on either side."""
    gone = facts.where(F.col("doc_id") == doc_id).select("fact_id").distinct()
    kept = relations.join(gone.withColumnRenamed("fact_id", "left_id"), "left_id", "left_anti").join(gone.withColumnRenamed("fact_id", "right_id"), "right_id", "left_anti")
    stays = ~F.col("doc_id").eqNullSafe(F.lit(doc_id))
    return filings.where(stays), facts.where(stays), kept.select(*relations.columns)


def _digits(v: Column, n: int) -> tuple[Column, Column]:
    """(exponent, the first ``n`` decimal digits as text) of a number other than nought, rounded half away from it."""
    a = F.abs(v)
    e = F.floor(F.log10(a)).cast("int")
    m = F.round(F.when(e >= n - 1, a / F.pow(F.lit(10.0), e - (n - 1))).otherwise(a * F.pow(F.lit(10.0), (n - 1) - e)), 0).cast("long")
    over = m >= 10**n
    return e + over.cast("int"), F.when(over, F.lit("1" + "0" * (n - 1))).otherwise(m.cast("string"))


def general_number(v: Column, n: int = 4) -> Column:
    """A number in up to ``n`` digits with thousands set off, in powers of ten where it is under 0.0001 or has more digits before the point."""
    e, s = _digits(v, n)
    tail = lambda x: F.when(F.length(F.rtrim(x, F.lit("0"))) > 0, F.concat(F.lit("."), F.rtrim(x, F.lit("0")))).otherwise(F.lit(""))
    power = F.concat(F.substring(s, 1, 1), tail(F.substring(s, 2, n)), F.lit("e"), F.when(e < 0, F.lit("-")).otherwise(F.lit("+")), F.when(F.abs(e) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(e).cast("string"))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), F.rtrim(s, F.lit("0")))
    plain = F.concat(F.format_number(F.substring(s, F.lit(1), e + 1).cast("long"), 0), tail(F.substring(s, e + 2, F.lit(n))))
    said = F.when((e < -4) | (e >= n), power).when(e < 0, small).otherwise(plain)
    return F.when(v == 0, F.lit("0")).otherwise(F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")), said))


def describe(facts: DataFrame) -> DataFrame:
    """(fact_id, line): each fact in one line; a value that is not stated is a question mark."""
    q = F.col("quantity")
    whole = q["canonical_value"].isNotNull() & q["canonical_unit"].isNotNull()
    value = F.when(whole, F.concat_ws(" ", general_number(q["canonical_value"]), q["canonical_unit"])).when(q.isNotNull(), q["raw"]).otherwise(F.nullif(F.col("value_text"), F.lit("")))
    said = F.array_join(F.transform(F.array_sort(F.map_entries("context")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    named = F.concat(F.coalesce("subject", F.lit("")), F.lit(" · "), F.coalesce("metric", F.lit("")))
    return facts.select("fact_id", F.concat(named, F.lit(" = "), F.coalesce(value, F.lit("?")), F.when(F.length(said) > 0, F.concat(F.lit("  ["), said, F.lit("]"))).otherwise(F.lit(""))).alias("line"))


# The signs of money.
SIGNS = {"INR": "₹", "USD": "$", "EUR": "€", "GBP": "£"}


def _two_places(v: Column, always: bool = False) -> Column:
    """A number with thousands set off and up to two decimals (``always``: just two), rounded half away from nought."""
    cents = F.round(F.abs(v) * 100, 0).try_cast("long")
    part = F.lpad((cents % 100).cast("string"), 2, "0")
    part = part if always else F.rtrim(part, F.lit("0"))
    text = F.concat(F.format_number(F.floor(cents / 100).cast("long"), 0), F.when(F.length(part) > 0, F.concat(F.lit("."), part)).otherwise(F.lit("")))
    return F.concat(F.when((v < 0) & (cents > 0), F.lit("-")).otherwise(F.lit("")), text)


def display_value(value: Column, unit: Column, text: Column | None = None) -> Column:
    """How a value is shown: money with its sign, in millions from a million on, percent with its sign, others with their unit, counts bare.

    Without a number its text, or a dash.
    """
    sign = F.coalesce(*[F.when(unit == u, F.lit(s)) for u, s in SIGNS.items()])
    money = F.concat(sign, F.when(F.abs(value) >= 1e6, F.concat(_two_places(value / 1e6, True), F.lit(" Mn"))).otherwise(_two_places(value)))
    number = _two_places(value)
    other = F.when(unit == "percent", F.concat(number, F.lit("%"))).when((F.length(unit) > 0) & (unit != "count"), F.concat(number, F.lit(" "), unit)).otherwise(number)
    nothing = F.coalesce(F.nullif(text, F.lit("")), F.lit("—")) if text is not None else F.lit("—")
    return F.when(value.isNull() | F.isnan(value), nothing).otherwise(F.coalesce(money, other, general_number(value)))


def key_chips(relations: DataFrame) -> DataFrame:
    """(left_id, right_id, keys): the qualifiers to show, differing ones first, then unstated ones, each in alphabetical order."""
    keys = F.concat(F.array_sort(F.coalesce("differing_keys", F.array().cast("array<string>"))), F.array_sort(F.coalesce("unstated_keys", F.array().cast("array<string>"))))
    return relations.select("left_id", "right_id", F.array_distinct(keys).alias("keys"))


def render(inlined: DataFrame, quote_chars: int = 110, reason_chars: int = 400) -> DataFrame:
    """(left_id, right_id, text): relations with their facts (see ``with_facts``) as text for a console, long quotes cut."""
    side = lambda s: F.concat_ws("", F.lit("  "), F.coalesce(f"{s}.evidence.filename", F.lit("?")), F.lit(" p"), F.col(f"{s}.evidence.page").cast("string"), F.lit(": "), F.substring(f"{s}.evidence.quote", 1, quote_chars))
    head = F.concat_ws("", F.lit("["), "verdict", F.lit("] "), F.format_string("%.3f", "confidence"))
    return inlined.select("left_id", "right_id", F.concat_ws("\n", head, side("left"), side("right"), F.substring(F.coalesce("reasoning", F.lit("")), 1, reason_chars)).alias("text"))
