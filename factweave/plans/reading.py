"""Queries of layout, reading windows, grounding, extraction and display, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions import text
from factweave.operators import browse, extract, layout
from factweave.operators.dedupe import latest_facts
from factweave.operators.pairs import candidate_pairs
from factweave.operators.verdicts import interesting, judge, ranked
from factweave.operators.windows import build_windows, score_windows, select_windows, text_blocks
from factweave.plans.knowledge import BARE_SQL, FEATURES_SQL, LATEST, LATEST_CALLS_SQL, RELATIONS_LATEST, SCORED_SQL, STRIP, VERDICT_SQL, latest_relations, narrow_latest, pair_features, sql_density, sql_factor, sql_infer, sql_number, sql_unit
from factweave.plans.registry import Registry
from factweave.schema import CONTEXT_KEYS, VERDICTS
from factweave.session import table

reading = Registry()
query = reading.query

# ---- layout ---------------------------------------------------------------------------------------------------

SPANS_SQL = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents WHERE text IS NOT NULL),
spans AS (SELECT doc_id, k // 5 AS block, k AS line, text FROM lines WHERE length(text) > 0 AND length(text) % 7 <> 1),
sized AS (SELECT *, length(text) + CASE WHEN lead(line) OVER (PARTITION BY doc_id, block ORDER BY line) IS NULL THEN 2 ELSE 1 END AS step FROM spans),
placed AS (SELECT doc_id, block, line, text, (coalesce(sum(step) OVER (PARTITION BY doc_id ORDER BY block, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS start FROM sized)"""


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents as printed spans, five lines a block; some are pictures (kind 1)."""
    lines = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "text"))
    box = F.struct(F.lit(0.0).alias("x0"), F.col("k").cast("double").alias("y0"), F.length("text").cast("double").alias("x1"), (F.col("k") + 1).cast("double").alias("y1"))
    return lines.select("doc_id", F.lit(1).alias("page"), F.expr("k div 5").cast("int").alias("block"), F.col("k").alias("line"), F.lit(0).alias("span"), F.when(F.length("text") % 7 == 1, 1).otherwise(0).alias("kind"), "text", box.alias("bbox"))


@query("layout_spans", f"WITH {SPANS_SQL} SELECT doc_id, line::INT AS line, start, (start + length(text))::INT AS stop FROM placed")
def layout_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Printed spans with their offsets in the page."""
    return layout.flatten_spans(_spans(spark, sf)).select("doc_id", "line", "start", "stop")


@query(
    "layout_blocks",
    f"""WITH {SPANS_SQL} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1)::INT AS idx, min(start)::INT AS start, max(start + length(text))::INT AS stop,
  md5(string_agg(text, chr(10) ORDER BY line)) AS text_md5, min(line)::DOUBLE AS y0, max(length(text))::DOUBLE AS x1 FROM placed GROUP BY doc_id, block""",
)
def layout_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of a page, numbered, with text and box."""
    return layout.page_blocks(layout.flatten_spans(_spans(spark, sf))).select("doc_id", "idx", "start", "stop", F.md5("text").alias("text_md5"), "bbox.y0", "bbox.x1")


@query(
    "text_layers",
    f"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, len(string_split(text, chr(10))) AS pages FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, coalesce(length({STRIP('text')}), 0) AS n, i, greatest(1, pages // 5) AS step FROM lines)
SELECT doc_id, coalesce(bool_or(n > 50) FILTER (WHERE i % step = 0 AND i // step < 5), false) AS has_text FROM s GROUP BY doc_id""",
)
def text_layers(spark: SparkSession, sf: str) -> DataFrame:
    """S3: whether sampled pages hold text; the lines of a text stand for pages, blank ones among them."""
    pages = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))
    return layout.has_text_layer(pages)


# ---- reading windows --------------------------------------------------------------------------------------------

WINDOW = 600
WINDOWS_SQL = f"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL),
offsets AS (SELECT doc_id, k, text, (coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS start FROM lines),
blocks AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS idx, start, (start + length(text))::INT AS stop FROM offsets WHERE length(trim(text)) > 0),
reach AS (SELECT a.doc_id, a.idx, any_value(a.start) AS start, max(b.idx) AS last, max(b.stop) AS stop FROM blocks a JOIN blocks b ON a.doc_id = b.doc_id AND b.idx >= a.idx AND (b.idx = a.idx OR b.stop - a.start <= {WINDOW}) GROUP BY a.doc_id, a.idx),
runs AS (SELECT doc_id, idx, last, start, stop FROM reach WHERE idx = 0 UNION ALL SELECT r.doc_id, r.idx, r.last, r.start, r.stop FROM runs w JOIN reach r ON r.doc_id = w.doc_id AND r.idx = w.last + 1)"""


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    return build_windows(text_blocks(table(spark, sf, "documents")), WINDOW)


@query("build_windows", f"WITH RECURSIVE {WINDOWS_SQL} SELECT doc_id, 1::INT AS page, start, stop, idx AS first_idx, last AS last_idx FROM runs")
def build_windows_query(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy reading windows of each document's lines."""
    return _windows(spark, sf)


@query(
    "top_windows",
    f"""WITH RECURSIVE {WINDOWS_SQL}, cut AS (SELECT r.doc_id, r.start, r.stop, substring(d.text, r.start + 1, r.stop - r.start) AS t FROM runs r JOIN documents d USING (doc_id)),
scored AS (SELECT doc_id, start, stop, {sql_density('t')} AS score FROM cut)
SELECT doc_id, 1::INT AS page, start, stop, score, doc_id || ':1:' || start AS window_key FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, start) <= 2""",
)
def top_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The two densest windows of each document."""
    pages = table(spark, sf, "documents").select("doc_id", F.lit(1).alias("page"), "text")
    return select_windows(score_windows(_windows(spark, sf), pages), 2).select("doc_id", "page", "start", "stop", "score", "window_key")


# ---- grounding and extraction -------------------------------------------------------------------------------------


def sql_loose(quote: str) -> str:
    """The pattern of a quote with any run of white space for any other."""
    return f"array_to_string(list_transform(list_filter(string_split_regex({quote}, '[\\s\\x{{00A0}}]+'), lambda w: w <> ''), lambda w: regexp_escape(w)), '[\\s\\x{{00A0}}]+')"


@query(
    "ground_loose",
    f"""WITH q AS (SELECT DISTINCT evidence.quote AS quote FROM facts WHERE length({STRIP('evidence.quote')}) > 0),
w AS (SELECT quote, 'Note' || chr(10) || replace(quote, ' ', chr(10) || '   ') || ' end' AS t FROM q),
m AS (SELECT *, CASE WHEN contains(t, quote) THEN quote ELSE regexp_extract(t, {sql_loose('quote')}) END AS found FROM w)
SELECT quote, (strpos(t, found) - 1)::INT AS start, (strpos(t, found) - 1 + length(found))::INT AS stop FROM m WHERE found <> ''""",
)
def ground_loose(spark: SparkSession, sf: str) -> DataFrame:
    """F16: every quote found in a text that sets it with other white space."""
    quotes = table(spark, sf, "facts").select(F.col("evidence.quote").alias("quote")).where(F.length(text.strip(F.col("quote"))) > 0).distinct()
    there = quotes.withColumn("t", F.concat(F.lit("Note\n"), F.replace("quote", F.lit(" "), F.lit("\n   ")), F.lit(" end")))
    return there.withColumn("at", text.locate(F.col("t"), F.col("quote"))).where("at IS NOT NULL").select("quote", "at.start", "at.stop")


def _grounded(spark: SparkSession, sf: str) -> DataFrame:
    """Stored proposals grounded in what is known of their pages: the tables hold no page text, so the quotes of a page's stored facts stand for it."""
    quotes = table(spark, sf, "facts").select("doc_id", F.col("evidence.page").alias("page"), F.col("evidence.span_start").alias("at"), F.col("evidence.quote").alias("quote")).where("quote IS NOT NULL").distinct()
    pages = quotes.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "quote"))), lambda x: x["quote"]), "\n").alias("window_text"))
    rows = extract.proposals(table(spark, sf, "extractions")).join(pages, ["doc_id", "page"], "left").withColumn("window_text", F.coalesce("window_text", F.lit(""))).withColumn("window_start", F.lit(0))
    return extract.ground(rows)


_FIELDS = ", ".join(f"f->>'{k}' AS {k}" for k in ("subject", "metric", "value_raw", "magnitude", "unit", "value_text", "quote"))
PROPOSALS_SQL = f"""{LATEST_CALLS_SQL},
bare AS (SELECT cache_key, doc_id, page, {BARE_SQL} AS b FROM c),
lists AS (SELECT cache_key, doc_id, page, from_json(json_extract(b, '$.facts'), '["JSON"]') AS l FROM bare WHERE json_valid(b)),
j AS (SELECT cache_key, doc_id, page, unnest(l) AS f, generate_subscripts(l, 1) - 1 AS ordinal FROM lists)"""
GROUNDED_SQL = f"""{PROPOSALS_SQL},
raw AS (SELECT cache_key, doc_id, page, ordinal, {_FIELDS}, (f->>'confidence')::DOUBLE AS conf FROM j),
quotes AS (SELECT DISTINCT doc_id, evidence.page AS page, evidence.span_start AS pos, evidence.quote AS quote FROM facts WHERE evidence.quote IS NOT NULL),
pages AS (SELECT doc_id, page, string_agg(quote, chr(10) ORDER BY pos NULLS FIRST, quote) AS w FROM quotes GROUP BY doc_id, page),
seen AS (SELECT raw.*, coalesce(w, '') AS w FROM raw LEFT JOIN pages USING (doc_id, page)),
met AS (SELECT *, CASE WHEN length({STRIP('quote')}) > 0 THEN CASE WHEN contains(w, quote) THEN quote ELSE nullif(regexp_extract(w, {sql_loose('quote')}), '') END END AS found FROM seen),
stood AS (SELECT *, strpos(w, found) - 1 AS start, coalesce(length({STRIP('value_raw')}) > 0, false) AS has, nullif({STRIP("coalesce(value_text, '')")}, '') AS said FROM met),
num AS (SELECT *, {sql_number('value_raw')} AS v, {sql_unit('unit')} AS u, {sql_factor('magnitude', 'unit')} AS k, {sql_factor('magnitude', 'NULL')} AS plain, {sql_infer('found')} AS shown,
  regexp_extract_all(found, '\\d[\\d,]*(?:\\.\\d+)?') AS nums, {STRIP('value_raw')} AS val FROM stood),
unit2 AS (SELECT *, (v IS NULL OR u IS NULL OR u = 'count') AND shown IS NOT NULL AS again FROM num),
canon AS (SELECT *, CASE WHEN again THEN shown ELSE u END AS u2, CASE WHEN again THEN plain ELSE k END AS k2, len(list_distinct(nums)) AS d, len(list_filter(nums, lambda x: x = val)) AS t FROM unit2),
judged AS (SELECT *, CASE WHEN found IS NULL THEN 'ungrounded' WHEN NOT has AND said IS NULL THEN 'empty' ELSE 'kept' END AS outcome,
  CASE WHEN u2 = 'bps' THEN v / 100 WHEN u2 = 'percent' THEN v ELSE v * k2 END AS cv, CASE WHEN v IS NOT NULL THEN CASE WHEN u2 IN ('bps', 'percent') THEN 'percent' ELSE coalesce(u2, 'count') END END AS cu,
  CASE WHEN value_raw IS NULL OR length(value_raw) = 0 THEN 1.0::DOUBLE WHEN NOT contains(found, val) THEN 0.4::DOUBLE WHEN d <= 2 THEN 1.0::DOUBLE WHEN t > 1 THEN 0.5::DOUBLE ELSE greatest(0.45::DOUBLE, 1.0::DOUBLE - 0.12::DOUBLE * (d - 2)) END AS factor,
  CASE WHEN value_raw IS NULL OR length(value_raw) = 0 THEN NULL WHEN NOT contains(found, val) THEN 'value ''' || val || ''' is not in its own quote' WHEN d <= 2 THEN NULL
    WHEN t > 1 THEN 'value ''' || val || ''' stands ' || t || ' times in its quote' ELSE 'quote holds ' || d || ' numbers; which column it is was inferred' END AS notes FROM canon)"""
EXTRACTED_SQL = f"""WITH {GROUNDED_SQL},
named AS (SELECT *, {STRIP('subject')} AS s, {STRIP('metric')} AS m FROM judged WHERE outcome = 'kept'),
ids AS (SELECT *, sha256(concat_ws('|', coalesce(doc_id, ''), coalesce(page::VARCHAR, 'None'), coalesce(start::VARCHAR, 'None'), coalesce(lower(s), ''), coalesce(lower(m), ''), coalesce(CASE WHEN has THEN val ELSE said END, 'None')))[1:16] AS fact_id,
  round(conf * factor + 1e-9, 3) AS confidence FROM named),
best AS (SELECT max_by(i, {{'c': confidence, 'o': -ordinal, 'k': cache_key}}) AS r FROM ids i GROUP BY fact_id)
SELECT r.fact_id AS fact_id, r.doc_id AS doc_id, lower(r.s) AS subject_key, lower(r.m) AS metric_key, CASE WHEN r.has THEN r.cv END AS canonical_value, CASE WHEN r.has THEN r.cu END AS canonical_unit, r.confidence AS confidence, r.notes AS notes, r.start::INT AS span_start FROM best"""


@query("extracted_facts", EXTRACTED_SQL)
def extracted_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Grounded, normalised facts of the stored payloads."""
    facts = extract.to_facts(_grounded(spark, sf))
    return facts.select("fact_id", "doc_id", "subject_key", "metric_key", "canonical_value", "canonical_unit", "confidence", "notes", F.col("evidence.span_start").alias("span_start"))


STATS_SQL = f"""{GROUNDED_SQL},
counted AS (SELECT doc_id, count(*) AS proposed, count(*) FILTER (WHERE outcome = 'kept') AS kept, count(*) FILTER (WHERE outcome = 'ungrounded') AS dropped_ungrounded, count(*) FILTER (WHERE outcome = 'empty') AS dropped_empty_value FROM judged GROUP BY doc_id),
failed AS (SELECT doc_id, count(*) AS failed_windows FROM bare WHERE NOT coalesce(json_valid(b) AND CASE WHEN json_valid(b) THEN json_type(b, '$.facts') = 'ARRAY' END, false) GROUP BY doc_id),
stats AS (SELECT doc_id, coalesce(proposed, 0) AS proposed, coalesce(kept, 0) AS kept, coalesce(dropped_ungrounded, 0) AS dropped_ungrounded, coalesce(dropped_empty_value, 0) AS dropped_empty_value, coalesce(failed_windows, 0) AS failed_windows
  FROM counted FULL JOIN failed USING (doc_id))"""


@query("extraction_stats", f"WITH {STATS_SQL} SELECT *, coalesce(kept::DOUBLE / nullif(proposed, 0), 0.0::DOUBLE) AS grounding_rate FROM stats")
def extraction_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of each document."""
    return extract.extraction_stats(_grounded(spark, sf), extract.failed_calls(table(spark, sf, "extractions")))


@query("stats_lines", f"WITH {STATS_SQL} SELECT doc_id, proposed || ' proposed, ' || kept || ' kept (' || (kept * 100 + proposed // 2) // greatest(proposed, 1) || '%), ' || dropped_ungrounded || ' ungrounded, ' || dropped_empty_value || ' empty, ' || failed_windows || ' failed' AS summary FROM stats")
def stats_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The counters as one line."""
    return extract.stats_line(extract.extraction_stats(_grounded(spark, sf), extract.failed_calls(table(spark, sf, "extractions"))))


def _stated_sql(key: str) -> str:
    value = STRIP(f"(f->>'{key}')")
    return f"CASE WHEN lower({value}) NOT IN ('', 'null', 'none', 'n/a', 'unknown') THEN '{key}=' || {value} END"


@query("proposal_contexts", f"WITH {PROPOSALS_SQL} SELECT cache_key, ordinal::INT AS ordinal, array_to_string(list_filter([{', '.join(map(_stated_sql, CONTEXT_KEYS))}], lambda x: x IS NOT NULL), ';') AS context FROM j")
def proposal_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """The qualifiers that each proposal states."""
    p = extract.proposals(table(spark, sf, "extractions"))
    return p.select("cache_key", "ordinal", F.array_join(F.transform(F.map_entries(extract.context_of(F.col("raw"))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("context"))


# ---- display, ranking and filters -----------------------------------------------------------------------------------


def sql_general(v: str) -> str:
    e0 = f"floor(log10(abs({v})))::INT"
    m0 = f"round(CASE WHEN {e0} >= 3 THEN abs({v}) / pow(10.0::DOUBLE, {e0} - 3) ELSE abs({v}) * pow(10.0::DOUBLE, 3 - {e0}) END)::BIGINT"
    e, s = f"({e0} + CASE WHEN {m0} >= 10000 THEN 1 ELSE 0 END)", f"(CASE WHEN {m0} >= 10000 THEN '1000' ELSE {m0}::VARCHAR END)"
    tail = lambda x: f"(CASE WHEN length(rtrim({x}, '0')) > 0 THEN '.' || rtrim({x}, '0') ELSE '' END)"
    power = f"{s}[1] || {tail(f'{s}[2:]')} || 'e' || CASE WHEN {e} < 0 THEN '-' ELSE '+' END || CASE WHEN abs({e}) < 10 THEN '0' ELSE '' END || abs({e})"
    small = f"'0.' || repeat('0', -{e} - 1) || rtrim({s}, '0')"
    plain = f"format('{{:,}}', substring({s}, 1, {e} + 1)::BIGINT) || {tail(f'substring({s}, {e} + 2)')}"
    return f"(CASE WHEN {v} = 0 THEN '0' ELSE CASE WHEN {v} < 0 THEN '-' ELSE '' END || CASE WHEN {e} < -4 OR {e} >= 4 THEN {power} WHEN {e} < 0 THEN {small} ELSE {plain} END END)"


def sql_places(v: str, always: bool = False) -> str:
    c = f"round(abs({v}) * 100)::BIGINT"
    part = f"lpad(({c} % 100)::VARCHAR, 2, '0')"
    part = part if always else f"rtrim({part}, '0')"
    return f"(CASE WHEN {v} < 0 AND {c} > 0 THEN '-' ELSE '' END || format('{{:,}}', {c} // 100) || CASE WHEN length({part}) > 0 THEN '.' || {part} ELSE '' END)"


_ENTRIES = "array_to_string(list_transform(list_sort(map_entries(context)), lambda e: e.key || '=' || e.value), ', ')"


@query(
    "fact_lines",
    f"""WITH {LATEST} SELECT fact_id, coalesce(subject, '') || ' · ' || coalesce(metric, '') || ' = ' || coalesce(CASE WHEN quantity.canonical_value IS NOT NULL AND quantity.canonical_unit IS NOT NULL THEN {sql_general('quantity.canonical_value')} || ' ' || quantity.canonical_unit
  WHEN quantity IS NOT NULL THEN quantity.raw ELSE nullif(value_text, '') END, '?') || CASE WHEN length(coalesce({_ENTRIES}, '')) > 0 THEN '  [' || {_ENTRIES} || ']' ELSE '' END AS line FROM latest""",
)
def fact_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Each fact in one line."""
    return browse.describe(narrow_latest(spark, sf, "subject", "metric", "quantity", "value_text", "context"))


_SIGN = "CASE canonical_unit " + " ".join(f"WHEN '{u}' THEN '{s}'" for u, s in browse.SIGNS.items()) + " END"


@query(
    "shown_values",
    f"""SELECT DISTINCT fact_id, CASE WHEN canonical_value IS NULL OR isnan(canonical_value) THEN coalesce(nullif(value_text, ''), '—') WHEN {_SIGN} IS NOT NULL THEN {_SIGN} || CASE WHEN abs(canonical_value) >= 1e6 THEN {sql_places('(canonical_value / 1e6)', True)} || ' Mn' ELSE {sql_places('canonical_value')} END
  WHEN canonical_unit = 'percent' THEN {sql_places('canonical_value')} || '%' WHEN length(canonical_unit) > 0 AND canonical_unit <> 'count' THEN {sql_places('canonical_value')} || ' ' || canonical_unit ELSE {sql_places('canonical_value')} END AS shown FROM facts""",
)
def shown_values(spark: SparkSession, sf: str) -> DataFrame:
    """how values are shown."""
    return table(spark, sf, "facts").select("fact_id", browse.display_value(F.col("canonical_value"), F.col("canonical_unit"), F.col("value_text")).alias("shown")).distinct()


@query("best_pairs", f"WITH {FEATURES_SQL}, {SCORED_SQL} SELECT left_id, right_id FROM pairs ORDER BY score DESC, left_id, right_id LIMIT 500")
def best_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """T4: the best pairs only (the limit is the feature)."""
    return candidate_pairs(pair_features(spark, sf), max_pairs=500).select("left_id", "right_id")


_PLACE = "list_position([" + ", ".join(f"'{v}'" for v in VERDICTS) + "], verdict)"


@query("ranked_relations", f"WITH {FEATURES_SQL}, {SCORED_SQL}, {VERDICT_SQL} SELECT left_id, right_id, verdict, confidence FROM verdicts WHERE verdict <> 'UNRELATED' ORDER BY {_PLACE}, confidence DESC, left_id, right_id LIMIT 200")
def ranked_relations(spark: SparkSession, sf: str) -> DataFrame:
    """The first relations a reader should see (the limit is the feature)."""
    found = interesting(judge(candidate_pairs(pair_features(spark, sf))))
    return ranked(found).limit(200).select("left_id", "right_id", "verdict", "confidence")


@query("document_facts", f"WITH {LATEST} SELECT fact_id, subject, confidence FROM latest WHERE doc_id = (SELECT min(doc_id) FROM filings) AND confidence >= 0")
def document_facts(spark: SparkSession, sf: str) -> DataFrame:
    """All facts of a document."""
    first = table(spark, sf, "filings").agg(F.min("doc_id")).first()[0]
    return browse.find_facts(narrow_latest(spark, sf, "subject"), doc_id=first, limit=None).select("fact_id", "subject", "confidence")


@query("fact_by_id", f"WITH {LATEST} SELECT fact_id, doc_id, subject, metric FROM latest WHERE fact_id = (SELECT max(fact_id) FROM facts)")
def fact_by_id(spark: SparkSession, sf: str) -> DataFrame:
    """One fact by its id."""
    facts = table(spark, sf, "facts")
    wanted = facts.agg(F.max("fact_id")).first()[0]
    return latest_facts(facts.where(F.col("fact_id") == wanted)).select("fact_id", "doc_id", "subject", "metric")


_SIDES = " OR ".join(f"contains(lower(coalesce({x}.{c}, '')), 'power')" for x in ("l", "g") for c in ("subject", "metric"))
_INLINED = f"WITH {LATEST}, {RELATIONS_LATEST} SELECT left_id, right_id, verdict, rel.confidence FROM rel JOIN latest l ON l.fact_id = left_id JOIN latest g ON g.fact_id = right_id"


@query("relations_search", f"{_INLINED} WHERE rel.confidence >= 0 AND ({_SIDES})")
def relations_search(spark: SparkSession, sf: str) -> DataFrame:
    """Relations with a word on either side."""
    return browse.find_relations(latest_relations(spark, sf), narrow_latest(spark, sf, "subject", "metric"), search="Power", limit=None).select("left_id", "right_id", "verdict", "confidence")


_BUSIEST = "(SELECT f FROM (SELECT left_id AS f FROM relations UNION ALL SELECT right_id FROM relations) JOIN (SELECT DISTINCT fact_id FROM facts) ON f = fact_id GROUP BY f ORDER BY count(*) DESC, f LIMIT 1)"


@query("relations_of_fact", f"{_INLINED} WHERE rel.confidence >= 0 AND (left_id = {_BUSIEST} OR right_id = {_BUSIEST})")
def relations_of_fact(spark: SparkSession, sf: str) -> DataFrame:
    """P5: relations that have the fact which most of them are about on either side."""
    facts = table(spark, sf, "facts")
    sides = table(spark, sf, "relations").select(F.explode(F.array("left_id", "right_id")).alias("fact_id")).join(facts.select("fact_id").distinct(), "fact_id", "left_semi")
    busiest = sides.groupBy("fact_id").count().orderBy(F.desc("count"), "fact_id").first()
    return browse.find_relations(latest_relations(spark, sf), narrow_latest(spark, sf), fact_id=busiest["fact_id"] if busiest else "", limit=None).select("left_id", "right_id", "verdict", "confidence")


@query("key_chips", f"WITH {RELATIONS_LATEST} SELECT left_id, right_id, array_to_string(list_concat(list_sort(coalesce(differing_keys, [])), list_filter(list_sort(coalesce(unstated_keys, [])), lambda k: NOT list_contains(coalesce(differing_keys, []), k))), ',') AS keys FROM rel")
def key_chips(spark: SparkSession, sf: str) -> DataFrame:
    """The qualifiers to show, differing ones first."""
    return browse.key_chips(latest_relations(spark, sf)).select("left_id", "right_id", F.array_join("keys", ",").alias("keys"))


@query("reading_order", f"WITH {LATEST} SELECT doc_id, fact_id, row_number() OVER (PARTITION BY doc_id ORDER BY evidence.page NULLS FIRST, evidence.span_start NULLS FIRST, fact_id)::INT AS place FROM latest")
def reading_order(spark: SparkSession, sf: str) -> DataFrame:
    """Facts in the order of reading."""
    place = F.struct("evidence.page", "evidence.span_start").alias("evidence")
    return extract.in_reading_order(narrow_latest(spark, sf, place)).select("doc_id", "fact_id", "place")
