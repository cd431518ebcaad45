"""Queries of the fact knowledge operators over the domain tables, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions import identity, periods, quantities, text, tokens
from factweave.operators import browse, extract, layout
from factweave.operators.dedupe import best_by, latest_facts, surest_facts, upsert
from factweave.operators.pairs import POSTING_CAP, candidate_ids, candidate_pairs, exact_ids, exact_links, features
from factweave.operators.verdicts import interesting, judge
from factweave.plans.registry import Registry
from factweave.session import saved, table

knowledge = Registry()
query = knowledge.query


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _array(words) -> str:
    return "[" + _list(words) + "]"


LATEST = "latest AS (SELECT r.* FROM (SELECT max_by(f, {'t': ingested_at, 'c': confidence, 'd': doc_id}) AS r FROM facts f GROUP BY fact_id))"
STRIP = lambda c: f"regexp_replace({c}, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g')"
NORM = lambda c: f"lower({STRIP(f'coalesce({c}, chr(0))')})".replace("chr(0)", "''")

# ---- numbers and units ----------------------------------------------------------------------------------------


def sql_number(c: str) -> str:
    s = STRIP(c)
    inner = STRIP(f"regexp_replace({s}, '^\\((.*)\\)$', '\\1', 's')")
    kept = f"regexp_replace({inner}, '[^0-9.]', '', 'g')"
    value = f"CASE WHEN regexp_matches({kept}, '[0-9]') AND NOT regexp_matches({kept}, '\\..*\\.') THEN try_cast({kept} AS DOUBLE) END"
    return f"(CASE WHEN regexp_matches({s}, '^\\(.*\\)$', 's') OR regexp_matches({inner}, '^[-−]') THEN -({value}) ELSE {value} END)"


SCALE_RE = r"(?i)\b(thousand|lakhs?|lacs?|crores?|cr|million|mn|billion|bn|trillion|tn)\b"


def sql_currency(c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{p.replace('(?iu)', '(?i)')}') THEN '{u}'" for u, p in quantities.UNIT_PATTERNS) + " END"


def sql_unit(c: str) -> str:
    s = STRIP(c)
    rest = f"regexp_replace(regexp_replace({s}, '{SCALE_RE}', '', 'g'), '^[ .,\\-–—/()]+|[ .,\\-–—/()]+$', '', 'g')"
    return f"(CASE WHEN length({s}) > 0 THEN CASE WHEN regexp_matches({s}, '{quantities.BPS.replace('(?iu)', '(?i)')}') THEN 'bps' WHEN regexp_matches({s}, '{quantities.PERCENT.replace('(?iu)', '(?i)')}') THEN 'percent' ELSE coalesce({sql_currency(s)}, CASE WHEN length({rest}) >= 2 THEN lower({rest}) END) END END)"


def sql_infer(c: str) -> str:
    return f"(CASE WHEN length({c}) > 0 THEN CASE WHEN regexp_matches({c}, '{quantities.BPS.replace('(?iu)', '(?i)')}') THEN 'bps' ELSE coalesce({sql_currency(c)}, CASE WHEN regexp_matches({c}, '{quantities.PERCENT.replace('(?iu)', '(?i)')}') THEN 'percent' END) END END)"


SCALE_MAP = "MAP {" + ", ".join(f"'{k}': {v!r}::DOUBLE" for k, v in quantities.SCALES.items()) + "}"


def sql_factor(magnitude: str, unit: str) -> str:
    token = f"coalesce(nullif({magnitude}, ''), nullif(lower(regexp_extract({STRIP(unit)}, '{SCALE_RE}', 1)), ''))"
    return f"coalesce(map_extract({SCALE_MAP}, regexp_replace(lower({STRIP(token)}), '\\.+$', ''))[1], 1.0)"


@query(
    "parse_number",
    f"SELECT DISTINCT quantity.raw AS raw, {sql_number('quantity.raw')} AS value FROM facts WHERE quantity IS NOT NULL",
)
def parse_number(spark: SparkSession, sf: str) -> DataFrame:
    """F1 over every printed value."""
    return table(spark, sf, "facts").where("quantity IS NOT NULL").select(F.col("quantity.raw").alias("raw")).distinct().withColumn("value", quantities.parse_number(F.col("raw")))


@query(
    "unit_phrase",
    f"SELECT DISTINCT quantity.unit AS phrase, {sql_unit('quantity.unit')} AS unit, {sql_factor('NULL', 'quantity.unit')} AS factor FROM facts WHERE quantity.unit IS NOT NULL",
)
def unit_phrase(spark: SparkSession, sf: str) -> DataFrame:
    """unit and scale of every unit phrase."""
    p = table(spark, sf, "facts").select(F.col("quantity.unit").alias("phrase")).where("phrase IS NOT NULL").distinct()
    u = quantities.unit_phrase(F.col("phrase"))
    return p.select("phrase", u["unit"].alias("unit"), quantities.scale(u["magnitude"])["factor"].alias("factor"))


@query("infer_unit", f"SELECT evidence.quote AS quote, {sql_infer('evidence.quote')} AS unit, count(*) AS n FROM facts GROUP BY 1, 2")
def infer_unit(spark: SparkSession, sf: str) -> DataFrame:
    """F4 over every quote."""
    return table(spark, sf, "facts").groupBy(F.col("evidence.quote").alias("quote"), quantities.infer_unit(F.col("evidence.quote")).alias("unit")).agg(F.count(F.lit(1)).alias("n"))


def _sql_canonical() -> str:
    return f"""
WITH p AS (SELECT DISTINCT fact_id, quantity.raw AS raw, quantity.magnitude AS mag, quantity.unit AS unit, evidence.quote AS quote FROM facts WHERE quantity IS NOT NULL),
a AS (SELECT *, {sql_number('raw')} AS v, {sql_unit('unit')} AS u, {sql_factor('mag', 'unit')} AS k, {sql_infer('quote')} AS seen FROM p),
b AS (SELECT *, CASE WHEN v IS NOT NULL THEN CASE WHEN u IN ('bps', 'percent') THEN 'percent' ELSE coalesce(u, 'count') END END AS cu FROM a),
c AS (SELECT *, (cu IS NULL OR cu = 'count') AND seen IS NOT NULL AS again FROM b),
d AS (SELECT *, CASE WHEN again THEN seen ELSE u END AS u2, CASE WHEN again THEN {sql_factor('mag', 'NULL')} ELSE k END AS k2 FROM c)
SELECT fact_id, raw, CASE WHEN u2 = 'bps' THEN v / 100 WHEN u2 = 'percent' THEN v ELSE v * k2 END AS value,
       CASE WHEN v IS NOT NULL THEN CASE WHEN u2 IN ('bps', 'percent') THEN 'percent' ELSE coalesce(u2, 'count') END END AS unit
FROM d"""


@query("normalize_quantity", _sql_canonical())
def normalize_quantity(spark: SparkSession, sf: str) -> DataFrame:
    """canonical value and unit of every quantity, the quote's unit where its own says nothing."""
    q = table(spark, sf, "facts").where("quantity IS NOT NULL").select("fact_id", F.col("quantity.raw").alias("raw"), F.col("quantity.magnitude").alias("mag"), F.col("quantity.unit").alias("unit"), F.col("evidence.quote").alias("quote")).distinct()
    c = extract.with_canonical(q, F.col("raw"), F.col("mag"), F.col("unit"), F.col("quote"))
    return c.select("fact_id", "raw", F.col("__value").alias("value"), F.col("__name").alias("unit"))


@query(
    "values_agree",
    """WITH l AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS s FROM lineitem GROUP BY 1)
SELECT o_orderkey, round(abs(o_totalprice - s) / greatest(abs(o_totalprice), abs(s)), 6) AS gap,
       abs(o_totalprice - s) / greatest(abs(o_totalprice), abs(s)) <= 0.005 AS agree
FROM orders JOIN l ON o_orderkey = l_orderkey""",
)
def values_agree(spark: SparkSession, sf: str) -> DataFrame:
    """Stated order totals against the sum of their lines."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("s"))
    both = table(spark, sf, "orders").select("o_orderkey", "o_totalprice").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return both.select("o_orderkey", F.round(quantities.relative_gap(F.col("o_totalprice"), F.col("s")), 6).alias("gap"), quantities.values_agree(F.col("o_totalprice"), F.col("s")).alias("agree"))


# ---- tokens, identity, periods ----------------------------------------------------------------------------------


def sql_tokens(c: str) -> str:
    return f"list_sort(list_filter(list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')), lambda t: length(t) > 1 AND t NOT IN ({_list(tokens.STOP_WORDS)})))"


@query("tokenize", f"SELECT DISTINCT subject, metric, array_to_string({sql_tokens('subject')}, ' ') AS subject_tokens, array_to_string({sql_tokens('metric')}, ' ') AS metric_tokens FROM facts")
def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    """content tokens of subjects and metrics."""
    names = table(spark, sf, "facts").select("subject", "metric").distinct()
    return names.select("subject", "metric", F.array_join(tokens.tokenize(F.col("subject")), " ").alias("subject_tokens"), F.array_join(tokens.tokenize(F.col("metric")), " ").alias("metric_tokens"))


def sql_signature(c: str) -> tuple[str, str]:
    total = f"regexp_matches(coalesce({c}, ''), '{identity.AGGREGATION}')"
    letters = f"array_to_string(list_sort(regexp_extract_all(regexp_extract(coalesce({c}, ''), '{identity.COMPONENTS}', 1), '[A-Z]')), '')"
    return total, letters


@query("metric_signature", "SELECT DISTINCT metric, {0} AS total, {1} AS components FROM facts".format(*sql_signature("metric")))
def metric_signature(spark: SparkSession, sf: str) -> DataFrame:
    """totals and component labels."""
    m = table(spark, sf, "facts").select("metric").distinct()
    s = identity.signature(F.col("metric"))
    return m.select("metric", s["total"].alias("total"), s["components"].alias("components"))


def sql_fiscal(c: str) -> str:
    t = NORM(c)
    fy = periods.FISCAL.replace("(?u)", "")
    g = lambda p, i: f"nullif(regexp_extract({t}, '{p}', {i}), '')"
    last = f"try_cast(coalesce({g(fy, 2)}, {g(fy, 1)}) AS INT)"
    start, end = f"try_cast({g(periods.YEAR_RANGE, 1)} AS INT)", f"try_cast({g(periods.YEAR_RANGE, 2)} AS INT)"
    return f"(CASE WHEN regexp_matches({t}, '{fy}') THEN CASE WHEN {last} < 100 THEN {last} + 2000 ELSE {last} END ELSE CASE WHEN {end} < 100 THEN {start} - {start} % 100 + {end} ELSE {end} END END)"


def sql_vintage(c: str) -> str:
    names = sorted(periods.VINTAGES, key=lambda n: (-len(n), n))
    return "CASE " + " ".join(f"WHEN contains({NORM(c)}, '{n}') THEN {periods.VINTAGES[n]}" for n in names) + " END"


PERIOD_SQL = f"""SELECT period, count(*) AS n, {sql_fiscal('period')} AS fiscal_year, regexp_matches({NORM('period')}, '{periods.AS_OF}') AS as_of,
regexp_extract({NORM('period')}, '{periods.QUARTER}', 1) AS quarter FROM (SELECT context['period'] AS period FROM facts) WHERE period IS NOT NULL GROUP BY period"""


@query("fiscal_period", PERIOD_SQL)
def fiscal_period(spark: SparkSession, sf: str) -> DataFrame:
    """what each spelling of a period denotes."""
    p = table(spark, sf, "facts").select(F.col("context")["period"].alias("period")).where("period IS NOT NULL").groupBy("period").agg(F.count(F.lit(1)).alias("n"))
    x = p.withColumn("p", periods.period_parts(F.col("period")))
    return x.select("period", "n", F.col("p.year").alias("fiscal_year"), F.col("p.as_of").alias("as_of"), F.col("p.quarter").alias("quarter"))


@query(
    "periods_equivalent",
    f"""WITH p AS (SELECT DISTINCT context['period'] AS period FROM facts WHERE context['period'] IS NOT NULL),
x AS (SELECT period, {NORM('period')} AS t, {sql_fiscal('period')} AS y, regexp_matches({NORM('period')}, '{periods.AS_OF}') AS a, regexp_extract({NORM('period')}, '{periods.QUARTER}', 1) AS q FROM p)
SELECT l.period AS a, r.period AS b FROM x l JOIN x r ON l.period < r.period AND l.t <> '' AND r.t <> '' AND (l.t = r.t OR (l.y = r.y AND l.a = r.a AND l.q = r.q))""",
)
def periods_equivalent(spark: SparkSession, sf: str) -> DataFrame:
    """the spellings that denote the same period, met on what they have in common."""
    p = table(spark, sf, "facts").select(F.col("context")["period"].alias("period")).where("period IS NOT NULL").distinct().withColumn("p", periods.period_parts(F.col("period")))
    keys = F.array_compact(F.array(F.concat(F.lit("t"), F.col("p.text")), F.concat_ws("|", F.lit("y"), F.col("p.year"), F.col("p.as_of"), F.col("p.quarter"))))
    keyed = p.withColumn("k", F.explode(keys))
    l, r = keyed.alias("l"), keyed.alias("r")
    met = l.join(r, (F.col("l.k") == F.col("r.k")) & (F.col("l.period") < F.col("r.period")))
    return met.where(periods.periods_equivalent(F.col("l.p"), F.col("r.p"))).select(F.col("l.period").alias("a"), F.col("r.period").alias("b")).distinct()


@query("vintage_rank", f"SELECT vintage, count(*) AS n, {sql_vintage('vintage')} AS rank FROM (SELECT context['vintage'] AS vintage FROM facts) WHERE vintage IS NOT NULL GROUP BY vintage")
def vintage_rank(spark: SparkSession, sf: str) -> DataFrame:
    """F24."""
    v = table(spark, sf, "facts").select(F.col("context")["vintage"].alias("vintage")).where("vintage IS NOT NULL").groupBy("vintage").agg(F.count(F.lit(1)).alias("n"))
    return v.withColumn("rank", periods.vintage_rank(F.col("vintage")))


# ---- text ---------------------------------------------------------------------------------------------------------


def sql_density(c: str) -> str:
    flag = lambda p, w: f"CASE WHEN regexp_matches(strip_accents({c}), '{p}') THEN {w} ELSE 0.0::DOUBLE END"
    ratio = f"(len(regexp_extract_all({c}, '\\d'))::DOUBLE / length({c}))"
    currency = r"(?i)[₹$€£]|\b(?:rs\.?|inr|usd|eur)\b"
    # without accents, as its word bounds know ASCII letters only
    score = f"least({ratio} * 40, 4.0::DOUBLE) + " + " + ".join(flag(p, f"{w}::DOUBLE") for p, w in ((currency, 2.0), (text.MAGNITUDE, 2.0), (text.PERCENT, 1.5), (text.PERIOD, 2.0), (text.MONTH_DATE, 1.5), (text.STATE_VERB, 1.5)))
    score += f" + least(len(regexp_extract_all(strip_accents({c}), '{text.CLAIM}')) * 1.6::DOUBLE, 4.8::DOUBLE)"
    return f"(CASE WHEN length({c}) >= 120 THEN round(({score}) * (CASE WHEN {ratio} > 0.35 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) + 1e-9, 3) ELSE 0.0::DOUBLE END)"


@query("fact_density", f"SELECT doc_id, {sql_density('text')} AS score FROM documents WHERE text IS NOT NULL")
def fact_density(spark: SparkSession, sf: str) -> DataFrame:
    """F15 over whole documents."""
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", text.fact_density(F.col("text")).alias("score"))


@query(
    "ground_exact",
    """WITH b AS (SELECT item_id, regexp_extract(text, '^[^.]*\\.') AS quote FROM benchmark)
SELECT item_id, doc_id, (strpos(d.text, quote) - 1)::INT AS start, (strpos(d.text, quote) - 1 + length(quote))::INT AS stop
FROM b JOIN documents d ON strpos(d.text, quote) > 0 WHERE length(quote) >= 40""",
)
def ground_exact(spark: SparkSession, sf: str) -> DataFrame:
    """First sentences of test items found verbatim in documents, with their offsets.

    A quote meets the documents that hold its longest word, then is located; the words of a quote are few.
    """
    quotes = table(spark, sf, "benchmark").select("item_id", F.regexp_extract("text", r"^[^.]*\.", 0).alias("quote")).where("length(quote) >= 40")
    longest = F.array_sort(F.transform(F.array_distinct(F.regexp_extract_all("quote", F.lit("[A-Za-z]{4,}"), F.lit(0))), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))[0]["w"]
    quotes = quotes.withColumn("word", longest)
    docs = table(spark, sf, "documents").where("text IS NOT NULL")
    wanted = quotes.select("word").distinct()
    words = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0)))).alias("word")).join(wanted, "word", "left_semi")
    met = quotes.join(words, "word").join(docs.select("doc_id", "text"), "doc_id")
    at = met.withColumn("at", F.position("quote", "text")).where("at > 0")
    return at.select("item_id", "doc_id", (F.col("at") - 1).cast("int").alias("start"), (F.col("at") - 1 + F.length("quote")).cast("int").alias("stop"))


@query(
    "grounding_quality",
    """WITH p AS (SELECT DISTINCT quantity.raw AS raw, evidence.quote AS quote FROM facts WHERE quantity IS NOT NULL),
n AS (SELECT *, regexp_extract_all(quote, '\\d[\\d,]*(?:\\.\\d+)?') AS nums FROM p),
k AS (SELECT *, len(list_distinct(nums)) AS d, len(list_filter(nums, lambda x: x = trim(raw))) AS t FROM n)
SELECT raw, quote, CASE WHEN raw IS NULL OR length(raw) = 0 THEN 1.0::DOUBLE WHEN NOT contains(quote, trim(raw)) THEN 0.4::DOUBLE WHEN d <= 2 THEN 1.0::DOUBLE WHEN t > 1 THEN 0.5::DOUBLE
  ELSE greatest(0.45::DOUBLE, 1.0::DOUBLE - 0.12::DOUBLE * (d - 2)) END AS factor FROM k""",
)
def grounding_quality(spark: SparkSession, sf: str) -> DataFrame:
    """F17."""
    p = table(spark, sf, "facts").where("quantity IS NOT NULL").select(F.col("quantity.raw").alias("raw"), F.col("evidence.quote").alias("quote")).distinct()
    return p.withColumn("factor", text.grounding_quality(F.col("raw"), F.col("quote"))["factor"])


@query("content_ids", "SELECT doc_id, sha256(text)[1:16] AS content_id, length(text) AS chars FROM documents WHERE text IS NOT NULL")
def content_ids(spark: SparkSession, sf: str) -> DataFrame:
    """S4, F35."""
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("content_id"), F.length("text").cast("long").alias("chars"))


@query(
    "fact_ids",
    """SELECT fact_id AS stored_id, sha256(concat_ws('|', coalesce(doc_id, ''), coalesce(evidence.page::VARCHAR, 'None'), coalesce(evidence.span_start::VARCHAR, 'None'),
  CASE WHEN length(subject_key) > 0 THEN subject_key ELSE coalesce(subject, '') END, CASE WHEN length(metric_key) > 0 THEN metric_key ELSE coalesce(metric, '') END,
  coalesce(CASE WHEN quantity IS NOT NULL THEN quantity.raw ELSE value_text END, 'None')))[1:16] AS computed_id FROM facts""",
)
def fact_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The identity rule of facts."""
    c = F.col
    return table(spark, sf, "facts").select(c("fact_id").alias("stored_id"), extract.fact_id(c("doc_id"), c("evidence.page"), c("evidence.span_start"), c("subject"), c("subject_key"), c("metric"), c("metric_key"), c("quantity.raw"), c("value_text"), c("quantity").isNotNull()).alias("computed_id"))


# ---- facts by their latest row ----------------------------------------------------------------------------------------


def narrow_latest(spark: SparkSession, sf: str, *columns) -> DataFrame:
    """The latest row of each fact with some columns: what isn't asked for is neither read nor shuffled."""
    return latest_facts(table(spark, sf, "facts").select("fact_id", "doc_id", "confidence", "ingested_at", *columns))


def pair_features(spark: SparkSession, sf: str) -> DataFrame:
    """The features that pairing and judging need, written down."""
    place = F.struct("evidence.page", "evidence.span_start").alias("evidence")
    value = F.struct("quantity.canonical_value", "quantity.canonical_unit")
    quantity = F.when(F.col("quantity").isNotNull(), value).alias("quantity")
    return saved(features(narrow_latest(spark, sf, "subject", "metric", "context", "valid_from", "valid_to", place, quantity)))[0]


# ---- pairs and verdicts ---------------------------------------------------------------------------------------------

FEATURES_SQL = f"""{LATEST},
feat AS (SELECT fact_id, doc_id, {{'d': doc_id, 'p': evidence.page, 's': evidence.span_start, 'i': fact_id}} AS place, {sql_tokens('metric')} AS m, {sql_tokens('subject')} AS s,
  quantity IS NOT NULL AS q, quantity.canonical_value AS v, quantity.canonical_unit AS u, confidence AS c, {sql_signature('metric')[0]} AS total, {sql_signature('metric')[1]} AS parts,
  nullif(valid_from, '') AS vf, nullif(valid_to, '') AS vt, {", ".join(f"nullif(context['{k}'], '') AS x_{k}" for k in ("basis", "entity_scope", "period", "vintage", "geography", "segment", "measure"))} FROM latest),
post AS (SELECT fact_id, doc_id, place, unnest(list_distinct(list_concat(m, s))) AS token FROM feat),
rare AS (SELECT token FROM post GROUP BY token HAVING count(*) > 1 AND count(*) <= 400),
ids AS (SELECT DISTINCT l.fact_id AS left_id, r.fact_id AS right_id FROM post l JOIN rare USING (token) JOIN post r ON l.token = r.token AND l.place < r.place)"""
_LIKE = lambda x: f"greatest(coalesce(len(list_intersect(a.{x}, b.{x}))::DOUBLE / nullif(len(list_distinct(list_concat(a.{x}, b.{x}))), 0), 0.0), 0.9::DOUBLE * coalesce(len(list_intersect(a.{x}, b.{x}))::DOUBLE / nullif(least(len(a.{x}), len(b.{x})), 0), 0.0))"
_DIM = _list(quantities.DIMENSIONED)
SCORED_SQL = f"""wide AS (SELECT left_id, right_id, a, b,
  CASE WHEN len(a.s) = 0 OR len(b.s) = 0 THEN {_LIKE('m')} ELSE 0.7::DOUBLE * {_LIKE('m')} + 0.3::DOUBLE * {_LIKE('s')} END AS score
  FROM ids JOIN feat a ON a.fact_id = left_id JOIN feat b ON b.fact_id = right_id
  WHERE CASE WHEN NOT a.q AND NOT b.q THEN true WHEN a.q <> b.q THEN false
    ELSE coalesce(a.u IS NOT NULL AND a.v IS NOT NULL AND b.u IS NOT NULL AND b.v IS NOT NULL AND (a.u = b.u OR NOT (a.u IN ({_DIM}) OR b.u IN ({_DIM}))), false) END),
pairs AS (SELECT * FROM wide WHERE score >= 0.5)"""


@query("candidate_pairs", f"WITH {FEATURES_SQL}, {SCORED_SQL} SELECT left_id, right_id, round(score, 6) AS score FROM pairs")
def candidate_pairs_query(spark: SparkSession, sf: str) -> DataFrame:
    """Blocked similarity self-join, capped postings, score at least one half."""
    feats = pair_features(spark, sf)
    return candidate_pairs(feats).select("left_id", "right_id", F.round("score", 6).alias("score"))


@query("candidate_pairs_exact", f"WITH {FEATURES_SQL.replace(' AND count(*) <= 400', '')}, {SCORED_SQL} SELECT left_id, right_id, round(score, 6) AS score FROM pairs")
def candidate_pairs_exact(spark: SparkSession, sf: str) -> DataFrame:
    """J3 without the cap: every pair of score at least one half, whatever the frequency of its tokens."""
    feats = pair_features(spark, sf)
    return exact_ids(feats).select("left_id", "right_id", F.round("score", 6).alias("score"))


@query(
    "fact_links",
    f"""WITH {FEATURES_SQL.replace(' AND count(*) <= 400', '')}, {SCORED_SQL}, ends AS (SELECT left_id AS fact_id FROM pairs UNION ALL SELECT right_id FROM pairs),
counted AS (SELECT fact_id, count(*) AS n FROM ends GROUP BY fact_id)
SELECT f.fact_id, min(f.fact_id) OVER (PARTITION BY m, s, u, q, v IS NOT NULL) AS class_id, coalesce(n, 0)::BIGINT AS n_links FROM feat f LEFT JOIN counted USING (fact_id)""",
)
def fact_links(spark: SparkSession, sf: str) -> DataFrame:
    """J3 exactly, one row a fact: its class of facts alike in names and unit, and how many facts it pairs with."""
    value = F.struct("quantity.canonical_value", "quantity.canonical_unit")
    latest = narrow_latest(spark, sf, "subject", "metric", F.when(F.col("quantity").isNotNull(), value).alias("quantity"))
    names = [tokens.tokenize(F.col("metric")).alias("m"), tokens.tokenize(F.col("subject")).alias("s")]
    measured = [F.col("quantity").isNotNull().alias("has_q"), F.col("quantity.canonical_value").alias("v"), F.col("quantity.canonical_unit").alias("u")]
    return exact_links(saved(latest.select("fact_id", "doc_id", F.struct("doc_id", "fact_id").alias("place"), *names, *measured))[0])


def _residual_sql(x: str) -> str:
    def side(own: str, other: str) -> str:
        explained = " ".join(f"WHEN t IN ({_list(g)}) THEN len(list_intersect({other}.{x}, {_array(g)})) > 0" for g in identity.SYNONYMS)
        return f"list_filter({own}.{x}, lambda t: NOT list_contains({other}.{x}, t) AND NOT (CASE {explained} ELSE false END))"

    return f"list_concat({side('a', 'b')}, {side('b', 'a')})"


_NEST = lambda x: f"(len(list_filter(a.{x}, lambda t: NOT list_contains(b.{x}, t))) = 0 OR len(list_filter(b.{x}, lambda t: NOT list_contains(a.{x}, t))) = 0)"


def _period_sql(side: str) -> tuple[str, str, str, str]:
    c = f"{side}.x_period"
    return NORM(c), f"regexp_matches({NORM(c)}, '{periods.AS_OF}')", f"regexp_extract({NORM(c)}, '{periods.QUARTER}', 1)", sql_fiscal(c)


def _differs_sql(k: str) -> str:
    both = f"a.x_{k} IS NOT NULL AND b.x_{k} IS NOT NULL"
    if k != "period":
        return f"CASE WHEN {both} AND {NORM(f'a.x_{k}')} <> {NORM(f'b.x_{k}')} THEN '{k}' END"
    (ta, aa, qa, ya), (tb, ab, qb, yb) = _period_sql("a"), _period_sql("b")
    return f"CASE WHEN {both} AND NOT ({ta} <> '' AND {tb} <> '' AND ({ta} = {tb} OR ({aa} = {ab} AND {qa} = {qb} AND coalesce({ya} = {yb}, false)))) THEN '{k}' END"


_KEYS = ("basis", "entity_scope", "period", "vintage", "geography", "segment", "measure")
VERDICT_SQL = f"""st AS (SELECT left_id, right_id, least(a.c, b.c) * score AS base,
  coalesce(a.vt <= b.vf, false) OR coalesce(b.vt <= a.vf, false) OR ((a.vf IS NOT NULL OR a.vt IS NOT NULL) AND (b.vf IS NOT NULL OR b.vt IS NOT NULL)
    AND NOT (a.vf IS NOT DISTINCT FROM b.vf AND a.vt IS NOT DISTINCT FROM b.vt)) AS apart,
  list_filter([{", ".join(_differs_sql(k) for k in _KEYS)}], lambda t: t IS NOT NULL) AS diff,
  list_filter([{", ".join(f"CASE WHEN (a.x_{k} IS NULL) <> (b.x_{k} IS NULL) THEN '{k}' END" for k in _KEYS)}], lambda t: t IS NOT NULL) AS silent,
  a.v IS NOT NULL AND a.u IS NOT NULL AND b.v IS NOT NULL AND b.u IS NOT NULL AS valued,
  coalesce(a.v = b.v OR abs(a.v - b.v) / nullif(greatest(abs(a.v), abs(b.v)), 0) <= 0.005, false) AS near,
  list_concat(CASE WHEN a.total <> b.total OR a.parts <> b.parts THEN ['{identity.LEVEL}'] ELSE {_residual_sql('m')} END, CASE WHEN len(a.s) = 0 OR len(b.s) = 0 THEN [] ELSE {_residual_sql('s')} END) AS rest,
  len(a.m) > 0 AND len(b.m) > 0 AND {_NEST('m')} AND (len(a.s) = 0 OR len(b.s) = 0 OR {_NEST('s')}) AS inside FROM pairs),
ag AS (SELECT *, valued AND near AS agree, CASE WHEN len(rest) = 0 THEN 'same' WHEN inside AND len(list_intersect(rest, {_array(identity.QUALIFIERS)})) = 0 THEN 'specialisation' ELSE 'different' END AS kind FROM st),
ru AS (SELECT *, CASE WHEN apart THEN 1 WHEN len(diff) > 0 THEN 2 WHEN kind <> 'same' AND agree THEN 3 WHEN kind = 'specialisation' AND valued THEN 4 WHEN kind <> 'same' THEN 5
  WHEN NOT valued THEN 6 WHEN agree THEN 7 WHEN len(silent) > 0 THEN 8 ELSE 9 END AS rule FROM ag),
verdicts AS (SELECT left_id, right_id, ['RECONCILED','RECONCILED','CORROBORATES','LIKELY_CONTRADICTS','UNRELATED','UNRELATED','CORROBORATES','LIKELY_CONTRADICTS','CONTRADICTS'][rule] AS verdict,
  CASE rule WHEN 1 THEN 'valid_time' WHEN 2 THEN array_to_string(diff, ',') WHEN 5 THEN 'metric' ELSE '' END AS differing_keys,
  CASE rule WHEN 4 THEN 'metric_identity' WHEN 8 THEN array_to_string(silent, ',') ELSE '' END AS unstated_keys,
  CASE WHEN rule IN (1, 2, 5, 6) THEN 'rule' ELSE 'arithmetic' END AS method,
  round(CASE rule WHEN 2 THEN base * 0.95::DOUBLE WHEN 3 THEN base * 0.9::DOUBLE WHEN 4 THEN base * 0.45::DOUBLE WHEN 5 THEN base * 0.5::DOUBLE WHEN 6 THEN 0.2::DOUBLE WHEN 8 THEN base * pow(0.6::DOUBLE, len(silent)) ELSE base END + 1e-9, 3) AS confidence FROM ru)"""


def _judged(spark: SparkSession, sf: str, new_ids: DataFrame | None = None, cap: int | None = POSTING_CAP) -> DataFrame:
    feats = pair_features(spark, sf)
    return judge(candidate_pairs(feats, cap=cap, new_ids=new_ids))


@query("verdicts", f"WITH {FEATURES_SQL}, {SCORED_SQL}, {VERDICT_SQL} SELECT * FROM verdicts")
def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """R1 to R9 over all candidate pairs."""
    return _judged(spark, sf).select("left_id", "right_id", "verdict", F.array_join("differing_keys", ",").alias("differing_keys"), F.array_join("unstated_keys", ",").alias("unstated_keys"), "method", "confidence")


@query("rebuild_counts", f"WITH {FEATURES_SQL.replace(' AND count(*) <= 400', '')}, {SCORED_SQL}, {VERDICT_SQL} SELECT verdict, count(*) AS n FROM verdicts WHERE verdict <> 'UNRELATED' GROUP BY verdict")
def rebuild_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of a full rebuild, over all pairs however frequent their tokens are."""
    return browse.verdict_counts(interesting(_judged(spark, sf, cap=None)))


_LAST_DOC = "(SELECT max_by(doc_id, {'t': ingested_at, 'd': doc_id}) FROM filings)"


@query("relate_new", f"WITH {FEATURES_SQL}, {SCORED_SQL}, {VERDICT_SQL} SELECT v.left_id, v.right_id, v.verdict, v.confidence FROM verdicts v JOIN latest l ON l.fact_id = v.left_id JOIN latest r ON r.fact_id = v.right_id WHERE v.verdict <> 'UNRELATED' AND (l.doc_id = {_LAST_DOC} OR r.doc_id = {_LAST_DOC})")
def relate_new(spark: SparkSession, sf: str) -> DataFrame:
    """Relations of the facts of the document taken in last."""
    last = table(spark, sf, "filings").agg(F.max_by("doc_id", F.struct("ingested_at", "doc_id")).alias("doc_id"))
    ids = narrow_latest(spark, sf).join(F.broadcast(last), "doc_id", "left_semi").select("fact_id")
    return interesting(_judged(spark, sf, ids)).select("left_id", "right_id", "verdict", "confidence")


@query("cross_document_ids", f"WITH {FEATURES_SQL} SELECT i.left_id, i.right_id FROM ids i JOIN feat a ON a.fact_id = i.left_id JOIN feat b ON b.fact_id = i.right_id WHERE a.doc_id <> b.doc_id")
def cross_document_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate ids between different documents."""
    return candidate_ids(pair_features(spark, sf), cross_document_only=True)


# ---- stored tables ----------------------------------------------------------------------------------------------------

RELATIONS_LATEST = "rel AS (SELECT r.* FROM (SELECT max_by(x, {'t': judged_at, 'v': verdict, 'c': confidence}) AS r FROM relations x GROUP BY left_id, right_id))"


def latest_relations(spark: SparkSession, sf: str) -> DataFrame:
    return best_by(table(spark, sf, "relations"), ["left_id", "right_id"], "judged_at", "verdict", "confidence")


@query("latest_facts", f"WITH {LATEST} SELECT fact_id, doc_id, subject, metric, confidence, ingested_at FROM latest")
def latest_facts_query(spark: SparkSession, sf: str) -> DataFrame:
    """Last delivered row of each fact."""
    return narrow_latest(spark, sf, "subject", "metric").select("fact_id", "doc_id", "subject", "metric", "confidence", "ingested_at")


@query("surest_facts", "SELECT r.fact_id AS fact_id, r.confidence AS confidence, r.ingested_at AS ingested_at FROM (SELECT max_by(f, {'c': confidence, 't': -epoch_us(ingested_at)}) AS r FROM facts f GROUP BY fact_id)")
def surest_facts_query(spark: SparkSession, sf: str) -> DataFrame:
    """A10: the most certain row of each fact, the first of equals."""
    return surest_facts(table(spark, sf, "facts").select("fact_id", "confidence", "ingested_at")).select("fact_id", "confidence", "ingested_at")


@query("verdict_counts", "SELECT verdict, count(*) AS n FROM relations GROUP BY verdict")
def verdict_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A2."""
    return browse.verdict_counts(table(spark, sf, "relations"))


@query("doc_fact_counts", "SELECT d.doc_id, d.ingested_at, coalesce(n, 0) AS fact_count FROM filings d LEFT JOIN (SELECT doc_id, count(*) AS n FROM facts GROUP BY doc_id) c USING (doc_id)")
def doc_fact_counts(spark: SparkSession, sf: str) -> DataFrame:
    """J2, A4, T3."""
    return browse.documents_with_counts(table(spark, sf, "filings"), table(spark, sf, "facts")).select("doc_id", "ingested_at", "fact_count")


@query("corpus_stats", "SELECT (SELECT count(*) FROM filings) AS documents, (SELECT coalesce(sum(page_count), 0)::BIGINT FROM filings) AS pages, (SELECT count(*) FROM facts) AS facts, (SELECT string_agg(verdict || '=' || n, ';' ORDER BY verdict) FROM (SELECT verdict, count(*) AS n FROM relations GROUP BY verdict)) AS verdicts")
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    """A1, A5."""
    out = browse.corpus_stats(table(spark, sf, "filings"), table(spark, sf, "facts"), table(spark, sf, "relations"))
    return out.withColumn("verdicts", F.array_join(F.transform(F.map_entries("verdicts"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"))


@query("cache_stats", "SELECT count(*) AS entries, count(DISTINCT doc_id) AS documents FROM extractions")
def cache_stats(spark: SparkSession, sf: str) -> DataFrame:
    """A3."""
    return browse.cache_stats(table(spark, sf, "extractions"))


@query("flagged_facts", "SELECT doc_id, count(*) FILTER (WHERE length(notes) > 0) AS flagged, count(*) AS facts FROM facts GROUP BY doc_id")
def flagged_facts(spark: SparkSession, sf: str) -> DataFrame:
    """A7, P18."""
    return browse.flagged(table(spark, sf, "facts"))


@query(
    "facts_query",
    f"""WITH {LATEST} SELECT fact_id, subject, confidence FROM latest WHERE confidence >= 0.8 AND (contains(lower(coalesce(subject, '')), 'energy') OR contains(lower(coalesce(metric, '')), 'energy')
  OR len(list_filter(map_entries(context), lambda e: contains(lower(e.key), 'energy') OR contains(lower(e.value), 'energy'))) > 0) ORDER BY confidence DESC, fact_id LIMIT 100""",
)
def facts_query(spark: SparkSession, sf: str) -> DataFrame:
    """A text search, a page of it (the limit is the feature)."""
    return browse.find_facts(narrow_latest(spark, sf, "subject", "metric", "context"), search="energy", min_confidence=0.8).select("fact_id", "subject", "confidence")


@query(
    "relations_query",
    f"""WITH {LATEST}, {RELATIONS_LATEST} SELECT left_id, right_id, verdict, rel.confidence, l.subject AS left_subject, g.subject AS right_subject
FROM rel JOIN latest l ON l.fact_id = left_id JOIN latest g ON g.fact_id = right_id
WHERE verdict = 'RECONCILED' AND (list_contains(differing_keys, 'period') OR list_contains(unstated_keys, 'period')) AND l.doc_id <> g.doc_id AND rel.confidence >= 0.5
ORDER BY rel.confidence DESC, left_id, right_id LIMIT 500""",
)
def relations_query(spark: SparkSession, sf: str) -> DataFrame:
    """J1, P4, P6, P8, P9, T2 (the limit is the feature)."""
    out = browse.find_relations(latest_relations(spark, sf), narrow_latest(spark, sf, "subject"), verdict="reconciled", key="period", cross_document=True, min_confidence=0.5, limit=500)
    return out.select("left_id", "right_id", "verdict", "confidence", F.col("left.subject").alias("left_subject"), F.col("right.subject").alias("right_subject"))


@query("relations_with_facts", f"WITH {LATEST}, {RELATIONS_LATEST} SELECT left_id, right_id, verdict, l.metric AS left_metric, g.metric AS right_metric FROM rel JOIN latest l ON l.fact_id = left_id JOIN latest g ON g.fact_id = right_id")
def relations_with_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Every relation with both its facts."""
    out = browse.with_facts(latest_relations(spark, sf), narrow_latest(spark, sf, "metric"))
    return out.select("left_id", "right_id", "verdict", F.col("left.metric").alias("left_metric"), F.col("right.metric").alias("right_metric"))


_FIRST_DOC = "(SELECT min(doc_id) FROM filings)"


@query(
    "delete_cascade",
    f"""SELECT 'filings' AS tbl, count(*) AS n FROM filings WHERE doc_id <> {_FIRST_DOC} UNION ALL SELECT 'facts', count(*) FROM facts WHERE doc_id IS DISTINCT FROM {_FIRST_DOC}
UNION ALL SELECT 'relations', count(*) FROM relations WHERE left_id NOT IN (SELECT fact_id FROM facts WHERE doc_id = {_FIRST_DOC}) AND right_id NOT IN (SELECT fact_id FROM facts WHERE doc_id = {_FIRST_DOC})""",
)
def delete_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """What is left without the first document."""
    filings, facts, relations = table(spark, sf, "filings"), table(spark, sf, "facts"), table(spark, sf, "relations")
    first = filings.agg(F.min("doc_id")).first()[0]
    left = browse.without_document(first, filings, facts, relations)
    count = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "n")
    return count("filings", left[0]).unionByName(count("facts", left[1])).unionByName(count("relations", left[2]))


@query(
    "upsert_filings",
    """WITH new AS (SELECT doc_id || '' AS doc_id, 'renamed' AS filename FROM filings WHERE page_count % 2 = 0)
SELECT DISTINCT doc_id, filename FROM filings WHERE doc_id NOT IN (SELECT doc_id FROM new) UNION SELECT DISTINCT doc_id, filename FROM new""",
)
def upsert_filings(spark: SparkSession, sf: str) -> DataFrame:
    """Filings of an even number of pages taken in again under another name."""
    filings = table(spark, sf, "filings").select("doc_id", "filename", "page_count")
    new = filings.where("page_count % 2 = 0").select("doc_id", F.lit("renamed").alias("filename")).distinct()
    return upsert(filings.select("doc_id", "filename"), new, ["doc_id"]).distinct()


@query("context_signature", "SELECT fact_id, coalesce(array_to_string(list_sort(list_transform(list_filter(map_entries(context), lambda e: length(e.value) > 0), lambda e: e.key || '=' || lower(trim(e.value)))), ';'), '') AS signature FROM facts")
def context_signature(spark: SparkSession, sf: str) -> DataFrame:
    """F37."""
    sig = F.transform(extract.context_signature(F.col("context")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return table(spark, sf, "facts").select("fact_id", F.coalesce(F.array_join(F.array_sort(sig), ";"), F.lit("")).alias("signature"))


BARE_SQL = "regexp_replace(regexp_replace(trim(payload, ' ' || chr(10)), '^```[a-z]*\\s*', ''), '\\s*```$', '')"
LATEST_CALLS_SQL = "c AS (SELECT r.* FROM (SELECT max_by(x, {'t': created_at, 'p': payload}) AS r FROM extractions x GROUP BY cache_key))"


@query("proposals", f"WITH {LATEST_CALLS_SQL}, j AS (SELECT cache_key, doc_id, page, unnest(from_json(json_extract({BARE_SQL}, '$.facts'), '[\"JSON\"]')) AS f FROM c WHERE json_valid({BARE_SQL})) SELECT cache_key, doc_id, page, f->>'subject' AS subject, f->>'metric' AS metric, f->>'value_raw' AS value_raw, (f->>'confidence')::DOUBLE AS confidence FROM j")
def proposals(spark: SparkSession, sf: str) -> DataFrame:
    """The proposals of readable payloads."""
    p = extract.proposals(table(spark, sf, "extractions"))
    return p.select("cache_key", "doc_id", "page", *[F.col(f"raw.{c}").alias(c) for c in ("subject", "metric", "value_raw", "confidence")])


@query("page_boxes", "SELECT doc_id, evidence.page AS page, count(*) AS n, min(b.x0) AS x0, min(b.y0) AS y0, max(b.x1) AS x1, max(b.y1) AS y1 FROM (SELECT doc_id, evidence, unnest(evidence.bboxes) AS b FROM facts) GROUP BY doc_id, evidence.page")
def page_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """The box around all evidence of a page."""
    boxes = table(spark, sf, "facts").select("doc_id", F.col("evidence.page").alias("page"), F.explode("evidence.bboxes").alias("b"))
    u = boxes.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"), layout.union_box("b").alias("u"))
    return u.select("doc_id", "page", "n", "u.x0", "u.y0", "u.x1", "u.y1")


@query(
    "evidence_overlaps",
    """WITH e AS (SELECT DISTINCT fact_id, doc_id, evidence.page AS page, evidence.span_start AS s, evidence.span_end AS t FROM facts WHERE evidence.span_end > evidence.span_start)
SELECT a.fact_id AS fact_id, count(b.fact_id) AS touching FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.page = b.page AND b.s < a.t AND b.t > a.s AND a.fact_id <> b.fact_id GROUP BY a.fact_id""",
)
def evidence_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Facts whose evidence ranges overlap on a page."""
    e = table(spark, sf, "facts").select("fact_id", "doc_id", F.col("evidence.page").alias("page"), F.col("evidence.span_start").alias("start"), F.col("evidence.span_end").alias("stop")).where("stop > start").distinct()
    met = layout.overlaps(e, e, ["doc_id", "page"]).where("left.fact_id <> right.fact_id")
    return met.groupBy(F.col("left.fact_id").alias("fact_id")).agg(F.count(F.lit(1)).alias("touching"))
