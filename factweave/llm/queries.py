"""Queries of the problems tagged llm, with oracle SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.components import connected_groups, latest_links
from factweave.llm.leaks import find_leaks, remove_leaks
from factweave.llm.mixture import draw, mixture_plan, planned_mixture, sized_documents
from factweave.llm.names import variants
from factweave.llm.subjects import subject_areas
from factweave.plans.registry import Registry
from factweave.session import cut, table

llm = Registry()

P3_FOUND_SQL = """
WITH RECURSIVE latest AS (
  SELECT least(left_id, right_id) AS a, greatest(left_id, right_id) AS b,
         max({'t': judged_at, 'v': upper(trim(verdict))}) AS s
  FROM relations WHERE left_id <> right_id GROUP BY 1, 2),
links AS (SELECT a, b FROM latest WHERE s.v = 'CORROBORATES'),
both_ways AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
reach(id, r) AS (SELECT u, u FROM both_ways UNION SELECT e.v, x.r FROM reach x JOIN both_ways e ON e.u = x.id WHERE x.r < e.v)
SELECT id AS fact_id, min(r) AS group_id FROM (SELECT id, r FROM reach) GROUP BY id
"""


@llm.query("p3_found", P3_FOUND_SQL)
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every fact linked to another, with the least fact_id of its group."""
    links = latest_links(table(spark, sf, "relations"), "left_id", "right_id", "verdict", "judged_at", "CORROBORATES")
    return connected_groups(links).select(F.col("id").alias("fact_id"), "group_id")


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@llm.query("p6_found")
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and the test items leaked into them."""
    return _leaks(spark, sf).select("doc_id", "item_id").distinct()


@llm.query("p6_clean")
def p6_clean(spark: SparkSession, sf: str) -> DataFrame:
    """All documents, leaked spans cut out of their texts."""
    return remove_leaks(table(spark, sf, "documents"), cut(_leaks(spark, sf))).select("doc_id", "text")


@llm.query("p7_found")
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Target sources that can't supply their share of a mix as large as the corpus."""
    return planned_mixture(sized_documents(table(spark, sf, "documents")), table(spark, sf, "source_targets")).where("short").select("source")


@llm.query("p7_plan")
def p7_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes, given tokens, repeats, planned share and share actually drawn of each target source."""
    return mixture_plan(table(spark, sf, "documents"), table(spark, sf, "source_targets"))


@llm.query("p7_mix")
def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    """How often each document is used in the mix."""
    documents = table(spark, sf, "documents")
    return draw(documents, planned_mixture(sized_documents(documents), table(spark, sf, "source_targets")))


@llm.query("p4_found")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of subject_keys naming the same firm or person, and of metric_keys naming the same measure."""
    return variants(table(spark, sf, "facts"))


def _areas(spark: SparkSession, sf: str) -> DataFrame:
    return subject_areas(table(spark, sf, "documents"), table(spark, sf, "doc_labels"), table(spark, sf, "subject_areas"))


@llm.query("p8_found")
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and the subject areas that at least three of their sentences treat."""
    return _areas(spark, sf).select("doc_id", "subject_code").distinct()


@llm.query("p8_composition")
def p8_composition(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and treated sentences of each subject area in the corpus."""
    return _areas(spark, sf).groupBy("subject_code").agg(F.count_distinct("doc_id").alias("n_docs"), F.sum("n_sentences").alias("n_sentences"))
