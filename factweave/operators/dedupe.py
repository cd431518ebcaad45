"""One row for each key: the latest, the most certain, or the last delivered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The row of each key with the greatest ``order`` columns (nulls least); a map-side aggregation, no sort, no window.

    Columns keep their order. Ties must be broken by ``order``, else any of the tied rows is kept.
    """
    packed = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("__row"))
    return packed.select([F.col("__row")[c].alias(c) for c in df.columns])


def latest_facts(facts: DataFrame) -> DataFrame:
    """The last delivered row of each fact_id; of rows delivered together the most certain."""
    return best_by(facts, ["fact_id"], "ingested_at", "confidence", "doc_id")


def surest_facts(facts: DataFrame) -> DataFrame:
    """The most certain row of each fact_id; of equally certain ones the first delivered."""
    return best_by(facts, ["fact_id"], "confidence", -F.unix_micros(F.col("ingested_at").cast("timestamp")))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` and those rows of ``old`` whose key it does not hold; a null key is a key."""
    condition = [old[k].eqNullSafe(new[k]) for k in keys]
    cond = condition[0]
    for c in condition[1:]:
        cond = cond & c
    return old.join(new, cond, "left_anti").unionByName(new, allowMissingColumns=True)
