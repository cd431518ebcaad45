"""Continuous periods and gaps of an entity's half-open intervals, by a sweep line.

Each interval is a plus event on its first day and a minus event on its first day no longer covered. Events
of one (entity, day) are summed before anything is sorted, map side first, so what one entity brings to its
sweep is bounded by the number of days there are, not by its rows; a prefix sum of the net events is the
number of intervals open. A period starts where the sum leaves zero and ends where it returns; touching
intervals cancel on their common day and stay one period. The gap before a period is found on the way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factweave.functions.dates import is_absent, parse_day

FIRST_DAY, LAST_DAY = "0001-01-01", "9999-12-31"


def stated_intervals(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, ``a``, ``b``) of every row that states an interval.

    An absent start is the first day, an absent end the last; rows with both absent, with a value that names
    no real day, or with the end not after the start state none.
    """
    lo, hi = is_absent(F.col(start)), is_absent(F.col(end))
    a = F.when(lo, FIRST_DAY).otherwise(parse_day(F.col(start)))
    b = F.when(hi, LAST_DAY).otherwise(parse_day(F.col(end)))
    present = df.select(F.col(key).alias("key"), F.col(start), F.col(end)).where(~(lo & hi))
    return present.select("key", a.alias("a"), b.alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND b > a")


def periods_and_gaps(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, span_kind ``period`` or ``gap``, span_from, span_to).

    Rows with a null key are one entity of that key; repeated rows change nothing; extra columns are left
    out; an empty table, or one without a stated interval, gives no rows.
    """
    events = stated_intervals(df, key, start, end).select("key", F.explode(F.array(F.struct(F.col("a").alias("day"), F.lit(1).alias("d")), F.struct(F.col("b").alias("day"), F.lit(-1).alias("d")))).alias("e"))
    net = events.groupBy("key", F.col("e.day").alias("day")).agg(F.sum("e.d").alias("net"))
    order = W.partitionBy("key").orderBy("day")
    swept = net.withColumn("open", F.sum("net").over(order.rowsBetween(W.unboundedPreceding, 0)))
    edges = swept.where("(open = 0 AND net <> 0) OR (open > 0 AND open = net)")
    spans = edges.select("key", "day", "open", F.lead("day").over(order).alias("until")).where("until IS NOT NULL")
    return spans.select(F.col("key").alias(key), F.when(F.col("open") > 0, "period").otherwise("gap").alias("span_kind"), F.col("day").alias("span_from"), F.col("until").alias("span_to"))
