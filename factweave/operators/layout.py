"""Pages, blocks and spans of parsed documents: offsets, boxes and text layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factweave.functions.text import strip


def flatten_spans(spans: DataFrame) -> DataFrame:
    """Offsets of printed spans in their page's text.

    ``spans`` has (doc_id, page, block, line, span, kind, text, bbox). Only text blocks (kind 0) and spans with text count; a line feed ends each line
    but a block's last, an empty line follows each block. Adds ``start`` and ``stop``; a block whose lines hold no text is left out whole.
    """
    kept = spans.where((F.col("kind") == 0) & (F.length("text") > 0))
    in_order = W.partitionBy("doc_id", "page").orderBy("block", "line", "span")
    line_end = F.lead("line").over(W.partitionBy("doc_id", "page", "block").orderBy("line", "span"))
    gap = F.when(line_end.isNull(), 2).when(line_end != F.col("line"), 1).otherwise(0)
    sized = kept.withColumn("__step", F.length("text") + gap)
    start = F.coalesce(F.sum("__step").over(in_order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return sized.withColumn("start", start).withColumn("stop", F.col("start") + F.length("text")).drop("__step")


def page_blocks(placed: DataFrame) -> DataFrame:
    """(doc_id, page, idx, start, stop, text, bbox): blocks of placed spans with the union of their boxes, numbered from nought."""
    lines = placed.groupBy("doc_id", "page", "block", "line").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda x: x["text"]), "").alias("text"), union_box("bbox").alias("bbox"))
    blocks = lines.groupBy("doc_id", "page", "block").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"), union_box("bbox").alias("bbox"))
    number = (F.row_number().over(W.partitionBy("doc_id", "page").orderBy("block")) - 1).cast("int")
    return blocks.withColumn("idx", number).select("doc_id", "page", "idx", "start", "stop", "text", "bbox")


def page_texts(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, text): the blocks of a page, an empty line after each."""
    joined = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\n\n"), F.lit("\n\n"))
    return blocks.groupBy("doc_id", "page").agg(joined.alias("text"))


def union_box(box: str) -> Column:
    """Aggregate: the least box around all; null without any."""
    c = F.col(box)
    return F.struct(F.min(c["x0"]).alias("x0"), F.min(c["y0"]).alias("y0"), F.max(c["x1"]).alias("x1"), F.max(c["y1"]).alias("y1"))


def boxes_for(spans: Column, start: Column, stop: Column) -> Column:
    """Boxes of a page's spans (an array of STRUCT<start, stop, bbox>) that a half-open range touches."""
    return F.transform(F.filter(spans, lambda s: (s["start"] < stop) & (s["stop"] > start)), lambda s: s["bbox"])


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], width: int = 512) -> DataFrame:
    """(left, right): structs of every two rows with the same keys whose half-open ranges (start, stop) overlap.

    Ranges are laid in bins of ``width`` and meet on (keys, bin), each pair in its first common bin only, so no group is held in a row. Empty ranges and
    null keys or ends meet nothing.
    """
    span = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))
    side = lambda df, name: df.where("stop > start").select(F.struct(*df.columns).alias(name), *[F.col(k).alias(f"{name}_{k}") for k in keys], F.explode(span).alias(f"{name}_bin"))
    l, r = side(left, "left"), side(right, "right")
    met = l.join(r, [F.col(f"left_{k}") == F.col(f"right_{k}") for k in [*keys, "bin"]])
    first = F.floor(F.greatest("left.start", "right.start") / width)
    return met.where("left.start < right.stop AND right.start < left.stop").where(F.col("left_bin") == first).select("left", "right")


def has_text_layer(pages: DataFrame, sample: int = 5, min_chars: int = 50) -> DataFrame:
    """(doc_id, has_text): whether any of up to ``sample`` evenly spread pages holds more than ``min_chars`` stripped characters.

    ``pages`` has (doc_id, page, text) of all pages, blank ones (null or empty text) among them.
    """
    n = F.coalesce(F.length(strip(F.col("text"))), F.lit(0))
    per_doc = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", n.alias("n")))).alias("p"))
    step = F.greatest(F.lit(1), F.expr(f"size(p) div {sample}"))
    seen = F.slice(F.filter("p", lambda x, i: i % step == 0), 1, sample)
    return per_doc.select("doc_id", F.exists(seen, lambda x: x["n"] > min_chars).alias("has_text"))
