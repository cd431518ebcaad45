"""Reading windows: runs of a page's blocks up to a length, scored and selected."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factweave.functions.text import fact_density
from factweave.session import pin

WINDOW_CHARS = 12_000


def text_blocks(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, page, idx, start, stop, text): the lines of plain texts that hold more than blanks, as blocks of page 1 with code-point offsets."""

    @F.pandas_udf("array<struct<idx:int,start:int,stop:int,text:string>>")
    def lines(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            at, found = 0, []
            for x in (t or "").split("\n"):
                if x.strip(" "):
                    found.append({"idx": len(found), "start": at, "stop": at + len(x), "text": x})
                at += len(x) + 1
            out.append(found)
        return pd.Series(out)

    found = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).where("t IS NOT NULL").select("doc_id", F.explode(lines("t")).alias("x"))
    return found.select("doc_id", F.lit(1).alias("page"), "x.idx", "x.start", "x.stop", "x.text")


def _runs(most: int):
    @F.pandas_udf("array<struct<start:int,stop:int,first:int,last:int>>")
    def runs(pages: pd.Series) -> pd.Series:
        out = []
        for blocks in pages:
            found: list[dict] = []
            for b in blocks:
                if found and b["stop"] - found[-1]["start"] <= most:
                    found[-1]["stop"], found[-1]["last"] = int(b["stop"]), int(b["idx"])
                else:
                    found.append({"start": int(b["start"]), "stop": int(b["stop"]), "first": int(b["idx"]), "last": int(b["idx"])})
            out.append(found)
        return pd.Series(out)

    return runs


def build_windows(blocks: DataFrame, max_chars: int = WINDOW_CHARS) -> DataFrame:
    """(doc_id, page, start, stop, first_idx, last_idx): greedy runs of blocks.

    A block joins the run unless its end lies more than ``max_chars`` past the run's start; a longer block is a run by itself; runs
    never cross pages. Blocks of one page are folded in order, once, within the page's row: a page is bounded by what is printed on it.
    """
    pages = blocks.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "idx"))).alias("blocks"))
    runs = pages.select("doc_id", "page", F.explode(_runs(max_chars)("blocks")).alias("w"))
    return runs.select("doc_id", "page", "w.start", "w.stop", F.col("w.first").alias("first_idx"), F.col("w.last").alias("last_idx"))


def score_windows(windows: DataFrame, pages: DataFrame) -> DataFrame:
    """Windows with their ``text``, ``score`` and ``window_key``; those that score nought fall out. ``pages`` has (doc_id, page, text)."""
    joined = windows.join(pages.select("doc_id", "page", F.col("text").alias("__page")), ["doc_id", "page"])
    cut = pin(joined, {"text": F.expr("substring(__page, start + 1, stop - start)")}).drop("__page")
    return pin(cut, {"score": fact_density(F.col("text"))}).where("score > 0").withColumn("window_key", F.concat_ws(":", "doc_id", "page", "start"))


def select_windows(windows: DataFrame, limit: int | None = None) -> DataFrame:
    """The ``limit`` best windows of each document (all, if it is null or nought), ties in reading order."""
    if not limit:
        return windows
    best = W.partitionBy("doc_id").orderBy(F.desc("score"), "page", "start")
    return windows.withColumn("__rank", F.row_number().over(best)).where(F.col("__rank") <= limit).drop("__rank")
