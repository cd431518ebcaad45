"""Mixing sources to target shares of the total size in tokens.

Sizes come from a public tokenizer, whose vocabulary file is a parameter and is read where the work is done.
The shares come from capped water-filling: a source that can't supply its share even at its cap is clamped
there, what it lacks is spread over the others in proportion to their targets, and so on until none is over. The
plan has one row a source. Documents are then drawn by seeded hash: whole repetitions, and a fraction of one
more decided document by document. The actual shares are those of the tokens of the documents drawn.
"""

from __future__ import annotations

import base64
import importlib.util
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.session import cut

#: The seed of the draw, whose shares the plan reports.
SEED = 7
#: The package whose folder holds the vocabulary files; ``FACTWEAVE_VOCABULARY`` or an argument names another file.
VOCABULARY = ("public_tokenizers", "byte_bpe_50k.tiktoken")
#: How the tokenizer's words are cut before merging: a fixed value of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer texts go to the tokenizer in pieces, which bounds its memory.
PIECE = 20_000
#: Where any text may be cut without changing its tokens: none goes on from a letter or figure into white space.
_CUT = re.compile(r"(?<=[0-9A-Za-z])(?=[ \n])")


def vocabulary_path(path: str | None = None) -> str:
    if path or os.environ.get("FACTWEAVE_VOCABULARY"):
        return path or os.environ["FACTWEAVE_VOCABULARY"]
    for folder in ("/opt/tokenizers", os.path.dirname(getattr(importlib.util.find_spec(VOCABULARY[0]), "origin", "") or "")):
        if folder and os.path.exists(os.path.join(folder, VOCABULARY[1])):
            return os.path.join(folder, VOCABULARY[1])
    raise FileNotFoundError(f"no {VOCABULARY[1]}; give its path")


_ENCODINGS: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer of a vocabulary file, built once in a worker."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def pieces(text: str, least: int = PIECE) -> Iterator[str]:
    """The text in pieces of at least ``least`` characters that end where a token ends; a stretch without such a place stays whole."""
    start = 0
    while len(text) - start > least and (m := _CUT.search(text, start + least)) is not None:
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def count_tokens(texts: DataFrame, text: str, path: str | None = None) -> DataFrame:
    """``texts`` with ``n_tokens``; a null text has none. The whole text counts."""
    where = vocabulary_path(path)

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(where)
        for s in batches:
            yield pd.Series([0 if t is None else sum(len(enc.encode_ordinary(x)) for x in pieces(t)) for t in s], dtype="int64")

    return texts.withColumn("n_tokens", tokens(text))


def source_key(c: Column) -> Column:
    """Spellings that differ in case, padding, blanks, hyphens or underscores are one; a blank is null."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"(?U)[\s_\-]+", "_"), F.lit(""))


def sized_documents(documents: DataFrame, source: str = "source", text: str = "text", path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(source_key, n_tokens, ``keep``) of every document that has a source."""
    sized = count_tokens(documents.select(source_key(F.col(source)).alias("source_key"), F.col(text).alias("t"), *keep).where("source_key IS NOT NULL"), "t", path)
    return sized.select("source_key", "n_tokens", *keep)


def _sizes(sized: DataFrame) -> DataFrame:
    return sized.groupBy("source_key").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("tokens"))


def source_sizes(documents: DataFrame, source: str = "source", text: str = "text", path: str | None = None) -> DataFrame:
    """(source_key, n_docs, tokens) of every source; documents without a source are left out."""
    return _sizes(sized_documents(documents, source, text, path))


def water_fill(targets: list[tuple[str, float, int, int]], total: float) -> dict[str, dict[str, float]]:
    """The plan of capped water-filling over (source, share, max_repeats, tokens).

    Every source gets ``wanted`` (its share of ``total``), ``supply`` (its tokens times its cap), ``given`` tokens,
    ``repeats`` (given over own tokens) and ``short``. Shares are taken relative to their sum. The given sizes add up
    to ``total`` unless all sources are at their caps.
    """
    scale = sum(max(0.0, s or 0.0) for _, s, _, _ in targets)
    share = {k: (max(0.0, s or 0.0) / scale if scale else 0.0) for k, s, _, _ in targets}
    supply = {k: float(max(0, n or 0)) * max(0, r or 0) for k, _, r, n in targets}
    size = {k: float(max(0, n or 0)) for k, _, _, n in targets}
    given, free, left = {}, set(share), float(total)
    while free:
        weight = sum(share[k] for k in free)
        over = [k for k in sorted(free) if supply[k] <= (left * share[k] / weight if weight else 0.0)]
        if not over:
            given |= {k: left * share[k] / weight if weight else 0.0 for k in free}
            break
        for k in over:
            given[k] = supply[k]
            free.discard(k)
        left = max(0.0, left - sum(given[k] for k in over))
    return {
        k: {"wanted": share[k] * total, "supply": supply[k], "given": given[k], "repeats": given[k] / size[k] if size[k] else 0.0, "short": float(supply[k] < share[k] * total)}
        for k in share
    }


def mixture_plan(documents: DataFrame, targets: DataFrame, path: str | None = None, seed: int = SEED) -> DataFrame:
    """``planned_mixture`` with drawn, the tokens of the documents that ``draw`` takes with this seed, and actual_share, their share of the mix."""
    sized = cut(sized_documents(documents, path=path, keep=("doc_id",)), costly=True)
    plan = cut(planned_mixture(sized, targets))
    used = draw(sized.withColumnRenamed("source_key", "source"), plan, seed, keep=("n_tokens",))
    drawn = used.groupBy("source_key").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("drawn"))
    # one row a target source
    whole = plan.join(F.broadcast(drawn), "source_key", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0).cast("long")))
    mixed = whole.agg(F.sum("drawn").alias("mixed"))
    out = whole.crossJoin(F.broadcast(mixed)).withColumn("actual_share", F.coalesce(F.try_divide(F.col("drawn"), F.col("mixed")), F.lit(0.0)))
    return out.select(*plan.columns[:-1], "drawn", "actual_share", "short")


def planned_mixture(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a target source: source, source_key, target_share, max_repeats, n_docs, tokens, wanted, given, repeats, planned_share, short.

    ``sized`` is of ``sized_documents``.

    The mix is as large as all documents that have a source. A target without documents is short (if its share
    is above nought), a source without a target gets nothing. Both inputs of the plan have one row a target, a
    list that people write; it is refused beyond 10,000 rows.
    """
    spark = sized.sparkSession
    sizes = _sizes(sized)
    wanted = targets.groupBy(source_key(F.col("source")).alias("source_key")).agg(F.min("source").alias("source"), F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    both = sizes.withColumn("all_tokens", F.lit(None).cast("long")).select("source_key", "n_docs", "tokens").join(wanted, "source_key", "full")
    flat = both.withColumn("kept", F.col("source").isNotNull()).groupBy(F.when(F.col("kept"), F.col("source_key")).alias("source_key")).agg(F.first("source").alias("source"), F.first("target_share").alias("target_share"), F.first("max_repeats").alias("max_repeats"), F.sum("n_docs").alias("n_docs"), F.sum("tokens").alias("tokens"))
    rows = flat.limit(10_002).collect()
    if len(rows) > 10_001:
        raise ValueError("more than 10,000 target sources")
    total = sum(r["tokens"] or 0 for r in rows)
    known = [r for r in rows if r["source_key"] is not None]
    plan = water_fill([(r["source_key"], r["target_share"], r["max_repeats"], r["tokens"] or 0) for r in known], total)
    mixed = sum(p["given"] for p in plan.values()) or 1.0
    out = [
        (r["source"], r["source_key"], float(r["target_share"] or 0.0), int(r["max_repeats"] or 0), int(r["n_docs"] or 0), int(r["tokens"] or 0), p["wanted"], p["given"], p["repeats"], p["given"] / mixed, bool(p["short"]))
        for r in known
        for p in [plan[r["source_key"]]]
    ]
    return spark.createDataFrame(out, "source string, source_key string, target_share double, max_repeats int, n_docs long, tokens long, wanted double, given double, repeats double, planned_share double, short boolean")


def draw(documents: DataFrame, plan: DataFrame, seed: int = SEED, doc_id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source_key, uses, ``keep``): how often each document is used, never more than its source's cap.

    ``repeats`` 2.4 means every document twice and four in ten once more, chosen by a seeded hash of the id, so the
    draw is the same on any cluster. The plan has one row a source (see ``mixture_plan``) and is broadcast.
    """
    keyed = documents.select(F.col(doc_id).alias("doc_id"), source_key(F.col("source")).alias("source_key"), *keep)
    coin = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    uses = F.floor("repeats") + F.when(coin < F.col("repeats") - F.floor("repeats"), 1).otherwise(0)
    planned = keyed.join(F.broadcast(plan.select("source_key", "repeats", "max_repeats")), "source_key")
    return planned.select("doc_id", "source_key", F.least(uses, F.col("max_repeats").cast("long")).alias("uses"), *keep).where("uses > 0")
