"""Trie join: all pairs of strings within a bounded edit distance.

Strings are sharded by their first letters into forward tries and by their last letters into tries of the
reversed strings. In each shard every string runs a Levenshtein automaton (its band of the edit matrix, neighbours
swapped counting as one edit) down the shard's trie, and a branch is left as soon as no cell is within the bound. A pair whose edits
touch both ends meets in neither trie: its first edit lies among the first letters and its last among the last ones. Without one letter
at either place both strings are the same, and an equi-join on strings with such letters left out finds them, so the join is complete
for any bound up to two, for strings of all lengths and shards of any number of letters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_END = ""


def bound(n: int) -> int:
    """Edits allowed for a string of n letters."""
    return 0 if n < 4 else 1 if n < 8 else 2


def build(words: list[str]) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[_END] = w
    return root


def neighbours(root: dict, word: str, k: int) -> Iterator[tuple[str, int]]:
    """(word, distance) of the trie's words within k edits; swapped neighbours are one edit."""
    n = len(word)
    far = k + 1
    stack = [(root, 0, list(range(min(k, n) + 1)) + [far] * (n - min(k, n)), None, "")]
    while stack:
        node, depth, row, before, last = stack.pop()
        if _END in node and row[n] <= k:
            yield node[_END], row[n]
        depth += 1
        lo, hi = max(1, depth - k), min(n, depth + k)
        if lo > n + 1:
            continue
        for c, child in node.items():
            if c == _END:
                continue
            new = [far] * (n + 1)
            if depth <= k:
                new[0] = depth
            least = new[0]
            for j in range(lo, hi + 1):
                if word[j - 1] == c:
                    v = row[j - 1]
                else:
                    v = 1 + min(row[j - 1], row[j], new[j - 1])
                    if before is not None and j > 1 and word[j - 1] == last and word[j - 2] == c and before[j - 2] + 1 < v:
                        v = before[j - 2] + 1
                new[j] = v
                if v < least:
                    least = v
            if least <= k or (before is not None and min(row) <= k):
                stack.append((child, depth, new, row, c))


def edits(a: str, b: str, k: int) -> int:
    """The distance of two strings, k + 1 if it is larger."""
    return next((d for _, d in neighbours(build([b]), a, k)), k + 1)


def _shard_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows():
        for pdf in batches:
            yield from zip(pdf["shard"], pdf["word"])

    out: list[tuple[str, str, int]] = []
    for shard, members in groupby(rows(), key=lambda r: r[0]):
        words = [w for _, w in members]
        back = shard[0] == "<"
        if back:
            words = [w[::-1] for w in words]
        root = build(words)
        for w in words:
            for v, d in neighbours(root, w, bound(len(w))):
                if v != w:
                    a, b = (w[::-1], v[::-1]) if back else (w, v)
                    out.append((a, b, d))
        if len(out) > 20_000:
            yield pd.DataFrame(out, columns=["a", "b", "d"])
            out = []
    yield pd.DataFrame(out, columns=["a", "b", "d"])


def _core_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = [(a, b, d) for a, b in zip(pdf["a"], pdf["b"]) if (d := edits(a, b, bound(len(a)))) <= bound(len(a))]
        yield pd.DataFrame(out, columns=["a", "b", "d"])


def outer_cores(word: str, ends: int) -> set[str]:
    """The word without one of its first letters, one of its last ones, or one of each, and the word itself.

    An edit that changes the first ``ends`` letters has its letter among the first ``ends + 1`` (the second of two swapped ones).
    Both letters are left out only where two edits may lie.
    """
    n = len(word)
    first, last = range(min(ends + 1, n)), range(max(0, n - ends - 1), n)
    out = {word, *(word[:i] + word[i + 1 :] for i in {*first, *last})}
    if n >= 6:
        out |= {word[:i] + word[i + 1 : j] + word[j + 1 :] for i in first for j in last if i < j}
    return out


def cut_letters(ends: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def cores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(w, c) for w in pdf["word"] for c in outer_cores(w, ends)], columns=["word", "core"])

    return cores


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Rows over as many partitions as a shuffle has: few rows may be much work, and adaptive execution would put them into one task."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *columns)


def trie_join(words: DataFrame, word: str, ends: int | None = None) -> DataFrame:
    """(a, b, d): for every distinct string ``a`` its other strings ``b`` within ``bound(len(a))`` edits.

    Nulls and strings under four letters have no neighbours. ``ends`` letters name a shard; by default as many as keep
    a shard of a large vocabulary in the thousands (two up to a million strings, then one more per factor of twenty).
    """
    distinct = words.select(F.col(word).alias("word")).where(F.length(word) >= 4).distinct()
    if ends is None:
        n = distinct.count()
        ends = 2 + sum(n > limit for limit in (10**6, 2 * 10**7, 4 * 10**8))
    shards = distinct.select("word", F.explode(F.array(F.concat(F.lit(">"), F.substring("word", 1, ends)), F.concat(F.lit("<"), F.reverse(F.substring("word", -ends, ends))))).alias("shard"))
    met = spread(shards, "shard").sortWithinPartitions("shard").mapInPandas(_shard_pairs, "a string, b string, d int")
    # edits at both ends: what is left without the letter of the first edit, of the last one, or of both
    cores = distinct.mapInPandas(cut_letters(ends), "word string, core string")
    ends_differ = "substring(l.word, 1, {0}) <> substring(r.word, 1, {0}) AND substring(l.word, -{0}, {0}) <> substring(r.word, -{0}, {0})".format(ends)
    both = cores.alias("l").join(cores.alias("r"), F.col("l.core") == F.col("r.core")).where("l.word <> r.word AND abs(length(l.word) - length(r.word)) <= 2").where(ends_differ)
    differing = spread(both.select(F.col("l.word").alias("a"), F.col("r.word").alias("b")), "a", "b").distinct()
    return met.unionByName(differing.mapInPandas(_core_pairs, "a string, b string, d int")).distinct()
