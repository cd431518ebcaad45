"""Readings of names whose tokens may stand for several words.

The readings of a name are all choices of one option for each token; their number is a product and is never written out. Instead the
names meet the sets of words that are wanted (targets) on the options of one token, the one that the fewest targets hold, and an
assignment of tokens to words decides for each pair. So all options and all readings count.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.trie import spread
from factweave.session import saved

Option = tuple[int, tuple[str, ...]]


def _placed(firsts: list[set[str]], left: Counter) -> bool:
    """Whether each token can have a word of its own among those left (augmenting paths)."""
    held: dict[str, set[int]] = defaultdict(set)
    at: dict[int, str] = {}
    for i in range(len(firsts)):
        came: dict[str, int] = {}
        queue, end = [i], None
        for j in queue:
            for w in firsts[j]:
                if w in came or left[w] <= 0:
                    continue
                came[w] = j
                if len(held[w]) < left[w]:
                    end = w
                    break
                queue.extend(held[w])
            if end is not None:
                break
        if end is None:
            return False
        while end is not None:
            j = came[end]
            held[end].add(j)
            before, at[j] = at.get(j), end
            if before is not None:
                held[before].discard(j)
            end = before
    return True


def assign(options: list[list[Option]], target: list[str]) -> list[int] | None:
    """The numbers of the first choice of one option a token, in the tokens' order, whose words are together just the target's; None without one.

    Where all options are single words the matching looks ahead exactly, and no choice is ever taken back.
    """
    left = Counter(target)
    fit = [sorted(o for o in opts if all(c <= left[w] for w, c in Counter(o[1]).items())) for opts in options]
    if not fit or not all(fit):
        return None
    firsts = [{ws[0] for _, ws in opts} for opts in fit]
    least, most = ([*accumulate((f(len(ws) for _, ws in opts) for opts in reversed(fit)), initial=0)][::-1] for f in (min, max))
    if not least[0] <= len(target) <= most[0] or not _placed(firsts, left):
        return None
    dead: set[tuple[int, frozenset]] = set()
    chosen: list[Option] = []
    stack, size = [iter(fit[0])], len(target)
    while stack:
        i = len(stack)  # the place after the one that is chosen now
        for k, ws in stack[-1]:
            left.subtract(ws)
            if least[i] <= size - len(ws) <= most[i] and all(left[w] >= 0 for w in ws) and (i, frozenset((+left).items())) not in dead and _placed(firsts[i:], left):
                chosen.append((k, ws))
                size -= len(ws)
                break
            left.update(ws)
        else:
            stack.pop()
            if chosen:
                dead.add((i - 1, frozenset((+left).items())))
                _, ws = chosen.pop()
                left.update(ws)
                size += len(ws)
            continue
        if i == len(fit):
            return [k for k, _ in chosen]
        stack.append(iter(fit[i]))
    return None


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every word walks down the trie of its shard's tokens; each token comes before the words."""

    def rows():
        for pdf in batches:
            yield from zip(pdf["shard"], pdf["token"], pdf["word"], pdf["n"])

    out: list[tuple[str, str, int]] = []
    for shard, members in groupby(rows(), key=lambda r: r[0]):
        root: dict = {}
        for _, token, w, n in members:
            if token is not None:
                node = root
                for c in w[2:]:
                    node = node.setdefault(c, {})
                node.setdefault("", []).append((token, len(w) + (token == w and len(w) > 2), n))
                continue
            stack = [(root, w.index(shard[1], 1) + 1)]
            while stack:
                node, p = stack.pop()
                for c, child in node.items():
                    if c == "":
                        out += [(token, w, n) for token, length, m in child if n > m and len(w) > length]
                    elif (q := w.find(c, p)) >= 0:
                        stack.append((child, q + 1))
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=["token", "word", "n"])
                out = []
    yield pd.DataFrame(out, columns=["token", "word", "n"])


def written_out(tokens: DataFrame, used: DataFrame) -> DataFrame:
    """(token, word, n): all words that a token may abbreviate, those of ``used`` (word, n) that are used more than itself.

    ``tokens`` has (token, word, n): a token ends with a dot where its name has one, ``word`` is without it. The word begins with the token's first
    letter and has its others in order; it is longer, by two letters if there is no dot. Tokens are sharded by their first two letters,
    words by their first one and each other one, so that the tokens met are those that fit so far.
    """
    short = tokens.where("length(word) BETWEEN 2 AND CASE WHEN token <> word THEN 8 ELSE 7 END").select(F.substring("word", 1, 2).alias("shard"), "token", "word", "n")
    others = F.array_distinct(F.split(F.expr("substring(word, 2)"), ""))
    long = used.where("length(word) > 2").select("word", "n", F.explode(others).alias("c")).where("c <> ''").select(F.concat(F.substring("word", 1, 1), "c").alias("shard"), F.lit(None).cast("string").alias("token"), "word", "n")
    rows = short.unionByName(long.join(short.select("shard").distinct(), "shard", "left_semi"))
    # nulls, the words, come last
    return spread(rows, "shard").sortWithinPartitions("shard", F.col("token").asc_nulls_last()).mapInPandas(_walk, "token string, word string, n long")


#: An option counts in all readings, only in those as the name stands, or only in those with what stand-ins take the place of.
ALWAYS, AS_IT_STANDS, STOOD_IN = 0, 1, 2


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows():
        for pdf in batches:
            yield from zip(pdf["name"], pdf["k"], pdf["opts"], pdf["target"])

    columns = ["name", "k", "target", "aside", "rank"]
    out: list[tuple] = []
    for (name, k), members in groupby(rows(), key=lambda r: r[:2]):
        ways: dict[int, list[list[Option]]] = {AS_IT_STANDS: [], STOOD_IN: []}
        for _, _, opts, target in members:
            if target is None:
                read = [o.split(" ") for o in opts]
                for side, there in ways.items():
                    there.append([(int(o[0]), tuple(o[2:])) for o in read if int(o[1]) in (ALWAYS, side)])
                continue
            for side, there in ways.items():
                if (rank := assign(there, target.split(" "))) is not None:
                    out.append((name, k, target, side == STOOD_IN, rank))
                    break
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=columns)
                out = []
    yield pd.DataFrame(out, columns=columns)


def fitting(items: DataFrame, options: DataFrame, targets: DataFrame) -> DataFrame:
    """(name, k, target, aside, rank): all targets that a reading of each item says, with the first such reading.

    ``items`` has (name, k, pos, token), ``options`` (token, idx, side, words) with a token's options numbered from the most likely one,
    ``targets`` (target): words in order and apart by blanks. ``aside`` readings hold an option that is ``STOOD_IN``; they come out only
    where no other says the target. ``rank`` has the numbers of the options in the order of the tokens.
    """
    targets = targets.select("target").distinct()
    held = targets.select("target", F.split("target", " ").alias("ws")).select("target", F.size("ws").alias("size"), F.explode(F.array_distinct("ws")).alias("word"))
    spoken = options.withColumn("word", F.col("words")[0])
    often = held.groupBy("word").agg(F.count(F.lit(1)).alias("often"))
    coded = F.concat_ws(" ", F.col("idx").cast("string"), F.col("side").cast("string"), F.array_join("words", " "))
    per = spoken.join(often, "word", "left").groupBy("token").agg(F.collect_list(coded).alias("opts"), F.max(F.size("words")).alias("most"), F.sum(F.coalesce("often", F.lit(0))).alias("often"))
    laid, _ = saved(items.join(per, "token").select("name", "k", "pos", "token", "opts", "most", "often"))
    only = F.element_at(F.split(F.col("opts")[0], " "), 3)
    whole = laid.groupBy("name", "k").agg(
        F.count(F.lit(1)).alias("least"), F.sum("most").alias("most"), F.max(F.size("opts")).alias("ways"),
        F.min_by("token", F.struct("often", "pos")).alias("token"), F.array_join(F.array_sort(F.collect_list(only)), " ").alias("target"),
    )
    one = whole.where("ways = 1").join(targets, "target", "left_semi").select("name", "k", "target", F.lit(False).alias("aside"), F.expr("array_repeat(0, cast(least AS int))").alias("rank"))
    several = whole.where("ways > 1").select("name", "k", "token", "least", "most")
    met = several.join(spoken.select("token", "word").distinct(), "token").join(held, "word").where("size BETWEEN least AND most").select("name", "k", "target").distinct()
    rows = laid.join(several.select("name", "k"), ["name", "k"], "left_semi").select("name", "k", "pos", "opts", F.lit(None).cast("string").alias("target"))
    rows = rows.unionByName(met.select("name", "k", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("array<string>").alias("opts"), "target"))
    settled = spread(rows, "name", "k").sortWithinPartitions("name", "k", F.col("pos").asc_nulls_last()).select("name", "k", "opts", "target").mapInPandas(_settle, "name string, k int, target string, aside boolean, rank array<int>")
    return one.unionByName(settled)
