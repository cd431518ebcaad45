"""Passages of held-out test items inside training documents.

The n-grams of the normalised test items form a set that is broadcast; every window of n tokens of every
document is looked up in it. Documents with hits are verified: around the hits the longest common
subsequence with the item is found, stretch by stretch, and a document is a case if one or two stretches
in the item's order hold the wanted share of its words, its names and figures (two at least) among them.

Names and figures are words of few passages of the whole test set; items that share most of their n-grams (several
questions on one text, an item under other ids) are one passage. An item with fewer than two such words is verified by
the share of its n-grams alone.

The broadcast set is bounded: test items beyond ``block_chars`` characters come in that many blocks, each broadcast by itself and held by
a worker one after the other; documents are cut into words once for all of them. Words are counted before blocks are cut, so blocks don't
change the result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A leak may be edited lightly, which breaks long windows; three words keep a hit between two edits.
NGRAM = 3
#: Words held for one item, and for names and figures within the stretches found.
SHARE, MARKED_SHARE = 1 / 3, 0.5
#: Tokens between two hits of one stretch, at most.
GAP = 12
#: N-grams shared with a longer item from which an item is of its passage.
SAME_PASSAGE = 0.6
SCHEMA = "doc_id long, item_id long, matched int, item_words int, spans array<struct<start:int,stop:int>>"

_TOKEN = re.compile("[a-z]+|\\d{1,3}(?:[,  ]\\d{2,3})+(?:\\.\\d+)?|\\d+(?:\\.\\d+)?|[^\\W\\d_]+")
_BROKEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t]*(?=[^\W\d_])")
_GROUP = str.maketrans("", "", ",  ")
_MARKS = re.compile("[̀-ͯ]+")
_THIN = re.compile("(?<=\\d)[\u00a0\u202f](?=\\d{2,3})")


def joined_groups(text: str) -> str:
    """Group marks that are spaces as commas, which the folding below leaves alone; as long as the text itself."""
    return _THIN.sub(",", text) if "\u00a0" in text or "\u202f" in text else text


def plain(text: str) -> str:
    """Lower case, without accents; as long as the text itself if that is ASCII."""
    if text.isascii():
        return text.lower()
    text = joined_groups(text)
    return _MARKS.sub("", unicodedata.normalize("NFKD", text.lower()))


def tokens(text: str) -> list[str]:
    """Words and figures, figures without group marks; a word broken at a line's end is whole."""
    text = plain(text)
    if "-\n" in text or "-\r" in text or "- \n" in text:
        text = _BROKEN.sub("", text)
    return [t if t[0] > "9" or t.isdigit() else t.translate(_GROUP) for t in _TOKEN.findall(text)]


def passage_marks(blocks: Iterable[list[tuple[int, str]]], n: int = NGRAM, same: float = SAME_PASSAGE) -> set[str]:
    """The words of a whole test set that are names and figures: what few passages have, and in a small set also looks like one."""
    items = sorted({tuple(ws): t for rows in blocks for _, t in rows if (ws := tokens(t or ""))}.items(), key=lambda x: (-len(x[0]), x[0]))
    passages: list[set[str]] = []
    owner: dict[int, set[int]] = defaultdict(set)
    named: set[str] = set()
    for ws, text in items:
        named |= {plain(w) for w in re.findall(r"(?<![.?!] )(?<!^)\b[^\W\d_]+", text) if w[0].isupper()}
        grams = {hash(ws[p : p + n]) for p in range(len(ws) - n + 1)}
        shared = Counter(k for g in grams for k in owner.get(g, ()))
        k, held = max(shared.items(), key=lambda x: (x[1], -x[0]), default=(0, 0))
        if not grams or held < same * len(grams):
            k = len(passages)
            passages.append(set())
        passages[k].update(ws)
        for g in grams:
            owner[g].add(k)
    seen = Counter(w for p in passages for w in p)
    rare = max(2, math.ceil(0.01 * len(passages)))
    return {w for w, c in seen.items() if c <= rare and (len(passages) >= 50 or w[0].isdigit() or w in named)}


class Items:
    """Test items as token numbers with the lookup tables of the scan. ``marks`` are those of the whole test set, if this is a block of it."""

    def __init__(self, rows: list[tuple[int, str]], n: int = NGRAM, marks: set[str] | None = None, share: float = SHARE) -> None:
        self.n = n
        self.words = {i: tokens(t or "") for i, t in rows}
        seen = {w for ws in self.words.values() for w in ws}
        self.vocab = {w: k for k, w in enumerate(sorted(seen), 1)}
        self.base = len(self.vocab) + 1
        marks = passage_marks([rows], n) if marks is None else marks
        self.marked = {k for w, k in self.vocab.items() if w in marks}
        self.ids = {i: [self.vocab[w] for w in ws] for i, ws in self.words.items()}
        #: Items without two names or figures.
        self.plain = {i for i, ws in self.ids.items() if len(self.marked.intersection(ws)) < 2}
        self.places = {i: self._places(ws) for i, ws in self.ids.items()}
        self.item_codes = {i: [self.code(ws, p) for p in range(len(ws) - n + 1)] for i, ws in self.ids.items()}
        self.code_sets = {i: frozenset(cs) for i, cs in self.item_codes.items()}
        self.codes = np.array(sorted(set(chain.from_iterable(self.code_sets.values()))), dtype=np.int64)
        #: Items by those of their n-grams that hold a name or figure; other n-grams may stand in any number of items.
        self.named: dict[int, list[int]] = defaultdict(list)
        for i, ws in self.ids.items():
            if i not in self.plain:
                for k in {c for p, c in enumerate(self.item_codes[i]) if not self.marked.isdisjoint(ws[p : p + n])}:
                    self.named[k].append(i)
        self.unnamed = self._rarest(share)
        self.named = dict(self.named)
        if self.base**n >= 2**62:
            raise ValueError("too many different words for one block")

    def _rarest(self, share: float) -> dict[int, list[int]]:
        """Items without names by their rarest n-grams: a document that holds the share of all holds at least one of them."""
        used = Counter(chain.from_iterable(self.code_sets[i] for i in self.plain))
        out: dict[int, set[int]] = defaultdict(set)
        for i in self.plain:
            codes = sorted(self.item_codes[i], key=lambda c: (used[c], c))
            for c in codes[: len(codes) - math.ceil(share * len(codes) - 1e-9) + 1]:
                out[c].add(i)
        return {c: sorted(xs) for c, xs in out.items()}

    def code(self, ws: list[int], p: int) -> int:
        out = 0
        for w in ws[p : p + self.n]:
            out = out * self.base + w
        return out

    @staticmethod
    def _places(ws: list[int]) -> dict[int, list[int]]:
        out: dict[int, list[int]] = defaultdict(list)
        for p, w in enumerate(ws):
            out[w].append(p)
        return {w: ps[::-1] for w, ps in out.items()}

    def hits(self, ids: np.ndarray) -> np.ndarray:
        """Where in the token numbers (0: not in any item) a window of a test item begins."""
        if len(ids) < self.n or not len(self.codes):
            return np.empty(0, dtype=np.int64)
        code = np.zeros(len(ids) - self.n + 1, dtype=np.int64)
        good = np.ones(len(code), dtype=bool)
        for k in range(self.n):
            part = ids[k : k + len(code)]
            code = code * self.base + part
            good &= part > 0
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.flatnonzero(good & (self.codes[at] == code))


def common_places(ids: list[int], start: int, stop: int, places: dict[int, list[int]]) -> list[tuple[int, int]]:
    """(document position, item position) of a longest common subsequence of ids[start:stop] and an item."""
    tails: list[int] = []
    ends: list[int] = []
    chain: list[tuple[int, int, int]] = []
    for p in range(start, stop):
        for q in places.get(ids[p], ()):
            k = bisect_left(tails, q)
            chain.append((p, q, ends[k - 1] if k else -1))
            if k == len(tails):
                tails.append(q)
                ends.append(len(chain) - 1)
            else:
                tails[k] = q
                ends[k] = len(chain) - 1
    out, c = [], ends[-1] if ends else -1
    while c >= 0:
        p, q, c = chain[c]
        out.append((p, q))
    return out[::-1]


def _dense(pairs: list[tuple[int, int]], gap: int) -> list[list[tuple[int, int]]]:
    """Cuts a common subsequence where neighbours lie far apart in document or item."""
    out: list[list[tuple[int, int]]] = []
    for x in pairs:
        if out and x[0] - out[-1][-1][0] <= gap and x[1] - out[-1][-1][1] <= gap:
            out[-1].append(x)
        else:
            out.append([x])
    return out


def _trimmed(s: list[tuple[int, int]], marked: set[int], ws: list[int]) -> list[tuple[int, int]]:
    """A stretch without stray words at its ends: it begins and ends with a name, a figure or two words in a row."""
    a, b = 0, len(s)
    while b - a > 1 and ws[s[a][1]] not in marked and (s[a + 1][0] - s[a][0], s[a + 1][1] - s[a][1]) != (1, 1):
        a += 1
    while b - a > 1 and ws[s[b - 1][1]] not in marked and (s[b - 1][0] - s[b - 2][0], s[b - 1][1] - s[b - 2][1]) != (1, 1):
        b -= 1
    return s[a:b]


def verify(ids: list[int], at: list[int], item: int, items: Items, share: float = SHARE, marked_share: float = MARKED_SHARE, gap: int = GAP) -> tuple[int, list[tuple[int, int]]] | None:
    """(matched words, token spans) or None if the document is no case.

    The best one or two stretches decide and are the words that match; the spans are of all stretches of the item, further copies
    and parts among them.
    """
    places, ws = items.places[item], items.ids[item]
    stretches: list[list[tuple[int, int]]] = []
    ranges: list[tuple[int, int]] = []
    lo = at[0]
    for k, p in enumerate(at):
        if k + 1 == len(at) or at[k + 1] - p > gap:
            first = max(lo - gap, stretches[-1][-1][0] + 1 if stretches else 0)
            ranges.append((max(0, first), min(len(ids), p + items.n + gap)))
            stretches += _dense(common_places(ids, *ranges[-1], places), gap)
            lo = at[k + 1] if k + 1 < len(at) else lo

    def worth(found: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
        out = []
        for s in (_trimmed(x, items.marked, ws) for x in found):
            got = {q for _, q in s}
            inside = [q for q in range(s[0][1], s[-1][1] + 1) if ws[q] in items.marked]
            held = sum(q in got for q in inside)
            if len(s) >= items.n and (item in items.plain or inside) and held >= marked_share * len(inside):
                out.append(s)
        return out

    kept = worth(stretches)
    best: tuple[int, list] | None = None
    for i, s in enumerate(kept):
        for other in [None, *kept[i + 1 :]]:
            if other is not None and other[0][1] <= s[-1][1]:
                continue
            n = len(s) + (len(other) if other else 0)
            if best is None or n > best[0]:
                best = (n, [s] + ([other] if other else []))
    if best is None or best[0] < share * len(ws):
        return None
    if item in items.plain:
        runs = sum((b[0] - a[0], b[1] - a[1]) == (items.n - 1, items.n - 1) for s in best[1] for a, b in zip(s, s[items.n - 1 :]))
        if runs < share * (len(ws) - items.n + 1):
            return None
    spans = [(s[0][0], s[-1][0] + 1) for s in kept]
    # a common subsequence holds one copy of the item: what it leaves of its range is looked at again
    todo = _gaps(ranges, spans, items.n)
    while todo:
        more = [(s[0][0], s[-1][0] + 1) for r in todo for s in worth(_dense(common_places(ids, *r, places), gap))]
        todo = _gaps([r for r in todo if any(r[0] <= a < r[1] for a, _ in more)], more, items.n)
        spans += more
    return best[0], sorted(spans)


def _gaps(ranges: list[tuple[int, int]], spans: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """What the spans leave of the ranges, in pieces of ``least`` tokens or more."""
    out = []
    for lo, hi in ranges:
        for a, b in sorted(s for s in spans if s[0] < hi and s[1] > lo):
            if a - lo >= least:
                out.append((lo, a))
            lo = max(lo, b)
        if hi - lo >= least:
            out.append((lo, hi))
    return out


def _char_spans(text: str, spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Token spans as code-point offsets of the text itself."""
    origin, parts = [], []
    for k, c in enumerate(joined_groups(text)):
        d = c.lower() if c.isascii() else _MARKS.sub("", unicodedata.normalize("NFKD", c.lower()))
        parts.append(d)
        origin += [k] * len(d)
    low = "".join(parts)
    cuts = [(m.start(), m.end()) for m in _BROKEN.finditer(low)]
    if cuts:
        keep = np.ones(len(low), dtype=bool)
        for a, b in cuts:
            keep[a:b] = False
        origin = [o for o, k in zip(origin, keep) if k]
        low = "".join(c for c, k in zip(low, keep) if k)
    found = [(m.start(), m.end()) for m in _TOKEN.finditer(low)]
    return [{"start": origin[found[a][0]], "stop": origin[found[min(b, len(found)) - 1][1] - 1] + 1} for a, b in spans]


def candidates(ws: list[int], hits: list[int], items: Items) -> dict[int, list[int]]:
    """Items that a document may hold, with the places where one of their n-grams begins: two of an item's names or figures are hit, or
    one of the rarest n-grams of an item without names."""
    n = items.n
    codes = [items.code(ws, p) for p in hits]
    marks: dict[int, set[int]] = defaultdict(set)
    found: set[int] = set()
    for p, c in zip(hits, codes):
        for i in items.named.get(c, ()):
            marks[i].update(items.marked.intersection(ws[p : p + n]))
        found.update(items.unnamed.get(c, ()))
    found |= {i for i, m in marks.items() if len(m) >= 2}
    return {i: [p for p, c in zip(hits, codes) if c in items.code_sets[i]] for i in sorted(found)}


def scan_block(words: dict[int, list[str]], items: Items, share: float, marked_share: float, gap: int) -> Iterator[tuple[int, int, int, int, list[tuple[int, int]]]]:
    """(document, item, matched, item words, token spans) of the cases among the documents of a batch."""
    get, n, apart = items.vocab.get, items.n, [0] * items.n
    order = list(words)
    numbers = {d: [get(t, 0) for t in ws] for d, ws in words.items()}
    ends = np.cumsum([len(numbers[d]) + n for d in order])
    # all documents of a batch in one row, with gaps that no window crosses
    hits = items.hits(np.fromiter(chain.from_iterable(chain(numbers[d], apart) for d in order), dtype=np.int64))
    owner = np.searchsorted(ends, hits, side="right")
    for k in np.flatnonzero(np.bincount(owner, minlength=1)).tolist():
        d = order[k]
        ws = numbers[d]
        at = (hits[owner == k] - (ends[k] - len(ws) - n)).tolist()
        for i, places in candidates(ws, at, items).items():
            if (case := verify(ws, places, i, items, share, marked_share, gap)) is not None:
                yield d, i, case[0], len(items.ids[i]), case[1]


def scan(batches: Iterator[pd.DataFrame], blocks: list, share: float, marked_share: float, gap: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = {d: t for d, t in enumerate(pdf["text"]) if t}
        words, out, ids = {d: tokens(t) for d, t in texts.items()}, [], pdf["doc_id"].tolist()
        for block in blocks:
            for d, i, matched, n, spans in scan_block(words, block.value, share, marked_share, gap):
                out.append((ids[d], i, matched, n, _char_spans(texts[d], spans)))
            if len(blocks) > 1:  # a worker holds one block at a time
                block.__dict__.pop("_value", None)
        yield pd.DataFrame(out, columns=["doc_id", "item_id", "matched", "item_words", "spans"])


def find_leaks(documents: DataFrame, benchmark: DataFrame, share: float = SHARE, marked_share: float = MARKED_SHARE, n: int = NGRAM, gap: int = GAP, block_chars: int = 5_000_000) -> DataFrame:
    """(doc_id, item_id, matched, item_words, spans) of every leaked item of every document.

    Null and empty texts on either side, and items of fewer than ``n`` words, give no case; whole texts of any length are scanned;
    a document or an item given twice is found twice; extra columns are left out; empty tables give no rows.
    """
    spark = documents.sparkSession
    known = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    blocks = max(1, math.ceil((known.agg(F.sum(F.length("text"))).first()[0] or 0) / block_chars))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).where("text IS NOT NULL")
    block = lambda b: [tuple(r) for r in known.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()]
    marks = passage_marks(map(block, range(blocks)), n)
    shared = [spark.sparkContext.broadcast(Items(block(b), n, marks, share)) for b in range(blocks)]
    return texts.mapInPandas(lambda batches: scan(batches, shared, share, marked_share, gap), SCHEMA)


def remove_leaks(documents: DataFrame, leaks: DataFrame, whole: bool = False) -> DataFrame:
    """``documents`` without leaked spans (or, if ``whole``, without leaked documents).

    Only leaked documents are joined for their spans; overlapping spans of several items are cut once. Columns stay as they
    are; a document that is all leak keeps an empty text.
    """
    if whole:
        return documents.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")
    spans = leaks.groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("__spans"))
    joined = documents.join(spans, "doc_id", "left")
    # one fold over the sorted spans: what stands between the end of the last and the start of the next is kept
    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"))
    folded = F.aggregate(
        "__spans",
        start,
        lambda acc, s: F.struct(
            F.concat(acc["kept"], F.when(s["start"] > acc["at"], F.substring("text", acc["at"] + 1, s["start"] - acc["at"])).otherwise(F.lit(""))).alias("kept"),
            F.greatest(acc["at"], s["stop"]).alias("at"),
        ),
    )
    clean = F.concat(folded["kept"], F.substring(F.col("text"), folded["at"] + 1, F.length("text")))
    return joined.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(clean)).select(*documents.columns)
