"""Subject areas of documents by class-association rules.

Sentences of labelled documents are transactions of word stems; the document's areas are class items of
each. Frequent patterns come from Spark's parallel FP-growth, those with a class item become rules, and a rule
is pruned where a shorter one says the same with no less confidence. Raters err and leave areas out, so
confidences are calibrated on held-out labelled documents to what the best rules of an area reach there. Every sentence of every document is then scored by its
most specific matching rules; a document has the areas that enough of its sentences treat.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.session import saved

#: At most so many labelled documents are mined, taken by hash of the id; all documents are scored.
MAX_LABELLED = 20_000
#: Sentences of an area that make it one of the document's.
MIN_SENTENCES = 3
#: Labelled sentences that hold a pattern and its area, at least.
MIN_COUNT = 3
#: Items worth mining: their share in an area over the area's own share.
MIN_LIFT = 1.6
#: Words of a rule, and kept words of a transaction: the patterns of a longer sentence, which come in pieces of so many words, would multiply.
MAX_WORDS, MAX_ITEMS = 3, 12
#: One labelled document in so many, by hash of the id, is not mined but serves to calibrate.
HELD_OUT = 5
#: What a longer pattern must add to the confidence of its parts.
MARGIN = 0.05
#: Calibrated evidence that makes a sentence treat an area.
EVIDENCE = 0.55
_CLASS = "\t"

_MARKS = re.compile("[̀-ͯ]+")
_TAG = re.compile(r"<[^<>]*>")
_WORD = re.compile(r"[^\W\d_]+")
#: A sentence ends at a mark before white space or at an empty line ...
_END = re.compile(r"[.!?][\"'”»)\]]*(?:\s|$)|\n\s*\n")
#: ... but not after these, nor after a single letter.
_SHORT = frozenset(("mr", "dr", "ms", "rs", "no", "vs", "st", "co", "inc", "ltd", "pvt"))


def folded(text: str) -> str:
    """Lower case, without accents and tags."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    text = text.lower()
    return text if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFKD", text))


def stem(w: str) -> str:
    return w[:-1] if len(w) > 3 and w[-1] == "s" and w[-2] != "s" else w


def sentences(low: str) -> list[list[str]]:
    """The words of each sentence of a folded text."""
    out, start = [], 0
    for m in _END.finditer(low):
        at = m.start()
        if low[at] == ".":
            k = at - 1
            while k >= start and at - k <= 4 and low[k].isalpha():
                k -= 1
            if at - k <= 4 and (at - k == 2 or low[k + 1 : at] in _SHORT):
                continue
        out.append(_WORD.findall(low, start, at))
        start = m.end()
    out.append(_WORD.findall(low, start))
    return out


def labelled(documents: DataFrame, labels: DataFrame, areas: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, text, codes): labelled documents with the known codes that raters gave, case and padding aside."""
    code = F.lower(F.trim("subject_code"))
    known = areas.select(code.alias("code")).where("code IS NOT NULL").distinct()
    given = labels.select("doc_id", code.alias("code")).where("doc_id IS NOT NULL AND code IS NOT NULL")
    given = given.join(F.broadcast(known), "code", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    chosen = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return documents.select("doc_id", "text").where("text IS NOT NULL").join(chosen, "doc_id").select("doc_id", "text", "codes")


def _transactions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = [(d, sorted({stem(w) for w in ws}), list(c)) for d, t, c in zip(pdf["doc_id"], pdf["text"], pdf["codes"]) for ws in sentences(folded(t)) if ws]
        yield pd.DataFrame(out, columns=["doc_id", "items", "codes"])


def _named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = {stem(w) for name in pdf["name"] if (ws := _WORD.findall(folded(name))) for w in (ws[0], ws[-1])}
        yield pd.DataFrame({"item": sorted(out)})


def names_among(documents: DataFrame, name: str, items: set[str]) -> set[str]:
    """Those of some words that begin or end a name in a column: whom a text is about says nothing of its subject."""
    spark = documents.sparkSession
    names = documents.select(F.col(name).alias("name")).where("name IS NOT NULL AND name <> ''").distinct()
    asked = spark.createDataFrame([(w,) for w in sorted(items)], "item string")
    return {r["item"] for r in asked.join(names.mapInPandas(_named, "item string").distinct(), "item", "left_semi").collect()}


class Rules:
    """Rules (pattern of stems -> area, evidence) ready for scoring; bounded by the labelled sample they come from."""

    def __init__(self, rules: list[tuple[tuple[str, ...], str, float]], known: set[str]) -> None:
        self.rules: dict[tuple[str, ...], list[tuple[str, float]]] = defaultdict(list)
        for pattern, area, evidence in rules:
            self.rules[pattern].append((area, evidence))
        self.items = {w for p in self.rules for w in p}
        self.by_first: dict[str, list[tuple[str, ...]]] = defaultdict(list)
        for p in self.rules:
            self.by_first[p[0]].append(p)
        self.form = {f: w for w in self.items for f in (w + "s", w) if stem(f) == w}
        self.known = known | self.items
        near: dict[str, set[str]] = defaultdict(set)
        for w in self.items:
            if len(w) >= 5:
                for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
                    near[k].add(w)
        self.near = dict(near)
        self.memo: dict[str, str | None] = {}
        self.seen: dict[frozenset[str], str | None] = {}

    def closest(self, w: str) -> str | None:
        """The one item within an edit (or two neighbours swapped) of a word that is none of the known ones."""
        if w not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            found: set[str] = set(self.near.get(w, ()))
            for i in range(len(w)):
                found |= self.near.get(w[:i] + w[i + 1 :], set())
            found = {x for x in found if abs(len(x) - len(w)) <= 1 and x[0] == w[0] or sorted(x) == sorted(w)}
            self.memo[w] = min(found) if len(found) == 1 else None
        return self.memo[w]

    def score(self, found: set[str]) -> dict[str, float]:
        """Evidence by area: of each area the best rule, where a longer matching pattern stands for the shorter ones in it.

        Only the rules that begin with one of the words are looked at, so any number of words may match.
        """
        matched = [p for w in found for p in self.by_first.get(w, ()) if found.issuperset(p)]
        covered = {q for p in matched for m in range(1, len(p)) for q in combinations(p, m)}
        out: dict[str, float] = {}
        for p in matched:
            if p not in covered:
                for area, e in self.rules[p]:
                    out[area] = max(out.get(area, 0.0), e)
        return out

    def area(self, ws: list[str], evidence: float) -> str | None:
        """The area that a sentence treats, if any. Misspelt words count where the well-spelt ones don't decide."""
        get = self.form.get
        found = {x for w in ws if (x := get(w))}
        best = self._best(found, evidence) if found else None
        if best is None:
            known = self.known
            fixed = {x for w in ws if len(w) >= 5 and (v := stem(w)) not in known and (x := self.closest(v))}
            if fixed:
                best = self._best(found | fixed, evidence)
        return best

    def _best(self, found: set[str], evidence: float) -> str | None:
        key = frozenset(found)
        if key not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[key] = self._decide(found, evidence)
        return self.seen[key]

    def _decide(self, found: set[str], evidence: float) -> str | None:
        if len(found) == 1:
            rules = self.rules.get(tuple(found))
            if not rules:
                return None
            top = max(rules, key=lambda x: (x[1], x[0]))
            return top[0] if top[1] >= evidence else None
        scores = self.score(found)
        top = max(scores.items(), key=lambda x: (x[1], x[0]), default=(None, 0.0))
        return top[0] if top[1] >= evidence else None


def mine(documents: DataFrame, labels: DataFrame, areas: DataFrame, limit: int = MAX_LABELLED, min_count: int = MIN_COUNT, min_lift: float = MIN_LIFT, names: str | None = "issuer_key") -> Rules:
    """Mines, prunes and calibrates the rules. The sample is bounded by ``limit``, and with it the rules.

    ``names`` is a column of who a document is about, if there is one: the names in it are no evidence of a subject.
    """
    from pyspark.ml.fpm import FPGrowth

    sample = labelled(documents, labels, areas, limit)
    held = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(HELD_OUT)) == 0
    rows, drop_rows = saved(sample.mapInPandas(_transactions, "doc_id long, items array<string>, codes array<string>").withColumn("held", held))
    size = {r["held"]: r["n"] for r in rows.groupBy("held").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = size.get(False, 0)
    if not n:
        return Rules([], set())
    mined, kept_out = F.count_if(~F.col("held")), F.count_if("held")
    prior = {r["code"]: r["n"] / n for r in rows.select(F.explode("codes").alias("code"), "held").groupBy("code").agg(mined.alias("n")).collect()}
    by_item = rows.select("doc_id", "held", F.explode("items").alias("item")).groupBy("item").agg(mined.alias("n"), kept_out.alias("held_n"), F.count_distinct(F.when(~F.col("held"), F.col("doc_id"))).alias("docs"))
    by_class = rows.select("held", F.explode("items").alias("item"), "codes").select("held", "item", F.explode("codes").alias("code")).groupBy("item", "code").agg(mined.alias("k"), kept_out.alias("held_k"))
    # the words of a bounded sample that occur in it min_count times: a bounded list
    known = {r["item"] for r in by_item.where(F.col("n") + F.col("held_n") >= min_count).select("item").collect()}
    base = F.coalesce(*[F.when(F.col("code") == c, F.lit(x)) for c, x in prior.items()], F.lit(0.0))
    telling = (F.col("docs") >= 2) & (F.col("k") >= min_count) & (F.length("item") > 2) & (F.col("k") / F.col("n") >= base * min_lift)
    counts = by_item.where(F.col("n") >= min_count).join(by_class, "item").where(telling).collect()
    keep = {r["item"] for r in counts}
    if names is not None and names in documents.columns and keep:
        keep -= names_among(documents, names, keep)

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kept = [([w for w in items if w in keep], [_CLASS + c for c in cs]) for items, cs in zip(pdf["items"], pdf["codes"])]
            out = [([*ws[k : k + MAX_ITEMS], *cs],) for ws, cs in kept for k in range(0, len(ws), MAX_ITEMS)]
            yield pd.DataFrame(out, columns=["items"])

    kept, drop_kept = saved(rows.where("NOT held").select("items", "codes").mapInPandas(marked, "items array<string>"))
    total = kept.count()
    if not total:
        return Rules([], known)
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, min_count / total), minConfidence=0.0).fit(kept).freqItemsets
    is_class = lambda i: F.startswith(i, F.lit(_CLASS))
    sets = sets.select("freq", F.filter("items", is_class).alias("codes"), F.array_sort(F.filter("items", lambda i: ~is_class(i))).alias("words")).where(f"size(words) BETWEEN 1 AND {MAX_WORDS} AND size(codes) <= 1")
    sets, drop_sets = saved(sets)
    whole = sets.where("size(codes) = 0").select("words", F.col("freq").alias("n"))
    joint = sets.where("size(codes) = 1").select("words", F.substring(F.col("codes")[0], 2, 1000).alias("code"), F.col("freq").alias("k"))
    # confidence is smoothed towards the area's prior by two sentences, so rare patterns don't outdo their parts by luck
    conf = (F.col("k") + 2 * base) / (F.col("n") + 2)
    top = joint.join(whole, "words").withColumn("conf", conf).withColumn("prior", base).groupBy("words").agg(F.max_by(F.struct("code", "conf", "k", "prior"), F.struct("conf", "code")).alias("t"))
    best = {tuple(r["words"]): (r["code"], r["conf"], r["k"]) for r in top.where(F.col("t.conf") >= F.col("t.prior") * min_lift - MARGIN).select("words", "t.code", "t.conf", "t.k").collect()}
    for drop in (drop_rows, drop_kept, drop_sets):
        drop()
    checked = {(r["item"], r["code"]): (r["held_k"], r["held_n"]) for r in counts if r["held_n"]}
    return Rules(calibrate(prune(best, prior, min_lift), checked, prior), known)


def prune(best: dict[tuple[str, ...], tuple[str, float, int]], prior: dict[str, float], min_lift: float, margin: float = MARGIN) -> list[tuple[tuple[str, ...], str, float, int]]:
    """Rules (pattern, area, confidence, count) without those that a part of the pattern makes as well.

    ``best`` has each pattern's most likely area with confidence and count.
    """
    out = []
    for p, (area, c, k) in best.items():
        parts = [best[q] for m in range(1, len(p)) for q in combinations(p, m) if q in best]
        if c >= min_lift * prior[area] and not any(a == area and x >= c - margin for a, x, _ in parts):
            out.append((p, area, c, k))
    return out


def calibrate(rules: list[tuple[tuple[str, ...], str, float, int]], checked: dict[tuple[str, str], tuple[int, int]], prior: dict[str, float]) -> list[tuple[tuple[str, ...], str, float]]:
    """Evidence of a rule: its confidence over what the area's sure rules reach, one at most.

    Wrong and missing labels keep even sure rules of an area under one; the level they reach is the upper quartile of the confidences
    that the area's single-word rules have in held-out documents (``checked``: hits and sentences of word and area), weighted by their hits. An area
    without held-out sentences goes by the mined confidences.
    """
    level: dict[str, float] = {}
    mined: dict[str, list[tuple[float, int]]] = defaultdict(list)
    held: dict[str, list[tuple[float, int]]] = defaultdict(list)
    for p, area, c, k in rules:
        if len(p) == 1:
            mined[area].append((c, k))
            hits, sentences = checked.get((p[0], area), (0, 0))
            if hits:
                held[area].append(((hits + 2 * prior[area]) / (sentences + 2), hits))
    for area in mined:
        cs = sorted(held[area] if sum(k for _, k in held[area]) >= 30 else mined[area])
        upper, run = 0.75 * sum(k for _, k in cs), 0
        for c, k in cs:
            run += k
            if run >= upper:
                level[area] = c
                break
    return [(p, area, min(1.0, c / level.get(area, 1.0))) for p, area, c, _ in rules]


def count_areas(text: str, rules: Rules, evidence: float = EVIDENCE) -> Counter:
    out: Counter = Counter()
    for ws in sentences(folded(text)):
        if ws and (a := rules.area(ws, evidence)) is not None:
            out[a] += 1
    return out


def score_documents(documents: DataFrame, rules: Rules, evidence: float = EVIDENCE) -> DataFrame:
    """(doc_id, subject_code, n_sentences) of every area that a sentence of a document treats; whole texts, all documents."""
    shared = documents.sparkSession.sparkContext.broadcast(rules)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = shared.value
        for pdf in batches:
            out = [(d, a, n) for d, t in zip(pdf["doc_id"], pdf["text"]) for a, n in count_areas(t, r, evidence).items()]
            yield pd.DataFrame(out, columns=["doc_id", "subject_code", "n_sentences"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).where("text IS NOT NULL")
    return texts.mapInPandas(scored, "doc_id long, subject_code string, n_sentences int")


def subject_areas(documents: DataFrame, labels: DataFrame, areas: DataFrame, min_sentences: int = MIN_SENTENCES, limit: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, subject_code, n_sentences) of the areas that at least ``min_sentences`` sentences of a document treat.

    Null, empty and figures-only texts have no area; labels with a null, an unknown code or an unknown document
    don't count; without usable labels there are no rules and no rows; a document given twice is scored twice; extra columns are left out.
    """
    return score_documents(documents, mine(documents, labels, areas, limit)).where(F.col("n_sentences") >= min_sentences)
