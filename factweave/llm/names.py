"""Variant spellings of names.

Every name is read into a stem (what is its own: the made-up or family name) and a form (what it says beside: lines of
business, given name, initials), with legal forms and titles set aside, abbreviations written out, and words joined or
cut where that gives known words. Token order plays no part: a stem of several words is also put in the order of its words'
roots, and the two are one; of words that may be given or family name, the order used most decides for all. A trie join finds the stems within a few edits; each belongs to the most used spelling near it. Forms of
one stem are then held against each other: a form that says less joins the only one that says it all, forms
that differ are different entities (sister firms, relatives). Lines of business, given names, their short forms and nicknames are no
lists but are learned from the table (``learn``), and so are the words of measures; a measure is the set of its words.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factweave.llm.readings import ALWAYS, AS_IT_STANDS, STOOD_IN, fitting, written_out
from factweave.llm.trie import bound, edits, spread, trie_join
from factweave.session import cut, saved

# Legal forms and titles; words of measures that carry no meaning of their own.
LEGAL = ("limited", "ltd", "private", "pvt", "public", "company", "co", "corporation", "corp", "corpn", "incorporated", "inc", "plc", "llp", "llc", "and")
TITLES = ("the", "m/s", "messrs", "mr", "mrs", "ms", "miss", "dr", "prof", "shri", "smt", "sri")
FILLERS = frozenset(("from", "of", "to", "in", "the", "for", "and", "on", "by", "a"))
#: A word that stands beside at least so many different words of its own, and beside this share of what the most general one stands beside, is general.
MIN_PARTNERS, PARTNER_SHARE = 4, 0.1
#: A short form or nickname stands with at least so many families or firms that are also known under the full form; they are this share of
#: all its own words, and so many times as many as with any other general word.
MIN_SHARED, SHARED, DOMINANCE = 2, 0.4, 2
_MARKS = re.compile("[̀-ͯ]+")


def plain(name: str) -> str:
    return _MARKS.sub("", unicodedata.normalize("NFKD", name.lower()))


def _abbreviates(t: str, w: str) -> int:
    """2 if t begins w, 1 if its letters stand in w in order from the same first letter, else 0."""
    if len(t) < 2 or len(t) >= len(w) or t[0] != w[0]:
        return 0
    if w.startswith(t):
        return 2
    it = iter(w)
    return int(all(c in it for c in t))


def name_text(name: str) -> str:
    return plain(name).replace("'", "").replace("’", "").replace("&", " and ").replace("p.l.c", "plc").replace("s/w", "sw")


def name_words(name: str) -> tuple[bool, list[str]]:
    """(whether a legal form says that it is a firm, the other words of two letters or more without titles)."""
    text = re.sub(r"\([a-z]{2,4}\)", " ", name_text(name)).replace("-", "")
    toks = [x for x in (re.sub(r"[^a-z/]", "", t) for t in re.split(r"[\s,()]+", text)) if x]
    return any(t in LEGAL for t in toks) or "m/s" in toks, sorted({t.replace("/", "") for t in toks if t not in TITLES and t not in LEGAL and len(t) > 1})


Reading = tuple[str, str, str, list[str], bool]


class Reader:
    """Reads names of firms and people into (kind, stem, form, own words, whether the first of them was taken for a given name)."""

    def __init__(self, trades=(), aliases=(), given=(), legal=LEGAL, titles=TITLES) -> None:
        """``trades`` (lines of business, the most used first), ``aliases`` (their short forms) and ``given`` (given names with their
        nicknames, apart by blanks) are what ``learn`` finds in a table, or lists of one's own."""
        given = dict(given)
        self.legal, self.titles, self.trades, self.aliases = set(legal), set(titles), list(trades), dict(aliases)
        self.given = {g: g for g in given} | {n: g for g, ns in given.items() for n in ns.split()}
        self.long_given = [g for g in given if len(g) >= 5]
        self.memo: dict[tuple[str, bool], str | None] = {}

    def trade(self, t: str, short: bool = True) -> str | None:
        """The trade word that a token is: spelt out, misspelt or abbreviated."""
        key = (t, short)
        if key not in self.memo:
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[key] = self._trade(t, short)
        return self.memo[key]

    def _trade(self, t: str, short: bool) -> str | None:
        if t in self.trades:
            return t
        if t in self.aliases:
            return self.aliases[t]
        if len(t) >= 4:
            near = [(edits(t, w, bound(max(len(t), len(w)))), w) for w in self.trades if abs(len(t) - len(w)) <= 2]
            near = [(d, w) for d, w in near if d <= (1 if min(len(t), len(w)) < 8 else 2)]
            near += [(1, x) for w, x in self.aliases.items() if len(w) > 6 and abs(len(t) - len(w)) <= 1 and edits(t, w, 1) <= 1]
            if near:
                return min(near)[1]
        if short and len(t) <= 8:
            cut = [(-_abbreviates(t, w), k, w) for k, w in enumerate(self.trades) if _abbreviates(t, w)]
            if cut:
                return min(cut)[2]
        return None

    def shortened(self, t: str) -> bool:
        """Whether a token without a dot looks like a short form rather than like a piece of a name."""
        if len(t) <= 3:
            return re.fullmatch("[a-z][^aeiou]+", t) is not None
        return len(t) <= 8 and (len(re.findall("[aeiou]", t)) < 2 or any(w.startswith(t) for w in self.trades))

    def ending(self, t: str) -> str | None:
        """The trade word that the end of a run-together token stands for."""
        if len(t) >= 3 and (self.shortened(t) or any(w.startswith(t) for w in self.trades)):
            return self.trade(t)
        return None

    def is_legal(self, t: str) -> bool:
        return t in self.legal or (len(t) >= 5 and any(len(w) >= 6 and edits(t, w, 1 if len(w) < 8 else 2) <= (1 if len(w) < 8 else 2) for w in self.legal))

    def name_of(self, t: str) -> str | None:
        if t in self.given:
            return self.given[t]
        if len(t) >= 5:
            near = [(d, g) for g in self.long_given if (d := edits(t, g, 1 if len(g) < 8 else 2)) <= (1 if len(g) < 8 else 2)]
            if near:
                return min(near)[1]
        return None

    def read(self, name: str) -> Reading | None:
        """A name's reading, or None for a name without letters."""
        text = name_text(name)
        hints = [h for h in re.findall(r"\(([a-z]{2,4})\)", text) if h not in self.legal]
        text = re.sub(r"\(([a-z]{2,4})\)", lambda m: " " if m[1] in hints else f" {m[1]} ", text).replace("-", "")
        raw = [t for t in re.split(r"[\s,()]+", text) if t]
        dotted = {t.rstrip(".") for t in raw if t.endswith(".")}
        toks = [x for x in (re.sub(r"[^a-z/]", "", t) for t in raw) if x]
        toks = [t.replace("/", "") for t in toks if t not in self.titles]
        firm = any(self.is_legal(t) for t in toks if len(t) > 1) or any(t in self.trades or t in self.aliases for t in toks) or "m/s" in text or "the" in raw
        if not firm and not any(self.name_of(t) or len(t) == 1 for t in toks):
            firm = any(self.trade(t, short=t in dotted) or self._split(t) for t in toks) or len(toks) > 3
        if firm:
            return self._firm(toks, dotted, hints)
        before, _, after = text.partition(",")
        turned = len(before.split()) == 1 and after.strip() != "" and toks and toks[0] == re.sub(r"[^a-z]", "", before)
        return self._person(toks, bool(turned))

    def _split(self, t: str) -> tuple[str, list[str]] | None:
        """(rest, words) of a token that runs together with trade or legal words at either end."""
        best: tuple[int, str, list[str]] | None = None
        for w in (*self.trades, *self.aliases, *(x for x in self.legal if len(x) >= 6)):
            for part, rest in ((t[-len(w) :], t[: -len(w)]), (t[: len(w)], t[len(w) :])):
                if part == w and len(rest) >= 5 and (best is None or len(w) > best[0]):
                    best = (len(w), rest, [w])
            if len(w) >= 5:
                for m in (len(w) - 1, len(w), len(w) + 1):
                    for part, rest in ((t[-m:], t[:-m]), (t[:m], t[m:])):
                        if len(rest) >= 6 and len(t) >= 13 and (best is None or len(w) - 0.5 > best[0]) and edits(part, w, 1) <= 1:
                            best = (len(w) - 0.5, rest, [w])
        return (best[1], best[2]) if best else None

    def _firm(self, toks: list[str], dotted: set[str], hints: list[str]) -> Reading | None:
        trades: list[str] = []
        own: list[str] = []
        k = 0
        while k < len(toks):
            t = toks[k]
            if k + 1 < len(toks) and len(t) + len(toks[k + 1]) >= 5 and not (t in self.trades or t in self.legal or toks[k + 1] in self.trades or toks[k + 1] in self.legal):
                both = t + toks[k + 1]
                if (w := self.trade(both, short=False)) and not (self.trade(t) and self.trade(toks[k + 1])):
                    trades.append(w)
                    k += 2
                    continue
                if both in self.legal and len(both) > 4:
                    k += 2
                    continue
            k += 1
            if t in self.legal:
                continue
            if w := self.trade(t, short=t in dotted or self.shortened(t)):
                trades.append(w)
            elif len(t) > 1 and self.is_legal(t):
                continue
            elif len(t) > 1 or not any(x in ("limited", "ltd") for x in toks):
                own.append(t)
            elif t != "p":
                own.append(t)
        if len(own) > 1:  # beside a stem, a word further off from a trade word may be one that is badly misspelt
            far = [(d, w, t) for t in own if 5 <= len(t) <= 14 for w in self.trades if len(w) >= 6 and abs(len(t) - len(w)) <= 2 and (d := edits(t, w, 2)) <= 2]
            if far and len(own) - len({t for _, _, t in far}) >= 1:
                _, w, t = min(far)
                trades.append(w)
                own.remove(t)
        rest: list[str] = []
        for t in own:
            if len(own) == 1 and (cutting := self._split(t)) is not None:
                t, words = cutting
                for w in words:
                    if w not in self.legal:
                        trades.append(self.aliases.get(w, w))
                again = self._split(t) if len(t) >= 12 else None
                if again is not None and again[1][0] not in self.legal:
                    trades.append(self.aliases.get(again[1][0], again[1][0]))
                    t = again[0]
            rest.append(t)
        stem = "".join(rest)
        if len(rest) > 1 and (cutting := self._split(stem)) is not None and cutting[1][0] not in self.legal:
            rest = [cutting[0]]
            stem, trades = cutting[0], [*trades, self.aliases.get(cutting[1][0], cutting[1][0])]
        if not stem:
            return ("firm", " ".join(sorted(trades)), "d:|h:", [], False) if trades else None
        return "firm", stem, "d:" + ",".join(sorted(set(trades))) + "|h:" + ",".join(sorted("".join(sorted(h)) for h in hints)), rest, False

    def _person(self, toks: list[str], turned: bool = False) -> Reading | None:
        given, initials, own, guessed = None, [], [], False
        for t in toks:
            if len(t) == 1:
                initials.append(t)
            elif given is None and (g := self.name_of(t)):
                given = g
            else:
                own.append(t)
        if given is None and not initials and len(own) == 1:
            for g in sorted(self.given, key=len, reverse=True):
                if len(g) >= 4 and len(own[0]) - len(g) >= 5 and (own[0].startswith(g) or own[0].endswith(g)):
                    given, own = self.given[g], [own[0][len(g) :] if own[0].startswith(g) else own[0][: -len(g)]]
                    break
        if given is None and len(own) > 1 and not initials:
            own = [*own[1:], own[0]] if turned else own  # family name, given names
            given, own, guessed = own[0], own[1:], True
        if not own:
            if given is None:
                return None
            own, given = [given], None
        first = given[0] if given else (initials[0] if initials else "")
        middle = (initials if given else initials[1:])[:1]
        return "person", "".join(own), f"g:{given or ''}|i:{first}|m:{''.join(middle)}", [given, *own] if guessed else own, guessed


def _fields(form: str) -> dict[str, str]:
    return dict(p.split(":", 1) for p in form.split("|"))


def firm_entities(forms: list[str]) -> dict[str, str | None]:
    """Each form's entity among the forms of one stem; None where it could be several."""
    read = {f: _fields(f) for f in forms}
    said = {f: frozenset(filter(None, x["d"].split(","))) for f, x in read.items()}
    full = set(said.values())
    top = [s for s in full if not any(s < o for o in full)]
    out: dict[str, str | None] = {}
    for f in forms:
        hints = [h for h in read[f]["h"].split(",") if h]
        spell = lambda s: "".join(sorted(w[0] for w in s))
        fits = [s for s in top if said[f] <= s and all(h == spell(s) for h in hints)]
        if not fits and hints:
            fits = [s for s in top if said[f] <= s]
        out[f] = ",".join(sorted(fits[0])) if len(fits) == 1 else None
    return out


def person_entities(forms: list[str]) -> dict[str, str | None]:
    read = {f: _fields(f) for f in forms}
    people = {(x["g"], x["m"]) for x in read.values() if x["g"]}
    people = {(g, m) for g, m in people if m or not any(h == g and n for h, n in people)}
    loose = {(x["i"], x["m"]) for x in read.values() if not x["g"] and x["i"]}
    out: dict[str, str | None] = {}
    for f, x in read.items():
        if x["g"]:
            fits = [(g, m) for g, m in people if g == x["g"] and (not x["m"] or m == x["m"])]
        else:
            fits = [(g, m) for g, m in people if (not x["i"] or g[0] == x["i"]) and (not x["m"] or not m or m == x["m"])]
            if not fits and x["i"]:
                fits = [(i, m) for i, m in loose if i == x["i"] and (m == x["m"] or not x["m"])]
        out[f] = " ".join(fits[0]) if len(fits) == 1 else None
    return out


def strongest(pairs: DataFrame, words: DataFrame, ratio: float = 1.0) -> DataFrame:
    """(word, root): the most used spelling near each word, followed to its own and so on to the end.

    ``words`` has (word, n). A word follows a neighbour used at least ``ratio`` times as often; ties go to the first in order.
    """
    n = words.select("word", "n")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")).distinct()
    near = both.join(n.select(F.col("word").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("word").alias("b"), F.col("n").alias("nb")), "b")
    up = near.where((F.col("nb") >= F.col("na") * ratio) & ((F.col("nb") > F.col("na")) | (F.col("b") < F.col("a"))))
    parent = up.groupBy(F.col("a").alias("word")).agg(F.max_by("b", F.struct("nb", -F.col("d"), "b")).alias("up"))
    root = cut(n.select("word").join(parent, "word", "left").select("word", F.coalesce("up", "word").alias("root")))
    # each pass doubles the steps; parents are used more or come first in order, so there is an end
    while True:
        step = root.select(F.col("word").alias("w2"), F.col("root").alias("r2"))
        onward = root.join(step, root["root"] == step["w2"]).select("word", F.col("r2").alias("root"), (F.col("r2") != F.col("root")).alias("moved"))
        onward = cut(onward)
        root = onward.select("word", "root")
        if onward.where("moved").isEmpty():
            return root


def _part_endings(parsed: DataFrame, reader: Reader) -> DataFrame:
    """Stems that are another, more used stem run together with a short form (``lakratokirelec.``) are cut after it."""

    def cut_off(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(s, p, w) for s, p in zip(pdf["stem"], pdf["part"]) if (w := reader.ending(s[len(p) :])) is not None]
            yield pd.DataFrame(out, columns=["stem", "part", "trade"])

    firms = parsed.where("kind = 'firm'").groupBy("stem").agg(F.sum("n").alias("n"))
    parts = firms.where("length(stem) >= 9").select("stem", "n", F.explode(F.expr("transform(sequence(greatest(6, length(stem) - 9), length(stem) - 3), k -> substring(stem, 1, k))")).alias("part"))
    found = parts.join(firms.select(F.col("stem").alias("part"), F.col("n").alias("m")), "part").where("m > n").select("stem", "part")
    ends = found.mapInPandas(cut_off, "stem string, part string, trade string").groupBy("stem").agg(F.max_by(F.struct("part", "trade"), F.length("part")).alias("c"))
    said = F.split(F.substring_index(F.substring("form", 3, 10_000), "|", 1), ",")
    trades = F.array_join(F.array_sort(F.array_distinct(F.filter(F.concat(said, F.array("c.trade")), lambda x: x != ""))), ",")
    whole = F.concat(F.lit("d:"), trades, F.lit("|"), F.substring_index("form", "|", -1))
    joined = parsed.join(ends, "stem", "left")
    is_cut = (F.col("kind") == "firm") & F.col("c").isNotNull()
    return joined.select("name", "n", "kind", F.when(is_cut, F.col("c.part")).otherwise(F.col("stem")).alias("stem"), F.when(is_cut, whole).otherwise(F.col("form")).alias("form"), F.when(is_cut, F.lit(None)).otherwise(F.col("ordered")).alias("ordered"))


def _in_order(parsed: DataFrame) -> DataFrame:
    """(name, n, kind, stem, form, ordered): ``ordered`` is a stem of several words in the order of their roots, else null.

    Where a person's given name was taken by its place, the names of the same words decide together which of them it is: the
    one that comes first most often.
    """
    many = parsed.where("size(own) > 1")
    placed = many.select("name", "n", "kind", "form", "guessed", F.posexplode("own").alias("pos", "word"))
    words = cut(placed.groupBy("word").agg(F.sum("n").alias("n")))
    roots = strongest(cut(trie_join(words, "word"), costly=True), words)
    rooted = placed.join(roots, "word").groupBy("name", "n", "kind", "form", "guessed").agg(F.array_sort(F.collect_list(F.struct("pos", "root", "word"))).alias("ws"))
    rooted = cut(rooted.withColumn("key", F.array_join(F.array_sort("ws.root"), " ")))
    first = rooted.where("guessed").groupBy("key", F.col("ws")[0]["root"].alias("given")).agg(F.sum("n").alias("n"))
    given = first.groupBy("key").agg(F.max_by("given", F.struct("n", "given")).alias("given"))
    read = rooted.join(given.withColumn("guessed", F.lit(True)), ["key", "guessed"], "left")
    # the first word of the given name's root, and the others
    at = F.expr("filter(ws, w -> w.root = given)[0]")
    read = read.withColumn("g", F.when(F.col("guessed"), at)).withColumn("ws", F.when(F.col("guessed"), F.expr("filter(ws, w -> w.pos <> g.pos)")).otherwise(F.col("ws")))
    by_root = F.expr("array_join(transform(array_sort(transform(ws, w -> struct(w.root AS root, w.pos AS pos, w.word AS word))), w -> w.word), '')")
    g = F.col("g.word")
    turned = read.select(
        "name",
        F.when(F.col("guessed"), F.array_join("ws.word", "")).alias("new_stem"),
        F.when(F.col("guessed"), F.concat(F.lit("g:"), g, F.lit("|i:"), F.substring(g, 1, 1), F.lit("|m:"))).alias("new_form"),
        F.when(F.size("ws") > 1, by_root).alias("ordered"),
    )
    return parsed.join(turned, "name", "left").select("name", "n", "kind", F.coalesce("new_stem", "stem").alias("stem"), F.coalesce("new_form", "form").alias("form"), "ordered")


def learn(names: DataFrame, min_partners: int = MIN_PARTNERS, share: float = PARTNER_SHARE, min_shared: int = MIN_SHARED, shared: float = SHARED) -> Reader:
    """A reader with the general words that a table of (name, n) itself shows.

    Lines of business and given names stand beside many different words, each of which stands beside few; legal forms tell firms from people. A
    word that stands with several firms or families which are also known under one general word, and all but never beside that word, is its
    short form or nickname. Misspelt words count as what they are nearest to.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(a, n, firm, w) for a, n in zip(pdf["name"], pdf["n"]) for firm, ws in [name_words(a)] for w in ws]
            yield pd.DataFrame(out, columns=["name", "n", "firm", "word"])

    told, drop_told = saved(names.mapInPandas(split, "name string, n long, firm boolean, word string"))
    words = told.groupBy("word").agg(F.sum("n").alias("n"))
    roots = strongest(saved(trie_join(words, "word"))[0], words)
    rooted, drop_rooted = saved(told.join(roots, "word").select("name", "n", "firm", F.col("root").alias("word")).distinct())
    l, r = rooted.select("name", F.col("word").alias("a")), rooted.select("name", F.col("word").alias("b"))
    beside, drop_beside = saved(l.join(r, "name").where("a <> b").select("a", "b").distinct())
    count = beside.groupBy("a").agg(F.count(F.lit(1)).alias("k"))
    fewer = beside.join(count.withColumnRenamed("k", "ka"), "a").join(count.select(F.col("a").alias("b"), F.col("k").alias("kb")), "b").groupBy(F.col("a").alias("word")).agg(F.count_if(F.col("kb") < F.col("ka")).alias("partners"))
    kinds = rooted.groupBy("word").agg((F.avg(F.col("firm").cast("double")) >= 0.5).alias("firm"), F.sum("n").alias("n")).join(fewer, "word")
    kinds, drop_kinds = saved(kinds)
    most = kinds.groupBy("firm").agg(F.max("partners").alias("most"))
    general = kinds.join(F.broadcast(most), "firm").where(F.col("partners") >= F.greatest(F.lit(min_partners), F.col("most") * share))
    general, drop_general = saved(general.select("word", "firm", "n"))
    # what isn't general is a firm's or family's own; a short form meets its full form there, never in one name
    own = beside.join(general.select(F.col("word").alias("b")), "b", "left_anti").select(F.col("a").alias("short"), F.col("b").alias("own"))
    via = own.join(beside.select(F.col("a").alias("own"), F.col("b").alias("word")), "own").where("short <> word").join(general.select("word", F.col("firm").alias("word_firm"), F.col("n").alias("word_n")), "word")
    met = via.groupBy("short", "word", "word_firm", "word_n").agg(F.count(F.lit(1)).alias("met"))
    together = l.join(r, "name").where("a <> b").groupBy(F.col("a").alias("short"), F.col("b").alias("word")).agg(F.count(F.lit(1)).alias("together"))
    met = met.join(together, ["short", "word"], "left").where(F.coalesce("together", F.lit(0)) <= F.col("met") * 0.1)
    seen = own.groupBy("short").agg(F.count(F.lit(1)).alias("seen"))
    fits = met.join(seen, "short").join(kinds.select(F.col("word").alias("short"), F.col("firm").alias("short_firm"), F.col("n").alias("short_n")), "short")
    fits = fits.where((F.col("short_firm") == F.col("word_firm")) & (F.col("short_n") < F.col("word_n")))
    # of several full forms the one that is met far more than the others
    best = fits.groupBy("short", "short_firm", "seen").agg(F.max_by("word", "met").alias("word"), F.max("met").alias("top"), F.sort_array(F.collect_list("met"), False).alias("all")).where((F.col("top") >= min_shared) & (F.col("top") >= F.col("seen") * shared))
    full = {r["short"]: r["word"] for r in best.where((F.size("all") == 1) | (F.try_element_at("all", F.lit(2)) * DOMINANCE <= F.col("top"))).select("short", "word").collect()}
    known = general.orderBy(F.desc("n"), "word").collect()
    for drop in (drop_told, drop_rooted, drop_beside, drop_kinds, drop_general):
        drop()

    def root(w: str) -> str:
        seen = {w}
        while w in full and full[w] not in seen:
            w = full[w]
            seen.add(w)
        return w

    trades = [r["word"] for r in known if r["firm"] and root(r["word"]) == r["word"]]
    given: dict[str, list[str]] = {r["word"]: [] for r in known if not r["firm"] and root(r["word"]) == r["word"]}
    aliases = {}
    for w in sorted(full):
        if root(w) in given:
            given[root(w)].append(w)
        elif _abbreviates(w, root(w)) or _abbreviates(root(w), w):  # lines of business are shortened by letters
            aliases[w] = root(w)
    return Reader(trades, aliases, {g: " ".join(ns) for g, ns in given.items()})


def name_entities(names: DataFrame, name: str, n: str, reader: Reader | None = None) -> DataFrame:
    """(name, entity) of names of firms and people; (name, n) has each name once with how often it is used.

    Names without letters, and forms that could belong to several entities, have no row. Without a ``reader`` the table's own general words are
    learned first.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(a, b, *r) for a, b in zip(pdf["name"], pdf["n"]) if (r := reader.read(a)) is not None]
            yield pd.DataFrame(out, columns=["name", "n", "kind", "stem", "form", "own", "guessed"])

    rows = names.select(F.col(name).alias("name"), F.col(n).cast("long").alias("n")).where("name IS NOT NULL AND name <> ''")
    reader = reader or learn(rows)
    parsed = cut(spread(rows, "name").mapInPandas(read, "name string, n long, kind string, stem string, form string, own array<string>, guessed boolean"), costly=True)
    parsed = cut(_part_endings(cut(_in_order(parsed)), reader))
    word, other = (F.concat_ws(":", F.substring("kind", 1, 1), c) for c in ("stem", "ordered"))
    turned = parsed.where("ordered <> stem").select(word.alias("a"), other.alias("b"), "n")
    stems = cut(parsed.select(word.alias("word"), "n").unionByName(turned.select(F.col("b").alias("word"), "n")).groupBy("word").agg(F.sum("n").alias("n")))
    pairs = cut(trie_join(stems.select(F.substring("word", 3, 10_000).alias("w")), "w"), costly=True)
    by_kind = pairs.select(F.explode(F.array(F.lit("f:"), F.lit("p:"))).alias("k"), "a", "b", "d").select(F.concat("k", "a").alias("a"), F.concat("k", "b").alias("b"), "d")
    roots = strongest(by_kind.unionByName(turned.select("a", "b", F.lit(0).alias("d"))), stems)
    rooted = parsed.withColumn("word", F.concat_ws(":", F.substring("kind", 1, 1), "stem")).join(roots, "word").select("name", "kind", "root", "form")
    # what a stem's names say beside it: distinct combinations of a small vocabulary, not names
    forms = rooted.select("kind", "root", "form").distinct()

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = pdf["kind"].iloc[0]
        found = (firm_entities if kind == "firm" else person_entities)(sorted(pdf["form"]))
        return pd.DataFrame([(kind, pdf["root"].iloc[0], f, e) for f, e in found.items() if e is not None], columns=["kind", "root", "form", "entity"])

    entities = spread(forms, "kind", "root").groupBy("kind", "root").applyInPandas(resolve, "kind string, root string, form string, entity string")
    return rooted.join(entities, ["kind", "root", "form"]).select("name", F.concat_ws("|", "kind", "root", "entity").alias("entity"))


def _measure_tokens(name: str) -> list[tuple[str, bool]]:
    """(word, abbreviated) of a measure's name in its order, without fillers."""
    text = plain(name).replace("'", "").replace("’", "").replace("a/c", "ac")
    out = []
    for t in re.split(r"[\s,()\-/]+", text):
        w = re.sub(r"[^a-z0-9]", "", t)
        if w and w not in FILLERS:
            out.append((w, t.endswith(".")))
    return out


def singular(w: str) -> str:
    if len(w) > 4 and w.endswith(("xes", "ses", "ches", "shes")):
        w = w[:-2]
    return w[:-1] if len(w) > 2 and w.endswith("s") and not w.endswith("ss") else w


def looked_up(toks: list[tuple[str, bool]]) -> set[str]:
    """The words whose use ``pieces`` may ask for."""
    out = {singular(t) for t, _ in toks} | {singular(t + u) for (t, _), (u, _) in zip(toks, toks[1:])}
    for t, _ in toks:
        if len(t) > 6:
            out |= {singular(x) for i in range(2, len(t) - 1) for x in (t[:i], t[i:])}
    return out


def pieces(toks: list[tuple[str, bool]], used: dict[str, int]) -> list[tuple[str, bool]]:
    """Tokens joined or cut where that makes words used more than the token itself."""

    def n(w: str) -> int:
        return used.get(w, 0)

    out: list[tuple[str, bool]] = []
    k = 0
    while k < len(toks):
        t, dot = toks[k]
        if k + 1 < len(toks):
            both = singular(t + toks[k + 1][0])
            if n(both) > min(n(singular(t)), n(singular(toks[k + 1][0]))):
                out.append((both, False))
                k += 2
                continue
        k += 1
        w = singular(t)
        cuts = [(min(n(singular(a)) or (10**9 if a in FILLERS else 0), n(singular(b)) or (10**9 if b in FILLERS else 0)), a, b) for i in range(2, len(t) - 1) for a, b in [(t[:i], t[i:])] if max(len(a), len(b)) > 3] if len(t) > 6 else []
        best = max(cuts, default=(0, "", ""))
        if best[0] > n(w):
            out += [(singular(x), False) for x in best[1:] if x not in FILLERS]
        else:
            out.append((w, dot))
    return out


def stand_ins(items: DataFrame, options: DataFrame, plain_words: DataFrame, ratio: float = 0.25) -> DataFrame:
    """(word, full): short words that take the place of one to three others in names otherwise equal and used far more often.

    ``items`` has (name, n, pos, token, word), ``options`` (token, idx, word) with the token's own word as 0. A short word of up to five letters among
    ``plain_words`` (those that aren't misspelt) counts if every name that holds it has such a counterpart, all with the same words in its place, and is
    used ``ratio`` as often as that at most.
    """

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for n, ws in zip(pdf["n"], pdf["words"]):
                ws = list(ws)
                out += [(n, " ".join(sorted(ws[:k] + ws[k + m :])), ws[k : k + m]) for m in range(1, 4) for k in range(len(ws) - m + 1) if m < len(ws) and sum(map(len, ws[k : k + m])) >= 5]
                if len(out) > 5_000:
                    yield pd.DataFrame(out, columns=["n", "rest", "span"])
                    out = []
            yield pd.DataFrame(out, columns=["n", "rest", "span"])

    said = items.groupBy("name", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "word")))["word"].alias("words")).withColumn("size", F.size("words"))
    said, drop_said = saved(said.where("size > 1"))
    # only names with a counterpart of up to two words more that is used so much oftener can hold one, and the other way round
    sizes = said.groupBy("size").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    above = sizes.select(F.explode(F.expr("sequence(size - 2, size)")).alias("size"), "most").groupBy("size").agg(F.max("most").alias("most"))
    below = sizes.select(F.explode(F.expr("sequence(size, size + 2)")).alias("size"), "least").groupBy("size").agg(F.min("least").alias("least"))
    placed = said.join(below, "size").where(F.col("n") * ratio >= F.col("least")).select("n", "words").mapInPandas(places, "n long, rest string, span array<string>")
    # of each rest only the most used words in the place, so that nothing is paired within a group
    full, drop_full = saved(placed.groupBy("rest").agg(F.max_by("span", F.struct("n", "span")).alias("full"), F.max("n").alias("full_n")))
    rare = said.join(above, "size").where(F.col("n") <= F.col("most") * ratio).select("name")
    placed_short = items.join(rare, "name", "left_semi").select("name", "n", "pos", "token").join(options, "token").where("length(word) <= 5").join(plain_words.select("word"), "word", "left_semi")
    short, drop_short = saved(placed_short.select("name", "n", F.col("pos").alias("k"), "word").distinct())
    others = short.select("name", "k").distinct().join(items.select("name", "pos", "token"), "name").where("pos <> k")
    rests = fitting(others, options.select("token", "idx", F.lit(ALWAYS).alias("side"), F.array("word").alias("words")), full.select(F.col("rest").alias("target")))
    met = short.join(rests.select("name", "k", F.col("target").alias("rest")), ["name", "k"]).join(full, "rest")
    met = met.where((F.col("n") <= F.col("full_n") * ratio) & ~F.array_contains("full", F.col("word")) & (F.length(F.array_join("full", "")) > F.length("word"))).select("name", "word", "full").distinct()
    held = said.select("name", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("held"))
    one = met.groupBy("word").agg(F.count_distinct("name").alias("met"), F.count_distinct("full").alias("ways"), F.min("full").alias("full"))
    out, _ = saved(one.join(held, "word").where("ways = 1 AND met = held").select("word", "full"))
    for drop in (drop_said, drop_full, drop_short):
        drop()
    return out


def measure_entities(names: DataFrame, name: str, n: str) -> DataFrame:
    """(name, entity) of names of measures: all words serve to write out abbreviations, and all readings of a name count."""
    rows = cut(names.select(F.col(name).alias("name"), F.col(n).cast("long").alias("n")).where("name IS NOT NULL AND name <> ''"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for a, b in zip(pdf["name"], pdf["n"]):
                toks = _measure_tokens(a)
                own = Counter(singular(t) for t, _ in toks)
                out += [(a, b, w, own[w]) for w in looked_up(toks)]
                if len(out) > 5_000:
                    yield pd.DataFrame(out, columns=["name", "n", "word", "times"])
                    out = []
            yield pd.DataFrame(out, columns=["name", "n", "word", "times"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for a, b, counts in zip(pdf["name"], pdf["n"], pdf["counts"]):
                used = {w: int(m) for w, m in (c.split(" ") for c in counts)}
                out += [(a, b, k, t + "." * dot, t) for k, (t, dot) in enumerate(pieces(_measure_tokens(a), used))]
            yield pd.DataFrame(out, columns=["name", "n", "pos", "token", "word"])

    # each name gets the use of the words it may be cut into or joined to, so that no vocabulary is sent around
    asked, drop_asked = saved(spread(rows, "name").mapInPandas(ask, "name string, n long, word string, times long"))
    used, drop_used = saved(asked.where("times > 0").groupBy("word").agg(F.sum(F.col("n") * F.col("times")).alias("n")))
    told = asked.select("name", F.col("n").alias("name_n"), "word").join(used, "word").groupBy("name", F.col("name_n").alias("n")).agg(F.collect_list(F.concat_ws(" ", "word", F.col("n").cast("string"))).alias("counts"))
    items, _ = saved(spread(told, "name").mapInPandas(read, "name string, n long, pos int, token string, word string"))
    words = cut(items.groupBy("word").agg(F.sum("n").alias("n")))
    roots = strongest(cut(trie_join(words, "word"), costly=True), words)

    tokens = items.select("token", "word").distinct()
    fits = written_out(tokens.join(used, "word", "left").select("token", "word", F.coalesce("n", F.lit(0)).alias("n")), used)
    likely = fits.select("token", "word", F.row_number().over(W.partitionBy("token").orderBy(F.desc("n"), "word")).alias("idx"))
    options, _ = saved(tokens.select("token", "word", F.lit(0).alias("idx")).unionByName(likely))
    drop_asked()
    drop_used()

    # a reading with what stand-ins take the place of comes after the others
    full = stand_ins(items, options, roots.where("word = root").select("word"))
    stood = full.select(F.col("word").alias("short"), F.posexplode("full").alias("at", "word")).join(roots, "word", "left").groupBy("short").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("root", "word").alias("root"))))["root"].alias("full"))
    sided = options.join(roots, "word", "left").join(stood.withColumnRenamed("short", "word"), "word", "left").select("token", "idx", F.coalesce("root", "word").alias("root"), "full")
    sided = sided.select("token", "idx", F.when(F.col("full").isNull(), ALWAYS).otherwise(AS_IT_STANDS).alias("side"), F.array("root").alias("words")).unionByName(sided.where("full IS NOT NULL").select("token", "idx", F.lit(STOOD_IN).alias("side"), F.col("full").alias("words")))
    sided = cut(sided.groupBy("token", "side", "words").agg(F.min("idx").alias("idx")))
    own = items.join(roots, "word").groupBy("name", "n").agg(F.array_join(F.array_sort(F.collect_list("root")), " ").alias("target"))
    own = cut(own.groupBy("target").agg(F.sum("n").alias("support")))
    read_as = fitting(items.select("name", F.lit(0).alias("k"), "pos", "token"), sided, own)
    signed = read_as.join(own, "target").join(rows, "name")
    # a reading counts where another name says just that, and more often than what the name says as it stands
    best = W.partitionBy("name").orderBy(F.desc(F.col("support") > F.col("n")), "aside", F.desc("support"), "rank")
    return signed.withColumn("k", F.row_number().over(best)).where("k = 1").select("name", F.col("target").alias("entity"))


def pairs_of(entities: DataFrame) -> DataFrame:
    """(name_a, name_b) of every two names of one entity, name_a before name_b by code points.

    All pairs are wanted here: an entity has as many names as there are ways it is spelt, not as it has rows.
    """
    a, b = entities.alias("a"), entities.alias("b")
    return a.join(b, F.col("a.entity") == F.col("b.entity")).where("a.name < b.name").select(F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b"))


def variants(facts: DataFrame, subject: str = "subject_key", metric: str = "metric_key", reader: Reader | None = None) -> DataFrame:
    """(field, name_a, name_b) of the spellings of one firm, person or measure among two columns.

    Null and empty names are none, repeated rows only weigh more, extra columns are left out, an empty table gives no rows. The general words of
    names are learned from the table, if no ``reader`` brings its own.
    """
    both = cut(facts.select(F.explode(F.array(F.struct(F.lit("subject").alias("field"), F.col(subject).alias("name")), F.struct(F.lit("metric").alias("field"), F.col(metric).alias("name")))).alias("f")).select("f.field", "f.name").where("name IS NOT NULL AND name <> ''").groupBy("field", "name").agg(F.count(F.lit(1)).alias("n")))
    subject_pairs = pairs_of(cut(name_entities(both.where("field = 'subject'"), "name", "n", reader)))
    metric_pairs = pairs_of(cut(measure_entities(both.where("field = 'metric'"), "name", "n")))
    return subject_pairs.select(F.lit("subject").alias("field"), "name_a", "name_b").unionByName(metric_pairs.select(F.lit("metric").alias("field"), "name_a", "name_b"))
