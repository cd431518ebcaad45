"""The two Python boundaries: a parser of document bytes and an extractor of proposals.

Both are plain callables, run in ``mapInPandas`` next to the data. No parser library and no model is part of this
repository; tests pass deterministic stand-ins.
"""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators.extract import cache_key
from factweave.schema import PROPOSAL_FIELDS

#: bytes -> (page, block, line, span, kind, text, (x0, y0, x1, y1)) of every printed span; a blank last page is a span of empty text.
Parser = Callable[[bytes], Iterator[tuple]]
#: passage -> payload, the JSON text ``{"facts": [...]}``.
Extractor = Callable[[str], str]
SPAN_ROWS = "doc_id string, page int, block int, line int, span int, kind int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>"
ATTEMPTS, FIRST_PAUSE = 3, 2.0
PROMPT_VERSION = "v1"
TRANSIENT = ("429", "503", "overloaded", "timeout", "unavailable", "rate limit")


class IngestError(ValueError):
    """A document that can't be taken in: no text layer, or no passage worth reading."""


class ExtractorError(RuntimeError):
    """All models of an extractor failed."""


def chain(models: list[Extractor], attempts: int = ATTEMPTS, pause: float = FIRST_PAUSE, sleep: Callable[[float], None] = time.sleep) -> Extractor:
    """Models tried in turn, each up to ``attempts`` times while its error looks transient, pausing twice as long each time."""

    def call(passage: str) -> str:
        last: Exception | None = None
        for model in models:
            for k in range(attempts):
                try:
                    return model(passage)
                except Exception as e:  # noqa: BLE001
                    last = e
                    if not any(t in str(e).lower() for t in TRANSIENT):
                        break
                    if k + 1 < attempts:
                        sleep(pause * 2**k)
        raise ExtractorError(str(last))

    return call


def structured(model: Extractor) -> Extractor:
    """A model held to the schema of proposals: an answer that isn't ``{"facts": [...]}`` of flat objects with a quote is an error, so a chain goes on."""

    def call(passage: str) -> str:
        said = model(passage)
        body = re.sub(r"^```[a-z]*\s*|\s*```$", "", said.strip())
        facts = json.loads(body)["facts"]
        if not isinstance(facts, list):
            raise ValueError("facts is no list")
        for f in facts:
            if not isinstance(f, dict) or not isinstance(f.get("quote"), str) or any(isinstance(f.get(k), (list, dict)) for k in PROPOSAL_FIELDS) or not isinstance(f.get("confidence", 0.0), (int, float)):
                raise ValueError("a proposal is not as the schema wants it")
        return said

    return call


_PROVIDERS: dict[str, Extractor] = {}


def register_provider(name: str, extractor: Extractor) -> None:
    _PROVIDERS[name] = extractor


def get_provider(name: str | None = None) -> Extractor:
    """A registered extractor: the one named, or named by ``FACTWEAVE_PROVIDER``, or the only one there is."""
    name = name or os.environ.get("FACTWEAVE_PROVIDER") or (next(iter(_PROVIDERS)) if len(_PROVIDERS) == 1 else None)
    if name not in _PROVIDERS:
        raise ExtractorError(f"no extractor {name!r}; there are {sorted(_PROVIDERS)}")
    return _PROVIDERS[name]


def prompt(passage: str) -> str:
    """What an extractor is asked: quotes verbatim, numbers as printed, qualifiers only if stated."""
    return (
        "List every checkable fact in the passage as JSON {\"facts\": [...]}. Quote the words it rests on verbatim. Give numbers as printed, "
        "scale and unit apart, and a qualifier only where the passage states it. Fields of a fact: " + ", ".join(PROPOSAL_FIELDS) + ", confidence (0 to 1).\n\nPassage:\n" + passage
    )


def parse_documents(binaries: DataFrame, parser: Parser) -> DataFrame:
    """Printed spans of each document's bytes, for ``layout.flatten_spans``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SPAN_ROWS.split(", ")]
        for pdf in batches:
            for doc, content in zip(pdf["doc_id"], pdf["content"]):
                rows = [(doc, *r[:6], dict(zip(("x0", "y0", "x1", "y1"), r[6]))) for r in parser(content)]
                yield pd.DataFrame(rows, columns=names[: len(names)])

    return binaries.select("doc_id", "content").mapInPandas(run, SPAN_ROWS)


def call_extractor(windows: DataFrame, cache: DataFrame, extractor: Extractor, model: str, version: str = PROMPT_VERSION, parallel: int | None = None, ask: Callable[[str], str] = prompt) -> DataFrame:
    """``windows`` with cache_key, model, payload and hit: cached payloads, and fresh ones for the texts that have none.

    The extractor is given what ``ask`` makes of a window's text, once for each text. A call that fails gives a null payload. ``parallel`` bounds
    the calls made at a time.
    """
    keyed = windows.withColumn("cache_key", cache_key(version, model, F.col("text")))
    known = cache.groupBy("cache_key").agg(F.max_by("payload", F.struct("created_at", "payload")).alias("payload"))
    hits = keyed.select("cache_key").distinct().join(known, "cache_key").select("cache_key", "payload", F.lit(True).alias("hit"))
    missing = keyed.join(cache.select("cache_key"), "cache_key", "left_anti").groupBy("cache_key").agg(F.first("text").alias("text"))
    if parallel:
        missing = missing.repartition(parallel)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, text in zip(pdf["cache_key"], pdf["text"]):
                try:
                    said = extractor(ask(text))
                except Exception:  # noqa: BLE001
                    said = None
                out.append((key, said, False))
            yield pd.DataFrame(out, columns=["cache_key", "payload", "hit"])

    answers = hits.unionByName(missing.mapInPandas(run, "cache_key string, payload string, hit boolean"))
    return keyed.join(answers, "cache_key").withColumn("model", F.lit(model))
