"""What ships with each registry of plug-ins; users add their own by name.

Minters and annotators are column functions, accumulators are aggregates or
functions over a list of values, handlers take a micro-batch and its state,
embedding models map a list of texts to a list of vectors, and extractors a list of
prompts to a list of answers.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.constants import CONCEPT_KEYWORDS
from quarry.requests import ACCUMULATORS, ANNOTATORS, EMBEDDINGS, EXTRACTORS, HANDLERS, MINTERS
from quarry.streaming.changes import Bundles, StateTable

for _kind in ("PERSON", "ORGANIZATION", "LOCATION", "DATE", "QUANTITY", "OTHER"):
    MINTERS.add(_kind.lower())(lambda text, kind=_kind: T.mint_uri(F.lit(kind), text))


def mint(kind: Column, text: Column) -> Column:
    """The uri of a text by the minter that the row names; null where none is known."""
    found = F.lit(None).cast("string")
    for name in MINTERS.names():
        found = F.when(kind == name, MINTERS.get(name)(text)).otherwise(found)
    return found


@ANNOTATORS.add("pattern")
def pattern(text: Column, regex: str = r"[A-Z][a-z]+") -> Column:
    """All matches of a pattern in order, as structs (text, kind)."""
    found = F.regexp_extract_all(text, F.lit(f"({regex})"), F.lit(1))
    return F.transform(found, lambda t: F.struct(t.alias("text"), F.lit("pattern").alias("kind")))


@ANNOTATORS.add("terms")
def terms(text: Column, known: tuple[str, ...] = ()) -> Column:
    """The known terms that stand in the text as words, as structs (text, kind)."""
    held = [F.when(F.array_contains(T.tokens(text, 1), w), F.struct(F.lit(w).alias("text"), F.lit("terms").alias("kind"))) for w in known]
    return F.array_compact(F.array(*held)) if held else F.array().cast("array<struct<text:string,kind:string>>")


@ACCUMULATORS.add("count")
def count(value: Column) -> Column:
    return F.count(value)


@ACCUMULATORS.add("sum_of_squares")
def sum_of_squares(value: Column) -> Column:
    return F.sum(value * value)


def folded(first: Column, update: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None) -> Callable[[Column], Column]:
    """An accumulator from a first state, an update and a final step, over a group's
    values in ascending order; a group's values meet in one row."""
    return lambda value: F.aggregate(F.array_sort(F.collect_list(value)), first, update, finish)


@ACCUMULATORS.add("alternating")
def alternating(value: Column) -> Column:
    """The last value less the one before plus the one before that, and so on."""
    return folded(F.lit(0).cast("bigint"), lambda s, v: v.cast("bigint") - s)(value)


@HANDLERS.add("upsert")
def upsert_handler(state: StateTable) -> Callable[[DataFrame, int], None]:
    return state.merge


@HANDLERS.add("bundle")
def bundle_handler(bundles: Bundles) -> Callable[[DataFrame, int], None]:
    return bundles.add


@EMBEDDINGS.add("shape")
def shape(texts: list[str]) -> list[list[float]]:
    """Characters, blanks and vowels of each text: a stand-in for a real model."""
    return [[float(len(t)), float(t.count(" ")), float(sum(t.count(v) for v in "aeiou"))] for t in texts]


@EXTRACTORS.add("keywords")
def keywords(prompts: list[str]) -> list[str]:
    """Answers as a model would, from the keyword rules: a stand-in that runs anywhere."""
    answers = []
    for asked in prompts:
        body = asked.split("\n\nTEXT:\n", 1)[1].rsplit("\n\nAnswer with", 1)[0].lower()
        found: dict[str, list[dict]] = {}
        for category, rules in CONCEPT_KEYWORDS.items():
            for uri, words in rules.items():
                held = next((w for w in words if w.lower() in body), None)
                if held:
                    label = "".join(f" {c}" if c.isupper() else c for c in uri.split(":")[1]).strip()
                    found.setdefault(category, []).append({"label": label, "confidence": 0.85, "evidence": held, "section": "Description"})
        answers.append(f"Here it is: {json.dumps(found)}")
    return answers
