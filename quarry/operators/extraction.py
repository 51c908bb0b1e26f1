"""Concepts named by a language model. The model is a plug-in: a function from a
list of prompts to a list of answers, called on batches inside the executors."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

CATEGORIES = ("risks", "mechanisms", "impacts")
_HIT = "category string, label string, confidence double, evidence string, section string"


def prompt(body: str, labels: dict[str, list[str]]) -> str:
    """What the model is asked about one document."""
    lists = "\n\n".join(f"{c.upper()}:\n" + "\n".join(f"- {label}" for label in labels.get(c, ())) for c in CATEGORIES)
    return (
        f"Name the concepts of these lists that the text below speaks of.\n\n{lists}\n\nTEXT:\n{body}\n\n"
        f"Answer with one JSON object: for each of {', '.join(CATEGORIES)} a list of objects with label, "
        "confidence (0 to 1), evidence (a quote of at most 100 characters) and section."
    )


def parsed(answer: str | None) -> list[tuple]:
    """(category, label, confidence, evidence, section) of an answer's JSON object,
    from its first to its last brace; nothing if there is none."""
    text = answer or ""
    low, high = text.find("{"), text.rfind("}")
    try:
        found = json.loads(text[low : high + 1]) if 0 <= low < high else {}
    except ValueError:
        return []
    rows = []
    for category in CATEGORIES:
        listed = found.get(category) if isinstance(found, dict) else None
        for item in listed if isinstance(listed, list) else ():
            if isinstance(item, dict) and isinstance(item.get("label"), str):
                confidence = item.get("confidence")
                sure = float(confidence) if isinstance(confidence, (int, float)) else None
                rows.append((category, item["label"], sure, item.get("evidence"), item.get("section")))
    return rows


def extracted(
    chunks: DataFrame, vocabulary: DataFrame, model: Callable[[list[str]], list[str]], batch: int = 16, most: int | None = None
) -> DataFrame:
    """(doc_id, category, label, uri, confidence, evidence, section) of chunks
    (doc_id, n, section, text) by a vocabulary (category, label, uri), which is small
    and goes into every prompt. A batch that fails gives nothing. most cuts a
    document's text to what the model takes; None sends it whole. A label outside the
    vocabulary gets a uri of its own words."""
    labels: dict[str, list[str]] = {}
    for row in vocabulary.orderBy("category", "label").collect():
        labels.setdefault(row["category"], []).append(row["label"])
    parts = F.array_sort(F.collect_list(F.struct("n", F.concat_ws(":\n", "section", "text").alias("t"))))
    body = F.array_join(F.transform(parts, lambda p: p["t"]), "\n")
    docs = chunks.groupBy("doc_id").agg(body.alias("body"))

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for at in range(0, len(frame), batch):
                some = frame.iloc[at : at + batch]
                try:
                    answers = model([prompt((b or "")[:most], labels) for b in some["body"]])
                except Exception:  # noqa: BLE001  a failed batch is defined as nothing
                    continue
                for doc, answer in zip(some["doc_id"], answers):
                    out += [(doc, *hit) for hit in parsed(answer)]
            yield pd.DataFrame(out, columns=["doc_id", *[c.split()[0] for c in _HIT.split(", ")]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    hits = docs.mapInPandas(ask, f"doc_id {kind}, {_HIT}")
    known = vocabulary.select("category", F.lower("label").alias("_label"), "uri").dropDuplicates(["category", "_label"])
    named = hits.withColumn("_label", F.lower(F.trim("label"))).join(known, ["category", "_label"], "left")
    own = T.sanitise_uri(F.initcap("label"))
    return named.select("doc_id", "category", "label", F.coalesce("uri", own).alias("uri"), "confidence", "evidence", "section")
