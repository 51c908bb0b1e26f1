"""Text spans: chunking, offsets, sentences, and mapping annotations to chunks."""

from __future__ import annotations

import re


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from quarry.functions import constants as C


def paragraphs(docs: DataFrame, separator: str = "\n", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, start, text): non-empty parts with their half-open code-point
    offsets, which are summed inside the row, so texts are not shuffled."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.split(text_col, re.escape(separator)).alias("parts"))
    zero = F.array(F.lit(0).cast("bigint"))
    starts = F.aggregate(
        "parts", zero, lambda done, part: F.concat(done, F.array(F.element_at(done, -1) + F.length(part) + len(separator)))
    )
    placed = rows.select("doc_id", F.posexplode(F.arrays_zip(F.col("parts").alias("text"), starts.alias("start"))).alias("n", "x"))
    return placed.select("doc_id", "n", "x.start", "x.text").where("text != ''")


def numbered_sections(sections: DataFrame) -> DataFrame:
    """sections (doc_id, place, title, parts array) with section_number: a section
    takes a number, then each of its parts, one at least, the numbers after it."""
    before = Window.partitionBy("doc_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    size = 1 + F.greatest(F.size("parts"), F.lit(1))
    return sections.withColumn("section_number", 1 + F.coalesce(F.sum(size).over(before), F.lit(0)))


def packed(parts: Column, most: int = 1000, glue: str = "\n\n") -> Column:
    """Greedy chunks of an array of strings: a chunk takes parts until the next
    would carry it over `most` characters."""

    def step(state: Column, part: Column) -> Column:
        current, done = state["current"], state["done"]
        full = (F.length(current) + F.length(part) > most) & (current != "")
        grown = F.when(current == "", part).otherwise(F.concat(current, F.lit(glue), part))
        return F.struct(
            F.when(full, part).otherwise(grown).alias("current"),
            F.when(full, F.concat(done, F.array(current))).otherwise(done).alias("done"),
        )

    start = F.struct(F.lit("").alias("current"), F.array().cast("array<string>").alias("done"))
    return F.aggregate(
        parts, start, step, lambda s: F.when(F.trim(s["current"]) != "", F.concat(s["done"], F.array(s["current"]))).otherwise(s["done"])
    )


#: A run of final marks, white space, and a capital after it; or the control character
#: that stands for such an end already. Blanks before the marks go when a piece is trimmed.
_BOUNDARY = re.compile(r"(?<![.!?])[.!?]+[ \t\n\f\r]+(?=[A-Z])|\x01")


def split_sentences(text: str | None, trim: str | None = None) -> list[str]:
    """Sentences without their final marks; after an abbreviation the next piece is
    joined on again with a bare full stop. trim: the characters that are taken off
    both ends of a piece, white space unless given."""
    out: list[str] = []
    before = ""
    for at, piece in enumerate(_BOUNDARY.split(text or "")):
        piece = piece.strip(trim)
        if at and before.endswith(C.ABBREVIATIONS):
            out[-1] += "." + piece
        else:
            out.append(piece)
        before = piece
    return [s for s in (s.strip(trim) for s in out) if s]


def sentences(text: str | Column, trim: str | None = None) -> Column:
    """The array of split_sentences()."""

    @F.pandas_udf(ArrayType(StringType()))
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_sentences(t, trim))

    return split(text)


_WORD_ENDS = frozenset(" \n\t.!?")


def split_with_offsets(text: str | None, size: int = 4500, trim: str | None = None) -> list[tuple[int, str]]:
    """(start, chunk) of at most size characters, cut at word ends where there are any.
    trim: the characters taken off both ends of a chunk, white space unless given."""
    text, at, out = text or "", 0, []
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            cut = next((k for k in range(end, at, -1) if text[k] in _WORD_ENDS), end)
            end = cut
        if chunk := text[at:end].strip(trim):
            out.append((at, chunk))
        at = end
        while at < len(text) and text[at] in " \n\t":
            at += 1
    return out


def offset_chunks(text: str | Column, trim: str | None = None) -> Column:
    """The array of split_with_offsets()."""
    kind = ArrayType(StructType().add("start", IntegerType()).add("chunk", StringType()))

    @F.pandas_udf(kind)
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "chunk": c} for a, c in split_with_offsets(t, trim=trim)])

    return cut(text)


def overlap_join(spans: DataFrame, chunks: DataFrame, key: str = "doc_id", bucket: int = 512) -> DataFrame:
    """spans (key, lo, hi, ...) with the chunks (key, start, stop, ...) they overlap.

    Both sides are cut into buckets of offsets, so the join is an equality on key
    and bucket; a pair is kept in the first bucket both share. The work follows the
    overlaps, not the product of a document's spans and chunks.
    """
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / bucket), F.floor(F.greatest(hi - 1, lo) / bucket)))
    left = spans.withColumn("_b", bins(F.col("lo"), F.col("hi")))
    right = chunks.withColumn("_b", bins(F.col("start"), F.col("stop")))
    first = F.floor(F.greatest("lo", "start") / bucket)
    return left.join(right, [key, "_b"]).where((F.col("lo") < F.col("stop")) & (F.col("hi") > F.col("start")) & (F.col("_b") == first)).drop("_b").withColumn(
        "relative_lo", F.greatest(F.col("lo") - F.col("start"), F.lit(0))
    ).withColumn("relative_hi", F.least(F.col("hi") - F.col("start"), F.col("stop") - F.col("start")))


def _with_texts(chunks: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """One row per document with its text and all its chunks (_rows), so a text is
    shuffled once and not with every chunk."""
    own = [c for c in chunks.columns if c != key]
    return chunks.groupBy(key).agg(F.collect_list(F.struct(*own)).alias("_rows")).join(docs.select(key, "text"), key)


def located(chunks: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """chunks (key, chunk) with start and stop of their first place in the text; misses go."""
    placed = _with_texts(chunks, docs, key).select(
        key, F.inline(F.expr("transform(_rows, r -> struct(r, locate(trim(r.chunk), text) - 1 AS start))")).alias("_row", "start")
    )
    return placed.where("start >= 0").select(key, "_row.*", "start", (F.col("start") + F.length(F.trim("_row.chunk"))).alias("stop"))


def highlighted(text: Column, terms: list[str], fragments: int = 3, size: int = 150) -> Column:
    """Up to three marked fragments around terms; an approximation of an engine's fragmenter.

    A fragment starts half the size before a term, or where the last one ended, and ends
    half the size after the last term that begins within half the size of its start: what
    the pattern .{0,half}term.{0,half} takes, but that tries every start of a text. Here
    the text is cut at its terms once and its pieces are gone through in order.
    """
    pattern = "|".join(map(re.escape, sorted(terms, key=len, reverse=True)))
    half = size // 2
    found = F.regexp_extract_all(text, F.lit(rf"(?is)(?=\b({pattern})\b)"), F.lit(1))
    pieces = F.split(text, rf"(?is)(?=\b(?:{pattern})\b)")
    # the piece before the first term, unless the text begins with one
    lead = F.when(F.size(found) == F.size(pieces), 0).otherwise(F.length(pieces[0]))
    rest = F.when(F.size(found) == F.size(pieces), pieces).otherwise(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))))
    whole = F.length(text)

    def step(state: Column, item: Column) -> Column:
        at, low, high, used, done = (state[c] for c in ("at", "low", "high", "used", "done"))
        ends = at + F.length(item["term"])
        inside = (low >= 0) & (at - low <= half)
        closed = (low >= 0) & ~inside
        after = F.when(closed, F.least(high + half, whole)).otherwise(used)
        opens = ~inside & (at >= after)
        return F.struct(
            (at + F.length(item["piece"])).alias("at"),
            F.when(inside, low).when(opens, F.greatest(after, at - half)).otherwise(-1).alias("low"),
            F.when(inside | opens, ends).otherwise(high).alias("high"),
            after.alias("used"),
            F.when(closed, F.concat(done, F.array(F.struct(low.alias("low"), after.alias("high"))))).otherwise(done).alias("done"),
        )

    none = F.array().cast("array<struct<low:int,high:int>>")
    start = F.struct(lead.alias("at"), F.lit(-1).alias("low"), F.lit(0).alias("high"), F.lit(0).alias("used"), none.alias("done"))
    last = lambda s: F.array(F.struct(s["low"].alias("low"), F.least(s["high"] + half, whole).alias("high")))
    enough = lambda s, x: F.when(F.size(s["done"]) < fragments, step(s, x)).otherwise(s)
    spots = F.aggregate(
        F.arrays_zip(rest.alias("piece"), found.alias("term")), start, enough,
        lambda s: F.when(s["low"] >= 0, F.concat(s["done"], last(s))).otherwise(s["done"]),
    )
    cut = lambda x: F.substring(text, x["low"] + 1, x["high"] - x["low"])
    return F.transform(F.slice(spots, 1, fragments), lambda x: F.regexp_replace(cut(x), rf"(?i)\b({pattern})\b", "<mark>$1</mark>"))


def reconstruct_offsets(text: str, chunk: str) -> tuple[int, int] | None:
    """Where a re-flowed chunk stands: its exact place, else the stretch from its
    first to its last words (three down to one) that is 50 to 2000 characters long
    and whose words agree with the chunk's to over 0.85 (Jaccard)."""
    at = text.find(chunk)
    if at >= 0:
        return at, at + len(chunk)
    words = chunk.split()
    want = set(words)
    for n in (3, 2, 1):
        if len(words) < 2 * n:
            continue
        head, tail = (re.compile(r"\s+".join(map(re.escape, part))) for part in (words[:n], words[-n:]))
        for first in head.finditer(text):
            for last in tail.finditer(text, first.end()):
                size = last.end() - first.start()
                if size > 2000:
                    break
                got = set(text[first.start() : last.end()].split())
                if size >= min(50, len(chunk)) and len(got & want) / len(got | want) > 0.85:
                    return first.start(), last.end()
    return None


def reconstructed(chunks: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """chunks (key, chunk) with lo and hi by reconstruct_offsets, null if not found."""
    kind = StructType().add("lo", IntegerType()).add("hi", IntegerType())

    @F.pandas_udf(ArrayType(kind))
    def find(texts: pd.Series, parts: pd.Series) -> pd.Series:
        at = lambda text, chunk: dict(zip(("lo", "hi"), reconstruct_offsets(text or "", chunk or "") or (None, None)))
        return pd.Series([[at(t, c) for c in cs] for t, cs in zip(texts, parts)])

    found = _with_texts(chunks, docs, key).withColumn("_at", find("text", F.col("_rows.chunk")))
    return found.select(key, F.inline(F.arrays_zip("_rows", "_at")).alias("_row", "_at")).select(key, "_row.*", "_at.lo", "_at.hi")


def structured(blocks: list[tuple[str, str]], least: int = 150, most: int = 1200, overlap: int = 1) -> list[tuple[str, str, list[str]]]:
    """(context, text, kinds) chunks of ordered (kind, text) blocks.

    A header starts a chunk and is the context of what follows; tables and lists
    stay whole even if they are over `most`; paragraphs over it are cut at
    sentences, and such a chunk repeats the last `overlap` sentences of the one
    before. A chunk below `least` joins the one before it under the same header.
    """
    out: list[tuple[str, str, list[str]]] = []
    context, held, kinds = "", [], []

    def flush() -> None:
        nonlocal held, kinds
        text = "\n".join(held)
        if text:
            last = out[-1] if out else None
            if last and len(text) < least and last[0] == context and len(last[1]) + len(text) < most:
                out[-1] = (context, f"{last[1]}\n{text}", last[2] + [k for k in kinds if k not in last[2]])
            else:
                out.append((context, text, list(dict.fromkeys(kinds))))
        held, kinds = [], []

    for kind, text in blocks:
        if kind == "header":
            flush()
            context = text
            continue
        pieces = [text]
        if kind == "paragraph" and len(text) > most:
            pieces, part = [], []
            for sentence in re.split(r"(?<=[.!?])\s+", text):
                if part and len(" ".join([*part, sentence])) > most:
                    pieces.append(" ".join(part))
                    part = part[-overlap:] if overlap else []
                part.append(sentence)
            pieces.append(" ".join(part))
        for piece in pieces:
            if held and len("\n".join([*held, piece])) > most:
                flush()
            held.append(piece)
            kinds.append(kind)
    flush()
    return out


def structured_column(kinds: Column, texts: Column, least: int = 150, most: int = 1200, overlap: int = 1) -> Column:
    """structured() of two arrays, as an array of (context, text, kinds): a document's
    blocks in one row, so nothing is shuffled and a batch of documents is one call."""
    kind = StructType().add("context", StringType()).add("text", StringType()).add("kinds", ArrayType(StringType()))

    @F.pandas_udf(ArrayType(kind))
    def chunks(kinds: pd.Series, texts: pd.Series) -> pd.Series:
        names = ("context", "text", "kinds")
        return pd.Series([[dict(zip(names, c)) for c in structured(list(zip(k, t)), least, most, overlap)] for k, t in zip(kinds, texts)], dtype=object)

    return chunks(kinds, texts)


def structured_chunks(blocks: DataFrame, least: int = 150, most: int = 1200, overlap: int = 1) -> DataFrame:
    """(doc_id, chunk_index, context, text, kinds) of blocks (doc_id, n, kind, text)."""
    held = blocks.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("n", "kind", "text"))).alias("b"))
    found = structured_column(F.col("b.kind"), F.col("b.text"), least, most, overlap)
    return held.select("doc_id", F.posexplode(found).alias("chunk_index", "c")).select("doc_id", "chunk_index", "c.*")
