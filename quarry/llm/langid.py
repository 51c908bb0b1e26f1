"""Language identification by cross-parsing entropy.

Running labelled text of each language becomes a suffix automaton. A text is
parsed against it by longest matches, across words; every match is a phrase, and
the language that needs the fewest phrases, each weighted with the bits of a
pointer into its training text, wins.

Symbols are UTF-8 bytes, so the alphabet is small for every script. The longest
match that starts where the last one ended is a deterministic walk: from a state
without a transition for the next symbol a new phrase starts at the root. That
walk is laid out as a flat table, and many documents step through the tables of
all languages together.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._shared import only, prepare

#: Documented bounds of the labelled sample: documents drawn of each language,
#: characters of each of them, and documents drawn in all. With more languages
#: each gets an equal share of the last, one document at least; no language is left out.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_TOTAL = 400, 160, 4000
#: Bytes of text whose documents step together, and the number of documents
#: still running from which on each is walked by itself.
_TOGETHER, _FEW = 3 << 20, 10

#: What separates the drawn documents; no parsed text holds it.
_BREAK = b"\n"
_SPACED = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
_LATIN = re.compile(rb"[A-Za-z]")
_models: dict[str, "Model"] = {}


class SuffixAutomaton:
    """All substrings of the text added, as transitions per state."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self._link, self._len = [-1], [0]

    def _state(self, length: int, link: int, step: dict[int, int]) -> int:
        self.next.append(step)
        self._link.append(link)
        self._len.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        copy = self._state(self._len[p] + 1, self._link[q], dict(self.next[q]))
        self._link[q] = copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self._link[p]
        return copy

    def add(self, text: bytes) -> None:
        """Add one text; a match never runs from one added text into another."""
        last = 0
        for c in text:
            p, q = last, self.next[last].get(c)
            if q is not None:
                last = q if self._len[q] == self._len[p] + 1 else self._split(p, q, c)
                continue
            last = self._state(self._len[p] + 1, 0, {})
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = last
                p = self._link[p]
            if p != -1:
                q = self.next[p][c]
                self._link[last] = q if self._len[q] == self._len[p] + 1 else self._split(p, q, c)


def normalised(text: str) -> bytes:
    """The text in lower case as UTF-8, every run of ASCII non-letters one space."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACED).split())


def has_letter(text: bytes) -> bool:
    """Whether any character of UTF-8 text is a letter (Unicode categories L*)."""
    return bool(_LATIN.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


class Model:
    """Parses texts against the running text of each language."""

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        texts = [[normalised(t) for t in samples[lang]] for lang in self.langs]
        symbols = sorted(set(b"".join(b"".join(t) for t in texts)))
        self._width = len(symbols) + 1  # the last column: symbols no language knows
        codes = np.full(256, len(symbols), dtype=np.uint8)
        codes[symbols] = np.arange(len(symbols))
        self._codes = codes.tobytes()
        self._bits = np.array([math.log2(sum(map(len, t)) + 2) for t in texts])
        made, self._roots, base = [], [], 0
        for k in range(len(texts)):
            automaton = SuffixAutomaton()
            for text in texts[k]:
                automaton.add(text)
            texts[k] = None
            made.append(self._moves(automaton))
            self._roots.append(base << 1)
            base += made[-1][0] * self._width
        # one array that each language's rows are laid into, so it is never held twice
        self._steps = np.empty(base, dtype=np.int32)
        for root in self._roots:
            self._lay(root >> 1, *made.pop(0))

    def _moves(self, automaton: SuffixAutomaton) -> tuple:
        """States, and of each transition the state, the symbol and the next state."""
        code, rows = self._codes, automaton.next
        sizes = np.array([len(r) for r in rows], dtype=np.int32)
        at = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
        over = np.fromiter((code[c] for r in rows for c in r), dtype=np.uint8, count=at.size)
        to = np.fromiter((q for r in rows for q in r.values()), dtype=np.int32, count=at.size)
        return len(rows), at, over, to

    def _lay(self, base: int, states: int, at: np.ndarray, over: np.ndarray, to: np.ndarray) -> None:
        """Row of each state: twice the place of the next state's row, plus one where a phrase starts."""
        width = self._width
        steps = (base + to * np.int32(width)) << 1
        of_root = int(np.searchsorted(at, 1))
        first = np.full(width, base << 1 | 1, dtype=np.int32)
        first[over[:of_root]] = steps[:of_root] | 1
        table = self._steps[base : base + states * width].reshape(states, width)
        table[:] = first
        table[at[of_root:], over[of_root:]] = steps[of_root:]

    def phrases(self, texts: Sequence[bytes]) -> np.ndarray:
        """Phrases of each normalised text (rows) in each language (columns)."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        sizes = np.array([len(texts[i]) for i in order], dtype=np.int64)
        coded = b"".join([texts[i] for i in order]).translate(self._codes)
        symbols = np.frombuffer(coded, dtype=np.uint8)
        place = np.cumsum(sizes) - sizes
        state = np.repeat(np.array(self._roots, dtype=np.int32)[:, None], len(texts), axis=1)
        count = np.zeros(state.shape, dtype=np.int32)
        end = int(sizes[_FEW]) if sizes.size > _FEW else 0
        running = np.searchsorted(-sizes, -np.arange(end), side="left")
        for n in running.tolist():
            at = state[:, :n] >> 1
            at += symbols[place[:n]]
            state[:, :n] = found = self._steps.take(at, mode="clip")
            found &= 1
            count[:, :n] += found
            place[:n] += 1
        steps = memoryview(self._steps)
        ends = np.cumsum(sizes).tolist()
        for k in range(min(_FEW, len(order))):
            rest = coded[ends[k] - int(sizes[k]) + end : ends[k]]
            for lang in range(len(self.langs)) if rest else ():
                x, n = int(state[lang, k]), 0
                for c in rest:
                    x = steps[(x >> 1) + c]
                    n += x & 1
                count[lang, k] += n
        back = np.empty((len(texts), len(self.langs)), dtype=np.int64)
        back[order] = count.T
        return back

    def predict(self, texts: Sequence[bytes | None]) -> list[tuple[str, float, float | None]]:
        """For each text the language, how much shorter its parse is than the next
        one's, 0 to 1, and the phrases it takes per symbol."""
        found: list[tuple[str, float, float | None]] = [("und", 0.0, None)] * len(texts)
        asked = [i for i, t in enumerate(texts) if t and self.langs and has_letter(t)]
        plain = [normalised(texts[i].decode("utf-8", "replace")) for i in asked]
        del texts  # the parse needs room of a few times the texts
        for i, text, phrases in zip(asked, plain, self.phrases(plain)):
            cost = phrases * self._bits
            best = int(np.argmin(cost))
            others = np.delete(cost, best)
            score = float(1 - cost[best] / others.min()) if others.size else 1.0
            found[i] = (self.langs[best], score, phrases[best] / len(text))
        return found


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[str]]:
    """Running text per language from a bounded labelled sample: SAMPLE_DOCS documents
    of each language (an equal share of SAMPLE_TOTAL if that is less), drawn by a
    hash of their id, SAMPLE_CHARS characters of each from a hash-drawn place. docs
    are the rows it may learn from. Rows with a null id, text or language, or without
    a letter in the drawn characters, teach nothing.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).dropna()
    draw = F.abs(F.xxhash64("i") % F.lit(1 << 40)) / F.lit(float(1 << 40))
    sizes = rows.groupBy("l").count().collect()
    if not sizes:
        return {}
    share = max(1, min(SAMPLE_DOCS, SAMPLE_TOTAL // len(sizes)))
    # as an Arrow table: a list of rows would start Python workers of their own on every executor
    most = {"l": pa.array([r["l"] for r in sizes], pa.string()), "most": pa.array([(4.0 * share + 8) / r["count"] for r in sizes], pa.float64())}
    wanted = docs.sparkSession.createDataFrame(pa.table(most))
    nth = F.row_number().over(Window.partitionBy("l").orderBy("d", "i", F.xxhash64("t")))
    room = F.greatest(F.length("t") - SAMPLE_CHARS, F.lit(0))
    start = (F.abs(F.xxhash64("i", F.lit(1)) % F.lit(1 << 40)) / F.lit(float(1 << 40)) * room).cast("int") + 1
    drawn = (
        rows.withColumn("d", draw).join(F.broadcast(wanted), "l").where(F.col("d") < F.col("most"))
        .select("l", "i", "d", F.substring("t", start, F.lit(SAMPLE_CHARS)).alias("t")).select("l", "t", nth.alias("n"))
        .where(F.col("n") <= share)
    )
    samples: dict[str, list[str]] = {}
    for row in sorted(drawn.toLocalIterator(), key=lambda r: (r["l"], r["n"])):
        if any(map(str.isalpha, row["t"])):
            samples.setdefault(row["l"], []).append(row["t"])
    return samples


def predict(
    docs: DataFrame, samples: dict[str, list[str]], text_col: str = "text", carry: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """The columns in carry, then lang_pred, score and phrase_rate (phrases per
    symbol in that language), for each row of docs, from the whole text only. No shuffle."""
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(samples)
    key = uuid.uuid4().hex

    def judged(model: Model, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = iter(model.predict([t.as_py() for batch in held for t in batch.column(1).cast(pa.binary())]))
        for batch in held:
            some = [next(found) for _ in range(batch.num_rows)]
            columns = [pa.array([f[k] for f in some], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["carried", "lang_pred", "score", "phrase_rate"])

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("langid", _models.clear)
        if key not in _models:
            _models.clear()
            _models[key] = Model(sent.value)
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(1).nbytes
            if size > _TOGETHER:
                yield from judged(_models[key], held)
                held, size = [], 0
        yield from judged(_models[key], held)

    rows = docs.select(F.struct(*carry).alias("carried"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["carried"].dataType.simpleString()
    return rows.mapInArrow(guess, f"carried {kind}, lang_pred string, score double, phrase_rate double").select(
        "carried.*", "lang_pred", "score", "phrase_rate"
    )


def held_out(doc_id: F.Column) -> F.Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per row of docs.

    Learns from text and lang of the rows that are not held out. lang_pred is a
    learned language, or `und` with score 0 exactly if the text is null or has no
    letter (Unicode category L*), or nothing could be learned. A text whose letters
    no language knows is a tie; ties go to the language first in code-point order,
    with score 0. A very long text is parsed whole, in memory of a few times its
    size. A null doc_id is never held out and teaches nothing. Repeated rows each
    give a row; an empty table gives none; other columns are ignored.
    """
    samples = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, samples).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
