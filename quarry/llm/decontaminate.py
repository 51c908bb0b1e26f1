"""Benchmark decontamination by template windows.

Tokens are canonicalised: numbers, names and units become typed placeholders.
Windows of canonical tokens of the documents meet those of the benchmark in a hash
join; the values that stand in the placeholders are the slots. Matches of one item
along one diagonal are a candidate passage, and it counts if its slots are
consistent: equal values in the item stay equal in the document and different ones
different. So a question with new numbers or names is found like a verbatim one,
and a text that only shares the shape of some tokens is not. A run of names or of
numbers is one placeholder, and matches on neighbouring diagonals add up, so names
of another length and inserted or deleted tokens hide nothing.

Items that the templates do not cover whole (windows with few literal tokens, at
most one window) are also matched by the plain values of their tokens, a list of
numbers alone included.

The documents pass once, however large the benchmark is: a bitmap of bounded size
over the hashes of its windows keeps all others out of the join.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._shared import forget, materialise, only, prepare
from quarry.llm.wordhash import Prefix

#: Canonical tokens of a window, literal tokens it needs, and the share of an
#: item's windows that make a leak.
WINDOW, LITERALS, COVERAGE = 8, 4, 0.5
#: Tokens of the shortest window that counts without any literal, by its values alone.
BARE = 3
#: Tokens inserted or deleted in all between matches that are added up.
DRIFT = 8
#: Tokens a worker process keeps, and the longest of them.
CACHED_TOKENS, CACHED_BYTES = 300_000, 48

UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t lb lbs oz ml cl l s sec second seconds "
    "min minute minutes h hour hours day days week weeks month months year years hz khz mhz ghz w kw mw j kj v a k c f "
    "b kb mb gb tb usd eur dollar dollars euro euros cent cents percent degree degrees".split()
)
_PUNCTUATION = "\"'`´‘’“”«»()[]{}<>|*#_~!?.,;:…-–—&%^=+\\/@"
_CLOSING, _SENTENCE_ENDS = "\"'”’»)]", (".", "!", "?", ":", "…")
_DIGIT = re.compile(r"\d")
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*")
_NUMBER_UNIT = re.compile(r"([+-]?[$€£]?\d[\d.,:/]*)([^\W\d_]+|%|°)")
_LITERAL, _NUM, _UNIT, _NAME, _NUM_UNIT = range(5)


def _hash(kind: str) -> int:
    return xxhash.xxh64_intdigest(f"\0{kind}")


_HASH_OF = np.array([0, _hash("number"), _hash("unit"), _hash("name"), _hash("number unit")], dtype=np.uint64)


def _power(n: np.ndarray) -> np.ndarray:
    """Powers of an odd number modulo 2 ** 64, for the order of tokens in a run."""
    return np.cumprod(np.full(int(n.max()) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))[n - 1] * (n > 0) + (n == 0)


class Tokens:
    """What single tokens are, kept for tokens that repeat."""

    def __init__(self) -> None:
        self._known: dict[bytes, int] = {}
        self._hash = np.zeros(1 << 12, dtype=np.uint64)
        self._size = 1

    def _slot(self, low: str) -> int:
        if self._size == self._hash.size:
            self._hash = np.concatenate((self._hash, np.zeros_like(self._hash)))
        self._hash[self._size] = xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass"))
        self._size += 1
        return self._size - 1

    def _code(self, token: bytes) -> int:
        """Bits 0-2 kind, 3 title case, 4 ends a sentence, 5 only punctuation; then the place of its hash."""
        text = token.decode("utf-8", "replace")
        bare = text.strip(_PUNCTUATION)
        low = bare.lower()
        code = _UNIT if low in UNITS else _LITERAL
        if _DIGIT.search(bare):
            joined = _NUMBER_UNIT.fullmatch(text.strip("\"'()[]{}!?.,;:"))
            if joined and (joined[2].lower() in UNITS or joined[2] in "%°"):
                code = _NUM_UNIT
            elif _NUMBER.fullmatch(bare):
                code = _NUM
        if code == _LITERAL and low != bare and len(bare) > 1 and bare[0].isupper() and not bare.isupper():
            code |= 8
        if text.endswith(_SENTENCE_ENDS) or text.rstrip(_CLOSING).endswith(_SENTENCE_ENDS):
            code |= 16
        if not bare:
            code |= 32
        return code | self._slot(low) << 6

    def read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Canonical hash, hash of the value, and whether it is a slot, for each
        token that is more than punctuation, a run of names or of numbers being
        one; then hash of the value and slot of each token by itself, and where in
        these each of the former begins, with the end."""
        known = self._known
        if len(known) > CACHED_TOKENS:
            known.clear()
            self._size = 1
        new = set(words).difference(known)
        for word in new:
            known[word] = self._code(word)
        code = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        for word in new:
            if len(word) > CACHED_BYTES:
                del known[word]
        kind = code & 7
        before = np.concatenate(([True], (code[:-1] & 16) > 0))[: code.size]
        kind[((code & 8) > 0) & ~before] = _NAME
        after_number = np.concatenate(([False], kind[:-1] == _NUM))[: code.size]
        kind[(kind == _UNIT) & ~after_number] = _LITERAL
        full = (code & 32) == 0
        kind, raw = kind[full], self._hash[code[full] >> 6]
        again = np.concatenate(([False], (kind[1:] == kind[:-1]) & ((kind[1:] == _NAME) | (kind[1:] == _NUM))))[: kind.size]
        begins = np.flatnonzero(~again)
        starts, value = np.append(begins, kind.size), raw
        if begins.size < kind.size:
            nth = np.arange(kind.size) - np.repeat(begins, np.diff(starts))
            value = np.add.reduceat(raw * _power(nth), begins, dtype=np.uint64)
        slot = kind != _LITERAL
        kind = kind[begins]
        return np.where(kind == _LITERAL, value, _HASH_OF[kind]), value, slot[begins], raw, slot, starts


_TEMPLATE, _PLAIN = 0, 1


def _index_windows(canon: np.ndarray, slot: np.ndarray, width: int, literals: int, bare: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, hashes, tokens of a window) of the windows of an item that count:
    those with literals literal tokens, and those of bare tokens or more. Fewer
    tokens than width: one window of them all."""
    held = min(width, canon.size)
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), 0
    free = np.cumsum(np.concatenate(([0], ~slot)))
    use = np.flatnonzero(free[held:] - free[:-held] >= (0 if held >= bare else min(literals, held)))
    return use, _tagged(Prefix(canon), held, width)[use], held


def _tagged(prefix: Prefix, held: int, width: int) -> np.ndarray:
    """Window hashes that tell windows of whole short items from others."""
    return prefix.windows(held) ^ np.uint64(held if held < width else 0)


def _lists(values: np.ndarray, at: np.ndarray, held: int) -> np.ndarray:
    return values[np.add.outer(at, np.arange(held))]


def _item_windows(items: DataFrame, width: int, literals: int) -> DataFrame:
    """(layer, hash, held, item_id, item_key, place, usable, theirs): the windows of
    the items (item_id, item_key, text), usable being an item's windows of the layer,
    and theirs the values of a window's tokens."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            for item_id, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                canon, value, slot, raw, raw_slot, _ = tokens.read(text.encode("utf-8", "surrogatepass").split())
                # a window of placeholders alone says nothing, but its values do
                found = [(_TEMPLATE, value, *_index_windows(canon, slot, width, literals, width + 1))]
                if canon.size and (found[0][2].size < max(canon.size - width + 1, 1) or canon.size <= width):
                    found.append((_PLAIN, raw, *_index_windows(raw, raw_slot, width, 1, BARE)))
                for layer, values, places, hashes, held in found:
                    n = places.size
                    if n:
                        same = lambda v, kind: pa.array([v] * n, kind)  # noqa: B023, E731
                        columns = [
                            same(layer, pa.int8()), pa.array(hashes.view(np.int64)), same(held, pa.int32()), same(item_id, pa.int64()), same(key, pa.string()),
                            pa.array(places.astype(np.int32)), same(n, pa.int32()), pa.array(list(_lists(values, places, held).view(np.int64)), pa.list_(pa.int64())),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, ["layer", "hash", "held", "item_id", "item_key", "place", "usable", "theirs"])

    return items.select("item_id", "item_key", "text").mapInArrow(
        cut, "layer tinyint, hash bigint, held int, item_id bigint, item_key string, place int, usable int, theirs array<bigint>"
    )


#: Bits of the bitmap over window hashes (8 MB); each window sets two.
SIEVE_BITS = 1 << 26


def _places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64(SIEVE_BITS - 1)
    return hashes & low, (hashes >> np.uint64(32)) & low


def _sieve(windows: DataFrame) -> np.ndarray:
    """The bitmap of the windows' hashes, put together from parts of 4 kB."""
    mask = F.lit(SIEVE_BITS - 1)
    bit = F.explode(F.array(F.col("hash").bitwiseAND(mask) + 1, F.shiftrightunsigned("hash", 32).bitwiseAND(mask) + 1)).alias("bit")
    parts = windows.select(bit).groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    found = np.zeros(SIEVE_BITS // 8, dtype=np.uint8)
    for row in parts.toLocalIterator():
        # buckets count from 1, and so do the bits in them
        part = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
        found[(row["part"] - 1) * part.size :][: part.size] = part
    return found


def _passage(hits: list[tuple], width: int, coverage: float) -> tuple | None:
    """(windows matched, windows, verbatim, first token, end) of the best consistent
    passage of one item in one text, if there is one. hits are (place, at, lo, hi,
    usable, theirs, mine)."""
    diagonals: dict[int, dict[int, tuple]] = defaultdict(dict)
    for hit in hits:
        diagonals[hit[1] - hit[0]][hit[0]] = hit
    usable = hits[0][4]
    least = coverage * usable
    if len(set().union(*diagonals.values())) < least:
        return None
    best, shifts = None, sorted(diagonals)
    for shift in shifts:
        near = shifts[bisect_left(shifts, shift - DRIFT) : bisect_right(shifts, shift + DRIFT)]
        tries = [diagonals[shift]]
        if len(near) > 1:
            added: dict[int, tuple] = {}
            for s in sorted(near, key=lambda s: (abs(s - shift), s)):
                for place, hit in diagonals[s].items():
                    added.setdefault(place, hit)
            if len(added) > len(tries[0]):
                tries.append(added)
        for chosen in tries:
            if len(chosen) < least or (best and len(chosen) < best[0]):
                continue
            some = list(chosen.values())
            theirs = [v for hit in some for v in hit[5]]
            mine = [v for hit in some for v in hit[6]]
            pairs = set(zip(theirs, mine))
            if len(pairs) != len(set(theirs)) or len(pairs) != len(set(mine)):
                continue
            same = theirs == mine and len({hit[1] - hit[0] for hit in some}) == 1
            if best is None or (len(some), same) > (best[0], best[2]):
                best = (len(some), usable, same, min(hit[2] for hit in some), max(hit[3] for hit in some))
    return best


_LEAK = "item_id:bigint,n_matched:bigint,n_windows:bigint,verbatim:boolean,first_token:bigint,n_tokens:bigint"
_HIT = ("place", "at", "lo", "hi", "usable", "theirs", "mine")
_of_worker: dict[str, Tokens] = {}


def _worker_tokens() -> Tokens:
    only("decontaminate", _of_worker.clear)
    return _of_worker.setdefault("", Tokens())


def leaks_of_texts(
    texts: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS, coverage: float = COVERAGE
) -> DataFrame:
    """(text_key, leaks) of the texts (text_key string, text) that hold an item of the
    benchmark (item_id, text): text_key tells texts apart, equal ones may repeat."""
    spark = texts.sparkSession
    prepare(spark)
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where("text is not null").distinct().withColumn("item_key", F.md5("text"))
    windows = materialise(_item_windows(items, window, literals))
    widths = defaultdict(list)
    for row in windows.select("layer", "held").distinct().collect():  # two layers, `window` widths at most
        widths[row["layer"]].append(row["held"])
    sent = spark.sparkContext.broadcast(_sieve(windows))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, bits = _worker_tokens(), sent.value
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for row, text in enumerate(batch.column(1).cast(pa.binary())):
                canon, value, _, raw, _, starts = tokens.read((text.as_py() or b"").split())
                for layer, hashed, values in ((_TEMPLATE, canon, value), (_PLAIN, raw, raw)):
                    prefix = Prefix(hashed) if widths[layer] else None
                    for held in widths[layer]:
                        if held > hashed.size:
                            continue
                        found = _tagged(prefix, held, window)
                        one, two = _places(found)
                        at = np.flatnonzero((bits[one >> np.uint64(3)] >> (one & np.uint64(7)).astype(np.uint8)) & (bits[two >> np.uint64(3)] >> (two & np.uint64(7)).astype(np.uint8)) & 1)
                        if at.size:
                            span = (starts[at], starts[at + held]) if layer == _TEMPLATE else (at, at + held)
                            parts = (np.full(at.size, row), np.full(at.size, layer), found[at].view(np.int64), at, *span)
                            for column, part in zip(columns, parts):
                                column.append(part)
                            columns[6] += list(_lists(values, at, held).view(np.int64))
            if columns[0]:
                rows, *rest = (np.concatenate(c) for c in columns[:6])
                kinds = [pa.int8(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), *[pa.array(c, k) for c, k in zip(rest, kinds)], pa.array(columns[6], pa.list_(pa.int64()))],
                    ["text_key", "layer", "hash", "at", "lo", "hi", "mine"],
                )

    seen = texts.select("text_key", "text").mapInArrow(search, "text_key string, layer tinyint, hash bigint, at int, lo int, hi int, mine array<bigint>")
    # copies of a text give their windows once
    seen = materialise(seen.groupBy("text_key", "layer", "hash", "at").agg(*[F.any_value(c).alias(c) for c in ("lo", "hi", "mine")]))
    pairs = seen.join(windows, ["layer", "hash"]).groupBy("text_key", "item_id", "item_key").agg(F.collect_list(F.struct("layer", *_HIT)).alias("hits"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, item, hits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                of: dict[int, list] = defaultdict(list)
                for hit in sorted(hits.as_py(), key=lambda h: (h["at"], h["place"])):
                    of[hit["layer"]].append(tuple(hit[name] for name in _HIT))
                for layer in (_TEMPLATE, _PLAIN):
                    found = _passage(of[layer], window, coverage) if of[layer] else None
                    if found:
                        n, usable, same, first, end = found
                        rows.append((key, item, n, usable, same, first, end - first))
                        break
            names = ["text_key", *[f.split(":")[0] for f in _LEAK.split(",")]]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)], names)

    leaks = pairs.select("text_key", "item_id", "hits").mapInArrow(judge, f"text_key string, {_LEAK.replace(':', ' ')}")
    each = F.struct(*[f.split(":")[0] for f in _LEAK.split(",")])
    found = materialise(leaks.groupBy("text_key").agg(F.array_sort(F.collect_list(each)).alias("leaks")))
    for old in (windows, seen):
        forget(old)
    return found


def annotate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    literals: int = LITERALS,
    coverage: float = COVERAGE,
    carry: Sequence[str] = ("doc_id",),
    text_col: str = "text",
) -> DataFrame:
    """The columns in carry, then leaks, for each row of docs: the benchmark items
    (item_id, text) whose windows the text holds to at least `coverage` along one
    diagonal or neighbouring ones with consistent slots. verbatim is false for a
    re-parameterised item. An item of one or two numbers or names alone (under BARE
    tokens) matches nothing. Of several passages of one item that with most windows
    is told, of equal ones the verbatim one, then the first found; every item that
    leaks is told, in the order of its id.

    Every text is read whole, once; a very long one in memory of a few times its
    size. Only its windows that the benchmark may hold are shuffled. A null, empty or
    punctuation-only text on either side matches nothing; null ids are carried along;
    repeated rows each give a row; an empty table of documents gives an empty result,
    an empty benchmark no leaks; other columns are ignored.
    """
    text = F.col(text_col).cast("string")
    # equal texts hold equal items, so leaks are found per text and told per row
    found = leaks_of_texts(docs.select(F.md5(text).alias("text_key"), text.alias("text")).where("text is not null"), benchmark, window, literals, coverage)
    rows = docs.select(F.struct(*carry).alias("carried"), F.md5(text).alias("text_key"))
    none = F.array().cast(f"array<struct<{_LEAK}>>")
    return rows.join(found, "text_key", "left").select("carried.*", F.coalesce("leaks", none).alias("leaks"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, n_matched, n_windows, coverage, verbatim, first_token,
    n_tokens): one row per leak that `annotate` finds, so none for clean documents."""
    leak = F.col("leak")
    return annotate(docs, benchmark, **options).select("doc_id", F.explode("leaks").alias("leak")).select(
        "doc_id", leak["item_id"].alias("item_id"), leak["n_matched"].alias("n_matched"),
        leak["n_windows"].alias("n_windows"), (leak["n_matched"] / leak["n_windows"]).alias("coverage"),
        leak["verbatim"].alias("verbatim"), leak["first_token"].alias("first_token"), leak["n_tokens"].alias("n_tokens"),
    )
