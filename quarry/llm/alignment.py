"""Alignment of two tokenizers over the bytes of the same texts.

A text is cut where neither vocabulary joins characters: before a space or a line
feed behind a character that is no white space. The parts repeat, so each worker
process keeps how a part's tokens align. New parts are encoded together, and a
two-pointer merge of the cumulative byte ends of both token sequences gives the
groups and the links. Documents are taken in chunks of bounded size: a chunk's pairs
of ids form a dictionary with the number of its documents that hold each, and a
document keeps places in it. Spark adds the dictionaries up, joins counts and
per-side maxima back to them, and each chunk's documents meet their dictionary again.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._shared import forget, materialise, only, prepare

#: Bytes of text whose documents form a chunk; a longer document is one by itself.
CHUNK_BYTES = 4 << 20
#: Parts whose alignment a worker process keeps; all are dropped when there are more.
KEPT_PARTS = 250_000
#: Characters of new parts encoded together, and of the longest one among them.
_TOGETHER, _SHORT = 1 << 18, 64
#: Parts in one string that is encoded.
_JOINED = 32
#: Pairs of tokens expanded at once.
_PAIRS = 1 << 21
#: White space, then other characters, up to a space or line feed behind one of them.
_PART = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
#: The byte that each character of a byte-level vocabulary stands for: printable ones
#: for themselves, the other bytes in order from U+0100.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_OF = {chr(b): b for b in _PLAIN} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}

_aligners: dict[tuple, "Aligner"] = {}


def default_paths() -> tuple[str, str, str]:
    import public_tokenizers as found

    return found.path("byte_bpe_50k.json"), found.path("piece_bpe_32k.model"), found.path("byte_bpe_50k.tiktoken")


class ByteLevel:
    """A: byte-level BPE. Parts of ASCII characters are encoded from the vocabulary's
    rank file, which gives the same ids."""

    def __init__(self, path: str, ranks_path: str | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        size = self._tokenizer.get_vocab_size()
        entries = [self._tokenizer.id_to_token(i) or "" for i in range(size)]
        self.bytes_of = [bytes(_BYTE_OF.get(c, 0) for c in entry) for entry in entries]
        self._ranks = None
        if ranks_path is not None:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self._ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str], short_parts: bool) -> list[list[int]]:
        if self._ranks is not None and short_parts and all(map(str.isascii, texts)):
            return list(map(self._ranks.encode_ordinary, texts))
        return [found.ids for found in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """B: pieces with byte fallback, which puts a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self._model.get_piece_size())
        self.bytes_of = [
            bytes([int(self._model.id_to_piece(i)[3:5], 16)]) if self._model.is_byte(i) else self._model.id_to_piece(i).replace("▁", " ").encode() for i in ids
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


def merge_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """The offsets in both of two ascending sequences without repeats: a two-pointer
    merge, done as a stable merge of two sorted runs, in which equals are neighbours."""
    both = np.concatenate([ends_a, ends_b])
    both.sort(kind="stable")
    return both[1:][both[1:] == both[:-1]]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of all ranges one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if ends.size else 0) + np.repeat(starts - (ends - sizes), sizes)


def _pairs(owner: np.ndarray, group_a: np.ndarray, ids_a: np.ndarray, group_b: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """(owner of a group << 32 | pair, links), distinct and sorted: all pairs of an A and a B
    token of one group. Equal ids of a group are counted, not repeated, and pairs are
    expanded in blocks, so memory follows the distinct pairs."""
    held_a, times_a = np.unique(group_a.astype(np.int64) << 32 | ids_a, return_counts=True)
    held_b, times_b = np.unique(group_b.astype(np.int64) << 32 | ids_b, return_counts=True)
    first, last = (np.searchsorted(held_b >> 32, held_a >> 32, side=side) for side in ("left", "right"))
    sizes, done = last - first, []
    for rows in np.split(np.arange(held_a.size), np.flatnonzero(np.diff(np.cumsum(sizes) // _PAIRS)) + 1):
        at_b = _spread(first[rows], sizes[rows])
        at_a = np.repeat(rows, sizes[rows])
        pair = (held_a[at_a] & 0xFFFFFFFF) << 16 | held_b[at_b] & 0xFFFFFFFF
        done.append(_summed(owner[held_a[at_a] >> 32] << 32 | pair, times_a[at_a] * times_b[at_b]))
    if len(done) == 1:
        return done[0]
    return _summed(*(np.concatenate(c) for c in zip(*done)))


def _summed(keys: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sum of the numbers of each."""
    order = np.argsort(keys, kind="stable")
    keys, numbers = keys[order], numbers[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if keys.size else order
    return keys[new], np.add.reduceat(numbers, new) if keys.size else numbers


def _batches(texts: list[str | None]) -> Iterator[list[str | None]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text or "")
        if size > _TOGETHER:
            yield held
            held, size = [], 0
    yield held


class Aligner:
    """How the tokens of parts align, kept for parts met before."""

    def __init__(self, path_a: str, path_b: str, ranks_path: str | None):
        self._a, self._b = ByteLevel(path_a, ranks_path), Pieces(path_b)
        if len(self._a.bytes_of) > 1 << 16 or len(self._b.bytes_of) > 1 << 16:
            raise ValueError("ids of both vocabularies must be under 65536")
        self._length_a, self._length_b = (np.array([len(x) for x in side.bytes_of]) for side in (self._a, self._b))
        most = max(len(self._a.bytes_of), len(self._b.bytes_of))
        self._text = [f"{i}{mark}" for i in range(most) for mark in ",|;\n"]
        self.clear()

    def clear(self) -> None:
        self._place: dict[str, int] = {}
        self._groups: list[str] = []
        self._unsound: set[int] = set()
        self._numbers: list[np.ndarray] = []
        self._pairs: list[np.ndarray] = []
        self._links: list[np.ndarray] = []
        self._sizes: list[np.ndarray] = []

    def align(self, texts: list[str | None]) -> dict[str, object]:
        """Of each text n_a, n_b, n_groups, n_links, groups_sha256, and at and n: places
        in the dictionary (pairs, docs) of all texts and links; null for no tokens."""
        if len(self._place) > KEPT_PARTS:
            self.clear()
        places, hashes = [], []
        for some in _batches(texts):
            parts = [_PART.findall(" " + t) if t else [] for t in some]
            self._learn({p: None for found in parts for p in found if p not in self._place})
            for found in parts:
                held = list(map(self._place.__getitem__, found))
                if not self._unsound.isdisjoint(held):
                    held = []
                places.append(np.array(held, dtype=np.int32))
                hashes.append(sha256(";".join(map(self._groups.__getitem__, held)).encode()).hexdigest() if held else "")
        numbers = np.concatenate(self._numbers) if self._numbers else np.zeros((0, 4), np.int64)
        sizes, pairs, links = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self._sizes, self._pairs, self._links))
        totals = np.array([numbers[p].sum(axis=0) for p in places], dtype=np.int64).reshape(-1, 4)
        starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(texts)), [p.size for p in places])
        held, times = np.unique(owner << 32 | np.concatenate(places), return_counts=True)
        part = held & 0xFFFFFFFF
        at = _spread(starts[part], sizes[part])
        held, n = _summed(np.repeat(held >> 32 << 32, sizes[part]) | pairs[at], links[at] * np.repeat(times, sizes[part]))
        known, inverse = np.unique(held & 0xFFFFFFFF, return_inverse=True)
        ends = np.searchsorted(held, np.arange(1, len(texts)) << 32)
        return {
            "totals": totals, "hashes": hashes, "at": np.split(inverse.astype(np.int32), ends), "n": np.split(n, ends), "pairs": known,
            "docs": np.bincount(inverse, minlength=known.size),
        }

    def _learn(self, new: dict[str, None]) -> None:
        short, held, size = [], [], 0
        for part in new:
            if "▁" in part:  # its bytes cannot come back from B
                self._add([part], None)
            elif len(part) > _SHORT or part[-1].isspace():
                self._together([part], False)
            else:
                (held if part.isascii() else short).append(part)
        for some in (held, short):
            joined: list[str] = []
            for part in some:
                joined.append(part)
                size += len(part)
                if size > _TOGETHER:
                    self._together(joined, True)
                    joined, size = [], 0
            if joined:
                self._together(joined, True)
            size = 0

    def _add(self, parts: list[str], found: tuple | None) -> None:
        first = len(self._place)
        self._place.update(zip(parts, range(first, first + len(parts))))
        if found is None:
            self._unsound.update(range(first, first + len(parts)))
            self._groups += [""] * len(parts)
            self._numbers.append(np.zeros((len(parts), 4), np.int64))
            self._sizes.append(np.zeros(len(parts), np.int64))
        else:
            groups, numbers, sizes, pairs, links = found
            self._groups += groups
            self._numbers.append(numbers)
            self._sizes.append(sizes)
            self._pairs.append(pairs)
            self._links.append(links)

    def _together(self, parts: list[str], short: bool) -> None:
        """Encode parts, some in one text behind a filler, whose token is dropped."""
        joined = ["a" + "".join(parts[i : i + _JOINED]) for i in range(0, len(parts), _JOINED)]
        sides = []
        for found in (self._a.encode([" " + t for t in joined], short), self._b.encode(joined)):
            if len({ids[0] for ids in found}) > 1:
                raise ValueError("a vocabulary joins characters across a cut")
            ids = np.fromiter(chain.from_iterable(found), dtype=np.int64)
            sides.append(np.delete(ids, np.cumsum([0, *map(len, found[:-1])])))
        ids_a, ids_b = sides
        whole = "".join(parts).encode()
        if any(b"".join(map(side.bytes_of.__getitem__, ids.tolist())) != whole for side, ids in ((self._a, ids_a), (self._b, ids_b))):
            if len(parts) > 1:
                for part in parts:
                    self._together([part], short)
            else:
                self._add(parts, None)
            return
        ends_a, ends_b = np.cumsum(self._length_a[ids_a]), np.cumsum(self._length_b[ids_b])
        stops = np.cumsum([len(p.encode()) for p in parts])
        common = merge_ends(ends_a, ends_b)
        if not np.isin(stops, common, assume_unique=True).all():
            raise ValueError("a vocabulary joins characters across a cut")
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        part_of = np.searchsorted(stops, common)
        held, links = _pairs(part_of, group_a, ids_a, group_b, ids_b)
        n_a, n_b = np.bincount(group_a, minlength=common.size), np.bincount(group_b, minlength=common.size)
        numbers = np.stack(
            [np.add.reduceat(x, np.searchsorted(part_of, np.arange(len(parts)))) for x in (n_a, n_b, np.ones_like(n_a), n_a * n_b)], axis=1
        )
        self._add(parts, (self._spelled(ids_a, group_a, ids_b, group_b, part_of), numbers, np.bincount(held >> 32, minlength=len(parts)), held & 0xFFFFFFFF, links))

    def _spelled(self, ids_a: np.ndarray, group_a: np.ndarray, ids_b: np.ndarray, group_b: np.ndarray, part_of: np.ndarray) -> list[str]:
        """``a1,a2|b1;a3|b2`` for each part."""
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        last_group = np.append(part_of[1:] != part_of[:-1], True)[group_b]
        marks = np.concatenate([ids_a * 4 + last_a, ids_b * 4 + last_b * (2 + last_group)])
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        return "".join(map(self._text.__getitem__, marks[order].tolist())).split("\n")[:-1]


def aligner(paths: tuple[str, str, str | None]) -> Aligner:
    """One aligner per worker process."""
    only("alignment", _aligners.clear)
    if paths not in _aligners:
        _aligners.clear()
        _aligners[paths] = Aligner(*paths)
    return _aligners[paths]


_FOUND = (
    "chunk bigint, id string, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, at array<int>, n array<bigint>, "
    "a array<int>, b array<int>, docs array<bigint>"
)


def _chunks(paths: tuple[str, str, str | None], chunk_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for key, text in zip(batch["id"], batch["text"]):
                if held and size + len(text or b"") > chunk_bytes:
                    yield _chunk(task << 32 | number, held, paths)
                    number, held, size = number + 1, [], 0
                held.append((key, text))
                size += len(text or b"")
        if held:
            yield _chunk(task << 32 | number, held, paths)

    return run


def _decoded(text: bytes | None) -> str | None:
    try:
        return bytes(text).decode() if text is not None else None
    except UnicodeDecodeError:  # no tokenizer gives these bytes back
        return None


def _chunk(number: int, rows: list[tuple], paths: tuple[str, str, str | None]) -> pd.DataFrame:
    found = aligner(paths).align([_decoded(text) for _, text in rows])
    columns = {"chunk": number, "id": [key for key, _ in rows]}
    columns |= {name: found["totals"][:, k] for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
    columns |= {"groups_sha256": found["hashes"], "at": found["at"], "n": found["n"], "a": None, "b": None, "docs": None}
    docs, pairs = pd.DataFrame(columns), found["pairs"]
    words = {"chunk": number, "a": [(pairs >> 16).astype(np.int32)], "b": [(pairs & 0xFFFF).astype(np.int32)], "docs": [found["docs"]]}
    whole = pd.concat([docs.astype(object), pd.DataFrame(words).reindex(columns=docs.columns).astype(object)])
    return whole.where(whole.notna(), None)


_SCORED = "id string, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, n_best_b bigint, count_sum bigint"


def _score(docs: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    """Sums over the links of each document of a chunk, whose dictionary is words."""
    size = int(words["place"].max()) + 1 if len(words) else 0
    columns = np.zeros((3, size), dtype=np.int64)
    columns[:, words["place"].to_numpy()] = words[["best_a", "best_b", "count"]].to_numpy(dtype=np.int64).T
    lengths = docs["at"].map(len).to_numpy()
    ends = np.cumsum(lengths)
    out = docs[["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]].copy()
    if ends.size and ends[-1]:
        at, n = np.concatenate(docs["at"].tolist()), np.concatenate(docs["n"].tolist())
        sums = np.concatenate([np.zeros((3, 1), np.int64), np.cumsum(columns[:, at] * n, axis=1)], axis=1)
        found = sums[:, ends] - sums[:, ends - lengths]
    else:
        found = np.zeros((3, len(docs)), dtype=np.int64)
    out["n_best"], out["n_best_b"], out["count_sum"] = found
    return out


def align(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str, str | None] | None = None, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """How two tokenizers align over each document, and how common its links are.

    A encodes a space and the text, B the text, before which it puts a space. Byte
    offsets where tokens of both end cut them into groups; all pairs of an A and a B
    token of one group are links. The count of a pair of ids is the number of
    documents that hold it linked. Per row: doc_id, n_a, n_b, n_groups, n_links,
    groups_sha256 (of ``a1,a2|b1;a3|b2``), n_best (links whose count is the highest
    of their A id), n_best_b (of their B id), count_sum (over links).

    Null and empty texts, and those whose bytes do not come back from both sides
    (U+2581, bytes that are no UTF-8), have no tokens: zeros, and '' as the digest.
    Control strings inside texts are plain text. A very long text is one chunk and
    aligned whole. Ties for the highest count are all best. Rows that repeat, and
    rows with a null doc_id, are documents of their own; other columns are ignored;
    an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    found = materialise(rows.mapInPandas(_chunks(paths or default_paths(), chunk_bytes), _FOUND))
    words = found.where("a is not null").select("chunk", F.posexplode(F.arrays_zip("a", "b", "docs")).alias("place", "w")).select(
        "chunk", "place", "w.a", "w.b", "w.docs"
    )
    counts = materialise(words.groupBy("a", "b").agg(F.sum("docs").alias("count")))
    tops = [counts.groupBy(side).agg(F.max("count").alias(f"top_{side}")) for side in "ab"]
    stats = materialise(
        counts.join(tops[0], "a").join(tops[1], "b")
        .select("a", "b", "count", *[(F.col("count") == F.col(f"top_{side}")).cast("int").alias(f"best_{side}") for side in "ab"])
    )
    back = words.select("chunk", "place", "a", "b").join(stats, ["a", "b"]).select(F.col("chunk").alias("of"), "place", "count", "best_a", "best_b")
    parts = found.where("a is null").drop("a", "b", "docs")
    forget(counts)
    scored = parts.groupBy("chunk").cogroup(back.groupBy("of")).applyInPandas(_score, _SCORED)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "n_best_b", "count_sum", "groups_sha256"]
    return scored.select(F.col("id").cast(kind).alias("doc_id"), *names)
