"""Best-fit packing by exact-complement hashing.

Pieces of one length are interchangeable, so the packing is planned on the
histogram of lengths, which has at most `capacity` entries however many
documents there are. Single lengths, pairs and triples that exactly fill a gap
are consumed first under their availability; what is left goes best-fit into the
gaps. Every piece then finds its place from its rank among pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import tokens
from quarry.llm._shared import materialise, prepare

#: (number of sequences, ((length, times), ...) in their order of placing)
Group = tuple[int, tuple[tuple[int, int], ...]]


def _pair(avail: np.ndarray, total: int, most: int) -> tuple[int, int] | None:
    """Available lengths x >= y with x + y = total and x <= most, x largest."""
    top = min(most, total - 1)
    low = (total + 1) // 2
    if top < low:
        return None
    xs = np.arange(top, low - 1, -1)
    fit = np.flatnonzero((avail[xs] > 0) & (avail[total - xs] > 0))
    for at in fit[:2]:
        x = int(xs[at])
        if 2 * x != total or avail[x] > 1:
            return x, total - x
    return None


def _complement(avail: np.ndarray, first: int, gap: int) -> tuple[int, ...] | None:
    if gap > 0 and gap <= first and avail[gap] > (gap == first):
        return (gap,)
    held = avail.copy()
    held[first] -= 1
    if found := _pair(held, gap, first):
        return found
    for x in np.flatnonzero(held[: min(first, gap - 2) + 1])[::-1].tolist():
        if 3 * x < gap:
            break
        held[x] -= 1
        rest = _pair(held, gap - x, x)
        held[x] += 1
        if rest:
            return (x, *rest)
    return None


def plan(lengths: dict[int, int], capacity: int) -> list[Group]:
    """Groups of equally filled sequences for a histogram {length: pieces}."""
    avail = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in lengths.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit {capacity}")
        avail[length] += n
    groups: list[Group] = []
    if avail[capacity]:
        groups.append((int(avail[capacity]), ((capacity, 1),)))
        avail[capacity] = 0
    for length in range(capacity - 1, (capacity - 1) // 4, -1):
        while avail[length] > 0 and (rest := _complement(avail, length, capacity - length)):
            used = Counter((length, *rest))
            n = min(int(avail[x]) // k for x, k in used.items())
            for x, k in used.items():
                avail[x] -= n * k
            groups.append((n, tuple(sorted(used.items(), reverse=True))))
    gaps: dict[int, list[Group]] = {}
    is_open = np.zeros(capacity + 1, dtype=bool)

    def put(gap: int, group: Group) -> None:
        if group[0]:
            gaps.setdefault(gap, []).append(group)
            is_open[gap] = True

    for length in range(capacity, 0, -1):
        left = int(avail[length])
        while left:
            fitting = np.flatnonzero(is_open[length:])
            if fitting.size:
                gap = length + int(fitting[0])
                n, held = gaps[gap].pop()
                if not gaps[gap]:
                    is_open[gap] = False
            else:
                gap, held = capacity, ()
                n = -(-left // (capacity // length))
            each = gap // length
            full = min(n, left // each)
            part = min(left - full * each, each) if full < n else 0
            put(gap - each * length, (full, held + ((length, each),)))
            if part:
                put(gap - part * length, (1, held + ((length, part),)))
            if held:
                put(gap, (n - full - bool(part), held))
            left -= full * each + part
    return groups + [group for kept in gaps.values() for group in kept]


def _slots(groups: list[Group]) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, pieces per sequence, first sequence, offset), by length and rank."""
    seen: Counter = Counter()
    rows, sequence = [], 0
    for n, content in groups:
        offset = 0
        for length, each in content:
            rows.append((length, seen[length], each, sequence, offset))
            seen[length] += n * each
            offset += length * each
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5), sequence


def cut(
    docs: DataFrame, capacity: int, tokenizer: str, end_id: int, id_col: str, text_col: str, cached_words: int | None = None
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and part and nth,
    the task and the piece's number among those of its length in that task."""
    kind = docs.schema[id_col].dataType.simpleString()
    width = capacity * 4
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = tokens.encoder(tokenizer, cached_words).encode_all
        end = np.array([end_id], dtype="<u4").tobytes()
        part = TaskContext.get().partitionId()
        seen: Counter = Counter()
        for batch in batches:
            rows, owner = [], []
            texts = (t.as_py() for t in batch.column(1).cast(pa.binary()))
            for at, ids in enumerate(encode_all(texts)):
                ids += end
                for k, low in enumerate(range(0, len(ids), width)):
                    held = ids[low : low + width]
                    length = len(held) // 4
                    owner.append(at)
                    rows.append((k, low // 4, length, zlib.crc32(held), part, seen[length]))
                    seen[length] += 1
            columns = list(zip(*rows)) if rows else [()] * 6
            types = [pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64()))] + [pa.array(c, t) for c, t in zip(columns, types)],
                names,
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        pieces,
        f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint",
    )


def pack(
    docs: DataFrame,
    capacity: int = 2048,
    tokenizer: str | None = None,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    cached_words: int | None = None,
) -> DataFrame:
    """Pack all documents into sequences of at most capacity tokens.

    A document is the ids of its text followed by end_id; only longer ones are
    cut, into pieces of capacity, of which the last may be shorter. One row per
    piece: doc_id, piece (from 0), start, length, ids_crc32 (of the piece's
    little-endian unsigned 32-bit ids), sequence_id, offset (gapless from 0).

    Null and empty text: end_id alone. A very long text becomes many pieces. Pieces
    of equal length are interchangeable and placed in the order of tasks. Null ids and repeated rows are packed like
    any other row. An empty table gives an empty result; other columns are
    ignored. cached_words bounds the words whose ids a worker process keeps (default:
    tokens.CACHED_WORDS): fewer take less memory and more time. The driver holds one number per length, capacity at most. A hot
    length needs no large task: ranks come from counts per input task.
    """
    spark = docs.sparkSession
    prepare(spark)
    found = materialise(cut(docs, capacity, tokenizer or tokens.default_path(), end_id, id_col, text_col, cached_words))
    counts = found.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    lengths = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots, _ = _slots(plan(lengths, capacity))
    table = spark.sparkContext.broadcast(slots)
    ranked = found.join(base, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank")
    )
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = table.value
        keys = slots[:, 0] << 48 | slots[:, 1]
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            slot = slots[np.searchsorted(keys, length << 48 | rank, side="right") - 1]
            nth = rank - slot[:, 1]
            yield pa.RecordBatch.from_arrays(
                batch.columns[:5]
                + [pa.array(slot[:, 3] + nth // slot[:, 2]), pa.array(slot[:, 4] + nth % slot[:, 2] * length)],
                names,
            )

    kind = found.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(
        place,
        f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    )
