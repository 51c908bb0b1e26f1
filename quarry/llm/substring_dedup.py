"""Removal of long passages that an earlier document holds too.

A window is `length` consecutive words. Every word covered by a window that also
starts in a document with a smaller id goes.

The reference shards are not consecutive slices of the corpus: each document
would have to pass every shard's automaton, and the broadcast would grow with
the corpus. Instead, equal windows are made to meet. The smallest hash among a
window's short grams, its minimiser, is the same wherever the window stands, so
the windows around one minimiser are one shard. For each shard with more than
one surrounding text a suffix automaton is built, whose states know the smallest
document they occur in; the texts are streamed through it, and wherever the
matching statistic reaches `length`, the state of the last `length` words names
the window's first owner.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._shared import forget, hash_filter, materialise, passes, prepare
from quarry.llm.wordhash import Prefix, word_hashes

#: Words of the grams among which a window's minimiser is chosen.
GRAM = 8
#: Texts around one minimiser up to which they share an automaton.
SHARD_TEXTS = 2048
#: Windows handled at a time in a very long text.
_STEP = 1 << 16


def segments(hashes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimiser: its hash, a hash of the words the run
    covers and of the minimiser's place in them, first window, windows."""
    n = hashes.size - length + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    prefix = Prefix(hashes)
    grams = prefix.windows(gram)
    width = length - gram + 1
    place = np.empty(n, dtype=np.int64)
    for at in range(0, n, _STEP):
        part = sliding_window_view(grams[at : min(n, at + _STEP) + width - 1], width)
        place[at : at + len(part)] = part.argmin(axis=1) + np.arange(at, at + len(part))
    firsts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    counts = np.diff(np.append(firsts, n))
    spots = place[firsts]
    content = prefix.spans(firsts, firsts + counts + length - 1) + (spots - firsts).astype(np.uint64)
    return grams[spots], content, firsts, counts


class OwnerAutomaton:
    """Suffix automaton over sequences of hashed words; every state knows the
    smallest owner of the sequences it occurs in."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len, self.owner = [-1], [0], [None]

    def add(self, words: list[int], owner: int) -> None:
        step, link, size, owners = self.next, self.link, self.len, self.owner
        last = 0
        for c in words:
            p, q = last, step[last].get(c)
            if q is None:
                cur = len(step)
                step.append({})
                link.append(0)
                size.append(size[p] + 1)
                owners.append(owner)
                while p != -1 and c not in step[p]:
                    step[p][c] = cur
                    p = link[p]
                q = step[p][c] if p != -1 else None
            else:
                cur = None
            if q is not None:
                if size[q] != size[p] + 1:
                    copy = len(step)
                    step.append(dict(step[q]))
                    link.append(link[q])
                    size.append(size[p] + 1)
                    owners.append(owners[q])
                    link[q] = copy
                    while p != -1 and step[p].get(c) == q:
                        step[p][c] = copy
                        p = link[p]
                    q = copy
                if cur is None:
                    cur = q
                    owners[cur] = owner if owners[cur] is None else min(owners[cur], owner)
                else:
                    link[cur] = q
            last = cur

    def settle(self) -> None:
        """Hand every state's owner on to the shorter substrings that end with it."""
        for state in sorted(range(1, len(self.next)), key=self.len.__getitem__, reverse=True):
            up = self.link[state]
            if up > 0 and (self.owner[up] is None or self.owner[state] < self.owner[up]):
                self.owner[up] = self.owner[state]

    def owners(self, words: list[int], length: int) -> list[int | None]:
        """For each window of words the smallest owner, None where none has it."""
        state, held, found = 0, 0, []
        for at, c in enumerate(words):
            while state and c not in self.next[state]:
                state = self.link[state]
                held = self.len[state]
            if c in self.next[state]:
                state = self.next[state][c]
                held += 1
            while state and self.len[self.link[state]] >= length:
                state = self.link[state]
                held = self.len[state]
            if at >= length - 1:
                found.append(self.owner[state] if held >= length else None)
        return found


def _keys(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, text_key, gram, content, first, n): the runs of every text."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, columns = [], []
            for at, text in enumerate(batch.column(2).cast(pa.binary())):
                words = (text.as_py() or b"").split()
                if len(words) >= length:
                    found = segments(word_hashes(words), length, gram)
                    owner.append(np.full(found[0].size, at, dtype=np.int64))
                    columns.append(found)
            if not owner:
                continue
            rows = pa.array(np.concatenate(owner))
            grams, contents, firsts, counts = (np.concatenate(c) for c in zip(*columns))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows), batch.column(1).take(rows), pa.array(grams.view(np.int64)),
                    pa.array(contents.view(np.int64)), pa.array(firsts.astype(np.int32)), pa.array(counts.astype(np.int32)),
                ],
                ["doc_id", "text_key", "gram", "content", "first", "n"],
            )

    return docs.mapInArrow(runs, "doc_id bigint, text_key bigint, gram bigint, content bigint, first int, n int")


def _key() -> Column:
    return F.xxhash64("doc_id", "text_key")


def _per_text(wanted: DataFrame) -> DataFrame:
    """(doc_id, text_key, runs): what is wanted of each text."""
    return wanted.groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("gram", "content", "owner", "hot", "first", "n")).alias("runs")
    )


def _cut_out(docs: DataFrame, per_text: DataFrame, length: int) -> DataFrame:
    """(gram, content, owner, hot, words): the hashed words of the runs of per_text, a
    written table. Only texts that may have runs are shuffled."""
    docs = passes(docs, hash_filter(per_text, _key()), _key()).where("_may").drop("_may")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, runs in zip(batch.column(0).cast(pa.binary()), batch.column(1)):
                hashes = word_hashes(text.as_py().split()).view(np.int64)
                for r in runs.as_py():
                    words = hashes[r["first"] : r["first"] + r["n"] + length - 1]
                    rows.append((r["gram"], r["content"], r["owner"], r["hot"], words.tolist()))
                    if len(rows) >= 5000:
                        yield _rows(rows)
                        rows = []
            if rows:
                yield _rows(rows)

    def _rows(rows: list) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), types)], ["gram", "content", "owner", "hot", "words"]
        )

    return docs.join(per_text, ["doc_id", "text_key"]).select("text", "runs").mapInArrow(
        cut, "gram bigint, content bigint, owner bigint, hot boolean, words array<bigint>"
    )


_RUNS = "array<struct<at:int,n:int,owner:bigint>>"


def _by_automaton(texts: DataFrame, length: int) -> DataFrame:
    """(gram, content, runs) from texts (gram, content, owner, words), shard by shard."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, held = None, []
        for batch in batches:
            out = []
            for row in zip(*(batch.column(i) for i in range(4))):
                g = row[0].as_py()
                if g != gram:
                    out += solved(gram, held)
                    gram, held = g, []
                held.append((row[1].as_py(), row[2].as_py(), row[3].as_py()))
            if out:
                yield _rows(out)
        if out := solved(gram, held):
            yield _rows(out)

    def solved(gram: int | None, held: list) -> list:
        if not held:
            return []
        shard = OwnerAutomaton()
        for _, owner, words in held:
            shard.add(words, owner)
        shard.settle()
        out = []
        for content, _, words in held:
            runs: list[dict] = []
            for at, owner in enumerate(shard.owners(words, length)):
                if runs and runs[-1]["owner"] == owner:
                    runs[-1]["n"] += 1
                else:
                    runs.append({"at": at, "n": 1, "owner": owner})
            out.append((gram, content, runs))
        return out

    run = pa.struct([("at", pa.int32()), ("n", pa.int32()), ("owner", pa.int64())])

    def _rows(rows: list) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.list_(run)]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), types)], ["gram", "content", "runs"]
        )

    return (
        texts.repartition("gram").sortWithinPartitions("gram")
        .select("gram", "content", "owner", "words")
        .mapInArrow(stream, f"gram bigint, content bigint, runs {_RUNS}")
    )


def _windows(texts: DataFrame, length: int) -> DataFrame:
    """(gram, content, owner, at, window): every window of texts as a hash."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(4))):
                gram, content, owner, words = (x.as_py() for x in row)
                found = Prefix(np.array(words, dtype=np.int64).view(np.uint64)).windows(length)
                n = found.size
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, v, dtype=np.int64)) for v in (gram, content, owner)
                    ] + [pa.array(np.arange(n, dtype=np.int32)), pa.array(found.view(np.int64))],
                    ["gram", "content", "owner", "at", "window"],
                )

    return texts.select("gram", "content", "owner", "words").mapInArrow(
        hashed, "gram bigint, content bigint, owner bigint, at int, window bigint"
    )


def _first_owners(windows: DataFrame) -> DataFrame:
    """(gram, window, least) of the windows that have several owners."""
    owners = windows.groupBy("gram", "window").agg(F.min("owner").alias("least"), F.max("owner").alias("most"))
    return owners.where("least < most").drop("most")


def _by_window(texts: DataFrame, windows: DataFrame, first: DataFrame, length: int) -> DataFrame:
    """The same for shards with very many texts: the windows meet one by one in an
    aggregation, so that no task needs a whole shard. windows and first are written
    tables, so their join can split a window that very many texts hold."""
    earlier = (
        windows.join(first.withColumnRenamed("gram", "g").withColumnRenamed("window", "w"),
                     (F.col("gram") == F.col("g")) & (F.col("window") == F.col("w")) & (F.col("least") < F.col("owner")))
        .groupBy("gram", "content")
        .agg(F.collect_list(F.struct("at", F.lit(1).alias("n"), F.col("least").alias("owner"))).alias("more"))
    )
    # the text's own owner has all its windows; only still earlier owners need naming
    own = texts.select(
        "gram", "content",
        F.array(F.struct(F.lit(0).alias("at"), (F.size("words") - length + 1).alias("n"), "owner")).cast(_RUNS).alias("runs"),
    )
    return own.join(earlier, ["gram", "content"], "left").select(
        "gram", "content", F.concat("runs", F.coalesce(F.col("more").cast(_RUNS), F.array().cast(_RUNS))).alias("runs")
    )


def removals(docs: DataFrame, length: int = 50, gram: int = GRAM, shard_texts: int = SHARD_TEXTS) -> DataFrame:
    """(doc_id, text_key, spans): per text the half-open word spans, sorted and
    disjoint, covered by windows that also start in a document with a smaller id.
    docs has doc_id bigint, text_key and text. Shards of more than shard_texts
    texts take the window path. What the steps write on the way is deleted."""
    made: list[DataFrame] = []

    def written(df: DataFrame) -> DataFrame:
        made.append(materialise(df))
        return made[-1]

    keys = written(_keys(docs, length, gram))
    contents = written(
        keys.groupBy("gram", "content").agg(
            F.min("doc_id").alias("owner"),
            F.max("doc_id").alias("last"),
            F.min(F.struct("doc_id", "text_key", "first", "n")).alias("rep"),
        )
    )
    grams = written(
        contents.groupBy("gram")
        .agg(F.min("owner").alias("least"), F.max("last").alias("most"), F.count(F.lit(1)).alias("texts"))
        .where("least < most")
    )
    shared = written(contents.join(grams, "gram"))
    alone = shared.where("texts = 1").select(
        "gram", "content",
        F.array(F.struct(F.lit(0).alias("at"), F.col("rep.n").alias("n"), F.col("owner"))).cast(_RUNS).alias("runs"),
    )
    wanted = shared.where("texts > 1").select(
        "gram", "content", "owner", (F.col("texts") > shard_texts).alias("hot"), "rep.doc_id", "rep.text_key", "rep.first", "rep.n"
    )
    texts = written(_cut_out(docs, written(_per_text(wanted)), length))
    windows = written(_windows(texts.where("hot"), length))
    first = written(_first_owners(windows))
    owners = alone.union(_by_automaton(texts.where("not hot"), length)).union(_by_window(texts.where("hot"), windows, first, length))
    late = F.filter("runs", lambda r: r["owner"] < F.col("doc_id"))
    found = materialise(
        keys.join(owners, ["gram", "content"])
        .where(F.size(late) > 0)
        .select(
            "doc_id", "text_key",
            F.explode(
                F.transform(
                    late,
                    lambda r: F.struct(
                        (F.col("first") + r["at"]).alias("lo"), (F.col("first") + r["at"] + r["n"] + length - 1).alias("hi")
                    ),
                )
            ).alias("span"),
        )
        .groupBy("doc_id", "text_key")
        .agg(F.array_sort(F.collect_set("span")).alias("spans"))
    )
    for old in made:
        forget(old)
    return found


def deduplicate(
    docs: DataFrame, length: int = 50, gram: int = GRAM, shard_texts: int = SHARD_TEXTS, carry: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """The columns in carry, then n_words, n_removed, spans (half-open, of words)
    and kept_text, the kept words joined by one space; one row per row of docs.

    Words are maximal runs without ASCII white space, unchanged, over the whole
    text. Null text: no words. Null doc_id: the row keeps all its words and
    removes none elsewhere. A very long text is treated whole, its windows a block at
    a time. Of several owners of a window the smallest doc_id counts. Rows that repeat a doc_id never remove from each
    other, as none is smaller. An empty table gives an empty result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    gram = min(gram, length)
    rows = docs.select(
        F.struct(*carry).alias("carried"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    ).withColumn("text_key", F.xxhash64("text"))
    able = rows.where("doc_id is not null and text is not null").select("doc_id", "text_key", "text")
    found = removals(able, length, gram, shard_texts)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, cuts in zip(batch.column(1).cast(pa.binary()), batch.column(2)):
                words = (text.as_py() or b"").split()
                kept, at, spans = [], 0, []
                for span in cuts.as_py() or ():
                    low, high = max(at, span["lo"]), max(at, span["hi"])
                    kept += words[at:low]
                    if spans and spans[-1]["hi"] == low:
                        spans[-1]["hi"] = high
                    elif high > low:
                        spans.append({"lo": low, "hi": high})
                    at = high
                kept += words[at:]
                out.append((len(words), len(words) - len(kept), spans, b" ".join(kept).decode("utf-8", "replace")))
            span = pa.struct([("lo", pa.int32()), ("hi", pa.int32())])
            types = [pa.int64(), pa.int64(), pa.list_(span), pa.string()]
            columns = zip(*out) if out else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(c, t) for c, t in zip(columns, types)],
                ["carried", "n_words", "n_removed", "spans", "kept_text"],
            )

    kind = rows.schema["carried"].dataType.simpleString()
    flagged = passes(rows, hash_filter(found, _key()), _key())
    whole = flagged.where("not _may").select("carried", "text", F.lit(None).cast(found.schema["spans"].dataType).alias("spans"))
    some = flagged.where("_may").join(found, ["doc_id", "text_key"], "left").select("carried", "text", "spans")
    return (
        whole.union(some)
        .mapInArrow(
            keep,
            f"carried {kind}, n_words bigint, n_removed bigint, spans array<struct<lo:int,hi:int>>, kept_text string",
        )
        .select("carried.*", "n_words", "n_removed", "spans", "kept_text")
    )
