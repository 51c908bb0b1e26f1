"""Near-duplicates by the Jaccard similarity of word shingles.

Min-hash bands propose which texts to compare; the comparison itself is exact.
Texts that share a band form groups, and inside a group an all-pairs join with
prefix filtering finds every pair that reaches the threshold.

No task holds more than a bounded number of texts. A larger group is first linked
along the hubs of its bands, which joins near copies in linear work; then blocks of
its texts are compared with one another, but not blocks that are of one component
already.
"""

from __future__ import annotations

import math
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from quarry.llm._shared import connected_components, forget, hash_filter, materialise, only, passes, prepare

#: Min-hashes of a band, and bands. A pair of similarity 0.8 shares none of the
#: bands with probability (1 - 0.8 ** 6) ** 75, about 1.2e-10.
ROWS, BANDS = 6, 75
#: Texts that one task compares at most: those of a group, or of two blocks of a larger one.
GROUP_TEXTS = 4096
#: Shingles hashed at a time, and texts compared at a time.
_STEP, _BATCH = 512, 256
_FACTORS = np.random.default_rng(42).integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32) | np.uint32(1)


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct XXH64 of a text's word shingles, A-Z lower-cased. Fewer
    words than a shingle: the whole sequence is one; no words: none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, k = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(
        np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts, ends[k - 1 :].tolist())), np.uint64, len(starts))
    )


def buckets(found: np.ndarray) -> np.ndarray:
    """One signed 64-bit bucket per band of the min-hashes of shingles()."""
    if not found.size:
        return np.zeros(0, dtype=np.int64)
    low, high = found.astype(np.uint32), (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(_FACTORS.size, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, found.size, _STEP):
        mixed = np.multiply.outer(_FACTORS, low[at : at + _STEP])
        mixed ^= high[at : at + _STEP]
        np.minimum(least, mixed.min(axis=1), out=least)
    bands = least.reshape(BANDS, ROWS)
    hashes = [xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(bands)]
    return np.array(hashes, dtype=np.uint64).view(np.int64)


def similar_groups(sets: list[np.ndarray], threshold: float, known: list | None = None) -> np.ndarray:
    """For each set the place of a representative of its component, linked at a
    Jaccard similarity of threshold or more; sets of equal known labels are linked
    from the start.

    Elements are ordered rare first. Two sets that reach the threshold share an
    element among the first n - ceil(threshold * n) + 1 of each, so only those
    are indexed. Pairs already in one component are not compared.
    """
    sizes = np.array([s.size for s in sets], dtype=np.int64)
    label = np.arange(len(sets))
    if not sizes.sum():
        return label
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(counts.size, dtype=np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(counts.size)
    single = int((counts == 1).sum())
    rows = [np.sort(r) for r in np.split(rank[inverse], np.cumsum(sizes)[:-1])]
    if known is not None:
        first: dict = {}
        label = np.array([first.setdefault(name, k) for k, name in enumerate(known)])
    members: dict[int, list[int]] = {}
    for k, of in enumerate(label.tolist()):
        members.setdefault(of, []).append(k)
    index: defaultdict[int, array] = defaultdict(lambda: array("q"))
    marked, seen = np.zeros(counts.size, dtype=bool), np.zeros(len(sets), dtype=bool)
    for x, row in enumerate(rows):
        prefix = row[: row.size - math.ceil(threshold * row.size - 1e-9) + 1]
        prefix = prefix[prefix >= single].tolist()
        lists = [np.array(index[t]) for t in prefix if t in index]
        if lists:
            seen[:] = False
            seen[np.concatenate(lists)] = True
            near = np.flatnonzero(seen)
            least, most = np.minimum(sizes[near], row.size), np.maximum(sizes[near], row.size)
            near = near[least / most >= threshold]
            marked[row] = True
            while near.size:
                some, near = near[:_BATCH], near[_BATCH:]
                starts = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
                common = np.add.reduceat(marked[np.concatenate([rows[k] for k in some])], starts, dtype=np.int64)
                for k in some[common / (sizes[some] + row.size - common) >= threshold]:
                    a, b = int(label[x]), int(label[k])
                    if a != b:
                        a, b = (a, b) if len(members[a]) >= len(members[b]) else (b, a)
                        label[members[b]] = a
                        members[a] += members.pop(b)
                near = near[label[near] != label[x]]
            marked[row] = False
        for t in prefix:
            index[t].append(x)
    return label


def _large_groups(members: DataFrame, edges: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """(class, linked) for groups of any size, in tasks of bounded size: members
    (root, class, text), edges (u, v) from the hub of each band to its texts, both
    written tables."""
    half = max(1, GROUP_TEXTS // 2)
    made: list[DataFrame] = []

    def written(df: DataFrame) -> DataFrame:
        made.append(materialise(df))
        return made[-1]

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("shingles", int)
        hub, mine = None, None
        for batch in batches:
            keep = []
            for u, a, b in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if u != hub:
                    hub, mine = u, shingles(a.as_py(), shingle)
                theirs = shingles(b.as_py(), shingle)
                common = np.intersect1d(mine, theirs, assume_unique=True).size
                keep.append(common >= threshold * (mine.size + theirs.size - common) - 1e-9 and common > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    hubs = members.select(F.col("class").alias("u"), F.col("text").alias("hub_text"))
    ends = members.select(F.col("class").alias("v"), "text")
    pairs = edges.join(ends, "v").join(hubs, "u").select("u", "v", "hub_text", "text")
    near = written(pairs.mapInArrow(similar, "u bigint, v bigint"))
    of_hub = connected_components(near).withColumnRenamed("node", "class").withColumnRenamed("root", "label")
    labelled = written(members.join(of_hub, "class", "left").withColumn("label", F.coalesce("label", "class")))
    sizes = labelled.groupBy("root", "label").agg(F.count(F.lit(1)).alias("n"))
    many = written(sizes.where(F.col("n") >= half).select("root", "label", F.ceil(F.col("n") / half).alias("parts")))
    few = written(
        sizes.where(F.col("n") < half).groupBy("root").agg(F.ceil(F.sum("n") / half).alias("pools"))
    )
    # components of many texts have blocks of their own; the others share blocks
    placed = labelled.join(many, ["root", "label"], "left").join(few, "root", "left")
    own = F.struct(F.col("label").alias("of"), F.pmod(F.xxhash64("class"), "parts").alias("nth"))
    pool = F.struct(F.lit(None).cast("bigint").alias("of"), F.pmod(F.xxhash64("label"), "pools").alias("nth"))
    texts = written(placed.select("root", "class", "label", "text", F.when(F.col("parts").isNotNull(), own).otherwise(pool).alias("block")))
    blocks = written(texts.select("root", "block").distinct())
    a, b = blocks.select("root", F.col("block").alias("a")), blocks.select("root", F.col("block").alias("b"))
    alike = F.col("a.of").isNotNull() & F.col("a.of").eqNullSafe(F.col("b.of"))
    tasks = written(a.join(b, "root").where((F.col("a") <= F.col("b")) & ~alike))
    side = lambda c: tasks.select("root", F.col(c).alias("block"), "a", "b").join(texts, ["root", "block"])
    both = side("a").union(side("b").where("a != b")).select("root", "a", "b", "class", "label", "text")

    def compare(group: pa.Table) -> pa.Table:
        only("shingles", int)
        sets = [shingles(t.as_py(), shingle) for t in group.column("text")]
        classes = group.column("class").to_numpy()
        found = classes[similar_groups(sets, threshold, group.column("label").to_pylist())]
        moved = found != classes
        return pa.table({"u": classes[moved], "v": found[moved]})

    more = both.groupBy("root", "a", "b").applyInArrow(compare, "u bigint, v bigint")
    links = connected_components(near.union(more))
    found = materialise(
        members.select("class").join(links.withColumnRenamed("node", "class"), "class", "left").select("class", F.coalesce("root", "class").alias("linked"))
    )
    for old in made:
        forget(old)
    return found


def near_duplicates(
    docs: DataFrame, shingle: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
    labels: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, copy, component_id, kept), one row per row of docs; copy is the
    text's xxhash64, and kept holds for the row of the smallest (doc_id, copy) of
    each component, null ids last (and for each repetition of that row).

    component_id is the smallest doc_id reachable over pairs of texts whose sets
    of word shingles have a Jaccard similarity of threshold or more. Texts with
    equal sets are one class and count once, however many there are. Every pair
    that shares a band is compared exactly, and so are all others of its group;
    a pair at 0.8 shares no band with probability 1.2e-10, less above.

    labels (copy, label), one row per text at least, adds links of another method:
    texts of one label are linked too, and chains run over links of both kinds.

    Null or empty text: the empty set, one class. Null doc_id: the row takes its
    class's component, but names none (component_id is null if no row of the
    component has a doc_id). Repeated rows each give a row. An empty table gives
    an empty result; other columns are ignored. A task holds the texts of a group
    of at most GROUP_TEXTS, or of as many of a larger group, with their hashes (8
    bytes a word).
    """
    prepare(docs.sparkSession)
    kind = StructType([StructField("class", LongType()), StructField("buckets", ArrayType(LongType()))])

    @F.pandas_udf(kind)
    def signed(texts: pd.Series) -> pd.DataFrame:
        only("shingles", int)
        sets = [shingles(t, shingle) for t in texts]
        classes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
        return pd.DataFrame({"class": classes, "buckets": [buckets(s) for s in sets]})

    def compare(group: pa.Table) -> pa.Table:
        only("shingles", int)
        sets = [shingles(t.as_py(), shingle) for t in group.column("text")]
        classes = group.column("class").to_numpy()
        return pa.table({"class": classes, "linked": classes[similar_groups(sets, threshold)]})

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("copy"))
    rows = materialise(texts.select("doc_id", "copy", signed("text").alias("s")).select("doc_id", "copy", "s.*"))
    classes = rows.groupBy("class").agg(F.min("copy").alias("copy"), F.any_value("buckets").alias("buckets"))
    held = classes.select("class", F.explode("buckets").alias("bucket"))
    # written tables on both sides, so a band that very many texts share can be split
    hubs = materialise(held.groupBy("bucket").agg(F.min("class").alias("u"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    edges = materialise(held.join(hubs, "bucket").where("u != class").select("u", F.col("class").alias("v")).distinct())
    groups = materialise(connected_components(edges).withColumnRenamed("node", "class"))
    large = materialise(groups.groupBy("root").count().where(F.col("count") > GROUP_TEXTS).select("root", F.lit(True).alias("large")))
    of_class = rows.groupBy("class").agg(F.min("copy").alias("copy"))
    wanted = materialise(groups.join(of_class, "class").join(large, "root", "left"))
    # only texts of groups are shuffled: a filter of bounded size passes few others
    sieve = hash_filter(wanted, F.col("copy"))
    some = passes(texts.select("copy", "text"), sieve, F.col("copy")).where("_may").join(wanted.select("copy"), "copy", "left_semi")
    members = wanted.join(some.groupBy("copy").agg(F.any_value("text").alias("text")), "copy").select("root", "class", "text", "large")
    if large.isEmpty():
        links = materialise(members.drop("large").groupBy("root").applyInArrow(compare, "class long, linked long"))
    else:
        members = materialise(members)
        few = members.where("large is null").drop("large").groupBy("root").applyInArrow(compare, "class long, linked long")
        many = members.where("large").drop("large")
        of_many = edges.join(many.select(F.col("class").alias("v")), "v", "left_semi")
        links = materialise(few.union(_large_groups(many, materialise(of_many), shingle, threshold)))
    joined = materialise(
        rows.select("doc_id", "copy", "class").join(links, "class", "left").select(
            "doc_id", "copy", F.coalesce("linked", "class").alias("linked")
        )
    )
    if labels is not None:
        # a star over the components that share a label
        met = materialise(joined.select("copy", "linked").distinct().join(labels, "copy").select("label", "linked").distinct())
        hub = met.groupBy("label").agg(F.min("linked").alias("u"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        both = connected_components(met.join(hub, "label").select("u", F.col("linked").alias("v"))).withColumnRenamed("node", "linked")
        alone, joined = joined, materialise(
            joined.join(both, "linked", "left").select("doc_id", "copy", F.coalesce("root", "linked").alias("linked"))
        )
        forget(alone)
        forget(met)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "copy")
    least = materialise(joined.groupBy("linked").agg(F.min("doc_id").alias("component_id"), F.min(order).alias("first")))
    found = materialise(
        joined.join(least, "linked").select("doc_id", "copy", "component_id", order.eqNullSafe(F.col("first")).alias("kept"))
    )
    for table in (rows, hubs, edges, groups, large, wanted, links, joined, least):
        forget(table)
    return found
