"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into so few segments that, of two fingerprints within the
wanted distance, one segment differs by at most one bit. Every segment is
indexed once per bit with that bit masked out, the variants meet in an equality
join, and the full distance is verified.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quarry.llm._shared import connected_components, hash_filter, materialise, only, passes, prepare

#: Shingles hashed at a time, so that a very long text needs bounded memory.
_STEP = 1 << 15


def simhash(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text, A-Z lower-cased, over word shingles.

    A bit is 1 if it is set in over half of the shingles' XXH64 (seed 42).
    Fewer words than a shingle: the whole sequence is one; no words: 0.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), _STEP):
        hashes = np.array(
            [digest(joined[s:e], 42) for s, e in zip(starts[at : at + _STEP], ends[at : at + _STEP])], dtype="<u8"
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per row of docs, fp as a signed 64-bit number. Null text: 0."""
    prepare(docs.sparkSession)

    @F.pandas_udf(LongType())
    def hashed(texts: pd.Series) -> pd.Series:
        only("simhash", int)
        found = np.array([simhash(t, shingle) for t in texts], dtype=np.uint64)
        return pd.Series(found.view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), hashed(F.col(text_col)).alias("fp"))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def linked(classes: DataFrame, max_distance: int = 2, bucket_limit: int = 64) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) that connect exactly
    the fingerprints linked by chains of steps of max_distance (0 to 2) bits.

    A variant's bucket of up to bucket_limit fingerprints is compared pair by
    pair. Fingerprints in a larger bucket are linked through their one-bit
    neighbourhoods instead: two fingerprints are within two bits exactly if some
    point is within one bit of both, such a point has 65 fingerprints around it
    at most, and a star over them replaces their pairs. So the work is linear in
    the fingerprints, however many share a variant.
    """
    if max_distance not in (0, 1, 2):
        raise ValueError("max_distance must be 0, 1 or 2")
    if max_distance == 0:
        return classes.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    segments = (max_distance + 2) // 2
    width = 64 // segments
    masks = []
    for bit in range(64):
        low = min(bit // width, segments - 1) * width
        high = 64 if low + 2 * width > 64 else low + width
        masks.append(F.lit(_signed((((1 << high) - 1) ^ ((1 << low) - 1)) & ~(1 << bit))))
    variants = classes.select("fp", F.posexplode(F.array(*masks)).alias("bit", "mask")).select(
        "fp", F.col("bit").cast("byte").alias("bit"), F.col("fp").bitwiseAND(F.col("mask")).alias("rest")
    )
    key = ["bit", "rest"]
    # written first, so a filter of bounded size keeps the variants that nothing shares
    # out of the join, which is of two plain shuffles, so a hot variant can be split
    shared = materialise(variants.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    hashed = F.xxhash64(*key)
    met = materialise(passes(variants, hash_filter(shared, hashed), hashed).where("_may").drop("_may").join(shared, key))
    members = met.where(F.col("n") <= bucket_limit).groupBy(*key).agg(F.collect_list("fp").alias("fps"))
    near = (
        members.select("fps", F.explode("fps").alias("u"))
        .select(
            "u",
            F.explode(
                F.filter(
                    "fps", lambda x: (x > F.col("u")) & (F.bit_count(x.bitwiseXOR(F.col("u"))) <= max_distance)
                )
            ).alias("v"),
        )
        .distinct()
    )
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << bit))) for bit in range(64)])
    around = (
        met.where(F.col("n") > bucket_limit).select("fp").distinct()
        .select("fp", F.explode(flips).alias("centre"))
        .groupBy("centre").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    )
    if max_distance == 2:
        hub = F.array_min("fps")
    else:
        around, hub = around.where(F.array_contains("fps", F.col("centre"))), F.col("centre")
    stars = around.select(hub.alias("u"), F.explode("fps").alias("v")).where("u != v").distinct()
    return near.union(stars)


def near_duplicates(
    docs: DataFrame,
    shingle: int = 3,
    max_distance: int = 2,
    bucket_limit: int = 64,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of docs.

    component_id is the smallest doc_id reachable over links, itself included.
    Equal fingerprints count as one class with its smallest doc_id, so groups of
    copies of any size cost one class; classes are compared, never copies.

    Null, empty or blank text: fingerprint zero, linked like any other. A very long
    text is hashed whole, its shingles a block at a time. Ties (several rows of the
    smallest doc_id) name the same component. Null doc_id: the
    row is kept and takes its class's component, but names none (component_id is
    null if no row of the component has a doc_id). Repeated rows each give a row.
    An empty table gives an empty result; other columns are ignored.
    """
    found = materialise(fingerprints(docs, shingle, id_col, text_col))
    classes = materialise(found.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = connected_components(linked(classes, max_distance, bucket_limit))
    rooted = materialise(
        classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    )
    least = materialise(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    of_class = rooted.join(least, "root").select("fp", "component_id")
    return found.join(of_class, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
