"""What several operators of this subpackage need: table loading, materialised
intermediate tables, code shipping and connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.session import ship_code

#: Bytes of one Arrow batch sent to a Python worker, where the session sets none.
BATCH_BYTES = 2 << 20
#: Rows of one Arrow batch: texts can be long.
BATCH_ROWS = 1000

_own_root: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Make this package importable on every executor and keep Arrow batches small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ship_code(spark)


_kept: dict[str, Callable[[], object]] = {}


def only(name: str, forget_all: Callable[[], object]) -> None:
    """In a worker process: free what other operators keep there, such as tables of
    words, since a process outlives a query's stages. forget_all frees what the
    caller keeps. What is freed goes back to the system."""
    others = [n for n in _kept if n != name]
    for other in others:
        _kept.pop(other)()
    _kept[name] = forget_all
    if others:
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # absent outside glibc
        if trim:
            trim(0)


def shared_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="quarry-"))
        atexit.register(shutil.rmtree, _own_root[0], ignore_errors=True)
    return f"file://{_own_root[0]}"


def new_path(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/quarry-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df once to the shared folder and read it again.

    A lost executor then costs no recomputation, and a Python pass used by
    several branches of a plan runs once.
    """
    path = new_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._folder = path
    return written


def forget(df: DataFrame) -> None:
    """Delete the files of a table that materialise() returned and no later plan reads."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df._folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def part_of(at: str) -> Column:
    """The task that wrote a row of in_order(), from its _at."""
    return F.shiftright(at, 33)


def in_order(rows: DataFrame, *order: Column) -> DataFrame:
    """rows, written in the order given, with _at, which ascends in it: dealt out by
    ranges, sorted within each, numbered by task and place."""
    return materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))


def stretches(placed: DataFrame, group: list[str], measure: Column | None = None) -> DataFrame:
    """One row for each group (the leading columns of the order; none: all rows) and
    task of in_order(): part, the group, first (the lowest _at there), before (the sum
    of measure in earlier tasks; default: the rows), total (the group's sum) and
    first_of_all (the group's lowest _at). No window holds more rows than there are tasks."""
    measure = F.lit(1) if measure is None else measure
    here = placed.groupBy(part_of("_at").alias("part"), *group).agg(F.min("_at").alias("first"), F.sum(measure).cast("bigint").alias("_here"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return here.select(
        "part", *group, "first", F.coalesce(F.sum("_here").over(earlier), F.lit(0)).alias("before"),
        F.sum("_here").over(whole).alias("total"), F.min("first").over(whole).alias("first_of_all"),
    )


#: Bits of a filter of hashes (8 MB), which keeps rows without a partner out of a shuffle.
FILTER_BITS = 1 << 26


def hash_filter(keys: DataFrame, hashed: Column) -> DataFrame:
    """(_part, _bits): a bitmap of bounded size over the hashes of keys, to broadcast."""
    bit = (F.pmod(hashed, F.lit(FILTER_BITS)) + 1).alias("bit")
    return keys.select(bit).groupBy(F.bitmap_bucket_number("bit").alias("_part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("_bits")
    )


def passes(rows: DataFrame, sieve: DataFrame, hashed: Column) -> DataFrame:
    """rows with _may: false where no key of hash_filter() has the row's hash."""
    bit = F.pmod(hashed, F.lit(FILTER_BITS)) + 1
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("_bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    joined = rows.withColumn("_part", F.bitmap_bucket_number(bit)).join(F.broadcast(sieve), "_part", "left")
    return joined.withColumn("_may", held).drop("_part", "_bits")


def anti_join(rows: DataFrame, gone: DataFrame, on: Column, row_hash: Column, gone_hash: Column) -> DataFrame:
    """rows without partner in gone, a written table. Only rows that pass a filter of
    gone's hashes are shuffled, so most stay where they are if few go."""
    flagged = passes(rows, hash_filter(gone, gone_hash), row_hash)
    rest = flagged.where("_may").drop("_may").join(gone, on, "left_anti")
    return flagged.where("not _may").drop("_may").union(rest)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v); root is the
    smallest node reachable. Nulls and self-loops are ignored; without edges the
    result is empty.

    Alternating large-star and small-star rounds: each is two joins on the node
    and a partial aggregation, the state is one edge per node at most after the
    first rounds, and the number of rounds grows with the logarithm of the
    component's size. Every step is written to the shared folder, so each join
    reads two plain shuffles and adaptive execution may split a node with very
    many neighbours.
    """
    u, v = F.col("u"), F.col("v")
    state = materialise(
        edges.where(u != v).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    mark = _fingerprint(state)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = state.union(state.select(v.alias("u"), u.alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = materialise(both.join(least, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct())
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (
            large.join(low, "u").where(v > F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        later = materialise(small)
        now = _fingerprint(later)
        for old in (state, least, large, low):
            forget(old)
        state = later
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("connected components did not settle")
    return state.select(u.alias("node"), v.alias("root")).union(state.select(v, v).distinct())


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))
    ).first()
    return tuple(row)
