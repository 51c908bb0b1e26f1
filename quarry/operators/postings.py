"""A postings index for keyword search: blocks of postings with their maxima, stored by
term, so that a query reads the blocks of its own terms and none of the texts.

Documents are dealt into slices of about SLICE_DOCS by a hash of their id; a block holds
the postings of one term, field and slice, and the largest share of a score that any of
them can give. A query first reads the maxima of its terms' blocks alone, which bound
the best score of every slice. The slices of the highest bounds are scored; the k-th best
score found there is a threshold, and of the others only the slices whose bound reaches it
are scored too. No document outside can be among the k best, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.search import K1, B, ranked, top
from quarry.session import materialise

#: Documents of a slice, aimed at; folders of terms.
SLICE_DOCS, BUCKETS = 64, 64
#: Slices that a task builds.
TASK_SLICES = 32


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _share(tf: Column, n: Column, average: Column) -> Column:
    """What a term gives to a score, but for its rarity and the field's boost."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / average))


def build(docs: DataFrame, id_col: str, fields: dict[str, Column], path: str, analyser: Callable[[Column], Column] = T.tokens) -> None:
    """Write the index of the fields of docs under path.

    A null or empty field has no words; words repeat. Rows that share an id are documents
    of their own in the statistics, and their postings add up under that id. A null id is
    an id like any other. A very long text has one posting for each of its terms.
    """
    spark = docs.sparkSession
    raw = docs.select(F.col(id_col).alias("doc_id"), *[value.alias(name) for name, value in fields.items()])
    sizes = raw.select(*[F.size(analyser(F.col(name))).alias(name) for name in fields])
    stats = sizes.agg(F.count(F.lit(1)).alias("total"), *[F.avg(name).alias(name) for name in fields]).first()
    kind = raw.schema["doc_id"].dataType.simpleString()
    rows = [(name, int(stats["total"]), float(stats[name] or 0.0), kind) for name in fields]
    spark.createDataFrame(rows, "field string, total long, average double, kind string").write.parquet(f"{path}/fields")
    slices = max(1, -(-int(stats["total"]) // SLICE_DOCS))
    # the texts are dealt out by slice, once; a task then has all postings of its slices, and
    # both counts below follow without a shuffle of words
    tasks = max(spark.sparkContext.defaultParallelism, -(-slices // TASK_SLICES))
    dealt = raw.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(slices))).repartition(tasks, "slice")
    each = F.array(*[F.struct(F.lit(name).alias("field"), analyser(F.col(name)).alias("words")) for name in fields])
    listed = dealt.select("slice", "doc_id", F.inline(each)).select("slice", "doc_id", "field", F.size("words").alias("n"), F.explode("words").alias("term"))
    counted = listed.groupBy("slice", "term", "field", "doc_id", "n").agg(F.count(F.lit(1)).alias("tf"))
    gathered = counted.groupBy("slice", "term", "field").agg(F.sort_array(F.collect_list(F.struct("doc_id", "tf", "n"))).alias("postings"))
    # sorted by term, so that a file's row groups are skipped by their smallest and largest
    # term; a term of very many blocks lies in several files. What follows from the postings
    # is not shuffled with them
    ranged = gathered.repartitionByRange(_bucket(F.col("term")), "term", "field", "slice")
    average = reduce(lambda c, r: F.when(F.col("field") == r[0], r[2]).otherwise(c), rows, F.lit(0.0))
    most = F.array_max(F.transform("postings", lambda p: _share(p["tf"], p["n"], average)))
    ready = ranged.select("term", "field", "slice", most.alias("most"), F.size("postings").cast("bigint").alias("df"), "postings", _bucket(F.col("term")).alias("bucket"))
    ready.sortWithinPartitions("bucket", "term", "field", "slice").write.partitionBy("bucket").parquet(f"{path}/blocks")


def blocks_of(spark: SparkSession, path: str, terms: Sequence[str]) -> DataFrame:
    """The blocks of the terms: folders and row groups of other terms are not read."""
    buckets = [r["b"] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(_bucket(F.col("t")).alias("b")).distinct().collect()]
    kind = spark.read.parquet(f"{path}/fields").first()["kind"]
    shape = f"term string, field string, slice bigint, most double, df bigint, postings array<struct<doc_id:{kind},tf:bigint,n:int>>, bucket int"
    return spark.read.schema(shape).parquet(f"{path}/blocks").where(F.col("bucket").isin(sorted(buckets)) & F.col("term").isin(list(terms)))


def search(
    spark: SparkSession, path: str, terms: Sequence[str], boosts: dict[str, float], k: int | None, restrict: DataFrame | None = None
) -> DataFrame:
    """(doc_id, score) of the k best documents with any of the terms, or of all with
    k=None: the best field's BM25 score times its boost, to six decimals, ties by
    doc_id. restrict(doc_id) limits the documents scored, not the statistics."""
    terms = list(dict.fromkeys(terms))
    if not terms:
        raise ValueError("a search needs a term")
    blocks = blocks_of(spark, path, terms).where(F.col("field").isin(list(boosts)))
    fields = spark.read.parquet(f"{path}/fields").where(F.col("field").isin(list(boosts)))
    boost = reduce(lambda c, item: F.when(F.col("field") == item[0], item[1]).otherwise(c), boosts.items(), F.lit(0.0))
    # a row for each term and field, few and known before the search
    found = blocks.groupBy("term", "field").agg(F.sum("df").alias("df")).join(F.broadcast(fields), "field")
    rare = F.log(1 + (F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * boost
    weights = [(r["term"], r["field"], r["weight"], r["average"]) for r in found.select("term", "field", "average", rare.alias("weight")).collect()]
    weight, average = F.lit(0.0), F.lit(1.0)
    for term, field, value, mean in weights:
        here = (F.col("term") == term) & (F.col("field") == field)
        weight, average = F.when(here, value).otherwise(weight), F.when(here, mean).otherwise(average)

    def scored(some: DataFrame) -> DataFrame:
        posting = some.select("term", "field", F.inline("postings"))
        if restrict is not None:
            posting = posting.join(restrict.select("doc_id").distinct(), "doc_id", "left_semi")
        one = posting.withColumn("s", weight * _share(F.col("tf"), F.col("n"), average)).groupBy("doc_id", "field").agg(F.sum("s").alias("s"))
        return one.groupBy("doc_id").agg(F.round(F.max("s"), 6).alias("score")).where("score > 0")

    if k is None or restrict is not None:
        return scored(blocks) if k is None else top(scored(blocks), k)
    sums = blocks.select("slice", "field", (weight * F.col("most")).alias("most")).groupBy("slice", "field").agg(F.sum("most").alias("bound"))
    bounds = materialise(sums.groupBy("slice").agg(F.max("bound").alias("bound")))
    first = materialise(bounds.orderBy(F.desc("bound"), "slice").limit(k))
    best = materialise(top(scored(blocks.join(F.broadcast(first.select("slice")), "slice", "left_semi")), k))
    reached = best.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
    least = reached["least"] - 2e-6 if reached["n"] == k else 0.0
    rest = bounds.where(F.col("bound") >= least).join(first.select("slice"), "slice", "left_anti").select("slice")
    return top(best.union(scored(blocks.join(rest, "slice", "left_semi"))), k)


def ranked_search(spark: SparkSession, path: str, terms: Sequence[str], boosts: dict[str, float], k: int) -> DataFrame:
    """(doc_id, score, rank) of search()."""
    return ranked(search(spark, path, terms, boosts, k), k)
