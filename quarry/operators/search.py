"""Keyword and vector ranking, fusion, facets and score statistics.

BM25 here is score = sum over terms of idf * tf * (k1 + 1) / (tf + k1 * (1 - b +
b * length / average)), idf = ln(1 + (n - df + 0.5) / (df + 0.5)). A query has
few terms, so their frequencies are counted inside each row and kept, a few numbers
a document: one pass over the texts, and no shuffle of postings.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from quarry.functions import text as T
from quarry.session import materialise

K1, B, RRF_K, TOP = 1.2, 0.75, 60, 200


def _equals(term: str):
    return lambda word: word == term


def bm25(
    docs: DataFrame, id_col: str, fields: dict[str, tuple[Column, float]], terms: Sequence[str], restrict: DataFrame | None = None,
    analyser: Callable[[Column], Column] = T.tokens,
) -> DataFrame:
    """(doc_id, score) of documents with any term; score is the best field's,
    times its boost, to six decimals. restrict(doc_id) limits the documents
    scored, not the statistics. analyser turns a field into its words; terms are
    words as it gives them."""
    columns = [F.col("doc_id")]
    tokenised = docs.select(F.col(id_col).alias("doc_id"), *[analyser(value).alias(f"{name}_words") for name, (value, _) in fields.items()])
    for name in fields:
        words = F.col(f"{name}_words")
        columns += [F.size(words).alias(f"{name}_n")]
        columns += [
            F.size(F.filter(words, _equals(term))).alias(f"{name}_{at}") for at, term in enumerate(terms)
        ]
    counted = materialise(tokenised.select(*columns))
    stats = counted.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.avg(f"{name}_n").alias(f"{name}_avg") for name in fields],
        *[F.count_if(F.col(f"{name}_{at}") > 0).alias(f"{name}_{at}_df") for name in fields for at in range(len(terms))],
    )
    scored = counted
    if restrict is not None:
        scored = scored.join(restrict.select("doc_id").distinct(), "doc_id", "left_semi")
    scored = scored.join(F.broadcast(stats))

    def field(name: str, boost: float) -> Column:
        def one(at: int) -> Column:
            tf, df = F.col(f"{name}_{at}"), F.col(f"{name}_{at}_df")
            idf = F.log(1 + (F.col("total") - df + 0.5) / (df + 0.5))
            norm = K1 * (1 - B + B * F.col(f"{name}_n") / F.col(f"{name}_avg"))
            return F.when(tf > 0, idf * tf * (K1 + 1) / (tf + norm)).otherwise(0.0)

        return reduce(lambda a, b: a + b, map(one, range(len(terms)))) * boost

    values = [field(name, boost) for name, (_, boost) in fields.items()]
    best = F.greatest(*values) if len(values) > 1 else values[0]
    return scored.select("doc_id", F.round(best, 6).alias("score")).where("score > 0")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def vector_scores(vectors: DataFrame, query: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(doc_id, score) against the one-row query(query_vector), to six decimals."""
    return vectors.join(F.broadcast(query)).select(
        F.col(id_col).alias("doc_id"), F.round(cosine(F.col(vector_col), F.col("query_vector")), 6).alias("score")
    )


#: Query vectors that go to the tasks at a time; a query block and rows of vectors whose
#: cosines a task holds at a time.
QUERY_BLOCK, _ASKED, _ROWS = 16_384, 256, 4096
#: Scores in millionths: of pairs without a number for a cosine, which rank first as NaN does,
#: and of null vectors, which rank last; a null id.
_NAN, _NONE, _NO_ID = 1 << 40, -(1 << 40), -(1 << 63)


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector in double precision; None for null ones and those that hold nulls."""
    column = column.cast(pa.list_(pa.float64()))
    if column.null_count or column.flatten().null_count:
        return [None if v is None or None in v else np.array(v) for v in column.to_pylist()]
    edges = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))))
    values = column.flatten().to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


def _table(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, lengths, missing): zero and non-finite vectors are zero rows of length NaN;
    missing are null ones and those of another width."""
    found = [v if v is not None and v.size == width else None for v in _vectors(column)]
    missing = np.array([v is None for v in found], dtype=bool)
    rows = np.array([np.zeros(width) if v is None else v for v in found]).reshape(len(found), width)
    with np.errstate(over="ignore", invalid="ignore"):
        squares = (rows * rows).sum(axis=1)
    known = np.isfinite(squares) & (squares > 0)
    return np.where(known[:, None], rows, 0.0), np.where(known, np.sqrt(np.where(known, squares, 1.0)), np.nan), missing


def _by_width(asked: pa.Array) -> list[tuple[np.ndarray, tuple, int]]:
    """(places, _table(), width) of at most _ASKED queries of one width each."""
    widths = np.array([0 if v is None else v.size for v in _vectors(asked)], dtype=np.int64)
    out = []
    for width in np.unique(widths).tolist():
        here = np.flatnonzero(widths == width)
        out += [(at, _table(asked.take(pa.array(at)), width), width) for at in np.array_split(here, -(-here.size // _ASKED))]
    return out


def _millionths(asked: tuple, vectors: tuple) -> np.ndarray:
    """Cosines of all pairs of two _table()s in millionths, rounded half away from zero. Where
    a product of matrices can't tell which way to round, the pair is summed up term by term."""
    (a, a_lengths, a_missing), (b, b_lengths, b_missing) = asked, vectors
    scaled = a @ b.T / a_lengths[:, None] / b_lengths * 1e6
    known = np.isfinite(scaled)
    scaled[~known] = 0.0
    found = np.trunc(scaled + np.copysign(0.5, scaled)).astype(np.int64)
    dot = lambda x, y: sum((x * y).tolist(), 0.0)
    for i, j in zip(*np.nonzero(np.abs(np.abs(scaled - np.trunc(scaled)) - 0.5) < 1e-7)):
        one = dot(a[i], b[j]) / math.sqrt(dot(a[i], a[i]) * dot(b[j], b[j]))
        found[i, j] = int(Decimal(repr(one)).scaleb(6).to_integral_value(ROUND_HALF_UP))
    found[~known] = _NAN
    found[a_missing] = _NONE
    found[:, b_missing] = _NONE
    return found


def _score(millionths: str) -> Column:
    return F.when(F.col(millionths) == _NAN, float("nan")).when(F.col(millionths) != _NONE, F.col(millionths) / F.lit(1e6))


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(column.cast(pa.int64()).fill_null(_NO_ID))


def _queries(queries: DataFrame) -> Iterator[tuple[pa.ChunkedArray, pa.ChunkedArray]]:
    """(q, v) of the queries, about QUERY_BLOCK at a time."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    for block in range(blocks):
        some = queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block) if blocks > 1 else queries
        held = some.select("q", F.col("v").cast("array<double>").alias("v")).toArrow()
        yield held.column(0), held.column(1)


def _few_tasks(vectors: DataFrame) -> DataFrame:
    """vectors in a few tasks a core, as each task gives results for every query."""
    return vectors.coalesce(4 * vectors.sparkSession.sparkContext.defaultParallelism)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", skip_self: bool = False) -> DataFrame:
    """(q, doc_id, score, rank): the k vectors of the highest cosine for each of a stated
    query set (q, v), to six decimals, ties by id (a whole number); skip_self leaves out the
    vector whose id is q, and null ids.

    Every pair is computed, as products of matrices, but a task gives k rows for a query
    and not a row for each pair. Null vectors, those that hold nulls and those of another
    width than the query have a null score and rank last; zero and non-finite ones have NaN
    and rank first.
    """
    spark = vectors.sparkSession
    kind = queries.schema["q"].dataType.simpleString()
    if not isinstance(vectors.schema[id_col].dataType, IntegralType):
        raise ValueError("ids must be whole numbers")
    parts = []
    for names, asked in _queries(queries):
        shared = spark.sparkContext.broadcast((names.combine_chunks(), asked.combine_chunks()))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, asked = shared.value
            own = _ids(names) if skip_self else None
            groups = _by_width(asked)
            # the best so far: ids and scores of each query
            held = [(np.zeros((len(at), 0), np.int64), np.zeros((len(at), 0), np.int64)) for at, *_ in groups]
            for batch in batches:
                for start in range(0, batch.num_rows, _ROWS):
                    some = batch.slice(start, _ROWS)
                    ids, tables = _ids(some.column(0)), {}
                    for g, (at, q, width) in enumerate(groups):
                        if width not in tables:
                            tables[width] = _table(some.column(1), width)
                        found = _millionths(q, tables[width])
                        if skip_self:
                            mine = own[at][:, None]
                            found[(mine == ids) | (mine == _NO_ID) | (ids == _NO_ID)] = 2 * _NONE
                        held[g] = _kept(*held[g], ids, found, k)
            for (at, *_), (ids, found) in zip(groups, held):
                there = found > 2 * _NONE
                row = np.nonzero(there)[0]
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(at[row])), pa.array(ids[there], mask=ids[there] == _NO_ID), pa.array(found[there])], ["q", "doc_id", "millionths"]
                )

        rows = _few_tasks(vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")))
        parts.append(rows.mapInArrow(best, f"q {kind}, doc_id bigint, millionths bigint"))
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("millionths"), "doc_id"))
    ranked_rows = reduce(DataFrame.union, parts).withColumn("rank", nth).where(F.col("rank") <= k)
    return ranked_rows.select("q", F.col("doc_id").cast(vectors.schema[id_col].dataType), _score("millionths").alias("score"), "rank")


def _kept(old_ids: np.ndarray, old: np.ndarray, ids: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, of those held and those found; ties to the smaller id."""
    many = len(found)
    least = old.min(axis=1) if old.shape[1] >= k else np.full(many, 3 * _NONE)
    if found.shape[1] > k:  # no more than the k best of this part, and ties of the last
        least = np.maximum(least, np.partition(found, -k, axis=1)[:, -k])
    row, place = np.nonzero(found >= least[:, None])
    rows = np.concatenate([np.repeat(np.arange(many), old.shape[1]), row])
    every, scores = np.concatenate([old_ids.ravel(), ids[place]]), np.concatenate([old.ravel(), found[row, place]])
    order = np.lexsort((every, -scores, rows))
    rows, every, scores = rows[order], every[order], scores[order]
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
    first = nth < k
    out_ids, out = np.zeros((many, k), np.int64), np.full((many, k), 3 * _NONE, np.int64)
    out_ids[rows[first], nth[first]], out[rows[first], nth[first]] = every[first], scores[first]
    return out_ids, out


def best_of_groups(vectors: DataFrame, queries: DataFrame, group: Column, vector_col: str = "embedding") -> DataFrame:
    """(q, doc_id, score): the highest cosine of the vectors of each group (a whole number)
    for each of a stated query set (q, v), to six decimals, NaN above all numbers and null below
    (see nearest()). Vectors are dealt out by group, so each task gives the rows of its groups once."""
    spark = vectors.sparkSession
    kind = queries.schema["q"].dataType.simpleString()
    tasks = 4 * spark.sparkContext.defaultParallelism
    rows = vectors.select(group.cast("bigint").alias("doc_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.repartition(tasks, "doc_id").sortWithinPartitions("doc_id")
    parts = []
    for names, asked in _queries(queries):
        shared = spark.sparkContext.broadcast((names.combine_chunks(), asked.combine_chunks()))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, asked = shared.value
            groups = _by_width(asked)
            now, most = None, np.zeros(0, np.int64)

            def done() -> pa.RecordBatch:
                group = pa.array(np.full(len(names), now), mask=np.full(len(names), now == _NO_ID))
                return pa.RecordBatch.from_arrays([names, group, pa.array(most)], ["q", "doc_id", "millionths"])

            for batch in batches:
                of = _ids(batch.column(0))
                edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
                for a, b in zip(edges[:-1], edges[1:]):
                    if a == b:
                        continue
                    if of[a] != now:
                        if now is not None:
                            yield done()
                        now, most = of[a], np.full(len(names), _NONE, np.int64)
                    for start in range(a, b, _ROWS):
                        some, tables = batch.column(1).slice(start, min(_ROWS, b - start)), {}
                        for at, q, width in groups:
                            if width not in tables:
                                tables[width] = _table(some, width)
                            most[at] = np.maximum(most[at], _millionths(q, tables[width]).max(axis=1))
            if now is not None:
                yield done()

        parts.append(rows.mapInArrow(best, f"q {kind}, doc_id bigint, millionths bigint"))
    return reduce(DataFrame.union, parts).select("q", "doc_id", _score("millionths").alias("score"))


def top(scores: DataFrame, k: int = TOP) -> DataFrame:
    return scores.orderBy(F.desc("score"), "doc_id").limit(k)


def ranked(scores: DataFrame, k: int = TOP) -> DataFrame:
    """(doc_id, score, rank) of the k best; ties by doc_id. Only k rows meet in one task."""
    nth = F.row_number().over(Window.orderBy(F.desc("score"), "doc_id"))
    return top(scores, k).withColumn("rank", nth)


def fuse(left: DataFrame, right: DataFrame, k: int = RRF_K, best: bool = False) -> DataFrame:
    """(doc_id, rrf): reciprocal rank fusion of two (doc_id, rank); a missing side
    adds nothing. A document with several ranks on one side counts with its worst,
    or with best=True its best."""
    pick = F.min if best else F.max
    sides = [side.groupBy("doc_id").agg(pick("rank").alias("rank")) for side in (left, right)]
    both = sides[0].unionByName(sides[1])
    return both.groupBy("doc_id").agg(F.sum(1 / (F.col("rank") + k)).alias("rrf"))


def max_normalised(scores: DataFrame, column: str, few: bool = False) -> DataFrame:
    """column divided by its maximum; all zero if that is zero. few: the rows are
    those of a ranking and may meet in one task, so they are computed once."""
    if few:
        joined = scores.withColumn("_most", F.max(column).over(Window.partitionBy(F.lit(0))))
    else:
        joined = scores.join(F.broadcast(scores.agg(F.max(column).alias("_most"))))
    return joined.withColumn(
        column, F.when(F.col("_most") == 0, 0.0).otherwise(F.col(column) / F.col("_most"))
    ).drop("_most")


#: Bins of a histogram of a group, and rows of a bin that may meet in one task.
BINS, FEW_ROWS = 2048, 100_000


def at_ranks(rows: DataFrame, keys: Sequence[str], column: str, ranks: DataFrame) -> DataFrame:
    """(keys, rank, value): the values at the ranks (keys, rank; from 0) of each group,
    by selection. A histogram between a group's extremes tells which bin holds a rank,
    and that bin alone is looked at again, until it has few rows or one value. State is
    BINS counts a group, and no task holds a group's values. Null and NaN values have no
    rank; ranks beyond a group give nothing."""
    keys, v = list(keys), F.col("_v")
    values = rows.select(*keys, F.col(column).cast("double").alias("_v")).where(v.isNotNull() & ~F.isnan(v))
    target = [*keys, "rank"]
    ends = values.groupBy(*keys).agg(F.min("_v").alias("low"), F.max("_v").alias("high"), F.count(F.lit(1)).alias("n"))
    joined = ranks.join(ends, keys) if keys else ranks.join(F.broadcast(ends))
    spans = materialise(joined.where((F.col("rank") >= 0) & (F.col("rank") < F.col("n"))).select(*target, "low", "high", "n", F.lit(0).cast("bigint").alias("before")))

    def inside() -> DataFrame:
        some = spans.select(*target, "low", "high", "before")
        met = values.join(some, keys) if keys else values.join(F.broadcast(some))
        return met.where(v.between(F.col("low"), F.col("high")))

    while spans.where((F.col("n") > FEW_ROWS) & (F.col("low") < F.col("high"))).limit(1).count():
        # halves first, so that a span of any width keeps finite
        share = (v / 2 - F.col("low") / 2) / F.greatest(F.col("high") / 2 - F.col("low") / 2, F.lit(5e-324))
        bins = inside().groupBy(*target, "before", F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin")).agg(
            F.min("_v").alias("low"), F.max("_v").alias("high"), F.count(F.lit(1)).alias("n")
        )
        earlier = F.coalesce(F.sum("n").over(Window.partitionBy(*target).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        spans = materialise(
            bins.withColumn("before", F.col("before") + earlier)
            .where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n"))).select(*target, "low", "high", "n", "before")
        )
    counts = inside().groupBy(*target, "before", "_v").agg(F.count(F.lit(1)).alias("c"))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy(*target).orderBy("_v"))
    return counts.withColumn("_upto", upto).where(F.col("_upto") > F.col("rank")).groupBy(*target).agg(F.min("_v").alias("value"))


def _packed(rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """rows with all keys in one column, whose null fields equal each other in a join."""
    return (rows.withColumn("_k", F.struct(*keys)), ["_k"]) if keys else (rows, [])


def quantiles(rows: DataFrame, keys: Sequence[str], column: str, shares: dict[str, float]) -> DataFrame:
    """(keys, one column for each share): percentiles with linear interpolation between
    the two nearest ranks, as exact as at_ranks(). A group without values has nulls."""
    rows, key = _packed(rows, keys)
    value = F.col(column).cast("double")
    groups = materialise(rows.groupBy(*key).agg(F.count_if(value.isNotNull() & ~F.isnan(value)).alias("n")))
    names = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(share).alias("share")) for name, share in shares.items()])).alias("p")
    place = F.col("p.share") * (F.col("n") - 1)
    wanted = groups.where("n > 0").select(*key, "n", names).select(
        *key, F.col("p.name").alias("name"), F.floor(place).alias("lower"), F.ceil(place).alias("upper"), (place - F.floor(place)).alias("part")
    )
    found = materialise(at_ranks(rows, key, column, wanted.select(*key, F.explode(F.array("lower", "upper")).alias("rank")).distinct()))
    low, high = (found.select(*key, F.col("rank").alias(name), F.col("value").alias(f"{name}_value")) for name in ("lower", "upper"))
    both = wanted.join(low, [*key, "lower"]).join(high, [*key, "upper"])
    one = F.col("lower_value") + F.col("part") * (F.col("upper_value") - F.col("lower_value"))
    picked = both.groupBy(*key).agg(*[F.max(F.when(F.col("name") == name, one)).alias(name) for name in shares])
    return groups.select("_k").join(picked, "_k", "left").select("_k.*", *shares) if keys else picked


def score_statistics(scores: DataFrame, by: Sequence[str] = (), column: str = "score") -> DataFrame:
    """Count, extremes, mean, population deviation, median, the 95th percentile at
    the floor index, and the kind of distribution."""
    value = F.col(column)
    scores, keys = _packed(scores, by)
    # equal scores are counted first: groups of any size meet as value counts, never as rows
    counts = scores.where(value.isNotNull()).groupBy(*keys, value.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    v, c = F.col("_v"), F.col("_c")
    found = materialise(counts.groupBy(*keys).agg(
        F.sum(c).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), (F.sum(v * c) / F.sum(c)).alias("mean"),
        F.sqrt(F.greatest(F.sum(v * v * c) / F.sum(c) - F.pow(F.sum(v * c) / F.sum(c), 2), F.lit(0.0))).alias("deviation"),
    ).where("n > 0"))
    middle, last = (F.col("n") - 1) / 2, F.floor(0.95 * (F.col("n") - 1))
    places = found.select(*keys, F.floor(middle).alias("lower"), F.ceil(middle).alias("upper"), last.alias("p95"))
    ranks = places.select(*keys, F.explode(F.array("lower", "upper", "p95")).alias("rank")).distinct()
    named = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(name).alias("rank")) for name in ("lower", "upper", "p95")])).alias("p")
    values = places.select(*keys, named).select(*keys, "p.name", "p.rank").join(at_ranks(scores, keys, column, ranks), [*keys, "rank"])
    picked = values.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in ("lower", "upper", "p95")])
    picked = picked.select(*keys, ((F.col("lower") + F.col("upper")) / 2).alias("median"), "p95")
    whole = found.join(picked, keys) if keys else found.join(F.broadcast(picked))
    named_by = ["_k.*"] if keys else []
    return whole.select(
        *named_by, "n", "low", "high", "mean", "deviation", "median", "p95", distribution(*map(F.col, ("n", "low", "high", "mean", "deviation"))).alias("kind")
    )


def distribution(n: Column, low: Column, high: Column, mean: Column, deviation: Column) -> Column:
    return (
        F.when(n < 3, "insufficient_data").when((low > 0) & (deviation / mean > 1), "log_normal")
        .when((low > 0) & (high > 10 * low), "power_law").otherwise("normal")
    )


def facets(rows: DataFrame, lists: Sequence[str], scalars: Sequence[str]) -> DataFrame:
    """(facet, value, n): counts of the members of array columns and of scalar
    columns, whose nulls count as unknown."""
    parts = [rows.select(F.lit(c).alias("facet"), F.explode(c).alias("value")) for c in lists]
    parts += [rows.select(F.lit(c).alias("facet"), F.coalesce(c, F.lit("unknown")).alias("value")) for c in scalars]
    return reduce(DataFrame.unionByName, parts).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def page(rows: DataFrame, order: Sequence[Column], size: int, number: int) -> DataFrame:
    """One page (from 1) with its envelope."""
    total = rows.agg(F.count(F.lit(1)).alias("total_results"))
    pages = F.ceil(F.col("total_results") / size)
    return (
        rows.orderBy(*order).offset(size * (number - 1)).limit(size).join(F.broadcast(total))
        .withColumn("current_page", F.lit(number)).withColumn("total_pages", pages)
        .withColumn("has_next", F.lit(number) < pages).withColumn("has_previous", F.lit(number > 1))
    )
