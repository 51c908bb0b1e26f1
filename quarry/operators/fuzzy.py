"""Fuzzy terms: a dictionary of distinct terms, met by deletion neighbourhoods.

Two words within k edits become equal when at most k characters are taken out of each, so
candidates come from an equality join of the shortened forms, and the distance is computed
for distinct candidates only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import materialise

#: The shortest words that may differ by one edit, and by two.
ONE_EDIT, TWO_EDITS = 3, 6


def edits(query: Column) -> Column:
    """Edits that a query of this length allows: none, one or two."""
    return F.when(F.length(query) < ONE_EDIT, 0).when(F.length(query) < TWO_EDITS, 1).otherwise(2)


def _shorter(word: Column) -> Column:
    """word without each one of its characters."""
    drop = lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word)))
    return F.when(F.length(word) > 0, F.transform(F.sequence(F.lit(1), F.length(word)), drop)).otherwise(F.array().cast("array<string>"))


def shortened(word: Column, most: Column) -> Column:
    """The distinct forms of word with up to most (0 to 2) characters taken out."""
    one = F.array_distinct(_shorter(word))
    two = F.array_distinct(F.flatten(F.transform(one, _shorter)))
    whole = F.array(word)
    return F.when(most == 0, whole).when(most == 1, F.array_union(whole, one)).otherwise(F.array_union(F.array_union(whole, one), two))


def near_terms(terms: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, term, distance): the distinct terms (term) within the edits that each
    distinct query (query) allows by its length. Nulls match nothing, repeats count once.

    Terms longer or shorter than any query allows are left out first, so a very long
    term makes no forms; a query of n characters makes about n * n / 2 of them.
    A term gives up as many characters as a query of its length or up to two more may
    allow.
    """
    asked = queries.select("query").where("query is not null").distinct().withColumn("k", edits(F.col("query")))
    reach = asked.agg(F.min(F.length("query") - F.col("k")).alias("low"), F.max(F.length("query") + F.col("k")).alias("high"))
    size = F.length("term")
    known = terms.select("term").where("term is not null").distinct()
    known = known.join(F.broadcast(reach), (size >= F.col("low")) & (size <= F.col("high"))).select("term")
    most = F.when(size + 1 < ONE_EDIT, 0).when(size + 2 < TWO_EDITS, 1).otherwise(2)
    forms = known.select("term", F.explode(shortened(F.col("term"), most)).alias("form"))
    mine = asked.select("query", "k", F.explode(shortened(F.col("query"), F.col("k"))).alias("form"))
    pairs = forms.join(mine, "form").where(F.abs(F.length("query") - F.length("term")) <= F.col("k")).select("query", "term", "k").distinct()
    return pairs.withColumn("distance", F.levenshtein("query", "term")).where(F.col("distance") <= F.col("k")).select("query", "term", "distance")


def fuzzy_words(words: DataFrame, queries: DataFrame) -> DataFrame:
    """fuzzy_search without an index: over words (doc_id, term), one row for each time a
    document holds a term. Words that are near no query leave before the shuffle if
    the near terms are few, and with the join otherwise."""
    near = materialise(near_terms(words.select("term"), queries))
    each = words.join(near, "term").groupBy("query", "doc_id", "term", "distance").agg(F.count(F.lit(1)).alias("tf"))
    return _matches(each)


def _matches(each: DataFrame) -> DataFrame:
    return each.groupBy("query", "doc_id").agg(F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("hits"), F.min("distance").alias("nearest"))


def fuzzy_search(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """(query, doc_id, terms, hits, nearest) from the postings index under path: documents
    with a term near a query; how many distinct terms, how often, and the least distance.

    The index's own terms are the dictionary, read as one column; postings leave the
    index only for terms that are near some query. All fields of the index count.
    """
    kind = spark.read.parquet(f"{path}/fields").first()["kind"]
    blocks = spark.read.schema(f"term string, postings array<struct<doc_id:{kind},tf:bigint,n:int>>").parquet(f"{path}/blocks")
    near = near_terms(blocks.select("term"), queries)
    posting = blocks.join(near, "term").select("query", "term", "distance", F.inline("postings"))
    each = posting.groupBy("query", "doc_id", "term").agg(F.sum("tf").alias("tf"), F.min("distance").alias("distance"))
    return _matches(each)
