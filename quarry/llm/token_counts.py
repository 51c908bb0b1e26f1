"""Token counts by an exact length histogram.

Documents are counted by encoded length. Suffix sums over the histogram then
answer, for every context limit at once, how many documents are longer, how many
tokens a truncation keeps, and every quantile.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import tokens
from quarry.llm._shared import materialise, prepare

#: Lengths per block of the two-level suffix sums.
_BLOCK = 128


def token_lengths(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) per row of docs, over the whole text; null text: 0."""
    prepare(docs.sparkSession)
    path = tokenizer or tokens.default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = tokens.encoder(path).encode_all
        for batch in batches:
            texts = (t.as_py() for t in batch.column(1).cast(pa.binary()))
            found = [len(ids) // 4 for ids in encode_all(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        count, f"doc_id {kind}, n_tokens bigint"
    )


def histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs) from a column n_tokens."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def length_table(counts: DataFrame) -> DataFrame:
    """One row per distinct length, which is the answer for a context limit of
    that many tokens: n_docs of exactly that length, docs_longer and
    tokens_longer beyond it, truncated_total tokens kept when every document is
    cut at the limit, and share_within, the documents' quantile at that length.

    The suffix sums run in two levels, over blocks of lengths and inside each
    block, so no task holds the whole histogram.
    """
    rows = materialise(counts.withColumn("block", F.floor(F.col("n_tokens") / _BLOCK)))
    blocks = rows.groupBy("block").agg(
        F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("toks")
    )
    beyond = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    later = blocks.select(
        "block",
        F.coalesce(F.sum("docs").over(beyond), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("toks").over(beyond), F.lit(0)).alias("toks_after"),
    )
    totals = blocks.agg(F.sum("docs").alias("all_docs"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("n_tokens")
    return (
        rows.join(F.broadcast(later), "block")
        .join(F.broadcast(totals))
        .select(
            "n_tokens",
            "n_docs",
            (F.coalesce(F.sum("n_docs").over(inside), F.lit(0)) + F.col("docs_after")).alias("docs_longer"),
            (F.coalesce(F.sum(F.col("n_docs") * at).over(inside), F.lit(0)) + F.col("toks_after")).alias("tokens_longer"),
            "all_docs",
        )
    )


def count_tokens(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The length table of docs with truncated totals and quantiles.

    Null and empty texts have length 0; a very long text counts whole, in the
    memory of its words, and ties of length share a row; null ids and repeated rows count like any
    other row; an empty table gives an empty result; other columns are ignored.
    """
    counts = materialise(histogram(token_lengths(docs, tokenizer, id_col, text_col)))
    table = length_table(counts)
    total = counts.agg(F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")), F.lit(0)).alias("all_tokens"))
    return table.join(F.broadcast(total)).select(
        "n_tokens",
        "n_docs",
        "docs_longer",
        "tokens_longer",
        (F.col("all_tokens") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")).alias("truncated_total"),
        (F.lit(1.0) - F.col("docs_longer") / F.col("all_docs")).alias("share_within"),
    )


def quantiles(table: DataFrame, points: Sequence[float]) -> DataFrame:
    """(q, n_tokens): the smallest length that at least a share q of documents stays within."""
    wanted = table.sparkSession.createDataFrame([(float(q),) for q in points], "q double")
    return (
        table.join(F.broadcast(wanted), F.col("share_within") >= F.col("q"))
        .groupBy("q").agg(F.min("n_tokens").alias("n_tokens"))
    )
