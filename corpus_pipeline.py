"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, langid, packing, shingle_dedup, simhash, substring_dedup
from quarry.llm._shared import anti_join, materialise, table


#: The language stage rejects texts of so many bytes or more (normalised: letters and
#: single spaces) whose best language still needs over this many phrases per byte.
JUDGED_BYTES, MOST_PHRASES = 20, 0.75


#: Words whose token ids a worker process keeps while it packs. Executors that have
#: run the other stages have grown, so this is less than packing by itself takes.
CACHED_WORDS = 150_000


def _whole(docs: DataFrame) -> Column:
    """The whole row in one column, row, its fields numbered: names may hold anything."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("row")


def _field(docs: DataFrame, name: str) -> Column:
    """A column of docs, from row."""
    return F.col("row")[f"c{docs.columns.index(name)}"]


def _columns(docs: DataFrame, changed: dict[str, Column] | None = None) -> list[Column]:
    """All columns of docs, from row, but for those that changed."""
    return [(changed or {}).get(c, _field(docs, c)).alias(c) for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no recognisable language, and names the language of
    those whose lang is null.

    Learns from the rows that are not held out. Rejected: null and empty texts,
    texts without a letter, and texts of JUDGED_BYTES or more that no learned
    language explains (over MOST_PHRASES phrases per byte). If nothing can be
    learned, all go. A very long text is parsed whole; ties of two languages keep
    the document; repeated rows and rows with a null doc_id are judged like any
    other; other columns pass through, whatever their names; an empty table gives
    an empty one.
    """
    samples = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    judged = langid.predict(docs.select(_whole(docs), "text"), samples, carry=("row",))
    known = (F.col("phrase_rate") <= MOST_PHRASES) | (F.octet_length(_field(docs, "text")) < JUDGED_BYTES)
    named = F.coalesce(_field(docs, "lang"), "lang_pred")
    return judged.where((F.col("lang_pred") != "und") & known).select(*_columns(docs, {"lang": named}))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: texts whose SimHashes over
    five-word shingles differ in two bits at most, and what is linked through them.
    So few bits miss most pairs at a similarity of 0.8, so texts whose sets of these
    shingles have a Jaccard similarity of 0.8 or more are linked too; a group may
    hold links of both kinds.

    The document kept is that of the smallest doc_id, null ids last; texts of one
    id are told apart, and ties go to the smaller hash of the text. A row that
    repeats is kept once. Null, empty and blank texts form one group. A very long
    text is compared whole. Other columns pass through, whatever their names; an
    empty table gives an empty one.
    """
    texts = docs.select(F.xxhash64("text").alias("copy"), "text")
    hashed = simhash.near_duplicates(texts, shingle=5, max_distance=2, id_col="copy")
    labels = hashed.select(F.col("doc_id").alias("copy"), F.col("component_id").alias("label")).distinct()
    found = shingle_dedup.near_duplicates(docs, shingle=5, threshold=0.8, labels=labels)
    gone = materialise(found.where("not kept").select(F.col("doc_id").alias("id"), F.col("copy").alias("hash")).distinct())
    repeated = (
        found.where("kept").groupBy(F.col("doc_id").alias("id"), F.col("copy").alias("hash"))
        .agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "hash")
    )
    rows = docs.select(_whole(docs), F.col("doc_id").alias("i"), F.xxhash64("text").alias("h"))
    same = F.col("i").eqNullSafe(F.col("id")) & (F.col("h") == F.col("hash"))
    kept = anti_join(rows, gone, same, F.xxhash64("i", "h"), F.xxhash64("id", "hash"))
    if not repeated.isEmpty():
        several = kept.join(repeated, same, "left_semi")
        once = several.groupBy("i", "h").agg(F.any_value("row").alias("row")).select("row")
        kept = kept.join(repeated, same, "left_anti").select("row").union(once)
    return kept.select(*_columns(docs))


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 50 words or more that a document of a smaller doc_id
    holds too; a document goes if nothing is left of it.

    Null, empty and blank texts and texts under 50 words stay as they are. A text
    that loses words comes back with its words joined by single spaces, and n_chars
    follows it. Rows of equal doc_id do not cut each other, so ties and repeated
    rows stay; a null doc_id neither owns nor loses anything. A very long text is
    treated whole. Other columns pass through, whatever their names; an empty
    table gives an empty one.
    """
    whole = docs.select(_whole(docs), "doc_id", "text")
    cut = substring_dedup.deduplicate(whole, carry=("row",))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(_field(docs, "text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(kind)).otherwise(_field(docs, "n_chars"))
    return cut.where("n_removed = 0 or n_removed < n_words").select(*_columns(docs, new))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item, verbatim or re-parameterised.

    Null and empty texts, and rows with a null doc_id, are judged like any other
    (the first hold nothing). A very long text is read whole. One item suffices,
    so ties do not matter; repeated rows share one fate. With an empty benchmark
    all rows stay; an empty table gives an empty one. Other columns pass through,
    whatever their names.
    """
    rows = docs.select(_whole(docs), F.md5("text").alias("key"))
    texts = docs.select(F.md5("text").alias("text_key"), "text").where("text is not null")
    leaks = decontaminate.leaks_of_texts(texts, table(spark, sf_dir, "benchmark"))
    gone = materialise(leaks.select("text_key"))
    return anti_join(rows, gone, F.col("key") == F.col("text_key"), F.xxhash64("key"), F.xxhash64("text_key")).select(*_columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens: one row per piece, with
    doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    Null and empty texts give the end token alone; a very long text gives many
    pieces; pieces of equal length are placed in the order of their input tasks;
    repeated rows and rows with a null doc_id are packed like any other; other
    columns are dropped; an empty table gives an empty result.
    """
    return packing.pack(docs, cached_words=CACHED_WORDS)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", pack),
]

#: Stages such as language ID have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, over the whole documents table. Each stage reads its
    documents more than once, so what a stage keeps is written before the next."""
    docs = table(spark, sf_dir, "documents")
    *before, (_, last) = STAGES
    for _, stage in before:
        docs = materialise(stage(spark, docs, sf_dir))
    return last(spark, docs, sf_dir)
