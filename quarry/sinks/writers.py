"""Sinks: texts, chunks, vectors, Turtle, manifests, audit rows and indexes.

All go through Spark's writers, so any file system it knows is a target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import escape_literal, escape_turtle, slug
from quarry.operators.tables import delete, upsert


def write_texts(docs: DataFrame, path: str) -> None:
    """One folder per document."""
    docs.select("doc_id", F.col("text").cast("string").alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").partitionBy("doc_id").json(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Rows with both ids only."""
    vectors.where("doc_id is not null and chunk_id is not null").write.mode("overwrite").parquet(path)


def write_turtle(lines: DataFrame, path: str, append: bool = False) -> None:
    lines.select("value").write.mode("append" if append else "overwrite").text(path)


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append_audit(rows: DataFrame, path: str) -> None:
    """The audit log only grows."""
    rows.write.mode("append").parquet(path)


def index(target: DataFrame, changes: DataFrame, key: str, order: str, path: str) -> None:
    """Upsert by id into a new version of an index."""
    upsert(target, changes, [key], [order]).write.mode("overwrite").parquet(path)


def unindex(target: DataFrame, ids: DataFrame, key: str, path: str) -> None:
    delete(target, ids, key).write.mode("overwrite").parquet(path)


def _property(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"    {name} "), value))


def _quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), escape_turtle(value), F.lit('"'))


def _block(subject: Column, kind: str, *properties: Column) -> Column:
    return F.concat(F.concat_ws(" ;\n", F.concat(subject, F.lit(f" a {kind}")), *properties), F.lit(" ."))


def chunk_turtle(chunks: DataFrame, with_text: bool = True) -> DataFrame:
    """One block per chunk (doc_id, chunk_id, text, start, stop); offsets only when
    both are there."""
    both = F.col("start").isNotNull() & F.col("stop").isNotNull()
    number = lambda name: F.when(both, F.col(name).cast("string"))
    text = [_property("sgm:text", _quoted(F.col("text")))] if with_text else []
    block = _block(
        F.concat(F.lit("sg:"), "chunk_id"), "sgm:Chunk", _property("sgm:partOf", F.concat(F.lit("sg:"), "doc_id")), *text,
        _property("sgm:startOffset", number("start")), _property("sgm:endOffset", number("stop")),
    )
    return chunks.select("doc_id", "chunk_id", block.alias("value"))


def alignment_turtle(extractions: DataFrame) -> DataFrame:
    """One block per extraction (doc_id, nth, uri, label, confidence, evidence)."""
    block = _block(
        F.concat_ws("_", F.concat(F.lit("sg:"), "doc_id"), F.lit("ext"), "nth"), "sg:Extraction", _property("sg:concept", F.col("uri")),
        _property("rdfs:label", _quoted(F.col("label"))),
        _property("sg:confidence", F.concat(F.lit('"'), F.format_string("%.4f", "confidence"), F.lit('"^^xsd:decimal'))),
        _property("sg:evidence", F.concat(F.lit('"'), escape_literal(F.col("evidence")), F.lit('"'))),
    )
    return extractions.select("doc_id", "nth", block.alias("value"))


def organisation_turtle(mentions: DataFrame) -> DataFrame:
    """One block per organisation of mentions (name, kind, source), by name, with its
    number of mentions and distinct sources."""
    found = mentions.groupBy("name", "kind").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources"))
    block = _block(
        F.concat(F.lit("sg:Org_"), slug(F.col("name"))), "org:Organization", _property("rdfs:label", _quoted(F.col("name"))),
        _property("sg:organizationType", _quoted(F.col("kind"))), _property("sg:mentionCount", F.col("n").cast("string")),
        _property("sg:sources", _quoted(F.col("sources"))),
    )
    return found.select("name", block.alias("value")).orderBy("name")


def concept_turtle(counts: DataFrame, scheme: str) -> DataFrame:
    """One block per concept (concept, n), most frequent first."""
    block = _block(
        F.concat(F.lit(f"sg:{scheme}_"), slug(F.col("concept"))), "skos:Concept", F.lit(f"    skos:inScheme sg:{scheme}Scheme"),
        _property("skos:prefLabel", _quoted(F.col("concept"))), _property("rdfs:label", _quoted(F.col("concept"))),
    )
    return counts.select("concept", "n", block.alias("value")).orderBy(F.desc("n"), "concept")


def entity_turtle(entities: DataFrame) -> DataFrame:
    """Entities (uri, name, chunk_id) as statements with links both ways."""
    link = lambda s, p, o: F.concat_ws(" ", s, F.lit(p), o, F.lit("."))
    chunk = F.concat(F.lit("sg:"), "chunk_id")
    lines = F.array(link(F.col("uri"), "rdfs:label", _quoted(F.col("name"))), link(F.col("uri"), "sg:mentionedIn", chunk), link(chunk, "sg:mentions", F.col("uri")))
    return entities.select(F.explode(lines).alias("value")).distinct()
