"""Queries that go through the registries of plug-ins, and streams that are polled."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import plugins as P
from quarry.operators.entities import embed
from quarry.registry import query
from quarry.functions import constants as C
from quarry.operators.extraction import extracted
from quarry.requests import ACCUMULATORS, ANNOTATORS, EMBEDDINGS, EXTRACTORS, HANDLERS
from quarry.session import scratch, table
from quarry.streaming import changes as S


@query("minted_by_kind", """SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'location' WHEN 1 THEN 'date' ELSE 'unheard' END AS kind, CASE n_nationkey % 3 WHEN 0 THEN 'kr:location/' || lower(replace(n_name, ' ', '_')) WHEN 1 THEN 'kr:date/' || lower(replace(n_name, ' ', '_')) END AS uri FROM nation""")
def minted_by_kind(spark, sf_dir):
    """The minter is looked up by the row's kind; unknown kinds mint nothing."""
    kind = F.element_at(F.array(*map(F.lit, ("location", "date", "unheard"))), (F.col("n_nationkey") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "nation").withColumn("kind", kind)
    return rows.select("n_nationkey", "kind", P.mint(F.col("kind"), F.col("n_name")).alias("uri"))


@query("annotated", r"""SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Z][a-z]+'), lambda t: t)) AS text, 'pattern' AS kind FROM documents WHERE text IS NOT NULL
    UNION ALL SELECT doc_id, w, 'terms' FROM documents, (VALUES ('the'), ('und')) v(w) WHERE list_contains(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), w)""")
def annotated(spark, sf_dir):
    """Two annotators by name over every text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = F.concat(ANNOTATORS.get("pattern")(F.col("text")), ANNOTATORS.get("terms")(F.col("text"), ("the", "und")))
    return docs.where("text is not null").select("doc_id", F.inline(found).alias("text", "kind"))


@query("model_embeddings", """SELECT p_partkey, length(p_name) * 1.0 AS characters, (length(p_name) - length(replace(p_name, ' ', ''))) * 1.0 AS blanks, length(regexp_replace(p_name, '[^aeiou]', '', 'g')) * 1.0 AS vowels FROM part""")
def model_embeddings(spark, sf_dir):
    """Vectors of a model looked up by name, in batches."""
    found = embed(table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("text")), EMBEDDINGS.get("shape"), size=3)
    return found.select("p_partkey", *[F.col("embedding")[k].alias(n) for k, n in enumerate(("characters", "blanks", "vowels"))])


@query("accumulated", """WITH v AS (SELECT c_nationkey, c_custkey AS x, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS r FROM customer)
    SELECT c_nationkey, count(x) AS n, CAST(sum(x * x) AS BIGINT) AS squares, CAST(sum(CASE WHEN r % 2 = 1 THEN x ELSE -x END) AS BIGINT) AS alternating FROM v GROUP BY c_nationkey""")
def accumulated(spark, sf_dir):
    """Accumulators by name: built-in aggregates, and one of an update step."""
    each = {"n": "count", "squares": "sum_of_squares", "alternating": "alternating"}
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(*[ACCUMULATORS.get(f)(F.col("c_custkey")).alias(n) for n, f in each.items()])


@query("handled_stream", """SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def handled_stream(spark, sf_dir):
    """A stream's handler loaded by name."""
    state = S.StateTable(spark, ["user_id"], ["event_id"])
    S.drain(S.table_stream(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), HANDLERS.get("upsert")(state), scratch(spark))
    return state.read().select("user_id", "event_type")


@query("polled_stream", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def polled_stream(spark, sf_dir):
    """Polled more than once from one checkpoint: each record counts once."""
    out, place = scratch(spark), scratch(spark)
    stream = S.table_stream(spark, sf_dir, "events").select("event_id", "event_type")
    S.poll(stream, lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}"), place, budget=0)
    S.drain(stream, lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}"), place, retries=1)
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("stream_progress", "SELECT count(*) AS records FROM events")
def stream_progress(spark, sf_dir):
    """Records processed as the stream reports them."""
    seen = S.drain(S.table_stream(spark, sf_dir, "events").select("event_id"), lambda batch, i: batch.write.format("noop").mode("overwrite").save(), scratch(spark))
    return spark.createDataFrame([(sum(p["records"] for p in seen),)], "records bigint")


_CONCEPTS = [(g, u, "".join(f" {c}" if c.isupper() else c for c in u.split(":")[1]).strip(), ks) for g, rules in C.CONCEPT_KEYWORDS.items() for u, ks in rules.items()]


@query("model_concepts", "WITH r(category, uri, label, words) AS (VALUES " + ", ".join(f"('{g}', '{u}', '{t}', [{', '.join(chr(39) + k.lower() + chr(39) for k in ks)}])" for g, u, t, ks in _CONCEPTS)
       + """), d AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' Drought.' WHEN 1 THEN ' A parametric risk pool.' ELSE '' END AS t FROM documents)
    SELECT doc_id, category, label, uri, CAST(0.85 AS DOUBLE) AS confidence, 'Description' AS section FROM d, r WHERE len(list_filter(words, lambda w: contains(lower(t), w))) > 0""")
def model_concepts(spark, sf_dir):
    """Concepts that a model, looked up by name, finds in every text."""
    vocabulary = spark.createDataFrame([(g, t, u) for g, u, t, _ in _CONCEPTS], "category string, label string, uri string")
    more = F.when(F.col("doc_id") % 3 == 0, " Drought.").when(F.col("doc_id") % 3 == 1, " A parametric risk pool.").otherwise("")
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("n"), F.lit("Description").alias("section"), F.concat("text", more).alias("text"))
    return extracted(chunks, vocabulary, EXTRACTORS.get("keywords")).select("doc_id", "category", "label", "uri", "confidence", "section")
