"""Queries on what the sinks write."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import spans as P
from quarry.registry import query
from quarry.session import table
from quarry.sinks import writers as W


@query("chunk_turtle", """WITH pr AS (SELECT doc_id, n, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, text
      FROM (SELECT doc_id, unnest(range(len(l))) AS n, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))
    SELECT doc_id, doc_id || '_' || n AS chunk_id, 'sg:' || doc_id || '_' || n || ' a sgm:Chunk ;' || chr(10) || '    sgm:partOf sg:' || doc_id ||
      CASE WHEN n % 2 = 0 THEN ' ;' || chr(10) || '    sgm:startOffset ' || CAST(start AS BIGINT) || ' ;' || chr(10) || '    sgm:endOffset ' || CAST(start + length(text) AS BIGINT) ELSE '' END || ' .' AS value FROM pr WHERE text <> ''""")
def chunk_turtle(spark, sf_dir):
    chunks = P.paragraphs(table(spark, sf_dir, "documents"))
    rows = chunks.select(
        "doc_id", F.concat_ws("_", "doc_id", "n").alias("chunk_id"), "text", "start", F.when(F.col("n") % 2 == 0, F.col("start") + F.length("text")).alias("stop")
    )
    return W.chunk_turtle(rows, with_text=False)


@query("organisation_turtle", """WITH m AS (SELECT p_brand AS name, split_part(p_type, ' ', 1) AS kind, CAST(p_size % 3 AS VARCHAR) AS source FROM part), g AS (SELECT name, kind, count(*) AS n, array_to_string(list_sort(list_distinct(list(source))), ', ') AS sources FROM m GROUP BY ALL)
    SELECT name, 'sg:Org_' || regexp_replace(lower(name), '[^a-z0-9]', '', 'g') || ' a org:Organization ;' || chr(10) || '    rdfs:label "' || name || '" ;' || chr(10) || '    sg:organizationType "' || kind || '" ;' || chr(10) || '    sg:mentionCount ' || n || ' ;' || chr(10) || '    sg:sources "' || sources || '" .' AS value FROM g""")
def organisation_turtle(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.split("p_type", " ")[0].alias("kind"), (F.col("p_size") % 3).cast("string").alias("source"))
    return W.organisation_turtle(rows)


@query("concept_scheme", """SELECT p_type AS concept, count(*) AS n, 'sg:RiskType_' || lower(replace(p_type, ' ', '_')) || ' a skos:Concept ;' || chr(10) || '    skos:inScheme sg:RiskTypeScheme ;' || chr(10) || '    skos:prefLabel "' || p_type || '" ;' || chr(10) || '    rdfs:label "' || p_type || '" .' AS value FROM part GROUP BY p_type""")
def concept_scheme(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("concept")).agg(F.count(F.lit(1)).alias("n"))
    return W.concept_turtle(counts, "RiskType")


@query("extraction_numbers", """WITH x AS (SELECT p_partkey AS doc_id, unnest([0, 1, 2]) AS category, p_type AS label, p_size AS size FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY category) AS nth FROM x WHERE size % 4 <> category)
    SELECT doc_id, nth, 'sg:' || doc_id || '_ext_' || nth || ' a sg:Extraction ;' || chr(10) || '    sg:concept sg:C' || category || ' ;' || chr(10) || '    rdfs:label "' || label || '" ;' || chr(10) || '    sg:confidence "0.8500"^^xsd:decimal ;' || chr(10) || '    sg:evidence "' || label || '" .' AS value FROM n""")
def extraction_numbers(spark, sf_dir):
    """Extractions numbered across categories in a fixed order."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_type").alias("label"), "p_size", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("category"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("category"))
    numbered = rows.where("p_size % 4 != category").withColumn("nth", nth)
    return W.alignment_turtle(numbered.select("doc_id", "nth", F.concat(F.lit("sg:C"), "category").alias("uri"), "label", F.lit(0.85).alias("confidence"), F.col("label").alias("evidence")))


@query("entity_links", """WITH e AS (SELECT 'kr:n' || c_nationkey AS uri, c_mktsegment AS name, 'c' || c_custkey AS chunk FROM customer)
    SELECT DISTINCT v AS value FROM (SELECT uri || ' rdfs:label "' || name || '" .' AS v FROM e UNION ALL SELECT uri || ' sg:mentionedIn sg:' || chunk || ' .' FROM e UNION ALL SELECT 'sg:' || chunk || ' sg:mentions ' || uri || ' .' FROM e)""")
def entity_links(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("kr:n"), "c_nationkey").alias("uri"), F.col("c_mktsegment").alias("name"), F.concat(F.lit("c"), "c_custkey").alias("chunk_id"))
    return W.entity_turtle(rows)


@query("subject_documents", """SELECT 'n' || n_nationkey AS s, '{"name":[{"value":"' || n_name || '","graph":"g"}],"region":[{"value":"' || n_regionkey || '","graph":"g"}]}' AS predicates FROM nation""")
def subject_documents(spark, sf_dir):
    """Index documents with a map of predicates."""
    from quarry.operators.graph import subject_documents as documents, triples

    nation = table(spark, sf_dir, "nation")
    data = triples(nation, F.concat(F.lit("n"), "n_nationkey"), {"name": F.col("n_name"), "region": F.col("n_regionkey")}, graph="g")
    return documents(data).select("s", F.to_json("predicates").alias("predicates"))
