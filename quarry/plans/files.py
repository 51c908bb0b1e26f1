"""Sinks written and sources read back: each query goes through files in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.registry import query
from quarry.session import scratch, table
from quarry.sinks import writers as W
from quarry.sources import readers as I


def _lines(rows, path):
    """Each row's value as text, one below the other."""
    rows.select("value").write.text(path)


@query("csv_records", """SELECT 'sol_' || substr(sha256('solution://' || c_name || '/' || CASE WHEN c_nationkey = 3 THEN '' ELSE 'N' || c_nationkey END), 1, 17) AS doc_id, c_name AS name,
    CASE WHEN c_nationkey = 3 THEN '' ELSE 'N' || c_nationkey END AS country, c_mktsegment || chr(10) || 'a "b", c' AS description, '' AS results FROM customer WHERE c_custkey % 7 <> 0""")
def csv_records(spark, sf_dir):
    """A folder of CSV files with null tokens, quotes and line ends inside values; rows without a name go."""
    path, rows = scratch(spark), table(spark, sf_dir, "customer")
    country = F.when(F.col("c_nationkey") == 3, "N/A").otherwise(F.concat(F.lit("N"), "c_nationkey"))
    rows.select(
        F.col("c_custkey").alias("No."), F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).alias("Name"), country.alias("Country"),
        F.concat("c_mktsegment", F.lit('\na "b", c')).alias("Description"), F.lit("nil").alias("Results"),
    ).repartition(3).write.option("header", True).option("escape", '"').csv(path)
    return I.read_records(spark, path).select("doc_id", "name", "country", "description", "results")


@query("json_roots", "SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 100 + r_regionkey, r_name FROM region")
def json_roots(spark, sf_dir):
    """Files whose root is a list, and files whose root is one object."""
    path = scratch(spark)
    nation = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))).alias("rows"))
    nation.select(F.col("n_regionkey").alias("file"), F.to_json("rows").alias("value")).write.partitionBy("file").text(path)
    region = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).alias("file"), F.to_json(F.struct((F.col("r_regionkey") + 100).alias("id"), F.col("r_name").alias("name"))).alias("value"))
    region.write.mode("append").partitionBy("file").text(path)
    return I.read_json_rows(spark, path, "id bigint, name string").select("id", "name")


@query("manifest_rows", "SELECT n_nationkey AS doc_id, n_name AS name FROM nation WHERE n_regionkey <> 2")
def manifest_rows(spark, sf_dir):
    """A manifest, written and read; rows marked skip go."""
    path = scratch(spark)
    W.write_manifest(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.col("n_name").alias("name"), F.when(F.col("n_regionkey") == 2, True).when(F.col("n_regionkey") == 1, False).alias("skip")), path)
    return I.read_manifest(spark, path, "doc_id bigint, name string")


@query("feature_records", "SELECT 'http://g/' || s_suppkey || '/' AS url, s_name AS name, CASE WHEN s_suppkey % 3 <> 0 THEN 'P.PPL' || s_nationkey END AS code, s_suppkey * 10 AS population, s_nationkey + 0.5 AS lat FROM supplier")
def feature_records(spark, sf_dir):
    """RDF/XML documents, each after its url's line."""
    path, rows = scratch(spark), table(spark, sf_dir, "supplier")
    code = F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit('<gn:featureCode rdf:resource="https://o#P.PPL'), "s_nationkey", F.lit('"/>'))).otherwise("")
    value = F.concat(
        F.lit("http://g/"), "s_suppkey", F.lit("/\n<?xml?><gn:Feature>\n  <gn:name>"), "s_name", F.lit("</gn:name>"), code, F.lit("\n<gn:population>"),
        (F.col("s_suppkey") * 10).cast("string"), F.lit("</gn:population><wgs84_pos:lat>"), "s_nationkey", F.lit(".5</wgs84_pos:lat></gn:Feature>"),
    )
    _lines(rows.select(value.alias("value")), path)
    return I.feature_fields(I.read_features(spark, path)).select("url", "name", "code", "population", "lat")


@query("feature_code_counts", "SELECT 'A.ADM' || (p_size % 6) AS code, count(*) AS n FROM part GROUP BY 1")
def feature_code_counts(spark, sf_dir):
    path = scratch(spark)
    code = F.when(F.col("p_partkey") % 2 == 0, F.lit("gn:")).otherwise("<http://x/o#")
    value = F.concat(F.lit("<s"), "p_partkey", F.lit("> gn:featureCode "), code, F.lit("A.ADM"), (F.col("p_size") % 6).cast("string"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise(">"), F.lit(" ;"))
    _lines(table(spark, sf_dir, "part").select(value.alias("value")), path)
    return I.feature_codes(spark, path)


@query("turtle_blocks", "SELECT 'sg:n' || n_nationkey || ' a sg:Nation ;' || chr(10) || '  sg:in sg:r' || n_regionkey AS block FROM nation")
def turtle_blocks(spark, sf_dir):
    """Statements over several lines, with prefixes and comments between them."""
    path = scratch(spark)
    head = F.when(F.col("n_nationkey") % 5 == 0, "@prefix sg: <http://s/> .\n# a note\n").otherwise("")
    _lines(table(spark, sf_dir, "nation").select(F.concat(head, F.lit("sg:n"), "n_nationkey", F.lit(" a sg:Nation ;\n  sg:in sg:r"), "n_regionkey", F.lit(" .")).alias("value")), path)
    return I.read_turtle_blocks(spark, path)


@query("vocabulary_labels", "SELECT lower(n_name) AS label, 'sg:n' || n_nationkey AS uri FROM nation")
def vocabulary_labels(spark, sf_dir):
    path = scratch(spark)
    kind = F.when(F.col("n_nationkey") % 2 == 0, "skos:prefLabel").otherwise("rdfs:label")
    _lines(table(spark, sf_dir, "nation").select(F.concat(F.lit("sg:n"), "n_nationkey", F.lit(" a skos:Concept ;\n  "), kind, F.lit(' "'), "n_name", F.lit('" .')).alias("value")), path)
    return I.read_vocabulary(spark, path)


@query("mapping_lines", "SELECT n_name AS name, 'gn:' || n_nationkey AS uri FROM nation")
def mapping_lines(spark, sf_dir):
    path = scratch(spark)
    mark = F.when(F.col("n_nationkey") % 2 == 0, "'").otherwise('"')
    value = F.concat(F.lit("  "), mark, "n_name", mark, F.lit(": 'gn:"), "n_nationkey", F.lit("',  # note\n# 'no entry'"))
    _lines(table(spark, sf_dir, "nation").select(value.alias("value")), path)
    return I.read_mapping(spark, path)


@query("paged_rows", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def paged_rows(spark, sf_dir):
    """Pages of seven rows with a token each, put together: a page starts at the key
    that its token names, and the driver holds one page at a time."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    def fetch(token):
        page = [tuple(r) for r in rows.where(F.col("n_nationkey") >= int(token or 0)).orderBy("n_nationkey").limit(7).collect()]
        return page, str(page[-1][0] + 1) if len(page) == 7 else None

    return I.read_pages(spark, fetch, "id bigint, name string", together=2)


@query("document_texts", "SELECT n_nationkey AS doc_id, n_name || '!' AS text FROM nation")
def document_texts(spark, sf_dir):
    """One folder of text per document."""
    path = scratch(spark)
    W.write_texts(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.concat("n_name", F.lit("!")).alias("text")), path)
    return spark.read.text(path).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("value").alias("text"))


@query("chunk_files", "SELECT 'd' || n_nationkey AS doc_id, 'd' || n_nationkey || '_chunk_1' AS chunk_id, n_name AS text FROM nation")
def chunk_files(spark, sf_dir):
    """One JSON object per file under a prefix."""
    path = scratch(spark)
    W.write_chunks(table(spark, sf_dir, "nation").select(F.concat(F.lit("d"), "n_nationkey").alias("doc_id"), F.concat(F.lit("d"), "n_nationkey", F.lit("_chunk_1")).alias("chunk_id"), F.col("n_name").alias("text")), path)
    chunks, _ = I.read_chunks(spark, path)
    return chunks.select(F.split("chunk_id", "_chunk_")[0].alias("doc_id"), "chunk_id", "text")


@query("vector_files", "SELECT vec_id AS doc_id, 'c' || vec_id AS chunk_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)), 4) AS norm FROM embeddings WHERE vec_id % 9 <> 0")
def vector_files(spark, sf_dir):
    """Vectors with both ids, written in bulk and read back."""
    path, rows = scratch(spark), table(spark, sf_dir, "embeddings")
    W.write_vectors(rows.select(F.col("vec_id").alias("doc_id"), F.when(F.col("vec_id") % 9 != 0, F.concat(F.lit("c"), "vec_id")).alias("chunk_id"), "embedding"), path)
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return spark.read.parquet(path).select("doc_id", "chunk_id", F.round(norm, 4).alias("norm"))


@query("turtle_files", "SELECT '<n' || n_nationkey || '> <name> \"' || n_name || '\" .' AS value FROM nation UNION ALL SELECT '<r' || r_regionkey || '> <name> \"' || r_name || '\" .' FROM region")
def turtle_files(spark, sf_dir):
    """Statements written, and more appended."""
    path = scratch(spark)
    line = lambda kind, key, name: F.concat(F.lit(f"<{kind}"), key, F.lit('> <name> "'), name, F.lit('" .')).alias("value")
    W.write_turtle(table(spark, sf_dir, "nation").select(line("n", "n_nationkey", "n_name")), path)
    W.write_turtle(table(spark, sf_dir, "region").select(line("r", "r_regionkey", "r_name")), path, append=True)
    return spark.read.text(path)


@query("audit_log", "SELECT event_type AS action, count(*) * 2 AS n FROM events GROUP BY 1")
def audit_log(spark, sf_dir):
    """An audit log only grows: the same rows twice."""
    path, rows = scratch(spark), table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("action"))
    for _ in range(2):
        W.append_audit(rows, path)
    return spark.read.parquet(path).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("index_versions", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_mktsegment END AS value FROM customer WHERE c_custkey % 5 <> 0")
def index_versions(spark, sf_dir):
    """An index written, rows laid over it, and rows taken out by id."""
    first, second, rows = scratch(spark), scratch(spark), table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("value"), F.lit(0).alias("n"))
    W.index(rows, rows.where("c_custkey % 4 = 0").select("c_custkey", F.lit("new").alias("value"), F.lit(1).alias("n")), "c_custkey", "n", first)
    W.unindex(spark.read.parquet(first), rows.where("c_custkey % 5 = 0"), "c_custkey", second)
    return spark.read.parquet(second).select("c_custkey", "value")
