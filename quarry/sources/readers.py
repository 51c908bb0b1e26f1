"""Scans: CSV folders, JSON objects and lists, manifests, RDF and Turtle, scripts,
mapping files, message envelopes and relational tables."""

from __future__ import annotations

import io
import re
import tarfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.session import scratch, ship_code

CSV_FIELDS = {
    # fixed values: column heads as the files have them
    "number": "No.", "name": "Name", "country": "Country", "public_organisations": "Public Organisations",
    "international_organisations": "International Organisations", "private_organisations": "Private Organisations",
    "type_of_risk": "Type of Risk", "type_of_solution": "Type of Solution ", "ppp": "PPP?", "theme": "Theme",
    "year_of_implementation": "Year of Implementation", "description": "Description", "key_highlights": "Key Highlights",
    "results": "Results", "organization_sources": "Organization Sources", "other_sources": "Other Sources",
    "contact_information": "Contact Information", "date_added": "Date Added", "last_updated": "Last Updated",
    "most_recent_changes": "Most Recent Changes",
}


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """All CSV files of a folder but backups, as text; a row without a name goes.
    Rows are numbered from 1 within each file, in file order."""
    raw = (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("pathGlobFilter", "*.csv")
        .csv(folder).withColumn("_path", F.input_file_name()).withColumn("_at", F.monotonically_increasing_id())
    )
    file = F.regexp_extract(F.url_decode("_path"), r"([^/]+)\.csv$", 1)
    heads = {c.lstrip("﻿"): c for c in raw.columns}
    fields = [T.clean_null(F.col(f"`{heads[h]}`") if h in heads else F.lit(None)).alias(f) for f, h in CSV_FIELDS.items()]
    nth = F.row_number().over(Window.partitionBy("source_file").orderBy("_at"))
    rows = raw.where(~F.col("_path").contains(".backup")).select(file.alias("source_file"), "_at", *fields)
    numbered = rows.withColumn("row_number", nth).where("name != ''").drop("_at")
    return numbered.withColumn("id", F.concat_ws("_", "source_file", "row_number")).withColumn(
        "doc_id", T.solution_id(F.concat(F.lit("solution://"), "name", F.lit("/"), "country"))
    )


def read_chunks(spark: SparkSession, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, metadata) of one JSON object per file under a prefix; files named
    metadata are the latter. Chunks come by chunk_id."""
    rows = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(prefix)
    meta = F.input_file_name().contains("metadata")
    rows = rows.withColumn("_meta", meta)
    return rows.where("not _meta").drop("_meta").orderBy("chunk_id"), rows.where("_meta").drop("_meta")


def read_json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of files whose root is a list or one object."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_archives(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """(archive, member, content) of the members of tar files, packed or not, whose
    name ends with suffix. A task holds one archive."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["archive", "member", "content"]
        for batch in batches:
            for archive, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                with tarfile.open(fileobj=io.BytesIO(data.as_py())) as packed:
                    for one in packed:
                        if one.isfile() and one.name.endswith(suffix):
                            rows.append((archive, one.name, packed.extractfile(one).read().decode("utf-8", "replace")))
                            size += one.size
                            if size > 4 << 20:
                                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names)
                                rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(members, "archive string, member string, content string")


def read_pages(spark: SparkSession, fetch: Callable[[str | None], tuple[list[tuple], str | None]], schema: str, together: int = 100) -> DataFrame:
    """The rows of a source that hands out pages: fetch(token) gives a page's rows and
    the next token, None at the end. Pages are written as they come, `together` at a
    time, so the driver never holds them all."""
    path, token, rows, pages = scratch(spark), None, [], 0
    while True:
        page, token = fetch(token)
        rows += page
        pages += 1
        if pages % together == 0 or token is None:
            spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
            rows = []
        if token is None:
            return spark.read.schema(schema).parquet(path)


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per line; rows marked skip go."""
    return spark.read.schema(f"{schema}, skip boolean").json(path).where(~F.coalesce("skip", F.lit(False))).drop("skip")


def read_table(spark: SparkSession, url: str, name: str, properties: dict[str, str]) -> DataFrame:
    """A relational table; the driver class must be on the class path."""
    return spark.read.jdbc(url, name, properties=properties)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(url, record) of concatenated RDF/XML documents, each after its url's line."""
    lines = spark.read.option("lineSep", "\nhttp").text(path)
    text = F.regexp_replace("value", "^(?!http)", "http")
    return lines.where(F.trim("value") != "").select(
        F.regexp_extract(text, r"^(\S+)", 1).alias("url"), F.trim(F.regexp_replace(text, r"^\S+\s*", "")).alias("record")
    ).where("record != ''")


def feature_fields(features: DataFrame) -> DataFrame:
    """name, code, population, lat and lon of RDF/XML features."""
    tag = lambda name: F.nullif(F.regexp_extract("record", rf"<gn:{name}[^>]*>([^<]*)</gn:{name}>", 1), F.lit(""))
    point = lambda name: F.nullif(F.regexp_extract("record", rf"<wgs84_pos:{name}[^>]*>([^<]*)<", 1), F.lit(""))
    return features.select(
        "url", tag("name").alias("name"), F.nullif(F.regexp_extract("record", r'featureCode rdf:resource="[^"#]*#([^"]+)"', 1), F.lit("")).alias("code"),
        tag("population").cast("bigint").alias("population"), point("lat").cast("double").alias("lat"), point("long").cast("double").alias("lon"),
    )


def read_turtle_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(block): statements of Turtle files that end with a full stop on a line's end;
    prefixes and comments go."""
    blocks = spark.read.option("lineSep", " .\n").text(path).select(F.regexp_replace("value", r"(?m)^\s*(?:#|@prefix).*$", "").alias("b"))
    return blocks.select(F.regexp_replace("b", r"^\s+|\s*\.?\s*$", "").alias("block")).where("block != ''")


def feature_codes(spark: SparkSession, path: str) -> DataFrame:
    """(code, n) of Turtle features."""
    lines = spark.read.text(path).select(F.regexp_extract("value", r"featureCode\s+(?:gn:|<[^>#]*#)([\w.]+)", 1).alias("code"))
    return lines.where("code != ''").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def split_script(text: str) -> list[str]:
    """Requests of a script, each with the prefixes above it; comments go."""
    prefixes, requests = [], []
    for part in re.sub(r"(?m)^\s*#.*$", "", text).split(";"):
        own = re.findall(r"(?im)^\s*(prefix\s+\S*:\s*<[^>]*>)", part)
        prefixes += [p for p in own if p not in prefixes]
        body = re.sub(r"(?im)^\s*prefix\s+\S*:\s*<[^>]*>", "", part).strip()
        if body:
            requests.append("\n".join([*prefixes, body]))
    return requests


def script_requests(scripts: DataFrame, id_col: str, script_col: str) -> DataFrame:
    """(id, n, request): the requests of each script, numbered from 0. A null script has none."""
    ship_code(scripts.sparkSession)
    split = F.udf(split_script, "array<string>", useArrow=True)
    text = F.coalesce(F.col(script_col), F.lit(""))
    return scripts.select(id_col, F.posexplode(split(text)).alias("n", "request"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(label, uri) of the concepts of a Turtle vocabulary."""
    blocks = read_turtle_blocks(spark, path)
    label = F.regexp_extract("block", r'(?:skos:prefLabel|rdfs:label)\s+"([^"]*)"', 1)
    return blocks.select(F.lower(label).alias("label"), F.regexp_extract("block", r"^(\S+)", 1).alias("uri")).where("label != ''")


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(name, uri) of lines like 'Name': 'gn:1',  # note."""
    pattern = r"""^\s*['"]([^'"]+)['"]\s*:\s*['"]([^'"]+)['"]"""
    return spark.read.text(path).where(F.col("value").rlike(pattern)).select(
        F.regexp_extract("value", pattern, 1).alias("name"), F.regexp_extract("value", pattern, 2).alias("uri")
    )


def unwrap_messages(rows: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """rows with message, from a bare message, a notification envelope or a queue
    body with either in it; rows without one, or without its first field, go."""
    body = F.coalesce(F.get_json_object(column, "$.body"), F.col(column))
    text = F.coalesce(F.get_json_object(body, "$.Message"), body)
    first = schema.split()[0]
    return rows.withColumn("message", F.from_json(text, schema)).where(F.col("message")[first].isNotNull())


def text_of_blocks(blocks: DataFrame, kind: str = "LINE") -> DataFrame:
    """(doc_id, text): blocks (doc_id, n, type, text) of one kind in order, by lines."""
    items = F.array_sort(F.collect_list(F.struct("n", "text")))
    return blocks.where(F.col("type") == kind).groupBy("doc_id").agg(F.array_join(F.transform(items, lambda x: x["text"]), "\n").alias("text"))
