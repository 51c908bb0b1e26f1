"""Streaming queries, drained and compared with their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.registry import query
from quarry.session import scratch, table
from quarry.streaming import changes as S


def rows_n():
    return F.count(F.lit(1))


@query("stream_bundles", """WITH t AS (SELECT user_id AS key, event_id // 100 AS commit_num, event_type, CASE WHEN lag(event_type) OVER (PARTITION BY event_id // 100, user_id ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS turn FROM events)
    SELECT commit_num, key, CAST(sum(turn) AS BIGINT) AS bundles, count(*) AS records FROM t GROUP BY ALL""")
def stream_bundles(spark, sf_dir):
    """Change records bundled batch by batch, commits cut by batch borders included."""
    bundles = S.Bundles(spark)

    def each(batch, batch_id):
        records = batch.select(F.floor(F.col("event_id") / 100).alias("commit_num"), F.col("event_id").alias("op_num"), F.col("user_id").alias("key"), F.col("event_type").alias("op"))
        bundles.add(records, batch_id)

    S.drain(S.table_stream(spark, sf_dir, "events"), each, scratch(spark))
    return spark.read.parquet(bundles.out).groupBy("commit_num", "key").agg(F.max("bundle").alias("bundles"), rows_n().alias("records"))


@query("stream_upsert", """SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def stream_upsert(spark, sf_dir):
    """The current row of each key, kept up batch by batch."""
    state = S.StateTable(spark, ["user_id"], ["ts", "event_id"])
    S.drain(S.table_stream(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts"), state.merge, scratch(spark))
    return state.read().select("user_id", "event_type", "event_id")


@query("stream_documents", """WITH r AS (SELECT event_id, user_id, event_type, CAST(CAST(floor(value) AS BIGINT) % 7 AS VARCHAR) AS value FROM events),
    t AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id, event_type, value ORDER BY event_id DESC) = 1)
    SELECT user_id, event_type AS field, string_agg(value, ',' ORDER BY value) AS held FROM t WHERE event_id % 3 <> 0 AND value IS NOT NULL AND user_id IS NOT NULL GROUP BY ALL""")
def stream_documents(spark, sf_dir):
    """Search documents of entities, kept up from bundles that add and remove values."""
    documents = S.Documents(spark)

    def each(batch, batch_id):
        op = F.when(F.col("event_id") % 3 == 0, "REMOVE").otherwise("ADD")
        value = (F.floor("value") % 7).cast("string")
        documents.add(batch.select(F.floor(F.col("event_id") / 100).alias("commit_num"), F.col("event_id").alias("op_num"), F.col("user_id").alias("key"), op.alias("op"), F.col("event_type").alias("field"), value.alias("value")).where("value is not null and key is not null"), batch_id)

    S.drain(S.table_stream(spark, sf_dir, "events"), each, scratch(spark))
    return documents.read().select(F.col("key").alias("user_id"), F.explode("fields").alias("field", "held")).select("user_id", "field", F.array_join("held", ",").alias("held"))


@query("stream_filtered", """SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase') AND value IS NOT NULL AND json_extract_string(props, '$.k') IS NOT NULL""")
def stream_filtered(spark, sf_dir):
    """A stream-static semi join with a rule table, then record checks."""
    rules = spark.createDataFrame([("click",), ("purchase",)], "event_type string")
    stream = S.table_stream(spark, sf_dir, "events").join(F.broadcast(rules), "event_type", "left_semi")
    stream = stream.where(F.col("value").isNotNull() & F.get_json_object("props", "$.k").isNotNull()).select("event_id", "event_type")
    out = scratch(spark)
    S.drain(stream, lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}"), scratch(spark))
    return spark.read.parquet(out).select("event_id", "event_type")


@query("stream_fan_out", """SELECT 'errors' AS sink, count(*) AS n FROM events WHERE event_type = 'error' UNION ALL SELECT 'users', count(DISTINCT user_id) FROM events""")
def stream_fan_out(spark, sf_dir):
    """One stage event, several sinks."""
    root = scratch(spark)
    sinks = {"errors": lambda b: b.where("event_type = 'error'").select("event_id"), "users": lambda b: b.select("user_id").distinct()}
    S.drain(S.table_stream(spark, sf_dir, "events"), S.fan_out(sinks, root), scratch(spark))
    errors = spark.read.parquet(f"{root}/errors").agg(rows_n().alias("n")).select(F.lit("errors").alias("sink"), "n")
    return errors.union(spark.read.parquet(f"{root}/users").agg(F.countDistinct("user_id").alias("n")).select(F.lit("users"), "n"))


@query("stream_daily_counts", """SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def stream_daily_counts(spark, sf_dir):
    """Windowed counts over the stream, complete mode (an extension)."""
    out = scratch(spark)
    S.drain(S.windowed_counts(S.table_stream(spark, sf_dir, "events")), lambda b, i: b.write.mode("overwrite").parquet(out), scratch(spark), "complete")
    return spark.read.parquet(out)


@query("envelope_unwrap", """SELECT event_id, event_type AS stage, CAST(user_id AS VARCHAR) AS doc_id FROM events WHERE event_id % 4 <> 3""")
def envelope_unwrap(spark, sf_dir):
    """Messages in a notification envelope, in a queue body, or bare; others go."""
    from quarry.sources.readers import unwrap_messages

    rows = table(spark, sf_dir, "events")
    message = F.to_json(F.struct(F.col("event_type").alias("stage"), F.col("user_id").cast("string").alias("doc_id")))
    inner = F.to_json(F.struct(message.alias("Message")))
    body = F.when(F.col("event_id") % 4 == 0, inner).when(F.col("event_id") % 4 == 1, F.to_json(F.struct(inner.alias("body")))).when(F.col("event_id") % 4 == 2, message).otherwise("not json")
    return unwrap_messages(rows.select("event_id", body.alias("value")), "stage string, doc_id string").select("event_id", "message.stage", "message.doc_id")
