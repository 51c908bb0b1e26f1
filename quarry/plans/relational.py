"""Joins, aggregates, set operations, windows and table maintenance."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import tables as M
from quarry.registry import query
from quarry.session import materialise, table


def rows_n():
    return F.count(F.lit(1))


@query(
    "pipeline_status_view",
    """SELECT c_custkey, c_name, o_orderkey, o_orderstatus, o_orderkey IS NULL AS without_job FROM customer LEFT JOIN orders ON o_custkey = c_custkey""",
)
def pipeline_status_view(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    joined = table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("c_custkey", "c_name", "o_orderkey", "o_orderstatus", F.col("o_orderkey").isNull().alias("without_job"))


@query(
    "job_stats",
    """SELECT o_orderstatus, count(*) AS n, round(avg(epoch(l_shipdate - o_orderdate) / 86400), 6) AS mean_days, round(min(o_totalprice), 2) AS low, round(max(o_totalprice), 2) AS high
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderstatus ORDER BY o_orderstatus""",
)
def job_stats(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice")
    days = F.timestamp_diff("SECOND", F.col("o_orderdate"), F.col("l_shipdate")) / 86400
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderstatus").agg(
        rows_n().alias("n"), F.round(F.avg(days), 6).alias("mean_days"), F.round(F.min("o_totalprice"), 2).alias("low"),
        F.round(F.max("o_totalprice"), 2).alias("high"),
    ).orderBy("o_orderstatus")


@query(
    "content_type_breakdown",
    """SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY event_type""",
)
def content_type_breakdown(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        rows_n().alias("n"), F.countDistinct("user_id").alias("users"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    )


@query(
    "new_docs_antijoin",
    """SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)""",
)
def new_docs_antijoin(spark, sf_dir):
    return M.delete(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query(
    "id_set_diff",
    """SELECT 'both' AS side, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL
    SELECT 'documents', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL
    SELECT 'labels', count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents) UNION ALL
    SELECT 'either', count(*) FROM (SELECT doc_id FROM labels UNION SELECT doc_id FROM documents)""",
)
def id_set_diff(spark, sf_dir):
    """All four counts in one pass: sides as bits, one aggregate per id."""
    a = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("bit"))
    b = table(spark, sf_dir, "labels").select("doc_id", F.lit(2).alias("bit"))
    mask = a.union(b).groupBy("doc_id").agg(F.bit_or("bit").alias("mask"))
    m = F.col("mask")
    counts = mask.agg(F.count_if(m == 3).alias("both"), F.count_if(m == 1).alias("documents"), F.count_if(m == 2).alias("labels"), rows_n().alias("either"))
    return counts.select(F.expr("stack(4, 'both', both, 'documents', documents, 'labels', labels, 'either', either) AS (side, n)"))


@query(
    "source_overlaps",
    """WITH o AS (SELECT p_brand AS name, CASE p_size % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END AS bit FROM part), m AS (SELECT name, bit_or(bit) AS m, count(*) AS c FROM o GROUP BY name)
    SELECT count(*) FILTER (m & 1 > 0) AS public_n, count(*) FILTER (m & 2 > 0) AS international_n, count(*) FILTER (m & 4 > 0) AS private_n, count(*) AS total_n,
    count(*) FILTER (m & 3 = 3) AS public_international, count(*) FILTER (m & 5 = 5) AS public_private, count(*) FILTER (m = 7) AS all_three, CAST(sum(c) AS BIGINT) AS mentions FROM m""",
)
def source_overlaps(spark, sf_dir):
    bit = F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4)), (F.col("p_size") % 3 + 1).cast("int"))
    names = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.bit_or(bit).alias("m"), rows_n().alias("c"))
    has = lambda bits: F.count_if(F.col("m").bitwiseAND(bits) == bits)
    return names.agg(
        has(1).alias("public_n"), has(2).alias("international_n"), has(4).alias("private_n"), rows_n().alias("total_n"),
        has(3).alias("public_international"), has(5).alias("public_private"), has(7).alias("all_three"), F.sum("c").alias("mentions"),
    )


@query("most_frequent", """SELECT kind, name, n FROM (SELECT split_part(p_type, ' ', 1) AS kind, p_brand AS name, count(*) AS n FROM part GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n DESC, name) <= 3""")
def most_frequent(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy(F.split("p_type", " ")[0].alias("kind"), F.col("p_brand").alias("name")).agg(rows_n().alias("n"))
    nth = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "name"))
    return counts.withColumn("r", nth).where("r <= 3").drop("r")


@query("vocab_frequencies", """SELECT 'raw' AS form, p_type AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL
    SELECT 'parts', v, count(*) FROM (SELECT unnest(string_split(p_type, ' ')) AS v FROM part) GROUP BY 2""")
def vocab_frequencies(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    whole = part.select(F.lit("raw").alias("form"), F.col("p_type").alias("value"))
    parts = part.select(F.lit("parts").alias("form"), F.explode(F.split("p_type", " ")).alias("value"))
    return whole.union(parts).groupBy("form", "value").agg(rows_n().alias("n"))


@query("distinct_usage", """SELECT p_brand, count(DISTINCT l_orderkey) AS orders FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') GROUP BY p_brand""")
def distinct_usage(spark, sf_dir):
    part = table(spark, sf_dir, "part").where(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13")).select("p_partkey", "p_brand")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey")
    return lines.join(part, F.col("p_partkey") == F.col("l_partkey")).groupBy("p_brand").agg(F.countDistinct("l_orderkey").alias("orders"))


@query("doc_overview_distincts", """SELECT o_custkey, count(DISTINCT o_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, CAST(sum(l_linenumber) AS BIGINT) AS total FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey""")
def doc_overview_distincts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(
        F.countDistinct("o_orderkey").alias("orders"), F.countDistinct("l_partkey").alias("parts"), F.sum("l_linenumber").alias("total")
    )


@query("mentions_per_section", """SELECT l_returnflag, l_linestatus, l_linenumber, l_suppkey, count(*) AS mentions FROM lineitem GROUP BY ALL""")
def mentions_per_section(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey").agg(rows_n().alias("mentions"))


@query("coverage_counts", """SELECT count(*) FILTER (r_regionkey IS NOT NULL) AS mapped, count(*) FILTER (r_regionkey IS NULL) AS unmapped, count(*) AS total FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON r_regionkey = n_regionkey""")
def coverage_counts(spark, sf_dir):
    known = table(spark, sf_dir, "region").where("r_regionkey < 3")
    joined = table(spark, sf_dir, "nation").join(known, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return joined.agg(F.count("r_regionkey").alias("mapped"), F.count_if(F.col("r_regionkey").isNull()).alias("unmapped"), rows_n().alias("total"))


@query("class_members", """SELECT c_mktsegment, count(*) AS n, array_to_string(list_sort(list(c_name))[1:5], '|') AS first_names FROM customer GROUP BY c_mktsegment""")
def class_members(spark, sf_dir):
    """Counts with the first five members: a top-k, so a group's size does not matter."""
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", "c_name")
    nth = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("c_name"))
    few = rows.withColumn("r", nth).where("r <= 5").groupBy("c_mktsegment").agg(F.array_join(F.array_sort(F.collect_list("c_name")), "|").alias("first_names"))
    return rows.groupBy("c_mktsegment").agg(rows_n().alias("n")).join(few, "c_mktsegment")


@query("cumulative_levels", """WITH h AS (SELECT p_size // 10 AS level, count(*) AS n FROM part GROUP BY 1) SELECT level, CAST(sum(n) OVER (ORDER BY level) AS BIGINT) AS upto, round(100.0 * sum(n) OVER (ORDER BY level) / sum(n) OVER (), 6) AS percent FROM h""")
def cumulative_levels(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_size") / 10).alias("level")).agg(rows_n().alias("n"))
    upto = F.sum("n").over(Window.orderBy("level"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("level", upto.alias("upto"), F.round(100.0 * upto / F.col("total"), 6).alias("percent"))


@query("scenario_coverage", """SELECT CAST(sum(CASE WHEN p_size <= 10 THEN 1 ELSE 0 END) AS BIGINT) AS small, CAST(sum(CASE WHEN p_size <= 25 THEN 1 ELSE 0 END) AS BIGINT) AS medium, CAST(sum(CASE WHEN p_type LIKE 'PROMO%' THEN 1 ELSE 0 END) AS BIGINT) AS promo, count(*) AS total FROM part""")
def scenario_coverage(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").agg(
        F.count_if(size <= 10).alias("small"), F.count_if(size <= 25).alias("medium"), F.count_if(F.col("p_type").startswith("PROMO")).alias("promo"), rows_n().alias("total")
    )


@query("term_document_frequency", """SELECT term, count(DISTINCT doc_id) AS docs FROM documents, (SELECT unnest(['tion', 'keit', 'eau', 'ción', 'zzzz']) AS term) WHERE contains(lower(text), term) GROUP BY term""")
def term_document_frequency(spark, sf_dir):
    low = F.lower("text")
    hits = F.array_compact(F.array(*[F.when(low.contains(t), F.lit(t)) for t in ("tion", "keit", "eau", "ción", "zzzz")]))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(hits).alias("term")).groupBy("term").agg(F.countDistinct("doc_id").alias("docs"))


@query("status_counters", """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p, count(*) AS total,
    round(CASE WHEN count(*) = 0 THEN 0 ELSE 100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*) END, 6) AS rate FROM orders GROUP BY 1""")
def status_counters(spark, sf_dir):
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count_if(s == "F").alias("f"), F.count_if(s == "O").alias("o"), F.count_if(s == "P").alias("p"), rows_n().alias("total"),
        F.round(F.when(rows_n() == 0, 0.0).otherwise(100.0 * F.count_if(s == "F") / rows_n()), 6).alias("rate"),
    )


@query("daily_cost_top", """WITH d AS (SELECT o_orderpriority AS service, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS cost FROM orders GROUP BY ALL)
    SELECT service, round(sum(cost), 2) AS total, count(*) AS days FROM d GROUP BY service HAVING sum(cost) > 0.01 ORDER BY 2 DESC, service LIMIT 10""")
def daily_cost_top(spark, sf_dir):
    days = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("service"), F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("cost"))
    total = days.groupBy("service").agg(F.sum("cost").alias("t"), rows_n().alias("days")).where("t > 0.01")
    return total.select("service", F.round("t", 2).alias("total"), "days").orderBy(F.desc("total"), "service").limit(10)


@query("batch_rollup", """SELECT l_linenumber AS batch, count(*) AS processed, count(*) FILTER (l_returnflag = 'R') AS failed, 3 * count(*) FILTER (l_returnflag <> 'R') AS chunks, CAST(sum(l_quantity) AS DOUBLE) AS pages FROM lineitem GROUP BY 1""")
def batch_rollup(spark, sf_dir):
    failed = F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("batch")).agg(
        rows_n().alias("processed"), F.count_if(failed).alias("failed"), (F.count_if(~failed) * 3).alias("chunks"), F.sum("l_quantity").cast("double").alias("pages")
    )


@query("page_estimate", """SELECT round(avg(n_chars), 4) AS mean_size, CAST(floor(avg(n_chars) * 1000) AS BIGINT) AS estimated FROM documents""")
def page_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.round(F.avg("n_chars"), 4).alias("mean_size"), F.floor(F.avg("n_chars") * 1000).alias("estimated"))


@query("guarded_averages", """SELECT c_custkey, count(o_orderkey) AS n, coalesce(round(sum(o_totalprice), 2) / count(o_orderkey), 0) AS mean_price FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def guarded_averages(spark, sf_dir):
    """The average of nothing is zero."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.coalesce(F.round(F.sum("o_totalprice"), 2) / F.nullif(F.count("o_orderkey"), F.lit(0)), F.lit(0.0)).alias("mean_price"))


@query("group_concat", """SELECT n_regionkey, string_agg(n_name, ' ' ORDER BY n_name) AS names, min(n_name) AS first_name, max(n_name) AS last_name FROM nation GROUP BY n_regionkey""")
def group_concat(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(
        F.array_join(F.array_sort(F.collect_list("n_name")), " ").alias("names"), F.min("n_name").alias("first_name"), F.max("n_name").alias("last_name")
    )


@query("latest_status", """SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def latest_status(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return M.latest(rows, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("stage_status_map", """WITH l AS (SELECT user_id, event_type, event_id % 3 AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)
    SELECT user_id, max(status) FILTER (event_type = 'click') AS click, max(status) FILTER (event_type = 'error') AS error, max(status) FILTER (event_type = 'view') AS view FROM l GROUP BY user_id""")
def stage_status_map(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    last = M.latest(rows, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")])
    status = F.col("event_id") % 3
    return last.groupBy("user_id").agg(*[F.max(F.when(F.col("event_type") == k, status)).alias(k) for k in ("click", "error", "view")])


@query("op_run_bundles", """WITH t AS (SELECT user_id, event_id, event_type, ts, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS turn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    b AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bundle FROM t)
    SELECT user_id, CAST(bundle AS BIGINT) AS bundle, any_value(event_type) AS op, count(*) AS n, min(event_id) AS first_id FROM b GROUP BY user_id, bundle""")
def op_run_bundles(spark, sf_dir):
    rows = M.runs(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"], "event_type")
    return rows.groupBy("user_id", "bundle").agg(F.min("event_type").alias("op"), rows_n().alias("n"), F.min("event_id").alias("first_id"))


@query("commit_bundles", """WITH k AS (SELECT event_id, user_id, event_id // 100 AS commit_num, event_type, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS turn FROM events WINDOW w AS (PARTITION BY event_id // 100, user_id ORDER BY event_id))
    SELECT commit_num, user_id, CAST(sum(turn) AS BIGINT) AS bundles, count(*) AS records FROM k GROUP BY ALL""")
def commit_bundles(spark, sf_dir):
    """Default mode: a bundle never crosses a commit."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.floor(F.col("event_id") / 100).alias("commit_num"))
    found = M.runs(rows, ["commit_num", "user_id"], ["event_id"], "event_type")
    return found.groupBy("commit_num", "user_id").agg(F.max("bundle").alias("bundles"), rows_n().alias("records"))


@query("fixed_batches", """SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 7 AS batch FROM events""")
def fixed_batches(spark, sf_dir):
    return M.batches(table(spark, sf_dir, "events").select("user_id", "event_id"), ["event_id"], 7, ["user_id"])


@query("upsert_last_wins", """WITH t AS (SELECT c_custkey AS id, c_acctbal AS v, 0 AS r FROM customer), ch AS (SELECT o_custkey AS id, o_totalprice AS v, o_orderkey AS r FROM orders), a AS (SELECT *, 0 AS new FROM t UNION ALL SELECT *, 1 FROM ch)
    SELECT id, v, r FROM a QUALIFY row_number() OVER (PARTITION BY id ORDER BY new DESC, r DESC) = 1""")
def upsert_last_wins(spark, sf_dir):
    target = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"), F.lit(0).cast("bigint").alias("r"))
    changes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("r"))
    return M.upsert(target, changes, ["id"], ["r"])


@query("delete_by_query", """SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""")
def delete_by_query(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return M.delete(table(spark, sf_dir, "lineitem").select("l_orderkey"), gone, "l_orderkey").groupBy("l_orderkey").agg(rows_n().alias("n"))


@query("cleanup_dry_run", """SELECT 'orders' AS table_name, count(*) AS rows FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7))""")
def cleanup_dry_run(spark, sf_dir):
    who = table(spark, sf_dir, "customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(who, "o_custkey", "left_semi")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).join(orders, "o_orderkey", "left_semi")
    return orders.agg(rows_n().alias("rows")).select(F.lit("orders").alias("table_name"), "rows").union(lines.agg(rows_n().alias("rows")).select(F.lit("lineitem"), "rows"))


@query("constraint_violations", """SELECT 'status' AS rule, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS n FROM orders UNION ALL SELECT 'price', count(*) FILTER (o_totalprice <= 1000) FROM orders UNION ALL SELECT 'required', count(*) FILTER (o_custkey IS NULL OR coalesce(o_orderpriority, '') = '') FROM orders""")
def constraint_violations(spark, sf_dir):
    return M.violations(table(spark, sf_dir, "orders"), {
        "status": F.col("o_orderstatus").isin("F", "O"), "price": F.col("o_totalprice") > 1000,
        "required": F.col("o_custkey").isNotNull() & (F.col("o_orderpriority") != ""),
    })


@query("recent_terminal_jobs", """SELECT event_id FROM events WHERE event_type IN ('purchase', 'error') AND ts > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 10 HOUR""")
def recent_terminal_jobs(spark, sf_dir):
    """A fixed clock stands for now."""
    now = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error") & (F.col("ts") > now - F.expr("INTERVAL 10 HOURS"))).select("event_id")


@query("pending_partial_index", """SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P')""")
def pending_partial_index(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "P")).select("o_orderkey", "o_orderstatus")


@query("systematic_sample", """WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS r, count(*) OVER () AS n FROM documents) SELECT doc_id FROM s WHERE (r - 1) % greatest(n // 20, 1) = 0 ORDER BY r LIMIT 20""")
def systematic_sample(spark, sf_dir):
    """Every n-th document by size, twenty in all (a sampling operator). Places come
    from counts per size and ranks within a size, so no task sorts all documents."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    sizes = rows.groupBy("n_chars").agg(rows_n().alias("c"))
    smaller = F.sum("c").over(Window.orderBy("n_chars").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select("n_chars", F.coalesce(smaller, F.lit(0)).alias("before"))
    total = sizes.agg(F.sum("c").alias("n"))
    nth = F.row_number().over(Window.partitionBy("n_chars").orderBy("doc_id"))
    placed = rows.join(before, "n_chars").withColumn("r", F.col("before") + nth).join(F.broadcast(total))
    return placed.where((F.col("r") - 1) % F.greatest(F.floor(F.col("n") / 20), F.lit(1)) == 0).orderBy("r").limit(20).select("doc_id")


@query("early_limit", """SELECT doc_id, upper(lang) AS lang FROM documents ORDER BY doc_id LIMIT 25""")
def early_limit(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").orderBy("doc_id").limit(25).select("doc_id", F.upper("lang").alias("lang"))


@query("band_join", """SELECT a.conv_id, a.turn, b.turn AS other, CASE WHEN b.turn < a.turn THEN 'previous' WHEN b.turn > a.turn THEN 'next' ELSE 'current' END AS place FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1""")
def band_join(spark, sf_dir):
    """Neighbours within one step: each row probes three equal keys, so no band is scanned."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    probes = rows.withColumn("other", F.explode(F.sequence(F.col("turn") - 1, F.col("turn") + 1)))
    found = probes.join(rows.select("conv_id", F.col("turn").alias("other")), ["conv_id", "other"])
    place = F.when(F.col("other") < F.col("turn"), "previous").when(F.col("other") > F.col("turn"), "next").otherwise("current")
    return found.select("conv_id", "turn", "other", place.alias("place"))


@query("adjacent_turns", """SELECT conv_id, turn, lag(turn) OVER w AS previous_turn, lead(turn) OVER w AS next_turn, first_value(turn) OVER w AS first_turn, max(turn) OVER (PARTITION BY conv_id) AS last_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def adjacent_turns(spark, sf_dir):
    w, whole = Window.partitionBy("conv_id").orderBy("turn"), Window.partitionBy("conv_id")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.lag("turn").over(w).alias("previous_turn"), F.lead("turn").over(w).alias("next_turn"),
        F.first("turn").over(w).alias("first_turn"), F.max("turn").over(whole).alias("last_turn"),
    )


#: Joined rows of shared_value_pairs that one task counts, about.
PAIR_ROWS = 1_000_000


@query("shared_value_pairs", """WITH p AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT a.l_orderkey AS a, b.l_orderkey AS b, count(*) AS shared FROM p a JOIN p b ON a.l_suppkey = b.l_suppkey AND a.l_orderkey <> b.l_orderkey AND a.l_orderkey % 100 = 0 GROUP BY ALL""")
def shared_value_pairs(spark, sf_dir):
    """Orders sharing suppliers with every hundredth order, itself excluded. The
    distinct pairs are written first, so the join reads plain shuffles and a popular
    supplier can be split. Nearly every joined row is a pair of its own, so rows are
    dealt out by pair before they are counted, to as many tasks as their number asks for."""
    pairs = materialise(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct())
    asked = pairs.where("l_orderkey % 100 = 0").withColumnRenamed("l_orderkey", "a")
    sizes = asked.groupBy("l_suppkey").agg(rows_n().alias("n")).join(pairs.groupBy("l_suppkey").agg(rows_n().alias("m")), "l_suppkey")
    total = sizes.agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0
    joined = asked.join(pairs.withColumnRenamed("l_orderkey", "b"), "l_suppkey").where("a != b").select("a", "b")
    return joined.repartition(max(1, math.ceil(total / PAIR_ROWS)), "a", "b").groupBy("a", "b").agg(rows_n().alias("shared"))


@query("co_occurrence_pairs", """SELECT l_orderkey, least(a, b) AS a, greatest(a, b) AS b, distance FROM (SELECT x.l_orderkey, x.l_partkey AS a, y.l_partkey AS b, abs(x.l_linenumber - y.l_linenumber) AS distance FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber < y.l_linenumber)""")
def co_occurrence_pairs(spark, sf_dir):
    """Unordered pairs inside one order, which holds seven lines at most."""
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("i"), F.col("l_partkey").alias("p"))
    y = x.select("l_orderkey", F.col("i").alias("j"), F.col("p").alias("q"))
    return x.join(y, "l_orderkey").where("i < j").select(
        "l_orderkey", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), (F.col("j") - F.col("i")).alias("distance")
    )


@query("metadata_enrichment", """SELECT doc_id, lang, quality, toxic FROM labels JOIN documents USING (doc_id)""")
def metadata_enrichment(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("doc_id", "lang", "quality", "toxic")


@query("repository_counts", """SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS size, max(doc_id) AS last_id FROM documents GROUP BY source""")
def repository_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(rows_n().alias("n"), F.sum("n_chars").alias("size"), F.max("doc_id").alias("last_id"))


@query("section_unpivot", """SELECT p_partkey, section, text FROM (SELECT p_partkey, 'description' AS section, p_name AS text FROM part UNION ALL SELECT p_partkey, 'highlights', CASE WHEN p_size > 20 THEN p_type ELSE '' END FROM part UNION ALL SELECT p_partkey, 'results', p_brand FROM part) WHERE trim(text) <> ''""")
def section_unpivot(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("description"), F.when(F.col("p_size") > 20, F.col("p_type")).otherwise("").alias("highlights"), F.col("p_brand").alias("results"))
    return rows.unpivot(["p_partkey"], ["description", "highlights", "results"], "section", "text").where(F.trim("text") != "")


@query("max_score_per_group", """SELECT label, max(norm) AS best, count(*) AS hits FROM (SELECT label, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)), 6) AS norm FROM embeddings) GROUP BY label""")
def max_score_per_group(spark, sf_dir):
    norm = F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 6)
    return table(spark, sf_dir, "embeddings").select("label", norm.alias("norm")).groupBy("label").agg(F.max("norm").alias("best"), rows_n().alias("hits"))
