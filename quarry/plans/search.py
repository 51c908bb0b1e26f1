"""Hybrid retrieval over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import constants as C
from quarry.functions import text as T
from quarry.functions.stem import stem, stemmed_tokens
from quarry.operators import fuzzy, postings, vector_index
from quarry.operators import search as S
from quarry.registry import query
from quarry.session import materialise, scratch, table

TERMS = ("the", "than", "ereden")
TITLE = "split_part(text, chr(10), 1)"
_LIST = ", ".join(f"'{t}'" for t in TERMS)


def _title():
    return F.substring_index("text", "\n", 1)


def _fields():
    return {"title": (_title(), C.FIELD_BOOSTS["title"]), "content": (F.col("text"), C.FIELD_BOOSTS["content"])}


BM25_CTE = rf"""
d AS (SELECT doc_id, source, lang,
  list_filter(regexp_extract_all(lower({TITLE}), '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) >= 2) AS title,
  list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) >= 2) AS content FROM documents),
f AS (SELECT doc_id, 'title' AS field, 3.0 AS boost, title AS w FROM d UNION ALL SELECT doc_id, 'content', 2.0, content FROM d),
st AS (SELECT field, count(*) AS total, avg(len(w)) AS avg_n FROM f GROUP BY field),
tf AS (SELECT doc_id, field, boost, len(w) AS n, t.term, len(list_filter(w, lambda x: x = t.term)) AS tf
       FROM f, (SELECT unnest([{_LIST}]) AS term) t),
df AS (SELECT field, term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY ALL),
sc AS (SELECT doc_id, field, boost * sum(CASE WHEN tf > 0 THEN ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * n / avg_n)) ELSE 0 END) AS s
       FROM tf JOIN df USING (field, term) JOIN st USING (field) GROUP BY doc_id, field, boost),
bm AS (SELECT doc_id, round(max(s), 6) AS score FROM sc GROUP BY doc_id HAVING round(max(s), 6) > 0),
bmr AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm QUALIFY rank <= 200)
"""
VECTOR_CTE = """
q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0),
vs AS (SELECT vec_id AS doc_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q.v), 6) AS score FROM embeddings, q),
vr AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM vs QUALIFY rank <= 200)
"""
RRF_CTE = """
rr AS (SELECT doc_id, sum(1 / (rank + 60)) AS rrf FROM (SELECT doc_id, rank FROM bmr UNION ALL SELECT doc_id, rank FROM vr) GROUP BY doc_id)
"""


def _keyword(spark, sf_dir):
    return S.bm25(table(spark, sf_dir, "documents"), "doc_id", _fields(), TERMS)


def _vector(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return S.vector_scores(vectors, vectors.where("vec_id = 0").select(F.col("embedding").alias("query_vector")))


@query("bm25_search", f"WITH {BM25_CTE} SELECT doc_id, score, rank FROM bmr")
def bm25_search(spark, sf_dir):
    return S.ranked(_keyword(spark, sf_dir))


@query("bm25_indexed", f"WITH {BM25_CTE} SELECT doc_id, score, rank FROM bmr")
def bm25_indexed(spark, sf_dir):
    """The same ranking from a postings index, which is built once and read by term."""
    path = scratch(spark)
    postings.build(table(spark, sf_dir, "documents"), "doc_id", {name: value for name, (value, _) in _fields().items()}, path)
    return postings.ranked_search(spark, path, TERMS, {name: boost for name, (_, boost) in _fields().items()}, S.TOP)


@query(
    "object_text_search",
    r"""WITH o AS (SELECT 'p' || p_partkey AS s, 'name' AS p, p_name AS o FROM part UNION ALL SELECT 'p' || p_partkey, 'type', p_type FROM part
      UNION ALL SELECT 's' || s_suppkey, 'name', s_name FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'name', n_name FROM nation),
    d AS (SELECT s || ' ' || p AS doc_id, list_filter(regexp_extract_all(lower(o), '[\p{L}\p{N}_]+'), lambda x: length(x) >= 2) AS w FROM o),
    st AS (SELECT count(*) AS total, avg(len(w)) AS avg_n FROM d),
    tf AS (SELECT doc_id, len(w) AS n, t.term, len(list_filter(w, lambda x: x = t.term)) AS tf FROM d, (SELECT unnest(['blue', 'tin', 'germany']) AS term) t),
    df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY term)
    SELECT doc_id AS object, round(sum(CASE WHEN tf > 0 THEN ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * n / avg_n)) ELSE 0 END), 6) AS score
    FROM tf JOIN df USING (term), st GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 5""",
)
def object_text_search(spark, sf_dir):
    """The five best objects of triples for a few words, with their scores."""
    part, supplier, nation = (table(spark, sf_dir, name) for name in ("part", "supplier", "nation"))
    triple = lambda rows, kind, key, p, o: rows.select(F.concat(F.lit(kind), F.col(key), F.lit(f" {p}")).alias("object"), F.col(o).alias("o"))
    objects = (
        triple(part, "p", "p_partkey", "name", "p_name").union(triple(part, "p", "p_partkey", "type", "p_type"))
        .union(triple(supplier, "s", "s_suppkey", "name", "s_name")).union(triple(nation, "n", "n_nationkey", "name", "n_name"))
    )
    path = scratch(spark)
    postings.build(objects, "object", {"o": F.col("o")}, path)
    return postings.search(spark, path, ("blue", "tin", "germany"), {"o": 1.0}, 5).withColumnRenamed("doc_id", "object")


@query("bm25_stemmed")
def bm25_stemmed(spark, sf_dir):
    """Keyword search over stems without stop words; checked by brute force in tests."""
    terms = tuple(dict.fromkeys(stem(t) for t in ("tioning", "hands", "ereden")))
    return S.ranked(S.bm25(table(spark, sf_dir, "documents"), "doc_id", _fields(), terms, analyser=stemmed_tokens))


@query("vector_topk", f"WITH {VECTOR_CTE} SELECT doc_id, score, rank FROM vr")
def vector_topk(spark, sf_dir):
    return S.ranked(_vector(spark, sf_dir))


@query("vector_index_topk")
def vector_index_topk(spark, sf_dir):
    """The ten nearest of every hundredth vector among all rows, from the cell index;
    its recall is measured against brute force in tests."""
    vectors, path = table(spark, sf_dir, "embeddings"), scratch(spark)
    vector_index.build(vectors, path)
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    return vector_index.search(spark, path, asked, 10, skip_self=True)


@query(
    "vector_index_exact",
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    p AS (SELECT a.vec_id AS q, b.vec_id AS doc_id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
    SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM p QUALIFY rank <= 10""",
)
def vector_index_exact(spark, sf_dir):
    """The same question with every cell visited."""
    vectors, path = table(spark, sf_dir, "embeddings"), scratch(spark)
    vector_index.build(vectors, path)
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    return vector_index.search(spark, path, asked, 10, visits=None, skip_self=True)


@query(
    "hybrid_search_rrf",
    f"""WITH {BM25_CTE}, {VECTOR_CTE}, {RRF_CTE}
    SELECT doc_id, round(rrf / max(rrf) OVER (), 6) AS score FROM rr ORDER BY round(rrf / max(rrf) OVER (), 6) DESC, doc_id LIMIT 20""",
)
def hybrid_search_rrf(spark, sf_dir):
    fused = S.fuse(S.ranked(_keyword(spark, sf_dir)), S.ranked(_vector(spark, sf_dir)))
    scored = S.max_normalised(fused.withColumnRenamed("rrf", "score"), "score", few=True).withColumn("score", F.round("score", 6))
    return S.top(scored, 20)


@query(
    "rrf_worst_rank_of_chunks",
    f"""WITH {BM25_CTE}, {VECTOR_CTE},
    w AS (SELECT doc_id % 50 AS doc_id, max(rank) AS rank FROM vr GROUP BY 1)
    SELECT doc_id, round(sum(1 / (rank + 60)), 9) AS rrf FROM (SELECT doc_id, rank FROM bmr UNION ALL SELECT doc_id, rank FROM w) GROUP BY doc_id""",
)
def rrf_worst_rank_of_chunks(spark, sf_dir):
    """Vector hits are chunks of 50 documents: several ranks for each."""
    chunks = S.ranked(_vector(spark, sf_dir)).withColumn("doc_id", F.col("doc_id") % 50)
    fused = S.fuse(S.ranked(_keyword(spark, sf_dir)), chunks)
    return fused.select("doc_id", F.round("rrf", 9).alias("rrf"))


@query(
    "keyword_rerank",
    f"""WITH {BM25_CTE}, c AS (SELECT doc_id FROM documents WHERE lang = 'en'),
    s AS (SELECT c.doc_id, coalesce(bm.score, 0) AS s FROM c LEFT JOIN bm USING (doc_id))
    SELECT doc_id, round(CASE WHEN max(s) OVER () = 0 THEN 0 ELSE s / max(s) OVER () END, 6) AS score FROM s""",
)
def keyword_rerank(spark, sf_dir):
    """Candidates keep a place with score 0 where no term matches."""
    docs = table(spark, sf_dir, "documents")
    candidates = docs.where("lang = 'en'").select("doc_id")
    scores = S.bm25(docs, "doc_id", _fields(), TERMS, restrict=candidates)
    joined = candidates.join(scores, "doc_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return S.max_normalised(joined, "score").select("doc_id", F.round("score", 6).alias("score"))


@query(
    "vector_filtered",
    f"WITH {VECTOR_CTE} SELECT doc_id, score FROM vs WHERE label IN (1, 2, 3) ORDER BY score DESC, doc_id LIMIT 50",
)
def vector_filtered(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    one = vectors.where("vec_id = 0").select(F.col("embedding").alias("query_vector"))
    return S.top(S.vector_scores(vectors.where(F.col("label").isin(1, 2, 3)), one), 50)


@query(
    "weighted_scores",
    f"""WITH {BM25_CTE}, {VECTOR_CTE}
    SELECT doc_id, round(0.6 * coalesce(bm.score, 0) + 4.16 * coalesce(vs.score, 0), 5) AS score,
      CASE WHEN coalesce(vs.score, 0) >= 0.3 THEN 'high' WHEN coalesce(vs.score, 0) >= 0.1 THEN 'medium' ELSE 'low' END AS confidence
    FROM bm FULL JOIN vs USING (doc_id)""",
)
def weighted_scores(spark, sf_dir):
    weights, limits = C.SCORING["weights"], C.SCORING["confidence_thresholds"]
    keyword = _keyword(spark, sf_dir).withColumnRenamed("score", "k")
    vector = _vector(spark, sf_dir).withColumnRenamed("score", "v")
    k, v = F.coalesce("k", F.lit(0.0)), F.coalesce("v", F.lit(0.0))
    level = F.when(v >= limits["high"], "high").when(v >= limits["medium"], "medium").otherwise("low")
    return keyword.join(vector, "doc_id", "full").select(
        "doc_id", F.round(weights["keyword"] * k + weights["vector"] * v, 5).alias("score"), level.alias("confidence")
    )


@query(
    "engine_concat",
    f"""WITH {BM25_CTE}, {VECTOR_CTE} SELECT doc_id, score, 'keyword' AS engine FROM bmr UNION ALL SELECT doc_id, score, 'vector' FROM vr""",
)
def engine_concat(spark, sf_dir):
    """Hits of both engines one below the other, duplicates kept."""
    parts = [S.top(s).withColumn("engine", F.lit(n)) for s, n in ((_keyword(spark, sf_dir), "keyword"), (_vector(spark, sf_dir), "vector"))]
    return parts[0].unionByName(parts[1]).orderBy(F.desc("score"), "doc_id")


@query(
    "method_score_ranges",
    f"""WITH {BM25_CTE}, {VECTOR_CTE}, a AS (SELECT 'keyword' AS method, score FROM bmr UNION ALL SELECT 'vector', score FROM vr)
    SELECT method, count(*) AS n, min(score) AS low, max(score) AS high, round(avg(score), 6) AS mean FROM a GROUP BY method""",
)
def method_score_ranges(spark, sf_dir):
    both = engine_concat(spark, sf_dir).withColumnRenamed("engine", "method")
    return both.groupBy("method").agg(
        F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"), F.round(F.avg("score"), 6).alias("mean")
    )


@query(
    "score_statistics",
    """WITH s AS (SELECT event_type, value FROM events WHERE value IS NOT NULL),
    a AS (SELECT event_type, count(*) AS n, min(value) AS low, max(value) AS high, avg(value) AS mean, stddev_pop(value) AS deviation,
      median(value) AS median, list_sort(list(value))[CAST(floor(0.95 * (count(*) - 1)) AS INT) + 1] AS p95 FROM s GROUP BY event_type)
    SELECT event_type, n, low, high, round(mean, 4) AS mean, round(deviation, 4) AS deviation, round(median, 6) AS median, p95,
      CASE WHEN n < 3 THEN 'insufficient_data' WHEN low > 0 AND deviation / mean > 1 THEN 'log_normal'
           WHEN low > 0 AND high > 10 * low THEN 'power_law' ELSE 'normal' END AS kind FROM a""",
)
def score_statistics(spark, sf_dir):
    found = S.score_statistics(table(spark, sf_dir, "events"), ["event_type"], "value")
    return found.select(
        "event_type", "n", "low", "high", F.round("mean", 4).alias("mean"), F.round("deviation", 4).alias("deviation"),
        F.round("median", 6).alias("median"), "p95", "kind",
    )


@query(
    "percentile_bounds",
    """SELECT event_type, round(quantile_cont(value, 0.05), 6) AS low, round(quantile_cont(value, 0.95), 6) AS high FROM events GROUP BY event_type""",
)
def percentile_bounds(spark, sf_dir):
    """Interpolated bounds, unlike the floor index of score_statistics."""
    found = S.quantiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"low": 0.05, "high": 0.95})
    return found.select("event_type", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(
    "score_outliers",
    """WITH s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS d FROM events GROUP BY event_type)
    SELECT event_id, CASE WHEN d = 0 THEN false ELSE abs(value - m) / d > 2 END AS outlier FROM events JOIN s USING (event_type) WHERE value IS NOT NULL""",
)
def score_outliers(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    stats = events.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("d"))
    away = F.when(F.col("d") == 0, False).otherwise(F.abs(F.col("value") - F.col("m")) / F.col("d") > 2)
    return events.join(stats, "event_type").where("value is not null").select("event_id", away.alias("outlier"))


@query(
    "filter_terms_any",
    """SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21') AND (string_split(p_type, ' ')[1] IN ('STANDARD', 'ECONOMY', 'PROMO')) AND p_size > 10""",
)
def filter_terms_any(spark, sf_dir):
    """Any of within a field, all fields together."""
    kinds = F.array(*map(F.lit, ("STANDARD", "ECONOMY", "PROMO")))
    return table(spark, sf_dir, "part").where(
        F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13", "Brand#21")
        & F.arrays_overlap(F.slice(F.split("p_type", " "), 1, 1), kinds) & (F.col("p_size") > 10)
    ).select("p_partkey")


@query(
    "any_term_match",
    rf"""WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'))) AS w FROM documents)
    SELECT DISTINCT doc_id FROM t WHERE w IN ({_LIST})""",
)
def any_term_match(spark, sf_dir):
    wanted = F.array(*map(F.lit, TERMS))
    return table(spark, sf_dir, "documents").where(F.arrays_overlap(T.tokens(F.col("text")), wanted)).select("doc_id")


@query(
    "two_list_lexical_filter",
    """SELECT doc_id FROM documents WHERE (contains(lower(text), 'ther') OR contains(lower(text), 'erung')) AND (contains(lower(text), 'tion') OR contains(lower(text), 'keit'))""",
)
def two_list_lexical_filter(spark, sf_dir):
    """One term of each list, as substrings."""
    low = F.lower("text")
    return table(spark, sf_dir, "documents").where(
        T.contains_any(low, ("ther", "erung")) & T.contains_any(low, ("tion", "keit"))
    ).select("doc_id")


@query(
    "tsd_selection",
    """WITH qv AS (SELECT vec_id AS q, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT q, vec_id % 200 AS doc_id, max(round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 6)) AS score FROM embeddings, qv GROUP BY 1, 2),
    n AS (SELECT q, doc_id, score / max(score) OVER (PARTITION BY q) AS norm, max(score) OVER (PARTITION BY q) AS m FROM s),
    c AS (SELECT q, doc_id, norm FROM n JOIN documents USING (doc_id) WHERE m <> 0 AND norm >= 0.2
          AND (contains(lower(text), 'ther') OR contains(lower(text), 'erung'))),
    t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY norm DESC, doc_id) AS r FROM c QUALIFY r <= 3)
    SELECT doc_id, round(max(norm), 6) AS best, count(*) AS hits FROM t GROUP BY doc_id""",
)
def tsd_selection(spark, sf_dir):
    """The best three documents of each query vector (every hundredth) that pass a
    lexical test, with their best normalised score and number of hits."""
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    per_doc = materialise(S.best_of_groups(vectors, queries, F.col("vec_id") % 200))
    most = per_doc.groupBy("q").agg(F.max("score").alias("m"))
    norm = per_doc.join(most, "q").where("m != 0").withColumn("norm", F.col("score") / F.col("m")).where("norm >= 0.2")
    docs = table(spark, sf_dir, "documents").where(T.contains_any(F.lower("text"), ("ther", "erung"))).select("doc_id")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("norm"), "doc_id"))
    chosen = norm.join(docs, "doc_id").withColumn("r", nth).where("r <= 3")
    return chosen.groupBy("doc_id").agg(F.round(F.max("norm"), 6).alias("best"), F.count(F.lit(1)).alias("hits")).orderBy(F.desc("best"), F.desc("hits"), "doc_id")


@query(
    "facet_counts",
    """SELECT 'types' AS facet, v AS value, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS v FROM part) GROUP BY v
    UNION ALL SELECT 'names', v, count(*) FROM (SELECT unnest(string_split(p_name, ' ')) AS v FROM part) GROUP BY v
    UNION ALL SELECT 'brand', coalesce(CASE WHEN p_size > 40 THEN NULL ELSE p_brand END, 'unknown'), count(*) FROM part GROUP BY 2""",
)
def facet_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(
        F.split("p_type", " ").alias("types"), F.split("p_name", " ").alias("names"),
        F.when(F.col("p_size") <= 40, F.col("p_brand")).alias("brand"),
    )
    return S.facets(rows, ["types", "names"], ["brand"])


@query(
    "cursor_page",
    """SELECT c_custkey, c_acctbal, 2 AS current_page, count(*) OVER () AS total_results, CAST(ceil(count(*) OVER () / 20) AS BIGINT) AS total_pages,
    true AS has_next, true AS has_previous FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 20""",
)
def cursor_page(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return S.page(rows, [F.desc("c_acctbal"), F.col("c_custkey")], 20, 2)


@query(
    "filtered_listing",
    """SELECT o_orderkey, o_orderpriority, count(*) OVER () AS total FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31'
    AND o_orderpriority IN ('1-URGENT', '2-HIGH') ORDER BY o_orderkey LIMIT 30 OFFSET 10""",
)
def filtered_listing(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where(
        F.col("o_orderdate").between(F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1995-12-31").cast("timestamp_ntz"))
        & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    ).select("o_orderkey", "o_orderpriority")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy("o_orderkey").offset(10).limit(30).join(F.broadcast(total))


@query(
    "fuzzy_term_match",
    r"""WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS w FROM documents)
    SELECT doc_id, count(*) AS score FROM t WHERE regexp_full_match(w, '[a-z]+') AND abs(length(w) - 6) <= 2 AND levenshtein(w, 'ereden') <= 2 GROUP BY doc_id""",
)
def fuzzy_term_match(spark, sf_dir):
    """Terms of Latin letters; edits allowed by the term's length: none below three characters, one below six, else two."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text"), 1))).alias("term")).where(F.col("term").rlike("^[a-z]+$"))
    near = fuzzy.near_terms(words, spark.createDataFrame([("ereden",)], "query string"))
    return words.join(near.select("term"), "term").groupBy("doc_id").agg(F.count(F.lit(1)).alias("score"))


@query(
    "fuzzy_word_search",
    r"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z]+'))) AS term FROM documents),
    q AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS query FROM part), k AS (SELECT query, CASE WHEN length(query) < 3 THEN 0 WHEN length(query) < 6 THEN 1 ELSE 2 END AS k FROM q),
    n AS (SELECT query, term, levenshtein(query, term) AS d FROM (SELECT DISTINCT term FROM w) JOIN k ON abs(length(query) - length(term)) <= k AND levenshtein(query, term) <= k)
    SELECT query, doc_id, count(DISTINCT term) AS terms, count(*) AS hits, min(d) AS nearest FROM w JOIN n USING (term) GROUP BY ALL""",
)
def fuzzy_word_search(spark, sf_dir):
    """Every word of the parts' names against the words of every text."""
    words = F.filter(T.tokens(F.col("text"), 1), lambda w: w.rlike("^[a-z]+$"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(words).alias("term"))
    queries = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("query"))
    return fuzzy.fuzzy_words(rows, queries)


@query(
    "falsy_score_order",
    """SELECT vec_id, CASE WHEN label = 0 THEN vec_id ELSE label END AS score FROM embeddings ORDER BY 2 DESC, vec_id LIMIT 40""",
)
def falsy_score_order(spark, sf_dir):
    """A final score of zero falls back to the raw score."""
    score = F.coalesce(F.nullif(F.col("label"), F.lit(0)), F.col("vec_id"))
    return table(spark, sf_dir, "embeddings").select("vec_id", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(40)


@query(
    "related_vectors",
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    p AS (SELECT a.vec_id, b.vec_id AS other, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
    SELECT vec_id, other, score FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, other) <= 5""",
)
def related_vectors(spark, sf_dir):
    """The five nearest of every hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    found = S.nearest(vectors, asked, 5, skip_self=True)
    return found.select(F.col("q").alias("vec_id"), F.col("doc_id").alias("other"), "score")
