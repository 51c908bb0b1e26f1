"""Queries on organisations, concept matching and comparison metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import constants as C
from quarry.functions import text as T
from quarry.operators import entities as E
from quarry.operators import search as S
from quarry.registry import query
from quarry.session import table


def rows_n():
    return F.count(F.lit(1))


@query("org_class_counts", """WITH p AS (SELECT CASE p_size % 4 WHEN 0 THEN 'Ministry of Health (' || p_brand || ')' WHEN 1 THEN 'Asian Development Fund' WHEN 2 THEN p_brand || ' Insurance' ELSE p_name END AS name,
      CASE p_size % 4 WHEN 0 THEN 'HealthMinistry' WHEN 1 THEN 'DevelopmentBank' WHEN 2 THEN 'InsuranceCompany' ELSE 'PrivateOrganization' END AS class FROM part)
    SELECT class, count(DISTINCT name) AS n FROM p GROUP BY class""")
def org_class_counts(spark, sf_dir):
    kind = F.col("p_size") % 4
    name = F.when(kind == 0, F.concat(F.lit("Ministry of Health ("), "p_brand", F.lit(")"))).when(kind == 1, "Asian Development Fund").when(kind == 2, F.concat("p_brand", F.lit(" Insurance"))).otherwise(F.col("p_name"))
    rows = table(spark, sf_dir, "part").select(name.alias("name"))
    return rows.withColumn("class", T.organisation_class(F.col("name"), F.lit("private"))).groupBy("class").agg(F.countDistinct("name").alias("n"))


@query("similar_names")
def similar_names(spark, sf_dir):
    """Greedy fuzzy groups; checked by tests."""
    part = table(spark, sf_dir, "part")
    variants = part.select(F.concat("p_name", F.lit(" ltd")).alias("name")).union(part.select(F.concat("p_name", F.lit(" Limited"))))
    groups = E.similar_names(variants)
    return groups.join(E.best_names(groups), "canonical")


@query("concept_matches", r"""WITH c AS (SELECT DISTINCT p_type AS concept FROM part), t AS (SELECT p_partkey, split_part(p_type, ' ', 1) || ' ' || split_part(p_name, ' ', 1) AS text FROM part),
    n AS (SELECT p_partkey, concept, lower(text) AS a, lower(concept) AS b FROM t, c),
    m AS (SELECT *, list_distinct(string_split(a, ' ')) AS x, list_distinct(string_split(b, ' ')) AS y FROM n),
    k AS (SELECT p_partkey, concept, CASE WHEN a = b THEN 'exact' WHEN contains(a, b) OR contains(b, a) THEN 'partial' WHEN len(list_intersect(x, y)) / greatest(len(x), len(y)) > 0.3 THEN 'word_overlap' END AS kind,
      CASE WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN least(length(a), length(b)) / greatest(length(a), length(b)) ELSE len(list_intersect(x, y)) / greatest(len(x), len(y)) END AS confidence FROM m)
    SELECT p_partkey, concept, kind, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM k WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY confidence DESC, concept) <= 3""")
def concept_matches(spark, sf_dir):
    """Exact, containment and word overlap against a vocabulary; three best of each
    part's text. Texts that say the same are matched once."""
    part = table(spark, sf_dir, "part")
    concepts = part.select(F.col("p_type").alias("concept")).distinct()
    texts = part.select("p_partkey", F.concat_ws(" ", F.split("p_type", " ")[0], F.split("p_name", " ")[0]).alias("text"))
    found = E.best_matches(texts.select("text").distinct(), concepts, 3)
    return texts.join(found, "text").select("p_partkey", "concept", "kind", F.round("confidence", 6).alias("confidence"))


@query("lookup_cascade", """SELECT p_partkey, CASE WHEN split_part(p_type, ' ', 1) = 'PROMO' THEN 'known:promo' WHEN contains(p_type, 'STEEL') THEN 'fuzzy:steel' ELSE 'new:' || lower(replace(p_type, ' ', '_')) END AS uri FROM part""")
def lookup_cascade(spark, sf_dir):
    """Exact lookup, then containment with the first match winning, else a new uri."""
    exact = spark.createDataFrame([("PROMO", "known:promo")], "key string, uri string")
    fuzzy = spark.createDataFrame([("STEEL", "fuzzy:steel", 1)], "needle string, fuzzy_uri string, place int")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_type", F.split("p_type", " ")[0].alias("key"))
    joined = rows.join(F.broadcast(exact), "key", "left").join(F.broadcast(fuzzy), F.col("p_type").contains(F.col("needle")), "left")
    new = F.concat(F.lit("new:"), F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))))
    return joined.groupBy("p_partkey").agg(F.min_by(F.coalesce("uri", "fuzzy_uri", new), F.coalesce("place", F.lit(0))).alias("uri"))


@query("label_to_uri", """SELECT n_nationkey, CASE WHEN n_nationkey < 10 THEN 'sg:' || n_name ELSE 'sg:New_' || lower(replace(n_name, ' ', '_')) END AS uri FROM nation""")
def label_to_uri(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    known = nation.where("n_nationkey < 10").select(F.lower("n_name").alias("label"), F.concat(F.lit("sg:"), "n_name").alias("known"))
    joined = nation.withColumn("label", F.lower("n_name")).join(F.broadcast(known), "label", "left")
    return joined.select("n_nationkey", F.coalesce("known", F.concat(F.lit("sg:New_"), T.slug(F.col("n_name")))).alias("uri"))


_RULE_SQL = "SELECT doc_id, category, concept, label, 0.85 AS confidence, 'Keyword match: ' || first AS evidence FROM documents, (VALUES " + ", ".join(
    f"('{g}', '{u}', '{T_}', '{ks[0]}', [{', '.join(chr(39) + k.lower() + chr(39) for k in ks)}])" for g, rules in C.CONCEPT_KEYWORDS.items() for u, ks in rules.items()
    for T_ in ["".join((" " + ch if ch.isupper() else ch) for ch in u.split(":")[1]).strip()]
) + ") r(category, concept, label, first, words) WHERE len(list_filter(words, lambda w: contains(lower(text) || ' flood', w))) > 0 AND NOT (doc_id % 2 = 0 AND concept = 'sg:FloodRisk')"


@query("rule_concepts", _RULE_SQL)
def rule_concepts(spark, sf_dir):
    """Keyword rules add the concepts that a document does not have yet, by category."""
    docs = table(spark, sf_dir, "documents")
    # the lower-cased text is a column of its own, computed once for all rules
    low = docs.select("doc_id", F.concat(F.lower("text"), F.lit(" flood")).alias("low"))
    have = docs.where("doc_id % 2 = 0").select("doc_id", F.lit("sg:FloodRisk").alias("concept"))
    return E.keyword_concepts(low, F.col("low")).select("doc_id", "hit.*").join(have, ["doc_id", "concept"], "left_anti").select(
        "doc_id", "category", "concept", T.camel_label(F.col("concept")).alias("label"), F.lit(0.85).alias("confidence"), "evidence"
    )


@query("entity_routing", "SELECT event_id, event_type AS type, 'contextual' AS route FROM events WHERE event_type IN ('click', 'view')")
def entity_routing(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("type"))
    return E.routed(rows, ["click", "view"])


@query("text_quality_jaccard", r"""WITH p AS (SELECT a.conv_id, a.text AS x, b.text AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1),
    t AS (SELECT conv_id, list_distinct(regexp_extract_all(lower(x), '[\p{L}\p{N}_]+')) AS a, list_distinct(regexp_extract_all(lower(y), '[\p{L}\p{N}_]+')) AS b, length(x) AS n, length(y) AS m FROM p)
    SELECT conv_id, round(0.6 * len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) + 0.4 * least(n, m) / greatest(n, m), 6) AS quality FROM t""")
def text_quality_jaccard(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    a = turns.where("turn = 0").select("conv_id", F.col("text").alias("x"))
    b = turns.where("turn = 1").select("conv_id", F.col("text").alias("y"))
    return a.join(b, "conv_id").select("conv_id", F.round(E.text_quality(F.col("x"), F.col("y")), 6).alias("quality"))


@query("agreement_f1", """WITH a AS (SELECT p_type AS text FROM part WHERE p_size < 30), b AS (SELECT lower(p_type) AS text FROM part WHERE p_size > 20), c AS (SELECT count(*) AS common FROM (SELECT lower(text) FROM a INTERSECT SELECT lower(text) FROM b)),
    s AS (SELECT common / (SELECT count(*) FROM b) AS p, common / (SELECT count(*) FROM a) AS r FROM c) SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM s""")
def agreement_f1(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    found = E.agreement(part.where("p_size < 30").select(F.col("p_type").alias("text")), part.where("p_size > 20").select(F.lower("p_type").alias("text")))
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query("embedding_agreement", """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT a.label, round(list_cosine_similarity(a.v, b.v), 6) AS c FROM e a JOIN e b ON a.vec_id + 1 = b.vec_id)
    SELECT label, round(avg(c), 5) AS mean, round(stddev_pop(c), 5) AS deviation, min(c) AS low, max(c) AS high FROM s GROUP BY label""")
def embedding_agreement(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("w"))
    pairs = rows.join(other, "vec_id").select("label", F.round(S.cosine(F.col("embedding"), F.col("w")), 6).alias("c"))
    return pairs.groupBy("label").agg(F.round(F.avg("c"), 5).alias("mean"), F.round(F.stddev_pop("c"), 5).alias("deviation"), F.min("c").alias("low"), F.max("c").alias("high"))


@query("metric_recommendation", """WITH m AS (SELECT lang, avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0 END) AS mean, stddev_pop(quality) AS dev FROM labels JOIN documents USING (doc_id) GROUP BY lang)
    SELECT lang, round(mean, 6) AS mean, round(dev, 6) AS deviation, CASE WHEN mean > 0.7 THEN 'adopt' WHEN mean > 0.5 THEN 'review' ELSE 'reject' END AS recommendation FROM m""")
def metric_recommendation(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    m = table(spark, sf_dir, "labels").join(docs, "doc_id").groupBy("lang").agg(F.avg("quality").alias("mean"), F.stddev_pop("quality").alias("dev"))
    advice = F.when(F.col("mean") > 0.7, "adopt").when(F.col("mean") > 0.5, "review").otherwise("reject")
    return m.select("lang", F.round("mean", 6).alias("mean"), F.round("dev", 6).alias("deviation"), advice.alias("recommendation"))


@query("chunking_comparison", """SELECT lang, round(avg(n_chars), 4) AS mean_size, round(var_pop(n_chars), 2) AS variance, count(*) AS chunks FROM documents GROUP BY lang""")
def chunking_comparison(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.round(F.avg("n_chars"), 4).alias("mean_size"), F.round(F.var_pop("n_chars"), 2).alias("variance"), rows_n().alias("chunks"))


@query("entity_summary", """SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS contexts, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 4) AS mean FROM events GROUP BY event_type""")
def entity_summary(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        rows_n().alias("n"), F.countDistinct("user_id").alias("contexts"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"), F.round(F.avg("value"), 4).alias("mean")
    )


@query("top_entities_per_type", """SELECT event_type, user_id, n FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) <= 10""")
def top_entities_per_type(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(rows_n().alias("n"))
    nth = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("n"), "user_id"))
    return counts.withColumn("r", nth).where("r <= 10").drop("r")


@query("metadata_entities", """SELECT c_custkey, 'author' AS role, c_name AS name FROM customer UNION ALL SELECT c_custkey, 'publisher', c_mktsegment FROM customer WHERE c_acctbal > 0""")
def metadata_entities(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("author"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("publisher"))
    return rows.unpivot(["c_custkey"], ["author", "publisher"], "role", "name").where("name is not null")
