"""Queries over triples, taxonomies and ontologies.

region, nation, customer and supplier stand for a taxonomy; orders and lineitem
for documents and their parts.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import constants as C
from quarry.functions import text as T
from quarry.operators import graph as G
from quarry.registry import query
from quarry.session import table


def rows_n():
    return F.count(F.lit(1))


def _edges(spark, sf_dir):
    """child below parent: customers below nations below regions below the root."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"))
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey"), F.lit("root"))
    return c.union(n).union(r)


EDGES_CTE = """e AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region)"""
UP_CTE = "up(child, parent, depth) AS (SELECT child, parent, 1 FROM e UNION ALL SELECT up.child, e.parent, up.depth + 1 FROM up JOIN e ON e.child = up.parent)"


def _triples(spark, sf_dir):
    nations = G.triples(
        table(spark, sf_dir, "nation"), F.concat(F.lit("n"), "n_nationkey"),
        {"name": F.col("n_name"), "within": F.concat(F.lit("r"), "n_regionkey"), "code": F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey"))}, {"within": "iri"}, "nations",
    )
    regions = G.triples(table(spark, sf_dir, "region"), F.concat(F.lit("r"), "r_regionkey"), {"name": F.col("r_name")}, graph="regions")
    return nations.union(regions)


TRIPLES_CTE = """t AS (SELECT 'n' || n_nationkey AS s, 'name' AS p, n_name AS o, 'literal' AS o_kind, 'nations' AS g FROM nation
  UNION ALL SELECT 'n' || n_nationkey, 'within', 'r' || n_regionkey, 'iri', 'nations' FROM nation
  UNION ALL SELECT 'n' || n_nationkey, 'code', CAST(n_nationkey AS VARCHAR), 'literal', 'nations' FROM nation WHERE n_nationkey % 2 = 0
  UNION ALL SELECT 'r' || r_regionkey, 'name', r_name, 'literal', 'regions' FROM region)"""


@query("taxonomy_closure", f"WITH RECURSIVE {EDGES_CTE}, {UP_CTE} SELECT child, parent, depth FROM up")
def taxonomy_closure(spark, sf_dir):
    return G.closure(spark, _edges(spark, sf_dir))


@query("hierarchical_filter", f"WITH RECURSIVE {EDGES_CTE}, {UP_CTE} SELECT DISTINCT child FROM up WHERE parent IN ('r1', 'n3') UNION SELECT 'r1' UNION SELECT 'n3'")
def hierarchical_filter(spark, sf_dir):
    """Exact matches and everything below them."""
    below = G.closure(spark, _edges(spark, sf_dir)).where(F.col("parent").isin("r1", "n3")).select("child")
    return below.union(spark.createDataFrame([("r1",), ("n3",)], "child string")).distinct()


@query("not_in_taxonomy", f"WITH RECURSIVE {EDGES_CTE}, {UP_CTE} SELECT DISTINCT 'n' || s_nationkey AS used FROM supplier WHERE 'n' || s_nationkey NOT IN (SELECT child FROM up WHERE parent = 'r0')")
def not_in_taxonomy(spark, sf_dir):
    used = table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("used")).distinct()
    known = G.closure(spark, _edges(spark, sf_dir)).where("parent = 'r0'").select(F.col("child").alias("used"))
    return used.join(known, "used", "left_anti")


@query("region_members", "SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'")
def region_members(spark, sf_dir):
    asia = table(spark, sf_dir, "region").where("r_name = 'ASIA'").select(F.col("r_regionkey").alias("n_regionkey"))
    nations = table(spark, sf_dir, "nation").join(asia, "n_regionkey", "left_semi").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, sf_dir, "customer").join(nations, "c_nationkey", "left_semi").select("c_custkey")


@query("without_relation", "SELECT count(DISTINCT c_custkey) AS without_orders FROM customer ANTI JOIN orders ON o_custkey = c_custkey")
def without_relation(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(orders, "c_custkey", "left_anti").agg(F.countDistinct("c_custkey").alias("without_orders"))


@query("tree_worksheet", f"""WITH RECURSIVE {EDGES_CTE}, d(node, level, path) AS (SELECT 'root', 0, 'root' UNION ALL SELECT e.child, d.level + 1, d.path || '/' || e.child FROM d JOIN e ON e.parent = d.node WHERE d.level < 2)
    SELECT path, CASE WHEN level = 0 THEN node END AS level_0, CASE WHEN level = 1 THEN node END AS level_1, CASE WHEN level = 2 THEN node END AS level_2 FROM d""")
def tree_worksheet(spark, sf_dir):
    """The tree to a depth, a column per level, ordered by path."""
    _edges(spark, sf_dir).createOrReplaceTempView("_tree")
    rows = spark.sql("""WITH RECURSIVE d(node, level, path) AS (SELECT 'root', 0, 'root' UNION ALL
        SELECT e.child, d.level + 1, concat(d.path, '/', e.child) FROM d JOIN _tree e ON e.parent = d.node WHERE d.level < 2) SELECT * FROM d""")
    return rows.select("path", *[F.when(F.col("level") == k, F.col("node")).alias(f"level_{k}") for k in range(3)]).orderBy("path")


@query("star_pattern", f"WITH {TRIPLES_CTE} SELECT a.s AS n, a.o AS label, b.o AS region, c.o AS region_name, d.o AS code FROM t a JOIN t b ON a.s = b.s AND b.p = 'within' JOIN t c ON c.s = b.o AND c.p = 'name' LEFT JOIN t d ON d.s = a.s AND d.p = 'code' WHERE a.p = 'name'")
def star_pattern(spark, sf_dir):
    """A chain of patterns with an optional part."""
    return G.match(
        _triples(spark, sf_dir), [("?n", "name", "?label"), ("?n", "within", "?region"), ("?region", "name", "?region_name")], [[("?n", "code", "?code")]]
    )


@query("named_graph_pattern", f"WITH {TRIPLES_CTE} SELECT s AS n, o AS label FROM t WHERE g = 'regions' AND p = 'name'")
def named_graph_pattern(spark, sf_dir):
    return G.match(_triples(spark, sf_dir), [("?n", "name", "?label")], graph="regions")


@query("unbound_or_in", f"WITH {TRIPLES_CTE}, m AS (SELECT a.s, d.o AS code FROM t a LEFT JOIN t d ON d.s = a.s AND d.p = 'code' WHERE a.p = 'within') SELECT s AS n, code FROM m WHERE code IS NULL OR code IN ('2', '4')")
def unbound_or_in(spark, sf_dir):
    found = G.match(_triples(spark, sf_dir), [("?n", "within", "?r")], [[("?n", "code", "?code")]])
    return found.where(F.col("code").isNull() | F.col("code").isin("2", "4")).select("n", "code")


@query("compatible_join", f"""WITH {TRIPLES_CTE}, a AS (SELECT x.s AS n, d.o AS code FROM t x LEFT JOIN t d ON d.s = x.s AND d.p = 'code' WHERE x.p = 'within'), b AS (SELECT o AS code, s AS owner FROM t WHERE p = 'code' AND CAST(o AS INT) < 6)
    SELECT a.n, coalesce(a.code, b.code) AS code, b.owner FROM a JOIN b ON a.code = b.code OR a.code IS NULL""")
def compatible_join(spark, sf_dir):
    """An unbound shared variable is compatible with every value."""
    data = _triples(spark, sf_dir)
    a = G.match(data, [("?n", "within", "?r")], [[("?n", "code", "?code")]]).select("n", "code")
    return G.compatible_join(a, G.match(data, [("?owner", "code", "?code")]).where(F.col("code").cast("int") < 6).select("code", "owner"))


@query("minus_pattern", f"WITH {TRIPLES_CTE} SELECT s AS n FROM t WHERE p = 'within' AND s NOT IN (SELECT s FROM t WHERE p = 'code')")
def minus_pattern(spark, sf_dir):
    data = _triples(spark, sf_dir)
    return G.minus(G.match(data, [("?n", "within", "?r")]).select("n"), G.match(data, [("?n", "code", "?code")]))


@query("graph_update", f"""WITH {TRIPLES_CTE}, del AS (SELECT * FROM t WHERE p = 'code'), ins AS (SELECT s, 'label' AS p, o, o_kind, g FROM t WHERE p = 'name')
    SELECT s, p, o, g FROM t WHERE p <> 'code' UNION SELECT s, p, o, g FROM ins""")
def graph_update(spark, sf_dir):
    data = _triples(spark, sf_dir)
    return G.update(data, data.where("p = 'code'"), data.where("p = 'name'").withColumn("p", F.lit("label"))).select("s", "p", "o", "g")


@query("graph_management", f"""WITH {TRIPLES_CTE} SELECT 'clear' AS op, count(*) AS n FROM t WHERE g <> 'nations' UNION ALL SELECT 'copy', (SELECT count(*) FROM t WHERE g = 'regions') * 2
    UNION ALL SELECT 'move', (SELECT count(*) FROM t WHERE g = 'regions') UNION ALL SELECT 'add', count(*) + (SELECT count(*) FROM t WHERE g = 'regions') FROM t""")
def graph_management(spark, sf_dir):
    data = _triples(spark, sf_dir)
    results = {"clear": G.clear(data, "nations"), "copy": G.copy(data, "regions", "nations"), "move": G.move(data, "regions", "nations"), "add": G.add(data, "regions", "nations")}
    parts = [rows.agg(rows_n().alias("n")).select(F.lit(op).alias("op"), "n") for op, rows in results.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("turtle_lines", f"""WITH {TRIPLES_CTE} SELECT '<' || s || '> <' || p || '> ' || CASE WHEN o_kind = 'literal' THEN '"' || o || '"' ELSE '<' || o || '>' END || ' .' AS value FROM t""")
def turtle_lines(spark, sf_dir):
    return G.to_turtle(_triples(spark, sf_dir))


@query("nquads_round_trip", f"WITH {TRIPLES_CTE} SELECT s, p, o, o_kind, CASE WHEN p = 'name' THEN 'en' END AS o_lang, g FROM t")
def nquads_round_trip(spark, sf_dir):
    iri = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    lang = F.when(F.col("p") == "name", "@en").otherwise("")
    value = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), "o", F.lit('"'), lang)).otherwise(iri("o"))
    lines = _triples(spark, sf_dir).select(F.concat_ws(" ", iri("s"), iri("p"), value, iri("g"), F.lit(".")).alias("value"))
    noise = spark.createDataFrame([("# a comment",), ("not a statement",)], "value string")
    return G.parse_nquads(lines.union(noise)).select("s", "p", "o", "o_kind", "o_lang", "g")


@query("predicate_whitelist", """SELECT event_id FROM events WHERE event_id % 3 = 0 AND event_type IN ('click', 'view') OR event_id % 3 = 1 AND event_type = 'error'""")
def predicate_whitelist(spark, sf_dir):
    """A semi join with a small rule table of graph and predicate."""
    rules = spark.createDataFrame([(0, "click"), (0, "view"), (1, "error")], "kind int, event_type string")
    rows = table(spark, sf_dir, "events").withColumn("kind", (F.col("event_id") % 3).cast("int"))
    return rows.join(F.broadcast(rules), ["kind", "event_type"], "left_semi").select("event_id")


@query("subject_filter_two_pass", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)")
def subject_filter_two_pass(spark, sf_dir):
    """All facts of the subjects that one fact selects."""
    lines = table(spark, sf_dir, "lineitem")
    chosen = lines.where("l_returnflag = 'R' and l_quantity > 45").select("l_orderkey")
    return lines.select("l_orderkey", "l_linenumber").join(chosen, "l_orderkey", "left_semi")


@query("concept_documents", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey IN (1, 2, 3, 5, 8) ORDER BY 1 LIMIT 50")
def concept_documents(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where(F.col("l_partkey").isin(1, 2, 3, 5, 8)).select("l_orderkey").distinct().orderBy("l_orderkey").limit(50)


@query("concept_co_occurrences", "SELECT b.l_partkey AS other, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey WHERE a.l_partkey IN (1, 2, 3) GROUP BY 1")
def concept_co_occurrences(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    asked = lines.where(F.col("l_partkey").isin(1, 2, 3)).withColumnRenamed("l_partkey", "asked")
    return asked.join(lines.withColumnRenamed("l_partkey", "other"), "l_orderkey").where("asked != other").groupBy("other").agg(rows_n().alias("n"))


@query("concept_summary", "SELECT l_orderkey, l_partkey, count(*) AS mentions, round(avg(l_discount), 6) AS confidence FROM lineitem GROUP BY ALL")
def concept_summary(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(rows_n().alias("mentions"), F.round(F.avg("l_discount"), 6).alias("confidence"))


@query("chunks_by_concept", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_partkey = 10 AND l_discount >= 0.03 ORDER BY l_discount DESC, l_orderkey, l_linenumber")
def chunks_by_concept(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_partkey = 10 and l_discount >= 0.03").select("l_orderkey", "l_linenumber", "l_discount").orderBy(F.desc("l_discount"), "l_orderkey", "l_linenumber")


@query("entity_neighbourhood", "SELECT p_partkey, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_orderkey) AS documents, count(*) AS mentions FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def entity_neighbourhood(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey", "l_orderkey")
    known = table(spark, sf_dir, "part").select("p_partkey")
    return lines.join(known, "p_partkey").groupBy("p_partkey").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_orderkey").alias("documents"), rows_n().alias("mentions"))


@query("one_hop_pattern", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 2 AND s_acctbal > 0")
def one_hop_pattern(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return table(spark, sf_dir, "supplier").where("s_acctbal > 0").join(nations, "s_nationkey").select("s_suppkey", "n_name")


@query("context_scoring", """WITH c AS (SELECT c_custkey AS id, c_custkey % 5 <> 0 AS places, ['US', 'FR', 'IN', 'BR'][c_custkey % 4 + 1] AS country, c_custkey * 1000 AS people, c_custkey % 3 AS t FROM customer),
    b AS (SELECT *, CASE WHEN t = 0 THEN CASE WHEN country = 'US' THEN 0.3 ELSE -0.15 END WHEN t = 1 AND country = 'FR' OR t = 2 AND country = 'IN' THEN 0.3 ELSE 0 END + 0.4 + CASE WHEN country = 'IN' THEN 0.32 ELSE 0 END
      + CASE WHEN people > 1000000 THEN 0.1 WHEN people > 100000 THEN 0.05 ELSE 0 END + 0.2 AS boost FROM c)
    SELECT id, round(CAST(least(0.5 + CASE WHEN places THEN boost ELSE 0.15 END, 1) AS DOUBLE), 6) AS confidence,
      concat_ws('|', CASE t WHEN 0 THEN 'doc_north_american_context' WHEN 1 THEN 'doc_european_context' ELSE 'doc_asian_context' END, 'co_occurrence_with_2_locations', 'semantic_geographic:country_context',
        CASE WHEN people > 1000000 THEN 'major_city_population' WHEN people > 100000 THEN 'medium_city_population' END) AS signals FROM b""")
def context_scoring(spark, sf_dir):
    """Geographic and general boosts of alignments."""
    from quarry.operators.entities import context_boost

    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("c_custkey") % n + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 != 0, "geonames").otherwise("hazards").alias("ontology"), F.lit("Flood").alias("entity"), F.lit(0.5).alias("confidence"),
        pick(("US", "FR", "IN", "BR"), 4).alias("country"), F.lit("Illinois").alias("admin1"), (F.col("c_custkey") * 1000).alias("population"),
        pick(("Flood risk in the USA", "European funds", "South Asia report"), 3).alias("title"),
        F.array(F.lit("Illinois"), F.lit("India")).alias("locations"), F.array(F.lit("geographic:country_context")).alias("signals"), F.array(F.lit("flood")).alias("keywords"),
    )
    return context_boost(rows).select("id", F.round("confidence", 6).alias("confidence"), F.array_join("context_signals", "|").alias("signals"))


@query("admin_code_filter", "SELECT p_partkey, 'A.ADM' || (p_size % 6) AS code FROM part WHERE p_size % 6 BETWEEN 1 AND 4")
def admin_code_filter(spark, sf_dir):
    code = F.concat(F.lit("A.ADM"), F.col("p_size") % 6)
    return table(spark, sf_dir, "part").select("p_partkey", code.alias("code")).where(F.col("code").isin(*C.ADMIN_CODES))


@query("population_top", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS population FROM customer ORDER BY population DESC NULLS LAST, c_custkey LIMIT 20")
def population_top(spark, sf_dir):
    value = F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal"))
    return table(spark, sf_dir, "customer").select("c_custkey", value.alias("population")).orderBy(F.desc_nulls_last("population"), "c_custkey").limit(20)


@query("fts_graph_join", "SELECT p_partkey, l_orderkey, l_linenumber FROM (SELECT p_partkey FROM part WHERE list_contains(string_split(lower(p_name), ' '), 'blue') OR list_contains(string_split(lower(p_type), ' '), 'tin')) JOIN lineitem ON l_partkey = p_partkey")
def fts_graph_join(spark, sf_dir):
    """A term lookup feeding a graph join."""
    hits = table(spark, sf_dir, "part").where(F.array_contains(T.tokens(F.col("p_name")), "blue") | F.array_contains(T.tokens(F.col("p_type")), "tin")).select("p_partkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber")
    return lines.join(hits, "p_partkey").select("p_partkey", "l_orderkey", "l_linenumber")


@query("bag_union", "SELECT 'name' AS field, p_partkey FROM part WHERE contains(p_name, 'a') UNION ALL SELECT 'type', p_partkey FROM part WHERE contains(p_type, 'A') UNION ALL SELECT 'brand', p_partkey FROM part WHERE contains(p_brand, '1')")
def bag_union(spark, sf_dir):
    """Three fields searched, duplicates kept."""
    part = table(spark, sf_dir, "part")
    parts = [part.where(F.col(c).contains(t)).select(F.lit(f).alias("field"), "p_partkey") for f, c, t in (("name", "p_name", "a"), ("type", "p_type", "A"), ("brand", "p_brand", "1"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("concept_lookup", f"""WITH {TRIPLES_CTE} SELECT 'label' AS kind, s, o AS value FROM t WHERE p = 'name' AND (contains(lower(o), 'an') OR levenshtein(lower(o), 'asia') <= 2)
    UNION ALL SELECT 'uri', p, o FROM t WHERE s = 'n4' UNION ALL SELECT 'in', s, p FROM t WHERE o = 'r2' AND o_kind = 'iri' UNION ALL SELECT 'no_label', s, '' FROM (SELECT DISTINCT s FROM t) WHERE s NOT IN (SELECT s FROM t WHERE p = 'name')""")
def concept_lookup(spark, sf_dir):
    """Lookups by label, uri and relation, and validation."""
    o = G.Ontology(_triples(spark, sf_dir))
    label = o.by_label("asia").union(o.by_label("an", 0)).distinct().select(F.lit("label").alias("kind"), "s", F.col("label").alias("value"))
    uri = o.by_uri("n4").select(F.lit("uri"), "p", "o")
    links = o.relations("r2").where("direction = 'in'").select(F.lit("in"), "other", "p")
    return label.union(uri).union(links).union(o.problems().where("problem = 'no_label'").select("problem", "s", F.lit("")))


@query("ontology_statistics", f"WITH {TRIPLES_CTE} SELECT p, count(*) AS n, count(DISTINCT s) AS subjects FROM t GROUP BY p")
def ontology_statistics(spark, sf_dir):
    return G.Ontology(_triples(spark, sf_dir)).statistics()


@query("gazetteer_lookup", "SELECT c_custkey, CASE WHEN n_nationkey < 20 THEN 'gn:' || n_nationkey END AS uri FROM customer JOIN nation ON n_nationkey = c_nationkey")
def gazetteer_lookup(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    names = nation.where("n_nationkey < 20").select(F.lower("n_name").alias("name"), F.concat(F.lit("gn:"), "n_nationkey").alias("uri"))
    rows = table(spark, sf_dir, "customer").join(nation.select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit(" "), "n_name").alias("country")), "c_nationkey")
    return G.gazetteer_ids(rows.select("c_custkey", "country"), names).select("c_custkey", "uri")
